"""Model manifests and model files."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritab.functions import sqltext
from veritab.session import materialize

# Resource types taken from a manifest.
RESOURCE_TYPES = ["model", "seed", "snapshot", "source"]
# Bytes of texts that are parsed together.
TOGETHER = 65_536

_COLUMNS = "map<string, struct<data_type: string, description: string>>"
MANIFEST_SCHEMA = (
    "metadata struct<project_name: string>, "
    "nodes map<string, struct<resource_type: string, database: string, `schema`: string, name: string, "
    f"alias: string, description: string, columns: {_COLUMNS}, "
    "depends_on: struct<nodes: array<string>>, raw_code: string, compiled_code: string>>, "
    "sources map<string, struct<database: string, `schema`: string, source_name: string, name: string, "
    f"identifier: string, description: string, columns: {_COLUMNS}>>"
)


def read_manifests(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Parsed manifest documents, one row each."""
    return spark.read.schema(MANIFEST_SCHEMA).json(path, multiLine=multi_line)


def _mark(name):
    return f'{{"_mark":"{name}"}}'


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of some ``TOGETHER`` bytes as one list, with a mark that no text can know before, between and after them."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts, name = batch.column(0).fill_null("null"), uuid.uuid4().hex
        part = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)) // TOGETHER
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(texts)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(cuts), texts), f",{_mark(name)},")
        whole = pc.binary_join_element_wise(f'{{"d":[{_mark(name)}', joined, f"{_mark(name)}]}}", ",")
        yield pa.RecordBatch.from_arrays([whole, pa.array([name] * len(whole), pa.string()), pa.array(np.diff(cuts), pa.int32())], ["value", "name", "n"])


def parse_manifests(texts: DataFrame, column: str = "value") -> DataFrame:
    """Manifest documents of a text column.

    For each text with a name not met before the parser copies all names it keeps, so texts are parsed many at a time, as one list. If the
    list has any error, or other elements than one between each two marks, its texts are parsed one by one.
    """
    one = T.StructType(texts.sparkSession.createDataFrame([], MANIFEST_SCHEMA).schema.fields + [T.StructField("_mark", T.StringType())])
    listed = T.StructType([T.StructField("d", T.ArrayType(one)), T.StructField("_bad", T.StringType())])
    found = (
        texts.select(F.col(column).cast("string")).mapInArrow(_together, "value string, name string, n int")
        .select("*", F.from_json("value", listed, {"columnNameOfCorruptRecord": "_bad"}).alias("m"))
    )
    d, n, own = F.col("m.d"), F.col("n"), len(_mark("0" * 32)) + 1
    marks = F.filter(d, lambda e, i: (i % 2 == 0) & (e["_mark"] == F.col("name")))
    fine = F.col("m._bad").isNull() & (F.size(d) == 2 * n + 1) & (F.size(marks) == n + 1)
    body = F.substr("value", F.lit(len('{"d":[') + own + 1), F.length("value") - F.lit(len('{"d":[') + 2 * own + len("]}")))
    between = F.concat(F.lit(r'\Q,{"_mark":"'), "name", F.lit(r'"},\E'))
    singly = F.transform(F.split(body, between, -1), lambda text: F.from_json(text, one))
    rows = F.when(fine, F.filter(d, lambda e, i: i % 2 == 1)).otherwise(singly)
    return found.select(F.inline(rows)).drop("_mark")


def _empty_to_null(c):
    return F.when(c != "", c)


def manifest_nodes(manifests: DataFrame, default_project: str = "dbt", types: list[str] = RESOURCE_TYPES) -> DataFrame:
    """Models, seeds, snapshots and sources as rows; tests and the like are skipped."""
    project = F.coalesce(_empty_to_null(F.col("metadata.project_name")), F.lit(default_project))
    service = F.concat(F.lit("dbt-"), F.replace(F.lower(project), F.lit(" "), F.lit("-")))
    head = manifests.withColumn("service", service)

    def pick(*options):
        return F.coalesce(*[_empty_to_null(o) if not isinstance(o, str) else F.lit(o) for o in options])

    no_parents = F.array().cast("array<string>")

    def node(e):
        n = e["value"]
        parents = F.filter(
            F.coalesce(n["depends_on"]["nodes"], no_parents), lambda p: ~F.startswith(p, F.lit("test."))
        )
        return F.struct(
            e["key"].alias("unique_id"),
            n["resource_type"].alias("resource_type"),
            pick(n["database"], "unknown").alias("database"),
            pick(n["schema"], "default").alias("schema_name"),
            pick(n["alias"], n["name"]).alias("name"),
            F.lit("dbt_model").alias("asset_type"),
            n["description"].alias("description"),
            n["columns"].alias("columns"),
            parents.alias("depends_on"),
            pick(n["raw_code"], n["compiled_code"]).alias("raw_code"),
        )

    def source(e):
        n = e["value"]
        return F.struct(
            e["key"].alias("unique_id"),
            F.lit("source").alias("resource_type"),
            pick(n["database"], n["source_name"], "unknown").alias("database"),
            pick(n["schema"], n["source_name"], "default").alias("schema_name"),
            pick(n["identifier"], n["name"]).alias("name"),
            F.lit("table").alias("asset_type"),
            n["description"].alias("description"),
            n["columns"].alias("columns"),
            no_parents.alias("depends_on"),
            F.lit(None).cast("string").alias("raw_code"),
        )

    kept = F.filter(F.map_entries("nodes"), lambda e: e["value"]["resource_type"].isin([t for t in types if t != "source"]))
    rows = F.coalesce(F.transform(kept, node), F.array())
    if "source" in types:
        rows = F.concat(rows, F.coalesce(F.transform(F.map_entries("sources"), source), F.array()))
    # Both maps of a document are exploded together, so it is parsed once.
    rows = head.select("service", F.inline(rows))
    return rows.filter(F.col("name").isNotNull()).withColumn(
        "fqn", F.concat_ws(".", "service", "database", "schema_name", "name")
    )


def node_columns(nodes: DataFrame) -> DataFrame:
    """Columns of manifest nodes."""
    return nodes.select(
        "fqn", F.explode("columns").alias("column_name", "c")
    ).select(
        "fqn", "column_name",
        F.coalesce("c.data_type", F.lit("Unknown")).alias("data_type"),
        F.col("c.description").alias("description"),
    )


def dependency_edges(nodes: DataFrame) -> DataFrame:
    """Dependency edges of manifest nodes; unresolved parents are dropped.

    The nodes are read from both ends, so they are written out once instead of
    parsing every document twice.
    """
    nodes = materialize(
        nodes.select("service", "unique_id", "resource_type", "fqn", "depends_on", "raw_code"), "manifest-nodes"
    )
    down = nodes.filter(F.col("resource_type") != "source").select(
        "service", F.col("unique_id").alias("job_id"), F.col("fqn").alias("downstream_fqn"),
        "raw_code", F.explode("depends_on").alias("parent"),
    )
    up = nodes.select("service", F.col("unique_id").alias("parent"), F.col("fqn").alias("upstream_fqn"))
    up = up.distinct()  # a parent is declared by every manifest that uses it
    return (
        # Of several nodes with one edge the least by id; only its text is rewritten.
        down.join(up, ["service", "parent"])
        .groupBy("upstream_fqn", "downstream_fqn").agg(F.min(F.struct("job_id", "raw_code")).alias("first"))
        .select(
            "upstream_fqn", "downstream_fqn", "first.job_id", sqltext.plain_sql(F.col("first.raw_code")).alias("sql"),
            F.lit("dbt_model").alias("transform_type"),
            F.lit("ref").alias("transform_subtype"),
            F.lit("dbt_model").alias("component"),
            F.lit(1.0).alias("confidence"),
            F.lit("dbt_manifest").alias("source"),
        )
    )


def read_model_files(spark: SparkSession, root: str) -> DataFrame:
    """Model files below a folder: path and whole content."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.sql")
        .text(root, wholetext=True)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


def analyse_models(files: DataFrame, project: str, label: str = "shop", base: str = "models") -> DataFrame:
    """References, sources, description, tags and column comments of model files.

    A file without any reference, source or description is left out.
    """
    text = F.col("content")
    read = F.struct(
        "path",
        sqltext.model_fqn(F.col("path"), project, label, base).alias("fqn"),
        sqltext.model_refs(text).alias("refs"),
        sqltext.model_sources(text).alias("sources"),
        sqltext.model_header(text).alias("description"),
        sqltext.model_tags(text).alias("tags"),
        sqltext.commented_columns(text).alias("column_comments"),
    )
    # Told within the row: a filter would be pushed below, and read every text twice.
    told = F.filter(F.array(read), lambda r: (F.size(r["refs"]) > 0) | (F.size(r["sources"]) > 0) | r["description"].isNotNull())
    return files.select(F.inline(told))
