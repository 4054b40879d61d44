"""Files as catalog assets: listing, schemas, asset rows, table statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators.adjacent import one_row

# Recognised file formats, and those kept when no filter is given.
FORMATS = ["parquet", "csv", "json", "orc", "avro"]
DEFAULT_FORMATS = ["parquet", "csv", "json"]
# Stages a file asset can belong to.
FILE_STAGES = (1, 2, 4)
# Bytes read at a time while looking for the end of a header.
HEADER_CHUNK = 64 * 1024


def file_format(key: Column) -> Column:
    """Format named by the suffix, else null."""
    suffix = F.regexp_extract(F.lower(key), r"\.([a-z]+)$", 1)
    return F.when(suffix.isin(FORMATS), suffix)


def list_files(
    spark: SparkSession, root: str, formats: list[str] = DEFAULT_FORMATS, stage: int | None = None
) -> DataFrame:
    """Data files below a folder: path, key, format, size, modification time, stage.

    Only metadata columns are selected, so no file content is read.
    """
    if stage is not None and stage not in FILE_STAGES:
        raise ValueError(f"stage must be one of {FILE_STAGES}, got {stage}")
    base = root.rstrip("/")
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(base)
        .select("path", "length", "modificationTime")
    )
    clean = F.regexp_replace("path", r"^[a-z0-9]+:/+", "/")
    prefix = "/" + base.split("://", 1)[-1].lstrip("/")
    key = F.substring(clean, F.lit(len(prefix) + 2), F.length(clean))
    suffix = F.lower(F.substring_index(F.col("key"), ".", -1))
    return (
        files.select(
            "path", key.alias("key"), F.col("length").alias("size_bytes"),
            F.col("modificationTime").alias("last_modified"),
        )
        .filter(suffix.isin(list(formats)))
        .withColumn("format", file_format(F.col("key")))
        .filter(F.col("format").isNotNull())
        .withColumn("pipeline_stage", F.lit(stage).cast("int"))
    )


def _read_headers(batches):
    """Names in the first line that is not blank, of each file of <path>; only the bytes up to its end are read.

    Names may be quoted and hold commas. Bytes that are no UTF-8 are read as Latin-1.
    """
    import csv

    import pandas as pd
    from pyarrow import fs

    for batch in batches:
        names = []
        for path in batch["path"]:
            # Hadoop writes local paths with one slash.
            uri = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
            system, name = fs.FileSystem.from_uri(uri)
            head = b""
            with system.open_input_stream(name) as stream:
                while b"\n" not in head.lstrip() and (chunk := stream.read(HEADER_CHUNK)):
                    head += chunk
            line = head.removeprefix(b"\xef\xbb\xbf").lstrip().split(b"\n", 1)[0].rstrip(b"\r")
            try:
                text = line.decode("utf-8")
            except UnicodeDecodeError:
                text = line.decode("latin-1")
            names.append(next(csv.reader([text], skipinitialspace=True), []))
        yield pd.DataFrame({"path": batch["path"], "names": names})


def csv_header_columns(spark: SparkSession, root: str) -> DataFrame:
    """Columns of each CSV file by its header: path, ordinal, name, type, nullable.

    Spark lists the files and spreads them over tasks; a task opens each of its
    files and stops after the first line, whatever the size of the file.
    """
    paths = list_files(spark, root, ["csv"]).select("path")
    headers = paths.mapInPandas(_read_headers, "path string, names array<string>")
    return headers.select("path", F.posexplode("names").alias("ordinal", "raw")).select(
        "path",
        "ordinal",
        F.trim("raw").alias("name"),
        F.lit("string").alias("data_type"),
        F.lit(True).alias("nullable"),
    )


def schema_rows(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """One row per column of the given tables, from their schemas (footers only)."""
    rows = [
        (name, i, f.name, f.dataType.simpleString(), f.nullable)
        for name, df in tables.items()
        for i, f in enumerate(df.schema.fields)
    ]
    return spark.createDataFrame(
        rows, "table_name string, ordinal int, name string, data_type string, nullable boolean"
    )


def file_assets(files: DataFrame, columns: DataFrame, bucket: str, role: str | None = None) -> DataFrame:
    """Asset rows of listed files, keyed by gcs://bucket/key.

    ``columns`` holds <key, name, data_type, nullable, ordinal> of readable files;
    a file without rows there gets an empty schema.
    """
    schema = columns.groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct("ordinal", "name", "data_type", "nullable"))).alias("schema"),
    )
    fqn = F.concat(F.lit(f"gcs://{bucket}/"), F.col("key"))
    return files.join(schema, "key", "left").select(
        fqn.alias("fqn"),
        F.element_at(F.split("key", "/"), -1).alias("name"),
        F.lit("table").alias("asset_type"),
        F.lit("gcs_object").alias("asset_subtype"),
        "format",
        "size_bytes",
        "last_modified",
        "pipeline_stage",
        F.lit(role).cast("string").alias("source_role"),
        F.coalesce(F.size("schema"), F.lit(0)).alias("column_count"),
        "schema",
    )


def table_stats(spark: SparkSession, df: DataFrame, root: str) -> DataFrame:
    """Rows, files, bytes and last modification of one table."""
    listing = (
        spark.read.format("binaryFile").load(root).agg(
            F.count("*").alias("parts"),
            F.sum("length").alias("size_bytes"),
            F.max("modificationTime").alias("last_modified"),
        )
    )
    return one_row(df.agg(F.count("*").alias("row_count")), listing)


def first_rows(df: DataFrame, n: int, order_by: list[str] | None = None) -> DataFrame:
    """First n rows; with keys the choice is deterministic."""
    return (df.orderBy(*order_by) if order_by else df).limit(n)
