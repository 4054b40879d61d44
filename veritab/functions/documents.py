"""OpenLineage documents, tolerant JSON, fingerprints and clamps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCHEMA_URL = "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent"
PRODUCER = "veritab"

# Transform type -> (OpenLineage type, subtype).
TRANSFORM_TYPES = {
    "direct": ("DIRECT", None),
    "passthrough": ("DIRECT", "IDENTITY"),
    "rename": ("DIRECT", "RENAME"),
    "cast": ("TRANSFORMATION", "CAST"),
    "aggregation": ("TRANSFORMATION", "AGGREGATION"),
    "expression": ("TRANSFORMATION", "EXPRESSION"),
    "derivation": ("TRANSFORMATION", "DERIVATION"),
}


def openlineage_type(ttype: Column) -> Column:
    """Struct <type, subtype>; an unknown type keeps its upper-case name as subtype."""

    def pair(t, s):
        return F.struct(t.alias("type"), s.alias("subtype"))

    chain = None
    for kind, (ol_type, ol_subtype) in TRANSFORM_TYPES.items():
        value = pair(F.lit(ol_type), F.lit(ol_subtype).cast("string"))
        chain = F.when(ttype == kind, value) if chain is None else chain.when(ttype == kind, value)
    return chain.otherwise(pair(F.lit("TRANSFORMATION"), F.upper(ttype)))


def dataset_namespace(fqn: Column, explicit: Column) -> Column:
    """The explicit namespace, else 'service://database' from the name."""
    parts = F.split(fqn, r"\.")
    return F.coalesce(explicit, F.concat(parts[0], F.lit("://"), F.coalesce(F.get(parts, F.lit(1)), F.lit("default"))))


def column_lineage_fields(column_edges: DataFrame, by: tuple[str, ...] = ("downstream_id",)) -> DataFrame:
    """One row per downstream column (and what else ``by`` names): its distinct inputs and transformations.

    Input rows carry downstream_id, downstream_col, upstream_name,
    upstream_namespace, upstream_col, transform_type, description and
    transform_expression. A column's facet lists its own inputs only.
    """
    ol = openlineage_type(F.col("transform_type"))
    field = F.struct(
        F.col("upstream_namespace").alias("namespace"),
        F.col("upstream_name").alias("name"),
        F.col("upstream_col").alias("field"),
    )
    transformation = F.struct(
        ol["type"].alias("type"),
        ol["subtype"].alias("subtype"),
        F.coalesce("description", F.lit("")).alias("description"),
        F.coalesce("transform_expression", F.lit("")).alias("expression"),
        F.lit(False).alias("masking"),
    )
    return column_edges.groupBy(*by, "downstream_col").agg(
        F.array_sort(F.collect_set(field)).alias("inputFields"),
        F.array_sort(F.collect_set(transformation)).alias("transformations"),
    )


def dataset_documents(assets: DataFrame, fields: DataFrame | None, producer: str = PRODUCER) -> DataFrame:
    """Dataset rows <id, column, dataset> with documentation and, for outputs, column lineage.

    A table has one document for each column with lineage, whatever their number, which a reader of run
    events adds up; a table without any has one document, with a null column.
    """
    documentation = F.struct(
        F.lit(producer).alias("_producer"), F.coalesce("description", F.lit("")).alias("description")
    )
    base = assets.select(
        "id",
        dataset_namespace(F.col("fqn"), F.col("ol_namespace")).alias("namespace"),
        "name",
        documentation.alias("documentation"),
    )
    if fields is None:
        base = base.withColumn("column", F.lit(None).cast("string"))
        facets = F.struct("documentation")
    else:
        each = fields.select(
            "downstream_id", F.col("downstream_col").alias("column"),
            F.create_map("downstream_col", F.struct("inputFields", "transformations")).alias("fields"))
        base = base.join(each, base.id == each.downstream_id, "left")
        lineage = F.when(
            F.col("fields").isNotNull(), F.struct(F.lit(producer).alias("_producer"), F.col("fields"))
        )
        facets = F.struct("documentation", lineage.alias("columnLineage"))
    return base.select("id", "column", F.struct("namespace", "name", facets.alias("facets")).alias("dataset"))


def lineage_events(edges: DataFrame, assets: DataFrame, column_edges: DataFrame, since, event_type: str, event_time,
                   namespace: str, name: str, run_id: str, producer: str = PRODUCER) -> DataFrame:
    """Run events of one run, composed from the table edges created at or after ``since``:
    <upstream_id, downstream_id, document>.

    A run is told in one event per edge, which a reader adds up by its run id, so no document and no task
    holds the lineage of many tables. The input is the upstream table; the output is the downstream
    table with the column lineage that comes from that input.
    """
    recent = edges.filter(F.col("created_at") >= F.lit(since).cast("timestamp")).select("upstream_id", "downstream_id").distinct()
    pair = ("upstream_id", "downstream_id")
    # As many entries as the downstream table has columns.
    fields = column_lineage_fields(column_edges.join(recent, list(pair), "left_semi"), pair).groupBy(*pair).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("downstream_col", F.struct("inputFields", "transformations"))))).alias("fields"))
    documentation = F.struct(F.lit(producer).alias("_producer"), F.coalesce("description", F.lit("")).alias("description"))
    told = assets.select("id", dataset_namespace(F.col("fqn"), F.col("ol_namespace")).alias("namespace"), "name",
                         documentation.alias("documentation"))
    up = told.select(F.col("id").alias("upstream_id"), F.struct(
        "namespace", "name", F.struct("documentation").alias("facets")).alias("input"))
    down = told.select(F.col("id").alias("downstream_id"), *[F.col(c).alias(f"d_{c}") for c in ("namespace", "name", "documentation")])
    lineage = F.when(F.col("fields").isNotNull(), F.struct(F.lit(producer).alias("_producer"), F.col("fields")))
    output = F.struct(
        F.col("d_namespace").alias("namespace"), F.col("d_name").alias("name"),
        F.struct(F.col("d_documentation").alias("documentation"), lineage.alias("columnLineage")).alias("facets"))
    document = run_event_document(
        F.lit(event_type), F.lit(event_time).cast("timestamp"), F.lit(namespace), F.lit(name), F.lit(run_id),
        F.array("input"), F.array(output), F.create_map(F.lit("processing_engine"), F.struct(F.lit(producer).alias("name"))), F.lit(producer))
    return recent.join(fields, list(pair), "left").join(up, "upstream_id").join(down, "downstream_id").select(
        *pair, document.alias("document"))


def run_event_document(
    event_type: Column, event_time: Column, namespace: Column, name: Column, run_id: Column,
    inputs: Column, outputs: Column, facets: Column, producer: Column,
) -> Column:
    """One run event as a JSON text."""
    return F.to_json(
        F.struct(
            event_type.alias("eventType"),
            F.date_format(event_time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("eventTime"),
            F.coalesce(producer, F.lit("")).alias("producer"),
            F.lit(SCHEMA_URL).alias("schemaURL"),
            F.struct(namespace.alias("namespace"), name.alias("name")).alias("job"),
            F.struct(run_id.alias("runId")).alias("run"),
            inputs.alias("inputs"),
            outputs.alias("outputs"),
            facets.alias("runFacets"),
        )
    )


def model_reply(content: Column) -> Column:
    """Struct <description, confidence, tier> of a model reply that should be JSON.

    Fence lines are dropped, the text from the first '{' to the last '}' is
    parsed, and anything unreadable falls back to the text itself at 0.4.
    """
    text = F.regexp_replace(F.coalesce(content, F.lit("")), r"^\s+|\s+$", "")
    unfenced = F.when(
        F.startswith(text, F.lit("```")), F.regexp_replace(text, r"(?m)^[ \t]*```[^\n]*\n?", "")
    ).otherwise(text)
    braces = F.regexp_extract(unfenced, r"(?s)\{.*\}", 0)
    body = F.when(braces != "", braces).otherwise(unfenced)
    readable = F.try_parse_json(body).isNotNull() & (braces != "")
    parsed = F.from_json(body, "description string, confidence double, tier string")
    fallback = F.struct(
        body.alias("description"),
        F.lit(0.4).alias("confidence"),
        F.lit("normal").alias("tier"),
    )
    return F.when(readable, parsed).otherwise(fallback)


def fingerprint(text: Column) -> Column:
    """First 16 hex digits of the SHA-256 of a text."""
    return F.substring(F.sha2(text, 256), 1, 16)


def clamp_confidence(value: Column) -> Column:
    """Number in [0, 1]; missing, unreadable or zero gives 0.5."""
    number = value.try_cast("double")
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.coalesce(number, F.lit(0.0)) == 0.0, 0.5).otherwise(number)))
