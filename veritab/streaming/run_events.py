"""Ingest of run events and the documents read back from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.functions.documents import run_event_document

# Run event types.
EVENT_TYPES = ["START", "RUNNING", "COMPLETE", "FAIL", "ABORT"]

_DATASETS = "array<struct<namespace: string, name: string, facets: map<string,string>>>"
RUN_EVENT_SCHEMA = (
    "eventType string, eventTime string, producer string, schemaURL string, "
    "job struct<namespace: string, name: string>, run struct<runId: string>, "
    f"inputs {_DATASETS}, outputs {_DATASETS}, runFacets map<string,string>, jobFacets map<string,string>"
)


def _filled(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) != ""


def checked(events: DataFrame, now: Column | None = None) -> DataFrame:
    """Event rows with ``reason``; '' means the event is accepted.

    Works on batch and streaming frames of the run-event schema. ``now`` stands
    in for a missing event time; one that is no time is a reason. Facets of the run, the job and the
    datasets are kept.
    """
    kind = F.upper(F.coalesce("eventType", F.lit("")))
    time = F.try_to_timestamp("eventTime")
    whole = _filled(F.col("job.namespace")) & _filled(F.col("job.name")) & _filled(F.col("run.runId"))
    reason = (
        F.when(~kind.isin(EVENT_TYPES), F.concat(F.lit("invalid eventType: "), kind))
        .when(~whole, "missing required: job.namespace, job.name, run.runId")
        .when(_filled(F.col("eventTime")) & time.isNull(), F.concat(F.lit("invalid eventTime: "), "eventTime"))
        .otherwise("")
    )
    none = {c: F.array().cast(events.schema[c].dataType) for c in ("inputs", "outputs")}
    return events.select(
        kind.alias("event_type"),
        F.when(_filled(F.col("eventTime")), time).otherwise(now if now is not None else F.current_timestamp()).alias("event_time"),
        F.col("job.namespace").alias("job_namespace"),
        F.col("job.name").alias("job_name"),
        F.col("run.runId").alias("run_id"),
        F.coalesce("inputs", none["inputs"]).alias("inputs"),
        F.coalesce("outputs", none["outputs"]).alias("outputs"),
        F.coalesce("runFacets", F.create_map().cast("map<string,string>")).alias("facets"),
        F.coalesce("jobFacets", F.create_map().cast("map<string,string>")).alias("job_facets"),
        F.coalesce("producer", F.lit("external")).alias("producer"),
        "schemaURL",
        reason.alias("reason"),
    )


def ingest(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append accepted and rejected events; the folder ``accepted=true|false`` tells them apart.

    One file sink for both keeps the append exactly-once.
    """
    rows = checked(events).withColumn("accepted", F.col("reason") == "")
    return (
        rows.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("accepted")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def stored(spark: SparkSession, path: str) -> DataFrame:
    """Ingested events with a boolean ``accepted``; filtering on it prunes the folders."""
    events = spark.read.parquet(path)
    return events.withColumn("accepted", F.col("accepted").cast("boolean"))


def to_documents(rows: DataFrame) -> DataFrame:
    """Stored events as run-event JSON texts."""
    doc = run_event_document(
        F.col("event_type"), F.col("event_time"), F.col("job_namespace"), F.col("job_name"), F.col("run_id"),
        F.col("inputs"), F.col("outputs"), F.col("facets"), F.col("producer"),
    )
    return rows.select("run_id", doc.alias("document"))
