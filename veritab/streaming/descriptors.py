"""Change detection of descriptor files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from veritab.operators.adjacent import adjacent_value

_ORDER = ["mtime", "seq"]
_VERSION = "id string, mtime timestamp, seq long, sha string"


def _whole(versions: DataFrame) -> DataFrame:
    """Versions with an id, a time and a sha; others are passed over."""
    return versions.where("id is not null and mtime is not null and sha is not null")


def changes(versions: DataFrame, bucket: str = "hour") -> DataFrame:
    """Versions <id, seq, mtime, sha> whose sha differs from the one before.

    The first version of an id gives no row, and an (id, sha) is reported once,
    at its first change. An id with very many versions is cut into time buckets.
    """
    full = adjacent_value(_whole(versions), "id", F.date_trunc(bucket, "mtime"), _ORDER, "sha", "prev")
    changed = full.filter(F.col("prev").isNotNull() & (F.col("prev") != F.col("sha")))
    return (
        changed.groupBy("id", "sha")
        .agg(F.min(F.struct(*_ORDER, "prev")).alias("v"))
        .select("id", "sha", F.col("v.mtime").alias("mtime"), F.col("v.seq").alias("seq"), F.col("v.prev").alias("prev_sha"))
    )


def _before(spark: SparkSession, path: str, schema: str, epoch: int) -> DataFrame:
    """Rows that earlier batches wrote to a folder with one part per batch; a batch that runs again doesn't see its own."""
    rows = spark.read.schema(schema).parquet(path) if epoch else spark.createDataFrame([], schema)
    return rows.where(F.col("epoch") < epoch)


def _absorb(batch: DataFrame, epoch: int, path: str, bucket: str) -> None:
    """One batch: its versions and the versions beside them decide what is told anew.

    State is two tables below ``path/_state``, with one part per batch: the versions by day, and the first and last version of
    each id and day. Read are the days that the batch touches, of its ids, and for these ids the nearest
    versions of the days beside these. Each part is written over when a batch runs again.

    What is used more than once is kept for the time of the batch, so that each table is read and sorted once.
    """
    spark, state, kept = batch.sparkSession, f"{path}/_state", []

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df.persist(StorageLevel.DISK_ONLY))
        return kept[-1]

    try:
        _absorb_kept(spark, batch, epoch, path, state, bucket, keep)
    finally:
        for df in kept:
            df.unpersist()


def _absorb_kept(spark: SparkSession, batch: DataFrame, epoch: int, path: str, state: str, bucket: str, keep: Callable[[DataFrame], DataFrame]) -> None:
    old = _before(spark, f"{state}/versions", f"{_VERSION}, epoch int, day date", epoch)
    new = keep(batch.groupBy("id", *_ORDER).agg(F.min("sha").alias("sha")).withColumn("day", F.to_date("mtime")))
    days = [r.day for r in new.select("day").distinct().collect()]
    touched = new.select("id", "day").distinct()
    beside = keep(old.where(F.col("day").isin(days)).join(touched, ["id", "day"], "left_semi").select("id", *_ORDER, "sha"))
    part = f"{state}/versions/epoch={epoch}"
    # A few files for each day, not one for each task and day.
    new.join(beside, ["id", *_ORDER], "left_anti").hint("rebalance", F.col("day")).write.mode("overwrite").partitionBy("day").parquet(part)
    fresh = spark.read.schema(f"{_VERSION}, day date").parquet(part)

    edge = "id string, day date, first struct<mtime: timestamp, seq: long, sha: string>, last struct<mtime: timestamp, seq: long, sha: string>"
    row = F.struct("mtime", "seq", "sha")
    fresh.groupBy("id", "day").agg(F.min(row).alias("first"), F.max(row).alias("last")).write.mode("overwrite").parquet(f"{state}/edges/epoch={epoch}")
    by_day = _before(spark, f"{state}/edges", f"{edge}, epoch int", epoch).withColumn("here", F.lit(False)).unionByName(
        touched.withColumn("here", F.lit(True)), allowMissingColumns=True
    ).groupBy("id", "day").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.max("here").alias("here"))
    # Of a day that is not touched, only what comes next to a touched one.
    along = Window.partitionBy("id").orderBy("day")
    nearest = F.array(F.when(F.lead("here").over(along), F.col("last")), F.when(F.lag("here").over(along), F.col("first")))
    ends = by_day.select("id", "here", nearest.alias("near")).where("not here").select(
        "id", F.explode(F.array_distinct(F.array_compact("near"))).alias("v")).select("id", "v.*")

    rows = keep(beside.unionByName(ends).withColumn("fresh", F.lit(False)).unionByName(fresh.drop("day").withColumn("fresh", F.lit(True))))
    # What lies between the end of one day and the next version here is not known, unless one of them is fresh.
    linked = adjacent_value(rows.withColumn("told", F.struct("sha", "fresh")), "id", F.date_trunc(bucket, "mtime"), _ORDER, "told", "prev")
    found = keep(linked.where((F.col("fresh") | F.col("prev.fresh")) & (F.col("prev.sha") != F.col("sha"))).select(
        "id", "sha", F.struct("mtime", "seq", F.lit(0).alias("known"), F.col("prev.sha").alias("prev_sha")).alias("v")))

    # A change told before stays, unless there is an earlier one or its version has another one before it now.
    earlier = _before(spark, path, "id string, sha string, mtime timestamp, seq long, prev_sha string, epoch int", epoch)
    known = _newest(earlier.join(found.select("id", "sha").distinct(), ["id", "sha"], "left_semi")).select(
        "id", "sha", F.struct("mtime", "seq", F.lit(1).alias("known"), "prev_sha").alias("v"))
    told = found.unionByName(known).groupBy("id", "sha").agg(
        F.min("v").alias("v"), F.max(F.when(F.col("v.known") == 1, F.struct("v.mtime", "v.seq", "v.prev_sha"))).alias("was"))
    now = F.struct("v.mtime", "v.seq", "v.prev_sha")
    told.where(~now.eqNullSafe(F.col("was"))).select("id", "sha", "v.mtime", "v.seq", "v.prev_sha").write.mode("overwrite").parquet(
        f"{path}/epoch={epoch}")


def _newest(told: DataFrame) -> DataFrame:
    return told.groupBy("id", "sha").agg(F.max_by(F.struct("mtime", "seq", "prev_sha"), "epoch").alias("v")).select(
        "id", "sha", "v.mtime", "v.seq", "v.prev_sha")


def watch(versions: DataFrame, path: str, checkpoint: str, bucket: str = "hour") -> StreamingQuery:
    """Stream form of ``changes``: what each batch tells goes to ``path``, with the number of the batch as ``epoch``.

    Versions may come in any order. A late one is put between its neighbours: if that makes a change earlier, or gives it another
    version before it, the change is told again, and the row of the highest epoch holds (``told``). Batches in order tell each change once.
    No id is gathered in one place: its versions are cut into time buckets as in ``changes``. A version seen
    before is passed over, as is one without an id, a sha or a time.
    """

    def step(batch: DataFrame, epoch: int) -> None:
        _absorb(batch, epoch, path, bucket)

    rows = _whole(versions).select(F.col("id").cast("string").alias("id"), "mtime", F.col("seq").cast("long").alias("seq"), "sha")
    return (
        rows.writeStream.foreachBatch(step)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def told(spark: SparkSession, path: str) -> DataFrame:
    """The changes as they stand: per (id, sha) the row that was told last."""
    return _newest(spark.read.parquet(path))
