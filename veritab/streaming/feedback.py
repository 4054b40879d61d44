"""Feedback streams: every row is appended, and the few-shot examples follow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from veritab.operators.feedback import by_case, shots_of


#: Folders that the cases of a batch are dealt to, by skill.
SLOTS = 64


def append_feedback(feedback: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all rows to ``path``, exactly once."""
    return (
        feedback.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )


def _newest(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows of the highest epoch of each key."""
    return rows.withColumn("_last", F.max("epoch").over(Window.partitionBy(*keys))).where("epoch = _last").drop("_last")


def _merge(changed: DataFrame, epoch: int, path: str, k: int, min_rejects: int) -> None:
    """Write the changed cases, and the examples of their skills drawn anew.

    ``cases/epoch=n`` has the cases that batch n changed, by skill; ``shots/epoch=n`` the examples of the skills it touched.
    The examples of a skill need its other cases too: the parts of its folder are read, no others. Both parts are written over
    when a batch runs again, and a batch reads parts of earlier ones only.
    """
    spark = changed.sparkSession
    part = f"{path}/cases/epoch={epoch}"
    # Without partitions by a column that may be null or hold any text: a number stands for the skill.
    changed.withColumn("slot", F.pmod(F.xxhash64("skill"), F.lit(SLOTS))).write.mode("overwrite").partitionBy("slot").parquet(part)
    schema = StructType(changed.schema.fields).add("slot", "integer")
    fresh = spark.read.schema(schema).parquet(part)
    skills = fresh.select("skill", "slot").distinct()
    slots = [r.slot for r in skills.select("slot").distinct().collect()]
    if not slots:
        return
    every = spark.read.schema(schema.add("epoch", "integer")).parquet(f"{path}/cases").where(
        (F.col("epoch") <= epoch) & F.col("slot").isin(slots))
    every = every.join(skills.select(F.col("skill").alias("of"), F.col("slot").alias("at")), F.col("skill").eqNullSafe(F.col("of")) & (
        F.col("slot") == F.col("at")), "left_semi")
    # The newest state of a case, by a partial aggregate.
    row = F.struct(*[c for c in changed.columns if c not in ("skill", "case_key")])
    cases = every.groupBy("skill", "case_key").agg(F.max_by(row, "epoch").alias("v")).select("skill", "case_key", "v.*")
    shots_of(cases, k, min_rejects).write.mode("overwrite").parquet(f"{path}/shots/epoch={epoch}")


def update_shots(feedback: DataFrame, path: str, checkpoint: str, k: int = 5, min_rejects: int = 2) -> StreamingQuery:
    """Keep the examples of every skill below ``path``; ``shots`` reads them.

    The state is one row per (skill, case) and belongs to the query's checkpoint. A batch hands on the cases it
    changed, and only the examples of their skills are drawn and written again; a replayed batch writes its own parts over.
    """

    def step(cases: DataFrame, epoch: int) -> None:
        _merge(cases, epoch, path, k, min_rejects)

    return (
        by_case(feedback).writeStream.outputMode("update").foreachBatch(step)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def shots(spark: SparkSession, path: str) -> DataFrame:
    """The examples as they stand: for each skill those of the last batch that touched it."""
    return _newest(spark.read.parquet(f"{path}/shots"), "skill").drop("epoch")
