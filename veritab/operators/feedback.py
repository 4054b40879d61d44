"""Feedback on proposals and the few-shot examples drawn from it.

Rows: <seq, skill, case_key, pred, new_payload, accepted, reason>; ``seq`` is the
order of arrival.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_case(feedback: DataFrame) -> DataFrame:
    """Newest feedback, count and first ``seq`` of either kind per (skill, case).

    A partial aggregate, not a window: a case with a third of all feedback is
    combined before the shuffle. As a streaming aggregate it is the state the examples need.
    """
    row = F.struct("seq", "pred", "new_payload", "reason")
    kinds = {"accepted": F.col("accepted"), "rejected": ~F.col("accepted")}
    aggs = []
    for kind, mine in kinds.items():
        seq = F.when(mine, F.col("seq"))
        aggs += [F.max_by(row, seq).alias(kind), F.count(seq).alias(f"n_{kind}"), F.min(seq).alias(f"first_{kind}")]
    return feedback.groupBy("skill", "case_key").agg(*aggs)


def latest_of(cases: DataFrame, accepted: bool, min_count: int) -> DataFrame:
    """Rows of ``by_case`` with at least ``min_count`` feedback of one kind, and the newest of it."""
    kind = "accepted" if accepted else "rejected"
    return cases.filter(F.col(f"n_{kind}") >= min_count).select(
        "skill", "case_key", F.col(f"n_{kind}").alias("n"), F.col(f"first_{kind}").alias("first_seq"), f"{kind}.*")


def latest(feedback: DataFrame, accepted: bool, min_count: int) -> DataFrame:
    """Newest feedback per (skill, case) with at least ``min_count`` of its kind."""
    return latest_of(by_case(feedback), accepted, min_count)


def shots_of(cases: DataFrame, k: int = 5, min_rejects: int = 2) -> DataFrame:
    """The k best examples per skill from ``by_case``: accepted (100), then corrected rejects (70)."""
    good = latest_of(cases, True, 1).select(
        "skill", "case_key", "first_seq",
        F.when(F.coalesce("new_payload", F.lit("")) != "", F.col("new_payload")).otherwise(F.col("pred")).alias("expected"),
        F.lit(100).alias("weight"), F.lit("feedback_accept").alias("source"), F.lit(None).cast("string").alias("note"),
    )
    fixed = latest_of(cases, False, min_rejects).filter(F.coalesce("new_payload", F.lit("")) != "").select(
        "skill", "case_key", "first_seq", F.col("new_payload").alias("expected"),
        F.lit(70).alias("weight"), F.lit("feedback_reject_corrected").alias("source"), F.col("reason").alias("note"),
    )
    w = Window.partitionBy("skill").orderBy(F.desc("weight"), "first_seq")
    return (
        good.unionByName(fixed)
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .drop("first_seq")
    )


def few_shots(feedback: DataFrame, k: int = 5, min_rejects: int = 2) -> DataFrame:
    """The k best examples per skill."""
    return shots_of(by_case(feedback), k, min_rejects)
