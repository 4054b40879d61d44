"""Scores of model outputs against gold cases, reports and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PASS_SCORE = 0.7
# Gate limits.
MIN_MEAN, MIN_PASS_RATE, MAX_DROP = 0.7, 0.7, 0.05


def expected_kind(gold: Column) -> Column:
    """Kind of a gold struct by the keys it holds."""
    has = lambda k: gold[k].isNotNull()
    return (
        F.when(gold.isNull(), "freeform")
        .when(has("must_contain") | has("must_not_contain"), "list_contains")
        .when(has("contains") | has("max_length") | has("min_length"), "contains")
        .when(has("exact"), "exact")
        .when(has("fqn"), "fqn_match")
        .when(has("sql_safety") | has("guards"), "guard_match")
        .otherwise("freeform")
    )


def _lowered(c: Column) -> Column:
    return F.transform(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.lower(x))


def _share(hits: Column, of: Column) -> Column:
    return hits / F.greatest(F.lit(1), of)


def score_cases(df: DataFrame) -> DataFrame:
    """Add kind, score and issues to rows <gold, pred_text, pred_sql, passed_guards>."""
    g = F.col("gold")
    text = F.lower(F.coalesce("pred_text", F.lit("")))
    wanted = _lowered(g["contains"])
    found = F.filter(wanted, lambda w: F.contains(text, w))
    long = F.coalesce((g["max_length"] > 0) & (F.length(text) > g["max_length"] * 2), F.lit(False))
    contains = _share(F.size(found), F.size(wanted)) * F.when(long, 0.8).otherwise(1.0)

    sql = F.lower(F.coalesce("pred_sql", F.lit("")))
    must, forbid = _lowered(g["must_contain"]), _lowered(g["must_not_contain"])
    must_hit = F.filter(must, lambda w: F.contains(sql, w))
    forbidden = F.filter(forbid, lambda w: F.contains(sql, w))
    listed = F.lit(0.5) + F.lit(0.5) * _share(F.size(must_hit), F.size(must)) - F.lit(0.5) * F.size(forbidden)

    required = F.array_distinct(F.coalesce(g["guards"], F.array().cast("array<string>")))
    unmet = F.array_sort(F.array_except(required, F.coalesce("passed_guards", F.array().cast("array<string>"))))
    guards = _share(F.size(required) - F.size(unmet), F.size(required))

    exact = F.coalesce(g["exact"] == F.col("pred_text"), F.lit(False))
    kind = F.col("kind")
    raw = (
        F.when(kind == "exact", exact.cast("double"))
        .when(kind == "contains", contains)
        .when(kind == "list_contains", listed)
        .when(kind == "guard_match", guards)
        .otherwise(0.6)
    )

    def issue(cond, *parts):
        return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))

    join = lambda a: F.array_join(a, ", ")
    missing, must_miss = F.array_except(wanted, found), F.array_except(must, must_hit)
    issues = F.array_compact(
        F.array(
            issue((kind == "exact") & ~exact, "exact mismatch: expected=", F.coalesce(g["exact"], F.lit(""))),
            issue((kind == "contains") & (F.size(found) < F.size(wanted)), "missing keywords: ", join(missing)),
            issue((kind == "contains") & long, "可能超过 max_length=", F.coalesce(g["max_length"].cast("string"), F.lit(""))),
            issue((kind == "list_contains") & (F.size(must_miss) > 0), "missing: ", join(must_miss)),
            issue((kind == "list_contains") & (F.size(forbidden) > 0), "forbidden keyword hit: ", join(forbidden)),
            issue((kind == "guard_match") & (F.size(unmet) > 0), "guards not passed: ", join(unmet)),
            issue(kind.isin("freeform", "fqn_match"), "freeform gold; 规则打分 0.6 (建议配 judge)"),
        )
    )
    return (
        df.withColumn("kind", expected_kind(g))
        .withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)))
        .withColumn("issues", issues)
    )


def report(results: DataFrame) -> DataFrame:
    """Per skill: cases, passed, mean score (4 dp), median latency.

    The median is the element at n // 2 of the sorted latencies. Equal latencies
    are counted map-side first. Then the ranges of a skill are cumulated (an eighth of an octave each,
    some hundreds at most), and only the distinct latencies of the range that holds the median are.
    """
    summary = results.groupBy("skill").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("score") >= PASS_SCORE).alias("passed"),
        F.round(F.avg("score"), 4).alias("avg_score"),
    )
    latency = F.col("latency_ms").cast("double")
    place = F.floor(8 * F.signum(latency) * F.log2(F.abs(latency) + 1))
    counted = results.filter(F.col("latency_ms").isNotNull()).groupBy("skill", place.alias("range"), "latency_ms").agg(
        F.count("*").alias("n"))
    whole = Window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    nulls = results.groupBy("skill").agg(F.count_if(F.col("latency_ms").isNull()).alias("without"))
    # Cases without a latency come first, as nulls sort.
    middle = summary.select("skill", (F.floor(F.col("total") / 2)).alias("rank")).join(nulls, "skill").select(
        "skill", (F.col("rank") - F.col("without")).alias("rank"))
    ranges = (
        counted.groupBy("skill", "range").agg(F.sum("n").alias("n"))
        .withColumn("upto", F.sum("n").over(whole.partitionBy("skill").orderBy("range")))
        .join(middle.filter(F.col("rank") >= 0), "skill")
        .filter((F.col("upto") > F.col("rank")) & (F.col("upto") - F.col("n") <= F.col("rank")))
        .select("skill", "range", (F.col("rank") - F.col("upto") + F.col("n")).alias("rank"))
    )
    p50 = (
        counted.join(ranges, ["skill", "range"])
        .withColumn("upto", F.sum("n").over(whole.partitionBy("skill", "range").orderBy("latency_ms")))
        .filter(F.col("upto") > F.col("rank"))
        .groupBy("skill").agg(F.min("latency_ms").alias("p50_latency"))
    )
    return summary.join(p50, "skill", "left")


def issue_patterns(results: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent issue heads, the texts before ':'."""
    head = F.trim(F.substring_index("issue", ":", 1))
    return (
        results.select(F.explode("issues").alias("issue"))
        .groupBy(head.alias("pattern"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "pattern")
        .limit(k)
    )


def gate(reports: DataFrame, baseline: DataFrame | None = None, min_mean: float = MIN_MEAN,
         min_pass_rate: float = MIN_PASS_RATE, max_drop: float = MAX_DROP) -> DataFrame:
    """Per skill: passed and the reasons against it, compared to a baseline report.

    Numbers in reasons are rounded half-even from the exact binary value.
    """
    base = (
        baseline.select("skill", F.col("avg_score").alias("baseline_avg"))
        if baseline is not None
        else reports.select("skill", F.lit(None).cast("double").alias("baseline_avg"))
    )
    rate = F.col("passed") / F.greatest(F.lit(1), F.col("total"))
    delta = F.col("avg_score") - F.col("baseline_avg")
    reasons = F.array_compact(
        F.array(
            F.when(
                F.col("avg_score") < min_mean,
                F.concat(F.lit("avg_score "), F.format_number("avg_score", 3), F.lit(f" < min_avg_score {min_mean:.3f}")),
            ),
            F.when(
                rate < min_pass_rate,
                F.concat(
                    F.lit("pass_rate "), F.format_number(rate * 100, 2), F.lit(f"% < min_pass_rate {min_pass_rate:.2%}")
                ),
            ),
            F.when(
                delta < -max_drop,
                F.concat(
                    F.lit("regress "), F.format_number(delta, 3), F.lit(f" < -{max_drop:.3f} (vs baseline "),
                    F.format_number("baseline_avg", 3), F.lit(")"),
                ),
            ),
        )
    )
    return reports.join(base, "skill", "left").select(
        "skill",
        (F.size(reasons) == 0).alias("passed"),
        F.when(F.size(reasons) == 0, "OK").otherwise(F.array_join(reasons, "; ")).alias("reason"),
        F.col("avg_score").alias("report_avg"),
        "baseline_avg",
        F.round(rate, 4).alias("report_pass_rate"),
    )
