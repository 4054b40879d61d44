"""Anomaly detectors, health scores and the findings digest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.operators.adjacent import one_row
from veritab.operators.coverage import history_baseline
from veritab.operators.lineage import unowned

# Thresholds and window lengths.
Z_LIMIT = 2.0
NULL_LIMIT = 0.10
RECENT_DAYS = 7
HISTORY_DAYS = 30
# Health points lost per finding.
PENALTY = {"high": 25, "medium": 10, "low": 3}
# Suggested actions.
ACTION_GROWTH = "排查上游写入, 是否在批量重跑或新建临时表"
ACTION_SHRINK = "数据量明显下降, 检查是否有清理任务误删"
ACTION_NULLS = "上游 schema 变更或 ETL 异常, 检查 NULL 引入路径"
ACTION_PII = "新 PII 列被引入, 走法务评审 + 字段脱敏策略"
ACTION_OWNER = "请 infer_table_owners Skill 推荐 owner, 并人工 verify"


def volume_drift(snapshots: DataFrame, as_of) -> DataFrame:
    """Tables whose rows on ``as_of`` are far from their 30-day history.

    z = (current - median) / p90; no history or p90 = 0 gives no finding.
    """
    today = snapshots.filter(F.col("day") == F.lit(as_of).cast("date")).select("table_id", F.col("rows").alias("current_rows"))
    base = history_baseline(snapshots, as_of, HISTORY_DAYS).filter(F.col("p90_rows") > 0)
    z = (F.col("current_rows") - F.col("median_rows")) / F.col("p90_rows")
    return (
        today.join(base, "table_id")
        .withColumn("z", z)
        .filter(F.abs("z") > Z_LIMIT)
        .select(
            "table_id", F.lit("volume_drift").alias("kind"),
            F.when(F.col("z") > 2 * Z_LIMIT, "high").otherwise("medium").alias("severity"),
            F.to_json(
                F.struct("current_rows", "median_rows", "p90_rows", F.round("z", 2).alias("z_score"))
            ).alias("details"),
            F.when(F.col("z") > 0, ACTION_GROWTH).otherwise(ACTION_SHRINK).alias("suggested_action"),
        )
    )


def null_spike(profiles: DataFrame) -> DataFrame:
    """Tables with declared-not-null columns above 10 % nulls, and all those columns.

    Input: <table_id, name, ordinal, nullable, null_ratio>. A finding holds as many
    columns as its table has at most.
    """
    bad = profiles.filter(~F.col("nullable") & (F.col("null_ratio") > NULL_LIMIT))
    listed = bad.groupBy("table_id").agg(
        F.count("*").alias("n"),
        F.array_sort(F.collect_list(F.struct(
            "ordinal", F.col("name").alias("column"), F.round("null_ratio", 4).alias("null_ratio")))).alias("l"),
    )
    shown = F.transform("l", lambda s: F.struct(s["column"].alias("column"), s["null_ratio"].alias("null_ratio")))
    return listed.select(
        "table_id", F.lit("null_spike").alias("kind"),
        F.when(F.col("n") >= 3, "high").otherwise("medium").alias("severity"),
        F.to_json(F.struct(shown.alias("affected_columns"))).alias("details"),
        F.lit(ACTION_NULLS).alias("suggested_action"),
    )


def new_pii_columns(columns: DataFrame, as_of) -> DataFrame:
    """PII columns created in the last seven days, one row each."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(RECENT_DAYS))
    fresh = (F.col("pii_class") != "none") & (F.col("created_at") >= since)
    return columns.filter(fresh).select("table_id", "name", "pii_class")


def pii_escalation(columns: DataFrame, as_of) -> DataFrame:
    """Tables that got PII columns in the last seven days, with all of these columns by name;
    ``new_pii_columns`` has them as rows."""
    found = new_pii_columns(columns, as_of).groupBy("table_id").agg(
        F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("name", "pii_class"))).alias("new_pii_columns"))
    return found.select(
        "table_id", F.lit("pii_escalation").alias("kind"), F.lit("high").alias("severity"),
        F.to_json(F.struct("n", "new_pii_columns")).alias("details"),
        F.lit(ACTION_PII).alias("suggested_action"),
    )


def owner_gap(assets: DataFrame, owners: DataFrame) -> DataFrame:
    """Active tables without a verified owner."""
    return unowned(assets.filter(F.col("status") == "active"), owners).select(
        F.col("id").alias("table_id"), F.lit("owner_gap").alias("kind"), F.lit("medium").alias("severity"),
        F.to_json(F.struct(F.lit(0).alias("verified_owners"), F.col("fqn").alias("table_fqn"))).alias("details"),
        F.lit(ACTION_OWNER).alias("suggested_action"),
    )


def detect(assets: DataFrame, snapshots: DataFrame, profiles: DataFrame, columns: DataFrame, owners: DataFrame,
           as_of, skip: set[str] = frozenset(), service: str = "", pattern: str = "") -> DataFrame:
    """Findings of all detectors on active tables, with a confidence by severity."""
    active = assets.filter(F.col("status") == "active")
    if service:
        active = active.filter(F.startswith("fqn", F.lit(service + ".")))
    if pattern:
        active = active.filter(F.contains(F.lower("fqn"), F.lit(pattern.lower())))
    parts = []
    if "volume_drift" not in skip:
        parts.append(volume_drift(snapshots, as_of))
    if "null_spike" not in skip:
        parts.append(null_spike(profiles))
    if "pii_escalation" not in skip:
        parts.append(pii_escalation(columns, as_of))
    if "owner_gap" not in skip:
        parts.append(owner_gap(active, owners))
    if not parts:
        raise ValueError("all detectors are skipped")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    named = active.select(F.col("id").alias("table_id"), F.col("fqn").alias("table_fqn"))
    return found.join(named, "table_id").withColumn(
        "confidence", F.when(F.col("severity") == "high", 0.9).otherwise(0.6)
    )


def severity_counts(findings: DataFrame) -> DataFrame:
    return findings.groupBy("kind", "severity").agg(F.count("*").alias("n"))


def health_scores(assets: DataFrame, findings: DataFrame) -> DataFrame:
    """100 minus 25 / 10 / 3 per high / medium / low finding, at least 0, for every table."""
    severity = F.col("severity")
    lost = (
        F.when(severity == "high", PENALTY["high"]).when(severity == "medium", PENALTY["medium"]).otherwise(PENALTY["low"])
    )
    points = findings.groupBy("table_id").agg(F.sum(lost).alias("lost"))
    return assets.select(F.col("id").alias("table_id")).join(points, "table_id", "left").select(
        "table_id", F.greatest(F.lit(0.0), F.lit(100.0) - F.coalesce("lost", F.lit(0))).alias("health_score")
    )


def average_health(scores: DataFrame) -> DataFrame:
    return scores.agg(F.round(F.avg("health_score"), 1).alias("health_score_avg"), F.count("*").alias("tables"))


def digest(failed: DataFrame, suggestions: DataFrame, assets: DataFrame, as_of, days: int = 7,
           newest: int | None = None, sample: int = 5, service: str = "") -> DataFrame:
    """Findings digest: failed rules, suggestion backlog, undescribed critical and unhealthy tables.

    ``failed`` is lineage.failed_results. Rows: <kind, severity, n, sample>. Every failure has a row, or the
    ``newest`` ones if that is given; the row ``quality_failed_total`` counts them all. The other kinds have one row
    with a full count and the names of the first ``sample`` tables.
    """
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(F.lit(days))
    mine = assets.filter(F.startswith("fqn", F.lit(service + "."))) if service else assets
    active = mine.filter(F.col("status") == "active")
    listed = failed if newest is None else failed.orderBy(F.desc("created_at"), "rule_id", "message").limit(newest)
    quality = listed.select(
        F.lit("quality_failed").alias("kind"), "severity", F.lit(1).cast("bigint").alias("n"),
        F.concat_ws(" | ", "table_fqn", "rule", "message").alias("sample"),
    )
    total = failed.agg(F.count("*").alias("n")).filter(F.col("n") > 0).select(
        F.lit("quality_failed_total").alias("kind"), F.lit("warning").alias("severity"), "n", F.lit("").alias("sample"))
    backlog = suggestions.filter((F.col("status") == "pending") & (F.col("created_at") >= since)).agg(
        F.count("*").alias("n"), F.min("created_at").alias("oldest")
    )
    backlog = backlog.filter(F.col("n") > 0).select(
        F.lit("pending_suggestions").alias("kind"), F.lit("info").alias("severity"), "n",
        F.date_format("oldest", "yyyy-MM-dd HH:mm:ss").alias("sample"),
    )

    def counted(df, kind, text):
        """Count, and the first few by name."""
        n = df.agg(F.count("*").alias("n"))
        top = df.orderBy("fqn").limit(sample).agg(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("fqn", text.alias("s")))), lambda s: s["s"]), ", ").alias("sample")
        )
        return one_row(n, top).filter(F.col("n") > 0).select(
            F.lit(kind).alias("kind"), F.lit("warning").alias("severity"), "n", "sample"
        )

    undescribed = counted(
        active.filter((F.col("tier") == "critical") & F.col("description").isNull()), "critical_no_description", F.col("fqn")
    )
    unhealthy = counted(
        active.filter(F.col("health_score") < 60), "low_health",
        F.concat("fqn", F.lit("="), F.col("health_score").cast("string")),
    )
    return quality.unionByName(total).unionByName(backlog).unionByName(undescribed).unionByName(unhealthy)
