"""Counts, coverage and summaries over catalog tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veritab.functions.pii import HIGH_RISK
from veritab.operators.adjacent import one_row


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows per key; a missing key counts as 'unknown'."""
    return df.groupBy(
        *[F.when(F.coalesce(F.col(k).cast("string"), F.lit("")) != "", F.col(k).cast("string")).otherwise("unknown").alias(k) for k in keys]
    ).agg(F.count("*").alias("n"))


def column_edge_stats(column_edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Edge counts in total, by transform type and by component, and covered tables.

    One pass over the edges: they are counted per (type, component, table)
    first, and all figures are sums over those counts.
    """
    counted = column_edges.groupBy("transform_type", "component", "downstream_id").agg(F.count("*").alias("n"))
    table = F.col("downstream_id").cast("string")

    def figure(metric, key, n, distinct):
        return F.struct(F.lit(metric).alias("metric"), key.alias("key"), n.alias("n"), distinct.alias("table"))

    none, everything = F.lit(None).cast("string"), F.lit("all")
    figures = F.array(
        figure("transform_type", F.col("transform_type"), F.col("n"), none),
        figure("component", F.col("component"), F.col("n"), none),
        figure("edges", everything, F.col("n"), none),
        figure("tables_with_lineage", everything, F.lit(0).cast("bigint"), table),
    )
    sums = (
        counted.select(F.inline(figures))
        .groupBy("metric", "key")
        .agg(F.sum("n").alias("rows"), F.count_distinct("table").alias("tables"))
        .select("metric", "key", F.when(F.col("metric") == "tables_with_lineage", F.col("tables")).otherwise(F.col("rows")).alias("n"))
    )
    tables = assets.agg(F.count("*").alias("n")).select(F.lit("tables").alias("metric"), F.lit("all").alias("key"), "n")
    return sums.unionByName(tables)


def column_edge_counts(columns: DataFrame, column_edges: DataFrame) -> DataFrame:
    """Every column with its number of in-edges and out-edges."""
    ends = column_edges.select(
        F.inline(
            F.array(
                F.struct(F.col("downstream_column_id").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")),
                F.struct(F.col("upstream_column_id").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")),
            )
        )
    )
    counts = ends.groupBy("id").agg(F.sum("up").alias("n_upstream"), F.sum("down").alias("n_downstream"))
    return columns.join(counts, "id", "left").fillna(0, ["n_upstream", "n_downstream"])


def edge_counts(edges: DataFrame) -> DataFrame:
    """Number of table edges at each table, either side."""
    ends = edges.select(F.explode(F.array("upstream_id", "downstream_id")).alias("table_id"))
    return ends.groupBy("table_id").agg(F.count("*").alias("n_table_edges"))


def coverage_matrix(assets: DataFrame, columns: DataFrame, edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """Column-lineage coverage per table; a table without table edges counts as covered.

    Edge ends are reduced to distinct columns and counted per table, so the columns are only
    counted and everything meets at the size of the tables.
    """
    ends = column_edges.select(F.inline(F.array(
        F.struct(F.col("downstream_id").alias("table_id"), F.col("downstream_column_id").alias("column_id")),
        F.struct(F.col("upstream_id").alias("table_id"), F.col("upstream_column_id").alias("column_id")))))
    with_edges = ends.distinct().groupBy("table_id").agg(F.count("*").alias("n_with"))
    base = (
        assets.select(F.col("id").alias("table_id"), F.col("fqn").alias("table_fqn"), "tier")
        .join(columns.groupBy("table_id").agg(F.count("*").alias("n_columns")), "table_id", "left")
        .join(with_edges, "table_id", "left")
        .join(edge_counts(edges), "table_id", "left")
        .fillna(0, ["n_columns", "n_with", "n_table_edges"])
    )
    source = F.col("n_table_edges") == 0
    return base.select(
        "table_id", "table_fqn", "tier", "n_columns",
        F.when(source, F.col("n_columns")).otherwise(F.col("n_with")).alias("n_columns_with_lineage"),
        F.when(source, 100.0)
        .when(F.col("n_columns") > 0, F.round(F.col("n_with") / F.col("n_columns") * 100, 1))
        .otherwise(0.0)
        .alias("coverage_pct"),
        "n_table_edges",
    )


def coverage_totals(matrix: DataFrame) -> DataFrame:
    """Totals of a coverage matrix, with the number of tables at 0 %."""
    return matrix.agg(
        F.count("*").alias("total_tables"),
        F.sum("n_columns").alias("total_columns"),
        F.sum("n_columns_with_lineage").alias("total_columns_with_lineage"),
        F.count_if(F.col("coverage_pct") == 0).alias("tables_at_zero"),
    ).withColumn(
        "overall_coverage_pct",
        F.when(
            F.col("total_columns") > 0,
            F.round(F.col("total_columns_with_lineage") / F.col("total_columns") * 100, 1),
        ).otherwise(0.0),
    )


def description_coverage(assets: DataFrame, columns: DataFrame, edges: DataFrame, column_edges: DataFrame) -> DataFrame:
    """Described rows of each entity, by origin of the text, and the share in percent."""

    def one(df, entity):
        origin = F.col("description_source") if "description_source" in df.columns else F.lit(None).cast("string")
        return df.agg(
            F.count("*").alias("total"),
            F.count("description").alias("described"),
            F.count_if(origin == "ai_inferred").alias("ai"),
            F.count_if(origin == "manual").alias("manual"),
        ).select(
            F.lit(entity).alias("entity"), "total", "described", "ai", "manual",
            F.when(F.col("total") > 0, F.round(F.lit(100) * F.col("described") / F.col("total"), 2)).otherwise(0.0).alias("pct"),
        )

    return (
        one(assets, "table").unionByName(one(columns, "column"))
        .unionByName(one(edges, "table_edge")).unionByName(one(column_edges, "column_edge"))
    )


def pii_summary(columns: DataFrame) -> DataFrame:
    """Per table: PII columns, and how many of them are high risk."""
    return columns.filter(F.col("pii_class") != "none").groupBy("table_id").agg(
        F.count("*").alias("pii_columns"),
        F.count_if(F.col("pii_class").isin(HIGH_RISK)).alias("high_risk_columns"),
    )


def pii_class_counts(columns: DataFrame) -> DataFrame:
    return columns.filter(F.col("pii_class") != "none").groupBy("table_id", "pii_class").agg(F.count("*").alias("n"))


def top_pii_columns(columns: DataFrame, k: int = 20) -> DataFrame:
    """The k most confident PII columns of every table."""
    w = Window.partitionBy("table_id").orderBy(F.desc("pii_confidence"), "ordinal")
    return (
        columns.filter(F.col("pii_class") != "none")
        .withColumn("rank", F.row_number().over(w))
        .filter(F.col("rank") <= k)
        .select("table_id", F.col("name").alias("column_name"), "pii_class", F.col("pii_confidence").alias("confidence"), "rank")
    )


def quality_dashboard(assets: DataFrame, rules: DataFrame, results: DataFrame, suggestions: DataFrame) -> DataFrame:
    """One row: mean health, low tables, rule totals, failing rules, anomalies.

    A rule fails when its latest result did not pass.
    """
    health = assets.agg(
        F.round(F.avg("health_score"), 1).alias("avg_health_score"),
        F.count("*").alias("tables_total"),
        F.count_if(F.col("health_score") < 70).alias("tables_low"),
        F.count_if(F.col("health_score") < 40).alias("tables_critical"),
        F.max("health_score_updated_at").alias("last_run"),
    )
    latest = results.groupBy("rule_id").agg(F.max_by("passed", F.struct("created_at", "passed")).alias("passed"))
    rule_counts = rules.agg(F.count("*").alias("rules_total"))
    failing = latest.agg(F.count_if(~F.col("passed")).alias("rules_failing"))
    insight = suggestions.filter(F.col("suggestion_type") == "insight").agg(
        F.count_if(F.col("status") == "pending").alias("pending_anomalies"),
        F.count_if(F.col("severity") == "critical").alias("critical_anomalies"),
    )
    return one_row(health, rule_counts, failing, insight)


def newest_insights(suggestions: DataFrame, n: int = 20) -> DataFrame:
    return suggestions.filter(F.col("suggestion_type") == "insight").orderBy(F.desc("created_at"), "id").limit(n)


def owner_summary(owners: DataFrame) -> DataFrame:
    """Owners in total and per team, verified and not."""
    return owners.groupBy(F.coalesce("team", F.lit("unknown")).alias("team")).agg(
        F.count("*").alias("total"),
        F.count_if("is_verified").alias("verified"),
        F.count_if(~F.col("is_verified")).alias("unverified"),
    )


def tag_summary(tags: DataFrame) -> DataFrame:
    """Tags and bindings per category of tags with counts."""
    return tags.groupBy("category").agg(F.count("*").alias("tags"), F.sum("asset_count").alias("bindings"))


def term_summary(terms: DataFrame) -> DataFrame:
    """Terms, distinct domains and bindings per first letter."""
    letter = F.when(F.coalesce("name", F.lit("")) != "", F.upper(F.substring("name", 1, 1))).otherwise("#")
    return terms.groupBy(letter.alias("letter")).agg(
        F.count("*").alias("terms"),
        F.count_distinct("domain").alias("domains"),
        F.sum("asset_count").alias("bindings"),
    )


def acceptance(feedback: DataFrame) -> DataFrame:
    """Acceptance per skill, most feedback first; the rate is a whole percent."""
    skill = F.when(F.coalesce("skill", F.lit("")) != "", F.col("skill")).otherwise("unknown")
    return (
        feedback.groupBy(skill.alias("skill"))
        .agg(F.count("*").alias("total"), F.count_if("accepted").alias("accepted"))
        .withColumn("rejected", F.col("total") - F.col("accepted"))
        .withColumn("rate", F.floor(F.col("accepted") * 100 / F.col("total") + 0.5).cast("int"))
        .orderBy(F.desc("total"), "skill")
    )


def edge_breakdown(edges: DataFrame) -> DataFrame:
    """Edges of a neighbourhood by source, transform type and component."""
    out = None
    for column in ("source", "transform_type", "component"):
        part = edges.groupBy(F.lit(column).alias("dimension"), F.coalesce(column, F.lit("unknown")).alias("key")).agg(
            F.count("*").alias("n")
        )
        out = part if out is None else out.unionByName(part)
    return out


def stage_coverage(items: DataFrame) -> DataFrame:
    """Covered and missing stages of 1..6 and the share in percent."""
    stages = F.array_sort(F.collect_set(F.when(F.col("stage").between(1, 6), F.col("stage"))))
    return items.agg(stages.alias("covered")).select(
        F.array_join("covered", ",").alias("covered_stages"),
        F.array_join(F.array_except(F.sequence(F.lit(1), F.lit(6)), "covered"), ",").alias("missing_stages"),
        F.round(F.lit(100) * F.size("covered") / 6, 1).alias("coverage_pct"),
    )


def history_baseline(snapshots: DataFrame, as_of, days: int = 30, key: str = "table_id") -> DataFrame:
    """Median and 0.9 quantile of the daily rows in the window before ``as_of``.

    A key has at most ``days`` snapshots, so the exact quantile state is small.
    """
    day = F.col("day")
    until = F.lit(as_of).cast("date")
    window = snapshots.filter((day < until) & (day >= F.date_sub(until, days)))
    return window.groupBy(key).agg(
        F.percentile("rows", 0.5).alias("median_rows"), F.percentile("rows", 0.9).alias("p90_rows")
    )
