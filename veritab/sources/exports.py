"""BI exports, job declarations, model IO declarations and task lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veritab.functions import sqltext
from veritab.operators.adjacent import adjacent_value

# Service and database candidates of a BI dataset, in order.
WAREHOUSE_SERVICES = ["ch-shop_dw", "clickhouse-prod", "dbt-shop_dw"]
DATABASE_ALIASES = ["shop", "shop_dw"]
# Ordinals of one DAG that are ordered together.
TASKS_PER_BUCKET = 1_000_000


def dashboard_charts(dashboards: DataFrame) -> DataFrame:
    """Distinct (dashboard, chart) pairs: metadata list plus slices."""
    empty = F.array().cast("array<bigint>")
    ids = F.array_union(F.coalesce("chart_ids", empty), F.coalesce("slice_ids", empty))
    return dashboards.select(F.col("id").alias("dashboard_id"), F.explode(ids).alias("chart_id"))


def bi_assets(dashboards: DataFrame, charts: DataFrame, datasets: DataFrame, service: str) -> DataFrame:
    """Dashboard, chart and dataset assets of a BI export.

    Only charts that some dashboard shows, and datasets those charts read.
    """
    used = dashboard_charts(dashboards).select(F.col("chart_id").alias("id")).distinct()
    shown = charts.join(used, "id", "left_semi")
    read = datasets.join(
        shown.filter(F.col("dataset_id").isNotNull()).select(F.col("dataset_id").alias("id")).distinct(),
        "id", "left_semi",
    )

    def asset(df, kind, part, name, description, chart_ids=None):
        return df.select(
            F.concat(F.lit(f"{service}.{part}."), F.col("id").cast("string")).alias("fqn"),
            name.alias("name"),
            F.lit(kind).alias("asset_type"),
            description.alias("description"),
            (chart_ids if chart_ids is not None else F.lit(None).cast("array<bigint>")).alias("chart_ids"),
        )

    sid = F.col("id").cast("string")
    boards = asset(
        dashboards, "superset_dashboard", "dashboard",
        F.coalesce("title", F.concat(F.lit("dashboard_"), sid)),
        F.coalesce("description", "title", F.concat(F.lit("dashboard_"), sid)),
        F.col("chart_ids"),
    )
    chart_rows = asset(
        shown, "superset_chart", "chart",
        F.coalesce("slice_name", F.concat(F.lit("chart_"), sid)),
        F.coalesce("slice_name", F.concat(F.lit("Superset chart #"), sid)),
    )
    dataset_rows = asset(
        read, "superset_dataset", "ds",
        F.concat(F.lit("dataset_"), sid),
        F.concat(F.lit("Superset dataset #"), sid),
    )
    return boards.unionByName(chart_rows).unionByName(dataset_rows)


def resolve_datasets(datasets: DataFrame, assets: DataFrame) -> DataFrame:
    """Warehouse table of each dataset: the first candidate name that exists.

    Candidates: services x (own database, aliases) x (own schema, default).
    """
    schema = F.coalesce("schema_name", F.lit("default"))
    databases = F.array_distinct(F.array(F.col("database"), *[F.lit(a) for a in DATABASE_ALIASES]))
    schemas = F.array_distinct(F.array(schema, F.lit("default")))
    candidates = F.flatten(
        F.transform(
            F.array(*[F.lit(s) for s in WAREHOUSE_SERVICES]),
            lambda s: F.flatten(
                F.transform(
                    databases,
                    lambda d: F.transform(schemas, lambda n: F.concat_ws(".", s, d, n, F.col("table_name"))),
                )
            ),
        )
    )
    # Names are built here from short columns, so that estimates from files are far too low to broadcast a side by.
    exploded = datasets.select(F.col("id").alias("dataset_id"), F.posexplode(candidates).alias("rank", "fqn"))
    hits = exploded.join(assets.select("fqn", F.col("id").alias("table_id")).hint("merge"), "fqn")
    return (
        hits.groupBy("dataset_id")
        .agg(F.min(F.struct("rank", "fqn", "table_id")).alias("best"))
        .select("dataset_id", F.col("best.fqn").alias("fqn"), F.col("best.table_id").alias("table_id"))
    )


def bi_edges(charts: DataFrame, datasets: DataFrame, resolved: DataFrame, service: str) -> DataFrame:
    """Chart -> dataset and dataset -> table edges, confidence 0.95."""
    known = datasets.select(F.col("id").alias("dataset_id")).hint("merge")
    chart_edges = charts.join(known, "dataset_id").select(
        F.concat(F.lit(f"{service}.chart."), F.col("id").cast("string")).alias("upstream_fqn"),
        F.concat(F.lit(f"{service}.ds."), F.col("dataset_id").cast("string")).alias("downstream_fqn"),
        F.lit("superset_chart").alias("transform_type"),
        F.lit(None).cast("string").alias("transform_subtype"),
    )
    dataset_edges = resolved.select(
        F.concat(F.lit(f"{service}.ds."), F.col("dataset_id").cast("string")).alias("upstream_fqn"),
        F.col("fqn").alias("downstream_fqn"),
        F.lit("superset_dataset").alias("transform_type"),
        F.lit("dataset_to_table").alias("transform_subtype"),
    )
    return (
        chart_edges.unionByName(dataset_edges)
        .groupBy("upstream_fqn", "downstream_fqn", "transform_type").agg(F.min("transform_subtype").alias("transform_subtype"))
        .withColumn("confidence", F.lit(0.95))
        .withColumn("source", F.col("transform_type"))
    )


def merge_declarations(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Refresh pipeline rows <name, type, stage, description, config>.

    A new stage replaces the old one when given; configs are merged, new keys win.
    One row per (name, type) on each side.
    """
    e, n = existing.alias("e"), incoming.alias("n")
    merged = F.map_concat(
        F.map_filter(
            F.coalesce("e.config", F.create_map().cast("map<string,string>")),
            lambda k, v: ~F.coalesce(F.map_contains_key(F.col("n.config"), k), F.lit(False)),
        ),
        F.coalesce("n.config", F.create_map().cast("map<string,string>")),
    )
    return e.join(n, ["name", "type"], "full").select(
        "name", "type",
        F.coalesce("n.stage", "e.stage").alias("stage"),
        F.coalesce("n.description", "e.description").alias("description"),
        merged.alias("config"),
    )


def job_edges(jobs: DataFrame) -> DataFrame:
    """Source x sink edges of jobs <path, sql, stage, subtype>, statement by statement.

    A statement names a few tables, so the product per statement is small. The sink
    counts among the sources in the text; self edges are dropped. An edge that several statements
    of a path make is one, with the least stage and subtype.
    """
    one = jobs.select("path", "stage", "subtype", F.explode(sqltext.statements(F.col("sql"))).alias("statement"))
    rows = one.select(
        "path", "stage", "subtype",
        F.lower(sqltext.write_target(F.col("statement"))).alias("downstream_fqn"),
        F.explode(sqltext.statement_sources(F.col("statement"))).alias("src"),
    ).withColumn("upstream_fqn", F.lower("src"))
    return (
        rows.filter(F.col("downstream_fqn").isNotNull() & (F.col("upstream_fqn") != F.col("downstream_fqn")))
        .groupBy("upstream_fqn", "downstream_fqn", "path").agg(F.min(F.struct("stage", "subtype")).alias("first"))
        .select("upstream_fqn", "downstream_fqn", "path", "first.*")
        .select(
            "upstream_fqn", "downstream_fqn",
            F.lit("flink_sql").alias("transform_type"),
            F.col("subtype").alias("transform_subtype"),
            F.col("stage").alias("pipeline_stage"),
            F.lit(0.9).alias("confidence"),
            F.lit("github_mcp").alias("source"),
            F.col("path").alias("job_id"),
        )
    )


def model_io_edges(models: DataFrame, stage: int = 3) -> DataFrame:
    """Three edges per model IO declaration <name, input_fqn, output_fqn>.

    input -> in port, in port -> out port, out port -> output, at stages n-1, n, n+1.
    """
    inside = F.concat(F.lit("mex://"), F.col("name"), F.lit("/in"))
    outside = F.concat(F.lit("mex://"), F.col("name"), F.lit("/out"))

    def edge(up, down, subtype, at):
        return F.struct(
            up.alias("upstream_fqn"), down.alias("downstream_fqn"),
            F.lit(subtype).alias("transform_subtype"), F.lit(at).alias("pipeline_stage"),
        )

    edges = F.array(
        edge(F.col("input_fqn"), inside, "gcs_to_mex", stage - 1),
        edge(inside, outside, "mex_internal", stage),
        edge(outside, F.col("output_fqn"), "mex_to_gcs", stage + 1),
    )
    return (
        models.select(F.col("name").alias("model"), F.explode(edges).alias("e"))
        .select("model", "e.*")
        .filter(F.col("upstream_fqn").isNotNull() & F.col("downstream_fqn").isNotNull())
        .withColumn("transform_type", F.lit("mex_inference"))
        .withColumn("confidence", F.lit(0.8))
    )


def resolve_edges(edges: DataFrame, assets: DataFrame) -> DataFrame:
    """Keep edges whose both ends are registered; add the two ids."""
    ids = assets.select("id", "fqn")
    up = ids.select(F.col("id").alias("upstream_id"), F.col("fqn").alias("upstream_fqn"))
    down = ids.select(F.col("id").alias("downstream_id"), F.col("fqn").alias("downstream_fqn"))
    return edges.join(up, "upstream_fqn").join(down, "downstream_fqn")


def task_chain(tasks: DataFrame, stage: int = 1) -> DataFrame:
    """Each task to the next task of the same DAG <dag_id, ordinal, task_id>."""
    bucket = F.floor(F.col("ordinal") / TASKS_PER_BUCKET)
    return (
        adjacent_value(tasks, "dag_id", bucket, ["ordinal"], "task_id", "next_task", forward=True)
        .filter(F.col("next_task").isNotNull() & (F.col("next_task") != F.col("task_id")))
        .select(
            "dag_id", F.col("task_id").alias("upstream_task"), F.col("next_task").alias("downstream_task"),
            F.lit("airflow_task").alias("transform_type"), F.lit("dag_chain").alias("transform_subtype"),
            F.concat("dag_id", F.lit("::"), "task_id", F.lit("->"), "next_task").alias("job_id"),
            F.lit(stage).alias("pipeline_stage"), F.lit(0.8).alias("confidence"),
            F.lit("airflow_dag").alias("source"),
        )
    )
