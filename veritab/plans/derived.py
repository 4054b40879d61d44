"""Catalog views derived from the benchmark tables.

The benchmark has no catalog, so assets, columns, edges and the like are derived
from its tables, whole. ``VIEWS`` holds the same definitions as plain SQL for the
oracle engine.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritab.operators import lineage
from veritab.session import spread

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

AS_OF = datetime(2024, 1, 3)
AS_OF_S = 1704240000  # the same moment in epoch seconds

LAYERS = ["stg", "ods", "dwd", "dws", "fct", "dim"]
SERVICES = ["shop", "finance", "growth", "logistics", "superset", "wh"]
SUBTYPES = ["gcs_object", "clickhouse_table", "superset_dashboard"]
SUFFIXES = ["id", "at", "count", "amount", "email", "phone", "status", "url", "uuid", "address", "version", "note"]
RAW_TYPES = ["UInt64", "DateTime", "Nullable(String)", "Decimal(18, 2)", "String"]
BARE_TYPES = ["UInt64", "DateTime", "String", "Decimal(18, 2)", "String"]
PII = ["none", "none", "none", "none", "email", "phone", "none", "none", "uuid_pseudo", "address", "none", "none"]
TRANSFORMS = ["copy", "aggregation", "expression", "derivation", "sql", "ref", "query"]
COMPONENTS = [
    "airflow_task", "dbt_model", "flink_job", "superset_chart", "sql", "gcs_copy", "clickhouse_table", None,
]
EDGE_SUBTYPES = [None, "view", "cte", "io"]
EDGE_SOURCES = ["dbt_manifest", "airflow_dag", "sqlglot", "ai_inferred"]
COLUMN_TRANSFORMS = ["direct", "cast", "aggregation", "expression", "derivation", "window"]
TEAMS = ["data-shop", "data-finance", "data-platform", None]
ROLES = ["owner", "steward", "consumer"]
TAG_CATEGORIES = ["pii", "tier", "domain", "custom"]
KINDS = ["description", "pii_class", "owner", "glossary", "lineage", "insight"]
TARGETS = ["table", "column", "table", "table", "table", "table"]
RUN_TYPES = {"signup": "start", "view": "RUNNING", "click": "Complete", "purchase": "FAIL", "error": "oops"}


def _items(values, engine):
    text = ", ".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"array({text})" if engine == "spark" else f"[{text}]"


def pick(values, expr, engine="spark"):
    """The value at position ``expr`` modulo the list length, as SQL text."""
    if engine == "spark":
        return f"element_at({_items(values, engine)}, cast(({expr}) % {len(values)} + 1 as int))"
    return f"({_items(values, engine)})[({expr}) % {len(values)} + 1]"


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One benchmark table; zone-less timestamps are read as UTC."""
    df = spark.read.parquet(f"{root}/{name}.parquet")
    naive = [f.name for f in df.schema.fields if f.dataType.simpleString() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


# Expressions both engines read alike, with the list lookups filled in per engine.
def _asset_exprs(e):
    return {
        "id": "p_partkey",
        "service": f"concat({pick(SERVICES, 'p_size', e)}, '-', lower(replace(p_brand, '#', '')))",
        "database": "concat('d', p_partkey)",
        "schema_name": "lower(p_type)",
        "name": f"concat({pick(LAYERS, 'p_partkey', e)}, '_', replace(p_name, ' ', '_'))",
        "tier": "case when p_size <= 10 then 'critical' when p_size <= 25 then 'important' else 'normal' end",
        "status": "case when p_size % 7 = 0 then 'deprecated' else 'active' end",
        "asset_type": "case p_partkey % 5 when 0 then 'view' when 1 then 'dbt_model' else 'table' end",
        "asset_subtype": pick(SUBTYPES, "p_partkey", e),
        "description": "case when p_size % 5 = 0 then null else concat(p_name, ' records of ', lower(p_type)) end",
        "description_source": "case when p_size % 5 = 0 then null when p_size % 5 in (1, 2) then 'ai_inferred' else 'manual' end",
        "health_score": "case when p_size % 9 = 0 then null else cast((p_partkey * 7) % 101 as double) end",
        "health_s": "1700000000 + p_partkey % 86400",
        "profiled_s": "case when p_partkey % 3 = 0 then null else 1700000000 + p_partkey % 3600 end",
        "column_count": "p_size",
    }


def _column_exprs(e):
    k = "(l_partkey + l_suppkey)"
    return {
        "id": "concat(l_partkey, ':', l_suppkey)",
        "table_id": "l_partkey",
        "ordinal": "l_suppkey",
        "name": f"concat('s', l_suppkey, '_', {pick(SUFFIXES, 'l_suppkey', e)})",
        "raw_type": pick(RAW_TYPES, "l_suppkey", e),
        "data_type": pick(BARE_TYPES, "l_suppkey", e),
        "nullable": "(l_suppkey % 5 = 2)",
        "pii_class": f"case when {k} % 3 = 0 then 'none' else {pick(PII, 'l_suppkey', e)} end",
        "pii_confidence": f"({k} % 10) / 10.0" if e == "duck" else f"cast({k} % 10 as double) / 10.0D",
        "pii_source": f"case when {k} % 2 = 0 then 'ai_inferred' end",
        "description": f"case when {k} % 4 = 0 then null else concat('column of supplier ', l_suppkey) end",
        "description_source": f"case {k} % 4 when 1 then 'manual' when 2 then 'ai_inferred' when 3 then 'imported' end",
        "sample": "case l_suppkey % 6 when 0 then concat('u', l_suppkey, '@example.com') when 1 then '2024-01-02 03:04:05'"
                  " when 2 then 'US' when 3 then concat('10.0.0.', l_suppkey % 200) else 'n/a' end",
        "created_s": f"{AS_OF_S} - ((l_partkey * 31 + l_suppkey) % 30) * 86400",
        "null_ratio": f"({k} % 20) / 100.0" if e == "duck" else f"cast({k} % 20 as double) / 100.0D",
    }


def _edge_exprs(e):
    k = "(upstream_id + downstream_id)"
    return {
        "id": "concat(upstream_id, '>', downstream_id)",
        "upstream_id": "upstream_id",
        "downstream_id": "downstream_id",
        "low_supp": "low_supp",
        "high_supp": "high_supp",
        "transform_type": pick(TRANSFORMS, k, e),
        "component": pick(COMPONENTS, "upstream_id * 3 + downstream_id", e),
        "transform_subtype": pick(EDGE_SUBTYPES, k, e),
        "job_id": f"case when {k} % 5 = 0 then null else concat('dag_', upstream_id % 10, '.task_', downstream_id % 10) end",
        "transform_expression": f"case when {k} % 3 = 0 then null else concat('sum(c', low_supp, ')') end",
        "sql": f"case when {k} % 3 = 1 then concat('INSERT INTO t', downstream_id, ' SELECT u.a FROM t', upstream_id, ' u') end",
        "source": pick(EDGE_SOURCES, k, e),
        "pipeline_stage": f"nullif({k} % 7, 0)",
        "confidence": f"0.5 + ({k} % 6) / 10.0" if e == "duck" else f"0.5D + cast({k} % 6 as double) / 10.0D",
        "description": f"case when {k} % 2 = 0 then null else concat('edge ', upstream_id, ' to ', downstream_id) end",
        "created_s": f"{AS_OF_S} - first_order",
    }


def _named(exprs):
    return [f"{v} AS {k}" for k, v in exprs.items()]


def _times(df, **columns):
    return df.withColumns({new: F.timestamp_seconds(F.col(old)) for new, old in columns.items()})


def assets(spark, root):
    df = load(spark, root, "part").selectExpr(*_named(_asset_exprs("spark")))
    df = df.withColumn("fqn", F.concat_ws(".", "service", "database", "schema_name", "name"))
    return _times(df, health_score_updated_at="health_s", last_profiled_at="profiled_s")


def columns(spark, root):
    # Dealt by table while the rows are narrow: whoever wants the columns of a table together finds them so.
    df = load(spark, root, "lineitem").select("l_partkey", "l_suppkey").repartition("l_partkey").distinct()
    df = df.selectExpr(*_named(_column_exprs("spark"))).withColumn("sample_values", F.array("sample", F.lit("n/a")))
    return _times(df, created_at="created_s")


def edges(spark, root):
    per_order = load(spark, root, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_partkey").alias("upstream_id"), F.max("l_partkey").alias("downstream_id"),
        F.min("l_suppkey").alias("low_supp"), F.max("l_suppkey").alias("high_supp"),
    )
    df = per_order.filter("upstream_id < downstream_id").groupBy("upstream_id", "downstream_id").agg(
        F.min("low_supp").alias("low_supp"), F.max("high_supp").alias("high_supp"), F.min("l_orderkey").alias("first_order")
    )
    return _times(df.selectExpr(*_named(_edge_exprs("spark"))), created_at="created_s")


def sql_edges(spark, root):
    """Edges whose SQL selects real columns; the others carry none."""
    low = f"concat('s', low_supp, '_', {pick(SUFFIXES, 'low_supp')})"
    high = f"concat('s', high_supp, '_', {pick(SUFFIXES, 'high_supp')})"
    names = assets(spark, root).select("id", "name")
    df = (
        edges(spark, root)
        .join(names.selectExpr("id as upstream_id", "name as up_name"), "upstream_id")
        .join(names.selectExpr("id as downstream_id", "name as down_name"), "downstream_id")
    )
    text = (
        f"concat('INSERT INTO ', down_name, ' SELECT u.', {low}, ' AS ', {low}, ', CAST(u.', {high}, ' AS String) AS ', {high},"
        f" ', max(u.', {low}, ') AS ', {high}, ', q.', {high}, ' AS ', {low}, ' FROM ', up_name, ' u -- from x')"
    )
    return df.withColumn("sql", F.expr(f"case when sql is not null then {text} end"))


def column_edges(spark, root):
    e = edges(spark, root).select("upstream_id", "downstream_id", "component", F.col("job_id").alias("edge_job"), F.col("source").alias("edge_source"))
    matched = lineage.equal_names(e, columns(spark, root), {"id": "upstream_column_id", "ordinal": "ordinal"}, {"id": "downstream_column_id"})
    return matched.withColumnRenamed("column_name", "upstream_col").selectExpr(
        "upstream_id", "downstream_id", "upstream_column_id", "downstream_column_id", "upstream_col", "upstream_col as downstream_col",
        f"{pick(COLUMN_TRANSFORMS, 'ordinal')} as transform_type",
        "concat('x(', upstream_col, ')') as transform_expression",
        "coalesce(component, 'lineage_to_column') as component",
        "coalesce(edge_job, 'unknown') as job_id",
        "case ordinal % 4 when 0 then 0.6D when 1 then 0.7D when 2 then 0.95D else 1.0D end as confidence",
        "case when ordinal % 3 = 0 then null else concat('moves ', upstream_col) end as description",
        "edge_source as source",
    )


def owners(spark, root):
    return load(spark, root, "lineitem").groupBy(F.col("l_partkey").alias("table_id")).agg(
        F.min("l_suppkey").alias("s"), F.sum("l_linenumber").alias("n")
    ).selectExpr(
        "table_id as id", "table_id", "concat('user', s, '@example.com') as user_email", "concat('User ', s) as user_name",
        f"{pick(TEAMS, 's')} as team", f"{pick(ROLES, 's')} as role", "'imported' as source", "n % 2 = 0 as is_verified",
    )


def tags(spark, root):
    number = "cast(replace(p_brand, 'Brand#', '') as int)"
    return load(spark, root, "part").select("p_brand").distinct().selectExpr(
        "lower(replace(p_brand, '#', '_')) as id", "lower(replace(p_brand, '#', '_')) as name",
        f"{pick(TAG_CATEGORIES, number)} as category", "concat('tables of ', p_brand) as description",
    )


def asset_tags(spark, root):
    return load(spark, root, "part").selectExpr("p_partkey as table_id", "lower(replace(p_brand, '#', '_')) as tag_id")


def terms(spark, root):
    return load(spark, root, "part").selectExpr("explode(split(p_name, ' ')) as id").distinct().selectExpr(
        "id", "id as name", "concat('items described as ', id) as definition",
        "case length(id) % 3 when 0 then 'shop' when 1 then 'finance' end as domain",
        "array(concat(substring(id, 2, 2)), upper(concat(id, '_brand'))) as synonyms",
    )


def asset_terms(spark, root):
    return load(spark, root, "part").selectExpr("p_partkey as table_id", "explode(split(p_name, ' ')) as term_id")


def suggestions(spark, root):
    df = load(spark, root, "orders").selectExpr(
        "o_orderkey as id", "o_custkey as target_id", "o_orderdate as created_at",
        "case o_orderstatus when 'O' then 'pending' when 'F' then 'approved' else 'rejected' end as status",
        f"{pick(KINDS, 'o_orderkey')} as suggestion_type", f"{pick(TARGETS, 'o_orderkey')} as target_type",
        "round(o_totalprice / 500000, 2) as confidence",
        "case when o_orderpriority = '1-URGENT' then 'critical' else 'info' end as severity",
        "concat('skill_', o_orderkey % 4) as skill",
    )
    payload = F.create_map(
        F.lit("description"), F.concat(F.lit("text "), F.col("id")),
        F.lit("tier"), F.when(F.col("id") % 4 == 0, "gold").otherwise("important"),
        F.lit("column_id"), F.concat("target_id", F.lit(":"), F.col("id") % 10),
        F.lit("pii_class"), F.lit("phone"),
        F.lit("user_email"), F.concat(F.lit(" User"), F.col("id") % 5, F.lit("@Example.com ")),
        F.lit("team"), F.lit("data-shop"),
        F.lit("term_id"), F.when(F.col("id") % 4 == 1, "ring").otherwise("nothing"),
    )
    return df.withColumn("payload", payload)


def run_events(spark, root):
    """Events as run-event documents of the ingest schema."""
    kinds = " ".join(f"when '{k}' then '{v}'" for k, v in RUN_TYPES.items())
    return load(spark, root, "events").selectExpr(
        f"case event_type {kinds} end as eventType",
        "date_format(ts, 'yyyy-MM-dd HH:mm:ss') as eventTime",
        "concat('ns_', user_id % 3) as ns", "concat('job_', user_id) as jn",
        "case when value < 2 then null else concat('run_', event_id) end as rid",
        "get_json_object(props, '$.k') as k",
    ).select(
        "eventType", "eventTime", F.lit("feed").alias("producer"), F.lit(None).cast("string").alias("schemaURL"),
        F.struct(F.col("ns").alias("namespace"), F.col("jn").alias("name")).alias("job"),
        F.struct(F.col("rid").alias("runId")).alias("run"),
        F.array(F.struct(F.col("ns").alias("namespace"), F.concat(F.lit("in_"), "k").alias("name"))).alias("inputs"),
        F.lit(None).cast("array<struct<namespace: string, name: string>>").alias("outputs"),
        F.create_map(F.lit("k"), F.col("k")).alias("runFacets"),
        F.lit(None).cast("map<string,string>").alias("jobFacets"),
    )


def feedback_of(events):
    """Feedback rows of an events frame, batch or stream."""
    return events.selectExpr(
        "event_id as seq", "event_type as skill", "cast(user_id as string) as case_key",
        "concat('p', event_id) as pred",
        "case when cast(get_json_object(props, '$.k') as int) % 2 = 0 then concat('fix', event_id) end as new_payload",
        "value >= 60 as accepted", "concat('because ', event_id) as reason", "ts as created_at",
    )


def feedback(spark, root):
    return feedback_of(load(spark, root, "events"))


def snapshots(spark, root):
    return load(spark, root, "events").groupBy(F.col("user_id").alias("table_id"), F.to_date("ts").alias("day")).agg(
        F.count("*").alias("rows")
    )


def rules(spark, root):
    """One stored rule per supplier, and its results: one per line item."""
    return load(spark, root, "supplier").selectExpr(
        "concat('r', s_suppkey) as rule_id", "s_suppkey as table_id", "concat('rule of ', s_name) as name",
        "case s_suppkey % 3 when 0 then 'volume' when 1 then 'null_ratio' else 'freshness' end as rule_type",
        "case when s_acctbal < 3000 then 'high' else 'medium' end as severity",
        "s_acctbal >= 1000 as is_enabled", f"timestamp_seconds({AS_OF_S} - s_suppkey) as created_at",
    )


def results(spark, root):
    return load(spark, root, "lineitem").selectExpr(
        "concat('r', l_suppkey) as rule_id", "l_returnflag <> 'R' as passed", "l_quantity as observed",
        "concat('order ', l_orderkey, ' line ', l_linenumber, ' part ', l_partkey) as message", "l_shipdate as created_at",
    )


def sql_log(spark, root):
    """One query text per asset, in ten shapes."""
    name = f"concat({pick(LAYERS, 'p_partkey')}, '_', replace(p_name, ' ', '_'))"
    col = f"concat('s', p_size, '_', {pick(SUFFIXES, 'p_size')})"
    return spread(load(spark, root, "part").select("p_partkey", "p_size", "p_name", "p_type")).selectExpr(
        "p_partkey as query_id", "p_size", f"{name} as tname", f"{col} as cname", "lower(p_type) as sname"
    ).selectExpr("query_id", f"{SQL_TEXT} as sql")


# Query texts; the expression reads alike in both engines.
SQL_TEXT = """case query_id % 10
 when 0 then concat('SELECT u.', cname, ' AS a, sum(u.x) AS b FROM ', tname, ' u WHERE u.', cname, ' > 1')
 when 1 then concat('select * from ', sname, '.', tname, ' limit 50000')
 when 2 then concat('DELETE FROM ', tname)
 when 3 then concat('SELECT 1; SELECT 2 FROM ', tname)
 when 4 then concat('SELECT a FROM ', tname, ' -- drop table x')
 when 5 then concat('/* update */ SELECT a.', cname, ', b.k FROM ', tname, ' a JOIN missing_', p_size, ' b ON a.id = b.id LIMIT 20')
 when 6 then concat('INSERT INTO sink_', p_size, ' SELECT cast(a as int) AS a, b + 1 AS b FROM src.', tname)
 when 7 then concat('WITH x AS (SELECT * FROM ', tname, ' LIMIT 5) SELECT k FROM x')
 when 8 then concat('SELECT ''from fake_table'' AS lit, lower(u.', cname, ') AS c FROM ', tname, ' AS u;')
 else 'SHOW TABLES' end"""


def descriptors(spark, root):
    """Use-case descriptors, one per customer."""
    return load(spark, root, "customer").selectExpr(
        "concat('file_', c_custkey) as file_stem", "c_custkey",
        "named_struct('id', case when c_custkey % 5 = 0 then null else concat('uc-', c_custkey) end,"
        " 'version', cast(c_custkey % 3 + 1 as int), 'description', lower(c_mktsegment),"
        " 'owners', array(concat('own', c_nationkey)),"
        " 'sources', transform(sequence(1, cast(c_custkey % 4 + 1 as int)), i -> named_struct('id', concat('s', i), 'type', 't', 'stage', i)),"
        " 'analysis', array('a', 'b')) as s",
    ).select("file_stem", F.to_json("s").alias("spec"))


def versions_of(events):
    """Descriptor versions of an events frame: one id per user, the text in props."""
    return events.selectExpr(
        "cast(user_id as string) as id", "event_id as seq", "ts as mtime",
        "substring(sha2(concat('v', cast(get_json_object(props, '$.k') as int) % 3), 256), 1, 16) as sha",
    )


def eval_cases(spark, root):
    """Gold cases from documents, with the document text as the output to score."""
    return load(spark, root, "documents").selectExpr(
        "cast(doc_id as string) as id", "concat('skill_', lang) as skill", "text as pred_text", "text as pred_sql",
        "array(source, lang) as passed_guards", "n_chars as latency_ms",
        "named_struct("
        "'exact', case when doc_id % 6 = 0 then (case when n_chars % 2 = 0 then text else 'x' end) end,"
        "'contains', case when doc_id % 6 = 1 then array('the', 'INH', lang) end,"
        "'max_length', case when doc_id % 6 = 1 then 500 end,"
        "'min_length', cast(null as int),"
        "'must_contain', case when doc_id % 6 = 2 then array('an', 'The ') end,"
        "'must_not_contain', case when doc_id % 6 = 2 then array('reating', 'ouen') end,"
        "'fqn', case when doc_id % 6 = 3 then 'a.b' end,"
        "'sql_safety', cast(null as string),"
        "'guards', case when doc_id % 6 = 4 then array('en', 'src1', lang) end) as gold",
    )


def _view(source, exprs):
    return f"SELECT {', '.join(_named(exprs))} FROM {source}"


_D = "duck"
VIEWS = {
    "assets": (["part"], "SELECT *, concat_ws('.', service, database, schema_name, name) AS fqn FROM (" + _view("part", _asset_exprs(_D)) + ")"),
    "cols": (["lineitem"], _view("(SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)", _column_exprs(_D))),
    "edges": (
        ["lineitem"],
        _view(
            "(SELECT upstream_id, downstream_id, min(a) AS low_supp, max(b) AS high_supp, min(l_orderkey) AS first_order FROM"
            " (SELECT l_orderkey, min(l_partkey) AS upstream_id, max(l_partkey) AS downstream_id, min(l_suppkey) AS a,"
            " max(l_suppkey) AS b FROM lineitem GROUP BY 1) WHERE upstream_id < downstream_id GROUP BY 1, 2)",
            _edge_exprs(_D),
        ),
    ),
    "cedges": (
        ["edges", "cols"],
        "SELECT e.upstream_id, e.downstream_id, u.id AS upstream_column_id, d.id AS downstream_column_id, u.name AS upstream_col,"
        f" {pick(COLUMN_TRANSFORMS, 'u.ordinal', _D)} AS transform_type, concat('x(', u.name, ')') AS transform_expression,"
        " coalesce(e.component, 'lineage_to_column') AS component, coalesce(e.job_id, 'unknown') AS job_id,"
        " CASE u.ordinal % 4 WHEN 0 THEN 0.6 WHEN 1 THEN 0.7 WHEN 2 THEN 0.95 ELSE 1.0 END AS confidence,"
        " CASE WHEN u.ordinal % 3 = 0 THEN NULL ELSE concat('moves ', u.name) END AS description, e.source AS source"
        " FROM edges e JOIN cols u ON u.table_id = e.upstream_id JOIN cols d ON d.table_id = e.downstream_id AND d.name = u.name",
    ),
    "owners": (
        ["lineitem"],
        "SELECT table_id AS id, table_id, concat('user', s, '@example.com') AS user_email, concat('User ', s) AS user_name,"
        f" {pick(TEAMS, 's', _D)} AS team, {pick(ROLES, 's', _D)} AS role, 'imported' AS source, n % 2 = 0 AS is_verified"
        " FROM (SELECT l_partkey AS table_id, min(l_suppkey) AS s, sum(l_linenumber) AS n FROM lineitem GROUP BY 1)",
    ),
    "tags": (
        ["part"],
        "SELECT lower(replace(p_brand, '#', '_')) AS id, lower(replace(p_brand, '#', '_')) AS name,"
        f" {pick(TAG_CATEGORIES, chr(99) + 'ast(replace(p_brand, ' + chr(39) + 'Brand#' + chr(39) + ', ' + chr(39) * 2 + ') AS int)', _D)} AS category,"
        " concat('tables of ', p_brand) AS description FROM (SELECT DISTINCT p_brand FROM part)",
    ),
    "asset_tags": (["part"], "SELECT p_partkey AS table_id, lower(replace(p_brand, '#', '_')) AS tag_id FROM part"),
    "terms": (
        ["part"],
        "SELECT id, id AS name, concat('items described as ', id) AS definition, CASE length(id) % 3 WHEN 0 THEN 'shop' WHEN 1"
        " THEN 'finance' END AS domain, [substring(id, 2, 2), upper(concat(id, '_brand'))] AS synonyms FROM"
        " (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS id FROM part)",
    ),
    "asset_terms": (["part"], "SELECT p_partkey AS table_id, unnest(string_split(p_name, ' ')) AS term_id FROM part"),
    "sugg": (
        ["orders"],
        "SELECT o_orderkey AS id, o_custkey AS target_id, CAST(epoch(o_orderdate) AS BIGINT) AS created_s,"
        " CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END AS status,"
        f" {pick(KINDS, 'o_orderkey', _D)} AS suggestion_type, {pick(TARGETS, 'o_orderkey', _D)} AS target_type,"
        " round(o_totalprice / 500000, 2) AS confidence, CASE WHEN o_orderpriority = '1-URGENT' THEN 'critical' ELSE 'info' END AS severity,"
        " concat('skill_', o_orderkey % 4) AS skill FROM orders",
    ),
    "runs": (
        ["events"],
        "SELECT event_id, upper(CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in RUN_TYPES.items())
        + " END) AS event_type, CAST(floor(epoch(ts)) AS BIGINT) AS event_s, concat('ns_', user_id % 3) AS job_namespace,"
        " concat('job_', user_id) AS job_name, CASE WHEN value < 2 THEN NULL ELSE concat('run_', event_id) END AS run_id,"
        " json_extract_string(props, '$.k') AS k, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events",
    ),
    "fb": (
        ["events"],
        "SELECT event_id AS seq, event_type AS skill, CAST(user_id AS VARCHAR) AS case_key, concat('p', event_id) AS pred,"
        " CASE WHEN CAST(json_extract_string(props, '$.k') AS int) % 2 = 0 THEN concat('fix', event_id) END AS new_payload,"
        " value >= 60 AS accepted, concat('because ', event_id) AS reason FROM events",
    ),
    "snaps": (["events"], "SELECT user_id AS table_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2"),
    "rules": (
        ["supplier"],
        "SELECT concat('r', s_suppkey) AS rule_id, s_suppkey AS table_id, concat('rule of ', s_name) AS name,"
        " CASE s_suppkey % 3 WHEN 0 THEN 'volume' WHEN 1 THEN 'null_ratio' ELSE 'freshness' END AS rule_type,"
        " CASE WHEN s_acctbal < 3000 THEN 'high' ELSE 'medium' END AS severity, s_acctbal >= 1000 AS is_enabled,"
        f" {AS_OF_S} - s_suppkey AS created_s FROM supplier",
    ),
    "results": (
        ["lineitem"],
        "SELECT concat('r', l_suppkey) AS rule_id, l_returnflag <> 'R' AS passed, l_quantity AS observed,"
        " concat('order ', l_orderkey, ' line ', l_linenumber, ' part ', l_partkey) AS message,"
        " CAST(epoch(l_shipdate) AS BIGINT) AS created_s FROM lineitem",
    ),
    "sql_log": (
        ["part"],
        f"SELECT query_id, p_size, tname, cname, sname, {SQL_TEXT} AS sql FROM (SELECT p_partkey AS query_id, p_size,"
        f" concat({pick(LAYERS, 'p_partkey', _D)}, '_', replace(p_name, ' ', '_')) AS tname,"
        f" concat('s', p_size, '_', {pick(SUFFIXES, 'p_size', _D)}) AS cname, lower(p_type) AS sname FROM part)",
    ),
    "versions": (
        ["events"],
        "SELECT CAST(user_id AS VARCHAR) AS id, event_id AS seq, ts AS mtime, substring(sha256(concat('v',"
        " CAST(json_extract_string(props, '$.k') AS int) % 3)), 1, 16) AS sha FROM events",
    ),
}


def oracle(body: str, *views: str) -> str:
    """SQL text of ``body`` over the named derived views."""
    order: list[str] = []

    def need(v):
        if v in VIEWS and v not in order:
            for parent in VIEWS[v][0]:
                need(parent)
            order.append(v)

    for v in views:
        need(v)
    if not order:
        return body
    head = ", ".join(f"{v} AS ({VIEWS[v][1]})" for v in order)
    text = body.lstrip()
    if text.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {head}, {text[15:]}"
    if text.upper().startswith("WITH "):
        return f"WITH {head}, {text[5:]}"
    return f"WITH {head} {text}"
