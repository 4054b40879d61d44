"""Profiles, rules and anomalies over the benchmark tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from veritab.operators import anomaly, lineage, quality
from veritab.operators.quality import Rule
from veritab.plans import derived as d
from veritab.plans.derived import AS_OF, AS_OF_S, load, oracle
from veritab.plans.registry import QUERIES
from veritab.session import scratch_path
from veritab.sources import sinks

RULES_AS_OF = datetime(2001, 8, 2)
RULES_AS_OF_S = 996710400
O, L = "wh.db.default.orders", "wh.db.default.lineitem"


def _q(name, sql=None):
    return QUERIES.operator(name, group="quality", oracle=sql)


def _profile_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS row_count,"
        f" round(count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*), 3) AS null_ratio,"
        f" count(DISTINCT CAST({c} AS VARCHAR)) AS distinct_count FROM {table}"
        for c in columns
    )


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
            "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


@_q("q1_profile_lineitem", _profile_sql("lineitem", LINEITEM))
def q1_profile_lineitem(spark, root):
    return quality.profile(load(spark, root, "lineitem"))


@_q("q1_profile_documents", _profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def q1_profile_documents(spark, root):
    return quality.profile(load(spark, root, "documents"))


@_q("q1_sample_values",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, string_agg(CAST({c} AS VARCHAR), '|' ORDER BY o_orderkey) AS sample_values"
        " FROM (SELECT * FROM orders ORDER BY o_orderkey LIMIT 10)"
        for c in ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]) + ")")
def q1_sample_values(spark, root):
    out = quality.sample_values(load(spark, root, "orders"), ["o_orderkey"])
    return out.withColumn("sample_values", F.array_join("sample_values", "|"))


def _rule_sql(rule_id, fqn, passed, observed, threshold, message, table, status="checked"):
    source = f" FROM {table}" if table else ""
    return (
        f"SELECT '{rule_id}' AS rule_id, '{fqn}' AS table_fqn, '{status}' AS status, {passed} AS passed,"
        f" CAST({observed} AS DOUBLE) AS observed, CAST({threshold} AS DOUBLE) AS threshold, {message} AS message{source}"
    )


def _run(spark, root, rules):
    tables = {O: load(spark, root, "orders"), L: load(spark, root, "lineitem")}
    return quality.run_rules(spark, tables, rules, RULES_AS_OF, views={"governed_orders": tables[O]})


FRESH = [
    Rule("fresh_wide", O, "freshness", {"column": "o_orderdate", "threshold_minutes": 5_000_000}),
    Rule("fresh_tight", L, "freshness", {"column": "l_shipdate"}),
    Rule("fresh_bad", O, "freshness", {}),
]
_AGE = f"CAST(floor(({RULES_AS_OF_S} - epoch(max({{c}}))) / 60) AS BIGINT)"
_fresh_o, _fresh_l = _AGE.format(c="o_orderdate"), _AGE.format(c="l_shipdate")
FRESH_SQL = [
    _rule_sql("fresh_wide", O, f"{_fresh_o} <= 5000000", _fresh_o, "5000000",
              f"concat('last o_orderdate ', {_fresh_o}, 'm ago (limit 5000000m)')", "orders"),
    _rule_sql("fresh_tight", L, f"{_fresh_l} <= 60", _fresh_l, "60",
              f"concat('last l_shipdate ', {_fresh_l}, 'm ago (limit 60m)')", "lineitem"),
    _rule_sql("fresh_bad", O, "false", "NULL", "NULL", "'bad col: created_at'", None),
]
VOLUME = [
    Rule("vol_min", L, "volume", {"min": 1000}),
    Rule("vol_max", O, "volume", {"max": 5000}),
    Rule("vol_both", O, "volume", {"min": 1, "max": 10**12}),
]
VOLUME_SQL = [
    _rule_sql("vol_min", L, "count(*) >= 1000", "count(*)", "1000", "concat('row_count=', count(*), ' expected 1000~None')", "lineitem"),
    _rule_sql("vol_max", O, "count(*) <= 5000", "count(*)", "5000", "concat('row_count=', count(*), ' expected None~5000')", "orders"),
    _rule_sql("vol_both", O, "count(*) BETWEEN 1 AND 1000000000000", "count(*)", "1",
              "concat('row_count=', count(*), ' expected 1~1000000000000')", "orders"),
]
NULLS = [
    Rule("nulls_flag", L, "null_ratio", {"column": "l_returnflag"}),
    Rule("nulls_zero", O, "null_ratio", {"column": "o_orderpriority", "threshold": 0}),
    Rule("nulls_bad", O, "null_ratio", {"column": "no such"}),
]


def _ratio(c):
    return f"(count(*) FILTER (WHERE {c} IS NULL OR CAST({c} AS VARCHAR) = '') / count(*))"


NULLS_SQL = [
    _rule_sql("nulls_flag", L, f"{_ratio('l_returnflag')} <= 0.5", f"round({_ratio('l_returnflag')}, 4)", "0.5",
              f"printf('null_ratio=%.3f limit 0.5', {_ratio('l_returnflag')})", "lineitem"),
    _rule_sql("nulls_zero", O, f"{_ratio('o_orderpriority')} <= 0", f"round({_ratio('o_orderpriority')}, 4)", "0",
              f"printf('null_ratio=%.3f limit 0.0', {_ratio('o_orderpriority')})", "orders"),
    _rule_sql("nulls_bad", O, "false", "NULL", "0.5", "'bad col'", None),
]
DISTINCT = [
    Rule("distinct_cust", O, "distinct", {"column": "o_custkey", "min": 100}),
    Rule("distinct_flag", L, "distinct", {"column": "l_returnflag", "min": 4}),
]
DISTINCT_SQL = [
    _rule_sql("distinct_cust", O, "count(DISTINCT o_custkey) >= 100", "count(DISTINCT o_custkey)", "100",
              "concat('distinct=', count(DISTINCT o_custkey), ' min 100')", "orders"),
    _rule_sql("distinct_flag", L, "count(DISTINCT l_returnflag) >= 4", "count(DISTINCT l_returnflag)", "4",
              "concat('distinct=', count(DISTINCT l_returnflag), ' min 4')", "lineitem"),
]
CUSTOM = [
    Rule("custom_hit", O, "custom", {"sql": "SELECT * FROM governed_orders WHERE o_totalprice > 400000"}),
    Rule("custom_none", O, "custom", {"sql": "SELECT * FROM governed_orders WHERE o_totalprice < 0"}),
    Rule("custom_drop", O, "custom", {"sql": "DROP TABLE governed_orders"}),
    Rule("custom_empty", O, "custom", {}),
]
CUSTOM_SQL = [
    _rule_sql("custom_hit", O, "count(*) = 0", "count(*)", "0", "concat('custom check returned ', count(*), ' rows')",
              "orders WHERE o_totalprice > 400000"),
    _rule_sql("custom_none", O, "count(*) = 0", "count(*)", "0", "concat('custom check returned ', count(*), ' rows')",
              "orders WHERE o_totalprice < 0"),
    _rule_sql("custom_drop", O, "false", "NULL", "0", "'sql: DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)'", None),
    _rule_sql("custom_empty", O, "false", "NULL", "0", "'missing sql'", None),
]
OTHER = [
    Rule("unknown_type", O, "magic", {}),
    Rule("no_table", "wh.db.default.nothing", "volume", {"min": 1}),
    Rule("switched_off", O, "volume", {"min": 1}, enabled=False),
]
OTHER_SQL = [
    _rule_sql("unknown_type", O, "false", "NULL", "NULL", "'unknown rule_type: magic'", None),
    _rule_sql("no_table", "wh.db.default.nothing", "NULL", "NULL", "NULL", "'table missing'", None, "skipped"),
]
U = " UNION ALL "


@_q("q2_freshness", U.join(FRESH_SQL))
def q2_freshness(spark, root):
    return _run(spark, root, FRESH)


@_q("q3_volume", U.join(VOLUME_SQL))
def q3_volume(spark, root):
    return _run(spark, root, VOLUME)


@_q("q4_null_ratio", U.join(NULLS_SQL))
def q4_null_ratio(spark, root):
    return _run(spark, root, NULLS)


@_q("q5_distinct", U.join(DISTINCT_SQL))
def q5_distinct(spark, root):
    return _run(spark, root, DISTINCT)


@_q("q6_custom_sql", U.join(CUSTOM_SQL))
def q6_custom_sql(spark, root):
    return _run(spark, root, CUSTOM)


@_q("q7_rule_set", U.join(FRESH_SQL + VOLUME_SQL + NULLS_SQL + DISTINCT_SQL + OTHER_SQL))
def q7_rule_set(spark, root):
    return _run(spark, root, FRESH + VOLUME + NULLS + DISTINCT + OTHER)


# Rules as a table holds them; some can only fail, and none of them stops another.
_STORED = [
    ("stored_rows", O, "volume", '{"min": 1}'), ("stored_text_time", O, "freshness", '{"column": "o_orderpriority"}'),
    ("stored_number_time", O, "freshness", '{"column": "o_totalprice"}'), ("stored_broken", O, "volume", "{min: "),
    ("stored_divides", O, "custom", '{"sql": "SELECT o_custkey / (o_orderkey - o_orderkey) FROM governed_orders WHERE 1 / (o_orderkey - o_orderkey) > 0"}'),
    ("stored_casts", O, "custom", '{"sql": "SELECT 1 FROM governed_orders WHERE CAST(o_orderpriority AS int) > 0"}'),
    ("stored_unknown", O, "custom", '{"sql": "SELECT * FROM no_such_table"}'),
    ("stored_drop", O, "custom", """{"sql": "SELECT \'--\', 1; DROP TABLE governed_orders"}"""),
    ("stored_ok", O, "custom", '{"sql": "SELECT * FROM governed_orders WHERE o_totalprice < 0"}'),
    ("stored_absent", "wh.db.default.absent", "volume", "{}"),
]


@_q("q7_stored_rules",
    "SELECT 'stored_rows' AS rule_id, 'checked' AS status, count(*) >= 1 AS passed, CAST(count(*) AS DOUBLE) AS observed FROM orders UNION ALL SELECT"
    " 'stored_ok', 'checked', count(*) = 0, CAST(count(*) AS DOUBLE) FROM orders WHERE o_totalprice < 0 UNION ALL SELECT 'stored_broken', 'checked', true,"
    " CAST(count(*) AS DOUBLE) FROM orders UNION ALL SELECT unnest(['stored_text_time', 'stored_number_time', 'stored_divides', 'stored_casts',"
    " 'stored_unknown', 'stored_drop']), 'checked', false, NULL UNION ALL SELECT 'stored_absent', 'skipped', NULL, NULL")
def q7_stored_rules(spark, root):
    orders = load(spark, root, "orders")
    stored = spark.createDataFrame([(*r, True) for r in _STORED] + [("stored_off", O, "volume", "{}", False)],
                                   "id string, table_fqn string, rule_type string, definition string, enabled boolean")
    results = quality.run_rules(spark, {O: orders}, quality.rules_of(stored), AS_OF, views={"governed_orders": orders})
    path = scratch_path(spark, "rule-results")
    sinks.append_rows(results, path)
    return spark.read.parquet(path).select("rule_id", "status", "passed", "observed")


# Definitions with values of another type than their rule wants, with the message of each; and many custom queries that
# name their table by the last part of its name.
_ILL_TYPED = [
    ("ill_ratio", "null_ratio", '{"column": "o_custkey", "threshold": "abc"}', "bad threshold: abc"),
    ("ill_ratio_list", "null_ratio", '{"column": "o_custkey", "threshold": [1]}', "bad threshold: [1]"),
    ("ill_ratio_flag", "null_ratio", '{"column": "o_custkey", "threshold": true}', "bad threshold: True"),
    ("ill_ratio_nan", "null_ratio", '{"column": "o_custkey", "threshold": NaN}', "bad threshold: nan"),
    ("ill_min", "volume", '{"min": "x"}', "bad min: x"),
    ("ill_max", "volume", '{"min": 1, "max": {"n": 2}}', "bad max: {'n': 2}"),
    ("ill_minutes", "freshness", '{"column": "o_orderdate", "threshold_minutes": "soon"}', "bad threshold_minutes: soon"),
    ("ill_column", "freshness", '{"column": ["y"]}', "bad column: ['y']"),
    ("ill_column_number", "distinct", '{"column": 7}', "bad column: 7"),
    ("ill_distinct", "distinct", '{"column": "o_custkey", "min": "many"}', "bad min: many"),
    ("ill_sql", "custom", '{"sql": ["SELECT 1"]}', "bad sql: ['SELECT 1']"),
    ("ill_readings", "custom", '{"sql": "SELECT 1 # \'\\n; DROP TABLE orders # \'"}', "sql: multiple statements detected (2)"),
]
_TYPED = [
    ("typed_min", "volume", '{"min": " 1 ", "max": "1e18"}'), ("typed_huge", "volume", '{"max": 100000000000000000000000}'),
    ("typed_ratio", "null_ratio", '{"column": "o_custkey", "threshold": "0.25"}'),
]
MANY = 20


@_q("q7_ill_typed_rules",
    "SELECT rule_id, false AS passed, CAST(NULL AS DOUBLE) AS observed, message FROM (VALUES "
    + ", ".join("('{}', '{}')".format(r[0], r[3].replace("'", "''")) for r in _ILL_TYPED) + ") ill(rule_id, message)"
    " UNION ALL SELECT 'typed_min', true, CAST(count(*) AS DOUBLE), concat('row_count=', count(*), ' expected 1~1e+18') FROM orders"
    " UNION ALL SELECT 'typed_huge', true, CAST(count(*) AS DOUBLE), concat('row_count=', count(*), ' expected None~1e+23') FROM orders"
    " UNION ALL SELECT 'typed_ratio', true, 0, 'null_ratio=0.000 limit 0.25'"
    f" UNION ALL SELECT concat('many_', i), n = 0, n, concat('custom check returned ', CAST(n AS BIGINT), ' rows') FROM (SELECT i, CAST(count(o_orderkey) AS"
    f" DOUBLE) AS n FROM range({MANY}) r(i) LEFT JOIN orders ON o_custkey % {MANY + 1} = i AND o_totalprice > 200000 GROUP BY i)")
def q7_ill_typed_rules(spark, root):
    rows = [(r[0], O, r[1], r[2], True) for r in _ILL_TYPED + _TYPED]
    rows += [(f"many_{i}", O, "custom", f'{{"sql": "SELECT * FROM orders WHERE o_custkey % {MANY + 1} = {i} AND o_totalprice > 200000 -- part {i}"}}', True)
             for i in range(MANY)]
    stored = spark.createDataFrame(rows, "id string, table_fqn string, rule_type string, definition string, enabled boolean")
    results = quality.run_rules(spark, {O: load(spark, root, "orders")}, quality.rules_of(stored), AS_OF)
    return results.select("rule_id", "passed", "observed", "message")


@_q("q7_rule_summary",
    "SELECT count(*) AS rules_checked, count(*) FILTER (WHERE passed) AS passed, count(*) FILTER (WHERE status = 'checked'"
    " AND NOT coalesce(passed, false)) AS failed FROM (" + U.join(VOLUME_SQL + NULLS_SQL + OTHER_SQL) + ")")
def q7_rule_summary(spark, root):
    return quality.rule_summary(_run(spark, root, VOLUME + NULLS + OTHER))


@_q("v2_user_predicate", CUSTOM_SQL[0].replace("custom_hit", "big_orders"))
def v2_user_predicate(spark, root):
    return _run(spark, root, [Rule("big_orders", O, "custom", CUSTOM[0].definition)])


DAY = "DATE '2024-01-03'"
BASE = (
    f"SELECT table_id, quantile_cont(n, 0.5) AS median_rows, quantile_cont(n, 0.9) AS p90_rows FROM snaps WHERE day < {DAY}"
    f" AND day >= {DAY} - 30 GROUP BY 1"
)
DRIFT = (
    "SELECT t.table_id, 'volume_drift' AS kind, CASE WHEN (t.n - median_rows) / p90_rows > 4 THEN 'high' ELSE 'medium' END AS severity,"
    " round((t.n - median_rows) / p90_rows, 2) AS z_score, t.n AS current_rows"
    f" FROM snaps t JOIN ({BASE}) b USING (table_id) WHERE t.day = {DAY} AND p90_rows > 0 AND abs((t.n - median_rows) / p90_rows) > 2"
)


@_q("a16_history_baseline", oracle(BASE, "snaps"))
def a16_history_baseline(spark, root):
    from veritab.operators.coverage import history_baseline

    return history_baseline(d.snapshots(spark, root), AS_OF)


@_q("q8_volume_drift", oracle(DRIFT, "snaps"))
def q8_volume_drift(spark, root):
    out = anomaly.volume_drift(d.snapshots(spark, root), AS_OF)
    detail = lambda k, t: F.get_json_object("details", f"$.{k}").cast(t).alias(k)
    return out.select("table_id", "kind", "severity", detail("z_score", "double"), detail("current_rows", "bigint"))


NULLSPIKE = (
    "SELECT table_id, 'null_spike' AS kind, CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity"
    " FROM cols WHERE NOT nullable AND null_ratio > 0.10 GROUP BY 1"
)


@_q("q9_null_spike", oracle(
    "WITH bad AS (SELECT * FROM cols WHERE NOT nullable AND null_ratio > 0.10) SELECT table_id, 'null_spike' AS kind,"
    " CASE WHEN count(*) >= 3 THEN 'high' ELSE 'medium' END AS severity,"
    " string_agg(name, ',' ORDER BY ordinal, name) AS listed FROM bad GROUP BY 1", "cols"))
def q9_null_spike(spark, root):
    out = anomaly.null_spike(d.columns(spark, root))
    listed = F.from_json("details", "affected_columns array<struct<column: string, null_ratio: double>>")
    return out.select("table_id", "kind", "severity", F.array_join(listed["affected_columns"]["column"], ",").alias("listed"))


PIIESC = (
    "SELECT table_id, 'pii_escalation' AS kind, 'high' AS severity FROM cols WHERE pii_class <> 'none'"
    f" AND created_s >= {AS_OF_S} - 7 * 86400 GROUP BY 1"
)


@_q("q10_pii_escalation", oracle(
    "SELECT table_id, 'pii_escalation' AS kind, 'high' AS severity, string_agg(concat(name, '=', pii_class), ',' ORDER BY name)"
    " AS listed, count(*) AS n FROM (SELECT * FROM cols WHERE pii_class <> 'none'"
    f" AND created_s >= {AS_OF_S} - 7 * 86400) GROUP BY 1", "cols"))
def q10_pii_escalation(spark, root):
    out = anomaly.pii_escalation(d.columns(spark, root), AS_OF)
    listed = F.from_json("details", "new_pii_columns array<struct<name: string, pii_class: string>>")["new_pii_columns"]
    text = F.array_join(F.transform(listed, lambda c: F.concat(c["name"], F.lit("="), c["pii_class"])), ",")
    return out.select(
        "table_id", "kind", "severity", text.alias("listed"), F.get_json_object("details", "$.n").cast("bigint").alias("n"))


@_q("q10_new_pii_columns", oracle(
    f"SELECT table_id, name, pii_class FROM cols WHERE pii_class <> 'none' AND created_s >= {AS_OF_S} - 7 * 86400", "cols"))
def q10_new_pii_columns(spark, root):
    return anomaly.new_pii_columns(d.columns(spark, root), AS_OF)


GAP = (
    "SELECT id AS table_id, 'owner_gap' AS kind, 'medium' AS severity FROM assets WHERE status = 'active'"
    " AND id NOT IN (SELECT table_id FROM owners WHERE is_verified)"
)


@_q("q11_owner_gap", oracle(GAP, "assets", "owners"))
def q11_owner_gap(spark, root):
    return anomaly.owner_gap(d.assets(spark, root), d.owners(spark, root)).select("table_id", "kind", "severity")


FOUND = (
    f"WITH found AS (SELECT f.* FROM (SELECT table_id, kind, severity FROM ({DRIFT}) UNION ALL {NULLSPIKE} UNION ALL {PIIESC}"
    f" UNION ALL {GAP}) f JOIN assets a ON a.id = f.table_id AND a.status = 'active') "
)
FOUND_VIEWS = ("assets", "cols", "owners", "snaps")


def _found(spark, root):
    cols = d.columns(spark, root)
    return anomaly.detect(d.assets(spark, root), d.snapshots(spark, root), cols, cols, d.owners(spark, root), AS_OF)


@_q("q12_anomalies", oracle(
    FOUND + "SELECT found.table_id, kind, severity, fqn AS table_fqn, CASE WHEN severity = 'high' THEN 0.9 ELSE 0.6 END AS confidence"
    " FROM found JOIN assets ON assets.id = found.table_id", *FOUND_VIEWS))
def q12_anomalies(spark, root):
    return _found(spark, root).select("table_id", "kind", "severity", "table_fqn", "confidence")


@_q("q12_severity_counts", oracle(FOUND + "SELECT kind, severity, count(*) AS n FROM found GROUP BY 1, 2", *FOUND_VIEWS))
def q12_severity_counts(spark, root):
    return anomaly.severity_counts(_found(spark, root))


SCORES = (
    "SELECT a.id AS table_id, greatest(0.0, 100.0 - coalesce(sum(CASE severity WHEN 'high' THEN 25 WHEN 'medium' THEN 10"
    " WHEN 'low' THEN 3 END), 0)) AS health_score FROM assets a LEFT JOIN found f ON f.table_id = a.id GROUP BY 1"
)


@_q("q13_health_scores", oracle(FOUND + SCORES.replace("greatest(", "CAST(greatest(").replace(" AS health_score", " AS DOUBLE) AS health_score"), *FOUND_VIEWS))
def q13_health_scores(spark, root):
    return anomaly.health_scores(d.assets(spark, root), _found(spark, root))


@_q("q13_average_health", oracle(
    FOUND + f"SELECT round(avg(health_score), 1) AS health_score_avg, count(*) AS tables FROM ({SCORES})", *FOUND_VIEWS))
def q13_average_health(spark, root):
    return anomaly.average_health(anomaly.health_scores(d.assets(spark, root), _found(spark, root)))


SINCE, UNTIL = datetime(2001, 7, 1), datetime(2001, 7, 31)
SINCE_S, UNTIL_S = 993945600, 996537600
FAILED = (
    "SELECT r.rule_id, a.fqn AS table_fqn, u.name AS rule, u.severity, r.message, r.created_s FROM results r JOIN rules u"
    " USING (rule_id) JOIN assets a ON a.id = u.table_id WHERE NOT r.passed"
)


@_q("j12_failed_results", oracle(f"{FAILED} AND r.created_s BETWEEN {SINCE_S} AND {UNTIL_S}", "results", "rules", "assets"))
def j12_failed_results(spark, root):
    out = lineage.failed_results(d.results(spark, root), d.rules(spark, root), d.assets(spark, root), SINCE, UNTIL)
    return out.select("rule_id", "table_fqn", "rule", "severity", "message", F.unix_timestamp("created_at").alias("created_s"))


@_q("q14_digest", oracle(
    f"WITH failed AS ({FAILED} AND r.created_s >= {SINCE_S}),"
    f" act AS (SELECT * FROM assets WHERE status = 'active')"
    " SELECT 'quality_failed' AS kind, severity, 1 AS n, concat_ws(' | ', table_fqn, rule, message) AS sample FROM failed"
    " UNION ALL SELECT 'quality_failed_total', 'warning', count(*), '' FROM failed HAVING count(*) > 0"
    " UNION ALL SELECT 'pending_suggestions', 'info', count(*), strftime(make_timestamp(min(created_s) * 1000000), '%Y-%m-%d %H:%M:%S') FROM sugg"
    f" WHERE status = 'pending' AND created_s >= {UNTIL_S} - 30 * 86400 HAVING count(*) > 0"
    " UNION ALL SELECT 'critical_no_description', 'warning', (SELECT count(*) FROM act WHERE tier = 'critical' AND description IS NULL),"
    " (SELECT string_agg(fqn, ', ' ORDER BY fqn) FROM (SELECT fqn FROM act WHERE tier = 'critical' AND description IS NULL ORDER BY fqn LIMIT 5))"
    " UNION ALL SELECT 'low_health', 'warning', (SELECT count(*) FROM act WHERE health_score < 60),"
    " (SELECT string_agg(concat(fqn, '=', health_score), ', ' ORDER BY fqn) FROM (SELECT * FROM act WHERE health_score < 60 ORDER BY fqn LIMIT 5))",
    "results", "rules", "assets", "sugg"))
def q14_digest(spark, root):
    a = d.assets(spark, root)
    failed = lineage.failed_results(d.results(spark, root), d.rules(spark, root), a, SINCE)
    return anomaly.digest(failed, d.suggestions(spark, root), a, UNTIL, days=30)
