"""Listings, search, counts and coverage over the derived catalog."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import names
from veritab.operators import coverage, evaluation, feedback, lineage, listing
from veritab.plans import derived as d
from veritab.plans.derived import oracle
from veritab.plans.registry import QUERIES


def _q(name, sql=None):
    return QUERIES.operator(name, group="listing", oracle=sql)


@_q("f1_find_assets", oracle(
    "SELECT id, fqn, tier FROM assets WHERE (lower(name) LIKE '%ring%' OR lower(fqn) LIKE '%ring%') AND tier = 'important'"
    " ORDER BY fqn LIMIT 50 OFFSET 10", "assets"))
def f1_find_assets(spark, root):
    found = listing.find_assets(d.assets(spark, root), "RING", "important")
    return listing.page(found, [F.col("fqn")], 50, 10).select("id", "fqn", "tier")


@_q("f1_total", oracle("SELECT count(*) AS total FROM assets WHERE lower(fqn) LIKE '%ring%' AND fqn LIKE 'shop-brand2.%'", "assets"))
def f1_total(spark, root):
    return listing.total(listing.find_assets(d.assets(spark, root), "ring", service="shop-brand2"))


@_q("f2_asset_columns", oracle(
    "SELECT name, ordinal, data_type, pii_class FROM cols WHERE table_id = 7 AND pii_class <> 'none' ORDER BY ordinal", "cols"))
def f2_asset_columns(spark, root):
    return listing.asset_columns(d.columns(spark, root), 7, True).select("name", "ordinal", "data_type", "pii_class")


@_q("f3_find_edges", oracle(
    "SELECT e.id, u.fqn AS upstream_fqn, v.fqn AS downstream_fqn, e.created_s FROM edges e LEFT JOIN assets u ON u.id = e.upstream_id"
    " LEFT JOIN assets v ON v.id = e.downstream_id WHERE e.description IS NOT NULL AND component = 'dbt_model' AND pipeline_stage = 3"
    " ORDER BY e.created_s DESC, e.id LIMIT 100", "edges", "assets"))
def f3_find_edges(spark, root):
    a = d.assets(spark, root)
    found = listing.find_edges(d.edges(spark, root), a, True, "dbt_model", 3)
    top = listing.page(found, [F.desc("created_at"), F.asc("id")], 100)
    return listing.with_fqns(top, a).select("id", "upstream_fqn", "downstream_fqn", "created_s")


@_q("f4_find_suggestions", oracle(
    "SELECT id, confidence, created_s FROM sugg WHERE status = 'pending' AND suggestion_type = 'owner' AND target_type = 'table'"
    " ORDER BY confidence DESC, created_s DESC, id LIMIT 50", "sugg"))
def f4_find_suggestions(spark, root):
    found = listing.find_suggestions(d.suggestions(spark, root), "pending", "owner", "table")
    return listing.page(found, listing.suggestion_order(), 50).select(
        "id", "confidence", F.unix_timestamp("created_at").alias("created_s"))


@_q("f5_find_rules", oracle(
    "SELECT rule_id, table_id, severity FROM rules WHERE rule_type = 'volume' AND is_enabled ORDER BY created_s DESC LIMIT 50", "rules"))
def f5_find_rules(spark, root):
    found = listing.find_rules(d.rules(spark, root), rule_type="volume", enabled=True)
    return listing.page(found, [F.desc("created_at")], 50).select("rule_id", "table_id", "severity")


@_q("f6_run_events", oracle(
    "SELECT event_type, job_name, run_id, event_s FROM runs WHERE job_namespace = 'ns_1' AND event_type <> 'OOPS' AND run_id IS NOT NULL"
    " ORDER BY event_s DESC, run_id LIMIT 50", "runs"))
def f6_run_events(spark, root):
    from veritab.streaming.run_events import checked

    ok = checked(d.run_events(spark, root)).filter(F.col("reason") == "")
    found = listing.find_run_events(ok, namespace="ns_1")
    return listing.page(found, [F.desc("event_time"), F.asc("run_id")], 50).select(
        "event_type", "job_name", "run_id", F.unix_timestamp("event_time").alias("event_s"))


@_q("f7_find_owners", oracle(
    "SELECT o.id, team, user_email, fqn AS table_fqn FROM owners o LEFT JOIN assets a ON a.id = o.table_id WHERE team = 'data-shop'"
    " AND role = 'owner' AND is_verified ORDER BY team, user_email, o.id", "owners", "assets"))
def f7_find_owners(spark, root):
    found = listing.find_owners(d.owners(spark, root), d.assets(spark, root), "data-shop", "owner", True)
    return found.orderBy("team", "user_email", "id").select("id", "team", "user_email", "table_fqn")


@_q("f8_tags", oracle(
    "SELECT t.id, category, count(a.table_id) AS asset_count FROM tags t LEFT JOIN asset_tags a ON a.tag_id = t.id"
    " WHERE category = 'domain' AND name LIKE '%brand%' GROUP BY 1, 2", "tags", "asset_tags"))
def f8_tags(spark, root):
    found = listing.find_tags(d.tags(spark, root), "domain", "Brand")
    return listing.with_binding_counts(found, d.asset_tags(spark, root), "tag_id").orderBy("category", "name").select(
        "id", "category", "asset_count")


@_q("f8_terms", oracle(
    "SELECT t.id, domain, count(a.table_id) AS asset_count FROM terms t LEFT JOIN asset_terms a ON a.term_id = t.id"
    " WHERE lower(definition) LIKE '%as r%' OR lower(name) LIKE '%as r%' GROUP BY 1, 2", "terms", "asset_terms"))
def f8_terms(spark, root):
    found = listing.find_terms(d.terms(spark, root), q="as R")
    return listing.with_binding_counts(found, d.asset_terms(spark, root), "term_id").select("id", "domain", "asset_count")


@_q("f9_lowest_health", oracle(
    "SELECT id, fqn, health_score FROM assets WHERE health_score < 70 ORDER BY health_score, id LIMIT 20", "assets"))
def f9_lowest_health(spark, root):
    low = listing.lowest_health(d.assets(spark, root))
    return listing.page(low, [F.col("health_score"), F.col("id")], 20).select("id", "fqn", "health_score")


@_q("f10_feedback", oracle(
    "SELECT seq, case_key FROM fb WHERE skill = 'view' AND NOT accepted AND (lower(skill) LIKE '%7%' OR lower(case_key) LIKE '%7%')", "fb"))
def f10_feedback(spark, root):
    return listing.find_feedback(d.feedback(spark, root), "view", False, "7").select("seq", "case_key")


@_q("f11_glob_filter", oracle(
    "SELECT id, name FROM assets WHERE (regexp_matches(name, '^(stg|dim)_.*$') OR regexp_matches(name, '^f.t_[a-h].*$'))"
    " AND NOT regexp_matches(name, '^.*_ring$')", "assets"))
def f11_glob_filter(spark, root):
    keep = names.glob_match(F.col("name"), ["stg_*", "dim_*", "f?t_[a-h]*"], ["*_ring"])
    return d.assets(spark, root).filter(keep).select("id", "name")


def _score(text):
    return f"CASE WHEN lower({text}) = 'ring' THEN 1.0 WHEN lower({text}) LIKE 'ring%' THEN 0.9 WHEN lower({text}) LIKE '%ring%' THEN 0.6 ELSE 0.0 END"


_UC = (
    "SELECT CASE WHEN c_custkey % 5 = 0 THEN concat('file_', c_custkey) ELSE concat('uc-', c_custkey) END AS id,"
    " c_custkey % 3 + 1 AS version, lower(c_mktsegment) AS description, concat('own', c_nationkey) AS owner,"
    " c_custkey % 4 + 1 AS sources_count, 2 AS analysis_count FROM customer"
)
SEARCH = (
    "SELECT * FROM ("
    "(SELECT 'asset' AS kind, CAST(id AS VARCHAR) AS id, fqn AS title, " + _score("fqn") + " AS score FROM assets WHERE lower(fqn) LIKE '%ring%'"
    " OR lower(name) LIKE '%ring%' OR lower(description) LIKE '%ring%' ORDER BY 4 DESC, fqn LIMIT 10)"
    " UNION ALL (SELECT 'owner', CAST(id AS VARCHAR), coalesce(user_name, user_email), " + _score("user_email")
    + " FROM owners WHERE lower(user_email) LIKE '%ring%' OR lower(user_name) LIKE '%ring%' OR lower(team) LIKE '%ring%' ORDER BY 4 DESC, owners.id LIMIT 10)"
    " UNION ALL (SELECT 'tag', id, name, " + _score("name") + " FROM tags WHERE lower(name) LIKE '%ring%' OR lower(description) LIKE '%ring%' ORDER BY 4 DESC, id LIMIT 10)"
    " UNION ALL (SELECT 'glossary', id, name, " + _score("name") + " FROM terms WHERE lower(name) LIKE '%ring%' OR lower(definition) LIKE '%ring%' ORDER BY 4 DESC, id LIMIT 10)"
    " UNION ALL (SELECT 'suggestion', CAST(id AS VARCHAR), concat(suggestion_type, ' (', skill, ')'), " + _score("concat(skill, ' ', suggestion_type)")
    + " FROM sugg WHERE lower(skill) LIKE '%ring%' OR lower(suggestion_type) LIKE '%ring%' OR CAST(target_id AS VARCHAR) LIKE '%ring%'"
    " ORDER BY 4 DESC, created_s DESC, sugg.id LIMIT 10)"
    f" UNION ALL (SELECT 'use_case', id, id, {_score('concat_ws(chr(32), id, description, owner)')} FROM ({_UC})"
    " WHERE lower(concat_ws(' ', id, description, owner)) LIKE '%ring%' ORDER BY 4 DESC, id LIMIT 10)) ORDER BY score DESC, kind, id LIMIT 40"
)


def _search(spark, root, q, limit):
    return listing.search(
        q, limit, d.assets(spark, root), d.owners(spark, root), d.tags(spark, root), d.terms(spark, root),
        d.suggestions(spark, root), listing.use_cases(d.descriptors(spark, root)),
    )


_VIEWS6 = ("assets", "owners", "tags", "terms", "sugg")


@_q("f12_search", oracle(SEARCH, *_VIEWS6))
def f12_search(spark, root):
    return _search(spark, root, "ring", 40)


@_q("u2_search_kinds", oracle(f"SELECT kind, count(*) AS n FROM ({SEARCH}) GROUP BY 1", *_VIEWS6))
def u2_search_kinds(spark, root):
    return _search(spark, root, "ring", 40).groupBy("kind").agg(F.count("*").alias("n"))


@_q("x12_search_score", oracle(f"SELECT id, {_score('name')} AS name_score, {_score('description')} AS text_score FROM assets", "assets"))
def x12_search_score(spark, root):
    return d.assets(spark, root).select(
        "id", names.search_score(F.col("name"), "Ring").alias("name_score"),
        names.search_score(F.col("description"), "Ring").alias("text_score"))


@_q("f13_needs_pii_class", oracle(
    "SELECT id, name FROM cols WHERE (pii_class = 'none' OR pii_confidence < 0.5) AND name IN ('s4_email', 's5_phone', 's7_url')", "cols"))
def f13_needs_pii_class(spark, root):
    return listing.needs_pii_class(d.columns(spark, root), names=["s4_email", "s5_phone", "s7_url"]).select("id", "name")


@_q("f14_missing", oracle(
    "SELECT 'table' AS entity, CAST(id AS VARCHAR) AS id FROM assets WHERE description IS NULL UNION ALL SELECT 'edge', id FROM edges"
    " WHERE description IS NULL UNION ALL SELECT 'profile', CAST(id AS VARCHAR) FROM assets WHERE status = 'active' AND profiled_s IS NULL",
    "assets", "edges"))
def f14_missing(spark, root):
    a = d.assets(spark, root)
    part = lambda df, e: df.select(F.lit(e).alias("entity"), F.col("id").cast("string").alias("id"))
    return (
        part(listing.without_description(a), "table")
        .unionByName(part(listing.without_description(d.edges(spark, root)), "edge"))
        .unionByName(part(listing.never_profiled(a), "profile"))
    )


@_q("f15_use_cases",
    f"SELECT * FROM ({_UC}) WHERE lower(concat_ws(' ', id, description, owner)) LIKE '%build%'")
def f15_use_cases(spark, root):
    out = listing.use_cases(d.descriptors(spark, root), "BUILD")
    return out.select("id", "version", "description", F.array_join("owners", ",").alias("owner"), "sources_count", "analysis_count")


@_q("a1_column_edge_stats", oracle(
    "SELECT 'transform_type' AS metric, transform_type AS key, count(*) AS n FROM cedges GROUP BY 2 UNION ALL"
    " SELECT 'component', component, count(*) FROM cedges GROUP BY 2 UNION ALL SELECT 'edges', 'all', count(*) FROM cedges UNION ALL"
    " SELECT 'tables_with_lineage', 'all', count(DISTINCT downstream_id) FROM cedges UNION ALL SELECT 'tables', 'all', count(*) FROM assets",
    "cedges", "assets"))
def a1_column_edge_stats(spark, root):
    return coverage.column_edge_stats(d.column_edges(spark, root), d.assets(spark, root))


MATRIX = (
    "WITH up AS (SELECT downstream_column_id AS id, count(*) AS n FROM cedges GROUP BY 1),"
    " down AS (SELECT upstream_column_id AS id, count(*) AS n FROM cedges GROUP BY 1),"
    " per AS (SELECT table_id, count(*) AS n, count(*) FILTER (WHERE up.n IS NOT NULL OR down.n IS NOT NULL) AS w FROM cols"
    " LEFT JOIN up ON up.id = cols.id LEFT JOIN down ON down.id = cols.id GROUP BY 1),"
    " te AS (SELECT t, count(*) AS n FROM (SELECT upstream_id AS t FROM edges UNION ALL SELECT downstream_id FROM edges) GROUP BY 1),"
    " matrix AS (SELECT a.id AS table_id, fqn AS table_fqn, tier, coalesce(per.n, 0) AS n_columns, CASE WHEN te.n IS NULL THEN"
    " coalesce(per.n, 0) ELSE coalesce(w, 0) END AS n_columns_with_lineage, CASE WHEN te.n IS NULL THEN 100.0 WHEN per.n > 0 THEN"
    " round(CAST(w AS DOUBLE) / per.n * 100, 1) ELSE 0.0 END AS coverage_pct, coalesce(te.n, 0) AS n_table_edges"
    " FROM assets a LEFT JOIN per ON per.table_id = a.id LEFT JOIN te ON te.t = a.id) "
)
_MV = ("assets", "cols", "edges", "cedges")


def _matrix(spark, root):
    return coverage.coverage_matrix(
        d.assets(spark, root), d.columns(spark, root), d.edges(spark, root), d.column_edges(spark, root))


@_q("a2_coverage_matrix", oracle(MATRIX + "SELECT * FROM matrix", *_MV))
def a2_coverage_matrix(spark, root):
    return _matrix(spark, root).orderBy("coverage_pct", "table_id")


@_q("a2_coverage_totals", oracle(
    MATRIX + "SELECT count(*) AS total_tables, sum(n_columns) AS total_columns, sum(n_columns_with_lineage) AS"
    " total_columns_with_lineage, count(*) FILTER (WHERE coverage_pct = 0) AS tables_at_zero,"
    " round(sum(n_columns_with_lineage) / sum(n_columns) * 100, 1) AS overall_coverage_pct FROM matrix", *_MV))
def a2_coverage_totals(spark, root):
    return coverage.coverage_totals(_matrix(spark, root))


def _cov(entity, table, origin):
    ai = "count(*) FILTER (WHERE description_source = 'ai_inferred')" if origin else "0"
    hand = "count(*) FILTER (WHERE description_source = 'manual')" if origin else "0"
    return (
        f"SELECT '{entity}' AS entity, count(*) AS total, count(description) AS described, {ai} AS ai, {hand} AS manual,"
        f" round(100 * count(description) / count(*), 2) AS pct FROM {table}"
    )


@_q("a3_description_coverage", oracle(
    " UNION ALL ".join([_cov("table", "assets", 1), _cov("column", "cols", 1), _cov("table_edge", "edges", 0), _cov("column_edge", "cedges", 0)]),
    *_MV))
def a3_description_coverage(spark, root):
    return coverage.description_coverage(
        d.assets(spark, root), d.columns(spark, root), d.edges(spark, root), d.column_edges(spark, root))


@_q("a4_pii_summary", oracle(
    "SELECT table_id, count(*) AS pii_columns, count(*) FILTER (WHERE pii_class IN ('email', 'phone', 'address')) AS high_risk_columns"
    " FROM cols WHERE pii_class <> 'none' GROUP BY 1", "cols"))
def a4_pii_summary(spark, root):
    return coverage.pii_summary(d.columns(spark, root))


@_q("a4_pii_class_counts", oracle("SELECT table_id, pii_class, count(*) AS n FROM cols WHERE pii_class <> 'none' GROUP BY 1, 2", "cols"))
def a4_pii_class_counts(spark, root):
    return coverage.pii_class_counts(d.columns(spark, root))


def _top_pii(k):
    return (
        "SELECT table_id, name AS column_name, pii_class, pii_confidence AS confidence, rank FROM (SELECT *, row_number() OVER"
        f" (PARTITION BY table_id ORDER BY pii_confidence DESC, ordinal) AS rank FROM cols WHERE pii_class <> 'none') WHERE rank <= {k}"
    )


@_q("a4_top_pii_columns", oracle(_top_pii(20), "cols"))
def a4_top_pii_columns(spark, root):
    return coverage.top_pii_columns(d.columns(spark, root))


@_q("w5_top_three", oracle(_top_pii(3), "cols"))
def w5_top_three(spark, root):
    return coverage.top_pii_columns(d.columns(spark, root), 3)


@_q("a5_quality_dashboard", oracle(
    "SELECT round(avg(health_score), 1) AS avg_health_score, count(*) AS tables_total, count(*) FILTER (WHERE health_score < 70) AS tables_low,"
    " count(*) FILTER (WHERE health_score < 40) AS tables_critical, max(health_s) AS last_run_s, (SELECT count(*) FROM rules) AS rules_total,"
    " (SELECT count(*) FROM (SELECT rule_id, arg_max(passed, created_s * 2 + passed::int) AS p FROM results GROUP BY 1) WHERE NOT p) AS rules_failing,"
    " (SELECT count(*) FROM sugg WHERE suggestion_type = 'insight' AND status = 'pending') AS pending_anomalies,"
    " (SELECT count(*) FROM sugg WHERE suggestion_type = 'insight' AND severity = 'critical') AS critical_anomalies FROM assets",
    "assets", "rules", "results", "sugg"))
def a5_quality_dashboard(spark, root):
    out = coverage.quality_dashboard(
        d.assets(spark, root), d.rules(spark, root), d.results(spark, root), d.suggestions(spark, root))
    return out.withColumn("last_run_s", F.unix_timestamp("last_run")).drop("last_run")


@_q("a5_newest_insights", oracle(
    "SELECT id, status, confidence FROM sugg WHERE suggestion_type = 'insight' ORDER BY created_s DESC, id LIMIT 20", "sugg"))
def a5_newest_insights(spark, root):
    return coverage.newest_insights(d.suggestions(spark, root)).select("id", "status", "confidence")


@_q("a6_count_by", oracle("SELECT coalesce(team, 'unknown') AS team, source, count(*) AS n FROM owners GROUP BY 1, 2", "owners"))
def a6_count_by(spark, root):
    return coverage.count_by(d.owners(spark, root), "team", "source")


@_q("a7_assets_by_tier", oracle("SELECT tier, count(*) AS n FROM assets GROUP BY 1", "assets"))
def a7_assets_by_tier(spark, root):
    return coverage.count_by(d.assets(spark, root), "tier")


@_q("a8_owner_summary", oracle(
    "SELECT coalesce(team, 'unknown') AS team, count(*) AS total, count(*) FILTER (WHERE is_verified) AS verified,"
    " count(*) FILTER (WHERE NOT is_verified) AS unverified FROM owners GROUP BY 1", "owners"))
def a8_owner_summary(spark, root):
    return coverage.owner_summary(d.owners(spark, root))


@_q("a9_tag_summary", oracle(
    "SELECT category, count(*) AS tags, sum(n) AS bindings FROM (SELECT t.id, category, count(a.table_id) AS n FROM tags t"
    " LEFT JOIN asset_tags a ON a.tag_id = t.id GROUP BY 1, 2) GROUP BY 1", "tags", "asset_tags"))
def a9_tag_summary(spark, root):
    return coverage.tag_summary(listing.with_binding_counts(d.tags(spark, root), d.asset_tags(spark, root), "tag_id"))


@_q("a9_term_summary", oracle(
    "SELECT upper(substring(id, 1, 1)) AS letter, count(*) AS terms, count(DISTINCT domain) AS domains, sum(n) AS bindings FROM"
    " (SELECT t.id, domain, count(a.table_id) AS n FROM terms t LEFT JOIN asset_terms a ON a.term_id = t.id GROUP BY 1, 2) GROUP BY 1",
    "terms", "asset_terms"))
def a9_term_summary(spark, root):
    return coverage.term_summary(listing.with_binding_counts(d.terms(spark, root), d.asset_terms(spark, root), "term_id"))


@_q("a10_acceptance", oracle(
    "SELECT skill, count(*) AS total, count(*) FILTER (WHERE accepted) AS accepted, count(*) FILTER (WHERE NOT accepted) AS rejected,"
    " CAST(floor(100.0 * count(*) FILTER (WHERE accepted) / count(*) + 0.5) AS INT) AS rate FROM fb GROUP BY 1", "fb"))
def a10_acceptance(spark, root):
    return coverage.acceptance(d.feedback(spark, root))


@_q("a15_rescan_totals", oracle("SELECT asset_subtype, count(*) AS n FROM assets GROUP BY 1", "assets"))
def a15_rescan_totals(spark, root):
    return coverage.count_by(d.assets(spark, root), "asset_subtype")


@_q("j9_unowned", oracle("SELECT id FROM assets WHERE id NOT IN (SELECT table_id FROM owners WHERE is_verified)", "assets", "owners"))
def j9_unowned(spark, root):
    return lineage.unowned(d.assets(spark, root), d.owners(spark, root)).select("id")


@_q("j10_with_any_edge", oracle(
    "SELECT id FROM assets WHERE id IN (SELECT upstream_id FROM edges UNION SELECT downstream_id FROM edges)", "assets", "edges"))
def j10_with_any_edge(spark, root):
    return lineage.with_any_edge(d.assets(spark, root), d.edges(spark, root)).select("id")


@_q("j14_tags_and_terms", oracle(
    "SELECT table_id, 'tag' AS kind, name FROM asset_tags JOIN tags ON tags.id = tag_id UNION ALL"
    " SELECT table_id, 'term', name FROM asset_terms JOIN terms ON terms.id = term_id", "asset_tags", "tags", "asset_terms", "terms"))
def j14_tags_and_terms(spark, root):
    tagged = listing.bound_items(d.asset_tags(spark, root), d.tags(spark, root), "tag_id")
    named = listing.bound_items(d.asset_terms(spark, root), d.terms(spark, root), "term_id")
    return tagged.select("table_id", F.lit("tag").alias("kind"), "name").unionByName(
        named.select("table_id", F.lit("term").alias("kind"), "name"))


@_q("w2_latest_accepted", oracle(
    "SELECT skill, case_key, count(*) AS n, arg_max(pred, seq) AS pred FROM fb WHERE accepted GROUP BY 1, 2", "fb"))
def w2_latest_accepted(spark, root):
    return feedback.latest(d.feedback(spark, root), True, 1).select("skill", "case_key", "n", "pred")


@_q("w2_latest_rejected", oracle(
    "SELECT skill, case_key, count(*) AS n, arg_max(pred, seq) AS pred FROM fb WHERE NOT accepted GROUP BY 1, 2 HAVING count(*) >= 2", "fb"))
def w2_latest_rejected(spark, root):
    return feedback.latest(d.feedback(spark, root), False, 2).select("skill", "case_key", "n", "pred")


SHOTS = (
    "SELECT skill, case_key, expected, weight, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY skill ORDER BY weight DESC,"
    " first_seq) AS rank FROM (SELECT skill, case_key, min(seq) AS first_seq, coalesce(arg_max(struct_pack(v := new_payload), seq).v, arg_max(pred, seq)) AS"
    " expected, 100 AS weight, 'feedback_accept' AS source FROM fb WHERE accepted GROUP BY 1, 2 UNION ALL SELECT * FROM (SELECT skill,"
    " case_key, min(seq) AS first_seq, arg_max(struct_pack(v := new_payload), seq).v AS expected, 70 AS weight, 'feedback_reject_corrected' AS source"
    " FROM fb WHERE NOT accepted GROUP BY 1, 2 HAVING count(*) >= 2) WHERE expected IS NOT NULL)) WHERE rank <= {k}"
)


@_q("w3_few_shots", oracle(SHOTS.format(k=5), "fb"))
def w3_few_shots(spark, root):
    return feedback.few_shots(d.feedback(spark, root)).drop("note")


@_q("w3_many_shots", oracle(SHOTS.format(k=1000), "fb"))
def w3_many_shots(spark, root):
    return feedback.few_shots(d.feedback(spark, root), k=1000).drop("note")


@_q("w4_first_by_short_name", oracle("SELECT name AS short_name, min(id) AS id, arg_min(fqn, id) AS fqn FROM assets GROUP BY 1", "assets"))
def w4_first_by_short_name(spark, root):
    return lineage.first_by_short_name(d.assets(spark, root))


# Evaluation ------------------------------------------------------------------

_HITS = "(contains(lower(text), 'the')::int + contains(lower(text), 'inh')::int + contains(lower(text), lang)::int)"
_MUST = "(contains(lower(text), 'an')::int + contains(lower(text), 'the ')::int)"
_FORBID = "(contains(lower(text), 'reating')::int + contains(lower(text), 'ouen')::int)"
_NEED = "len(list_distinct(['en', 'src1', lang]))"
_MET = "len(list_filter(list_distinct(['en', 'src1', lang]), lambda x: x IN (source, lang)))"
SCORED = (
    "WITH scored AS (SELECT CAST(doc_id AS VARCHAR) AS id, concat('skill_', lang) AS skill, n_chars AS latency_ms,"
    " (['exact', 'contains', 'list_contains', 'fqn_match', 'guard_match', 'freeform'])[doc_id % 6 + 1] AS kind,"
    f" greatest(0.0, least(1.0, CASE doc_id % 6 WHEN 0 THEN (CASE WHEN n_chars % 2 = 0 THEN 1.0 ELSE 0.0 END)"
    f" WHEN 1 THEN CAST({_HITS} AS DOUBLE) / 3 * (CASE WHEN length(text) > 1000 THEN CAST(0.8 AS DOUBLE) ELSE 1.0 END)"
    f" WHEN 2 THEN CAST(0.5 AS DOUBLE) + CAST(0.5 AS DOUBLE) * ({_MUST} / 2) - CAST(0.5 AS DOUBLE) * {_FORBID}"
    f" WHEN 4 THEN CAST({_MET} AS DOUBLE) / {_NEED} ELSE CAST(0.6 AS DOUBLE) END)) AS score,"
    f" (CASE doc_id % 6 WHEN 0 THEN (n_chars % 2)::int WHEN 1 THEN ({_HITS} < 3)::int + (length(text) > 1000)::int"
    f" WHEN 2 THEN ({_MUST} < 2)::int + ({_FORBID} > 0)::int WHEN 4 THEN ({_MET} < {_NEED})::int ELSE 1 END) AS n_issues FROM documents) "
)


def _scored(spark, root):
    return evaluation.score_cases(d.eval_cases(spark, root))


@_q("e1_expected_kind", "SELECT CAST(doc_id AS VARCHAR) AS id, (['exact', 'contains', 'list_contains', 'fqn_match', 'guard_match',"
    " 'freeform'])[doc_id % 6 + 1] AS kind FROM documents")
def e1_expected_kind(spark, root):
    return d.eval_cases(spark, root).select("id", evaluation.expected_kind(F.col("gold")).alias("kind"))


@_q("e2_scores", SCORED + "SELECT id, kind, round(score, 6) AS score, n_issues FROM scored")
def e2_scores(spark, root):
    return _scored(spark, root).select("id", "kind", F.round("score", 6).alias("score"), F.size("issues").alias("n_issues"))


REPORT = (
    "SELECT skill, count(*) AS total, count(*) FILTER (WHERE score >= 0.7) AS passed, round(avg(score), 4) AS avg_score,"
    " list_sort(list(latency_ms))[count(*) // 2 + 1] AS p50_latency FROM scored GROUP BY 1"
)


@_q("a12_report", SCORED + REPORT)
def a12_report(spark, root):
    return evaluation.report(_scored(spark, root))


@_q("a13_issue_patterns",
    "WITH heads AS (SELECT unnest(list_filter([CASE WHEN doc_id % 6 = 0 AND n_chars % 2 = 1 THEN 'exact mismatch' END,"
    f" CASE WHEN doc_id % 6 = 1 AND {_HITS} < 3 THEN 'missing keywords' END,"
    " CASE WHEN doc_id % 6 = 1 AND length(text) > 1000 THEN '可能超过 max_length=500' END,"
    f" CASE WHEN doc_id % 6 = 2 AND {_MUST} < 2 THEN 'missing' END, CASE WHEN doc_id % 6 = 2 AND {_FORBID} > 0 THEN 'forbidden keyword hit' END,"
    f" CASE WHEN doc_id % 6 = 4 AND {_MET} < {_NEED} THEN 'guards not passed' END,"
    " CASE WHEN doc_id % 6 IN (3, 5) THEN 'freeform gold; 规则打分 0.6 (建议配 judge)' END], lambda x: x IS NOT NULL)) AS pattern FROM documents)"
    " SELECT pattern, count(*) AS n FROM heads GROUP BY 1 ORDER BY n DESC, pattern LIMIT 5")
def a13_issue_patterns(spark, root):
    return evaluation.issue_patterns(_scored(spark, root))


@_q("e3_gate", SCORED.rstrip() + f", rep AS ({REPORT}) SELECT skill, len(r) = 0 AS passed, CASE WHEN len(r) = 0 THEN 'OK' ELSE array_to_string(r, '; ') END"
    " AS reason, report_avg, baseline_avg, report_pass_rate FROM (SELECT skill, avg_score AS report_avg, base AS baseline_avg,"
    " round(passed / total, 4) AS report_pass_rate, list_filter([CASE WHEN avg_score < 0.7 THEN printf('avg_score %.3f < min_avg_score 0.700', avg_score) END,"
    " CASE WHEN passed / total < 0.7 THEN printf('pass_rate %.2f%% < min_pass_rate 70.00%%', passed / total * 100) END,"
    " CASE WHEN avg_score - base < -0.05 THEN printf('regress %+.3f < -0.050 (vs baseline %.3f)', avg_score - base, base) END], lambda x: x IS NOT NULL) AS r"
    " FROM (SELECT *, CASE WHEN skill = 'skill_en' THEN avg_score + 0.1 ELSE avg_score END AS base FROM rep))")
def e3_gate(spark, root):
    rep = evaluation.report(_scored(spark, root))
    base = rep.withColumn(
        "avg_score", F.when(F.col("skill") == "skill_en", F.col("avg_score") + 0.1).otherwise(F.col("avg_score")))
    return evaluation.gate(rep, base)
