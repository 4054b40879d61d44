"""Edge building, similar names, glossary matches and graph walks."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from veritab.functions import describe, documents
from veritab.operators import assembly, coverage, graph, lineage, listing
from veritab.plans import derived as d
from veritab.plans.derived import AS_OF, oracle
from veritab.plans.q_sources import _MODEL_EDGES, _bi, _jobs, _models, _tasks, _warehouse
from veritab.plans.registry import QUERIES
from veritab.session import materialize
from veritab.sources import exports


def _q(name, sql=None):
    return QUERIES.operator(name, group="lineage", oracle=sql)


MATCHED = (
    "SELECT e.upstream_id, e.downstream_id, u.id AS upstream_column_id, c.id AS downstream_column_id, u.name AS upstream_col,"
    " coalesce(e.job_id, 'lineage_to_column') AS job_id, coalesce(e.component, 'lineage_to_column') AS component, 0.7 AS confidence,"
    " concat('原样透传 ', u.name, ' (', u.data_type, ')') AS description FROM edges e JOIN cols u ON u.table_id = e.upstream_id"
    " JOIN cols c ON c.table_id = e.downstream_id AND c.name = u.name WHERE e.sql IS NULL"
)
_MATCH_COLS = ["upstream_id", "downstream_id", "upstream_column_id", "downstream_column_id", "upstream_col", "job_id", "component",
               "confidence", "description"]


@_q("j2_name_match_edges", oracle(MATCHED, "edges", "cols"))
def j2_name_match_edges(spark, root):
    return lineage.name_match_edges(d.edges(spark, root), d.columns(spark, root)).select(*_MATCH_COLS)


@_q("j3_drop_outranked", oracle(
    f"SELECT m.upstream_column_id, m.downstream_column_id, m.job_id FROM ({MATCHED}) m WHERE NOT EXISTS (SELECT 1 FROM cedges x WHERE"
    " x.upstream_column_id = m.upstream_column_id AND x.downstream_column_id = m.downstream_column_id AND x.confidence > 0.7)",
    "edges", "cols", "cedges"))
def j3_drop_outranked(spark, root):
    found = lineage.name_match_edges(d.edges(spark, root), d.columns(spark, root))
    out = lineage.drop_outranked(found, d.column_edges(spark, root))
    return out.select("upstream_column_id", "downstream_column_id", "job_id")


_GROUPS = (
    "WITH toks AS (SELECT id, fqn, list_sort(list_distinct(regexp_extract_all(regexp_replace(lower(name), '^(stg|ods|dwd|dws|ads|fct|dim)_', ''),"
    " '[a-z0-9]{3,}'))) AS tokens, split_part(lower(name), '_', 1) AS layer FROM assets),"
    " g AS (SELECT tokens, layer, count(*) AS members FROM toks WHERE len(tokens) > 0 GROUP BY 1, 2),"
    " pairs AS (SELECT a.tokens AS lt, a.layer AS ll, b.tokens AS rt, b.layer AS rl, a.members AS lm, b.members AS rm,"
    " len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens))) AS sim,"
    " CASE WHEN a.tokens = b.tokens AND a.layer = b.layer THEN a.members * (a.members - 1) // 2 ELSE a.members * b.members END AS n"
    " FROM g a JOIN g b ON a.tokens < b.tokens OR (a.tokens = b.tokens AND a.layer <= b.layer)) "
)
_DIRECTION = (
    "CASE WHEN {a} IN ('stg', 'ods', 'src', 'raw') AND {b} IN ('fct', 'dim', 'dwd', 'dws', 'ads', 'mart') THEN 'forward' WHEN {a} IN"
    " ('fct', 'dim', 'dwd', 'dws', 'ads', 'mart') AND {b} IN ('stg', 'ods', 'src', 'raw') THEN 'backward' ELSE 'input_order' END"
)


@_q("j7_similar_name_groups", oracle(
    _GROUPS + "SELECT array_to_string(lt, ' ') AS left_tokens, ll AS left_layer, array_to_string(rt, ' ') AS right_tokens, rl AS right_layer,"
    " lm AS left_members, rm AS right_members, n AS table_pairs, round(sim, 6) AS similarity, round(least(0.9, 0.4 + sim), 3) AS confidence, "
    + _DIRECTION.format(a="ll", b="rl") + " AS direction FROM pairs WHERE sim >= 0.4 AND n > 0", "assets"))
def j7_similar_name_groups(spark, root):
    return lineage.similar_name_groups(d.assets(spark, root)).withColumn("similarity", F.round("similarity", 6))


_SIMILAR = (
    _GROUPS.split(" g AS (")[0].rstrip().rstrip(",") + ", p AS (SELECT a.id AS a, b.id AS b, "
    + _DIRECTION.format(a="a.layer", b="b.layer") + " AS dir, len(list_intersect(a.tokens, b.tokens)) / len(list_distinct(list_concat(a.tokens, b.tokens)))"
    " AS sim FROM toks a JOIN toks b ON a.id < b.id WHERE len(a.tokens) > 0 AND len(b.tokens) > 0)"
    " SELECT CASE WHEN dir = 'backward' THEN b ELSE a END AS upstream_id, CASE WHEN dir = 'backward' THEN a ELSE b END AS downstream_id,"
    " round(least(0.9, 0.4 + sim), 3) AS confidence FROM p WHERE sim >= 0.4"
)


@_q("j7_similar_tables", oracle(_SIMILAR, "assets"))
def j7_similar_tables(spark, root):
    out = lineage.similar_tables(d.assets(spark, root))
    return out.select("upstream_id", "downstream_id", "confidence")


@_q("j8_glossary_matches", oracle(
    "WITH t AS (SELECT id AS table_id, concat_ws(' ', lower(fqn), lower(coalesce(description, ''))) AS txt FROM assets),"
    " s AS (SELECT table_id, t2.id AS term, greatest(CASE WHEN contains(txt, lower(t2.name)) THEN 0.7 ELSE 0 END, CASE WHEN"
    " len(list_filter(t2.synonyms, lambda x: contains(txt, lower(x)))) > 0 THEN 0.65 ELSE 0 END) AS c FROM t, terms t2)"
    " SELECT table_id, term, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY c DESC, term) AS r FROM s"
    " WHERE c > 0) WHERE r <= 3 AND c >= 0.55", "assets", "terms"))
def j8_glossary_matches(spark, root):
    return lineage.glossary_matches(d.assets(spark, root), d.terms(spark, root)).select("table_id", "term", "confidence")


@_q("j8_document_terms", oracle(
    "WITH t AS (SELECT doc_id AS table_id, concat_ws(' ', source, lower(text)) AS txt FROM documents), v AS (SELECT DISTINCT lower(lang) AS w FROM documents"
    " UNION SELECT DISTINCT lower(split_part(text, ' ', 2)) FROM documents WHERE doc_id % 100 = 3),"
    " s AS (SELECT table_id, w, 0.7 AS c FROM t, v WHERE w <> '' AND contains(txt, w))"
    " SELECT table_id, w AS term, c AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY w) AS r FROM s) WHERE r <= 3"))
def j8_document_terms(spark, root):
    docs = d.load(spark, root, "documents")
    texts = docs.select(F.col("doc_id").alias("id"), F.col("source").alias("fqn"), F.col("text").alias("description"))
    words = docs.select(F.lower("lang").alias("w")).union(
        docs.where("doc_id % 100 = 3").select(F.lower(F.split_part("text", F.lit(" "), F.lit(2))))).distinct()
    terms = words.where("w <> ''").select(F.col("w").alias("id"), F.col("w").alias("name"), F.lit(None).cast("array<string>").alias("synonyms"))
    return lineage.glossary_matches(texts, terms).select("table_id", "term", "confidence")


_SIDE = (
    "SELECT x.upstream_id, x.downstream_id, '{dir}' AS direction, u.name AS upstream_column, u.data_type AS upstream_data_type, v.name AS"
    " downstream_column, v.data_type AS downstream_data_type, a.fqn AS upstream_fqn, b.fqn AS downstream_fqn, x.transform_type FROM cedges x"
    " LEFT JOIN cols u ON u.id = x.upstream_column_id LEFT JOIN cols v ON v.id = x.downstream_column_id LEFT JOIN assets a ON a.id ="
    " x.upstream_id LEFT JOIN assets b ON b.id = x.downstream_id WHERE x.{end} = 100"
)
_OF = _SIDE.format(dir="upstream", end="downstream_id") + " UNION ALL " + _SIDE.format(dir="downstream", end="upstream_id")
_OF_COLS = ["upstream_id", "downstream_id", "direction", "upstream_column", "upstream_data_type", "downstream_column",
            "downstream_data_type", "upstream_fqn", "downstream_fqn", "transform_type"]


@_q("j13_column_lineage_of_table", oracle(_OF, "cedges", "cols", "assets"))
def j13_column_lineage_of_table(spark, root):
    return lineage.column_lineage_of(
        d.column_edges(spark, root), d.assets(spark, root), d.columns(spark, root), 100).select(*_OF_COLS)


@_q("j13_column_lineage_of_column", oracle(
    f"SELECT * FROM ({_OF}) WHERE (direction = 'upstream' AND downstream_column = 's5_phone') OR (direction = 'downstream' AND"
    " upstream_column = 's5_phone')", "cedges", "cols", "assets"))
def j13_column_lineage_of_column(spark, root):
    return lineage.column_lineage_of(
        d.column_edges(spark, root), d.assets(spark, root), d.columns(spark, root), 100, "s5_phone").select(*_OF_COLS)


def _sql_case(kind, low, high, ttype, expr, description):
    return (
        f"SELECT e.id, e.upstream_id, e.downstream_id, u.id AS upstream_column_id, c.id AS downstream_column_id, '{ttype}' AS transform_type,"
        f" {expr} AS transform_expression, concat('sqlglot:', coalesce(e.job_id, 'unknown')) AS job_id, {description} AS description FROM edges e JOIN"
        f" cols u ON u.table_id = e.upstream_id AND u.ordinal = e.{low} JOIN cols c ON c.table_id = e.downstream_id AND c.ordinal = e.{high}"
        " WHERE e.sql IS NOT NULL"
    )


SQL_EDGES = " UNION ALL ".join([
    _sql_case("direct", "low_supp", "low_supp", "direct", "concat('u.', u.name)",
              "concat('原样透传 ', u.name, ' (类型 ', u.data_type, ' → ', c.data_type, ')')"),
    _sql_case("cast", "high_supp", "high_supp", "cast", "concat('CAST(u.', u.name, ' AS String)')",
              "concat('由 ', u.name, ' 转换类型至 ', c.data_type, ' (CAST(u.', u.name, ' AS String))')"),
    _sql_case("agg", "low_supp", "high_supp", "aggregation", "concat('max(u.', u.name, ')')",
              "concat('聚合表达式 max(u.', u.name, ') 生成 ', c.name)"),
])


@_q("x17_sql_column_edges", oracle(f"SELECT * EXCLUDE (id, upstream_id, downstream_id) FROM ({SQL_EDGES})", "edges", "cols"))
def x17_sql_column_edges(spark, root):
    out = lineage.sql_column_edges(d.sql_edges(spark, root), d.assets(spark, root), d.columns(spark, root))
    return out.select(
        "upstream_column_id", "downstream_column_id", "transform_type", "transform_expression", "job_id", "description")


def _sql_edges(spark, root):
    """What inference takes of the edges with their statements, written out: it is read several times."""
    used = d.sql_edges(spark, root).select("upstream_id", "downstream_id", "job_id", "component", "pipeline_stage", "sql")
    return materialize(used, "sql-edges")


_INFERRED = (
    f"SELECT upstream_column_id, downstream_column_id, transform_type, job_id, 0.95 AS confidence, 'sqlglot' AS source FROM ({SQL_EDGES}) UNION ALL"
    " SELECT upstream_column_id, downstream_column_id, 'direct', concat('lineage_to_column:', CASE job_id WHEN 'lineage_to_column' THEN 'unknown'"
    f" ELSE job_id END), 1.0, 'lineage_to_column' FROM ({MATCHED})"
)


@_q("g8_infer_column_edges", oracle(_INFERRED, "edges", "cols"))
def g8_infer_column_edges(spark, root):
    out = lineage.infer_column_edges(_sql_edges(spark, root), d.assets(spark, root), d.columns(spark, root))
    return out.select("upstream_column_id", "downstream_column_id", "transform_type", "job_id", "confidence", "source")


def _refreshed(spark, root):
    """A run over a catalog in which tables of one name lack a column and some edges their statement, then the changes."""
    edges, assets, columns = _sql_edges(spark, root), d.assets(spark, root), d.columns(spark, root)
    before = columns.where("table_id % 17 <> 3 or hash(id) % 2 = 0")
    old = edges.where("upstream_id % 19 <> 5")
    marks = materialize(lineage.edge_marks(old, assets, before), "edge-marks-before")
    inferred = materialize(lineage.infer_column_edges(old, assets, before), "inferred-before")
    return lineage.refresh_column_edges(edges, assets, columns, marks, inferred)


@_q("g8_refreshed_edges", oracle(_INFERRED, "edges", "cols"))
def g8_refreshed_edges(spark, root):
    return _refreshed(spark, root)["column_edges"].select(
        "upstream_column_id", "downstream_column_id", "transform_type", "job_id", "confidence", "source")


@_q("g7_bulk_inference", oracle(f"SELECT source, count(*) AS column_edges_created FROM ({_INFERRED}) GROUP BY 1", "edges", "cols"))
def g7_bulk_inference(spark, root):
    return assembly.bulk_column_inference(
        d.assets(spark, root), d.columns(spark, root), _sql_edges(spark, root), d.column_edges(spark, root))["counts"]


@_q("g7_bulk_with_similar_names", oracle(
    f"SELECT source, transform_type, count(*) AS n FROM (SELECT 'sqlglot' AS source, transform_type FROM ({SQL_EDGES}) UNION ALL SELECT"
    f" 'lineage_to_column', 'direct' FROM ({MATCHED}) UNION ALL SELECT 'lineage_to_column', 'direct' FROM ({_SIMILAR}) s JOIN cols u ON u.table_id ="
    " s.upstream_id JOIN cols c ON c.table_id = s.downstream_id AND c.name = u.name WHERE (s.upstream_id, s.downstream_id) NOT IN"
    " (SELECT (upstream_id, downstream_id) FROM edges)) GROUP BY 1, 2", "edges", "cols", "assets"))
def g7_bulk_with_similar_names(spark, root):
    assets = d.assets(spark, root)
    out = assembly.bulk_column_inference(
        assets, d.columns(spark, root), _sql_edges(spark, root), d.column_edges(spark, root), focus=assets.select("id"))
    return out["column_edges"].groupBy("source", "transform_type").agg(F.count("*").alias("n"))


def _stages(spark, root):
    """Outputs of the stage operators, by stage."""
    named = lambda df, t: df.withColumn("transform_type", F.lit(t))
    chain = exports.task_chain(_tasks(spark, root)).selectExpr(
        "concat(dag_id, '.', upstream_task) as upstream_fqn", "concat(dag_id, '.', downstream_task) as downstream_fqn", "transform_type")
    jobs = exports.job_edges(_jobs(spark, root))
    ports = exports.model_io_edges(_models(spark, root))
    _, charts, datasets = _bi(spark, root)
    bi = exports.bi_edges(charts, datasets, exports.resolve_datasets(datasets, _warehouse(spark, root)), "bi")
    return [
        (1, "task_chain", named(chain, "airflow_task")),
        (1, "jobs(preprocess)", jobs.filter("pipeline_stage = 1")),
        (3, "model_io", ports),
        (5, "jobs(load)", jobs.filter("pipeline_stage = 5")),
        (6, "bi", bi),
    ]


_ASSEMBLED = (
    "SELECT 1 AS stage, 'task_chain' AS stage_label, (SELECT count(*) FROM (SELECT l_partkey AS a, lead(l_partkey) OVER (PARTITION BY l_orderkey"
    " ORDER BY l_partkey * 100000 + l_suppkey * 10 + l_linenumber) AS b FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM"
    " lineitem)) WHERE b <> a) AS n UNION ALL SELECT CASE WHEN query_id % 4 = 0 THEN 5 ELSE 1 END, CASE WHEN query_id % 4 = 0 THEN 'jobs(load)' ELSE"
    " 'jobs(preprocess)' END, count(*) FROM sql_log WHERE query_id % 10 = 6 GROUP BY 1, 2 UNION ALL"
    f" SELECT 3, 'model_io', count(*) FROM ({_MODEL_EDGES})"
)


@_q("g9_stage_assembly", oracle(_ASSEMBLED, "sql_log"))
def g9_stage_assembly(spark, root):
    out = assembly.assemble(_stages(spark, root), {1, 3, 5})
    return out.groupBy("stage", "stage_label").agg(F.count("*").alias("n"))


_COVERED = (
    f"WITH found AS (SELECT DISTINCT stage FROM ({_ASSEMBLED}) WHERE n > 0 UNION SELECT 6 FROM orders WHERE o_orderstatus <> 'P')"
    " SELECT (SELECT string_agg(stage, ',' ORDER BY stage) FROM found) AS covered_stages, (SELECT string_agg(s, ',' ORDER BY s) FROM"
    " range(1, 7) r(s) WHERE s NOT IN (FROM found)) AS missing_stages, (SELECT round(100 * count(*) / 6, 1) FROM found) AS coverage_pct"
)


@_q("a14_stage_coverage", oracle(_COVERED, "sql_log"))
def a14_stage_coverage(spark, root):
    return coverage.stage_coverage(assembly.assemble(_stages(spark, root)))


# Graph walks -----------------------------------------------------------------


def _center(edges):
    """The table with the most edges on its weaker side, lowest id first: one row."""
    ends = edges.select(
        F.inline(
            F.array(
                F.struct(F.col("upstream_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
                F.struct(F.col("downstream_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
            )
        )
    )
    return ends.groupBy("id").agg(F.least(F.sum("o"), F.sum("i")).alias("n")).orderBy(F.desc("n"), "id").first()["id"]


def _walk_sql(depth):
    return (
        "WITH RECURSIVE cen AS (SELECT t AS id FROM (SELECT upstream_id AS t, 1 AS o FROM edges UNION ALL SELECT downstream_id, 0 FROM edges)"
        " GROUP BY 1 ORDER BY least(sum(o), sum(1 - o)) DESC, t LIMIT 1),"
        f" up(id, l) AS (SELECT id, 0 FROM cen UNION SELECT e.upstream_id, l + 1 FROM up JOIN edges e ON e.downstream_id = up.id WHERE l < {depth}),"
        f" dn(id, l) AS (SELECT id, 0 FROM cen UNION SELECT e.downstream_id, l + 1 FROM dn JOIN edges e ON e.upstream_id = dn.id WHERE l < {depth}),"
        " ups AS (SELECT id, min(l) AS l FROM up GROUP BY 1), dns AS (SELECT id, min(l) AS l FROM dn GROUP BY 1) "
    )


_NODES = (
    "SELECT id, 'up' AS side, l AS level, -l AS layer FROM ups WHERE l > 0 UNION ALL SELECT id, 'down', l, l FROM dns WHERE l > 0"
    " UNION ALL SELECT id, 'center', 0, 0 FROM cen"
)


def _touched(depth):
    return (
        f"SELECT 'up' AS side, e.id FROM edges e JOIN ups ON ups.id = e.downstream_id AND l < {depth} UNION ALL"
        f" SELECT 'down', e.id FROM edges e JOIN dns ON dns.id = e.upstream_id AND l < {depth}"
    )


def _stored_edges(spark, root):
    """The edge table, written out: walks read it once per level."""
    return materialize(d.edges(spark, root), "edges")


def _walk(spark, root, depth=3):
    e = _stored_edges(spark, root)
    return graph.neighbourhood(e, _center(e), depth)


def _sides(walk):
    return walk.upstream_edges.select(F.lit("up").alias("side"), "id").unionByName(
        walk.downstream_edges.select(F.lit("down").alias("side"), "id"))


@_q("g1_neighbourhood_nodes", oracle(_walk_sql(3) + "SELECT id, side, level FROM (" + _NODES + ")", "edges"))
def g1_neighbourhood_nodes(spark, root):
    return _walk(spark, root).nodes.select("id", "side", "level")


@_q("g1_neighbourhood_edges", oracle(_walk_sql(2) + _touched(2), "edges"))
def g1_neighbourhood_edges(spark, root):
    return _sides(_walk(spark, root, 2))


def _impact(spark, root, direction="both", depth=3):
    e = _stored_edges(spark, root)
    return graph.impact(e, _center(e), direction, depth)


@_q("g2_impact_paths", oracle(
    _walk_sql(2) + "SELECT CASE t.side WHEN 'up' THEN 'upstream' ELSE 'downstream' END AS direction, e.upstream_id, e.downstream_id, e.transform_type AS via,"
    f" e.source, a.fqn AS from_fqn, b.fqn AS to_fqn FROM ({_touched(2)}) t JOIN edges e ON e.id = t.id LEFT JOIN assets a ON a.id = e.upstream_id"
    " LEFT JOIN assets b ON b.id = e.downstream_id", "edges", "assets"))
def g2_impact_paths(spark, root):
    return graph.impact_paths(_impact(spark, root, depth=2), d.assets(spark, root))


_HIT = "SELECT id FROM ups WHERE l > 0 UNION SELECT id FROM dns WHERE l > 0"


@_q("g2_impact_summary", oracle(
    _walk_sql(3) + "SELECT (SELECT count(*) FROM ups WHERE l > 0) AS upstream_count, (SELECT count(*) FROM dns WHERE l > 0) AS downstream_count,"
    f" (SELECT count(DISTINCT user_email) FROM owners WHERE is_verified AND table_id IN ({_HIT})) AS owners,"
    f" (SELECT count(DISTINCT term_id) FROM asset_terms WHERE table_id IN ({_HIT})) AS terms,"
    f" (SELECT count(*) FROM ({_touched(3)}) WHERE side = 'up') AS upstream_edges, (SELECT count(*) FROM ({_touched(3)}) WHERE side = 'down') AS downstream_edges",
    "edges", "owners", "asset_terms"))
def g2_impact_summary(spark, root):
    return graph.impact_summary(_impact(spark, root), d.owners(spark, root), d.asset_terms(spark, root), d.terms(spark, root))


@_q("g2_impact_upstream", oracle(_walk_sql(3) + "SELECT id, l AS level FROM ups WHERE l > 0", "edges"))
def g2_impact_upstream(spark, root):
    return _impact(spark, root, "upstream").nodes.filter("side = 'up'").select("id", "level")


@_q("u1_affected", oracle(
    _walk_sql(3) + f"SELECT DISTINCT 'owner' AS kind, user_email AS name FROM owners WHERE is_verified AND table_id IN ({_HIT}) UNION ALL"
    f" SELECT DISTINCT 'term', term_id FROM asset_terms WHERE table_id IN ({_HIT})", "edges", "owners", "asset_terms"))
def u1_affected(spark, root):
    walk = _impact(spark, root)
    people = graph.affected_owners(walk, d.owners(spark, root)).select(F.lit("owner").alias("kind"), F.col("user_email").alias("name"))
    words = graph.affected_terms(walk, d.asset_terms(spark, root), d.terms(spark, root)).select(F.lit("term").alias("kind"), "name")
    return people.unionByName(words)


@_q("g3_first_edges", oracle(
    _walk_sql(2) + "SELECT * FROM (SELECT 'upstream' AS direction, e.id FROM edges e JOIN ups ON ups.id = e.downstream_id AND l < 2 ORDER BY e.upstream_id,"
    " e.downstream_id LIMIT 50) UNION ALL SELECT * FROM (SELECT 'downstream', e.id FROM edges e JOIN dns ON dns.id = e.upstream_id AND l < 2 ORDER BY"
    " e.upstream_id, e.downstream_id LIMIT 50)", "edges"))
def g3_first_edges(spark, root):
    return graph.first_edges(_impact(spark, root, depth=2)).select("direction", "id")


@_q("g4_signed_layers", oracle(_walk_sql(3) + "SELECT id, layer FROM (" + _NODES + ")", "edges"))
def g4_signed_layers(spark, root):
    return _walk(spark, root).nodes.select("id", "layer")


_HOPS = (
    "WITH RECURSIVE both_ways AS (SELECT DISTINCT upstream_id AS a, downstream_id AS b FROM cedges UNION SELECT downstream_id, upstream_id FROM cedges),"
    " cen AS (SELECT t AS id FROM (SELECT upstream_id AS t, 1 AS o FROM edges UNION ALL SELECT downstream_id, 0 FROM edges) GROUP BY 1"
    " ORDER BY least(sum(o), sum(1 - o)) DESC, t LIMIT 1),"
    " h(id, l) AS (SELECT id, 0 FROM cen UNION SELECT b, l + 1 FROM h JOIN both_ways ON a = h.id WHERE l < 8),"
    " hop AS (SELECT id, min(l) AS distance FROM h GROUP BY 1) "
)


@_q("g5_hop_distance", oracle(_HOPS + "SELECT * FROM hop", "edges", "cedges"))
def g5_hop_distance(spark, root):
    return graph.hop_distance(d.column_edges(spark, root), _center(d.edges(spark, root)))


@_q("g6_reaches", oracle(
    _HOPS + "SELECT a.id, hop.id IS NOT NULL AND distance > 0 AS reaches FROM assets a LEFT JOIN hop ON hop.id = a.id", "edges", "cedges", "assets"))
def g6_reaches(spark, root):
    return graph.reaches(d.column_edges(spark, root), d.assets(spark, root), _center(d.edges(spark, root)))


def _break(dim):
    return f"SELECT '{dim}' AS dimension, coalesce({dim}, 'unknown') AS key, count(*) AS n FROM near GROUP BY 2"


@_q("a11_edge_breakdown", oracle(
    _walk_sql(2).rstrip() + f", near AS (SELECT e.* FROM ({_touched(2)}) t JOIN edges e ON e.id = t.id) " + " UNION ALL ".join(
        _break(x) for x in ("source", "transform_type", "component")), "edges"))
def a11_edge_breakdown(spark, root):
    walk = _walk(spark, root, 2)
    return coverage.edge_breakdown(walk.upstream_edges.unionByName(walk.downstream_edges))


# Descriptions and OpenLineage documents --------------------------------------


def _duck_fill(template, values):
    from string import Formatter

    parts = []
    for literal, field, _, _ in Formatter().parse(template):
        if literal:
            parts.append("'" + literal.replace("'", "''") + "'")
        if field:
            parts.append(values[field])
    return f"concat({', '.join(parts)})"


def _trunc(x, n):
    return f"CASE WHEN length({x}) <= {n} THEN {x} ELSE concat(substring({x}, 1, {n - 3}), '...') END"


_EXPR = "coalesce(transform_expression, '')"
_GLIMPSE = _trunc("coalesce(sql, '')", 80)
_COMMON = dict.fromkeys(["model_name", "job_id", "chart_id"], "coalesce(job_id, '')") | {
    "upstream_fqn": "uf", "downstream_fqn": "df", "sql_glimpse": _GLIMPSE, "filter_expr": _EXPR,
    "columns": f"CASE WHEN {_EXPR} = '' THEN '(all)' ELSE {_EXPR} END",
}
_BY_TYPE = _COMMON | {
    "dag_id": "split_part(coalesce(job_id, ''), '.', 1)", "task_id": "list_last(string_split(coalesce(job_id, ''), '.'))", "transform_expr": _EXPR,
}
_BY_SUB = _COMMON | {"dag_id": "coalesce(job_id, '')", "task_id": "coalesce(job_id, '')",
                     "transform_expr": f"CASE WHEN {_EXPR} = '' THEN transform_subtype ELSE {_EXPR} END"}


def _templated(key, values, confidence):
    rows = "".join(
        f" WHEN comp = '{c}' AND {key} = '{k}' THEN struct_pack(description := {_duck_fill(t, values)}, confidence := {confidence},"
        f" rationale := 'template_match:{c}/{k}')"
        for (c, k), t in describe.EDGE_TEMPLATES.items()
    )
    return f"CASE{rows} END"


def _or(x):
    return f"CASE WHEN {_EXPR} = '' THEN '{x}' ELSE {_EXPR} END"


DESCRIBED = (
    f"SELECT id, s.description AS description, s.confidence AS confidence, s.rationale AS rationale, job_id, upstream_id, downstream_id FROM (SELECT e.*,"
    f" coalesce({_templated('transform_type', _BY_TYPE, 0.9)}, {_templated('transform_subtype', _BY_SUB, 0.8)}, struct_pack(description := CASE"
    " transform_type WHEN 'copy' THEN concat('由 ', uf, ' 复制到 ', df) WHEN 'aggregation' THEN concat(uf, ' 聚合到 ', df, ' (', "
    f"{_or('aggregation')}, ')') WHEN 'expression' THEN concat(uf, ' 派生 ', df, ' (', {_or('expression')}, ')') WHEN 'derivation' THEN"
    " concat('由 ', uf, ' 派生 ', df) ELSE concat(uf, ' → ', df, ' (', comp, '/', transform_type, ')') END, confidence := 0.5, rationale :="
    " concat('generic_template:', comp, '/', transform_type))) AS s FROM (SELECT e.*, coalesce(component, 'sql') AS comp, a.fqn AS uf, b.fqn AS df"
    " FROM edges e JOIN assets a ON a.id = e.upstream_id JOIN assets b ON b.id = e.downstream_id) e)"
)


def _described(spark, root):
    e = listing.with_fqns(d.edges(spark, root).drop("description"), d.assets(spark, root))
    s = describe.edge_description()
    return e.withColumn("s", s).select(
        "id", "upstream_id", "downstream_id", "job_id", F.col("s.description").alias("description"),
        F.col("s.confidence").alias("confidence"), F.col("s.rationale").alias("rationale"))


@_q("x25_edge_descriptions", oracle(f"SELECT id, description, confidence, rationale FROM ({DESCRIBED})", "edges", "assets"))
def x25_edge_descriptions(spark, root):
    return _described(spark, root).select("id", "description", "confidence", "rationale")


@_q("x25_propagated", oracle(
    f"SELECT x.upstream_column_id, x.downstream_column_id, concat('[', x.transform_type, '] ', t.description, ' (列 ', substring(x.transform_expression, 1, 60), ')')"
    f" AS description FROM cedges x JOIN ({DESCRIBED}) t ON t.upstream_id = x.upstream_id AND t.downstream_id = x.downstream_id AND t.job_id = x.job_id"
    " WHERE x.description IS NULL", "edges", "assets", "cedges"))
def x25_propagated(spark, root):
    told = _described(spark, root).select("upstream_id", "downstream_id", "job_id", F.col("description").alias("edge_text"))
    mute = listing.without_description(d.column_edges(spark, root))
    return mute.join(told, ["upstream_id", "downstream_id", "job_id"]).select(
        "upstream_column_id", "downstream_column_id", describe.propagated_description(F.col("edge_text")).alias("description"))


@_q("x26_column_edge_descriptions", oracle(
    "SELECT x.upstream_column_id, x.downstream_column_id, CASE x.transform_type WHEN 'direct' THEN concat('原样透传 ', u.name, ' (类型 ', u.data_type,"
    " ' → ', v.data_type, ')') WHEN 'cast' THEN concat('由 ', u.name, ' 转换类型至 ', v.data_type, ' (x(', u.name, '))') WHEN 'aggregation' THEN"
    " concat('聚合表达式 x(', u.name, ') 生成 ', v.name) WHEN 'window' THEN concat('窗口函数 x(', u.name, ') → ', v.name) WHEN 'expression' THEN"
    " concat('派生表达式 x(', u.name, ') → ', v.name) ELSE concat('由上游 ', u.name, ' 派生 ', v.name, ' (x(', u.name, '))') END AS description"
    " FROM cedges x JOIN cols u ON u.id = x.upstream_column_id JOIN cols v ON v.id = x.downstream_column_id", "cedges", "cols"))
def x26_column_edge_descriptions(spark, root):
    c = d.columns(spark, root)
    up = c.selectExpr("id as upstream_column_id", "name as un", "data_type as ut")
    down = c.selectExpr("id as downstream_column_id", "name as dn", "data_type as dt")
    text = describe.column_edge_description(
        F.col("transform_type"), F.col("transform_expression"), F.col("un"), F.col("ut"), F.col("dn"), F.col("dt"))
    return d.column_edges(spark, root).join(up, "upstream_column_id").join(down, "downstream_column_id").select(
        "upstream_column_id", "downstream_column_id", text.alias("description"))


@_q("x27_openlineage_types", oracle(
    "SELECT transform_type, CASE transform_type WHEN 'direct' THEN 'DIRECT' ELSE 'TRANSFORMATION' END AS ol_type, CASE transform_type WHEN 'direct'"
    " THEN NULL ELSE upper(transform_type) END AS ol_subtype, count(*) AS n FROM cedges GROUP BY 1", "cedges"))
def x27_openlineage_types(spark, root):
    counted = d.column_edges(spark, root).groupBy("transform_type").agg(F.count("*").alias("n"))
    ol = documents.openlineage_type(F.col("transform_type"))
    return counted.select("transform_type", ol["type"].alias("ol_type"), ol["subtype"].alias("ol_subtype"), "n")


def _facet_edges(spark, root):
    a = d.assets(spark, root).select(
        F.col("id").alias("upstream_id"), F.col("fqn").alias("upstream_fqn"), F.col("name").alias("upstream_name"),
        documents.dataset_namespace(F.col("fqn"), F.lit(None).cast("string")).alias("upstream_namespace"))
    return d.column_edges(spark, root).join(a, "upstream_id")


@_q("x28_column_facets", oracle(
    "SELECT x.downstream_id, x.upstream_col AS downstream_col, count(DISTINCT (concat(a.service, '://', a.database), a.name)) AS n_inputs,"
    " string_agg(DISTINCT concat(a.service, '://', a.database, '/', a.name), ',' ORDER BY concat(a.service, '://', a.database, '/', a.name)) AS inputs,"
    " count(DISTINCT (transform_type, x.description, transform_expression)) AS n_transformations FROM cedges x JOIN assets a ON a.id = x.upstream_id"
    " GROUP BY 1, 2", "cedges", "assets"))
def x28_column_facets(spark, root):
    fields = documents.column_lineage_fields(_facet_edges(spark, root))
    text = F.array_join(F.array_sort(F.transform("inputFields", lambda f: F.concat(f["namespace"], F.lit("/"), f["name"]))), ",")
    return fields.select(
        "downstream_id", "downstream_col", F.size("inputFields").alias("n_inputs"), text.alias("inputs"),
        F.size("transformations").alias("n_transformations"))


@_q("x28_run_events", oracle(
    "WITH recent AS (SELECT * FROM edges WHERE created_s >= 1704240000 - 9000), f AS (SELECT DISTINCT downstream_id, upstream_id, upstream_col AS col FROM cedges),"
    " g AS (SELECT upstream_id, downstream_id, string_agg(col, ',' ORDER BY col) AS cols FROM f GROUP BY 1, 2)"
    " SELECT r.upstream_id, r.downstream_id, 'COMPLETE' AS event_type, '2024-01-03T00:00:00.000000Z' AS event_time, 'run-1' AS run_id, 'ns/nightly' AS job,"
    " concat(u.service, '://', u.database, '/', u.name) AS input, concat(v.service, '://', v.database, '/', v.name) AS output,"
    " coalesce(v.description, '') AS documentation, coalesce(g.cols, '') AS cols FROM recent r JOIN assets u ON u.id = r.upstream_id JOIN assets v ON"
    " v.id = r.downstream_id LEFT JOIN g ON g.upstream_id = r.upstream_id AND g.downstream_id = r.downstream_id", "edges", "assets", "cedges"))
def x28_run_events(spark, root):
    assets = d.assets(spark, root).withColumn("ol_namespace", F.lit(None).cast("string"))
    events = documents.lineage_events(
        d.edges(spark, root), assets, _facet_edges(spark, root), AS_OF - timedelta(seconds=9000), "COMPLETE", AS_OF, "ns", "nightly", "run-1")
    dataset = ("array<struct<namespace: string, name: string, facets: struct<documentation: struct<description: string>,"
               " columnLineage: struct<fields: map<string, struct<inputFields: array<struct<name: string>>>>>>>>")
    doc = F.from_json("document", f"eventType string, eventTime string, job struct<namespace: string, name: string>, run struct<runId: string>,"
                                  f" inputs {dataset}, outputs {dataset}")
    place = lambda x: F.concat(x["namespace"], F.lit("/"), x["name"])
    e = events.select("upstream_id", "downstream_id", doc.alias("d")).withColumn("i", F.col("d.inputs")[0]).withColumn("o", F.col("d.outputs")[0])
    cols = F.array_join(F.array_sort(F.map_keys("o.facets.columnLineage.fields")), ",")
    return e.select(
        "upstream_id", "downstream_id", F.col("d.eventType").alias("event_type"), F.col("d.eventTime").alias("event_time"),
        F.col("d.run.runId").alias("run_id"), place(F.col("d.job")).alias("job"), place(F.col("i")).alias("input"), place(F.col("o")).alias("output"),
        F.col("o.facets.documentation.description").alias("documentation"), F.coalesce(cols, F.lit("")).alias("cols"))


@_q("x28_output_datasets", oracle(
    "SELECT a.id, concat(a.service, '://', a.database) AS namespace, a.name, coalesce(a.description, '') AS documentation, c.col AS column, coalesce(c.inputs, '') AS inputs FROM assets a"
    " LEFT JOIN (SELECT x.downstream_id, x.upstream_col AS col, string_agg(DISTINCT concat(u.service, '://', u.database, '/', u.name, '.', x.upstream_col), ','"
    " ORDER BY concat(u.service, '://', u.database, '/', u.name, '.', x.upstream_col)) AS inputs FROM cedges x JOIN assets u ON u.id = x.upstream_id GROUP BY 1, 2) c"
    " ON c.downstream_id = a.id WHERE a.id IN (SELECT downstream_id FROM edges)",
    "assets", "edges", "cedges"))
def x28_output_datasets(spark, root):
    ends = d.edges(spark, root).select(F.col("downstream_id").alias("id"))
    tables = d.assets(spark, root).withColumn("ol_namespace", F.lit(None).cast("string")).join(ends, "id", "left_semi")
    out = documents.dataset_documents(tables, documents.column_lineage_fields(_facet_edges(spark, root)))
    inputs = F.try_element_at("dataset.facets.columnLineage.fields", F.col("column"))["inputFields"]
    text = F.array_sort(F.transform(inputs, lambda f: F.concat(f["namespace"], F.lit("/"), f["name"], F.lit("."), f["field"])))
    return out.select(
        "id", "dataset.namespace", "dataset.name", F.col("dataset.facets.documentation.description").alias("documentation"),
        "column", F.coalesce(F.array_join(text, ","), F.lit("")).alias("inputs"))
