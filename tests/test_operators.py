"""Operators against brute force on small tables, hot groups included."""

import itertools
import json
import random
import re
from collections import defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritab.functions import documents
from veritab.operators import adjacent, assembly, evaluation, feedback, graph, lineage, quality, review
from veritab.plans.registry import Entry, Registry
from veritab.sources import cases, exports, files, models, sinks
from veritab.streaming import descriptors, run_events


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


# Neighbours inside hot keys ------------------------------------------------------


@pytest.mark.parametrize("forward", [False, True])
def test_adjacent_value_equals_plain_window(spark, forward):
    rnd = random.Random(1)
    data = [(rnd.choice(["hot", "hot", "a", "b"]), i, rnd.choice([None, "x", "y"])) for i in rnd.sample(range(5000), 900)]
    df = spark.createDataFrame(data, "k string, o long, v string")
    got = adjacent.adjacent_value(df, "k", F.floor(F.col("o") / 37), ["o"], "v", "n", forward)
    want, by = {}, defaultdict(list)
    for k, o, v in data:
        by[k].append((o, v))
    for k, seq in by.items():
        seq.sort()
        for i, (o, _) in enumerate(seq):
            j = i + 1 if forward else i - 1
            want[k, o] = seq[j][1] if 0 <= j < len(seq) else None
    assert {(r["k"], r["o"]): r["n"] for r in got.collect()} == want


def test_one_row(spark):
    a = spark.createDataFrame([(1,)], "a int")
    b = spark.createDataFrame([("x", False)], "b string, c boolean")
    assert rows(adjacent.one_row(a, b)) == [(1, "x", False)]


# Graph ---------------------------------------------------------------------------


def random_graph(seed, nodes=40, count=90):
    rnd = random.Random(seed)
    pairs = {(rnd.randrange(nodes), rnd.randrange(nodes)) for _ in range(count)}
    pairs |= {(0, n) for n in range(1, nodes, 3)}  # a hub with a third of the nodes
    return sorted(pairs)


def edge_table(spark, pairs):
    return spark.createDataFrame([(a, b, "copy", "s") for a, b in pairs], "upstream_id long, downstream_id long, transform_type string, source string")


def brute_neighbourhood(pairs, center, depth):
    seen, side = {center}, {center: ("center", 0)}
    fu, fd, eu, ed = {center}, {center}, [], []
    for level in range(1, depth + 1):
        up = [e for e in pairs if e[1] in fu]
        eu += up
        fu = {a for a, _ in up} - seen
        seen |= fu
        side.update({n: ("up", level) for n in fu})
        down = [e for e in pairs if e[0] in fd]
        ed += down
        fd = {b for _, b in down} - seen
        seen |= fd
        side.update({n: ("down", level) for n in fd})
    return side, sorted(eu), sorted(ed)


def brute_impact(pairs, center, depth):
    seen, side, found = {center}, {center: ("center", 0)}, {}
    for name, near, far in (("up", 1, 0), ("down", 0, 1)):
        frontier, edges = {center}, []
        for level in range(1, depth + 1):
            hit = [e for e in pairs if e[near] in frontier]
            edges += hit
            frontier = {e[far] for e in hit} - seen
            seen |= frontier
            side.update({n: (name, level) for n in frontier})
        found[name] = sorted(edges)
    return side, found["up"], found["down"]


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("walk,brute", [(graph.neighbourhood, brute_neighbourhood), (lambda e, c, d: graph.impact(e, c, "both", d), brute_impact)])
def test_walks_on_cyclic_graphs(spark, seed, walk, brute):
    pairs = random_graph(seed)
    got = walk(edge_table(spark, pairs), 5, 3)
    side, up, down = brute(pairs, 5, 3)
    assert {r["id"]: (r["side"], r["level"]) for r in got.nodes.collect()} == side
    assert rows(got.upstream_edges, "upstream_id", "downstream_id") == up
    assert rows(got.downstream_edges, "upstream_id", "downstream_id") == down


def test_one_direction(spark):
    got = graph.impact(edge_table(spark, [(1, 2), (2, 3), (3, 4)]), 3, "upstream", 10)
    assert rows(got.nodes, "id", "layer") == [(1, -2), (2, -1), (3, 0)]
    assert got.downstream_edges.count() == 0


def test_hop_distance_and_reach(spark):
    pairs = [(1, 2), (3, 2), (3, 4), (4, 5), (8, 9)]
    e = edge_table(spark, pairs)
    assert rows(graph.hop_distance(e, 1), "id", "distance") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 4)]
    ids = spark.createDataFrame([(i,) for i in range(1, 10)], "id long")
    assert [r[0] for r in rows(graph.reaches(e, ids, 1)) if r[1]] == [2, 3, 4, 5]


# Similar names and glossary --------------------------------------------------------


def brute_similar(tables, t):
    import re

    def tokens(n):
        return frozenset(re.findall(r"[a-z0-9]{3,}", re.sub(r"^(stg|ods|dwd|dws|ads|fct|dim)_", "", n)))

    out = defaultdict(int)
    for (i, a), (j, b) in itertools.combinations(tables, 2):
        x, y = tokens(a), tokens(b)
        if x and y and len(x & y) / len(x | y) >= t:
            key = tuple(sorted([(tuple(sorted(x)), a.split("_")[0]), (tuple(sorted(y)), b.split("_")[0])]))
            out[key] += 1
    return dict(out)


@pytest.mark.parametrize("t", [0.3, 0.4, 0.5, 0.75, 1.0])
def test_similar_names_lose_no_pair(spark, t):
    rnd = random.Random(7)
    words = ["order", "user", "item", "daily", "risk", "pay", "xx", "geo"]
    tables = [(i, "_".join([rnd.choice(["stg", "fct", "raw"])] + rnd.choices(words, k=rnd.randint(1, 4)))) for i in range(120)]
    tables += [(200 + i, "stg_hot_word") for i in range(60)]  # a third are copies
    df = spark.createDataFrame([(i, f"s.d.c.{n}") for i, n in tables], "id long, fqn string")
    got = {
        tuple(sorted([(tuple(r["left_tokens"].split()), r["left_layer"]), (tuple(r["right_tokens"].split()), r["right_layer"])])): r["table_pairs"]
        for r in lineage.similar_name_groups(df, t).collect()
    }
    assert got == brute_similar(tables, t)


def test_similar_tables_direction(spark):
    df = spark.createDataFrame([(1, "s.d.c.fct_order"), (2, "s.d.c.stg_order"), (3, "s.d.c.abc_order"), (4, "s.d.c.stg_else")], "id long, fqn string")
    out = lineage.similar_tables(df, df.filter("id = 1").select("id"))
    # abc is no layer prefix, so it stays a token: similarity 1/2.
    assert rows(out, "upstream_id", "downstream_id", "confidence") == [(1, 3, 0.9), (2, 1, 0.9)]


def test_bulk_pairs_only_tables_that_share_a_column(spark, monkeypatch):
    """tables of one name were paired all with all before their columns were met."""
    names = ["stg_order_item"] * 30 + ["fct_order_item", "fct_order_item_daily", "else_where"]
    assets = spark.createDataFrame([(i, f"s.d.c.{n}") for i, n in enumerate(names)] + [(3, "s.d.c.stg_item_risk"), (None, "s.d.c.stg_order_item")], "id long, fqn string")
    cols = [(f"{i}:{c}", i, c) for i in range(33) for c in (f"own{i}", f"mod{i % 11}")] + [("5:x", 5, "own6"), ("7:n", 7, None), ("8:n", 8, None), ("?", None, "mod1")]
    columns = spark.createDataFrame([(*c, "String") for c in cols], "id string, table_id long, name string, data_type string")
    edges = spark.createDataFrame([(0, 11, None, None, None, None)], "upstream_id long, downstream_id long, sql string, job_id string, component string, pipeline_stage int")
    focus = assets.where("id in (0, 2, 5, 11, 30)").select("id")
    existing = spark.createDataFrame([], "upstream_column_id string, downstream_column_id string, transform_type string, job_id string, confidence double")
    written = {}
    monkeypatch.setattr(assembly, "materialize", lambda df, name: written.setdefault(name, df))
    out = assembly.bulk_column_inference(assets, columns, edges, existing, focus=focus)
    pairs = [tuple(r) for r in out["table_edges"].select("upstream_id", "downstream_id").collect()]
    assert sorted(pairs) == sorted({tuple(r) for r in lineage.similar_tables(assets, focus).select("upstream_id", "downstream_id").collect()} - {(0, 11)})
    named = {t: {c for _, i, c in cols if i == t and c} for t in range(33)}
    assert sorted(tuple(r) for r in written["similar-edges"].select("upstream_id", "downstream_id").collect()) == sorted(p for p in pairs if named[p[0]] & named[p[1]])
    want = {(u[0], d[0]) for a, b in [*pairs, (0, 11)] for u in cols if u[1] == a for d in cols if d[1] == b and u[2] and u[2] == d[2]}
    got = rows(out["column_edges"], "upstream_column_id", "downstream_column_id")
    assert len(want) > 8 and got == sorted(want)


def test_glossary_scores(spark):
    assets = spark.createDataFrame([(1, "s.d.c.gmv_daily", "total Net Sales"), (2, "s.d.c.other", None)], "id long, fqn string, description string")
    terms = spark.createDataFrame(
        [("g", "GMV", ["gross"]), ("n", "Revenue", ["net sales", ""]), ("o", "Z", ["the"]), ("p", "Nope", [])],
        "id string, name string, synonyms array<string>")
    assert rows(lineage.glossary_matches(assets, terms), "table_id", "term", "confidence") == [
        (1, "GMV", 0.7), (1, "Revenue", 0.65), (2, "Z", 0.65)]


# Profile and rules -------------------------------------------------------------------


def test_profile(spark):
    df = spark.createDataFrame([("a", 1), ("", 1), (None, 2), ("a" * 100, None)], "s string, n int")
    assert rows(quality.profile(df)) == [("n", 4, 0.25, 2), ("s", 4, 0.5, 3)]
    assert rows(quality.profile(df, exact=False)) == [("n", 4, 0.25, 2), ("s", 4, 0.5, 3)]


def test_rules_on_empty_table(spark):
    df = spark.createDataFrame([], "created_at timestamp, v string")
    name = "s.d.c.t"
    rules = [quality.Rule("f", name, "freshness"), quality.Rule("n", name, "null_ratio", {"column": "v"}),
             quality.Rule("d", name, "distinct", {"column": "v"}), quality.Rule("b", "t", "volume", {"min": 1})]
    out = quality.run_rules(spark, {name: df, "t": df}, rules, datetime(2024, 1, 1))
    assert rows(out, "rule_id", "passed", "message") == [
        ("b", False, "bad fqn"), ("d", False, "distinct=0 min 1"), ("f", False, "no rows"), ("n", True, "null_ratio=0.000 limit 0.5")]


def test_rules_share_one_scan(spark):
    df = spark.range(10).withColumn("v", F.col("id") % 3)
    name = "s.d.c.t"
    rules = [quality.Rule(f"r{i}", name, "volume", {"min": i}) for i in range(20)] + [quality.Rule("d", name, "distinct", {"column": "v"})]
    plan = quality.run_rules(spark, {name: df}, rules, datetime(2024, 1, 1))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (") == 1


# Sinks ---------------------------------------------------------------------------------


def test_upsert_newest_wins(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 9, "b")], "k int, v int, x string")
    new = spark.createDataFrame([(1, 1, "c"), (2, 3, "d"), (3, 0, "e")], "k int, v int, x string")
    assert rows(sinks.upsert(old, new, ["k"], "v")) == [(1, 1, "c"), (2, 9, "b"), (3, 0, "e")]


def test_upsert_with_maps(spark):
    old = spark.createDataFrame([(1, 1, {"a": "b"})], "k int, v int, m map<string,string>")
    new = spark.createDataFrame([(1, 2, {"c": "d"})], "k int, v int, m map<string,string>")
    assert sinks.upsert(old, new, ["k"], "v").first()["m"] == {"c": "d"}


def test_insert_if_absent(spark):
    old = spark.createDataFrame([(1, "a")], "k int, x string")
    new = spark.createDataFrame([(1, "z"), (2, "q"), (2, "p")], "k int, x string")
    assert rows(sinks.insert_if_absent(old, new, ["k"])) == [(2, "p")]


def test_fill_empty_keeps_manual_text(spark):
    old = spark.createDataFrame([(1, "kept", {"a": "1"}, ["x"]), (2, "", None, None)], "k int, t string, m map<string,string>, l array<string>")
    new = spark.createDataFrame([(1, "new", {"a": "2", "b": "3"}, ["x", "y"]), (2, "new", {"c": "4"}, ["z"])], "k int, t string, m map<string,string>, l array<string>")
    got = {r["k"]: r for r in sinks.fill_empty(old, new, ["k"], ["t"], ["m"], ["l"]).collect()}
    assert (got[1]["t"], got[1]["m"], got[1]["l"]) == ("kept", {"a": "2", "b": "3"}, ["x", "y"])
    assert (got[2]["t"], got[2]["m"], got[2]["l"]) == ("new", {"c": "4"}, ["z"])


# Sources -----------------------------------------------------------------------------------


def test_csv_header_and_listing(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.csv").write_text(" order_id ,user_id\r\n1,2\n")
    (tmp_path / "b.txt").write_text("x")
    (tmp_path / "c.JSON").write_text("{}")
    assert rows(files.list_files(spark, str(tmp_path), stage=4), "key", "format", "pipeline_stage") == [("c.JSON", "json", 4), ("d/a.csv", "csv", 4)]
    assert rows(files.csv_header_columns(spark, str(tmp_path)), "ordinal", "name") == [(0, "order_id"), (1, "user_id")]
    with pytest.raises(ValueError):
        files.list_files(spark, str(tmp_path), stage=3)


def test_csv_header_of_any_length(spark, tmp_path):
    names = [f"column_{i}" for i in range(20_000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + "1,2\n")
    (tmp_path / "bare.csv").write_text("only")
    out = files.csv_header_columns(spark, str(tmp_path))
    assert out.filter("path like '%wide%'").count() == 20_000
    assert rows(out.filter("path like '%bare%'"), "ordinal", "name") == [(0, "only")]


def test_catalog_schemas(spark):
    from veritab import catalog

    for entity in catalog.entities():
        frame = catalog.empty(spark, entity)
        assert catalog.conform(frame.limit(0), entity).schema == frame.schema
        assert set(catalog.KEYS.get(entity, [])) <= set(frame.columns)
    got = catalog.conform(spark.createDataFrame([(7, "x")], "table_id int, tag_id string"), "asset_tags")
    assert rows(got) == [("7", "x")]


def test_manifest_file(spark, tmp_path):
    doc = {
        "metadata": {"project_name": "Shop DW"},
        "nodes": {
            "model.a": {"resource_type": "model", "database": "wh", "schema": "s", "name": "n", "alias": "fct", "columns": {"id": {"data_type": "Int64"}},
                        "depends_on": {"nodes": ["source.x", "test.q", "model.unknown"]}, "raw_code": "select * from {{ source('s', 'x') }}"},
            "test.q": {"resource_type": "test", "name": "q"},
        },
        "sources": {"source.x": {"source_name": "raw", "identifier": "x"}},
    }
    path = tmp_path / "manifest.json"
    path.write_text(json.dumps(doc, indent=1))
    nodes = models.manifest_nodes(models.read_manifests(spark, str(path)))
    assert rows(nodes, "fqn", "asset_type") == [("dbt-shop-dw.raw.raw.x", "table"), ("dbt-shop-dw.wh.s.fct", "dbt_model")]
    assert rows(models.dependency_edges(nodes), "upstream_fqn", "downstream_fqn", "sql") == [
        ("dbt-shop-dw.raw.raw.x", "dbt-shop-dw.wh.s.fct", "select * from x")]
    assert rows(models.node_columns(nodes)) == [("dbt-shop-dw.wh.s.fct", "id", "Int64", None)]


GOOD_MANIFESTS = [json.dumps({
    "metadata": {"project_name": f"P {i}"}, "nodes": {f"model.{i}": {"resource_type": "model", "name": f"n{i}", "columns": {f"c{i}": {"data_type": "é\n\""}}}},
    "sources": {f"s{i}": {"name": "t"}}}) for i in range(60)]
ODD_MANIFESTS = [
    "", " ", "null", None, "5", '"x"', "xxx", "[]", "{}", "[1", "1]", '{"z":[1', "1]}", '[{"nodes":{}}]', '{}],"d":[{}', '{"nodes":{"a":{"name":"x"}', '{"nodes":{"a":{"name":"x',
    '{"nodes":{"a":{"name":"x"}}} trailing', '{"nodes":{"a":{"name":"x"}}},{"nodes":{}}', '{"metadata":{"project_name":"p"}}]} , ', "{'nodes':{'a':{'name':'q'}}}",
    '{"nodes":{"a":{"name":1.0}}}', '{"nodes":{"a":"str"}}', '{"nodes":{"a":null,"b":{"name":"x"}}}', '{"nodes":[1]}', '{"nodes":{"a":{"name":{"z":1, "b":[2]}}}}',
    '{"nodes":{"a":{"name":"x"},"a":{"name":"y"}}}', '{"nodes":{"a":{"depends_on":{"nodes":["x",1,null,{"q":1}]}}}}', '{"nodes":{"a":{"depends_on":["x"]}}}',
    '{"_mark":"q"}', '{"_mark":{"x":1}}', '{"metadata":{"project_name":NaN}}', '{"nodes":{"a":{"name":"tab\tx"}}}', json.dumps({"nodes": {"m": {"name": "y" * 70_000}}}),
]


@pytest.mark.parametrize("docs", [GOOD_MANIFESTS, GOOD_MANIFESTS + ODD_MANIFESTS, ['{"z":[1', "1]}", '{"nodes":{"x":{"name":"1"}}},{}', GOOD_MANIFESTS[0]] * 3, *[[x] for x in ODD_MANIFESTS[4:20:5]]])
def test_manifests_parsed_together_are_as_parsed_alone(spark, docs):
    df = spark.createDataFrame([(x,) for x in docs], "value string").coalesce(1)
    got, want = models.parse_manifests(df), df.select(F.from_json("value", models.MANIFEST_SCHEMA).alias("m")).select("m.*")
    assert got.schema == want.schema
    assert got.collect() == want.collect()


def test_manifests_are_parsed_together():
    """each was parsed by itself, and the parser copied the names it kept for each."""
    batch = pa.RecordBatch.from_arrays([pa.array([*GOOD_MANIFESTS, None, ODD_MANIFESTS[-1], "{}"], pa.string())], ["value"])
    parts = [r for b in models._together([batch, batch.slice(0, 0)]) for r in b.to_pylist()]
    assert [r["n"] for r in parts] == [61, 2]
    listed = json.loads(parts[0]["value"])["d"]
    assert listed[1::2] == [json.loads(x) for x in GOOD_MANIFESTS] + [None]
    assert listed[::2] == [{"_mark": parts[0]["name"]}] * 62


def test_model_files(spark, tmp_path):
    (tmp_path / "m.sql").write_text("-- @description: hi\nselect a AS b -- note\nfrom {{ ref('x') }}")
    (tmp_path / "plain.sql").write_text("select 1")
    found = models.read_model_files(spark, str(tmp_path)).withColumn("path", F.element_at(F.split("path", "/"), -1))
    out = models.analyse_models(found, "p").collect()
    assert [(r["fqn"], r["description"], r["column_comments"]) for r in out] == [("dbt-p.shop.main.m", "hi", {"b": "note"})]


def test_cases_reject_malformed_lines(spark):
    good = spark.createDataFrame([("# note",), ("",), ('{"id": "1", "skill": "s", "gold": {"exact": "x"}}',)], "value string")
    assert rows(cases.parse_cases(good), "id", "skill") == [("1", "s")]
    bad = good.union(spark.createDataFrame([("{oops",)], "value string"))
    with pytest.raises(Exception, match="invalid json"):
        cases.parse_cases(bad).collect()


def test_task_chain_keeps_file_order(spark):
    tasks = spark.createDataFrame([("d", i, f"t{i}") for i in (3, 1, 2)] + [("e", 1, "x")], "dag_id string, ordinal long, task_id string")
    assert rows(exports.task_chain(tasks), "upstream_task", "downstream_task") == [("t1", "t2"), ("t2", "t3")]


# Feedback and evaluation: values of the public test corpus ------------------------------------


def store(spark, data):
    return spark.createDataFrame(
        [(i, *r) for i, r in enumerate(data)], "seq long, skill string, case_key string, pred string, new_payload string, accepted boolean, reason string")


def test_rejected_needs_two(spark):
    f = store(spark, [("q", "q-bad", "p", "n", False, None)] * 3 + [("q", "q-once", "p", None, False, None)])
    assert rows(feedback.latest(f, False, 2), "case_key") == [("q-bad",)]


def test_few_shots_weights(spark):
    f = store(spark, [("q", "good", "p", None, True, None)] + [("q", "bad", "p", "fix", False, "no")] * 2 + [("q", "raw", "p", None, False, None)] * 2)
    assert rows(feedback.few_shots(f), "rank", "weight", "expected", "source") == [
        (1, 100, "p", "feedback_accept"), (2, 70, "fix", "feedback_reject_corrected")]


def test_few_shots_cut(spark):
    f = store(spark, [("s", f"k{i}", "p", None, True, None) for i in range(10)])
    assert feedback.few_shots(f, k=3).count() == 3


GOLD = "exact string, contains array<string>, max_length int, min_length int, must_contain array<string>, must_not_contain array<string>, fqn string, sql_safety string, guards array<string>"


@pytest.mark.parametrize("gold,text,sql,passed,score", [
    ({"exact": "X"}, "X", None, None, 1.0),
    ({"exact": "1"}, "2", None, None, 0.0),
    ({"contains": ["订单", "GMV"]}, "这是一张订单 GMV 汇总表", None, None, 1.0),
    ({"contains": ["订单", "GMV", "用户"]}, "订单 GMV 汇总表", None, None, 2 / 3),
    ({"contains": ["a"], "max_length": 1}, "a long text", None, None, 0.8),
    ({"must_contain": ["orders_daily", "LIMIT"]}, None, "SELECT * FROM orders_daily LIMIT 10", None, 1.0),
    ({"must_not_contain": ["DELETE"]}, None, "DELETE FROM orders_daily", None, 0.0),
    ({"guards": ["schema", "sql_safety", "row_limit"]}, None, None, ["schema", "sql_safety", "row_limit"], 1.0),
    ({"guards": ["schema", "sql_safety", "pii"]}, None, None, ["schema"], 1 / 3),
    ({}, "x", None, None, 0.6),
])
def test_scores(spark, gold, text, sql, passed, score):
    df = spark.createDataFrame([(gold, text, sql, passed)], f"gold struct<{GOLD.replace(' string', ': string').replace(' array', ': array').replace(' int', ': int')}>, pred_text string, pred_sql string, passed_guards array<string>")
    assert evaluation.score_cases(df).first()["score"] == pytest.approx(score)


@pytest.mark.parametrize("avg,passed,base,ok,word", [
    (0.85, 9, None, True, "OK"), (0.5, 5, None, False, "avg_score"), (0.85, 5, None, False, "pass_rate"), (0.75, 8, 0.85, False, "regress"), (0.83, 9, 0.85, True, "OK"),
])
def test_gate(spark, avg, passed, base, ok, word):
    rep = spark.createDataFrame([("s", 10, passed, avg)], "skill string, total int, passed int, avg_score double")
    b = None if base is None else spark.createDataFrame([("s", base)], "skill string, avg_score double")
    r = evaluation.gate(rep, b).first()
    assert r["passed"] is ok and word in r["reason"]


def test_report_takes_upper_median(spark):
    df = spark.createDataFrame([("s", 1.0, x) for x in (10, 20, 30, 40)] + [("t", 0.0, 5)], "skill string, score double, latency_ms long")
    assert rows(evaluation.report(df)) == [("s", 4, 4, 1.0, 30), ("t", 1, 0, 0.0, 5)]


# Review and lineage documents ------------------------------------------------------------------


def test_only_first_decision_counts(spark):
    s = spark.createDataFrame([(1, "pending"), (2, "approved")], "id long, status string")
    d = spark.createDataFrame([(1, 2, "reject", "b"), (1, 1, "approve", "a"), (2, 1, "approve", "a"), (9, 1, "approve", "a")], "id long, seq long, action string, actor string")
    out = review.decide(s, d)
    assert rows(out, "id", "seq", "outcome") == [(1, 1, "applied"), (1, 2, "conflict"), (2, 1, "conflict"), (9, 1, "missing")]
    assert rows(review.reviewed(s, out), "id", "status") == [(1, "approved"), (2, "approved")]


def test_drop_outranked(spark):
    c = spark.createDataFrame([("a", "b", 0.7), ("c", "d", 0.7)], "upstream_column_id string, downstream_column_id string, confidence double")
    e = spark.createDataFrame([("a", "b", 0.95), ("c", "d", 0.7)], c.schema)
    assert rows(lineage.drop_outranked(c, e), "upstream_column_id") == [("c",)]


def test_a_document_for_each_column(spark):
    e = spark.createDataFrame(
        [(1, f"c{i % 3}", "ns", f"t{i}", "f", "direct", None, None) for i in range(500)],
        "downstream_id long, downstream_col string, upstream_namespace string, upstream_name string, upstream_col string, transform_type string, description string, transform_expression string")
    fields = documents.column_lineage_fields(e)
    assert fields.select(F.explode("inputFields")).count() == 500
    t = spark.createDataFrame([(1, "s.d.c.t", "t", None, None), (2, "s.d.c.u", "u", None, None)], "id long, fqn string, name string, description string, ol_namespace string")
    assert rows(documents.dataset_documents(t, fields), "id", "column") == [(1, "c0"), (1, "c1"), (1, "c2"), (2, None)]


def test_registry_refuses_downgrade():
    r = Registry()
    r.add(Entry("a", 2, "g", lambda: None))
    with pytest.raises(ValueError):
        r.add(Entry("a", 1, "g", lambda: None))
    r.add(Entry("a", 3, "g", lambda: None))
    assert r.get("a").version == 3 and r.names("g") == ["a"] and r.names("h") == []


# Streams -----------------------------------------------------------------------------------------


def test_descriptor_stream_over_batches(spark, tmp_path):
    rnd = random.Random(3)
    start = datetime(2024, 1, 1)
    data = [(rnd.choice(["hot", "hot", "a", "b"]), i, start + timedelta(hours=i), rnd.choice("xyz")) for i in range(120)]
    schema = "id string, seq long, mtime timestamp, sha string"
    for n in range(4):
        spark.createDataFrame(data[n * 30:(n + 1) * 30], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        # Stopped and started again for every file, on the same checkpoint.
        descriptors.watch(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    told, want, last = set(), [], {}
    for i, seq, _, sha in data:
        if i in last and last[i] != sha and (i, sha) not in told:
            told.add((i, sha))
            want.append((i, sha, seq))
        last[i] = sha
    assert rows(spark.read.parquet(str(tmp_path / "out")), "id", "sha", "seq") == sorted(want)
    assert rows(descriptors.changes(spark.createDataFrame(data, schema)), "id", "sha", "seq") == sorted(want)


def test_late_versions_are_put_in_place(spark, tmp_path):
    rnd = random.Random(8)
    start = datetime(2024, 1, 1)
    schema = "id string, seq long, mtime timestamp, sha string"
    data = [(rnd.choice(["hot", "hot", "hot", "a", "b"]), i, start + timedelta(hours=rnd.randrange(60), minutes=i % 3), rnd.choice("xyzw")) for i in range(120)]
    data += [("four", i, start + timedelta(days=i), s) for i, s in enumerate("xyzw")]
    late = data[:-4]
    rnd.shuffle(late)
    parts = [late[n::9] + [data[-4 + i] for i in which] for n, which in zip(range(9), [(0, 3), (1, 2), *[()] * 7])]
    parts[5] += parts[2] + [(None, 1, start, "x"), ("a", 999, None, "x"), ("a", 998, start, None)]
    out, known = str(tmp_path / "out"), []
    for n, part in enumerate(parts):
        batch = spark.createDataFrame(part, schema)
        descriptors._absorb(descriptors._whole(batch), n, out, "hour")
        if n in (1, 4):  # the same batch once more, as after a lost driver
            descriptors._absorb(descriptors._whole(batch), n, out, "hour")
        known += part
        if n in (1, 8):
            want = rows(descriptors.changes(spark.createDataFrame(known, schema).dropDuplicates(["id", "seq"])), "id", "sha", "seq", "prev_sha", "mtime")
            assert rows(descriptors.told(spark, out), "id", "sha", "seq", "prev_sha", "mtime") == want
            if n == 1:
                assert [r[:2] + r[3:4] for r in want if r[0] == "four"] == [("four", "w", "z"), ("four", "y", "x"), ("four", "z", "y")]


def test_late_versions_meet_the_days_beside_theirs_only(spark, tmp_path, monkeypatch):
    schema = "id string, seq long, mtime timestamp, sha string"
    day = lambda n, sha, seq=0: ("a", seq, datetime(2024, 1, 1) + timedelta(days=n), sha)
    first = [day(n, f"s{n}") for n in range(20)] + [day(n, f"t{n}", 1) for n in range(20) if n != 9]
    late, out, met = [day(10, "late", 2), day(15, "more", 2), day(17, "once", 2)], str(tmp_path / "out"), []
    linked = descriptors.adjacent_value
    monkeypatch.setattr(descriptors, "adjacent_value", lambda df, *args: met.append(df.count()) or linked(df, *args))
    for n, part in enumerate([first, late, late]):
        descriptors._absorb(spark.createDataFrame(part, schema), n, out, "hour")
    # Three days of two versions, the three late ones, and the versions next to these days: 9, 11, 14, both of 16, 18.
    assert met[:2] == [len(first), 6 + 3 + 6]
    monkeypatch.undo()
    want = descriptors.changes(spark.createDataFrame(first + late, schema))
    assert rows(descriptors.told(spark, out), "id", "sha", "seq", "prev_sha", "mtime") == rows(want, "id", "sha", "seq", "prev_sha", "mtime")
    day_files = list((tmp_path / "out" / "_state" / "versions" / "epoch=0").glob("day=*/*.parquet"))
    assert len(day_files) == 20
    assert not spark.sparkContext._jsc.getPersistentRDDs()


def test_feedback_batches_touch_their_skills(spark, tmp_path):
    from veritab.operators import feedback as ops
    from veritab.streaming import feedback
    rnd = random.Random(2)
    schema = "seq long, skill string, case_key string, pred string, new_payload string, accepted boolean, reason string"
    data = [(i, rnd.choice(["a", "b", "c", None]), f"k{rnd.randrange(12)}", f"p{i}", rnd.choice([None, "", f"n{i}"]), rnd.random() < 0.5, "r") for i in range(200)]
    path = str(tmp_path / "shots")
    (tmp_path / "in").mkdir()
    for n, part in enumerate([data[:120], data[120:199], data[199:]]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        feedback.update_shots(stream, path, str(tmp_path / "cp")).awaitTermination()
    found = lambda df: sorted(map(tuple, df.collect()), key=repr)
    want = found(ops.few_shots(spark.createDataFrame(data, schema)))
    assert found(feedback.shots(spark, path)) == want
    last = [r.epoch for r in spark.read.parquet(f"{path}/shots").select("epoch").distinct().orderBy("epoch").collect()][-1]
    assert {r.skill for r in spark.read.parquet(f"{path}/shots/epoch={last}").collect()} <= {data[-1][1]}
    assert {(r.skill, r.case_key) for r in spark.read.parquet(f"{path}/cases/epoch={last}").collect()} == {data[-1][1:3]}
    # The last batch once more.
    again = ops.by_case(spark.createDataFrame([r for r in data if r[1:3] == data[-1][1:3]], schema))
    feedback._merge(again, last, path, 5, 2)
    assert found(feedback.shots(spark, path)) == want


def test_run_events_accept_and_reject(spark, tmp_path):
    (tmp_path / "in").mkdir()
    good = {"eventType": "complete", "eventTime": "2024-01-01T00:00:00Z", "job": {"namespace": "n", "name": "j"}, "run": {"runId": "r"}}
    bad = [dict(good, eventType="DONE"), dict(good, run={}), dict(good, job={"namespace": "", "name": "j"})]
    (tmp_path / "in" / "e.json").write_text("\n".join(json.dumps(x) for x in [good, *bad]))
    stream = spark.readStream.schema(run_events.RUN_EVENT_SCHEMA).json(str(tmp_path / "in"))
    run_events.ingest(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = run_events.stored(spark, str(tmp_path / "out"))
    assert rows(out.filter("accepted"), "event_type", "run_id", "producer") == [("COMPLETE", "r", "external")]
    assert out.filter("not accepted").count() == 3
    doc = json.loads(run_events.to_documents(out.filter("accepted")).first()["document"])
    assert doc["run"] == {"runId": "r"} and doc["eventTime"] == "2024-01-01T00:00:00.000000Z"


def test_csv_headers_of_odd_files(spark, tmp_path):
    from veritab.sources import files
    (tmp_path / "a.csv").write_bytes(b"\n\r\n \na,\"b,c\", d\r\n1,2,3\n")
    (tmp_path / "b.csv").write_bytes("größe,x\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"\xef\xbb\xbfid")
    got = rows(files.csv_header_columns(spark, str(tmp_path)), "path", "ordinal", "name")
    assert [(p[-5], i, n) for p, i, n in got] == [("a", 0, "a"), ("a", 1, "b,c"), ("a", 2, "d"), ("b", 0, "größe"), ("b", 1, "x"), ("d", 0, "id")]


def test_neighbours_of_rows_without_order(spark):
    from veritab.operators.adjacent import adjacent_value
    df = spark.createDataFrame([("k", None, "a"), ("k", 1, "b"), (None, 2, "c"), (None, 3, "d")], "k string, o long, v string")
    got = adjacent_value(df, "k", F.floor(F.col("o") / 2), ["o"], "v", "prev")
    assert {r.v: r.prev for r in got.collect()} == {"a": None, "b": "a", "c": None, "d": "c"}


def test_wide_findings_and_full_digest(spark):
    from veritab.operators import anomaly
    wide = spark.createDataFrame([(1, f"c{i:02d}", i, False, 0.5, "email", datetime(2024, 1, 2)) for i in range(25)],
                                 "table_id long, name string, ordinal long, nullable boolean, null_ratio double, pii_class string, created_at timestamp")
    for found, field in ((anomaly.null_spike(wide), "affected_columns"), (anomaly.pii_escalation(wide, datetime(2024, 1, 3)), "new_pii_columns")):
        assert len(json.loads(found.first()["details"])[field]) == 25
    failed = spark.createDataFrame([(f"r{i}", "high", "s.d.c.t", "x" * 5000, "m", datetime(2024, 1, 2)) for i in range(100)],
                                   "rule_id string, severity string, table_fqn string, rule string, message string, created_at timestamp")
    sugg = spark.createDataFrame([("pending", datetime(2024, 1, 2))], "status string, created_at timestamp")
    assets = spark.createDataFrame([("s.d.c.t", "active", "critical", None, 10.0)], "fqn string, status string, tier string, description string, health_score double")
    got = anomaly.digest(failed, sugg, assets, datetime(2024, 1, 3)).groupBy("kind").agg(F.sum("n").alias("n"), F.count("*").alias("c"))
    assert {r["kind"]: (r["n"], r["c"]) for r in got.collect()} == {
        "quality_failed": (100, 100), "quality_failed_total": (100, 1), "pending_suggestions": (1, 1), "critical_no_description": (1, 1), "low_health": (1, 1)}


def test_bad_event_times_are_rejected(spark):
    good = ("START", "2024-01-01T00:00:00Z", None, None, ("n", "j"), ("r",), [("n", "d", {"k": "v"})], None, None, {"o": "1"})
    df = spark.createDataFrame([good, ("START", "yesterday", *good[2:]), ("START", None, *good[2:])], run_events.RUN_EVENT_SCHEMA)
    got = run_events.checked(df, F.lit(datetime(2024, 5, 5))).collect()
    assert [r.reason for r in got] == ["", "invalid eventTime: yesterday", ""]
    assert got[1].event_time is None and got[2].event_time == datetime(2024, 5, 5)
    assert got[0].job_facets == {"o": "1"} and got[0].inputs[0].facets == {"k": "v"}


def test_long_glossary_texts(spark):
    text = "x" * 30_000 + " Gross Margin " + "y" * 30_000
    assets = spark.createDataFrame([(i, "s.d.c.t", text) for i in range(20)], "id long, fqn string, description string")
    terms = spark.createDataFrame([("g", "gross margin", ["gm", "m"]), ("h", "net", None)], "id string, name string, synonyms array<string>")
    assert rows(lineage.glossary_matches(assets, terms), "table_id", "term_id", "confidence") == [(i, "g", 0.7) for i in range(20)]


def test_rules_fail_by_themselves(spark):
    from datetime import datetime
    name, other = "a.b.c.orders", "a.b.d.orders"
    df = spark.createDataFrame([(1, {"k": "v"}), (2, None)], "x int, m map<string,string>")
    rules = [quality.Rule("map", name, "distinct", {"column": "m"}), quality.Rule("ok", name, "volume", {"min": "2", "max": 2.0}),
             quality.Rule("bad", name, "volume", {"min": {}}), quality.Rule("empty", name, "null_ratio", {"column": "x", "threshold": ""}),
             quality.Rule("with", name, "custom", {"sql": "WITH orders2 AS (SELECT * FROM orders) SELECT * FROM orders2 WHERE x > 1; -- end"}),
             quality.Rule("own", name, "custom", {"sql": "SELECT * FROM extra_rows"}),
             quality.Rule("slow", name, "custom", {"sql": "SELECT count(*) AS n FROM range(0, 1000000000000, 1, 1) WHERE hash(id) = 7"})]
    out = quality.run_rules(spark, {name: df}, rules, datetime(2024, 1, 1), views={"extra_rows": df.limit(0)}, seconds=8)
    got = {r.rule_id: (r.passed, r.observed, r.message) for r in out.collect()}
    assert got["map"][:2] == (True, 1.0) and got["ok"][:2] == (True, 2.0) and got["bad"] == (False, None, "bad min: {}")
    assert got["empty"][:2] == (True, 0.0) and got["with"][:2] == (False, 1.0) and got["own"][:2] == (True, 0.0)
    assert got["slow"] == (False, None, "sql: stopped after 8 s")
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("veritab_")]
    # A last part that two tables share names neither.
    out = quality.run_rules(spark, {name: df, other: df}, [quality.Rule("two", name, "custom", {"sql": "SELECT * FROM orders"})], datetime(2024, 1, 1))
    assert "TABLE_OR_VIEW_NOT_FOUND" in out.first().message


def test_custom_rules_run_side_by_side(spark, monkeypatch):
    import threading
    from datetime import datetime
    meeting = threading.Barrier(4, timeout=60)
    counted = quality._counted

    def together(*args):
        meeting.wait()  # passes only when four queries are under way
        return counted(*args)

    monkeypatch.setattr(quality, "_counted", together)
    rules = [quality.Rule(f"r{i}", "a.b.c.t", "custom", {"sql": f"SELECT * FROM t WHERE x = {i}"}) for i in range(8)]
    out = quality.run_rules(spark, {"a.b.c.t": spark.range(5).toDF("x")}, rules, datetime(2024, 1, 1), at_once=4)
    assert {r.rule_id: r.observed for r in out.collect()} == {f"r{i}": float(i < 5) for i in range(8)}


def test_refresh_works_on_changed_pairs_only(spark):
    from veritab.operators import lineage
    assets = spark.createDataFrame([(i, f"w.d.c.t{i}") for i in range(6)], "id long, fqn string")
    cols = [(f"{t}:{c}", t, c, "int") for t in range(6) for c in "ab"]
    column = "id string, table_id long, name string, data_type string"
    edge = "upstream_id long, downstream_id long, job_id string, component string, pipeline_stage string, sql string"
    sql = "select t0.a as a, t0.b as b from t0"
    links = [(0, 1, "j", None, None, sql), (0, 2, "j", None, None, sql), (3, 4, None, None, None, None), (4, 5, None, None, None, None), (0, 5, "k", None, None, sql)]
    old = spark.createDataFrame(links, edge), assets, spark.createDataFrame(cols, column)
    marks, inferred = lineage.edge_marks(*old), lineage.infer_column_edges(*old)
    again = lineage.refresh_column_edges(*old, marks, inferred)
    assert again["changed"].count() == 0 and rows(again["column_edges"].drop("component", "pipeline_stage")) == rows(inferred.drop("component", "pipeline_stage"))
    # Table 4 has one more column, an edge is gone, another has other text.
    new = (spark.createDataFrame([*links[:1], (0, 2, "j", None, None, "select t0.a as b from t0"), *links[2:4]], edge), assets,
           spark.createDataFrame([*cols, ("4:z", 4, "z", "int"), ("3:z", 3, "z", "int")], column))
    got = lineage.refresh_column_edges(*new, marks, inferred)
    assert rows(got["changed"]) == [(0, 2), (3, 4), (4, 5)]
    found = lambda df: rows(df, "upstream_column_id", "downstream_column_id", "transform_type", "job_id", "confidence", "source")
    assert found(got["column_edges"]) == found(lineage.infer_column_edges(*new))
    assert rows(got["marks"]) == rows(lineage.edge_marks(*new))


def test_a_statement_of_many_edges_is_parsed_once(spark):
    from veritab.operators import lineage
    edges = spark.range(50).selectExpr("id as upstream_id", "id + 1 as downstream_id", "case when id % 2 = 0 then 'select t.a as x from t' else 'select 1' end as sql")
    assert rows(lineage.statement_refs(edges), "downstream_col", "upstream_table", "upstream_col") == [("x", "t", "a")]


def test_components_of_a_chain_take_few_rounds(spark):
    rnd = random.Random(9)
    names = list(range(1000))
    rnd.shuffle(names)
    pairs = list(zip(names, names[1:])) + [(2000 + i, 2001 + i % 3) for i in range(5)] + [(5000, 6000 + i) for i in range(400)] + [(7000, 7000)]
    pairs += [(rnd.randrange(8000, 8100), rnd.randrange(8000, 8100)) for _ in range(70)]
    labels, rounds = graph.component_labels(edge_table(spark, pairs))
    least = {}
    for a, b in pairs:
        if a != b:
            x, y = least.setdefault(a, {a}), least.setdefault(b, {b})
            if x is not y:
                x |= y
                least.update((n, x) for n in y)
    assert rows(labels, "id", "label") == sorted((n, min(group)) for n, group in least.items())
    assert rounds <= 16


def test_hops_read_the_folders_of_their_frontier(spark):
    pairs = [(i, i + 1) for i in range(300)] + [(10_000, 20_000 + i) for i in range(500)]
    index = graph.Adjacency.of(graph._both_ways(edge_table(spark, pairs)))
    frontier, seen = graph.materialize_observed(spark.createDataFrame([(7,), (8,)], "id long"), "front", **graph.Adjacency.seen("id"))
    near = index.near(frontier, seen)
    assert rows(near) == [(6,), (7,), (8,), (9,)]
    plan = near._jdf.queryExecution().executedPlan().toString()
    assert "bucket#" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert "GreaterThanOrEqual(a,7)" in plan and "LessThanOrEqual(a,8)" in plan
    # Nothing reached is no folder at all.
    empty, none = graph.materialize_observed(frontier.limit(0), "front", **graph.Adjacency.seen("id"))
    assert none["n"] == 0 and index.near(empty, none).count() == 0


@pytest.mark.parametrize("letters", [4_000_000, 40])
def test_contained_phrases(spark, letters):
    from veritab.operators import lineage
    rnd = random.Random(4)
    phrases = ["a", "ab", "abc", "bca", "é ü", "net revenue", "revenue", "x\ny", None, "", "zz"] + ["".join(rnd.choice("abcé ") for _ in range(rnd.randint(1, 5))) for _ in range(40)]
    texts = [None, "", "net revenue of é ü", "x\ny"] + ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(0, 60))) for _ in range(60)] + ["ab" * 20_000]
    out = lineage.contained_phrases(spark.createDataFrame(list(enumerate(texts)), "id long, text string"),
                                    spark.createDataFrame([(p,) for p in phrases], "phrase string"), letters)
    assert rows(out) == sorted({(i, p) for i, t in enumerate(texts) for p in phrases if p and t and p in t})
    none = spark.createDataFrame([(None,)], "phrase string")
    assert lineage.contained_phrases(spark.createDataFrame([(1, "x")], "id long, text string"), none).count() == 0


def test_glossary_shuffles_only_the_best(spark):
    """Texts with many terms, a table in two texts, equal scores, and phrases dealt to several automata."""
    names = [f"w{i:02d}" for i in range(40)]
    terms = spark.createDataFrame([(n, n, ["syn" + n]) for n in names] + [("z", "zz", ["w00"])], "id string, name string, synonyms array<string>")
    assets = spark.createDataFrame([(1, " ".join(names[5:]), None), (1, "synw03 w39", ""), (2, "synw07 synw01", "w00"), (3, None, None)],
                                   "id long, fqn string, description string")
    want = [(1, "w03", 0.7), (1, "w05", 0.7), (1, "w06", 0.7), (2, "w00", 0.7), (2, "w01", 0.7), (2, "w07", 0.7)]
    for letters in (10, 4_000_000):
        assert rows(lineage.glossary_matches(assets, terms, letters=letters), "table_id", "term", "confidence") == want
    base = assets.selectExpr("id as table_id", "lower(fqn) as text")
    known = spark.createDataFrame([(n, n, n, 0.7) for n in names], "phrase string, id string, term string, score double")
    assert lineage.contained_phrases(base, known, best=3).count() <= 3 * 4


def test_no_side_of_dataset_names_is_broadcast(spark):
    from veritab.sources import exports

    datasets = spark.createDataFrame([(1, "db", None, "t"), (1, "db", "s", "t"), (None, "db", "s", "u")], "id long, database string, schema_name string, table_name string")
    assets = spark.createDataFrame([(7, "clickhouse-prod.db.s.t"), (8, "ch-shop_dw.shop.default.t"), (None, None)], "id long, fqn string")
    out = exports.resolve_datasets(datasets, assets)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and rows(out, "dataset_id", "fqn", "table_id") == [(1, "ch-shop_dw.shop.default.t", 8)]
    charts = spark.createDataFrame([(5, 1), (6, 9), (7, None)], "id long, dataset_id long")
    edges = exports.bi_edges(charts, datasets, out, "bi")
    assert "Broadcast" not in edges._jdf.queryExecution().executedPlan().toString() and edges.count() == 2


def test_equal_names_travel_as_hashes(spark):
    pairs = spark.createDataFrame([(1, 2, "j"), (1, 2, "k"), (2, 1, None), (1, 3, "j"), (None, 1, "j")], "upstream_id long, downstream_id long, job_id string")
    columns = spark.createDataFrame([("a", 1, "x"), ("b", 1, "x"), ("c", 2, "x"), ("d", 2, None), ("e", 1, None), ("f", 2, "y"), ("g", None, "x")],
                                    "id string, table_id long, name string")
    out = lineage.equal_names(pairs, columns, {"id": "u"}, {"id": "v"})
    assert sorted((r.upstream_id, r.downstream_id, r.job_id or "", r.column_name, r.u, r.v) for r in out.collect()) == [
        (1, 2, "j", "x", "a", "c"), (1, 2, "j", "x", "b", "c"), (1, 2, "k", "x", "a", "c"), (1, 2, "k", "x", "b", "c"),
        (2, 1, "", "x", "c", "a"), (2, 1, "", "x", "c", "b")]
    assert "map_zip_with" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_texts_of_few_bytes_are_spread(spark):
    from veritab.session import spread
    from veritab.sources import models

    ids = spread(spark.range(800).coalesce(1)).selectExpr("id", "spark_partition_id() as p")
    assert ids.select("p").distinct().count() == 8 and ids.select("id").distinct().count() == 800
    files = spark.createDataFrame([("models/a/m.sql", "select 1 from {{ ref('x') }}"), ("models/b.sql", "select 1")], "path string, content string")
    out = models.analyse_models(files, "demo")
    # Texts are read once: no filter over them stands below.
    assert "Filter" not in out._jdf.queryExecution().optimizedPlan().toString() and [r.path for r in out.collect()] == ["models/a/m.sql"]


def test_similar_tables_without_a_shuffle_of_edges(spark):
    """Each edge once, whether both tables are in the focus or a table is listed twice; distinct only for tables of several names."""
    focus = spark.createDataFrame([(1,), (2,), (2,), (None,)], "id long")
    base = [(1, "a.b.c.stg_red_bolt"), (2, "a.b.c.fct_red_bolt"), (3, "a.b.c.dim_red_bolt"), (3, "a.b.c.dim_red_bolt"), (None, "a.b.c.dim_red_bolt"), (4, "a.b.c.x_nut_cap")]
    once = lineage.similar_tables(spark.createDataFrame(base, "id long, fqn string"), focus)
    want = [(1, 2, 0.9), (1, 3, 0.9), (2, 3, 0.9)]
    assert rows(once, "upstream_id", "downstream_id", "confidence") == want
    assert "Aggregate [upstream_id" not in once._jdf.queryExecution().optimizedPlan().toString()
    twice = lineage.similar_tables(spark.createDataFrame(base + [(3, "a.b.c.dwd_red_bolt")], "id long, fqn string"), focus)
    assert rows(twice, "upstream_id", "downstream_id", "confidence") == want


def _similar_pairs(tables, focus=None):
    """Brute force over <id, name>: edges of tables whose names share enough tokens."""
    up, down, out = {"stg", "ods", "src", "raw"}, {"fct", "dim", "dwd", "dws", "ads", "mart"}, set()
    known = sorted({(i, n) for i, n in tables if i is not None and n is not None}, key=str)
    tokens = {n: set(re.findall("[a-z0-9]{3,}", re.sub("^(stg|ods|dwd|dws|ads|fct|dim)_", "", n))) for _, n in known}
    for (a, m), (b, n) in itertools.permutations(known, 2):
        shared, either = tokens[m] & tokens[n], tokens[m] | tokens[n]
        if a < b and either and len(shared) / len(either) >= 0.4 and (focus is None or a in focus or b in focus):
            back = m.split("_")[0] in down and n.split("_")[0] in up
            out.add((b, a) if back else (a, b))
    return out


def _names(spark, tables):
    return spark.createDataFrame([(i, None if n is None else f"a.b.c.{n}") for i, n in tables], "id long, fqn string")


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_similar_tables_of_all_tables(spark, block):
    """F1 F7: without a focus no pair is left out, however tables are dealt to blocks."""
    rnd = random.Random(3)
    tables = [(i, "_".join([rnd.choice(["stg", "fct", "abc"]), *rnd.choices(["order", "user", "item", "risk"], k=rnd.randint(1, 3))])) for i in range(40)]
    tables += [(1, "ods_order_item"), tables[5], (None, "stg_order"), (90, None), (91, "x"), (92, "stg_a_b")]
    df = _names(spark, tables)
    for focus in (None, {1, 5, 6, 91}):
        chosen = None if focus is None else spark.createDataFrame([(i,) for i in focus], "id long")
        got = rows(lineage.similar_tables(df, chosen, block=block), "upstream_id", "downstream_id")
        # Table 1 has two names, so that an edge may come with two confidences.
        assert sorted(set(got)) == sorted(_similar_pairs(tables, focus))
        plain = [r for r in got if 1 not in r]
        assert len(plain) == len(set(plain))


def test_similar_tables_of_one_name_are_spread(spark):
    """all tables of a name were paired in one task."""
    out = lineage.similar_tables(_names(spark, [(i, "stg_order_item") for i in range(400)]), block=50)
    found = out.groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert sum(r["count"] for r in found) == 400 * 399 // 2 and len(found) == 8
    assert max(r["count"] for r in found) < 400 * 399 // 6


@pytest.fixture()
def small_catalog(spark, tmp_path):
    """Four tables of one name without rules, of which two share a column."""
    parts = [(i, "red bolt", "Brand#12", "SMALL TIN", 5, 1.0) for i in (10, 11, 12, 13)] + [(14, "blue nut", "Brand#12", "SMALL TIN", 5, 1.0)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(1,)], "s_suppkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    lines = [(1, 10, 7), (2, 11, 7), (3, 12, 8), (4, 13, 9), (5, 14, 7)]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def test_similar_names_cover_tables_without_rules(spark, small_catalog):
    """F6 F7: pairs were left out whose tables have no rule."""
    from veritab.plans import q_lineage

    # 10 is fct, 11 dim, 12 stg, 13 ods.
    got = rows(q_lineage.j7_similar_tables(spark, small_catalog), "upstream_id", "downstream_id", "confidence")
    assert got == [(10, 11, 0.9), (12, 10, 0.9), (12, 11, 0.9), (12, 13, 0.9), (13, 10, 0.9), (13, 11, 0.9)]
    counts = rows(q_lineage.g7_bulk_with_similar_names(spark, small_catalog), "source", "transform_type", "n")
    assert counts == [("lineage_to_column", "direct", 1)]


def _exchanges(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    return sum("Exchange hashpartitioning(" in x and "ReusedExchange" not in x for x in plan)


def test_columns_are_shuffled_once(spark):
    """F3 F4 F5: each end of each step shuffled all columns again, and edges went through a shuffle for each of their ends twice."""
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        columns = spark.createDataFrame([(f"{t}:{n}", t, n, "String") for t in range(6) for n in ("a", "b", f"own{t}")] + [("x", None, "a", None), ("y", 2, None, None), ("0:a2", 0, "a", "Date")],
                                        "id string, table_id long, name string, data_type string")
        pairs = spark.createDataFrame([(0, 1), (1, 2), (0, 9)], "upstream_id long, downstream_id long")
        out = lineage.equal_names(pairs, columns, {"id": "u", "data_type": "t"}, {"id": "v"})
        # The columns, and the pairs on their way to the one table, the other, and back.
        assert _exchanges(out) <= 4
        assert rows(out, "u", "t", "v") == [("0:a", "String", "1:a"), ("0:a2", "Date", "1:a"), ("0:b", "String", "1:b"), ("1:a", "String", "2:a"), ("1:b", "String", "2:b")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_names_of_one_hash_are_told_apart(spark):
    """F3 F4 F5: names travel as 16-bit hashes; 600 names have some that share one."""
    columns = spark.createDataFrame([(f"{t}:n{i}", t, f"n{i}") for t in (1, 2) for i in range(600) if i % 2 == t % 2 or i % 50 == 0], "id string, table_id long, name string")
    pairs = spark.createDataFrame([(1, 2)], "upstream_id long, downstream_id long")
    out = lineage.equal_names(pairs, columns, {"id": "u"}, {"id": "v"})
    assert rows(out, "u", "v") == sorted((f"1:n{i}", f"2:n{i}") for i in range(0, 600, 50))


def test_bulk_inference_matches_names_once(spark, monkeypatch):
    """F2 F4: inference and name matching each met all columns of all edges."""
    calls = []
    met = lineage.equal_names
    monkeypatch.setattr(lineage, "equal_names", lambda *a: calls.append(1) or met(*a))
    assets = _names(spark, [(1, "stg_a_order"), (2, "fct_b_order")])
    columns = spark.createDataFrame([("1:x", 1, "x", "Int"), ("2:x", 2, "x", "Int"), ("?", 1, "y", "Int"), (None, 2, "y", "Int")], "id string, table_id long, name string, data_type string")
    edges = spark.createDataFrame([(1, 2, None, None, None, None)], "upstream_id long, downstream_id long, sql string, job_id string, component string, pipeline_stage int")
    existing = spark.createDataFrame([], "upstream_column_id string, downstream_column_id string, transform_type string, job_id string, confidence double")
    out = assembly.bulk_column_inference(assets, columns, edges, existing)["column_edges"]
    assert len(calls) == 1
    # A column without id outranks nothing, so both of its edges stay.
    assert sorted((r.upstream_column_id, r.downstream_column_id or "", r.job_id, r.confidence) for r in out.collect()) == [
        ("1:x", "2:x", "lineage_to_column:unknown", 1.0), ("?", "", "lineage_to_column", 0.7), ("?", "", "lineage_to_column:unknown", 1.0)]
