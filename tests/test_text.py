"""Scalar rules on values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from veritab.functions import describe, documents, names, pii, sqlread, sqltext


def one(spark, expr, **values):
    schema = ", ".join(f"{k} string" for k in values) or "z string"
    df = spark.createDataFrame([tuple(values.values()) or ("",)], schema)
    return df.select(expr.alias("r")).first()["r"]


def lit(spark, fn, text):
    return one(spark, fn(F.col("t")), t=text)


@pytest.mark.parametrize("glob,name,hit", [
    ("*", "x", True), ("stg_*", "stg_a", True), ("stg_*", "a_stg_", False), ("a?c", "abc", True), ("a?c", "ac", False),
    ("[ab]x", "bx", True), ("[!ab]x", "bx", False), ("[!ab]x", "cx", True), ("a.b", "axb", False), ("a+b", "a+b", True),
])
def test_glob(spark, glob, name, hit):
    assert lit(spark, lambda c: names.glob_match(c, [glob]), name) is hit


def test_glob_exclude_wins(spark):
    assert lit(spark, lambda c: names.glob_match(c, ["a*"], ["*z"]), "abz") is False
    assert lit(spark, lambda c: names.glob_match(c), "anything") is True


@pytest.mark.parametrize("fqn,parts", [
    (" Svc.DB.Sch.Tab ", ("svc", "db", "sch", "tab")), ("svc.sch.tab", ("svc", "default", "sch", "tab")),
    ("tab", ("tab", "default", "default", "tab")),
])
def test_split_fqn(spark, fqn, parts):
    assert tuple(lit(spark, names.split_fqn, fqn)) == parts


@pytest.mark.parametrize("ref,full", [
    ("t", "s.d.c.t"), ("x.t", "s.d.x.t"), ("b.x.t", "s.b.x.t"), ("A.b.x.T", "a.b.x.t"), ("`x`.`t`", "s.d.x.t"),
])
def test_resolve_reference(spark, ref, full):
    got = lit(spark, lambda c: names.resolve_reference(c, F.lit("s"), F.lit("d"), F.lit("c")), ref)
    assert got == full


def test_team(spark):
    assert lit(spark, names.team_of, "prod-shop.d.s.t") == "data-shop"
    assert lit(spark, names.team_of, "wh.d.s.fct_x") == "data-engineering"
    assert lit(spark, names.team_of, "wh.d.s.ods_x") == "data-platform"
    assert lit(spark, names.team_of, "") == "unknown"


# Values of the public test corpus: a write is refused, two statements are refused,
# a keyword in a comment is not, and a limit is added.
@pytest.mark.parametrize("sql,allowed", [
    ("SELECT 1 FROM t", True), ("DELETE FROM t", False), ("SELECT 1; SELECT 2", False), ("SELECT 1 -- delete", True),
    ("SELECT 1 /* drop */ FROM t;", True), ("", False), ("SHOW TABLES", False), ("SELECT 1 UNION SELECT 2", False),
    ("WITH a AS (SELECT 1 UNION SELECT 2) SELECT * FROM a", True),
])
def test_safety(spark, sql, allowed):
    assert lit(spark, sqltext.safety_verdict, sql)["allowed"] is allowed


@pytest.mark.parametrize("sql,limited", [
    ("SELECT * FROM t", "SELECT * FROM t LIMIT 1000"), ("SELECT * FROM t LIMIT 5;", "SELECT * FROM t LIMIT 5"),
    ("SELECT * FROM t limit 99999", "SELECT * FROM t LIMIT 1000"),
    ("SELECT * FROM (SELECT 1 LIMIT 5)", "SELECT * FROM (SELECT 1 LIMIT 5) LIMIT 1000"),
])
def test_limit(spark, sql, limited):
    assert lit(spark, sqltext.clamp_limit, sql)["sql"] == limited


def test_hide_nested_restores(spark):
    text = "a (b, 'c)d', (e)) , f 'g,h' i"
    hidden = lit(spark, sqltext.hide_nested, text)
    assert len(hidden) == len(text)
    assert hidden.count(",") == 1 and hidden.count("(") == 1
    assert lit(spark, lambda c: sqltext.show_hidden(sqltext.hide_nested(c)), text) == text


def test_references_in_order(spark):
    sql = "SELECT * FROM b.x JOIN a ON 1 JOIN b.x ON 2; UPDATE c.d.e SET x = 1"
    assert lit(spark, sqltext.table_references, sql) == ["b.x", "a", "c.d.e"]


@pytest.mark.parametrize("sql,target,sources", [
    ("INSERT INTO a.b.c.sink SELECT x FROM d.e.f.src s WHERE y > 1", "a.b.c.sink", ["d.e.f.src"]),
    ("CREATE TABLE IF NOT EXISTS t2 AS SELECT * FROM t1", "t2", ["t1"]),
    ("SELECT ' from z ' FROM t -- join w", None, ["t"]),
])
def test_targets(spark, sql, target, sources):
    assert lit(spark, sqltext.write_target, sql) == target
    assert lit(spark, sqltext.statement_sources, sql) == sources


def test_select_items(spark):
    sql = "INSERT INTO k SELECT DISTINCT u.a, f(u.b, g(v.c)) AS d, u.e e2, 'x, y' AS s FROM up u LEFT JOIN w.v AS v ON u.i = v.i"
    items = lit(spark, sqltext.select_items, sql)
    assert [(i["body"], i["name"]) for i in items] == [("u.a", "a"), ("f(u.b, g(v.c))", "d"), ("u.e", "e2"), ("'x, y'", "s")]
    assert lit(spark, sqltext.alias_map, sql) == {"u": "up", "v": "v"}


def test_column_refs_follow_aliases(spark):
    df = spark.createDataFrame([("SELECT u.a AS x, sum(u.b + v.c) AS y, plain FROM up u JOIN v ON 1",)], "sql string")
    got = {tuple(r) for r in sqltext.select_column_refs(df).select(
        "downstream_col", "transform_type", "upstream_table", "upstream_col").collect()}
    assert got == {("x", "direct", "up", "a"), ("y", "aggregation", "up", "b"), ("y", "aggregation", "v", "c")}


def test_column_refs_of_all_branches(spark):
    df = spark.createDataFrame([("SELECT u.a AS x FROM up u, v w UNION ALL SELECT w.b FROM (SELECT 1) s, v w",)], "sql string")
    got = {tuple(r) for r in sqltext.select_column_refs(df).select("downstream_col", "upstream_table", "upstream_col").collect()}
    assert got == {("x", "up", "a"), ("x", "v", "b")}


@pytest.mark.parametrize("sql,words", [
    ("SELECT e.email, f(phone) AS ssn FROM email e, ssn WHERE 'address' = \"ID\" -- dob", {"select", "email", "phone", "where", "id"}),
    ("SELECT name FROM a.name n JOIN b ON n.id = b.id", {"select", "name", "on", "id"}),
])
def test_words_that_can_be_columns(spark, sql, words):
    assert set(lit(spark, sqltext.referenced_words, sql)) == words


def test_ref_with_two_arguments(spark):
    text = "select * from {{ ref('p', \"m\") }} {# kept #} join {{ source(s, t) }} {{ other() }} {%- if a > '}' %}x{% endif %}{"
    assert lit(spark, sqltext.plain_sql, text) == "select * from m {# kept #} join t {{ other() }} x{"


def test_long_texts(spark):
    literal = "SELECT '" + "x''y" * 20_000 + "' AS a, b FROM t /* " + "c" * 50_000 + " */ WHERE " + "(" * 30 + "a" + ")" * 30
    assert lit(spark, sqltext.safety_verdict, literal)["allowed"] is True
    assert lit(spark, sqltext.table_references, literal) == ["t"]


def test_plain_sql(spark):
    text = "{{ config(materialized='table') }}\nselect * from {{ ref('a') }} join {{ source('s','t') }}{% if x %} where d={{ var('v') }}{% endif %}"
    assert lit(spark, sqltext.plain_sql, text) == "select * from a join t where d='v'"


@pytest.mark.parametrize("name,meaning", [
    ("ID", "主键 / 外键 ID"), ("order_id", "主键 / 外键 ID"), ("created_at", "时间戳 (创建/更新时间, UTC)"), ("user_email", "邮箱地址 (PII)"),
    ("nothing", None), ("is_", "布尔标志位 (0/1 或 true/false)"), ("is_new", None),
])
def test_name_rule(spark, name, meaning):
    assert lit(spark, lambda c: describe.name_rule(c)["meaning"], name) == meaning


def test_value_rule_is_sample_major(spark):
    df = spark.createDataFrame([([None, "zzz", "US", "a@b.co"],), ([],), (["x", "x", "x", "x", "x", "US"],)], "s array<string>")
    got = [r[0] for r in df.select(describe.value_rule(F.col("s"))["meaning"]).collect()]
    assert got == ["ISO 3166-1 alpha-2 国家代码", None, None]


def test_value_scan_counts_words(spark):
    df = spark.createDataFrame([("mail (a@b.com), a@b.com 1.2.3.4 on 2024-01-02T00 DE",), ("13912345678.",), ("nothing",)], "t string")
    got = {r["meaning"]: (r["words"], r["rows_hit"]) for r in describe.value_pattern_scan(df, "t").collect()}
    assert got["邮箱格式 (PII)"] == (2, 1) and got["IPv4 地址 (PII)"] == (1, 1)
    assert got["中国手机号 (11 位, PII)"] == (1, 1) and got["ISO 8601 日期"] == (1, 1) and got["MD5 哈希"] == (0, 0)


@pytest.mark.parametrize("policy,value,masked", [
    ("none", "abcdef", "abcdef"), ("partial", "abcdef", "ab**ef"), ("partial", "abcd", "****"), ("full", "abc", "***"), ("full", None, None),
])
def test_mask(spark, policy, value, masked):
    assert lit(spark, lambda c: pii.mask(c, policy), value) == masked


@pytest.mark.parametrize("cls,tier", [("ssn", "high"), ("dob", "medium"), ("other", "low"), ("none", "none"), ("", "none")])
def test_risk(spark, cls, tier):
    assert lit(spark, pii.risk_tier, cls) == tier


@pytest.mark.parametrize("content,description,confidence", [
    ('```json\n{"description": "d", "confidence": 0.8, "tier": "critical"}\n```', "d", 0.8),
    ('Sure {"description": "d", "confidence": 0.3} bye', "d", 0.3), ("no json", "no json", 0.4), ("{broken", "{broken", 0.4),
])
def test_model_reply(spark, content, description, confidence):
    r = lit(spark, documents.model_reply, content)
    assert (r["description"], r["confidence"]) == (description, confidence)


@pytest.mark.parametrize("text,value", [("0.3", 0.3), ("7", 1.0), ("-1", 0.0), ("x", 0.5), (None, 0.5), ("0", 0.5)])
def test_clamp(spark, text, value):
    assert lit(spark, documents.clamp_confidence, text) == value


def test_openlineage_type(spark):
    assert tuple(lit(spark, documents.openlineage_type, "rename")) == ("DIRECT", "RENAME")
    assert tuple(lit(spark, documents.openlineage_type, "join")) == ("TRANSFORMATION", "JOIN")


def test_sample_preview(spark):
    df = spark.createDataFrame([(["a", None, "x" * 41, "b", "c", "d"],), (None,)], "s array<string>")
    got = [r[0] for r in df.select(describe.sample_preview(F.col("s"))).collect()]
    assert got == ["[a, null, " + "x" * 40 + "…, b, c]", "(无样本)"]


@pytest.mark.parametrize("sql, n", [
    ("SELECT 'a''b', \"c\" FROM t -- note\nWHERE x", 1), ("SELECT 'a\\b' FROM t", 1), ("SELECT a$b, $1 FROM t", 1),
    ("SELECT 'a\\' FROM t", 2), ("SELECT 1 # x", 2), ("SELECT $a$ ' $a$", 2), ("SELECT q'{'}'", 2), ("", 1)])
def test_views_of_a_text(spark, sql, n):
    seen = lit(spark, sqlread.views, sql)
    assert len({v["text"] for v in seen}) == n


def test_texts_with_many_escapes(spark):
    sql = "SELECT '" + "\\'" * 200_000 + "' FROM t"
    # The even number of quotes closes for readers without escapes as well; what stands between them differs.
    assert lit(spark, lambda c: F.size(sqlread.views(c)), sql) > 1
    assert "t" in lit(spark, sqltext.table_references, sql)


@pytest.mark.parametrize("text, refs, sources, tags, header", [
    ("-- @Description : the model\n{{ config(materialized='table', tags=['a', \"b\"]) }} select * from {{ ref('x') }} join {{ref(\"p\", 'y')}} {{ ref('x') }}"
     " join {{ source('raw', 't') }} {% if ref('z') %}", [("x", "x"), ("p", "y")], [("raw", "t")], ["a", "b"], "the model"),
    ("select 1 -- @description: no\n{{ config(alias='q') }}{{ source('one') }} {{ ref(a, b, c) }}", [], [], [], None),
    ("", [], [], [], None)])
def test_model_tags(spark, text, refs, sources, tags, header):
    assert [tuple(r) for r in lit(spark, sqltext.model_refs, text)] == refs
    assert [tuple(r) for r in lit(spark, sqltext.model_sources, text)] == sources
    assert lit(spark, sqltext.model_tags, text) == tags
    assert lit(spark, sqltext.model_header, text) == header
