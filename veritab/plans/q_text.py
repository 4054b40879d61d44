"""Scalar rules over names, samples, PII, query texts and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from veritab.functions import describe, documents, names, pii, sqltext
from veritab.plans import derived as d
from veritab.plans.derived import LAYERS, load, oracle, pick
from veritab.plans.registry import QUERIES
from veritab.session import spread
from veritab.sources import sinks


def _q(name, sql=None):
    return QUERIES.operator(name, group="text", oracle=sql)


def _chain(text, rules, field):
    value = (lambda m, c: f"'{m}'") if field == "meaning" else (lambda m, c: str(c))
    return "CASE " + " ".join(f"WHEN regexp_matches({text}, '{p}') THEN {value(m, c)}" for p, m, c in rules) + " END"


@_q("x1_name_rules", oracle(
    f"SELECT id, {_chain('lower(name)', describe.NAME_PATTERNS, 'meaning')} AS meaning,"
    f" {_chain('lower(name)', describe.NAME_PATTERNS, 'confidence')} AS confidence FROM cols", "cols"))
def x1_name_rules(spark, root):
    rule = describe.name_rule(F.col("name"))
    return d.columns(spark, root).select("id", rule["meaning"].alias("meaning"), rule["confidence"].alias("confidence"))


@_q("x2_sample_rules", oracle(
    f"SELECT id, {_chain('sample', describe.VALUE_PATTERNS, 'meaning')} AS meaning FROM cols", "cols"))
def x2_sample_rules(spark, root):
    return d.columns(spark, root).select("id", describe.value_rule(F.col("sample_values"))["meaning"].alias("meaning"))


def _scan_sql(table):
    words = (
        "(SELECT list_filter(list_transform(regexp_split_to_array(text, '\\s+'), lambda w: regexp_replace(w, '^[(\\[<\"'']+|[)\\]>\"'',;:.!?]+$', '', 'g')),"
        f" lambda w: w <> '') AS w FROM {table})"
    )
    return " UNION ALL ".join(
        f"SELECT '{m}' AS meaning, sum(len(list_filter(w, lambda x: regexp_matches(x, '{p}')))) AS words,"
        f" count(*) FILTER (WHERE len(list_filter(w, lambda x: regexp_matches(x, '{p}'))) > 0) AS rows_hit FROM t"
        for p, m, _ in describe.VALUE_PATTERNS
    ), words


_DOCS, _DOCW = _scan_sql("documents")


@_q("x2_value_scan_documents", f"WITH t AS {_DOCW} {_DOCS}")
def x2_value_scan_documents(spark, root):
    return describe.value_pattern_scan(load(spark, root, "documents"), "text")


_TALK, _TALKW = _scan_sql("conversations")


@_q("x2_value_scan_conversations", f"WITH t AS {_TALKW} {_TALK}")
def x2_value_scan_conversations(spark, root):
    return describe.value_pattern_scan(load(spark, root, "conversations"), "text")


_HINT = "CASE trim(split_part({c}, '(', 1)) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in describe.TYPE_HINTS.items()) + " ELSE '' END"


@_q("x3_type_hints", oracle(f"SELECT id, {_HINT.format(c='data_type')} AS hint FROM cols", "cols"))
def x3_type_hints(spark, root):
    return d.columns(spark, root).select("id", describe.type_hint(F.col("data_type")).alias("hint"))


_PIIH = "CASE pii_class " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in describe.PII_HINTS.items()) + " ELSE '' END"
INFERRED = (
    "SELECT id, CASE WHEN h <> '' AND pii_confidence >= 0.7 THEN concat(h, ' (PII 分类由 ', coalesce(pii_source, 'unknown'), ' 推断)')"
    " WHEN vm IS NOT NULL THEN concat(vm, ' (基于 2 个样本值)') WHEN nm IS NOT NULL THEN CASE WHEN th <> '' AND NOT contains(nm, th) THEN"
    " concat(nm, ', ', th) ELSE concat(nm, ' (', data_type, ')') END WHEN th <> '' THEN concat(name, ' (', th, ')') ELSE"
    " concat('t', ' 表的 ', name, ' 列 (类型 ', data_type, ')') END AS description, CASE WHEN h <> '' AND pii_confidence >= 0.7 THEN"
    " greatest(0.85, pii_confidence) WHEN vm IS NOT NULL THEN vc WHEN nm IS NOT NULL THEN nc WHEN th <> '' THEN 0.5 ELSE 0.4 END AS confidence,"
    " old_description, old_source FROM"
    f" (SELECT id, name, data_type, pii_confidence, pii_source, description AS old_description, description_source AS old_source, {_PIIH} AS h,"
    f" {_chain('sample', describe.VALUE_PATTERNS, 'meaning')} AS vm, {_chain('sample', describe.VALUE_PATTERNS, 'confidence')} AS vc,"
    f" {_chain('lower(name)', describe.NAME_PATTERNS, 'meaning')} AS nm, {_chain('lower(name)', describe.NAME_PATTERNS, 'confidence')} AS nc,"
    f" {_HINT.format(c='data_type')} AS th FROM cols)"
)


@_q("x4_column_descriptions", oracle(f"SELECT id, description, confidence FROM ({INFERRED})", "cols"))
def x4_column_descriptions(spark, root):
    return describe.describe_columns(d.columns(spark, root), F.lit("t")).select(
        "id", "inferred.description", "inferred.confidence")


def _scored(spark, root):
    """Classifier output, one row per order."""
    return load(spark, root, "orders").selectExpr(
        "o_orderkey as id", f"{pick(['EMAIL', ' phone ', 'none', 'uuid_pseudo', 'zodiac', None], 'o_orderkey')} as pii_class",
        "case when o_custkey % 7 = 0 then null else round(o_totalprice / 500000, 2) end as confidence",
        f"{pick([None, 'partial', 'full', '', None], 'o_custkey')} as masking_policy")


@_q("x5_classify_scored",
    "SELECT * FROM (SELECT id, cls AS pii_class, CASE WHEN coalesce(conf, 0) = 0 THEN 0.5 ELSE conf END AS confidence, CASE WHEN coalesce(mp, '') <> ''"
    " THEN mp WHEN cls IN ('none', 'uuid_pseudo') THEN 'none' ELSE 'hash' END AS masking_policy FROM (SELECT o_orderkey AS id,"
    " (['email', 'phone', 'none', 'uuid_pseudo', 'other', 'other'])[o_orderkey % 6 + 1] AS cls, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE"
    " round(o_totalprice / 500000, 2) END AS conf, ([NULL, 'partial', 'full', '', NULL])[o_custkey % 5 + 1] AS mp FROM orders)) WHERE confidence >= 0.6")
def x5_classify_scored(spark, root):
    return pii.classify_scored(_scored(spark, root))


@_q("x6_risk_tiers", oracle(
    "SELECT CASE WHEN pii_class IN ('email', 'phone', 'address') THEN 'high' WHEN pii_class = 'none' THEN 'none' ELSE 'low' END AS tier,"
    " pii_class, count(*) AS n FROM cols GROUP BY 1, 2", "cols"))
def x6_risk_tiers(spark, root):
    return d.columns(spark, root).groupBy(pii.risk_tier(F.col("pii_class")).alias("tier"), "pii_class").agg(F.count("*").alias("n"))


@_q("x7_keyword_flags", oracle(
    "SELECT id, regexp_matches(lower(name), 'email|phone|ssn|id_card|address') OR contains(lower(coalesce(description, '')), 'pii') AS flagged FROM cols", "cols"))
def x7_keyword_flags(spark, root):
    return d.columns(spark, root).select("id", pii.keyword_flag(F.col("name"), F.col("description")).alias("flagged"))


@_q("x8_text_screen",
    "SELECT doc_id, regexp_matches(text, '1[3-9]\\d{9}') OR regexp_matches(text, '\\d{17}[\\dXx]') AS rejected FROM documents")
def x8_text_screen(spark, root):
    return load(spark, root, "documents").select("doc_id", pii.holds_real_pii(F.col("text")).alias("rejected"))


@_q("x9_layer_direction", oracle(
    "SELECT u AS up_layer, v AS down_layer, CASE WHEN u IN ('stg', 'ods') AND v IN ('fct', 'dim', 'dwd', 'dws') THEN 'forward' WHEN v IN ('stg',"
    " 'ods') AND u IN ('fct', 'dim', 'dwd', 'dws') THEN 'backward' ELSE 'input_order' END AS direction, count(*) AS n FROM (SELECT split_part(a.name, '_', 1)"
    " AS u, split_part(b.name, '_', 1) AS v FROM edges e JOIN assets a ON a.id = e.upstream_id JOIN assets b ON b.id = e.downstream_id) GROUP BY 1, 2",
    "edges", "assets"))
def x9_layer_direction(spark, root):
    layer = names.name_layer(F.col("fqn"))
    a = d.assets(spark, root)
    e = d.edges(spark, root).join(a.select(F.col("id").alias("upstream_id"), layer.alias("up_layer")), "upstream_id").join(
        a.select(F.col("id").alias("downstream_id"), layer.alias("down_layer")), "downstream_id")
    return e.groupBy("up_layer", "down_layer", names.layer_direction(F.col("up_layer"), F.col("down_layer")).alias("direction")).agg(
        F.count("*").alias("n"))


TEAM = (
    "CASE WHEN service LIKE '%shop%' THEN 'data-shop' WHEN service LIKE '%finance%' THEN 'data-finance' WHEN service LIKE '%growth%' THEN"
    " 'data-growth' WHEN service LIKE '%logistics%' THEN 'data-logistics' WHEN service LIKE '%superset%' THEN 'bi-team' WHEN contains(fqn, 'fct_')"
    " OR contains(fqn, 'dim_') OR contains(fqn, 'stg_') THEN 'data-engineering' ELSE 'data-platform' END"
)
CONTACT = "CASE team " + " ".join(f"WHEN '{t}' THEN '{c[0]}'" for t, c in names.TEAM_CONTACTS.items()) + " END"


@_q("x10_teams", oracle(f"SELECT id, team, {CONTACT} AS user_email FROM (SELECT id, {TEAM} AS team FROM assets)", "assets"))
def x10_teams(spark, root):
    team = names.team_of(F.col("fqn"))
    return d.assets(spark, root).select("id", team.alias("team"), names.team_contact(team)["user_email"].alias("user_email"))


@_q("x11_split_names", oracle(
    "SELECT id, service, CASE WHEN id % 2 = 0 THEN database ELSE 'default' END AS database, schema_name, name FROM assets", "assets"))
def x11_split_names(spark, root):
    messy = F.concat(F.lit(" \t"), F.upper(F.when(F.col("id") % 2 == 0, F.col("fqn")).otherwise(
        F.concat_ws(".", "service", "schema_name", "name"))), F.lit(" \n"))
    return d.assets(spark, root).select("id", names.split_fqn(messy).alias("s")).select("id", "s.*")


@_q("x13_table_references", oracle(
    "SELECT query_id, string_agg(r, ',' ORDER BY r) AS refs FROM (SELECT query_id, unnest(list_distinct(regexp_extract_all(sql,"
    " '(?i)\\b(?:from|join|into|update)\\s+((?:[a-zA-Z_]\\w*\\.){0,2}[a-zA-Z_]\\w*)', 1))) AS r FROM sql_log) WHERE r <> 'fake_table' GROUP BY 1", "sql_log"))
def x13_table_references(spark, root):
    refs = F.array_sort(sqltext.table_references(F.col("sql")))
    return d.sql_log(spark, root).select("query_id", F.array_join(refs, ",").alias("refs")).filter("refs <> ''")


@_q("x14_task_evidence", oracle(
    "SELECT query_id, string_agg(r, ',' ORDER BY r) AS refs FROM (SELECT query_id, unnest(list_distinct(list_transform(regexp_extract_all(concat(sql,"
    " ' ; drop TABLE ', tname, '_old'), '(?i)\\b(?:from|join|into|update|table)\\s+([a-zA-Z_][\\w.\"`]*)', 1), lambda t: trim(t, '\"`')))) AS r FROM sql_log) GROUP BY 1", "sql_log"))
def x14_task_evidence(spark, root):
    tail = load(spark, root, "part").selectExpr(
        "p_partkey as query_id", f"concat(' ; drop TABLE ', {pick(LAYERS, 'p_partkey')}, '_', replace(p_name, ' ', '_'), '_old') as tail")
    log = d.sql_log(spark, root).join(tail, "query_id")
    refs = F.array_sort(sqltext.task_table_evidence(F.concat("sql", "tail")))
    return log.select("query_id", F.array_join(refs, ",").alias("refs"))


@_q("x15_targets_and_sources", oracle(
    "SELECT query_id, CASE query_id % 10 WHEN 6 THEN concat('sink_', p_size) END AS target, CASE query_id % 10 WHEN 1 THEN concat(sname, '.', tname)"
    " WHEN 5 THEN CASE WHEN tname < concat('missing_', p_size) THEN concat(tname, ',missing_', p_size) ELSE concat('missing_', p_size, ',', tname) END"
    " WHEN 6 THEN concat('src.', tname) WHEN 7 THEN CASE WHEN tname < 'x' THEN concat(tname, ',x') ELSE concat('x,', tname) END WHEN 9 THEN '' ELSE tname END AS sources FROM sql_log", "sql_log"))
def x15_targets_and_sources(spark, root):
    return d.sql_log(spark, root).select(
        "query_id", sqltext.write_target(F.col("sql")).alias("target"),
        F.array_join(sqltext.statement_sources(F.col("sql")), ",").alias("sources"))


# Select items with the class each must get; @ stands for a column name.
ITEMS = [
    ("@", "direct"), ("u.@", "direct"), ("sum(u.@)", "aggregation"), ("countDistinct(@)", "aggregation"),
    ("groupArray(@)", "aggregation"), ("row_number() OVER (PARTITION BY @ ORDER BY d)", "window"), ("sum(@) over w", "window"),
    ("CAST(@ AS Decimal(10, 2))", "cast"), ("@ + 1", "arithmetic"), ("(a + b) * @", "arithmetic"), ("-@", "arithmetic"),
    ("lower(trim(@))", "function"), ("case when @ > 1 then ''a, b'' else @ end", "derivation"), ("@ > 1", "expression"),
    ("concat(@, '' - '') || ''x''", "expression"), ("''literal''", "expression"),
]


def _item_sql(which, engine="spark"):
    return pick([i[which] for i in ITEMS], "p_partkey", engine)


@_q("x16_transform_kinds",
    f"SELECT p_partkey AS id, {_item_sql(1, 'duck')} AS kind FROM part")
def x16_transform_kinds(spark, root):
    text = f"replace({_item_sql(0)}, '@', concat('c_', p_size))"
    items = load(spark, root, "part").selectExpr("p_partkey as id", f"{text} as item")
    return items.select("id", sqltext.transform_kind(F.col("item")).alias("kind"))


@_q("x18_safety", oracle(
    "SELECT query_id, query_id % 10 NOT IN (2, 3, 6, 9) AS allowed, CASE query_id % 10 WHEN 3 THEN 'multiple statements detected (2)' WHEN 9 THEN"
    " 'only SELECT allowed, got show' WHEN 2 THEN 'DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)' WHEN 6 THEN"
    " 'DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)' ELSE '' END AS reason FROM sql_log", "sql_log"))
def x18_safety(spark, root):
    v = sqltext.safety_verdict(F.col("sql"))
    return d.sql_log(spark, root).select("query_id", v["allowed"].alias("allowed"), v["reason"].alias("reason"))


@_q("x19_limits", oracle(
    "SELECT query_id, CASE query_id % 10 WHEN 1 THEN replace(sql, 'limit 50000', 'LIMIT 1000') WHEN 4 THEN concat('SELECT a FROM ', tname, ' LIMIT 1000') WHEN 5 THEN"
    " replace(sql, '/* update */ ', '') WHEN 8 THEN concat(rtrim(sql, ';'), ' LIMIT 1000')"
    " ELSE concat(sql, ' LIMIT 1000') END AS sql, CASE query_id % 10 WHEN 1 THEN 'clamped LIMIT 50000 -> 1000' WHEN 5 THEN 'LIMIT 20 ok' ELSE 'injected LIMIT' END"
    " AS note FROM sql_log", "sql_log"))
def x19_limits(spark, root):
    v = sqltext.clamp_limit(F.col("sql"))
    return d.sql_log(spark, root).select("query_id", v["sql"].alias("sql"), v["note"].alias("note"))


_MISSING = "CASE query_id % 10 WHEN 5 THEN concat('missing_', p_size) WHEN 6 THEN concat('sink_', p_size) WHEN 7 THEN 'x' END"


@_q("x20_registered_tables", oracle(
    f"SELECT query_id, {_MISSING} IS NULL AS allowed, coalesce({_MISSING}, '') AS missing FROM sql_log", "sql_log"))
def x20_registered_tables(spark, root):
    out = sqltext.unregistered_tables(d.sql_log(spark, root), d.assets(spark, root))
    return out.select("query_id", "allowed", F.array_join("missing", ",").alias("missing"))


# Texts that only a look at literals, quoted names and comments tells apart; @ stands for a table of the
# catalog, # for its full name. With each: is it allowed, what a limit makes of it, and tables not in the catalog.
HARD_TEXTS = [
    ("SELECT '--', 1; DROP TABLE @", False, None, ""),
    ("SELECT '/*' ; DROP TABLE @; SELECT '*/'", False, None, ""),
    ("SELECT 1/**/; DROP/**/TABLE @", False, None, ""),
    ("SELECT a FROM @ WHERE b = 'open", False, None, ""),
    ("SELECT '\\' ; DROP TABLE @; -- '", False, None, ""),
    ("SELECT 'please delete me' AS a FROM @", True, "SELECT 'please delete me' AS a FROM @ LIMIT 1000", ""),
    ("SELECT ';' AS a, 'it''s' AS \"drop\" FROM @", True, "SELECT ';' AS a, 'it''s' AS \"drop\" FROM @ LIMIT 1000", ""),
    ("SELECT a FROM @ -- note", True, "SELECT a FROM @ LIMIT 1000", ""),
    ("SELECT a FROM @ LIMIT 50000 OFFSET 5", True, "SELECT a FROM @ LIMIT 1000 OFFSET 5", ""),
    ("SELECT a FROM @ LIMIT 5, 50000 /* end */", True, "SELECT a FROM @ LIMIT 5, 1000", ""),
    ("SELECT a FROM @ OFFSET 2 ROWS FETCH NEXT 50000 ROWS ONLY", True, "SELECT a FROM @ OFFSET 2 ROWS FETCH NEXT 1000 ROWS ONLY", ""),
    ("SELECT a FROM # u", True, "SELECT a FROM # u LIMIT 1000", ""),
    ("SELECT a FROM `secret`.`t t`", True, "SELECT a FROM `secret`.`t t` LIMIT 1000", "secret.t t"),
    ("SELECT a FROM \"secret\"", True, "SELECT a FROM \"secret\" LIMIT 1000", "secret"),
    ("SELECT f(a, b) x, y FROM @, secret s, (SELECT k, extract(year FROM d) FROM deep.er, @ o) q JOIN z-1.w ON q.a = s.b, last_one WHERE 1 = 1",
     True, "SELECT f(a, b) x, y FROM @, secret s, (SELECT k, extract(year FROM d) FROM deep.er, @ o) q JOIN z-1.w ON q.a = s.b, last_one WHERE 1 = 1"
     " LIMIT 1000", "deep.er,last_one,secret,z-1.w"),
]


def _hard(which, engine="spark"):
    def text(v):
        if v is None:
            return "NULL"
        quoted = v.replace("\\", "\\\\") if engine == "spark" else v
        mark = "\\'" if engine == "spark" else "''"
        return "'" + quoted.replace("'", mark) + "'"

    if which == 1:
        return "CASE query_id % 15 " + " ".join(f"WHEN {i} THEN {str(t[1]).lower()}" for i, t in enumerate(HARD_TEXTS)) + " END"
    cases = " ".join(f"WHEN {i} THEN {text(t[which])}" for i, t in enumerate(HARD_TEXTS))
    return f"replace(replace(CASE query_id % 15 {cases} END, '@', name), '#', fqn)"


@_q("x18_hard_texts", oracle(
    f"SELECT query_id, {_hard(1)} AS allowed, {_hard(2, 'duck')} AS sql, {_hard(3, 'duck')} AS missing FROM (SELECT id AS query_id, name, fqn FROM assets)",
    "assets"))
def x18_hard_texts(spark, root):
    assets = d.assets(spark, root)
    texts = spread(assets.selectExpr("id as query_id", "name", "fqn")).select("query_id", F.expr(_hard(0)).alias("sql"))
    missing = sqltext.unregistered_tables(texts, assets).select("query_id", F.array_join("missing", ",").alias("missing"))
    allowed = sqltext.safety_verdict(F.col("sql"))["allowed"]
    limited = F.when(allowed, sqltext.clamp_limit(F.col("sql"))["sql"])
    return texts.select("query_id", allowed.alias("allowed"), limited.alias("sql")).join(missing, "query_id")


# Texts that engines read differently; @ stands for a table of the catalog. With each: the reason against it, and
# the tables that any reading shows.
READ_TEXTS = [
    ("SELECT \"a\\\" , \"; DROP TABLE @; -- \"", "multiple statements detected (2)", ""),
    ("SELECT `a\\` , `; DROP TABLE @; -- `", "multiple statements detected (2)", ""),
    ("SELECT $$'$$; DROP TABLE @; SELECT $$'$$", "multiple statements detected (3)", ""),
    ("SELECT $q$ ; $q$, b FROM @", "multiple statements detected (2)", "@"),
    ("SELECT 1 # '\n; DROP TABLE x # '", "multiple statements detected (2)", ""),
    ("SELECT q'[']' FROM @; DROP TABLE x --'", "multiple statements detected (2)", "@"),
    ("SELECT a FROM @ --1; DROP TABLE x", "multiple statements detected (2)", "@"),
    ("SELECT a FROM @ -- x\r; DROP TABLE y", "multiple statements detected (2)", "@"),
    ("SELECT 1 /* /* */ ' */ ; DROP TABLE @; -- '", "comment in a comment", ""),
    ("SELECT 1 /*!50000 ; DROP TABLE @ */", "executable comment", ""),
    ("SELECT 'abc\\' FROM @", "a quote or comment is left open", "@"),
    ("SELECT a FROM @ INTO OUTFILE '/tmp/x'", "writes a file", "@"),
    ("SELECT 'it''s' FROM @ # from hidden_one", "", "@,hidden_one"),
    ("SELECT 'C:\\dir', $1, a$b FROM @ WHERE c = 'from x'", "", "@"),
    ("SELECT freq'x' FROM @ u JOIN z USING (id) JOIN y USING (id, k)", "", "@,y,z"),
    ("SELECT a FROM @ TABLESAMPLE (10 PERCENT) WHERE b", "", "@"),
    ("SELECT * FROM url('http://h/p', CSV) JOIN s3('a') AS z ON 1, unnest(a) b, db.fn(1) c, @", "", "@,db.fn(),s3(),url()"),
    ("MERGE INTO @ USING u ON k = u.k WHEN MATCHED THEN UPDATE SET b = 1", "DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)", "@,u"),
    ("DELETE FROM @ t USING u, v WHERE t.a = u.a", "DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)", "@,u,v"),
    ("INSERT INTO @ (a, b) SELECT a, b FROM w", "DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)", "@,w"),
]

# Row limits of many forms. With each: what a maximum of 1000 rows makes of it, and the note.
LIMIT_TEXTS = [
    ("SELECT a FROM @ LIMIT ALL", "SELECT a FROM @ LIMIT 1000", "clamped LIMIT ALL -> 1000"),
    ("SELECT a FROM @ LIMIT 50000 BY b", "SELECT a FROM @ LIMIT 50000 BY b LIMIT 1000", "injected LIMIT"),
    ("SELECT a FROM @ limit 2 by b limit 50000", "SELECT a FROM @ limit 2 by b LIMIT 1000", "clamped LIMIT 50000 -> 1000"),
    ("SELECT a FROM @ LIMIT 20*1000", None, "refused: a limit in a form that is not known"),
    ("SELECT a FROM @ LIMIT ?", None, "refused: a limit in a form that is not known"),
    ("SELECT a FROM @ LIMIT 5 LIMIT 50000", None, "refused: a limit in a form that is not known"),
    ("SELECT a FROM @ FETCH FIRST ROW ONLY", None, "refused: a limit in a form that is not known"),
    ("SELECT TOP 50000 a FROM @", "SELECT TOP 1000 a FROM @", "clamped LIMIT 50000 -> 1000"),
    ("select distinct top 7 a FROM @", "select distinct top 7 a FROM @", "LIMIT 7 ok"),
    ("SELECT TOP (50000) a FROM @", None, "refused: a limit in a form that is not known"),
    ("SELECT TOP 10 PERCENT a FROM @", None, "refused: a limit in a form that is not known"),
    ("SELECT TOP 7 a FROM @ LIMIT 3", None, "refused: a limit in a form that is not known"),
    ("SELECT a FROM @ LIMIT 9999999999999999999999999999999999999999", "SELECT a FROM @ LIMIT 1000",
     "clamped LIMIT 9999999999999999999999999999999999999999 -> 1000"),
    ("SELECT a FROM (SELECT b FROM @ LIMIT 50000) t", "SELECT a FROM (SELECT b FROM @ LIMIT 50000) t LIMIT 1000", "injected LIMIT"),
    ("SELECT top.a AS limit_a FROM @ top", "SELECT top.a AS limit_a FROM @ top LIMIT 1000", "injected LIMIT"),
    ("SELECT a FROM @ # note", None, "refused: engines read this text differently"),
    ("SELECT a FROM @ /* open", None, "refused: a quote or comment is left open"),
]


def _listed(texts, which, engine="spark"):
    """The given entry of the text that a row's number picks, with the row's name filled in."""
    def literal(v):
        if v is None:
            return "NULL"
        if engine == "spark":
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return "'" + v.replace("'", "''") + "'"

    cases = " ".join(f"WHEN {i} THEN {literal(t[which])}" for i, t in enumerate(texts))
    return f"replace(CASE id % {len(texts)} {cases} END, '@', name)"


def _of_assets(spark, root, texts):
    return spread(d.assets(spark, root).select("id", "name")).select(F.col("id").alias("query_id"), F.expr(_listed(texts, 0)).alias("sql"))


@_q("x18_engine_readings", oracle(
    f"SELECT query_id, reason = '' AS allowed, reason, list_aggregate(list_sort(string_split(refs, ',')), 'string_agg', ',') AS refs FROM (SELECT id AS query_id,"
    f" {_listed(READ_TEXTS, 1, 'duck')} AS reason, {_listed(READ_TEXTS, 2, 'duck')} AS refs FROM assets)", "assets"))
def x18_engine_readings(spark, root):
    v = sqltext.safety_verdict(F.col("sql"))
    return _of_assets(spark, root, READ_TEXTS).select(
        "query_id", v["allowed"].alias("allowed"), v["reason"].alias("reason"),
        F.array_join(F.array_sort(sqltext.table_references(F.col("sql"))), ",").alias("refs"))


@_q("x19_limit_forms", oracle(
    f"SELECT id AS query_id, {_listed(LIMIT_TEXTS, 1, 'duck')} AS sql, {_listed(LIMIT_TEXTS, 2, 'duck')} AS note FROM assets", "assets"))
def x19_limit_forms(spark, root):
    v = sqltext.clamp_limit(F.col("sql"))
    return _of_assets(spark, root, LIMIT_TEXTS).select("query_id", v["sql"].alias("sql"), v["note"].alias("note"))


@_q("x21_pii_columns", oracle(
    "SELECT l.query_id, count(c.id) = 0 AS allowed, coalesce(max(CASE WHEN c.id IS NOT NULL THEN concat(l.cname, '(', c.pii_class, ')') END), '') AS pii_columns, count(c.id) AS n_columns"
    " FROM sql_log l LEFT JOIN cols c ON c.name = l.cname AND c.pii_class <> 'none' AND l.query_id % 10 IN (0, 5, 8) GROUP BY 1", "sql_log", "cols"))
def x21_pii_columns(spark, root):
    out = sqltext.pii_verdict(d.sql_log(spark, root), d.columns(spark, root))
    return out.select("query_id", "allowed", F.array_join("pii_columns", ",").alias("pii_columns"), "n_columns")


@_q("u3_missing_tables", oracle(
    f"SELECT {_MISSING} AS ref, count(*) AS n FROM sql_log WHERE {_MISSING} IS NOT NULL GROUP BY 1", "sql_log"))
def u3_missing_tables(spark, root):
    out = sqltext.unregistered_tables(d.sql_log(spark, root), d.assets(spark, root))
    return out.select(F.explode("missing").alias("ref")).groupBy("ref").agg(F.count("*").alias("n"))


@_q("u4_merge_lists", oracle(
    "SELECT a.id, list_aggregate(list_sort(list_distinct(list_concat(string_split(a.name, '_'), CASE WHEN o.role IS NULL THEN [] ELSE [o.role, 'stg'] END))), 'string_agg', ',') AS merged"
    " FROM assets a LEFT JOIN owners o ON o.table_id = a.id", "assets", "owners"))
def u4_merge_lists(spark, root):
    old = d.assets(spark, root).select("id", F.split("name", "_").alias("words"))
    new = d.owners(spark, root).select(F.col("table_id").alias("id"), F.array("role", F.lit("stg")).alias("words"))
    merged = sinks.fill_empty(old, new, ["id"], [], lists=["words"])
    return merged.select("id", F.array_join(F.array_sort(F.array_distinct("words")), ",").alias("merged"))


@_q("x22_masked_customers",
    "SELECT c_custkey, concat(substring(c_name, 1, 2), repeat('*', length(c_name) - 4), right(c_name, 2)) AS c_name, c_nationkey, '***' AS c_acctbal,"
    " sha256(c_mktsegment) AS c_mktsegment FROM customer")
def x22_masked_customers(spark, root):
    return pii.mask_columns(load(spark, root, "customer"), {
        "c_custkey": "none", "c_name": "partial", "c_acctbal": "full", "c_mktsegment": "hash"})


def _replies(spark, root):
    """Model replies in four shapes: fenced JSON, JSON inside prose, prose, broken JSON."""
    body = "concat('{\"description\": \"about ', source, '\", \"confidence\": 0.', doc_id % 10, ', \"tier\": \"critical\"}')"
    return load(spark, root, "documents").selectExpr(
        "doc_id", f"case doc_id % 4 when 0 then concat('```json\n', {body}, '\n```') when 1 then concat('Sure: ', {body}, ' ok')"
        " when 2 then translate(text, '{}', '') else concat('{', lang, ' ', source, '}') end as content")


@_q("x29_model_replies",
    "SELECT doc_id, CASE doc_id % 4 WHEN 2 THEN regexp_replace(replace(replace(text, '{', ''), '}', ''), '^\\s+|\\s+$', '', 'g')"
    " WHEN 3 THEN concat('{', lang, ' ', source, '}') ELSE concat('about ', source) END AS description, CASE WHEN doc_id % 4 < 2 THEN CAST(doc_id % 10 AS DOUBLE) / 10"
    " ELSE 0.4 END AS confidence, CASE WHEN doc_id % 4 < 2 THEN 'critical' ELSE 'normal' END AS tier FROM documents")
def x29_model_replies(spark, root):
    return _replies(spark, root).select("doc_id", documents.model_reply(F.col("content")).alias("r")).select("doc_id", "r.*")


@_q("x30_fingerprints", "SELECT doc_id, substring(sha256(text), 1, 16) AS sha FROM documents")
def x30_fingerprints(spark, root):
    return load(spark, root, "documents").select("doc_id", documents.fingerprint(F.col("text")).alias("sha"))


@_q("x31_clamped",
    "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN 0.5 ELSE greatest(0, least(1, CASE WHEN value / 50 - 0.5 = 0 THEN 0.5 ELSE value / 50 - 0.5 END)) END AS confidence FROM events")
def x31_clamped(spark, root):
    value = F.when(F.col("user_id") % 5 == 0, "high").otherwise((F.col("value") / 50 - 0.5).cast("string"))
    return load(spark, root, "events").select("event_id", documents.clamp_confidence(value).alias("confidence"))


@_q("x32_sample_previews",
    "SELECT doc_id, concat('[', CASE WHEN length(text) > 40 THEN concat(substring(text, 1, 40), '…') ELSE text END, ', ', lang, ', null]') AS preview,"
    " concat('{ doc_id=', doc_id, ', lang=', lang, ', source=', source, ' }') AS row_text FROM documents")
def x32_sample_previews(spark, root):
    samples = F.array("text", "lang", F.lit(None).cast("string"))
    return load(spark, root, "documents").select(
        "doc_id", describe.sample_preview(samples).alias("preview"), describe.row_preview(["doc_id", "lang", "source"]).alias("row_text"))
