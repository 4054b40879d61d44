"""Screens and extraction over a table of query texts.

Works on text with column expressions; it is no parser. Texts are cut into literals,
quoted names, comments and the rest under the readings of several engines (``sqlread``);
screens and extractors look at what is outside of the former in any of them. Contents of parentheses and of string literals are
moved out of the ASCII range (same length), so patterns only see the outer level,
at any nesting depth, and the text can be restored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veritab.functions.sqlread import over_views, strip_comments, view, views

# Statements and keywords a screened query may not hold.
FORBIDDEN = [
    "insert", "update", "delete", "drop", "truncate", "alter", "create", "grant", "revoke",
    "attach", "detach", "rename", "optimize", "kill", "system", "set", "use",
]
# Row limits.
MAX_ROWS = 10_000
DEFAULT_ROWS = 1_000
# Aggregate function names, matched in lower case.
AGGREGATES = [
    "sum", "sumif", "sumdistinct",
    "count", "countif", "countdistinct", "countequalf",
    "avg", "avgif", "avgdistinct",
    "min", "minif", "max", "maxif",
    "any", "anylast", "anyheavy", "anyvalue", "any_value", "first", "last",
    "first_value", "last_value",
    "array_agg", "string_agg", "approx_distinct",
    "grouparray", "groupconcat", "groupuniqarray",
    "quantile", "quantiledeterministic", "quantiletiming",
    "median", "quantiles",
    "uniq", "uniqexact", "uniqcombined", "uniqhll12",
    "stddevpop", "stddevsamp", "varpop", "varsamp",
    "covarpop", "covarsamp", "corr",
]

_ASCII = "".join(chr(c) for c in range(0x20, 0x7F))
_HIDDEN = "".join(chr(0xE000 + c) for c in range(0x20, 0x7F))
_NAME = r"[a-zA-Z_]\w*"

# One part of a table name, plain (hyphens allowed) or quoted, and a whole name.
_PART = r"(?:[\p{L}_][\p{L}\p{N}_$]*(?:-[\p{L}\p{N}_$]+)*|\"[^\"]*\"|`[^`]*`)"
_TABLE = rf"{_PART}(?:\s*\.\s*{_PART})*"

def outside(sql: Column) -> Column:
    """The text of the standard view: no literals, no comments, quoted names hidden."""
    return view(sql)["text"]


def statements(sql: Column) -> Column:
    """The statements of a text, as ``outside`` gives them; empty ones are left out."""
    return F.filter(F.split(outside(sql), ";"), lambda p: p.rlike(r"\S"))


def _clean_name(name: Column) -> Column:
    return show_hidden(F.regexp_replace(name, r"[\"`\s]", ""))


def hide_nested(text: Column) -> Column:
    """Same-length text with parenthesised and quoted contents moved out of ASCII."""
    pieces = F.split(text, r"(?<=[()'])|(?=[()'])")
    zero = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit("").alias("out"))

    def step(acc, piece):
        depth, quoted, out = acc["depth"], acc["quoted"], acc["out"]
        hidden = F.translate(piece, _ASCII, _HIDDEN)
        quote = piece == "'"
        opens, closes = (piece == "(") & ~quoted, (piece == ")") & ~quoted
        after = F.when(opens, depth + 1).when(closes, F.greatest(depth - 1, F.lit(0))).otherwise(depth)
        visible = F.when(quote | opens, depth == 0).when(closes, after == 0).otherwise((depth == 0) & ~quoted)
        return F.struct(
            after.alias("depth"),
            F.when(quote, ~quoted).otherwise(quoted).alias("quoted"),
            F.concat(out, F.when(visible, piece).otherwise(hidden)).alias("out"),
        )

    return F.aggregate(pieces, zero, step)["out"]


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def show_hidden(text: Column) -> Column:
    """Undo hide_nested."""
    return F.translate(text, _HIDDEN, _ASCII)


# Words that end a list of tables, and words that can follow a table name without being its alias.
_LIST_ENDS = "where|group|order|having|limit|union|intersect|except|window|qualify|select|set|values|fetch|offset|returning"
_NOT_ALIAS = [
    "on", "where", "join", "left", "right", "inner", "outer", "full", "cross", "group", "order", "limit", "having", "union",
    "using", "set", "values", "select", "as", "lateral", "natural", "semi", "anti", "asof", "global", "any", "all", "final",
    "intersect", "except", "window", "qualify", "fetch", "offset", "returning", "sample", "prewhere", "settings", "format", "from",
    "into", "update", "table", "only", "tablesample", "pivot", "unpivot", "when", "matched", "for", "default", "end", "with", "outfile",
    "dumpfile",
]
# Functions that make rows of their arguments and read nothing.
_ROW_MAKERS = ["unnest", "explode", "explode_outer", "posexplode", "inline", "generate_series", "range", "numbers", "sequence", "flatten", "values", "arrayjoin"]
# Calls that hold the word from without a table after it.
_FROM_CALLS = r"(?i)\b(?:extract|trim|substring|overlay|position)\s*\([^()]*\)"


def _levels(text: Column) -> Column:
    """Contents of all parentheses, innermost first, and the text around them, each without parentheses."""
    deepest = F.aggregate(
        F.regexp_extract_all(text, F.lit("[()]"), F.lit(0)), F.struct(F.lit(0).alias("depth"), F.lit(0).alias("most")),
        lambda acc, p: _let(F.greatest(F.lit(0), acc["depth"] + F.when(p == "(", 1).otherwise(-1)),
                            lambda n: F.struct(n.alias("depth"), F.greatest(acc["most"], n).alias("most"))))["most"]
    zero = F.struct(text.alias("text"), F.array().cast("array<string>").alias("found"))

    def inner(acc, _):
        return _let(F.regexp_replace(acc["text"], _FROM_CALLS, " \ue000 "), lambda t: F.struct(
            F.regexp_replace(t, r"\([^()]*\)", " \ue000 ").alias("text"),
            F.concat(acc["found"], F.regexp_extract_all(t, F.lit(r"\(([^()]*)\)"), F.lit(1))).alias("found")))

    turns = F.when(deepest > 0, F.sequence(F.lit(1), deepest)).otherwise(F.array().cast("array<int>"))
    return _let(F.aggregate(turns, zero, inner), lambda acc: F.concat(F.array(acc["text"]), F.reverse(acc["found"])))


def _named_tables(text: Column, words: str = "join|into|update|using") -> Column:
    """<table, alias> at every place of a text from ``outside`` that names one: after from and the given
    words, and after each comma of a list of tables."""
    after = rf"(?is)(?<!distinct\s)\bfrom\b(.*?)(?=\b(?:{_LIST_ENDS}|from)\b|;|$)"
    alias_of = rf"(?:\s+as\s+{_PART}|\s+(?!(?:{'|'.join(_NOT_ALIAS)})\b){_PART})?"
    single = rf"(?i)\b(?:{words})\s+(?:(?:table|only|lateral)\s+)?{_TABLE}(?:\s*\ue000)?{alias_of}"

    def of_level(level):
        lists = F.flatten(F.transform(F.regexp_extract_all(level, F.lit(after), F.lit(1)), lambda r: F.split(r, ",")))
        return F.concat(lists, F.regexp_extract_all(level, F.lit(single), F.lit(0)))

    def entry(piece):
        start = rf"(?is)^\s*(?:(into|update)\s+|(?:join|using)\s+)?(?:(?:table|only|lateral)\s+)?({_TABLE})(\s*\ue000)?(?:\s+as\s+({_PART})|\s+({_PART}))?"
        alias = F.concat(F.regexp_extract(piece, start, 4), F.regexp_extract(piece, start, 5))
        # Behind into and update stand columns in parentheses.
        call = (F.regexp_extract(piece, start, 3) != "") & (F.regexp_extract(piece, start, 1) == "")
        return F.struct(
            F.regexp_extract(piece, start, 2).alias("table"), call.alias("call"),
            F.when((alias != "") & ~F.lower(alias).isin(_NOT_ALIAS), alias).alias("alias"))

    named = _let(_levels(text), lambda ls: F.transform(F.flatten(F.transform(ls, of_level)), entry))
    # Functions that make rows of their arguments, and keywords, name no table.
    return F.transform(
        F.filter(named, lambda e: (e["table"] != "") & ~F.lower(e["table"]).isin(_NOT_ALIAS) & ~(e["call"] & F.lower(e["table"]).isin(_ROW_MAKERS))),
        lambda e: F.struct(F.concat(_clean_name(e["table"]), F.when(e["call"], "()").otherwise("")).alias("table"), _clean_name(e["alias"]).alias("alias")))


def table_references(sql: Column) -> Column:
    """Distinct table names after from / join / into / update / using and in lists of tables, of any number of
    parts, quoted or not; literals and comments name nothing. A table function is told as its name with ().
    Where engines read a text differently, the names of all readings count."""
    return over_views(sql, lambda text: F.transform(_named_tables(text), lambda e: e["table"]))


# Words that a table name stands behind in the text of a task.
_BEFORE_TABLES = ["from", "join", "into", "update", "table"]


def task_table_evidence(text: Column) -> Column:
    """Distinct table names in task text: words behind from, join, into, update or table, anywhere in it.

    Task text is code around SQL, so that literals and comments count as evidence here.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[\w.\"`]+|[^\s\w.\"`]"), F.lit(0))

    def names(ws):
        at = F.filter(F.transform(ws, lambda w, i: F.when(
            (i > 0) & F.lower(F.get(ws, i - 1)).isin(_BEFORE_TABLES) & w.rlike("^[a-zA-Z_]"), w)), lambda w: w.isNotNull())
        return F.transform(at, lambda w: F.regexp_replace(w, "^[\"`]+|[\"`]+$", ""))

    return F.array_distinct(_let(words, names))


def write_target(statement: Column) -> Column:
    """Target of INSERT INTO / CREATE TABLE AS / MERGE INTO of one statement, else null."""

    def of_text(text):
        insert = F.regexp_extract(text, rf"(?i)\b(?:insert\s+(?:into|overwrite)|merge\s+into)\s+(?:table\s+)?({_TABLE})", 1)
        create = F.regexp_extract(
            text, rf"(?i)\bcreate\s+(?:or\s+replace\s+)?(?:table|view)\s+(?:if\s+not\s+exists\s+)?({_TABLE})", 1
        )
        return F.when(insert != "", insert).when(create != "", create)

    return _clean_name(F.get(F.filter(F.transform(views(statement), lambda v: of_text(v["text"])), lambda t: t.isNotNull()), F.lit(0)))


def statement_sources(statement: Column) -> Column:
    """Sorted distinct tables one statement reads; the write target is left out."""
    refs = table_references(statement)
    return _let(
        write_target(statement), lambda target: F.array_sort(F.filter(refs, lambda r: target.isNull() | (r != target)))
    )


# A file written by a query.
_WRITES_FILE = r"(?i)\binto\s+(?:outfile|dumpfile)\b"


def _verdict(seen: Column) -> Column:
    """Reason against one view of a text; empty if there is none."""
    bare = F.regexp_replace(F.regexp_replace(seen["text"], r"^\s+|\s+$", ""), r"[;\s]+$", "")

    def judge(raw, outer):
        n = F.size(F.filter(F.split(raw, ";"), lambda p: p.rlike(r"\S")))
        head = F.regexp_extract(outer, r"^[\s(]*([a-z]+)", 1)
        return (
            F.when(seen["fault"] != "", seen["fault"])
            .when(n > 1, F.format_string("multiple statements detected (%d)", n))
            .when(
                raw.rlike(r"(?i)\b(" + "|".join(FORBIDDEN) + r")\b"),
                F.lit("DML/DDL keyword detected (INSERT/UPDATE/DELETE/DROP/...)"),
            )
            .when(raw.rlike(_WRITES_FILE), "writes a file")
            .when(n == 0, "empty statement")
            .when(outer.rlike(r"\b(union|intersect|except)\b"), "only SELECT allowed, got set operation")
            .when(~head.isin("select", "with"), F.concat(F.lit("only SELECT allowed, got "), head))
            .otherwise("")
        )

    return _let(bare, lambda raw: _let(F.lower(hide_nested(raw)), lambda outer: judge(raw, outer)))


def safety_verdict(sql: Column) -> Column:
    """Struct <allowed, reason>: one statement, no forbidden word, SELECT only.

    Words and semicolons count outside of literals, quoted names and comments. Engines differ on what these are; a text
    has to pass under every reading, and the reason is that of the first one it fails.
    """
    reasons = F.filter(F.transform(views(sql), _verdict), lambda r: r != "")
    reason = F.when(sql.isNull(), "empty statement").otherwise(F.coalesce(F.get(reasons, F.lit(0)), F.lit("")))
    return _let(reason, lambda r: F.struct((r == "").alias("allowed"), r.alias("reason")))


def clamp_limit(sql: Column, max_rows: int = DEFAULT_ROWS) -> Column:
    """Struct <sql, note>: the text without comments, with an outer row limit of at most ``max_rows``.

    LIMIT n, LIMIT n OFFSET m, LIMIT m, n, FETCH FIRST n ROWS and SELECT TOP n are limits; the number of rows is
    cut when above the maximum and the rest stays. LIMIT ALL becomes the maximum. LIMIT n BY columns holds for each value of the
    columns: a text that has it still gets a limit. A text without any gets LIMIT at its end. Limits in any other form (an
    expression, a parameter, a share of the rows) are refused, as are texts that engines read differently or leave open: no text, and a note.
    """
    cap = max(1, min(MAX_ROWS, int(max_rows)))
    bare = F.regexp_replace(F.regexp_replace(strip_comments(sql), r"^\s+|\s+$", ""), r"[;\s]+$", "")
    # Head, what comes before the number of rows, the number, what comes after it.
    forms = [
        r"(?is)^(.*?)\s*\b(limit\s+)(\d+)(\s+offset\s+\d+(?:\s+rows?)?)?$",
        r"(?is)^(.*?)\s*\b(limit\s+\d+\s*,\s*)(\d+)()$",
        r"(?is)^(.*?)\s*\b((?:offset\s+\d+\s+rows?\s+)?fetch\s+(?:first|next)\s+)(\d+)(\s+rows?\s+(?:only|with\s+ties))$",
        r"(?is)^(.*?)\s*\b(limit\s+)(all)(\s+offset\s+\d+(?:\s+rows?)?)?$",
        r"(?is)^(\s*select(?:\s+(?:distinct|all))?)\s+(top\s+)(\d+)(\s+(?!percent\b|with\s+ties\b)(?:(?!\b(?:limit|fetch|top)\b).)*+)$",
    ]
    by = r"(?is)\blimit\s+\d+(?:\s+offset\s+\d+|\s*,\s*\d+)?\s+by\b"
    # A limit that no form takes. Names in quotes and the inside of parentheses are hidden by then.
    unread = rf"(?is)\b(?:limit|fetch\s+(?:first|next))\b|^\s*select(?:\s+(?:distinct|all))?\s+top\b\s*[^,.]"

    def row(text, note):
        return F.struct(text.alias("sql"), note.alias("note"))

    def cut(raw, outer):
        refused = row(F.lit(None).cast("string"), F.lit("refused: a limit in a form that is not known"))
        plain = F.regexp_replace(outer, by, " ")
        out = F.when(plain.rlike(unread), refused).otherwise(row(F.concat(raw, F.lit(f" LIMIT {cap}")), F.lit("injected LIMIT")))
        for form in reversed(forms):
            word, number, tail = (F.regexp_extract(outer, form, i) for i in (2, 3, 4))
            every = F.lower(number) == "all"
            n = number.try_cast("decimal(38,0)")
            # More digits than any number of rows has are above every maximum.
            above = every | F.coalesce(n > cap, F.lit(True))
            rest = F.substring(raw, F.lit(1), F.length(F.regexp_extract(outer, form, 1)))
            end = F.substring(raw, F.length(raw) - F.length(tail) + 1, F.length(tail))
            short = F.concat(rest, F.lit(" "), F.upper(word), F.lit(str(cap)), F.when(F.lower(F.trim(word)) == "top", end).otherwise(F.upper(tail)))
            kept = F.when(above, row(short, F.concat(F.lit("clamped LIMIT "), F.upper(number), F.lit(f" -> {cap}")))).otherwise(
                row(raw, F.concat(F.lit("LIMIT "), number, F.lit(" ok"))))
            # What stands before a limit must hold no other one.
            again = F.regexp_replace(F.regexp_extract(outer, form, 1), by, " ").rlike(unread)
            out = F.when(outer.rlike(form), F.when(again, refused).otherwise(kept)).otherwise(out)
        return out

    def refused(seen):
        faults = F.filter(F.transform(seen, lambda v: v["fault"]), lambda f: f != "")
        unlike = F.size(F.array_distinct(F.transform(seen, lambda v: v["text"]))) > 1
        return F.when(seen.isNull(), "no text").when(unlike, "engines read this text differently").otherwise(F.get(faults, F.lit(0)))

    why = _let(views(sql), refused)
    limited = _let(bare, lambda raw: _let(hide_nested(raw), lambda outer: cut(raw, outer)))
    both = F.struct(why.alias("why"), limited.alias("limited"))
    return _let(both, lambda b: F.when(b["why"].isNotNull(), row(F.lit(None).cast("string"), F.concat(F.lit("refused: "), b["why"]))).otherwise(
        b["limited"]))


def unregistered_tables(queries: DataFrame, assets: DataFrame) -> DataFrame:
    """Per query: allowed, and the sorted references no catalog table answers to.

    A reference is known by full name, by table name, or by its last part.
    """
    refs = queries.select(
        "query_id", F.explode(table_references(F.col("sql"))).alias("ref")
    ).withColumn("key", F.lower("ref"))
    known = (
        assets.select(F.lower("fqn").alias("known"))
        .union(assets.select(F.lower("name").alias("known")))
        .distinct()
    )
    by_full = refs.join(known, refs.key == known.known, "left_anti")
    missing = by_full.join(known, F.substring_index(by_full.key, ".", -1) == known.known, "left_anti")
    # Number of references per query is bounded by the text, so this list is small.
    grouped = missing.groupBy("query_id").agg(F.array_sort(F.collect_set("ref")).alias("missing"))
    return queries.select("query_id").join(grouped, "query_id", "left").select(
        "query_id",
        F.col("missing").isNull().alias("allowed"),
        F.coalesce("missing", F.array().cast("array<string>")).alias("missing"),
    )


def referenced_words(sql: Column) -> Column:
    """Distinct lower-case names that can be columns: those that stand neither where a table or an alias does, nor
    before a dot or a parenthesis; quoted names count, literals and comments do not."""
    item = rf"{_TABLE}(?:\s+(?:as\s+)?(?!(?:{'|'.join(_NOT_ALIAS)})\b){_PART})?"

    def of_text(seen):
        text = F.regexp_replace(F.lower(seen), rf"\b(?:from|join|into|update)\s+{item}(?:\s*,\s*{item})*", " ")
        text = F.regexp_replace(text, rf"\bas\s+{_PART}", " ")
        word = r"(?:(?<![\p{L}\p{N}_$])[\p{L}_][\p{L}\p{N}_$]*+|\"[^\"]*\"|`[^`]*`)(?!\s*[(.])"
        return F.transform(F.regexp_extract_all(text, F.lit(word), F.lit(0)), lambda w: F.lower(_clean_name(w)))

    return over_views(sql, of_text)


def pii_verdict(queries: DataFrame, columns: DataFrame, allow_pii: bool = False) -> DataFrame:
    """Per query: the PII column names it mentions and whether it may run.

    Matching is by column name anywhere in the catalog. Names are reduced to
    (name, class) with the number of columns behind them before the join, so a
    name used by a third of all tables is still one row.
    """
    names = (
        columns.filter(F.col("pii_class") != "none")
        .groupBy(F.lower(F.substring_index("name", ".", -1)).alias("word"), "pii_class")
        .agg(F.count("*").alias("n_columns"))
    )
    words = queries.select("query_id", F.explode(referenced_words(F.col("sql"))).alias("word"))
    hits = (
        words.join(names, "word")
        .groupBy("query_id")
        .agg(
            F.array_sort(F.collect_set(F.concat("word", F.lit("("), "pii_class", F.lit(")")))).alias("pii_columns"),
            F.sum("n_columns").alias("n_columns"),
        )
    )
    return queries.select("query_id").join(hits, "query_id", "left").select(
        "query_id",
        (F.col("pii_columns").isNull() | F.lit(allow_pii)).alias("allowed"),
        F.coalesce("pii_columns", F.array().cast("array<string>")).alias("pii_columns"),
        F.coalesce("n_columns", F.lit(0)).alias("n_columns"),
    )


def transform_kind(item: Column) -> Column:
    """Class of one select item: aggregation, window, cast, direct, arithmetic,
    function, derivation or expression. Any call that is no aggregate is a function."""
    compare = r"[<>=!]|\|\||\b(and|or|not|is|in|like|between)\b"

    def kind(outer):
        call = F.regexp_extract(outer, r"^([a-z_]\w*)\s*\([^()]*\)$", 1)
        return (
            F.when(outer.rlike(r"\)\s*over\s*[(\w]"), "window")
            .when(
                outer.rlike(r"^(try_)?cast\s*\([^()]*\)$") | outer.rlike(r"^[\w.\"`]+::\w+(\([^()]*\))?$"), "cast"
            )
            .when(outer.rlike(r"^case\b.*\bend$"), "derivation")
            .when(outer.rlike(r"^[a-z_\"`][\w\"`]*(\.[a-z_\"`][\w\"`]*)*$"), "direct")
            .when((call != "") & call.isin(AGGREGATES), "aggregation")
            .when(call != "", "function")
            .when(outer.rlike(compare), "expression")
            .when(outer.rlike(r"[\w)\"`]\s*[-+*/%]") | outer.rlike(r"^-\s*[a-z_(]"), "arithmetic")
            .otherwise("expression")
        )

    return _let(F.lower(hide_nested(F.regexp_replace(item, r"^\s+|\s+$", ""))), kind)


# Words that end an expression and name nothing.
_NOT_IMPLIED = ["end", "null", "true", "false"]


def select_items(sql: Column) -> Column:
    """Array of <body, name> for the outer SELECT list, and for those of further UNION branches; an item
    of a later branch has the name that the first gives its place."""
    text = F.regexp_replace(strip_comments(sql), r"[;\s]+$", "")
    branches = F.split(hide_nested(text), r"(?i)\b(?:union(?:\s+(?:all|distinct))?|intersect|except)\b")

    def item(piece):
        alias = F.regexp_extract(piece, rf"(?i)\s+as\s+[\"`]?({_NAME})[\"`]?$", 1)
        return _let(alias, lambda a: named(piece, a))

    def named(p, alias):
        bare = F.regexp_extract(p, rf"({_NAME})[\"`]?$", 1)
        implied = p.rlike(rf"[\w)\"`']\s+[\"`]?{_NAME}[\"`]?$") & ~F.lower(bare).isin(_NOT_IMPLIED)
        body = (
            F.when(alias != "", F.regexp_replace(p, rf"(?i)\s+as\s+[\"`]?{_NAME}[\"`]?$", ""))
            .when(implied, F.regexp_replace(p, rf"\s+[\"`]?{_NAME}[\"`]?$", ""))
            .otherwise(p)
        )
        return F.struct(
            show_hidden(body).alias("body"), F.when(alias != "", alias).otherwise(bare).alias("name")
        )

    def items(branch):
        listing = F.regexp_extract(branch, r"(?is)\bselect\s+(?:distinct\s+)?(.*?)\s+from\s", 1)
        pieces = F.filter(F.split(listing, ","), lambda p: F.trim(p) != "")
        return F.transform(F.transform(pieces, lambda p: F.regexp_replace(p, r"^\s+|\s+$", "")), item)

    def renamed(lists):
        return F.flatten(F.transform(lists, lambda own: F.transform(own, lambda x, i: F.struct(
            x["body"].alias("body"), F.coalesce(F.get(lists[0], i)["name"], x["name"]).alias("name")))))

    return _let(F.transform(branches, items), renamed)


def alias_map(sql: Column) -> Column:
    """Map alias (or table name) -> table short name over all tables that are read."""

    def entry(e):
        table = F.substring_index(e["table"], ".", -1)
        return F.struct(F.coalesce(e["alias"], table).alias("key"), table.alias("value"))

    return _first_entries(F.transform(_let(outside(sql), lambda t: _named_tables(t, "join")), entry))


def _first_entries(entries: Column) -> Column:
    """Map of <key, value> structs; the first entry of a key wins."""

    def keep_first(es):
        keys = F.array_distinct(F.transform(es, lambda e: e["key"]))
        return F.map_from_entries(F.transform(keys, lambda k: F.filter(es, lambda e: e["key"] == k)[0]))

    return _let(entries, keep_first)


def select_column_refs(df: DataFrame, sql: str = "sql") -> DataFrame:
    """Rows of ``df`` exploded to qualified source columns of its select items.

    Adds downstream_col, body, transform_type, upstream_table (alias resolved)
    and upstream_col. Unqualified columns give no row.
    """
    items = df.withColumn("_alias", alias_map(F.col(sql))).withColumn(
        "_item", F.explode(select_items(F.col(sql)))
    )
    refs = F.array_distinct(
        F.regexp_extract_all(outside(F.col("_item.body")), F.lit(rf"\b({_NAME}\.{_NAME})\b"), F.lit(1))
    )
    out = items.withColumn("_ref", F.explode(refs))
    qualifier = F.substring_index("_ref", ".", 1)
    return out.select(
        *df.columns,
        F.col("_item.name").alias("downstream_col"),
        F.col("_item.body").alias("transform_expression"),
        transform_kind(F.col("_item.body")).alias("transform_type"),
        F.coalesce(F.try_element_at("_alias", qualifier), qualifier).alias("upstream_table"),
        F.substring_index("_ref", ".", -1).alias("upstream_col"),
    )


# Tags that leave nothing in the plain text.
_SILENT = ["config"]
_SILENT_BLOCKS = ["for", "endfor", "if", "endif", "else", "endmacro"]


_TAGS = r"\{\{[\s\S]*?\}\}|\{%[\s\S]*?%\}|[^{]+|\{"


def _tag(piece: Column) -> Column:
    """Struct <kind, call, inner, args> of a tag: its first word, what its call holds, all it holds, and the call's arguments.

    Arguments are the quoted texts, or the words where none is quoted.
    """
    def arguments(call):
        quoted = F.regexp_extract_all(call, F.lit(r"['\"]([^'\"]+)['\"]"), F.lit(1))
        return _let(quoted, lambda q: F.when(F.size(q) > 0, q).otherwise(F.regexp_extract_all(call, F.lit(r"(\w+)"), F.lit(1))))

    def told(inner):
        return _let(F.regexp_extract(inner, r"(?s)^\w+\s*\((.*)\)$", 1), lambda call: F.struct(
            F.regexp_extract(inner, r"^(\w+)", 1).alias("kind"), call.alias("call"), inner.alias("inner"), arguments(call).alias("args")))

    return _let(F.regexp_extract(piece, r"(?s)^\{[{%]-?\s*(.*?)\s*-?[}%]\}$", 1), told)


def plain_sql(template: Column) -> Column:
    """Turn a templated model text into plain SQL.

    The text is cut into tags and what is between them. A ref or source tag becomes the name of its last
    argument, a var tag its name as a literal, this a placeholder; config and the block tags of loops,
    conditions and macros vanish; any other tag stays.
    """
    def told(piece):
        return _let(_tag(piece), lambda tag: (
            F.when(F.startswith(piece, F.lit("{%")), F.when(tag["kind"].isin(_SILENT_BLOCKS), F.lit("")).otherwise(piece))
            .when(~F.startswith(piece, F.lit("{{")), piece)
            .when(tag["kind"].isin(_SILENT), F.lit(""))
            .when(tag["inner"] == "this", F.lit("_this_"))
            .when(tag["kind"].isin("ref", "source") & (F.size(tag["args"]) > 0), F.try_element_at(tag["args"], F.lit(-1)))
            .when((tag["kind"] == "var") & (F.size(tag["args"]) > 0), F.concat(F.lit("'"), F.get(tag["args"], F.lit(0)), F.lit("'")))
            .otherwise(piece)))

    text = F.array_join(F.transform(F.regexp_extract_all(template, F.lit(_TAGS), F.lit(0)), told), "")
    return F.regexp_replace(F.regexp_replace(text, r"\n\s*\n+", "\n\n"), r"^\s+|\s+$", "")


def _calls(text: Column, kind: str) -> Column:
    """Tags of the text that are one call of the given kind, in order."""
    pieces = F.filter(F.regexp_extract_all(text, F.lit(_TAGS), F.lit(0)), lambda p: F.startswith(p, F.lit("{{")))
    return F.filter(F.transform(pieces, _tag), lambda tag: (tag["kind"] == kind) & (tag["call"] != ""))


def model_refs(text: Column) -> Column:
    """Distinct <package, name> of ref() calls, in order; a call with one argument names its package by it."""
    named = F.filter(_calls(text, "ref"), lambda tag: F.size(tag["args"]).between(1, 2))
    return F.array_distinct(F.transform(named, lambda tag: F.struct(
        F.get(tag["args"], F.lit(0)).alias("package"), F.try_element_at(tag["args"], F.lit(-1)).alias("name"))))


def model_sources(text: Column) -> Column:
    """Distinct <source_name, name> of source() calls, in order."""
    named = F.filter(_calls(text, "source"), lambda tag: F.size(tag["args"]) == 2)
    return F.array_distinct(F.transform(named, lambda tag: F.struct(
        F.get(tag["args"], F.lit(0)).alias("source_name"), F.get(tag["args"], F.lit(1)).alias("name"))))


# The line that describes a model.
_HEADER = "@description:"


def model_header(text: Column) -> Column:
    """What follows the mark of a description in a comment of its own line, else null."""
    def told(line):
        body = F.ltrim(F.substring(line, F.lit(3), F.length(line)))
        mark, value = F.regexp_replace(F.lower(F.substring_index(body, ":", 1)), r"\s+$", ""), F.substring(body, F.locate(":", body) + 1, F.length(body))
        return F.when(F.startswith(line, F.lit("--")) & F.contains(body, F.lit(":")) & (F.concat(mark, F.lit(":")) == _HEADER), F.trim(value))

    found = F.filter(F.transform(F.split(text, "\n"), told), lambda t: t.isNotNull())
    return _let(F.get(found, F.lit(0)), lambda first: F.when(first != "", first))


def model_tags(text: Column) -> Column:
    """Tags listed in the first config() call."""
    def listed(after):
        return F.when(after.rlike(r"^\s*=\s*\["), F.substring_index(F.substring(after, F.locate("[", after) + 1, F.length(after)), "]", 1))

    def tags(call):
        inside = _let(F.substring(call, F.locate("tags", call) + 4, F.length(call)), listed)
        each = F.transform(F.split(inside, ","), lambda t: F.regexp_replace(t, r"^[\s'\"]+|[\s'\"]+$", ""))
        return F.filter(F.when(F.locate("tags", call) > 0, each).otherwise(F.array().cast("array<string>")), lambda t: t != "")

    return _let(F.get(_calls(text, "config"), F.lit(0))["call"], tags)


def commented_columns(text: Column) -> Column:
    """Map column -> comment of 'AS col -- comment' lines; the first wins."""
    found = F.regexp_extract_all(
        text, F.lit(r"(?i)(AS\s+[\"']?[a-zA-Z_]\w*[\"']?\s*,?\s*--\s*[^\n]+)"), F.lit(1)
    )

    def entry(line):
        name = F.regexp_extract(line, r"(?i)^AS\s+[\"']?([a-zA-Z_]\w*)", 1)
        note = F.trim(F.regexp_extract(line, r"--\s*([^\n]+)", 1))
        return F.struct(name.alias("key"), note.alias("value"))

    return _first_entries(F.filter(F.transform(found, entry), lambda e: e["value"] != ""))


def model_fqn(path: Column, project: str, label: str = "shop", base: str = "models") -> Column:
    """Catalog name of a model file path."""
    rel = F.when(F.startswith(path, F.lit(base + "/")), F.substring(path, F.lit(len(base) + 2), F.length(path))).otherwise(path)
    parts = F.split(rel, "/")
    name = F.replace(F.element_at(parts, -1), F.lit(".sql"), F.lit(""))
    schema = F.when(F.size(parts) > 1, parts[0]).otherwise("main")
    return F.concat(F.lit(f"dbt-{project}.{label}."), schema, F.lit("."), name)
