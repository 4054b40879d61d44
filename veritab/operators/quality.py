"""Column profiles and data-quality rules, one scan per table."""

from __future__ import annotations

import json
import math
import re
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veritab.functions.sqlread import SPARK, strip_comments
from veritab.functions.sqltext import safety_verdict

_SAFE_NAME = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")

RESULT_SCHEMA = (
    "rule_id string, table_fqn string, status string, passed boolean, "
    "observed double, threshold double, message string"
)


def _empty(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c).cast("string") == "")


def _told(df: DataFrame, c: str) -> list[Column]:
    """A value in 128 hashed bits, so that any value is two numbers; null stays null, empty text is 0, 0."""
    kind = df.schema[c].dataType.simpleString()
    # Values of a type are as distinct as their texts; maps have no hash of their own.
    value = F.col(c).cast("string") if "map<" in kind else F.col(c)
    empty = value == "" if kind == "string" or "map<" in kind else F.lit(False)
    seeds = (value,), (F.lit(1), value)
    return [F.when(empty, F.lit(0).cast("long")).when(value.isNotNull(), F.xxhash64(*seed)).alias(name)
            for name, seed in zip(("value", "more"), seeds)]


def profile(df: DataFrame, exact: bool = True) -> DataFrame:
    """Per column: rows, null-or-empty ratio (3 dp) and distinct values as text.

    Exact: the table is turned into (column, hashed value) pairs that are counted
    map-side, so a frequent value is one row per task before the shuffle and
    all columns share one exchange. ``exact=False`` sketches the distinct count
    in a single pass without that exchange.
    """
    if exact:
        pairs = df.select(
            F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), *_told(df, c)) for c in df.columns]))
        )
        counted = pairs.groupBy("column_name", "value", "more").agg(F.count("*").alias("n"))
        stats = counted.groupBy("column_name").agg(
            F.sum("n").alias("row_count"),
            F.sum(F.when(F.col("value").isNull() | ((F.col("value") == 0) & (F.col("more") == 0)), F.col("n")).otherwise(0)).alias("empty"),
            F.count("value").alias("distinct_count"),
        )
    else:
        aggs = [F.count("*").alias("n")]
        for i, c in enumerate(df.columns):
            aggs += [F.count_if(_empty(c)).alias(f"e{i}"), F.approx_count_distinct(F.col(c).cast("string")).alias(f"d{i}")]
        stats = df.agg(*aggs).select(
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column_name"), F.col("n").alias("row_count"),
                            F.col(f"e{i}").alias("empty"), F.col(f"d{i}").alias("distinct_count"),
                        )
                        for i, c in enumerate(df.columns)
                    ]
                )
            )
        )
    return stats.select(
        "column_name", "row_count",
        F.round(F.col("empty") / F.greatest("row_count", F.lit(1)), 3).alias("null_ratio"),
        "distinct_count",
    )


def sample_values(df: DataFrame, order_by: list[str], n: int = 10) -> DataFrame:
    """First n values of every column, by row order of the given keys."""
    w = Window.orderBy(*order_by)  # over n rows only
    rows = df.orderBy(*order_by).limit(n).withColumn("_i", F.row_number().over(w))
    cells = rows.select(
        "_i",
        F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in df.columns])),
    )
    return cells.groupBy("column_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda s: s["value"]).alias("sample_values")
    )


@dataclass
class Rule:
    """One quality rule. ``definition`` keys: column, threshold_minutes, min, max, threshold, sql."""

    rule_id: str
    table_fqn: str
    rule_type: str
    definition: dict = field(default_factory=dict)
    enabled: bool = True


class BadValue(Exception):
    """A value of a definition that is not of its type."""


def _read_number(definition: dict, key: str, default=None, whole: bool = False):
    """A finite number, also one in a text; null and '' are the default. Whole numbers lose their fraction."""
    value = definition.get(key)
    if value is None or value == "":
        return default
    found = value
    if isinstance(value, str):
        try:
            found = int(value) if re.fullmatch(r"\s*[+-]?\d{1,400}\s*", value) else float(value)
        except ValueError:
            found = None
    if isinstance(found, bool) or not isinstance(found, (int, float)) or not math.isfinite(found):
        raise BadValue(f"bad {key}: {value}")
    found = int(found) if whole else found
    # Beyond a long, a double is near enough to compare counts with.
    return float(found) if isinstance(found, int) and abs(found) >= 1 << 63 else found


def _read_text(definition: dict, key: str) -> str | None:
    value = definition.get(key)
    if value is not None and not isinstance(value, str):
        raise BadValue(f"bad {key}: {value}")
    return value


def _number(value) -> Column:
    return F.lit(None).cast("double") if value is None else F.lit(float(value))


def _constant(message: str, threshold=None):
    return F.lit(False), F.lit(None).cast("double"), _number(threshold), F.lit(message)


def _check(rule: Rule, df: DataFrame, as_of: datetime, metrics: dict[str, Column]):
    """(passed, observed, threshold, message) columns over the metric columns.

    Adds what it needs to ``metrics``; equal metrics are computed once. Raises ``BadValue``.
    """
    d = rule.definition

    def metric(name: str, expr: Column) -> Column:
        metrics.setdefault(name, expr)
        return F.col(f"`{name}`")

    def usable(column):
        return bool(column) and bool(_SAFE_NAME.match(column)) and column in df.columns

    if rule.rule_type == "freshness":
        column = _read_text(d, "column") or "created_at"
        limit = _read_number(d, "threshold_minutes", 60, whole=True) or 60
        if not usable(column):
            return _constant(f"bad col: {column}")
        kind = df.schema[column].dataType.simpleString()
        if kind not in ("timestamp", "timestamp_ntz", "date", "string"):
            return _constant(f"no time col: {column}", limit)
        # A text that is no time counts as none, and stops no other rule.
        time = F.try_to_timestamp(column) if kind == "string" else F.col(column)
        last = metric(f"max:{column}", F.max(time).cast("timestamp"))
        age = F.floor((F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(last)) / 60)
        text = F.concat(F.lit(f"last {column} "), age.cast("string"), F.lit(f"m ago (limit {limit}m)"))
        return (
            F.coalesce(age <= limit, F.lit(False)), age.cast("double"), _number(limit),
            F.when(last.isNull(), "no rows").otherwise(text),
        )
    if rule.rule_type == "volume":
        low, high = _read_number(d, "min"), _read_number(d, "max")
        n = metric("rows", F.count(F.lit(1)))
        passed = F.lit(True)
        if low is not None:
            passed = passed & (n >= low)
        if high is not None:
            passed = passed & (n <= high)
        text = F.concat(F.lit("row_count="), n.cast("string"), F.lit(f" expected {low}~{high}"))
        return passed, n.cast("double"), _number(low if low is not None else high), text
    if rule.rule_type == "null_ratio":
        column, limit = _read_text(d, "column"), float(_read_number(d, "threshold", 0.5))
        if not usable(column):
            return _constant("bad col", limit)
        n = metric("rows", F.count(F.lit(1)))
        empty = metric(f"empty:{column}", F.count_if(_empty(column)))
        ratio = F.when(n > 0, empty / n).otherwise(0.0)
        text = F.concat(F.lit("null_ratio="), F.format_number(ratio, 3), F.lit(f" limit {limit}"))
        return ratio <= limit, F.round(ratio, 4), _number(limit), text
    if rule.rule_type == "distinct":
        column = _read_text(d, "column")
        limit = _read_number(d, "min", 1, whole=True) or 1
        if not usable(column):
            return _constant("bad col", limit)
        # Maps can't be compared, their texts can.
        value = F.to_json(column) if "map<" in df.schema[column].dataType.simpleString() else F.col(column)
        n = metric(f"distinct:{column}", F.count_distinct(value))
        text = F.concat(F.lit("distinct="), n.cast("string"), F.lit(f" min {limit}"))
        return n >= limit, n.cast("double"), _number(limit), text
    return _constant(f"unknown rule_type: {rule.rule_type}")


def _result(rule: Rule, status: str, passed, observed, threshold, message) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.table_fqn).alias("table_fqn"),
        F.lit(status).alias("status"),
        passed.alias("passed"),
        observed.alias("observed"),
        threshold.alias("threshold"),
        message.alias("message"),
    )


#: Custom queries that run at a time, and seconds that each may take.
AT_ONCE, SECONDS = 8, 3_600


def _counted(spark: SparkSession, text: str, views: dict[str, str], seconds: float) -> int:
    """Rows of one query, whose jobs have a tag of their own and are cancelled when its time is up."""
    named = [n for n in views if n.lower() in text.lower()]
    heads = ", ".join(f"`{n}` AS (SELECT * FROM `{views[n]}`)" for n in named)
    full = (f"WITH {heads} " if heads else "") + f"SELECT count(*) AS n FROM (\n{text}\n)"
    context, tag, late = spark.sparkContext, f"veritab-rule-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        # A query may plan its next job after one was cancelled.
        while not late.wait(0.5):
            context.cancelJobsWithTag(tag)

    context.addJobTag(tag)
    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    started = time.monotonic()
    timer.start()
    try:
        return spark.sql(full).first()["n"]
    except Exception:
        if time.monotonic() - started >= seconds:
            raise TimeoutError(f"stopped after {seconds:g} s") from None
        raise
    finally:
        timer.cancel()
        late.set()
        context.removeJobTag(tag)


def _custom_results(spark: SparkSession, rules: list[Rule], frames: dict[str, DataFrame], at_once: int, seconds: float) -> list[Column]:
    """Results of user queries; one passes if it returns no rows.

    All texts are screened by one job. Then each query that may run is counted on its own, ``at_once`` at a time, as it has its
    own sources and its errors must stop no other rule; only its count comes back. Tables are known to a query by
    the given names, for as long as it runs.
    """
    texts: list = []
    for rule in rules:
        try:
            texts.append((_read_text(rule.definition, "sql") or None, None))
        except BadValue as bad:
            texts.append((None, str(bad)))
    screened = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, sql string").select(
        "i", safety_verdict(F.col("sql"))["reason"].alias("reason"), strip_comments(F.col("sql"), SPARK).alias("bare")).collect()
    reasons, bare = {r.i: r.reason for r in screened}, {r.i: re.sub(r"[;\s]+$", "", r.bare or "") for r in screened}
    run = [i for i, (t, _) in enumerate(texts) if t and not reasons[i]]
    views = {name: f"veritab_{uuid.uuid4().hex}" for name in frames} if run else {}

    def one(i: int) -> tuple:
        try:
            n = _counted(spark, bare[i], views, seconds)
        except (PySparkException, Py4JJavaError, TimeoutError) as error:
            return _constant(f"sql: {str(error).splitlines()[0]}", 0)
        return F.lit(n == 0), _number(n), _number(0), F.lit(f"custom check returned {n} rows")

    try:
        for name, view in views.items():
            frames[name].createOrReplaceTempView(view)
        with ThreadPoolExecutor(max_workers=max(1, at_once)) as pool:
            ran = dict(zip(run, pool.map(one, run)))
    finally:
        for view in views.values():
            spark.catalog.dropTempView(view)
    out = []
    for i, rule in enumerate(rules):
        text, bad = texts[i]
        checks = ran.get(i) or _constant(bad or ("missing sql" if not text else f"sql: {reasons[i]}"), 0)
        out.append(_result(rule, "checked", *checks))
    return out


def rules_of(table: DataFrame, table_fqn: str | None = None, rule_ids: list[str] | None = None) -> list[Rule]:
    """Enabled rules of a rule table <id, table_fqn, rule_type, definition (JSON), enabled>, of one table or by id if asked."""
    chosen = table.filter(F.col("enabled"))
    if table_fqn is not None:
        chosen = chosen.filter(F.col("table_fqn") == table_fqn)
    if rule_ids is not None:
        chosen = chosen.filter(F.col("id").cast("string").isin(rule_ids))
    rows = chosen.select(F.col("id").cast("string").alias("id"), "table_fqn", "rule_type", "definition").orderBy("id").collect()
    return [Rule(r.id, r.table_fqn, r.rule_type, _definition(r.definition)) for r in rows]


def _definition(text: str | None) -> dict:
    """A rule's definition; one that is no JSON object is empty, so its rule fails by itself."""
    try:
        found = json.loads(text or "{}")
    except ValueError:
        return {}
    return found if isinstance(found, dict) else {}


def _aggregate(df: DataFrame, rules: list[Rule], as_of: datetime) -> DataFrame:
    """Results of the given rules over one scan of their table."""
    metrics: dict[str, Column] = {}
    checks = []
    for rule in rules:
        try:
            own = dict(metrics)
            checks.append((rule, _check(rule, df, as_of, own)))
            metrics = own
        except BadValue as bad:
            checks.append((rule, _constant(str(bad))))
    metrics.setdefault("rows", F.count(F.lit(1)))
    one = df.agg(*[e.alias(n) for n, e in metrics.items()])
    return one.select(F.inline(F.array(*[_result(r, "checked", *c) for r, c in checks])))


def run_rules(spark: SparkSession, tables: dict[str, DataFrame], rules: list[Rule], as_of: datetime,
              views: dict[str, DataFrame] | None = None, at_once: int = AT_ONCE, seconds: float = SECONDS) -> DataFrame:
    """Result rows of all enabled rules.

    The rules of one table share a single aggregate over one scan of it; custom queries run on their own, some
    at a time and each with its own time limit, waiting for a free core included. They know the frames of ``views`` by their names, and the tables by the last part of theirs where
    it is theirs alone. A rule that cannot run, or whose definition holds a value of another type, gives a failed or skipped row and stops no other.
    """
    by_table: dict[str, list[Rule]] = {}
    parts: list[DataFrame] = []
    notes: list[Column] = []
    custom: list[Rule] = []
    for rule in rules:
        if not rule.enabled:
            continue
        if rule.table_fqn not in tables:
            none = F.lit(None).cast("double")
            notes.append(_result(rule, "skipped", F.lit(None).cast("boolean"), none, none, F.lit("table missing")))
        elif len(rule.table_fqn.split(".")) != 4:
            notes.append(_result(rule, "checked", *_constant("bad fqn")))
        elif rule.rule_type == "custom":
            custom.append(rule)
        else:
            by_table.setdefault(rule.table_fqn, []).append(rule)
    for fqn, group in by_table.items():
        try:
            parts.append(_aggregate(tables[fqn], group, as_of))
        except AnalysisException:
            # Some column cannot be measured as asked: find the rules that ask for it.
            fine = []
            for rule in group:
                try:
                    _aggregate(tables[fqn], [rule], as_of)
                    fine.append(rule)
                except AnalysisException as error:
                    notes.append(_result(rule, "checked", *_constant(str(error).splitlines()[0])))
            if fine:
                parts.append(_aggregate(tables[fqn], fine, as_of))
    if custom:
        short = [fqn.split(".")[-1] for fqn in tables]
        frames = {n: tables[fqn] for n, fqn in zip(short, tables) if short.count(n) == 1 and _SAFE_NAME.match(n)}
        notes += _custom_results(spark, custom, frames | (views or {}), at_once, seconds)
    if notes:
        parts.append(spark.range(1).select(F.inline(F.array(*notes))))
    if not parts:
        return spark.createDataFrame([], RESULT_SCHEMA)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def rule_summary(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count("*").alias("rules_checked"),
        F.count_if(F.coalesce("passed", F.lit(False))).alias("passed"),
        F.count_if((F.col("status") == "checked") & ~F.coalesce("passed", F.lit(False))).alias("failed"),
    )
