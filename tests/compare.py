"""Run queries on Spark and their oracle SQL on DuckDB, and compare whole results."""

from __future__ import annotations

import math
import sys
import time
from datetime import datetime

import duckdb

sys.path.insert(0, __file__.rsplit("/", 2)[0])

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]


def duck(root):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{root}/{t}.parquet'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)) or type(v).__name__ == "Decimal":
        f = float(v)
        return "nan" if math.isnan(f) else float(f"{f:.10g}")
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(norm(r[i]) for i in order) for r in data]
    return sorted(out, key=repr)


def compare(spark, con, root, name, fn, sql):
    start = time.time()
    df = fn(spark, root)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - start
    if sql is None:
        return spent, len(got), "no oracle"
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(names) != sorted(df.columns):
        return spent, len(got), f"COLUMNS {sorted(df.columns)} vs {sorted(names)}"
    if got != want:
        extra = [r for r in got if r not in set(want)][:2] if len(got) < 200000 else []
        lack = [r for r in want if r not in set(got)][:2] if len(want) < 200000 else []
        return spent, len(got), f"DIFFERENT {len(got)} vs {len(want)}\n   spark {extra}\n   duck  {lack}"
    return spent, len(got), "ok"


def main():
    import __spark_entry__ as e
    from veritab.session import build_session

    root = sys.argv[1]
    prefixes = sys.argv[2:]
    spark = build_session(
        "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g",
                       "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    con, sqls, bad = duck(root), e.oracle_sql(), 0
    for name, fn in e.queries().items():
        if prefixes and not any(name.startswith(p) for p in prefixes):
            continue
        try:
            spent, n, verdict = compare(spark, con, root, name, fn, sqls.get(name))
        except Exception as err:  # report and go on
            spent, n, verdict = 0, 0, f"ERROR {type(err).__name__} {str(err)[:700]}"
        bad += verdict not in ("ok", "no oracle")
        print(f"{name:32s} {spent:6.2f}s {n:8d} {verdict}", flush=True)
    print("bad:", bad)


if __name__ == "__main__":
    main()
