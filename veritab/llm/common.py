"""Small helpers shared by the operators: Arrow batches of texts, bounded samples, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.session import materialize, materialize_counted

#: Rows that one Arrow batch holds at most while whole texts are worked on; see also
#: spark.sql.execution.arrow.maxBytesPerBatch, which bounds a batch's bytes.
ROWS = 512

LOWER_ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def per_row(df: DataFrame, fn: Callable, schema: str, *columns: str) -> DataFrame:
    """One output row for each input row: ``fn`` gets the values of ``columns`` and returns a tuple.

    Only the named columns are sent to Python, whatever else the table holds.
    """
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = None
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                out = [fn(*v) for v in zip(*(c.to_pylist() for c in part.columns))]
                target = target or arrow_schema(schema)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[i] for r in out], target.field(n).type) for i, n in enumerate(names)], schema=target)

    return df.select(*columns).mapInArrow(run, schema)


def many_per_row(df: DataFrame, fn: Callable, schema: str, *columns: str) -> DataFrame:
    """Any number of output rows for each input row: ``fn`` returns an iterable of tuples."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target = arrow_schema(schema)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], target.field(n).type) for i, n in enumerate(names)], schema=target)

        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                out: list[tuple] = []
                for v in zip(*(c.to_pylist() for c in batch.slice(at, ROWS).columns)):
                    out.extend(fn(*v))
                    if len(out) >= 20_000:
                        yield batch_of(out)
                        out = []
                if out:
                    yield batch_of(out)

    return df.select(*columns).mapInArrow(run, schema)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(),
          "binary": pa.binary()}


def arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(arrow_type(name[6:-1]))
    return _ARROW[name]


def arrow_schema(schema: str) -> pa.Schema:
    """Arrow schema of a ``name type, name type`` string with plain types and arrays of them."""
    return pa.schema([pa.field(*(lambda n, t: (n, arrow_type(t)))(*c.split(" ", 1))) for c in schema.split(", ")])


def unused(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as it takes to differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most ``rows`` rows, chosen by the hash of ``key``: the same ones at every run and partitioning."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Smallest node reachable from every node of an undirected graph: ``node``, ``root``.

    ``edges`` has columns ``a`` and ``b``. Large-star and small-star rounds take turns until
    nothing changes; each round is written to the shared scratch folder, so a lost executor
    costs one round at most. A hub's neighbours are reduced to their minimum by a partial
    aggregate, and are joined with it by rows, never gathered.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges, before = materialize(edges, name), None
    while True:
        # Large star: neighbours above a node go to the smallest of its neighbourhood.
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = (both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        # Small star: a node and its smaller neighbours go to the smallest of them.
        large = materialize(large, name)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        edges, count = materialize_counted(small, name)
        total = edges.agg(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()[0]
        if not count or (count, total) == before:
            break
        before = (count, total)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
