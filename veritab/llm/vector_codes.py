"""Product codes of vectors; the nearest codebook entry is found with a geometric near-neighbour access tree (GNAT).

A vector's components become integers floor(1024 x); the vector is cut into equal parts, each with its own codebook. A
tree over the entries of a codebook has a few split entries per node; every other entry goes to its nearest split. For
each pair of split and child the node keeps the range of distances between the split and the child's entries. A query
drops a whole child as soon as its distance to some split lies outside that range by strictly more than the best distance so
far. Bounds are rounded outwards, so that rounding can only keep a child too many, and what is kept is compared by exact
integer squared distances, ties by the lower index: the result is that of a full search.

Rows whose vector is null or has a null, NaN or infinite component are dropped. A vector of another length than the
first (by vec_id, null ids last), or of a length that the number of parts doesn't divide, is kept with a null code and error. Rows
that share a vec_id are rows of their own; of equal ids the smaller vector comes first in a codebook. Fewer rows than
entries give a shorter codebook. Errors beyond a long are null. Other columns are passed over. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from veritab.session import materialize

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Splits of a node, and queries worked on at once.
SPLITS, CHUNK = 8, 4096
_SLACK = 2.0 ** -48


def usable(vector: Column) -> Column:
    """Neither null nor with a null, NaN or infinite component."""
    return F.coalesce(vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (
        F.abs(x) != F.lit(float("inf")))), F.lit(False))


def _integers(values: np.ndarray) -> np.ndarray:
    """floor(1024 x), as Python integers where a product could leave 64 bits."""
    scaled = np.floor(values.astype(np.float64) * SCALE)
    if not scaled.size or np.abs(scaled).max() < 2.0 ** 27:
        return scaled.astype(np.int64)
    out = np.empty(values.shape, dtype=object)
    out.ravel()[:] = [int(x) * SCALE if abs(x) >= 2.0 ** 53 else int(np.floor(x * SCALE)) for x in values.astype(np.float64).ravel().tolist()]
    return out


def _alike(*arrays: np.ndarray) -> list[np.ndarray]:
    """All as 64-bit integers if no squared distance of them can overflow, else all as Python integers."""
    most = max((int(np.abs(a).max()) for a in arrays if a.size), default=0)
    wide = max((a.shape[-1] for a in arrays), default=0)
    kind = np.int64 if 4 * wide * most * most < 1 << 62 else object
    return [a.astype(kind) for a in arrays]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of ``a`` to all of ``b``."""
    apart = a[:, None, :] - b[None, :, :]
    return (apart * apart).sum(axis=2) if a.shape[1] else np.zeros((len(a), len(b)), dtype=np.int64)


def _root(squares: np.ndarray) -> np.ndarray:
    return np.sqrt(squares.astype(np.float64))


class Gnat:
    """A node: split entries, and for each a child with the other entries nearest to it."""

    def __init__(self, entries: np.ndarray, ids: np.ndarray, splits: int = SPLITS):
        self.entries, self.children = entries, []
        if len(ids) <= splits:
            self.ids = np.sort(ids)
            return
        # Farthest-first choice of splits.
        chosen, far = [int(ids[0])], _squares(entries[ids], entries[ids[:1]])[:, 0]
        while len(chosen) < splits:
            far[np.isin(ids, chosen)] = -1
            chosen.append(int(ids[int(np.argmax(far))]))
            far = np.minimum(far, _squares(entries[ids], entries[chosen[-1:]])[:, 0])
        self.ids = np.sort(np.array(chosen))
        rest = ids[~np.isin(ids, self.ids)]
        away = _squares(entries[rest], entries[self.ids])
        home = np.argmin(away, axis=1)
        self.low, self.high = np.full((splits, splits), np.inf), np.full((splits, splits), -np.inf)
        distance = _root(away)
        for child in range(splits):
            mine = home == child
            self.children.append(Gnat(entries, rest[mine], splits) if mine.any() else None)
            if mine.any():
                self.low[:, child] = distance[mine].min(axis=0) * (1 - _SLACK)
                self.high[:, child] = distance[mine].max(axis=0) * (1 + _SLACK)

    def search(self, queries: np.ndarray, rows: np.ndarray, best: np.ndarray, found: np.ndarray) -> None:
        """Improve ``best`` (squared distance) and ``found`` (entry) of the given rows."""
        away = _squares(queries[rows], self.entries[self.ids])
        near = np.argmin(away, axis=1)
        at, who = away[np.arange(len(rows)), near], self.ids[near]
        better = (found[rows] < 0) | (at < best[rows]) | ((at == best[rows]) & (who < found[rows]))
        best[rows[better]], found[rows[better]] = at[better], who[better]
        if not self.children:
            return
        distance = _root(away)
        low, high = distance * (1 - _SLACK), distance * (1 + _SLACK)
        for own in (True, False):  # the child of the nearest split first: it makes the ball small
            for child, node in enumerate(self.children):
                if node is None:
                    continue
                radius = (_root(best[rows]) * (1 + _SLACK))[:, None]
                met = (low - radius <= self.high[:, child]) & (high + radius >= self.low[:, child])
                left = ((near == child) == own) & met.all(axis=1)
                if left.any():
                    node.search(queries, rows[left], best, found)


class Codebook:
    """The entries of one part."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.tree = entries, None

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and exact squared distance of the nearest entry, ties to the lower index."""
        entries, parts = _alike(self.entries, parts)
        if self.tree is None or self.tree.entries.dtype != entries.dtype:
            self.tree = Gnat(entries, np.arange(len(entries)))
        best, found = np.zeros(len(parts), dtype=parts.dtype), np.full(len(parts), -1, dtype=np.int64)
        for i in range(0, len(parts), CHUNK):
            self.tree.search(parts, np.arange(i, min(i + CHUNK, len(parts))), best, found)
        return found, best


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    """The integers of the batch's vectors, whose lengths are all ``dim``."""
    flat = batch.column(batch.schema.get_field_index("v")).flatten().to_numpy(zero_copy_only=False)
    return _integers(flat.reshape(batch.num_rows, dim) if dim else np.zeros((batch.num_rows, 0)))


def _cut(vectors: np.ndarray, parts: int) -> list[np.ndarray]:
    width = vectors.shape[1] // parts
    return [vectors[:, p * width:(p + 1) * width] for p in range(parts)]


def _sums(books: list[Codebook], dim: int):
    """Task-wise sums of the parts of each entry, as decimal texts: at most one row for each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], list] = {}
        for batch in batches:
            for p, part in enumerate(_cut(_vectors(batch, dim), len(books))):
                found, _ = books[p].nearest(part)
                order = np.argsort(found, kind="stable")
                which, first = np.unique(found[order], return_index=True)
                sums = np.add.reduceat(part[order], first, axis=0) if part.shape[1] else np.zeros((len(which), 0), dtype=object)
                for e, n, s in zip(which.tolist(), np.diff(np.append(first, len(found))).tolist(), sums.tolist()):
                    old = total.get((p, e))
                    total[p, e] = [n, s] if old is None else [old[0] + n, [a + b for a, b in zip(old[1], s)]]
        rows = [(p, e, n, [str(x) for x in s]) for (p, e), (n, s) in total.items()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(
            zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string())))], ["part", "entry", "n", "sums"])

    return run


def _merge(rows):
    """One row for an entry: floor(sum / count); a group has a row for each task at most."""
    n = int(rows["n"].sum())
    sums = [sum(int(x) for x in column) for column in zip(*rows["sums"])]
    rows = rows.head(1).copy()
    rows["sums"] = [[str(s // n) for s in sums]]
    return rows


def train(vectors: DataFrame, dim: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[Codebook]:
    """Codebooks: first the parts of the first vectors by id, then means of what is nearest, round by round.

    A task sends one row of sums for each entry; the driver gets as many numbers as the codebooks have.
    """
    first = vectors.orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    start = _integers(np.array([r.v for r in first], dtype=np.float64).reshape(len(first), dim))
    books = [Codebook(p) for p in _cut(start, parts)]
    for _ in range(rounds if first else 0):
        means = vectors.select("v").mapInArrow(_sums(books, dim), "part int, entry int, n long, sums array<string>")
        means = means.groupBy("part", "entry").applyInPandas(_merge, "part int, entry int, n long, sums array<string>")
        new = [b.entries.astype(object) for b in books]
        for r in means.collect():
            new[r.part][r.entry] = [int(x) for x in r.sums]
        books = [Codebook(_alike(e)[0]) for e in new]
    return books


def _encode(books: list[Codebook], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [books[p].nearest(part) for p, part in enumerate(_cut(_vectors(batch, dim), len(books)))]
            errors = sum(best.astype(object) for _, best in got)
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1),
                pa.array(["".join(f"{c:02x}" for c in row) for row in zip(*(found.tolist() for found, _ in got))], pa.string()),
                pa.array([int(e) if e < 1 << 63 else None for e in errors], pa.int64())], ["id", "label", "code", "error"])

    return run


def digest(books: list[Codebook]) -> str:
    """SHA-256 of all components by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(x) for b in books for x in b.entries.ravel().tolist()).encode()).hexdigest()


def compress(table: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    ``label_error`` adds the errors of all rows of a label; rows without a label are one group.
    """
    if not 1 <= entries <= 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    rows = table.select(F.col("vec_id").alias("id"), F.col("label").alias("label"), F.col("embedding").alias("v")).where(usable(F.col("v")))
    first = rows.orderBy(F.col("id").asc_nulls_last(), "v").limit(1).collect()
    dim = len(first[0].v) if first else 0
    fits = F.lit(dim % parts == 0) & (F.size("v") == dim)
    books = train(rows.where(fits), dim, parts, entries, rounds) if first and dim % parts == 0 else []
    types = f"id {rows.schema['id'].dataType.simpleString()}, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    odd = rows.where(~fits).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    coded = rows.where(fits).select("id", "label", "v").mapInArrow(_encode(books, dim), types).union(odd) if books else odd
    coded = materialize(coded, "vector-codes")
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    return coded.join(labels, F.col("label").eqNullSafe(F.col("of")), "left").select(
        F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
