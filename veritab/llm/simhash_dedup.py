"""SimHash near-duplicates by pivot distance tables.

Every distinct fingerprint gets its Hamming distances to a table of reference fingerprints.
Two fingerprints at distance r differ by at most r in every such coordinate (triangle
inequality), and, as only r bits can differ, at least ``BLOCKS - r`` of the bit blocks have
equal coordinates to all references of the block. Pairs that agree in the coordinates of
``BLOCKS - r`` blocks meet; a pair is discarded when the largest coordinate difference
over the whole-width references exceeds r, and what survives is verified by exact distance.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import LOWER_ASCII, ROWS, components, unused
from veritab.session import materialize

SPACE = "\x20\t\n\x0b\x0c\r"

#: References over all 64 bits, and over a block; any fixed numbers do.
_R = np.random.default_rng(2024)
PIVOTS = _R.integers(0, 2**64, 16, dtype=np.uint64)
BLOCK_PIVOTS = _R.integers(0, 2**64, 24, dtype=np.uint64)

#: Rows of one key that are compared in one task; longer keys are dealt out over pairs of parts.
KEY_ROWS = 4096


def words_of(text: str) -> list[str]:
    """Words between the six ASCII white-space characters."""
    if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f"):
        return text.split()
    return [w for w in text.translate(_TO_SPACE).split(" ") if w]


_TO_SPACE = {ord(c): " " for c in SPACE}


def fingerprint(text: str | None, shingle: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; 0 without words."""
    words = words_of((text or "").translate(LOWER_ASCII))
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxhash.xxh64_intdigest(" ".join(words), seed)]
    else:
        digest = xxhash.xxh64_intdigest
        hashes = [digest(s, seed) for s in map(" ".join, zip(*(words[i:] for i in range(shingle))))]
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):
        part = np.array(hashes[at:at + 8192], ">u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, *keep: str) -> DataFrame:
    """``docs`` reduced to ``keep`` (default doc_id) with ``fp``, the fingerprint as a signed long."""
    keep = keep or ("doc_id",)
    fields = docs.select(*keep).schema.simpleString()[len("struct<"):-1].replace(":", " ").replace(",", ", ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                fp = np.array([fingerprint(t, shingle) for t in part.column(part.num_columns - 1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(fp.view(np.int64))], [*keep, "fp"])

    return docs.select(*keep, "text").mapInArrow(run, f"{fields}, fp long")


def _blocks(radius: int) -> list[np.uint64]:
    """Masks of radius + 2 blocks of the 64 bits."""
    cuts = np.linspace(0, 64, radius + 3).round().astype(int)
    return [np.uint64(sum(1 << b for b in range(lo, hi))) for lo, hi in zip(cuts, cuts[1:])]


def _keys(fps: np.ndarray, radius: int) -> list[np.ndarray]:
    """For every two blocks one key per fingerprint: a hash of its distances to the references of these blocks."""
    tables = []
    for i, mask in enumerate(_blocks(radius)):
        table = np.full(len(fps), i + 1, np.uint64)
        for pivot in BLOCK_PIVOTS:
            distance = np.bitwise_count((fps ^ pivot) & mask).astype(np.uint64)
            table = (table ^ distance) * np.uint64(0x9E3779B97F4A7C15)
            table ^= table >> np.uint64(29)
        tables.append(table)
    return [(a * np.uint64(0xBF58476D1CE4E5B9)) ^ b for a, b in combinations(tables, 2)]


def _keyed(nodes: DataFrame, radius: int) -> DataFrame:
    """A row (key, node, fp) for every two blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            for keys in _keys(fps, radius):
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *batch.columns], ["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp long")


def _links(fps: np.ndarray, nodes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Links that connect whatever is connected among the fingerprints of one key."""
    table = np.bitwise_count(fps[:, None] ^ PIVOTS).astype(np.int8)
    left = np.ones(len(fps), bool)
    for start in range(len(fps)):
        if not left[start]:
            continue
        left[start] = False
        front = [start]
        while front:
            i = front.pop()
            rest = np.flatnonzero(left)
            rest = rest[np.abs(table[rest] - table[i]).max(axis=1, initial=0) <= radius]
            rest = rest[np.bitwise_count(fps[rest] ^ fps[i]) <= radius]
            left[rest] = False
            for j in rest:
                yield int(nodes[i]), int(nodes[j])
                front.append(j)


def links(nodes: DataFrame, radius: int, key_rows: int = KEY_ROWS) -> DataFrame:
    """Links ``a``, ``b`` between the nodes of distinct fingerprints; their components are those of all
    links within ``radius`` bits. ``nodes`` has ``node`` and ``fp``.

    A key with more than ``key_rows`` rows is split into parts and every two parts meet in a task
    of their own, so that no task holds more than two parts; nothing is dropped.
    """
    keyed = materialize(_keyed(nodes, radius), "pivot-keys")
    size = keyed.groupBy("key").count().where("count > 1")
    parts = size.select("key", F.ceil(F.col("count") / key_rows).cast("int").alias("parts"))
    dealt = (keyed.join(parts, "key")
             .withColumn("own", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int"))
             .withColumn("other", F.explode(F.when(F.col("parts") == 1, F.array(F.lit(0)))
                                            .otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
             .select("key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "node", "fp"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: list[tuple[int, int]] = []

        def groups(table: pa.Table) -> None:
            key, lo, hi, node, fp = (c.to_numpy() for c in table.columns)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])) + 1
            for a, b in zip([0, *cuts], [*cuts, len(key)]):
                if b - a > 1:
                    out.extend(_links(fp[a:b].view(np.uint64), node[a:b], radius))

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
            # Work on the groups that have ended; rows come in the order of their groups.
            if sum(b.num_rows for b in held) > 4 * key_rows:
                table = pa.Table.from_batches(held).combine_chunks()
                last = [c[-1].as_py() for c in table.columns[:3]]
                key, lo, hi = (c.to_numpy() for c in table.columns[:3])
                end = int(np.argmax((key == last[0]) & (lo == last[1]) & (hi == last[2])))
                groups(table.slice(0, end))
                held = table.slice(end).to_batches()
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])
                out.clear()
        if held:
            groups(pa.Table.from_batches(held).combine_chunks())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*out)], ["a", "b"])

    return (dealt.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
            .mapInArrow(run, "a long, b long").distinct())


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """``doc_id``, ``fingerprint`` (16 hex digits) and ``component_id`` for each row of ``docs``.

    Null or blank texts have fingerprint 0 and link like any other. Rows with equal fingerprints
    collapse to one node before pairs are sought, so groups of copies cost one row. A null doc_id
    counts in its group but never is the smallest; a component of null ids only has a null id.
    An empty table gives no rows; repeated rows give repeated rows. Other columns are not read.
    """
    rows = materialize(fingerprints(docs, shingle), "simhash")
    return _classes(rows, radius).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _classes(rows: DataFrame, radius: int) -> DataFrame:
    """``rows`` (doc_id, fp, ...) with ``component_id``, the smallest doc_id of the component."""
    nodes = materialize(
        rows.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.col("fp")), "simhash-nodes")
    roots = materialize(components(links(nodes, radius)), "simhash-roots")
    named = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "component_id"), "fp")


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row of each component of near-duplicates: the smallest doc_id, then the smallest hash of its row.

    All columns are kept. Null ids come after all others; equal rows of one id leave one row.
    """
    names, h = docs.columns, unused(docs, "row_hash")
    tagged = docs.withColumn(h, F.xxhash64(*[F.col(f"`{c}`") for c in names]))
    rows = materialize(
        fingerprints(tagged.select("doc_id", F.col(h).alias("h"), "text"), shingle, "doc_id", "h"), "simhash")
    nodes = materialize(
        rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "h")).alias("best")),
        "simhash-nodes")
    roots = materialize(components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius)), "simhash-roots")
    kept = (nodes.join(roots, nodes.fp == roots.node, "left")
            .groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("best").alias("best")))
    kept = kept.select(F.col("best.doc_id").alias(unused(tagged, "kept_id")), F.col("best.h").alias(unused(tagged, "kept_hash")))
    same = (F.col(h) == kept[kept.columns[1]]) & tagged["doc_id"].eqNullSafe(kept[kept.columns[0]])
    return tagged.join(kept, same, "left_semi").dropDuplicates(["doc_id", h]).select(*[F.col(f"`{c}`") for c in names])
