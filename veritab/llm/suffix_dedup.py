"""Long repeats by column-wise construction of a collection's Burrows-Wheeler order.

A string of ``T`` bytes that occurs twice holds, at both places, the same anchor: the smallest
``K``-byte hash in it. So the repeats are found among the contexts of anchors, each the ``D = T - K``
bytes before an anchor and the ``T`` bytes from it on. The contexts of one anchor hash are a small
collection of documents, and its suffixes are sorted column by column: every round inserts one symbol
per document, in front of what is there, and takes the order, the classes of equal beginnings and
the common prefixes over from the round before (a stable sort by the new symbol). After round r
a document's suffix starts r bytes before its anchor; its window of ``T`` bytes is repeated if a neighbour
in the order shares ``T`` symbols. Between the steps everything lies in tables of the scratch
folder that are written and read in sequence; no step holds a whole group of copies: equal contexts are one row,
and groups of many different contexts are split by windows until they are small.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import ROWS, many_per_row, per_row
from veritab.session import materialize, materialize_counted

T, K = 400, 64
D = T - K

#: Different contexts of one anchor that are sorted together; larger groups are split by windows.
GROUP_ROWS = 20_000
#: Contexts that one task sorts, about.
BUCKET_ROWS = 8_000
#: Windows whose anchors are sought at a time.
BLOCK = 1 << 18
#: Bits of the filter that keeps untouched texts out of shuffles, for each touched document, and the most of all: 256 MB.
#: Beyond that more untouched texts get through; results stay the same.
FILTER_SHARE, FILTER_MOST = 16, 1 << 31
#: Words of a passage that is reported when documents share it, and of the pieces it is found by.
PASSAGE, PIECE = 51, 32

_BASE = 0x9E3779B97F4A7C15
_BYTES = np.random.default_rng(41).integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


@lru_cache(maxsize=1)
def _powers(n: int = BLOCK + 4 * T) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 2**64)):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def content_id(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def anchors(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the anchors, the hash at each, and the hash of its whole context."""
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    up, down = _powers()
    whole = np.frombuffer(data, np.uint8)
    for first in range(0, len(data) - T + 1, BLOCK):
        windows = min(BLOCK, len(data) - T + 1 - first)
        lo, hi = max(0, first - D), min(len(data), first + windows + 2 * T)
        part = whole[lo:hi]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(_BYTES[part] * up[:len(part)], out=total[1:])
        at = first - lo
        grams = np.arange(at, at + windows + D)
        h = _mix((total[grams + K] - total[grams]) * down[grams])
        # Least hash of each window, the first of equals, by doubling the span.
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= D + 1:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        rest = D + 1 - span
        if rest:
            least = np.minimum(least[:-rest], least[rest:])
        pick = np.unique(least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        pos = grams[pick]
        a, b = np.maximum(pos - D, 0), np.minimum(pos + T, len(part))
        sides = (pos - a).astype(np.uint64) * np.uint64(1009) + (b - a).astype(np.uint64)
        found.append((pos + lo, h[pick], _mix((total[b] - total[a]) * down[a] ^ _mix(sides))))
    if not found:
        return (np.zeros(0, np.int64),) + (np.zeros(0, np.uint64),) * 2
    pos, kh, sh = (np.concatenate(x) for x in zip(*found))
    pos, keep = np.unique(pos, return_index=True)  # blocks overlap
    return pos, kh[keep], sh[keep]


def repeated_windows(groups: list[int], lefts: list[bytes], rights: list[bytes], lo: int, hi: int) -> np.ndarray:
    """For each context and each r from ``lo`` to ``hi``: does its window that starts r bytes before the
    anchor occur in another context of its group?"""
    n = len(groups)
    out = np.zeros((n, hi - lo + 1), bool)
    width = T - lo
    start = sorted(range(n), key=lambda i: (groups[i], rights[i]))
    order = np.array(start, np.int64)
    rank = np.empty(n, np.int64)
    rank[order] = np.arange(n)
    llen, rlen = np.array([len(x) for x in lefts]), np.array([len(x) for x in rights])
    right = np.frombuffer(b"".join(rights[i].ljust(width, b"\0") for i in start), np.uint8).reshape(n, width)
    # Columns to insert, nearest to the anchor first.
    left = np.frombuffer(b"".join(x[::-1].ljust(hi, b"\0") for x in lefts), np.uint8).reshape(n, hi) if hi else None
    gid = np.array(groups)[order]
    # Common prefixes of neighbours in the order of what follows the anchors.
    common = np.zeros(n, np.int64)
    for at in range(1, n, 4096):
        a, b = right[at - 1:min(n, at + 4096) - 1], right[at:at + 4096]
        differ = a != b
        common[at:at + 4096] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    ends = rlen[order]
    common[1:] = np.minimum(common[1:], np.minimum(ends[1:], ends[:-1]))
    new_group = np.ones(n, bool)
    new_group[1:] = gid[1:] != gid[:-1]
    common[new_group] = 0
    begins = new_group  # in the current order: does a class of equal inserted symbols begin here?
    for r in range(hi + 1):
        if r:
            classes = np.cumsum(begins)
            has = llen[order] >= r
            order, classes = order[has], classes[has]
            symbols = left[order, r - 1]
            sort = np.argsort(symbols, kind="stable")
            order, classes, symbols = order[sort], classes[sort], symbols[sort]
            begins = np.ones(len(order), bool)
            begins[1:] = (symbols[1:] != symbols[:-1]) | (classes[1:] != classes[:-1])
        # A document alone in its class stays alone.
        if len(order):
            single = begins & np.append(begins[1:], True)
            order, begins = order[~single], begins[~single]
        if not len(order):
            break
        if r >= lo:
            classes = np.cumsum(begins)
            fits = rlen[order] >= T - r
            own, cls = order[fits], classes[fits]
            tail = np.cumsum(common < T - r)[rank[own]]
            same = (cls[1:] == cls[:-1]) & (tail[1:] == tail[:-1])
            out[own[1:][same], r - lo] = True
            out[own[:-1][same], r - lo] = True
    return out


def runs(rows: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(row, first, last) of the runs of true values."""
    edge = np.zeros((rows.shape[0], 1), np.int8)
    step = np.diff(np.concatenate([edge, rows.astype(np.int8), edge], axis=1), axis=1)
    a, b = np.nonzero(step == 1), np.nonzero(step == -1)
    yield from zip(a[0].tolist(), a[1].tolist(), (b[1] - 1).tolist())


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _anchor_rows(docs: DataFrame) -> DataFrame:
    """A row for each document of T bytes or more: cid, doc_id, and its anchors as arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                cids, lists = [], ([], [], [])
                for text in part.column(1).to_pylist():
                    data = text.encode()
                    cids.append(content_id(data))
                    pos, kh, sh = anchors(data)
                    for to, values in zip(lists, (pos, kh.view(np.int64), sh.view(np.int64))):
                        to.append(values)
                arrays = [pa.ListArray.from_arrays(
                    pa.array(np.concatenate([[0], np.cumsum([len(v) for v in to])]), pa.int32()),
                    pa.array(np.concatenate(to) if to else np.zeros(0, np.int64))) for to in lists]
                yield pa.RecordBatch.from_arrays([pa.array(cids, pa.binary()), part.column(0), *arrays],
                                                 ["cid", "doc_id", "pos", "kh", "sh"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.where(F.octet_length("text") >= T).select("doc_id", "text")
            .mapInArrow(run, f"cid binary, doc_id {kind}, pos array<long>, kh array<long>, sh array<long>"))


#: Bits of one row of a bitmap as Spark makes them.
_BLOCK_BITS = 32_768


def _filter_bits(rows: int) -> int:
    """A power of two that gives each of the rows ``FILTER_SHARE`` bits, one block at least."""
    return min(FILTER_MOST, max(_BLOCK_BITS, 1 << (FILTER_SHARE * rows).bit_length()))


def _place(bits: int):
    """Bit of a document; from 0."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(bits))


def _bitmap(ids: DataFrame, bits: int) -> np.ndarray:
    """Bits set at the hashes of the doc_ids."""
    block, inside = F.shiftright("b", 15), F.pmod(F.col("b"), F.lit(_BLOCK_BITS))
    rows = ids.select(_place(bits).alias("b")).distinct().groupBy(block.alias("block")).agg(
        F.call_function("bitmap_construct_agg", inside).alias("map"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.toLocalIterator():
        at = r.block * (_BLOCK_BITS // 8)
        out[at:at + len(r.map)] = np.frombuffer(bytes(r.map), np.uint8)
    return out


def _packed_texts(docs: DataFrame, bitmap: np.ndarray) -> DataFrame:
    """doc_id and deflated text of the documents that the filter lets through (some more than needed)."""
    sent = docs.sparkSession.sparkContext.broadcast(bitmap)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = sent.value
        for batch in batches:
            b = batch.column(1).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)))
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                z = [zlib.compress(t.encode(), 1) for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])

    return docs.where(F.octet_length("text") >= T).select("doc_id", _place(8 * len(bitmap)).alias("b"), "text").mapInArrow(
        run, f"doc_id {kind}, z binary")


def _gid(*parts) -> int:
    return int.from_bytes(hashlib.blake2b(repr(parts[:-1]).encode() + parts[-1], digest_size=8).digest(), "big", signed=True)


def _split_hot(contexts: DataFrame, group_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """Contexts in groups of at most ``group_rows``, and the spans (cid, s, e) found on the way.

    A larger group has its range of windows halved: each half needs more equal bytes, so its groups are
    smaller, and contexts that are equal on all bytes of a half are one row from then on. A half
    of one window has one row per group, so this ends.
    """
    cold, spans = None, None
    while True:
        hot = contexts.groupBy("gid", "lo", "hi").count().where(F.col("count") > group_rows).drop("count")
        hot, count = materialize_counted(hot, "hot-anchors")
        if not count:
            return contexts if cold is None else cold.unionByName(contexts), spans
        keys = ["gid", "lo", "hi"]
        rest = contexts.join(hot, keys, "left_anti")
        cold = rest if cold is None else cold.unionByName(rest)

        def halves(cid, pos, lo, hi, left, right):
            mid = (lo + hi) // 2
            for a, b in ((lo, mid), (mid + 1, hi)):
                if a > b or len(left) < a or len(right) < T - b:
                    continue
                l, r = left[max(0, len(left) - b):], right[:T - a]
                core = left[len(left) - a:] + right[:T - b]
                yield cid, pos, _gid(a, b, core), a, b, _gid(a, b, len(l), l + r), l, r

        half = materialize(many_per_row(
            contexts.join(hot, keys), halves,
            "cid binary, pos long, gid long, lo int, hi int, sh long, left binary, right binary",
            "cid", "pos", "lo", "hi", "left", "right"), "halves")
        same = ["gid", "lo", "hi", "sh"]
        # Written down on its own, so that the join can split a span that stands in very many places.
        places = materialize(half.groupBy(*same).agg(F.count("*").alias("places"), F.min(F.struct("cid", "pos")).alias("m")),
                             "halves-places")
        told = materialize(half.join(places, same), "halves-told")
        s = F.col("pos") - F.least(F.octet_length("left"), F.col("hi"))
        e = F.col("pos") + F.least(F.octet_length("right"), T - F.col("lo"))
        found = told.where("places > 1").select("cid", s.alias("s"), e.alias("e"))
        spans = found if spans is None else spans.unionByName(found)
        contexts = told.where(F.col("m") == F.struct("cid", "pos")).select(
            "cid", "pos", "gid", "lo", "hi", "left", "right")


def _sorted_spans(contexts: DataFrame, count: int, bucket_rows: int) -> DataFrame:
    """Spans (cid, s, e) of the repeated windows within the groups."""
    buckets = max(1, -(-count // bucket_rows))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        rows: list[tuple[bytes, int, int]] = []
        for (lo, hi), same in part.groupby(["lo", "hi"]):
            cids, pos = same["cid"].tolist(), same["pos"].tolist()
            hits = repeated_windows(same["gid"].tolist(), [bytes(x) for x in same["left"]], [bytes(x) for x in same["right"]],
                                    int(lo), int(hi))
            rows += [(cids[i], pos[i] - (lo + b), pos[i] - (lo + a) + T) for i, a, b in runs(hits)]
        return pd.DataFrame(rows, columns=["cid", "s", "e"])

    return (contexts.withColumn("bucket", F.pmod(F.xxhash64("gid", "lo", "hi"), F.lit(buckets)))
            .groupBy("bucket").applyInPandas(run, "cid binary, s long, e long"))


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, sha256 of the text, ``spans`` (start, end in bytes) covered by
    strings of ``T`` bytes that also start anywhere else, and ``kept``, the rest (null where nothing is removed).

    Null texts are empty; texts under T bytes keep all. Copies of a text of T bytes or more, repeated
    rows included, are removed whole, the first as well. An empty table gives no rows. Null ids are ids
    like others. Columns other than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = docs.select("doc_id", text.alias("text"))
    ids = docs.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("sha256"))
    ids = materialize(ids.withColumn("cid", F.unhex(F.substring("sha256", 1, 32))), "contents")

    # One row per content of T bytes or more, with its anchors; copies have the same ones.
    content = materialize(_anchor_rows(docs).groupBy("cid").agg(
        F.count("*").alias("copies"), F.min("doc_id").alias("doc_id"), F.first(F.arrays_zip("pos", "kh", "sh")).alias("anchors")),
        "anchors")
    each = content.select("cid", "doc_id", "copies", F.explode("anchors").alias("x")).select("cid", "doc_id", "copies", "x.*")
    spread = materialize(each.groupBy("kh", "sh").agg(
        F.count("*").alias("places"), F.min(F.struct("cid", "pos", "doc_id")).alias("m")), "anchor-contexts")
    # Written down on its own, so that the join with it can split an anchor of very many contexts.
    often = materialize(spread.groupBy("kh").agg(F.count("*").alias("contexts"), F.sum("places").alias("total")).where("total > 1"),
                        "repeated-hashes")
    repeated = materialize(spread.join(often, "kh").select("kh", "sh", "places", "contexts", "m.*"), "repeated-anchors")

    # A context that stands in several places is repeated as a whole.
    whole = materialize(each.where("copies = 1").join(repeated.where("places > 1").select("kh", "sh"), ["kh", "sh"]).select(
        "cid", "doc_id", "pos"), "whole-contexts")

    # Contexts that share an anchor with different ones are cut out of the texts.
    wanted = repeated.where("contexts > 1").groupBy("doc_id", "cid").agg(
        F.collect_list(F.struct("pos", "kh", (F.col("places") == 1).alias("single"))).alias("at"))
    touched, rows = materialize_counted(
        repeated.where("contexts > 1").select("doc_id").union(whole.select("doc_id")).distinct(), "touched")
    texts = _packed_texts(docs, _bitmap(touched, _filter_bits(rows)))

    def cut(z, cid, at):
        data = zlib.decompress(z)
        if content_id(data) == cid:
            for x in at:
                p = x["pos"]
                yield cid, p, x["kh"], 0, D, data[max(0, p - D):p], data[p:p + T]

    contexts, count = materialize_counted(many_per_row(
        texts.join(wanted, texts.doc_id.eqNullSafe(wanted.doc_id)).select("z", "cid", "at"), cut,
        "cid binary, pos long, gid long, lo int, hi int, left binary, right binary", "z", "cid", "at"), "contexts")
    small, spans = _split_hot(contexts, group_rows)
    found = _sorted_spans(small, count, bucket_rows)
    found = found if spans is None else found.unionByName(spans)

    # All spans of a content, and its text without them.
    one = content.where("copies = 1").select("cid", "doc_id")
    covered = materialize(
        found.select("cid", "s", "e").unionByName(whole.select(
            "cid", F.greatest(F.lit(0).cast("long"), F.col("pos") - D).alias("s"), (F.col("pos") + T).alias("e")))
        .groupBy("cid").agg(F.collect_set(F.struct("s", "e")).alias("spans")).join(one, "cid"), "spans")
    kind = "cid binary, starts array<long>, ends array<long>, kept binary"

    def rest(z, cid, spans):
        data = zlib.decompress(z)
        if content_id(data) == cid:
            own = merged([(x["s"], min(len(data), x["e"])) for x in spans])
            left, end = [], 0
            for a, b in own:
                left.append(data[end:a])
                end = b
            yield cid, [a for a, _ in own], [b for _, b in own], b"".join([*left, data[end:]])

    cleaned = many_per_row(texts.join(covered, texts.doc_id.eqNullSafe(covered.doc_id)).select("z", "cid", "spans"),
                           rest, kind, "z", "cid", "spans").dropDuplicates(["cid"])
    told = content.select("cid", "copies").join(cleaned, "cid", "left").where("copies > 1 or kept is not null")
    out = ids.join(told, "cid", "left")
    copied = F.coalesce(F.col("copies") > 1, F.lit(False))
    zero = F.lit(0).cast("long")
    spans_of = F.when(copied, F.array(F.struct(zero.alias("start"), F.col("n_bytes").alias("end")))).when(
        F.col("kept").isNull(), F.array().cast("array<struct<start:bigint,end:bigint>>")).otherwise(
        F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    return out.select("doc_id", "n_bytes", "sha256", spans_of.alias("spans"),
                      F.when(copied, F.lit(b"")).otherwise(F.col("kept")).alias("kept"))


# Passages by words ---------------------------------------------------------------------


def _word_hashes(data: bytes) -> np.ndarray:
    """A hash for each word, a run of bytes without white space."""
    b = np.frombuffer(data, np.uint8)
    inside = ~((b == 32) | ((b >= 9) & (b <= 13)))
    turn = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8)))
    starts, lengths = turn[::2], turn[1::2] - turn[::2]
    if not len(starts):
        return np.zeros(0, np.uint64)
    power = np.full(int(lengths.max()), _BASE, np.uint64)
    power[0] = 1
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    return _mix(np.add.reduceat(_BYTES[b[inside]] * np.cumprod(power)[place], first))


def _of_runs(values: np.ndarray, n: int, join) -> np.ndarray:
    """One value for each run of ``n`` values; ``join(left, right, size)`` puts runs together, the right one of ``size``."""
    out, size, part, width = None, 0, values, 1
    if len(values) < n:
        return values[:0]
    while n:
        if n & 1:
            if out is None:
                out = part
            else:
                right = part[size:]
                out = join(out[:len(right)], right, width)
            size += width
        n >>= 1
        if n:
            part = join(part[:len(part) - width], part[width:], width)
            width *= 2
    return out


def passage_marks(text: str | None, words: int = PASSAGE, piece: int = PIECE) -> list[int]:
    """Marks of a text: the least hash of the pieces in each run of ``words`` words.

    Texts that share such a run share its mark; texts that share no ``piece`` words share none.
    """
    data, marks = (text or "").encode(), set()
    carried, at = np.zeros(0, np.uint64), 0
    while at < len(data):
        end = min(len(data), at + 8 * BLOCK)
        while end < len(data) and data[end] not in b" \t\n\v\f\r":
            end += 1
        hashes = np.concatenate([carried, _word_hashes(data[at:end])])
        pieces = _of_runs(hashes, piece, lambda left, right, size: left * np.uint64(pow(_BASE, size, 2**64)) + right)
        least = _of_runs(_mix(pieces), words - piece + 1, lambda left, right, size: np.minimum(left, right))
        marks.update(np.unique(least.view(np.int64)).tolist())
        carried, at = hashes[max(0, len(hashes) - words + 1):], end
    return sorted(marks)


def shared_passages(docs: DataFrame) -> DataFrame:
    """Distinct doc_ids of rows that share a passage of ``PASSAGE`` words or more with another row.

    None of them is missed; rows that share fewer than ``PIECE`` words in a row are left out, those between may be in. A mark is
    joined by rows, however many documents hold it.
    """
    kind = docs.schema["doc_id"].dataType.simpleString().replace("bigint", "long")
    marks = per_row(docs, lambda i, t: (i, passage_marks(t)), f"doc_id {kind}, marks array<long>", "doc_id", "text")
    rows = materialize(marks.select("doc_id", F.explode("marks").alias("mark")), "passage-marks")
    shared = rows.groupBy("mark").agg(F.count("*").alias("n")).where("n > 1").select("mark")
    return rows.join(shared, "mark").select("doc_id").distinct()


def digest(removed: DataFrame, shared: DataFrame | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of what ``remove_repeats`` returns; with the ids of ``shared_passages``
    also whether the document is among them."""
    total = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    told = removed.select(
        "doc_id", "n_bytes", total.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.when(F.col("kept").isNull(), F.col("sha256")).otherwise(F.sha2("kept", 256)).alias("kept_sha256"))
    if shared is None:
        return told
    shared = shared.select(F.col("doc_id").alias("of"), F.lit(True).alias("hit"))
    return told.join(shared, F.col("doc_id").eqNullSafe(F.col("of")), "left").select(
        *told.columns, F.coalesce("hit", F.lit(False)).alias("shares_passage"))
