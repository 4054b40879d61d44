"""Conflict-constrained best-fit packing.

Pieces of documents go to the tightest bin that has room and no conflict. Open bins are ordered by
the room left in them; each carries a bitmap of the sources and one of the duplicate clusters it
holds. The search starts at the least room that fits and goes from successor to successor until a
compatible bin is found; if there is none, a bin is opened.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from veritab.session import materialize, materialize_counted

CAPACITY = 8192

#: Pieces packed together in one task, about.
SHARD_ROWS = 4_000


def best_fit(sizes: list[int], sources: list, clusters: list, capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) for each piece, in the given order.

    Two pieces of one cluster never share a bin, and neither do two of one source. A null source or
    cluster conflicts with nothing. Values that occur once need no bit. A piece of the whole
    capacity has a bin of its own at once.
    """
    bit_of: list[dict] = []
    for values in (sources, clusters):
        often = [v for v, n in Counter(values).items() if n > 1 and v is not None]
        bit_of.append({v: 1 << i for i, v in enumerate(often)})
    room: list[int] = []  # distinct rooms of open bins, ascending
    bins: dict[int, dict[tuple[int, int], list[int]]] = {}  # room -> bitmaps -> bins, each a stack
    placed: list[tuple[int, int]] = []
    count = 0
    for size, source, cluster in zip(sizes, sources, clusters):
        s, c = bit_of[0].get(source, 0), bit_of[1].get(cluster, 0)
        found = None
        for at in range(bisect_left(room, size), len(room)):
            # Bins of equal room and bitmaps are alike: one test stands for all of them.
            found = next(((room[at], key) for key in bins[room[at]] if not (key[0] & s or key[1] & c)), None)
            if found:
                break
        if found:
            left, key = found
            alike = bins[left][key]
            number = alike.pop()
            if not alike:
                del bins[left][key]
                if not bins[left]:
                    del bins[left]
                    room.pop(bisect_left(room, left))
        else:
            left, key, number = capacity, (0, 0), count
            count += 1
        placed.append((number, capacity - left))
        if size < left:
            rest = left - size
            if rest not in bins:
                bins[rest] = {}
                insort(room, rest)
            bins[rest].setdefault((key[0] | s, key[1] | c), []).append(number)
    return placed


def cluster_of(text: Column) -> Column:
    """Documents whose texts differ in case and white space only are duplicates."""
    return F.xxhash64(F.trim(F.regexp_replace(F.lower(text), r"\s+", " ")))


def character_starts(text: Column, capacity: int) -> Column:
    """Byte offsets at which a text is cut into pieces of at most ``capacity`` bytes, the first 0; none lies within a character.

    A text with characters of several bytes is cut a little earlier, so that a cut can move back to the start of
    its character, three bytes at most.
    """
    if capacity < 7:
        raise ValueError("a piece must be longer than a cut moves back, and hold a character of four bytes: 7 bytes at least")
    data, size = text.cast("binary"), F.octet_length(text).cast("long")
    width = F.when(size == F.length(text), F.lit(capacity)).otherwise(F.lit(capacity - 3)).cast("long")

    def inside(at: Column) -> Column:
        """Is the byte one that goes on a character?"""
        byte = F.hex(F.substring(data, (at + 1).cast("int"), F.lit(1)))
        return (byte >= "80") & (byte < "C0")

    def start(i: Column) -> Column:
        at = i * width
        return F.when(at == 0, at).when(~inside(at), at).when(~inside(at - 1), at - 1).when(~inside(at - 2), at - 2).otherwise(at - 3)

    last = F.greatest(F.lit(0).cast("long"), F.floor((size - 1) / width))
    return F.transform(F.sequence(F.lit(0).cast("long"), last), start)


def pieces(docs: DataFrame, size: Column, cluster: Column, source: Column, capacity: int = CAPACITY, starts: Column | None = None) -> DataFrame:
    """Documents cut into pieces of at most ``capacity``: doc_id, row, piece, start, size, source, cluster.

    They are cut at ``starts``, by default at multiples of the capacity. A document of size 0 is one piece of size 0. ``row`` tells rows apart,
    repeated ones too; write the result down before using it twice.
    """
    last = F.greatest(F.lit(0).cast("long"), F.floor((size.cast("long") - 1) / capacity))
    if starts is None:
        starts = F.transform(F.sequence(F.lit(0).cast("long"), last), lambda i: i * capacity)
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), size.cast("long").alias("whole"),
                       source.cast("string").alias("source"), cluster.cast("long").alias("cluster"), starts.alias("starts"))
    cut = rows.select("doc_id", "row", "whole", "source", "cluster", F.explode(F.arrays_zip(
        F.sequence(F.lit(0).cast("long"), F.size("starts").cast("long") - 1).alias("piece"), F.col("starts").alias("start"),
        F.slice(F.concat("starts", F.array("whole")), F.lit(2), F.size("starts")).alias("stop"))).alias("p"))
    return cut.select("doc_id", "row", "p.piece", "p.start", (F.col("p.stop") - F.col("p.start")).alias("size"), "source", "cluster")


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS, size: Column | None = None,
         cluster: Column | None = None, source: Column | None = None) -> DataFrame:
    """Where each piece of each document goes: doc_id, piece, start, size, bin, offset, bin_size.

    ``size`` counts UTF-8 bytes unless given, and then texts are cut between characters; ``cluster`` is the hash of the normalised text and
    ``source`` the column of that name. Pieces are dealt at random over shards of about
    ``shard_rows`` and packed there, largest first, so hot sources and large groups of copies
    spread evenly and no task holds a whole group. Within a bin no two pieces are of one source or cluster;
    bins are numbered shard by shard. A null text is an empty document, a null source or cluster
    conflicts with nothing; repeated rows are documents of one cluster and so go to different bins; an
    empty table gives no rows. Other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    cut = pieces(docs, F.octet_length(text) if size is None else size,
                 F.when(F.length(F.trim(text)) > 0, cluster_of(text)) if cluster is None else cluster,
                 F.col("source") if source is None else source, capacity, character_starts(text, capacity) if size is None else None)
    cut, count = materialize_counted(cut, "pieces")
    shards = max(1, -(-count // shard_rows))

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "doc_id", "row", "piece"], ascending=[False, True, True, True], kind="stable")
        blank = part["source"].isna(), part["cluster"].isna()
        columns = [[None if b else v for v, b in zip(part[c], gone)] for c, gone in zip(("source", "cluster"), blank)]
        placed = best_fit(part["size"].tolist(), *columns, capacity)
        part = part.assign(bin=[key[0] << 32 | b for b, _ in placed], offset=[o for _, o in placed])
        part["bin_size"] = part.groupby("bin")["size"].transform("sum")
        return part[["doc_id", "piece", "start", "size", "bin", "offset", "bin_size"]]

    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = cut.withColumn("shard", F.pmod(F.xxhash64("row", "piece", F.lit(7)), F.lit(shards)))
    # As text on the way: pandas has no null among integers.
    dealt = dealt.withColumn("doc_id", F.col("doc_id").cast("string"))
    out = dealt.groupBy("shard").applyInPandas(
        run, "doc_id string, piece long, start long, size long, bin long, offset long, bin_size long")
    return out.withColumn("doc_id", F.col("doc_id").cast(kind))


def bins(packed: DataFrame) -> DataFrame:
    """One row for each bin: its size and the doc_ids in it, by offset; a bin holds ``CAPACITY`` pieces at most."""
    return packed.groupBy("bin", "bin_size").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("offset", "piece", "doc_id"))), lambda x: x["doc_id"]).alias("doc_ids"))
