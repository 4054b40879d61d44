"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming blocks,
exact weighted-shingle similarity.

DataFrame functions only. Windows as long as an item are laid where a document shares a five-word
shingle with some item, at the offset the shingle has there, and between two such offsets less than
a window apart; a window without a shared shingle has similarity 0. Items of equal words are one text. Fingerprints of windows and
texts are cut into ``radius + 1`` blocks; two within ``radius`` bits have a block in common, so
that joining on blocks finds all of them. What is within the radius is verified on its shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from veritab.llm.common import unused
from veritab.session import materialize, materialize_counted

#: Shingle rows of the items up to which they are broadcast (24 bytes each); more are joined by shuffles.
BROADCAST_SHINGLES = 1_000_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits; none for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0), F.array().cast("array<string>"))


def _bind(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _starts(w: Column, n: int) -> Column:
    """0-based starts of the shingles of n words; none if there are fewer words."""
    return F.when(F.size(w) >= n, F.sequence(F.lit(0), F.size(w) - n)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(w: Column, n: int) -> Column:
    return F.transform(_starts(w, n), lambda i: F.xxhash64(F.lit(n), *[w[i + k] for k in range(n)]))


def shingle_texts(w: Column, n: int) -> Column:
    return F.transform(_starts(w, n), lambda i: F.array_join(F.slice(w, i + 1, n), " "))


def simhash(w: Column) -> Column:
    """64-bit SimHash of the words, repeats included: a bit is set where over half of the words' hashes set it."""

    def bits(h: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
            lambda acc, b: acc.bitwiseOR(F.when(
                2 * F.size(F.filter(h, lambda x: F.getbit(x, b) == 1)) > F.size(h),
                F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))))

    return _bind(F.transform(w, lambda x: F.xxhash64(x)), bits)


def blocks(fp: Column, radius: int) -> Column:
    """(block number, bits of the block) for radius + 1 blocks."""
    cuts = [round(64 * i / (radius + 1)) for i in range(radius + 2)]
    return F.array(*[
        F.struct(F.lit(i).alias("block"),
                 F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1).cast("long")).alias("bits"))
        for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))])


def _items(benchmark: DataFrame) -> DataFrame:
    """Items with their words and the key of these, which items of equal words share."""
    rows = benchmark.select("item_id", words(F.col("text")).alias("words")).where("size(words) > 0")
    return rows.select("item_id", "words", F.sha2(F.array_join("words", " "), 256).alias("text_id")).distinct()


def _texts(items: DataFrame, shingle: int) -> DataFrame:
    """Different texts, and the shingle length that fits them (shorter ones: all their words)."""
    return items.groupBy("text_id").agg(F.first("words").alias("words")).select(
        "text_id", "words", F.size("words").alias("length"), F.least(F.size("words"), F.lit(shingle)).alias("n"))


def matches(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, radius: int = 16, least: float = 0.8) -> DataFrame:
    """One row for each document and item with a window of similarity ``least`` or more.

    Columns: doc_id, item_id, start (first word of the best window, the earliest of equals), length
    (its words), distance (bits between the fingerprints), similarity. Similarity is the Jaccard
    index of shingle multisets, plain or weighted, whichever is more; a shingle weighs 1 + ln(texts /
    texts that hold it), texts being the different word sequences of the items, and one that no text holds
    as much as one that a single text holds. Null, blank and short texts match nothing;
    items without words match nothing; repeated rows and items of equal text give the row of each
    id once; empty tables give none. Columns other than doc_id, text and item_id, text are not read.
    """
    items = materialize(_items(benchmark), "items")
    best = F.max_by(F.struct("start", "length", "distance", "similarity"), F.struct("similarity", -F.col("start"))).alias("m")
    found = _matches(docs.select("doc_id", "text", F.xxhash64("text").alias("h")), items, shingle, radius, least)
    return (found.groupBy("doc_id", "text_id").agg(best).select("doc_id", "text_id", "m.*")
            .join(items.select("item_id", "text_id"), "text_id").groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "m.*"))


def _matches(docs: DataFrame, items: DataFrame, shingle: int, radius: int, least: float) -> DataFrame:
    texts = materialize(_texts(items, shingle), "item-texts")
    # Shingle lengths in use: the asked one, and shorter ones where texts are that short.
    sizes = sorted(r.n for r in texts.select("n").distinct().collect()) or [shingle]

    # Where does a document share a shingle with an item?
    posted, count = materialize_counted(
        _union(texts.where(F.col("n") == n).select("length", F.posexplode(shingle_hashes(F.col("words"), n)).alias("at", "hash"))
               for n in sizes).distinct(), "item-shingles")
    side = F.broadcast(posted) if count <= BROADCAST_SHINGLES else posted
    bound = docs.select("doc_id", "h", words(F.col("text")).alias("words")).where(F.size("words") >= min(sizes))
    found = _union(
        bound.select("doc_id", "h", F.size("words").alias("size"), F.posexplode(shingle_hashes(F.col("words"), n)).alias("pos", "hash"))
        for n in sizes)
    # The same window may be found by many shingles and for items of one length: once is enough.
    start = F.greatest(F.lit(0), F.least(F.col("pos") - F.col("at"), F.col("size") - F.col("length")))
    laid = materialize(
        found.join(side, "hash").select("doc_id", "h", start.alias("start"), "length").distinct()
        .groupBy("doc_id", "h").agg(F.sort_array(F.collect_list(F.struct("length", "start"))).alias("laid"))
        .withColumn("laid", _between(F.col("laid"))), "windows")

    # Words of the windows and their fingerprints.
    bodies = docs.join(laid, (docs.h == laid.h) & docs.doc_id.eqNullSafe(laid.doc_id)).select(
        docs.doc_id, docs.h, words(F.col("text")).alias("words"), "laid")
    window = bodies.select("doc_id", "h", F.explode(F.transform("laid", lambda x: F.struct(
        x["start"].alias("start"), x["length"].alias("length"), F.slice("words", x["start"] + 1, x["length"]).alias("w")))).alias("x"))
    window = materialize(
        window.select("doc_id", "h", "x.start", "x.length", F.col("x.w").alias("words")).distinct()
        .withColumn("fp", simhash(F.col("words"))), "window-fingerprints")

    # Multi-index join: fingerprints of windows and items of one length that share a block.
    printed = texts.withColumn("fp", simhash(F.col("words")))
    left = window.select("length", "fp").distinct().select("length", "fp", F.explode(blocks(F.col("fp"), radius)).alias("k"))
    right = printed.select("text_id", "length", F.col("fp").alias("item_fp"), F.explode(blocks(F.col("fp"), radius)).alias("k"))
    near = (left.join(right, ["length", "k"])
            .where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= radius)
            .select("length", "fp", "text_id", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))).alias("distance")).distinct())

    # Exact similarity of what is left.
    weighted, known = _weighted(texts, sizes)
    pairs = window.join(near, ["length", "fp"]).join(weighted, ["text_id", "length"])
    return _similar(pairs, known, sizes, least)


def _between(laid: Column) -> Column:
    """The sorted windows, and those between two of one length that are less than it apart."""
    def filled(x: Column, i: Column) -> Column:
        after = F.get(laid, i + 1)
        to = F.when((after["length"] == x["length"]) & (after["start"] - x["start"] < x["length"]), after["start"] - 1)
        return F.transform(F.sequence(x["start"], F.coalesce(to, x["start"])),
                           lambda at: F.struct(at.alias("start"), x["length"].alias("length")))

    return F.flatten(F.transform(laid, filled))


def _union(frames) -> DataFrame:
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f)
    return out


def _weighted(texts: DataFrame, sizes: list[int]) -> tuple[DataFrame, DataFrame]:
    """Texts with their distinct shingles, how often each occurs, and its weight; and what the shingles of several texts
    weigh less than those of one."""
    rows = _union(texts.where(F.col("n") == n).select("text_id", "length", "n", F.explode(shingle_texts(F.col("words"), n)).alias("s"))
                  for n in sizes).groupBy("text_id", "length", "n", "s").agg(F.count("*").alias("times"))
    held = rows.groupBy("s").agg(F.log(F.count("*")).alias("less"))
    known, count = materialize_counted(held.where("less > 0"), "shared-shingles")
    side = F.broadcast(known) if count <= BROADCAST_SHINGLES else known
    total = texts.agg((1 + F.log(F.count("*"))).alias("rarest"))
    # The total is one row.
    return (rows.join(side, "s", "left").join(F.broadcast(total), F.lit(True))
            .withColumn("weight", F.col("rarest") - F.coalesce("less", F.lit(0.0)))
            .groupBy("text_id", "length", "n")
            .agg(F.collect_list(F.struct("s", "times", "weight")).alias("shingles"), F.max("rarest").alias("rarest"))), side


def _similar(pairs: DataFrame, known: DataFrame, sizes: list[int], least: float) -> DataFrame:
    """Pairs of windows and texts of similarity ``least`` or more."""
    own = None
    for n in sizes:
        of_n = shingle_texts(F.col("words"), n)
        own = F.when(F.col("n") == n, of_n) if own is None else own.when(F.col("n") == n, of_n)

    def parts(ws: Column) -> Column:
        met = F.transform("shingles", lambda x: F.struct(
            x["times"].alias("times"), x["weight"].alias("weight"),
            F.size(F.filter(ws, lambda s: s == x["s"])).alias("seen")))

        def of(m: Column) -> Column:
            zero = F.lit(0.0)
            return F.struct(
                F.aggregate(m, zero, lambda a, x: a + x["weight"] * F.least(x["times"], x["seen"])).alias("common"),
                F.aggregate(m, zero, lambda a, x: a + x["weight"] * F.greatest(x["times"], x["seen"])).alias("either"),
                F.aggregate(m, zero, lambda a, x: a + F.least(x["times"], x["seen"])).alias("shared"),
                F.aggregate(m, zero, lambda a, x: a + F.greatest(x["times"], x["seen"])).alias("all"),
                F.filter(ws, lambda s: ~F.array_contains(F.col("shingles.s"), s)).alias("foreign"))

        return _bind(met, of)

    key = ["doc_id", "h", "start", "length", "text_id"]

    def enough(p: Column) -> Column:
        # No shingle weighs less than 1, so that the others cannot reach it.
        return (p["shared"] / (p["all"] + F.size(p["foreign"])) >= least) | (p["common"] / (p["either"] + F.size(p["foreign"])) >= least)

    # A filter on columns would be pushed below them and work them out anew for each of its terms.
    scored = pairs.select(*key, "distance", "rarest", F.inline(F.filter(F.transform(F.array(own), parts), enough)))
    each = scored.select(*key, "distance", "rarest", "common", "either", (F.col("shared") / (F.col("all") + F.size("foreign"))).alias("plain"),
                         F.explode_outer("foreign").alias("f"))
    each = each.withColumn("s", F.coalesce("f", "text_id")).join(known, "s", "left")
    weight = F.when(F.col("f").isNotNull(), F.col("rarest") - F.coalesce("less", F.lit(0.0))).otherwise(0.0)
    return (each.groupBy(*key).agg(F.min("distance").alias("distance"), F.max("plain").alias("plain"), F.max("common").alias("common"),
                                   F.max("either").alias("either"), F.sum(weight).alias("rest"))
            .withColumn("similarity", F.greatest("plain", F.col("common") / (F.col("either") + F.col("rest"))))
            .where(F.col("similarity") >= least).select(*key, "distance", "similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, shingle: int = 5, radius: int = 16, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without a benchmark passage, with all their columns; equal rows share their fate."""
    h = unused(docs, "text_hash")
    tagged = docs.withColumn(h, F.xxhash64("text"))
    items = materialize(_items(benchmark), "items")
    found = _matches(tagged.select("doc_id", "text", F.col(h).alias("h")), items, shingle, radius, least)
    found = found.select(F.col("doc_id").alias(unused(tagged, "leak_id")), F.col("h").alias(unused(tagged, "leak_hash"))).distinct()
    same = (F.col(h) == found[found.columns[1]]) & tagged["doc_id"].eqNullSafe(found[found.columns[0]])
    return tagged.join(found, same, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
