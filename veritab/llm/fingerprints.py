"""Document fingerprints by consistent weighted sampling, DataFrame functions only.

Terms are words (`[^\\x20\\x09-\\x0D]+`), their weights the counts S in a text. For sample k a term draws, from its hash
alone, r and c of Gamma(2, 1) and a uniform b; with t = floor(ln S / r + b) its value is ln c - r (t - b + 1). The least
value over the terms of a text is the sample. Two texts have the same sample with a probability equal to the generalised
Jaccard similarity of their weights (sum of minima over sum of maxima), so the share of equal samples estimates it.

Null text is an empty text. A text without words has the fingerprint of zeros, which only such texts have. Equal texts
have equal fingerprints, whatever else their rows hold. Rows are ordered by doc_id, those without one last, rows of one
doc_id by the hash of their text and the text; each row is followed by the next one, also where rows repeat, and the
last by the first. A table of one row follows itself; an empty table gives no rows. Other columns are passed over.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Samples of a signature, and how many of them one row works out.
SAMPLES = 32
STEP = 8
#: Least number of documents in a bucket of neighbours; more documents make more buckets first.
BUCKET_ROWS = 256
_LOW_BITS = (1 << 32) - 1
_BLANK = r"[\x20\x09-\x0D]+"


def _list(values, kind: str) -> Column:
    """A constant array; one folded literal however many values it has."""
    if not values:
        return F.array().cast(f"array<{kind}>")
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _long(value: int) -> Column:
    return F.lit(value).cast("long")


# Neighbours ----------------------------------------------------------------------------


def _bucket(bounds: list[int], splits: list[int], starts: list[int]) -> Column:
    """Number of the bucket of a row <id, order>, ascending in the order of the rows."""
    at, steps = _list(bounds, "long"), [1 << b for b in reversed(range(len(bounds).bit_length()))]
    # Number of bounds at or below the id, by halving.
    found = F.aggregate(_list(steps, "int"), F.lit(0),
                        lambda acc, s: F.when(F.get(at, acc + s - 1) <= F.col("id"), acc + s).otherwise(acc))
    place = F.when(F.col("id").isNull(), F.lit(len(bounds) + 1)).otherwise(found)
    parts = F.get(_list(splits, "int"), place)
    # Hashes are spread evenly, so that equal stretches of them are equal shares of the rows of one id.
    inside = F.least(F.floor(F.col("order") * F.lit(2.0 ** -63) * parts).cast("int"), parts - 1)
    return F.get(_list(starts, "int"), place) + F.when(parts > 1, inside).otherwise(F.lit(0))


def in_buckets(docs: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Rows <id, text, order, bucket, guest>, shuffled by bucket.

    Buckets follow the order of the rows and hold ``n / (16 x shuffle partitions)`` of them, at least
    ``bucket_rows``; rows of one id that fill more are split by the hash of their text. The first row of a bucket is
    also a guest of the bucket before, so that each row has its next one beside it. Bounds are quantiles of the
    ids; they and the first rows are counted by the number of buckets, not by rows.
    """
    spark = docs.sparkSession
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    n = docs.count()
    limit = max(bucket_rows, n // (16 * width))
    count = n // limit
    bounds: list[int] = []
    if count > 1:
        shares = [i / count for i in range(1, count)]
        bounds = docs.agg(F.percentile_approx("id", shares, max(10_000, 20 * count)).alias("q")).first().q or []
    crowds = {r.id: r.n for r in docs.groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") > limit).collect()}
    bounds = sorted(set(bounds) | {i for k in crowds if k is not None for i in (k, k + 1) if i < 1 << 63})
    splits = [1] + [max(1, math.ceil(crowds.get(b, 0) / limit)) for b in bounds] + [max(1, math.ceil(crowds.get(None, 0) / limit))]
    starts = [sum(splits[:i]) for i in range(len(splits))]

    rows = docs.withColumn("order", F.shiftrightunsigned(F.xxhash64("text"), 1))
    rows = rows.withColumn("bucket", _bucket(bounds, splits, starts))
    firsts = sorted((r.bucket, r.f.id, r.f.order) for r in rows.groupBy("bucket").agg(
        F.min(F.struct("id", "order")).alias("f")).collect())
    first_id, first_order, before = [0] * sum(splits), [-1] * sum(splits), [-1] * sum(splits)
    for (b, i, o), (previous, *_) in zip(firsts, firsts[-1:] + firsts):
        first_id[b], first_order[b], before[b] = i or 0, o, previous
    is_first = (F.coalesce("id", _long(0)) == F.get(_list(first_id, "long"), F.col("bucket"))) & (
        F.col("order") == F.get(_list(first_order, "long"), F.col("bucket")))
    own = F.struct(F.col("bucket"), F.lit(False).alias("guest"))
    guest = F.struct(F.get(_list(before, "int"), F.col("bucket")).alias("bucket"), F.lit(True).alias("guest"))
    placed = rows.select("id", "text", "order", F.explode(F.when(is_first, F.array(own, guest)).otherwise(F.array(own))).alias("p"))
    return placed.select("id", "text", "order", "p.bucket", "p.guest").repartition(width, "bucket")


# Samples -------------------------------------------------------------------------------


def _hashes(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, _BLANK), lambda w: w != ""), lambda w: F.xxhash64(w))


def _tagged(hashes: Column, tag: int) -> Column:
    return F.transform(hashes, lambda h: h.bitwiseAND(_long(-2)).bitwiseOR(_long(tag)))


def _let(value: Column, body) -> Column:
    """``body`` of a value that is worked out once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def weighted_terms(one: Column, other: Column) -> Column:
    """Array of <term, n, m>: the hashed words of two texts (63 bits) with their counts in either."""

    def same(a, b):
        return F.shiftright(a, 1) == F.shiftright(b, 1)

    def counted(words):
        size = F.size(words)
        every = F.when(size > 0, F.sequence(F.lit(0), size - 1)).otherwise(F.array().cast("array<int>"))
        # Starts of runs of one word in one text; those of the other text come right behind.
        runs = F.filter(every, lambda i: (i == 0) | (F.get(words, i) != F.get(words, i - 1)))
        return _let(runs, lambda st: _let(F.transform(st, lambda p: F.get(words, p)), lambda v: terms(st, v, size)))

    def terms(st, v, size):
        places = F.when(F.size(st) > 0, F.sequence(F.lit(0), F.size(st) - 1)).otherwise(F.array().cast("array<int>"))
        heads = F.filter(places, lambda j: (j == 0) | ~same(F.get(v, j), F.get(v, j - 1)))

        def term(j):
            here, after = F.get(v, j), F.get(v, j + 1)
            length = F.coalesce(F.get(st, j + 1), size) - F.get(st, j)
            more = F.coalesce(F.get(st, j + 2), size) - F.get(st, j + 1)
            second = here.bitwiseAND(_long(1)) == 1
            return F.struct(
                F.shiftright(here, 1).alias("term"),
                F.when(second, F.lit(0)).otherwise(length).alias("n"),
                F.when(second, length).when(F.coalesce(same(here, after), F.lit(False)), more).otherwise(F.lit(0)).alias("m"))

        return F.transform(heads, term)

    return _let(F.sort_array(F.concat(_tagged(_hashes(one), 0), _tagged(_hashes(other), 1))), counted)


def _draws(i: int) -> tuple[Column, Column, Column]:
    """r, ln c and b of the i-th sample of a row whose column ``z`` is the hash of its term and step."""
    a, b, c = (F.xxhash64(F.col("z").bitwiseXOR(_long((3 * i + j + 1) * 0x9E3779B97F4A7C15 % (1 << 63)))) for j in range(3))

    def gamma(x):
        # Minus the logarithm of two uniforms of 32 bits each.
        high = F.shiftrightunsigned(x, 32).cast("double") + 0.5
        low = x.bitwiseAND(_long(_LOW_BITS)).cast("double") + 0.5
        return -F.ln(high * low * F.lit(2.0 ** -64))

    return gamma(a), F.ln(gamma(b)), F.shiftrightunsigned(c, 11).cast("double") * F.lit(2.0 ** -53)


def samples(terms: DataFrame, key: list[str], n_samples: int = SAMPLES) -> DataFrame:
    """The least values of the samples of two texts: ``key``, one, other (arrays of doubles; null for no term).

    ``terms`` has the key, ``term``, and the logarithms ``n`` and ``m`` of the counts, null for none. A row of a key without terms has
    a null ``term``. A row works out STEP samples, whose draws serve both texts.
    """
    if n_samples % STEP:
        raise ValueError(f"the number of samples must be a multiple of {STEP}")
    steps = terms.withColumn("step", F.explode(F.array(*[F.lit(i) for i in range(n_samples // STEP)])))
    steps = steps.select(*key, "step", F.xxhash64("term", "step").alias("z"), "n", "m")
    drawn = steps.select(*key, "step", "n", "m", *[
        x.alias(f"{name}{i}") for i in range(STEP) for name, x in zip("rcb", _draws(i))])

    def value(weight, i):
        r, c, b = (F.col(f"{name}{i}") for name in "rcb")
        return c - r * (F.floor(F.col(weight) / r + b) - b + 1)

    least = drawn.groupBy(*key, "step").agg(*[F.min(value(w, i)).alias(f"{w}{i}") for i in range(STEP) for w in "nm"])
    joined = least.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(
        "step", *[F.array(*[F.col(f"{w}{i}") for i in range(STEP)]).alias(w) for w in "nm"]))).alias("all"))
    return joined.select(*key, *[F.flatten(F.col(f"all.{w}")).alias(out) for w, out in (("n", "one"), ("m", "other"))])


def codes(values: Column) -> Column:
    """32 bits for each sample; zero where there is none."""
    return F.transform(values, lambda v: F.when(v.isNull(), _long(0)).otherwise(F.xxhash64(v).bitwiseAND(_long(_LOW_BITS))))


def hexed(signature: Column) -> Column:
    return F.array_join(F.transform(signature, lambda c: F.lpad(F.lower(F.hex(c)), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal samples."""
    return F.size(F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda same: same)) / F.size(a)


def fingerprints(docs: DataFrame, n_samples: int = SAMPLES, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has the last half of the code points replaced by the first ones of the next document. Texts are
    shuffled once, by bucket; everything after stays within the tasks of that shuffle.
    """
    inside = Window.partitionBy("bucket").orderBy("guest", "id", "order", "text")
    rows = in_buckets(docs, bucket_rows).withColumn("after", F.lead("text").over(inside)).withColumn("row", F.row_number().over(inside))
    n, half = F.length("text"), F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - half), F.substring(F.coalesce("after", F.lit("")), F.lit(1), half))
    texts = rows.select("bucket", "row", "guest", "id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    key = ["bucket", "row", "guest", "id", "n_chars", "sha"]
    # What stands beside an explode in one select is worked out once per exploded row.
    hashed = texts.select("bucket", "row", "guest", "id", "n_chars", F.sha2("edited", 256).alias("sha"),
                          weighted_terms(F.col("text"), F.col("edited")).alias("all"))
    listed = hashed.select(*key, F.explode_outer("all").alias("t"))
    terms = listed.select(*key, "t.term", *[F.when(F.col(f"t.{w}") > 0, F.ln(f"t.{w}")).alias(w) for w in "nm"])
    signed = samples(terms, key, n_samples).select(*key, codes(F.col("one")).alias("one"), codes(F.col("other")).alias("other"))
    beside = signed.withColumn("next", F.lead("one").over(Window.partitionBy("bucket").orderBy("row")))
    return beside.where(~F.col("guest")).select(
        F.col("id").alias("doc_id"), "n_chars", F.col("sha").alias("edited_sha256"),
        hexed(F.col("one")).alias("fingerprint"), hexed(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("one"), F.col("other")).alias("near_edited"), likeness(F.col("one"), F.col("next")).alias("near_next"))
