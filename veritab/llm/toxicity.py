"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The labelled rows are dealt into folds by their id: one teaches the lexicon, one the trees and one
the calibration, so that no step is fitted on what the step before has seen; the fourth is held out. Of
near copies, which a short sketch tells, one row counts in the lexicon.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from veritab.llm.common import ROWS, bounded_sample
from veritab.session import materialize

FEATURES = ("strong", "strong_count", "strong_kinds", "weight", "mild", "second_person_near", "second_person", "capitals",
            "loud", "exclaimed", "punctuation", "hidden", "mixed", "length")

#: Folds by crc32 of the id as text, modulo 4.
LEXICON_FOLD, TREE_FOLD, CALIBRATION_FOLD, HELD_OUT = 0, 1, 3, 2

#: Labelled rows used of each fold, at most.
FOLD_ROWS = 20_000

#: Words known to insult whatever the labelled rows hold, and words for the second person.
SEEDS = frozenset("idiot moron loser stupid scum worthless pathetic disgusting trash clown".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted "
                          "ustedes ti tus vosotros".split())

_EDGE = ".,;:!?\"'()[]{}<>…«»“”„-–—"
_FOLD = str.maketrans("01!34@5$7", "oiieaasst", ".-_*~+")
_SPACED = re.compile(r"(?<!\w)\w(?:[ .\-_*]\w){3,}(?!\w)")


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)).cast("int")


def tokens_of(text: str) -> list[str]:
    return [t.strip(_EDGE) for t in text.split()]


def sketch(words: list[str]) -> int:
    """Least hash of the three-word shingles: near copies mostly agree on it."""
    return min((xxhash.xxh64_intdigest(" ".join(w)) for w in zip(words, words[1:], words[2:])), default=0) >> 1


def features(text: str, lexicon: dict[str, float]) -> list[float]:
    """Densities are per word, so texts of any length compare; all zero without words."""
    words = [w for w in tokens_of(text) if w]
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    lower = [w.lower() for w in words]
    strong, kinds, weight, mild, loud, hidden, mixed, near = 0, set(), 0.0, 0, 0, 0, 0, 0
    person = [i for i, w in enumerate(lower) if w in SECOND_PERSON]
    hits = []
    for i, w in enumerate(lower):
        value = lexicon.get(w)
        if value is None and not w.isalpha():
            plain = w.translate(_FOLD)
            if plain != w and not w.isdigit() and any(map(str.isalpha, w)):
                mixed += 1
                value = lexicon.get(plain)
                hidden += value is not None
        if value is None:
            continue
        if value >= 3:
            strong += 1
            kinds.add(w)
            loud += words[i].isupper()
            hits.append(i)
        else:
            mild += 1
        weight += value
    if " " in text and (spaced := _SPACED.findall(text)):
        hidden += sum(re.sub(r"[ .\-_*]", "", s).lower() in lexicon for s in spaced)
    at = 0
    for i in hits:
        while at < len(person) and person[at] < i - 5:
            at += 1
        near += at < len(person) and person[at] <= i + 5
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    marks = sum(map(text.count, ".,;:!?\"'"))
    return [strong / n, math.log1p(strong), float(len(kinds)), weight / n, mild / n, near / max(1, len(hits)), len(person) / n,
            upper / n, loud / n, text.count("!") / n, marks / n, math.log1p(hidden), mixed / n, math.log1p(n)]


def learn_lexicon(docs: DataFrame, labelled: DataFrame) -> dict[str, float]:
    """Words of toxic rows with their log-odds, and the seeds.

    A word counts once per row and once per group of near copies. It is taken if the log-likelihood ratio
    between toxic and other rows leaves little room for chance; all such words are, their number is bounded by that
    of the labelled rows. A word with other characters in it counts as what it reads without them.
    """

    def read(w: str) -> str:
        plain = w if w.isalpha() else w.translate(_FOLD)
        return plain if plain.isalpha() else w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = [w.lower() for w in tokens_of(text or "")]
                kept = sorted({read(w) for w in words if any(map(str.isalpha, w))})
                out.append((sketch(words), toxic, kept))
            yield pa.RecordBatch.from_arrays(
                [pa.array([s for s, _, _ in out], pa.int64()), pa.array([t for _, t, _ in out], pa.int32()),
                 pa.array([w for _, _, w in out], pa.list_(pa.string()))], ["sketch", "toxic", "words"])

    rows = materialize(docs.join(F.broadcast(labelled), "doc_id").select("text", "toxic").mapInArrow(
        run, "sketch long, toxic int, words array<string>").groupBy("sketch").agg(
        F.max("toxic").alias("toxic"), F.min("words").alias("words")), "lexicon-rows")
    totals = rows.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    lexicon = {w: 4.0 for w in SEEDS}
    if not totals.t or totals.t == totals.n:
        return lexicon
    t, o = float(totals.t), float(totals.n - totals.t)
    a, b = F.col("a").cast("double"), F.col("b").cast("double")
    expected = (a + b) * t / (t + o)
    other = a + b - expected
    ratio = 2 * (a * F.log(a / expected) + F.when(b > 0, b * F.log(b / other)).otherwise(0.0))
    odds = F.log((a + 0.5) / (t + 1)) - F.log((b + 0.5) / (o + 1))
    found = (rows.select("toxic", F.explode("words").alias("word"))
             .groupBy("word").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")).where("a >= 3")
             .select("word", ratio.alias("ratio"), odds.alias("odds")).where("odds > 1.5 and ratio > 15")
             .collect())
    return lexicon | {r.word: r.odds for r in found}


def _with_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(lexicon)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                x = np.array([features(t or "", sent.value) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(FEATURES), pa.int32()),
                                                              pa.array(x.ravel()))], ["doc_id", "x"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, x array<double>")


def score(docs: DataFrame, labels: DataFrame, fold_rows: int = FOLD_ROWS, cut: float = 0.3, trees: int = 20) -> DataFrame:
    """doc_id, held_out, score (0..1, the calibrated chance of label 1) and predicted for each row of ``docs``.

    Null and blank texts have zero features and are scored like any other. Only labels of rows that
    are not held out are read, at most ``fold_rows`` of each fold, chosen by hash. Null labels and ids
    are left out; of several labels of one id the larger counts. Without rows of both classes the score is the share of
    label 1, or 0 without any. Rows are scored one by one: repeated rows get equal results, an empty
    table gives no rows; other columns are not read.
    """
    known = (labels.where("doc_id is not null and toxic is not null").groupBy("doc_id")
             .agg(F.max("toxic").cast("int").alias("toxic")).withColumn("fold", fold(F.col("doc_id"))))
    part = {f: bounded_sample(known.where(F.col("fold") == f), "doc_id", fold_rows).select("doc_id", "toxic")
            for f in (LEXICON_FOLD, TREE_FOLD, CALIBRATION_FOLD)}
    lexicon = learn_lexicon(docs.select("doc_id", "text"), part[LEXICON_FOLD])
    table = materialize(_with_features(docs, lexicon), "toxicity-features")
    rows = table.withColumn("features", array_to_vector("x"))
    teach = rows.join(F.broadcast(part[TREE_FOLD]), "doc_id").select("features", F.col("toxic").cast("double").alias("label"))
    seen = teach.agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.avg("label").alias("share")).first()
    if seen.lo is None or seen.lo == seen.hi:
        scored = rows.withColumn("score", F.lit(float(seen.share or 0.0)))
    else:
        model = GBTClassifier(maxIter=trees, maxDepth=3, stepSize=0.3, seed=5, maxBins=64).fit(teach)
        raw = model.transform(rows).withColumn("raw", vector_to_array("probability")[1])
        check = raw.join(F.broadcast(part[CALIBRATION_FOLD]), "doc_id").select("raw", F.col("toxic").cast("double").alias("label"))
        if check.isEmpty():
            scored = raw.withColumn("score", F.col("raw"))
        else:
            curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="score").fit(check)
            scored = curve.transform(raw)
    value = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == HELD_OUT, F.lit(False)).alias("held_out"),
                         value.alias("score"), (value >= cut).cast("int").alias("predicted"))
