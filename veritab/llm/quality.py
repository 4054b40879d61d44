"""Quality rules with an isolation forest over rule statistics.

Base rules count words, symbols, repeated lines and repeated three-word windows. The forest is
grown on ratios of such counts with random features and random splits; a document that few splits
isolate is anomalous. The score above which a document is rejected is calibrated on labelled rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import ROWS, arrow_schema, per_row
from veritab.llm.simhash_dedup import SPACE, words_of
from veritab.session import materialize

SYMBOLS = "#*$%&|<>"
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = ("symbols", "exclaimed", "capitals", "bars", "echoed", "long_words", "word_length", "dup_lines", "repeat_words", "digits",
            "non_letters", "lines")

#: Trees of the forest, and the rows that each is grown on: of few rows, anomalous ones are isolated best.
TREES, TREE_ROWS = 128, 256


def base_counts(text: str, words: list[str]) -> tuple[int, int, int, int, int]:
    """The five counts of the base rules, over the whole text."""
    lines: set[str] = set()
    dup = 0
    for line in text.split("\n"):
        if line in lines:
            dup += 1
        elif line.strip(SPACE):
            lines.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        often = {w for w, n in Counter(windows).items() if n > 1}
        reach = 0  # end of the words counted so far
        for i, w in enumerate(windows):
            if w in often:
                repeated += i + 3 - max(reach, i)
                reach = i + 3
    return len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), dup, repeated


def failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


def statistics(text: str, words: list[str], counts: tuple[int, ...]) -> list[float]:
    """Ratios in 0..1 that mean the same for texts of any length and language; all zero without words.

    Those of the base rules are among them: mean word length (by its logarithm), repeated lines and repeated windows.
    """
    n, chars, symbols, dup, repeated = counts
    if not n:
        return [0.0] * len(FEATURES)
    lines = sum(1 for line in text.split("\n") if line.strip(SPACE))
    letters = sum(map(str.isalpha, text))
    upper = sum(w.isupper() and len(w) > 1 for w in words)
    echoed = sum(map(str.__eq__, words, words[1:]))
    return [min(1.0, symbols / n), min(1.0, text.count("!") / n), upper / n, min(1.0, text.count("|") / n),
            echoed / n, sum(len(w) > 30 for w in words) / n, min(1.0, math.log1p(chars / n) / 5), dup / lines, min(1.0, repeated / n),
            sum(map(str.isdigit, text)) / len(text), 1 - min(1.0, letters / chars), min(1.0, lines / n)]


@dataclass
class Forest:
    """Isolation trees as flat arrays: feature (-1: leaf), split, left child, path length at the leaf."""

    feature: np.ndarray
    split: np.ndarray
    left: np.ndarray
    depth: np.ndarray
    roots: np.ndarray
    norm: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / expected path length): near 1 is anomalous, below 0.5 is ordinary."""
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                f = self.feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.split[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.depth[at]
        return np.exp2(-total / (max(1, len(self.roots)) * self.norm))


def _expected(n: int) -> float:
    """Mean path length of an unsuccessful search among n rows."""
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(x: np.ndarray, trees: int = TREES, rows: int = TREE_ROWS, seed: int = 11) -> Forest:
    """A forest over random subsamples; height is limited to the logarithm of the subsample.

    Splits are drawn from the whole range 0..1 of a ratio, narrowed by the splits above, not from the
    values seen: a value that no row of the sample has falls on an empty side and is isolated at once. The sample
    holds good rows, all alike; splits within their values cannot tell what lies outside of them.
    """
    rng = np.random.default_rng(seed)
    rows = min(rows, len(x))
    limit = max(1, math.ceil(math.log2(max(rows, 2))))
    feature, split, left, depth, roots = [], [], [], [], []

    def node() -> int:
        for column in (feature, left):
            column.append(-1)
        split.append(0.0)
        depth.append(0.0)
        return len(feature) - 1

    for _ in range(trees if rows else 0):
        root = node()
        roots.append(root)
        stack = [(root, x[rng.choice(len(x), rows, replace=False)], 0, np.zeros(x.shape[1]), np.ones(x.shape[1]))]
        while stack:
            at, part, level, low, high = stack.pop()
            if level >= limit or len(part) < 2:
                depth[at] = level + _expected(len(part))
                continue
            f = int(rng.integers(x.shape[1]))
            cut = rng.uniform(low[f], high[f])
            a, b = node(), node()
            feature[at], split[at], left[at] = f, cut, a
            goes = part[:, f] >= cut
            under, over = high.copy(), low.copy()
            under[f] = over[f] = cut
            stack += [(a, part[~goes], level + 1, low, under), (b, part[goes], level + 1, over, high)]
    return Forest(np.array(feature, int), np.array(split), np.array(left, int), np.array(depth), np.array(roots, int),
                  max(_expected(rows), 1.0))


def threshold(scores: np.ndarray, good: np.ndarray, clean_share: float = 0.995) -> float:
    """The cut with the best balanced accuracy among those that keep ``clean_share`` of the good rows.

    Without rows of both classes nothing is rejected.
    """
    if not good.any() or good.all():
        return math.inf
    least = float(np.quantile(scores[good], clean_share, method="higher"))
    values = np.unique(scores)
    cuts = np.append((values[1:] + values[:-1]) / 2, values[-1] + 1e-9)
    cuts = cuts[cuts > least]
    keeps = np.searchsorted(np.sort(scores[good]), cuts) / good.sum()
    drops = 1 - np.searchsorted(np.sort(scores[~good]), cuts) / (~good).sum()
    return float(cuts[np.argmax(keeps + drops)]) if len(cuts) else math.inf


@dataclass
class Model:
    forest: Forest
    cut: float


def _measured(docs: DataFrame) -> DataFrame:
    """Counts, ``base_failed`` and statistics of every row: <doc_id, five counts, base_failed, x>, written out once."""
    out = f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean, x array<double>"

    def measure(doc_id, text):
        words = words_of(text or "")
        counts = base_counts(text or "", words)
        return doc_id, *counts, failed(counts[0], counts[4]), statistics(text or "", words, counts)

    return materialize(per_row(docs.withColumn("doc_id", F.col("doc_id").cast("long")), measure, out, "doc_id", "text"), "quality-statistics")


def _with_scores(measured: DataFrame, forest: Forest, columns: str) -> DataFrame:
    """``columns`` of measured rows, whose last input is x, and their scores as ``anomaly``."""
    sent = measured.sparkSession.sparkContext.broadcast(forest)
    target = arrow_schema(f"{columns}, anomaly double")
    names = target.names[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column(batch.num_columns - 1).to_pylist(), float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(sent.value.scores(x))], schema=target)

    return measured.select(*names, "x").mapInArrow(run, f"{columns}, anomaly double")


def best_cut(scored: DataFrame, clean_share: float = 0.995) -> float:
    """``threshold`` of all rows <anomaly, good>: scores are counted by their millionths, so the driver gets a million counts at most.

    Cuts lie between the scores of two such classes.
    """
    seen = scored.groupBy(F.floor(F.col("anomaly") * 1_000_000).alias("at")).agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"), F.min("anomaly").alias("least"), F.max("anomaly").alias("most"),
        F.max(F.when(F.col("good"), F.col("anomaly"))).alias("good_most")).orderBy("at").toPandas()
    good, bad = seen["good"].to_numpy().cumsum(), seen["bad"].to_numpy().cumsum()
    if not len(seen) or not good[-1] or not bad[-1]:
        return math.inf
    # The class that holds the quantile of the good rows, as the next higher row gives it.
    holds = int(np.searchsorted(good, math.ceil(clean_share * (good[-1] - 1)) + 1))
    cuts = np.append((seen["least"].to_numpy()[1:] + seen["most"].to_numpy()[:-1]) / 2, seen["most"].iloc[-1] + 1e-9)
    likely = np.arange(len(cuts)) >= holds
    gain = good / good[-1] + 1 - bad / bad[-1]
    return float(cuts[likely][np.argmax(gain[likely])])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Forest and threshold from all labelled rows.

    The forest is grown on the rows labelled good, so that path lengths tell how far a document
    is from ordinary ones however many of the labelled rows are bad. Rows that fail the base rules
    take no part. Rows with a null label or id are left out.
    """
    return _fit(_measured(docs), labels)


def _fit(measured: DataFrame, labels: DataFrame) -> Model:
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        (F.max("quality") >= 1).alias("good"))
    rows = materialize(measured.where("not base_failed").select("doc_id", "x").join(known, "doc_id").select("good", "x"), "quality-labelled")
    few = rows.where("good")
    if few.isEmpty():
        few = rows
    # A tree is grown on its own few rows, so all trees together use so many of the good rows at most; they are drawn from all of them.
    drawn = few.orderBy(F.xxhash64("x"), "x").limit(TREES * TREE_ROWS).collect()
    x = np.array(sorted(r.x for r in drawn), float).reshape(-1, len(FEATURES))
    forest = grow(x, TREES, TREE_ROWS)
    if not len(x):
        return Model(forest, math.inf)
    return Model(forest, best_cut(_with_scores(rows, forest, "good boolean")))


def _scored(docs: DataFrame, model: Model, schema: str, columns: list[str], emit) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, cut = sent.value.forest, sent.value.cut
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                split = [words_of(t) for t in texts]
                counts = [base_counts(t, w) for t, w in zip(texts, split)]
                x = np.array([statistics(*v) for v in zip(texts, split, counts)])
                scores = forest.scores(x)
                base = np.array([failed(c[0], c[4]) for c in counts])
                yield emit(part, counts, base, scores, ~base & (scores < cut))

    return docs.select(*columns).mapInArrow(run, schema)


def assess(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, ``base_failed``, ``anomaly`` (0..1) and ``kept`` for each row of ``docs``.

    A null or blank text has no words, fails the base rules and has the score of its zero statistics.
    Rows are judged one by one: repeated rows get equal results, an empty table gives none, and
    columns other than doc_id and text are not read. Without labelled rows of both kinds only the
    base rules reject. Texts are read once: fitting and scoring share their statistics.
    """
    measured = _measured(docs)
    model = _fit(measured, labels)
    scored = _with_scores(measured, model.forest, f"doc_id long, {', '.join(f'{c} long' for c in COUNTS)}, base_failed boolean")
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("anomaly") < model.cut))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with all their columns; no shuffle."""
    names = docs.columns
    model = fit(docs, labels)
    at = names.index("text")
    order = [*names[:at], *names[at + 1:], "text"]

    def emit(part, counts, base, scores, kept):
        return part.filter(pa.array(kept))

    ordered = docs.select(*[F.col(f"`{c}`") for c in order])
    return _scored(ordered, model, ordered.schema, [f"`{c}`" for c in order], emit).select(*[F.col(f"`{c}`") for c in names])
