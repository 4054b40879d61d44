"""Token counts by offsets: whole documents are encoded once and their tokens told out to sections.

The vocabulary is a file of byte strings with ranks; its path is a parameter. The driver reads it and
sends it to the tasks, so executors need no such file.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import ROWS

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

#: How this vocabulary cuts a text before pairs are merged.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"

RULES = ("first", "most")


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> tuple[tiktoken.Encoding, np.ndarray]:
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, i in ranks.items():
        lengths[i] = len(piece)
    return tiktoken.Encoding("sections", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths


def token_spans(text: str, encoder: tiktoken.Encoding, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one character that each token touches; a token may hold part of a character."""
    ends = np.cumsum(lengths[np.array(encoder.encode_ordinary(text), np.int64)])
    starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
    if text.isascii():
        return starts, ends
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # character of each byte
    return char[starts], char[ends - 1] + 1


def section_starts(text: str) -> np.ndarray:
    """Sections are lines with their line feed; an empty text is one empty section."""
    out = [0]
    at = text.find("\n")
    while 0 <= at < len(text) - 1:
        out.append(at + 1)
        at = text.find("\n", at + 1)
    return np.array(out, np.int64)


def allot(starts: np.ndarray, ends: np.ndarray, sections: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses into another one.

    ``first``: the section of the token's first character. ``most``: the section with most of the
    token's characters, of equals the earliest.
    """
    first = np.searchsorted(sections, starts, "right") - 1
    last = np.searchsorted(sections, ends - 1, "right") - 1
    crossing = last > first
    own = first.copy()
    if rule == "most":
        edges = np.append(sections, np.iinfo(np.int64).max)
        for i in np.flatnonzero(crossing):
            over = range(first[i], last[i] + 1)
            own[i] = max(over, key=lambda s: (min(ends[i], edges[s + 1]) - max(starts[i], edges[s]), -s))
    return own, crossing


def section_tokens(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, rule: str = "most") -> DataFrame:
    """A row for each section of each row of ``docs``: doc_id, section, start, end (characters), n_tokens and
    n_crossing, the tokens of it that reach into another section.

    The tokens of a document are those of its whole text, so its sections add up to them. A null or empty text is one
    empty section without tokens; repeated rows are counted each; an empty table gives no rows. Columns other
    than doc_id and text are not read.
    """
    if rule not in RULES:
        raise ValueError(f"rule is one of {RULES}")
    with open(vocabulary, "rb") as f:
        sent = docs.sparkSession.sparkContext.broadcast(f.read())
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, lengths = _encoder(sent.value, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                rows, columns = [], [[], [], [], [], []]
                for i, text in enumerate(part.column(1).to_pylist()):
                    text = text or ""
                    sections = section_starts(text)
                    own, crossing = allot(*token_spans(text, encoder, lengths), sections, rule)
                    n = len(sections)
                    rows.append(np.full(n, i))
                    for to, values in zip(columns, (np.arange(n), sections, np.append(sections[1:], len(text)),
                                                    np.bincount(own, minlength=n), np.bincount(own[crossing], minlength=n))):
                        to.append(values)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.concatenate(rows))), *(pa.array(np.concatenate(c), pa.int64()) for c in columns)],
                    names)

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, section long, start long, end long, n_tokens long, n_crossing long")


def document_tokens(sections: DataFrame) -> DataFrame:
    """Totals of documents from their sections: doc_id, n_sections, n_tokens, n_crossing."""
    return sections.groupBy("doc_id").agg(F.count("*").alias("n_sections"), F.sum("n_tokens").alias("n_tokens"),
                                          F.sum("n_crossing").alias("n_crossing"))
