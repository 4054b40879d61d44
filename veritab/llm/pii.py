"""Personal data: pattern rules and a skip-chain conditional random field.

The rules find emails, addresses, card and phone numbers. The field labels every token that can be one of them or a
secret: all that hold a digit or an ``@``, whatever stands behind a name for a secret, long tokens, tokens of mixed
case, and all repetitions of what stands behind such a name. Neighbouring tokens share chain
potentials, and a token shares skip potentials with its next repetition and with the next token of
the same shape and beginning, however far away in the document. Sum-product message passing on this loopy
graph gives each token its marginals; tokens with a label are spans of that kind. A kind that a rule decides
is possible only for what the rule takes. The messages of a document pass until they settle, whatever other documents do.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritab.llm.common import ROWS, arrow_schema, bounded_sample

KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("none", *KINDS)

#: Documents whose rule spans train the weights, at most.
TRAIN_ROWS = 4_000

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match that starts inside a run of digits ends like one that starts with the run, so only starts of runs are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s0-9@]*[0-9@]\S*")
#: Tokens of 24 characters, or of 12 with a capital behind a small letter.
_ODD = re.compile(r"(?<!\S)(?:(?=\S*[a-z][A-Z])\S{12,}|\S{24,})")
_RUN = re.compile(r"\S+")
#: Names for a secret, with what may stand between one and its value.
_NAME = (r"(?:pass(?:word|wd|phrase|code)|passwort|contraseña|mot de passe|pwd|secret|token|credentials?|bearer|"
         r"(?:api|access|private|secret|client|auth)[_ -]?key)")
_AFTER = re.compile(rf"(?i)(?<![a-z]){_NAME}[\"'\]]{{0,2}}(?:[ \t]{{0,3}}(?:[=:]=?|=>|->)[ \t]{{0,3}}|(?<=bearer)[ \t]{{1,3}}|[ \t]is[ \t])[\"'`]?(?=[^\s\"'`])")
_KEY = re.compile(r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield "email", start, end
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[Span]:
    """Rule spans, by start, then kind."""
    found = list(_emails(text))
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) < 4 and int(p) <= 255 for p in m[0].split(".")):
                found.append(("ip", *m.span()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", *m.span()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= sum(map(str.isdigit, m[0])) <= 15:
                    found.append(("phone", *m.span()))
    return in_order(found)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


@dataclass
class Node:
    start: int
    end: int
    text: str
    near: bool  # the token before it is a node as well
    named: bool = False  # stands behind a name for a secret

    def shape(self) -> str:
        """Classes of characters, runs shortened to their class and a rough length."""
        out = []
        for m in re.finditer(r"[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]+", self.text):
            c = m[0][0]
            if c.isascii() and c.isalnum():
                out.append("9Aa"[0 if c.isdigit() else 1 if c.isupper() else 2] + str(min(3, len(m[0]).bit_length())))
            else:
                out.append(m[0][:2])
        # A long pattern is told by its beginning and a checksum of all of it.
        return "".join(out if len(out) <= 12 else [*out[:12], f"~{zlib.crc32(''.join(out).encode())}"])


def _bare(text: str, a: int, b: int) -> tuple[int, int]:
    """A token without the quotes and marks around it."""
    while a < b and text[a] in "\"'`([{<":
        a += 1
    while b > a and text[b - 1] in "\"'`)]}>,.;:!?":
        b -= 1
    return a, b


def nodes_of(text: str) -> list[Node]:
    """The tokens that the field labels, in order; of ``name=value`` the value only."""
    start = {m.end(): m.start() for m in _TOKEN.finditer(text)}  # by end, as tokens end at white space
    start.update((m.end(), m.start()) for m in _ODD.finditer(text))
    named: set[int] = set()
    if "=" in text or ":" in text or _HINT.search(text):
        for m in _AFTER.finditer(text):
            value = _RUN.match(text, m.end())
            if value and (value.end() not in named or start[value.end()] < m.end()):
                start[value.end()] = m.end()
                named.add(value.end())
        values = {text[slice(*_bare(text, start[e], e))].casefold() for e in named} - {""}
        if values:
            for m in _RUN.finditer(text):
                if m.end() not in start and text[slice(*_bare(text, *m.span()))].casefold() in values:
                    start[m.end()] = m.start()
    nodes: list[Node] = []
    for end in sorted(start):
        a, b = _bare(text, start[end], end)
        if a < b:
            near = bool(nodes) and start[end] - nodes[-1].end <= 3
            nodes.append(Node(a, b, text[a:b], near, end in named))
    return nodes


_HINT = re.compile(r"(?i)bearer|\bis\b")


def _form(t: str) -> str:
    """What a token is made of, and how long it is, roughly."""
    classes = "".join(c for c, found in (("a", any(map(str.islower, t))), ("A", any(map(str.isupper, t))), ("9", any(map(str.isdigit, t))),
                                         ("-", not t.isalnum())) if found)
    return f"{classes}{min(4, len(t) // 6)}"


def features(text: str, node: Node) -> list[str]:
    t = node.text
    digits = sum(map(str.isdigit, t))
    before = text[max(0, node.start - 24):node.start].lower()
    word = re.search(r"([\w-]+)\W*$", before)
    named = t.split("=", 1)[0].split(":", 1)[0].lower() if "=" in t or ":" in t else ""
    out = ["bias", "shape=" + node.shape(), f"digits={min(digits, 20)}", f"length={min(len(t).bit_length(), 8)}"]
    out += ["secret_name", "secret_name:" + _form(t)] if node.named else []
    out += ["form=" + _form(t)]
    out += ["key"] if _KEY.fullmatch(t) else []
    out += ["at"] if "@" in t else []
    out += ["plus"] if t[0] == "+" else []
    out += ["hex"] if len(t) >= 16 and re.fullmatch(r"[0-9a-f]+", t) else []
    out += ["upper"] if len(t) >= 16 and re.fullmatch(r"[0-9A-Z]+", t) and digits < len(t) else []
    out += ["four"] if re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", t) else []
    out += ["luhn"] if t.isascii() and t.isdigit() and 12 <= len(t) <= 19 and luhn(t) else []
    out += ["named=" + named] if named and len(named) < 20 else []
    out += ["after=" + word[1][-16:]] if word and before[word.end(1):].strip() in ("=", ":", '="', ':"', '= "', ': "') else []
    return out


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(node, node, kind): 0 neighbours, 1 next repetition, 2 next one of similar form."""
    out, last, alike = [], {}, {}
    for i, n in enumerate(nodes):
        if n.near:
            out.append((i - 1, i, 0))
        key = n.text.casefold()
        like = (n.shape(), key[:4])
        if key in last:
            out.append((last[key], i, 1))
        elif like in alike:
            out.append((alike[like], i, 2))
        last[key] = alike[like] = i
    return out


class Cover:
    """Which stretches of a text spans touch; by halving, however many there are."""

    def __init__(self, spans: list[Span]) -> None:
        spans = sorted((a, b) for _, a, b in spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def touches(self, a: int, b: int) -> bool:
        at = bisect_left(self.starts, b)
        return at > 0 and self.ends[at - 1] > a


def seeds_of(text: str, nodes: list[Node]) -> list[Span]:
    """Secrets that need no field: access keys, and what stands behind a name for a secret and is no common word."""
    found = [("secret", *m.span()) for m in _KEY.finditer(text)]
    for n in nodes:
        t = n.text
        plain = t.isalpha() and (t.islower() or t.istitle() or t.isupper())
        if n.named and (len(t) >= 12 or len(t) >= 6 and not plain):
            found.append(("secret", n.start, n.end))
    return found


def _labels(text: str, nodes: list[Node], told: list[Span] | None = None) -> list[int]:
    """Training labels: rule spans, then the secrets that are told, or else the seeds."""
    base = base_spans(text)
    covers = [(LABELS.index(k), Cover([s for s in base if s[0] == k])) for k in KINDS[:4]]
    covers.append((LABELS.index("secret"), Cover(seeds_of(text, nodes) if told is None else told)))
    return [next((k for k, cover in covers if cover.touches(n.start, n.end)), 0) for n in nodes]


def possible(text: str, nodes: list[Node], base: list[Span]) -> np.ndarray:
    """Labels that each node can have: a kind with a rule only where a rule span is, or the rule takes the token."""
    cover = Cover(base)
    out = np.ones((len(nodes), len(LABELS)), bool)
    for i, n in enumerate(nodes):
        if not cover.touches(n.start, n.end):
            taken = {k for k, a, b in base_spans(n.text) if (a, b) == (0, len(n.text))}
            out[i, 1:5] = [k in taken for k in KINDS[:4]]
    return out


def made_documents(n: int = 600, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Texts with made secrets of many forms, and look-alikes that are none, for the training rows."""
    rng = random.Random(seed)
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: some(lower, rng.randint(2, 9))
    number = lambda k: rng.choice(digit[1:]) + some(digit, k - 1)
    forms = [
        lambda: some(lower, rng.randint(4, 9)) + some(digit, rng.randint(1, 4)) + some(lower, rng.randint(0, 4)), lambda: some(lower, rng.randint(12, 24)),
        lambda: some("0123456789abcdef", rng.choice([12, 16, 32, 40, 64])), lambda: "sk" + rng.choice(["", "_", "-"]) + some(lower + digit, rng.randint(12, 32)),
        lambda: "AKIA" + some(upper + digit, 16), lambda: "ghp_" + some(lower + upper + digit, 36), lambda: some(lower + upper + digit + "+/", 40),
        lambda: "eyJ" + some(lower + upper + digit, 20) + "." + some(lower + upper + digit + "_-", 30),
        lambda: "-".join(some("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)), lambda: some(lower + upper + digit + "!#$%&*+?^~", rng.randint(9, 18)),
        lambda: word().title() + some("!$#", 1) + some(digit, 3), lambda: "-".join(word() + word() for _ in range(4))]
    names = ["password", "Password", "passwd", "pwd", "DB_PASSWORD", "secret", "client_secret", "token", "access_token", "api_key", "apikey", "API-KEY",
             "private_key", "credential", "passphrase", "auth_key"]
    joins = ["=", ": ", " = ", ":", " : ", "=\"", ": '", "\": \""]
    alike = [
        lambda: f"version: {number(1)}.{number(2)}.{number(1)}", lambda: f"section {number(1)}.{number(1)}.{number(2)}", lambda: f"no. {number(6)}",
        lambda: f"{number(4)}-0{number(1)}-1{rng.choice(digit)}", lambda: f"1{rng.choice('0123')}:{rng.choice('12345')}{rng.choice(digit)}", lambda: f"${number(2)}.99",
        lambda: f"https://{word()}.example/{word()}/{number(4)}?{word()}={word()}", lambda: f"{word()}{word().title()}{word().title()}()",
        lambda: some(lower, rng.randint(18, 30)), lambda: f"ISBN 978{number(10)}", lambda: f"{number(2)},000", lambda: f"call {number(3)}-{number(4)}",
        lambda: f"{rng.choice(names)}: {word()[:6]}", lambda: f"the {rng.choice(['password', 'token', 'secret'])} {word()}", lambda: f"key: {word()}",
        lambda: f"id {some(upper, 2)}-{number(5)}", lambda: f"{word().upper()}_{word().upper()}_{number(2)}", lambda: f"{word()}.{word()}.{number(2)}"]
    out = []
    for _ in range(n):
        text, spans, kept = "", [], []
        for _ in range(rng.randint(3, 8)):
            text += " ".join(word() for _ in range(rng.randint(2, 10))) + rng.choice([" ", ". ", "\n"])
            if rng.random() < 0.5:
                text += rng.choice(alike)() + rng.choice([" ", ", ", "\n"])
                continue
            value = rng.choice(kept) if kept and rng.random() < 0.4 else rng.choice(forms)()
            if value not in kept and not value.startswith(("AKIA", "ghp_", "eyJ")):
                join = rng.choice(joins)
                text += rng.choice(names) + join
                close = join[-1] if join[-1] in "\"'" else ""
            else:
                close = ""
            spans.append(("secret", len(text), len(text) + len(value)))
            kept.append(value)
            text += value + close + rng.choice([" ", "\n", ". "])
        out.append((text, spans))
    return out


@dataclass
class Field:
    """Weights of a fitted field: features x labels, and one labels x labels table for each kind of edge."""

    names: dict[str, int]
    unary: np.ndarray
    pair: np.ndarray

    def potentials(self, lists: list[list[str]]) -> np.ndarray:
        out = np.zeros((len(lists), len(LABELS)))
        for i, names in enumerate(lists):
            at = [self.names[f] for f in names if f in self.names]
            if at:
                out[i] = self.unary[at].sum(axis=0)
        return out

    def marginals(self, unary: np.ndarray, edges: np.ndarray, first: list[int] | None = None, rounds: int | None = None,
                  damping: float = 0.3) -> np.ndarray:
        """Beliefs after loopy sum-product message passing.

        ``first`` has the first node of each document, and the number of nodes at its end. Documents share no edge; each goes on until its
        own messages settle, for ``rounds`` rounds at most, by default as many as it has nodes and a few more.
        """
        if not len(edges):
            return np.exp(unary - np.logaddexp.reduce(unary, axis=1, keepdims=True))
        bounds = np.array(first if first is not None else [0, len(unary)])
        a, b = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        table = np.concatenate([self.pair[edges[:, 2]], self.pair[edges[:, 2]].transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges), 2 * len(edges)), np.arange(len(edges))])
        doc = np.searchsorted(bounds, a, side="right") - 1
        limit = 12 + np.diff(bounds) if rounds is None else np.full(len(bounds) - 1, rounds)
        order = np.argsort(b, kind="stable")
        into, cut = np.unique(b[order], return_index=True)
        sent = np.zeros((len(a), len(LABELS)))

        def received() -> np.ndarray:
            total = unary.copy()
            total[into] += np.add.reduceat(sent[order], cut, axis=0)
            return total

        live, turn = np.arange(len(a)), 0
        while len(live):
            turn += 1
            out = received()[a[live]] - sent[back[live]]  # all that a knows but from b
            new = np.logaddexp.reduce(out[:, :, None] + table[live], axis=1)
            new -= np.logaddexp.reduce(new, axis=1, keepdims=True)
            change = np.zeros(len(bounds))
            np.maximum.at(change, doc[live], np.abs(new - sent[live]).max(axis=1))
            sent[live] = damping * sent[live] + (1 - damping) * new
            live = live[(change[doc[live]] >= 1e-4) & (turn < limit[doc[live]])]
        total = received()
        return np.exp(total - np.logaddexp.reduce(total, axis=1, keepdims=True))


def train(documents: list[str], steps: int = 200, rate: float = 0.5, decay: float = 1e-4, made: int = 600) -> Field:
    """Weights by gradient ascent on the pseudo-likelihood: each token given its neighbours' labels.

    Made documents join the given ones.
    """
    lists: list[list[str]] = []
    y: list[int] = []
    edges: list[tuple[int, int, int]] = []
    for text, told in [(t, None) for t in documents] + made_documents(made):
        nodes = nodes_of(text)
        edges += [(a + len(y), b + len(y), k) for a, b, k in edges_of(nodes)]
        lists += [features(text, n) for n in nodes]
        y += _labels(text, nodes, told)
    counts: dict[str, int] = {}
    for f in lists:
        for name in f:
            counts[name] = counts.get(name, 0) + 1
    names = {f: i for i, f in enumerate(sorted(f for f, n in counts.items() if n > 1))}
    L = len(LABELS)
    unary, pair = np.zeros((len(names), L)), np.zeros((3, L, L))
    if not y:
        pair[1:] = np.eye(L)
        return Field(names, unary, pair)
    row = np.array([i for i, f in enumerate(lists) for n in f if n in names])
    col = np.array([names[n] for f in lists for n in f if n in names], int)
    gold = np.array(y)
    target = np.eye(L)[gold]
    e = np.array(edges, int).reshape(-1, 3)
    share = 1 / np.maximum(1, np.bincount(col, minlength=len(names)))[:, None]
    for _ in range(steps):
        score = np.zeros((len(gold), L))
        np.add.at(score, row, unary[col])
        np.add.at(score, e[:, 0], pair[e[:, 2], :, gold[e[:, 1]]])
        np.add.at(score, e[:, 1], pair[e[:, 2], gold[e[:, 0]], :])
        score -= np.logaddexp.reduce(score, axis=1, keepdims=True)
        miss = target - np.exp(score)
        step = np.zeros_like(unary)
        np.add.at(step, col, miss[row])
        unary += rate * (step * share - decay * unary)
        if len(e):
            grad = np.zeros_like(pair)
            np.add.at(grad, (e[:, 2], slice(None), gold[e[:, 1]]), miss[e[:, 0]])
            np.add.at(grad, (e[:, 2], gold[e[:, 0]]), miss[e[:, 1]])
            pair += rate * (grad / len(e) - decay * pair)
    # Potentials for agreement only: repeated tokens pull towards one label, never apart.
    pair[1:] = np.array([np.diag(np.maximum(np.diag(p), 0.5)) for p in pair[1:]])
    return Field(names, unary, pair)


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Field:
    """A field trained on at most ``rows`` documents, chosen by the hash of their id."""
    ids = bounded_sample(docs.where("doc_id is not null").select("doc_id").distinct(), "doc_id", rows)
    # The sample is bounded by its parameter, whatever the size of the table.
    texts = (docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").where("text rlike '[0-9@=:]'")
             .groupBy("doc_id").agg(F.min("text").alias("text")).select("text").collect())
    return train(sorted(r.text for r in texts))


def _added(nodes: list[Node], label: np.ndarray, base: list[Span]) -> list[Span]:
    """Spans of the field that no rule span touches."""
    cover = Cover(base)
    return [(LABELS[k], n.start, n.end) for n, k in zip(nodes, label) if k and not cover.touches(n.start, n.end)]


def find(field: Field, texts: list[str | None], sure: float = 0.5) -> list[tuple[list[Span], list[Span]]]:
    """Rule spans and all spans of each text."""
    base, nodes, lists, edges, first, can = [], [], [], [], [0], []
    for text in texts:
        text = text or ""
        own = nodes_of(text)
        base.append(base_spans(text))
        edges += [(a + first[-1], b + first[-1], k) for a, b, k in edges_of(own)]
        lists += [features(text, n) for n in own]
        can.append(possible(text, own, base[-1]))
        nodes.append(own)
        first.append(first[-1] + len(own))
    if not first[-1]:
        return [(b, b) for b in base]
    potentials = np.where(np.concatenate(can), field.potentials(lists), -1e3)
    belief = field.marginals(potentials, np.array(edges, int).reshape(-1, 3), first)
    best = belief.argmax(axis=1)
    best[belief.max(axis=1) < sure] = 0
    return [(b, in_order(b + _added(n, best[lo:hi], b))) for b, n, lo, hi in zip(base, nodes, first, first[1:])]


def mask(text: str | None, spans: list[Span]) -> str | None:
    """The text with every span replaced by its kind in brackets; overlapping spans are one, named by the first."""
    if not spans:
        return text
    out, end = [], 0
    for kind, a, b in spans:
        if a < end:
            if b > end:
                end = b
            continue
        out += [text[end:a], f"[{kind.upper()}]"]
        end = b
    return "".join([*out, text[end:]])


def _each(docs: DataFrame, field: Field, columns: list[str], schema, emit) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                texts = part.column(part.num_columns - 1).to_pylist()
                yield emit(part, texts, find(sent.value, texts))

    return docs.select(*columns).mapInArrow(run, schema)


def scan(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Counts of rule spans, their digest, ``spans`` of rules and field and their number, for each row of ``docs``.

    Offsets are code points, ends exclusive; spans come by start, then kind (email, ip, card, phone,
    secret). Null and empty texts have no spans: counts 0, the digest of an empty string, empty
    ``spans``. Rows are judged one by one, so repeated rows get equal results; an empty table gives no
    rows. Columns other than doc_id and text are not read.
    """
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long"

    def emit(part, texts, found):
        kinds = [[s[0] for s in base] for base, _ in found]
        return pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array([k.count(x) for k in kinds], pa.int64()) for x in KINDS[:4]),
             pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string()),
             pa.array([written(spans) for _, spans in found], pa.string()),
             pa.array([len(spans) for _, spans in found], pa.int64())], schema=arrow_schema(schema))

    return _each(docs.select(F.col("doc_id").cast("long"), "text"), fit(docs, rows), ["doc_id", "text"], schema, emit)


def redact(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """``docs`` with masked texts, and n_chars, where there is such a column, counted anew; no shuffle, no row is lost."""
    names = docs.columns
    at = names.index("text")
    order = [*names[:at], *names[at + 1:], "text"]
    ordered = docs.select(*[F.col(f"`{c}`") for c in order])

    def emit(part, texts, found):
        masked = pa.array([mask(t, spans) for t, (_, spans) in zip(texts, found)], part.schema.field(part.num_columns - 1).type)
        return pa.RecordBatch.from_arrays([*part.columns[:-1], masked], schema=part.schema)

    out = _each(ordered, fit(docs, rows), [f"`{c}`" for c in order], ordered.schema, emit)
    counted = {c: F.length("text").cast(docs.schema[c].dataType).alias(c) for c in names if c == "n_chars"}
    return out.select(*[counted.get(c, F.col(f"`{c}`")) for c in names])
