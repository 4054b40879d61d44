"""Vector codes, conversation repair and document fingerprints against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veritab.llm import conversations as conv
from veritab.llm import fingerprints as prints
from veritab.llm import queries
from veritab.llm import vector_codes as codes

SMALL = "/root/testdata/sf0.001"
NOTHING = hashlib.sha256(b"").hexdigest()


# --- vector codes

def codes_brute(rows, entries=256):
    """vec_id, code, error, label_error, hash; by full search over plain integers."""
    kept = [(i, [math.floor(1024 * x) for x in v], lab) for i, v, lab in rows
            if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    width = len(kept[0][1]) // 4
    cut = lambda v: [tuple(v[p * width:(p + 1) * width]) for p in range(4)]
    books = [[cut(v)[p] for _, v, _ in kept[:entries]] for p in range(4)]
    near = lambda p, x: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(books[p]))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(p, cut(v)[p])[1], []).append(cut(v)[p])
            for j, xs in groups.items():
                books[p][j] = tuple(sum(c) // len(xs) for c in zip(*xs))
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    got = [(i, [near(p, cut(v)[p]) for p in range(4)], lab) for i, v, lab in kept]
    sums = Counter()
    for _, n, lab in got:
        sums[lab] += sum(d for d, _ in n)
    return [(i, "".join(f"{j:02x}" for _, j in n), sum(d for d, _ in n), sums[lab], sha) for i, n, lab in got]


def vectors_of(spark, rows):
    return spark.createDataFrame([(v, "x", lab, i) for i, v, lab in rows], "embedding array<float>, code string, label int, vec_id long")


def in_order(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "", r[2] or 0))


def test_vector_codes(spark):
    rng = random.Random(4)
    f32 = lambda x: float(np.float32(x))
    rows = [(i * 3 % 700, [f32(rng.gauss(0, 0.05)) for _ in range(8)], rng.choice([1, 2, None])) for i in range(400)]
    rows += [(i, [f32(rng.randrange(3) / 1024) for _ in range(8)], 1) for i in range(900, 960)]  # ties
    rows += [rows[3], rows[3], (None, [0.5] * 8, None), (2000, None, 1), (2001, [1.0] * 7 + [None], 1), (2002, [float("nan")] + [0.0] * 7, 1),
             (2003, [float("-inf")] + [0.0] * 7, 1), (2004, [-1e-9] * 8, 5)]
    got = codes.compress(vectors_of(spark, rows))
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert in_order(got.collect()) == in_order(codes_brute(rows))
    assert in_order(codes.compress(vectors_of(spark, rows[:30])).collect()) == in_order(codes_brute(rows[:30]))


def test_vector_codes_odd_tables(spark):
    assert codes.compress(vectors_of(spark, [(1, None, 1)])).count() == 0
    assert codes.compress(vectors_of(spark, [(1, [1.0] * 4, 1)]).limit(0)).count() == 0
    rows = [(1, [1.0] * 8, 1), (2, [2.0] * 8, 1), (3, [1.0] * 5, 1)]
    got = {r.vec_id: (r.code, r.error, r.label_error) for r in codes.compress(vectors_of(spark, rows)).collect()}
    assert got == {1: ("00000000", 0, 0), 2: ("01010101", 0, 0), 3: (None, None, 0)}
    assert [r.code for r in codes.compress(vectors_of(spark, [(1, [], 1), (2, [], 2)])).collect()] == ["00000000"] * 2
    big = [(i, [float(np.float32(x * 1e30)) for x in (i, -i, i * i, 1)], i % 2) for i in range(6)] + [(9, [0.1] * 4, 0)]
    got = in_order(codes.compress(vectors_of(spark, big), entries=3).collect())
    assert [(r[0], r[1], r[4]) for r in got] == [(r[0], r[1], r[4]) for r in in_order(codes_brute(big, 3))]


@pytest.mark.parametrize("spread", [1, 4, 200, 10 ** 13])
def test_tree_equals_full_search(spread):
    rng = np.random.default_rng(spread % 1000)
    for size, width in ((1, 3), (9, 1), (256, 2), (256, 6)):
        entries = rng.integers(-spread, spread + 1, (size, width))
        queries_ = rng.integers(-spread, spread + 1, (300, width))
        queries_[:size] = entries[:300]
        found, best = codes.Codebook(entries).nearest(queries_)
        away = ((queries_[:, None].astype(object) - entries[None].astype(object)) ** 2).sum(axis=2)
        assert found.tolist() == [min(range(size), key=lambda j: (a[j], j)) for a in away] and best.tolist() == away.min(axis=1).tolist()


# --- conversations

def harm(rows):
    out = []
    for c, t, role, text in rows:
        told = lambda x: " " if x is None else str(x)
        role, text, h = told(role), told(text), zlib.crc32(f"{told(c)}:{told(t)}".encode()) % 20
        if h:
            out += [(c, t, "user" if h == 4 else role, "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text)] * (1 + (h == 3))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).hexdigest()))


def fault_of(rows):
    seen, out = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip("\t\n\v\f\r ")
        out.append("blank" if not bare.strip("\t\n\v\f\r ") else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows, found):
    """By trying every choice of edits and of up to two inserts before each row and at the end."""
    best = None
    for edits in itertools.product(*["D" if f in ("blank", "duplicate") else "KRD" for f in found]):
        for inserts in itertools.product(range(3), repeat=len(rows) + 1):
            cost, audit, turns = 5 * sum(inserts), "", []
            for k, edit, f, (_, _, role, text) in zip(inserts, edits, found, rows):
                audit += "I" * k + edit
                turns += ["I"] * k + ([] if edit == "D" else ["R" + text] if edit == "R" else [(role, text)])
                cost += {"K": 0, "R": 1, "D": 2}[edit] + (5 if f == "truncated" and edit != "D" else 0)
            audit, turns = audit + "I" * inserts[-1], turns + ["I"] * inserts[-1]
            if best and (cost, audit) >= best[:2]:
                continue
            out, ok = [], True
            for turn in turns:
                want = "a" if out and out[-1][0][:1] == "u" else "u"
                if isinstance(turn, str):
                    out.append(({"u": "user", "a": "assistant"}[want], turn[1:] if turn[0] == "R" else ""))
                else:
                    out.append(turn)
            ok = re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out))
            if ok:
                best = (cost, audit, "\n".join(f"{r}:{t}" for r, t in out))
    return best


def repaired_brute(rows):
    out = []
    after = harm(rows)
    for c in {r[0] for r in rows}:
        mine = [r for r in after if r[0] == c]
        found, turns = fault_of(mine), [r[1] for r in mine if r[1] is not None]
        cost, audit, text = cheapest(mine, found)
        n = Counter(found)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, n["blank"], n["duplicate"], n["truncated"], illegal, cost, audit,
                    hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0))


def conversations_of(spark, rows):
    return spark.createDataFrame([(t, x, "z", r, c) for c, t, r, x in rows], "turn long, text string, audit string, role string, conv_id long")


def test_repair_equals_brute_force(spark):
    rng = random.Random(7)
    rows = []
    for c in range(120):
        for t in range(rng.randrange(1, 5)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"])
            text = rng.choice(["Hi.", "Well?", "cut off", "é ü. \n", " ", None, "", "One more!", "no . end", "x" * 3000 + "."])
            rows.append((c, rng.choice([t, t, t, t + 3, None]), role, text))
    rows += [(None, 1, "user", "Q?"), (None, 2, "assistant", "A."), (500, None, None, None), (501, 2, "user", "a."), (501, 2, "user", "a."), (501, 2, "user", "b.")]
    want = repaired_brute(rows)
    got = conv.repair(conversations_of(spark, rows))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=lambda r: (r[0] is not None, r[0] or 0)) == want
    assert conv.repair(conversations_of(spark, rows).limit(0)).count() == 0
    gone = next(i for i in range(10_000) if zlib.crc32(f"{i}:1".encode()) % 20 == 0)
    assert tuple(conv.repair(conversations_of(spark, [(gone, 1, "user", "Hi.")])).first()) == (gone, 0, 0, 0, 0, 0, 0, "", NOTHING)


def plain(rows):
    """Cost and audit of rows <initial, bad, cut off> by the same states, with whole texts in place of nodes."""
    states = {0: (0, "")}

    def offer(to, s, value):
        if s not in to or value < to[s]:
            to[s] = value

    def inserted(states):
        out = dict(states)
        for s in (0, 1, 3):
            if s in states:
                offer(out, 2, (states[s][0] + 5, states[s][1] + "I"))
        if 2 in out:
            offer(out, 3, (out[2][0] + 5, out[2][1] + "I"))
        return out

    for initial, bad, cut in rows:
        new = {}
        for s, (cost, text) in inserted(states).items():
            offer(new, s, (cost + 2, text + "D"))
            if not bad:
                more = 5 if cut else 0
                if initial in conv._KEPT[s]:
                    offer(new, conv._KEPT[s][initial], (cost + more, text + "K"))
                offer(new, conv._NEW[s], (cost + more + 1, text + "R"))
        states = new
    states = inserted(states)
    return min(states[s] for s in (0, 3) if s in states)


def test_one_conversation_over_many_partitions(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([f"{rng.randrange(400)}.", f"{t}.", f"{t} and", ""]))
            for c, n in ((1, 5), (7, 3000), (9, 4)) for t in range(n)]
    after = [r for r in harm(rows) if r[0] == 7]
    found = fault_of(after)
    cost, audit = plain([(r[2][:1], f in ("blank", "duplicate"), f == "truncated") for r, f in zip(after, found)])
    data = conversations_of(spark, rows)
    parts = conv.faults(conv.damaged(data))
    got = {r.conv_id: r for r in conv.repair(data).collect()}[7]
    assert parts.repartitionByRange(8, "conv_id", "turn").where("conv_id = 7").select(F.spark_partition_id()).distinct().count() > 5
    assert (got.cost, got.audit) == (cost, audit)
    assert (got.blank, got.duplicate, got.truncated) == tuple(Counter(found)[k] for k in ("blank", "duplicate", "truncated"))
    assert got.gaps == max(r[1] for r in after) - min(r[1] for r in after) + 1 - len({r[1] for r in after})
    assert got.illegal == sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(after, after[1:]))
    turns = conv.repaired(conv.damaged(data), conv.audits(parts)).where("conv_id = 7").orderBy("place").collect()
    assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in turns)) and len(turns) == sum(ch != "D" for ch in audit)


def test_audits_compare_as_texts(monkeypatch):
    rng = random.Random(5)

    def nodes(n):
        out = [conv.Edit()]
        for _ in range(n):
            out.append(conv.Edit(rng.choice(out[-6:]), rng.choice("DIKR")))
        return out

    for base in (conv._BASE, 0):  # with 0 every audit that ends alike has the same hash
        monkeypatch.setattr(conv, "_BASE", base)
        made = nodes(150)
        assert all(conv.less(a, b) == (a.text() < b.text()) for a in made for b in made)


# --- document fingerprints

def signature_brute(text):
    """The samples of a text, by the formula, term by term."""
    counts = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
    out = []
    for k in range(prints.SAMPLES):
        step, i = divmod(k, prints.STEP)
        least = None
        for word, n in counts.items():
            term = (xxhash.xxh64_intdigest(word.encode(), 42) - (1 << 64) * (xxhash.xxh64_intdigest(word.encode(), 42) >> 63)) >> 1
            z = xxhash.xxh64_intdigest(step.to_bytes(4, "little"), xxhash.xxh64_intdigest(term.to_bytes(8, "little", signed=True), 42))
            a, b, c = (xxhash.xxh64_intdigest((z ^ ((3 * i + j + 1) * 0x9E3779B97F4A7C15 % (1 << 63))).to_bytes(8, "little"), 42) for j in range(3))
            r, g = (-math.log(((x >> 32) + 0.5) * ((x & 0xFFFFFFFF) + 0.5) * 2.0 ** -64) for x in (a, b))
            beta = (c >> 11) * 2.0 ** -53
            t = math.floor(math.log(n) / r + beta)
            value = math.log(g) - r * (t - beta + 1)
            least = value if least is None else min(least, value)
        out.append(least)
    return out


def edits_brute(rows):
    """<id, text, edited text, next text> in order."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (
        r[0] is None, r[0] or 0, (xxhash.xxh64_intdigest(r[1].encode(), 42) >> 1), r[1]))
    return [(i, t, t[:len(t) - len(t) // 2] + u[:len(t) // 2], u) for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1])]


def prints_of(spark, rows):
    return spark.createDataFrame([(t, "q", i) for i, t in rows], "text string, fingerprint string, doc_id long")


@pytest.mark.parametrize("bucket_rows", [256, 4])
def test_fingerprints(spark, bucket_rows):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").limit(150).collect()]
    rows = docs + [(7, "same id"), (7, "another text of the same id"), (None, "no id"), (None, None), (3, docs[3][1])]
    rows += [(9000, f"{i} crowd") for i in range(60)]
    rows += [(10_000, ""), (10_001, None), (10_002, "\t \n"), (10_003, "é" * 9), (10_004, "word " * 30_000), (1 << 62, "last"), (-5, "first one")]
    got = prints.fingerprints(prints_of(spark, rows), bucket_rows=bucket_rows)
    assert got.columns == ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    got = got.collect()
    want = edits_brute(rows)
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=key) == sorted(
        ((i, len(t), hashlib.sha256(e.encode()).hexdigest()) for i, t, e, _ in want), key=key)
    by_edit = {(i, hashlib.sha256(e.encode()).hexdigest()): (t, e, u) for i, t, e, u in want}
    of_text = {}
    for r in got:
        text, edited, after = by_edit[r.doc_id, r.edited_sha256]
        same = lambda a, b: sum(a[8 * k:8 * k + 8] == b[8 * k:8 * k + 8] for k in range(prints.SAMPLES)) / prints.SAMPLES
        assert len(r.fingerprint) == 8 * prints.SAMPLES and r.near_edited == same(r.fingerprint, r.edited_fingerprint)
        assert of_text.setdefault(text, r.fingerprint) == r.fingerprint and of_text.setdefault(edited, r.edited_fingerprint) == r.edited_fingerprint
    for r in got:
        assert r.near_next == same(r.fingerprint, of_text[by_edit[r.doc_id, r.edited_sha256][2]])
    assert prints.fingerprints(prints_of(spark, rows).limit(0)).count() == 0
    one = prints.fingerprints(prints_of(spark, [(1, "abcd")])).first()
    assert (one.edited_sha256, one.near_next) == (hashlib.sha256(b"abab").hexdigest(), 1.0)


def test_samples_follow_the_formula(spark):
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").orderBy("doc_id").limit(12).collect()] + ["a a a b", "a b", ""]
    pairs = spark.createDataFrame([(i, t, u) for i, (t, u) in enumerate(zip(texts, texts[1:] + texts[:1]))], "k int, t string, u string")
    listed = pairs.select("k", prints.weighted_terms(F.col("t"), F.col("u")).alias("all"))
    for r, t, u in zip(listed.orderBy("k").collect(), texts, texts[1:] + texts[:1]):
        words = lambda x: Counter(re.findall(r"[^\x20\x09-\x0D]+", x))
        assert sorted((w.n, w.m) for w in r["all"]) == sorted((words(t)[w], words(u)[w]) for w in words(t) | words(u))
    terms = listed.select("k", F.explode_outer("all").alias("t")).select(
        "k", "t.term", *[F.when(F.col(f"t.{w}") > 0, F.ln(f"t.{w}")).alias(w) for w in "nm"])
    for r, t, u in zip(prints.samples(terms, ["k"]).orderBy("k").collect(), texts, texts[1:] + texts[:1]):
        for got, text in ((r.one, t), (r.other, u)):
            assert got == pytest.approx(signature_brute(text), rel=1e-9) if text else set(got) == {None}


def test_collisions_estimate_generalised_jaccard(spark):
    rng = random.Random(11)
    pairs = []
    for i in range(60):
        base = [f"w{rng.randrange(40)}" for _ in range(120)]
        other = base[:rng.randrange(121)] + [f"v{rng.randrange(40)}" for _ in range(rng.randrange(60))]
        pairs.append((" ".join(base), " ".join(other)))
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "k int, a string, b string")
    terms = rows.select("k", F.explode(prints.weighted_terms(F.col("a"), F.col("b"))).alias("t")).select(
        "k", "t.term", *[F.when(F.col(f"t.{w}") > 0, F.ln(f"t.{w}")).alias(w) for w in "nm"])
    got = {r.k: r.near for r in prints.samples(terms, ["k"], 256).select("k", prints.likeness(F.col("one"), F.col("other")).alias("near")).collect()}
    off = []
    for i, (a, b) in enumerate(pairs):
        x, y = Counter(a.split()), Counter(b.split())
        off.append(got[i] - sum((x & y).values()) / sum((x | y).values()))
    assert max(map(abs, off)) < 0.13 and abs(sum(off) / len(off)) < 0.015


def test_queries_are_registered():
    assert {"op11_vector_code_compression", "op12_conversation_repair", "op13_document_fingerprints"} <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, name):
    import compare
    _, n, verdict = compare.compare(spark, compare.duck(SMALL), SMALL, name, queries.QUERIES[name], queries.ORACLES[name])
    assert n > 0 and verdict == "ok", verdict


def test_digests_of_several_steps_agree(spark):
    """The texts of the repaired turns give the hash that the query tells."""
    data = spark.read.parquet(f"{SMALL}/conversations.parquet")
    rows = conv.damaged(data)
    turns = conv.repaired(rows, conv.audits(conv.faults(rows))).collect()
    texts = {}
    for r in sorted(turns, key=lambda r: (r.conv_id, r.place)):
        texts.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in conv.repair(data).collect():
        assert r.repaired_sha256 == hashlib.sha256("\n".join(texts.get(r.conv_id, [])).encode()).hexdigest()
