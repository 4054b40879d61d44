"""Operators that compare documents, and the pipeline, against brute force."""

import math
import re
import sys
from collections import Counter

import pytest
from pyspark.sql import functions as F

from test_llm_texts import ODD, docs_of, documents, fingerprint_brute, labels_of, spans_brute
from veritab.llm import common, decontaminate, packing, pii, quality, simhash_dedup, suffix_dedup
from veritab.llm.simhash_dedup import near_duplicates

SMALL = "/root/testdata/sf0.001"


# --- components and near-duplicates

def components_brute(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [find(i) for i in range(n)]


def test_components(spark):
    import random
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(60)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 400), rng.randrange(200, 400)) for _ in range(150)]
    want = components_brute(400, edges)
    got = {r.node: r.root for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(i, i) == want[i] for i in range(400))
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def near_brute(ids, texts, radius=3):
    """The rows, and the smallest id of each component."""
    fps = [fingerprint_brute(t) for t in texts]
    edges = [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= radius]
    roots = components_brute(len(fps), edges)
    least = {}
    for i, r in zip(ids, roots):
        least[r] = min((x for x in (least.get(r), i) if x is not None), default=None)
    return [(i, f"{fp:016x}", least[r]) for i, fp, r in zip(ids, fps, roots)], list(least.values())


def test_near_duplicates(spark):
    texts = [r.text for r in documents(spark).select("text").limit(400).collect()] + [t for t in ODD if len(t or "") < 30_000]
    texts += [texts[3] + " extra", texts[3], "A b c", "a B C"]
    ids = [None if i == 5 else i // 2 * 2 if i > 395 else i for i in range(len(texts))]
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    want, groups = near_brute(ids, texts)
    want.sort(key=key)
    docs = docs_of(spark, texts, ids)
    assert sorted(map(tuple, near_duplicates(docs).collect()), key=key) == want
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda x: (x is None, x or 0)) == sorted(groups, key=lambda x: (x is None, x or 0))
    assert near_duplicates(docs.limit(0)).count() == 0 and simhash_dedup.drop_near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("key_rows", [4096, 16])
def test_links_lose_nothing(spark, key_rows):
    import random
    rng = random.Random(9)
    fps = [rng.getrandbits(64) for _ in range(150)]
    fps += [f ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for f in fps for _ in range(3)]
    dense = rng.getrandbits(64)
    fps += [dense ^ (1 << a) ^ (1 << b) for a in range(9) for b in range(a)]
    fps = sorted(set(fps))
    nodes = spark.createDataFrame([(i, f - (f >> 63 << 64)) for i, f in enumerate(fps)], "node long, fp long")
    got = components_brute(len(fps), [(r.a, r.b) for r in simhash_dedup.links(nodes, 3, key_rows).collect()])
    want = components_brute(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 3])
    assert got == want


# --- long repeats

def repeats_brute(texts, t=suffix_dedup.T):
    import hashlib
    data = [(x or "").encode() for x in texts]
    seen = Counter(b[i:i + t] for b in data for i in range(len(b) - t + 1))
    out = []
    for b in data:
        mark = bytearray(len(b))
        for i in range(len(b) - t + 1):
            if seen[b[i:i + t]] > 1:
                mark[i:i + t] = b"\1" * t
        kept = bytes(x for x, m in zip(b, mark) if not m)
        out.append((len(b), sum(mark), sum(m and not (i and mark[i - 1]) for i, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return out


def repeat_texts():
    import random
    rng = random.Random(17)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randint(3, 9)))
    fresh = lambda n: "".join(word() for _ in range(n))
    passage = fresh(160)
    base = fresh(400)
    texts = [None, "", "short", "short", base, base, base[:600], base[37:900] + fresh(30), "x" + base[300:1500] + "y"]
    texts += [fresh(60) + passage[rng.randint(0, 200):] + fresh(60) for _ in range(12)] + [fresh(20) + passage + fresh(20)] * 3
    texts += ["ab" * 500, "z" * 2000, "ab" * 200, fresh(100) + "q" * 399, fresh(100) + "q" * 401, base[:399], base[100:500], fresh(30) + base[100:500]]
    once = fresh(90)
    return texts + [fresh(40) + once + fresh(80) + once + fresh(10), passage[5:450].upper(), "日本語" * 140 + passage]


@pytest.mark.parametrize("group_rows", [20_000, 2])
def test_repeats(spark, group_rows):
    texts = repeat_texts()
    ids = [None if i == 4 else 7 if i in (7, 8) else i for i in range(len(texts))]
    docs = docs_of(spark, texts, ids)
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs, group_rows, bucket_rows=40)).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[1:])
    want = [(i, *w) for i, w in zip(ids, repeats_brute(texts))]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_repeats_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.collect()
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(suffix_dedup.remove_repeats(docs)).collect()}
    assert [got[r.doc_id] for r in rows] == repeats_brute([r.text for r in rows])
    assert suffix_dedup.remove_repeats(docs.limit(0)).count() == 0


def test_repeats_of_any_id(spark):
    # The hash of the first id is 0 modulo every size of the filter.
    texts = repeat_texts()[4:12]
    ids = [25_317_696, 0, -1, 1 << 62, -(1 << 63), 32_768, 32_767, 1]
    got = suffix_dedup.digest(suffix_dedup.remove_repeats(docs_of(spark, texts, ids))).collect()
    assert sorted(map(tuple, got)) == sorted((i, *w) for i, w in zip(ids, repeats_brute(texts)))


@pytest.mark.parametrize("rows, bits", [(0, 1 << 15), (2_000, 1 << 15), (2_048, 1 << 16), (10 ** 6, 1 << 24), (10 ** 12, 1 << 31)])
def test_filter_follows_the_rows(rows, bits):
    assert suffix_dedup._filter_bits(rows) == bits


def test_shared_passages(spark, monkeypatch):
    import random
    rng = random.Random(23)
    fresh = lambda n: [f"w{rng.randrange(10 ** 6)}" for _ in range(n)]
    long = fresh(90)
    texts = [fresh(200) + long[20:71] + fresh(30), fresh(5) + long[20:71], long[:51], long[39:], fresh(60) + long[40:71] + fresh(60), long, fresh(400), [], fresh(50)]
    texts = ["\t".join(t) + "  \n" for t in texts] + [None, " ".join(fresh(3)) * 40]
    twice = " ".join(fresh(60))
    texts += [twice + " x " + twice]  # its own repeat only

    def runs(t, n):
        w = (t or "").split()
        return {tuple(w[i:i + n]) for i in range(len(w) - n + 1)}

    def sharing(n):
        seen = Counter(r for t in texts for r in runs(t, n))
        return {i for i, t in enumerate(texts) if any(seen[r] > 1 for r in runs(t, n))}

    docs = docs_of(spark, texts, list(range(len(texts))))
    got = {r.doc_id for r in suffix_dedup.shared_passages(docs).collect()}
    assert sharing(suffix_dedup.PASSAGE) <= got <= sharing(suffix_dedup.PIECE) and {0, 1, 2, 5} <= got and 4 not in got
    told = suffix_dedup.digest(suffix_dedup.remove_repeats(docs), suffix_dedup.shared_passages(docs))
    assert {r.doc_id for r in told.where("shares_passage").collect()} == got and told.count() == len(texts)
    assert suffix_dedup.shared_passages(docs.limit(0)).count() == 0
    whole = [suffix_dedup.passage_marks(t) for t in texts]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 16)
    assert [suffix_dedup.passage_marks(t) for t in texts] == whole


def test_anchors_do_not_depend_on_blocks(monkeypatch):
    data = "".join(t or "" for t in repeat_texts()).encode()
    whole = suffix_dedup.anchors(data)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 700)
    for a, b in zip(whole, suffix_dedup.anchors(data)):
        assert (a == b).all()


# --- decontamination

def shingles(words, n):
    return Counter(" ".join(words[i:i + n]) for i in range(len(words) - n + 1))


def leaks_brute(texts, items, least=0.8):
    split = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    items = {i: split(t) for i, t in items if split(t)}
    held = Counter(s for w in items.values() for s in shingles(w, min(5, len(w))))
    out = set()
    for d, t in texts:
        words = split(t)
        for i, w in items.items():
            n = min(5, len(w))
            want = shingles(w, n)
            weight = {s: 1 + math.log(len(items) / held[s]) for s in want}
            size = min(len(w), len(words))
            for at in range(max(1, len(words) - size + 1)):
                own = shingles(words[at:at + size], n)
                if own.keys() & want.keys():
                    common_ = sum(weight[s] * min(own[s], want[s]) for s in want)
                    either = sum(weight[s] * max(own[s], want[s]) for s in want)
                    either += (1 + math.log(len(items))) * sum(c for s, c in own.items() if s not in want)
                    if common_ / either >= least:
                        out.add((d, i))
                        break
    return out


def test_leaks(spark):
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    long = max((t for _, t in bench), key=len)
    words = long.split()
    extra = [long, "x y " + long.upper() + " z", " ".join(words[:20] + ["NEW"] + words[20:]), " ".join(words[:-3]), " ".join(words[: len(words) // 2]),
             " ".join(w + "," for w in words), None, "", "a b", "Tiny one", "word " * 9000 + long, long, long]
    rows += [(10_000 + i, t) for i, t in enumerate(extra)]
    bench += [(900, "tiny one"), (901, None), (902, ""), (903, bench[0][1]), (904, "solo")]
    docs = docs_of(spark, [t for _, t in rows], [i for i, _ in rows])
    items = spark.createDataFrame(bench, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontaminate.matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks_brute(rows, bench)
    assert len({(r.doc_id, r.item_id) for r in got}) == len(got)
    clean = decontaminate.drop_contaminated(docs, items)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {r.doc_id for r in got}
    assert decontaminate.matches(docs.limit(0), items).count() == 0 and decontaminate.matches(docs, items.limit(0)).count() == 0
    assert decontaminate.drop_contaminated(docs, items.limit(0)).count() == len(rows)


def test_copied_items_hide_nothing(spark):
    import random
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz"
    some = [["".join(rng.choices(letters, k=6)) for _ in range(55)] for _ in range(300)]
    bench = [(i, " ".join(w)) for i, w in enumerate(some)]
    copies = [(1000 + i, bench[0][1] + "!") for i in range(150)]
    edited = some[0][:27] + ["changed"] + some[0][28:]
    mixed = some[1][:50] + some[2][50:]  # foreign shingles that another text holds
    docs = docs_of(spark, [" ".join(edited), "before it " + " ".join(mixed) + " and on", bench[3][1], "none of all this"])
    schema = "item_id long, text string"
    alone = decontaminate.matches(docs, spark.createDataFrame(bench, schema)).collect()
    got = decontaminate.matches(docs, spark.createDataFrame(bench + copies, schema)).collect()
    same = {0, *(i for i, _ in copies)}
    assert {(r.doc_id, r.item_id) for r in got} == {(0, i) for i in same} | {(1, 1), (2, 3)}
    assert {(r.doc_id, r.item_id) for r in alone} == {(0, 0), (1, 1), (2, 3)}
    # Copies change no similarity; 46 of 56 shingles are common.
    told = {(r.doc_id, r.item_id): r.similarity for r in alone}
    assert all(abs(r.similarity - told[r.doc_id, 0 if r.item_id in same else r.item_id]) < 1e-9 for r in got)
    assert abs(told[0, 0] - 46 / 56) < 1e-9
    assert decontaminate.drop_contaminated(docs, spark.createDataFrame(bench + copies, schema)).count() == 1


def test_windows_between_offsets(spark):
    laid = spark.createDataFrame([([(4, 0), (4, 3), (4, 9), (5, 10)],)], "laid array<struct<length: int, start: int>>")
    got, = laid.select(decontaminate._between(F.col("laid")).alias("x")).collect()
    assert [(r.start, r.length) for r in got.x] == [(0, 4), (1, 4), (2, 4), (3, 4), (9, 4), (10, 5)]


def test_main_path_has_no_python(spark):
    docs, items = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/benchmark.parquet")
    plan = decontaminate.matches(docs, items)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# --- packing

def check_packed(rows, texts, sources, capacity):
    """``rows`` cover every byte of every document once and break no rule."""
    by_doc, by_bin = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.bin, []).append(r)
    for i, t in enumerate(texts):
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.start for r in own] == [sum(x.size for x in own[:k]) for k in range(len(own))]
        assert sum(r.size for r in own) == len((t or "").encode())
    for held in by_bin.values():
        held.sort(key=lambda r: (r.offset, r.size))
        assert all(a.offset + a.size == b.offset for a, b in zip(held, held[1:])) and held[0].offset == 0
        assert sum(r.size for r in held) == held[0].bin_size <= capacity
        for values in ([sources[r.doc_id] for r in held], [" ".join((texts[r.doc_id] or "").lower().split()) for r in held]):
            given = [v for v in values if v]
            assert len(given) == len(set(given))


def test_packing(spark):
    rows = documents(spark).collect()
    docs = documents(spark).withColumn("bin", F.lit("x")).withColumn("shard", F.lit("x"))
    got = packing.pack(docs, capacity=4096, shard_rows=300)
    got = got.collect()
    texts, sources = [None] * len(rows), [None] * len(rows)
    for r in rows:
        texts[r.doc_id], sources[r.doc_id] = r.text, r.source
    check_packed(got, texts, sources, 4096)
    tables = packing.bins(spark.createDataFrame(got)).collect()
    assert sum(len(b.doc_ids) for b in tables) == len(got)


def test_packing_odd_rows(spark):
    docs = docs_of(spark, ODD).withColumn("source", F.when(F.col("doc_id") % 2 == 0, "s"))
    check_packed(packing.pack(docs, capacity=1000).collect(), ODD, ["s" if i % 2 == 0 else None for i in range(len(ODD))], 1000)
    assert packing.pack(docs.limit(0)).count() == 0
    same = docs_of(spark, ["one text"] * 20, [3] * 19 + [None])
    got = packing.pack(same).collect()
    assert len(got) == len({r.bin for r in got}) == 20


@pytest.mark.parametrize("capacity", [7, 8, 64])
def test_pieces_are_texts(spark, capacity):
    import random
    rng = random.Random(capacity)
    texts = ["é" * 600, "a" * 129, "日本語" * 40, "🙂" * 33, "", None, "a🙂b" * 50] + ["".join(rng.choice("aé日🙂") for _ in range(rng.randint(0, 200))) for _ in range(60)]
    got = {}
    for r in packing.pack(docs_of(spark, texts), capacity=capacity).collect():
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.size))
    for i, t in enumerate(texts):
        data = (t or "").encode()
        parts = [data[a:a + n] for _, a, n in sorted(got[i])]
        assert b"".join(parts) == data and all(len(x) <= capacity for x in parts)
        assert "".join(x.decode() for x in parts) == (t or "") and (len(parts) == 1 or all(parts))


def test_ids_of_other_types(spark):
    docs = spark.createDataFrame([("k1", "some text", "s"), (None, "other", "s")], "doc_id string, text string, source string")
    assert sorted(r.doc_id or "" for r in packing.pack(docs).collect()) == ["", "k1"]
    short = docs_of(spark, ["x", "y"]).withColumn("doc_id", F.col("doc_id").cast("short"))
    assert dict(packing.pack(short).dtypes)["doc_id"] == "smallint" and sorted(r.doc_id for r in packing.pack(short).collect()) == [0, 1]


def test_tightest_bin():
    import random
    rng = random.Random(2)
    for _ in range(60):
        sizes = [rng.randint(0, 30) for _ in range(80)]
        sources, clusters = [rng.choice([None, 1, 2, 3, 4, 5]) for _ in sizes], [rng.choice([None, *range(30)]) for _ in sizes]
        got = packing.best_fit(sizes, sources, clusters, 40)
        room, held = [], []
        for size, s, c, (b, offset) in zip(sizes, sources, clusters, got):
            fits = [i for i in range(len(room)) if room[i] >= size and (s is None or s not in held[i][0]) and (c is None or c not in held[i][1])
                    and room[i] > 0]
            if fits:
                assert room[b] == min(room[i] for i in fits) and b in fits
            else:
                assert b == len(room)
                room.append(40)
                held.append((set(), set()))
            assert offset == 40 - room[b]
            room[b] -= size
            held[b][0].add(s)
            held[b][1].add(c)


# --- pipeline

def test_pipeline(spark):
    import corpus_pipeline as p
    root = SMALL
    docs = spark.read.parquet(f"{root}/documents.parquet")
    assert [n for n, _ in p.STAGES] == ["quality_rules", "simhash_near_dedup", "benchmark_decontamination", "pii", "best_fit_packing"]
    stage = dict(p.STAGES)
    good = stage["quality_rules"](spark, docs, root)
    labels = spark.read.parquet(f"{root}/labels.parquet")
    kept = {r.doc_id for r in quality.assess(docs, labels).where("kept").collect()}
    assert {r.doc_id for r in good.collect()} == kept and good.columns == docs.columns
    single = stage["simhash_near_dedup"](spark, good, root)
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    assert {r.doc_id for r in single.collect()} == set(near_brute(*zip(*rows))[1]) and single.columns == docs.columns
    clean = stage["benchmark_decontamination"](spark, single, root)
    rows = [(r.doc_id, r.text) for r in single.collect()]
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{root}/benchmark.parquet").collect()]
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - {d for d, _ in leaks_brute(rows, bench)}
    private = stage["pii"](spark, clean, root)
    before, after = {r.doc_id: r for r in clean.collect()}, {r.doc_id: r for r in private.collect()}
    assert private.columns == docs.columns and before.keys() == after.keys()
    for i, r in after.items():
        assert not spans_brute(r.text) and r.n_chars == len(r.text)
        assert r.text == before[i].text or pii.nodes_of(before[i].text)
    got = p.run(spark, root).collect()
    assert {r.doc_id for r in got} == after.keys()
    assert sum(r.size for r in got) == sum(len(r.text.encode()) for r in after.values())


def test_pipeline_on_odd_rows(spark, tmp_path):
    import corpus_pipeline as p
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    for k, docs in enumerate([docs_of(spark, ODD).select(*names), docs_of(spark, []).select(*names)]):
        root = str(tmp_path / str(k))
        docs.write.parquet(f"{root}/documents.parquet")
        labels_of(spark, []).write.parquet(f"{root}/labels.parquet")
        spark.createDataFrame([], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
        assert p.run(spark, root).count() >= 0
        for name, stage in p.STAGES[:-1]:
            assert stage(spark, docs, root).columns == names


def test_queries_are_registered():
    import __spark_entry__ as e
    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in e.queries()
    assert "veritab.llm" in sys.modules
