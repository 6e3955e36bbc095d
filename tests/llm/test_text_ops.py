"""Language, near-duplicates, repeated strings and personal data against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from assaywright.llm import language, pii, simhash, suffix
from assaywright.llm._common import stored, table
from assaywright.llm.components import components

DATA = "/root/testdata/sf0.001"


# ---- language
def test_language_held_out(spark):
    got = language.op1_language_id(spark, DATA).join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == 200 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["held_out"]]
    assert np.mean([r["lang"] == r["lang_pred"] for r in held]) > 0.97


def test_language_edges(spark):
    rows = [(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "de"), (4, "12 34 !!", "en"), (5, "", None), (6, "the dog", None), (7, "½²", "x"), (8, "the " * 50_000, "en")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("score", F.lit("own"))
    got = {r["doc_id"]: r for r in language.predict(df, language.fit(df, "text", "lang")).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3, 4, 5, 6, 7, 8)] == ["en", "de", "und", "und", "und", "en", "und", "en"]
    assert got[3]["score"] == 0.0
    none = language.fit(df.limit(0), "text", "lang")
    assert {r["lang_pred"] for r in language.predict(df, none).collect()} == {"und"}


def bayes_brute(rows: list[tuple], texts: list[str | None], orders=language.ORDERS) -> list[tuple]:
    """Multinomial naive Bayes over hashed character n-grams in plain Python: (label, score) of each text."""
    import math

    import pyarrow.compute as pc

    def grams(t: str) -> Counter:
        c = re.sub(r"[\x00-\x60\x7b-\x7f]+", " ", pc.utf8_lower(t).as_py())  # letter by letter
        out = Counter()
        for k in orders:
            for i in range(len(c) - k + 1):
                h = 0
                for x in c[i : i + k]:
                    h = (h * 0x9E3779B97F4A7C15 + ord(x) + 1) % (1 << 64)
                out[(h * 0xD6E8FEB86659FD93) % (1 << 64) >> 49] += 1
        return out

    labels = sorted({y for _, y in rows if y is not None})
    counts = {y: Counter() for y in labels}
    for t, y in {(t, y) for t, y in rows if t is not None and y is not None}:  # copies count once
        counts[y].update(grams(t))
    n = Counter(y for t, y in rows if t is not None and y is not None)
    size = {y: sum(counts[y].values()) + 0.1 * language.BUCKETS for y in labels}
    out = []
    for t in texts:
        if t is None or not any(c.isalpha() for c in t):
            out.append(("und", 0.0))
            continue
        logs = [math.log(n[y] / sum(n.values())) + sum(k * math.log((counts[y][g] + 0.1) / size[y]) for g, k in grams(t).items()) for y in labels]
        best = max(logs)
        out.append((labels[logs.index(best)], 1 / sum(math.exp(x - best) for x in logs)))
    return out


def test_op1_by_brute_force(spark, tmp_path):
    r = random.Random(3)
    words = {"aa": ["the", "cat", "sat", "on", "it"], "bb": ["der", "hund", "und", "die", "katze"], "cc": ["кот", "и", "пёс", "на"]}
    docs = [(i, " ".join(r.choice(words[y] + ["x", "42", "İ", "ß"]) for _ in range(r.randint(1, 12))) + r.choice(["", "!", " ..", "\n"]), r.choice([y, y, y, None]) if i % 7 else r.choice(["aa", "bb"])) for i, y in enumerate(r.choice(sorted(words)) for _ in range(90))]
    docs += [(900, None, "aa"), (901, "", "bb"), (902, "12 !", "cc"), (903, "½²", None), docs[4], docs[4], (904, docs[4][1], docs[4][2])]
    df = spark.createDataFrame([(*d, "own", "own", "own") for d in docs], "doc_id bigint, text string, lang string, lang_pred string, score string, held_out string")
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    import zlib

    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    want = bayes_brute([(t, y) for i, t, y in docs if not held(i)], [t for _, t, _ in docs])
    got = sorted(map(tuple, language.op1_language_id(spark, str(tmp_path)).select("doc_id", "held_out", "lang_pred", "score").collect()))
    for g, w in zip(got, sorted((i, held(i), *x) for (i, _, _), x in zip(docs, want, strict=True)), strict=True):
        assert g[:3] == w[:3] and g[3] == pytest.approx(w[3], abs=1e-4)


def test_many_labels_ties_and_long_texts(spark, monkeypatch):
    rows = [(i, chr(0x4E00 + i) * 5, f"l{i:03}") for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = language.fit(df, "text", "lang")
    assert len(model.labels) == 150
    long = "".join(chr(0x4E00 + 77) + "  1 " for _ in range(300_000))  # 2 MB, in parts
    some = spark.createDataFrame([(1, long), (2, chr(0x4E00 + 5)), (3, "q"), (3, "q")], "doc_id bigint, text string")
    got = {x["doc_id"]: x for x in language.predict(some, model).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["l077", "l005", "l000"]  # equally likely: the first
    assert language.predict(some.limit(0), model).count() == 0
    import pyarrow as pa

    r = random.Random(1)
    text = "".join(r.choice(["ab", "é", "  ", "1", "中", "\U0001f600", "z", "\n\n\n"]) for _ in range(4000))
    col = pa.array(["first", text, None, "last", ""])
    full = {a: sorted(x.ravel().tolist()) for a, b, o, x, _ in language._ngrams(pa.array([text]))}[0]
    for size in (7, 64, 1000):
        parts = [x.ravel() for a, b, o, x, _ in language._ngrams(col, size) if a == 1]
        assert len(parts) > 3 and Counter(np.concatenate(parts).tolist()) - Counter({language.BUCKETS: 10**6}) == Counter(full) - Counter({language.BUCKETS: 10**6})


# ---- near-duplicates
def fp_brute(t: str) -> int:
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    if not w:
        return 0
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def reach(ids: list, fps: list[int]) -> dict:
    a, par = np.array(fps, np.uint64), list(range(len(fps)))

    def root(x):
        while par[x] != x:
            x = par[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ a[i]) <= 3) + i + 1:
            p, q = root(i), root(int(j))
            par[max(p, q)] = min(p, q)
    groups: dict[int, list] = {}
    for i, x in enumerate(ids):
        groups.setdefault(root(i), []).append(x)
    return {x: min(g) for g in groups.values() for x in g}


def test_simhash(spark):
    docs = {r["doc_id"]: r["text"] for r in table(spark, DATA, "documents").collect()} | {9001: None, 9002: "", 9003: "One two", 9004: "ONE\ttwo", 9005: "É b\x1cc d"}
    df = spark.createDataFrame([(i, t, "x") for i, t in docs.items()], "doc_id bigint, text string, fp string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(df, "doc_id").collect()}
    fps = {i: fp_brute(t) for i, t in docs.items()}
    assert {i: r["fp"] % (1 << 64) for i, r in got.items()} == fps
    assert {i: r["component_id"] for i, r in got.items()} == reach(list(fps), list(fps.values()))
    assert simhash.near_duplicates(df.limit(0), "doc_id").count() == 0


def test_op2(spark, tmp_path):
    """The query's spelling of what the operator finds: hex digits, smallest ids, repeated and clashing rows."""
    docs = [(r["doc_id"], r["text"]) for r in table(spark, DATA, "documents").collect()] + [(9001, None), (9002, ""), (9003, "One two"), (9004, "ONE\ttwo"), (9003, "One two"), (9005, "w " * 60_000), (9006, "w " * 60_001)]
    spark.createDataFrame([(*d, 1, "own", "own") for d in docs], "doc_id bigint, text string, fp int, fingerprint string, component_id string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    fps = [fp_brute(t) for _, t in docs]
    low = reach(list(range(len(docs))), fps)
    groups: dict[int, list] = {}
    for k, (i, _) in enumerate(docs):
        groups.setdefault(low[k], []).append(i)
    want = sorted((i, f"{fp:016x}", min(groups[low[k]])) for k, ((i, _), fp) in enumerate(zip(docs, fps, strict=True)))
    assert sorted(map(tuple, simhash.op2_simhash_near_dedup(spark, str(tmp_path)).select("doc_id", "fingerprint", "component_id").collect())) == want
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert simhash.op2_simhash_near_dedup(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("spread", [16, 11])
def test_large_buckets(spread):
    """Buckets of one block's values, whole or with a flip behind it, against all pairs."""
    r = np.random.default_rng(spread)
    k = r.integers(0, 2**63, dtype=np.uint64) << np.uint64(16)
    for n, flips in ((300, 0), (1500, 6), (1500, 48)):
        low = r.integers(0, 1 << spread, n).astype(np.uint64)
        flip = r.integers(0, flips + 1, n)
        fps = np.unique(k ^ low ^ np.where(flip > 0, np.uint64(1) << (np.uint64(15) + flip.astype(np.uint64)), np.uint64(0)))
        small, large = simhash.stars(fps, most=10**9), simhash.bucket_stars(fps, 0, int(k))
        as_sets = lambda x: set(zip(*map(list, x), strict=True))
        assert as_sets(small) == as_sets(large)


def alike(a: str | None, b: str | None) -> float:
    x, y = ((t or "").lower().split() for t in (a, b))
    x, y = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (x, y))
    return len(x & y) / len(x | y)


def test_near_copies(spark):
    """No link below the similarity, all links at or above it, one group for each word sequence."""
    r = random.Random(17)
    vocab = [f"w{k}" for k in range(900)]
    base = [" ".join(r.choice(vocab) for _ in range(r.randint(60, 300))) for _ in range(60)]
    texts = list(base)
    for t in base[:40]:
        for p in (0.004, 0.01, 0.015, 0.03, 0.08):
            texts.append(" ".join(r.choice(vocab) if r.random() < p else w for w in t.split()))
    texts += [base[0].upper().replace(" ", "  "), base[1], "", None, "  ", "one two", "one two", "one three", "w1 w2 w3 w4 w5", "w1 w2 w3 w4 w6"] + ["same " * 50 + x for x in ("a", "b")]
    many = " ".join(r.choice(vocab) for _ in range(400))  # a large group of copies, more than are tried with each other
    texts += [" ".join(w if k != i else "changed" for k, w in enumerate(many.split())) for i in range(0, 400, 4)]
    rows = [(100 + i, t, "own") for i, t in enumerate(texts)] + [(100, texts[0], "own"), (None, "null key", "own"), (None, "null key too", "own"), (7, base[3], "own")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, digest string").repartition(3)
    got = simhash.near_copies(df, "doc_id").collect()
    assert len(got) == len(rows)
    group = {(x["doc_id"], x["digest"]): (x["low"], x["low_digest"]) for x in got}
    by_text = {}
    for i, t, _ in rows:
        key = " ".join((t or "").lower().split())
        by_text.setdefault(key, set()).add(group[i, hashlib.blake2b(key.encode(), digest_size=16).digest()])
    assert all(len(v) == 1 for v in by_text.values())  # one sequence, one group
    seqs = sorted(by_text)
    root = {k: next(iter(by_text[k])) for k in seqs}
    near = [(a, b) for i, a in enumerate(seqs) for b in seqs[:i] if alike(a, b) >= 0.8]
    par = {k: k for k in seqs}

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for a, b in near:
        par[find(a)] = find(b)
    for a in seqs:  # groups are parts of the true ones
        assert all(find(a) == find(b) for b in seqs if root[a] == root[b])
    assert all(root[a] == root[b] for a, b in near)
    assert sum(v == (7, hashlib.blake2b(base[3].lower().encode(), digest_size=16).digest()) for v in root.values()) >= 2  # the smallest id stands for them
    assert simhash.near_copies(df.limit(0), "doc_id").count() == 0


def test_recall_of_near_copies_by_band(spark):
    """Documents with one altered copy each, and groups of over 16 copies: all true pairs meet, in every band of similarity."""
    r = random.Random(3)
    docs = [x["text"] for x in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect() if x["text"] and 100 <= len(x["text"].split()) <= 400][:240]
    vocab = sorted({w for t in docs for w in t.split()})
    rates = (0.004, 0.008, 0.012, 0.016, 0.02)
    other = lambda t, p: " ".join(r.choice(vocab) if r.random() < p else w for w in t.split())
    texts = [x for t in docs for x in (t, other(t, r.choice(rates)))]
    for t in docs[:3]:  # large groups
        texts += [other(t, 0.01) for _ in range(30)]
    # one passage that all of a group share, among words of their own: no copies, but crowded shingles
    passage = " ".join(r.choice(vocab) for _ in range(60))
    texts += [passage + " " + " ".join(r.choice(vocab) for _ in range(60)) for _ in range(60)]
    texts += [other(t, 0.01) for t in texts[-60:][:20]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    low = {x["doc_id"]: x["low"] for x in simhash.near_copies(df, "doc_id").collect()}
    sets = []
    for t in texts:
        w = t.lower().split()
        sets.append(frozenset(hash(tuple(w[i : i + 5])) for i in range(max(1, len(w) - 4))))
    bands: dict[float, list[bool]] = {}
    reached = list(range(len(texts)))

    def find(i: int) -> int:
        while reached[i] != i:
            i = reached[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if min(a, b) < 0.8 * max(a, b) or (both := len(sets[i] & sets[j])) < 0.8 * (a + b - both):
                continue
            bands.setdefault(min(0.95, int(both / (a + b - both) * 20) / 20), []).append(low[i] == low[j])
            reached[find(i)] = find(j)
    assert set(bands) == {0.8, 0.85, 0.9, 0.95} and min(map(len, bands.values())) > 20
    assert all(np.mean(x) >= 0.99 for x in bands.values()), {k: np.mean(x) for k, x in bands.items()}
    assert all(find(i) == find(low[i]) for i in low)  # and no others


def test_crowds_of_many_groups(spark, monkeypatch):
    """One large group of texts of which most pairs are below the similarity: exact groups over many blocks, and no table of its pairs."""
    r = random.Random(23)
    vocab = [f"w{k}" for k in range(900)]
    base = [r.choice(vocab) for _ in range(150)]
    texts = [" ".join(base)]
    for i in range(260):
        words = list(base)
        for at in r.sample(range(len(base)), 2 + i % 8):
            words[at] = r.choice(vocab)
        texts.append(" ".join(words))
    texts += [" ".join(base[:110] + [r.choice(vocab) for _ in range(n)]) for n in (1, 5, 20, 38)]  # sizes that differ
    monkeypatch.setattr(simhash, "CROWD_BLOCK", 2048)
    rows, keep = {}, simhash.stored

    def counted(some, name):
        out = keep(some, name)
        rows.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", counted)
    got = {x["doc_id"]: x["low"] for x in simhash.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id").collect()}
    up = list(range(len(texts)))

    def find(i: int) -> int:
        return i if up[i] == i else find(up[i])

    near = [(i, j) for i in range(len(texts)) for j in range(i) if alike(texts[i], texts[j]) >= 0.8]
    for i, j in near:
        up[max(find(i), find(j))] = min(find(i), find(j))
    want = {i: find(i) for i in range(len(texts))}
    assert got == want and len(set(want.values())) > 20 and len(near) > 100 and max(rows["crowd-blocks"]) > 20
    last = list(rows).index("crowds-apart")
    pairs = len(texts) * (len(texts) - 1) // 2
    assert all(max(n) <= 3 * len(texts) for name, n in list(rows.items())[last + 1 :] if name != "crowd-edges") and max(rows["crowd-edges"]) < pairs / 4, rows


def test_sketch_buckets_split(spark, monkeypatch):
    """Small crowds give all pairs; texts that are mostly crowded go on to buckets of two shingles and more, and what stays crowded is handed
    on whole; texts that have only one crowded shingle do not meet in it."""
    monkeypatch.setattr(simhash, "CROWD", 3)
    sketches = [[1, 2, 3, 4]] * 5 + [[1, 10 + i, 20 + i, 30 + i] for i in range(6)] + [[7, 8, 100 + i // 2] for i in range(6)] + [[50], [50], [50], [51]]
    rows = [(bytes([i]), len(s), sorted(s), list(range(20))) for i, s in enumerate(sketches)]  # sketches that allow every pair
    rows[18] = (rows[18][0], 1, [50], [99])  # and one that allows none
    items = stored(spark.createDataFrame(rows, "digest binary, size bigint, sketch array<bigint>, low array<int>"), "items")
    pairs, crowds = simhash.sketch_buckets(items, stored)
    got = {frozenset((bytes(x["ra"])[0], bytes(x["rb"])[0])) for x in pairs.collect()}
    left: dict[int, set] = {}
    for x in crowds.collect():
        left.setdefault(x["k"], set()).add(bytes(x["digest"])[0])
    assert frozenset((17, 19)) in got and not any(18 in p for p in got) and {frozenset((11 + i, 12 + i)) for i in (0, 2, 4)} <= got
    assert not any(len(p & set(range(5, 11))) == 2 for p in got)  # they share one crowded shingle only
    assert set(map(frozenset, left.values())) == {frozenset(range(5))}


def test_simhash_links_all_distances(spark):
    r = np.random.default_rng(1)
    fps = []
    for x in r.integers(0, 2**63, 60, dtype=np.uint64):
        for d in range(7):
            y = int(x)
            for bit in r.choice(64, d, False):
                y ^= 1 << int(bit)
            fps.append(y)
    c = fps[0]
    fps = list(dict.fromkeys(fps + [c ^ sum(1 << int(b) for b in r.choice(12, r.integers(0, 5), False)) for _ in range(800)]))
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    got = {x["node"]: x["root"] for x in simhash.linked(stored(spark.createDataFrame([(sign(x),) for x in fps], "fp bigint"), "fps")).collect()}
    want = reach(fps, fps)
    assert all(got.get(sign(x), sign(x)) == sign(want[x]) for x in fps)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (501, 500), (7, 7)], "a bigint, b bigint")
    got = {r["node"]: r["root"] for r in components(e).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[501] == 500 and len(got) == 203


# ---- repeated strings
def test_suffix_array():
    r = random.Random(2)
    for _ in range(400):
        k = r.choice([1, 2, 3, 5, 200])
        t = [r.randint(1, k) for _ in range(r.randint(0, 40))]
        sa = suffix.suffix_array(np.array(t, np.int64), k)
        assert sa.tolist() == sorted(range(len(t)), key=lambda i: t[i:])
        if t:
            pre = suffix.permuted_prefixes(np.array(t), sa, 10**6)
            for a, b in zip(sa[1:], sa, strict=False):
                n = 0
                while max(a, b) + n < len(t) and t[a + n] == t[b + n]:
                    n += 1
                assert pre[a] == n


def removed(texts: list, n: int) -> list[tuple]:
    raw = [(t or "").encode() for t in texts]
    c = Counter(b[i : i + n] for b in raw for i in range(len(b) - n + 1))
    out = []
    for b in raw:
        m = np.zeros(len(b), bool)
        for i in range(len(b) - n + 1):
            if c[b[i : i + n]] > 1:
                m[i : i + n] = True
        out.append((len(b), int(m.sum()), int((m & ~np.append(False, m[:-1])).sum()) if len(b) else 0, np.frombuffer(b, np.uint8)[~m].tobytes()))
    return out


@pytest.mark.parametrize("how", [{"shard_bytes": 3000}, {"most_segments": 2}, {"most_segments": 9, "shard_bytes": 1}])
def test_repeats(spark, how):
    r = random.Random(5)
    word = lambda n: "".join(r.choice(["a", "b", "ab", "é", "中", "xyz "]) for _ in range(n))
    passages = [word(60) for _ in range(6)]
    ts = []
    for _ in range(200):
        t = word(r.randint(0, 40))
        for _ in range(r.randint(0, 3)):
            a = r.randint(0, 30)
            t += r.choice(passages)[a : a + r.randint(20, 60)] + word(r.randint(0, 20))
        ts.append(t)
    ts += [None, "", "a" * 500, "a" * 39, "ab" * 300, "ab" * 300, ts[3]]
    rows = [(i, t) for i, t in enumerate(ts)] + [(7, ts[7])]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kd", F.lit(1))
    want = removed([t for _, t in rows], 40)
    got = suffix.remove_repeats(df, "doc_id", length=40, gram=10, **how).collect()
    assert sorted((x["doc_id"], x["n_bytes"], x["n_removed"], x["n_spans"], bytes(x["kept"])) for x in got) == sorted((i, *w) for (i, _), w in zip(rows, want, strict=True))
    assert suffix.remove_repeats(df.limit(0), "doc_id").count() == 0


def test_sweeps_agree(monkeypatch):
    """Induction by buckets and by elements give one array, and reduced texts are sorted by recursion."""
    r = random.Random(8)
    deep = []
    inner = suffix.suffix_array
    monkeypatch.setattr(suffix, "suffix_array", lambda s, top: deep.append(len(s)) or inner(s, top))
    for _ in range(60):
        t = np.array([r.randint(1, 3) for _ in range(300)] * r.randint(1, 3), np.int64)
        got = []
        for sweep in (suffix._sweep, suffix._sweep_each):
            monkeypatch.setattr(suffix, "_sweep", sweep)
            got.append(inner(t, 3).tolist())
        monkeypatch.undo()
        monkeypatch.setattr(suffix, "suffix_array", lambda s, top: deep.append(len(s)) or inner(s, top))
        assert got[0] == got[1] == sorted(range(len(t)), key=lambda i: t[i:].tolist())
    assert len(deep) > 100


def test_windows_that_repeat():
    """Trimming by both sides of the anchor loses no window that repeats, and the arrays find all of them."""
    r = random.Random(6)
    for _ in range(80):
        n = 12
        core = "".join(r.choice("ab") for _ in range(4))
        segs = list({("".join(r.choice("ab") for _ in range(r.randint(4, 9))), "".join(r.choice("ab") for _ in range(r.randint(8, 10)))) for _ in range(r.randint(1, 30))})
        raw, rel = [(x + core + y).encode() for x, y in segs], np.array([len(x) for x, _ in segs])
        raw, rel = zip(*[(b, k) for b, k in zip(raw, rel, strict=True) if len(b) >= n], strict=True)
        first, end = suffix.trimmed(np.zeros(len(raw), int), np.array(rel), list(raw), n)
        seen = Counter((k - w, b[w : w + n]) for b, k in zip(raw, rel, strict=True) for w in range(min(k, len(b) - n) + 1))
        for b, k, lo, hi in zip(raw, rel, first.tolist(), end.tolist(), strict=True):
            again = [w for w in range(min(k, len(b) - n) + 1) if seen[k - w, b[w : w + n]] > 1]
            assert all(lo <= w < hi for w in again)
        got = suffix.repeated_windows(list(raw), n)
        all_ = Counter(b[w : w + n] for b in raw for w in range(len(b) - n + 1))
        assert [g.tolist() for g in got] == [[w for w in range(len(b) - n + 1) if all_[b[w : w + n]] > 1] for b in raw]
    assert suffix.repeated_windows([], 5) == []


def test_texts_over_chunks(spark):
    """Texts longer than the chunk in which anchors are found (2**17 bytes) and than a row group (2**20)."""
    r = random.Random(12)
    fill = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    p, q = fill(700), fill(400)
    edge = (1 << 17) - 350  # p lies over the chunk's end
    a = fill(edge) + p + fill(140_000) + q + fill(50)
    b = fill(1 << 20) + q + fill((1 << 17) - 900) + p + fill(70_000) + p
    rows = [(1, a), (2, b), (3, fill(90) + p), (4, fill(300))]
    df = spark.createDataFrame([(*x, 1, 2, 3, "k") for x in rows], "doc_id bigint, text string, n_bytes int, n_removed int, n_spans int, kept string")
    raw = {i: t.encode() for i, t in rows}
    count = Counter(x[w : w + 200] for x in raw.values() for w in range(len(x) - 199))
    for got in suffix.remove_repeats(df, "doc_id").collect():
        x = raw[got["doc_id"]]
        gone = np.zeros(len(x) + 1, int)
        for w in range(len(x) - 199):
            if count[x[w : w + 200]] > 1:
                gone[w] += 1
                gone[w + 200] -= 1
        gone = np.cumsum(gone)[:-1] > 0
        assert got["n_removed"] == gone.sum() and bytes(got["kept"]) == np.frombuffer(x, np.uint8)[~gone].tobytes()
        assert got["n_bytes"] == len(x) and got["n_spans"] == {1: 2, 2: 3, 3: 1, 4: 0}[got["doc_id"]]


def test_op3_on_documents(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").collect()
    want = {d["doc_id"]: w for d, w in zip(docs, removed([d["text"] for d in docs], 200), strict=True)}
    for r in suffix.op3_suffix_array_dedup(spark, DATA).collect():
        w = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (*w[:3], hashlib.sha256(w[3]).hexdigest())


# ---- personal data
RE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def spans_brute(t: str) -> list[tuple]:
    def ok(k, m):
        d = re.sub("[^0-9]", "", m)
        if k == "ip":
            return all(int(x) <= 255 for x in m.split("."))
        if k == "card":
            twice = [int(c) if i % 2 == 0 else 2 * int(c) - 9 * (int(c) > 4) for i, c in enumerate(d[::-1])]
            return 12 <= len(d) <= 19 and sum(twice) % 10 == 0
        return k != "phone" or 9 <= len(d) <= 15

    return sorted((m.start(), n, m.end(), k) for n, (k, p) in enumerate(RE.items()) for m in re.finditer(p, t or "") if ok(k, m[0]))


def test_base_spans(spark):
    r = random.Random(4)
    parts = ["a", "b.", "@", "x@y.com", ".", "1", "22", "255.", "300.", "4111 1111 1111 1111", "+49 (30) 1234567", "-", " ", "é", "😀", "%", "_", "\n", "12.3.4.5", "5500-0000-0000-0004", "00000001"]
    ts = ["".join(r.choice(parts) for _ in range(r.randint(0, 25))) for _ in range(800)] + [None, "", "1" * 20000, "a." * 20000, "a@" * 5000, "1 " * 5000, "1." * 5000, "+1" * 5000, "+" + "1(" * 9000]
    df = spark.createDataFrame(list(enumerate(ts)), "doc_id bigint, text string")
    for x in pii.find_spans(df, "doc_id").collect():
        assert [(b["start"], b["rank"], b["end"], b["kind"]) for b in x["base"]] == spans_brute(ts[x["doc_id"]])


def test_disclosing_terms(spark):
    rows = [(i, f"filler words here number{i} {['alpha', 'beta', 'gamma'][i % 3]}xx common") for i in range(60)]
    rows += [(100 + i, f"unique{chr(97 + i)} Professor Quillfeather wrote from bob@x.org about common matters {chr(97 + i) * 5}") for i in range(4)] + [(200, "Quillfeather alone common"), (300, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("spans", F.lit(3))
    got = {r["doc_id"]: r["text"] for r in pii.sanitise(df, "doc_id", least_texts=3).collect()}
    assert got[100] == "uniquea [TERM] [TERM] [TERM] [TERM] [EMAIL] [TERM] common [TERM] aaaaa"
    assert got[0] == rows[0][1] and got[200] == rows[64][1] and got[300] is None
    assert pii.sanitise(df.limit(0), "doc_id").count() == 0


def test_terms_of_one_mention(spark, tmp_path):
    """op4 and the pipeline judge entities that stand in a single text."""
    import corpus_pipeline

    rows = [(i, f"filler words here common number{i}") for i in range(60)] + [(100, "common Quillfeather wrote from bob@x.org here")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["spans"] for r in pii.op4_pii(spark, str(tmp_path)).collect()}
    assert got[100] == "term:7:19,term:20:25,term:26:30,email:31:40" and not any(got[i] for i in range(60))
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.personal_data(spark, df, str(tmp_path)).collect()}
    assert clean[100] == "common [TERM] [TERM] [TERM] [EMAIL] here" and clean[7] == rows[7][1]


def test_texts_with_very_many_mentions(spark):
    """Time grows with the length of a text, not with its mentions times its terms; spans and cleaned text are as they should be."""
    import time

    took = []
    for n in (2_000, 20_000):
        text = " ".join(f"user{i}@example{i % 97}.org word{i} common" for i in range(n))
        df = spark.createDataFrame([(1, text)] + [(i, "some common text here") for i in range(2, 30)], "doc_id bigint, text string")
        began = time.perf_counter()
        got = {r["doc_id"]: r["spans"] for r in pii.find_spans(df, "doc_id").collect()}
        took.append(time.perf_counter() - began)
        want = [(m.start(), m.end(), "email" if "@" in m[0] else "term") for m in re.finditer(r"\S+@\S+|word\d+", text)]
        assert [(s["start"], s["end"], s["kind"]) for s in got[1]] == want and not any(got[i] for i in range(2, 30))
        clean = {r["doc_id"]: r["text"] for r in pii.sanitise(df, "doc_id").collect()}
        assert clean[1] == " ".join(["[EMAIL] [TERM] common"] * n) and clean[2] == "some common text here"
    assert took[1] < 3 * took[0] + 10, took


def test_cleaned_by_brute_force(spark):
    """Overlapping spans, spans over the chunks' borders, wide characters."""
    r = random.Random(2)
    rows, want = [], []
    for i in range(120):
        t = "".join(r.choice("ab é😀\n") for _ in range(r.choice([0, 5, 200, 20_000])))
        spans = sorted({(a := r.randrange(len(t) + 1), min(len(t), a + r.choice([1, 3, 40, 9000])), r.choice(["email", "term"])) for _ in range(r.choice([0, 1, 30, 300]))} if t else set())
        spans = [s for s in spans if s[0] < s[1]]
        rows.append((i, t, spans))
        out, at = [], 0
        for a, b, k in spans:
            if a >= at:
                out += [t[at:a], f"[{k.upper()}]"]
            at = max(at, b)
        want.append("".join(out) + t[at:])
    df = spark.createDataFrame(rows, "i int, text string, spans array<struct<start:int,end:int,kind:string>>")
    got = {x["i"]: x["c"] for x in df.select("i", pii.cleaned(F.col("text"), F.col("spans")).alias("c")).collect()}
    assert [got[i] for i in range(len(rows))] == want


def test_terms_of_whole_documents(spark):
    """Short names and numbers, far from the entity and wherever they stand: by brute force."""
    r = random.Random(9)
    common = ["here", "we", "go", "7", "on"]
    fill = lambda n: " ".join(r.choice(common) for _ in range(n))
    rows = [(i, fill(30)) for i in range(60)] + [(100, f"Li {fill(300)} li@x.org {fill(300)} case4711 Bob's LI 4711 e\u0301t\u00e9 {fill(700)} Bob"), (101, f"{fill(5)} 10.0.0.7 Bob \U0001f600 Zo\u00eb")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {x["doc_id"]: {(s["start"], s["end"]) for s in x["spans"] if s["kind"] == pii.TERM} for x in pii.find_spans(df, "doc_id", least_texts=1).collect()}
    holds = Counter(w for _, t in rows for w in {m[0].lower() for m in re.finditer(r"[\w\u0301]+", t)})
    for i, t in rows:
        base = spans_brute(t)
        free = [m for m in re.finditer(r"[\w\u0301]+", t) if all(m.end() <= b[0] or m.start() >= b[2] for b in base)]
        told = {(m.start(), m.end()) for m in free if base and np.log(len(rows) / holds[m[0].lower()]) / np.log(len(rows)) >= pii.THRESHOLD - 1e-12}
        assert got[i] == told, i
    assert len(got[100]) == 6 and len(got[101]) == 1 and not any(got[i] for i in range(60))  # bob is in two of 62 texts


def test_op4_by_brute_force(spark, tmp_path):
    """All spans of the query from patterns and disclosure in plain Python; repeated rows count as documents in every total."""
    import math

    r = random.Random(21)
    common = [f"w{k}" for k in range(25)]
    names = ["Quill", "Li", "Ödön", "4711", "Bob"]
    mail = ["a@x.org", "b.c@y.co.uk", "10.0.0.7", "+49 30 1234567", "4111 1111 1111 1111"]
    docs = [(i, " ".join(r.choice(common) for _ in range(r.randint(3, 30))) + (f" {names[k := r.randrange(5)]} {mail[k]} {names[k if r.random() < 0.9 else 0]}," if r.random() < 0.3 else "")) for i in range(120)]
    docs += [(500, None), (501, ""), docs[3], docs[3], *[d for d in docs if "Quill" in d[1]][:2], (502, "Only here: zed@q.net " + "long " * 6000 + "Zed")]
    spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id bigint, text string, spans string, base int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    base = [spans_brute(t) for _, t in docs]
    entities = [{f"{k}:{(t or '')[s:e].lower()}" for s, _, e, k in b} for (_, t), b in zip(docs, base, strict=True)]
    words = [[(m.start(), m.end(), m[0].lower()) for m in re.finditer(r"\w+", t or "")] for _, t in docs]
    free = [[w for w in ws if all(w[1] <= b[0] or w[0] >= b[2] for b in bs)] for ws, bs in zip(words, base, strict=True)]
    n, n_t, n_e, n_et = len(docs), Counter(), Counter(), Counter()
    for ws, fs, es in zip(words, free, entities, strict=True):
        n_t.update({w[2] for w in ws})
        n_e.update(es)
        n_et.update({(e, w[2]) for e in es for w in fs})
    for (i, t), bs, fs, es in zip(docs, base, free, entities, strict=True):
        told = {w[2] for w in fs for e in es if n_e[e] < n and math.log(n_et[e, w[2]] * n / (n_e[e] * n_t[w[2]])) / math.log(n / n_e[e]) >= pii.THRESHOLD - 1e-12}
        bs.extend((s, 4, e, "term") for s, e, w in fs if w in told)
    want = []
    for (i, t), bs in zip(docs, base, strict=True):
        say = lambda x: ",".join(f"{k}:{s}:{e}" for s, _, e, k in sorted(x))
        own = [b for b in bs if b[3] != "term"]
        want.append((i, *(sum(b[3] == k for b in own) for k in pii.KINDS), hashlib.sha256(say(own).encode()).hexdigest(), say(bs)))
    got = pii.op4_pii(spark, str(tmp_path)).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")
    assert dict(got.dtypes)["n_email"] == "bigint" and sorted(map(tuple, got.collect())) == sorted(want)
    assert sum("term" in w[-1] for w in want) > 10
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert pii.op4_pii(spark, f"{tmp_path}/none").count() == 0


def test_op3_query_edges(spark, tmp_path):
    p = "A passage of more than two hundred bytes that stands in several texts, é and all. " * 4
    docs = [(1, None), (2, ""), (3, "x" + p + "y"), (4, p), (4, p), (5, "z" * 250), (6, "short")]
    spark.createDataFrame([(*d, "own", 1) for d in docs], "doc_id bigint, text string, kept string, n_removed int").write.parquet(f"{tmp_path}/documents.parquet")
    want = sorted((i, *w[:3], hashlib.sha256(w[3]).hexdigest()) for (i, _), w in zip(docs, removed([t for _, t in docs], 200), strict=True))
    assert sorted(map(tuple, suffix.op3_suffix_array_dedup(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())) == want
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert suffix.op3_suffix_array_dedup(spark, f"{tmp_path}/none").count() == 0
