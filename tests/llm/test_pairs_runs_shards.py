"""Alignment of two tokenizers, periodic runs and sharding against brute force."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from assaywright.llm import align, periodic, queries, sharding
from assaywright.llm._bytelevel import byte_symbols
from assaywright.llm.tokens import vocabulary_path

DATA = "/root/testdata/sf0.001"


# ---- alignment
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(vocabulary_path())
    a.encode_special_tokens = True
    a.no_padding()
    a.no_truncation()
    return a, sentencepiece.SentencePieceProcessor(model_file=vocabulary_path(align.PIECES))


def aligned_brute(texts: list[str | None]) -> list[tuple]:
    """What op11 returns for each text, from the libraries, token by token."""
    a, b = libraries()
    back = {c: k for k, c in enumerate(byte_symbols())}
    of_a = {i: bytes(back[c] for c in w) if all(c in back for c in w) else w.encode() for w, i in a.get_vocab().items()}
    of_b = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    found = []
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        raw = (" " + (t or "")).encode()
        if not t or b"".join(of_a[i] for i in x) != raw or b"".join(of_b(i) for i in y) != raw:
            found.append(None)
            continue
        ends = {e: k for k, e in enumerate(np.cumsum([len(of_a[i]) for i in x]).tolist())}
        said, links, la, lb = [], [], 0, 0
        for k, e in enumerate(np.cumsum([len(of_b(i)) for i in y]).tolist()):
            if e in ends:
                said.append(",".join(map(str, x[la : ends[e] + 1])) + "|" + ",".join(map(str, y[lb : k + 1])))
                links.append((x[ends[e]], y[k]))
                la, lb = ends[e] + 1, k + 1
        found.append((len(x), len(y), links, ";".join(said)))
    count = Counter(p for f in found if f for p in f[2])
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    return [(0, 0, 0, 0, 0, 0, "") if f is None else (f[0], f[1], len(f[2]), len(f[2]), sum(count[p] == top[p[1]] for p in f[2]), sum(count[p] for p in f[2]), hashlib.sha256(f[3].encode()).hexdigest()) for f in found]


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def odd_texts() -> list[str | None]:
    rnd = random.Random(5)
    some = ["a", "ab ", " ", "  ", "é", "ü ü", "\n", "\t", "x\n  y", "naïve café", "▁", "<s>", "<unk>", "<0x0A>", "<|endoftext|>", "日本語 の 文", "👍🏽 ok", "it's", "1234", "don't stop", " ", "word", "Hello", ".", "!?", "\x00", "\x1c z", "ﬁ"]
    out: list[str | None] = [None, "", *some]
    for _ in range(400):
        out.append("".join(rnd.choice(some) + rnd.choice(["", " ", " ", "  "]) for _ in range(rnd.randint(1, 12))))
    return [*out, "the cat " * 3000, "x" * 9000, *out[30:40]]


def test_alignment_by_the_libraries(spark):
    texts = odd_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3).withColumns({"n_a": F.lit("own"), "links": F.lit(0)})
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in align.alignment(df).collect()}
    assert [got[i] for i in range(len(texts))] == aligned_brute(texts)


def test_op11_on_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").collect()
    df = align.op11_cross_tokenizer_alignment(spark, DATA)
    assert df.columns == ["doc_id", *COLUMNS]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in df.collect()}
    assert [got[r["doc_id"]] for r in docs] == aligned_brute([r["text"] for r in docs])


def test_parts_are_whole_texts(spark):
    """A model whose vocabulary allows no cuts takes texts whole and gives the same."""
    df = spark.createDataFrame([("the cat sat on  the mat.",), (None,)], "text string")
    whole = align._pieces(open(vocabulary_path(align.PIECES), "rb").read())
    assert whole.cuts
    got = align.aligned(df, spell=True).collect()
    m = align._plain(open(vocabulary_path(), "rb").read(), align.codec_parts(spark, vocabulary_path())[1].value)
    one = align.Pieces(open(vocabulary_path(align.PIECES), "rb").read())
    one.cuts = False
    (n_a, n_b, links, said), none = align.Aligner(m, one)([df.collect()[0]["text"], None])
    assert none is None and (got[0]["n_a"], got[0]["n_b"], got[0]["links"], got[0]["groups"]) == (n_a, n_b, links.tolist(), said)


def test_partial_counts_in_bounded_memory(spark, monkeypatch):
    monkeypatch.setattr(align, "MOST_PAIRS", 10)
    monkeypatch.setattr(align, "SHARD_ROWS", 20)
    rnd = np.random.default_rng(1)
    rows = [([int(x) << 32 | int(y) for x, y in zip(rnd.integers(0, 9, 40), rnd.integers(0, 9, 40), strict=True)],) for _ in range(60)] + [([],), ([7 << 32] * 5000,)]
    df = spark.createDataFrame(rows, "links array<bigint>")
    partial = align.stored(align.partial_counts(df), "partial")
    shards, root = align.count_shards(partial, 9)
    count = Counter(x for r in rows for x in r[0])
    keys = np.array(sorted(count))
    assert len(shards.lines) > 1 and shards.get(keys).tolist() == [count[k] for k in keys.tolist()]
    assert shards.get(np.array([-5, 10 << 32])).tolist() == [0, 0]
    assert shards.top.tolist() == [max([n for k, n in count.items() if k >> 32 == b], default=0) for b in range(9)]
    align.remove(spark, root)


def test_alignment_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    assert align.alignment(df).collect() == []


# ---- periodic runs
def runs_brute(words: list, least: int = periodic.LEAST, times: int = periodic.TIMES) -> list[tuple]:
    def smallest(w: list) -> int:
        border, k = [0] * len(w), 0
        for i in range(1, len(w)):
            while k and w[i] != w[k]:
                k = border[k - 1]
            k += w[i] == w[k]
            border[i] = k
        return len(w) - border[-1]

    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q) and smallest(words[i : j + q]) == q:
                out.append((i, j - i + q, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def odd_words(rnd: random.Random) -> list[int]:
    n, k, out = rnd.randint(0, 220), rnd.choice([1, 2, 3, 5, 40]), []
    while len(out) < n:
        if rnd.random() < 0.5:
            out += [rnd.randrange(k) for _ in range(rnd.randint(1, 10))]
        else:
            unit = [rnd.randrange(k) for _ in range(rnd.randint(1, 25))]
            out += (unit * 9)[: rnd.randint(len(unit), 9 * len(unit))]
    return out[:n]


def test_runs():
    rnd = random.Random(3)
    for _ in range(1500):
        words = odd_words(rnd)
        numbers: dict[int, int] = {}
        ids = np.array([numbers.setdefault(w, len(numbers)) for w in words], np.int64)
        runs = periodic.find_runs(ids)
        assert runs == runs_brute(words)
        drop = {i for s, size, q in runs for i in range(s + q, s + size)}
        assert np.flatnonzero(~periodic.collapsed(len(words), runs)).tolist() == sorted(drop)


@pytest.mark.parametrize("least", [1e9, 2.0])
def test_lag_counts(monkeypatch, least):
    monkeypatch.setattr(periodic, "heavy_from", lambda n: least)  # all words light, or all that repeat heavy
    rnd = random.Random(4)
    for _ in range(300):
        words = odd_words(rnd) or [0]
        ids = np.unique(words, return_inverse=True)[1]
        assert periodic.lag_counts(ids, len(ids) // 3).tolist() == [0, *(sum(x == y for x, y in zip(words, words[q:], strict=False)) for q in range(1, len(ids) // 3 + 1))]


def test_hashes_that_lie(monkeypatch):
    """Runs are right even if all hashes are equal."""
    monkeypatch.setattr(periodic._Hashes, "__call__", lambda self, start, stop: np.zeros(np.broadcast(start, stop).shape))
    rnd = random.Random(6)
    for _ in range(200):
        words = odd_words(rnd)
        assert periodic.find_runs(np.unique(words, return_inverse=True)[1] if words else np.zeros(0, np.int64)) == runs_brute(words)


def test_long_texts_take_little_time():
    import time

    began = time.perf_counter()
    n = 200_000
    assert periodic.find_runs(np.zeros(n, np.int64)) == [(0, n, 1)]
    assert periodic.find_runs(np.tile(np.arange(50_000), 4)) == [(0, n, 50_000)]
    periodic.find_runs(np.random.default_rng(0).integers(0, 2, n))
    assert time.perf_counter() - began < 60


def run_digests(key: object, text: str | None) -> tuple:
    words = (text or "").encode().split()
    if key is not None and words and (h := zlib.crc32(str(key).encode())) % 10 == 0:
        g, n = h // 10, len(words)
        a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = runs_brute(words)
    best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
    drop = {i for s, size, q in runs for i in range(s + q, s + size)}
    said = "".join(f"{s},{size},{q}\n" for s, size, q in runs)
    return (len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], hashlib.sha256(said.encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in drop)).hexdigest())


def test_op12_edges(spark, tmp_path):
    rnd = random.Random(8)
    texts = [None, "", "  \t\n", "a", "a " * 30, "a b c " * 9, "x y " * 24, "é ü\n" * 40, *(" ".join(map(str, odd_words(rnd))) for _ in range(80))]
    rows = [(i if i % 7 else None, t, "own", 5) for i, t in enumerate(texts)] + [(4, texts[4], "own", 5)] * 3
    path = str(tmp_path)
    spark.createDataFrame(rows, "doc_id bigint, text string, runs string, start int").write.parquet(f"{path}/documents.parquet")
    cols = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    df = periodic.op12_periodic_runs(spark, path)
    assert df.columns == cols
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(((k, *run_digests(k, t)) for k, t, _, _ in rows), key=repr)
    whole = periodic.periodic_runs(spark.read.parquet(f"{path}/documents.parquet")).filter("n_runs > 0").first()
    assert whole["runs"][0]["period"] >= 1 and len(whole["collapsed"]) < len(whole["text"])
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert periodic.periodic_runs(none).collect() == []


def test_op12_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = periodic.op12_periodic_runs(spark, DATA)
    rel = con.sql(queries.ORACLE["op12_periodic_runs"])
    assert rel.columns == df.columns and sorted(rel.fetchall(), key=repr) == sorted(map(tuple, df.collect()), key=repr)


# ---- sharding
def sharded(df, **how):
    return sharding.assign(df, "doc_id", **how).toPandas()


def laws(t, texts: dict, shards: int = sharding.SHARDS, tolerance: float = 0.001) -> None:
    by = t.groupby("shard")
    assert set(t["shard"]) <= set(range(shards)) and set(t["law"]) == {"bytes"} and t["grown_shard"].isna().all()
    for _, g in by:
        assert sorted(g["slot"]) == list(range(len(g)))
    for r in t.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
    size, fair = by["size"].sum().reindex(range(shards), fill_value=0), t["size"].sum() / shards
    assert size.max() - size.min() <= max(2 * tolerance * fair, 2 * t["size"].min() + 2)


def test_sharding_keeps_groups_and_balances(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("red green blue one two three".split()) for _ in range(int(rnd.paretovariate(1.1)) % 400)) + f" n{i}" for i in range(3000)]
    texts += [texts[5]] * 40 + [None, ""] * 20
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    t = sharded(df)
    laws(t, dict(enumerate(texts)))
    t["text"] = [texts[i] or "" for i in t["doc_id"]]
    assert (t.groupby("text")["shard"].nunique() == 1).all()
    for c in ("tokens", "size"):
        total = t.groupby("shard")[c].sum()
        assert total.max() < 1.1 * total.mean()
    rows = t.groupby("shard").size()
    assert rows.max() < 1.6 * rows.mean()  # bytes come first, and groups stay together


def test_a_group_over_a_fair_share_is_cut(spark):
    rows = [(i, "the same text over and over") for i in range(700)] + [(1000 + i, f"text {i}") for i in range(900)] + [(5000, "the same text over and over")] * 3
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({"shard": F.lit("own"), "size": F.lit("own"), "_at": F.lit(0)})
    t = sharded(df)
    laws(t, dict(rows), tolerance=0.04)
    whole = t[t["doc_id"] < 1000]["shard"].nunique()
    assert whole == -(-703 * 28 * 16 // int(t["size"].sum()))  # in no more shards than it takes


def test_bundles_are_few(spark, monkeypatch):
    """Small groups are placed in bundles; the driver gets no more lines than there are bundles and heavy groups."""
    monkeypatch.setattr(sharding, "HEAVY", 4)
    monkeypatch.setattr(sharding, "BUNDLES", 64)
    placed = []
    monkeypatch.setattr(sharding, "place", lambda items, shards, f=sharding.place: placed.append(len(items)) or f(items, shards))
    rows = [(i, f"text number {i}") for i in range(2000)]
    t = sharded(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert placed[0] <= 64 + 12
    laws(t, dict(rows), tolerance=0.15)


def test_place():
    rng = np.random.default_rng(0)
    items = rng.pareto(3, (500, 3)) + 1  # none larger than a shard
    where = sharding.place(items, 16)
    load = np.array([items[where == k].sum(axis=0) for k in range(16)])
    assert (load[:, 0].max() - load[:, 0].min()) < 1.2  # the smallest items are 1
    assert sharding.place(np.zeros((0, 3))).tolist() == [] and len(sharding.place(np.zeros((5, 3)))) == 5


def test_op13_of_an_empty_table_and_null_keys(spark, tmp_path):
    assert sharded(spark.createDataFrame([], "doc_id bigint, text string")).empty
    t = sharded(spark.createDataFrame([(None, "a")] * 40 + [(None, None)] * 7, "doc_id bigint, text string"))
    assert len(t) == 47 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in t.groupby("shard"))
    df = sharding.op13_sharding(spark, DATA)
    assert df.columns[:7] == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and dict(df.dtypes)["slot"] == "bigint" and dict(df.dtypes)["shard"] == "int"
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    laws(df.toPandas(), docs, tolerance=0.005)  # 200 texts
