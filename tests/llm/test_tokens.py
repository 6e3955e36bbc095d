"""Counts, ids, decoding and packing against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache

import numpy as np
import pytest

from assaywright.llm import packing, tokens
from assaywright.llm._bytelevel import ByteLevelBPE, batches, class_table

PARTS = ["a", "b", "'s", "'t", "'re", "'ll", "'", "' ", " ", "  ", "\n", "\t", " ", "　", "1", "²", "é", "ß", "中", "!", "<|endoftext|>", "<|endo", "x" * 60, "aaaa", "́", "😀", "don't", "\x1c", "\u0085", "\x00"]


@cache
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.vocabulary_path())


def texts(n: int = 1500) -> list[str]:
    r = random.Random(1)
    out = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 30))) for _ in range(n)]
    points = [chr(c) for c in (r.choice([r.randrange(0x110000), r.randrange(0x3000), r.randrange(0x300)]) for _ in range(9000)) if not 0xD800 <= c < 0xE000]
    return out + ["".join(points[i : i + 12]) for i in range(0, len(points), 12)] + ["", "a" * 5000, "ab" * 3000, " " * 500, "word " * 3000]


@pytest.mark.parametrize("cuts", [True, False])
def test_ids_equal_the_library(cuts):
    path = tokens.vocabulary_path()
    with open(path, "rb") as f:
        m = ByteLevelBPE(f.read(), class_table(path), cuts)
    raw = [t.encode() for t in texts()]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got: dict[int, list[int]] = {}
    for part, o, a, b in batches(data, offs, 4000):
        ids, cut = m.encode(part, o)
        for i in range(b - a):
            got.setdefault(a + i, []).extend(ids[cut[i] : cut[i + 1]].tolist())
    want = [e.ids for e in library().encode_batch(texts(), add_special_tokens=False)]
    assert [got.get(i, []) for i in range(len(want))] == want


def codec(cuts: bool) -> ByteLevelBPE:
    path = tokens.vocabulary_path()
    with open(path, "rb") as f:
        return ByteLevelBPE(f.read(), class_table(path), cuts)


def ids_of(m: ByteLevelBPE, some: list[str], most: int = 1 << 18) -> list[list[int]]:
    raw = [t.encode() for t in some]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    got: list[list[int]] = [[] for _ in some]
    for part, o, a, b in batches(data, offs, most):
        ids, cut = m.encode(part, o)
        for i in range(b - a):
            got[a + i].extend(ids[cut[i] : cut[i + 1]].tolist())
    return got


def thue_morse(n: int = 10) -> tuple[str, str]:
    """Two words of 2**n letters that every polynomial modulo 2**64 gives one hash."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


@pytest.mark.parametrize("cuts", [True, False])
@pytest.mark.parametrize("lead", ["", "prefix", "x y "])
def test_pieces_of_one_hash(cuts, lead):
    from assaywright.llm._bytelevel import span_hashes

    a, b = thue_morse()
    raw = np.frombuffer((a + b).encode(), np.uint8)
    h = span_hashes(raw, np.array([0, 1024]), np.array([1024, 2048]))
    assert h[0] == h[1]
    some = [lead + a, lead + b, lead + a, f"{b} {a}", lead + thue_morse(11)[1], lead + thue_morse(11)[0]]
    want = [e.ids for e in library().encode_batch(some, add_special_tokens=False)]
    m = codec(cuts)
    assert ids_of(m, some) == want and ids_of(m, some[::-1]) == want[::-1]


def test_a_full_table_keeps_whole_tokens(monkeypatch):
    from assaywright.llm import _bytelevel

    monkeypatch.setattr(_bytelevel, "MOST_PIECES", 50)
    words = tokens.whole_tokens(tokens.vocabulary_path())
    m = codec(False)
    m.enter(words)
    at = m._known(*(x := (np.frombuffer(b"".join(words), np.uint8), np.cumsum([0, *map(len, words[:-1])]), np.cumsum(list(map(len, words))))))
    some = texts(400)
    want = [e.ids for e in library().encode_batch(some, add_special_tokens=False)]
    forgot = []
    monkeypatch.setattr(m, "_forget", lambda f=m._forget: forgot.append(m.index.n) or f())
    assert ids_of(m, some, 2000) == want
    assert len(forgot) > 5 and m.stay == len(words)
    before = m.index.n
    assert (m._known(*x) == at).all() and m.index.n == before  # nothing had to be merged again


def test_long_texts_are_cut_where_it_is_safe():
    r = random.Random(3)
    parts = ["word", " ", "\n", "\t", "a1", "2.5", "'s", "don't", "(x)", "<|endoftext|>", '"', "  ", "é", "end.", "!", "\r\n", "'", "　"]
    some = ["".join(r.choice(parts) for _ in range(3000)) for _ in range(4)] + ["x" * 9000, "one,two;three" * 500]
    want = [e.ids for e in library().encode_batch(some, add_special_tokens=False)]
    for most in (64, 500, 4000):
        assert ids_of(codec(True), some, most) == want


def test_whole_tokens_are_single():
    words = tokens.whole_tokens(tokens.vocabulary_path())
    assert len(words) > 49_000
    some = [w.decode() for w in words[:: len(words) // 200] if b"\xef\xbf\xbd" not in w and not any(b >= 0x80 for b in w)]
    assert all(len(library().encode(w, add_special_tokens=False).ids) == 1 for w in some)


def frame(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts(300))] + [(9001, None, "x"), (9001, None, "x")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens string").repartition(4), dict((i, t or "") for i, t, _ in rows)


def test_counts(spark):
    df, by_id = frame(spark)
    rows = tokens.count_tokens(df, limit=20).collect()
    assert len(rows) == len(by_id) + 1
    for r in rows:
        n = len(library().encode(by_id[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(by_id[r["doc_id"]].encode()), n, n > 20)
    assert tokens.count_tokens(df.limit(0)).count() == 0


def test_round_trip(spark):
    df, by_id = frame(spark)
    for r in tokens.encode_decode(df).collect():
        ids = library().encode(by_id[r["doc_id"]], add_special_tokens=False).ids
        assert r["token_ids"] == ids and r["decoded"] == library().decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()


@pytest.mark.parametrize(("counts", "bins"), [({1024: 3}, 3), ({512: 4}, 2), ({600: 2, 424: 2}, 2), ({1: 1024}, 1), ({700: 1, 300: 1, 24: 1, 600: 1, 400: 1}, 2), ({}, 0)])
def test_plan_is_tight(counts, bins):
    plan = packing.plan_bins(counts)
    assert sum(t for t, _ in plan) == bins
    used: dict[int, int] = {}
    for times, combo in plan:
        assert sum(n * k for n, k in combo) <= 1024
        for n, k in combo:
            used[n] = used.get(n, 0) + n // n * k * times
    assert used == counts


def test_fullest_is_exact():
    import itertools

    r = random.Random(5)
    for _ in range(60):
        items = [r.randint(1, 30) for _ in range(r.randint(1, 9))]
        counts = {n: items.count(n) for n in items}
        combo = packing.fullest(counts, 40)
        seed, rest = max(items), sorted(items)[:-1]
        best = max(seed + sum(c) for k in range(len(rest) + 1) for c in itertools.combinations(rest, k) if seed + sum(c) <= 40)
        assert sum(n * k for n, k in combo) == best and all(k <= counts[n] for n, k in combo)


def test_packing(spark):
    df, by_id = frame(spark)
    pieces = packing.stored(packing.token_pieces(df, "doc_id"), "test-pieces")
    rows = packing.pack(pieces, "doc_id").collect()
    place: dict[int, list] = {}
    total: dict[int, int] = {}
    for r in rows:
        ids = library().encode(by_id[r["doc_id"]], add_special_tokens=False).ids + [2]
        part = ids[r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 1024 or r["piece"] == 0
        place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        total[r["doc_id"]] = total.get(r["doc_id"], 0) + r["length"]
    for spans in place.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 1024
    assert len(place) <= -(-sum(r["length"] for r in rows) // 1024) + 1
    assert packing.pack(packing.stored(packing.token_pieces(df.limit(0), "doc_id"), "none"), "doc_id").count() == 0


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from assaywright.llm._common import shared_dir

    def session(master: str, found: str | None):
        kept = []
        sc = SimpleNamespace(master=master, getCheckpointDir=lambda: found, setCheckpointDir=kept.append)
        return SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: d)), kept

    for master in ("spark://host:7077", "yarn", "k8s://x", "local-cluster[3,2,1024]"):
        with pytest.raises(RuntimeError):
            shared_dir(session(master, None)[0])
        assert shared_dir(session(master, "hdfs://x/cp")[0]) == "hdfs://x/cp"
    one, kept = session("local[4]", None)
    assert shared_dir(one).startswith("file://") and len(kept) == 1


# ---- the registered queries
def corpus(spark, tmp_path):
    """A documents table with hard rows and a clash of every column that a query adds."""
    a, b = thue_morse()
    rows = list(enumerate([*texts(120), a, b, "p " + a, "p " + b, None, "", "Same row", "word " * 2500]))
    rows += [rows[-2], rows[-2], (500, None)]
    clash = "n_bytes", "n_tokens", "over_limit", "ids_sha256", "decoded_sha256", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    df = spark.createDataFrame([(*r, *["own"] * len(clash)) for r in rows], "doc_id bigint, text string, " + ", ".join(f"`{c}` string" for c in clash))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    return rows


def ids_by_library(t: str | None) -> list[int]:
    return library().encode(t or "", add_special_tokens=False).ids


def test_op6(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    got = tokens.op6_token_counts(spark, str(tmp_path)).select("doc_id", "n_bytes", "n_tokens", "over_limit")
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_bytes": "bigint", "n_tokens": "bigint", "over_limit": "boolean"}
    assert sorted(map(tuple, got.collect())) == sorted((i, len((t or "").encode()), n := len(ids_by_library(t)), n > 512) for i, t in rows)


def test_op9(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = [(i, len(x), sha(np.array(x, "<u4").tobytes()), sha(library().decode(x, skip_special_tokens=False).encode())) for i, t in rows for x in [ids_by_library(t)]]
    got = tokens.op9_bpe_round_trip(spark, str(tmp_path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_op5(spark, tmp_path):
    rows = corpus(spark, tmp_path)
    want = []
    for i, t in rows:
        x = [*ids_by_library(t), 2]
        edges = [0, *range(len(x) % 1024 or 1024, len(x) + 1, 1024)]
        want += [(i, p, s, e - s, zlib.crc32(np.array(x[s:e], "<u4").tobytes())) for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False))]
    got = [tuple(r) for r in packing.op5_best_fit_packing(spark, str(tmp_path)).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset").collect()]
    assert sorted(r[:5] for r in got) == sorted(want)
    filled: dict[int, list] = {}
    for r in got:
        filled.setdefault(r[5], []).append((r[6], r[3]))
    for spans in filled.values():
        spans.sort()
        assert all(o == sum(n for _, n in spans[:k]) for k, (o, _) in enumerate(spans)) and sum(n for _, n in spans) <= 1024
    assert len(filled) <= -(-sum(r[3] for r in got) // 1024) + 1


def test_queries_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for fn in (packing.op5_best_fit_packing, tokens.op6_token_counts, tokens.op9_bpe_round_trip):
        assert fn(spark, str(tmp_path)).count() == 0
