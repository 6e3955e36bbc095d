"""Ed25519 against published vectors and another implementation; calibration against numpy; storage, periodic jobs."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from assaywright.functions import ed25519
from assaywright.operators import compliance, ensemble, hashing, signals
from assaywright.sources import readers
from assaywright.streaming import flows

#: The first three vectors of RFC 8032, section 7.1 (seed, public key, message, signature).
VECTORS = [
    ("9d61b19deffd5a60ba844af492ec2cc44449c5697b326919703bac031cae7f60", "d75a980182b10ab7d54bfed3c964073a0ee172f3daa62325af021a68f707511a", "", "e5564300c360ac729086e2cc806e828a84877f1eb8e5d974d873e065224901555fb8821590a33bacc61e39701cf9b46bd25bf5f0595bbe24655141438e7a100b"),
    ("4ccd089b28ff96da9db6c346ec114e0f5b8a319f35aba624da8cf6ed4fb8a6fb", "3d4017c3e843895a92b70aa74d1b7ebc9c982ccf2ec4968cc0cd55f12af4660c", "72", "92a009a9f0d4cab8720e820b5f642540a2b27b5416503f8fb3762223ebdb69da085ac1e43e15996e458f3613d0f11d8c387b2eaeb4302aeeb00d291612bb0c00"),
    ("c5aa8df43f9f837bedb7442f31dcb7b166d38535076f094b85ce3a2e0b4458f7", "fc51cd8e6218a1a38da47ed00230f0580816ed13ba3303ac5deb911548908025", "af82", "6291d657deec24024827e69c3abe01a30ce548a284743a445e3680d7db5ac3ac18ff9b538d16f290ae67f760984dc6594a7c15e9716ed28dc027beceea1ec40a"),
]


@pytest.mark.parametrize("vector", VECTORS)
def test_published_vectors(vector):
    seed, public, message, signature = map(bytes.fromhex, vector)
    assert ed25519.public_key(seed) == public and ed25519.sign(seed, message) == signature and ed25519.verify(public, message, signature)


def test_keys_that_come_often_take_no_doublings(monkeypatch):
    seed, steps = b"t" * 32, []
    public = ed25519.public_key(seed)
    signed = [(m, ed25519.sign(seed, m)) for m in (bytes([i]) * 64 for i in range(60))]
    monkeypatch.setattr(ed25519, "add", lambda a, b, plain=ed25519.add: steps.append(1) or plain(a, b))
    for turn in range(2):  # by steps and by the table
        for m, s in signed:
            assert ed25519.verify(public, m, s) and not ed25519.verify(public, m + b"x", s) and not ed25519.verify(public, m, s[:32] + bytes([s[32] ^ 1]) + s[33:])
        for first in (b"\x01" + bytes(31), bytes(32), b"\xed" + b"\xff" * 30 + b"\x7f", b"\x01" + bytes(30) + b"\x80", b"\xff" * 32):
            assert not ed25519.verify(public, signed[0][0], first + signed[0][1][32:])
        if not turn:
            steps.clear()
    assert not steps and ed25519.sign(seed, b"m") == ed25519.sign(seed, b"m") and not steps


def test_signatures_of_another_implementation(spark):
    """Java's signatures are valid here, ours there, and changed ones nowhere."""
    j = spark.sparkContext._jvm
    r = random.Random(4)
    seed = r.randbytes(32)
    public = ed25519.public_key(seed)
    keys = j.java.security.KeyFactory.getInstance("Ed25519")
    private = keys.generatePrivate(j.java.security.spec.PKCS8EncodedKeySpec(bytearray.fromhex("302e020100300506032b657004220420") + seed))
    theirs_public = keys.generatePublic(j.java.security.spec.X509EncodedKeySpec(bytearray.fromhex("302a300506032b6570032100") + public))
    for n in (0, 1, 31, 200):
        message = r.randbytes(n)
        signer = j.java.security.Signature.getInstance("Ed25519")
        signer.initSign(private)
        signer.update(bytearray(message))
        theirs = bytes(signer.sign())
        assert theirs == ed25519.sign(seed, message) and ed25519.verify(public, message, theirs)
        checker = j.java.security.Signature.getInstance("Ed25519")
        checker.initVerify(theirs_public)
        checker.update(bytearray(message))
        assert checker.verify(bytearray(ed25519.sign(seed, message)))
        for k in range(0, 64, 7):
            bad = bytearray(theirs)
            bad[k] ^= 1 << r.randrange(8)
            assert not ed25519.verify(public, message, bytes(bad))
        assert not ed25519.verify(public, message + b"x", theirs)
    high = (int.from_bytes(theirs[32:], "little") + ed25519.ORDER).to_bytes(32, "little")
    assert not ed25519.verify(public, message, theirs[:32] + high)
    assert not ed25519.verify(public, message, b"") and not ed25519.verify(b"x", message, theirs) and not ed25519.verify(b"\xff" * 32, message, theirs)


def test_rows_without_keys(spark):
    df = spark.createDataFrame([(1, "k1"), (2, "none"), (3, None)], "scan_id int, key_id string")
    seeds = {"k1": b"s" * 32}
    signed = compliance.sign_ed25519(df.withColumn("content_hash", F.sha2(F.col("scan_id").cast("string"), 512)), seeds)
    got = compliance.check_ed25519(signed, {"k1": ed25519.public_key(b"s" * 32)}).orderBy("scan_id").collect()
    assert [r["signature_valid"] for r in got] == [True, False, False] and got[1]["signature"] is None


def test_platt(spark):
    r = np.random.default_rng(2)
    s = r.normal(size=600)
    y = (r.random(600) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    a, b = ensemble.platt_fit(spark.createDataFrame([(float(x), int(k)) for x, k in zip(s, y, strict=True)] + [(None, 1)], "s double, y int"), "s", "y")
    n1, n0 = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    p = 1 / (1 + np.exp(-(a * s + b)))
    assert abs((p - t).sum()) < 1e-6 and abs(((p - t) * s).sum()) < 1e-6 and 1 < a < 3  # where the likelihood is greatest
    with pytest.raises(ValueError):
        ensemble.platt_fit(spark.createDataFrame([(1.0, 1)], "s double, y int"), "s", "y")


@pytest.mark.parametrize("threshold", [0, 2, 3, 5, 6, 8, 11])
def test_bands_lose_no_match(spark, threshold):
    r = np.random.default_rng(threshold)
    q = r.integers(-(2**63), 2**63, 40)
    refs = [int(x) ^ sum((1 << int(b)) - (1 << 64 if b == 63 else 0) for b in r.choice(64, int(r.integers(0, threshold + 3)), False)) for x in q for _ in range(8)]
    refs = [x - (1 << 64) if x >= 1 << 63 else x + (1 << 64) if x < -(1 << 63) else x for x in refs]
    a = spark.createDataFrame([(i, int(x)) for i, x in enumerate(q)], "k int, h bigint")
    b = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(refs)], "ref_id string, ref_h bigint")
    got = [{(x["k"], x["ref_id"], x["distance"]) for x in hashing.matches(a, b, threshold, m).collect()} for m in ("banded", "broadcast")]
    assert got[0] == got[1] == {(i, f"r{j}", d) for i, x in enumerate(q) for j, y in enumerate(refs) if (d := ((int(x) ^ y) % (1 << 64)).bit_count()) <= threshold}


def test_a_large_tenant_is_spread_and_sorted(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(20_000).select((F.when(F.col("id") % 10 < 9, 1).otherwise(F.col("id") % 50)).alias("tenant_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 7919 % 40_000).cast("int"))).alias("ts"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # the table is small here
    try:
        readers.write_by_month(df, f"{tmp_path}/t")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    files = list((tmp_path / "t" / "month=202401").glob("*.parquet"))
    assert len(files) >= 3  # one tenant has nine tenths of the rows
    for f in files:
        t = pq.read_table(f).to_pylist()
        keys = [(r["tenant_id"], r["ts"]) for r in t]
        assert keys == sorted(keys)


def test_a_periodic_job(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    seen: list[int] = []
    q = flows.run_every(spark.readStream.schema("id bigint").parquet(f"{tmp_path}/in"), lambda b, n: seen.append(b.count()), f"{tmp_path}/cp", "1 second")
    try:
        for k in (5, 7):
            end = time.time() + 60
            while sum(seen) < k and time.time() < end:
                time.sleep(0.2)
            assert sum(seen) == k
            if k == 5:
                spark.range(2).write.mode("append").parquet(f"{tmp_path}/in")
    finally:
        q.stop()


def test_filters_of_many_tracks_are_those_of_one():
    r = np.random.default_rng(3)
    b, a = signals.butter_band(4, 0.05, 0.27)
    x = r.normal(size=(5, 200))
    assert np.allclose(signals.zero_phase(b, a, x), [signals.zero_phase(b, a, one) for one in x])


def test_canonical_text_is_sorted_at_every_depth(spark):
    a = spark.sql("SELECT 1 AS i, named_struct('b', 1, 'a', named_struct('z', CAST(NULL AS INT), 'y', array(named_struct('q', 1, 'p', 2)))) AS s, map('k2', 1, 'k1', 2) AS m")
    b = spark.sql("SELECT map('k1', 2, 'k2', 1) AS m, named_struct('a', named_struct('y', array(named_struct('p', 2, 'q', 1)), 'z', CAST(NULL AS INT)), 'b', 1) AS s, 1 AS i")
    text = [x.select(compliance.canonical(x, ["s", "m", "i"]).alias("t")).first()["t"] for x in (a, b)]
    assert text[0] == text[1] == '{"i":1,"m":[{"key":"k1","value":2},{"key":"k2","value":1}],"s":{"a":{"y":[{"p":2,"q":1}],"z":null},"b":1}}'
    gone = spark.sql("SELECT 1 AS i, CAST(NULL AS STRING) AS s")
    assert gone.select(compliance.canonical(gone, ["i", "s"]).alias("t")).first()["t"] == '{"i":1,"s":null}'


def test_batches_are_signed_as_one(spark):
    rows = [(i % 3, i, f"v{i}") for i in range(600)] + [(0, 5, "v5")] * 2
    df = spark.createDataFrame(rows, "b int, i int, v string")
    seeds = {"k": b"s" * 32}
    roots = compliance.sign_ed25519(compliance.batch_roots(compliance.sign(df, ["i", "v"], "k"), ["b"]).withColumn("key_id", F.lit("k")), seeds)
    check = lambda now: {r["b"]: (r["rows"], r["batch_valid"]) for r in compliance.check_batches(compliance.sign(now, ["i", "v"], ""), roots, ["b"], {"k": ed25519.public_key(seeds["k"])}).collect()}
    assert check(df.repartition(7)) == {0: (202, True), 1: (200, True), 2: (200, True)}
    changed = df.withColumn("v", F.when(F.col("i") == 7, "other").otherwise(F.col("v")))
    assert check(changed) == {0: (202, True), 1: (200, False), 2: (200, True)}
    assert check(df.filter("i <> 2")) == {0: (202, True), 1: (200, True), 2: (199, False)}
    assert check(df.dropDuplicates()) == {0: (201, False), 1: (200, True), 2: (200, True)}
    assert check(df.filter("b = 1")) == {0: (0, False), 1: (200, True), 2: (0, False)}
    swapped = df.withColumn("b", F.when(F.col("i") == 1, 2).when(F.col("i") == 2, 1).otherwise(F.col("b")))
    assert not check(swapped)[1][1] and not check(swapped)[2][1]


def test_spectra_of_many_tracks_are_those_of_one():
    r = np.random.default_rng(5)
    boxes = r.normal(size=(4, 90, 4)).cumsum(axis=1)
    boxes[2] = 7.0
    for many, one in ((signals.flickers(boxes, 30.0), [signals.flicker(b, 30.0) for b in boxes]), (signals.pulses(g := np.vstack([r.normal(size=(3, 200)), np.ones((1, 200))]), 30.0), [signals.pulse(x, 30.0) for x in g])):
        for k, x in enumerate(one):
            assert all(np.isnan(m[k]) if v is None else m[k] == pytest.approx(v) for m, v in zip(many, x, strict=True))


def test_rows_are_signed_and_checked_together(spark, monkeypatch):
    """Batches take no steps of single rows and say what single rows say, of changed and malformed signatures, too."""
    from assaywright.functions import ed25519_rows as many

    r = random.Random(6)
    seeds = {"a": b"a" * 32, "b": b"b" * 32, "few": b"f" * 32}
    keys = [("few" if i % 100 == 0 else "b" if i % 3 else "a") for i in range(1500)]
    messages = [r.randbytes(i % 70) for i in range(1500)]
    one_by_one = [ed25519.sign(seeds[k], m) for k, m in zip(keys, messages, strict=True)]
    public = {k: ed25519.public_key(v) for k, v in seeds.items()}
    changed = [s if i % 2 else s[: i % 64] + bytes([s[i % 64] ^ 1 << r.randrange(8)]) + s[i % 64 + 1 :] for i, s in enumerate(one_by_one)]
    for i, first in enumerate((b"\x01" + bytes(31), bytes(32), b"\xed" + b"\xff" * 30 + b"\x7f", b"\x01" + bytes(30) + b"\x80", b"\xff" * 32)):
        changed[10 * i] = first + one_by_one[10 * i][32:]
    changed[4], changed[6], changed[8] = b"", one_by_one[6][:63], one_by_one[8][:32] + (int.from_bytes(one_by_one[8][32:], "little") + ed25519.ORDER).to_bytes(32, "little")
    said = [ed25519.verify(public[k], m, s) for k, m, s in zip(keys, messages, changed, strict=True)]
    assert said == [a == b for a, b in zip(one_by_one, changed, strict=True)] and 700 < sum(said) < 800
    args = [public[k] for k in keys], messages
    assert many.verify(*args, changed) == said and many.verify([b"\xff" * 32] * 300, messages[:300], one_by_one[:300]) == [False] * 300

    def never(*_):
        raise AssertionError("a row by itself")

    monkeypatch.setattr(ed25519, "_from_table", never)
    monkeypatch.setattr(ed25519, "times", never)
    assert many.sign([seeds[k] for k in keys], messages) == one_by_one
    monkeypatch.undo()
    df = spark.createDataFrame([(i, k if i % 7 else None, m.hex() if i % 11 else None, s if i % 13 else None) for i, (k, m, s) in enumerate(zip(keys, messages, changed, strict=True))], "i int, key_id string, content_hash string, signature binary").coalesce(1)
    valid = {x["i"]: x["signature_valid"] for x in compliance.check_ed25519(df, public).collect()}
    assert valid == {i: bool(i % 7 and i % 11 and i % 13 and v) for i, v in enumerate(said)}
    signed = {x["i"]: x["signature"] for x in compliance.sign_ed25519(df.drop("signature"), seeds).collect()}
    assert all((signed[i] is None) if not (i % 7 and i % 11) else bytes(signed[i]) == s for i, s in enumerate(one_by_one))


def test_limbs_are_exact():
    from assaywright.functions import ed25519_rows as many

    p, r = ed25519.P, random.Random(7)
    values = [0, 1, 2, 18, 19, p - 1, p, p + 1, p + 18, p // 2, *(1 << e for e in many.EDGES[:12]), *(p - (1 << e) for e in many.EDGES[:12]), *(r.randrange(p) for _ in range(2000))]
    a, b = many._limbs(values), many._limbs(values[::-1])
    ints = lambda x: many._ints(x)
    assert ints(a) == [v % p for v in values] and ints(0 - a) == [-v % p for v in values]
    assert ints(many._mul(a + b, a - b)) == [(v + w) * (v - w) % p for v, w in zip(values, values[::-1], strict=True)]
    # the largest limbs that a product leaves, as sums of two, in all signs
    edge = many._UNIT * np.array([2.0 ** (w - 1) for w in many._WIDTH])[:, None] * 65 / 64
    edge = np.hstack([edge, -edge, edge * np.array([[1], [-1]] * 6), *(edge * np.array([[r.choice((1, -1))] for _ in range(12)]) for _ in range(50))])
    exact = lambda x: [sum(int(v) for v in col) for col in x.T]
    for c in (edge, edge[:, ::-1]):
        got = many._mul(2 * edge, 2 * c)
        assert ints(got) == [4 * v * w % p for v, w in zip(exact(edge), exact(c), strict=True)]
        assert (abs(got) <= abs(edge[:, :1])).all()
    x = many._limbs([v for v in values if v % p])
    assert ints(many._inverses(x)) == [pow(v, -1, p) for v in values if v % p]
