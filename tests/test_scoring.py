"""Scenarios of scoring, policy and the first layer, and properties of the formulas."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from assaywright.operators import hashing, ingest, l1, policy, scoring
from assaywright.schemas import L1, L2, L3, CONTEXT, METADATA

SCAN = f"scan_id bigint, tenant_id int, l1 struct<{L1.simpleString()[7:-1]}>, l2 struct<{L2.simpleString()[7:-1]}>, l3 struct<{L3.simpleString()[7:-1]}>, ctx struct<{CONTEXT.simpleString()[7:-1]}>"
CLEAN1, CLEAN2 = (False, None, 0.1, 0.05, True, [], 1), (0.1, 0.05, 0.9, 0.1, 0.05, 0.1, 1, 10)
CLEAN3, NO = (0.1, 0.1, 0.1, 0.1, 0.1, 0.1, 0.9, 10), (False, 0.0, False)
BAD1, BAD2 = (True, "df-1", 0.9, 0.85, False, ["DeepFaceLab"], 1), (0.9, 0.95, 0.1, 0.9, 0.85, 0.9, 1, 10)
BAD3, ALL = (0.95, 0.9, 0.9, 0.9, 0.9, 0.95, 0.95, 10), (True, 0.9, True)


def score(spark, *rows):
    df = spark.createDataFrame([(i, 1, *r) for i, r in enumerate(rows)], SCAN)
    return {r["scan_id"]: r for r in scoring.risk_score(df).collect()}


def test_layers_and_context(spark):
    got = score(spark, (CLEAN1, CLEAN2, CLEAN3, NO), (BAD1, BAD2, BAD3, ALL), (CLEAN1, None, (0.1, 0.1, 0.1, 0.1, 0.1, 0.48, 0.9, 1), NO), (CLEAN1, None, (0.1, 0.1, 0.1, 0.1, 0.1, 0.48, 0.9, 1), ALL), (None, None, CLEAN3, NO), (None, None, None, NO))
    assert got[0]["verdict"] == "ALLOW" and got[0]["risk_score"] < 0.3 and not got[0]["reason_codes"]
    assert got[1]["verdict"] == "BLOCK" and got[1]["reason_codes"][0]["code"] == "L1_HASH_MATCH"
    assert got[3]["risk_score"] > got[2]["risk_score"] and got[3]["context_multiplier"] > 1
    assert 0 <= got[4]["risk_score"] <= 1 and got[4]["base_score"] == pytest.approx(0.1)
    assert got[5]["risk_score"] == 0 and got[5]["verdict"] == "ALLOW"


def test_no_faces_dilute(spark):
    got = score(spark, (CLEAN1, None, None, NO), (CLEAN1, (0.9, 0.9, 0.9, 0.9, 0.9, 0.9, 0, 1), None, NO))
    assert got[1]["l2_score"] == 0 and got[1]["base_score"] < got[0]["base_score"]


@pytest.mark.parametrize(("s", "want"), [(0.0, "ALLOW"), (0.2999, "ALLOW"), (0.3, "FLAG"), (0.6, "FLAG_URGENT"), (0.8499, "FLAG_URGENT"), (0.85, "BLOCK"), (1.0, "BLOCK")])
def test_bands(spark, s, want):
    assert spark.range(1).select(scoring.verdict(F.lit(s)).alias("v")).first()["v"] == want


def applied(spark, score, codes, mult=1.0, rules=(), th=(0.3, 0.6, 0.85), auto=True):
    df = spark.createDataFrame([(1, 1, score, mult, [(c, "L3_NEURAL", "", 1.0) for c in codes], *th, auto)], "scan_id int, tenant_id int, risk_score double, context_multiplier double, reason_codes array<struct<code:string,category:string,explanation:string,confidence:double>>, allow_max double, flag_max double, flag_urgent_max double, auto_block_known_hash boolean")
    return policy.apply_policy(df, [policy.RuleSet(1, tuple(rules))]).first()


def test_policies(spark):
    r = applied(spark, 0.2, [])
    assert (r["verdict"], r["override_rule_id"]) == ("ALLOW", None)
    assert applied(spark, 0.25, [], th=(0.2, 0.5, 0.75))["verdict"] == "FLAG"
    r = applied(spark, 0.4, ["L3_GAN_DETECTION"], rules=[policy.Rule("ESCALATE_GAN", policy.ReasonCodePresent(("L3_GAN_DETECTION",)), "FLAG_URGENT", "P", "e")])
    assert (r["verdict"], r["override_rule_id"], r["reason_codes"][-1]["code"]) == ("FLAG_URGENT", "ESCALATE_GAN", "P")
    r = applied(spark, 0.35, ["L1_HASH_MATCH"])
    assert (r["verdict"], r["reason_codes"][-1]["code"]) == ("BLOCK", "POLICY_AUTO_BLOCK_HASH")
    assert applied(spark, 0.35, ["L1_HASH_MATCH"], auto=False)["verdict"] == "FLAG"
    r = applied(spark, 0.7, ["CTX_PUBLIC_FIGURE"], 1.45, [policy.Rule("B", policy.AllOf((policy.ScoreAbove(0.6), policy.ReasonCodePresent(("CTX_PUBLIC_FIGURE",)))), "BLOCK", "P", "e")])
    assert (r["verdict"], r["override_rule_id"]) == ("BLOCK", "B")


def test_lookup_defaults(spark):
    scans = spark.createDataFrame([(1, 9)], "scan_id int, tenant_id int")
    none = spark.createDataFrame([], "tenant_id int, allow_max double, flag_max double, flag_urgent_max double, auto_block_known_hash boolean")
    assert policy.lookup(scans, none).first()["allow_max"] == 0.3


def scan(spark, **md):
    row = {"codec": "h264", "container": "mp4", "encoder": None, "exif_tags": [], "bitrate_kbps": None, "fps": 30.0, "duration_secs": 10.0, "width": 1920, "height": 1080, "gop_sizes": [], "c2pa_valid": None} | md
    df = spark.createDataFrame([(tuple(row[f] for f in METADATA.fieldNames()),)], f"md struct<{METADATA.simpleString()[7:-1]}>")
    return l1.compression_scan(l1.metadata_scan(df)).first()


def test_metadata(spark):
    r = scan(spark)
    assert r["metadata_score"] == pytest.approx(0.15) and not r["detected_tools"]
    assert scan(spark, encoder="Lavf58.29.100 DeepFaceLab")["detected_tools"] == ["DeepFaceLab"]
    r = scan(spark, exif_tags=[("Software", "faceswap v2.1")])
    assert r["metadata_score"] >= 0.7 and r["detected_tools"] == ["FaceSwap"]
    assert scan(spark, encoder="ffmpeg", c2pa_valid=True)["metadata_score"] < 0.05
    assert scan(spark, encoder="droop")["detected_tools"] == ["Roop"]


def test_compression(spark):
    assert scan(spark, gop_sizes=[30] * 5, bitrate_kbps=5000.0)["compression_score"] < 0.1
    assert scan(spark, gop_sizes=[5, 60, 10, 90, 3, 120])["compression_score"] > 0.1


@pytest.mark.parametrize(("m", "c", "dist", "want"), [(0.0, 0.0, None, "ALLOW"), (0.0, 0.0, 0, "BLOCK"), (0.0, 0.0, 4, "ESCALATE"), (0.8, 0.0, None, "ESCALATE"), (0.39, 0.3, None, "ESCALATE")])
def test_decision(spark, m, c, dist, want):
    df = spark.createDataFrame([(m, c, dist)], "metadata_score double, compression_score double, match_distance int")
    assert l1.decide(df).first()["decision"] == want


def test_hashes(spark):
    h = spark.range(1).select(hashing.hamming(F.lit(0).cast("bigint"), F.lit(-1).cast("bigint")).alias("a"), hashing.hamming(F.lit(5), F.lit(4)).alias("b"), hashing.ahash(F.array(*[F.lit(0)] * 63, F.lit(255))).alias("c")).first()
    assert (h["a"], h["b"], h["c"]) == (64, 1, -(1 << 63))


def test_phash_is_the_cosine_transform():
    import numpy as np

    g = np.random.default_rng(1).integers(0, 256, (32, 32)).astype(float)
    low = []
    for v in range(8):
        for u in range(8):
            if u or v:
                a = np.cos((2 * np.arange(32) + 1) * u * np.pi / 64)
                b = np.cos((2 * np.arange(32) + 1) * v * np.pi / 64)
                low.append((g * b[:, None] * a[None, :]).sum() * np.sqrt((1 if u == 0 else 2) / 32) * np.sqrt((1 if v == 0 else 2) / 32))
    want = sum(1 << i for i, x in enumerate(low) if x > sorted(low)[31])
    assert hashing.phash_of(g) == want


def test_banded_equals_nested(spark):
    import random

    r = random.Random(3)
    sign = lambda x: x - (1 << 64) if x >> 63 else x
    base = [r.getrandbits(64) for _ in range(60)]
    q = spark.createDataFrame([(i, sign(b)) for i, b in enumerate(base)], "vec_id bigint, h bigint")
    refs = []
    for i, b in enumerate(base):
        for k in range(r.randint(0, 9)):
            b ^= 1 << r.randrange(64)
        refs.append((str(i), sign(b)))
    refs = spark.createDataFrame(refs, "ref_id string, ref_h bigint")
    for t in (3, 5, 8):
        a, b = (sorted(map(tuple, hashing.matches(q, refs, t, m).select("vec_id", "ref_id", "distance").collect())) for m in ("banded", "broadcast"))
        assert a == b and a


def test_chunks(spark):
    df = spark.createDataFrame([("u", 1, 2, "b"), ("u", 0, 2, "a"), ("u", 0, 2, "a"), ("v", 0, 3, "x")], "upload_id string, chunk_index int, total_chunks int, data string")
    got = {r["upload_id"]: r["content"] for r in ingest.assemble_chunks(df).collect()}
    assert got == {"u": "ab", "v": None}


def test_family_matches_by_blocks(spark, monkeypatch):
    """All matches, and the best ones, of hashes that very many rows share; no join on hashes, whose groups grow with the square of the rows."""
    monkeypatch.setattr(hashing, "BLOCK", 16)
    hot = [-1 << 40, 7, -(1 << 63)]
    h = lambda i, k: None if (i + k) % 11 == 0 else hot[k] ^ ((1 << i % 9) - 1) if i % 3 else (i * 0x9E3779B97F4A7C15 + k) % (1 << 64) - (1 << 63)
    frames = [(i // 2, i, *(h(i, k) for k in range(3))) for i in range(90)]
    refs = [(f"r{i}", *(h(i + 1, k) for k in range(3))) for i in range(50)]
    q = spark.createDataFrame(frames, "video_id bigint, frame bigint, ahash bigint, dhash bigint, phash bigint")
    r = spark.createDataFrame(refs, "ref_id string, ahash bigint, dhash bigint, phash bigint")
    want = set()
    for v, f, *mine in frames:
        for ref, *theirs in refs:
            for k, (name, most) in enumerate(hashing.FAMILIES.items()):
                if mine[k] is not None and theirs[k] is not None and (d := ((mine[k] ^ theirs[k]) % (1 << 64)).bit_count()) <= most:
                    want.add((v, f, k, name, ref, d))
    got = hashing.family_matches(q, r, ["video_id", "frame"])
    rows = [tuple(x) for x in got.collect()]
    assert len(want) > 500 and len(rows) == len(want) and set(rows) == want
    first = {}
    for v, f, k, _, ref, d in want:
        first[v] = min(first.get(v, (99,)), (d, f, k, ref))
    few = hashing.family_matches(q, r, ["video_id", "frame"], best=True)
    assert {x["video_id"]: tuple(x)[1:] for x in hashing.best_match(few, "video_id").collect()} == first and few.count() <= 90 * 4
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "HashJoin" not in plan
    assert hashing.family_matches(q.limit(0), r, ["frame"]).count() == 0
