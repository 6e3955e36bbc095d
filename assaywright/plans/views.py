"""Domain tables as projections of the test tables, in Spark and, for the oracle, in SQL. Both are deterministic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import MODELS

TOOLS = ("photoshop", "gimp", "final cut", "capcut")
ENCODERS = ("Lavf58.29.100", "DeepFaceLab 2.0", "faceswap-gan v1", "HandBrake 1.3", "x264", "ffmpeg 4.2", "Adobe Premiere", "droop")
SIZES = ((1920, 1080), (1080, 1920), (640, 480), (1000, 700), (512, 512))
REGIONS = ("eu-west-1", "us-east-1", "eu-central-1", "ap-south-1")
AS_OF = "2024-01-30 00:00:00"


def as_of() -> Column:
    return F.lit(AS_OF).cast("timestamp")


def _s(prime: int, key: str = "event_id") -> Column:
    return (F.col(key) * prime % 1000) / F.lit(1000.0)


def _s_sql(prime: int, key: str = "event_id") -> str:
    return f"(({key} * {prime} % 1000) / 1000e0)"


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def scan_facts(spark: SparkSession, d: str) -> DataFrame:
    e = t(spark, d, "events").select("event_id", "ts", "user_id", "event_type", "value")
    k = F.col("event_id")
    two, three = F.col("event_type").isin("click", "purchase", "error"), F.col("event_type").isin("purchase", "error")
    i = lambda n: (k % n).cast("int")
    l1 = F.struct(
        (k % 97 == 0).alias("hash_match_found"), F.when(k % 97 == 0, F.concat(F.lit("ref-"), (k % 13).cast("string"))).alias("hash_match_id"), _s(7919).alias("metadata_anomaly_score"), _s(6971).alias("compression_anomaly_score"),
        F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("c2pa_chain_valid"), F.slice(F.array(*map(F.lit, TOOLS)), F.lit(1), i(5)).alias("detected_editing_tools"),
    )
    l2 = F.when(two, F.struct(_s(4001).alias("micro_flicker_score"), _s(5003).alias("rppg_absence_score"), _s(5011).alias("rppg_signal_quality"), _s(6007).alias("eye_movement_anomaly_score"), _s(7001).alias("skin_texture_anomaly_score"), _s(8009).alias("facial_symmetry_score"), i(4).alias("faces_analyzed")))
    scores = [_s(p).alias(f"{m}_score") for m, p in zip(MODELS, (3001, 3011, 3019, 3023, 3037), strict=True)]
    l3 = F.when(three, F.struct(*scores, _s(9001).alias("ensemble_score"), _s(9007).alias("model_agreement_ratio")))
    ctx = F.struct((k % 11 == 0).alias("public_figure_detected"), _s(2003).alias("political_content_score"), (k % 17 == 0).alias("account_trust_anomaly"))
    region = F.get(F.array(*map(F.lit, REGIONS)), i(4))
    return e.select(k.alias("scan_id"), (F.col("user_id") % 25).cast("int").alias("tenant_id"), "ts", F.col("value").alias("duration_ms"), "event_type", region.alias("region"), l1.alias("l1"), l2.alias("l2"), l3.alias("l3"), ctx.alias("ctx"))


SCAN_FACTS = f"""scan_facts AS (
  SELECT event_id AS scan_id, CAST(user_id % 25 AS INTEGER) AS tenant_id, ts, value AS duration_ms, event_type,
    CASE event_id % 4 WHEN 0 THEN '{REGIONS[0]}' WHEN 1 THEN '{REGIONS[1]}' WHEN 2 THEN '{REGIONS[2]}' ELSE '{REGIONS[3]}' END AS region,
    event_id % 97 = 0 AS hash_match, CASE WHEN event_id % 97 = 0 THEN 'ref-' || (event_id % 13) END AS hash_match_id,
    {_s_sql(7919)} AS metadata, {_s_sql(6971)} AS compression, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS c2pa, CAST(event_id % 5 AS INTEGER) AS n_tools,
    array_to_string(list_slice({list(TOOLS)!r}, 1, event_id % 5), ', ') AS tools,
    event_type IN ('click', 'purchase', 'error') AS has_l2, event_type IN ('purchase', 'error') AS has_l3,
    {_s_sql(4001)} AS flicker, {_s_sql(5003)} AS rppg, {_s_sql(6007)} AS eye, {_s_sql(7001)} AS skin, {_s_sql(8009)} AS symmetry, event_id % 4 AS faces,
    {_s_sql(3001)} AS vit, {_s_sql(3011)} AS gan, {_s_sql(3019)} AS tcn, {_s_sql(3023)} AS diffusion, {_s_sql(3037)} AS lipsync, {_s_sql(9001)} AS ensemble, {_s_sql(9007)} AS agreement,
    event_id % 11 = 0 AS public_figure, {_s_sql(2003)} AS political, event_id % 17 = 0 AS trust_anomaly
  FROM events)"""

SCORED = """layers AS (
  SELECT *, greatest(0e0, least(1e0, (CASE WHEN hash_match THEN 1e0 ELSE 0e0 END + metadata + compression + CASE WHEN c2pa = false THEN 6e-1 ELSE 0e0 END + CASE WHEN n_tools > 0 THEN least(n_tools * 15e-2, 6e-1) ELSE 0e0 END)
      / (2 + CAST(hash_match AS INTEGER) + CASE WHEN c2pa IS NULL THEN 0 ELSE 1 END + CASE WHEN n_tools > 0 THEN 1 ELSE 0 END))) AS l1_score,
    CASE WHEN has_l2 THEN CASE WHEN faces = 0 THEN 0e0 ELSE greatest(0e0, least(1e0, 0e0 + flicker * 2e-1 + rppg * 25e-2 + eye * 2e-1 + skin * 15e-2 + symmetry * 2e-1)) END END AS l2_score,
    CASE WHEN has_l3 THEN greatest(0e0, least(1e0, ensemble * CASE WHEN agreement >= 8e-1 THEN 1e0 WHEN agreement >= 5e-1 THEN 9e-1 ELSE 75e-2 END)) END AS l3_score,
    1e0 + CASE WHEN public_figure THEN 3e-1 ELSE 0e0 END + political * 2e-1 + CASE WHEN trust_anomaly THEN 15e-2 ELSE 0e0 END AS context_multiplier
  FROM scan_facts),
based AS (
  SELECT *, greatest(0e0, least(1e0, (0e0 + l1_score * 2e-1 + CASE WHEN l2_score IS NOT NULL THEN l2_score * 35e-2 ELSE 0e0 END + CASE WHEN l3_score IS NOT NULL THEN l3_score * 45e-2 ELSE 0e0 END)
      / (0e0 + 2e-1 + CASE WHEN l2_score IS NOT NULL THEN 35e-2 ELSE 0e0 END + CASE WHEN l3_score IS NOT NULL THEN 45e-2 ELSE 0e0 END))) AS base_score FROM layers),
risked AS (SELECT *, greatest(0e0, least(1e0, base_score * context_multiplier)) AS risk_score FROM based),
scored AS (SELECT *, CASE WHEN risk_score < 3e-1 THEN 'ALLOW' WHEN risk_score < 6e-1 THEN 'FLAG' WHEN risk_score < 85e-2 THEN 'FLAG_URGENT' ELSE 'BLOCK' END AS verdict FROM risked)"""

_F2 = lambda x: f"printf('%.2f', {x})"
REASONS = f"""reasons AS (
  SELECT scan_id, tenant_id, ts, verdict, risk_score, u.o AS o, u.code AS code, u.category AS category, u.explanation AS explanation, u.confidence AS confidence FROM scored, unnest([
    {{'o': 1, 'ok': hash_match, 'code': 'L1_HASH_MATCH', 'category': 'L1_HASH', 'explanation': 'Media matches known deepfake hash (id: ' || hash_match_id || ')', 'confidence': 99e-2}},
    {{'o': 2, 'ok': metadata > 5e-1, 'code': 'L1_METADATA_ANOMALY', 'category': 'L1_METADATA', 'explanation': 'Metadata anomaly detected (score: ' || {_F2("metadata")} || ')', 'confidence': metadata}},
    {{'o': 3, 'ok': compression > 5e-1, 'code': 'L1_COMPRESSION_ANOMALY', 'category': 'L1_METADATA', 'explanation': 'Compression pattern anomaly (score: ' || {_F2("compression")} || ')', 'confidence': compression}},
    {{'o': 4, 'ok': c2pa = false, 'code': 'L1_C2PA_INVALID', 'category': 'L1_METADATA', 'explanation': 'C2PA provenance chain is invalid or tampered', 'confidence': 8e-1}},
    {{'o': 5, 'ok': n_tools > 0, 'code': 'L1_EDITING_TOOLS', 'category': 'L1_METADATA', 'explanation': 'Editing tool artifacts detected: ' || tools, 'confidence': greatest(0e0, least(1e0, l1_score * 8e-1))}},
    {{'o': 6, 'ok': has_l2 AND faces > 0 AND flicker > 5e-1, 'code': 'L2_MICRO_FLICKER', 'category': 'L2_BIOMETRIC', 'explanation': 'Micro-flicker anomaly in facial region (score: ' || {_F2("flicker")} || ')', 'confidence': flicker}},
    {{'o': 7, 'ok': has_l2 AND faces > 0 AND rppg > 6e-1, 'code': 'L2_RPPG_ABSENT', 'category': 'L2_BIOMETRIC', 'explanation': 'Remote photo-plethysmography signal absent or synthetic (score: ' || {_F2("rppg")} || ')', 'confidence': rppg}},
    {{'o': 8, 'ok': has_l2 AND faces > 0 AND eye > 5e-1, 'code': 'L2_EYE_ANOMALY', 'category': 'L2_BIOMETRIC', 'explanation': 'Eye movement pattern inconsistent with natural behavior (score: ' || {_F2("eye")} || ')', 'confidence': eye}},
    {{'o': 9, 'ok': has_l2 AND faces > 0 AND skin > 5e-1, 'code': 'L2_SKIN_TEXTURE', 'category': 'L2_BIOMETRIC', 'explanation': 'Skin texture inconsistency detected (score: ' || {_F2("skin")} || ')', 'confidence': skin}},
    {{'o': 10, 'ok': has_l2 AND faces > 0 AND symmetry > 5e-1, 'code': 'L2_FACIAL_SYMMETRY', 'category': 'L2_BIOMETRIC', 'explanation': 'Unnatural facial symmetry pattern (score: ' || {_F2("symmetry")} || ')', 'confidence': symmetry}},
    {{'o': 11, 'ok': has_l3 AND ensemble > 5e-1, 'code': 'L3_ENSEMBLE_HIGH', 'category': 'L3_NEURAL', 'explanation': 'Neural network ensemble indicates synthetic media (score: ' || {_F2("ensemble")} || ', agreement: ' || printf('%.0f', agreement * 1e2) || '%)', 'confidence': ensemble}},
    {{'o': 12, 'ok': has_l3 AND vit > 6e-1, 'code': 'L3_VIT_DETECTION', 'category': 'L3_NEURAL', 'explanation': 'Vision Transformer detected synthetic artifacts (score: ' || {_F2("vit")} || ')', 'confidence': vit}},
    {{'o': 13, 'ok': has_l3 AND gan > 6e-1, 'code': 'L3_GAN_DETECTION', 'category': 'L3_NEURAL', 'explanation': 'GAN-specific detector triggered (score: ' || {_F2("gan")} || ')', 'confidence': gan}},
    {{'o': 14, 'ok': has_l3 AND tcn > 6e-1, 'code': 'L3_TEMPORAL_ANOMALY', 'category': 'L3_NEURAL', 'explanation': 'Temporal consistency analysis flagged anomalies (score: ' || {_F2("tcn")} || ')', 'confidence': tcn}},
    {{'o': 15, 'ok': has_l3 AND diffusion > 6e-1, 'code': 'L3_DIFFUSION_ARTIFACT', 'category': 'L3_NEURAL', 'explanation': 'Diffusion model artifacts detected (score: ' || {_F2("diffusion")} || ')', 'confidence': diffusion}},
    {{'o': 16, 'ok': has_l3 AND lipsync > 6e-1, 'code': 'L3_LIPSYNC_MISMATCH', 'category': 'L3_NEURAL', 'explanation': 'Lip-sync mismatch with audio track (score: ' || {_F2("lipsync")} || ')', 'confidence': lipsync}},
    {{'o': 17, 'ok': public_figure, 'code': 'CTX_PUBLIC_FIGURE', 'category': 'CONTEXT', 'explanation': 'Public figure detected -- risk multiplier applied (+0.30)', 'confidence': 9e-1}},
    {{'o': 18, 'ok': political > 3e-1, 'code': 'CTX_POLITICAL_CONTENT', 'category': 'CONTEXT', 'explanation': 'Political content detected (score: ' || {_F2("political")} || ') -- risk multiplier applied', 'confidence': political}},
    {{'o': 19, 'ok': trust_anomaly, 'code': 'CTX_ACCOUNT_ANOMALY', 'category': 'CONTEXT', 'explanation': 'Account trust anomaly detected -- risk multiplier applied (+0.15)', 'confidence': 75e-2}}
  ]) AS x(u) WHERE u.ok),
coded AS (SELECT scan_id, string_agg(code, ',' ORDER BY o) AS codes, string_agg(explanation, '|' ORDER BY o) AS facts, count(*) AS n_codes FROM reasons GROUP BY scan_id)"""


def tenants(spark: SparkSession, d: str) -> DataFrame:
    n, r = t(spark, d, "nation"), t(spark, d, "region")
    j = F.when(F.col("r_name") == "EUROPE", "EU").when(F.col("r_name") == "AMERICA", "US").otherwise("OTHER")
    return n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("tenant_id"), F.col("n_name").alias("tenant_name"), j.alias("jurisdiction"))


TENANTS = """tenants AS (
  SELECT n_nationkey AS tenant_id, n_name AS tenant_name, CASE r_name WHEN 'EUROPE' THEN 'EU' WHEN 'AMERICA' THEN 'US' ELSE 'OTHER' END AS jurisdiction
  FROM nation JOIN region ON n_regionkey = r_regionkey)"""


def policies(spark: SparkSession, d: str) -> DataFrame:
    """Three versions for each tenant but those divisible by seven, which have none."""
    n = t(spark, d, "nation").select(F.col("n_nationkey").alias("tenant_id")).filter("tenant_id % 7 <> 0")
    v = n.select("tenant_id", F.explode(F.array(*map(F.lit, (0, 1, 2)))).alias("version"))
    start = lambda k: F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(k * 10)
    x = F.col("tenant_id") + F.col("version")
    return v.select(
        "tenant_id", "version", start(F.col("version")).alias("effective_from"), F.when(F.col("version") < 2, start(F.col("version") + 1)).alias("effective_until"), (F.lit(0.2) + x % 4 * F.lit(0.05)).alias("allow_max"),
        (F.lit(0.5) + x % 3 * F.lit(0.05)).alias("flag_max"), (F.lit(0.75) + x % 5 * F.lit(0.03)).alias("flag_urgent_max"), (x % 2 == 0).alias("auto_block_known_hash"), (F.lit(5) + x % 20).alias("data_retention_days"),
    )


POLICIES = """policies AS (
  SELECT n_nationkey AS tenant_id, v AS version, TIMESTAMP '2024-01-01' + to_days(v * 10) AS effective_from, CASE WHEN v < 2 THEN TIMESTAMP '2024-01-01' + to_days((v + 1) * 10) END AS effective_until,
    2e-1 + (n_nationkey + v) % 4 * 5e-2 AS allow_max, 5e-1 + (n_nationkey + v) % 3 * 5e-2 AS flag_max, 75e-2 + (n_nationkey + v) % 5 * 3e-2 AS flag_urgent_max, (n_nationkey + v) % 2 = 0 AS auto_block_known_hash, 5 + (n_nationkey + v) % 20 AS data_retention_days
  FROM nation, unnest([0, 1, 2]) AS x(v) WHERE n_nationkey % 7 <> 0)"""


def video_metadata(spark: SparkSession, d: str, gops: bool = True) -> DataFrame:
    """gops: with the sizes of picture groups, which take an aggregate over another table."""
    k = F.col("doc_id")
    pick = lambda items, n: F.get(F.array(*map(F.lit, items)), (k % n).cast("int"))
    g = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("g"))
    gop = g.select(F.col("l_orderkey").alias("doc_id"), F.transform("g", lambda x: x["l_quantity"].cast("int")).alias("gop_sizes"))
    docs = t(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    tags = F.when(k % 3 == 0, F.array(F.struct(F.lit("Software").alias("key"), F.col("source").alias("value")))).otherwise(F.array().cast("array<struct<key:string,value:string>>"))
    md = F.struct(
        F.when(k % 10 != 9, F.lit("h264")).alias("codec"), F.lit("mp4").alias("container"), F.when(k % 9 != 8, pick(ENCODERS, len(ENCODERS))).alias("encoder"), tags.alias("exif_tags"), F.when(k % 6 != 5, (k * 37 % 20000).cast("double")).alias("bitrate_kbps"),
        F.when(k % 5 != 4, F.lit(25.0)).alias("fps"), pick([s[0] for s in SIZES], 5).alias("width"), pick([s[1] for s in SIZES], 5).alias("height"), F.coalesce("gop_sizes", F.array().cast("array<int>")).alias("gop_sizes"), F.when(k % 4 == 0, True).when(k % 4 == 1, False).alias("c2pa_valid"),
    )
    docs = docs.join(gop, "doc_id", "left") if gops else docs.withColumn("gop_sizes", F.lit(None).cast("array<int>"))
    return docs.select(k.alias("video_id"), "n_chars", md.alias("md"))


def _case(items, key: str = "doc_id") -> str:
    n = len(items)
    q = lambda x: f"'{x}'" if isinstance(x, str) else str(x)
    return f"CASE {key} % {n} " + " ".join(f"WHEN {i} THEN {q(x)}" for i, x in enumerate(items)) + " END"


VIDEO = f"""gops AS (SELECT l_orderkey AS doc_id, list(CAST(l_quantity AS INTEGER) ORDER BY l_linenumber) AS gop FROM lineitem GROUP BY l_orderkey),
video AS (
  SELECT d.doc_id AS video_id, n_chars, CASE WHEN d.doc_id % 10 <> 9 THEN 'h264' END AS codec, 'mp4' AS container, CASE WHEN d.doc_id % 9 <> 8 THEN {_case(ENCODERS, "d.doc_id")} END AS encoder,
    CASE WHEN d.doc_id % 3 = 0 THEN 'Software=' || source END AS tag, CASE WHEN d.doc_id % 6 <> 5 THEN CAST(d.doc_id * 37 % 20000 AS DOUBLE) END AS bitrate, CASE WHEN d.doc_id % 5 <> 4 THEN 25e0 END AS fps,
    {_case([s[0] for s in SIZES], "d.doc_id")} AS width, {_case([s[1] for s in SIZES], "d.doc_id")} AS height, gop, CASE d.doc_id % 4 WHEN 0 THEN true WHEN 1 THEN false END AS c2pa
  FROM documents d LEFT JOIN gops g ON g.doc_id = d.doc_id),
searchable AS (SELECT *, lower(concat_ws(' ', encoder, codec, container, tag)) AS txt FROM video)"""


def actions(spark: SparkSession, d: str) -> DataFrame:
    """Reviews of every third scan."""
    from ..operators.scoring import risk_score

    s = risk_score(scan_facts(spark, d), reasons=False).filter("scan_id % 3 = 0")
    new = F.when(F.col("scan_id") % 7 == 0, "ALLOW").when(F.col("scan_id") % 11 == 0, "BLOCK").otherwise(F.col("verdict"))
    return s.select("scan_id", (F.col("scan_id") % 10).cast("int").alias("reviewer_id"), F.col("verdict").alias("original_verdict"), new.alias("new_verdict"), (F.col("scan_id") % 600 + 30).alias("review_seconds"), (F.col("ts") + F.make_dt_interval(hours=F.lit(2))).alias("acted_at"))


ACTIONS = """actions AS (
  SELECT scan_id, CAST(scan_id % 10 AS INTEGER) AS reviewer_id, verdict AS original_verdict, CASE WHEN scan_id % 7 = 0 THEN 'ALLOW' WHEN scan_id % 11 = 0 THEN 'BLOCK' ELSE verdict END AS new_verdict, scan_id % 600 + 30 AS review_seconds, ts + INTERVAL 2 HOUR AS acted_at
  FROM scored WHERE scan_id % 3 = 0)"""


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Labelled sandbox samples: toxic stands for fake, the source for the attack category."""
    x = t(spark, d, "labels").join(t(spark, d, "documents").select("doc_id", "source", "lang"), "doc_id")
    return x.select(F.col("doc_id").alias("sample_id"), F.col("source").alias("category"), "lang", (F.col("toxic") == 1).alias("is_fake"), ((F.col("doc_id") * 31 % 100) < F.when(F.col("toxic") == 1, 80).otherwise(15)).alias("detected"))


SAMPLES = """samples AS (
  SELECT l.doc_id AS sample_id, source AS category, lang, toxic = 1 AS is_fake, (l.doc_id * 31 % 100) < CASE WHEN toxic = 1 THEN 80 ELSE 15 END AS detected FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def hashes(spark: SparkSession, d: str) -> DataFrame:
    """Average hashes of embeddings read as 8 x 8 grids, and planted references a few bits away."""
    from ..operators.hashing import ahash

    grid = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1.0) * 127.0).cast("int"))
    e = t(spark, d, "embeddings").select("vec_id", grid.alias("grid"))
    return e.select("vec_id", ahash(F.col("grid")).alias("h"))


def frame_hashes(spark: SparkSession, d: str) -> DataFrame:
    """(video_id, frame, ahash, dhash, phash): two frames a video, hashed in three families."""
    from ..operators import hashing

    lum = lambda x: F.floor((x.cast("double") + 1.0) * 127.0)
    small = F.transform("embedding", lambda x: lum(x).cast("int"))
    wide = F.transform(F.concat("embedding", F.slice("embedding", 1, 8)), lambda x: lum(x).cast("int"))
    big = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.transform("embedding", lambda x: lum(x) + i)))
    e = t(spark, d, "embeddings").select("vec_id", hashing.ahash(small).alias("ahash"), hashing.dhash(wide).alias("dhash"), big.alias("grid"))
    return hashing.phash(e).select(F.floor(F.col("vec_id") / 2).alias("video_id"), F.col("vec_id").alias("frame"), "ahash", "dhash", "phash")


def family_references(frames: DataFrame) -> DataFrame:
    """Every fifth frame as a reference, each family's hash with some of its lowest bits flipped."""
    mask = lambda n: F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("frame") % n).cast("int")) - 1
    return frames.filter("frame % 5 = 0").select(F.concat(F.lit("r"), F.col("frame").cast("string")).alias("ref_id"), *[F.col(c).bitwiseXOR(mask(n)).alias(c) for c, n in (("ahash", 10), ("dhash", 9), ("phash", 13))])


def references(hashed: DataFrame, every: int = 5) -> DataFrame:
    """Every fifth hash with vec_id % 10 of its bits flipped."""
    n = (F.col("vec_id") % 10).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), n) - 1
    return hashed.filter(F.col("vec_id") % every == 0).select(F.concat(F.lit("r"), F.col("vec_id").cast("string")).alias("ref_id"), F.col("h").bitwiseXOR(mask).alias("ref_h"))


HASHES = """grids AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127e0) AS INTEGER)) AS g FROM embeddings),
hashes AS (
  SELECT vec_id, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 64), lambda i: CASE WHEN g[i + 1] > floor(list_sum(g) / 64e0) THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(i AS INTEGER) END ELSE CAST(0 AS BIGINT) END)), lambda a, b: a | b) AS h FROM grids),
refs AS (SELECT 'r' || vec_id AS ref_id, xor(h, (CAST(1 AS BIGINT) << CAST(vec_id % 10 AS INTEGER)) - 1) AS ref_h FROM hashes WHERE vec_id % 5 = 0)"""


_BITS = "list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(range(0, 64), lambda i: CASE WHEN {} THEN CASE WHEN i = 63 THEN CAST(-9223372036854775808 AS BIGINT) ELSE CAST(1 AS BIGINT) << CAST(i AS INTEGER) END ELSE CAST(0 AS BIGINT) END)), lambda a, b: a | b)"
#: Three families of hashes; the transform hash by sums of cosines, in millionths as in the operator.
FAMILIES = f"""lum AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127e0) AS INTEGER)) AS g, list_transform(list_concat(embedding, embedding[1:8]), lambda x: CAST(floor((CAST(x AS DOUBLE) + 1e0) * 127e0) AS INTEGER)) AS w FROM embeddings),
cells AS (SELECT vec_id, i // 32 AS r, i % 32 AS c, CAST(g[i % 64 + 1] + i // 64 AS DOUBLE) AS v FROM lum, unnest(range(0, 1024)) AS x(i)),
across AS (SELECT vec_id, r, l, sum(v * cos((2 * c + 1) * l * pi() / 64)) AS s FROM cells, unnest(range(0, 8)) AS y(l) GROUP BY ALL),
low AS (SELECT vec_id, k * 8 + l - 1 AS i, floor(sum(s * cos((2 * r + 1) * k * pi() / 64)) * sqrt(CASE WHEN k = 0 THEN 1 ELSE 2 END / 32e0) * sqrt(CASE WHEN l = 0 THEN 1 ELSE 2 END / 32e0) * 1e6 + 5e-1) AS x FROM across, unnest(range(0, 8)) AS z(k) WHERE k + l > 0 GROUP BY vec_id, k, l),
trans AS (SELECT vec_id, CAST(sum(CASE WHEN x > m THEN CAST(1 AS BIGINT) << CAST(i AS INTEGER) ELSE 0 END) AS BIGINT) AS p FROM low JOIN (SELECT vec_id AS v, list_sort(list(x))[32] AS m FROM low GROUP BY vec_id) ON v = vec_id GROUP BY vec_id),
fams AS (SELECT vec_id, {_BITS.format("g[i + 1] > floor(list_sum(g) / 64e0)")} AS a, {_BITS.format("w[i // 8 * 9 + i % 8 + 1] > w[i // 8 * 9 + i % 8 + 2]")} AS h, p FROM lum JOIN trans USING (vec_id)),
fref AS (SELECT 'r' || vec_id AS ref_id, xor(a, (CAST(1 AS BIGINT) << CAST(vec_id % 10 AS INTEGER)) - 1) AS a, xor(h, (CAST(1 AS BIGINT) << CAST(vec_id % 9 AS INTEGER)) - 1) AS h, xor(p, (CAST(1 AS BIGINT) << CAST(vec_id % 13 AS INTEGER)) - 1) AS p FROM fams WHERE vec_id % 5 = 0),
fmatch AS (SELECT vec_id, 0 AS fam, ref_id, CAST(bit_count(xor(f.a, r.a)) AS INTEGER) AS d FROM fams f, fref r WHERE bit_count(xor(f.a, r.a)) <= 5
  UNION ALL SELECT vec_id, 1, ref_id, CAST(bit_count(xor(f.h, r.h)) AS INTEGER) FROM fams f, fref r WHERE bit_count(xor(f.h, r.h)) <= 6
  UNION ALL SELECT vec_id, 2, ref_id, CAST(bit_count(xor(f.p, r.p)) AS INTEGER) FROM fams f, fref r WHERE bit_count(xor(f.p, r.p)) <= 8),
fbest AS (SELECT video_id, m.a AS match_distance, m.b AS frame, m.c AS family_ord, m.e AS ref_id FROM (SELECT vec_id // 2 AS video_id, min(struct_pack(a := d, b := vec_id, c := fam, e := ref_id)) AS m FROM fmatch GROUP BY vec_id // 2))"""


#: Tracks of one task: as tables of frames are stored by track, some 1,000 of them a file.
TRACKS_A_TASK = 1024


def track_ids(spark: SparkSession, d: str) -> DataFrame:
    """(track_id), dealt by track before any frames are made: what is done by track needs no shuffle of frames, and a task has as many tracks
    however many there are. The number of parts is given, as a shuffle by its small size would be put into few."""
    c = t(spark, d, "customer").select(F.col("c_custkey").alias("track_id"))
    return c.repartition(max(spark.sparkContext.defaultParallelism, -(-c.count() // TRACKS_A_TASK)), "track_id")


def tracks(spark: SparkSession, d: str, n: int = 120) -> DataFrame:
    """(track_id, frame, openness, px, py, pupil_distance): n frames for each customer, by arithmetic; all frames of a track in one part."""
    f = track_ids(spark, d).select("track_id", F.explode(F.sequence(F.lit(0), F.lit(n) - F.col("track_id") % 3 * 40)).alias("frame"))
    k, i = F.col("track_id"), F.col("frame")
    shut = ((i + k) % (20 + k % 7 * 10)) < (2 + k % 12)
    return f.select("track_id", i.cast("bigint").alias("frame"), F.when((k % 5 != 0) & shut, 0.1).otherwise(0.8).alias("openness"), (F.lit(100.0) + (i * k % 9) * (k % 4) * F.lit(0.5)).alias("px"), (F.lit(80.0) + (i * i * k % 7) * (k % 3) * F.lit(0.25)).alias("py"), F.when(k % 13 == 0, 0.0).otherwise(60.0).alias("pupil_distance"))


def tracks_sql(n: int = 120, name: str = "track_frames") -> str:
    return f"""{name} AS (
  SELECT c_custkey AS track_id, CAST(i AS BIGINT) AS frame,
    CASE WHEN c_custkey % 5 <> 0 AND ((i + c_custkey) % (20 + c_custkey % 7 * 10)) < (2 + c_custkey % 12) THEN 1e-1 ELSE 8e-1 END AS openness,
    1e2 + (i * c_custkey % 9) * (c_custkey % 4) * 5e-1 AS px, 8e1 + (i * i * c_custkey % 7) * (c_custkey % 3) * 25e-2 AS py, CASE WHEN c_custkey % 13 = 0 THEN 0e0 ELSE 6e1 END AS pupil_distance
  FROM customer, unnest(range(0, {n + 1} - CAST(c_custkey % 3 AS BIGINT) * 40)) AS x(i))"""


TRACKS = tracks_sql()


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
