"""Queries over compliance records, joins, operations and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ed25519
from ..functions.numeric import mean6
from ..operators import compliance, ops, policy, quality, scoring
from ..sources import readers
from ..streaming import flows
from . import views as V
from .registry import query
from .scores import _M6, _N, BASE, BASE_P, scored

BASE_R = V.with_(V.SCAN_FACTS, V.SCORED, V.REASONS)
_id = lambda kind, key="scan_id": f"sha256('{kind}:' || {key})"


@query(BASE_R + f"SELECT {_id('audit')} AS audit_id, scan_id, tenant_id, verdict AS decision, risk_score, coalesce(codes, '') AS reason_codes, verdict IN ('FLAG', 'FLAG_URGENT') AS human_oversight_required, 'EU_AI_ACT' AS regulation, 'Article 13' AS article_reference FROM scored LEFT JOIN coded USING (scan_id)")
def audit_log(spark, d):
    return compliance.audit_log(scored(spark, d, True)).withColumn("reason_codes", F.array_join("reason_codes", ",")).drop("created_at")


REPORTABLE = "((verdict = 'BLOCK' AND risk_score > 95e-2) OR (political > 3e-1 AND risk_score > 8e-1))"


@query(BASE_R + f"SELECT {_id('incident')} AS incident_id, scan_id, 'automated_detection' AS incident_type, 'high' AS severity, coalesce(codes, '') AS reason_codes, 'pending_review' AS status FROM scored LEFT JOIN coded USING (scan_id) WHERE {REPORTABLE}")
def incident_reports(spark, d):
    return compliance.incidents(scored(spark, d, True)).select("incident_id", "scan_id", "incident_type", "severity", F.array_join("reason_codes", ",").alias("reason_codes"), "status")


@query(BASE_R + f"SELECT {_id('incident')} AS incident_id, scan_id FROM scored WHERE {REPORTABLE} AND ts >= TIMESTAMP '2024-01-05' ORDER BY ts, scan_id LIMIT 25")
def incident_listing(spark, d):
    from ..operators.analytics import page

    found = compliance.incidents(scored(spark, d, True)).withColumnRenamed("created_at", "ts")
    return page(found.filter(F.col("ts") >= F.lit("2024-01-05").cast("timestamp")), 25).select("incident_id", "scan_id")


_SYN = "(verdict = 'BLOCK' OR (verdict = 'FLAG' AND risk_score > 7e-1))"


@query(BASE + f"SELECT {_id('manifest')} AS manifest_id, scan_id, verdict AS decision, concat_ws(',', 'L1', CASE WHEN has_l2 THEN 'L2' END, CASE WHEN has_l3 THEN 'L3' END) AS tiers, concat_ws(',', 'verdict', 'reason_codes', CASE WHEN {_SYN} THEN 'c2pa.ai_generated' END) AS assertions, {_SYN} AS is_ai_generated, sha256(CAST(scan_id AS VARCHAR)) AS hash_value, 'scan:' || scan_id AS title FROM scored WHERE verdict <> 'ALLOW'")
def provenance_manifests(spark, d):
    m = compliance.manifests(scored(spark, d, True))
    return m.select("manifest_id", "scan_id", "decision", F.array_join(F.transform("actions", lambda a: a["tier"]), ",").alias("tiers"), F.array_join("assertions", ",").alias("assertions"), "is_ai_generated", "hash_value", "title")


_BASIS = "CASE verdict " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in compliance.BASES.items()) + " END"


@query(BASE_R + f"SELECT {_id('statement')} AS statement_id, scan_id, tenant_id, verdict AS decision, {_BASIS} AS legal_basis, coalesce(facts, 'Automated analysis detected indicators of media manipulation with a confidence score of ' || printf('%.1f', risk_score * 1e2) || '%.') AS facts, true AS internal_complaint FROM scored LEFT JOIN coded USING (scan_id) WHERE verdict <> 'ALLOW'")
def statements_of_reasons(spark, d):
    return compliance.statements(scored(spark, d, True)).select("statement_id", "scan_id", "tenant_id", "decision", "legal_basis", F.array_join("facts", "|").alias("facts"), F.col("redress_info.internal_complaint").alias("internal_complaint"))


@query(BASE + "SELECT date_trunc('month', ts)::TIMESTAMP AS period, verdict AS decision_type, count(*) AS n FROM scored GROUP BY ALL")
def dsa_counters(spark, d):
    """Merged from two batches of additive counters."""
    s = scored(spark, d)
    return compliance.merge_counters(compliance.decision_counters(s.filter("scan_id < 500")), compliance.decision_counters(s.filter("scan_id >= 500")))


_ALERT = "SELECT event_id AS alert_id, CASE event_id % 5 WHEN 0 THEN 'deepfake_wave' WHEN 1 THEN 'coordinated_campaign' WHEN 2 THEN 'identity_theft_cluster' WHEN 3 THEN 'political_disinformation_surge' ELSE 'other' END AS alert_type, CASE WHEN event_id % 3 = 0 THEN 'critical' ELSE 'low' END AS severity, CASE WHEN event_id % 4 <> 0 THEN event_id % 200 END AS affected_users FROM events"


@query(f"SELECT {_id('risk', 'alert_id')} AS report_id, alert_id, alert_type, severity, 'pending_submission' AS status FROM ({_ALERT}) WHERE CASE WHEN alert_type IN ('deepfake_wave', 'coordinated_campaign', 'political_disinformation_surge') THEN true WHEN alert_type = 'identity_theft_cluster' THEN coalesce(affected_users > 100, false) ELSE severity = 'critical' END")
def systemic_risk(spark, d):
    k = F.col("event_id")
    kinds = ("deepfake_wave", "coordinated_campaign", "identity_theft_cluster", "political_disinformation_surge", "other")
    a = V.t(spark, d, "events").select(k.alias("alert_id"), F.get(F.array(*map(F.lit, kinds)), (k % 5).cast("int")).alias("alert_type"), F.when(k % 3 == 0, "critical").otherwise("low").alias("severity"), F.when(k % 4 != 0, k % 200).alias("affected_users"))
    return compliance.systemic_risks(a)


@query(BASE + f"SELECT date_trunc('day', ts)::TIMESTAMP AS period, count(*) AS scans FROM scored WHERE ts > TIMESTAMP '{V.AS_OF}' - INTERVAL 24 HOUR GROUP BY ALL")
def record_of_processing(spark, d):
    s = scored(spark, d).filter(F.col("ts") > V.as_of() - F.make_dt_interval(F.lit(1)))
    return s.groupBy(F.date_trunc("day", "ts").alias("period")).agg(F.count("*").alias("scans"))


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("SELECT count(*) AS n FROM information_schema.columns WHERE table_name IN (" + ", ".join(f"'{t}'" for t in TABLES) + ") AND column_name LIKE '%key%' AND table_name NOT LIKE '%item%'")
def zero_retention_columns(spark, d):
    """Over the catalog of the given tables, as their files describe themselves: columns that hold keys, line items left out."""
    return quality.columns_like(quality.catalog({t: V.t(spark, d, t) for t in TABLES}), "%key%", "%item%")


_EXP = "scored s JOIN policies p ON p.tenant_id = s.tenant_id AND p.version = 2"
_OLD = f"s.ts < TIMESTAMP '{V.AS_OF}' - to_days(CAST(data_retention_days AS INTEGER))"


@query(BASE_P + f"SELECT scan_id, s.tenant_id, ts FROM scored s WHERE scan_id NOT IN (SELECT scan_id FROM {_EXP} WHERE {_OLD})")
def retention_survivors(spark, d):
    p = policy.current(V.policies(spark, d), V.as_of())
    return compliance.survivors(scored(spark, d).select("scan_id", "tenant_id", "ts"), p, V.as_of()).select("scan_id", "tenant_id", "ts")


@query(BASE_P + f"SELECT scan_id, s.tenant_id FROM {_EXP} WHERE {_OLD}")
def retention_expired(spark, d):
    p = policy.current(V.policies(spark, d), V.as_of())
    return compliance.expired(scored(spark, d).select("scan_id", "tenant_id", "ts"), p, V.as_of()).select("scan_id", "tenant_id")


@query(f"SELECT event_id AS scan_id, CASE event_type WHEN 'view' THEN 'completed' WHEN 'click' THEN 'failed' ELSE 'processing' END AS status, event_type NOT IN ('view', 'click') OR ts >= TIMESTAMP '{V.AS_OF}' - INTERVAL 1 HOUR AS kept FROM events")
def processing_retention(spark, d):
    """Processing metadata that has ended goes after an hour; what is under way stays."""
    status = F.when(F.col("event_type") == "view", "completed").when(F.col("event_type") == "click", "failed").otherwise("processing")
    kept, purged = compliance.purge_processing(V.t(spark, d, "events").select(F.col("event_id").alias("scan_id"), status.alias("status"), "ts"), V.as_of())
    return kept.withColumn("kept", F.lit(True)).unionByName(purged.withColumn("kept", F.lit(False))).drop("ts")


@query(BASE + f"SELECT scan_id FROM scored WHERE ts >= TIMESTAMP '{V.AS_OF}' - INTERVAL 15 DAY")
def ttl_filter(spark, d):
    return compliance.within_ttl(scored(spark, d), "ts", 15, V.as_of()).select("scan_id")


_ERASE = "SELECT scan_id FROM scored WHERE scan_id % 101 = 0"


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS) + f"SELECT 'verdicts' AS store, scan_id, count(*) AS deleted FROM scored WHERE scan_id IN ({_ERASE}) GROUP BY scan_id UNION ALL SELECT 'actions', scan_id, count(*) FROM actions WHERE scan_id IN ({_ERASE}) GROUP BY scan_id")
def erasure_log(spark, d):
    s = scored(spark, d)
    return compliance.erase({"verdicts": s.select("scan_id"), "actions": V.actions(spark, d)}, s.filter("scan_id % 101 = 0"))[1].select("store", "scan_id", "deleted")


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS) + f"SELECT scan_id, reviewer_id FROM actions WHERE scan_id NOT IN ({_ERASE})")
def erasure_survivors(spark, d):
    s = scored(spark, d)
    return compliance.erase({"actions": V.actions(spark, d)}, s.filter("scan_id % 101 = 0"))[0]["actions"].select("scan_id", "reviewer_id")


@query(V.with_(V.SCAN_FACTS, V.TENANTS) + "SELECT scan_id, tenant_id, region FROM scan_facts JOIN tenants USING (tenant_id) WHERE jurisdiction = 'EU' AND region NOT LIKE 'eu-%'")
def residency_violations(spark, d):
    return compliance.outside_region(V.scan_facts(spark, d), V.tenants(spark, d)).select("scan_id", "tenant_id", "region")


@query(V.with_(V.TENANTS) + "SELECT tenant_id, tenant_name FROM tenants WHERE tenant_id % 4 <> 0")
def dpa_gap(spark, d):
    signed = V.t(spark, d, "nation").filter("n_nationkey % 4 = 0").select(F.col("n_nationkey").alias("tenant_id"))
    return V.tenants(spark, d).join(signed, "tenant_id", "left_anti").select("tenant_id", "tenant_name")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'model_change' WHEN 1 THEN 'manifest_issued' WHEN 2 THEN 'audit_snapshot' ELSE 'ignored' END AS handler FROM events")
def event_routing(spark, d):
    kinds = F.array(*map(F.lit, ("model_version_update", "c2pa_manifest_generated", "audit_requested", "heartbeat")))
    e = V.t(spark, d, "events").select("event_id", F.get(kinds, (F.col("event_id") % 4).cast("int")).alias("event_type"))
    return compliance.route(e).select("event_id", "handler")


@query("SELECT p_brand AS model_name, p_partkey AS version, lag(p_partkey) OVER (PARTITION BY p_brand ORDER BY p_size, p_partkey) AS previous_version FROM part")
def model_timeline(spark, d):
    v = V.t(spark, d, "part").select(F.col("p_brand").alias("model_name"), F.col("p_partkey").alias("version"), F.col("p_size").alias("deployed_at"))
    return compliance.model_changes(v).select("model_name", "version", "previous_version")


@query(BASE + f"SELECT count(*) AS total, CAST(sum(CASE WHEN verdict = 'ALLOW' THEN 1 ELSE 0 END) AS BIGINT) AS n_allow, CAST(sum(CASE WHEN verdict = 'FLAG' THEN 1 ELSE 0 END) AS BIGINT) AS n_flag, CAST(sum(CASE WHEN verdict = 'FLAG_URGENT' THEN 1 ELSE 0 END) AS BIGINT) AS n_flag_urgent, CAST(sum(CASE WHEN verdict = 'BLOCK' THEN 1 ELSE 0 END) AS BIGINT) AS n_block, CAST(sum(CASE WHEN verdict IN ('FLAG', 'FLAG_URGENT') THEN 1 ELSE 0 END) AS BIGINT) AS oversight, {_N(REPORTABLE)} AS incidents, count(DISTINCT tenant_id) AS tenants FROM scored")
def audit_snapshot(spark, d):
    return compliance.audit_snapshot(scored(spark, d, True))


@query("SELECT user_id, max(event_id) AS event_id FROM events e WHERE ts = (SELECT max(ts) FROM events f WHERE f.user_id = e.user_id) GROUP BY user_id")
def upsert_latest(spark, d):
    return compliance.upsert_latest(V.t(spark, d, "events").select("user_id", "ts", "event_id"), "user_id", "ts").select("user_id", "event_id")


KEYS = [("k0", "ACTIVE", 1, None), ("k1", "ROTATED", 1, 15), ("k2", "REVOKED", 1, 20)]


@query(BASE + "SELECT scan_id, scan_id % 10 <> 0 AS content_hash_valid, CASE scan_id % 4 WHEN 0 THEN 'ACTIVE' WHEN 1 THEN 'ROTATED' WHEN 2 THEN 'REVOKED' ELSE 'UNKNOWN' END AS key_status, CASE scan_id % 4 WHEN 0 THEN true WHEN 1 THEN ts < TIMESTAMP '2024-01-15' ELSE false END AS key_valid_at_signing FROM scored")
def verify_signatures(spark, d):
    s = scored(spark, d).select("scan_id", "verdict", F.col("ts").alias("signed_at"))
    day = lambda n: F.to_timestamp(F.concat(F.lit("2024-01-"), F.lpad(F.col(n).cast("string"), 2, "0")))
    keys = spark.createDataFrame(KEYS, "key_id string, status string, a int, b int").select("key_id", "status", day("a").alias("valid_from"), day("b").alias("valid_until"))
    signed = compliance.sign(s, ["scan_id", "verdict"], "k").withColumn("key_id", F.concat(F.lit("k"), (F.col("scan_id") % 4).cast("string")))
    tampered = signed.withColumn("verdict", F.when(F.col("scan_id") % 10 == 0, F.lit("CHANGED")).otherwise(F.col("verdict")))
    return compliance.verify(tampered, keys, ["scan_id", "verdict"]).select("scan_id", "content_hash_valid", "key_status", "key_valid_at_signing")


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS) + "SELECT reviewer_id, count(*) AS n FROM actions WHERE reviewer_id % 2 = 0 AND acted_at >= TIMESTAMP '2024-01-10' AND acted_at < TIMESTAMP '2024-01-25' GROUP BY ALL")
def qualified_reviews(spark, d):
    q = spark.range(0, 10, 2).select(F.col("id").cast("int").alias("reviewer_id"), F.lit("2024-01-10").cast("timestamp").alias("a"), F.lit("2024-01-25").cast("timestamp").alias("b"))
    return V.actions(spark, d).join(q, "reviewer_id").filter((F.col("acted_at") >= F.col("a")) & (F.col("acted_at") < F.col("b"))).groupBy("reviewer_id").agg(F.count("*").alias("n"))


@query("SELECT event_id AS request_id, tenant_id, n, n > 2 AS rejected FROM (SELECT event_id, user_id % 5 AS tenant_id, row_number() OVER (PARTITION BY user_id % 5, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)")
def rate_limit(spark, d):
    r = V.t(spark, d, "events").select(F.col("event_id").alias("request_id"), (F.col("user_id") % 5).alias("tenant_id"), "ts")
    limits = spark.range(5).select(F.col("id").alias("tenant_id"), F.lit(2).alias("per_window"))
    return ops.rate_limited(r, limits, "hour").select("request_id", "tenant_id", F.col("n").cast("bigint").alias("n"), "rejected")


BOUNDS = (10.0, 50.0, 100.0, 200.0)
_HIST = "hist AS (SELECT event_type, le, CAST(sum(CASE WHEN value <= coalesce(le, 1e300) THEN 1 ELSE 0 END) AS BIGINT) AS n FROM events, (VALUES (1e1), (5e1), (1e2), (2e2), (NULL)) b(le) GROUP BY ALL)"


@query("WITH " + _HIST + " SELECT * FROM hist")
def latency_histogram(spark, d):
    return ops.histogram(V.t(spark, d, "events"), "value", ["event_type"], BOUNDS)


@query("WITH " + _HIST + """, w AS (SELECT event_type, le, n, lag(n, 1, 0) OVER o AS below, lag(le, 1, 0e0) OVER o AS start, max(n) OVER (PARTITION BY event_type) AS total FROM hist WINDOW o AS (PARTITION BY event_type ORDER BY le NULLS LAST)),
 hit AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY le NULLS LAST) AS k FROM w WHERE n >= total * 9e-1)
 SELECT event_type, total, floor(CASE WHEN le IS NULL THEN 2e2 ELSE start + (le - start) * ((total * 9e-1 - below) / (n - below)) END * 1e6 + 5e-1) / 1e6 AS quantile FROM hit WHERE k = 1""")
def latency_quantiles(spark, d):
    from ..functions.numeric import round_to

    return ops.histogram_quantile(latency_histogram(spark, d), 0.9, ["event_type"]).withColumn("quantile", round_to("quantile", 6))


_AV = "SELECT user_id % 5 AS tenant_id, count(*) AS requests, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY ALL"


def _av(spark, d):
    r = V.t(spark, d, "events").select((F.col("user_id") % 5).alias("tenant_id"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"))
    return ops.availability(r, ["tenant_id"])


@query(f"SELECT *, CAST(requests - errors AS DOUBLE) / requests AS availability FROM ({_AV})")
def availability_slo(spark, d):
    return _av(spark, d)


@query(f"SELECT tenant_id, floor(b * 1e6 + 5e-1) / 1e6 AS budget_left, CASE WHEN b <= 0 THEN 'EXHAUSTED' WHEN b < 1e-1 THEN 'INCIDENT' WHEN b < 25e-2 THEN 'FREEZE' WHEN b <= 5e-1 THEN 'CAUTION' ELSE 'NORMAL' END AS band FROM (SELECT *, greatest(1e0 - CAST(errors AS DOUBLE) / (requests * (1e0 - 7e-1)), 0e0) AS b FROM ({_AV}))")
def error_budget(spark, d):
    from ..functions.numeric import round_to

    return ops.error_budget(_av(spark, d), 0.7).select("tenant_id", round_to("budget_left", 6).alias("budget_left"), "band")


@query("WITH dy AS (SELECT event_type AS service, date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS requests, CAST(sum(CASE WHEN value > 20 THEN 1 ELSE 0 END) AS BIGINT) AS errors FROM events GROUP BY ALL), w AS (SELECT service, day, CAST(sum(requests) OVER x AS BIGINT) AS requests, CAST(sum(errors) OVER x AS BIGINT) AS errors FROM dy WINDOW x AS (PARTITION BY service ORDER BY day RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW)) SELECT *, floor(errors / (requests * (1e0 - 9e-1)) * 1e6 + 5e-1) / 1e6 AS burned FROM w")
def budget_burn(spark, d):
    """The error budget that the last 30 days burn, for each service and day."""
    from ..functions.numeric import round_to

    e = V.t(spark, d, "events").groupBy(F.col("event_type").alias("service"), F.date_trunc("day", "ts").alias("day")).agg(F.count("*").alias("requests"), F.count_if(F.col("value") > 20).alias("errors"))
    return ops.budget_burn(e, 0.9).withColumn("burned", round_to("burned", 6))


_SLOT = "SELECT event_type AS metric, (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 86400 AS slot, CAST(count(*) AS DOUBLE) AS value FROM events GROUP BY ALL"


@query(f"WITH m AS ({_SLOT}), o AS (SELECT metric AS alert, slot, value FROM m WHERE value > 5), r AS (SELECT *, slot - row_number() OVER (PARTITION BY alert ORDER BY slot) AS run FROM o) SELECT alert, 'P2' AS priority, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS held, max(value) AS peak FROM r GROUP BY alert, run HAVING count(*) >= 2")
def alert_for_duration(spark, d):
    slot = F.floor((F.unix_timestamp("ts") - 1704067200) / 86400)
    m = V.t(spark, d, "events").groupBy(F.col("event_type").alias("metric"), slot.alias("slot")).agg(F.count("*").cast("double").alias("value"))
    rules = spark.createDataFrame([(x, "P2", x, 5.0, 2) for x in ("view", "click", "purchase", "error", "signup")], "alert string, priority string, metric string, bound double, slots int")
    return ops.held_for(m, rules)


_CNT = "SELECT user_id % 10 AS key, (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 86400 AS day, hour(ts) // 8 AS slot, count(*) AS n FROM events GROUP BY ALL"


@query(f"WITH c AS ({_CNT}) SELECT key, day, slot, n, baseline, baseline > 0 AND n > baseline * 3 AS wave FROM (SELECT *, coalesce(sum(n) OVER (PARTITION BY key, slot ORDER BY day RANGE BETWEEN 7 PRECEDING AND 1 PRECEDING), 0) / 7e0 AS baseline FROM c)")
def wave_detection(spark, d):
    c = V.t(spark, d, "events").groupBy((F.col("user_id") % 10).alias("key"), F.floor((F.unix_timestamp("ts") - 1704067200) / 86400).alias("day"), F.floor(F.hour("ts") / 8).alias("slot")).agg(F.count("*").alias("n"))
    return ops.wave_baseline(c)


@query(BASE + "SELECT hash_match_id AS fingerprint, region, count(*) AS n, count(DISTINCT tenant_id) AS tenants, min(ts) AS first_seen, max(ts) AS last_seen FROM scored WHERE hash_match_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 2")
def wave_clusters(spark, d):
    s = scored(spark, d).filter("l1.hash_match_id is not null").select(F.col("l1.hash_match_id").alias("fingerprint"), "region", "tenant_id", "ts")
    return ops.clusters(s, ["fingerprint", "region"], 2)


@query("WITH r AS (SELECT event_type AS fingerprint, user_id % 20 AS target, (event_id * 7919 % 1000) / 1e3 AS trust FROM events), g AS (SELECT fingerprint, target, count(*) AS n, sum(CASE WHEN trust < 3e-1 THEN 1 ELSE 0 END) AS low FROM r GROUP BY ALL) SELECT fingerprint, CAST(sum(n) AS BIGINT) AS rows, count(*) AS targets, CAST(sum(low) AS DOUBLE) / CAST(sum(n) AS DOUBLE) AS low_trust_share, min(struct_pack(n := -n, t := target)).t AS main_target, -min(struct_pack(n := -n, t := target)).n AS main_target_rows FROM g GROUP BY fingerprint")
def wave_targets(spark, d):
    r = V.t(spark, d, "events").select(F.col("event_type").alias("fingerprint"), (F.col("user_id") % 20).alias("target"), (F.col("user_id") % 25).alias("tenant_id"), ((F.col("event_id") * 7919 % 1000) / F.lit(1000.0)).alias("trust"))
    return ops.wave_targets(r)


@query("SELECT event_id AS call_id, recent_failures, recent_failures >= 3 AS open FROM (SELECT event_id, CAST(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id % 3 ORDER BY CAST(floor(epoch(ts)) AS BIGINT) RANGE BETWEEN 21600 PRECEDING AND CURRENT ROW) AS BIGINT) AS recent_failures FROM events)")
def circuit_breaker(spark, d):
    c = V.t(spark, d, "events").select((F.col("user_id") % 3).alias("service"), F.col("event_id").alias("call_id"), "ts", (F.col("event_type") == "error").alias("failed"))
    return ops.circuit_breaker(c, 3, 21600).select("call_id", "recent_failures", "open")


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, o_orderpriority AS severity, count(*) AS incidents, " + f"{_M6('o_orderkey % 50 * 60')} AS mttd, {_M6('o_orderkey % 20 * 60')} AS mtta, {_M6('CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey % 100 * 60 END')} AS mttr, CAST(sum(CASE WHEN o_orderkey % 9 <> 0 THEN 1 ELSE 0 END) AS DOUBLE) / count(*) AS completion_rate FROM orders GROUP BY ALL")
def incident_metrics(spark, d):
    k = F.col("o_orderkey")
    plus = lambda at, n: F.col(at) + F.make_dt_interval(mins=n.cast("int"))
    o = V.t(spark, d, "orders").select(k.alias("k"), F.col("o_orderpriority").alias("severity"), F.col("o_orderdate").cast("timestamp").alias("occurred_at"))
    k = F.col("k")
    o = o.withColumn("detected_at", plus("occurred_at", k % 50)).withColumns({"acknowledged_at": plus("detected_at", k % 20), "resolved_at": F.when(k % 9 != 0, plus("detected_at", k % 100))})
    return ops.incident_metrics(o).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("SELECT event_type AS topic, (CAST(floor(epoch(ts)) AS BIGINT) - 1704067200) // 86400 AS slot, count(*) AS lag, CASE WHEN count(*) > 2 * b THEN 'SCALE_OUT_FAST' WHEN count(*) > b THEN 'SCALE_OUT' ELSE 'HOLD' END AS decision FROM events JOIN (VALUES ('view', 5), ('click', 7), ('error', 9), ('purchase', 3), ('signup', 1)) x(t, b) ON t = event_type GROUP BY topic, slot, b")
def scaling_decisions(spark, d):
    lag = V.t(spark, d, "events").groupBy(F.col("event_type").alias("topic"), F.floor((F.unix_timestamp("ts") - 1704067200) / 86400).alias("slot")).agg(F.count("*").alias("lag"))
    return ops.scale_decision(lag, {"view": 5, "click": 7, "error": 9, "purchase": 3, "signup": 1}).drop("bound")


@query("SELECT event_id, CASE user_id % 3 WHEN 0 THEN true WHEN 1 THEN event_type IN ('view', 'click') ELSE false END AS allowed FROM events")
def permission_check(spark, d):
    grants = spark.createDataFrame([(0, ["admin"]), (1, ["view", "click"])], "tenant_id bigint, permissions array<string>")
    c = V.t(spark, d, "events").select("event_id", (F.col("user_id") % 3).alias("tenant_id"), F.col("event_type").alias("permission"))
    return ops.permitted(c, grants).select("event_id", "allowed")


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'MALFORMED' WHEN 1 THEN 'UNKNOWN' WHEN 2 THEN 'REVOKED' ELSE 'OK' END AS status FROM events")
def api_key_check(spark, d):
    k = F.array(*map(F.lit, ("nope", "vts_live_none", "vts_test_old", "vts_live_good")))
    calls = V.t(spark, d, "events").select("event_id", F.get(k, (F.col("event_id") % 4).cast("int")).alias("api_key"))
    keys = spark.createDataFrame([("vts_test_old", 1, True), ("vts_live_good", 2, False)], "api_key string, tenant_id int, revoked boolean").select(F.sha2("api_key", 256).alias("key_hash"), "tenant_id", "revoked")
    return quality.check_keys(calls, keys).select("event_id", "status")


@query(BASE + f"SELECT scan_id, ts FROM scored WHERE ts > TIMESTAMP '{V.AS_OF}' - INTERVAL 600 MINUTE ORDER BY ts DESC, scan_id DESC LIMIT 10")
def recent_scans(spark, d):
    return ops.recent(scored(spark, d).select("scan_id", "ts"), V.as_of(), 600, 10)


@query("SELECT 'scans_total{type=\"' || event_type || '\",user=\"' || (user_id % 2) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 2")
def metrics_exposition(spark, d):
    g = V.t(spark, d, "events").groupBy("event_type", (F.col("user_id") % 2).cast("string").alias("u")).agg(F.count("*").alias("value"))
    return ops.exposition(g.select(F.lit("scans_total").alias("name"), F.create_map(F.lit("user"), "u", F.lit("type"), "event_type").alias("labels"), "value"))


def _messages(spark, d):
    e = V.t(spark, d, "events")
    env = F.to_json(F.struct(F.col("event_id").cast("string").alias("message_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), F.col("user_id").cast("string").alias("tenant_id"), F.col("event_id").cast("string").alias("scan_id"), F.concat(F.lit('{"score":'), F.col("value").cast("string"), F.lit("}")).alias("payload")))
    return e.select("event_id", F.when(F.col("event_id") % 10 == 0, F.lit("not json")).when(F.col("event_id") % 10 == 1, F.lit('{"tenant_id":"1"}')).otherwise(env).alias("value"))


@query("SELECT CASE event_id % 10 WHEN 0 THEN 'BAD_ENVELOPE' WHEN 1 THEN 'BAD_ENVELOPE' ELSE 'OK' END AS state, count(*) AS n FROM events GROUP BY ALL")
def quarantine(spark, d):
    from pyspark.sql import types as T

    ok, bad = readers.parse_envelopes(_messages(spark, d), T.StructType([T.StructField("score", T.DoubleType())]))
    return ok.select(F.lit("OK").alias("state")).union(bad.select("reason")).groupBy("state").agg(F.count("*").alias("n"))


@query(V.with_(V.SAMPLES) + f"SELECT category, count(*) AS samples, {_N('is_fake')} AS fakes, {_M6('doc_len')} AS avg_chars FROM (SELECT s.*, CAST(n_chars AS DOUBLE) AS doc_len FROM samples s JOIN documents ON doc_id = sample_id) GROUP BY ALL")
def sandbox_ground_truth(spark, d):
    s = V.samples(spark, d).join(V.t(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("n_chars").cast("double").alias("doc_len")), "sample_id")
    return s.groupBy("category").agg(F.count("*").alias("samples"), F.count_if("is_fake").alias("fakes"), mean6("doc_len").alias("avg_chars"))


SEEDS = {"k1": b"assaywright test key number one!", "k2": b"assaywright test key number two!"}


@query("SELECT user_id % 5 AS tenant_id, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS rows, NOT bool_or(event_type = 'error' AND event_id % 7 = 0) AS batch_valid FROM events GROUP BY ALL")
def batch_signatures(spark, d):
    """Events signed by tenant and day, one signature over the tree of their hashes: batches with a row that was changed later fail."""
    e = V.t(spark, d, "events").select((F.col("user_id") % 5).alias("tenant_id"), F.to_date("ts").alias("day"), "event_id", "event_type", "value")
    cols, by = ["event_id", "event_type", "value"], ["tenant_id", "day"]
    roots = compliance.batch_roots(compliance.sign(e, cols, "k1"), by).withColumn("key_id", F.when(F.col("tenant_id") % 2 == 0, "k1").otherwise("k2"))
    roots = compliance.sign_ed25519(roots, SEEDS)
    changed = e.withColumn("value", F.when((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0), F.coalesce("value", F.lit(0.0)) + 1.0).otherwise(F.col("value")))
    return compliance.check_batches(compliance.sign(changed, cols, ""), roots, by, {k: ed25519.public_key(v) for k, v in SEEDS.items()})


@query("SELECT event_id AS scan_id, CASE WHEN user_id % 2 = 0 THEN 'k1' ELSE 'k2' END AS key_id, event_type <> 'error' AND NOT (event_type = 'click' AND user_id % 2 = 1) AS signature_valid FROM events")
def ed25519_signatures(spark, d):
    """Every event signed and checked: errors were changed after signing, and clicks of the second key are checked against the first."""
    e = V.t(spark, d, "events").select(F.col("event_id").alias("scan_id"), "user_id", "event_type", "value")
    e = e.repartition(spark.sparkContext.defaultParallelism)  # milliseconds a row: worth more tasks than a small file has
    key = F.when(F.col("user_id") % 2 == 0, "k1").otherwise("k2")
    signed = compliance.sign_ed25519(compliance.sign(e, ["scan_id", "event_type", "value"], "").withColumn("key_id", key), SEEDS)
    later = signed.withColumn("content_hash", F.when(F.col("event_type") == "error", F.sha2(F.concat("content_hash", F.lit("x")), 512)).otherwise(F.col("content_hash")))
    later = later.withColumn("key_id", F.when((F.col("event_type") == "click") & (F.col("user_id") % 2 == 1), "k1").otherwise(F.col("key_id")))
    got = compliance.check_ed25519(later, {k: ed25519.public_key(v) for k, v in SEEDS.items()})
    return got.select("scan_id", key.alias("key_id"), "signature_valid")


@query("WITH a AS (SELECT user_id AS delivery_id, event_type, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS attempt FROM events), d AS (SELECT delivery_id, max(attempt) AS attempts, bool_or(event_type = 'purchase') AS ok, max(struct_pack(a := attempt, t := ts)).t AS t FROM a WHERE attempt <= 1 + delivery_id % 5 GROUP BY delivery_id) SELECT delivery_id, CAST(attempts AS INTEGER) AS attempts, CASE WHEN ok THEN 'DELIVERED' WHEN attempts > 3 THEN 'DEAD' ELSE 'RETRY' END AS state, CASE WHEN NOT ok AND attempts <= 3 THEN t + to_seconds(CASE attempts WHEN 1 THEN 1 WHEN 2 THEN 10 ELSE 60 END) END AS next_at FROM d")
def webhook_retries(spark, d):
    """The first events of a user stand for the attempts of a delivery, which purchases end."""
    from pyspark.sql import Window

    e = V.t(spark, d, "events").withColumn("attempt", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))).filter(F.col("attempt") <= 1 + F.col("user_id") % 5)
    return readers.retry_schedule(e.select(F.col("user_id").alias("delivery_id"), "attempt", F.col("ts").cast("timestamp"), (F.col("event_type") == "purchase").alias("ok")))


# ---- storage
@query("SELECT o_orderkey, o_custkey, o_orderdate, strftime(o_orderdate, '%Y%m') AS month FROM orders WHERE strftime(o_orderdate, '%Y%m') BETWEEN '199703' AND '199806'")
def month_scan(spark, d):
    """Months of a table that is stored by month and sorted by key inside files: other months are not opened."""
    path = readers.scratch(spark, "months")
    readers.write_by_month(V.t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), path, "o_orderdate", ("o_custkey",))
    return readers.read_months(spark, path, "199703", "199806").withColumn("month", F.col("month").cast("string"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_custkey IN (7, 11, 100)")
def point_lookup(spark, d):
    """Rows of some keys, by a filter that reaches the scan."""
    return readers.lookup(V.t(spark, d, "orders"), "o_custkey", 7, 11, 100).select("o_orderkey", "o_custkey", "o_totalprice")


@query("SELECT o_orderkey, o_orderdate < TIMESTAMP '1998-01-15' AS archived FROM orders")
def archive_read(spark, d):
    """Orders before a date move to the archive, which is read back beside those that stay."""
    path = readers.scratch(spark, "archive")
    stay = readers.archive(V.t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate"), path, F.lit("1998-01-15").cast("timestamp"), "o_orderdate", ("o_custkey",))
    old = spark.read.parquet(path)
    return old.select("o_orderkey", F.lit(True).alias("archived")).union(stay.select("o_orderkey", F.lit(False)))


@query("SELECT user_id || ':' || event_type AS key, CAST(event_id AS BIGINT) AS event_id, event_type, CAST(value AS DOUBLE) AS value FROM events")
def keyed_messages(spark, d):
    """Messages written by key, as a topic holds them, and read again; each key is in one partition."""
    path = readers.scratch(spark, "topic")
    readers.write_keyed(V.t(spark, d, "events").select("event_id", "user_id", "event_type", "value"), path, ["user_id", "event_type"], "event_id")
    raw = spark.read.schema("key string, value string, partition int").json(path)
    once = raw.groupBy("key").agg(F.count_distinct("partition").alias("n")).filter("n > 1")
    got = raw.join(once, "key", "left_anti").withColumn("m", F.from_json("value", "event_id bigint, event_type string, value double"))
    return got.select("key", "m.event_id", "m.event_type", "m.value")


# ---- streams: run over the table to its end, then read what was written
#: Rows of a file that a stream reads: some 100 MB when kept in memory.
ROWS_A_FILE = 100_000


def _tmp(spark) -> str:
    return readers.scratch(spark, "stream")


def _source(spark, d):
    schema = V.t(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))


def _in_turn(spark, root: str, *parts, files: int = 8):
    """A stream that gets each part as a micro-batch of its own: every part is `files` files, and a batch takes as many, oldest first."""
    count = lambda: spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/in/part-*.parquet")
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for k, part in enumerate(parts):
        part.repartition(files).write.mode("append").parquet(f"{root}/in")
        while len(count().getFileSystem(conf).globStatus(count()) or []) < files * (k + 1):  # small parts leave some files out
            spark.createDataFrame([], part.schema).write.mode("append").parquet(f"{root}/in")
    return spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", files).parquet(f"{root}/in")


def _complete(df, root: str) -> None:
    q = df.writeStream.outputMode("complete").option("checkpointLocation", f"{root}/cp").trigger(availableNow=True).foreachBatch(lambda b, _: b.write.mode("overwrite").parquet(f"{root}/out")).start()
    q.awaitTermination()


@query("SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    """Daily tumbling windows; the table is rewritten with each batch, so open windows are there too."""
    root = _tmp(spark)
    _complete(flows.windowed_counts(_source(spark, d), "ts", ["event_type"], "1 day"), root)
    return spark.read.parquet(f"{root}/out")


@query("SELECT window_start::TIMESTAMP AS window_start, count(*) AS n FROM (SELECT unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS window_start FROM events) GROUP BY ALL")
def stream_sliding_counts(spark, d):
    root = _tmp(spark)
    _complete(flows.windowed_counts(_source(spark, d), "ts", [], "2 hours", "1 hour"), root)
    return spark.read.parquet(f"{root}/out")


_PASSED = "make_timestamp(1000 * (epoch_ms(max(ts)) - 172800000))"


@query(f"WITH early AS (SELECT {_PASSED} AS w FROM events WHERE event_type NOT IN ('error', 'purchase')), last AS (SELECT {_PASSED} AS w FROM events), k AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS window_start, event_type FROM events, early WHERE event_type <> 'error' OR date_trunc('hour', ts) + INTERVAL 1 HOUR > w) SELECT window_start, event_type, count(*) AS n FROM k, last WHERE window_start + INTERVAL 1 HOUR <= w GROUP BY ALL")
def stream_late_rows(spark, d):
    """Errors come last, two batches behind the rest: those of windows that the watermark (two days) has passed by then are dropped, the
    others count; windows are given out once, when the watermark has passed them. A batch drops by the watermark that the batch before
    it closed windows with, so purchases, which come second, all count."""
    root = _tmp(spark)
    e = V.t(spark, d, "events").select(F.col("ts").cast("timestamp"), "event_type")
    src = _in_turn(spark, root, e.filter("event_type not in ('error', 'purchase')"), e.filter("event_type = 'purchase'"), e.filter("event_type = 'error'"))
    flows.run_to_end(flows.windowed_counts(src, "ts", ["event_type"], "1 hour", late="2 days"), f"{root}/out", f"{root}/cp")
    return spark.read.schema("window_start timestamp, event_type string, n bigint").parquet(f"{root}/out")


@query("WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), n AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOUR AS session_end, count(*) AS n FROM n GROUP BY user_id, k")
def stream_sessions(spark, d):
    """Sessions of users, closed by six hours without events."""
    root = _tmp(spark)
    _complete(flows.session_counts(_source(spark, d), "ts", ["user_id"], "6 hours"), root)
    return spark.read.parquet(f"{root}/out")


@query("SELECT event_id, ts, user_id, event_type FROM events")
def stream_dedup(spark, d):
    """A feed that brings every event twice, in batches of their own: each comes out once, with all its columns."""
    root = _tmp(spark)
    e = V.t(spark, d, "events").select("event_id", F.col("ts").cast("timestamp"), "user_id", "event_type")
    flows.run_to_end(flows.deduplicated(_in_turn(spark, root, e.union(e.filter("event_type = 'view'")), e), ["event_id"], "ts", "400 days"), f"{root}/out", f"{root}/cp")
    return spark.read.schema(e.schema).parquet(f"{root}/out")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'dead' ELSE 'written' END AS outcome, CASE WHEN event_type = 'error' THEN 3 END AS attempts FROM events")
def stream_dead_letters(spark, d):
    """A sink that refuses batches with errors always, and those with clicks twice: three tries, then the dead letters; nothing is lost."""
    root = _tmp(spark)
    e = V.t(spark, d, "events").select("event_id", "event_type")
    tries: dict[int, int] = {}

    def sink(batch, number):
        tries[number] = tries.get(number, 0) + 1
        bad = [r["event_type"] for r in batch.select("event_type").distinct().collect()]  # a batch has one type here
        if "error" in bad or ("click" in bad and tries[number] < 3):
            raise RuntimeError("refused")
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    types = ["view", "click", "error"]
    parts = [e.filter(F.col("event_type") == t) for t in types] + [e.filter(~F.col("event_type").isin(types))]
    flows.run_batches(_in_turn(spark, root, *parts), flows.guarded(sink, f"{root}/dead"), f"{root}/cp")
    ok = spark.read.schema("event_id bigint, event_type string").parquet(f"{root}/out")
    dead = spark.read.schema("event_id bigint, event_type string, error string, attempts int").parquet(f"{root}/dead").filter("error = 'RuntimeError: refused'")
    return ok.select("event_id", F.lit("written").alias("outcome"), F.lit(None).cast("int").alias("attempts")).union(dead.select("event_id", F.lit("dead"), "attempts"))


_TIER = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 ELSE 3 END"
_LAY = f"layer_rows AS (SELECT event_id // 5 AS scan_id, {_TIER} AS tier, (event_id * 7919 % 1000) / 1e3 AS score, CAST(event_id // 5 % 3 + 1 AS INTEGER) AS terminal_tier, ts FROM events), last AS (SELECT scan_id, max(terminal_tier) AS t, max(ts) AS last_ts, {', '.join(f'max(struct_pack(a := ts, b := score)) FILTER (tier = {k}).b AS l{k}' for k in (1, 2, 3))} FROM layer_rows GROUP BY scan_id), p AS (SELECT *, l1 IS NOT NULL AND (t < 2 OR l2 IS NOT NULL) AND (t < 3 OR l3 IS NOT NULL) AS complete FROM last)"
_LAY = _LAY.replace("max(struct_pack(a := ts, b := score)) FILTER (tier = 1).b", "(max(struct_pack(a := ts, b := score)) FILTER (tier = 1)).b").replace("max(struct_pack(a := ts, b := score)) FILTER (tier = 2).b", "(max(struct_pack(a := ts, b := score)) FILTER (tier = 2)).b").replace("max(struct_pack(a := ts, b := score)) FILTER (tier = 3).b", "(max(struct_pack(a := ts, b := score)) FILTER (tier = 3)).b")


def _layers(df):
    k = F.col("event_id")
    tier = F.when(F.col("event_type") == "view", 1).when(F.col("event_type") == "click", 2).otherwise(3)
    return df.select(F.floor(k / 5).alias("scan_id"), tier.alias("tier"), ((k * 7919 % 1000) / F.lit(1000.0)).alias("score"), (F.floor(k / 5) % 3 + 1).cast("int").alias("terminal_tier"), "ts")


@query("WITH " + _LAY + " SELECT scan_id, l1, l2, l3, last_ts, complete FROM p, (SELECT epoch_ms(max(ts)) - 3600000 AS w FROM events) WHERE complete OR epoch_ms(last_ts) + 3600000 < w")
def stream_correlator(spark, d):
    """Scans come out once, with all scores: at their terminal tier, or incomplete when the watermark has passed their timeout. Those that may
    still become complete stay in the state."""
    root = _tmp(spark)
    flows.run_to_end(flows.correlate_grouped(_layers(_source(spark, d)), "1 hour"), f"{root}/out", f"{root}/cp")
    return spark.read.schema(flows.OUT).parquet(f"{root}/out")


@query("WITH " + _LAY + " SELECT scan_id, l1, l2, l3, complete FROM p")
def batch_correlator(spark, d):
    return flows.correlate_batch(_layers(V.t(spark, d, "events"))).select("scan_id", "l1", "l2", "l3", "complete")


@query(BASE + "SELECT 'audit' AS record, scan_id, verdict FROM scored UNION ALL SELECT 'statements', scan_id, verdict FROM scored WHERE verdict <> 'ALLOW' UNION ALL SELECT 'manifests', scan_id, verdict FROM scored WHERE verdict <> 'ALLOW'")
def stream_fanout(spark, d):
    """Verdicts fan out to three record tables in each micro-batch, with the same functions as in batch."""
    root = _tmp(spark)
    scans = V.scan_facts(spark, d)
    scans.write.option("maxRecordsPerFile", ROWS_A_FILE).parquet(f"{root}/in")  # a task reads two files or so, and a batch as many as keep all cores busy
    src = scoring.risk_score(readers.stream(spark, f"{root}/in", scans.schema, per_trigger=2 * spark.sparkContext.defaultParallelism))
    sinks = {"audit": compliance.audit_log, "statements": lambda s: compliance.statements(s).join(s.select("scan_id", "verdict"), "scan_id"), "manifests": compliance.manifests}
    flows.run_batches(src, flows.fan_out(sinks, f"{root}/out"), f"{root}/cp")
    out = None
    for name in sinks:
        one = spark.read.parquet(f"{root}/out/{name}")
        one = one.select(F.lit(name).alias("record"), "scan_id", (F.col("verdict") if "verdict" in one.columns else F.col("decision")).alias("verdict"))
        out = one if out is None else out.union(one)
    return out


@query("SELECT a.event_id // 2 AS scan_id, a.value AS l1, b.value AS l2 FROM events a JOIN events b ON a.event_id // 2 = b.event_id // 2 AND a.event_id % 2 = 0 AND b.event_id % 2 = 1 AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 300000000")
def stream_join(spark, d):
    """Two layers of a scan joined as streams, within an interval that bounds the state."""
    root = _tmp(spark)
    s = _source(spark, d).select(F.floor(F.col("event_id") / 2).alias("scan_id"), (F.col("event_id") % 2).alias("side"), "value", "ts")
    one = lambda k, v, t: s.filter(F.col("side") == k).select("scan_id", F.col("value").alias(v), F.col("ts").alias(t)).withWatermark(t, "1 hour")
    flows.run_to_end(flows.join_layers(one(0, "l1", "t1"), one(1, "l2", "t2"), "t1", "t2", "5 minutes").select("scan_id", "l1", "l2"), f"{root}/out", f"{root}/cp")
    return spark.read.schema("scan_id bigint, l1 double, l2 double").parquet(f"{root}/out")
