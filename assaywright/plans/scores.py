"""Queries over scores, reasons, policies and roll-ups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.numeric import mean6, micro
from ..operators import analytics, ensemble, policy, scoring
from ..schemas import MODELS
from . import views as V
from .registry import query

BASE = V.with_(V.SCAN_FACTS, V.SCORED)
_M6 = lambda x: f"sum(CAST(floor({x} * 1e6 + 5e-1) AS BIGINT)) / CAST(count({x}) AS DOUBLE) / 1e6"
_N = lambda cond: f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def scored(spark, d, reasons: bool = False):
    return scoring.risk_score(V.scan_facts(spark, d), reasons=reasons)


@query(BASE + f"SELECT tenant_id, date_trunc('hour', ts) AS period, verdict, count(*) AS scan_count, {_M6('risk_score')} AS avg_risk_score, {_M6('duration_ms')} AS avg_duration_ms, CAST(sum(CAST(floor(risk_score * 1e6 + 5e-1) AS BIGINT)) AS BIGINT) AS risk_micro FROM scored GROUP BY ALL")
def flagship_risk_rollup(spark, d):
    return analytics.verdict_rollup(scored(spark, d), "hour", F.sum(micro("risk_score")).alias("risk_micro"))


@query(BASE + f"SELECT tenant_id, date_trunc('hour', ts) AS period, verdict, count(*) AS scan_count, {_M6('risk_score')} AS avg_risk_score, {_M6('duration_ms')} AS avg_duration_ms FROM scored GROUP BY ALL")
def hourly_verdict_stats(spark, d):
    """From additive parts, as a maintained table would be: two halves are merged and finalised."""
    s = scored(spark, d)
    return analytics.finalise(analytics.merge_state(analytics.additive_state(s.filter("scan_id % 2 = 0"), "hour"), analytics.additive_state(s.filter("scan_id % 2 = 1"), "hour")))


LONG = """long_form AS (
  SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L1' AS tier, 'metadata' AS model, metadata AS score FROM scored
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L2', 'biometric', rppg FROM scored WHERE has_l2
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L3', 'vit_general', vit FROM scored WHERE has_l3
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L3', 'efficientnet_gan', gan FROM scored WHERE has_l3
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L3', 'tcn_temporal', tcn FROM scored WHERE has_l3
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L3', 'diffusion_artifact', diffusion FROM scored WHERE has_l3
  UNION ALL SELECT scan_id, tenant_id, ts, verdict, duration_ms, 'L3', 'lipsync_mismatch', lipsync FROM scored WHERE has_l3)"""
BASE_LONG = V.with_(V.SCAN_FACTS, V.SCORED, LONG)


@query(BASE_LONG + f"SELECT tenant_id, date_trunc('day', ts)::TIMESTAMP AS day, tier, model, count(*) AS n, {_M6('score')} AS avg_score, {_M6('duration_ms')} AS avg_duration_ms FROM long_form GROUP BY ALL")
def daily_detection_stats(spark, d):
    return analytics.long_form(scored(spark, d)).groupBy("tenant_id", F.date_trunc("day", "ts").alias("day"), "tier", "model").agg(F.count("*").alias("n"), mean6("score").alias("avg_score"), mean6("duration_ms").alias("avg_duration_ms"))


@query(BASE + f"SELECT tenant_id, date_trunc('hour', ts) AS period, verdict, count(*) AS scan_count, {_M6('risk_score')} AS avg_risk_score, {_M6('duration_ms')} AS avg_duration_ms, {_N('has_l3')} AS l3_count, {_N('public_figure')} AS public_figure_count FROM scored GROUP BY ALL")
def hourly_extended(spark, d):
    return analytics.verdict_rollup(scored(spark, d), "hour", F.count_if(F.col("l3").isNotNull()).alias("l3_count"), F.count_if(F.col("ctx.public_figure_detected")).alias("public_figure_count"))


ACC = f"""acc AS (SELECT date_trunc('day', ts)::TIMESTAMP AS day, model, {_N("score > 5e-1 AND verdict = 'BLOCK'")} AS tp, {_N("score > 5e-1 AND verdict = 'ALLOW'")} AS fp, {_N("score <= 5e-1 AND verdict = 'BLOCK'")} AS fn, {_N("score <= 5e-1 AND verdict = 'ALLOW'")} AS tn FROM long_form WHERE tier = 'L3' GROUP BY ALL)"""
BASE_ACC = V.with_(V.SCAN_FACTS, V.SCORED, LONG, ACC)


def daily_accuracy(spark, d):
    return analytics.model_accuracy(analytics.long_form(scored(spark, d)))


@query(BASE_ACC + "SELECT * FROM acc")
def model_accuracy_daily(spark, d):
    return daily_accuracy(spark, d)


_R = lambda a, b: f"CAST({a} AS DOUBLE) / nullif({b}, 0)"


@query(BASE_ACC + f"SELECT *, {_R('tp', 'tp + fn')} AS recall, {_R('tp', 'tp + fp')} AS precision, {_R('2 * tp', '2 * tp + fp + fn')} AS f1, {_R('fp', 'fp + tn')} AS fpr, {_R('fn', 'fn + tp')} AS fnr FROM acc WHERE day > TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY")
def model_prf(spark, d):
    return analytics.with_rates(daily_accuracy(spark, d).filter(F.col("day") > V.as_of() - F.make_dt_interval(F.lit(30))))


@query(BASE_ACC + "SELECT day, model, CAST(sum(tp + tn) OVER w AS DOUBLE) / nullif(sum(tp + fp + fn + tn) OVER w, 0) AS accuracy_7d, CAST(sum(tp + fp + fn + tn) OVER w AS BIGINT) AS scans_7d FROM acc WINDOW w AS (PARTITION BY model ORDER BY day RANGE BETWEEN INTERVAL 6 DAY PRECEDING AND CURRENT ROW)")
def rolling_accuracy(spark, d):
    return analytics.rolling_accuracy(daily_accuracy(spark, d))


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.TENANTS) + f"SELECT tenant_name, verdict, count(*) AS scan_count, {_M6('risk_score')} AS avg_score, {_M6('duration_ms')} AS avg_latency FROM scored JOIN tenants USING (tenant_id) WHERE ts > TIMESTAMP '{V.AS_OF}' - INTERVAL 24 HOUR GROUP BY ALL")
def tenant_volume(spark, d):
    return analytics.tenant_volume(scored(spark, d), V.tenants(spark, d), V.as_of() - F.make_dt_interval(F.lit(1)))


BASE_R = V.with_(V.SCAN_FACTS, V.SCORED, V.REASONS)


@query(BASE_R + f"SELECT code AS reason_code, count(*) AS occurrence_count, {_M6('risk_score')} AS avg_score, {_M6('confidence')} AS avg_confidence FROM reasons WHERE ts > TIMESTAMP '{V.AS_OF}' - INTERVAL 7 DAY AND verdict IN ('FLAG', 'BLOCK') GROUP BY ALL ORDER BY occurrence_count DESC, reason_code LIMIT 20")
def top_reason_codes(spark, d):
    return analytics.top_reasons(scored(spark, d, True), V.as_of() - F.make_dt_interval(F.lit(7)))


VB, VF, VA = "verdict = 'BLOCK'", "verdict = 'FLAG'", "verdict = 'ALLOW'"
TO_ALLOW, TO_BLOCK = "original_verdict <> new_verdict AND new_verdict = 'ALLOW'", "original_verdict <> new_verdict AND new_verdict = 'BLOCK'"


@query(BASE + f"SELECT date_trunc('hour', ts) AS period, {_N(VB)} AS blocks, {_N(VF)} AS flags, {_N(VA)} AS allows, count(*) AS total, CAST({_N(VB)} AS DOUBLE) / count(*) AS block_rate FROM scored WHERE ts > TIMESTAMP '{V.AS_OF}' - INTERVAL 48 HOUR GROUP BY ALL")
def hourly_trend_block_rate(spark, d):
    return analytics.trend(scored(spark, d).filter(F.col("ts") > V.as_of() - F.make_dt_interval(F.lit(2))))


def _series(unit: str) -> str:
    return BASE + f"SELECT date_trunc('{unit}', ts)::TIMESTAMP AS period, {_N(VB)} AS blocks, {_N(VF)} AS flags, {_N(VA)} AS allows, count(*) AS total, CAST({_N(VB)} AS DOUBLE) / count(*) AS block_rate FROM scored GROUP BY ALL"


@query(_series("day"))
def analytics_daily_series(spark, d):
    return analytics.trend(scored(spark, d), "day")


@query(_series("week"))
def analytics_weekly_series(spark, d):
    return analytics.trend(scored(spark, d), "week")


@query(_series("month"))
def analytics_monthly_series(spark, d):
    return analytics.trend(scored(spark, d), "month")


@query(BASE + "SELECT verdict, count(*) AS n FROM scored GROUP BY ALL")
def verdict_distribution(spark, d):
    return scored(spark, d).groupBy("verdict").agg(F.count("*").alias("n"))


@query(BASE + f"SELECT {_M6('duration_ms')} AS avg_latency_ms, floor(quantile_cont(duration_ms, 5e-1) * 1e6 + 5e-1) / 1e6 AS p50_latency_ms, floor(quantile_cont(duration_ms, 99e-2) * 1e6 + 5e-1) / 1e6 AS p99_latency_ms, CAST({_N('has_l3')} AS DOUBLE) / count(*) AS l3_usage_rate FROM scored")
def performance_metrics(spark, d):
    return analytics.performance(scored(spark, d))


_ATT = f"{_N('is_fake AND detected')} AS tp, {_N('is_fake AND NOT detected')} AS fn, {_N('NOT is_fake AND NOT detected')} AS tn, {_N('NOT is_fake AND detected')} AS fp"
_RATES = f"{_R('tp', 'tp + fn')} AS detection_rate, {_R('fn', 'tp + fn')} AS evasion_rate"


@query(V.with_(V.SAMPLES) + f"SELECT *, {_RATES} FROM (SELECT category, {_ATT}, CAST(grouping(category) AS INTEGER) AS overall FROM samples GROUP BY GROUPING SETS ((category), ()))")
def attack_report(spark, d):
    return analytics.attack_report(V.samples(spark, d))


@query(BASE + f"SELECT count(*) AS l1_scans, {_N('has_l2')} AS l2_scans, {_N('has_l3')} AS l3_scans, {_N(VB)} AS blocked, CAST({_N('has_l2')} AS DOUBLE) / count(*) AS l2_rate, CAST({_N('has_l3')} AS DOUBLE) / count(*) AS l3_rate, CAST({_N(VB)} AS DOUBLE) / count(*) AS block_rate FROM scored")
def detection_funnel(spark, d):
    return analytics.funnel(scored(spark, d))


BASE_A = V.with_(V.SCAN_FACTS, V.SCORED, V.ACTIONS)


@query(BASE_A + f"SELECT reviewer_id, count(*) AS reviews, {_N(TO_ALLOW)} AS overrides_to_allow, {_N(TO_BLOCK)} AS overrides_to_block, {_M6('review_seconds')} AS avg_review_seconds FROM actions GROUP BY ALL")
def reviewer_stats(spark, d):
    return analytics.reviewer_stats(V.actions(spark, d))


@query(V.with_(V.SAMPLES) + f"SELECT count(*) AS groups, min(a) AS lowest, max(a) AS highest, max(a) - min(a) AS gap, max(a) - min(a) > 5e-2 AS biased FROM (SELECT lang, CAST({_N('is_fake = detected')} AS DOUBLE) / count(*) AS a FROM samples GROUP BY lang)")
def bias_gap(spark, d):
    return analytics.bias_gap(V.samples(spark, d), "lang")


@query(BASE_A + f", months AS (SELECT date_trunc('month', ts)::TIMESTAMP AS month, count(*) AS total, {_N(VB)} AS blocked, {_N(VF)} AS flagged, count(DISTINCT tenant_id) AS tenants_active FROM scored GROUP BY ALL), rev AS (SELECT date_trunc('month', s.ts)::TIMESTAMP AS month, count(*) AS reviewed, {_N('original_verdict <> new_verdict')} AS overridden FROM actions a JOIN scored s ON a.scan_id = s.scan_id GROUP BY ALL) SELECT months.*, reviewed, overridden FROM months JOIN rev USING (month)")
def ai_monthly_report(spark, d):
    s = scored(spark, d)
    months = s.groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("total"), F.count_if(F.col("verdict") == "BLOCK").alias("blocked"), F.count_if(F.col("verdict") == "FLAG").alias("flagged"), F.count_distinct("tenant_id").alias("tenants_active"))
    rev = V.actions(spark, d).join(s.select("scan_id", "ts"), "scan_id").groupBy(F.date_trunc("month", "ts").alias("month")).agg(F.count("*").alias("reviewed"), F.count_if(F.col("original_verdict") != F.col("new_verdict")).alias("overridden"))
    return months.join(rev, "month")


@query(BASE + "SELECT scan_id, l1_score FROM scored")
def l1_composite(spark, d):
    return V.scan_facts(spark, d).select("scan_id", scoring.l1_composite(F.col("l1")).alias("l1_score"))


@query(BASE + "SELECT scan_id, l2_score FROM scored")
def l2_composite(spark, d):
    return V.scan_facts(spark, d).select("scan_id", scoring.l2_composite(F.col("l2")).alias("l2_score"))


@query(BASE + "SELECT scan_id, l3_score FROM scored")
def l3_composite(spark, d):
    return V.scan_facts(spark, d).select("scan_id", scoring.l3_composite(F.col("l3")).alias("l3_score"))


@query(BASE + "SELECT scan_id, context_multiplier FROM scored")
def context_multiplier(spark, d):
    return V.scan_facts(spark, d).select("scan_id", scoring.context_multiplier(F.col("ctx")).alias("context_multiplier"))


@query(BASE + "SELECT scan_id, base_score, risk_score, verdict FROM scored")
def risk_score(spark, d):
    return scored(spark, d).select("scan_id", "base_score", "risk_score", "verdict")


@query(BASE_R + "SELECT scan_id, code, category, explanation, confidence FROM reasons")
def reason_codes(spark, d):
    return scored(spark, d, True).select("scan_id", F.explode("reason_codes").alias("r")).select("scan_id", "r.code", "r.category", "r.explanation", "r.confidence")


BASE_P = V.with_(V.SCAN_FACTS, V.SCORED, V.POLICIES)
_FORCE = "policies AS p ON p.tenant_id = s.tenant_id AND p.version = 2"
_TH = lambda a="p.": f"coalesce({a}allow_max, 3e-1) AS allow_max, coalesce({a}flag_max, 6e-1) AS flag_max, coalesce({a}flag_urgent_max, 85e-2) AS flag_urgent_max, coalesce({a}auto_block_known_hash, true) AS auto_block"
LOOKED = f"looked AS (SELECT s.*, {_TH()} FROM scored s LEFT JOIN {_FORCE}), remapped AS (SELECT *, CASE WHEN risk_score < allow_max THEN 'ALLOW' WHEN risk_score < flag_max THEN 'FLAG' WHEN risk_score < flag_urgent_max THEN 'FLAG_URGENT' ELSE 'BLOCK' END AS v FROM looked)"


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.POLICIES, LOOKED) + "SELECT scan_id, tenant_id, allow_max, flag_max, flag_urgent_max, v AS tenant_verdict FROM remapped")
def policy_lookup(spark, d):
    got = policy.lookup(scored(spark, d), policy.current(V.policies(spark, d), V.as_of()))
    return got.select("scan_id", "tenant_id", "allow_max", "flag_max", "flag_urgent_max", scoring.verdict(F.col("risk_score"), F.col("allow_max"), F.col("flag_max"), F.col("flag_urgent_max")).alias("tenant_verdict"))


@query(BASE_P + "SELECT s.scan_id, s.tenant_id, p.version, p.flag_max FROM scored s LEFT JOIN policies p ON p.tenant_id = s.tenant_id AND s.ts >= p.effective_from AND (p.effective_until IS NULL OR s.ts < p.effective_until)")
def policy_asof(spark, d):
    return policy.as_of(scored(spark, d), V.policies(spark, d)).select("scan_id", "tenant_id", "version", "flag_max")


@query(BASE_P + "SELECT tenant_id, version, flag_max FROM policies QUALIFY row_number() OVER (PARTITION BY tenant_id ORDER BY version DESC) = 1")
def policy_latest(spark, d):
    return policy.latest(V.policies(spark, d)).select("tenant_id", "version", "flag_max")


RULES = [
    policy.RuleSet(1, (policy.Rule("ESCALATE_GAN", policy.ReasonCodePresent(("L3_GAN_DETECTION",)), "FLAG_URGENT", "POLICY_GAN", "GAN artifacts are reviewed at once"), policy.Rule("LOW", policy.ScoreBelow(0.5), "ALLOW", "POLICY_LOW", "Low scores pass"))),
    policy.RuleSet(2, (policy.Rule("HIGH_CONTEXT", policy.AllOf((policy.ScoreAbove(0.6), policy.ContextMultiplierAbove(1.2))), "BLOCK", "POLICY_CONTEXT", "High score in a sensitive context"), policy.Rule("NEVER", policy.AnyOf(()), "ALLOW", "X", "x"))),
    policy.RuleSet(3, (policy.Rule("NEURAL", policy.AnyOf((policy.CategoryPresent("L3_NEURAL"), policy.ScoreAbove(0.9))), "FLAG_URGENT", "POLICY_NEURAL", "Neural findings are reviewed"),)),
    policy.RuleSet(4, (policy.Rule("ALWAYS", policy.AllOf(()), "FLAG", "POLICY_ALL", "Everything is reviewed"),)),
]
RULED = """ruled AS (
  SELECT r.*, coalesce(codes, '') AS codes, CASE WHEN tenant_id = 1 AND list_contains(string_split(codes, ','), 'L3_GAN_DETECTION') THEN 'ESCALATE_GAN' WHEN tenant_id = 1 AND risk_score < 5e-1 THEN 'LOW'
    WHEN tenant_id = 2 AND risk_score > 6e-1 AND context_multiplier > 12e-1 THEN 'HIGH_CONTEXT' WHEN tenant_id = 3 AND (contains(codes, 'L3_') OR risk_score > 9e-1) THEN 'NEURAL' WHEN tenant_id = 4 THEN 'ALWAYS' END AS rule
  FROM remapped r LEFT JOIN coded USING (scan_id)),
acted AS (SELECT *, CASE rule WHEN 'ESCALATE_GAN' THEN 'FLAG_URGENT' WHEN 'LOW' THEN 'ALLOW' WHEN 'HIGH_CONTEXT' THEN 'BLOCK' WHEN 'NEURAL' THEN 'FLAG_URGENT' WHEN 'ALWAYS' THEN 'FLAG' ELSE v END AS v2,
    CASE rule WHEN 'ESCALATE_GAN' THEN 'POLICY_GAN' WHEN 'LOW' THEN 'POLICY_LOW' WHEN 'HIGH_CONTEXT' THEN 'POLICY_CONTEXT' WHEN 'NEURAL' THEN 'POLICY_NEURAL' WHEN 'ALWAYS' THEN 'POLICY_ALL' END AS added FROM ruled)"""


@query(V.with_(V.SCAN_FACTS, V.SCORED, V.REASONS, V.POLICIES, LOOKED, RULED) + "SELECT scan_id, tenant_id, CASE WHEN auto_block AND hash_match AND v2 <> 'BLOCK' THEN 'BLOCK' ELSE v2 END AS verdict, CASE WHEN auto_block AND hash_match AND v2 <> 'BLOCK' THEN 'AUTO_BLOCK_KNOWN_HASH' ELSE rule END AS override_rule_id, concat_ws(',', nullif(codes, ''), added, CASE WHEN auto_block AND hash_match AND v2 <> 'BLOCK' THEN 'POLICY_AUTO_BLOCK_HASH' END) AS codes FROM acted")
def policy_rules(spark, d):
    got = policy.apply_policy(policy.lookup(scored(spark, d, True), policy.current(V.policies(spark, d), V.as_of())), RULES)
    return got.select("scan_id", "tenant_id", "verdict", "override_rule_id", F.array_join(F.transform("reason_codes", lambda r: r["code"]), ",").alias("codes"))


CUSTOM = [(1, "r1", "GEOGRAPHIC", "eu-west-1", "FLAG", 5, True), (1, "r2", "THRESHOLD_OVERRIDE", "0.7", "BLOCK", 1, True), (2, "r3", "ALLOWLIST", "click", "ALLOW", 1, True), (2, "r4", "BLOCKLIST", "error", "BLOCK", 2, True), (3, "r5", "THRESHOLD_OVERRIDE", "0.1", "BLOCK", 1, False)]


@query(BASE + """, m AS (SELECT scan_id, rule_id, v FROM (SELECT s.scan_id, x.*, row_number() OVER (PARTITION BY s.scan_id ORDER BY priority, rule_id) AS k FROM scored s JOIN (VALUES (1, 'r1', 'GEOGRAPHIC', 'eu-west-1', 'FLAG', 5), (1, 'r2', 'THRESHOLD_OVERRIDE', '0.7', 'BLOCK', 1), (2, 'r3', 'ALLOWLIST', 'click', 'ALLOW', 1), (2, 'r4', 'BLOCKLIST', 'error', 'BLOCK', 2)) x(t, rule_id, kind, value, v, priority)
  ON s.tenant_id = t AND CASE WHEN kind IN ('ALLOWLIST', 'BLOCKLIST') THEN event_type = value WHEN kind = 'GEOGRAPHIC' THEN region = value ELSE risk_score >= try_cast(value AS DOUBLE) END) WHERE k = 1)
SELECT s.scan_id, m.rule_id, coalesce(m.v, s.verdict) AS final_verdict FROM scored s LEFT JOIN m ON m.scan_id = s.scan_id""")
def policy_custom_rules(spark, d):
    rules = spark.createDataFrame(CUSTOM, "tenant_id int, rule_id string, rule_type string, value string, verdict string, priority int, enabled boolean")
    return policy.custom_rules(scored(spark, d).withColumn("source", F.col("event_type")), rules).select("scan_id", "rule_id", "final_verdict")


SIM = [("strict", scoring.Thresholds(0.2, 0.5, 0.75)), ("loose", scoring.Thresholds(0.4, 0.7, 0.95))]


@query(BASE + "SELECT candidate, verdict AS old_verdict, CASE WHEN risk_score < a THEN 'ALLOW' WHEN risk_score < b THEN 'FLAG' WHEN risk_score < c THEN 'FLAG_URGENT' ELSE 'BLOCK' END AS new_verdict, count(*) AS scans FROM scored, (VALUES ('strict', 2e-1, 5e-1, 75e-2), ('loose', 4e-1, 7e-1, 95e-2)) x(candidate, a, b, c) GROUP BY ALL")
def policy_simulation(spark, d):
    return policy.simulate(scored(spark, d), SIM)


@query(BASE_P + "SELECT tenant_id, version, lag(flag_max) OVER (PARTITION BY tenant_id ORDER BY version) AS old_flag_max, flag_max AS new_flag_max, 'POLICY_CHANGE' AS event_class, 3650 AS retention_days FROM policies")
def policy_audit_trail(spark, d):
    return policy.versions_before(V.policies(spark, d))


@query(V.with_(V.SCAN_FACTS) + "SELECT scan_id, floor((vit * 3e-1 + gan * 25e-2 + tcn * 2e-1 + diffusion * 15e-2 + lipsync * 1e-1) / 1e0 * 1e6 + 5e-1) / 1e6 AS ensemble_score, floor(greatest(p, 1 - p) * 1e4 + 5e-1) / 1e4 AS model_agreement_ratio FROM (SELECT *, (CAST(vit > 5e-1 AS INTEGER) + CAST(gan > 5e-1 AS INTEGER) + CAST(tcn > 5e-1 AS INTEGER) + CAST(diffusion > 5e-1 AS INTEGER) + CAST(lipsync > 5e-1 AS INTEGER)) / 5e0 AS p FROM scan_facts WHERE has_l3)")
def ensemble_scores(spark, d):
    s = V.scan_facts(spark, d).filter("l3 is not null").select("scan_id", F.struct(*[F.col(f"l3.{m}_score").alias(m) for m in MODELS]).alias("s"))
    return ensemble.ensemble_wide(s).select("scan_id", "ensemble_score", "model_agreement_ratio")


@query(BASE_LONG + "SELECT scan_id, floor(CAST(sum(CAST(floor(w * score * 1e9 + 5e-1) AS BIGINT)) AS DOUBLE) / CAST(sum(CAST(floor(w * 1e9 + 5e-1) AS BIGINT)) AS DOUBLE) * 1e6 + 5e-1) / 1e6 AS ensemble_score, floor(greatest(avg(CAST(score > 5e-1 AS INTEGER)), 1 - avg(CAST(score > 5e-1 AS INTEGER))) * 1e4 + 5e-1) / 1e4 AS model_agreement_ratio, count(*) AS models, greatest(avg(CAST(score > 5e-1 AS INTEGER)), 1 - avg(CAST(score > 5e-1 AS INTEGER))) < 6e-1 AS low_agreement FROM (SELECT *, CASE model WHEN 'vit_general' THEN 3e-1 WHEN 'efficientnet_gan' THEN 25e-2 WHEN 'tcn_temporal' THEN 2e-1 WHEN 'diffusion_artifact' THEN 15e-2 ELSE 1e-1 END AS w FROM long_form WHERE tier = 'L3') GROUP BY scan_id")
def ensemble_from_rows(spark, d):
    return ensemble.ensemble_long(analytics.long_form(scored(spark, d)).filter("tier = 'L3'").select("scan_id", "model", "score"), "scan_id")


@query(BASE + f"SELECT scan_id, tenant_id, ts, risk_score FROM scored WHERE verdict IN ('FLAG', 'FLAG_URGENT') AND risk_score >= 4e-1 AND risk_score <= 8e-1 AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND scan_id NOT IN (SELECT scan_id FROM scored WHERE scan_id % 3 = 0)")
def dashboard_flagged(spark, d):
    s = analytics.dashboard_filter(scored(spark, d), ("FLAG", "FLAG_URGENT"), 0.4, 0.8, F.lit("2024-01-05").cast("timestamp"), F.lit("2024-01-20").cast("timestamp"))
    return analytics.pending_review(s, V.actions(spark, d)).select("scan_id", "tenant_id", "ts", "risk_score")


@query(BASE + "SELECT scan_id, ts, verdict FROM scored WHERE ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND scan_id > 0) ORDER BY ts, scan_id LIMIT 50")
def keyset_page(spark, d):
    import datetime

    return analytics.page(scored(spark, d).select("scan_id", "ts", "verdict"), 50, (datetime.datetime(2024, 1, 10), 0))


@query(BASE + "SELECT scan_id, ts, verdict, (SELECT count(*) FROM scored WHERE verdict <> 'ALLOW') AS total_count FROM scored WHERE verdict <> 'ALLOW' AND (ts > TIMESTAMP '2024-01-10' OR (ts = TIMESTAMP '2024-01-10' AND scan_id > 0)) ORDER BY ts, scan_id LIMIT 50")
def page_with_total(spark, d):
    """A page with the number of rows over all pages."""
    import datetime

    flagged = scored(spark, d).filter("verdict <> 'ALLOW'").select("scan_id", "ts", "verdict")
    return analytics.page_with_total(flagged, 50, (datetime.datetime(2024, 1, 10), 0))


@query(BASE + "SELECT scan_id, verdict, risk_score FROM scored WHERE verdict IN ('BLOCK', 'FLAG_URGENT') AND risk_score >= 7e-1")
def verdict_stream_filter(spark, d):
    return analytics.dashboard_filter(scored(spark, d), ("BLOCK", "FLAG_URGENT"), 0.7).select("scan_id", "verdict", "risk_score")


@query(BASE_A + "SELECT s.scan_id, s.verdict, a.new_verdict, a.scan_id IS NOT NULL AS reviewed FROM scored s LEFT JOIN actions a ON a.scan_id = s.scan_id")
def review_history(spark, d):
    a = V.actions(spark, d).select("scan_id", "new_verdict", F.lit(True).alias("_r"))
    return scored(spark, d).join(a, "scan_id", "left").select("scan_id", "verdict", "new_verdict", F.coalesce("_r", F.lit(False)).alias("reviewed"))
