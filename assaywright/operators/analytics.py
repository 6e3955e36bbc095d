"""Roll-ups, accuracy and dashboard answers. Means are kept as exact sums and counts, so parts of an aggregate can be merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean6, micro, round_to, share
from ..schemas import MODELS


def verdict_rollup(df: DataFrame, unit: str, *more: Column) -> DataFrame:
    """By tenant, time unit and verdict: scans, mean risk and duration, and further aggregates."""
    return df.groupBy("tenant_id", F.date_trunc(unit, "ts").alias("period"), "verdict").agg(F.count("*").alias("scan_count"), mean6("risk_score").alias("avg_risk_score"), mean6("duration_ms").alias("avg_duration_ms"), *more)


def additive_state(df: DataFrame, unit: str) -> DataFrame:
    """What a materialised roll-up stores: counts and sums, never means."""
    return df.groupBy("tenant_id", F.date_trunc(unit, "ts").alias("period"), "verdict").agg(F.count("*").alias("n"), F.sum(micro("risk_score")).alias("risk_micro"), F.sum(micro("duration_ms")).alias("duration_micro"))


def merge_state(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("tenant_id", "period", "verdict").agg(F.sum("n").alias("n"), F.sum("risk_micro").alias("risk_micro"), F.sum("duration_micro").alias("duration_micro"))


def finalise(state: DataFrame) -> DataFrame:
    return state.select("tenant_id", "period", "verdict", F.col("n").alias("scan_count"), (F.col("risk_micro") / F.col("n") / 1e6).alias("avg_risk_score"), (F.col("duration_micro") / F.col("n") / 1e6).alias("avg_duration_ms"))


def long_form(df: DataFrame) -> DataFrame:
    """One row for each tier and model of a scan: (tenant_id, ts, tier, model, score, duration_ms)."""
    one = lambda layer, tier, model, score: F.when(F.col(layer).isNotNull(), F.struct(F.lit(tier).alias("tier"), F.lit(model).alias("model"), score.cast("double").alias("score")))
    parts = [one("l1", "L1", "metadata", F.col("l1.metadata_anomaly_score")), one("l2", "L2", "biometric", F.col("l2.rppg_absence_score"))]
    parts += [one("l3", "L3", m, F.col(f"l3.{m}_score")) for m in MODELS]
    return df.select("scan_id", "tenant_id", "ts", "verdict", "duration_ms", F.explode(F.array_compact(F.array(*parts))).alias("p")).select("scan_id", "tenant_id", "ts", "verdict", "duration_ms", "p.tier", "p.model", "p.score")


def detection_state(df: DataFrame) -> DataFrame:
    """What a daily roll-up of detections stores: counts and sums by tenant, day, tier and model."""
    by = long_form(df).groupBy("tenant_id", F.date_trunc("day", "ts").alias("period"), "tier", "model")
    return by.agg(F.count("*").alias("n"), F.count("score").alias("scored"), F.sum(micro("score")).alias("score_micro"), F.count("duration_ms").alias("timed"), F.sum(micro("duration_ms")).alias("duration_micro"))


def detection_means(state: DataFrame) -> DataFrame:
    return state.select("tenant_id", F.col("period").alias("day"), "tier", "model", "n", (F.col("score_micro") / F.col("scored") / 1e6).alias("avg_score"), (F.col("duration_micro") / F.col("timed") / 1e6).alias("avg_duration_ms"))


def model_accuracy(long: DataFrame, unit: str = "day") -> DataFrame:
    """By day and model of the third layer: hits against BLOCK and ALLOW verdicts at one half."""
    s, v = F.col("score") > 0.5, F.col("verdict")
    return long.filter("tier = 'L3'").groupBy(F.date_trunc(unit, "ts").alias("day"), "model").agg(F.count_if(s & (v == "BLOCK")).alias("tp"), F.count_if(s & (v == "ALLOW")).alias("fp"), F.count_if(~s & (v == "BLOCK")).alias("fn"), F.count_if(~s & (v == "ALLOW")).alias("tn"))


def with_rates(df: DataFrame) -> DataFrame:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return df.withColumns({"recall": share(tp, tp + fn), "precision": share(tp, tp + fp), "f1": share(2 * tp, 2 * tp + fp + fn), "fpr": share(fp, fp + tn), "fnr": share(fn, fn + tp)})


def tenant_volume(df: DataFrame, tenants: DataFrame, since: Column) -> DataFrame:
    """By tenant name and verdict after `since`. Aggregates by id first, so names are joined to groups and not to scans."""
    g = df.filter(F.col("ts") > since).groupBy("tenant_id", "verdict").agg(F.count("*").alias("scan_count"), F.sum(micro("risk_score")).alias("r"), F.sum(micro("duration_ms")).alias("d"))
    return g.join(tenants.select("tenant_id", "tenant_name"), "tenant_id").groupBy("tenant_name", "verdict").agg(F.sum("scan_count").alias("scan_count"), (F.sum("r") / F.sum("scan_count") / 1e6).alias("avg_score"), (F.sum("d") / F.sum("scan_count") / 1e6).alias("avg_latency"))


def top_reasons(df: DataFrame, since: Column, n: int = 20, verdicts: tuple[str, ...] = ("FLAG", "BLOCK")) -> DataFrame:
    """The n most frequent reason codes; equal counts in order of the code."""
    rows = df.filter((F.col("ts") > since) & F.col("verdict").isin(*verdicts)).select("risk_score", F.explode("reason_codes").alias("r"))
    return rows.groupBy(F.col("r.code").alias("reason_code")).agg(F.count("*").alias("occurrence_count"), mean6("risk_score").alias("avg_score"), mean6("r.confidence").alias("avg_confidence")).orderBy(F.desc("occurrence_count"), "reason_code").limit(n)


def trend(df: DataFrame, unit: str = "hour") -> DataFrame:
    n = lambda v: F.count_if(F.col("verdict") == v)
    return df.groupBy(F.date_trunc(unit, "ts").alias("period")).agg(n("BLOCK").alias("blocks"), n("FLAG").alias("flags"), n("ALLOW").alias("allows"), F.count("*").alias("total"), share(n("BLOCK"), F.count("*")).alias("block_rate"))


def performance(df: DataFrame) -> DataFrame:
    """Mean, median and 99th percentile latency and the share of scans that reached the third layer."""
    return df.agg(mean6("duration_ms").alias("avg_latency_ms"), round_to(F.percentile("duration_ms", F.lit(0.5)), 6).alias("p50_latency_ms"), round_to(F.percentile("duration_ms", F.lit(0.99)), 6).alias("p99_latency_ms"), share(F.count_if(F.col("l3").isNotNull()), F.count("*")).alias("l3_usage_rate"))


def attack_report(samples: DataFrame) -> DataFrame:
    """samples: (category, is_fake, detected). Counts and rates overall (category null) and by category, in one pass."""
    f, d = F.col("is_fake"), F.col("detected")
    g = samples.groupingSets([["category"], []], "category").agg(F.count_if(f & d).alias("tp"), F.count_if(f & ~d).alias("fn"), F.count_if(~f & ~d).alias("tn"), F.count_if(~f & d).alias("fp"), F.grouping("category").cast("int").alias("overall"))
    return g.withColumns({"detection_rate": share(F.col("tp"), F.col("tp") + F.col("fn")), "evasion_rate": share(F.col("fn"), F.col("tp") + F.col("fn"))})


def funnel(df: DataFrame) -> DataFrame:
    n = F.count("*")
    l2, l3, b = F.count_if(F.col("l2").isNotNull()), F.count_if(F.col("l3").isNotNull()), F.count_if(F.col("verdict") == "BLOCK")
    return df.agg(n.alias("l1_scans"), l2.alias("l2_scans"), l3.alias("l3_scans"), b.alias("blocked"), share(l2, n).alias("l2_rate"), share(l3, n).alias("l3_rate"), share(b, n).alias("block_rate"))


def reviewer_stats(actions: DataFrame) -> DataFrame:
    """actions: (reviewer_id, original_verdict, new_verdict, review_seconds)."""
    changed = F.col("original_verdict") != F.col("new_verdict")
    return actions.groupBy("reviewer_id").agg(F.count("*").alias("reviews"), F.count_if(changed & (F.col("new_verdict") == "ALLOW")).alias("overrides_to_allow"), F.count_if(changed & (F.col("new_verdict") == "BLOCK")).alias("overrides_to_block"), mean6("review_seconds").alias("avg_review_seconds"))


def bias_gap(samples: DataFrame, group: str, limit: float = 0.05) -> DataFrame:
    """Largest difference of accuracy between groups and whether it exceeds the limit."""
    acc = samples.groupBy(group).agg(share(F.count_if(F.col("is_fake") == F.col("detected")), F.count("*")).alias("a"))
    return acc.agg(F.count("*").alias("groups"), F.min("a").alias("lowest"), F.max("a").alias("highest"), (F.max("a") - F.min("a")).alias("gap"), ((F.max("a") - F.min("a")) > limit).alias("biased"))


def pending_review(verdicts: DataFrame, actions: DataFrame) -> DataFrame:
    """Verdicts that wait for a person and have no action yet."""
    return verdicts.filter(F.col("verdict").isin("FLAG", "FLAG_URGENT")).join(actions.select("scan_id"), "scan_id", "left_anti")


def page(df: DataFrame, size: int, after: tuple | None = None, ts: str = "ts", key: str = "scan_id") -> DataFrame:
    """The next page in order of (ts, key) after a cursor; at most 100 rows, as the contract says."""
    if after is not None:
        df = df.filter((F.col(ts) > F.lit(after[0])) | ((F.col(ts) == F.lit(after[0])) & (F.col(key) > after[1])))
    return df.orderBy(ts, key).limit(min(size, 100))


def page_with_total(df: DataFrame, size: int, after: tuple | None = None, ts: str = "ts", key: str = "scan_id") -> DataFrame:
    """page() with total_count, the number of rows of df over all pages: a scalar subquery, counted apart from the page."""
    return page(df, size, after, ts, key).withColumn("total_count", df.agg(F.count("*")).scalar())


def dashboard_filter(df: DataFrame, verdicts: tuple[str, ...] | None = None, least: float | None = None, most: float | None = None, start: Column | None = None, end: Column | None = None) -> DataFrame:
    """Only the conditions that are given; they reach the scan."""
    for cond in (verdicts and F.col("verdict").isin(*verdicts), least is not None and F.col("risk_score") >= least, most is not None and F.col("risk_score") <= most, start is not None and F.col("ts") >= start, end is not None and F.col("ts") < end):
        if isinstance(cond, Column):
            df = df.filter(cond)
    return df


def rolling_accuracy(daily: DataFrame, days: int = 7) -> DataFrame:
    """daily: (day, model, tp, fp, fn, tn). Accuracy over the last days, by time and not by rows."""
    w = Window.partitionBy("model").orderBy(F.unix_timestamp("day")).rangeBetween(-(days - 1) * 86400, 0)
    s = lambda c: F.sum(c).over(w)
    good, all_ = s("tp") + s("tn"), s("tp") + s("tn") + s("fp") + s("fn")
    return daily.select("day", "model", share(good, all_).alias("accuracy_7d"), all_.alias("scans_7d"))
