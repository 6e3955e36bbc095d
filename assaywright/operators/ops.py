"""Operations: rate limits, latency histograms, service levels, alerts, waves, circuit breakers, incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import mean6, share

#: Upper bounds of the latency buckets in seconds.
BUCKETS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0)


def rate_limited(requests: DataFrame, limits: DataFrame, unit: str = "second") -> DataFrame:
    """Requests with their number in the tenant's fixed window and whether they are refused. Refused calls count too.

    requests: (request_id, tenant_id, ts); limits: (tenant_id, per_window). A window's rows are those of one tenant and second.
    """
    w = Window.partitionBy("tenant_id", "slot").orderBy("ts", "request_id")
    numbered = requests.withColumn("slot", F.date_trunc(unit, "ts")).withColumn("n", F.row_number().over(w))
    return numbered.join(limits, "tenant_id").withColumn("rejected", F.col("n") > F.col("per_window"))


def histogram(df: DataFrame, value: str, by: list[str], bounds: tuple[float, ...] = BUCKETS) -> DataFrame:
    """Cumulative bucket counts: (by..., le, n), le null for the last, unbounded one."""
    each = [F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)]
    g = df.groupBy(*by).agg(*each, F.count(value).alias("b_all"))
    pairs = F.array(*[F.struct(F.lit(b).cast("double").alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate(bounds)], F.struct(F.lit(None).cast("double").alias("le"), F.col("b_all").alias("n")))
    return g.select(*by, F.explode(pairs).alias("p")).select(*by, "p.le", "p.n")


def histogram_quantile(hist: DataFrame, q: float, by: list[str]) -> DataFrame:
    """The quantile by linear interpolation inside its bucket; the last finite bound if it lies beyond."""
    g = hist.groupBy(*by).agg(F.max("n").alias("total"), F.array_sort(F.collect_list(F.when(F.col("le").isNotNull(), F.struct("le", "n")))).alias("b"))
    rank = F.col("total") * F.lit(q)
    at = F.get(F.filter(F.transform("b", lambda x, i: F.struct(x["n"].alias("n"), i.alias("i"))), lambda x: x["n"] >= rank), F.lit(0))["i"]
    g = g.withColumns({"rank": rank, "at": at})
    hi, lo = F.get("b", F.col("at")), F.get("b", F.col("at") - 1)
    below, start = F.when(F.col("at") > 0, lo["n"]).otherwise(0), F.when(F.col("at") > 0, lo["le"]).otherwise(0.0)
    value = F.when(F.col("at").isNull(), F.get("b", F.size("b") - 1)["le"]).otherwise(start + (hi["le"] - start) * F.try_divide(F.col("rank") - below, (hi["n"] - below).cast("double")))
    return g.select(*by, "total", value.alias("quantile"))


def latency_sketches(df: DataFrame, value: str, by: list[str], k: int = 400) -> DataFrame:
    """(by..., sketch, n): a KLL sketch of the values of each group, of bounded size however many there are, to be stored and merged later."""
    return df.groupBy(*by).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"), F.count(value).alias("n"))


def merged_sketches(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of a coarser grouping from those of a finer one."""
    return sketches.filter("n > 0").groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"), F.sum("n").alias("n"))


def sketch_quantile(sketches: DataFrame, q: float, name: str = "quantile") -> DataFrame:
    """Adds the quantile. Its rank is off by no more than some 2.3 / k ** 0.9 of the values, with 99 % confidence: 1.1 % for k = 400."""
    return sketches.withColumn(name, F.kll_sketch_get_quantile_double("sketch", F.lit(q)))


def availability(requests: DataFrame, by: list[str]) -> DataFrame:
    """requests: status. Share of answers that are no server errors."""
    return requests.groupBy(*by).agg(F.count("*").alias("requests"), F.count_if(F.col("status") >= 500).alias("errors"), share(F.count_if(F.col("status") < 500), F.count("*")).alias("availability"))


def error_budget(df: DataFrame, target: float) -> DataFrame:
    """df: requests, errors. Share of the budget left and what follows from it."""
    left = 1.0 - F.try_divide(F.col("errors").cast("double"), F.col("requests") * (1.0 - target))
    df = df.withColumn("budget_left", F.greatest(F.coalesce(left, F.lit(1.0)), F.lit(0.0)))
    b = F.col("budget_left")
    return df.withColumn("band", F.when(b <= 0, "EXHAUSTED").when(b < 0.10, "INCIDENT").when(b < 0.25, "FREEZE").when(b <= 0.50, "CAUTION").otherwise("NORMAL"))


def budget_burn(daily: DataFrame, target: float, days: int = 30) -> DataFrame:
    """daily: (service, day, requests, errors). Over the last days, by time and not by rows: requests, errors and the share of the error
    budget that they burn."""
    w = Window.partitionBy("service").orderBy(F.unix_timestamp("day")).rangeBetween(-(days - 1) * 86400, 0)
    got = daily.select("service", "day", F.sum("requests").over(w).alias("requests"), F.sum("errors").over(w).alias("errors"))
    return got.withColumn("burned", F.try_divide(F.col("errors").cast("double"), F.col("requests") * (1.0 - target)))


def held_for(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Alerts whose condition held in `slots` successive slots.

    metrics: (metric, slot, value), one row for each slot; rules: (alert, priority, metric, bound, slots). Runs of slots over the
    bound are islands; one row for each run that is long enough.
    """
    over = metrics.join(rules, "metric").filter(F.col("value") > F.col("bound"))
    w = Window.partitionBy("alert").orderBy("slot")
    runs = over.withColumn("run", F.col("slot") - F.row_number().over(w)).groupBy("alert", "priority", "slots", "run").agg(F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count("*").alias("held"), F.max("value").alias("peak"))
    return runs.filter(F.col("held") >= F.col("slots")).drop("run", "slots")


def wave_baseline(counts: DataFrame, days: int = 7, factor: float = 3.0) -> DataFrame:
    """counts: (key, day, slot, n), n for each slot of each day. Flags slots over factor times the mean of the same slot on the days before.

    Days without rows count as zero, as the mean is taken over the days that the window spans.
    """
    w = Window.partitionBy("key", "slot").orderBy("day").rangeBetween(-days, -1)
    base = F.coalesce(F.sum("n").over(w), F.lit(0)).cast("double") / float(days)
    return counts.withColumn("baseline", base).withColumn("wave", (F.col("baseline") > 0) & (F.col("n") > F.col("baseline") * factor))


def wave_targets(rows: DataFrame, low_trust: float = 0.3) -> DataFrame:
    """rows: (fingerprint, target, tenant_id, trust). What a wave's clusters are judged by: for each fingerprint its rows, targets, tenants,
    the share of accounts of low trust, and the target that most of its rows aim at (of equal ones the first)."""
    by = rows.groupBy("fingerprint", "target").agg(F.count("*").alias("n"), F.count_if(F.col("trust") < low_trust).alias("low"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "target"))
    got = by.groupBy("fingerprint").agg(F.sum("n").alias("rows"), F.count("*").alias("targets"), F.sum("low").alias("low"), best.alias("best"))
    return got.select("fingerprint", "rows", "targets", share(F.col("low"), F.col("rows")).alias("low_trust_share"), F.col("best.target").alias("main_target"), (-F.col("best.n")).alias("main_target_rows"))


def clusters(rows: DataFrame, by: list[str], least: int) -> DataFrame:
    """Groups of at least so many rows with equal fingerprints."""
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("tenant_id").alias("tenants"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen")).filter(F.col("n") >= least)


def circuit_breaker(calls: DataFrame, failures: int, seconds: int) -> DataFrame:
    """calls: (service, call_id, ts, failed). Adds the failures of the last seconds and whether the circuit opens.

    Calls are summed by second first, in partial sums. A failure enters at its second and leaves `seconds` + 1 later, so what lies in the frame is a
    running sum, which grows by one step a row however many rows the frame has. Sums stay inside blocks of the frame's length: what lies behind a
    block's start is the block before, whose failures leave in this one. So a service with very many calls is dealt by block, not one task.
    Calls without service or time have no failures behind them.
    """
    second = F.unix_timestamp("ts")
    span = seconds + 1
    block = F.floor(F.col("_sec") / span)
    sums = calls.filter("failed").groupBy("service", second.alias("_sec")).agg(F.count("*").alias("_f"))
    step = lambda block, sec, f: F.struct(block.alias("_block"), sec.alias("_sec"), f.alias("_f"))
    f, sec = F.col("_f"), F.col("_sec")
    both = sums.select("service", F.explode(F.array(step(block, sec, f), step(block + 1, (block + 1) * span, f), step(block + 1, sec + span, -f))).alias("_x")).select("service", "_x.*", F.lit(False).alias("_asked"))
    asked = calls.select("service", second.alias("_sec")).distinct().select("service", block.alias("_block"), "_sec", F.lit(0).cast("bigint").alias("_f"), F.lit(True).alias("_asked"))
    w = Window.partitionBy("service", "_block").orderBy("_sec").rangeBetween(Window.unboundedPreceding, 0)
    recent = both.unionByName(asked).withColumn("recent_failures", F.sum("_f").over(w)).filter("_asked").select("service", "_sec", "recent_failures")
    got = calls.withColumn("_sec", second).join(recent, ["service", "_sec"], "left").drop("_sec")
    return got.withColumn("recent_failures", F.coalesce("recent_failures", F.lit(0))).withColumn("open", F.col("recent_failures") >= failures)


def incident_metrics(incidents: DataFrame) -> DataFrame:
    """incidents: (severity, occurred_at, detected_at, acknowledged_at, resolved_at). Mean times in seconds by month and severity."""
    span = lambda a, b: F.unix_timestamp(b) - F.unix_timestamp(a)
    return incidents.groupBy(F.date_trunc("month", "occurred_at").alias("month"), "severity").agg(F.count("*").alias("incidents"), mean6(span("occurred_at", "detected_at")).alias("mttd"), mean6(span("detected_at", "acknowledged_at")).alias("mtta"), mean6(span("detected_at", "resolved_at")).alias("mttr"), share(F.count("resolved_at"), F.count("*")).alias("completion_rate"))


def scale_decision(lag: DataFrame, thresholds: dict[str, int]) -> DataFrame:
    """lag: (topic, slot, lag). Whether a consumer group needs more instances."""
    bound = F.create_map(*[x for k, v in thresholds.items() for x in (F.lit(k), F.lit(v))])[F.col("topic")]
    return lag.withColumn("bound", bound).withColumn("decision", F.when(F.col("lag") > F.col("bound") * 2, "SCALE_OUT_FAST").when(F.col("lag") > F.col("bound"), "SCALE_OUT").otherwise("HOLD"))


def permitted(calls: DataFrame, grants: DataFrame, permission: str = "permission") -> DataFrame:
    """calls joined with the tenant's array of permissions; `allowed` says whether the needed one, or admin, is among them."""
    has = F.array_contains("permissions", F.col(permission)) | F.array_contains("permissions", "admin")
    return calls.join(grants, "tenant_id", "left").withColumn("allowed", F.coalesce(has, F.lit(False)))


def exposition(metrics: DataFrame) -> DataFrame:
    """metrics: (name, labels map, value) as lines of the text format, labels in order of their names."""
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit('="'), e["value"], F.lit('"'))), ",")
    return metrics.select(F.concat("name", F.when(F.size("labels") > 0, F.concat(F.lit("{"), pairs, F.lit("}"))).otherwise(""), F.lit(" "), F.col("value").cast("string")).alias("line"))


def recent(df: DataFrame, as_of: Column, minutes: int, n: int) -> DataFrame:
    """The newest n rows of the last minutes: a feature, not a safeguard."""
    return df.filter(F.col("ts") > as_of - F.make_dt_interval(mins=F.lit(minutes))).orderBy(F.desc("ts"), F.desc("scan_id")).limit(n)
