"""Tenant policies: thresholds, first-match rules compiled to expressions, automatic blocks, custom rules and simulation."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import col
from .scoring import Thresholds, verdict


class Condition:
    """A node of a rule's condition tree."""

    def compile(self) -> Column:
        raise NotImplementedError


@dataclass(frozen=True)
class ReasonCodePresent(Condition):
    codes: tuple[str, ...]

    def compile(self) -> Column:
        return F.arrays_overlap(F.col("_codes"), F.array(*map(F.lit, self.codes))) if self.codes else F.lit(False)


@dataclass(frozen=True)
class ScoreAbove(Condition):
    threshold: float

    def compile(self) -> Column:
        return F.col("risk_score") > self.threshold


@dataclass(frozen=True)
class ScoreBelow(Condition):
    threshold: float

    def compile(self) -> Column:
        return F.col("risk_score") < self.threshold


@dataclass(frozen=True)
class ContextMultiplierAbove(Condition):
    threshold: float

    def compile(self) -> Column:
        return F.col("context_multiplier") > self.threshold


@dataclass(frozen=True)
class CategoryPresent(Condition):
    category: str

    def compile(self) -> Column:
        return F.exists("reason_codes", lambda r: r["category"] == self.category)


@dataclass(frozen=True)
class AllOf(Condition):
    conditions: tuple[Condition, ...] = ()

    def compile(self) -> Column:
        out = F.lit(True)
        for c in self.conditions:
            out = out & c.compile()
        return out


@dataclass(frozen=True)
class AnyOf(Condition):
    conditions: tuple[Condition, ...] = ()

    def compile(self) -> Column:
        out = F.lit(False)
        for c in self.conditions:
            out = out | c.compile()
        return out


@dataclass(frozen=True)
class Rule:
    rule_id: str
    condition: Condition
    verdict: str
    reason_code: str
    explanation: str


@dataclass(frozen=True)
class RuleSet:
    """Rules of one tenant, in order; the first that matches wins."""

    tenant_id: int | str
    rules: tuple[Rule, ...] = field(default_factory=tuple)


def current(policies: DataFrame, as_of: Column | str) -> DataFrame:
    """The versions that are in force: effective_from <= as_of < effective_until (or open)."""
    t = col(as_of)
    return policies.filter((F.col("effective_from") <= t) & (F.col("effective_until").isNull() | (F.col("effective_until") > t)))


def latest(policies: DataFrame, key: str = "tenant_id") -> DataFrame:
    """The last version of each tenant."""
    last = policies.groupBy(key).agg(F.max("version").alias("version"))
    return policies.join(last, [key, "version"])


def lookup(scans: DataFrame, policies: DataFrame, key: str = "tenant_id", default: Thresholds = Thresholds()) -> DataFrame:
    """Left join with defaults where a tenant has no policy. policies: one row for each tenant, so scans keep their number of rows;
    Spark broadcasts it by its size or shuffles."""
    got = scans.join(policies.select(key, "allow_max", "flag_max", "flag_urgent_max", "auto_block_known_hash"), key, "left")
    return got.withColumns({"allow_max": F.coalesce("allow_max", F.lit(default.allow_max)), "flag_max": F.coalesce("flag_max", F.lit(default.flag_max)), "flag_urgent_max": F.coalesce("flag_urgent_max", F.lit(default.flag_urgent_max)), "auto_block_known_hash": F.coalesce("auto_block_known_hash", F.lit(True))})


def as_of(scans: DataFrame, policies: DataFrame, ts: str = "ts", key: str = "tenant_id") -> DataFrame:
    """Each scan with the version in force at its time: an equi join on the tenant with the interval as a residual condition.
    Scans without a version are kept with nulls."""
    p = policies.withColumnRenamed(key, "_tenant")
    when = (F.col(ts) >= p["effective_from"]) & (p["effective_until"].isNull() | (F.col(ts) < p["effective_until"]))
    return scans.join(p, (F.col(key) == F.col("_tenant")) & when, "left").drop("_tenant")


def apply_policy(df: DataFrame, rule_sets: list[RuleSet], key: str = "tenant_id") -> DataFrame:
    """df: the result of lookup() over scored scans. Replaces verdict and reason_codes, adds override_rule_id.

    Thresholds first, then the tenant's first matching rule, then the automatic block on a known hash. Rule trees are compiled to one
    expression; no row leaves the JVM.
    """
    df = df.withColumn("_codes", F.transform("reason_codes", lambda r: r["code"]))
    by_threshold = verdict(F.col("risk_score"), F.col("allow_max"), F.col("flag_max"), F.col("flag_urgent_max"))
    hit = F.lit(None).cast("struct<rule_id:string,verdict:string,code:string,explanation:string>")
    chain = None
    for s in rule_sets:
        for r in s.rules:
            out = F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.verdict).alias("verdict"), F.lit(r.reason_code).alias("code"), F.lit(r.explanation).alias("explanation"))
            test = (F.col(key) == s.tenant_id) & r.condition.compile()
            chain = F.when(test, out) if chain is None else chain.when(test, out)
    df = df.withColumn("_hit", hit if chain is None else chain)
    reason = lambda code, said: F.struct(code.alias("code"), F.lit("CONTEXT").alias("category"), said.alias("explanation"), F.lit(1.0).alias("confidence"))
    df = df.withColumn("_v", F.coalesce("_hit.verdict", by_threshold))
    auto = F.col("auto_block_known_hash") & F.array_contains("_codes", "L1_HASH_MATCH") & (F.col("_v") != "BLOCK")
    ruled = F.when(F.col("_hit").isNotNull(), F.concat("reason_codes", F.array(reason(F.col("_hit.code"), F.col("_hit.explanation"))))).otherwise(F.col("reason_codes"))
    blocked = F.array(reason(F.lit("POLICY_AUTO_BLOCK_HASH"), F.lit("Tenant policy auto-blocks media matching known deepfake hashes")))
    return df.withColumns({"reason_codes": F.when(auto, F.concat(ruled, blocked)).otherwise(ruled), "verdict": F.when(auto, "BLOCK").otherwise(F.col("_v")), "override_rule_id": F.when(auto, "AUTO_BLOCK_KNOWN_HASH").otherwise(F.col("_hit.rule_id"))}).drop("_codes", "_hit", "_v")


def custom_rules(scans: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules as rows: (tenant_id, rule_type, value, verdict, priority, enabled) with rule_type ALLOWLIST or BLOCKLIST matched on source,
    GEOGRAPHIC on region, THRESHOLD_OVERRIDE on risk_score >= value. The smallest priority wins, then the rule_id."""
    live = rules.filter("enabled")
    r = live.select(*[F.col(c).alias(f"r_{c}") for c in live.columns])
    match = F.when(F.col("r_rule_type").isin("ALLOWLIST", "BLOCKLIST"), F.col("source") == F.col("r_value")).when(F.col("r_rule_type") == "GEOGRAPHIC", F.col("region") == F.col("r_value")).otherwise(F.col("risk_score") >= F.expr("try_cast(r_value as double)"))
    hits = scans.join(r, (F.col("tenant_id") == F.col("r_tenant_id")) & match)
    best = hits.groupBy("scan_id").agg(F.min(F.struct("r_priority", "r_rule_id", "r_verdict")).alias("_b"))
    return scans.join(best, "scan_id", "left").withColumns({"rule_id": F.col("_b.r_rule_id"), "final_verdict": F.coalesce("_b.r_verdict", "verdict")}).drop("_b")


def simulate(scored: DataFrame, candidates: list[tuple[str, Thresholds]]) -> DataFrame:
    """(candidate, old_verdict, new_verdict, scans): how verdicts would change. All candidates are evaluated in one pass over the scans."""
    each = F.array(*[F.struct(F.lit(name).alias("candidate"), verdict(F.col("risk_score"), t.allow_max, t.flag_max, t.flag_urgent_max).alias("new_verdict")) for name, t in candidates])
    return scored.select(F.col("verdict").alias("old_verdict"), F.explode(each).alias("c")).groupBy("c.candidate", "old_verdict", "c.new_verdict").agg(F.count("*").alias("scans"))


def versions_before(policies: DataFrame) -> DataFrame:
    """Audit trail: each version with the thresholds it replaced."""
    w = Window.partitionBy("tenant_id").orderBy("version")
    return policies.select("tenant_id", "version", F.lag("flag_max").over(w).alias("old_flag_max"), F.col("flag_max").alias("new_flag_max"), F.lit("POLICY_CHANGE").alias("event_class"), F.lit(3650).alias("retention_days"))
