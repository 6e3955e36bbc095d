"""Records derived from verdicts: audit rows, incidents, manifests, statements, risk reports, retention, erasure, signatures."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import ed25519_rows
from ..functions.numeric import fixed, listed


def _id(kind: str, key: Column) -> Column:
    """An identifier that a rerun makes again."""
    return F.sha2(F.concat(F.lit(kind + ":"), key.cast("string")), 256)


def codes(reasons: str = "reason_codes") -> Column:
    return F.transform(F.coalesce(F.col(reasons), F.array().cast("array<struct<code:string,category:string,explanation:string,confidence:double>>")), lambda r: r["code"])


def audit_log(verdicts: DataFrame) -> DataFrame:
    """One audit row for each verdict. Human oversight is required for FLAG and FLAG_URGENT, not for BLOCK."""
    v = F.coalesce("verdict", F.lit("ALLOW"))
    return verdicts.select(
        _id("audit", F.col("scan_id")).alias("audit_id"), "scan_id", "tenant_id", v.alias("decision"), F.coalesce("risk_score", F.lit(0.0)).alias("risk_score"), codes().alias("reason_codes"),
        v.isin("FLAG", "FLAG_URGENT").alias("human_oversight_required"), F.lit("EU_AI_ACT").alias("regulation"), F.lit("Article 13").alias("article_reference"), F.col("ts").alias("created_at"),
    )


def reportable(v: str = "verdict") -> Column:
    """A block that is nearly certain, or a likely political or disinformation case."""
    political = F.exists(codes(), lambda c: F.startswith(c, F.lit("CTX_POLITICAL")) | (c == "THREAT_DISINFORMATION"))
    return ((F.col(v) == "BLOCK") & (F.col("risk_score") > 0.95)) | (political & (F.col("risk_score") > 0.8))


def incidents(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(reportable()).select(_id("incident", F.col("scan_id")).alias("incident_id"), "scan_id", F.lit("automated_detection").alias("incident_type"), F.lit("high").alias("severity"), codes().alias("reason_codes"), F.lit("EU_AI_ACT").alias("regulation"), F.lit("Article 62").alias("article_reference"), F.lit("pending_review").alias("status"), F.col("ts").alias("created_at"))


def manifests(verdicts: DataFrame) -> DataFrame:
    """For flagged and blocked scans: actions by executed tier, assertions, and the hash of the ingredient."""
    made = verdicts.filter(F.col("verdict").isin("BLOCK", "FLAG", "FLAG_URGENT"))
    action = lambda tier, kind: F.when(F.col(tier.lower()).isNotNull(), F.struct(F.lit("c2pa.analyzed").alias("action"), F.lit(tier).alias("tier"), F.lit(kind).alias("analysis_type")))
    acts = listed(action("L1", "metadata_hash"), action("L2", "biometric_consistency"), action("L3", "neural_network_ensemble"))
    synthetic = (F.col("verdict") == "BLOCK") | ((F.col("verdict") == "FLAG") & (F.col("risk_score") > 0.7))
    labels = listed(F.lit("verdict"), F.when(F.col("reason_codes").isNotNull(), F.lit("reason_codes")), F.when(synthetic, F.lit("c2pa.ai_generated")))
    content = F.col("content_hash") if "content_hash" in verdicts.columns else F.lit(None).cast("string")
    return made.select(_id("manifest", F.col("scan_id")).alias("manifest_id"), "scan_id", F.col("verdict").alias("decision"), acts.alias("actions"), labels.alias("assertions"), synthetic.alias("is_ai_generated"), F.lit("SHA-256").alias("hash_algorithm"), F.coalesce(content, F.sha2(F.col("scan_id").cast("string"), 256)).alias("hash_value"), F.concat(F.lit("scan:"), F.col("scan_id").cast("string")).alias("title"), F.lit("parentOf").alias("relationship"))


#: Legal basis by decision.
BASES = {
    "BLOCK": "Terms of service violation: Manipulated media policy — content identified as synthetic/deepfake with high confidence",
    "FLAG_URGENT": "Terms of service violation: Potentially manipulated media requiring urgent human review",
    "FLAG": "Terms of service: Content flagged for human review based on automated analysis indicators",
}
REDRESS = ("Certified DSA dispute body (to be designated)", "Users may seek judicial redress in the courts of their Member State of establishment")


def statements(verdicts: DataFrame) -> DataFrame:
    """Statements of reasons for everything but ALLOW. Facts are the explanations, or one sentence with the score."""
    said = F.filter(F.transform("reason_codes", lambda r: r["explanation"]), lambda e: e.isNotNull())
    fallback = F.concat(F.lit("Automated analysis detected indicators of media manipulation with a confidence score of "), fixed(F.col("risk_score") * 100.0, 1), F.lit("%."))
    basis = F.coalesce(F.create_map(*[F.lit(x) for kv in BASES.items() for x in kv])[F.col("verdict")], F.lit("No restriction applied"))
    redress = F.struct(F.lit(True).alias("internal_complaint"), F.lit(REDRESS[0]).alias("dispute_settlement_body"), F.lit(REDRESS[1]).alias("judicial_redress"))
    return verdicts.filter(F.col("verdict") != "ALLOW").select(_id("statement", F.col("scan_id")).alias("statement_id"), "scan_id", "tenant_id", F.col("verdict").alias("decision"), basis.alias("legal_basis"), F.lit(True).alias("automated_detection"), F.when(F.size(said) > 0, said).otherwise(F.array(fallback)).alias("facts"), F.lit("Section 4.2 — Manipulated Media Policy").alias("tos_provision"), redress.alias("redress_info"), F.col("ts").alias("created_at"))


def systemic_risks(alerts: DataFrame) -> DataFrame:
    """alerts: (alert_id, alert_type, severity, affected_users). Those that are systemic, as reports to be submitted."""
    t = F.col("alert_type")
    systemic = F.when(t.isin("deepfake_wave", "coordinated_campaign", "political_disinformation_surge"), True).when(t == "identity_theft_cluster", F.coalesce(F.col("affected_users") > 100, F.lit(False))).otherwise(F.coalesce(F.col("severity") == "critical", F.lit(False)))
    return alerts.filter(systemic).select(_id("risk", F.col("alert_id")).alias("report_id"), "alert_id", "alert_type", "severity", F.lit("pending_submission").alias("status"))


def decision_counters(verdicts: DataFrame) -> DataFrame:
    """(period, decision_type, n) by month."""
    return verdicts.groupBy(F.date_trunc("month", "ts").alias("period"), F.col("verdict").alias("decision_type")).agg(F.count("*").alias("n"))


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Counters after an upsert: additive, so the order of batches doesn't matter."""
    return old.unionByName(new).groupBy("period", "decision_type").agg(F.sum("n").cast("bigint").alias("n"))


def upsert_latest(rows: DataFrame, key: str, ts: str) -> DataFrame:
    """The last row of each key, as an upsert that replaces leaves it."""
    rest = [c for c in rows.columns if c not in (key, ts)]
    m = rows.groupBy(key).agg(F.max(F.struct(ts, *rest)).alias("m"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in (ts, *rest)])


def expired(verdicts: DataFrame, policies: DataFrame, as_of: Column, ts: str = "ts") -> DataFrame:
    """Verdicts past their tenant's retention. policies: one row in force for each tenant, with data_retention_days."""
    p = policies.select("tenant_id", "data_retention_days")
    return verdicts.join(p, "tenant_id").filter(F.col(ts) < as_of - F.make_dt_interval(F.col("data_retention_days")))


def purge_processing(scans: DataFrame, as_of: Column, hours: int = 1, done: tuple[str, ...] = ("completed", "failed")) -> tuple[DataFrame, DataFrame]:
    """(kept, purged) of processing metadata (status, ts): what has ended and is older than `hours` goes; scans under way stay."""
    old = F.coalesce(F.col("status").isin(*done) & (F.col("ts") < as_of - F.make_dt_interval(hours=F.lit(hours))), F.lit(False))
    return scans.filter(~old), scans.filter(old)


def survivors(verdicts: DataFrame, policies: DataFrame, as_of: Column, key: str = "scan_id", ts: str = "ts") -> DataFrame:
    return verdicts.join(expired(verdicts, policies, as_of, ts).select(key), key, "left_anti")


def within_ttl(df: DataFrame, ts: str, days: int, as_of: Column) -> DataFrame:
    return df.filter(F.col(ts) >= as_of - F.make_dt_interval(F.lit(days)))


def erase(tables: dict[str, DataFrame], requests: DataFrame, key: str = "scan_id") -> tuple[dict[str, DataFrame], DataFrame]:
    """Each table without the requested keys, and (store, key, deleted) counts for the log."""
    wanted = requests.select(key).distinct()
    kept = {n: t.join(wanted, key, "left_anti") for n, t in tables.items()}
    log = None
    for n, t in tables.items():
        one = t.join(wanted, key, "left_semi").groupBy(key).agg(F.count("*").alias("deleted")).withColumn("store", F.lit(n))
        log = one if log is None else log.unionByName(one)
    return kept, log


def route(events: DataFrame) -> DataFrame:
    """Adds the handler of a compliance event."""
    t = F.col("event_type")
    return events.withColumn("handler", F.when(t == "model_version_update", "model_change").when(t == "c2pa_manifest_generated", "manifest_issued").when(t == "audit_requested", "audit_snapshot").otherwise("ignored"))


def _in_order(x: Column, kind: T.DataType) -> Column:
    """x with the fields of all structs inside it in order of their names, and maps as their entries in order of their keys."""
    if isinstance(kind, T.StructType):
        inner = F.struct(*[_in_order(x.getField(f.name), f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)])
        return F.when(x.isNotNull(), inner)
    if isinstance(kind, T.ArrayType):
        return F.transform(x, lambda y: _in_order(y, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.transform(F.array_sort(F.transform(F.map_entries(x), lambda e: F.struct(e["key"].alias("key"), _in_order(e["value"], kind.valueType).alias("value")))), lambda e: e)
    return x


def canonical(df: DataFrame, cols: list[str]) -> Column:
    """JSON of columns of df with keys in sorted order at every depth, nulls written: equal content has equal text, and a null is not an absence."""
    return F.to_json(F.struct(*[_in_order(F.col(c), df.schema[c].dataType).alias(c) for c in sorted(cols)]), {"ignoreNullFields": "false"})


def sign(df: DataFrame, cols: list[str], key_id: str) -> DataFrame:
    """Adds content_hash (SHA-512 of the canonical JSON) and the key's id; the signature itself is made by sign_ed25519() or outside."""
    return df.withColumns({"content_hash": F.sha2(canonical(df, cols), 512), "key_id": F.lit(key_id)})


def batch_roots(signed: DataFrame, batch: list[str], digits: tuple[int, ...] = (6, 4, 2)) -> DataFrame:
    """(batch..., content_hash, rows): one hash over the content_hash of all rows of each batch, to be signed instead of every row.

    A tree over the hashes: those that begin with the same `digits` hexadecimal digits are hashed together in order, their hashes by fewer digits, and
    at last those of a batch. So no task gets a whole batch; repeated rows count as often as they are there. Rows without a hash count as ''.
    """
    level = signed.select(*batch, F.coalesce("content_hash", F.lit("")).alias("at"), F.coalesce("content_hash", F.lit("")).alias("h"), F.lit(1).cast("bigint").alias("n"))
    for k in (*digits, 0):
        level = level.withColumn("at", F.substring("at", 1, k)).groupBy(*batch, "at").agg(F.sort_array(F.collect_list("h")).alias("all"), F.sum("n").alias("n"))
        level = level.select(*batch, "at", F.sha2(F.concat_ws(",", "all"), 512).alias("h"), "n")
    return level.select(*batch, F.col("h").alias("content_hash"), F.col("n").alias("rows"))


def check_batches(rows: DataFrame, roots: DataFrame, batch: list[str], public: dict[str, bytes]) -> DataFrame:
    """(batch..., rows, batch_valid) of signed roots (batch..., content_hash, key_id, signature): whether the rows that are there now, with
    content_hash counted anew, have the root that was signed. One signature is checked for each batch and none for each row."""
    now = batch_roots(rows, batch).select(*batch, F.col("content_hash").alias("_now"), "rows")
    checked = check_ed25519(roots.drop("rows"), public).join(now, batch, "left")
    return checked.select(*batch, F.coalesce("rows", F.lit(0)).alias("rows"), (F.col("signature_valid") & F.coalesce(F.col("_now") == F.col("content_hash"), F.lit(False))).alias("batch_valid"))


def sign_ed25519(signed: DataFrame, seeds: dict[str, bytes]) -> DataFrame:
    """Adds signature (Ed25519 over the bytes of content_hash) by the key of each row's key_id, in Arrow batches; null where there is no such
    key. Keys are few and known to the caller."""

    @F.pandas_udf("binary")
    def run(key_id: pd.Series, content_hash: pd.Series) -> pd.Series:
        keys, hashes = key_id.tolist(), content_hash.tolist()
        at = [i for i, (k, h) in enumerate(zip(keys, hashes, strict=True)) if k in seeds and h is not None]
        out = np.full(len(keys), None, object)
        out[at] = ed25519_rows.sign([seeds[keys[i]] for i in at], [bytes.fromhex(hashes[i]) for i in at])
        return pd.Series(out)

    return signed.withColumn("signature", run("key_id", "content_hash"))


def check_ed25519(signed: DataFrame, public: dict[str, bytes]) -> DataFrame:
    """Adds signature_valid: whether signature is that of content_hash by the key of key_id; false without a key or a signature."""

    @F.pandas_udf("boolean")
    def run(key_id: pd.Series, content_hash: pd.Series, signature: pd.Series) -> pd.Series:
        keys, hashes, signatures = key_id.tolist(), content_hash.tolist(), signature.tolist()
        at = [i for i, (k, h, s) in enumerate(zip(keys, hashes, signatures, strict=True)) if k in public and h is not None and s is not None]
        out = np.zeros(len(keys), bool)
        out[at] = ed25519_rows.verify([public[keys[i]] for i in at], [bytes.fromhex(hashes[i]) for i in at], [bytes(signatures[i]) for i in at])
        return pd.Series(out)

    return signed.withColumn("signature_valid", run("key_id", "content_hash", "signature"))


def verify(signed: DataFrame, keys: DataFrame, cols: list[str], signed_at: str = "signed_at") -> DataFrame:
    """Adds content_hash_valid (the hash computed anew), key_status and key_valid_at_signing. keys: (key_id, status, valid_from, valid_until)."""
    got = signed.join(keys, "key_id", "left")
    inside = (F.col(signed_at) >= F.col("valid_from")) & (F.col("valid_until").isNull() | (F.col(signed_at) < F.col("valid_until")))
    return got.withColumns({"content_hash_valid": F.col("content_hash") == F.sha2(canonical(signed, cols), 512), "key_status": F.coalesce("status", F.lit("UNKNOWN")), "key_valid_at_signing": F.coalesce(inside & (F.col("status") != "REVOKED"), F.lit(False))}).drop("status", "valid_from", "valid_until")


def outside_region(scans: DataFrame, tenants: DataFrame) -> DataFrame:
    """Scans of EU tenants processed in a region outside the EU."""
    return scans.join(tenants.filter(F.col("jurisdiction") == "EU").select("tenant_id"), "tenant_id", "left_semi").filter(~F.startswith(F.col("region"), F.lit("eu-")))


def model_changes(versions: DataFrame) -> DataFrame:
    """Each model version with the one before it."""
    w = Window.partitionBy("model_name").orderBy("deployed_at", "version")
    return versions.withColumn("previous_version", F.lag("version").over(w))


def audit_snapshot(verdicts: DataFrame) -> DataFrame:
    """One row: totals by decision, oversight and incidents, from one aggregate."""
    n = lambda v: F.count_if(F.col("verdict") == v).alias(f"n_{v.lower()}")
    return verdicts.agg(F.count("*").alias("total"), n("ALLOW"), n("FLAG"), n("FLAG_URGENT"), n("BLOCK"), F.count_if(F.col("verdict").isin("FLAG", "FLAG_URGENT")).alias("oversight"), F.count_if(reportable()).alias("incidents"), F.count_distinct("tenant_id").alias("tenants"))
