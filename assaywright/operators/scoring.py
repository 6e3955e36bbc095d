"""Layer composites, risk score, verdict and reason codes as expressions over the nullable structs l1, l2, l3 and ctx.

A layer takes part if its struct is not null; missing fields of a layer count as zero. Everything is one projection, so Catalyst keeps
it in a single generated stage without a shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, fixed, listed


@dataclass(frozen=True)
class Weights:
    """Weights of the layers."""

    l1: float = 0.20
    l2: float = 0.35
    l3: float = 0.45


@dataclass(frozen=True)
class Thresholds:
    """Upper ends of the verdicts' bands."""

    allow_max: float = 0.30
    flag_max: float = 0.60
    flag_urgent_max: float = 0.85


#: What context adds to the multiplier.
PUBLIC_FIGURE, POLITICAL, TRUST_ANOMALY = 0.30, 0.20, 0.15
#: Weights of the signals of the second layer.
L2_WEIGHTS = {"micro_flicker_score": 0.20, "rppg_absence_score": 0.25, "eye_movement_anomaly_score": 0.20, "skin_texture_anomaly_score": 0.15, "facial_symmetry_score": 0.20}


def _zero(x: Column) -> Column:
    return F.coalesce(x, F.lit(0.0))


def verdict(score: Column, allow: Column | float = 0.30, flag: Column | float = 0.60, urgent: Column | float = 0.85) -> Column:
    """Half-open bands: below allow, flag, urgent, and the rest."""
    return F.when(score < allow, "ALLOW").when(score < flag, "FLAG").when(score < urgent, "FLAG_URGENT").otherwise("BLOCK")


def l1_composite(l1: Column) -> Column:
    """Mean of the signals that are there: hash match, metadata, compression, provenance, editing tools."""
    hit = F.coalesce(l1["hash_match_found"], F.lit(False))
    tools = F.coalesce(F.size(l1["detected_editing_tools"]), F.lit(0))
    valid = l1["c2pa_chain_valid"]
    total = F.when(hit, 1.0).otherwise(0.0) + _zero(l1["metadata_anomaly_score"]) + _zero(l1["compression_anomaly_score"])
    total = total + F.when(valid == F.lit(False), 0.6).otherwise(0.0) + F.when(tools > 0, F.least(tools * F.lit(0.15), F.lit(0.6))).otherwise(0.0)
    n = F.lit(2) + hit.cast("int") + valid.isNotNull().cast("int") + (tools > 0).cast("int")
    return F.when(l1.isNotNull(), clamp01(total / n))


def l2_composite(l2: Column) -> Column:
    """Weighted signals; zero if no face was analysed, although the layer still counts as active."""
    total = F.lit(0.0)
    for name, w in L2_WEIGHTS.items():
        total = total + _zero(l2[name]) * w
    return F.when(l2.isNotNull(), F.when(F.coalesce(l2["faces_analyzed"], F.lit(0)) == 0, 0.0).otherwise(clamp01(total)))


def l3_composite(l3: Column) -> Column:
    """Ensemble score, less where the models disagree."""
    r = _zero(l3["model_agreement_ratio"])
    return F.when(l3.isNotNull(), clamp01(_zero(l3["ensemble_score"]) * F.when(r >= 0.8, 1.0).when(r >= 0.5, 0.9).otherwise(0.75)))


def context_multiplier(ctx: Column) -> Column:
    return F.lit(1.0) + F.when(ctx["public_figure_detected"], PUBLIC_FIGURE).otherwise(0.0) + _zero(ctx["political_content_score"]) * POLITICAL + F.when(ctx["account_trust_anomaly"], TRUST_ANOMALY).otherwise(0.0)


def _reason(when: Column, code: str, category: str, text: Column | str, confidence: Column | float) -> Column:
    said = F.lit(text) if isinstance(text, str) else text
    sure = confidence if isinstance(confidence, Column) else F.lit(float(confidence))
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(category).alias("category"), said.alias("explanation"), sure.cast("double").alias("confidence")))


def _scored(text: str, score: Column, tail: str = ")") -> Column:
    return F.concat(F.lit(f"{text} (score: "), fixed(score, 2), F.lit(tail))


def l1_reasons(l1: Column, composite: Column) -> list[Column]:
    # fixed values: bounds, codes, wording and confidences
    tools = l1["detected_editing_tools"]
    return [
        _reason(l1["hash_match_found"], "L1_HASH_MATCH", "L1_HASH", F.concat(F.lit("Media matches known deepfake hash"), F.coalesce(F.concat(F.lit(" (id: "), l1["hash_match_id"], F.lit(")")), F.lit(""))), 0.99),
        _reason(l1["metadata_anomaly_score"] > 0.5, "L1_METADATA_ANOMALY", "L1_METADATA", _scored("Metadata anomaly detected", l1["metadata_anomaly_score"]), l1["metadata_anomaly_score"]),
        _reason(l1["compression_anomaly_score"] > 0.5, "L1_COMPRESSION_ANOMALY", "L1_METADATA", _scored("Compression pattern anomaly", l1["compression_anomaly_score"]), l1["compression_anomaly_score"]),
        _reason(l1["c2pa_chain_valid"] == F.lit(False), "L1_C2PA_INVALID", "L1_METADATA", "C2PA provenance chain is invalid or tampered", 0.80),
        _reason(F.size(tools) > 0, "L1_EDITING_TOOLS", "L1_METADATA", F.concat(F.lit("Editing tool artifacts detected: "), F.array_join(tools, ", ")), clamp01(composite * 0.8)),
    ]


#: Field, bound, code and wording of the reason rules of the second and third layer.
L2_RULES = (
    ("micro_flicker_score", 0.5, "L2_MICRO_FLICKER", "Micro-flicker anomaly in facial region"),
    ("rppg_absence_score", 0.6, "L2_RPPG_ABSENT", "Remote photo-plethysmography signal absent or synthetic"),
    ("eye_movement_anomaly_score", 0.5, "L2_EYE_ANOMALY", "Eye movement pattern inconsistent with natural behavior"),
    ("skin_texture_anomaly_score", 0.5, "L2_SKIN_TEXTURE", "Skin texture inconsistency detected"),
    ("facial_symmetry_score", 0.5, "L2_FACIAL_SYMMETRY", "Unnatural facial symmetry pattern"),
)
#: Fixed values, as above.
L3_RULES = (
    ("vit_general_score", 0.6, "L3_VIT_DETECTION", "Vision Transformer detected synthetic artifacts"),
    ("efficientnet_gan_score", 0.6, "L3_GAN_DETECTION", "GAN-specific detector triggered"),
    ("tcn_temporal_score", 0.6, "L3_TEMPORAL_ANOMALY", "Temporal consistency analysis flagged anomalies"),
    ("diffusion_artifact_score", 0.6, "L3_DIFFUSION_ARTIFACT", "Diffusion model artifacts detected"),
    ("lipsync_mismatch_score", 0.6, "L3_LIPSYNC_MISMATCH", "Lip-sync mismatch with audio track"),
)


def l2_reasons(l2: Column) -> list[Column]:
    faces = F.coalesce(l2["faces_analyzed"], F.lit(0)) > 0
    return [_reason(faces & (l2[f] > b), code, "L2_BIOMETRIC", _scored(said, l2[f]), l2[f]) for f, b, code, said in L2_RULES]


def l3_reasons(l3: Column) -> list[Column]:
    text = F.concat(F.lit("Neural network ensemble indicates synthetic media (score: "), fixed(l3["ensemble_score"], 2), F.lit(", agreement: "), fixed(l3["model_agreement_ratio"] * 100.0, 0), F.lit("%)"))
    return [_reason(l3["ensemble_score"] > 0.5, "L3_ENSEMBLE_HIGH", "L3_NEURAL", text, l3["ensemble_score"])] + [_reason(l3[f] > b, code, "L3_NEURAL", _scored(said, l3[f]), l3[f]) for f, b, code, said in L3_RULES]


def context_reasons(ctx: Column) -> list[Column]:
    # fixed values: bound, codes, wording and confidences
    p = ctx["political_content_score"]
    return [
        _reason(ctx["public_figure_detected"], "CTX_PUBLIC_FIGURE", "CONTEXT", "Public figure detected -- risk multiplier applied (+0.30)", 0.90),
        _reason(p > 0.3, "CTX_POLITICAL_CONTENT", "CONTEXT", _scored("Political content detected", p, ") -- risk multiplier applied"), p),
        _reason(ctx["account_trust_anomaly"], "CTX_ACCOUNT_ANOMALY", "CONTEXT", "Account trust anomaly detected -- risk multiplier applied (+0.15)", 0.75),
    ]


def risk_score(df: DataFrame, weights: Weights = Weights(), reasons: bool = True) -> DataFrame:
    """Adds l1_score, l2_score, l3_score (null where the layer is absent), base_score, context_multiplier, risk_score, verdict and reason_codes.

    Weights are shared out anew among the layers that are there; without any the base score is 0.
    """
    l1, l2, l3, ctx = (F.col(c) for c in ("l1", "l2", "l3", "ctx"))
    df = df.withColumns({"l1_score": l1_composite(l1), "l2_score": l2_composite(l2), "l3_score": l3_composite(l3), "context_multiplier": context_multiplier(ctx)})
    active = [(F.col("l1_score"), weights.l1), (F.col("l2_score"), weights.l2), (F.col("l3_score"), weights.l3)]
    top = bottom = F.lit(0.0)
    for s, w in active:
        top = top + F.when(s.isNotNull(), s * w).otherwise(0.0)
        bottom = bottom + F.when(s.isNotNull(), w).otherwise(0.0)
    df = df.withColumn("base_score", F.when(bottom > 0, clamp01(F.try_divide(top, bottom))).otherwise(0.0))
    df = df.withColumn("risk_score", clamp01(F.col("base_score") * F.col("context_multiplier"))).withColumn("verdict", verdict(F.col("risk_score")))
    if reasons:
        df = df.withColumn("reason_codes", listed(*l1_reasons(l1, F.col("l1_score")), *l2_reasons(l2), *l3_reasons(l3), *context_reasons(ctx)))
    return df
