"""Row types of scans, layer results, policies and records, and the fixed names used in them."""

from __future__ import annotations

from pyspark.sql import types as T

_TAG = T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T.StringType())])
_KINDS = {"boolean": T.BooleanType(), "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "timestamp": T.TimestampType(), "array<string>": T.ArrayType(T.StringType()), "array<int>": T.ArrayType(T.IntegerType()), "array<tag>": T.ArrayType(_TAG)}


def _struct(ddl: str) -> T.StructType:
    """Fields as "name type, name type"; made without a session."""
    return T.StructType([T.StructField(name, _KINDS[kind]) for name, kind in (f.split() for f in ddl.split(","))])


#: Names of verdicts, priorities and permissions.
VERDICTS = ("ALLOW", "FLAG", "FLAG_URGENT", "BLOCK")
PRIORITIES = ("LOW", "NORMAL", "HIGH", "CRITICAL")
PERMISSIONS = ("analyze", "read_verdicts", "manage_policies", "review", "view_analytics", "export_reports", "manage_keys", "sandbox", "admin")

REASON = "struct<code:string,category:string,explanation:string,confidence:double>"
L1 = _struct("hash_match_found boolean, hash_match_id string, metadata_anomaly_score double, compression_anomaly_score double, c2pa_chain_valid boolean, detected_editing_tools array<string>, duration_ms int")
L2 = _struct("micro_flicker_score double, rppg_absence_score double, rppg_signal_quality double, eye_movement_anomaly_score double, skin_texture_anomaly_score double, facial_symmetry_score double, faces_analyzed int, duration_ms int")
L3 = _struct("vit_general_score double, efficientnet_gan_score double, tcn_temporal_score double, diffusion_artifact_score double, lipsync_mismatch_score double, ensemble_score double, model_agreement_ratio double, duration_ms int")
CONTEXT = _struct("public_figure_detected boolean, political_content_score double, account_trust_anomaly boolean")
ENVELOPE = _struct("message_id string, timestamp timestamp, tenant_id string, scan_id string, payload string")
METADATA = _struct("codec string, container string, encoder string, exif_tags array<tag>, bitrate_kbps double, fps double, duration_secs double, width int, height int, gop_sizes array<int>, c2pa_valid boolean")
#: The five models of the last layer: column of their score and weight in the ensemble.
MODELS = {"vit_general": 0.30, "efficientnet_gan": 0.25, "tcn_temporal": 0.20, "diffusion_artifact": 0.15, "lipsync_mismatch": 0.10}
