"""First layer: metadata and compression rules, and the decision."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp01, listed

#: Substrings of face-swapping tools and their names; each adds 0.7.
TOOLS = (
    ("deepfacelab", "DeepFaceLab"), ("faceswap", "FaceSwap"), ("faceswap-gan", "FaceSwap-GAN"), ("deepfakes", "Deepfakes"), ("facefusion", "FaceFusion"), ("roop", "Roop"),
    ("simswap", "SimSwap"), ("ghost", "GHOST"), ("infoswap", "InfoSwap"), ("hififace", "HiFiFace"), ("megaportraits", "MegaPortraits"),
)
#: Substrings of editing tools and what they add.
SUSPICIOUS = (
    ("after effects", 0.15), ("premiere", 0.05), ("davinci resolve", 0.05), ("ffmpeg", 0.10), ("handbrake", 0.08), ("obs", 0.03),
    ("avisynth", 0.12), ("vapoursynth", 0.12), ("nuke", 0.10), ("blender", 0.10),
)
#: Names of transcoders in encoder strings, and usual shapes of pictures.
TRANSCODERS = ("ffmpeg", "handbrake", "avidemux", "mencoder")
ASPECTS = (16.0 / 9.0, 9.0 / 16.0, 4.0 / 3.0, 3.0 / 4.0, 1.0)


@dataclass(frozen=True)
class L1Config:
    metadata: float = 0.4
    compression: float = 0.5
    combined: float = 0.35


def searchable(md: str = "md") -> Column:
    """Encoder, codec, container and key=value tags in lower case, joined by spaces."""
    tags = F.coalesce(F.transform(F.col(f"{md}.exif_tags"), lambda t: F.concat(t["key"], F.lit("="), t["value"])), F.array().cast("array<string>"))
    return F.lower(F.array_join(F.concat(listed(F.col(f"{md}.encoder"), F.col(f"{md}.codec"), F.col(f"{md}.container")), tags), " "))


def metadata_scan(df: DataFrame, md: str = "md") -> DataFrame:
    """Adds metadata_score, detected_tools and metadata_codes. Names are plain substrings, so one may be found inside another."""
    m = lambda c: F.col(f"{md}.{c}")
    df = df.withColumn("_text", searchable(md))
    has = lambda s: F.contains(F.col("_text"), F.lit(s))
    score = F.lit(0.0)
    tools, codes = [], []
    for pattern, name in TOOLS:
        score = score + F.when(has(pattern), 0.7).otherwise(0.0)
        tools.append(F.when(has(pattern), F.lit(name)))
        codes.append(F.when(has(pattern), F.lit("L1_META_TOOL_" + name.upper())))
    for pattern, w in SUSPICIOUS:
        score = score + F.when(has(pattern), w).otherwise(0.0)
        tools.append(F.when(has(pattern), F.lit(pattern)))
        codes.append(F.when(has(pattern), F.lit("L1_META_SUSPICIOUS_" + pattern.upper().replace(" ", "_"))))
    stripped = (F.coalesce(F.size(m("exif_tags")), F.lit(0)) <= 0) & m("encoder").isNull() & m("codec").isNotNull()
    aspect = F.try_divide(m("width").cast("double"), m("height").cast("double"))
    odd = aspect.isNotNull()
    for a in ASPECTS:
        odd = odd & (F.abs(aspect - a) >= 0.02)
    score = score + F.when(stripped, 0.15).otherwise(0.0) + F.when(odd, 0.08).otherwise(0.0)
    codes += [F.when(stripped, F.lit("L1_META_STRIPPED")), F.when(odd, F.lit("L1_META_NONSTANDARD_ASPECT"))]
    score = F.when(m("c2pa_valid"), F.greatest(score - 0.2, F.lit(0.0))).otherwise(score)
    return df.withColumns({"metadata_score": clamp01(score), "detected_tools": listed(*tools), "metadata_codes": listed(*codes)}).drop("_text")


def compression_scan(df: DataFrame, md: str = "md") -> DataFrame:
    """Adds gop_cv, bitrate_ratio, compression_score and compression_codes. The deviation is that of the population."""
    m = lambda c: F.col(f"{md}.{c}")
    g = m("gop_sizes")
    n = F.coalesce(F.size(g), F.lit(0))
    mean = F.aggregate(g, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(g)
    var = F.aggregate(g, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / F.size(g)
    df = df.withColumn("gop_cv", F.when(n >= 2, F.when(mean > 0, F.sqrt(var) / mean).otherwise(0.0)))
    cv = F.col("gop_cv")
    expected = m("width").cast("double") * m("height").cast("double") * 0.1 * F.coalesce(m("fps"), F.lit(30.0)) / 1000.0
    df = df.withColumn("bitrate_ratio", F.try_divide(m("bitrate_kbps"), expected))
    r = F.col("bitrate_ratio")
    enc = F.lower(m("encoder"))
    transcoded = F.lit(False)
    for t in TRANSCODERS:
        transcoded = transcoded | F.coalesce(F.contains(enc, F.lit(t)), F.lit(False))
    transcoded = transcoded & (n > 0)
    score = F.when(cv > 0.3, F.least(cv - 0.3, F.lit(0.5))).otherwise(0.0) + F.when(r < 0.15, F.least(F.lit(0.15) - r, F.lit(0.3))).otherwise(0.0)
    score = score + F.when(r > 4.0, F.least((r - 4.0) * 0.05, F.lit(0.2))).otherwise(0.0) + F.when(transcoded, 0.05).otherwise(0.0)
    codes = listed(F.when(cv > 0.3, F.lit("L1_COMP_GOP_INCONSISTENT")), F.when(r < 0.15, F.lit("L1_COMP_UNDERCOMPRESSED")), F.when(r > 4.0, F.lit("L1_COMP_OVERCOMPRESSED")), F.when(transcoded, F.lit("L1_COMP_TRANSCODED")))
    return df.withColumns({"compression_score": clamp01(score), "compression_codes": codes})


def match_confidence(distance: Column) -> Column:
    return F.when(distance == 0, 1.0).when(distance <= 3, 0.95).when(distance <= 6, 0.85).otherwise(0.70)


def decide(df: DataFrame, config: L1Config = L1Config()) -> DataFrame:
    """df: metadata_score, compression_score and match_distance (null: no match). Adds decision."""
    m, c, d = F.col("metadata_score"), F.col("compression_score"), F.col("match_distance")
    up = (m >= config.metadata) | (c >= config.compression) | (m * 0.6 + c * 0.4 >= config.combined)
    return df.withColumn("decision", F.when(d <= 3, "BLOCK").when(d.isNotNull(), "ESCALATE").when(up, "ESCALATE").otherwise("ALLOW"))


def edge_action(df: DataFrame, most_bytes: int = 500_000_000) -> DataFrame:
    """What an edge node does with an upload: reject, block or forward, and how far the cloud goes on."""
    bad = ~F.coalesce(F.col("valid_format"), F.lit(False)) | (F.col("size_bytes") > most_bytes)
    action = F.when(bad, "REJECT").when(F.col("match_distance") == 0, "BLOCK").when(F.size("detected_tools") > 0, "FORWARD_HIGH").otherwise("FORWARD_NORMAL")
    return df.withColumn("edge_action", action).withColumn("cloud_tiers", F.when(F.col("edge_action") == "FORWARD_HIGH", "L1+L2+L3").when(F.col("edge_action") == "FORWARD_NORMAL", "L1+L2").when(F.col("edge_action") == "BLOCK", "AUDIT").otherwise("NONE"))


def frame_entropy(grid: Column, levels: int = 16) -> Column:
    """Shannon entropy in bits of the luminances (0 to 255) of a frame, over `levels` equal steps."""
    step = 256 // levels
    counts = F.transform(F.sequence(F.lit(0), F.lit(levels - 1)), lambda k: F.size(F.filter(grid, lambda x: F.floor(x / step) == k)))
    share = lambda n: n / F.size(grid)
    return F.aggregate(counts, F.lit(0.0), lambda acc, n: acc - F.when(n > 0, share(n) * F.log2(share(n))).otherwise(0.0))


def timestamp_scan(df: DataFrame, created: str = "created_at", modified: str = "modified_at", uploaded: str = "uploaded_at", slack: int = 86400) -> DataFrame:
    """Adds timestamp_codes: a modification before the creation, either after the upload (but for `slack` seconds of wrong clocks), and
    missing times."""
    t = lambda c: F.unix_timestamp(c)
    late = F.greatest(t(created), t(modified)) > t(uploaded) + slack
    return df.withColumn("timestamp_codes", listed(F.when(t(modified) < t(created), F.lit("L1_META_TIME_ORDER")), F.when(late, F.lit("L1_META_TIME_FUTURE")), F.when(F.col(created).isNull() & F.col(modified).isNull(), F.lit("L1_META_TIME_MISSING"))))
