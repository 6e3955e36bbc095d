"""Requests, uploads and frames: what comes before the first layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scan_requests(df: DataFrame) -> DataFrame:
    """Requests (upload_id, size_bytes, max_tier, priority) as scan contexts, with `error` set where a request is refused."""
    bad = F.when(F.coalesce(F.trim("upload_id"), F.lit("")) == "", "EMPTY_UPLOAD_ID").when(F.coalesce("size_bytes", F.lit(0)) <= 0, "EMPTY_VIDEO")
    tier = F.when(F.coalesce("max_tier", F.lit(0)) <= 0, 3).otherwise(F.least(F.col("max_tier"), F.lit(3)))
    prio = F.when(F.col("priority") == 1, "LOW").when(F.col("priority") == 3, "HIGH").when(F.col("priority") == 4, "CRITICAL").otherwise("NORMAL")
    return df.withColumns({"error": bad, "scan_tier": tier.cast("int"), "scan_priority": prio, "partition_key": F.concat_ws(":", "tenant_id", "upload_id")})


def assemble_chunks(chunks: DataFrame) -> DataFrame:
    """(upload_id, chunk_index, total_chunks, data): one row for each upload; repeated chunks count once. content is null until complete."""
    one = chunks.groupBy("upload_id", "chunk_index").agg(F.min("data").alias("data"), F.max("total_chunks").alias("total_chunks"))
    got = one.groupBy("upload_id").agg(F.max("total_chunks").alias("total_chunks"), F.count("*").alias("chunks"), F.array_sort(F.collect_list(F.struct("chunk_index", "data"))).alias("_c"))
    complete = F.col("chunks") == F.col("total_chunks")
    return got.select("upload_id", "total_chunks", "chunks", complete.alias("complete"), F.when(complete, F.array_join(F.transform("_c", lambda c: c["data"]), "")).alias("content"))


def frame_schedule(df: DataFrame, size: str = "size_bytes") -> DataFrame:
    """One row for each sampled frame: every 33 ms below 10 s, every second below a minute, else every two; 300 at most.

    The 300 belong to the schedule's definition.
    """
    dur = F.greatest(F.col(size) / 500000.0, F.lit(1.0))
    step = F.when(dur < 10, 33).when(dur < 60, 1000).otherwise(2000)
    n = F.least(F.ceil(dur * 1000.0 / step), F.lit(300)).cast("int")
    return df.withColumns({"duration_secs": dur, "step_ms": step}).withColumn("frame_index", F.explode(F.sequence(F.lit(0), n - 1))).withColumn("timestamp_ms", F.col("frame_index") * F.col("step_ms"))


def little_endian_u32(i: Column) -> Column:
    """The four bytes of an unsigned integer, least first, in hexadecimal."""
    h = F.lpad(F.hex(i.cast("bigint")), 8, "0")
    return F.concat(*[F.substring(h, p, 2) for p in (7, 5, 3, 1)])


def crop_hash(crop_hex: Column, frame_index: Column) -> Column:
    """SHA-256 of the crop's bytes followed by the frame index."""
    return F.sha2(F.unhex(F.concat(crop_hex, little_endian_u32(frame_index))), 256)


def first_uploads(df: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """The first row of each key by time: idempotent uploads. Partial minima travel, not all rows of a key."""
    rest = [c for c in df.columns if c not in (key, ts, tie)]
    m = df.groupBy(key).agg(F.min(F.struct(ts, tie, *rest)).alias("m"), F.count("*").alias("copies"))
    return m.select(key, *[F.col(f"m.{c}").alias(c) for c in (ts, tie, *rest)], "copies")


def detect_faces(frames: DataFrame, least_confidence: float = 0.9, side: int = 256) -> DataFrame:
    """frames: (frame_index, pixels). The stand-in of a face detector: one face of side x side with confidence 0.98 in the corner of every
    frame that has no pixels yet, none in others; adds box and confidence, one row for each face that is sure enough."""
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(float(side)).alias("x1"), F.lit(float(side)).alias("y1"))
    face = F.struct(box.alias("box"), F.lit(0.98).alias("confidence"))
    found = F.when(F.coalesce(F.length("pixels"), F.lit(0)) == 0, F.array(face)).otherwise(F.array().cast("array<struct<box:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>>"))
    return frames.withColumn("_f", F.explode(found)).withColumns({"box": F.col("_f.box"), "confidence": F.col("_f.confidence")}).drop("_f").filter(F.col("confidence") > least_confidence)


def large_faces(df: DataFrame, least_area: float = 64.0 * 64.0) -> DataFrame:
    """Tracks with an array of boxes (x0, y0, x1, y1) whose mean area is large enough."""
    area = F.aggregate("boxes", F.lit(0.0), lambda a, b: a + (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])) / F.size("boxes")
    return df.withColumn("mean_area", area).filter(F.col("mean_area") >= least_area)


def with_track_defaults(df: DataFrame) -> DataFrame:
    """Missing track fields get their defaults; tracks without frames go."""
    n = F.col("n_frames")
    out = df.filter(F.coalesce(n, F.lit(0)) > 0)
    box = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), F.lit(224.0).alias("x1"), F.lit(224.0).alias("y1"))
    return out.withColumns({"boxes": F.coalesce("boxes", F.array_repeat(box, n)), "openness": F.coalesce("openness", F.array_repeat(F.lit(0.5), n)), "pupil_distance": F.coalesce("pupil_distance", F.lit(60.0)), "fps": F.coalesce("fps", F.lit(30.0))})
