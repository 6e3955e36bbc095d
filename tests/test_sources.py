from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from assaywright.operators import analytics, ops
from assaywright.sources import readers


def test_envelopes(spark):
    good = '{"message_id":"m","timestamp":"2024-01-01T00:00:00","tenant_id":"t","scan_id":"s","payload":"{\\"score\\": 0.5}"}'
    df = spark.createDataFrame([(good,), ("",), (None,), ("{}",), (good.replace('{\\"score\\": 0.5}', "oops"),)], "value string")
    ok, bad = readers.parse_envelopes(df, T.StructType([T.StructField("score", T.DoubleType())]))
    assert [r["payload"]["score"] for r in ok.collect() if r["payload"]["score"] is not None] == [0.5]
    assert ok.count() + bad.count() == 5


def test_months_are_pruned(spark, tmp_path):
    df = spark.range(90).select(F.col("id").alias("scan_id"), (F.col("id") % 3).alias("tenant_id"), (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval(F.col("id").cast("int"))).alias("ts"))
    path = str(tmp_path / "t")
    readers.write_by_month(df, path)
    assert readers.read_months(spark, path, "202402", "202402").count() == 29


def test_config():
    c = readers.Config.from_env(env={"ASSAY__INPUT_PATH": "/x", "ASSAY__MAX_FILES": "7"})
    assert (c.input_path, c.max_files) == ("/x", 7)


def test_additive_state_merges(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("tenant_id"), F.lit("2024-01-01").cast("timestamp").alias("ts"), F.lit("ALLOW").alias("verdict"), (F.col("id") / 100.0).alias("risk_score"), F.col("id").cast("double").alias("duration_ms"))
    whole = analytics.finalise(analytics.additive_state(df, "hour"))
    parts = analytics.finalise(analytics.merge_state(*[analytics.additive_state(df.filter(F.col("id") % 3 == k) if "id" in df.columns else df.filter((F.col("duration_ms") % 3) == k), "hour") for k in range(3)]))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))


def test_histogram_of_nothing(spark):
    df = spark.createDataFrame([], "k int, v double")
    assert ops.histogram(df, "v", ["k"]).count() == 0


def test_webhook_signature(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("a",), (None,)], "b string").select(readers.hmac_sha256("k")(F.col("b")).alias("s")).collect()
    assert [r["s"] for r in got] == [hmac.new(b"k", b"a", hashlib.sha256).hexdigest(), None]
