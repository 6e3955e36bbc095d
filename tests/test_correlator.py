"""The correlator that keeps scans in groups, against the one that keeps each scan by itself."""

from __future__ import annotations

import datetime
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from assaywright.streaming import flows


class State:
    """What a step sees of Spark's state of one key."""

    def __init__(self):
        self.value, self.until, self.now, self.hasTimedOut = None, None, 0, False

    exists = property(lambda self: self.value is not None)
    get = property(lambda self: self.value)

    def update(self, value):
        self.value = value

    def remove(self):
        self.value = None

    def setTimeoutTimestamp(self, t):
        assert t >= self.now and t > 0
        self.until = t

    def getCurrentWatermarkMs(self):
        return self.now


class Layers:
    def withWatermark(self, *_):
        return self

    groupBy = withWatermark

    def applyInPandasWithState(self, step, *_):
        return step


def run(step, batches: list[pd.DataFrame], key: str, marks: list[int], chunk: int) -> list[list[tuple]]:
    """The rows of each micro-batch, as Spark calls a step: keys with messages first, then those whose timer the watermark has passed."""
    states, out = {}, []
    for batch, now in zip(batches, marks, strict=True):
        rows, calls = [], [(k, part, False) for k, part in batch.groupby(key)]
        for k, part, timed in calls + [(k, None, True) for k in states]:
            state = states.setdefault(k, State())
            if timed and not (state.exists and state.until < now):
                continue
            state.now, state.hasTimedOut = now, timed
            for got in step((k,), iter([] if timed else [part.iloc[i : i + chunk] for i in range(0, len(part), chunk)]), state):
                rows += [tuple(None if pd.isna(v) else v for v in r) for r in got.itertuples(index=False)]
        out.append(sorted(rows, key=str))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_groups_give_what_single_scans_give(seed):
    r = random.Random(seed)
    batches = []
    for n in (300, 200, 0, 150, 40, 0, 0):
        rows = [(r.randrange(120), r.choice((1, 1, 2, 3)), r.choice((r.random(), 0.5, np.nan)), 0, r.randrange(0, 4000) * 1000) for _ in range(n)]
        pdf = pd.DataFrame([(a, b, c, a % 3 + 1, 1_700_000_000_000_000 + t * 100) for a, b, c, _, t in rows], columns=["scan_id", "tier", "score", "terminal_tier", "t"])
        batches.append(pdf.astype({"scan_id": "int64", "tier": "int32", "score": "float64", "terminal_tier": "int32", "t": "int64"}).assign(ts=lambda x: pd.to_datetime(x["t"], unit="us"), _group=lambda x: x["scan_id"] % 5))
    marks = [0, *(1_700_000_000_000 + x for x in (150_000, 200_000, 260_000, 300_000, 400_000, 1_000_000))]
    single = run(flows.correlate(Layers(), timeout_ms=20_000), batches, "scan_id", marks, 1000)
    grouped = run(flows._grouped_step(20_000), batches, "_group", marks, 7)
    plain = lambda out: [[(int(a), b, c, d, pd.Timestamp(t, unit="us") if not isinstance(t, pd.Timestamp) else t, bool(e)) for a, b, c, d, t, e in rows] for rows in out]
    assert [sorted(x, key=str) for x in plain(grouped)] == [sorted(x, key=str) for x in plain(single)]
    assert sum(map(len, single)) > 120 and any(not row[-1] for rows in single for row in rows)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_groups_on_a_stream(spark, tmp_path, zone):
    """States are as few as groups; messages without a scan are one; times don't depend on the session's zone."""
    at = datetime.datetime(2024, 3, 10, 6, 30, tzinfo=datetime.timezone.utc)  # half an hour before the clocks change there
    micros = int(at.timestamp() * 1e6)
    rows = [(i, tier, i + tier / 10, 2, micros + 1_800_000_000 * tier + i) for i in range(400) for tier in ((1, 2) if i % 2 else (1,))]
    rows += [(None, 1, 0.5, 1, micros), (1000, 1, None, 1, micros + 5 * 3_600_000_000), (1001, 1, 1.0, 2, micros + 5 * 3_600_000_000)]
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame(rows, "scan_id bigint, tier int, score double, terminal_tier int, t bigint").select("scan_id", "tier", "score", "terminal_tier", F.timestamp_micros("t").alias("ts"))
        df.coalesce(1).write.parquet(f"{tmp_path}/in")
        layers = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
        q = flows.correlate_grouped(layers, "1 hour", groups=3).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
        q.awaitTermination()
        assert max(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress) <= 4
        got = spark.read.schema(flows.OUT).parquet(f"{tmp_path}/out").withColumn("last_ts", F.unix_micros("last_ts"))
        want = [(i, i + 0.1, i + 0.2 if i % 2 else None, None, micros + 1_800_000_000 * (2 if i % 2 else 1) + i, bool(i % 2)) for i in range(400)]
        want += [(None, 0.5, None, None, micros, True), (1000, None, None, None, micros + 5 * 3_600_000_000, True)]
        assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
