"""Components, rates with keyed state, topic segments, texture, sketches, subsets."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from assaywright.operators import graph, hashing, ops, texture
from assaywright.sources import segments
from assaywright.streaming import anomaly, flows


def rows_of(df) -> list[tuple]:
    return sorted(map(tuple, df.collect()), key=repr)


def roots_of(pairs: list[tuple]) -> dict:
    up: dict = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}


def test_components(spark):
    rnd = random.Random(2)
    pairs = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(170)]
    pairs += [(1000 + i, 1001 + i) for i in range(120)]  # a long chain
    pairs += [(2000, 2001 + i) for i in range(300)] + [(7, 7), (2000, 2001)]  # a hot node, a loop, a repeat
    got = dict(map(tuple, graph.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()))
    assert got == roots_of([p for p in pairs if p[0] != p[1]])
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


def test_links(spark):
    rows = [(i, i % 4 if i % 3 else None, 1 << (i % 8)) for i in range(40)] + [(100, None, None), (101, 9, 0b11)]
    df = spark.createDataFrame(rows, "n bigint, k bigint, h bigint")
    shared = rows_of(graph.shared_links(df, "n", "k"))
    assert len(shared) == sum(1 for _, k, _ in rows if k is not None) - 5  # a star for each value
    of = roots_of(shared)
    assert all((of.get(a, a) == of.get(b, b)) == (ka == kb) for a, ka, _ in rows for b, kb, _ in rows if ka is not None and kb is not None)
    near = roots_of(rows_of(graph.near_links(df, "n", "h", 1)))
    assert near[101] == near[0] == near[9] and near[8] == near[0] and near.get(2, 2) == 2 and 100 not in near


def rates_brute(windows: list[tuple], least: int, factor: int, idle: timedelta) -> list[tuple]:
    out, seen = [], {}
    for key, start, n in sorted(windows, key=lambda w: (w[0], w[1])):
        past, last = seen.get(key, ([], None))
        if last is not None and start - last > idle:
            past = []
        if len(past) >= least:
            mean = sum(past) / len(past)
            spread = sum((x - mean) ** 2 for x in past) / len(past)
            if (n - mean) ** 2 > factor**2 * spread + 1e-9:
                out.append((key, start, n, len(past), "HIGH" if n > mean else "LOW"))
        seen[key] = ([*past, n], start)
    return out


def test_rates_deviate_from_their_past(spark, tmp_path):
    rnd = random.Random(9)
    start, windows = datetime(2024, 1, 1), []
    for key in ("a", "b", "c"):
        t = start
        for _ in range(40):
            windows.append((key, t, rnd.choice([3, 4, 5, 4, 4, 30])))
            t += timedelta(hours=rnd.choice([1, 1, 1, 2, 30]))
    events = [(k, t + timedelta(seconds=i)) for k, t, n in windows for i in range(n)]
    end = max(t for _, t in events)
    src = spark.createDataFrame(events, "key string, ts timestamp")
    for part in range(3):  # in order of time: each part is a batch or several
        lo, hi = (start + (end - start) * p / 3 for p in (part, part + 1))
        src.filter((F.col("ts") >= F.lit(lo)) & ((F.col("ts") < F.lit(hi)) | F.lit(part == 2))).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(src.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with anomaly.rocks_state(spark):
        flows.run_to_end(anomaly.rate_anomalies(stream, "ts", ["key"], "1 hour", late="0 seconds", least=4, factor=2, idle=timedelta(hours=10)), f"{tmp_path}/out", f"{tmp_path}/cp")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
    closed = [w for w in windows if w[1] + timedelta(hours=1) <= end]
    want = rates_brute(closed, 4, 2, timedelta(hours=10))
    assert rows_of(spark.read.parquet(f"{tmp_path}/out")) == sorted(want, key=repr) and want


def messages(spark, n: int):
    return spark.range(n).select((F.col("id") % 7).alias("user"), "id", F.concat(F.lit("m"), F.col("id").cast("string")).alias("value"), F.timestamp_seconds("id").alias("timestamp"))


def test_segments_have_offsets_without_gaps(spark, tmp_path):
    segments.write_segments(messages(spark, 500), f"{tmp_path}/t", ["user"], "id", parts=3, length=40)
    spark.dataSource.register(segments.SegmentLog)
    got = spark.read.format("segment_log").load(f"{tmp_path}/t").collect()
    by: dict[int, list] = {}
    for r in got:
        by.setdefault(r["partition"], []).append((r["offset"], int(r["value"][1:]), r["key"], r["timestamp"]))
    assert sum(map(len, by.values())) == 500
    for p, some in by.items():
        some.sort()
        assert [o for o, *_ in some] == list(range(len(some))) and [i for _, i, *_ in some] == sorted(i for _, i, *_ in some)
        assert all(k == str(i % 7) and t == datetime(1970, 1, 1) + timedelta(seconds=i) for _, i, k, t in some)
        assert all(first % 40 == 0 for first, _, _ in segments.segments(f"{tmp_path}/t")[p])
    assert len({k for some in by.values() for _, _, k, _ in some}) == 7
    late = spark.read.format("segment_log").option("startingOffsets", json.dumps({str(p): len(s) - 1 for p, s in by.items()})).load(f"{tmp_path}/t")
    assert late.count() == len(by)


@pytest.mark.parametrize("most", [0, 60])
def test_a_stream_of_segments_is_taken_up_again(spark, tmp_path, most):
    root = str(tmp_path)
    segments.write_segments(messages(spark, 300), f"{root}/t", ["user"], "id", parts=3, length=50)
    spark.dataSource.register(segments.SegmentLog)
    sizes = []

    def run(fail: bool) -> None:
        src = spark.readStream.format("segment_log").option("commitPath", f"{root}/done")
        src = (src.option("maxOffsetsPerTrigger", most) if most else src).load(f"{root}/t")

        def sink(batch, number):
            batch.write.mode("overwrite").parquet(f"{root}/out/batch={number}")
            sizes.append(batch.count())
            if fail and number == (1 if most else 0):
                raise InterruptedError("stopped")

        q = src.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/cp").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()

    with pytest.raises(Exception, match="stopped"):
        run(True)
    run(False)
    # a topic that grows: 100 further messages, whose offsets go on
    ends = segments._ends(f"{root}/t")
    more = messages(spark, 400).filter("id >= 300")
    segments.write_segments(more, f"{root}/more", ["user"], "id", parts=3, length=50)
    import os
    import shutil

    for p, some in segments.segments(f"{root}/more").items():
        for first, last, folder in some:
            at = ends[str(p)]
            shutil.copytree(folder, f"{root}/t/partition={p}/segment={at + first}-{at + last}")
    run(False)
    out = spark.read.parquet(f"{root}/out").select("partition", "offset", "value").collect()
    assert sorted(int(r["value"][1:]) for r in out) == list(range(400))  # none lost, none twice
    if most:
        assert max(sizes) <= most and len(sizes) >= 7
    assert segments.SegmentStream({"path": f"{root}/t", "commitPath": f"{root}/done"})._written() == segments._ends(f"{root}/t")
    assert os.listdir(f"{root}/done")


def test_texture(spark):
    flat, checks, steps = [100] * 64, [(i + i // 8) % 2 * 200 for i in range(64)], [i % 8 * 20 for i in range(64)]
    df = spark.createDataFrame([(0, flat), (1, checks), (2, steps), (3, [1, 2]), (4, None)], "i int, g array<int>")
    got = {r["i"]: r for r in texture.skin_texture(df, "g").collect()}
    assert (got[0]["contrast"], got[0]["homogeneity"], got[0]["uniform_share"], got[0]["patterns"]) == (0.0, 1.0, 1.0, 1)
    assert got[1]["contrast"] == 40000.0 and got[1]["homogeneity"] == 0.0 and got[1]["uniform_share"] == 0.5
    assert got[2]["contrast"] == 400.0 and got[2]["uniform_share"] == 1.0
    assert got[3]["contrast"] is None and got[4]["patterns"] is None


def test_reflections(spark):
    spot = lambda x, y: [255 if (i % 8, i // 8) == (x, y) else 10 for i in range(64)]
    df = spark.createDataFrame([(0, spot(2, 2), spot(2, 2)), (1, spot(0, 0), spot(3, 4)), (2, spot(0, 0), spot(7, 7)), (3, None, spot(1, 1))], "i int, a array<int>, b array<int>")
    got = {r["i"]: r for r in texture.corneal_reflections(df, "a", "b").collect()}
    assert (got[0]["shift"], got[0]["corneal_score"]) == (0.0, 0.0)
    assert got[1]["shift"] == 5.0 and got[1]["corneal_score"] == 1.0 and got[2]["corneal_score"] == 1.0 and got[3]["shift"] is None
    assert got[0]["left_cells"] == got[0]["right_cells"] == 1


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("t"), (F.col("id") % 50).alias("hour"), (F.col("id") * 7919 % 20_011).cast("double").alias("v")).withColumn("v", F.when(F.col("t") == 2, F.lit(5.0)).otherwise(F.col("v")))
    some = ops.merged_sketches(ops.latency_sketches(df, "v", ["t", "hour"]), ["t"])
    for q in (0.01, 0.5, 0.99):
        for r in ops.sketch_quantile(some, q).collect():
            values = sorted(x["v"] for x in df.filter(F.col("t") == r["t"]).select("v").collect())
            lo, hi = sum(v < r["quantile"] for v in values), sum(v <= r["quantile"] for v in values)
            assert lo <= (q + 0.02) * len(values) and hi >= (q - 0.02) * len(values) and r["n"] == len(values)
    assert ops.merged_sketches(ops.latency_sketches(df.withColumn("v", F.lit(None).cast("double")), "v", ["t"]), ["t"]).count() == 0


def test_largest(spark):
    rnd = random.Random(4)
    rows = [(f"r{i}" if i % 9 else f"r{i}é", rnd.choice([1, 2, 2, 2, 10**12, -5, None, rnd.randrange(10**6)])) for i in range(400)]
    df = spark.createDataFrame(rows, "ref_id string, n bigint").repartition(4)
    order = sorted(rows, key=lambda r: (-(r[1] if r[1] is not None else -(1 << 62)), r[0].encode()))
    for n in (1, 7, 60, 150, 333, 399, 400, 900):
        assert rows_of(hashing.largest(df, n, "n")) == sorted(((k,) for k, _ in order[:n]), key=repr), n
    assert hashing.largest(df.limit(0), 5, "n").count() == 0


def test_circuit_breaker_by_blocks(spark):
    rnd = random.Random(6)
    calls = [(rnd.choice("xy"), i, datetime(2024, 1, 1) + timedelta(seconds=rnd.randrange(900)), rnd.random() < 0.4) for i in range(500)]
    df = spark.createDataFrame(calls, "service string, call_id bigint, ts timestamp, failed boolean")
    for seconds in (0, 1, 30, 5000):
        got = {r["call_id"]: (r["recent_failures"], r["open"]) for r in ops.circuit_breaker(df, 3, seconds).collect()}
        for s, i, t, _ in calls:
            n = sum(f for s2, _, t2, f in calls if s2 == s and timedelta(0) <= t - t2 <= timedelta(seconds=seconds))
            assert got[i] == (n, n >= 3)


def test_circuit_breaker_takes_running_sums(spark):
    """A frame that is summed anew for each of its seconds takes the square of its length."""
    df = spark.createDataFrame([("a", 1, 100, True)], "service string, call_id bigint, t bigint, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    plan = ops.circuit_breaker(df, 3, 21600)._jdf.queryExecution().optimizedPlan().toString()
    assert "specifiedwindowframe(RangeFrame, unboundedpreceding$(), currentrow$())" in plan and "-21600" not in plan


def test_circuit_breaker_against_brute_force_over_full_seconds(spark):
    rows = [("ab"[i % 2], i, (i * 7919) % 97 - 40, i % 3 == 0) for i in range(600)]
    df = spark.createDataFrame(rows, "service string, call_id bigint, t bigint, failed boolean").withColumn("ts", F.timestamp_seconds("t"))
    for seconds in (0, 1, 9, 200):
        want = {i: sum(f and s == service and t - seconds <= u <= t for s, _, u, f in rows) for service, i, t, _ in rows}
        assert {r["call_id"]: r["recent_failures"] for r in ops.circuit_breaker(df, 3, seconds).collect()} == want


def test_fan_out_takes_bounded_batches(spark, monkeypatch):
    from assaywright.plans import records

    monkeypatch.setattr(records, "ROWS_A_FILE", 50, raising=False)
    data = "/root/testdata/sf0.001"
    n = spark.read.parquet(f"{data}/events.parquet").count()
    got = records.stream_fanout(spark, data)
    assert got.filter("record = 'audit'").count() == n
    batches = {x.split("/batch=")[1].split("/")[0] for x in got.inputFiles() if "/audit/" in x}
    assert len(batches) >= n // 50 // (2 * spark.sparkContext.defaultParallelism) > 1


def test_correlator_of_a_scan_takes_no_pandas_steps(monkeypatch):
    """There are as many calls as scans, so sorting, grouping and converting tables of five rows was nearly all of the time."""
    import numpy as np
    import pandas as pd

    class State:
        hasTimedOut, exists, got = False, False, None

        def __init__(self, got=None):
            self.exists, self.get = got is not None, got

        def update(self, got):
            self.got = got

        def remove(self):
            self.got = None

        def setTimeoutTimestamp(self, t):
            self.until = t

        def getCurrentWatermarkMs(self):
            return 0

    class Layers:
        def withWatermark(self, *_):
            return self

        groupBy = withWatermark

        def applyInPandasWithState(self, step, *_):
            return step

    step = flows.correlate(Layers(), timeout_ms=1000)

    def never(*_, **__):
        raise AssertionError("a step of pandas")

    at = pd.to_datetime([30, 10, 30, 20], unit="s")
    part = pd.DataFrame({"tier": [1, 2, 1, 1], "score": [0.5, 0.25, 0.125, np.nan], "terminal_tier": [3, 3, 2, 3], "ts": at})
    for name in ("sort_values", "groupby", "astype"):
        monkeypatch.setattr(pd.DataFrame, name, never)
    out = list(step((7,), iter([part.iloc[:2]]), state := State()))
    assert not out and state.got == (0.5, 30_000_000, 0.25, 10_000_000, None, -1, 3) and state.until == 31_000
    (row,) = step((7,), iter([part.iloc[[0, 2, 1]].assign(terminal_tier=2)]), State())  # of equal times the larger score
    assert row.iloc[0][["scan_id", "l1", "l2", "complete"]].tolist() == [7, 0.5, 0.25, True] and np.isnan(row["l3"][0]) and row["last_ts"][0] == at[0]


def test_near_links_are_dealt_to_more_tasks_as_rows_grow(spark, monkeypatch):
    monkeypatch.setattr(graph, "ROWS_A_TASK", 8, raising=False)
    rows = [(i, (i // 4) * 0x1234567F1 ^ (1 << i % 4)) for i in range(100)]
    links = graph.near_links(spark.createDataFrame(rows, "n bigint, h bigint"), "n", "h", 6)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert sum("hashpartitioning(_b#" in x and ", 13), REPARTITION_BY_NUM" in x for x in plan.splitlines()) >= 2
    near = {(a, b) for a, x in rows for b, y in rows if a < b and (x ^ y).bit_count() <= 6}
    assert len(near) > 100 and {tuple(x) for x in links.collect()} == near
