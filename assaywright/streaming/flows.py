"""Streaming flows. They use the same transformations as batch; state is bounded by watermarks, timers and expiry."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

OUT = "scan_id bigint, l1 double, l2 double, l3 double, last_ts timestamp, complete boolean"
#: Groups of scans whose open ones are kept and timed together, the time of what has not come, and the open scans of a group as its state has them.
GROUPS, NEVER = 1024, -(1 << 63)
OPEN = np.dtype([("scan_id", np.int64), ("l", np.float64, 3), ("t", np.int64, 3), ("tier", np.int64), ("last", np.int64), ("until", np.int64)])
STATE = "l1 double, t1 bigint, l2 double, t2 bigint, l3 double, t3 bigint, tier int"


def windowed_counts(events: DataFrame, ts: str, by: list[str], size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts in tumbling or sliding windows; state older than the watermark is dropped."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    return events.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), *by, "n")


def deduplicated(events: DataFrame, key: list[str], ts: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark: at-least-once input becomes exactly-once output."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def correlate(layers: DataFrame, late: str = "1 hour", timeout_ms: int = 3_600_000) -> DataFrame:
    """layers: (scan_id, tier, score, terminal_tier, ts). One row for each scan when its terminal tier has arrived, or at the timeout.

    Messages may come in any order; the last by time wins in each tier. State is removed with the row. timeout_ms of event time
    bounds how long a scan may wait, so that scans that never complete don't stay for ever.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            l1, t1, l2, t2, l3, t3, tier = state.get
            state.remove()
            yield _row(key[0], (l1, l2, l3), max(t1, t2, t3), False)
            return
        there = state.exists
        got = list(state.get) if there else [None, -1, None, -1, None, -1, 3]
        for pdf in batches:  # a few rows a scan: plain values, as each step of pandas takes longer than all of them
            rows = sorted(zip(pdf["ts"].to_numpy().astype("datetime64[us]").astype(np.int64).tolist(), pdf["score"].tolist(), pdf["tier"].tolist(), pdf["terminal_tier"].tolist(), strict=True), key=_in_time)
            got[6] = int(rows[-1][3])
            for t, score, tier, _ in rows:  # the last of each tier wins
                at = 2 * (int(tier) - 1)
                if t >= got[at + 1]:
                    got[at], got[at + 1] = float(score), t
        last = max(got[1], got[3], got[5])
        if got[2 * (got[6] - 1)] is not None and all(got[2 * (k - 1)] is not None for k in range(1, got[6] + 1)):
            if there:
                state.remove()
            yield _row(key[0], (got[0], got[2], got[4]), last, True)
        else:
            state.update(tuple(got))
            state.setTimeoutTimestamp(max(last // 1000 + timeout_ms, state.getCurrentWatermarkMs() + 1))

    return layers.withWatermark("ts", late).groupBy("scan_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def correlate_grouped(layers: DataFrame, late: str = "1 hour", timeout_ms: int = 3_600_000, groups: int = GROUPS) -> DataFrame:
    """What correlate() gives, for many scans: one state and one call hold all open scans of a group (by the hash of scan_id), and a call goes through
    its scans as arrays, where correlate() has a call, a state and a timer for each scan.

    A group's timer is the first of its scans' timers. Keep `groups` for as long as a checkpoint is kept: states are found by it.
    """
    # messages without a scan are one scan, in a group of its own; times are counted here, whatever the session's time zone is
    scan = F.col("scan_id")
    group = F.when(scan.isNull(), -1).otherwise(F.pmod(F.hash(scan), F.lit(groups))).cast("int")
    rows = layers.withWatermark("ts", late).select(group.alias("_group"), F.coalesce(scan.cast("bigint"), F.lit(0)).alias("scan_id"), "tier", F.col("score").cast("double").alias("score"), "terminal_tier", F.unix_micros("ts").alias("t"), "ts")
    done = rows.groupBy("_group").applyInPandasWithState(_grouped_step(timeout_ms), "scan_id bigint, l1 double, l2 double, l3 double, t bigint, complete boolean", "open binary", "append", GroupStateTimeout.EventTimeTimeout)
    return done.select("scan_id", "l1", "l2", "l3", F.timestamp_micros("t").alias("last_ts"), "complete")


def _grouped_step(timeout_ms: int) -> Callable[[tuple, Iterator[pd.DataFrame], GroupState], Iterator[pd.DataFrame]]:
    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        old = np.frombuffer(bytes(state.get[0]), OPEN) if state.exists else np.empty(0, OPEN)
        new = np.empty(0, OPEN) if state.hasTimedOut else _last_of_scans(list(batches))
        now = state.getCurrentWatermarkMs()
        at = np.searchsorted(old["scan_id"], new["scan_id"])
        both = np.flatnonzero(old["scan_id"][np.minimum(at, len(old) - 1)] == new["scan_id"]) if len(old) else np.empty(0, np.int64)
        there = old[at[both]]
        for k in range(3):  # what is later wins; of equal times what came later
            keep = there["t"][:, k] > new["t"][both, k]
            for name in ("t", "l"):
                new[name][both[keep], k] = there[name][keep, k]
        new["last"][both] = np.maximum(new["last"][both], there["last"])
        new["until"] = np.maximum(new["last"] // 1000 + timeout_ms, now + 1)
        complete = ((new["t"] != NEVER) | (np.arange(1, 4) > new["tier"][:, None])).all(axis=1)
        rest = np.delete(old, at[both])
        late = rest["until"] < now
        out = np.concatenate([new[complete], rest[late]])
        still = np.concatenate([new[~complete], rest[~late]])
        if len(still):
            state.update((still[np.argsort(still["scan_id"])].tobytes(),))
            state.setTimeoutTimestamp(int(still["until"].min()))
        elif state.exists:
            state.remove()
        if len(out):
            scan = out["scan_id"] if key[0] >= 0 else pd.array([pd.NA] * len(out), "Int64")
            last = pd.array(out["last"], "Int64")
            last[out["last"] == NEVER] = pd.NA
            yield pd.DataFrame({"scan_id": scan, **{f"l{k + 1}": out["l"][:, k] for k in range(3)}, "t": last, "complete": np.arange(len(out)) < complete.sum()})

    return step


def _last_of_scans(batches: list[pd.DataFrame]) -> np.ndarray:
    """The scans of some messages in order, each with the last score of its tiers; of equal times the larger score, missing ones before all."""
    column = lambda name, kind, null=None: np.concatenate([np.asarray(b[name] if null is None else b[name].fillna(null)).astype(kind) for b in batches])
    scan, t, score = column("scan_id", np.int64), column("t", np.int64, NEVER), column("score", np.float64)
    tier, terminal = column("tier", np.int64, 0), column("terminal_tier", np.int64, 3)
    order = np.lexsort((score, t, scan))
    scan, t, score, tier, terminal = (x[order] for x in (scan, t, score, tier, terminal))
    end = np.flatnonzero(np.append(scan[1:] != scan[:-1], True))
    out = np.empty(len(end), OPEN)
    out["scan_id"], out["tier"], out["last"], out["until"], out["t"], out["l"] = scan[end], terminal[end], t[end], 0, NEVER, np.nan
    for k in range(3):
        of = np.flatnonzero((tier == k + 1) & (t != NEVER))
        of = of[np.append(scan[of][1:] != scan[of][:-1], True)] if len(of) else of
        to = np.searchsorted(out["scan_id"], scan[of])
        out["t"][to, k], out["l"][to, k] = t[of], score[of]
    return out


def _in_time(row: tuple) -> tuple:
    """The order of (t, score, ...): scores that are missing come last."""
    return row[0], row[1] != row[1], row[1]


def _row(key: int, scores: tuple, last: int, complete: bool) -> pd.DataFrame:
    # arrays of the right types, as a conversion takes ten times as long and there are as many rows as scans
    l1, l2, l3 = (np.array([np.nan if x is None else x], np.float64) for x in scores)
    return pd.DataFrame({"scan_id": np.array([key], np.int64), "l1": l1, "l2": l2, "l3": l3, "last_ts": np.array([last], "datetime64[us]"), "complete": np.array([complete])}, copy=False)


def correlate_batch(layers: DataFrame) -> DataFrame:
    """What correlate() gives over a finished input: one aggregate."""
    last = lambda t: F.max(F.when(F.col("tier") == t, F.struct("ts", "score")))["score"]
    g = layers.groupBy("scan_id").agg(last(1).alias("l1"), last(2).alias("l2"), last(3).alias("l3"), F.max("ts").alias("last_ts"), F.max("terminal_tier").alias("_t"))
    done = F.when(F.col("_t") >= 1, F.col("l1").isNotNull()) & ((F.col("_t") < 2) | F.col("l2").isNotNull()) & ((F.col("_t") < 3) | F.col("l3").isNotNull())
    return g.withColumn("complete", done).drop("_t")


def join_layers(a: DataFrame, b: DataFrame, ta: str, tb: str, within: str) -> DataFrame:
    """Two watermarked streams on scan_id, times no further apart than `within`; rows past it leave the state."""
    near = F.col(tb).between(F.col(ta) - F.expr(f"INTERVAL {within}"), F.col(ta) + F.expr(f"INTERVAL {within}"))
    other = b.withColumnRenamed("scan_id", "_scan")
    return a.join(other, (F.col("scan_id") == F.col("_scan")) & near).drop("_scan")


def fan_out(sinks: dict[str, Callable[[DataFrame], DataFrame]], root: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: derives each record table from the batch and writes it under its batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for name, derive in sinks.items():
                derive(batch).write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")
        finally:
            batch.unpersist()

    return write


def session_counts(events: DataFrame, ts: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    """Sessions of each key, closed by a gap without events: (by..., session_start, session_end, n)."""
    s = F.session_window(ts, gap)
    return events.withWatermark(ts, late).groupBy(*by, s.alias("w")).agg(F.count("*").alias("n")).select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def guarded(write: Callable[[DataFrame, int], None], dead: str, attempts: int = 3, wait: Callable[[int], float] = lambda n: 0.0) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: up to `attempts` tries of write, wait(n) seconds after the n-th; then the batch goes to the dead letters below
    `dead`, with what stopped it, and the stream goes on. A batch that comes again replaces its own letters."""

    def run(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        try:
            for n in range(1, attempts + 1):
                try:
                    write(batch, number)
                    return
                except Exception as e:  # noqa: BLE001  whatever stops a batch must not stop the stream
                    said = f"{type(e).__name__}: {e}"[:200]
                    if n < attempts:
                        time.sleep(wait(n))
            batch.withColumns({"error": F.lit(said), "attempts": F.lit(attempts)}).write.mode("overwrite").parquet(f"{dead}/batch={number}")
        finally:
            batch.unpersist()

    return run


def run_every(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """A periodic job: starts a query that looks for new rows at fixed times, and returns it to be stopped by the caller."""
    return df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def run_to_end(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is there and stop."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_batches(df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    q = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
