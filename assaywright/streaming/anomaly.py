"""Deviations of rates from their own past, on streams, with keyed state."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .flows import windowed_counts

#: Windows that a key must have behind it, standard deviations that count as deviation, and how long a key without events is remembered.
LEAST, FACTOR, IDLE = 5, 3, timedelta(days=7)


def _millis(t: datetime) -> int:
    return int((t if t.tzinfo else t.replace(tzinfo=UTC)).timestamp() * 1000)


class RateMonitor(StatefulProcessor):
    """Gets the counts of closed windows, in their order for each key, and keeps how many there were, their sum and their sum of squares.

    A count deviates if it lies more than `factor` standard deviations from the mean of the windows before it; mean and deviation are compared
    in whole numbers, n * count - sum against factor times the root of n * squares - sum squared, so there is no rounding. The
    state of a key is forgotten when the key has had no window for `idle`: at its next window, or by a timer if there is none.
    """

    def __init__(self, by: list[str], least: int = LEAST, factor: int = FACTOR, idle: timedelta = IDLE):
        self.by, self.least, self.factor, self.idle = by, least, factor, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "n bigint, total bigint, squares bigint, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        n, total, squares, last = self.seen.get() if self.seen.exists() else (0, 0, 0, None)
        idle = self.idle // timedelta(milliseconds=1)
        for r in sorted(rows, key=lambda r: r["window_start"]):
            at = _millis(r["window_start"])
            if last is not None and at - last > idle:
                n, total, squares = 0, 0, 0
            off, spread = n * r["n"] - total, n * squares - total * total
            if n >= self.least and off * off > self.factor**2 * spread:
                yield Row(**dict(zip(self.by, key, strict=True)), window_start=r["window_start"], n=r["n"], windows=n, direction="HIGH" if off > 0 else "LOW")
            n, total, squares, last = n + 1, total + r["n"], squares + r["n"] ** 2, at
        self.seen.update((n, total, squares, last))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        # only frees what nobody will ask for: a day later does no harm, whatever zone the clock is in
        self.handle.registerTimer(last + idle + 86_400_000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


def rate_anomalies(events: DataFrame, ts: str, by: list[str], size: str, late: str = "1 hour", **how) -> DataFrame:
    """(by..., window_start, n, windows, direction) of windows whose count deviates. Events are counted by window first, in partial sums, so
    Python gets a row for each key and window. Needs the state store of rocks_state()."""
    closed = windowed_counts(events, ts, by, size, late=late)
    kinds = ", ".join(f"`{c}` {closed.schema[c].dataType.simpleString()}" for c in by)
    return closed.groupBy(*by).transformWithState(RateMonitor(by, **how), f"{kinds}, window_start timestamp, n bigint, windows bigint, direction string", "Append", "EventTime")


@contextmanager
def rocks_state(spark: SparkSession):
    """The state store that keyed processors need, for queries started inside; afterwards the session has its own setting again."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)
