"""Roll-ups kept by a stream: every micro-batch's partial sums are merged into stored state, once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import analytics
from ..sources.tables import StoredTable, merge_additive


class Rollup:
    """State of a roll-up: rows (keys..., day, sums...) in a stored table with a folder for each day.

    derive makes a batch's partial state, with a row for each key, and may be the one that a batch query uses. A batch rewrites the files of the
    days that it has and no others, so late rows cost what their days cost, and there is no watermark after which they are lost. The
    number of the batch is the version's note: a batch that Spark repeats after a failure finds it and changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, derive: Callable[[DataFrame], DataFrame], keys: list[str], sums: list[str], schema: T.StructType, time: str = "period"):
        self.derive, self.keys, self.sums, self.time = derive, keys, sums, time
        self.table = StoredTable(spark, root, T.StructType([*schema.fields, T.StructField("day", T.StringType())]), part="day", order=tuple(keys))

    def merge(self, batch: DataFrame, number: int) -> None:
        """For foreachBatch."""
        new = self.derive(batch).withColumn("day", F.date_format(self.time, "yyyy-MM-dd"))
        merge_additive(self.table, new, [*self.keys, "day"], self.sums, f"batch-{number}")

    def state(self) -> DataFrame:
        return self.table.read().drop("day")


def hourly_verdicts(spark: SparkSession, root: str) -> Rollup:
    """Verdicts by tenant, hour and verdict: finalise(state()) has counts and means."""
    schema = T.StructType.fromDDL("tenant_id int, period timestamp, verdict string, n bigint, risk_micro bigint, duration_micro bigint")
    return Rollup(spark, root, lambda b: analytics.additive_state(b, "hour"), ["tenant_id", "period", "verdict"], ["n", "risk_micro", "duration_micro"], schema)


def daily_detections(spark: SparkSession, root: str) -> Rollup:
    """Detections by tenant, day, tier and model."""
    schema = T.StructType.fromDDL("tenant_id int, period timestamp, tier string, model string, n bigint, scored bigint, score_micro bigint, timed bigint, duration_micro bigint")
    keys = ["tenant_id", "period", "tier", "model"]
    return Rollup(spark, root, analytics.detection_state, keys, schema.names[4:], schema)


def monthly_decisions(spark: SparkSession, root: str) -> Rollup:
    """Decisions by month, the counter of transparency reports."""
    from ..operators.compliance import decision_counters

    schema = T.StructType.fromDDL("period timestamp, decision_type string, n bigint")
    return Rollup(spark, root, decision_counters, ["period", "decision_type"], ["n"], schema)
