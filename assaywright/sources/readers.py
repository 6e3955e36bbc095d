"""Readers and sinks: tables by path, message envelopes with quarantine, time-partitioned storage, reports."""

from __future__ import annotations

import hashlib
import hmac
import os
import re
import tempfile
import uuid
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import ENVELOPE


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A Parquet table; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{root}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir). Where that is unset, a session on one machine gets a
    temporary one; on a cluster it is an error."""
    shared = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="assaywright-")
        spark.sparkContext.setCheckpointDir(shared)
    return f"{shared.rstrip('/')}/assaywright/{name}-{uuid.uuid4().hex}"


def stream(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "parquet", per_trigger: int = 100) -> DataFrame:
    """A file stream: the stand-in for a topic where no broker connector is installed."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def topic_options(servers: str, topic: str) -> dict[str, str]:
    """Options of the broker source for where its connector is installed: from the earliest offset, offsets kept by the checkpoint."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest", "failOnDataLoss": "false"}


def parse_envelopes(raw: DataFrame, payload: T.StructType, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine): messages whose envelope and payload parse, with the payload as a struct, and the rest as they came.

    A bad message is never lost and never stops the others.
    """
    got = raw.withColumn("_e", F.from_json(value, ENVELOPE, {"mode": "PERMISSIVE"}))
    got = got.withColumn("_p", F.from_json("_e.payload", payload, {"mode": "PERMISSIVE"}))
    need = F.col("_e.scan_id").isNotNull() & F.col("_e.tenant_id").isNotNull() & F.col("_p").isNotNull()
    for f in payload.fields:
        if not f.nullable:
            need = need & F.col("_p")[f.name].isNotNull()
    ok = F.coalesce(need, F.lit(False))
    valid = got.filter(ok).select("_e.message_id", "_e.timestamp", "_e.tenant_id", "_e.scan_id", F.col("_p").alias("payload"))
    reason = F.when(F.col("_e.scan_id").isNull() | F.col("_e.tenant_id").isNull(), "BAD_ENVELOPE").otherwise("BAD_PAYLOAD")
    return valid, got.filter(~ok).select(F.col(value).alias("value"), reason.alias("reason"))


def defaulted(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Missing values of nested fields get defaults, as the consumers of untyped messages assume."""
    return df.withColumns({name: F.coalesce(F.col(name), F.lit(v)) for name, v in defaults.items()})


def write_by_month(df: DataFrame, path: str, ts: str = "ts", keys: tuple[str, ...] = ("tenant_id",), mode: str = "append") -> None:
    """A month partition for pruning and expiry; rows sorted by key inside files, so that row-group statistics skip.

    Rows are dealt by ranges of (month, keys, time), so a tenant with very many rows in a month is spread over files as others are.
    """
    by = df.withColumn("month", F.date_format(ts, "yyyyMM"))
    by.repartitionByRange("month", *keys, ts).sortWithinPartitions("month", *keys, ts).write.mode(mode).partitionBy("month").parquet(path)


def read_months(spark: SparkSession, path: str, start: str, end: str) -> DataFrame:
    """Months from start to end (yyyyMM, both included): other partitions are not opened."""
    return spark.read.option("spark.sql.sources.partitionColumnTypeInference.enabled", "false").parquet(path).filter(F.col("month").cast("string").between(start, end))


def lookup(df: DataFrame, key: str, *values: object) -> DataFrame:
    """Rows of the given keys: an equality filter that reaches the scan, where row-group statistics of sorted files skip the rest."""
    return df.filter(F.col(key).isin(*values))


def archive(df: DataFrame, path: str, cut: Column, ts: str = "ts", keys: tuple[str, ...] = ("tenant_id",)) -> DataFrame:
    """Move rows before `cut` to month partitions below path; returns the rows that stay."""
    write_by_month(df.filter(F.col(ts) < cut), path, ts, keys)
    return df.filter(~F.coalesce(F.col(ts) < cut, F.lit(False)))


def write_keyed(df: DataFrame, path: str, key: list[str], message_id: str, parts: int = 16) -> None:
    """Messages as a topic holds them: dealt to partitions by a hash of their key, in order of their ids within each, as lines of JSON."""
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    lines = df.select(part.alias("partition"), F.concat_ws(":", *key).alias("key"), F.to_json(F.struct(*df.columns)).alias("value"), message_id)
    lines.repartition(parts, "partition").sortWithinPartitions("partition", message_id).drop(message_id).write.partitionBy("partition").option("compression", "lz4").json(path)


def write_report(df: DataFrame, path: str, fmt: str = "json") -> None:
    if fmt not in ("json", "csv"):
        raise ValueError("reports are written as json or csv")
    df.write.mode("overwrite").option("header", "true").format(fmt).save(path)


def hmac_sha256(secret: str) -> Column:
    """A function of a payload column that signs webhook bodies, in Arrow batches."""
    key = secret.encode()

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else hmac.new(key, x.encode(), hashlib.sha256).hexdigest())

    return run


def fresh(ts: str, as_of: Column, seconds: int = 300) -> Column:
    """Whether a webhook's timestamp is close enough to be accepted."""
    return F.abs(F.unix_timestamp(as_of) - F.unix_timestamp(ts)) <= seconds


def retry_schedule(attempts: DataFrame, waits: tuple[int, ...] = (1, 10, 60)) -> DataFrame:
    """attempts: (delivery_id, attempt, ts, ok), attempts from 1. For each delivery its state (DELIVERED, RETRY or DEAD) and, where it is to be
    tried again, when: after the n-th failure waits[n - 1] seconds on; after one more there is no next time."""
    last = attempts.groupBy("delivery_id").agg(F.max(F.struct("attempt", "ts")).alias("m"), F.bool_or("ok").alias("ok"))
    n = F.col("m.attempt")
    wait = F.get(F.array(*[F.lit(w) for w in waits]), n - 1)
    state = F.when(F.col("ok"), "DELIVERED").when(n > len(waits), "DEAD").otherwise("RETRY")
    return last.select("delivery_id", n.alias("attempts"), state.alias("state"), F.when(state == "RETRY", F.col("m.ts") + F.make_dt_interval(secs=wait.cast("decimal(18,6)"))).alias("next_at"))


@dataclass(frozen=True)
class Config:
    """Settings with defaults, overridden by environment variables PREFIX__NAME."""

    input_path: str = "/data"
    checkpoint: str = ""
    max_files: int = 100
    score_timeout_secs: int = 300

    @classmethod
    def from_env(cls, prefix: str = "ASSAY", env: dict[str, str] | None = None) -> Config:
        env = os.environ if env is None else env
        got = {f.name: env[k] for f in fields(cls) if (k := f"{prefix}__{f.name.upper()}") in env}
        return cls(**{k: int(v) if cls.__dataclass_fields__[k].type == "int" else v for k, v in got.items()})
