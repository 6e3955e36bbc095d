"""What the operators of this subpackage share: table loading, shared intermediate tables, Arrow batches as flat bytes."""

from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that functions over batches see at once; with texts of 100 kB that is near 25 MB.
ARROW_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Let workers import this package from where the driver has it (on a cluster it is installed or sent with --py-files)."""
    env, root = spark.sparkContext.environment, str(Path(__file__).resolve().parents[2])
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [env.get("PYTHONPATH"), root]))


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], rows: int = ARROW_ROWS) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For functions over batches: they see at most `rows` rows at once, whatever the session's settings (Spark itself bounds the bytes of
    a batch), and a worker, which lives on for other tasks, gives what it has freed back to the system at the end."""

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batch.slice(lo, rows) for batch in it for lo in range(0, max(1, batch.num_rows), rows))
        gc.collect()
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL(None).malloc_trim(0)
        except AttributeError:  # another C library
            return

    return whole


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a session on one machine gets a temporary one; a
    cluster has none that executors could share, so that is an error."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="assaywright-")
        spark.sparkContext.setCheckpointDir(found)
    return found


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet below the shared folder and read it back: cuts the lineage, survives lost executors, and gives
    the planner true sizes. discard() takes the files away; the operators do so with all but the table that holds their result."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/assaywright/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._assay_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files of stored(df) once nothing reads them any more."""
    path = getattr(df, "_assay_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of the shared store."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def salted_semi_join(left: DataFrame, right: DataFrame, keys: list[str], place: list[str], share: int = 10_000, salts: int = 64) -> DataFrame:
    """Rows of left whose keys stand in right, which has one row for each key and n, how many rows of left it has.

    Keys with more than 10,000 rows and more than one in `share` of all (so at most `share` of them, a broadcast of bounded size)
    are dealt to `salts` tasks by a hash of `place`; all others need no salt.
    """
    total = right.agg(F.sum("n")).first()[0] or 0
    hot = right.filter(F.col("n") > max(10_000, total // share)).select(*keys)
    salt = F.pmod(F.xxhash64(*place), F.lit(salts)).cast("int")
    dealt = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), keys, "left").withColumn("_salt", F.when(F.col("_hot"), salt).otherwise(0)).drop("_hot")
    each = F.when(F.col("n") > max(10_000, total // share), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    return dealt.join(right.select(*keys, F.explode(each).alias("_salt")), [*keys, "_salt"], "left_semi").drop("_salt").select(*left.columns)


def flat_utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string or binary column as (bytes, offsets): row i is bytes[offsets[i]:offsets[i + 1]], nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    n = len(column)
    _, offs, data = column.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    if column.null_count:  # a null may cover bytes; give it none
        valid = np.asarray(column.is_valid())
        if ((offsets[1:] != offsets[:-1]) & ~valid).any():
            rows = [b"" if x is None else x for x in column.cast(pa.large_binary()).to_pylist()]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
            return np.frombuffer(b"".join(rows), np.uint8), offsets
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return flat, offsets - offsets[0]


def row_groups(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Cut rows into runs [a, b) of at most `most` bytes; a longer row stands alone."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n) for each s, n."""
    ends = np.cumsum(lengths)
    if not len(ends) or not ends[-1]:
        return np.zeros(0, np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)


class HashIndex:
    """Open-addressing map of non-zero 64-bit keys to positions 0, 1, 2, ..., looked up and filled in whole arrays."""

    def __init__(self, bits: int = 16):
        self.n = 0
        self._alloc(bits)

    def _alloc(self, bits: int) -> None:
        self.bits, self.mask = bits, (1 << bits) - 1
        self.keys = np.zeros(1 << bits, np.uint64)
        self.vals = np.zeros(1 << bits, np.int32)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """Positions, -1 where absent."""
        slot = self._slot(keys)
        at = self.keys[slot]
        out = np.where(at == keys, self.vals[slot], -1)
        todo = np.flatnonzero((at != keys) & (at != 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & self.mask
            at = self.keys[slot[todo]]
            hit = at == keys[todo]
            out[todo[hit]] = self.vals[slot[todo[hit]]]
            todo = todo[~hit & (at != 0)]
        return out

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Insert distinct absent keys; returns their positions."""
        if (self.n + len(keys)) * 2 > self.mask:
            used = np.flatnonzero(self.keys)
            old, vals = self.keys[used], self.vals[used]
            self._alloc(int(self.n + len(keys)).bit_length() + 2)
            self._place(old, vals)
        vals = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        self.n += len(keys)
        self._place(keys, vals)
        return vals

    def _place(self, keys: np.ndarray, vals: np.ndarray) -> None:
        slot, todo = self._slot(keys), np.arange(len(keys))
        while len(todo):
            s = slot[todo]
            free = self.keys[s] == 0
            self.keys[s[free]] = keys[todo[free]]  # the last of those that want a slot gets it
            won = free & (self.keys[s] == keys[todo])
            self.vals[s[won]] = vals[todo[won]]
            todo = todo[~won]
            slot[todo] = (slot[todo] + 1) & self.mask
