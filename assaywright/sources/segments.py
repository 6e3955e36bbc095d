"""Archived topics as a data source with offsets, batch and streaming.

    root/partition=<p>/segment=<first>-<last>/*.json    messages (key, value, timestamp) of offsets first to last, one file, a line each

A segment's name says which offsets it has, so listing is enough to know how far a partition goes. Reading starts at the earliest offset,
or where `startingOffsets` says ({"0": 17, ...}); a stream takes at most `maxOffsetsPerTrigger` messages a batch, shared among partitions by
what each has left. A stream's offsets are Spark's, in its checkpoint; below `commitPath`, if given, stand the offsets that are finished
(`committed`), for others to see how far a consumer is, and those that a batch has been planned for (`planned`), from which a limited stream that
is taken up again counts on. spark.dataSource.register(SegmentLog), then format("segment_log").
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from urllib.parse import unquote

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "partition int, offset bigint, key string, value string, timestamp timestamp"


def write_segments(df: DataFrame, path: str, key: list[str], order: str, parts: int = 4, length: int = 10_000) -> None:
    """Messages of df (key columns, order, value, timestamp): dealt to partitions by a hash of the key, offsets in order of `order`, in
    segments of `length` messages. A partition's offsets are ranks in ranges of `order`, whose sizes are summed up, so no task gets a whole partition."""
    part = F.pmod(F.xxhash64(*key), F.lit(parts)).cast("int")
    spans = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.select(part.alias("partition"), F.concat_ws(":", *key).alias("key"), "value", "timestamp", F.col(order).alias("_o"))
    cuts = rows.approxQuantile("_o", [i / spans for i in range(1, spans)], 0.01)
    span = F.array_size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c <= F.col("_o"))) if cuts else F.lit(0)
    rows = rows.withColumn("_s", span)
    sizes = rows.groupBy("partition", "_s").agg(F.count("*").alias("_n"))  # a few rows for each partition
    before = Window.partitionBy("partition").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("partition")
    base = sizes.select("partition", "_s", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"), F.sum("_n").over(whole).alias("_all"))
    at = F.row_number().over(Window.partitionBy("partition", "_s").orderBy("_o", "key", "value")) - 1 + F.col("_b")
    rows = rows.join(F.broadcast(base), ["partition", "_s"]).withColumn("_at", at)
    first = F.floor(F.col("_at") / length) * length
    rows = rows.withColumn("segment", F.concat_ws("-", first.cast("string"), F.least(first + (length - 1), F.col("_all") - 1).cast("string")))
    rows.repartition("partition", "segment").sortWithinPartitions("partition", "segment", "_at").select("partition", "segment", "key", "value", "timestamp").write.partitionBy("partition", "segment").json(path)


def _store(root: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(root if re.match(r"[a-z0-9]+:", root) else f"file://{root}")


def segments(root: str) -> dict[int, list[tuple[int, int, str]]]:
    """(first, last, folder) of each partition's segments, in order."""
    from pyarrow import fs

    store, path = _store(root)
    out: dict[int, list[tuple[int, int, str]]] = {}
    for f in store.get_file_info(fs.FileSelector(path, recursive=True)):
        m = re.search(r"/partition=(\d+)/segment=(\d+)-(\d+)$", unquote(f.path))
        if m and f.type == fs.FileType.Directory:
            out.setdefault(int(m[1]), []).append((int(m[2]), int(m[3]), f.path))
    return {p: sorted(s) for p, s in out.items()}


@dataclass
class Slice(InputPartition):
    """Offsets from `start` to before `stop` of one segment."""

    partition: int
    folder: str
    first: int
    start: int
    stop: int


def _slices(root: str, start: dict[str, int], stop: dict[str, int]) -> list[Slice]:
    out = []
    for p, some in segments(root).items():
        lo, hi = start.get(str(p), 0), stop.get(str(p), 0)
        out += [Slice(p, folder, first, max(lo, first), min(hi, last + 1)) for first, last, folder in some if max(lo, first) < min(hi, last + 1)]
    return out


def _ends(root: str) -> dict[str, int]:
    """The offset after the last of each partition."""
    return {str(p): s[-1][1] + 1 for p, s in segments(root).items()}


def _rows(root: str, s: Slice) -> Iterator[tuple]:
    from pyarrow import fs

    store, _ = _store(root)
    at = s.first
    for f in sorted(store.get_file_info(fs.FileSelector(s.folder)), key=lambda f: f.path):
        if not f.base_name.endswith(".json"):
            continue
        with store.open_input_stream(f.path) as lines:
            rest = b""
            while part := lines.read(1 << 20):
                *whole, rest = (rest + part).split(b"\n")
                for line in whole:
                    if s.start <= at < s.stop:
                        m = json.loads(line)
                        when = m.get("timestamp")
                        yield s.partition, at, m.get("key"), m.get("value"), datetime.fromisoformat(when).astimezone(UTC).replace(tzinfo=None) if when else None
                    at += 1
                    if at >= s.stop:
                        return


class SegmentLog(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segment_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return SegmentStream(self.options)


class SegmentReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.start = options["path"], json.loads(options.get("startingOffsets") or "{}")

    def partitions(self) -> list[Slice]:
        return _slices(self.root, self.start, _ends(self.root))

    def read(self, s: Slice) -> Iterator[tuple]:
        return _rows(self.root, s)


class SegmentStream(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.root, self.start = options["path"], json.loads(options.get("startingOffsets") or "{}")
        self.most = int(options.get("maxOffsetsPerTrigger") or 0)
        self.done = options.get("commitPath")
        self.planned: dict[str, int] | None = None

    def initialOffset(self) -> dict:
        return self.start

    def latestOffset(self) -> dict:
        """What is there, or as far as a batch may go from what has been planned before; of a stream that has just been taken up again, from what
        it has written to commitPath."""
        ends = _ends(self.root)
        if not self.most:
            return ends
        at = self.planned or self._written() or self.start
        left = {p: max(0, e - at.get(p, 0)) for p, e in ends.items()}
        total = sum(left.values())
        if total <= self.most:
            self.planned = ends
        else:
            share = {p: n * self.most // total for p, n in left.items()}
            spare = self.most - sum(share.values())
            for p in sorted(left, key=lambda p: share[p] - left[p]):
                more = min(spare, left[p] - share[p])
                share[p] += more
                spare -= more
            self.planned = {p: at.get(p, 0) + n for p, n in share.items()}
        return self.planned

    def partitions(self, start: dict, end: dict) -> list[Slice]:
        self.planned = {p: max(n, (self.planned or {}).get(p, 0)) for p, n in end.items()}
        self._write("planned", self.planned)
        return _slices(self.root, start, end)

    def read(self, s: Slice) -> Iterator[tuple]:
        return _rows(self.root, s)

    def commit(self, end: dict) -> None:
        """Spark has finished a batch and will not ask for it again."""
        self._write("committed", end)

    def _written(self, kind: str = "planned") -> dict[str, int] | None:
        if not self.done:
            return None
        from pyarrow import fs

        store, path = _store(f"{self.done}/{kind}")
        files = [f.path for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if f.base_name.endswith(".json")]
        best: dict[str, int] = {}
        for f in files:
            with store.open_input_stream(f) as x:
                best = {**best, **{p: max(n, best.get(p, 0)) for p, n in json.loads(x.read()).items()}}
        return best or None

    def _write(self, kind: str, offsets: dict[str, int]) -> None:
        if not self.done:
            return
        from pyarrow import fs

        store, path = _store(f"{self.done}/{kind}")
        store.create_dir(path, recursive=True)
        old = [f.path for f in store.get_file_info(fs.FileSelector(path)) if f.base_name.endswith(".json")]
        with store.open_output_stream(f"{path}/{uuid.uuid4().hex}.json") as f:
            f.write(json.dumps(offsets).encode())
        for f in old:
            store.delete_file(f)
