"""Best-fit packing by minimum bin slack: op5.

Documents become token pieces of at most `capacity`; only the histogram of piece lengths (at most `capacity` numbers) goes to the
driver. There each bin is filled by a bitset subset-sum over the lengths still available, the fullest combination is
removed, and is used for as many bins as the counts allow, so the plan has at most a few rows for each length. Pieces find
their bin from their rank among pieces of the same length; ranks come from small salted groups, whose counts are summed up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._bytelevel import codec
from ._common import discard, ready, released, stored, table
from .tokens import codec_parts, encoded_rows, vocabulary_path

CAPACITY = 1024
END = 2


def fullest(available: dict[int, int], capacity: int) -> list[tuple[int, int]]:
    """The combination [(length, how often)] with the largest sum up to capacity, the longest length included.

    available: counts by length. Subset sums are the bits of an integer; lengths enter from the longest on, so that of
    equally full combinations one with long pieces is found and short ones stay for later bins.
    """
    lengths = sorted((n for n, c in available.items() if c), reverse=True)
    seed = lengths[0]
    room = capacity - seed
    full = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in lengths:
        if n > room:
            continue
        for _ in range(min(available[n] - (n == seed), room // n)):
            grown = (reach | reach << n) & full
            if grown == reach:
                break
            steps.append((n, reach))
            reach = grown
            if reach >> room:
                break
        if reach >> room:
            break
    total, used = reach.bit_length() - 1, {seed: 1}
    for n, before in reversed(steps):
        if not before >> total & 1:  # only with this piece
            used[n] = used.get(n, 0) + 1
            total -= n
    return sorted(used.items(), reverse=True)


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(number of bins, [(length, pieces of it in each bin)])], using every piece once."""
    left = {int(n): int(c) for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError("piece lengths must be from 1 to the capacity")
    plan = []
    while left:
        combo = fullest(left, capacity)
        times = min(left[n] // k for n, k in combo)
        plan.append((times, combo))
        for n, k in combo:
            left[n] -= k * times
            if not left[n]:
                del left[n]
    return plan


def token_pieces(df: DataFrame, key: str, text: str = "text", capacity: int = CAPACITY, end: int = END, path: str | None = None, ids: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids]) of every text and its end id, in pieces of `capacity` ids of which the first may
    be shorter. A null text is empty: one piece that holds the end id alone. Repeated rows give repeated pieces, texts of any length
    are encoded whole, an empty table gives no rows. Other columns of df are left out, whatever their names."""
    spark = df.sparkSession
    ready(spark)
    spec, classes = codec_parts(spark, path or vocabulary_path())
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = codec(spec.value, classes.value, True)
        for batch in it:
            rows, cols = [], [[], [], [], [], []]
            for row, got in encoded_rows(batch, text, m):
                got = np.append(got, end).astype("<u4")
                raw = memoryview(got).cast("B")
                first = len(got) % capacity or capacity
                edges = [0, *range(first, len(got) + 1, capacity)]
                rows += [row] * (len(edges) - 1)
                for p, (s, e) in enumerate(zip(edges, edges[1:], strict=False)):
                    for c, v in zip(cols, (p, s, e - s, zlib.crc32(raw[4 * s : 4 * e]), got[s:e].astype(np.int32) if ids else None), strict=True):
                        c.append(v)
            types = [pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int32())] * ids
            arrays = [batch.column(batch.schema.get_field_index(key)).take(pa.array(rows, pa.int64())), *(pa.array(c, t) for c, t in zip(cols, types, strict=False))]
            yield pa.RecordBatch.from_arrays(arrays, [key, "piece", "start", "length", "ids_crc32"] + ["ids"] * ids)

    return df.select(key, text).mapInArrow(released(run), schema)


def pack(pieces: DataFrame, key: str, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to stored pieces with columns (key, piece, length, ...).

    Rows that are equal in key and piece are told apart by order alone. An empty table packs into no sequences. sequence_id
    counts from 0 without gaps; offsets in a sequence have no gaps.
    """
    spark = pieces.sparkSession
    groups = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    salted = pieces.withColumn("_g", F.pmod(F.xxhash64(key, "piece"), F.lit(groups)).cast("int"))
    counted = stored(salted.groupBy("length", "_g").agg(F.count("*").alias("_n")), "packing-counts")  # at most capacity * groups rows
    hist = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("_n").alias("n")).collect()}  # at most capacity rows
    plan = plan_bins(hist, capacity)
    # for each length: ranks from lo on lie in bins from `bin` on, k in each, the first at `offset`
    by_length: dict[int, list[list[int]]] = {}
    taken: dict[int, int] = {}
    bins = 0
    for times, combo in plan:
        offset = 0
        for n, k in combo:
            by_length.setdefault(n, []).append([taken.get(n, 0), bins, k, offset])
            taken[n] = taken.get(n, 0) + times * k
            offset += n * k
        bins += times
    shared = spark.sparkContext.broadcast({n: np.array(v).T for n, v in by_length.items()})  # a few rows for each length
    before = counted.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1))).select("length", "_g", F.coalesce("_before", F.lit(0)).alias("_before"))
    # rows are already dealt by length and group, so a merge join moves only the counts, which no task gets all of
    in_group = Window.partitionBy("length", "_g").orderBy(key, "piece")
    ranked = salted.withColumn("_r", F.row_number().over(in_group) - 1).join(before.hint("merge"), ["length", "_g"]).withColumn("_r", F.col("_r") + F.col("_before")).drop("_before", "_g")
    schema = ranked.drop("_r").select("*", F.lit(None).cast("bigint").alias("sequence_id"), F.lit(None).cast("bigint").alias("offset")).schema

    def place(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            n, r = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_r"))
            seq, off = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n):
                at = np.flatnonzero(n == one)
                lo, bin_, k, offset = shared.value[int(one)]
                j = np.searchsorted(lo, r[at], side="right") - 1
                inner = r[at] - lo[j]
                seq[at], off[at] = bin_[j] + inner // k[j], offset[j] + inner % k[j] * one
            keep = [i for i, x in enumerate(batch.schema.names) if x != "_r"]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(seq), pa.array(off)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    out = stored(ranked.mapInArrow(released(place, 1 << 16), schema), "packed")
    discard(counted)
    return out


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place."""
    docs = table(spark, sf_dir, "documents")
    pieces = stored(token_pieces(docs, "doc_id"), "packing-pieces")
    packed = pack(pieces, "doc_id")
    discard(pieces)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
