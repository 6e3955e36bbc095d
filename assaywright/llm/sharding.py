"""Shards of near equal size by vector bin packing: op13.

Equal texts are a group, and a group is placed as one. Every group is a vector of bytes, tokens and rows, in shares of the corpus; a shard has
room for an equal share of each. Groups are placed in descending order of their largest component, each where the dot product of its vector
with the room that is left is highest among shards whose room for bytes holds it (those with room for all three first); where none
has, the one with the most room for bytes takes it. The law that holds is `bytes`: sizes are near equal.

What the driver places is bounded: a group with more than 1 / HEAVY of the bytes, tokens or rows is an item of its own (at most 3 * HEAVY of
them), all others are bundled by a hash of their text into BUNDLES items, so it places fewer than 42,000 items however large the corpus is.
Only a group larger than a shard's fair share of the bytes is cut, as the law could not hold otherwise, into as few equal parts as fit.
Rows find their shard from two tables of these bounded sizes, which are broadcast, without a shuffle. Slots are ranks in small groups dealt
by a row's place in the stored table, so neither a hot text nor a repeated id nor a shard comes to one task.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import discard, flat_utf8, ready, released, stored, table
from .tokens import count_tokens

SHARDS = 16
HEAVY, BUNDLES = 8192, 16384
LAW = "bytes"


def place(items: np.ndarray, shards: int = SHARDS) -> np.ndarray:
    """The shard of each item. items: non-negative (bytes, tokens, rows) of each."""
    total = np.maximum(items.sum(axis=0), 1e-300)
    share = items / total * shards  # a shard's room is 1 of each
    where = np.zeros(len(items), np.int64)
    room = np.ones((shards, items.shape[1]))
    for i in np.lexsort((np.arange(len(items)), -share.sum(axis=1), -share.max(axis=1))).tolist():
        x = share[i]
        fits = room >= x - 1e-12
        score = room @ x
        for ok in (fits.all(axis=1), fits[:, 0]):
            if ok.any():
                k = int(np.argmax(np.where(ok, score, -np.inf)))
                break
        else:
            k = int(np.argmax(room[:, 0]))
        where[i] = k
        room[k] -= x
    return where


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds size (bytes of the text plus 1), text_crc32, tokens (by the byte-level vocabulary) and group (a 128-bit digest of the text; null
    counts as empty) and takes the text out."""
    ready(df.sparkSession)
    counted = count_tokens(df, text).withColumnRenamed("n_tokens", "tokens").drop("n_bytes", "over_limit")
    schema = counted.drop(text).select("*", F.lit(0).cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("text_crc32"), F.lit(None).cast("binary").alias("group")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            at = batch.schema.get_field_index(text)
            data, offs = flat_utf8(batch.column(at))
            raw = memoryview(np.ascontiguousarray(data)).cast("B")
            spans = list(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True))
            keep = [i for i in range(batch.num_columns) if i != at]
            new = [pa.array([e - s + 1 for s, e in spans], pa.int64()), pa.array([zlib.crc32(raw[s:e]) for s, e in spans], pa.int64()), pa.array([hashlib.blake2b(raw[s:e], digest_size=16).digest() for s, e in spans], pa.binary())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *new], [*(batch.schema.names[i] for i in keep), "size", "text_crc32", "group"])

    return counted.mapInArrow(released(run), schema)


def assign(df: DataFrame, key: str, text: str = "text", shards: int = SHARDS) -> DataFrame:
    """(key, size, text_crc32, tokens, law, shard, slot, grown_shard) of every row of df.

    slot counts from 0 in each shard without gaps; grown_shard is null under this law. A null or empty text has size 1 and is a group like any
    other; rows with equal texts lie in one shard unless their group is larger than a shard's fair share of the bytes. Texts of any length are
    measured whole, repeated rows and repeated or null keys each have a slot; an empty table gives no rows; other columns of df, whatever
    their names, are left out.
    """
    spark = df.sparkSession
    plain = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    rows = stored(measured(plain, "_text"), "measured")
    total = rows.agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).first()
    sums = (int(total["b"] or 0), int(total["t"] or 0), int(total["r"] or 0))
    vector = lambda b, t, r: (F.sum(b).alias("b"), F.sum(t).alias("t"), F.sum(r).alias("r"))
    groups = stored(rows.groupBy("group").agg(*vector("size", "tokens", F.lit(1))), "shard-groups")
    heavy = F.lit(False)
    for c, whole in zip("btr", sums, strict=True):
        heavy = heavy | (F.col(c) * HEAVY > F.lit(whole))
    own = groups.filter(heavy).collect()  # fewer than 3 * HEAVY
    bundle = F.pmod(F.xxhash64("group"), F.lit(BUNDLES)).cast("int")
    bundled = groups.filter(~heavy).groupBy(bundle.alias("bundle")).agg(*vector("b", "t", "r")).collect()  # at most BUNDLES

    items: list[tuple[float, float, float]] = [(x["b"], x["t"], x["r"]) for x in bundled]
    parts: list[tuple[bytes, int]] = []
    for x in own:
        n = max(1, -(-x["b"] * shards // max(1, sums[0])))  # over a fair share: as few equal parts as fit
        n = min(n, shards, x["r"])
        for k in range(n):
            share = x["r"] // n + (k < x["r"] % n)
            items.append(tuple(v * share / x["r"] for v in (x["b"], x["t"], x["r"])))
            parts.append((bytes(x["group"]), share))
    where = place(np.array(items, float).reshape(-1, 3), shards).tolist()
    light = {x["bundle"]: w for x, w in zip(bundled, where[: len(bundled)], strict=True)}
    alone: dict[bytes, list[tuple[int, int]]] = {}
    for (group, share), w in zip(parts, where[len(bundled) :], strict=True):
        alone.setdefault(group, []).append((share, w))
    discard(groups)

    by_bundle = np.zeros(BUNDLES, np.int16)
    by_bundle[list(light)] = list(light.values())
    whole = spark.createDataFrame([(g, w[0][1]) for g, w in alone.items() if len(w) == 1], "group binary, _own int")
    split = {g: w for g, w in alone.items() if len(w) > 1}  # fewer than `shards`
    # a row's place in the stored table does not change when it is read again
    placed = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    table_ = spark.createDataFrame([(i, int(w)) for i, w in enumerate(by_bundle.tolist())], "_bundle int, _light int")
    got = placed.withColumn("_bundle", bundle).join(F.broadcast(whole), "group", "left").join(F.broadcast(table_), "_bundle").withColumn("shard", F.coalesce("_own", "_light"))
    if split:
        got = _cut(got, split)
    return _rank_groups(got, ["shard"]).withColumn("slot", F.col("_rank").cast("bigint")).select(F.col("_key").alias(key), "size", "text_crc32", "tokens", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def _rank_groups(df: DataFrame, by: list[str]) -> DataFrame:
    """Adds _g, by which rows with equal `by` are dealt to groups of some thousand, and _rank, from 0 without gaps over all rows with equal `by`,
    in order of their place in the stored table."""
    many = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    salted = df.withColumn("_g", F.pmod(F.xxhash64("_file", F.floor(F.col("_at") / 64)), F.lit(many)).cast("int"))
    counts = salted.groupBy(*by, "_g").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)  # over at most `many` rows
    before = counts.select(*by, "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*by, "_g").orderBy("_file", "_at")
    ranked = salted.withColumn("_rank", F.row_number().over(inside) - 1)
    return ranked.join(before.hint("merge"), [*by, "_g"]).withColumn("_rank", F.col("_rank") + F.col("_before")).drop("_before", "_g")


def _cut(got: DataFrame, split: dict[bytes, list[tuple[int, int]]]) -> DataFrame:
    """The shard of rows of groups that are cut: from their rank in the group."""
    lines = []
    for group, some in split.items():
        at = 0
        for share, w in some:
            lines.append((group, at, at + share, w))
            at += share
    hot = F.col("group").isin(*[F.lit(g) for g in split])
    ranked = _rank_groups(got.filter(hot), ["group"])
    ranges = got.sparkSession.createDataFrame(lines, "_group binary, _from bigint, _to bigint, _part int")
    dealt = ranked.join(F.broadcast(ranges), (F.col("group") == F.col("_group")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    dealt = dealt.withColumn("shard", F.col("_part")).select(*got.columns)
    return got.filter(~hot).unionByName(dealt)


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of every document, sizes near equal."""
    docs = table(spark, sf_dir, "documents")
    return assign(docs, "doc_id").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "tokens")
