"""Near-duplicate vectors by PCA-ordered tiled comparison: op10.

Unit vectors are rotated onto the eigenvectors of the corpus' second moments (a rotation keeps every cosine), largest first, and
ordered by their first coordinate into blocks of bounded size: intervals of it, of which one that too many vectors share is dealt to
several blocks by hash. Two blocks meet in a tile only if their first coordinates are near enough for the threshold. In a tile,
vectors are compared in parts that lie in small boxes of the leading coordinates, and parts whose boxes are too far apart are not
compared at all. Leading coordinates are multiplied first; what the rest can add is at most the product of the suffix norms, and pairs for which
even that stays below the threshold stop there. Survivors get further coordinates, and those left are decided by the cosine in double
precision; so near the threshold that rounding could tell, by dot products of the vectors as given. A tile returns one row for
each vector that has a link in it: its number of links and the smallest vector that it reaches there, so dense groups never
become pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, ready, released, stored, table
from .components import components

THRESHOLD = 0.95
#: Bytes of vectors in a block; a tile holds two. Blocks of few vectors are not made smaller than a share of all of them.
BLOCK_BYTES, LEAST_BLOCKS = 4 << 20, 4
#: Intervals of the first coordinate that are counted, and vectors that are compared at once.
BINS, SUB = 1 << 16, 1024
#: Leading coordinates in which vectors that are compared at once are bounded.
BOX = 8
#: Coordinates after which the bound is tried.
STAGES = (16, 32)
#: What rounding in single precision, and in products of unit vectors, may hide.
SLACK, CLOSE = 1e-4, 1e-9


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows times a power of two that brings their largest component near one: exact, and no square overflows."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of rows as given: exact where products and sums of components are, as for small whole numbers."""
    e = lambda a, b: np.einsum("ij,ij->i", a, b)
    return e(x, y) / np.sqrt(e(x, x) * e(y, y))


def _spread(near: np.ndarray, low_a: np.ndarray, low_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label that each row and column reaches through near."""
    big = np.iinfo(np.int64).max
    dense = near.mean() > 0.02
    r, c = (None, None) if dense else np.nonzero(near)
    while True:
        if dense:
            a = np.minimum(low_a, np.where(near, low_b[None, :], big).min(axis=1))
            b = np.minimum(low_b, np.where(near, a[:, None], big).min(axis=0))
        else:
            a, b = low_a.copy(), low_b.copy()
            np.minimum.at(a, r, low_b[c])
            np.minimum.at(b, c, a[r])
        if (a == low_a).all() and (b == low_b).all():
            return a, b
        low_a, low_b = a, b


def near_pairs(raw: tuple[np.ndarray, np.ndarray], unit: tuple[np.ndarray, np.ndarray], turned: tuple[np.ndarray, np.ndarray], threshold: float) -> np.ndarray:
    """Which rows on the one side have a cosine of at least threshold with which on the other: rows as given, as units, and rotated in single
    precision. Where so many pairs outlast the leading coordinates that picking them out costs more than multiplying on, all are."""
    (x, y), (px, py) = unit, turned
    d = px.shape[1]
    stages = [s for s in STAGES if s < d] or [d]
    m = stages[0]
    rest = lambda p, k: np.sqrt(np.maximum(0, np.einsum("ij,ij->i", p[:, k:], p[:, k:])))
    dot = px[:, :m] @ py[:, :m].T
    may = dot + rest(px, m)[:, None] * rest(py, m)[None, :] >= threshold - SLACK
    if may.mean() > 0.05:
        cos = x @ y.T
        near = cos >= threshold
        r, c = np.nonzero(np.abs(cos - threshold) <= CLOSE)
    else:
        r, c = np.nonzero(may)
        part = dot[r, c]
        for a, b in zip(stages, stages[1:], strict=False):
            part = part + np.einsum("ij,ij->i", px[r, a:b], py[c, a:b])
            ok = part + rest(px, b)[r] * rest(py, b)[c] >= threshold - SLACK
            r, c, part = r[ok], c[ok], part[ok]
        cos = np.einsum("ij,ij->i", x[r], y[c])
        near = np.zeros(may.shape, bool)
        near[r, c] = cos >= threshold
        close = np.abs(cos - threshold) <= CLOSE
        r, c = r[close], c[close]
    for k in range(0, len(r), 1 << 14):  # both ways come to the same result
        i, j = r[k : k + (1 << 14)], c[k : k + (1 << 14)]
        near[i, j] = _cosines(raw[0][i], raw[1][j]) >= threshold
    return near


def compare_tile(ids: np.ndarray, copies: np.ndarray, block: np.ndarray, raw: np.ndarray, basis: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, links, smallest id reached) of the vectors that have a link in the tile of the one or two blocks given."""
    units = _units(raw)
    rotated = (units @ basis).astype(np.float32)
    first = np.flatnonzero(block == block.min())
    second = np.flatnonzero(block == block.max())
    same = block.min() == block.max()
    # in the order of the second coordinate, so that what is compared at once lies in a small box of the leading ones
    first, second = (x[np.argsort(rotated[x, min(1, rotated.shape[1] - 1)], kind="stable")] for x in (first, second))
    boxes = {id(x): [(p.min(axis=0), p.max(axis=0)) for p in (rotated[x[i : i + SUB], :BOX] for i in range(0, len(x), SUB))] for x in (first, second)}
    links = np.zeros(len(ids), np.int64)
    parent = list(range(len(ids)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(0, len(first), SUB):
        a = first[i : i + SUB]
        for j in range(i if same else 0, len(second), SUB):
            b = second[j : j + SUB]
            (a_low, a_high), (b_low, b_high) = boxes[id(first)][i // SUB], boxes[id(second)][j // SUB]
            apart = np.maximum(0, np.maximum(a_low - b_high, b_low - a_high)).astype(np.float64)
            if (apart * apart).sum() > 2 - 2 * threshold + SLACK:  # no two of them are near enough
                continue
            near = near_pairs((raw[a], raw[b]), (units[a], units[b]), (rotated[a], rotated[b]), threshold)
            if same and i == j:
                near &= ~np.eye(len(a), dtype=bool)
            if not near.any():
                continue
            np.add.at(links, a, near @ copies[b])
            if not (same and i == j):
                np.add.at(links, b, copies[a] @ near)
            la, lb = _spread(near, a.astype(np.int64), b.astype(np.int64))
            for at, low in ((a, la), (b, lb)):
                for x, y in zip(at[low != at].tolist(), low[low != at].tolist(), strict=True):
                    p, q = root(x), root(y)
                    if p != q:
                        parent[max(p, q)] = min(p, q)
    at = np.flatnonzero(links)
    label = np.array([root(int(k)) for k in at], np.int64)
    low = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(low, label, ids[at])
    return at, links[at], low[label]


def near_duplicates(df: DataFrame, key: str, vector: str, threshold: float = THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(key, n_links, component_id, kept) of every row of df.

    Vectors that are null, empty or zero, or hold null or non-finite components, link with nothing; so do vectors of different
    lengths with each other. Equal vectors link with each other and are compared with the others once. Rows that share a key
    count as one in components. kept is false where the key is null. An empty table gives no rows. Repeated rows come out as often as
    they are there. Other columns of df are left out, whatever their names.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must lie in (0, 1]")
    spark = df.sparkSession
    ready(spark)
    v = F.col(vector).cast("array<double>")
    usable = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0), F.lit(False))
    rows = df.select(F.col(key).alias("id"), v.alias("v"), usable.alias("ok"))
    keyed = rows.select("id", "ok", F.when(F.col("ok"), F.xxhash64("v")).alias("h"), F.when(F.col("ok"), F.xxhash64(F.lit(1), "v")).alias("g"), "v")
    distinct = stored(keyed.filter("ok and id is not null").groupBy("h", "g").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.first("v").alias("v")), "vectors")
    # lengths of which a block holds all vectors are compared in one pass, grouped by length; of others there are few
    shapes = distinct.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n")).withColumn("n_least", F.greatest(F.floor(F.lit(block_bytes) / (8 * F.col("d"))), F.lit(1)))
    large = {r["d"]: r["n"] for r in shapes.filter("n > n_least").collect()}
    turned: list[DataFrame] = []
    made = [_compare(distinct.filter(F.size("v") == d), d, n, threshold, block_bytes, turned) for d, n in sorted(large.items())]
    if shapes.filter("n <= n_least").limit(1).count():
        made.append(_compare_small(distinct.filter(~F.size("v").isin(list(large))) if large else distinct, threshold))
    slim = keyed.select("id", "h", "g")
    if not made:
        return slim.select(F.col("id").alias(key), F.lit(0).cast("bigint").alias("n_links"), F.col("id").alias("component_id"), F.col("id").isNotNull().alias("kept"))
    found = made[0]
    for more in made[1:]:
        found = found.union(more)
    found = stored(found, "vector-links")
    for done in turned:
        discard(done)
    roots = components(found.select(F.col("id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("h", "g").agg(F.sum("links").alias("links"))
    classes = distinct.select("h", "g", "id", "copies").join(links, ["h", "g"], "left").join(roots, F.col("id") == F.col("node"), "left")
    classes = classes.select("h", "g", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "id").alias("component_id"))
    out = slim.join(classes, ["h", "g"], "left")
    out = out.select(F.col("id").alias(key), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("bigint").alias("n_links"), F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id")).alias("component_id"))
    out = stored(out.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(False))), "vector-classes")
    for done in (distinct, found, roots):
        discard(done)
    return out


LINKS = "id bigint, h bigint, g bigint, links bigint, root bigint"


def _links(pdf: pd.DataFrame, basis: np.ndarray, raw: np.ndarray, block: np.ndarray, threshold: float) -> pd.DataFrame:
    ids = pdf["id"].to_numpy(np.int64)
    at, links, low = compare_tile(ids, pdf["copies"].to_numpy(np.int64), block, raw, basis, threshold)
    return pd.DataFrame({"id": ids[at], "h": pdf["h"].to_numpy()[at], "g": pdf["g"].to_numpy()[at], "links": links, "root": low})


def _compare_small(distinct: DataFrame, threshold: float) -> DataFrame:
    """Links among vectors of each length, for lengths of which one block holds all."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        raw = _scaled(np.array(pdf["v"].tolist(), np.float64))
        u = _units(raw)
        return _links(pdf, np.ascontiguousarray(np.linalg.eigh(u.T @ u)[1][:, ::-1]), raw, np.zeros(len(pdf), np.int64), threshold)

    return distinct.withColumn("d", F.size("v")).groupBy("d").applyInPandas(one, LINKS)


def blocks_of(counts: np.ndarray, rows: int, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first block of each bin, blocks that share it, first and last partner of each block) for vectors counted by bins of the first
    coordinate. Bins follow one another into blocks of about `rows`; one with more is dealt to several blocks of its own."""
    first, shared = np.zeros(len(counts), np.int64), np.ones(len(counts), np.int64)
    low: list[int] = []
    high: list[int] = []
    size = 0
    for k in np.flatnonzero(counts).tolist():
        n = int(counts[k])
        if n > rows:
            shared[k] = -(-n // rows)
            first[k] = len(low)
            low += [k] * int(shared[k])
            high += [k] * int(shared[k])
            size = rows  # what follows begins anew
            continue
        if not low or size + n > rows:
            low.append(k)
            high.append(k)
            size = 0
        first[k] = len(low) - 1
        high[-1] = k
        size += n
    low_, high_ = np.array(low, np.int64), np.array(high, np.int64)
    # bins are 2 / BINS wide; one more on either side for rounding
    far = int(np.ceil(reach * BINS / 2)) + 2
    last = np.searchsorted(low_, high_ + far, side="right") - 1
    lowest = np.searchsorted(np.maximum.accumulate(high_), low_ - far, side="left")
    return first, shared, np.minimum(lowest, np.arange(len(low_))), np.maximum(last, np.arange(len(low_)))


def _compare(distinct: DataFrame, d: int, n: int, threshold: float, block_bytes: int, made: list[DataFrame]) -> DataFrame:
    """(id, h, g, links, root): a row for each vector and tile in which it has links. made: gets the stored table that this reads."""
    spark = distinct.sparkSession

    def moments(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in it:
            u = _units(_scaled(np.asarray(batch.column(0).flatten()).reshape(-1, d)))
            total += u.T @ u
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array([row.tobytes() for row in total], pa.binary())], ["at", "x"])

    def added(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"at": pdf["at"].iloc[:1], "x": [sum(np.frombuffer(x, "<f8") for x in pdf["x"]).tobytes()]})

    got = distinct.select("v").mapInArrow(released(moments, 4096), "at bigint, x binary").groupBy("at").applyInPandas(added, "at bigint, x binary").toPandas()  # d rows of d numbers
    second = np.stack([np.frombuffer(x, "<f8") for x in got.sort_values("at")["x"]])
    basis = np.ascontiguousarray(np.linalg.eigh(second)[1][:, ::-1])
    shared = spark.sparkContext.broadcast(basis)
    kind = distinct.schema["id"].dataType.simpleString()

    def rotate(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            x = _scaled(np.asarray(batch.column(4).flatten()).reshape(-1, d))
            y = _units(x) @ shared.value[:, 0]
            bin_ = np.clip(np.floor((y + 1) * (BINS / 2)), 0, BINS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array([r.tobytes() for r in x.astype("<f8")], pa.binary()), pa.array(bin_)], ["h", "g", "id", "copies", "u", "bin"])

    turned = stored(distinct.select("h", "g", "id", "copies", "v").mapInArrow(released(rotate, 4096), f"h bigint, g bigint, id {kind}, copies bigint, u binary, bin int"), "vectors-rotated")
    made.append(turned)
    counts = np.zeros(BINS, np.int64)
    for r in turned.groupBy("bin").agg(F.count("*").alias("n")).collect():  # at most BINS rows
        counts[r["bin"]] = r["n"]
    rows = max(1, min(block_bytes // (8 * d), -(-n // LEAST_BLOCKS)))
    bounds = spark.sparkContext.broadcast(blocks_of(counts, rows, float(np.sqrt(2 - 2 * threshold)) + SLACK))  # two numbers a bin and a block

    def deal(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, several, lo, hi = bounds.value
        for batch in it:
            k = np.asarray(batch.column(5))
            b = first[k] + (np.asarray(batch.column(0)).view(np.uint64) % several[k].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(b, pa.int32()), pa.array(lo[b], pa.int32()), pa.array(hi[b], pa.int32())], ["h", "g", "id", "copies", "u", "block", "lo", "hi"])

    dealt = turned.mapInArrow(released(deal, 4096), f"h bigint, g bigint, id {kind}, copies bigint, u binary, block int, lo int, hi int")
    tiles = dealt.select("h", "g", "id", "copies", "u", "block", F.explode(F.sequence("lo", "hi")).alias("_o")).withColumns({"ti": F.least("block", "_o"), "tj": F.greatest("block", "_o")}).drop("_o")

    def tile(pdf: pd.DataFrame) -> pd.DataFrame:
        block = pdf["block"].to_numpy()
        if pdf["ti"].iloc[0] != pdf["tj"].iloc[0] and block.min() == block.max():  # the other block is empty
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("id", "h", "g", "links", "root")})
        return _links(pdf, shared.value, np.frombuffer(b"".join(pdf["u"]), "<f8").reshape(len(pdf), d), block, threshold)

    return tiles.groupBy("ti", "tj").applyInPandas(tile, LINKS)


def op10_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    return near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
