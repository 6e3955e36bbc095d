"""Perceptual hashes of luminance grids and lookups by Hamming distance.

The lookup is an equi join on bands: of three bands (more beyond a distance of eight) two hashes within the distance differ in some band
by a third of it at most. Each side emits its bands, and as many flips of single bits as make such bands meet: none, on one side, or on
both. So bands are wide (21 bits), and few pairs that lie apart meet by chance. Candidates are checked by the bit count of the exclusive
or. A reference set that has been counted and found small is broadcast instead, on request. Both ways give the same rows. Families of hashes, of which
some differ in few bits, are compared block by block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest distance of each family, in the order in which equal distances win.
FAMILIES = {"ahash": 5, "dhash": 6, "phash": 8}
#: References up to this many are compared with all queries, where the caller asks for it.
MOST_BROADCAST = 10_000
#: Rows of a block, and parts of the pairs of blocks: a pair takes a fraction of a second and 1 MB.
BLOCK, MOST_TILES = 8192, 4000


def _bits(flags: Column) -> Column:
    """Bit i of a BIGINT from flags[i]."""
    return F.aggregate(F.transform(flags, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))), F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x))


def ahash(grid: Column) -> Column:
    """grid: 64 luminances from 0 to 255. A bit is set where the pixel exceeds the integer mean."""
    total = F.aggregate(grid, F.lit(0).cast("bigint"), lambda a, x: a + x.cast("bigint"))
    mean = F.floor(total / F.size(grid))
    return _bits(F.transform(grid, lambda x: x > mean))


def dhash(grid: Column) -> Column:
    """grid: 8 rows of 9 luminances. A bit is set where a pixel exceeds its right neighbour."""
    at = F.sequence(F.lit(0), F.lit(63))
    return _bits(F.transform(at, lambda i: F.get(grid, (F.floor(i / 8) * 9 + i % 8).cast("int")) > F.get(grid, (F.floor(i / 8) * 9 + i % 8 + 1).cast("int"))))


def phash_of(grids: np.ndarray) -> np.ndarray:
    """grids: any number of 32 x 32. The 63 lowest frequencies of the orthonormal cosine transform without the constant, against their upper median; in
    millionths, so that frequencies that are equal but for rounding are equal."""
    n = 32
    k = np.arange(n)
    c = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / (2 * n)) * np.sqrt(np.where(k == 0, 1, 2) / n)[:, None]
    c = c[:8]
    low = np.floor((c @ np.asarray(grids, float).reshape(-1, n, n) @ c.T).reshape(-1, 64)[:, 1:] * 1e6 + 0.5)
    bits = low > np.sort(low, axis=1)[:, 31:32]
    return (bits.astype(np.int64) << np.arange(63)).sum(axis=1)


def phash(df: DataFrame, grid: str = "grid", name: str = "phash") -> DataFrame:
    """Adds the transform hash of 32 x 32 grids, computed in Arrow batches; null grids have none."""
    out = T.StructType([*df.schema.fields, T.StructField(name, T.LongType())])

    def run(it):
        for batch in it:
            col = batch.column(batch.schema.get_field_index(grid))
            there = np.asarray(col.is_valid())
            got = np.zeros(batch.num_rows, np.int64)
            if there.any():
                got[there] = phash_of(np.asarray(col.drop_null().flatten(), float))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.int64(), mask=~there)], [*batch.schema.names, name])

    return df.mapInArrow(run, out)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def band_edges(bands: int) -> list[tuple[int, int]]:
    """[(first bit, bits)] of `bands` bands that cover 64 bits."""
    size, more = divmod(64, bands)
    out, at = [], 0
    for i in range(bands):
        n = size + (i < more)
        out.append((at, n))
        at += n
    return out


def band_plan(threshold: int) -> tuple[int, int]:
    """(bands, differing bits in some band at most) for two hashes within the threshold."""
    bands = max(3, -(-(threshold + 1) // 3))
    return bands, threshold // bands


def _banded(df: DataFrame, h: str, bands: int, flips: bool) -> DataFrame:
    """A row for each band of each hash, and with flips for each of its bits changed."""
    each = [(i, at, n, m) for i, (at, n) in enumerate(band_edges(bands)) for m in (0, *(1 << k for k in range(n if flips else 0)))]
    one = lambda i, at, n, m: F.struct(F.lit(i).alias("b"), F.call_function("shiftrightunsigned", F.col(h), F.lit(at)).bitwiseAND(F.lit((1 << n) - 1).cast("bigint")).bitwiseXOR(F.lit(m).cast("bigint")).alias("v"))
    return df.withColumn("_band", F.explode(F.array(*[one(*x) for x in each]))).withColumns({"_b": F.col("_band.b"), "_v": F.col("_band.v")}).drop("_band")


def matches(queries: DataFrame, refs: DataFrame, threshold: int, method: str = "banded", parts: int | None = None) -> DataFrame:
    """(query columns..., ref_id, distance) within threshold. queries has `h`; refs has ref_id and `ref_h`. method: banded or broadcast.

    Equal hashes on either side are met once: candidates are joined on distinct hashes, then joined back. broadcast counts the references
    first, and takes bands after all if there are more than MOST_BROADCAST. parts: tasks that bands are dealt to; otherwise Spark chooses, by
    their compressed size, and tasks grow with the input.
    """
    if method == "broadcast" and refs.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST:
        return queries.join(F.broadcast(refs), hamming(F.col("h"), F.col("ref_h")) <= threshold).withColumn("distance", hamming(F.col("h"), F.col("ref_h"))).drop("ref_h")
    bands, differ = band_plan(threshold)
    a = _banded(queries.select("h").distinct(), "h", bands, differ >= 1)
    b = _banded(refs.select("ref_h").distinct(), "ref_h", bands, differ >= 2)
    if parts:
        a, b = (x.repartition(parts, "_b", "_v") for x in (a, b))
    pairs = a.join(b, ["_b", "_v"]).filter(hamming(F.col("h"), F.col("ref_h")) <= threshold).select("h", "ref_h").distinct()
    return queries.join(pairs, "h").join(refs, "ref_h").withColumn("distance", hamming(F.col("h"), F.col("ref_h"))).drop("ref_h")


def _blocks(df: DataFrame, name: str, by: list[str]) -> tuple[DataFrame, int]:
    """One row for each block of some BLOCK rows: its rows as one array. Rows are dealt by a hash of `by`, so equal hashes don't make a large block."""
    n = max(1, -(-df.count() // BLOCK))
    at = F.pmod(F.xxhash64(*by), F.lit(n)).alias(f"_{name}")
    return df.groupBy(at).agg(F.collect_list(F.struct(*df.columns)).alias(name)), n


def family_matches(frames: DataFrame, refs: DataFrame, key: list[str], families: dict[str, int] = FAMILIES, best: bool = False) -> DataFrame:
    """frames: key columns and a hash column for each family; refs: ref_id and the same. All matches within each family's distance:
    (key..., family_ord, family, ref_id, distance). best: at least the one of each row of frames with the least distance, then family, then ref_id,
    and no more than one for each block of references.

    Transform hashes of like pictures differ in so few bits that their bands hold a large share of all hashes, and matches grow with the square of
    the rows. So blocks of frames meet blocks of references, and bits are counted for all pairs of two blocks at once, a nanosecond a pair: a task
    holds two blocks, however many rows match. Matches are neither joined nor shuffled.
    """
    names = list(families)
    q, m = _blocks(frames.select(*key, *names), "q", key)
    r, n = _blocks(refs.select("ref_id", *names), "r", ["ref_id"])
    tiles = q.crossJoin(r).repartition(min(m * n, MOST_TILES), "_q", "_r").select("q", "r")
    kept = [*[frames.schema[c] for c in key], T.StructField("family_ord", T.IntegerType()), T.StructField("family", T.StringType()), refs.schema["ref_id"], T.StructField("distance", T.IntegerType())]

    def run(it):
        for batch in it:
            for i in range(batch.num_rows):
                yield from _tile(batch.column(0)[i].values, batch.column(1)[i].values, key, families, best)

    return tiles.mapInArrow(run, T.StructType([T.StructField(f.name, f.dataType) for f in kept]))


def _tile(rows: pa.StructArray, refs: pa.StructArray, key: list[str], families: dict[str, int], best: bool):
    """Matches of a block of rows with a block of references, in Arrow batches of some 100,000."""
    ids = refs.field("ref_id")
    if best:  # the first of equally distant references is the one to take
        order = pc.sort_indices(ids)
        refs, ids = refs.take(order), ids.take(order)
    names, chunk, found = list(families), 64, []
    hashes = [(np.asarray(x.field(c).fill_null(0)).view(np.uint64), np.asarray(x.field(c).is_valid())) for c in names for x in (rows, refs)]

    def out():
        if not found:
            return
        a, b, k, d = (np.concatenate(x) for x in zip(*found, strict=True))
        found.clear()
        cols = [*[rows.field(c).take(pa.array(a)) for c in key], pa.array(k, pa.int32()), pa.array(names).take(pa.array(k)), ids.take(pa.array(b)), pa.array(d, pa.int32())]
        for at in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([c.slice(at, 100_000) for c in cols], [*key, "family_ord", "family", "ref_id", "distance"])

    for at in range(0, len(rows), chunk):
        nearest = []
        for k, c in enumerate(names):
            (h, there), (ref, ref_there) = hashes[2 * k], hashes[2 * k + 1]
            d = np.bitwise_count(h[at : at + chunk, None] ^ ref[None, :])
            d[~there[at : at + chunk]] = 255
            d[:, ~ref_there] = 255
            if best:
                j = d.argmin(axis=1)
                low = d[np.arange(len(d)), j].astype(np.int64)
                nearest.append((np.where(low <= families[c], low, 255), j))
            else:
                a, b = np.nonzero(d <= families[c])
                found.append((a + at, b, np.full(len(a), k), d[a, b].astype(np.int64)))
        if best:
            low = np.stack([x for x, _ in nearest])
            k = low.argmin(axis=0)  # the first family of equal distances
            each = np.arange(low.shape[1])
            hit = np.flatnonzero(low[k, each] < 255)
            found.append((hit + at, np.stack([j for _, j in nearest])[k, each][hit], k[hit], low[k, each][hit]))
        if sum(len(x[0]) for x in found) >= 100_000:
            yield from out()
    yield from out()


def best_match(found: DataFrame, key: str) -> DataFrame:
    """One row for each key: least distance; of equal ones the first frame, family and reference."""
    return found.groupBy(key).agg(F.min(F.struct("distance", "frame", "family_ord", "ref_id")).alias("m")).select(key, "m.distance", "m.frame", "m.family_ord", "m.ref_id")


def largest(refs: DataFrame, n: int, by: str, key: str = "ref_id") -> DataFrame:
    """The keys of the n rows with the largest values of an integer column; of equal ones the first by key. key is unique; nulls come last.

    Not by a global order, which ends in one task: counts by ranges of values (partial sums, 256 ranges at a time) narrow down to the value that
    the n-th row has, all rows above it are taken, and of the rows with that value those whose keys come first, found by counts of their prefixes.
    """
    v = F.coalesce(F.col(by).cast("bigint"), F.lit(-(1 << 62)))
    rows = refs.select(key, v.alias("_v"))
    lo, hi = rows.agg(F.min("_v"), F.max("_v")).first()
    if lo is None:
        return rows.select(key)
    above = 0  # rows with a value over hi
    while lo < hi:  # the value that the n-th row has lies in lo..hi
        step = max(1, (hi - lo + 256) // 256)
        found = rows.filter(F.col("_v").between(lo, hi)).groupBy(F.call_function("div", F.col("_v") - lo, F.lit(step)).alias("b")).count().orderBy(F.desc("b")).collect()  # 256 at most
        for r in found:
            if above + r["count"] >= n:
                lo, hi = lo + r["b"] * step, min(hi, lo + (r["b"] + 1) * step - 1)
                break
            above += r["count"]
        else:
            return rows.select(key)  # fewer than n
    sure, tied = rows.filter(F.col("_v") > lo).select(key), rows.filter(F.col("_v") == lo).select(F.col(key).cast("string").alias("_k"), key)
    left = n - above
    head = ""  # all tied keys below it are in; those that begin with it are undecided
    taken = sure
    while True:
        size = len(head) + 1
        found = sorted(tied.filter(F.startswith("_k", F.lit(head))).groupBy(F.substring("_k", 1, size).alias("p")).count().collect())  # a row for each next character
        ok, nxt = [], None
        for r in found:
            if r["count"] <= left:
                ok.append(r["p"])
                left -= r["count"]
            else:
                nxt = r["p"]
                break
        if ok:
            taken = taken.union(tied.filter(F.substring("_k", 1, size).isin(ok)).select(key))
        if nxt is None or not left:
            return taken
        head = nxt


def edge_subset(refs: DataFrame, matched: int, newest: int, regional: int, region: str) -> DataFrame:
    """References for an edge node: the most matched, the newest and the most matched of its region, each once. ref_id is unique."""
    refs = refs.withColumn("_added", F.unix_micros("added_at"))
    a = largest(refs, matched, "match_count")
    b = largest(refs, newest, "_added")
    c = largest(refs.filter(F.col("region") == region), regional, "match_count")
    return a.union(b).union(c).distinct()


def latest_references(feed: DataFrame) -> DataFrame:
    """Feed rows (ref_id, ref_h, added_at): the last one of each reference."""
    last = feed.groupBy("ref_id").agg(F.max(F.struct("added_at", "ref_h")).alias("m"))
    return last.select("ref_id", "m.ref_h", "m.added_at")

