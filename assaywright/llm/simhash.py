"""SimHash near-duplicates by meet-in-the-middle ball hashing: op2.

Fingerprints link at `radius` 3 or fewer differing bits. The 64 bits are cut into four blocks of 16. A pair at distance 1 to 3
differs in some block; that block is masked out, which leaves two differences at most, and both sides emit all variants within
half the radius (one flipped bit) of what is left: they collide on a variant in the middle. For every pattern of differences over
blocks one mask and one set of flips is enough:

    all differences in one block i       mask i, no flip
    in two blocks i < j                  mask i, flips in j (one difference in j meets by the fingerprint itself)
    in three blocks i < j < k            mask i, flips in j and k

so mask i goes with flips in later blocks: 4 + 48 + 32 + 16 = 100 variants for each distinct fingerprint, not the 2081 of a whole
ball of radius two. Variants are shuffled, and colliding fingerprints are verified by their distance. A bucket holds at most
49 * 2**16 distinct fingerprints (25 MB), so its size is bounded however many documents there are; large buckets are verified on
65,536 words of flips and not by comparing all pairs. Buckets emit a star for each linked set, not pairs.

near_copies() finds copies by similarity, the exact share of common five-word shingles. Fingerprints over a text's different words, which
replaced words move less than those over shingles, propose pairs by the same balls; three bits cannot hold all texts of a similarity of 0.8,
so a sketch of each text, its SKETCH smallest shingles by hash, proposes what the balls miss: a pair that has one of them in common, and half
of all, which all but six in 100,000 pairs of similarity 0.8 have, and the shortest texts always. Shingles of very many texts, such as those of
a passage that many have, make no pairs; texts that are little else go on to buckets of two, three and four of them; see sketch_buckets().
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import discard, flat_utf8, ready, released, stored, table
from .components import components

RADIUS = 3
WORDS = 3
SEED = 42
BLOCK = 16
#: Rounds in which near_copies() decides a few pairs of each text, before it decides all that are left.
ROUNDS = 1
#: Shingles in a text's sketch; texts that a bucket may have for all its pairs to be tried; shingles of crowds that a text must have to go on, how
#: many of these make buckets, and of how many together at most.
SKETCH, CROWD, MOSTLY, LEAD, LEVELS = 32, 16, 24, 8, 4
#: Shingles of a block of texts of a crowd, and a text's least share of them: 2 MB, some 2,048 texts at most, or one that is longer.
CROWD_BLOCK, CROWD_LEAST = 1 << 18, 128


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Of one text in UTF-8: bit i is set if it is set in over half of the shingles' XXH64."""
    parts = text.lower().split()  # bytes: A-Z only, and white space is 0x20 and 0x09-0x0D
    if not parts:
        return 0
    line = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(line, seed)
    ends = np.cumsum([len(p) + 1 for p in parts]) - 1
    starts = (ends - [len(p) for p in parts]).tolist()[: len(parts) - words + 1]
    stops = ends.tolist()[words - 1 :]
    total, n = np.zeros(64, np.int64), len(starts)
    for lo in range(0, n, 1 << 16):  # bounded memory for very long texts
        h = np.fromiter((digest(line[s:e], seed) for s, e in zip(starts[lo : lo + (1 << 16)], stops[lo : lo + (1 << 16)], strict=True)), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def with_fingerprint(df: DataFrame, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the fingerprint as a signed 64-bit integer. A text that is null or has no word has fingerprint zero."""
    ready(df.sparkSession)
    df = df.drop(name)
    schema = df.select("*", F.lit(None).cast("bigint").alias(name)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            raw = data.tobytes()
            fps = np.array([fingerprint(raw[s:e]) for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps.view(np.int64))], [*batch.schema.names, name])

    return df.mapInArrow(released(run), schema)


def variant_plan() -> list[tuple[int, int, int]]:
    """(mask number, bits kept, flip) of the 100 variants; flip 0 stands for none."""
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    out = []
    for i in range(64 // BLOCK):
        keep = ~(((1 << BLOCK) - 1) << (BLOCK * i)) & ((1 << 64) - 1)
        out += [(i, signed(keep), 0)] + [(i, signed(keep), signed(1 << p)) for p in range(BLOCK * (i + 1), 64)]
    return out


def stars(fps: np.ndarray, radius: int = RADIUS, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """(smallest, member) for every linked set among distinct fingerprints, `most` rows of all pairs at a time."""
    n = len(fps)
    label = np.arange(n)
    while True:
        low = np.concatenate([np.where(np.bitwise_count(fps[k : k + most, None] ^ fps[None, :]) <= radius, label[None, :], n).min(axis=1) for k in range(0, n, most)])
        low = low[low]
        if (low == label).all():
            break
        label = low
    return _stars_of(fps, label)


def _stars_of(fps: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low = np.full(int(label.max()) + 1, np.uint64(0xFFFFFFFFFFFFFFFF))
    np.minimum.at(low, label, fps)
    rep = low[label]
    other = rep != fps
    return rep[other], fps[other]


_NEAR = {d: np.array([m for m in range(1, 1 << BLOCK) if m.bit_count() == d]) for d in (1, 2, 3)}


def bucket_stars(fps: np.ndarray, block: int, key: int) -> tuple[np.ndarray, np.ndarray]:
    """stars() of a whole bucket of any size: distinct fingerprints that differ from `key` in block `block` and one later bit at most.

    Such a fingerprint is a value v of the block and a flip f (a later bit, or none), so all of a bucket are 65,536 words of flips. Of
    one v, all with some flip lie within two bits of each other; they are one node, as are those of v and a neighbour of v. So there
    are two nodes a value, and links between them follow from the words of v and of v with one to three bits changed.
    """
    size = 1 << BLOCK
    shift = np.uint64(BLOCK * block)
    diff = (fps ^ np.uint64(key % (1 << 64))) & ~(np.uint64(size - 1) << shift)
    v = ((fps >> shift) & np.uint64(size - 1)).astype(np.int64)
    words = np.zeros(size, np.uint64)
    np.bitwise_or.at(words, v, diff)
    none = np.zeros(size, bool)
    none[v[diff == 0]] = True
    some = words != 0
    at = np.arange(size)
    label = np.concatenate([np.where(none, at, 2 * size), np.where(some, at + size, 2 * size)])  # nodes (v, none) and (v, any flip)
    a, c = label[:size], label[size:]

    while True:
        before = label.copy()
        both = none & some  # one bit apart
        a[both] = c[both] = np.minimum(a, c)[both]
        for d, masks in _NEAR.items():
            for m in masks.tolist():
                w = at ^ m
                hit = none & none[w]
                a[hit] = np.minimum(a, a[w])[hit]
                if d <= 2:
                    hit = none & some[w]
                    a[hit] = np.minimum(a, c[w])[hit]
                    hit = some & none[w]
                    c[hit] = np.minimum(c, a[w])[hit]
                hit = some & some[w] if d == 1 else (words & words[w]) != 0
                c[hit] = np.minimum(c, c[w])[hit]
        node = label < 2 * size
        label[node] = label[label[node]]
        if (label == before).all():
            break
    return _stars_of(fps, label[v + size * (diff != 0)])


def neighbours(fps: np.ndarray, few: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs among ascending fingerprints of one bucket: all among few, else of each with the next three and the first."""
    if len(fps) <= few:
        r, c = np.nonzero(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= RADIUS, 1))
        return fps[r], fps[c]
    pairs = [(fps[:-k], fps[k:]) for k in (1, 2, 3)] + [(np.full(len(fps) - 1, fps[0]), fps[1:])]
    near = [np.bitwise_count(x ^ y) <= RADIUS for x, y in pairs]
    return tuple(np.concatenate([p[i][m] for p, m in zip(pairs, near, strict=True)]) for i in (0, 1))


def colliding(fps: DataFrame, fp: str = "fp", pairs: bool = False) -> DataFrame:
    """(a, b): edges between distinct fingerprints (stored) that collide in a bucket and lie within the radius: a star for each linked set, or,
    with pairs, neighbours()."""
    ready(fps.sparkSession)
    plan = F.array(*[F.struct(F.lit(i).cast("tinyint").alias("i"), F.lit(keep).cast("bigint").alias("keep"), F.lit(flip).cast("bigint").alias("flip")) for i, keep, flip in variant_plan()])
    variants = fps.select(fp, F.explode(plan).alias("v")).select(F.col("v.i").alias("i"), F.col(fp).bitwiseAND(F.col("v.keep")).bitwiseXOR(F.col("v.flip")).alias("k"), fp)
    dealt = variants.repartition("i", "k").sortWithinPartitions("i", "k", fp)

    def of(some: np.ndarray, i: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        some = np.unique(some.view(np.uint64))
        if pairs:
            return neighbours(some)
        return stars(some) if len(some) <= 4096 else bucket_stars(some, i, k)

    def verify(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        rest = np.zeros((3, 0), np.int64)

        def edges(i: np.ndarray, k: np.ndarray, x: np.ndarray) -> pa.RecordBatch:
            new = np.append(True, (k[1:] != k[:-1]) | (i[1:] != i[:-1]))
            first = np.flatnonzero(new)
            size = np.diff(np.append(first, len(k)))
            a, b = [], []
            pair = first[size == 2]
            u, v = x[pair].view(np.uint64), x[pair + 1].view(np.uint64)
            near = (np.bitwise_count(u ^ v) <= RADIUS) & (u != v)
            a.append(np.minimum(u, v)[near])
            b.append(np.maximum(u, v)[near])
            for s, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                p, q = of(x[s : s + n], int(i[s]), int(k[s]))
                a.append(p)
                b.append(q)
            p, q = np.concatenate(a).tolist(), np.concatenate(b).tolist()
            if len(seen) > 50_000:
                seen.clear()  # only spares repeats
            fresh = [e for e in dict.fromkeys(zip(p, q, strict=True)) if e not in seen]
            seen.update(fresh)
            cols = np.array(fresh, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(cols[:, 0]), pa.array(cols[:, 1])], ["a", "b"])

        for batch in it:
            i, k, x = (np.asarray(c).astype(np.int64) for c in batch.columns)
            i, k, x = (np.concatenate(z) for z in zip(rest, (i, k, x), strict=True))
            change = np.flatnonzero((k[1:] != k[:-1]) | (i[1:] != i[:-1]))
            cut = int(change[-1]) + 1 if len(change) else 0  # the last bucket may go on
            rest = np.array([i[cut:], k[cut:], x[cut:]])
            if cut:
                yield edges(i[:cut], k[:cut], x[:cut])
        if rest.shape[1]:
            yield edges(*rest)

    return dealt.mapInArrow(released(verify, 1 << 20), "a bigint, b bigint")


def linked(fps: DataFrame, fp: str = "fp") -> DataFrame:
    """(node, root): the distinct fingerprints that link with another, and the smallest (as unsigned) that each reaches.

    fps: distinct fingerprints, stored.
    """
    found = colliding(fps, fp)
    flip = F.lit(-(1 << 63)).cast("bigint")  # so that signed order is the order of unsigned values
    roots = components(found.select(F.col("a").bitwiseXOR(flip).alias("a"), F.col("b").bitwiseXOR(flip).alias("b")))
    out = roots.select(F.col("node").bitwiseXOR(flip).alias("node"), F.col("root").bitwiseXOR(flip).alias("root"))
    out._assay_path = roots._assay_path  # for discard()
    return out


def near_duplicates(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fp, component_id) of every row of df: component_id is the smallest key of the rows that are linked with it.

    Texts that are null or have no words have fingerprint zero and are linked like others. Rows without a key get the id of
    their component; it is null if no row of the component has one. Repeated rows come out as often as they are there; texts of any
    length are read whole, in runs of shingles; an empty table gives no rows. Other columns of df, whatever their names, are left out.
    """
    rows = stored(with_fingerprint(df.select(key, text), text).select(key, "fp"), "fingerprints")
    distinct = stored(rows.groupBy("fp").agg(F.min(key).alias("_low")), "fingerprint-classes")
    roots = linked(distinct.select("fp"))
    by_root = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "_low", F.coalesce("root", "fp").alias("_root"))
    by_root = stored(by_root, "fingerprint-roots")
    low = by_root.groupBy("_root").agg(F.min("_low").alias("component_id"))
    ids = by_root.join(low, "_root").select("fp", "component_id")
    out = stored(rows.join(ids, "fp"), "near-duplicates")
    for done in (rows, distinct, roots, by_root):
        discard(done)
    return out


# ---- copies by similarity
class _Words:
    """Hashes of words, kept for the next texts."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > 200_000:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w, SEED)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def _majority(h: np.ndarray) -> int:
    total = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        total += np.unpackbits(np.ascontiguousarray(h[lo : lo + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(h), bitorder="little").view("<i8")[0])


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """Different hashes of the runs of `words` words; of fewer, of the whole."""
    n = max(1, len(h) - words + 1)
    out = np.zeros(n, np.uint64)
    for k in range(min(words, len(h))):
        out = (out ^ h[k : k + n]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return np.unique(out)


def _sequence(raw: bytes) -> tuple[list[bytes], bytes]:
    """The lower-cased words of a text in UTF-8, and a digest that stands for their sequence."""
    parts = raw.lower().split()
    return parts, hashlib.blake2b(b" ".join(parts), digest_size=16).digest()


def with_sequence(df: DataFrame, text: str = "text", name: str = "digest") -> DataFrame:
    """Adds the digest of each text's sequence of lower-cased words, as near_copies() has it. A column of this name is replaced."""
    ready(df.sparkSession)
    df = df.drop(name)
    schema = df.select("*", F.lit(None).cast("binary").alias(name)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            raw = data.tobytes()
            got = [_sequence(raw[s:e])[1] for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.binary())], [*batch.schema.names, name])

    return df.mapInArrow(released(run), schema)


def _may_be_alike(x: Callable[[str], Column], y: Callable[[str], Column], similarity: float) -> Column:
    """Whether sizes and sketches (`low`) of two texts allow the similarity: half of the sketch at 0.8; of texts that are all sketch, what is asked."""
    n = lambda of: F.least(of("size"), F.lit(SKETCH))
    asked = F.ceil(F.lit(similarity / (1 + similarity)) * (n(x) + n(y)) - F.lit(1e-9))
    common = F.size(F.array_intersect(x("low"), y("low")))
    return (F.least(x("size"), y("size")) >= F.lit(similarity) * F.greatest(x("size"), y("size"))) & (common >= F.least(asked, F.lit(max(1, int(SKETCH * (similarity - 0.3))))))


def sketch_buckets(items: DataFrame, held: Callable[[DataFrame, str], DataFrame], similarity: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """(pairs, crowds) from items with digest, size (different shingles), sketch (hashes) and low (the same in brief): pairs (ra, rb) of all
    buckets of up to CROWD texts that may be alike, and (k, digest, size, low) of the buckets that are left.

    A bucket is a shingle that stands in the sketches of several texts. Of alike texts a fifth of one at most is not in the other, so where
    more than that of a text stands in buckets that are not crowded, one of these brings the two together. Texts with MOSTLY of their sketch in crowds
    go on: two of their LEAD smallest crowded shingles make a bucket, then three, then four. What is crowded even then has most of its
    text and half of those in common. Of such texts of similarity 0.8 one pair in a hundred shares fewer than four and is not proposed; of 0.85 one in 300.
    """
    base = rows = held(items.select(F.explode("sketch").alias("k"), "digest"), "sketches")
    brief = lambda name: items.select(F.col("digest").alias(name), F.col("size").alias(f"{name}_size"), F.col("low").alias(f"{name}_low"))
    of = lambda name: lambda x: F.col(f"{name}_{x}")
    two = F.flatten(F.transform("d", lambda x, i: F.transform(F.slice("d", i + 2, F.size("d")), lambda y: F.struct(x.alias("ra"), y.alias("rb")))))
    met = None
    for level in range(1, LEVELS + 1):
        counts = held(rows.groupBy("k").agg(F.count("*").alias("n")).filter("n > 1"), "sketch-counts")
        total = counts.agg(F.sum("n")).first()[0] or 0
        hot = F.broadcast(counts.filter(F.col("n") > max(CROWD, total // 10_000)).select("k"))  # 10,000 at most
        cool = rows.join(hot, "k", "left_anti")
        few = cool.join(counts.filter(F.col("n") <= CROWD), "k", "left_semi").groupBy("k").agg(F.sort_array(F.collect_list("digest")).alias("d"))
        new = held(few.select(F.explode(two).alias("p")).select("p.ra", "p.rb").distinct(), "met-in-buckets")
        met = new if met is None else met.unionByName(new)
        crowded = rows.join(hot, "k", "left_semi").unionByName(cool.join(counts.filter(F.col("n") > CROWD), "k", "left_semi"))
        if level == 1:
            sets = crowded.groupBy("digest").agg(F.sort_array(F.collect_list("k")).alias("c"))
            least = F.ceil(F.lit(MOSTLY / SKETCH) * F.least(F.col("size"), F.lit(SKETCH)))
            base = held(sets.join(items.select("digest", "size"), "digest").filter(F.size("c") >= least).select("digest", F.slice("c", 1, LEAD).alias("c")), "crowded-texts")
            sets = base
        else:
            sets = base.join(crowded.select("digest").distinct(), "digest", "left_semi")
        if level < LEVELS:
            rows = held(sets.mapInArrow(released(_combined(level + 1), 1 << 14), "q array<bigint>, digest binary").select(F.xxhash64("q").alias("k"), "digest"), "sketch-groups")
    pairs = met.distinct().join(brief("ra"), "ra").join(brief("rb"), "rb").filter(_may_be_alike(of("ra"), of("rb"), similarity)).select("ra", "rb")
    crowds = held(crowded.join(items.select("digest", "size", "low"), "digest").select("k", "digest", "size", "low"), "crowds")
    return pairs, crowds


def _combined(many: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of (digest, shingles in order) a row for each combination of `many` shingles, in order."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            out, at = [], []
            for i, c in enumerate(batch.column(1).to_pylist()):
                new = [list(x) for x in combinations(c, many)]
                out += new
                at += [i] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64())), batch.column(0).take(pa.array(at, pa.int64()))], ["q", "digest"])

    return run


def crowd_links(members: DataFrame, held: Callable[[DataFrame, str], DataFrame], similarity: float = 0.8) -> DataFrame:
    """(a, b): links that join the roots of texts of one group that are alike, from (g, digest, root, size, s), g being a group that all pairs are wanted
    of, root what a text is joined with already, and s all its shingles in order.

    Pairs are not made as rows. Texts of a group are dealt to blocks of one order of size, roots with many texts to blocks of their own, and
    a task counts the common shingles of all texts of two blocks at once. Blocks of one root, and sizes that are too far apart, do not meet. Of
    the links of two blocks those go out that join roots which others have not joined, so fewer than the blocks have roots.
    """
    ready(members.sparkSession)
    weight = F.greatest(F.lit(CROWD_LEAST).cast("double"), F.pow(F.lit(2.0), F.col("e") + 1))
    rows = members.withColumn("e", F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    large = F.col("n") * weight >= CROWD_BLOCK / 2
    own = rows.groupBy("g", "e", "root").agg(F.count("*").alias("n")).filter(large).select("g", "e", "root", F.col("root").alias("own"))
    rows = rows.join(own, ["g", "e", "root"], "left")
    by = F.coalesce("own", F.lit(b""))  # no digest is empty
    parts = rows.groupBy("g", "e", by.alias("o")).agg(F.count("*").alias("n")).select("g", "e", "o", F.ceil(F.col("n") * weight / CROWD_BLOCK).cast("int").alias("m"))
    rows = rows.withColumn("o", by).join(parts, ["g", "e", "o"]).withColumn("p", F.pmod(F.xxhash64("digest"), F.col("m")).cast("int"))
    blocks = held(rows.groupBy("g", "e", "o", "p").agg(F.collect_list(F.struct("digest", "root", "s")).alias("t")), "crowd-blocks")
    x, y = (blocks.select("g", *[F.col(c).alias(f"{c}{i}") for c in ("e", "o", "p")]) for i in "xy")
    place = lambda i: F.struct(*[f"{c}{i}" for c in ("e", "o", "p")])
    # sizes of one order differ by less than a factor of two, so those of a similarity over a half lie in the same or the next
    meet = x.join(y, "g").filter((place("x") <= place("y")) & (F.abs(F.col("ex") - F.col("ey")) <= int(np.ceil(-np.log2(similarity)))) & ((F.col("ox") != F.col("oy")) | (F.col("ox") == F.lit(b""))))
    for i in "xy":
        at = blocks.select("g", *[F.col(c).alias(f"{c}{i}") for c in ("e", "o", "p")], F.col("t").alias(f"t{i}"))
        meet = meet.join(at, ["g", *[f"{c}{i}" for c in ("e", "o", "p")]])
    tiles = meet.select((place("x") == place("y")).alias("same"), "tx", "ty").repartition(F.xxhash64("g", place("x"), place("y")))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for i in range(batch.num_rows):
                a, b = _block_links(batch.column(1)[i].values, batch.column(2)[i].values, batch.column(0)[i].as_py(), similarity)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    return tiles.mapInArrow(released(run, 1), "a binary, b binary")


def _block_links(x: pa.StructArray, y: pa.StructArray, same: bool, similarity: float, columns: int = 4096, most: int = 256) -> tuple[list[bytes], list[bytes]]:
    """Of two blocks of (digest, root, s): links between texts of different roots, as many as join all roots that links join."""
    root = _Joined()
    sides = []
    for block in (x, y):
        s = block.field("s")
        sizes = np.diff(np.asarray(s.offsets))
        sides.append((block.field("digest").to_pylist(), [root.number(r) for r in block.field("root").to_pylist()], np.asarray(s.flatten()), np.repeat(np.arange(len(s)), sizes), sizes))
    (name_x, root_x, s_x, at_x, size_x), (name_y, root_y, s_y, at_y, size_y) = sides
    both = np.intersect1d(s_x, s_y)  # shingles of one side alone are in no pair
    entries = []
    for s, at in ((s_x, at_x), (s_y, at_y)):
        where = np.minimum(np.searchsorted(both, s), max(0, len(both) - 1))
        hit = both[where] == s if len(both) else np.zeros(len(s), bool)
        where, at = where[hit], at[hit]
        order = np.argsort(where, kind="stable")
        entries.append((where[order], at[order]))
    a, b = [], []
    for lo in range(0, len(name_x), most):
        hi = min(lo + most, len(name_x))
        common = np.zeros((hi - lo, len(name_y)), np.float32)  # whole numbers below 2**24 are exact
        for k in range(0, len(both), columns):
            (w_x, t_x), (w_y, t_y) = ((w[p:q], t[p:q]) for w, t in entries for p, q in [np.searchsorted(w, (k, k + columns))])
            here = (t_x >= lo) & (t_x < hi)
            if not here.any():
                continue
            m_x, m_y = np.zeros((hi - lo, columns), np.float32), np.zeros((len(name_y), columns), np.float32)
            m_x[t_x[here] - lo, w_x[here] - k] = 1
            m_y[t_y, w_y - k] = 1
            common += m_x @ m_y.T
        n = common.astype(np.int64)
        near = (n >= similarity * (size_x[lo:hi, None] + size_y[None, :] - n)) & (np.array(root_x[lo:hi])[:, None] != np.array(root_y)[None, :])
        for i, j in zip(*np.nonzero(near), strict=True):
            if (not same or lo + i < j) and root.join(root_x[lo + i], root_y[j]):
                a.append(name_x[lo + i])
                b.append(name_y[j])
    return a, b


class _Joined:
    """Roots that are joined step by step."""

    def __init__(self) -> None:
        self.numbers: dict[bytes, int] = {}
        self.up: list[int] = []

    def number(self, name: bytes) -> int:
        if name not in self.numbers:
            self.numbers[name] = len(self.up)
            self.up.append(len(self.up))
        return self.numbers[name]

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def near_copies(df: DataFrame, key: str, text: str = "text", words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(key, digest, low, low_digest) of every row: digest names the text's sequence of lower-cased words; low and low_digest are the smallest key
    of its group, and the digest of that row.

    Texts of one word sequence are one group. Two others link if their shingles of `words` words (fewer: the whole) are alike: common ones
    over all of both, at least `similarity`, counted exactly on whole texts of any length. Pairs are proposed where fingerprints over different
    words lie within three bits, and by sketch_buckets(), which says what may be missed; none below `similarity` is made. Null texts, and texts
    without words, are one sequence. A null key is larger than any other. An empty table gives no rows. Columns of df besides key and text
    are not looked at, whatever their names.
    """
    ready(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()
    df = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Words()
        for batch in it:
            data, offs = flat_utf8(batch.column(1))
            raw = data.tobytes()
            digests, prints, sizes, sketches, lows = [], [], [], [], []
            for s, e in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                parts, digest = _sequence(raw[s:e])
                digests.append(digest)
                h = look(parts)
                prints.append(_majority(np.unique(h)) if len(h) else 0)
                all_ = _shingles(h, words)
                sizes.append(len(all_))
                sketches.append(all_[:SKETCH].view(np.int64))
                lows.append(all_[:SKETCH].astype(np.uint32).view(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(prints, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sketches, pa.list_(pa.int64())), pa.array(lows, pa.list_(pa.int32()))], ["_key", "digest", "fp", "size", "sketch", "low"])

    made: list[DataFrame] = []

    def held(some: DataFrame, name: str) -> DataFrame:
        made.append(stored(some, name))
        return made[-1]

    rows = stored(df.mapInArrow(released(run), f"_key {kind}, digest binary, fp bigint, size bigint, sketch array<bigint>, low array<int>"), "word-fingerprints")
    items = held(rows.groupBy("digest").agg(F.first("fp").alias("fp"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.first("low").alias("low"), F.min("_key").alias("least")), "word-sequences")
    one = held(items.groupBy("fp").agg(F.min("digest").alias("rep")), "word-classes")
    far = colliding(one.select("fp"), pairs=True).distinct()
    far = far.join(one.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(one.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select("ra", "rb")
    sketched, crowds = sketch_buckets(items, held, similarity)
    # of a crowd each with the smallest
    side = lambda c: crowds.select("k", *[F.col(x).alias(f"{x}_{c}") for x in ("digest", "size", "low")])
    of = lambda c: lambda x: F.col(f"{x}_{c}")
    fits = _may_be_alike(of("a"), of("b"), similarity)
    first = crowds.groupBy("k").agg(F.min(F.struct("digest", "size", "low")).alias("m")).select("k", *[F.col(f"m.{x}").alias(f"{x}_a") for x in ("digest", "size", "low")])
    star = side("b").join(first, "k").filter((F.col("digest_a") != F.col("digest_b")) & fits).select(F.col("digest_a").alias("ra"), F.col("digest_b").alias("rb"))
    proposed = far.unionByName(sketched).unionByName(star)
    pairs = held(proposed.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).filter("a <> b").distinct(), "proposed-pairs")

    def texts_of(needed: DataFrame) -> DataFrame:
        """The texts of sequences (digest), one of each."""
        one_row = rows.join(needed, "digest", "left_semi").groupBy("digest").agg(F.min("_key").alias("_one"))
        whole = df.select("_key", F.coalesce("_text", F.lit("")).alias("t")).join(one_row, F.col("_key").eqNullSafe(F.col("_one"))).select("digest", "t")
        return held(whole.mapInArrow(released(_true_texts), "digest binary, t string").groupBy("digest").agg(F.first("t").alias("t")), "pair-texts")

    def alike(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look, last = _Words(), {}

        def of(name: bytes, t: str) -> np.ndarray:
            if name not in last:
                if len(last) > 32:
                    last.clear()
                last[name] = _shingles(look(t.encode().lower().split()), words)
            return last[name]

        for batch in it:
            a, b, ta, tb = (c.to_pylist() for c in batch.columns)
            keep = []
            for i in range(len(a)):
                x, y = of(a[i], ta[i]), of(b[i], tb[i])
                both = len(np.intersect1d(x, y, assume_unique=True))
                if both >= similarity * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), batch.column(1).take(pa.array(keep, pa.int64()))], ["a", "b"])

    def shingled(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _Words()
        for batch in it:
            sets = [_shingles(look(t.encode().lower().split()), words).view(np.int64) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["digest", "s"])

    def decided(some: DataFrame, texts: DataFrame) -> DataFrame:
        side = lambda c: texts.select(F.col("digest").alias(c), F.col("t").alias(f"t{c}"))
        return held(some.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb").mapInArrow(released(alike), "a binary, b binary"), "alike-pairs")

    def rooted(some: DataFrame, name: str, roots: DataFrame, to: str) -> DataFrame:
        return some.join(roots.select(F.col("node").alias(name), F.col("root").alias(to)), name, "left").withColumn(to, F.coalesce(to, name))

    def settled(left: DataFrame, close: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """All links so far and the components they make. In a group of copies a few links join all, so pairs are decided in rounds: first two of
        each text, then two more of each that still lie in different groups, then all that do. Pairs within a group that is joined already
        need no decision."""
        texts, roots = texts_of(left.select(F.col("a").alias("digest")).union(left.select("b")).distinct()), None
        for turn in range(ROUNDS + 1):
            some = left
            if turn < ROUNDS:
                hash_ = F.xxhash64(F.lit(turn), "a", "b")
                one = lambda c, d: left.groupBy(c).agg(F.min(F.struct(hash_.alias("h"), d)).alias("m")).select(F.col(c), F.col(f"m.{d}").alias(d))  # noqa: B023, E731
                some = held(one("a", "b").select("a", "b").union(one("b", "a").select("a", "b")).distinct(), "pairs-of-a-round")
            more = decided(some, texts)
            close = more if close is None else close.union(more)
            roots = components(close)
            made.append(roots)
            if turn < ROUNDS:
                apart = rooted(rooted(left.join(some, ["a", "b"], "left_anti"), "a", roots, "ra"), "b", roots, "rb").filter("ra <> rb")
                left = held(apart.select("a", "b"), "pairs-apart")
                if not left.limit(1).count():
                    break
        return close, roots

    close, roots = settled(pairs, None)
    # crowds that are not one group yet: every text with those of other groups, in all crowds that texts bring together
    split = held(rooted(crowds, "digest", roots, "root").select("k", "digest", "root", "size"), "crowds-by-group")
    many = split.groupBy("k").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("k")
    split = held(split.join(many, "k", "left_semi"), "crowds-apart")
    if split.limit(1).count():
        heads = split.groupBy("k").agg(F.min("digest").alias("a"))
        wide = components(held(split.join(heads, "k").select("a", F.col("digest").alias("b")).distinct(), "crowd-edges"))
        made.append(wide)
        inside = held(split.select("digest", "root", "size").distinct().join(wide.select(F.col("node").alias("digest"), F.col("root").alias("g")), "digest"), "crowd-texts")
        sets = held(texts_of(inside.select("digest")).mapInArrow(released(shingled), "digest binary, s array<bigint>"), "crowd-shingles")
        more = held(crowd_links(inside.join(sets, "digest").select("g", "digest", "root", "size", "s"), held, similarity), "crowd-links")
        roots = components(close.union(more))
        made.append(roots)
    grouped = stored(items.select("digest", F.col("least").alias("low")).join(roots, F.col("digest") == F.col("node"), "left").select("digest", "low", F.coalesce("root", "digest").alias("root")), "copy-groups")
    best = F.min(F.struct(F.col("low").isNull().alias("none"), "low", "digest"))
    lows = grouped.groupBy("root").agg(best.alias("m")).select("root", F.col("m.low").alias("low"), F.col("m.digest").alias("low_digest"))
    out = stored(rows.select(F.col("_key").alias(key), "digest").join(grouped.select("digest", "root"), "digest").join(lows, "root").select(key, "digest", "low", "low_digest"), "near-copies")
    for table_ in [*made, rows, grouped]:
        discard(table_)
    return out


def _true_texts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (digest, text) rows those whose text has that sequence of words: a key may stand for several texts."""
    for batch in it:
        keep = [i for i, (d, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) if _sequence(t.encode())[1] == d]
        yield batch.take(pa.array(keep, pa.int64()))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every document."""
    docs = table(spark, sf_dir, "documents")
    got = near_duplicates(docs, "doc_id")
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
