"""Exact repeated-substring removal with suffix arrays made by induced sorting: op3.

A byte goes if a string of `length` bytes that covers it starts anywhere else too. The work is cut so that no suffix of the corpus
is ever shuffled:

1. Every window of `length` bytes has an anchor, its leftmost smallest `gram` by hash. The anchor depends on the window's content
   alone, so equal windows have equal anchors at equal places. The windows of one anchor occurrence follow one another; with
   their bytes they are a segment of at most 2 * length - gram bytes. About one byte in 85 is an anchor.
2. Anchors are counted. Windows whose anchor is found once repeat nowhere.
3. Equal segments (by a cryptographic digest of 128 bits) are one string with a count: where it is above one, all its windows repeat.
   Anchors all of whose segments are found again need nothing more.
4. The other anchors are shards: all their different segments meet, and get a suffix array by induced sorting and its permuted common
   prefixes, which tell the windows that repeat. Before that, segments are cut to the windows that can repeat at all: a window that
   reaches d bytes to the left of the anchor needs some other segment with the same d bytes there, and likewise to the right.
5. An anchor with more different segments than a shard may hold (a boilerplate line with as many contexts as documents) is dealt out
   by content: its windows are cut by their distance from the anchor into pieces of eight, which all hold the same 193 bytes, and
   those bytes are the shard's key instead of the anchor. Pieces whose 193 bytes are found once repeat nowhere; equal pieces are one
   string with a count; the others get suffix arrays as above. Should even 193 bytes have that many surroundings, their pieces are
   dealt out by whole windows, that is, counted by digest.

Places are matched to strings that repeat by joins whose frequent keys (found by count, at most 10,000) are salted.
Rows that are equal in key and text count as places of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytelevel import span_hashes
from ._common import discard, flat_utf8, ranges, ready, released, row_groups, salted_semi_join, stored, table

LENGTH = 200
GRAM = 32
#: Different segments of one anchor that a shard takes, about 300 kB at most; anchors with more are dealt out by more content.
MOST_SEGMENTS = 1024
#: A shard's suffix array is made over about this many bytes.
SHARD_BYTES = 1 << 18
#: Windows of a hot anchor that are looked at together.
PIECE = 8
_CHUNK = 1 << 17


# ---- suffix array by induced sorting
def suffix_array(s: np.ndarray, top: int) -> np.ndarray:
    """The suffix array of s (integers from 1 to top) with an implied smallest end mark, which is left out.

    Suffixes are classified as larger or smaller than the next; leftmost smaller ones are sorted by sorting their
    substrings (recursively, under new names, where names repeat), and induce the order of all others in two linear sweeps over
    the buckets: a bucket at a time in numpy where buckets are few, an element at a time where they are many.
    """
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int64)
    s = np.append(s.astype(np.int64), 0)
    n += 1
    # type of i follows from the next place with another character
    change = np.flatnonzero(s[1:] != s[:-1])
    owner = np.searchsorted(change, np.arange(n - 1))
    small = np.zeros(n, bool)
    small[n - 1] = True
    small[: n - 1] = s[change[owner]] < s[change[owner] + 1]
    lms = np.zeros(n, bool)
    lms[1:] = small[1:] & ~small[:-1]
    places = np.flatnonzero(lms)
    size = np.bincount(s, minlength=top + 1)
    ends = np.cumsum(size)
    heads = ends - size

    def induce(order: np.ndarray) -> np.ndarray:
        sa = np.full(n, -1, np.int64)
        # leftmost smaller suffixes at the ends of their buckets, in the given order
        c = s[order]
        by = np.argsort(c, kind="stable")
        last = np.append(c[by][1:] != c[by][:-1], True)
        run = np.flatnonzero(last)
        count = np.diff(np.append(-1, run))
        back = np.repeat(run, count) - np.arange(len(by))
        sa[ends[c[by]] - 1 - back] = order[by]
        return sweep(sa, s, small, heads, ends)

    sweep = _sweep_each if np.count_nonzero(size) * 100 > n else _sweep
    sa = induce(places)
    if len(places) > 1:
        ranked = sa[lms[sa]]
        names = _names(s, small, places, ranked, n)
        m = int(names.max()) + 1
        reduced = names[places]
        if m < len(places):
            order = places[np.append(len(places) - 1, suffix_array(reduced[:-1], m - 1))]  # the end mark's name is the only 0
        else:
            order = places[np.argsort(reduced, kind="stable")]
        sa = induce(order)
    return sa[1:]


def _names(s: np.ndarray, small: np.ndarray, places: np.ndarray, ranked: np.ndarray, n: int) -> np.ndarray:
    """Names of leftmost-smaller substrings, given in sorted order: equal ones share a name. The end mark has name 0."""
    nxt = np.full(n, n - 1)
    nxt[places[:-1]] = places[1:]
    length = nxt[ranked] - ranked + 1
    differ = np.ones(len(ranked), bool)
    cand = np.flatnonzero(length[1:] == length[:-1]) + 1
    cand = cand[ranked[cand] != n - 1]
    cand = cand[ranked[cand - 1] != n - 1]
    same = np.ones(len(cand), bool)
    k, live = 0, np.arange(len(cand))
    while len(live):
        a, b = ranked[cand[live]] + k, ranked[cand[live] - 1] + k
        bad = (s[a] != s[b]) | (small[a] != small[b])
        same[live[bad]] = False
        k += 1
        live = live[~bad]
        live = live[length[cand[live]] > k]
    differ[cand[same]] = False
    names = np.full(n, -1)
    names[ranked] = np.cumsum(differ) - 1
    return names


def _sweep(sa: np.ndarray, s: np.ndarray, small: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    head, tail = heads.copy(), ends.copy()
    used = np.flatnonzero(ends > heads)

    def put(j: np.ndarray, forward: bool) -> np.ndarray:
        """Enter suffixes j in scanning order into their buckets; returns those of each character, grouped."""
        c = s[j]
        by = np.argsort(c, kind="stable")
        cs = c[by]
        first = np.flatnonzero(np.append(True, cs[1:] != cs[:-1]))
        count = np.diff(np.append(first, len(cs)))
        rank = np.arange(len(cs)) - np.repeat(first, count)
        if forward:
            sa[head[cs] + rank] = j[by]
            head[cs[first]] += count
        else:
            sa[tail[cs] - 1 - rank] = j[by]
            tail[cs[first]] -= count
        return c

    for c in used:
        lo = heads[c]
        while True:  # larger suffixes of this bucket, which grow as runs of c are followed
            hi = head[c]
            if hi == lo:
                break
            j = sa[lo:hi] - 1
            j = j[j >= 0]
            j = j[~small[j]]
            lo = hi
            if len(j):
                put(j, True)
        rest = sa[head[c] : ends[c]]
        j = rest[rest > 0] - 1
        j = j[~small[j]]
        if len(j):
            put(j, True)
    for c in used[::-1]:
        # smaller suffixes are entered anew from the end; what the first sweep left there is replaced
        hi = ends[c]
        while True:
            lo = tail[c]
            if lo == hi:
                break
            j = sa[lo:hi][::-1] - 1
            j = j[j >= 0]
            j = j[small[j]]
            hi = lo
            if len(j):
                put(j, False)
        j = sa[heads[c] : head[c]][::-1] - 1
        j = j[j >= 0]
        j = j[small[j]]
        if len(j):
            put(j, False)
    return sa


def _sweep_each(sa: np.ndarray, s: np.ndarray, small: np.ndarray, heads: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """As _sweep, one element after the other: what is entered behind the place of reading is read later."""
    out, head, tail = sa.tolist(), heads.tolist(), ends.tolist()
    before = np.full(len(s) + 1, -1)  # the character before each place; the last is for empty places
    before[1:-1] = s[:-1]
    larger = np.where(np.append(np.append(True, small[:-1]), True), -1, before).tolist()
    smaller = np.where(np.append(np.append(False, small[:-1]), False), before, -1).tolist()
    for j in out:
        c = larger[j]
        if c >= 0:
            at = head[c]
            out[at] = j - 1
            head[c] = at + 1
    for j in reversed(out):
        c = smaller[j]
        if c >= 0:
            tail[c] = at = tail[c] - 1
            out[at] = j - 1
    return np.array(out, np.int64)


def permuted_prefixes(s: np.ndarray, sa: np.ndarray, most: int, only: np.ndarray | None = None) -> np.ndarray:
    """For each place i, how much the suffix there has in common with the one before it in the suffix array, up to most (and a
    few more); permuted, that is by place and not by rank. only: ascending places to be looked at, others give 0.

    Characters are compared eight bytes at a time. Every eighth place of a run is compared from its beginning; for the next ones
    all but the last characters of what was found there are known to agree.
    """
    n, size = len(s), s.dtype.itemsize
    step = 8 // size
    prev = np.full(n, -1)
    prev[sa[1:]] = sa[:-1]
    words = np.ndarray(n + 1, "<u8", np.append(s, np.zeros(step, s.dtype)), strides=(size,))
    out = np.zeros(n, np.int64)
    places = np.arange(n) if only is None else only
    places = places[prev[places] >= 0]
    run = np.flatnonzero(np.append(True, np.diff(places) > 1)[: len(places)])
    nth = np.arange(len(places)) - np.repeat(run, np.diff(np.append(run, len(places))))
    lead = nth % 8 == 0

    def extend(live: np.ndarray) -> None:
        while len(live):
            k = out[live]
            going = (k < most) & (live + k < n) & (prev[live] + k < n)
            live, k = live[going], k[going]
            x = words[live + k] ^ words[prev[live] + k]
            low = x & (~x + np.uint64(1))
            out[live] += np.where(x == 0, step, (np.bitwise_count(np.maximum(low, np.uint64(1)) - np.uint64(1)) // (8 * size)).astype(np.int64))
            live = live[x == 0]

    extend(places[lead])
    rest = places[~lead]
    from_ = places[np.maximum.accumulate(np.where(lead, np.arange(len(places)), 0))[~lead]]
    out[rest] = np.maximum(0, np.minimum(out[from_], n - np.maximum(from_, prev[from_])) - (rest - from_))
    extend(rest)
    return np.minimum(out, n - np.maximum(np.arange(n), np.maximum(prev, 0)))


def repeated_windows(segments: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each segment, the starts of windows of `length` bytes that also start somewhere else in the segments."""
    if not segments:
        return []
    sizes = np.array([len(x) + 1 for x in segments])
    raw = np.frombuffer(b"".join(x + b"\0" for x in segments), np.uint8)
    s = raw.astype(np.int64) + 2
    stops = np.cumsum(sizes) - 1
    s[stops] = 1  # ends of segments; no window that counts reaches one
    sa = suffix_array(s, 257)
    room = np.repeat(stops, sizes) - np.arange(len(s))
    full = room >= length
    both = sa[1:][full[sa[1:]] & full[sa[:-1]]]  # equal windows follow one another, with none but such between them
    pre = permuted_prefixes(raw, sa, length, np.sort(both))
    hit = np.zeros(len(s), bool)
    same = pre[sa[1:]] >= length
    hit[sa[1:][same]] = hit[sa[:-1][same]] = True
    begin = stops - sizes + 1
    at = np.flatnonzero(hit)
    cut = np.searchsorted(at, np.append(begin, len(s)))
    return [at[cut[i] : cut[i + 1]] - begin[i] for i in range(len(segments))]


def _reach(group: np.ndarray, sides: list[bytes], width: int) -> np.ndarray:
    """How many bytes each string has at least in common with the nearest other one of its group, at most (zeros behind its end
    count as bytes, so it may be told too much, never too little)."""
    k = len(sides)
    flat = np.zeros((k, 4 + width), np.uint8)
    flat[:, :4] = group.astype(">u4").view(np.uint8).reshape(-1, 4)
    flat[:, 4:] = np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in sides), np.uint8).reshape(k, width)
    order = np.argsort(flat.view(f"S{4 + width}")[:, 0], kind="stable")
    flat = flat[order]
    differ = flat[1:] != flat[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), 4 + width) - 4  # below 0: another group
    out = np.zeros(k, np.int64)
    out[order] = np.maximum(np.append(0, common), np.append(common, 0))
    return out


def trimmed(group: np.ndarray, rel: np.ndarray, segments: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(first, end) of the windows of each segment that can repeat within its group, by what stands left and right of the anchor at rel."""
    far = _reach(group, [x[:r][::-1] for x, r in zip(segments, rel.tolist(), strict=True)], length)
    near = _reach(group, [x[r:] for x, r in zip(segments, rel.tolist(), strict=True)], length)
    windows = np.array([len(x) for x in segments]) - length + 1
    first = np.maximum(0, rel - far)  # a window that begins at w reaches rel - w bytes to the left
    end = np.minimum(windows, rel + near - length + 1)
    return first, np.maximum(end, first)


# ---- anchors
def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, first window in the text, number of windows, hash of the gram at the anchor, place of the anchor in the segment) for runs
    of windows. Within a chunk, hashes that share their leading 44 bits are told apart by place alone."""
    n = len(data)
    out: list[list[np.ndarray]] = [[], [], [], [], []]
    width = length - gram + 1
    sizes = np.diff(offsets)
    row = np.repeat(np.arange(len(sizes)), sizes)
    for c0 in range(0, max(0, n - length + 1), _CHUNK):
        c1 = min(n - length + 1, c0 + _CHUNK)  # windows from c0 to c1
        part = data[c0 : c1 + length - 1]
        g = span_hashes(part, np.arange(len(part) - gram + 1), np.arange(gram, len(part) + 1))
        m = g & np.uint64(0xFFFFFFFFFFF00000) | np.arange(len(g), dtype=np.uint64)  # order by hash, then by place
        done = 1
        while done < width:  # minima of 1, 2, 4, ... neighbours
            step = min(done, width - done)
            m = np.minimum(m[:-step], m[step:])
            done += step
        at = (m & np.uint64(0xFFFFF)).astype(np.int64)  # anchor of each window
        first = np.arange(c0, c1)
        ok = row[c0:c1] == row[first + length - 1]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[c0 + 1 : c1] != row[c0 : c1 - 1])
        new &= ok
        new[1:] |= ok[1:] & ~ok[:-1]
        s = np.flatnonzero(new)
        if not len(s):
            continue
        # a run ends where the next begins or the windows of the text end
        stop = np.append(s[1:], len(at))
        last = np.minimum(stop, offsets[row[c0 + s] + 1] - length + 1 - c0)
        k = last - s
        for o, v in zip(out, (row[c0 + s], c0 + s - offsets[row[c0 + s]], k, g[at[s]], at[s] - s), strict=True):
            o.append(v)
    return tuple(np.concatenate(o) if o else np.zeros(0, np.int64) for o in out)


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: np.ndarray) -> pa.Array:
    """128 bits for each stretch and small number that goes with it: equal digests stand for equal strings."""
    raw = data.tobytes()
    return pa.array([blake2b(raw[s:e], digest_size=16, salt=x.to_bytes(4, "little")).digest() for s, e, x in zip(starts.tolist(), ends.tolist(), salt.tolist(), strict=True)], pa.binary())


def _occurrences(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(ahash, shash, kd, kt, start, windows, rel) of every segment; keyed has kd, kt and text."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            kd, kt = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            data, offsets = flat_utf8(batch.column(2))
            for a, b in row_groups(offsets, 1 << 20):
                part, offs = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
                row, start, k, ah, rel = _anchors(part, offs, length, gram)
                for lo in range(0, len(row), 1 << 16):  # of very long texts
                    some = slice(lo, lo + (1 << 16))
                    at = offs[row[some]] + start[some]
                    sh = _digests(part, at, at + k[some] + length - 1, rel[some])
                    yield pa.RecordBatch.from_arrays([pa.array(ah[some].astype(np.uint64).view(np.int64)), sh, pa.array(kd[a:b][row[some]]), pa.array(kt[a:b][row[some]]), pa.array(start[some].astype(np.int64)), pa.array(k[some].astype(np.int32)), pa.array(rel[some].astype(np.int32))], ["ahash", "shash", "kd", "kt", "start", "windows", "rel"])

    return keyed.select("kd", "kt", "text").mapInArrow(released(run), "ahash bigint, shash binary, kd bigint, kt bigint, start bigint, windows int, rel int")


def _anchor_counts(keyed: DataFrame, length: int, gram: int) -> DataFrame:
    """(ahash, n): anchors with the number of their occurrences, summed within batches first."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offsets = flat_utf8(batch.column(0))
            for a, b in row_groups(offsets, 1 << 20):
                ah = _anchors(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], length, gram)[3]
                v, n = np.unique(ah, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(v.astype(np.uint64).view(np.int64)), pa.array(n)], ["ahash", "n"])

    return keyed.select("text").mapInArrow(released(run), "ahash bigint, n bigint").groupBy("ahash").agg(F.sum("n").alias("n"))


# ---- putting it together
def repeated_ranges(keyed: DataFrame, length: int = LENGTH, gram: int = GRAM, most_segments: int = MOST_SEGMENTS, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(kd, kt, start, end): ranges of bytes to remove, stored. keyed: kd (bigint), kt (bigint) name a text, text; kd and kt not null."""
    made: list[DataFrame] = []

    def held(df: DataFrame, name: str) -> DataFrame:
        made.append(stored(df, name))
        return made[-1]

    place = ["kd", "kt", "start"]
    span = F.struct("kd", "kt", "start", "windows", "rel")
    to = lambda df: df.select("kd", "kt", "start", (F.col("start") + F.col("windows") + length - 1).alias("end"))
    again = held(_anchor_counts(keyed, length, gram).filter("n > 1"), "anchors-found-again")
    found = held(salted_semi_join(_occurrences(keyed, length, gram), again, ["ahash"], place), "repeated-anchors")
    classes = held(found.groupBy("ahash", "shash").agg(F.count("*").alias("n"), F.min(span).alias("at")), "segment-classes")
    whole = to(salted_semi_join(found, classes.filter("n > 1").select("ahash", "shash", "n"), ["ahash", "shash"], place))
    several = classes.groupBy("ahash").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("kinds > 1 and least = 1").select("ahash", "kinds")
    open_ = held(classes.join(several, "ahash").select("ahash", (F.col("n") == 1).alias("one"), F.col("kinds"), "at.kd", "at.kt", "at.start", "at.windows", "at.rel"), "open-segments")
    texts = keyed.select("kd", "kt", "text")

    def with_bytes(some: DataFrame) -> DataFrame:
        """The bytes of each segment, cut out of its text."""
        wanted = some.groupBy("kd", "kt").agg(F.collect_list(F.struct("ahash", "one", "start", "windows", "rel")).alias("want"))
        unique = texts.join(wanted, ["kd", "kt"]).select("kd", "kt", "text", "want")

        def cut(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in it:
                kd, kt, want = (batch.column(i).to_pylist() for i in (0, 1, 3))
                data, offs = flat_utf8(batch.column(2))
                raw = data.tobytes()
                rows = [(w["ahash"], w["one"], d, t, w["start"], w["rel"], raw[o + w["start"] : o + w["start"] + w["windows"] + length - 1]) for d, t, o, ws in zip(kd, kt, offs[:-1].tolist(), want, strict=True) for w in ws]
                for lo in range(0, max(1, len(rows)), 1 << 14):
                    cols = list(zip(*rows[lo : lo + (1 << 14)], strict=True)) or [()] * 7
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["g", "one", "kd", "kt", "start", "rel", "seg"])

        # a text that is there twice under one key gives its segments twice: one copy is enough
        return unique.mapInArrow(released(cut), "g bigint, one boolean, kd bigint, kt bigint, start bigint, rel int, seg binary")

    def shards(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups, one after the other, in suffix arrays of about shard_bytes."""
        held: list[tuple] = []
        size, last, groups = 0, None, 0

        def flush() -> pa.RecordBatch:
            group, one, kd, kt, start, rel, seg = zip(*held, strict=True)
            first, end = trimmed(np.array(group), np.array(rel, np.int64), list(seg), length)
            live = np.flatnonzero(end > first).tolist()
            hits = repeated_windows([seg[i][first[i] : end[i] + length - 1] for i in live], length)
            cols: list[list[int]] = [[], [], [], []]
            for i, wins in zip(live, hits, strict=True):
                if one[i] and len(wins):
                    gap = np.flatnonzero(np.diff(wins) > 1)
                    at = start[i] + int(first[i])
                    for lo, hi in zip(wins[np.append(0, gap + 1)].tolist(), wins[np.append(gap, len(wins) - 1)].tolist(), strict=True):
                        for c, v in zip(cols, (kd[i], kt[i], at + lo, at + hi + length), strict=True):
                            c.append(v)
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["kd", "kt", "start", "end"])

        for batch in it:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != last:
                    if size >= shard_bytes:
                        yield flush()
                        held, size = [], 0
                    last, groups = row[0], groups + 1
                if held and held[-1][0] == groups and held[-1][2:6] == row[2:6]:
                    continue  # the same place of a text that is there twice
                held.append((groups, *row[1:]))
                size += len(row[6])
        if held:
            yield flush()

    def pieces(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(6))
            n = np.diff(offs) - length + 1
            rel = np.asarray(batch.column(5)).astype(np.int64)
            low = (rel - n + 1) // PIECE
            count = rel // PIECE - low + 1
            r = np.repeat(np.arange(batch.num_rows), count)
            j = ranges(low, count)
            far, close = np.minimum(rel[r], PIECE * j + PIECE - 1), np.maximum(rel[r] - n[r] + 1, PIECE * j)
            first = offs[:-1][r] + rel[r] - far
            k = far - close + 1
            core = offs[:-1][r] + rel[r] - PIECE * j
            by = span_hashes(data, core, core + length - PIECE + 1) ^ (j.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9FB21C651E98DF25)
            raw = data.tobytes()
            seg = [raw[x:y] for x, y in zip(first.tolist(), (first + k + length - 1).tolist(), strict=True)]
            col = [np.asarray(batch.column(i)) for i in range(5)]
            yield pa.RecordBatch.from_arrays([pa.array(by.view(np.int64)), _digests(data, first, first + k + length - 1, far), *(pa.array(c[r]) for c in col[1:4]), pa.array(col[4][r] + first - offs[:-1][r]), pa.array(k.astype(np.int32)), pa.array(far.astype(np.int32)), pa.array(seg, pa.binary())], ["g", "piece", "one", "kd", "kt", "start", "windows", "rel", "seg"])

    def windows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(6))
            n = np.diff(offs) - length + 1
            first = ranges(offs[:-1], n)
            r = np.repeat(np.arange(batch.num_rows), n)
            col = [np.asarray(batch.column(i)) for i in range(5)]
            yield pa.RecordBatch.from_arrays([_digests(data, first, first + length, np.zeros(len(first), np.int64)), *(pa.array(c[r]) for c in col[1:4]), pa.array(col[4][r] + first - offs[:-1][r])], ["window", "one", "kd", "kt", "start"])

    rows = ["g", "one", "kd", "kt", "start", "rel", "seg"]
    few = with_bytes(open_.filter(F.col("kinds") <= most_segments))
    parts = held(with_bytes(open_.filter(F.col("kinds") > most_segments)).dropDuplicates(["g", *place]).mapInArrow(released(pieces), "g bigint, piece binary, one boolean, kd bigint, kt bigint, start bigint, windows int, rel int, seg binary"), "hot-pieces")
    first = F.min(F.struct("kd", "kt", "start", "rel", "seg"))
    sorts = held(parts.groupBy("g", "piece").agg(F.count("*").alias("n"), F.min("one").alias("one"), first.alias("at")), "hot-sorts")
    equal = to(salted_semi_join(parts.filter("one").drop("seg"), sorts.filter("n > 1").select("g", "piece", "n"), ["g", "piece"], place))
    kinds = sorts.groupBy("g").agg(F.count("*").alias("kinds")).filter("kinds > 1")
    some = sorts.join(kinds, "g").select("g", (F.col("one") & (F.col("n") == 1)).alias("one"), "at.kd", "at.kt", "at.start", "at.rel", "at.seg", "kinds")
    every = few.select(*rows).union(some.filter(F.col("kinds") <= most_segments).select(*rows))
    near = every.repartition("g").sortWithinPartitions("g", *place).mapInArrow(released(shards), "kd bigint, kt bigint, start bigint, end bigint")
    many = held(some.filter(F.col("kinds") > most_segments).select(*rows).mapInArrow(released(windows), "window binary, one boolean, kd bigint, kt bigint, start bigint"), "hot-windows")
    twice = many.groupBy("window").agg(F.count("*").alias("n")).filter("n > 1")
    last = salted_semi_join(many.filter("one"), twice, ["window"], place).select("kd", "kt", "start", (F.col("start") + length).alias("end"))
    out = stored(whole.union(equal).union(near).union(last), "repeated-ranges")
    for df in made:
        discard(df)
    return out


def remove_repeats(df: DataFrame, key: str, text: str = "text", length: int = LENGTH, name: str = "kept", as_text: bool = False, **how) -> DataFrame:
    """Adds n_bytes, n_removed, n_spans and `name`, the bytes that stay, to df, whose other columns stay as they are.

    as_text: the bytes that stay as a string, without the parts of characters that a cut has left.

    A null text counts as empty, and texts shorter than `length` bytes keep all. Repeated rows are places of their own, so texts
    found twice lose every byte that a window covers. Very long texts are looked at whole, in chunks that overlap by a window. An empty
    table gives no rows. Columns with these names are replaced.
    """
    ready(df.sparkSession)
    df = df.drop("n_bytes", "n_removed", "n_spans", name)
    keys = {"_kd": F.xxhash64(F.lit(1), key), "_kt": F.xxhash64(text)}  # two hashes name a text of a row
    rows = df.withColumns(keys)
    keyed = rows.select(F.col("_kd").alias("kd"), F.col("_kt").alias("kt"), F.coalesce(text, F.lit("")).alias("text")).filter(F.octet_length("text") >= length)
    spans = repeated_ranges(keyed, length, **how)
    gone = spans.groupBy(F.col("kd").alias("_kd"), F.col("kt").alias("_kt")).agg(F.collect_list(F.struct("start", "end")).alias("_spans"))
    joined = rows.join(gone, ["_kd", "_kt"], "left").drop("_kd", "_kt")
    schema = joined.drop("_spans").select("*", *[F.lit(None).cast("bigint").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lit(None).cast("string" if as_text else "binary").alias(name)).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            col = batch.schema.get_field_index
            data, offs = flat_utf8(batch.column(col(text)))
            raw = data.tobytes()
            out: list[tuple] = []
            for i, found in enumerate(batch.column(col("_spans"))):
                s, e = int(offs[i]), int(offs[i + 1])
                if not found.is_valid:
                    out.append((e - s, 0, 0, raw[s:e]))
                    continue
                pairs = found.values.flatten()
                a, b = np.asarray(pairs[0]), np.asarray(pairs[1])
                by = np.argsort(a, kind="stable")
                a, b = a[by], np.maximum.accumulate(b[by])
                new = np.append(True, a[1:] > b[:-1])
                lo = a[new]
                hi = b[np.append(np.flatnonzero(new)[1:] - 1, len(b) - 1)]
                kept = b"".join(raw[s + x : s + y] for x, y in zip([0, *hi.tolist()], [*lo.tolist(), e - s], strict=True))
                out.append((e - s, int((hi - lo).sum()), len(lo), kept))
            cols = list(zip(*out, strict=True)) or [()] * 4
            keep = [i for i, x in enumerate(batch.schema.names) if x != "_spans"]
            if as_text:
                cols[3] = [x.decode("utf-8", "ignore") for x in cols[3]]
            made = [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string() if as_text else pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *made], [*(batch.schema.names[i] for i in keep), "n_bytes", "n_removed", "n_spans", name])

    return joined.mapInArrow(released(run), schema)


def op3_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without strings of 200 bytes that start anywhere else too."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = remove_repeats(docs, "doc_id")
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

