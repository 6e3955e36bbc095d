"""Periodic runs of words by heavy/light lag counting: op12.

A run repeats with a period q: words q apart are the same. For every lag the number of places where words that far apart agree is counted
first: for frequent words ("heavy") by exact autocorrelation, one Fourier transform of each word's places and one back for all of them; for
the rest ("light") by the differences of all pairs of a word's places. A run of period q has max(2q, 24 - q) such places in succession, so only
lags with as many matches at all get a scan. The scan looks for islands, stretches of matches: a long enough island holds a whole block
[kq, kq + q) of matches, which is two equal neighbouring blocks of words. Blocks are compared by hash, islands are widened from their
blocks, and every run is compared word by word before it counts; a lag where that fails is scanned place by place.
Lags are taken in ascending order and a stretch counts once, by its smallest period; its matches are taken off the counts of the multiples.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flat_utf8, ready, released, table

#: Fixed values of the definition: words of a run at least, and periods of a run at least.
LEAST, TIMES = 24, 3


def _needed(lags: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Matches in succession that a run of each period has."""
    return np.maximum((times - 1) * lags, least - lags)


def heavy_from(n: int) -> float:
    """Places from which a word is heavy: where the pairs of its places take more time than a transform of the text."""
    return max(16.0, (0.6 * n * np.log2(n + 2)) ** 0.5)


def lag_counts(ids: np.ndarray, most: int) -> np.ndarray:
    """counts[q], for q up to `most`: how many places i have ids[i] == ids[i + q]. ids: from 0 without gaps."""
    n = len(ids)
    out = np.zeros(most + 1, np.int64)
    size = np.bincount(ids)
    heavy = np.flatnonzero(size >= heavy_from(n))
    if len(heavy):  # exact: rounding errors of a text of n words are of the order of n * 1e-14
        length = 1 << int(n + most).bit_length()
        power = np.zeros(length // 2 + 1)
        for w in heavy.tolist():
            f = np.fft.rfft((ids == w).astype(np.float64), length)
            power += f.real**2 + f.imag**2
        out += np.rint(np.fft.irfft(power, length)[: most + 1]).astype(np.int64)
    light = np.ones(len(size), bool)
    light[heavy] = False
    places = np.argsort(ids, kind="stable")
    places = places[light[ids[places]]]
    word, step = ids[places], 1
    keep = np.arange(len(places))
    while True:  # the step-th next place of the same word; places go when their word has no further one, or only too far ones
        keep = keep[keep + step < len(places)]
        keep = keep[word[keep] == word[keep + step]]
        gap = places[keep + step] - places[keep]
        near = gap <= most
        keep, gap = keep[near], gap[near]
        if not len(keep):
            break
        out += np.bincount(gap, minlength=most + 1)
        step += 1
    out[0] = 0
    return out


class _Hashes:
    """Hashes of stretches of words, from prefix sums modulo 2**64 of odd multiples: equal stretches have equal hashes, and stretches with
    equal hashes are compared before anything is made of them."""

    def __init__(self, ids: np.ndarray):
        n = len(ids)
        base, back = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
        power = np.full(n + 1, base, np.uint64)
        inverse = np.full(n + 1, back, np.uint64)
        power[0] = inverse[0] = 1
        power, self.inverse = np.multiply.accumulate(power), np.multiply.accumulate(inverse)
        x = ids.astype(np.uint64) + np.uint64(1)
        x = (x ^ x >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(x * power[:n], out=self.sums[1:])

    def __call__(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return (self.sums[stop] - self.sums[start]) * self.inverse[start]


def _widened(hashes: _Hashes, n: int, q: int, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The islands [a, b) of lag q that hold the blocks from `first` to `last` (their numbers): widened by halving steps."""
    a, b = first * q, (last + 1) * q
    step = 1 << max(0, int(q).bit_length() - 1)  # an island's ends lie less than a block beyond its whole blocks
    while step:
        to = np.maximum(a - step, 0)
        more = (to < a) & (hashes(to, a) == hashes(to + q, a + q))
        a = np.where(more, to, a)
        to = np.minimum(b + step, n - q)
        more = (to > b) & (hashes(b, to) == hashes(b + q, to + q))
        b = np.where(more, to, b)
        step >>= 1
    return a, b


def islands(ids: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
    """All stretches [a, b) of places with ids[i] == ids[i + q], place by place."""
    same = np.zeros(len(ids) - q + 2, np.int8)
    same[1:-1] = ids[:-q] == ids[q:]
    edge = np.flatnonzero(np.diff(same))
    return edge[::2], edge[1::2]


def find_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period. ids: a number for each word, from 0 without gaps."""
    n = len(ids)
    if n < least or n < times:
        return []
    counts = lag_counts(ids, n // times)
    lags = np.arange(1, len(counts))
    lags = lags[counts[1:] >= _needed(lags, least, times)]
    if not len(lags):
        return []
    hashes = _Hashes(ids) if lags[-1] >= 8 else None
    found: dict[tuple[int, int], int] = {}

    def true(a: int, b: int, q: int) -> bool:
        return bool((ids[a:b] == ids[a + q : b + q]).all()) and (a == 0 or ids[a - 1] != ids[a - 1 + q]) and (b + q == n or ids[b] != ids[b + q])

    for q in lags.tolist():
        need = max((times - 1) * q, least - q)
        if counts[q] < need:  # runs of its divisors have its matches
            continue
        if q < 8 or times < 3:
            a, b = islands(ids, q)
        else:
            at = np.arange(0, n - 2 * q + 1, q)
            equal = np.flatnonzero(hashes(at, at + q) == hashes(at + q, at + 2 * q))
            if not len(equal):
                continue
            new = np.append(True, np.diff(equal) > 1)
            a, b = _widened(hashes, n, q, equal[new], equal[np.append(new[1:], True)])
        long = b - a >= need
        fresh = [(s, e) for s, e in zip(a[long].tolist(), b[long].tolist(), strict=True) if (s, e + q) not in found]
        if q >= 8 and not all(true(s, e, q) for s, e in fresh):
            a, b = islands(ids, q)
            long = b - a >= need
            fresh = list(zip(a[long].tolist(), b[long].tolist(), strict=True))
        for s, e in fresh:
            if (s, e + q) in found:
                continue
            found[s, e + q] = q
            # a run's places of matches at a multiple of its period are an island that ends where the run does: no other run is in it
            counts[2 * q : e + q - s : q] -= e + q - s - np.arange(2 * q, min(len(counts), e + q - s), q)
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run with the greatest length / period, exactly; ties: smallest start, then period."""
    best = None
    for r in runs:
        if best is None or (d := r[1] * best[2] - best[1] * r[2]) > 0 or d == 0 and (r[0], r[2]) < (best[0], best[2]):
            best = r
    return best


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words stay: a word goes if some run contains it after that run's first period."""
    mark = np.zeros(n + 1, np.int64)
    for s, size, q in runs:
        mark[s + q] += 1
        mark[s + size] -= 1
    return np.cumsum(mark)[:n] == 0


def planted(key: bytes | None, n: int) -> np.ndarray | None:
    """Which original word stands at each place of a text that the query makes periodic: those of a tenth of all keys; None: all as they are.
    A null key changes nothing."""
    if key is None or not n:
        return None
    h = zlib.crc32(key)
    if h % 10:
        return None
    g = h // 10
    a = g % n
    at = np.arange(n)
    at[a:] = a + (at[a:] - a) % (1 + (n - a) // (3 + g % 8))
    return at


def periodic_runs(df: DataFrame, text: str = "text", least: int = LEAST, times: int = TIMES, rewrite: str | None = None, texts: bool = True) -> DataFrame:
    """Adds to df: n_words, n_runs, runs (an array of start, length and period, by start, then period), the start, length and period of the
    strongest run, and collapsed, the words that stay joined by one space; without `texts` two digests stand for runs and collapsed.

    Words are runs of other bytes than white space (0x20, 0x09-0x0D) and are compared as they are. A text that is null, empty or shorter than
    `least` words has no runs; its strongest run is null. Texts of any length are taken whole, in memory in proportion to their length;
    repeated rows each have their runs; an empty table gives no rows. Columns of these names that df has already are replaced. rewrite: a column
    with a key; words are first put in the order that planted() gives.
    """
    ready(df.sparkSession)
    fields = {"n_words": "bigint", "n_runs": "bigint", "start": "bigint", "length": "bigint", "period": "bigint"}
    fields |= {"runs": "array<struct<start:bigint,length:bigint,period:bigint>>", "collapsed": "string"} if texts else {"runs_sha256": "string", "collapsed_sha256": "string"}
    df = df.drop(*fields)
    schema = df.select("*", *[F.lit(None).cast(t).alias(c) for c, t in fields.items()]).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            data, offs = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            raw = data.tobytes()
            keys = [None] * batch.num_rows if rewrite is None else [None if k is None else str(k).encode() for k in batch.column(batch.schema.get_field_index(rewrite)).to_pylist()]
            cols: list[list] = [[] for _ in fields]
            for k, s, e in zip(keys, offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                words = raw[s:e].split()
                at = planted(k, len(words))
                if at is not None:
                    words = [words[i] for i in at.tolist()]
                numbers: dict[bytes, int] = {}
                ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
                runs = find_runs(ids, least, times)
                best = strongest(runs) or (None, None, None)
                kept = words
                if runs:
                    stay = collapsed(len(words), runs)
                    kept = [words[i] for i in np.flatnonzero(stay).tolist()]
                left = b" ".join(kept)
                if texts:
                    last = ([dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], left.decode())
                else:
                    last = (hashlib.sha256("".join(f"{a},{b},{q}\n" for a, b, q in runs).encode()).hexdigest(), hashlib.sha256(left).hexdigest())
                for c, v in zip(cols, (len(words), len(runs), *best, *last), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 5 + ([pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), pa.string()] if texts else [pa.string(), pa.string()])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], [*batch.schema.names, *fields])

    return df.mapInArrow(released(run), schema)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, of which a tenth is made periodic first, as the definition of the query says."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = periodic_runs(docs, rewrite="doc_id", texts=False)
    milli = F.expr("1000 * length div period")
    return got.select("doc_id", "n_runs", "start", "length", "period", milli.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
