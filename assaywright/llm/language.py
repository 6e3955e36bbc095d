"""Language identification by multinomial naive Bayes over hashed character n-grams: op1.

Texts are lower-cased; every run of ASCII characters that are no letters counts as one space. The counts of n-grams by label are
summed on the cluster over a bounded sample of labelled texts; the matrix of log probabilities (32,768 buckets, 128 kB a label) is
broadcast, and a batch of texts is scored at once: each text is a sparse row of buckets, whose matrix rows are gathered and
summed. Log probabilities are integers (millionths of a bit, about), so sums don't hang on the order in which parts of a text or of a
batch are taken, and equal texts have equal scores. Long texts are read in parts, whole in the end.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import flat_utf8, ready, released, row_groups, table

UNKNOWN = "und"
BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: The classifier is fitted on about this many labelled rows of each label, chosen by a hash of the row's key.
SAMPLE_ROWS = 2000
#: Bytes of text that are turned into n-grams at once, and entries of the matrix that are gathered at once.
PART, GATHER = 1 << 19, 1 << 21
UNIT = 1 << 20
_LETTER = regex.compile(r"\p{L}")


@dataclass(frozen=True)
class Model:
    labels: tuple[str, ...]
    weights: np.ndarray  # (BUCKETS + 1, labels), integers in units; the last row, of what is no n-gram, is zero
    prior: np.ndarray  # in units


def _ngrams(column: pa.Array, part_bytes: int = PART) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, offsets of the rows' n-grams, buckets, whether each row has a letter) for runs of rows. A row of over
    `part_bytes` comes in several parts, each alone; their n-grams add up to those of the row."""
    data, offsets = flat_utf8(pc.utf8_lower(column.cast(pa.large_string())))
    if not len(data):
        return
    blank = (data < 0x80) & ((data < 0x61) | (data > 0x7A))
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[offsets[:-1][offsets[:-1] < len(data)]] = True
    data = np.where(blank, np.uint8(0x20), data)[keep]
    offsets = np.concatenate([[0], np.cumsum(keep)])[offsets]
    del blank, keep
    for a, b in row_groups(offsets, part_bytes):
        end = int(offsets[b])
        cuts = [*range(int(offsets[a]), end, part_bytes), end] if b - a == 1 else [int(offsets[a]), end]
        cuts = [next(i for i in range(c, end + 1) if i == end or data[i] & 0xC0 != 0x80) for c in cuts]
        for s, e in zip(cuts, cuts[1:], strict=False):
            if s == e:
                continue
            more = [i for i in range(e, min(end, e + 4 * max(ORDERS))) if data[i] & 0xC0 != 0x80]  # characters behind the part
            stop = more[max(ORDERS) - 1] if len(more) >= max(ORDERS) else min(end, e + 4 * max(ORDERS))
            yield (a, b, *_buckets(data[s:stop], np.clip(offsets[a : b + 1] - s, 0, e - s) if b - a > 1 else np.array([0, e - s]), e - s))


def _buckets(part: np.ndarray, offs: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets in characters, buckets of the n-grams that begin in the first `size` bytes, whether rows have a letter)."""
    n = len(offs) - 1
    chars = np.frombuffer(part.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    lead = np.concatenate([[0], np.cumsum((part & 0xC0) != 0x80)])
    at = lead[offs]
    row = np.repeat(np.arange(n), np.diff(at))
    m0 = int(lead[size])
    row = np.concatenate([row, np.full(len(chars) - m0, n - 1 if n == 1 else n)])
    has = np.bincount(row[:m0][(chars[:m0] >= 0x61) & (chars[:m0] <= 0x7A)], minlength=n)[:n] > 0
    for i in np.flatnonzero(~has & (np.diff(offs) > 0)):
        has[i] = bool(_LETTER.search(part[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")))
    c = chars.astype(np.uint64)
    buckets = np.full((len(ORDERS), m0), BUCKETS, np.int32)
    h = np.zeros(len(c), np.uint64)
    for k in range(max(ORDERS)):
        if len(c) <= k:
            break
        h = h[: len(c) - k] * np.uint64(0x9E3779B97F4A7C15) + c[k:] + np.uint64(1)
        if k + 1 in ORDERS:
            m = min(m0, len(h))
            got = ((h[:m] * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(49)).astype(np.int32)
            buckets[ORDERS.index(k + 1), :m] = np.where(row[:m] == row[k : k + m], got, BUCKETS)
    return at, buckets, has


def fit(df: DataFrame, text: str, label: str, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Fit on rows whose text and label are not null: about `sample_rows` different texts of each label, chosen by a hash of the text
    alone; copies of a text count once. Tables with no such row give a model without labels, which answers `und`. The model takes
    128 kB for each label, of which there may be any number.
    """
    spark = df.sparkSession
    rows = df.select(F.col(text).alias("t"), F.col(label).cast("string").alias("y"), F.xxhash64(text).alias("h")).filter("t is not null and y is not null")
    sizes = {r["y"]: (r["n"], max(1, r["texts"])) for r in rows.groupBy("y").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("texts")).collect()}  # a row for each label
    labels = tuple(sorted(sizes))
    if not labels:
        return Model((), np.zeros((BUCKETS + 1, 0), np.int32), np.zeros(0, np.int64))
    share = spark.createDataFrame([(y, min(1.0, sample_rows / sizes[y][1])) for y in labels], "y string, share double")
    chosen = rows.join(F.broadcast(share), "y").filter(F.pmod("h", F.lit(1 << 30)) < F.col("share") * float(1 << 30))
    sample = chosen.groupBy("y", "h").agg(F.min("t").alias("t")).select("t", "y")
    index = {y: i for i, y in enumerate(labels)}

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            keys = []
            y = np.array([index[v] for v in batch.column(1).to_pylist()], np.int64)
            for a, b, offs, buckets, _ in _ngrams(batch.column(0)):
                base = np.repeat(y[a:b], np.diff(offs)) * (BUCKETS + 1)
                got = np.unique(np.concatenate([(base + one)[one < BUCKETS] for one in buckets]), return_counts=True)
                keys.append(got)
            if keys:
                at, back = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
                n = np.bincount(back, np.concatenate([c for _, c in keys]), minlength=len(at)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    ready(spark)
    got = sample.mapInArrow(released(count), "at bigint, n bigint").groupBy("at").agg(F.sum("n").alias("n")).toPandas()  # at most labels x buckets
    counts = np.zeros((len(labels), BUCKETS + 1))
    counts.reshape(-1)[got["at"].to_numpy(np.int64)] = got["n"].to_numpy(float)
    counts = counts[:, :BUCKETS] + 0.1
    logs = np.log(counts) - np.log(counts.sum(axis=1, keepdims=True))
    n = np.array([sizes[y][0] for y in labels], float)
    weights = np.zeros((BUCKETS + 1, len(labels)), np.int32)
    weights[:BUCKETS] = np.rint(logs.T * UNIT)
    return Model(labels, weights, np.rint(np.log(n / n.sum()) * UNIT).astype(np.int64))


def predict(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred and score (posterior probability of lang_pred). Only the text is an input.

    A null or empty text, or one without a letter, gives `und` with score 0.0, and so does every text if the model has no labels. Of
    equally likely labels the first in alphabetical order is taken. Texts of any length are read whole. Repeated rows get equal
    results; an empty table gives no rows. Columns of these names that df has already are replaced.
    """
    spark = df.sparkSession
    ready(spark)
    shared = spark.sparkContext.broadcast(model)  # 128 kB a label
    df = df.drop("lang_pred", "score")
    schema = df.select("*", F.lit(None).cast("string").alias("lang_pred"), F.lit(None).cast("double").alias("score")).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        names = np.array([*m.labels, UNKNOWN], object)
        step = max(64, GATHER // max(1, len(m.labels)))
        for batch in it:
            rows = batch.num_rows
            best, score = np.full(rows, len(m.labels)), np.zeros(rows)
            total, has = np.tile(m.prior, (rows, 1)), np.zeros(rows, bool)
            for a, b, offs, buckets, letters in _ngrams(batch.column(batch.schema.get_field_index(text))):
                has[a:b] |= letters
                owner = np.repeat(np.arange(a, b), np.diff(offs))
                for one in buckets if m.labels else ():
                    for lo in range(0, len(one), step):
                        who = owner[lo : lo + step]
                        first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
                        total[who[first]] += np.add.reduceat(m.weights[one[lo : lo + step]], first, axis=0, dtype=np.int64)
            if m.labels and has.any():
                p = np.exp((total - total.max(axis=1, keepdims=True)) / UNIT)
                p /= p.sum(axis=1, keepdims=True)
                best = np.where(has, total.argmax(axis=1), len(m.labels))
                score = np.where(has, p.max(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[best], pa.string()), pa.array(score)], [*batch.schema.names, "lang_pred", "score"])

    return df.mapInArrow(released(run), schema)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a model of those whose remainder is not 1. A null doc_id has no
    remainder: such a row is predicted, but not learned from."""
    docs = table(spark, sf_dir, "documents")
    part = F.crc32(F.col("doc_id").cast("string")) % 3
    model = fit(docs.filter(part != 1), "text", "lang")
    rows = docs.select("doc_id", "text", F.coalesce(part == 1, F.lit(False)).alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", "score")
