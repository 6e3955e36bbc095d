"""Token counts, encoding with decoding, and what both share: op6 and op9.

Counts use a whole-token shortcut: every vocabulary string is put through the merges once, on the driver; those that come out
as one token stand in the workers' table for good, so that pre-tokens equal to them count one without merging.
Encoding splits pre-tokens further at forced boundaries: pairs of neighbouring bytes that occur inside no vocabulary string.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._bytelevel import ByteLevelBPE, batches, class_table, codec
from ._common import flat_utf8, ready, released, table

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.lru_cache(maxsize=4)
def _spec(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@functools.lru_cache(maxsize=4)
def whole_tokens(path: str) -> tuple[bytes, ...]:
    """The vocabulary strings that the splitter keeps in one piece and the merges bring to one token: their own."""
    m = ByteLevelBPE(_spec(path), class_table(path), cuts=False)
    words = [m.bytes_of[i] for i in m.vocab_ids]
    data = np.frombuffer(b"".join(words), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(w) for w in words])])
    ids, lens = m.merge(data, offs[:-1], offs[1:])
    first = np.cumsum(lens) - lens
    alone = (lens == 1) & (ids[first] == m.vocab_ids)
    return tuple(w for w, ok in zip(words, alone, strict=True) if ok)


def codec_parts(spark: SparkSession, path: str):
    """The tokenizer file and the class table as broadcasts: about 1.6 and 1.1 MB, fixed by the vocabulary."""
    return spark.sparkContext.broadcast(_spec(path)), spark.sparkContext.broadcast(class_table(path))


def encoded_rows(batch: pa.RecordBatch, column: str, m: ByteLevelBPE) -> Iterator[tuple[int, np.ndarray]]:
    """(row, ids) for every row of the batch in order; a null text has no ids."""
    data, offsets = flat_utf8(batch.column(batch.schema.get_field_index(column)))
    held: list[np.ndarray] = []
    for part, offs, a, b in batches(data, offsets):
        ids, cut = m.encode(part, offs)
        if b - a == 1:  # perhaps one part of a long text
            if held and held_row != a:
                yield held_row, np.concatenate(held)
                held = []
            held_row = a
            held.append(ids)
            continue
        if held:
            yield held_row, np.concatenate(held)
            held = []
        for i in range(b - a):
            yield a + i, ids[cut[i] : cut[i + 1]]
    if held:
        yield held_row, np.concatenate(held)


def count_tokens(df: DataFrame, text: str = "text", limit: int = 512, path: str | None = None) -> DataFrame:
    """Adds n_bytes, n_tokens and over_limit to df.

    A null text counts as empty: 0 bytes and tokens. Columns of these names that df has already are replaced. Texts of any
    length are counted whole, repeated rows each; an empty table gives no rows. Special strings inside texts count as one token, as by the library's default.
    """
    spark = df.sparkSession
    path = path or vocabulary_path()
    ready(spark)
    spec, classes = codec_parts(spark, path)
    whole = spark.sparkContext.broadcast(whole_tokens(path))  # at most the vocabulary
    df = df.drop("n_bytes", "n_tokens", "over_limit")
    schema = df.select("*", F.lit(0).cast("bigint").alias("n_bytes"), F.lit(0).cast("bigint").alias("n_tokens"), F.lit(False).alias("over_limit")).schema
    for name in ("n_bytes", "n_tokens", "over_limit"):
        schema[name].nullable = True

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = codec(spec.value, classes.value, False)
        if not m.lasting:
            m.enter(whole.value)
        for batch in it:
            data, offsets = flat_utf8(batch.column(batch.schema.get_field_index(text)))
            n = np.zeros(len(offsets) - 1, np.int64)
            for part, offs, a, b in batches(data, offsets):
                n[a:b] += m.count(part, offs)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.diff(offsets)), pa.array(n), pa.array(n > limit)], [*batch.schema.names, "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(released(run), schema)


def encode_decode(df: DataFrame, text: str = "text", path: str | None = None, ids: bool = True) -> DataFrame:
    """Adds n_tokens, ids_sha256, decoded_sha256 and, if asked, token_ids and decoded to df.

    A null text encodes as empty: no ids, decoded "". Texts of any length are encoded whole, repeated rows each; an empty table gives
    no rows. Columns of these names that df has already are replaced. The digests are of
    the ids as little-endian unsigned 32-bit integers and of the decoded text in UTF-8; bytes that are no UTF-8 decode as the
    replacement character, as the library does.
    """
    spark = df.sparkSession
    path = path or vocabulary_path()
    ready(spark)
    spec, classes = codec_parts(spark, path)
    names = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["token_ids", "decoded"] * ids
    df = df.drop(*names)
    empty = [F.lit(None).cast(t).alias(n) for n, t in zip(names, ("bigint", "string", "string", "array<int>", "string"), strict=False)]
    schema = df.select("*", *empty).schema

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = codec(spec.value, classes.value, True)
        for batch in it:
            out: list[tuple] = []
            for _, got in encoded_rows(batch, text, m):
                back = b"".join(map(m.bytes_of.__getitem__, got.tolist())).decode("utf-8", "replace")
                row = (len(got), hashlib.sha256(got.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest())
                out.append((*row, got.astype(np.int32), back) if ids else row)
            cols = [list(x) for x in zip(*out, strict=True)] or [[] for _ in names]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, t) for c, t in zip(cols, types, strict=False))], [*batch.schema.names, *names])

    return df.mapInArrow(released(run), schema)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).drop("text")


def op9_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of what they decode to."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode_decode(docs, ids=False).drop("text")
