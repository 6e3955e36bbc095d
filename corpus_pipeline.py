"""From documents to packed token sequences: language, near-duplicates, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next one's docs. All but the
last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaywright.llm import language, packing, pii, simhash, suffix
from assaywright.llm._common import discard, stored

#: A document goes if no language is recognised in it or the best one is less likely than this.
LEAST_SCORE = 0.5


def _with_text(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of `like`, with n_chars (where it exists) counted anew."""
    if "n_chars" in like.columns:
        docs = docs.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(like.schema["n_chars"].dataType))
    return docs.select(*[F.col(f"`{c}`") for c in like.columns])


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is recognised. Texts that are null or empty or have no letter go; texts of any length are read whole,
    repeated rows are judged alike, and an empty table stays empty."""
    model = language.fit(docs, "text", "lang")
    named = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    got = language.predict(docs.withColumnsRenamed(named), model)
    kept = got.filter((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumnsRenamed({v: k for k, v in named.items()}).select(*[F.col(f"`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each group of copies, the document with the smallest doc_id: texts of one sequence of words, and texts that share 0.8 of
    their five-word shingles with another of the group. Rows that are there several times stay once; null and empty texts are one group; texts
    of any length are compared whole; an empty table stays empty; other columns pass, whatever their names."""
    groups = simhash.near_copies(docs, "doc_id")
    first = F.col("doc_id").eqNullSafe(F.col("low")) & (F.col("digest") == F.col("low_digest"))
    stay = stored(groups.filter(first).groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_keep")).agg(F.count("*").alias("_n")), "stay")
    kept = simhash.with_sequence(docs, name="_digest").join(stay.select("_id", "_keep"), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_digest") == F.col("_keep")), "left_semi")
    if stay.filter("_n > 1").limit(1).count():  # rows that are there twice
        kept = kept.dropDuplicates(["doc_id", "_digest"])
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes out of texts all strings of 200 bytes that start anywhere else too. No document goes: null texts stay null, and a text that
    repeats as a whole stays as an empty one, as do all rows of a repeated one. Texts of any length are taken whole; an empty table stays empty."""
    named = {c: f"_doc_{i}" for i, c in enumerate(docs.columns) if c != "text"}
    got = suffix.remove_repeats(docs.withColumnsRenamed(named), named["doc_id"], name="kept", as_text=True)
    got = got.withColumn("text", F.when(F.col("text").isNotNull(), F.col("kept"))).select("text", *named.values())
    return _with_text(got.withColumnsRenamed({v: k for k, v in named.items()}), docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Puts [EMAIL] and the like in place of personal data and of the terms that give it away. No document goes; null texts stay null. Texts of any
    length are cleaned whole, repeated rows alike; an empty table stays empty; other columns pass, whatever their names."""
    return _with_text(pii.sanitise(docs, "doc_id"), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens. Null and empty texts are one piece of one token, long texts several pieces,
    repeated rows repeated pieces; an empty table gives no rows."""
    pieces = stored(packing.token_pieces(docs, "doc_id"), "pieces")
    out = packing.pack(pieces, "doc_id").select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
    discard(pieces)
    return out


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("suffix_array_dedup", repeated_passages),
    ("pii", personal_data),
    ("best_fit_packing", packed),
]

#: SQL can't express naive Bayes, fingerprint components, repeated substrings, spans and packing together; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        before, docs = docs, stored(stage(spark, docs, sf_dir), name)
        discard(before)  # written by the stage before, if any was
    return STAGES[-1][1](spark, docs, sf_dir)
