"""Checks of keys, references and inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
#: Prefixes of API keys.
KEY_PREFIXES = ("vts_live_", "vts_test_")


def duplicates(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count("*").alias("copies")).filter("copies > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """Rows of child whose reference is not null and finds no parent."""
    return child.filter(F.col(fk).isNotNull()).join(parent.select(F.col(pk).alias(fk)), fk, "left_anti")


def request_problems(df: DataFrame) -> DataFrame:
    """Adds the problems of requests (request_id, threshold, size_bytes, url) as a list, empty if there are none."""
    problems = F.array_compact(
        F.array(
            F.when(~F.coalesce(F.col("request_id").rlike(UUID), F.lit(False)), "bad_uuid"),
            F.when(~F.coalesce(F.col("threshold").between(0.0, 1.0), F.lit(False)), "bad_threshold"),
            F.when(~F.coalesce(F.col("size_bytes").between(1, 500 * 1024 * 1024), F.lit(False)), "bad_size"),
            F.when(~F.coalesce(F.col("url").rlike("^https?://[^\\s/]+"), F.lit(False)), "bad_url"),
        )
    )
    return df.withColumn("problems", problems)


def check_keys(calls: DataFrame, keys: DataFrame, secret: str = "api_key") -> DataFrame:
    """calls: api_key. keys: (key_hash, tenant_id, revoked). Adds tenant_id and status; only hashes of keys are compared."""
    good = F.lit(False)
    for p in KEY_PREFIXES:
        good = good | F.startswith(F.col(secret), F.lit(p))
    hashed = calls.withColumns({"_good": F.coalesce(good, F.lit(False)), "key_hash": F.sha2(F.col(secret), 256)})
    got = hashed.join(keys, "key_hash", "left")
    return got.withColumn("status", F.when(~F.col("_good"), "MALFORMED").when(F.col("tenant_id").isNull(), "UNKNOWN").when(F.col("revoked"), "REVOKED").otherwise("OK")).drop("_good", "key_hash", "revoked", secret)


def catalog(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name, data_type) of given tables; only their schemas are read."""
    spark = next(iter(tables.values())).sparkSession
    rows = [(t, f.name, f.dataType.simpleString()) for t, df in tables.items() for f in df.schema.fields]
    return spark.createDataFrame(rows, "table_name string, column_name string, data_type string")


def columns_like(catalog: DataFrame, pattern: str, unlike: str) -> DataFrame:
    """catalog: (table_name, column_name). How many columns match, tables like `unlike` left out."""
    return catalog.filter(F.col("column_name").like(pattern) & ~F.col("table_name").like(unlike)).agg(F.count("*").alias("n"))
