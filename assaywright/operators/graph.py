"""Groups of rows that are linked in several ways: star links for shared values, near links for hashes, and their connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.readers import scratch
from .hashing import matches

#: Rows whose bands one task holds; each has up to 66 bands and flips on both sides.
ROWS_A_TASK = 1024


def shared_links(rows: DataFrame, node: str, *keys: str) -> DataFrame:
    """(a, b): each row with the first of those that share its value of all keys. A value that a million rows share makes a million links and
    no pairs; the first comes from partial minima. Nulls share nothing."""
    there = rows.dropna(subset=[node, *keys])
    first = there.groupBy(*keys).agg(F.min(node).alias("a"))
    return there.join(first, list(keys)).filter(F.col(node) > F.col("a")).select("a", F.col(node).alias("b"))


def near_links(rows: DataFrame, node: str, h: str, distance: int) -> DataFrame:
    """(a, b): links that join rows whose hashes lie within the distance. Rows of one hash are linked with the first of them, and the first
    rows of near hashes with each other, so a hash that very many rows have meets its neighbours once."""
    there = rows.select(F.col(node).alias("_n"), F.col(h).alias("h")).dropna()
    one = there.groupBy("h").agg(F.min("_n").alias("a"))
    same = there.join(one, "h").filter("_n > a").select("a", F.col("_n").alias("b"))
    near = matches(one.select("h", F.col("a")), one.select(F.col("a").alias("ref_id"), F.col("h").alias("ref_h")), distance, parts=-(-rows.count() // ROWS_A_TASK))
    return same.union(near.filter("a < ref_id").select("a", F.col("ref_id").alias("b")))


def _kept(df: DataFrame, name: str) -> DataFrame:
    """Written below the shared folder and read again: cuts the lineage, outlives executors."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(*links: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of every node of some links (a, b): root is the smallest node that it reaches.

    Every node points at a smaller one. In a round each link is replaced by one between what its ends point at, and each node by the smallest of
    what its links and its pointer offer; pointers then point at their target's target, so long chains halve. All steps are joins on nodes
    with partial minima; a node with very many links is one row on the side that has one row a node.
    """
    every = reduce(DataFrame.union, [x.select("a", "b") for x in links])
    edges = _kept(every.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    point = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("root")).union(edges.select("a", "a")).groupBy("node").agg(F.min("root").alias("root"))
    point = _kept(point, "pointers")
    for _ in range(rounds):
        left, right = (point.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "ab")
        met = edges.join(left, "a").join(right, "b").filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct()
        edges = _kept(met, "links")
        if not edges.limit(1).count():
            return point
        # a larger root is hung on the smallest that it is linked with; the others stay
        hung = edges.groupBy(F.col("b").alias("root")).agg(F.min("a").alias("low"))
        step = point.join(hung, "root", "left").select("node", F.coalesce("low", "root").alias("root"))
        for _ in range(2):  # pointers' pointers
            of = step.select(F.col("node").alias("root"), F.col("root").alias("up"))
            step = _kept(step.join(of, "root").select("node", F.col("up").alias("root")), "pointers")
        point = step
    raise RuntimeError("components did not settle")


def campaigns(rows: DataFrame, groups: DataFrame, node: str, least: int, *counted: str) -> DataFrame:
    """(root, rows, n of different values of each counted column, first and last time) of components with at least so many rows. rows has ts."""
    got = rows.join(groups, rows[node] == groups["node"]).groupBy("root")
    got = got.agg(F.count("*").alias("rows"), *[F.count_distinct(c).alias(f"{c}s") for c in counted], F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"))
    return got.filter(F.col("rows") >= least)
