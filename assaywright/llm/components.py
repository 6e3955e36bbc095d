"""Connected components of an edge table without bringing edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import discard, stored


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root), stored: for every node of an edge the smallest node that it can reach.

    Large-star and small-star steps in turn: each hangs neighbours on the smallest node around. They halve the paths, so a few
    rounds do, about the logarithm of the longest. Smallest neighbours come from partial sums, so a node with very many
    edges does not land in one task; loops and repeated edges are allowed.
    """
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    e = stored(e, "edges")
    before = None
    for _ in range(rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).filter("u <> v")
        new = stored(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(e)
        e = new
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    out = stored(e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components")
    discard(e)
    return out
