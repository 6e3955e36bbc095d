"""Third layer: weighted ensemble of model scores and their agreement."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import round_to
from ..schemas import MODELS

UNKNOWN_WEIGHT = 0.1


def ensemble_long(df: DataFrame, key: str, weights: dict[str, float] = MODELS) -> DataFrame:
    """df: (key, model, score). Weighted mean to six decimals and agreement max(p, 1-p) to four, p the share of scores over one half.

    A model without a weight counts 0.1; a null score counts 0.0, as a failed inference does.
    """
    w = F.coalesce(F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(v))])[F.col("model")], F.lit(UNKNOWN_WEIGHT))
    s = F.coalesce("score", F.lit(0.0))
    micro = lambda x: F.sum(F.floor(x * 1e9 + 0.5).cast("bigint"))
    got = df.groupBy(key).agg((micro(w * s) / micro(w)).alias("e"), F.avg((s > 0.5).cast("double")).alias("p"), F.count("*").alias("models"))
    return got.select(key, round_to(F.col("e"), 6).alias("ensemble_score"), round_to(F.greatest(F.col("p"), 1 - F.col("p")), 4).alias("model_agreement_ratio"), "models", (F.greatest(F.col("p"), 1 - F.col("p")) < 0.6).alias("low_agreement"))


def ensemble_wide(df: DataFrame, scores: str = "s", weights: dict[str, float] = MODELS) -> DataFrame:
    """The same over a struct of score columns: a projection without a shuffle."""
    cols = [(F.coalesce(F.col(f"{scores}.{m}"), F.lit(0.0)), w) for m, w in weights.items()]
    top = sum(((c * w) for c, w in cols[1:]), cols[0][0] * cols[0][1])
    p = sum(((c > 0.5).cast("double") for c, _ in cols[1:]), (cols[0][0] > 0.5).cast("double")) / len(cols)
    return df.withColumns({"ensemble_score": round_to(top / float(sum(weights.values())), 6), "model_agreement_ratio": round_to(F.greatest(p, 1 - p), 4)})


def infer(df: DataFrame, models: dict[str, Callable[[pd.DataFrame], pd.Series]], inputs: list[str]) -> DataFrame:
    """Adds a score for each model from its function over Arrow batches, and failed_models, how many of them gave none: a function that
    fails on a batch scores 0.0 there, which is told apart from a score of zero by that count."""
    out = df
    for name, fn in models.items():
        out = out.withColumn(name, F.pandas_udf(_guarded(fn), "struct<score:double,failed:boolean>")(F.struct(*inputs)))
    failed = sum((F.col(f"{name}.failed").cast("int") for name in models), F.lit(0))
    return out.withColumn("failed_models", failed).withColumns({name: F.col(f"{name}.score") for name in models})


def _guarded(fn: Callable[[pd.DataFrame], pd.Series]) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            return pd.DataFrame({"score": fn(pdf).astype("float64").to_numpy(), "failed": False})
        except Exception:  # noqa: BLE001  a model that is down must not stop the scan
            return pd.DataFrame({"score": [0.0] * len(pdf), "failed": True})

    return call


def platt_fit(df: DataFrame, score: str, label: str, rounds: int = 25) -> tuple[float, float]:
    """(a, b) of the calibrated probability 1 / (1 + exp(-(a * score + b))), by Newton steps whose five sums are one aggregate each. Targets
    are drawn in from 0 and 1 by the counts of either class, as Platt has it."""
    rows = df.select(F.col(score).cast("double").alias("s"), F.col(label).cast("double").alias("y")).filter("s is not null and y is not null")
    n = rows.agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")).first()
    if not n["p"] or not n["n"]:
        raise ValueError("calibration needs rows of both classes")
    target = F.when(F.col("y") > 0.5, (n["p"] + 1) / (n["p"] + 2)).otherwise(1 / (n["n"] + 2))
    rows = rows.groupBy("s", target.alias("t")).agg(F.count("*").alias("k")).persist()  # at most two rows for each different score
    a, b = 0.0, math.log((n["p"] + 1) / (n["n"] + 1))
    try:
        for _ in range(rounds):
            p = 1 / (1 + F.exp(-(F.col("s") * a + b)))
            d, w, k = p - F.col("t"), p * (1 - p), F.col("k")
            g = rows.agg(F.sum(k * d * F.col("s")), F.sum(k * d), F.sum(k * w * F.col("s") * F.col("s")), F.sum(k * w * F.col("s")), F.sum(k * w)).first()
            ga, gb, aa, ab, bb = (float(x) for x in g)
            det = (aa + 1e-12) * (bb + 1e-12) - ab * ab
            da, db = ((bb + 1e-12) * ga - ab * gb) / det, ((aa + 1e-12) * gb - ab * ga) / det
            a, b = a - da, b - db
            if abs(da) + abs(db) < 1e-10:
                break
    finally:
        rows.unpersist()
    return a, b


def calibrated(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(score * a + b)))


def assigned(df: DataFrame, key: str, experiment: str, share: float) -> DataFrame:
    """Adds variant: `candidate` for a share of keys, by a hash of the experiment's name and the key, so that a key stays where it is."""
    point = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(experiment), F.col(key).cast("string")), 256), 1, 8), 16, 10).cast("bigint")
    return df.withColumn("variant", F.when(point < int(share * 2**32), "candidate").otherwise("current"))


def canary(stats: DataFrame, least: int = 100, worse: float = 0.02) -> DataFrame:
    """stats: (model, variant, scans, errors). For each model whether its candidate goes on, goes back (its error rate is more than `worse`
    over the current one's) or waits for `least` scans."""
    of = lambda v, c: F.coalesce(F.sum(F.when(F.col("variant") == v, F.col(c))), F.lit(0)).cast("bigint")
    g = stats.groupBy("model").agg(of("candidate", "scans").alias("n"), of("candidate", "errors").alias("e"), of("current", "scans").alias("n0"), of("current", "errors").alias("e0"))
    gap = F.coalesce(F.try_divide(F.col("e").cast("double"), F.col("n").cast("double")) - F.try_divide(F.col("e0").cast("double"), F.col("n0").cast("double")), F.lit(0.0))
    return g.select("model", F.col("n").alias("candidate_scans"), gap.alias("error_gap"), F.when(F.col("n") < least, "WAIT").when(gap > worse, "ROLLBACK").otherwise("PROMOTE").alias("decision"))
