"""Statistics over result tables: ranks, critical distance, slopes and signs, bootstrap intervals, comparison tables."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F


#: The studentised range at 0.05 over the root of two, for 2 to 10 methods.
CRITICAL = {2: 1.960, 3: 2.343, 4: 2.569, 5: 2.728, 6: 2.850, 7: 2.949, 8: 3.031, 9: 3.102, 10: 3.164}


def band(ranks: DataFrame, n: int) -> DataFrame:
    """(method, mean_rank, in_band): whether a method is within the critical distance of the best over ``n`` datasets."""
    every = ranks.agg(F.min("mean_rank").alias("best"), F.count("*").alias("k"))  # one row
    q = F.element_at(F.create_map(*[F.lit(x) for kv in CRITICAL.items() for x in kv]), F.col("k").cast("int"))
    cd = q * F.sqrt(F.col("k") * (F.col("k") + 1) / F.lit(6.0 * n))
    return ranks.join(F.broadcast(every)).select("method", "mean_rank", (F.col("mean_rank") <= F.col("best") + cd).alias("in_band"))


def sign_counts(slopes: DataFrame) -> DataFrame:
    """(n_neg, n_pos, p): how many slopes are below 0 and how many are not, and the exact two-sided binomial p."""
    n = slopes.agg(F.count_if(F.col("slope") < 0).alias("a"), F.count_if(F.col("slope") >= 0).alias("b")).first()  # two numbers
    return slopes.sparkSession.createDataFrame([(n["a"], n["b"], sign_test(n["b"], n["a"]) if n["a"] + n["b"] else None)], "n_neg long, n_pos long, p double")


def average_ranks(long: DataFrame) -> DataFrame:
    """(method, mean_rank) of (dataset, method, value) rows; equal values share their mean rank."""
    own = W.partitionBy("dataset").orderBy("value")
    tie = F.count("*").over(W.partitionBy("dataset", "value"))
    return long.select("method", (F.rank().over(own) + (tie - 1) / 2).alias("r")).groupBy("method").agg(F.avg("r").alias("mean_rank"))


def friedman(ranks: DataFrame, n: int, q: float) -> DataFrame:
    """(chi2, cd): Friedman's statistic of the mean ranks, and the critical distance for a table value ``q``."""
    k = F.count("*")
    chi = 12.0 * n / (k * (k + 1)) * (F.sum(F.col("mean_rank") * F.col("mean_rank")) - k * (k + 1) * (k + 1) / 4)
    return ranks.agg(chi.alias("chi2"), (F.lit(q) * F.sqrt(k * (k + 1) / F.lit(6.0 * n))).alias("cd"))


def slopes(rows: DataFrame) -> DataFrame:
    """(dataset, slope, sign) of rel on h."""
    out = rows.groupBy("dataset").agg(F.regr_slope("rel", "h").alias("slope"))
    return out.withColumn("sign", F.signum("slope").cast("int"))


def sign_test(positive: int, negative: int) -> float:
    """Exact two-sided binomial p."""
    n, k = positive + negative, min(positive, negative)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)


def bootstrap_mean(rows: DataFrame, by: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, mean, lo, hi): percentile interval of each group's mean; the groups are a few results each."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        v = np.sort(pdf[value].to_numpy(float))
        means = v[np.random.default_rng(seed).integers(0, len(v), (draws, len(v)))].mean(axis=1)
        return pd.DataFrame({by: [pdf[by].iloc[0]], "mean": [v.mean()], "lo": [np.percentile(means, 2.5)], "hi": [np.percentile(means, 97.5)]})

    return rows.groupBy(by).applyInPandas(run, f"{by} string, mean double, lo double, hi double")


def bootstrap_by_digest(rows: DataFrame, by: str, value: str, draws: int = 10_000, seed: int = 0) -> DataFrame:
    """(by, mean, lo, hi): as ``bootstrap_mean``, but what is drawn goes by digests, so that it is spread over the cluster and the same on any.

    Draws are counted by the values' places in order, so that no group of draws meets in a task before it is a mean.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    places = rows.where(F.col(value).isNotNull()).select(by, F.col(value).alias("v"), (F.row_number().over(W.partitionBy(by).orderBy(value)) - 1).cast("long").alias("place"))
    ks = counts.select(by, "n", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("k"))
    drawn = ks.select(by, "n", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("j"))
    number = F.conv(F.substring(F.md5(F.concat_ws(":", by, F.col("k").cast("string"), F.col("j").cast("string"), F.lit(str(seed)))), 1, 8), 16, 10).cast("long")
    picked = drawn.select(by, "k", (number % F.col("n")).alias("place")).groupBy(by, "k", "place").agg(F.count("*").alias("times"))
    means = picked.join(places, [by, "place"]).groupBy(by, "k").agg((F.sum(F.col("v") * F.col("times")) / F.sum("times")).alias("m"))
    ends = means.groupBy(by).agg(F.percentile("m", F.lit(0.025)).alias("lo"), F.percentile("m", F.lit(0.975)).alias("hi"))
    return counts.join(ends, by).select(by, "mean", "lo", "hi")


def relative_to_base(long: DataFrame, base: str) -> DataFrame:
    """(dataset, method, rel_pct): per cent over the base method's value."""
    b = long.where(F.col("method") == base).select("dataset", F.col("value").alias("b"))
    return long.join(b, "dataset").select("dataset", "method", (F.try_divide(F.col("value") - F.col("b"), "b") * 100).alias("rel_pct"))


def wide(long: DataFrame, methods: list[str]) -> DataFrame:
    return long.groupBy("dataset").pivot("method", methods).agg(F.first("value"))
