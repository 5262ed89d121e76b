"""Discretisation of features."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from loomcast.sources.tables import cut

TIE = 1e-7


#: Distinct values that one task may go through in order, batch by batch; more of them are binned by range partitions.
FOLD_LIMIT = 5_000_000


def _tie_ends(counts: DataFrame) -> DataFrame:
    """(p, v, next_v, cum): values that a larger one follows by more than a tie, or none at all; ``cum`` rows are not above them. A window for each p."""
    w = W.partitionBy("p").orderBy("v")
    out = counts.select("p", "v", F.lead("v").over(w).alias("next_v"), F.sum("n").over(w).alias("cum"))
    return out.where(F.col("next_v").isNull() | (F.col("next_v") - F.col("v") > TIE))


def _ranged_tie_ends(counts: DataFrame) -> DataFrame:
    """The same without a task that sees all values of a p: windows stay in range partitions, and what comes before and after a
    partition (a few numbers for each) is worked out on the driver."""
    spark = counts.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(parts, "p", "v").withColumn("part", F.spark_partition_id()))
    edges = ranged.groupBy("p", "part").agg(F.sum("n").alias("n"), F.min("v").alias("first")).orderBy("p", "part").collect()  # partitions + features rows
    known, before = [], 0
    for i, r in enumerate(edges):
        before = before if i and edges[i - 1]["p"] == r["p"] else 0
        follows = i + 1 < len(edges) and edges[i + 1]["p"] == r["p"]
        known.append((r["p"], r["part"], before, edges[i + 1]["first"] if follows else None))
        before += r["n"]
    kinds = dict(counts.dtypes)
    around = spark.createDataFrame(known, f"p {kinds['p']}, part int, before long, follows {kinds['v']}")
    w = W.partitionBy("p", "part").orderBy("v")
    own = ranged.join(F.broadcast(around), ["p", "part"])
    out = own.select("p", "v", F.coalesce(F.lead("v").over(w), F.col("follows")).alias("next_v"), (F.sum("n").over(w) + F.col("before")).alias("cum"))
    return cut(out.where(F.col("next_v").isNull() | (F.col("next_v") - F.col("v") > TIE)))


class _Closing:
    """The open bin of a p, fed with its tie ends in order."""

    def __init__(self, total: int, least: float, bins: int):
        self.need, self.bins, self.bin, self.start, self.lo, self.out = max(total // bins, 1), bins, 0, 0, least, []

    def feed(self, v: np.ndarray, following: np.ndarray, cum: np.ndarray, last: bool) -> None:
        """``last``: the last of these ends is the largest value."""
        while self.bin < self.bins - 1:
            k = int(np.searchsorted(cum, self.start + self.need))
            if k == len(cum) or (last and k == len(cum) - 1):
                break
            self._close(v[k], following[k], cum[k])
        if last:
            self._close(v[-1], np.nan, cum[-1])

    def _close(self, v, following, cum) -> None:
        self.out.append((self.bin, float(self.lo), float(v), int(cum - self.start)))
        self.bin, self.start, self.lo = self.bin + 1, int(cum), following


def _folded(ends: DataFrame, sizes: DataFrame, bins: int) -> DataFrame:
    """One pass over each p's tie ends in order; a task holds a batch of them and the bins."""
    kinds = dict(ends.dtypes)
    rows = ends.join(F.broadcast(sizes), "p").sortWithinPartitions("p", "v")  # sizes: a row a feature
    rows = rows.select("p", F.col("v").cast("double").alias("v"), F.col("next_v").cast("double").alias("next_v"), F.col("cum").cast("long").alias("cum"), "total", F.col("least").cast("double").alias("least"))

    def run(batches):
        at, now = None, None
        for b in batches:
            p = b.column(0).to_pylist()
            v, following, cum, total, least = (b.column(i).to_numpy(zero_copy_only=False) for i in range(1, 6))
            edge = [0, *[i for i in range(1, len(p)) if p[i] != p[i - 1]], len(p)]
            for x, y in zip(edge[:-1], edge[1:], strict=True):
                if x == y:
                    continue
                if now is None or p[x] != at:
                    at, now = p[x], _Closing(int(total[x]), least[x], bins)
                last = bool(np.isnan(following[y - 1]))
                now.feed(v[x:y], following[x:y], cum[x:y], last)
                if last:
                    n = len(now.out)
                    found = list(zip(*now.out, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array([at] * n, b.schema.field(0).type), pa.array(found[0], pa.int32()), pa.array(found[1], pa.float64()), pa.array(found[2], pa.float64()), pa.array(found[3], pa.int64())], names=["p", "bin", "bin_min", "bin_max", "n"])
                    now = None

    return rows.mapInArrow(run, f"p {kinds['p']}, bin int, bin_min double, bin_max double, n long")


def _stepped(ends: DataFrame, sizes: DataFrame, bins: int) -> DataFrame:
    """One small job for each bin, over all p at once: the first tie end with enough rows since the last one."""
    spark = ends.sparkSession
    at = {r["p"]: [r["total"] // bins, 0, r["least"]] for r in sizes.collect()}  # one row a feature
    kinds, out = dict(ends.dtypes), []
    for b in range(bins):
        state = spark.createDataFrame([(p, since, need) for p, (need, since, _) in at.items()], f"p {kinds['p']}, since long, need long")
        reached = F.col("next_v").isNull() | ((F.col("cum") - F.col("since") >= F.col("need")) & F.lit(b < bins - 1))
        near = ends.join(F.broadcast(state), "p").where((F.col("cum") > F.col("since")) & reached)
        for r in near.groupBy("p").agg(F.min(F.struct("cum", "v", "next_v")).alias("e")).collect():
            need, since, lo = at.pop(r["p"])
            out.append((r["p"], b, float(lo), float(r["e"]["v"]), r["e"]["cum"] - since))
            if r["e"]["next_v"] is not None:
                at[r["p"]] = [need, r["e"]["cum"], r["e"]["next_v"]]
        if not at:
            break
    return spark.createDataFrame(out, f"p {kinds['p']}, bin int, bin_min double, bin_max double, n long")


def greedy_bins(values: DataFrame, bins: int, by: str = "p", value: str = "v", fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """(by, bin, bin_min, bin_max, n): equal-frequency bins that never part equal values.

    A bin closes once it holds total/bins rows and the next value is larger by more than 1e-7; the last number takes the rest. Rows are
    counted by value first (partial aggregation) and the counts kept, so all that follows sees distinct values, not rows. Up to
    ``fold_limit`` of them are gone through in a task a group; more stay in range partitions.
    """
    counts = cut(values.select(F.col(by).alias("p"), F.col(value).alias("v")).where("v is not null").groupBy("p", "v").agg(F.count("*").alias("n")))
    sizes = counts.groupBy("p").agg(F.sum("n").alias("total"), F.min("v").alias("least"))
    if counts.count() <= fold_limit:
        out = _folded(_tie_ends(counts), sizes, bins)
    else:
        out = _stepped(_ranged_tie_ends(counts), sizes, bins)
    return out.withColumnRenamed("p", by)


def equal_width(values: DataFrame, bins: int, by: str = "p", value: str = "v") -> DataFrame:
    """(by, value, bin): bins of equal width between a group's least and largest value."""
    ends = values.groupBy(by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    b = F.floor(F.try_divide(F.col(value) - F.col("lo"), F.col("hi") - F.col("lo")) * bins)
    return values.join(ends, by).select(by, value, F.least(F.coalesce(b, F.lit(0)), F.lit(bins - 1)).cast("int").alias("bin"))


def equal_width_edges(values: DataFrame, bins: int, by: str = "p", value: str = "v") -> DataFrame:
    """(by, bin, bin_min, bin_max, n) of all bins of equal width; an empty one has the edges of its left neighbour. A constant is one bin."""
    counts = equal_width(values, bins, by, value).groupBy(by, "bin").agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count("*").alias("n"))
    several = counts.groupBy(by).agg((F.max("hi") > F.min("lo")).alias("several"))
    every = several.select(by, F.explode(F.when(F.col("several"), F.sequence(F.lit(0), F.lit(bins - 1))).otherwise(F.array(F.lit(0)))).alias("bin"))
    before = W.partitionBy(by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    return every.join(counts, [by, "bin"], "left").select(by, "bin", F.last("lo", ignorenulls=True).over(before).alias("bin_min"), F.last("hi", ignorenulls=True).over(before).alias("bin_max"), F.coalesce("n", F.lit(0)).alias("n"))


def qcut(values: DataFrame, levels: int, value: str = "v") -> DataFrame:
    """(value, code): quantile classes with equal edges merged; a constant has one class."""
    edges = values.agg(F.percentile(value, F.array(*[F.lit(i / levels) for i in range(levels + 1)]))).first()[0]  # levels + 1 numbers
    inner = sorted(set(edges))[1:-1]
    code = F.lit(0)
    for e in inner:
        code = code + F.when(F.col(value) > e, 1).otherwise(0)
    return values.select(value, code.cast("int").alias("code"))
