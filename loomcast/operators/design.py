"""Design matrices: lags, leads, derivatives, seasons, splits, scales. One window sort serves all lag and lead columns."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, WindowSpec, functions as F


def own() -> WindowSpec:
    """A series' rows in order; made when asked for, as a window needs a session."""
    return W.partitionBy("series").orderBy("index")


def back() -> WindowSpec:
    return W.partitionBy("series").orderBy(F.col("index").desc())


def lag_lead(panel: DataFrame, lags: int, horizon: int, complete: bool = True, diffs: bool = False, keep: tuple[str, ...] = ()) -> DataFrame:
    """(series, index, keep.., lag_1.., [diff_lag_2..], ahead_0..); ahead_0 is y itself. ``complete``: rows with all of them only."""
    past = [F.lag("y", k).over(own()).alias(f"lag_{k}") for k in range(1, lags + 1)]
    future = [F.lead("y", k).over(own()).alias(f"ahead_{k}") if k else F.col("y").alias("ahead_0") for k in range(horizon)]
    out = panel.select("series", "index", *keep, *past, *future)
    if complete:
        out = out.dropna(subset=[*[f"lag_{k}" for k in range(1, lags + 1)], *[f"ahead_{k}" for k in range(horizon)]])
    if diffs:
        out = out.withColumns({f"diff_lag_{k + 1}": F.col(f"lag_{k + 1}") - F.col(f"lag_{k}") for k in range(1, lags)})
    return out


def derivatives(design: DataFrame, horizon: int, orders: int) -> DataFrame:
    """Adds der_i_ahead_a: the i-th difference along the horizon. For as many orders as steps or more, ask for horizon + orders steps."""
    for i in range(1, orders + 1):
        before = (lambda a: f"ahead_{a}") if i == 1 else (lambda a, i=i: f"der_{i - 1}_ahead_{a}")
        design = design.withColumns({f"der_{i}_ahead_{a}": F.col(before(a)) - F.col(before(a - 1)) for a in range(i, horizon)})
    return design


def season(panel: DataFrame, length: int) -> DataFrame:
    """Adds season (1..length) and its sine and cosine; the largest observed season is a full turn."""
    numbered = panel.withColumn("season", F.pmod("season_index", F.lit(length)) + 1)
    top = numbered.agg(F.max("season").cast("double").alias("_top"))  # one row, worked out in the job that uses it
    angle = F.lit(2 * math.pi) * F.col("season") / F.col("_top")
    return numbered.join(F.broadcast(top)).withColumns({"sin_season": F.sin(angle), "cos_season": F.cos(angle)}).drop("_top")


def tail_split(rows: DataFrame, k: int) -> DataFrame:
    """Adds is_test: the last k rows of each series."""
    return rows.withColumn("is_test", F.row_number().over(back()) <= k)


def holdout(rows: DataFrame, k: int) -> DataFrame:
    """Adds is_eval: the last k rows of series that have more than k."""
    return rows.withColumn("is_eval", (F.row_number().over(back()) <= k) & (F.count("*").over(W.partitionBy("series")) > k))


def cv_folds(rows: DataFrame, folds: int, block: int, min_train: int | None = None) -> DataFrame:
    """(series, index, fold, part) for rolling-origin folds; fold 0 is the oldest; series too short for a fold are left out of it."""
    least = max(1, block // 2) if min_train is None else min_train
    r, n = F.row_number().over(back()) - 1, F.count("*").over(W.partitionBy("series"))
    out = rows.select("series", "index", r.alias("r"), n.alias("n")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    left = F.lit(folds) - F.col("fold")
    out = out.where(F.col("n") - left * block >= least)
    part = F.when(F.floor(F.col("r") / block) == left - 1, "test").when(F.col("r") >= left * block, "train")
    return out.select("series", "index", "fold", part.alias("part")).where("part is not null")


def _digest(seed: int) -> Column:
    return F.md5(F.concat_ws(":", F.col("series").cast("string"), F.col("index").cast("string"), F.lit(str(seed))))


def kfold(rows: DataFrame, folds: int, seed: int = 10, by_series: bool = True) -> DataFrame:
    """(series, index, fold): shuffled folds by a seeded digest. ``by_series``: each series is dealt out evenly; else rows go by
    their digest alone, which needs no shuffle and makes folds of about equal size."""
    if by_series:
        fold = F.ntile(folds).over(W.partitionBy("series").orderBy(_digest(seed), "index")) - 1
    else:
        fold = F.conv(F.substring(_digest(seed), 1, 8), 16, 10).cast("bigint") % folds
    return rows.select("series", "index", fold.cast("int").alias("fold"))


def series_means(train: DataFrame, column: str = "lag_1", zero: str = "mean") -> DataFrame:
    """(series, mean_series); a zero mean becomes the mean of all series' means, or 1."""
    means = train.groupBy("series").agg(F.avg(column).alias("m"))
    if zero == "one":
        return means.select("series", F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("m")).alias("mean_series"))
    other = means.agg(F.avg("m").alias("other"))  # one row
    return means.join(F.broadcast(other)).select("series", F.when(F.col("m") == 0, F.col("other")).otherwise(F.col("m")).alias("mean_series"))


def scale(rows: DataFrame, scales: DataFrame, columns: list[str], by: str = "mean_series") -> DataFrame:
    """Divides columns by their series' scale; series without one are dropped (inner join, one small row a series)."""
    return rows.join(scales, "series").withColumns({c: F.try_divide(F.col(c), F.col(by)) for c in columns})


def unscale(rows: DataFrame, columns: list[str], integer: bool = False, by: str = "mean_series") -> DataFrame:
    """Multiplies back and makes forecasts of it, as ``evaluated`` does."""
    return evaluated(rows.withColumns({c: F.col(c) * F.col(by) for c in columns}), columns, integer)


def evaluated(rows: DataFrame, columns: list[str], integer: bool = False) -> DataFrame:
    """Forecasts as they are judged: never below 0, and with ``integer`` rounded half to even."""
    return rows.withColumns({c: F.greatest(F.rint(c) if integer else F.col(c), F.lit(0.0)) for c in columns})


def normalized(rows: DataFrame, train: DataFrame, columns: list[str], external: list[str]) -> DataFrame:
    """rows with ``columns`` divided by their series' mean lag_1 of the training rows (a mean of 0 counts as 1), and each ``external`` one by its own mean."""
    means = train.groupBy("series").agg(F.avg("lag_1").alias("_mean"), *[F.avg(c).alias(f"{c}_mean") for c in external])
    out = rows.join(means.withColumn("_mean", F.when(F.col("_mean") == 0, F.lit(1.0)).otherwise(F.col("_mean"))), "series")
    out = out.withColumns({c: F.col(c) / F.col("_mean") for c in columns} | {c: F.try_divide(F.col(c), F.col(f"{c}_mean")) for c in external})
    return out.drop("_mean", *[f"{c}_mean" for c in external])


def seasonal_scale(panel: DataFrame, drop_last: int, season_length: int, fallback: bool = True) -> DataFrame:
    """(series, scale): mean absolute seasonal difference without the last rows; the lag-1 one where it is 0 or missing."""
    kept = panel.withColumn("_r", F.row_number().over(back())).where(F.col("_r") > drop_last)
    d = kept.select("series", F.abs(F.col("y") - F.lag("y", season_length).over(own())).alias("s"), F.abs(F.col("y") - F.lag("y", 1).over(own())).alias("o"))
    out = d.groupBy("series").agg(F.avg("s").alias("s"), F.avg("o").alias("o"))
    return out.select("series", (F.when(F.col("s") > 0, F.col("s")).otherwise(F.col("o")) if fallback else F.col("s")).alias("scale"))


def decay_weights(n: int, ratio: float | None) -> list[float]:
    """From 1 down to ``ratio`` in equal factors; a ratio of 0 or less counts as 0.001."""
    if ratio is None or n == 1:
        return [1.0] * n
    r = ratio if ratio > 0 else 0.001
    return [math.exp(math.log(r) / (n - 1) * t) for t in range(n)]


def naive(panel: DataFrame, horizon: int, season_length: int = 1) -> DataFrame:
    """(series, h, actual, pred): the last ``horizon`` rows against the last value, or the last season's, before them."""
    r = panel.withColumn("r", F.row_number().over(back()) - 1)
    test = r.where(F.col("r") < horizon).select("series", (F.lit(horizon) - F.col("r")).alias("h"), F.col("y").alias("actual"))
    past = r.where((F.col("r") >= horizon) & (F.col("r") < horizon + season_length)).select("series", (F.lit(horizon + season_length - 1) - F.col("r")).alias("place"), F.col("y").alias("pred"))
    return test.withColumn("place", F.pmod(F.col("h") - 1, F.lit(season_length))).join(past, ["series", "place"]).select("series", F.col("h").cast("int").alias("h"), "actual", "pred")
