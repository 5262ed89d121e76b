"""Forecast metrics as column expressions and aggregations over (series, h, actual, pred[, scale]) rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomcast.operators import design


def finite(x: Column) -> Column:
    """The value, or null for NaN and infinities."""
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def msmape_term(a: Column, f: Column, eps: float = 0.1) -> Column:
    return 200 * F.abs(a - f) / F.greatest(F.lit(0.5 + eps), F.abs(a) + F.abs(f) + eps)


def smape_term(a: Column, f: Column) -> Column:
    return 200 * F.abs(a - f) / (F.abs(a) + F.abs(f) + 1e-9)


def by_row(forecast: DataFrame, scales: DataFrame | None = None) -> DataFrame:
    """(series, rmse, msmape[, mase]) of each series."""
    a, f = F.col("actual"), F.col("pred")
    out = forecast.groupBy("series").agg(F.sqrt(F.avg((a - f) * (a - f))).alias("rmse"), F.avg(msmape_term(a, f)).alias("msmape"), F.avg(F.abs(a - f)).alias("mae"))
    if scales is not None:
        out = out.join(scales, "series", "left").withColumn("mase", F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale"))))
    return out


def robust(rows: DataFrame, column: str) -> DataFrame:
    """(mean, median, std) of the finite values; std divides by their number."""
    return rows.select(finite(F.col(column)).alias("x")).agg(F.avg("x").alias("mean"), F.median("x").alias("median"), F.stddev_pop("x").alias("std"))


def msmape_of(forecast: DataFrame, eps: float = 0.1) -> DataFrame:
    """(msmape): one number over all pairs; pairs with a missing or infinite side are left out."""
    return forecast.agg(F.avg(finite(msmape_term(F.col("actual"), F.col("pred"), eps))).alias("msmape"))


def msmape_sweep(forecast: DataFrame, eps: float = 0.5, last_only: bool = False) -> DataFrame:
    """(series, msmape): the form of the parameter sweeps, with half the sum of sizes and ``eps`` below; ``last_only``: the last step alone."""
    a, f = F.col("actual"), F.col("pred")
    rows = forecast.where(F.col("h") == F.col("_top")) if last_only and "_top" in forecast.columns else forecast
    if last_only and "_top" not in forecast.columns:
        rows = forecast.join(F.broadcast(forecast.agg(F.max("h").alias("_top")))).where(F.col("h") == F.col("_top"))  # one row
    return rows.groupBy("series").agg((100 * F.avg(F.abs(f - a) / (F.greatest(F.abs(a) + F.abs(f) + eps, F.lit(eps)) / 2))).alias("msmape"))


def report(forecast: DataFrame, scales: DataFrame, methods: list[str], horizon: int, periods: int = 1, integer: bool = False) -> DataFrame:
    """(method, horizon_period, type, agg, value) of stored (method, series, h, actual, pred) rows, as they are judged: not below 0, rounded with ``integer``.

    The horizon is cut into ``periods`` parts of equal length but the last. A method without rows gets rows without a value and period; one that lacks some of its
    rows (series times horizon) rows without a value.
    """
    spark = forecast.sparkSession
    length = -(-horizon // periods)
    wanted = spark.createDataFrame([(m,) for m in methods], "method string")
    rows = design.evaluated(forecast.join(F.broadcast(wanted), "method"), ["pred"], integer)
    whole = rows.groupBy("method").agg((F.count("*") == F.count_distinct("series") * horizon).alias("whole"))
    a, f = F.col("actual"), F.col("pred")
    by = rows.withColumn("horizon_period", (F.floor((F.col("h") - 1) / length) + 1).cast("int")).groupBy("method", "horizon_period", "series")
    by = by.agg(F.sqrt(F.avg((a - f) * (a - f))).alias("RMSE"), F.avg(msmape_term(a, f)).alias("msMAPE"), F.avg(F.abs(a - f)).alias("mae")).join(scales, "series", "left")
    by = by.withColumn("MASE", F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale"))))
    kinds = ("msMAPE", "MASE", "RMSE")
    long = by.groupBy("method", "horizon_period").agg(*[g(finite(F.col(k))).alias(f"{k} {n}") for k in kinds for n, g in (("mean", F.avg), ("median", F.median))])
    entry = lambda k, n: F.struct(F.lit(k).alias("type"), F.lit(n).alias("agg"), F.col(f"{k} {n}").alias("value"))
    full = wanted.join(long, "method", "left").join(whole, "method", "left")
    out = full.select("method", "horizon_period", "whole", F.explode(F.array(*[entry(k, n) for k in kinds for n in ("mean", "median")])).alias("x"))
    return out.select("method", "horizon_period", "x.type", "x.agg", F.when(F.col("whole"), F.col("x.value")).alias("value"))


def per_horizon(forecast: DataFrame, scales: DataFrame) -> DataFrame:
    a, f = F.col("actual"), F.col("pred")
    rows = forecast.join(scales, "series").select("h", F.try_divide(F.abs(a - f), F.when(F.col("scale") > 0, F.col("scale"))).alias("mase"), smape_term(a, f).alias("smape"), ((a - f) * (a - f)).alias("sq"))
    return rows.groupBy("h").agg(F.avg("mase").alias("mase_mean"), F.median("mase").alias("mase_med"), F.avg("smape").alias("smape_mean"), F.median("smape").alias("smape_med"), F.sqrt(F.avg("sq")).alias("rmse"))


def mase_of_history(forecast: DataFrame, history: DataFrame, season_length: int) -> DataFrame:
    """(series, mase) with the scale of each series' raw training rows: their mean absolute seasonal difference, or that of lag 1 where the
    history is no longer than a season or the seasonal one is 0; null where neither is positive."""
    return by_row(forecast, design.seasonal_scale(history, 0, season_length)).select("series", "mase")
