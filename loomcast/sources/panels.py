"""Dense panels (series, index, timestamp, y, season_index) out of event tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

#: name: (table, series column, time column, value column, unit, drop the last period, season length, horizon, lags)
PANELS = {
    "ph": ("events", "event_type", "ts", "value", "hour", False, 24, 6, 8),
    "pd": ("events", "event_type", "ts", "value", "day", False, 7, 3, 5),
    "pm": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "month", True, 12, 6, 15),
    "pu": ("lineitem", "l_suppkey", "l_shipdate", "l_extendedprice", "month", True, 12, 6, 12),
    "pq": ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", "quarter", True, 4, 2, 4),
    "py": ("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "year", False, 1, 1, 2),
    "pw": ("lineitem", "l_returnflag", "l_shipdate", "l_extendedprice", "week", True, 52, 4, 6),
}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def dense_panel(rows: DataFrame, series: str, ts: str, value: str, unit: str, drop_last: bool = False, covariate: str | None = None) -> DataFrame:
    """One row for each series and period between the first and last period of the table; periods without rows are 0.

    Sums are exact (decimal) and partial-aggregated before their only shuffle; the spine is one small row list per series.
    """
    extra = [] if covariate is None else [F.col(covariate).cast("decimal(18,2)").alias("c")]
    base = rows.select(F.col(series).cast("string").alias("series"), F.date_trunc(unit, ts).cast("timestamp_ntz").alias("timestamp"), F.col(value).cast("decimal(18,2)").alias("v"), *extra).where("series is not null and timestamp is not null")
    sums = base.groupBy("series", "timestamp").agg(F.sum("v").cast("double").alias("y"), *[F.sum("c").cast("double").alias("cov") for _ in extra])
    step = F.expr("interval 3 month" if unit == "quarter" else f"interval 1 {unit}")
    ends = base.agg(F.min("timestamp").alias("low"), (F.max("timestamp") - step if drop_last else F.max("timestamp")).alias("high"))  # one row
    times = F.when(F.col("high") >= F.col("low"), F.sequence(F.col("low"), F.col("high"), step))
    spine = base.select("series").distinct().join(F.broadcast(ends)).select("series", F.explode(times).alias("timestamp"))
    own = W.partitionBy("series").orderBy("timestamp")
    filled = spine.join(sums, ["series", "timestamp"], "left")
    columns = [F.coalesce("y", F.lit(0.0)).alias("y"), *[F.coalesce("cov", F.lit(0.0)).alias("cov") for _ in extra]]
    # on a dense spine the rank of a time in its series is its rank over all times
    n = (F.row_number().over(own) - 1).cast("long")
    return filled.select("series", n.alias("index"), "timestamp", *columns, n.alias("season_index"))


def panel(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    table, series, ts, value, unit, drop_last, *_ = PANELS[name]
    return dense_panel(read(spark, sf_dir, table), series, ts, value, unit, drop_last, "l_quantity" if name == "pw" else None)


def panel_sql(name: str) -> str:
    """The same panel as a list of common table expressions that end with one of the panel's name."""
    table, series, ts, value, unit, drop_last, *_ = PANELS[name]
    cov = ", CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS cov" if name == "pw" else ""
    take = ", coalesce(s.cov, 0.0) AS cov" if name == "pw" else ""
    less = f" - INTERVAL 1 {unit}" if drop_last else ""
    return f"""{name}_sums AS (SELECT CAST({series} AS VARCHAR) AS series, CAST(date_trunc('{unit}', {ts}) AS TIMESTAMP) AS timestamp,
 CAST(sum(CAST({value} AS DECIMAL(18,2))) AS DOUBLE) AS y{cov} FROM {table} GROUP BY 1, 2),
{name}_spine AS (SELECT series, unnest(generate_series((SELECT min(timestamp) FROM {name}_sums), (SELECT max(timestamp) FROM {name}_sums){less}, INTERVAL 1 {unit})) AS timestamp FROM (SELECT DISTINCT series FROM {name}_sums)),
{name} AS (SELECT p.series, CAST(row_number() OVER w - 1 AS BIGINT) AS index, p.timestamp, coalesce(s.y, 0.0) AS y{take}, CAST(row_number() OVER w - 1 AS BIGINT) AS season_index
 FROM {name}_spine p LEFT JOIN {name}_sums s ON s.series = p.series AND s.timestamp = p.timestamp WINDOW w AS (PARTITION BY p.series ORDER BY p.timestamp))"""
