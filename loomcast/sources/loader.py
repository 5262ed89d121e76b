"""From series collections in text files to panels with a calendar, covariates and a season index; run settings."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from loomcast.sources import tsf

#: Each frequency's short name, season lengths, calendar unit, and units a step.
FREQUENCIES = {
    "minutely": ("1min", (1440, 10080, 525960), "minutes", 1),
    "10_minutes": ("10min", (144, 1008, 52596), "minutes", 10),
    "half_hourly": ("30min", (48, 336, 17532), "minutes", 30),
    "hourly": ("1H", (24, 168, 8766), "hours", 1),
    "daily": ("1D", (7,), "days", 1),
    "weekly": ("1W", (365.25 / 7,), "weeks", 1),
    "monthly": ("1M", (12,), "months", 1),
    "quarterly": ("1Q", (4,), "months", 3),
    "yearly": ("1Y", (1,), "years", 1),
}
#: What a collection without a frequency, or whose times are to be ignored, counts as.
NO_FREQUENCY = ("1Y", (1,), "minutes", 1)
#: The start of series without one.
NO_START = "1900-01-01 00:00:00"


def after(start: Column, count: Column, unit: str) -> Column:
    """``start`` and ``count`` calendar units; months and years keep the day of the month, or take its last one."""
    n = count.cast("int")
    if unit in ("months", "quarters"):  # quarters are given in months
        return start + F.make_ym_interval(F.lit(0), n)
    if unit == "years":
        return start + F.make_ym_interval(n, F.lit(0))
    zero = F.lit(0)
    interval = {"weeks": lambda: (n * 7, zero, zero, zero), "days": lambda: (n, zero, zero, zero), "hours": lambda: (zero, n, zero, zero), "minutes": lambda: (zero, zero, n, zero), "seconds": lambda: (zero, zero, zero, n)}.get(unit)
    if interval is None:
        raise ValueError(f"unit: {unit}")
    return start + F.make_dt_interval(*interval())


def _start(table: DataFrame) -> Column:
    dates = [n for n, t in table.dtypes if t == "timestamp_ntz"]
    return F.col(dates[0]) if dates else F.lit(NO_START).cast("timestamp_ntz")


def load_panel(spark: SparkSession, path: str, sep: str = "_", ignore_timestamp: bool = False) -> tuple[DataFrame, str, tuple, int | None, list[str]]:
    """(panel, short frequency, season lengths, horizon, covariate types) of a collection; panel: (series, index, timestamp, y, covariates.., season_index).

    Where series are named ``type<sep>id`` and there are several types, those of type T are the panel, and the values of the others of the same id
    become columns, place by place; the lists are joined before they are exploded, so that one row a series is shuffled. season_index numbers the
    distinct times of all series in order. Values that are missing stay null.
    """
    table, meta = tsf.read_tsf(spark, path)
    known = meta["frequency"] is not None and not ignore_timestamp
    short, seasons, unit, step = FREQUENCIES[meta["frequency"]] if known else NO_FREQUENCY
    series = table.select(F.col("series_name").alias("series"), _start(table).alias("start"), F.col("series_value").alias("y"))
    first, types = series.select("series").first(), []
    if first is not None and sep in first["series"]:
        parted = series.withColumn("type", F.substring_index("series", sep, 1)).withColumn("id", F.substring(F.col("series"), F.length("type") + len(sep) + 1, F.length("series")))
        types = sorted(r[0] for r in parted.select("type").distinct().collect() if r[0] != "T")  # a few kinds of series
        if types and not parted.where("type = 'T'").isEmpty():
            more = parted.where("type <> 'T'").groupBy("id").pivot("type", types).agg(F.first("y"))
            series = parted.where("type = 'T'").join(more, "id", "left").select("series", "start", "y", *types)
        else:
            types = []
    rows = series.select("series", "start", *types, F.posexplode("y").alias("index", "y"))
    rows = rows.select("series", F.col("index").cast("long").alias("index"), after(F.col("start"), F.col("index") * step, unit).alias("timestamp"), "y", *[F.get(F.col(t), F.col("index")).alias(t) for t in types])
    # one row a time, however many series
    times = rows.select("timestamp").distinct().withColumn("season_index", (F.row_number().over(W.orderBy("timestamp")) - 1).cast("long"))
    return rows.join(times, "timestamp").select("series", "index", "timestamp", "y", *types, "season_index"), short, seasons, meta["horizon"], types


def long_frame(collection: DataFrame, frequency: str | None, compact: bool = False) -> DataFrame:
    """(unique_id, ds, y) of a series table, times from each series' start on. ``compact``: missing values are left out first, so that later ones move up."""
    _, _, unit, step = FREQUENCIES[frequency] if frequency else ("1D", (7,), "days", 1)
    values = F.filter("series_value", lambda x: x.isNotNull()) if compact else F.col("series_value")
    rows = collection.select(F.col("series_name").alias("unique_id"), _start(collection).alias("start"), F.posexplode(values).alias("i", "y"))
    return rows.select("unique_id", after(F.col("start"), F.col("i") * step, unit).alias("ds"), "y")


@dataclass
class RunConfig:
    """Settings of a benchmark run, with the published defaults; read from JSON, or YAML where its reader is installed."""

    datasets: list[str] = field(default_factory=list)
    seed: int = 10
    test_horizon: int = 1
    n_diff: int = 1
    cv_type: str = "timeseries"
    aggregation: str = "score"
    cv_metric: str = "rmse"
    max_depth: int = 40
    min_samples_leaf: int = 5
    n_discrete_lev: int = 32
    nfolds: int = 5
    min_depth: int = 4
    depth_increment: int = 4
    decay_set: list[float] = field(default_factory=lambda: [0, 0.5, 1])
    lambda_set: list[float] = field(default_factory=lambda: [0, 0.2, 0.5])
    beta_set: list[float] = field(default_factory=lambda: [0, 0.2, 0.5])
    bdt: dict = field(default_factory=lambda: {"n_estimators": 400, "lr": 0.05, "bagging_fraction": 0.8, "feature_fraction": 0.5, "max_depth": 8, "eval_metric": "mase"})
    rf: dict = field(default_factory=lambda: {"n_estimators": 400, "bagging_fraction": 0.8, "feature_fraction": 0.5, "max_depth": 40})

    @property
    def depths(self) -> list[int]:
        return list(range(self.min_depth, self.max_depth + 1, self.depth_increment))

    @classmethod
    def load(cls, path: str) -> RunConfig:
        """Settings that this engine does not have are an error, but for those of folders and threads."""
        with open(path) as f:
            text = f.read()
        if path.endswith(".json"):
            found = json.loads(text)
        else:
            import yaml

            found = yaml.safe_load(text)
        names = {x.name for x in fields(cls)}
        unknown = {k for k in found if k not in names and not k.endswith(("_path", "_dir", "_table", "_prefix", "threads", "n_jobs_cv"))}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return cls(**{k: v for k, v in found.items() if k in names})
