"""Generated panels of fixed size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Fixed values of the calendar study: days a year, years, what December adds to the load, how much milder the last one is.
DAYS, YEARS, BUMP, MILD = 365, 3, 12.0, 9.0
#: December's first day, days a month; the temperature's mean, swing, coldest day, and the deviation and memory of its noise; the load at 0
#: degrees, what a degree takes from it, and the deviation of its noise.
DECEMBER, MONTH, MEAN, SWING, COLDEST, STIR, MEMORY, LOAD, PER_DEGREE, LOAD_NOISE = 335, 30.44, 15, 10, 15, 2.2, 0.8, 100, 2, 1.5


def calendar_days(spark: SparkSession, seed: int = 2026) -> DataFrame:
    """One series of daily loads: (series, index, month 0..11, december, is_test, temp, sin_season, cos_season, load).

    The load falls with the temperature, which has a season and a lasting noise, and rises in December. The last December, unusually mild,
    is the test. The size is fixed: DAYS * YEARS rows.
    """
    g, t = np.random.default_rng(seed), np.arange(DAYS * YEARS)
    day = t % DAYS + 1
    angle = 2 * np.pi * day / DAYS
    december = day >= DECEMBER
    test = december & (t >= DAYS * (YEARS - 1))
    noise = np.convolve(g.normal(0, STIR, len(t)), MEMORY ** np.arange(80))[: len(t)]
    temp = MEAN - SWING * np.cos(angle - 2 * np.pi * COLDEST / DAYS) + noise + MILD * test
    load = LOAD - PER_DEGREE * temp + BUMP * december + g.normal(0, LOAD_NOISE, len(t))
    month = np.minimum(np.floor((day - 1) / MONTH), 11).astype(np.int32)
    frame = pd.DataFrame({"series": "T1", "index": t, "month": month, "december": december, "is_test": test, "temp": temp, "sin_season": np.sin(angle), "cos_season": np.cos(angle), "load": load})
    return spark.createDataFrame(frame, "series string, index long, month int, december boolean, is_test boolean, temp double, sin_season double, cos_season double, load double")


#: Fixed values of the synthetic panel: values a series, days a week; for each kind of series how many there are, the offset of their seeds, the weight of the
#: value before, and the deviation of the noise. The kinds have a wave of own size and phase; a pattern of weekdays; a trend with a small wave; nothing.
LENGTH, WEEK = 280, 7
KINDS = {"A": (80, 1000, 0.3, 0.3), "B": (60, 2000, 0.5, 0.3), "C": (40, 3000, 0.7, 0.3), "D": (20, 4000, 0.6, 1.0)}


def _drive(kind: str, g: np.random.Generator, t: np.ndarray) -> np.ndarray:
    """What moves a series of a kind besides its past and noise; the draws it needs come before those of the noise."""
    wave = lambda size, phase=0.0: size * np.sin(2 * np.pi * t / WEEK + phase)
    if kind == "A":
        size = 1.0 + 0.3 * g.normal()
        return wave(size, 2 * np.pi * g.random())
    if kind == "B":
        days = g.normal(0, 1.0, WEEK)
        days = days - days.mean()
        return (days * 1.2 / (days.std() + 1e-9))[t % WEEK]
    if kind == "C":
        slope, size = 0.02 + 0.01 * g.normal(), 0.3 + 0.1 * g.normal()
        return slope * t + wave(size)
    return np.zeros(len(t))


def synthetic_panel(spark: SparkSession, seed: int = 2026) -> DataFrame:
    """(series, index, y, season_index) of 200 seeded series, each made in a task."""
    rows = [(k, i, seed + offset + i) for k, (n, offset, *_) in KINDS.items() for i in range(n)]
    tasks = spark.createDataFrame(rows, "kind string, i int, seed long").repartition(8, "kind", "i")

    def run(batches):
        t = np.arange(LENGTH)
        for b in batches:
            for r in b.itertuples():
                *_, memory, noise = KINDS[r.kind]
                g = np.random.default_rng(r.seed)
                moved = _drive(r.kind, g, t) + g.normal(0, noise, LENGTH)
                y = np.empty(LENGTH)
                y[0] = g.normal(0, noise)
                for k in range(1, LENGTH):
                    y[k] = memory * y[k - 1] + moved[k]
                yield pd.DataFrame({"series": f"{r.kind}_{r.i:03d}", "index": t.astype(np.int64), "y": y, "season_index": (t % WEEK).astype(np.int64)})

    return tasks.mapInPandas(run, "series string, index long, y double, season_index long")
