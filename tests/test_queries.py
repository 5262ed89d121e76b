"""Every query with an SQL equivalent gives the same rows as DuckDB; the others give rows."""

import duckdb
import numpy as np
import pandas as pd
import pytest

from loomcast.plans import experiments, reports  # noqa: F401  register their queries
from loomcast.plans import queries as P

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("events", "orders", "lineitem"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def _rows(df):
    cols = sorted(df.columns)
    return sorted(map(repr, map(tuple, df[cols].astype(object).where(df[cols].notna(), None).values.tolist())))


@pytest.mark.parametrize("name", sorted(P.ORACLES))
def test_equals_sql(spark, duck, name):
    assert _rows(P.QUERIES[name](spark, SF).toPandas()) == _rows(duck.sql(P.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(P.QUERIES) - set(P.ORACLES)))
def test_gives_rows(spark, name):
    assert P.QUERIES[name](spark, SF).count() > 0


def test_iterative_methods_and_families(spark):
    got = P.QUERIES["iterative_vs_direct"](spark, SF).toPandas()
    assert {tuple(r) for r in got[["family", "method", "h"]].itertuples(index=False)} == {(f, m, h) for f in ("dt", "gbt", "rf") for m in ("direct", "iterative", "multi_iter") for h in (1, 2, 3)} and len(got) == 27
    assert (got[["mean_mase", "median_mase"]] > 0).all().all()
    first = got[got.h == 1].pivot(index="family", columns="method", values="mean_mase")
    assert np.allclose(first["direct"], first["multi_iter"])  # the first step is the same forecast


def test_roll_forward_moves_lags_and_season():
    angle, seen = 2 * np.pi * 5 / 12, []
    x = np.array([[3.0, 2.0, np.sin(angle), np.cos(angle)]])
    out = P._rolled(lambda s: (seen.append(s.copy()), s[:, :1] + 1)[1], x, 2, 3, 12)
    assert out.tolist() == [[4.0, 5.0, 6.0]] and seen[2][0, :2].tolist() == [5.0, 4.0]
    assert np.allclose([s[0, 2:] for s in seen], [(np.sin(angle + 2 * np.pi * k / 12), np.cos(angle + 2 * np.pi * k / 12)) for k in range(3)])


def test_noise_grid(spark):
    got = P.QUERIES["noise_sensitivity"](spark, SF).toPandas()
    assert len(got) == 75 and len(got.groupby(["sigma", "lam", "seed"])) == 75
    same = got[got.sigma == 0].groupby("lam")["mean_mase"].nunique()
    assert (same == 1).all() and got[got.sigma == 3].groupby("lam")["mean_mase"].nunique().max() > 1


def _steady(path, seed, spread):
    """events and orders with a row for each series and period, whose values vary as little as sums of many rows do."""
    rng = np.random.default_rng(seed)
    c = duckdb.connect()
    for table, series, time, value, n, unit in (("events", "event_type", "ts", "value", 30, "D"), ("orders", "o_orderpriority", "o_orderdate", "o_totalprice", 80, "MS")):
        rows = pd.DataFrame({series: np.repeat(list("abcde"), n), time: np.tile(pd.date_range("2020-01-01", periods=n, freq=unit), 5), value: np.round(1e6 * (1 + spread * rng.normal(size=5 * n)), 2)})
        c.register("made", rows)
        c.execute(f"copy (select * replace (CAST({time} AS TIMESTAMP) AS {time}) from made) to '{path}/{table}.parquet' (format parquet)")
        c.unregister("made")
        c.execute(f"create view {table} as select * from '{path}/{table}.parquet'")
    return c


@pytest.mark.parametrize(("name", "seed", "spread"), [("sweep_decay_msmape", 0, 0.02), ("gain_pruned_tree", 102, 0.008)])
def test_ties_of_steady_panels_equal_sql(spark, tmp_path, name, seed, spread):
    c = _steady(tmp_path, seed, spread)
    assert _rows(P.QUERIES[name](spark, str(tmp_path)).toPandas()) == _rows(c.sql(P.ORACLES[name]).df())


def test_nodes_of_one_month_equal_sql(spark, tmp_path):
    """Months' sums that go by their days: a node has one month only, and what its season gains is rounding."""
    rng, months = np.random.default_rng(1), pd.date_range("1992-01-01", periods=80, freq="MS")
    worth = np.round(1.13e8 * np.tile(months.days_in_month, 5) / 30 * (1 + 0.004 * rng.normal(size=400)), 2)
    pd.DataFrame({"o_orderpriority": np.repeat(list("abcde"), 80), "o_orderdate": np.tile(months, 5).astype("datetime64[us]"), "o_totalprice": worth}).to_parquet(tmp_path / "orders.parquet")
    c = duckdb.connect()
    c.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    assert _rows(P.QUERIES["gain_pruned_tree"](spark, str(tmp_path)).toPandas()) == _rows(c.sql(P.ORACLES["gain_pruned_tree"]).df())
