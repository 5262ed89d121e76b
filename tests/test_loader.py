"""Collections with calendars, covariates and missing values; run settings; draws; small operators that SQL does not reach."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import metrics, stats
from loomcast.operators import binning, kernel
from loomcast.operators.estimators import PanelData
from loomcast.sources import loader, tables, tsf


def _collection(tmp_path, lines, frequency="monthly"):
    head = ["@attribute series_name string", "@attribute start_timestamp date", *[f"@frequency {frequency}"] * bool(frequency), "@horizon 2", "@missing true", "@equallength false", "@data"]
    (tmp_path / "c.tsf").write_text("\n".join([*head, *lines]) + "\n")
    return str(tmp_path / "c.tsf")


def test_months_keep_the_end_of_the_month_and_covariates_join_by_id(spark, tmp_path):
    path = _collection(tmp_path, ["T_1:2020-01-31 00-00-00:1,2,?,4", "T_2:2020-02-29 00-00-00:5,6", "R_1:2020-01-31 00-00-00:10,20,30", "P_2:2020-02-29 00-00-00:7,8"])
    panel, short, seasons, horizon, types = loader.load_panel(spark, path)
    assert (short, seasons, horizon, types) == ("1M", (12,), 2, ["P", "R"])
    got = {(r.series, r["index"]): r for r in panel.collect()}
    assert [got["T_1", i].timestamp for i in range(4)] == [datetime.datetime(2020, m, d) for m, d in ((1, 31), (2, 29), (3, 31), (4, 30))]
    assert [got["T_1", i].R for i in range(4)] == [10, 20, 30, None] and got["T_1", 2].y is None and got["T_1", 0].P is None and got["T_2", 1].P == 8
    # times of all series in order: 31 January, 29 February (of both), 29 March, 31 March, 30 April
    assert [got["T_1", i].season_index for i in range(4)] == [0, 1, 3, 4] and [got["T_2", i].season_index for i in range(2)] == [1, 2]


@pytest.mark.parametrize("frequency,last", [("minutely", "2020-01-01 00:02"), ("10_minutes", "2020-01-01 00:20"), ("half_hourly", "2020-01-01 01:00"), ("hourly", "2020-01-01 02:00"), ("daily", "2020-01-03 00:00"),
                                            ("weekly", "2020-01-15 00:00"), ("monthly", "2020-03-01 00:00"), ("quarterly", "2020-07-01 00:00"), ("yearly", "2022-01-01 00:00"), (None, "2020-01-01 00:02")])
def test_every_frequency(spark, tmp_path, frequency, last):
    panel, *_, types = loader.load_panel(spark, _collection(tmp_path, ["a:2020-01-01 00-00-00:1,2,3"], frequency))
    assert panel.agg(F.max("timestamp")).first()[0] == datetime.datetime.strptime(last, "%Y-%m-%d %H:%M") and types == []


def test_ignored_times_and_compact_values(spark, tmp_path):
    path = _collection(tmp_path, ["x:2020-01-01 00-00-00:1,?,3"], "yearly")
    assert loader.load_panel(spark, path, ignore_timestamp=True)[1:3] == ("1Y", (1,))
    table, _ = tsf.read_tsf(spark, path)
    assert [r.y for r in loader.long_frame(table, "yearly", compact=True).orderBy("ds").collect()] == [1.0, 3.0]
    assert loader.long_frame(table, "yearly").count() == 3
    with pytest.raises(ValueError):
        loader.after(F.lit(None), F.lit(1), "fortnights")


def test_settings(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"seed": 3, "decay_set": [1.0], "data_path": "x", "nthreads": 4}))
    c = loader.RunConfig.load(str(tmp_path / "a.json"))
    assert (c.seed, c.decay_set, c.nfolds) == (3, [1.0], 5) and c.depths == list(range(4, 41, 4))
    (tmp_path / "b.json").write_text(json.dumps({"sede": 3}))
    with pytest.raises(ValueError, match="sede"):
        loader.RunConfig.load(str(tmp_path / "b.json"))


def test_draws_of_the_twister():
    """The ten-thousandth number of the generator's default seed is published; a draw has no repetition and follows the shuffle's steps."""
    t = np.random.MT19937()
    t._legacy_seeding(5489)
    assert int(t.random_raw(10_000)[-1]) == 4123659995
    t._legacy_seeding(7)
    want, pool = [], list(range(6))
    for i in range(6):
        j = i + int(t.random_raw()) % (6 - i)
        pool[i], pool[j] = pool[j], pool[i]
        want.append(pool[i])
    assert kernel.drawn_features(7, 6, 6) == [want] and sorted(want) == list(range(6))
    assert all(len(set(d)) == 3 for d in kernel.drawn_features(1, 8, 3, 20))


def test_more_derivatives_than_steps(spark):
    d = PanelData(1, 2, 2)
    assert d.steps == 4 and d.derivative_names == ["der_1_ahead_1", "der_1_ahead_2", "der_1_ahead_3", "der_2_ahead_2", "der_2_ahead_3"]
    rows = d.transform(spark.createDataFrame([("s", i, float(i**3)) for i in range(9)], "series string, index long, y double"))
    r = rows.where("index = 1").first()
    assert (r.lag_1, r.ahead_0, r.ahead_1, r.der_1_ahead_3, r.der_2_ahead_3) == (0.0, 1.0, 8.0, 64.0 - 27, 64.0 - 2 * 27 + 8) and "ahead_2" not in rows.columns
    assert len(d.weights(0.5)) == len(d.labels)


def test_report_of_incomplete_methods(spark):
    rows = [("a", "s", h, 1.0, -2.0) for h in (1, 2)] + [("b", "s", 1, 1.0, 1.0)]
    got = metrics.report(spark.createDataFrame(rows, "method string, series string, h int, actual double, pred double"), spark.createDataFrame([("s", 0.5)], "series string, scale double"), ["a", "b", "c"], 2).collect()
    values = {(r.method, r.type, r.agg): r.value for r in got}
    assert values["a", "MASE", "mean"] == 2.0 and values["a", "RMSE", "median"] == 1.0  # a forecast below 0 counts as 0
    assert all(v is None for (m, *_), v in values.items() if m in "bc") and len(got) == 18


def test_bins_of_a_constant_and_bands(spark):
    got = binning.equal_width_edges(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 0.0), ("b", 3.0)], "p string, v double"), 3).collect()
    assert {(r.p, r.bin, r.bin_min, r.bin_max, r.n) for r in got} == {("a", 0, 1.0, 1.0, 2), ("b", 0, 0.0, 0.0, 1), ("b", 1, 0.0, 0.0, 0), ("b", 2, 3.0, 3.0, 1)}
    ranks = spark.createDataFrame([("x", 1.1), ("y", 2.0), ("z", 2.9)], "method string, mean_rank double")
    assert {r.method for r in stats.band(ranks, 24).collect() if r.in_band} == {"x"}
    assert {r.method for r in stats.band(ranks, 4).collect() if r.in_band} == {"x", "y"}


def test_lists_and_files_of_a_name(spark, tmp_path):
    d = spark.createDataFrame([("k", "b"), ("k", "a")], "g string, x string")
    tables.write_list(d, "x", str(tmp_path / "l"), "g")
    assert [r.value for r in spark.read.text(str(tmp_path / "l")).collect()] == ["a\tb\t"]
    tables.write_csv_file(d, str(tmp_path / "f"), "run_12.csv")
    assert [r.seed for r in tables.read_seeds(spark, f"{tmp_path}/f/*.csv", "g string, x string").collect()] == [12, 12]
