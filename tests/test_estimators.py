"""The estimators on a small seasonal panel with a fixed seed."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast import BoostedModel, ForestModel, PanelData, TreeModel
from loomcast.functions import metrics
from loomcast.operators import design, kernel
from loomcast.sources import generated, tables

DATA = PanelData(lags=6, horizon=4, n_derivative=1, season_length=7, penalties=("sin_season", "cos_season"))
WEIGHTS = (1.0, 0.5, 0.2)


@pytest.fixture(scope="module")
def rows(spark):
    rng, t = np.random.default_rng(0), np.arange(60)
    panel = [(f"s{s}", int(i), float(v), int(i)) for s in range(6) for i, v in enumerate((1 + 0.3 * rng.normal()) * np.sin(2 * np.pi * t / 7) + 0.05 * rng.normal(size=60))]
    return design.tail_split(DATA.transform(spark.createDataFrame(panel, "series string, index long, y double, season_index long")), 4).persist()


def _mse(model, rows):
    return model.score(model.predict(rows)).agg(F.avg("mse")).first()[0]


def test_labels_and_groups():
    assert len(DATA.labels) == 4 + 3 + 2 and DATA.groups == [0] * 4 + [1] * 3 + [2] * 2 and len(DATA.weights(0.5)) == 9
    assert PanelData(2, 2, penalties=("x",)).groups == [0, 0, 1]


def test_models_learn_and_repeat(rows):
    train, test = rows.where("not is_test"), rows.where("is_test")
    flat = test.agg(F.avg(F.col("ahead_0") ** 2)).first()[0]
    for make in (lambda: TreeModel(DATA, 0.5, WEIGHTS, max_depth=4), lambda: BoostedModel(DATA, 0.5, WEIGHTS, n_estimators=60, rate=0.2, eval_k=4), lambda: ForestModel(DATA, 0.5, WEIGHTS, n_estimators=8, bagging_fraction=0.8, feature_fraction=0.5)):
        a, b = (_mse(make().fit(train), test) for _ in range(2))
        assert a == pytest.approx(b, abs=1e-12) and a < 0.5 * flat


def test_depth_cap_and_leaf_ids(rows):
    m = TreeModel(DATA, None, WEIGHTS, max_depth=3).fit(rows)
    assert m.predict(rows, depth=0, leaf_id=True).select("node_id").distinct().count() == 1
    assert m.predict(rows, leaf_id=True).select("node_id").distinct().count() == sum(n.threshold is None for n in m.nodes)


def test_refusals(rows):
    for wrong in (lambda: PanelData(0, 1), lambda: PanelData(1, 2, -1), lambda: PanelData(1, 1, penalties=("sin_season",)), lambda: TreeModel(DATA, 1.0, (1.0,)), lambda: TreeModel(DATA, 1.0, WEIGHTS, how="other"), lambda: ForestModel(DATA, 1.0, WEIGHTS).fit(rows.limit(0))):
        with pytest.raises(ValueError):
            wrong()
    for model in (TreeModel(DATA, 1.0, WEIGHTS), BoostedModel(DATA, 1.0, WEIGHTS), ForestModel(DATA, 1.0, WEIGHTS)):
        with pytest.raises(RuntimeError):
            model.predict(rows)
    with pytest.raises(RuntimeError):
        BoostedModel(DATA, 1.0, WEIGHTS).get_loss()


def test_inference_rows(spark):
    panel = spark.createDataFrame([("a", i, float(i), i) for i in range(10)], "series string, index long, y double, season_index long")
    got = PanelData(3, 4).transform(panel, inference=True)
    assert got.columns == ["series", "index", "lag_1", "lag_2", "lag_3"] and got.count() == 7


def test_kfold(spark):
    rows = spark.createDataFrame([(s, i) for s in "ab" for i in range(20)], "series string, index long")
    for by_series in (True, False):
        folds = design.kfold(rows, 4, by_series=by_series).collect()
        assert len(folds) == 40 and {r["fold"] for r in folds} == {0, 1, 2, 3}
    assert {r["count"] for r in design.kfold(rows, 4).groupBy("series", "fold").count().collect()} == {5}


def test_stored_tables(spark, tmp_path):
    (tmp_path / "m.txt").write_text("1 2  3\n4 5 6\n")
    assert [tuple(r) for r in tables.read_matrix(spark, str(tmp_path / "m.txt")).orderBy("series", "h").collect()][2:4] == [("T1", 3, 3.0), ("T2", 1, 4.0)]
    for s in (2026, 2027):
        (tmp_path / f"per_seed_{s}.csv").write_text("method,value\na,1.5\n")
    (tmp_path / "per_seed_all.csv").write_text("method,value\na,9\n")
    assert {tuple(r) for r in tables.read_seeds(spark, str(tmp_path / "per_seed_*.csv"), "method string, value double").collect()} == {("a", 1.5, 2026), ("a", 1.5, 2027)}
    tasks, log = spark.createDataFrame([("x", 1), ("y", 2)], "k string, v int"), str(tmp_path / "log")
    assert tables.pending(tasks, log, ["k"]).count() == 2
    tasks.limit(1).write.parquet(log)
    assert tables.pending(tasks, log, ["k"]).count() == 1
    made = []
    for _ in range(2):
        tables.cached(spark, str(tmp_path / "c"), lambda: made.append(1) or tasks).count()
    assert made == [1]


def test_fit_on_positions_is_that_of_copied_rows():
    g = np.random.default_rng(3)
    x, y, at = g.normal(size=(200, 4)), g.normal(size=(200, 3)), np.sort(g.permutation(200)[:120])
    groups, weights, p = np.array([0, 0, 1]), np.ones(3), kernel.Params(4, 3, 8, 0.7, 0.5, group_weights=(1.0, 0.3))
    a, b = kernel.fit_tree(x, y, groups, weights, p, 5, at), kernel.fit_tree(x[at], y[at], groups, weights, p, 5)
    assert all(np.array_equal(getattr(a, f), getattr(b, f)) for f in ("feature", "threshold", "left", "right", "n", "depth", "means"))


@pytest.mark.parametrize("cv", ["time", "series", "plain"])
def test_tune_penalties(rows, cv):
    m = TreeModel(DATA, 1.0, WEIGHTS, max_depth=3)
    best, log, summary = m.tune_penalties(rows, (0.0, 1.0), (0.0, 0.5), (0.2,), folds=3, depths=[1, 3], cv=cv)
    assert log.count() == 3 * 2 * 4 and summary.count() == 2 * 4
    low = summary.orderBy("test_error", "depth", "decay", "lam", "beta").first()
    assert best == {"depth": low.depth, "decay": low.decay, "objective_weights": (1.0, low.lam, low.beta)}
    again = m.tune_penalties(rows, (0.0, 1.0), (0.0, 0.5), (0.2,), folds=3, depths=[1, 3], cv=cv)
    assert again[0] == best and sorted(map(tuple, again[1].collect())) == sorted(map(tuple, log.collect()))


def test_tune_penalties_errors_and_refusals(rows, spark):
    m = TreeModel(DATA, 1.0, WEIGHTS, max_depth=2)
    scales = spark.createDataFrame([(f"s{i}", 2.0 if i else 0.0) for i in range(6)], "series string, scale double")
    one, two = (m.tune_penalties(rows, (1.0,), (0.2,), (0.2,), folds=2, cv="series", error=kernel.squared, scales=s)[2].first() for s in (None, scales))
    assert 0 < two.test_error < one.test_error  # the series without a scale is left out
    short = rows.where("index < 11")  # too short for rolling origins
    assert m.tune_penalties(short, (1.0,), (0.2,), (0.2,), folds=5)[1].count() == 5
    for wrong in (lambda: m.tune_penalties(rows, cv="other"), lambda: m.tune_penalties(rows.union(rows))):
        with pytest.raises(ValueError):
            wrong()


def test_boosting_stops_by_mase_and_refits(rows, spark):
    scales = spark.createDataFrame([(f"s{i}", float(i)) for i in range(5)], "series string, scale double")  # one is 0, one is missing
    with pytest.raises(ValueError):
        BoostedModel(DATA, 0.5, WEIGHTS, eval_k=4, metric="mase").fit(rows)
    a = BoostedModel(DATA, 0.5, WEIGHTS, n_estimators=20, rate=0.2, eval_k=4, metric="mase", patience=3).fit(rows, scales)
    b = BoostedModel(DATA, 0.5, WEIGHTS, n_estimators=20, rate=0.2, eval_k=4, metric="mase", patience=3, refit_on_full=True).fit(rows, scales)
    assert np.isfinite(a.get_loss()).all() and a.get_loss() == b.get_loss() and len(a.model.trees) == len(b.model.trees)
    assert b.model.trees[0].n[0] > a.model.trees[0].n[0]


def test_mase_of_history(spark):
    history = spark.createDataFrame([(s, i, v) for s, vs in {"a": [1.0, 3.0, 2.0, 6.0], "short": [1.0, 2.0], "flat": [5.0] * 4}.items() for i, v in enumerate(vs)], "series string, index long, y double")
    forecast = spark.createDataFrame([(s, 1, 4.0, 2.0) for s in ("a", "short", "flat")], "series string, h int, actual double, pred double")
    assert {tuple(r) for r in metrics.mase_of_history(forecast, history, 2).collect()} == {("a", 1.0), ("short", 2.0), ("flat", None)}


def test_calendar_days(spark):
    f = generated.calendar_days(spark).toPandas()
    assert len(f) == 1095 and f["is_test"].sum() == 31 and set(f["month"]) == set(range(12))
    rise = f["load"] - (100 - 2 * f["temp"])
    assert abs(rise[f["december"]].mean() - generated.BUMP) < 1 and abs(rise[~f["december"]].mean()) < 0.5
