"""Trees, forests and boosting on DataFrames, against the array tier and by scale; stored tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.operators import design, kernel, tree
from loomcast.operators.estimators import BoostedModel, ForestModel, PanelData, TreeModel
from loomcast.sources import tables


@pytest.fixture(scope="module")
def rows(spark):
    g = np.random.default_rng(3)
    data = [(f"s{s}", i, float(10 + s + 3 * np.sin(i / 3 + s) + g.normal())) for s in range(6) for i in range(60)]
    panel = spark.createDataFrame(data, "series string, index long, y double")
    return PanelData(3, 3, 1).transform(panel).cache()


SETTING = {"max_depth": 1, "min_leaf": 5, "bins": 16, "objective_weights": (1.0, 0.5)}


def test_boosted_stumps_are_the_same_in_both_tiers(rows):
    """At depth one the bins of a node are the global ones: the same trees, losses and stop."""
    scales = rows.select("series").distinct().withColumn("scale", F.lit(2.0))
    for metric, s in (("mse", None), ("mase", scales)):
        a, b = (BoostedModel(PanelData(3, 3, 1), **SETTING, n_estimators=12, rate=0.3, bagging_fraction=1.0, feature_fraction=1.0, eval_k=8, patience=3, metric=metric, tier=t).fit(rows, s) for t in ("arrays", "cluster"))
        assert np.allclose(a.get_loss(), b.get_loss()) and len(a.model.trees) == len(b.model.trees)
        assert [(t.feature.tolist(), np.round(t.threshold, 9).tolist(), t.n.tolist()) for t in a.model.trees] == [(t.feature.tolist(), np.round(t.threshold, 9).tolist(), t.n.tolist()) for t in b.model.trees]


def test_forest_on_the_cluster(rows):
    f = ForestModel(PanelData(3, 3, 1), max_depth=4, bins=16, objective_weights=(1.0, 0.5), n_estimators=6, bagging_fraction=0.7, feature_fraction=0.5, tier="cluster", keep_loss=True).fit(rows)
    n = rows.count()
    assert len({t.n[0] for t in f.trees}) > 1 and all(0.55 * n < t.n[0] < 0.85 * n for t in f.trees)
    assert len({t.feature[0] for t in f.trees}) > 1 and all((t.n[t.feature < 0] >= 5).all() and t.depth.max() <= 4 for t in f.trees)
    again = ForestModel(PanelData(3, 3, 1), max_depth=4, bins=16, objective_weights=(1.0, 0.5), n_estimators=6, bagging_fraction=0.7, feature_fraction=0.5, tier="cluster").fit(rows.repartition(7))
    assert [t.feature.tolist() for t in f.trees] == [t.feature.tolist() for t in again.trees]
    one = TreeModel(PanelData(3, 3, 1), max_depth=1, bins=16, objective_weights=(1.0, 0.5)).fit(rows)
    assert sum(r.mse for r in f.get_loss().collect()) < sum(r.mse for r in one.score(one.predict(rows)).collect()) and f.get_pred_df().count() == n
    with pytest.raises(RuntimeError):
        again.get_loss()


def test_tree_of_the_cluster_walks_as_its_nodes_say(rows):
    """The counts that the winners give are those of the rows that fall into the nodes."""
    t = TreeModel(PanelData(3, 3, 1), max_depth=5, bins=16, objective_weights=(1.0, 0.5)).fit(rows)
    leaves = {r.node_id: r for r in t.predict(rows, leaf_id=True).groupBy("node_id").agg(F.count("*").alias("n"), F.avg("ahead_0").alias("m")).collect()}
    ends = {x.node_id: x for x in t.nodes if x.feature < 0}
    assert set(leaves) == set(ends) and all(leaves[i].n == x.n and abs(leaves[i].m - x.means[0]) < 1e-9 for i, x in ends.items())


def test_gain_threshold_and_weight_modes(rows):
    sizes = [len(TreeModel(PanelData(3, 3, 1), max_depth=6, bins=16, objective_weights=(1.0, 0.5), gain_threshold=g).fit(rows).nodes) for g in (0.0, 0.05, 0.9)]
    assert sizes[0] > sizes[1] > sizes[2] == 1
    for mode in ("dirichlet", "onehot"):
        a, b = (TreeModel(PanelData(3, 3, 1), max_depth=4, bins=16, objective_weights=(1.0, 0.5), weight_mode=mode, seed=s).fit(rows).nodes for s in (1, 2))
        assert [x.feature for x in a] != [x.feature for x in b] or [x.threshold for x in a] != [x.threshold for x in b]
    with pytest.raises(ValueError):
        tree.Growth(weight_mode="other")


@pytest.mark.parametrize("scale", [1e-9, 1e-7, 1.0, 1e9])
@pytest.mark.parametrize("how", ["score", "rank"])
def test_cuts_do_not_depend_on_the_labels_scale(rows, scale, how):
    scaled = rows.withColumns({c: F.col(c) * scale for c in rows.columns if c.startswith(("ahead", "der"))})
    shape = lambda r: [(x.feature, x.threshold, x.n) for x in TreeModel(PanelData(3, 3, 1), max_depth=3, bins=16, objective_weights=(1.0, 0.5), how=how).fit(r).nodes]
    assert shape(scaled) == shape(rows)
    x, y = np.random.default_rng(1).normal(size=(200, 3)), np.random.default_rng(2).normal(size=(200, 2))
    y[:, 0] += 2 * (x[:, 1] > 0)
    fit = lambda k: kernel.fit_tree(x, y * k, np.array([0, 1]), np.ones(2), kernel.Params(max_depth=3, how=how, group_weights=(1.0, 0.3)))
    assert fit(scale).feature.tolist() == fit(1.0).feature.tolist() and fit(scale).threshold.tolist() == fit(1.0).threshold.tolist()


def test_constant_labels_are_not_split(rows):
    flat = rows.withColumns({c: F.lit(0.1 if c.startswith("ahead") else 0.0) for c in rows.columns if c.startswith(("ahead", "der"))})
    t = kernel.fit_tree(np.random.default_rng(0).normal(size=(300, 2)), np.full((300, 1), 0.1), np.zeros(1, int), np.ones(1), kernel.Params(gain_threshold=1e-6))
    assert len(t.feature) == 1
    assert len(TreeModel(PanelData(3, 3, 1), bins=16, objective_weights=(1.0, 0.5), gain_threshold=1e-6).fit(flat).nodes) == 1


def test_forecasts_are_never_below_zero(spark):
    d = spark.createDataFrame([(-1.2, 2.0), (2.5, 1.0), (3.5, 1.0)], "x double, mean_series double")
    assert [r.x for r in design.unscale(d, ["x"]).collect()] == [0.0, 2.5, 3.5]
    assert [r.x for r in design.unscale(d, ["x"], integer=True).collect()] == [0.0, 2.0, 4.0]


def test_cached_does_not_take_a_half_written_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    (tmp_path / "t" / "_SUCCESS").unlink()
    assert tables.cached(spark, path, lambda: spark.range(5)).count() == 5
    assert tables.cached(spark, path, lambda: spark.range(7)).count() == 5


def test_a_tree_for_each_group(spark, rows):
    """As fitting each group's arrays by itself; groups without rows to learn from, and too large ones."""
    p, features, labels = kernel.Params(max_depth=3), ["lag_1", "lag_2"], ["ahead_0"]
    nodes = kernel.fit_by_group(rows, "series", ["index"], features, labels, [0], [1.0], p).toPandas()
    for s, f in rows.toPandas().groupby("series"):
        f = f.sort_values("index")
        want = kernel.fit_tree(f[features].to_numpy(), f[labels].to_numpy(), np.array([0]), np.ones(1), p, 10)
        got = nodes[nodes.series == s].sort_values("node_id")
        assert got["feature"].tolist() == want.feature.tolist() and got["n"].tolist() == want.n.tolist()
    some = rows.withColumn("own", F.col("series") != "s0")
    assert {r.series for r in kernel.fit_by_group(some, "series", ["index"], features, labels, [0], [1.0], p, train="own").select("series").distinct().collect()} == {f"s{k}" for k in range(1, 6)}
    with pytest.raises(Exception, match="grow it on the cluster"):
        kernel.fit_by_group(rows, "series", ["index"], features, labels, [0], [1.0], p, most=10).count()


def test_boosting_keeps_predictions_if_asked(rows):
    m = BoostedModel(PanelData(3, 3, 1), **SETTING, n_estimators=2, keep_loss=True).fit(rows)
    assert m.get_pred_df().count() == rows.count()
    with pytest.raises(RuntimeError):
        BoostedModel(PanelData(3, 3, 1), **SETTING, n_estimators=2).fit(rows).get_pred_df()
