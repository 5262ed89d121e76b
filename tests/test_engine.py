"""Operators on small inputs: tiers against each other, determinism, corner cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcast.functions import stats
from loomcast.operators import binning, design, kernel, tree
from loomcast.sources import tsf


def _loop_bins(v, bins):
    """Plain restatement: (bin of each sorted value)."""
    need, b, count, out = len(v) // bins, 0, 0, []
    for i, x in enumerate(v):
        if i and count >= need and b < bins - 1 and x - v[i - 1] > 1e-7:
            b, count = b + 1, 0
        out.append(b)
        count += 1
    return out


CASES = {"all_equal": [3.0] * 64, "ascending": [float(i) for i in range(64)], "ties_at_start": [0.0] * 30 + [float(i) for i in range(1, 35)], "ties_at_end": [float(i) for i in range(34)] + [99.0] * 30, "random_ties": sorted(np.random.default_rng(0).integers(0, 12, 64).astype(float).tolist())}


@pytest.mark.parametrize("name", sorted(CASES))
def test_greedy_bins(spark, name):
    v = CASES[name]
    want = {b: _loop_bins(v, 8).count(b) for b in set(_loop_bins(v, 8))}
    got = {r["bin"]: r["n"] for r in binning.greedy_bins(spark.createDataFrame([(0, x) for x in v], "p int, v double"), 8).collect()}
    assert got == want
    assert np.diff(np.append(0, kernel.greedy_bins(np.array(v), 8))).tolist() == [want[b] for b in sorted(want)]


def _data(n=240, seed=0):
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 3)), 6)
    y = np.round(np.stack([x[:, 0] > 0.2, x[:, 1] * 0.3, x[:, 0] * x[:, 2]], axis=1).astype(float) + rng.normal(0, 0.05, (n, 3)), 6)
    return x, y


def test_tiers_agree_on_the_first_cut(spark):
    x, y = _data()
    rows = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "f0 double, f1 double, f2 double, a double, b double, c double")
    for how in ("score", "rank"):
        nodes = tree.grow(rows, ["f0", "f1", "f2"], tree.Objective(["a", "b", "c"], [0, 1, 1], [1.0, 1.0, 1.0], [1.0, 0.5]), 1, 16, 5, how)
        t = kernel.fit_tree(x, y, np.array([0, 1, 1]), np.ones(3), kernel.Params(max_depth=1, bins=16, how=how, group_weights=(1.0, 0.5)))
        assert nodes[0].feature == t.feature[0] and abs(nodes[0].threshold - t.threshold[0]) < 1e-9
        assert [n.n for n in nodes] == t.n.tolist()


def test_least_leaf_on_ties():
    rng = np.random.default_rng(1)
    x = np.stack([np.where(rng.random(400) < 0.9, 0.0, rng.normal(size=400)), rng.normal(size=400), np.where(rng.random(400) < 0.85, 1.5, 0.0)], axis=1)
    t = kernel.fit_tree(x, rng.normal(size=(400, 4)), np.zeros(4, int), np.ones(4), kernel.Params(max_depth=12, min_leaf=7))
    assert t.n[t.feature < 0].min() >= 7 and t.n[t.feature < 0].sum() == 400


def test_forest_does_not_depend_on_partitions(spark):
    x, y = _data()
    p = kernel.Params(max_depth=5, row_share=0.8, feature_share=0.5)
    a = kernel.forest(spark, x, y, np.zeros(3, int), np.ones(3), p, 6).toPandas().sort_values(["tree_id", "node_id"])
    b = [kernel.fit_tree(x, y, np.zeros(3, int), np.ones(3), p, s) for s in kernel.tree_seeds(10, 6)]
    assert a["feature"].tolist() == [f for t in b for f in t.feature.tolist()]


def test_boosting_stops_and_skips_zero_scales():
    x, y = _data()
    ev = np.arange(240) % 6 == 0
    scales = np.ones(240)
    scales[:60] = 0
    m = kernel.boost(x, y, np.zeros(3, int), np.ones(3), kernel.Params(max_depth=3), rounds=80, rate=0.3, eval_rows=ev, patience=5, metric="mase", scales=scales)
    assert np.isfinite(m.history).all() and len(m.history) < 80 and len(m.trees) == int(np.argmin(m.history)) + 2
    with pytest.raises(ValueError):
        kernel.boost(x, y, np.zeros(3, int), np.ones(3), kernel.Params(), eval_rows=np.zeros(240, bool))


def test_weight_modes_are_repeatable():
    x, y = _data()
    g = np.array([0, 1, 1])
    fixed = kernel.fit_tree(x, y, g, np.ones(3), kernel.Params(group_weights=(1.0, 0.5)), 3)
    for mode in ("dirichlet", "onehot"):
        a, b = (kernel.fit_tree(x, y, g, np.ones(3), kernel.Params(weight_mode=mode), 3) for _ in range(2))
        assert a.threshold.tolist() == b.threshold.tolist() != fixed.threshold.tolist()
    with pytest.raises(ValueError):
        kernel.Params(how="best")


def test_seasonal_scale_drops_the_whole_horizon(spark):
    rows = [("a", i, float(np.sin(2 * np.pi * i / 12)) + (10.0 if i >= 88 else 0.0)) for i in range(100)]
    p = spark.createDataFrame(rows, "series string, index long, y double")

    assert design.seasonal_scale(p, 12, 12, fallback=False).first()["scale"] < 1e-9
    assert design.seasonal_scale(p, 0, 12, fallback=False).first()["scale"] > 1


def test_rounding_is_half_to_even(spark):
    rows = spark.createDataFrame([("a", 2.5, 1.0), ("a", -3.0, 1.0)], "series string, p double, mean_series double")
    assert sorted(r["p"] for r in design.unscale(rows, ["p"], integer=True).collect()) == [0.0, 2.0]


def test_tsf(spark, tmp_path):
    f = tmp_path / "a.tsf"
    f.write_text("# c\n@attribute series_name string\n@frequency monthly\n@horizon 6\n@missing yes\n@data\nT1:1,?,3\nT2:4.5\n")
    rows, meta = tsf.read_tsf(spark, str(f))
    assert meta["horizon"] == 6 and meta["missing"] is True
    assert {r["series_name"]: r["series_value"] for r in rows.collect()} == {"T1": [1.0, None, 3.0], "T2": [4.5]}
    for bad in ("@frequency monthly\n@data\nT1:1\n", "@attribute a string\nT1:1\n", "@attribute a blob\n@data\nT1:1\n"):
        f.write_text(bad)
        with pytest.raises(ValueError):
            tsf.read_tsf(spark, str(f))


def test_sign_test():
    assert stats.sign_test(12, 12) == 1.0 and stats.sign_test(0, 10) == pytest.approx(2 / 1024)


def test_empty_panel(spark):
    from loomcast.sources.panels import dense_panel

    empty = spark.createDataFrame([], "s string, t timestamp_ntz, v double")
    assert dense_panel(empty, "s", "t", "v", "day").count() == 0
    assert design.cv_folds(spark.createDataFrame([("a", 0, 1.0)], "series string, index long, y double"), 3, 2).count() == 0
    assert F is not None


@pytest.mark.parametrize("name", sorted(CASES))
def test_ranged_bins_equal_folded_ones(spark, name):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(0, x) for x in CASES[name]] + [(1, float(x)) for x in np.round(rng.normal(size=300), 2)] + [(2, 5.0), (2, 5.0 + 5e-8), (2, 6.0), (1, None)], "p int, v double")
    folded, ranged = (sorted(map(tuple, binning.greedy_bins(rows, 8, fold_limit=k).collect())) for k in (10_000, 0))
    assert folded == ranged


def test_bins_of_nothing(spark):
    empty = spark.createDataFrame([(0, None)], "p int, v double")
    assert binning.greedy_bins(empty, 8).count() == 0
    assert binning.greedy_bins(empty, 8, fold_limit=-1).count() == 0


def test_walked_levels_equal_nested_cases(spark):
    """Rows found by walking down the tables of splits are those that nested cases give, level by level."""
    x, y = _data()
    rows = spark.createDataFrame([(*map(float, a), *map(float, b)) for a, b in zip(x, y, strict=True)], "f0 double, f1 double, f2 double, a double, b double, c double")
    objective = tree.Objective(["a", "b", "c"], [0, 1, 1], [1.0, 1.0, 1.0], [1.0, 0.5])
    nodes = tree.grow(rows, ["f0", "f1", "f2"], objective, 4, 16, 5)
    for depth in range(5):
        found = {r.node: (r["count"], r["avg(a)"]) for r in rows.groupBy(tree.leaf(nodes, ["f0", "f1", "f2"], depth).alias("node")).agg(F.count("*").alias("count"), F.avg("a")).collect()}
        ends = {n.node_id: n for n in nodes if n.depth == depth or (n.depth < depth and n.feature < 0)}
        assert set(found) == set(ends) and all(found[i][0] == n.n and abs(found[i][1] - n.means[0]) < 1e-9 for i, n in ends.items())
    assert max(n.depth for n in nodes) == 4


def test_features_that_part_rows_alike_tie():
    """The first feature wins, in whatever order the others have the rows on either side."""
    for how in ("score", "rank"):
        for seed in range(50):
            rng = np.random.default_rng(seed)
            x = np.stack([np.concatenate([rng.permutation(5), 5 + rng.permutation(5)]) for _ in range(4)], axis=1).astype(float)
            y = np.round(1 + 0.003 * rng.normal(size=(10, 3)), 6)
            t = kernel.fit_tree(x, y, np.array([0, 0, 1]), np.ones(3), kernel.Params(max_depth=1, how=how, group_weights=(1.0, 0.5)))
            assert t.feature[0] == 0
