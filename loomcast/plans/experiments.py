"""Experiment queries: sweeps, variant refits, stored forecasts, comparison tables, the synthetic study."""

from __future__ import annotations

from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from loomcast.functions import metrics, stats
from loomcast.operators import design, kernel, tree
from loomcast.plans import queries as Q
from loomcast.plans.queries import H, PD, PM, S, query
from loomcast.sources import generated, tables
from loomcast.sources.loader import RunConfig
from loomcast.sources.panels import PANELS, panel

#: Group weights (derivatives, season) of the variants.
VARIANTS = {"base": (0.0, 0.0), "deriv": (0.5, 0.0), "seas": (0.0, 0.5), "both": (0.5, 0.5)}
FAMILIES = ("dt", "gbt", "rf")


@query(f"WITH {PM} SELECT series, index, y FROM pm")
def series_explode(spark, sf_dir):
    lists = panel(spark, sf_dir, "pm").groupBy("series").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", "y"))), lambda s: s["y"]).alias("v"))
    return lists.select("series", F.posexplode("v").alias("index", "y")).select("series", F.col("index").cast("long").alias("index"), "y")


@query(f"WITH RECURSIVE {Q._CUTS.replace(f'c >= {Q._LEAF} AND t - c >= {Q._LEAF}', 'c >= 1 AND t - c >= 1')} SELECT CAST(p AS INTEGER) AS p, bin, CAST(c AS BIGINT) AS n_left, round(gain_0, 5) AS gain_0 FROM cc")
def prefix_gain(spark, sf_dir):
    return Q._rounded(tree.split_candidates(Q._root(spark, sf_dir)[0], Q._objective(), 1).select("p", "bin", "n_left", "gain_0"), 5)


_DIGEST = "md5(series || ':' || CAST(index AS VARCHAR) || ':10')"


@query(f"WITH {PD} SELECT series, index, CAST(ntile(5) OVER (PARTITION BY series ORDER BY {_DIGEST}, index) - 1 AS INTEGER) AS fold FROM pd")
def kfold_by_series(spark, sf_dir):
    return design.kfold(panel(spark, sf_dir, "pd"), 5)


@query(f"WITH {PD} SELECT series, index, CAST(CAST('0x' || substr({_DIGEST}, 1, 8) AS BIGINT) % 5 AS INTEGER) AS fold FROM pd")
def kfold_plain(spark, sf_dir):
    return design.kfold(panel(spark, sf_dir, "pd"), 5, by_series=False)


# --- sweeps and refits --------------------------------------------------------------------------------------------------------------


def _weights(decay: float) -> np.ndarray:
    return np.array([*design.decay_weights(3, decay), *design.decay_weights(2, decay), 1.0, 1.0])


#: Depths that a sweep's deep trees are scored at.
_DEPTHS = [1, 2, 3, 4, 6, 8]


def _half_smape(y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    return 100 * (np.abs(pred - y) / (np.maximum(np.abs(y) + np.abs(pred) + 0.5, 0.5) / 2)).mean(axis=1)


def _sweep(key: str, cells: list[dict], error=None) -> None:
    def f(spark, sf_dir):
        frame, x, y, groups = Q._arrays(spark, sf_dir, "pd", 5, 3)
        test = frame["is_test"].to_numpy()
        return Q.shown_log(kernel.grid(spark, x, y, groups, [(np.flatnonzero(~test), np.flatnonzero(test))], cells, _DEPTHS, 3, np.ones(len(x)), kernel.Params(min_leaf=3), _weights, error=error))

    f.__name__ = key
    f.__doc__ = "Train and test errors by one parameter and depth, the others fixed."
    plain = {} if error is None else {"error": "100 * (" + " + ".join(f"abs(m_ahead_{k} - ahead_{k}) / (greatest(abs(ahead_{k}) + abs(m_ahead_{k}) + 0.5, 0.5) / 2)" for k in range(3)) + ") / 3"}
    query(Q.grid_sql("pd", 5, cells, [("r > 3", "r <= 3")], _DEPTHS, 3, **plain))(f)


# fixed values: the grids of the sweeps
_sweep("sweep_beta", [{"decay": 1.0, "lam": 0.0, "beta": b} for b in (0.0, 0.1, 0.2, 0.5, 1.0)])
_sweep("sweep_lambda", [{"decay": 1.0, "lam": a, "beta": 0.0} for a in (0.0, 0.1, 0.2, 0.5, 1.0)])
_sweep("sweep_decay", [{"decay": d, "lam": 0.2, "beta": 0.0} for d in (1.0, 0.75, 0.5, 0.25, 0.0)])
_sweep("sweep_decay_msmape", [{"decay": d, "lam": 0.2, "beta": 0.0} for d in (1.0, 0.75, 0.5, 0.25, 0.0)], _half_smape)

_FORECAST = "variant string, family string, series string, index long, h int, actual double, pred double, n_trees int"


def _settings(trees: int) -> list[tuple]:
    """(variant, family, depth, decay, lam, beta, trees) without tuning."""
    return [(v, f, {"dt": 6, "gbt": 4, "rf": 6}[f], 1.0, lam, beta, trees) for v, (lam, beta) in VARIANTS.items() for f in FAMILIES]


def refit(spark: SparkSession, sf_dir: str, name: str, lags: int, horizon: int = 3, trees: int = 24, settings: list[tuple] | None = None, patience: int = 40) -> DataFrame:
    """(variant, family, series, index, h, actual, pred, n_trees): each variant's weights in each model family, one fit a task, on the unscaled test rows.

    Boosting holds out each series' last training row and stops by its scaled error. The panel's arrays are broadcast, as this tier fits a task.
    """
    frame, x, y, groups = Q._arrays(spark, sf_dir, name, lags, horizon)
    test = frame["is_test"].to_numpy()
    own = frame.loc[test, ["series", "index", "mean_series"]]
    actual = frame.loc[test, [f"ahead_{k}" for k in range(horizon)]].to_numpy()
    scales = dict(design.seasonal_scale(panel(spark, sf_dir, name), horizon, PANELS[name][6]).collect())  # a series each, as many as the arrays have
    scale = frame["series"].map(scales).to_numpy(float) / frame["mean_series"].to_numpy()
    held = (frame[~test].groupby("series").cumcount(ascending=False) == 0).to_numpy()
    shared = spark.sparkContext.broadcast((x, y, groups, test, own["series"].tolist(), own["index"].to_numpy(), own["mean_series"].to_numpy(), actual, scale, held))
    settings = settings or _settings(trees)
    tasks = spark.createDataFrame(settings, "variant string, family string, depth int, decay double, lam double, beta double, trees int").repartition(len(settings), "variant", "family")

    def run(batches):
        x, y, groups, test, series, index, mean, actual, scale, held = shared.value
        for b in batches:
            for r in b.itertuples():
                weights = np.array([*design.decay_weights(horizon, r.decay), *design.decay_weights(horizon - 1, r.decay), 1.0, 1.0])
                p = kernel.Params(max_depth=r.depth, group_weights=(1.0, r.lam, r.beta))
                bagged = replace(p, row_share=0.8, feature_share=0.5)
                if r.family == "dt":
                    pred, n = kernel.fit_tree(x[~test], y[~test], groups, weights, p, 10).predict(x[test]), 1
                elif r.family == "gbt":
                    m = kernel.boost(x[~test], y[~test], groups, weights, bagged, rounds=r.trees, eval_rows=held, patience=patience, metric="mase", scales=scale[~test])
                    pred, n = m.predict(x[test]), len(m.trees) - 1
                else:
                    pred, n = kernel.forest_predict([kernel.fit_tree(x[~test], y[~test], groups, weights, bagged, s) for s in kernel.tree_seeds(10, r.trees)], x[test]), r.trees
                h = actual.shape[1]
                yield pd.DataFrame({"variant": r.variant, "family": r.family, "series": np.repeat(series, h), "index": np.repeat(index, h), "h": np.tile(np.arange(1, h + 1, dtype=np.int32), len(series)), "actual": (actual * mean[:, None]).ravel(), "pred": (pred[:, :h] * mean[:, None]).ravel(), "n_trees": n})

    return tasks.mapInPandas(run, _FORECAST)


_PICKED = "CASE WHEN lam = 0 AND beta = 0 THEN 'base' WHEN beta = 0 THEN 'deriv' WHEN lam = 0 THEN 'seas' ELSE 'both' END"


def tuned(spark: SparkSession, sf_dir: str, name: str, lags: int, config: RunConfig, horizon: int = 3) -> tuple[DataFrame, DataFrame]:
    """(log, picks) of the whole grid of a run's settings: rolling origins over the training rows, one deep tree a task scored at every depth.

    picks: (variant, depth, decay, lam, beta, error), the best cell of each variant; ties go to the smaller depth, decay and weights.
    """
    frame, x, y, groups = Q._arrays(spark, sf_dir, name, lags, horizon)
    r = frame.groupby("series").cumcount(ascending=False).to_numpy() - horizon  # from the end of the training rows
    folds = [(np.flatnonzero(r >= (config.nfolds - k) * horizon), np.flatnonzero((r >= 0) & (r // horizon == config.nfolds - 1 - k))) for k in range(config.nfolds)]
    folds = [(a, b) for a, b in folds if len(a) and len(b)]
    cells = [{"decay": float(d), "lam": float(a), "beta": float(b)} for d in config.decay_set for a in config.lambda_set for b in config.beta_set]
    weights = lambda d: np.array([*design.decay_weights(horizon, d), *design.decay_weights(horizon - 1, d), 1.0, 1.0])
    p = kernel.Params(config.max_depth, config.min_samples_leaf, config.n_discrete_lev, how=config.aggregation)
    log = tables.cut(kernel.grid(spark, x, y, groups, folds, cells, config.depths, horizon, np.ones(len(x)), p, weights, config.seed, kernel.squared if config.cv_metric == "rmse" else None))
    key = ["depth", "decay", "lam", "beta"]
    mean = log.groupBy(*key).agg(F.avg(F.nanvl("test_error", F.lit(None).cast("double"))).alias("error")).where("error is not null").withColumn("variant", F.expr(_PICKED))
    best = F.row_number().over(W.partitionBy("variant").orderBy("error", *key))
    return log, mean.withColumn("r", best).where("r = 1").select("variant", *key, "error")


@query()
def benchmark_tuned(spark, sf_dir, config=None):
    """The whole chain at the published settings: grid, pick, three families of up to 400 trees refitted, stored, read again and summed up."""
    config = config or RunConfig()
    log, picks = tuned(spark, sf_dir, "pm", 6, config)
    path = tables.fresh_path(spark, "tuned")
    log.write.csv(f"{path}/log", header=True)
    tables.write_json(picks, f"{path}/best")
    best = spark.read.schema("variant string, depth int, decay double, lam double, beta double, error double").json(f"{path}/best").collect()  # four rows
    settings = [(b["variant"], f, {"dt": b["depth"], "gbt": config.bdt["max_depth"], "rf": config.rf["max_depth"]}[f], b["decay"], b["lam"], b["beta"], {"dt": 1, "gbt": config.bdt["n_estimators"], "rf": config.rf["n_estimators"]}[f]) for b in best for f in FAMILIES]
    tables.store_forecasts(refit(spark, sf_dir, "pm", 6, settings=settings).withColumn("dataset", F.lit("pm")), f"{path}/forecasts")
    rows = spark.read.parquet(f"{path}/forecasts")
    out = summary(rows, design.seasonal_scale(panel(spark, sf_dir, "pm"), 3, S), ["dataset", "variant", "family"])
    return out.join(rows.groupBy("dataset", "variant", "family").agg(F.max("n_trees").alias("n_trees")), ["dataset", "variant", "family"])


def summary(forecast: DataFrame, scales: DataFrame, by: list[str]) -> DataFrame:
    """by.., {mase, msmape, rmse}_{mean, med}: errors of each forecast row, then robust means and medians."""
    a, f = F.col("actual"), F.col("pred")
    rows = forecast.groupBy(*by, "series", "index").agg(F.avg(F.abs(a - f)).alias("mae"), F.avg(metrics.msmape_term(a, f)).alias("msmape"), F.sqrt(F.avg((a - f) * (a - f))).alias("rmse"))
    rows = rows.join(scales, "series").withColumn("mase", F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale"))))
    return rows.groupBy(*by).agg(*[g(metrics.finite(F.col(m))).alias(f"{m}_{n}") for m in ("mase", "msmape", "rmse") for g, n in ((F.avg, "mean"), (F.median, "med"))])


@query()
def refit_summary(spark, sf_dir):
    return summary(refit(spark, sf_dir, "pm", 6), design.seasonal_scale(panel(spark, sf_dir, "pm"), 3, S), ["variant", "family"])


@query()
def refit_per_horizon(spark, sf_dir):
    return summary(refit(spark, sf_dir, "pm", 6), design.seasonal_scale(panel(spark, sf_dir, "pm"), 3, S), ["variant", "family", "h"])


@query()
def benchmark_run(spark, sf_dir):
    """All variants and families on two panels: fitted, stored by dataset, read again and summed up."""
    path, out = tables.fresh_path(spark, "forecasts"), []
    for name, lags, season in (("pm", 6, S), ("pd", 5, 7)):
        tables.store_forecasts(refit(spark, sf_dir, name, lags, trees=8).withColumn("dataset", F.lit(name)), path)
        rows = spark.read.parquet(path).where(F.col("dataset") == name)
        out.append(summary(rows, design.seasonal_scale(panel(spark, sf_dir, name), 3, season), ["dataset", "variant", "family"]))
    return out[0].unionByName(out[1])


@query(f"WITH {Q._ROWS} SELECT 'pm' AS dataset, round(avg(mase), 5) AS mase_mean, round(median(mase), 5) AS mase_med, round(avg(msmape), 5) AS msmape_mean, round(median(msmape), 5) AS msmape_med FROM mr")
def recompute_metrics(spark, sf_dir):
    """Metrics from stored forecasts."""
    p, path = panel(spark, sf_dir, "pm"), tables.fresh_path(spark, "forecasts")
    tables.store_forecasts(design.naive(p, H, S).withColumn("dataset", F.lit("pm")), path)
    stored = spark.read.parquet(path).withColumn("index", F.lit(0))
    return Q._rounded(summary(stored, design.seasonal_scale(p, H, S), ["dataset"]).drop("rmse_mean", "rmse_med"), 5)


@query(f"WITH {PM}, {Q._naive_sql(S)} SELECT series, {', '.join(f'max(pred) FILTER (h = {h}) AS h_{h}' for h in range(1, H + 1))} FROM fc GROUP BY series")
def wide_forecast_store(spark, sf_dir):
    """One row a series, through CSV files and back."""
    path = tables.fresh_path(spark, "wide")
    tables.wide_forecasts(design.naive(panel(spark, sf_dir, "pm"), H, S), H).write.csv(path, header=True)
    return spark.read.csv(path, header=True, schema="series string, " + ", ".join(f"h_{h} double" for h in range(1, H + 1)))


@query(f"WITH {Q._ROWS}, c AS (SELECT quantile_cont(mase, 0.99) AS top FROM mr) SELECT series, round(least(mase, top), 5) AS mase FROM mr, c")
def mase_pool(spark, sf_dir):
    """Errors of all series, clipped at their 99th percentile."""
    rows = Q._by_row(spark, sf_dir).select("series", "mase")
    top = rows.agg(F.percentile("mase", F.lit(0.99)).alias("top"))  # one number
    return rows.join(F.broadcast(top)).select("series", F.round(F.least("mase", "top"), 5).alias("mase"))


@query(f"WITH {PM}, {Q._naive_sql(1)}, n AS (SELECT series, avg(abs(actual - pred)) AS e FROM fc GROUP BY series), {Q._naive_sql(S).replace('r AS (', 'r2 AS (', 1).replace('fc AS', 'fc2 AS').replace('FROM r a JOIN r b', 'FROM r2 a JOIN r2 b')}, s AS (SELECT series, avg(abs(actual - pred)) AS e FROM fc2 GROUP BY series) SELECT CASE WHEN s.e < n.e THEN 'snaive' WHEN s.e > n.e THEN 'naive' ELSE 'tie' END AS best, count(*) AS n FROM n JOIN s USING (series) GROUP BY 1")
def baseline_wins(spark, sf_dir):
    p = panel(spark, sf_dir, "pm")
    n, s = (design.naive(p, H, k).groupBy("series").agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias(e)) for k, e in ((1, "n"), (S, "s")))
    return n.join(s, "series").groupBy(F.when(F.col("s") < F.col("n"), "snaive").when(F.col("s") > F.col("n"), "naive").otherwise("tie").alias("best")).agg(F.count("*").alias("n"))


# --- synthetic study ----------------------------------------------------------------------------------------------------------------

#: Fixed values of the study: steps ahead and lags, depth and least leaf of its trees, trees of the forest; group weights of the variants.
_AHEAD, _DEPTH, _LEAST, _TREES = 14, 10, 5, 100
_STUDY = {"multi_base": (1.0, 0.0, 0.0), "multi_deriv": (1.0, 0.5, 0.0), "multi_seas": (1.0, 0.0, 0.5), "multi_both": (1.0, 0.5, 0.5)}


def _study(spark: SparkSession, seed: int = 2026, trees: int = _TREES, plain: bool = True) -> DataFrame:
    """(method, type, mase) of each series of the generated panel (its size is fixed): a multi-target tree for each variant, a tree and a forest on
    the targets alone, and naive forecasts. A variant, and every tenth of the forest, is a task's work."""
    p = tables.cut(generated.synthetic_panel(spark, seed))
    scales = design.seasonal_scale(p, _AHEAD, generated.WEEK)
    names = [*[f"lag_{k}" for k in range(1, _AHEAD + 1)], *[f"ahead_{k}" for k in range(_AHEAD)]]
    rows = design.tail_split(design.lag_lead(design.season(p, generated.WEEK), _AHEAD, _AHEAD, keep=("sin_season", "cos_season")), _AHEAD)
    f = Q._fitting(rows).sort_values(["series", "index"])
    x, y = f[names[:_AHEAD]].to_numpy(), f[names[_AHEAD:]].to_numpy()
    full = np.concatenate([y, np.diff(y, axis=1), f[["sin_season", "cos_season"]].to_numpy()], axis=1)
    last = f.groupby("series").cumcount(ascending=False).to_numpy() == 0
    shared = spark.sparkContext.broadcast((x, full, f["is_test"].to_numpy(), last, f["series"].to_numpy()[last].tolist()))
    groups = np.array([0] * _AHEAD + [1] * (_AHEAD - 1) + [2, 2])
    seeds = kernel.tree_seeds(0, trees)

    def run(batches):
        x, full, test, last, series = shared.value
        y = full[:, :_AHEAD]
        for b in batches:
            for r in b.itertuples():
                base = kernel.Params(max_depth=_DEPTH, min_leaf=_LEAST)
                if r.method in _STUDY:
                    found = [kernel.fit_tree(x[~test], full[~test], groups, np.ones(len(groups)), replace(base, group_weights=_STUDY[r.method]))]
                elif r.method == "tree":
                    found = [kernel.fit_tree(x[~test], y[~test], groups[:_AHEAD], np.ones(_AHEAD), base)]
                else:
                    found = [kernel.fit_tree(x[~test], y[~test], groups[:_AHEAD], np.ones(_AHEAD), replace(base, feature_share=0.5), s) for s in seeds[r.part::10]]
                if found:
                    pred = sum(t.predict(x[last])[:, :_AHEAD] for t in found)
                    yield pd.DataFrame({"method": r.method, "series": np.repeat(series, _AHEAD), "h": np.tile(np.arange(1, _AHEAD + 1), len(series)), "actual": y[last].ravel(), "pred": pred.ravel(), "n": len(found)})

    schema = "method string, series string, h int, actual double, pred double, n int"
    tasks = [(m, 0) for m in _STUDY] + ([("tree", 0), *[("forest", k) for k in range(10)]] if plain else [])
    fitted = spark.createDataFrame(tasks, "method string, part int").repartition(len(tasks), "method", "part").mapInPandas(run, schema)
    every = fitted.groupBy("method", "series", "h").agg(F.first("actual").alias("actual"), (F.sum("pred") / F.sum("n")).alias("pred")).drop("h")
    for m, s in (("naive", 1), ("snaive", generated.WEEK)) if plain else ():
        every = every.unionByName(design.naive(p, _AHEAD, s).select(F.lit(m).alias("method"), "series", "actual", "pred"))
    errors = every.groupBy("method", "series").agg(F.avg(F.abs(F.col("actual") - F.col("pred"))).alias("mae")).join(scales, "series")
    return errors.select("method", F.substring_index("series", "_", 1).alias("type"), F.try_divide("mae", F.when(F.col("scale") > 0, F.col("scale"))).alias("mase"))


@query()
def synthetic_study(spark, sf_dir):
    """Mean and median errors by method and type, and over all types, with the percentage to the plain tree's median."""
    out = _study(spark).cube("method", "type").agg(F.count("*").alias("n_series"), F.avg("mase").alias("mean_mase"), F.median("mase").alias("median_mase")).where("method is not null").withColumn("type", F.coalesce("type", F.lit("ALL")))
    out = tables.cut(out)
    base = out.where("method = 'multi_base'").select("type", F.col("median_mase").alias("b"))
    return out.join(F.broadcast(base), "type").select("method", "type", "n_series", "mean_mase", "median_mase", (F.try_divide(F.col("median_mase") - F.col("b"), "b") * 100).alias("rel_pct"))


@query()
def synthetic_aggregate(spark, sf_dir, seeds=(2026, 2027, 2028)):
    """Medians of several seeds, a file each, relative to the base; and the bootstrap interval of their mean."""
    path = tables.fresh_path(spark, "seeds")
    for seed in seeds:
        rows = _study(spark, seed, plain=False).groupBy("method").agg(F.median("mase").alias("value"))
        tables.write_csv_file(rows, path, f"study_{seed}.csv")
    rows = tables.read_seeds(spark, f"{path}/*.csv", "method string, value double").select(F.col("seed").cast("string").alias("dataset"), "method", "value")
    return stats.bootstrap_mean(stats.relative_to_base(rows, "multi_base"), "method", "rel_pct", 10_000)


# --- calendar study -----------------------------------------------------------------------------------------------------------------


def _calendar(spark: SparkSession) -> DataFrame:
    """The generated days with ``variant``, the leaf (node_id) and the forecast of a tree without and of one with seasonal objectives."""
    days, labels, out = tables.cut(generated.calendar_days(spark)), ["load", "sin_season", "cos_season"], None
    for variant, beta in (("base", 0.0), ("seas", 0.5)):
        objective = tree.Objective(labels, [0, 1, 1], [1.0, 1.0, 1.0], [1.0, beta])
        features = ["temp", "sin_season", "cos_season"]
        nodes = tree.grow(days.where("not is_test"), features, objective, 6, 32, 5)
        rows = tree.predict(days, nodes, features).withColumns({"variant": F.lit(variant), "pred": F.col("pred")[0]})
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def calendar_leaves(spark, sf_dir):
    """Share of each month in each leaf, over the training days."""
    rows = _calendar(spark).where("not is_test").groupBy("variant", "node_id", "month").agg(F.count("*").alias("n"))
    return rows.select("variant", "node_id", "month", "n", (F.col("n") / F.sum("n").over(W.partitionBy("variant", "node_id"))).alias("share"))


@query()
def calendar_stats(spark, sf_dir):
    """By variant: purity of the leaves, and what part of December's rise the forecasts of the mild test days have."""
    rows = tables.cut(_calendar(spark))
    leaf = rows.where("not is_test").groupBy("variant", "node_id").agg(F.count("*").alias("n"), F.count_if("december").alias("d"), F.count_distinct("month").alias("months"), (F.var_pop("sin_season") + F.var_pop("cos_season")).alias("v"))
    leaf = leaf.groupBy("variant").agg(F.count("*").alias("leaves"), F.max(F.col("d") / F.col("n")).alias("december_purity"), (F.max("d") / F.sum("d")).alias("december_modal_share"), F.avg("months").alias("months"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("dispersion"))
    test = rows.where("is_test").groupBy("variant").agg(F.avg("load").alias("actual"), F.avg("pred").alias("pred"), F.avg((F.col("pred") - 100 + 2 * F.col("temp")) / generated.BUMP).alias("captured"))
    return leaf.join(F.broadcast(test), "variant")  # two rows
