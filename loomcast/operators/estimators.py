"""Estimators over panels in DataFrames: a supervised panel, and tree, boosting and forest models with one interface.

``PanelData`` declares lags, horizon, derivatives and penalties once. ``TreeModel`` grows on the cluster, one histogram job a level,
at any size. ``BoostedModel`` and ``ForestModel`` have two tiers: "arrays" fits in tasks, with bins of its own at each node; "cluster" grows over
DataFrames of any size, with global bins. "auto" takes arrays up to ``MAX_CELLS`` numbers. No model is fitted on the driver.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from loomcast.operators import design, kernel, tree
from loomcast.sources import tables

#: Numbers (rows x columns) that the array tier takes: 1.6 GB of doubles.
MAX_CELLS = 200_000_000


@dataclass
class PanelData:
    """What a supervised panel is made of; ``transform`` makes it out of (series, index, y[, season_index]) rows."""

    lags: int
    horizon: int
    n_derivative: int = 0
    season_length: int | None = None
    penalties: tuple[str, ...] = ()
    extra: tuple[str, ...] = ()

    def __post_init__(self):
        if self.lags < 1 or self.horizon < 1 or self.n_derivative < 0:
            raise ValueError("lags and horizon are at least 1, n_derivative at least 0")
        if self.penalties and self.season_length is None and set(self.penalties) & {"sin_season", "cos_season"}:
            raise ValueError("seasonal penalties need season_length")

    @property
    def features(self) -> list[str]:
        return [*[f"lag_{k}" for k in range(1, self.lags + 1)], *self.extra]

    @property
    def targets(self) -> list[str]:
        return [f"ahead_{k}" for k in range(self.horizon)]

    @property
    def steps(self) -> int:
        """Steps ahead that the derivatives are made of: more than the horizon where that has too few for their order."""
        return self.horizon + (self.n_derivative if self.n_derivative >= self.horizon else 0)

    @property
    def derivative_names(self) -> list[str]:
        return [f"der_{i}_ahead_{a}" for i in range(1, self.n_derivative + 1) for a in range(i, self.steps)]

    @property
    def labels(self) -> list[str]:
        return [*self.targets, *self.derivative_names, *self.penalties]

    @property
    def groups(self) -> list[int]:
        """0 targets, 1 derivatives, 2 penalties; numbers without labels are left out."""
        kinds = [0] * len(self.targets) + [1] * len(self.derivative_names) + [2] * len(self.penalties)
        names = sorted(set(kinds))
        return [names.index(k) for k in kinds]

    def weights(self, decay: float | None) -> list[float]:
        orders = [w for i in range(1, self.n_derivative + 1) for w in design.decay_weights(self.steps - i, decay)]
        return [*design.decay_weights(self.horizon, decay), *orders, *[1.0] * len(self.penalties)]

    def transform(self, panel: DataFrame, inference: bool = False) -> DataFrame:
        """series, index, features and, but for inference, labels; rows that lack any of them are left out."""
        rows = design.season(panel, self.season_length) if self.season_length else panel
        keep = tuple(dict.fromkeys([*self.extra, *self.penalties]))
        if inference:
            return design.lag_lead(rows, self.lags, 0, keep=keep).dropna(subset=self.features)
        out = design.derivatives(design.lag_lead(rows, self.lags, self.steps, keep=keep), self.steps, self.n_derivative)
        return out.dropna(subset=[*self.features, *self.labels]).select("series", "index", *keep, *[f"lag_{k}" for k in range(1, self.lags + 1)], *self.targets, *self.derivative_names)


@dataclass
class _Model:
    data: PanelData
    decay: float | None = 1.0
    objective_weights: tuple[float, ...] = (1.0, 0.0, 0.0)
    max_depth: int = 5
    min_leaf: int = 5
    bins: int = 32
    how: str = "score"

    def __post_init__(self):
        if self.how not in ("score", "rank"):
            raise ValueError(f"how: {self.how}")
        n = max(self.data.groups) + 1
        if len(self.objective_weights) < n:
            raise ValueError(f"{n} groups of labels need as many weights")

    def _arrays(self, rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        columns = [*self.data.features, *self.data.labels]
        n = rows.count()
        if not n:
            raise ValueError("no rows to fit on")
        if n * len(columns) > MAX_CELLS:
            raise ValueError(f"{n} rows of {len(columns)} numbers don't fit the array tier; the cluster tier has no such limit")
        f = rows.select("series", "index", *columns).toPandas().sort_values(["series", "index"])
        self._order = f[["series", "index"]].reset_index(drop=True)
        return f[self.data.features].to_numpy(float), f[self.data.labels].to_numpy(float), np.array(self.data.groups), np.array(self.data.weights(self.decay))

    def _on_cluster(self, rows: DataFrame, tier: str) -> bool:
        if tier not in ("auto", "arrays", "cluster"):
            raise ValueError(f"tier: {tier}")
        return tier == "cluster" or (tier == "auto" and rows.count() * (len(self.data.features) + len(self.data.labels)) > MAX_CELLS)

    def _objective(self) -> tree.Objective:
        return tree.Objective(self.data.labels, self.data.groups, self.data.weights(self.decay), list(self.objective_weights))

    def _growth(self, **more) -> tree.Growth:
        return tree.Growth(self.max_depth, self.bins, self.min_leaf, self.how, **more)

    def _applied(self, rows: DataFrame, predict) -> DataFrame:
        """rows with ``pred``; one map over Arrow batches, no shuffle."""
        features, h = self.data.features, self.data.horizon
        schema = f"{rows.drop('pred').schema.toDDL()}, pred array<double>"

        def run(batches):
            for b in batches:
                yield b.assign(pred=list(predict(b[features].to_numpy(float))[:, :h])) if len(b) else b.assign(pred=pd.Series([], dtype=object))

        return rows.drop("pred").mapInPandas(run, schema)

    def _by_series(self, table: DataFrame, column: str) -> np.ndarray:
        """A column of a (series, ..) table, for each fitted row; NaN for series that it lacks."""
        known = dict(table.join(F.broadcast(table.sparkSession.createDataFrame([(s,) for s in self._order["series"].unique()], table.select("series").schema)), "series").select("series", column).collect())
        return self._order["series"].map(known).to_numpy(float)

    def _folds(self, rows: DataFrame, cv: str, n: int, seed: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if cv == "time":
            marks = design.cv_folds(rows, n, self.data.horizon).toPandas()
            if not len(marks):  # series too short for any origin
                return self._folds(rows, "series", n, seed)
        elif cv in ("series", "plain"):
            marks = design.kfold(rows, n, seed, cv == "series").toPandas()
        else:
            raise ValueError(f"cv: {cv}")
        marks = marks.merge(self._order.assign(at=np.arange(len(self._order))), on=["series", "index"])
        if cv == "time":
            parts = [tuple(np.sort(g.loc[g["part"] == k, "at"].to_numpy()) for k in ("train", "test")) for _, g in marks.groupby("fold")]
        else:
            fold = marks.sort_values("at")["fold"].to_numpy()
            parts = [(np.flatnonzero(fold != k), np.flatnonzero(fold == k)) for k in range(n)]
        return [(a, b) for a, b in parts if len(a) and len(b)]

    def tune_penalties(self, rows: DataFrame, decays=(0.0, 0.5, 1.0), lambdas=(0.0, 0.2, 0.5), betas=(0.0, 0.2, 0.5), folds: int = 5, depths=None, cv: str = "time", seed: int = 5,
                       error: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None, scales: DataFrame | None = None) -> tuple[dict, DataFrame, DataFrame]:
        """(best parameters, log, summary) of a grid of decays and group weights: one deep tree a task, scored at every depth.

        cv: "time" (rolling origins; shuffled within series if no series is long enough), "series" or "plain" folds. ``error`` takes
        targets and predictions and gives a row's error (absolute by default); ``scales`` (series, scale) divides it. The log has a row
        a fold, depth and cell, the summary their means; ties go to the smaller depth, decay and weights. Rows must be
        unique by series and index; this is the array tier, so that MAX_CELLS holds.
        """
        x, y, groups, _ = self._arrays(rows)
        if self._order.duplicated().any():
            raise ValueError("rows repeat a series and index")
        parts = self._folds(rows, cv, folds, seed)
        if not parts:
            raise ValueError("no fold has rows to train and to test on")
        n = len(set(self.data.groups))
        cells = [{"decay": float(d), "lam": float(a), "beta": float(b)} for d in decays for a in (lambdas if n > 1 else [0.0]) for b in (betas if n > 2 else [0.0])]
        p = kernel.Params(self.max_depth, self.min_leaf, self.bins, how=self.how)
        divisor = np.ones(len(x)) if scales is None else self._by_series(scales, "scale")
        log = kernel.grid(rows.sparkSession, x, y, groups, parts, cells, list(depths or [self.max_depth]), self.data.horizon, divisor, p, lambda d: np.array(self.data.weights(d)), seed, error)
        log = tables.cut(log)
        key = ["depth", "decay", "lam", "beta"]
        summary = log.groupBy(*key).agg(*[F.avg(F.nanvl(c, F.lit(None).cast("double"))).alias(c) for c in ("train_error", "test_error")])
        best = summary.where("test_error is not null").orderBy("test_error", *key).first()
        if best is None:
            raise ValueError("no finite error")
        return {"depth": best["depth"], "decay": best["decay"], "objective_weights": (1.0, best["lam"], best["beta"])}, log, summary

    def score(self, predicted: DataFrame) -> DataFrame:
        """(h, mse) of rows that have the targets and ``pred``."""
        parts = [F.struct(F.lit(k + 1).alias("h"), (F.col(c) - F.col("pred")[k]).alias("e")) for k, c in enumerate(self.data.targets)]
        return predicted.select(F.explode(F.array(*parts)).alias("x")).groupBy("x.h").agg(F.avg(F.col("x.e") * F.col("x.e")).alias("mse"))


@dataclass
class TreeModel(_Model):
    row_share: float = 1.0
    feature_share: float = 1.0
    by_node: bool = True
    gain_threshold: float = 0.0
    weight_mode: str = "fixed"
    alpha: float = 1.0
    seed: int = 10
    nodes: list[tree.Node] = field(default_factory=list)

    def fit(self, rows: DataFrame) -> TreeModel:
        data, edges = tree.prepared(rows, self.data.features, self.data.labels, self.bins, ["series", "index"])
        growth = self._growth(row_share=self.row_share, feature_share=self.feature_share, by_node=self.by_node, gain_threshold=self.gain_threshold, weight_mode=self.weight_mode, alpha=self.alpha)
        self.nodes = tree.grow_many(data, edges, self._objective(), growth, [self.seed], ["series", "index"])[0]
        if not self.nodes[0].n:
            raise ValueError("no rows to fit on")
        return self

    def predict(self, rows: DataFrame, depth: int = 99, leaf_id: bool = False) -> DataFrame:
        """rows with ``pred``, the targets' means, and with ``leaf_id`` also node_id; a depth cap gives inner nodes'."""
        if not self.nodes:
            raise RuntimeError("not fitted")
        out = tree.predict(rows, self.nodes, self.data.features, depth).withColumn("pred", F.slice("pred", 1, self.data.horizon))
        return out if leaf_id else out.drop("node_id")


@dataclass
class BoostedModel(_Model):
    n_estimators: int = 100
    rate: float = 0.05
    bagging_fraction: float = 0.8
    feature_fraction: float = 0.5
    eval_k: int = 0
    patience: int = 40
    seed: int = 10
    metric: str = "mse"
    min_delta: float = 0.0
    refit_on_full: bool = False
    tier: str = "auto"
    keep_loss: bool = False
    model: kernel.Boosted | None = None
    fitted: DataFrame | None = None

    def fit(self, rows: DataFrame, scales: DataFrame | None = None) -> BoostedModel:
        """With ``eval_k``, the last rows of each series that has more are held out and stop the rounds early.

        metric "mase" needs ``scales`` (series, scale), in the labels' unit; series without a positive one are left out of it. With
        ``refit_on_full`` the number of rounds found is fitted again on all rows; the losses stay those of the first fit.
        """
        if self.metric not in ("mse", "mase") or (self.metric == "mase" and scales is None):
            raise ValueError("metric: mse, or mase with scales")
        self.fitted = rows if self.keep_loss else None
        if self._on_cluster(rows, self.tier):
            return self._fit_cluster(rows, scales)
        x, y, groups, weights = self._arrays(rows)
        held = None
        if self.eval_k:
            g = self._order.groupby("series")
            held = ((g.cumcount(ascending=False) < self.eval_k) & (g["index"].transform("size") > self.eval_k)).to_numpy()
        p = kernel.Params(self.max_depth, self.min_leaf, self.bins, self.bagging_fraction, self.feature_fraction, True, self.how, self.objective_weights)
        by_row = None if scales is None else self._by_series(scales, "scale")
        fit = lambda **options: kernel.boost_in_task(rows.sparkSession, x, y, groups, weights, p, rate=self.rate, seed=self.seed, **options)
        self.model = fit(rounds=self.n_estimators, eval_rows=held, patience=self.patience, metric=self.metric, scales=by_row, min_delta=self.min_delta)
        if self.eval_k and self.refit_on_full:
            self.model = kernel.Boosted(fit(rounds=len(self.model.trees) - 1).trees, self.rate, self.model.history)
        return self

    def _fit_cluster(self, rows: DataFrame, scales: DataFrame | None) -> BoostedModel:
        key, carried = ["series", "index"], ["series", "index"]
        if self.eval_k:
            rows, carried = design.holdout(rows, self.eval_k), [*carried, "is_eval"]
        if scales is not None:
            rows, carried = rows.drop("scale").join(scales.select("series", "scale"), "series", "left"), [*carried, "scale"]
        data, edges = tree.prepared(rows, self.data.features, self.data.labels, self.bins, carried, held="is_eval" if self.eval_k else None, raw=True)
        growth = self._growth(row_share=self.bagging_fraction, feature_share=self.feature_fraction)
        fit = lambda rounds, held: tree.boost(data, edges, self._objective(), growth, rounds, self.rate, kernel.tree_seeds(self.seed, rounds + 1), key, held, self.patience, self.metric, "scale" if scales is not None else None, self.min_delta)
        found = fit(self.n_estimators, "is_eval" if self.eval_k else None)
        trees = found.trees
        if self.eval_k and self.refit_on_full:
            data, edges = tree.prepared(rows, self.data.features, self.data.labels, self.bins, carried, raw=True)
            trees = fit(len(found.trees) - 1, None).trees
        self.model = kernel.Boosted([kernel.of_nodes(t) for t in trees], self.rate, found.history)
        return self

    def predict(self, rows: DataFrame, n_tree: int | None = None) -> DataFrame:
        if self.model is None:
            raise RuntimeError("not fitted")
        shared = rows.sparkSession.sparkContext.broadcast(self.model)
        return self._applied(rows, lambda x: shared.value.predict(x, n_tree))

    def get_loss(self) -> list[float]:
        if self.model is None or not self.model.history:
            raise RuntimeError("losses are kept with eval_k only")
        return self.model.history

    def get_pred_df(self) -> DataFrame:
        """The fitted rows with ``pred``; kept with ``keep_loss`` only."""
        if self.fitted is None:
            raise RuntimeError("predictions are kept with keep_loss only")
        return self.predict(self.fitted)


@dataclass
class ForestModel(_Model):
    n_estimators: int = 100
    bagging_fraction: float = 1.0
    feature_fraction: float = 1.0
    seed: int = 10
    tier: str = "auto"
    keep_loss: bool = False
    trees: list[kernel.Tree] = field(default_factory=list)
    fitted: DataFrame | None = None

    def fit(self, rows: DataFrame) -> ForestModel:
        """One tree a task, or on the cluster all trees together; the forest does not depend on the number of tasks."""
        self.fitted = rows if self.keep_loss else None
        if self._on_cluster(rows, self.tier):
            data, edges = tree.prepared(rows, self.data.features, self.data.labels, self.bins, ["series", "index"])
            growth = self._growth(row_share=self.bagging_fraction, feature_share=self.feature_fraction)
            grown = tree.grow_many(data, edges, self._objective(), growth, kernel.tree_seeds(self.seed, self.n_estimators), ["series", "index"])
            self.trees = [kernel.of_nodes(t) for t in grown]
            return self
        p = kernel.Params(self.max_depth, self.min_leaf, self.bins, self.bagging_fraction, self.feature_fraction, True, self.how, self.objective_weights)
        self.trees = kernel.trees_of(kernel.forest(rows.sparkSession, *self._arrays(rows), p, self.n_estimators, self.seed))
        return self

    def predict(self, rows: DataFrame, n_tree: int | None = None) -> DataFrame:
        if not self.trees:
            raise RuntimeError("not fitted")
        shared = rows.sparkSession.sparkContext.broadcast(self.trees)
        return self._applied(rows, lambda x: kernel.forest_predict(shared.value, x, n_tree))

    def get_loss(self) -> DataFrame:
        """(h, mse) of the fitted rows; kept with ``keep_loss`` only."""
        if self.fitted is None:
            raise RuntimeError("losses are kept with keep_loss only")
        return self.score(self.predict(self.fitted))

    def get_pred_df(self) -> DataFrame:
        """The fitted rows with ``pred``; kept with ``keep_loss`` only."""
        if self.fitted is None:
            raise RuntimeError("predictions are kept with keep_loss only")
        return self.predict(self.fitted)
