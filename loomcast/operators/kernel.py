"""The many-small-models tier: numpy trees fitted inside Spark tasks, one tree, boosting run or grid cell a task.

Bins are made anew at every node from its own rows: equal-frequency, never between equal values, ``min(bins, n // min_leaf)`` of them.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession


@dataclass
class Params:
    max_depth: int = 5
    min_leaf: int = 5
    bins: int = 32
    row_share: float = 1.0
    feature_share: float = 1.0
    by_node: bool = True
    how: str = "score"
    group_weights: tuple[float, ...] = (1.0,)
    weight_mode: str = "fixed"
    alpha: float = 1.0
    gain_threshold: float = 0.0
    #: Gains below this part of what they are the difference of count as 0; 0 takes them as computed.
    noise: float = 1e-12

    def __post_init__(self):
        if self.how not in ("score", "rank"):
            raise ValueError(f"how: {self.how}")
        if self.weight_mode not in ("fixed", "dirichlet", "onehot"):
            raise ValueError(f"weight_mode: {self.weight_mode}")
        if self.max_depth < 0 or self.bins < 2 or self.min_leaf < 1 or not 0 < self.row_share <= 1 or not 0 < self.feature_share <= 1:
            raise ValueError("max_depth is at least 0, bins at least 2, min_leaf at least 1, shares are over 0 and at most 1")


@dataclass
class Tree:
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    n: np.ndarray
    depth: np.ndarray
    means: np.ndarray

    def leaf(self, x: np.ndarray, max_depth: int = 1 << 30) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        while True:
            go = (self.feature[at] >= 0) & (self.depth[at] < max_depth)
            if not go.any():
                return at
            i = np.flatnonzero(go)
            node = at[i]
            at[i] = np.where(x[i, self.feature[node]] < self.threshold[node], self.left[node], self.right[node])

    def predict(self, x: np.ndarray, max_depth: int = 1 << 30) -> np.ndarray:
        return self.means[self.leaf(x, max_depth)]


#: Places that scores tie to, as in the cluster tier and the SQL: where labels vary little, cuts that part the rows alike differ by more than 1e-12 of the
#: gain, in whatever order their feature has the rows.
TIE = 9


def greedy_bins(v: np.ndarray, bins: int) -> np.ndarray:
    """Ends (exclusive) of the bins in the sorted values ``v``."""
    n, need = len(v), len(v) // bins
    jumps = np.append(np.flatnonzero(np.diff(v) > 1e-7) + 1, n)
    ends, start = [], 0
    while len(ends) < bins - 1:
        k = np.searchsorted(jumps, start + max(need, 1))
        if k >= len(jumps):
            break
        ends.append(int(jumps[k]))
        start = ends[-1]
        if start == n:
            break
    if not ends or ends[-1] < n:
        ends.append(n)
    return np.array(ends)


def _split(x, y, groups, weights, group_weights, p: Params, features):
    """(feature, threshold) of the best cut, or None."""
    n = len(x)
    bins = min(p.bins, n // p.min_leaf)
    if bins < 2 or n < 2 * p.min_leaf:
        return None
    total = y.sum(axis=0)
    base = total * total / n
    gains, cells = [], []
    for f in features:
        order = np.argsort(x[:, f], kind="stable")
        v = x[order, f]
        if v[-1] - v[0] < 1e-7:
            continue
        ends = greedy_bins(v, bins)[:-1]
        ends = ends[(ends >= p.min_leaf) & (n - ends >= p.min_leaf)]
        if not len(ends):
            continue
        left = np.cumsum(y[order], axis=0)[ends - 1]
        c = ends[:, None]
        g = (left * left / c + (total - left) ** 2 / (n - c) - base) * weights
        by_group = np.stack([g[:, groups == k].sum(axis=1) for k in np.unique(groups)], axis=1)
        # what is left of a difference of larger numbers: noise of the arithmetic, at any scale of the labels
        gains.append(np.where(by_group > p.noise * np.array([(base * weights)[groups == k].sum() for k in np.unique(groups)]), by_group, 0.0) if p.noise > 0 else by_group)
        cells += [(f, 0.5 * (v[e - 1] + v[e])) for e in ends]
    if not cells:
        return None
    g = np.concatenate(gains)
    w = np.asarray(group_weights[: g.shape[1]], float)
    top = g.max(axis=0)
    share = g / np.where(top != 0, top, np.inf)
    if g.shape[1] == 1:
        score = share[:, 0]
    elif p.how == "rank":
        ranks = np.argsort(np.argsort(-np.round(share, TIE), axis=0, kind="stable"), axis=0, kind="stable")
        score = -(ranks @ w)
    else:
        score = share @ w
    best = int(np.round(score, TIE).argmax())
    if p.gain_threshold > 0:
        within = np.array([((y[:, groups == k] ** 2).sum(axis=0) - base[groups == k]) @ weights[groups == k] for k in np.unique(groups)])
        share = np.clip(np.divide(g[best], within, out=np.zeros_like(within), where=within > 0), 0, 1)
        if share @ w / max(w.sum(), 1e-12) < p.gain_threshold:
            return None
    return cells[best]


def fit_tree(x: np.ndarray, y: np.ndarray, groups: np.ndarray, weights: np.ndarray, p: Params, seed: int = 0, rows: np.ndarray | None = None) -> Tree:
    """Breadth first, with a budget of ``min(n // min_leaf, 2**depth)`` leaves.

    ``rows``: fits on these positions of the arrays without copying them; the tree is that of the copied rows.
    """
    rng = np.random.RandomState(seed)
    rows = np.arange(len(x)) if rows is None else rows
    if p.row_share < 1:
        rows = rows[np.sort(rng.permutation(len(rows))[: int(np.ceil(len(rows) * p.row_share))])]
    width = x.shape[1]
    n_features = min(width, int(p.feature_share * width) + 1) if p.feature_share < 1 else width
    budget = max(1, min(len(rows) // max(p.min_leaf, 1), 2 ** min(p.max_depth, 30)))
    own = np.arange(width) if n_features == width else np.sort(rng.permutation(width)[:n_features])
    n_groups = len(np.unique(groups))
    nodes, queue, leaves = [[-1, 0.0, -1, -1, len(rows), 0, y[rows].mean(axis=0)]], [(0, rows)], 1
    while queue:
        i, at = queue.pop(0)
        if nodes[i][5] >= p.max_depth or len(at) < 2 * p.min_leaf or leaves >= budget:
            continue
        features = own if not p.by_node or n_features == width else np.sort(rng.permutation(width)[:n_features])
        gw = p.group_weights
        if p.weight_mode == "dirichlet":
            gw = tuple(rng.dirichlet([p.alpha] * n_groups))
        elif p.weight_mode == "onehot":
            gw = tuple(np.eye(n_groups)[rng.randint(n_groups)])
        cut = _split(x[at], y[at], groups, weights, gw, p, features)
        if cut is None:
            continue
        below = x[at, cut[0]] < cut[1]
        nodes[i][:4] = [cut[0], cut[1], len(nodes), len(nodes) + 1]
        for part in (at[below], at[~below]):
            queue.append((len(nodes), part))
            nodes.append([-1, 0.0, -1, -1, len(part), nodes[i][5] + 1, y[part].mean(axis=0)])
        leaves += 1
    c = list(zip(*nodes, strict=True))
    return Tree(*[np.array(v) for v in c[:6]], np.stack(c[6]))


def drawn_features(seed: int, width: int, n: int, calls: int = 1) -> list[list[int]]:
    """``calls`` draws of n of ``width`` features without repetition: a Mersenne twister seeded by a number, and the first n steps of a shuffle each."""
    twister = np.random.MT19937()
    twister._legacy_seeding(seed)
    out = []
    for _ in range(calls):
        pool = list(range(width))
        for i, r in enumerate(twister.random_raw(n).tolist()):
            j = i + r % (width - i)
            pool[i], pool[j] = pool[j], pool[i]
        out.append(pool[:n])
    return out


def tree_seeds(seed: int, n: int) -> list[int]:
    return [int(s.generate_state(1, np.uint32)[0]) for s in np.random.SeedSequence(seed).spawn(n)]


_NODE_NAMES = ["tree_id", "node_id", "depth", "n", "feature", "threshold", "left", "right", "means"]
_NODES = "tree_id int, node_id int, depth int, n long, feature int, threshold double, left int, right int, means array<double>"


def _frame(tree: Tree, tree_id: int) -> pd.DataFrame:
    inner = tree.feature >= 0
    return pd.DataFrame({"tree_id": np.int32(tree_id), "node_id": np.arange(len(inner), dtype=np.int32), "depth": tree.depth.astype(np.int32), "n": tree.n.astype(np.int64), "feature": tree.feature.astype(np.int32), "threshold": [float(t) if k else None for t, k in zip(tree.threshold, inner, strict=True)], "left": tree.left.astype(np.int32), "right": tree.right.astype(np.int32), "means": [m.tolist() for m in tree.means]})


def forest(spark: SparkSession, x, y, groups, weights, p: Params, n_trees: int, seed: int = 10) -> DataFrame:
    """A table of nodes; each tree is a task's work, whatever the number of partitions. The arrays are broadcast: this tier's data fit a task."""
    shared = spark.sparkContext.broadcast((x, y, groups, weights, p))
    tasks = spark.createDataFrame(list(enumerate(tree_seeds(seed, n_trees))), "tree_id int, seed long").repartition(min(n_trees, 64))

    def run(batches):
        for b in batches:
            for t, s in zip(b["tree_id"], b["seed"], strict=True):
                yield _frame(fit_tree(*shared.value, seed=int(s)), int(t))

    return tasks.mapInPandas(run, _NODES)


def fit_by_group(rows: DataFrame, by: str, order: list[str], features: list[str], labels: list[str], groups: list[int], weights: list[float], p: Params, seed: int = 10, train: str | None = None, most: int = 10_000_000) -> DataFrame:
    """A table of nodes with column ``by``: a tree for each group of rows, in a task that holds that group alone.

    ``order``: columns that put a group's rows in order, so that draws don't depend on the plan. ``train``: a boolean column of the rows to learn from. A group
    of more than ``most`` numbers fails with a message: trees of the cluster tier have no such limit.
    """
    columns = dict(rows.dtypes)

    def run(f: pd.DataFrame) -> pd.DataFrame:
        if f.size > most:
            raise ValueError(f"group {f[by].iloc[0]} has {f.size} numbers; grow it on the cluster")
        f = f.sort_values(order)
        own = f if train is None else f[f[train]]
        if not len(own):
            return pd.DataFrame(columns=[by, *_NODE_NAMES])
        t = fit_tree(own[features].to_numpy(float), own[labels].to_numpy(float), np.array(groups), np.array(weights), p, seed)
        return _frame(t, 0).assign(**{by: f[by].iloc[0]})

    wanted = list(dict.fromkeys([by, *order, *features, *labels, *([train] if train else [])]))
    return rows.select(*wanted).groupBy(by).applyInPandas(run, f"{by} {columns[by]}, {_NODES}")


def trees_of(nodes: DataFrame) -> list[Tree]:
    """Fitted trees, in order of id, of a table of nodes."""
    return _trees(nodes.toPandas())


def _trees(nodes: pd.DataFrame) -> list[Tree]:
    out = []
    for _, f in nodes.sort_values(["tree_id", "node_id"]).groupby("tree_id"):
        out.append(Tree(f["feature"].to_numpy(), np.nan_to_num(f["threshold"].to_numpy(float)), f["left"].to_numpy(), f["right"].to_numpy(), f["n"].to_numpy(), f["depth"].to_numpy(), np.stack(f["means"].map(np.asarray))))
    return out


def of_nodes(nodes: list) -> Tree:
    """A tree grown on the cluster, as arrays."""
    column = lambda name, kind: np.array([getattr(x, name) for x in nodes], kind)
    return Tree(column("feature", np.int64), np.array([x.threshold or 0.0 for x in nodes]), column("left", np.int64), column("right", np.int64), column("n", np.int64), column("depth", np.int64), np.stack([np.asarray(x.means) for x in nodes]))


def forest_predict(trees: list[Tree], x: np.ndarray, n_trees: int | None = None) -> np.ndarray:
    """The mean over the first ``n_trees`` trees."""
    some = trees[:n_trees]
    return sum(t.predict(x) for t in some) / len(some)


@dataclass
class Boosted:
    trees: list[Tree]
    rate: float
    history: list[float]

    def predict(self, x: np.ndarray, n_trees: int | None = None) -> np.ndarray:
        """The first tree and ``n_trees`` shrunk ones."""
        out = self.trees[0].predict(x)
        for t in self.trees[1:] if n_trees is None else self.trees[1 : n_trees + 1]:
            out = out + self.rate * t.predict(x)
        return out


def boost(x, y, groups, weights, p: Params, rounds: int = 100, rate: float = 0.05, seed: int = 10, eval_rows: np.ndarray | None = None, patience: int = 40, metric: str = "mse", scales: np.ndarray | None = None, min_delta: float = 0.0) -> Boosted:
    """A first tree of depth one, unshrunk, then trees on the residuals of all labels.

    With ``eval_rows`` those rows are held out, and rounds stop after ``patience`` without an improvement over ``min_delta``; mase
    divides absolute errors by ``scales`` and leaves out rows whose scale is 0 or not finite.
    """
    train = np.ones(len(x), bool) if eval_rows is None else ~eval_rows
    if not train.any() or (eval_rows is not None and not eval_rows.any()):
        raise ValueError("no rows to train or to evaluate on")
    targets = groups == groups.min()

    def loss(pred: np.ndarray) -> float:
        e = (y - pred)[eval_rows][:, targets]
        if metric == "mse":
            return float((e * e).mean())
        s = scales[eval_rows]
        good = np.isfinite(s) & (s > 0)
        return float((np.abs(e).mean(axis=1)[good] / s[good]).mean()) if good.any() else float("nan")

    seeds = tree_seeds(seed, rounds + 1)
    at = np.flatnonzero(train)
    trees = [fit_tree(x, y, groups, weights, replace(p, max_depth=1, row_share=1.0, feature_share=1.0), seeds[0], at)]
    pred = trees[0].predict(x)
    history, best, best_at = [], np.inf, 0
    for k in range(rounds):
        t = fit_tree(x, y - pred, groups, weights, p, seeds[k + 1], at)
        trees.append(t)
        pred = pred + rate * t.predict(x)
        if eval_rows is not None:
            history.append(loss(pred))
            if history[-1] < best - max(min_delta, 1e-12):
                best, best_at = history[-1], k
            elif k - best_at >= patience:
                break
    return Boosted(trees[: best_at + 2] if eval_rows is not None else trees, rate, history)


def boost_in_task(spark: SparkSession, x, y, groups, weights, p: Params, **options) -> Boosted:
    """``boost`` as a task's work: the driver sends the arrays and gets the trees."""
    shared = spark.sparkContext.broadcast((x, y, groups, weights, p, options))

    def run(batches):
        for _ in batches:
            *data, options = shared.value
            m = boost(*data, **options)
            yield pd.concat([_frame(t, i).assign(rate=m.rate, history=[m.history] * len(t.feature)) for i, t in enumerate(m.trees)])

    nodes = spark.range(1).repartition(1).mapInPandas(run, f"{_NODES}, rate double, history array<double>").toPandas()
    return Boosted(_trees(nodes), float(nodes["rate"][0]), [float(v) for v in nodes["history"][0]])


def absolute(y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    return np.abs(y - pred).mean(axis=1)


def squared(y: np.ndarray, pred: np.ndarray) -> np.ndarray:
    return np.sqrt(((y - pred) ** 2).mean(axis=1))


def grid(spark: SparkSession, x, y, groups, folds: list[tuple[np.ndarray, np.ndarray]], cells: list[dict], depths: list[int], horizon: int, scales: np.ndarray, p: Params, weights_of, seed: int = 10, error: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """The log of a cross-validation grid: one deep fit a task (cell x fold), scored at all depths by a cap.

    ``error`` takes targets and predictions and gives a row's error, the mean absolute one by default; it is divided by ``scales``, and
    what is not finite is left out.

    cells: dicts with decay, lam, beta. scales: what row errors are divided by. ``weights_of(decay)`` gives the labels' weights.
    """
    shared = spark.sparkContext.broadcast((x, y, groups, folds, scales, {c["decay"]: weights_of(c["decay"]) for c in cells}))
    seeds = tree_seeds(seed, len(cells) * len(folds))
    rows = [(f, c["decay"], c["lam"], c["beta"], seeds[i * len(folds) + f]) for i, c in enumerate(cells) for f in range(len(folds))]
    tasks = spark.createDataFrame(rows, "fold int, decay double, lam double, beta double, seed long").repartition(min(len(rows), 64))

    def run(batches):
        x, y, groups, folds, scales, weights = shared.value
        for b in batches:
            for r in b.itertuples():
                train, test = folds[r.fold]
                t = fit_tree(x, y, groups, weights[r.decay], replace(p, max_depth=max(depths), group_weights=(1.0, r.lam, r.beta)), int(r.seed), train)
                out = []
                for d in depths:
                    with np.errstate(divide="ignore", invalid="ignore"):
                        e = (error or absolute)(y[:, :horizon], t.predict(x, d)[:, :horizon]) / scales
                    e[~np.isfinite(e)] = np.nan
                    out.append((r.fold, d, r.decay, r.lam, r.beta, float(np.nanmean(e[train])), float(np.nanmean(e[test]))))
                yield pd.DataFrame(out, columns=["fold", "depth", "decay", "lam", "beta", "train_error", "test_error"])

    return tasks.mapInPandas(run, "fold int, depth int, decay double, lam double, beta double, train_error double, test_error double")
