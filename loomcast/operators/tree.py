"""Distributed multi-target regression trees: a histogram aggregation, prefix windows and a ranked choice for each level.

Every level is one job over all its nodes, and over all trees of a forest: counts and label sums by (tree and node, feature, bin), running sums over
bins, the gain of each objective group at each cut, and the best cut by score or rank. Only the winners, at most two to the power of the depth for each
tree, come to the driver, with the sums on both sides, so that no job counts the children. A row finds its node by walking down tables of the splits,
one look-up a level; nothing is stored for it between levels, and the histogram is as large as the trees, not the data.

A budget of ``min(n // min_leaf, 2**depth)`` leaves needs no test: every leaf has ``min_leaf`` rows, and a tree ends at its depth.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from loomcast.operators.binning import greedy_bins
from loomcast.sources.tables import cut


@dataclass
class Objective:
    """Label columns in groups (target, derivative, external), a weight for each label and for each group."""

    labels: list[str]
    groups: list[int]
    weights: list[float]
    group_weights: list[float] = field(default_factory=lambda: [1.0])


@dataclass
class Node:
    node_id: int
    depth: int
    n: int
    means: list[float]
    feature: int = -1
    threshold: float | None = None
    left: int = -1
    right: int = -1


def bin_edges(rows: DataFrame, features: list[str], bins: int) -> list[list[tuple[float, float]]]:
    """(least, largest) of every bin of every feature: features x bins numbers."""
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(i).alias("p"), F.col(f).cast("double").alias("v")) for i, f in enumerate(features)])).alias("x")).select("x.p", "x.v")
    out: list[list] = [[] for _ in features]
    for r in sorted(greedy_bins(long, bins).collect(), key=lambda r: (r["p"], r["bin"])):
        out[r["p"]].append((r["bin_min"], r["bin_max"]))
    return out


def binned(rows: DataFrame, features: list[str], edges: list[list[tuple[float, float]]]) -> DataFrame:
    """Adds ``bins``, an array with the bin of each feature."""
    def place(f: str, e: list) -> Column:
        tops = F.array(*[F.lit(float(hi)) for _, hi in e[:-1]]) if len(e) > 1 else F.array().cast("array<double>")
        return F.size(F.filter(tops, lambda t: F.col(f) > t))

    return rows.withColumn("bins", F.array(*[place(f, e) for f, e in zip(features, edges, strict=True)]))


def histogram(assigned: DataFrame, labels: list[str], squares: bool = False) -> DataFrame:
    """(node, p, bin, n, s_label..[, q_label..]); q: sums of squares."""
    more = [F.sum(F.col(c) * F.col(c)).alias(f"q_{c}") for c in labels] if squares else []
    return assigned.select("node", F.posexplode("bins").alias("p", "bin"), *labels).groupBy("node", "p", "bin").agg(F.count("*").alias("n"), *[F.sum(c).alias(f"s_{c}") for c in labels], *more)


#: A gain below this share of what it is the difference of is noise of the arithmetic, whatever the labels' scale, and counts as 0.
NOISE = 1e-12


def split_candidates(hist: DataFrame, objective: Objective, min_leaf: int, sums: bool = False) -> DataFrame:
    """(node, p, bin, n_left, n_right, next_bin, gain_g..): all cuts after a bin that leave ``min_leaf`` rows on both sides.

    ``sums``: also the label sums of the left side and of the node (l_label.., a_label..), and with squares in ``hist`` what a group's labels vary (v_g..).
    """
    run = W.partitionBy("node", "p").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole, order = W.partitionBy("node", "p"), W.partitionBy("node", "p").orderBy("bin")
    labels = objective.labels
    squares = [x for x in labels if f"q_{x}" in hist.columns]
    running = hist.select("node", "p", "bin", F.sum("n").over(run).alias("c"), F.sum("n").over(whole).alias("t"), F.lead("bin").over(order).alias("next_bin"),
                          *[F.sum(f"s_{x}").over(run).alias(f"l_{x}") for x in labels], *[F.sum(f"s_{x}").over(whole).alias(f"a_{x}") for x in labels], *[F.sum(f"q_{x}").over(whole).alias(f"q_{x}") for x in squares])
    cuts = running.where(F.col("next_bin").isNotNull() & (F.col("c") >= min_leaf) & (F.col("t") - F.col("c") >= min_leaf))

    left, all_, c, t = (lambda x: F.col(f"l_{x}")), (lambda x: F.col(f"a_{x}")), F.col("c"), F.col("t")
    base = lambda x: all_(x) * all_(x) / t
    gain = lambda x: left(x) * left(x) / c + (all_(x) - left(x)) * (all_(x) - left(x)) / (t - c) - base(x)
    of = {g: [(x, w) for x, h, w in zip(labels, objective.groups, objective.weights, strict=True) if h == g] for g in sorted(set(objective.groups))}
    total = lambda f, own: sum((f(x) * w for x, w in own), F.lit(0.0))
    gains = [F.when(total(gain, own) > NOISE * total(base, own), total(gain, own)).otherwise(0.0).alias(f"gain_{g}") for g, own in of.items()]
    more = [*[F.col(f"{k}_{x}") for k in "la" for x in labels], *[total(lambda x: F.col(f"q_{x}") - base(x), own).alias(f"v_{g}") for g, own in of.items() if squares]] if sums else []
    return cuts.select("node", "p", "bin", "next_bin", c.alias("n_left"), (t - c).alias("n_right"), *gains, *more)


def best_splits(cuts: DataFrame, objective: Objective, how: str = "score") -> DataFrame:
    """The winner of each node. score: gains over their largest, weighted; rank: weighted ranks; ties: the first (feature, bin).

    Gains tie if they are equal to nine places of the node's largest, so that ties do not depend on the labels' scale. Columns w_g, where
    the cuts have them, are the node's own weights.
    """
    groups = sorted(set(objective.groups))
    node = W.partitionBy("node")
    weights = [F.col(f"w_{g}") if f"w_{g}" in cuts.columns else F.lit(float(w)) for g, w in zip(groups, objective.group_weights, strict=False)]
    shares = [F.coalesce(F.try_divide(F.col(f"gain_{g}"), F.max(f"gain_{g}").over(node)), F.lit(0.0)).alias(f"_share_{g}") for g in groups]
    shared = cuts.select("*", *shares)
    if how == "rank":
        ranks = [(F.row_number().over(node.orderBy(F.round(f"_share_{g}", 9).desc(), "p", "bin")) - 1) * w for g, w in zip(groups, weights, strict=False)]
        scored = shared.withColumn("score", -sum(ranks, F.lit(0.0)))
    else:
        scored = shared.withColumn("score", sum((F.col(f"_share_{g}") * w for g, w in zip(groups, weights, strict=False)), F.lit(0.0)))
    first = F.row_number().over(node.orderBy(F.round("score", 9).desc(), "p", "bin"))
    return scored.withColumn("_first", first).where("_first = 1").drop("_first", *[f"_share_{g}" for g in groups])


@dataclass
class Growth:
    """How trees grow. Shares below 1 are drawn: rows for a tree by a digest of their key, features for a tree or (``by_node``) a node.

    gain_threshold: the least weighted share of its groups' variation that a split must explain. weight_mode: "fixed", or group weights drawn
    anew for each node, "dirichlet" (with ``alpha``) or "onehot".
    """

    depth: int = 3
    bins: int = 32
    min_leaf: int = 5
    how: str = "score"
    row_share: float = 1.0
    feature_share: float = 1.0
    by_node: bool = True
    gain_threshold: float = 0.0
    weight_mode: str = "fixed"
    alpha: float = 1.0

    def __post_init__(self):
        if self.how not in ("score", "rank") or self.weight_mode not in ("fixed", "dirichlet", "onehot"):
            raise ValueError(f"how: {self.how}, weight_mode: {self.weight_mode}")
        if self.depth < 0 or self.bins < 2 or self.min_leaf < 1 or not 0 < self.row_share <= 1 or not 0 < self.feature_share <= 1:
            raise ValueError("depth is at least 0, bins at least 2, min_leaf at least 1, shares are over 0 and at most 1")


def draw(key: list[str], seed: Column | int) -> Column:
    """A number in 0..2**32-1 for a row, by a digest of its key and a seed: the same on any cluster."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(k).cast("string") for k in key], (F.lit(seed) if isinstance(seed, int) else seed).cast("string"))), 1, 8), 16, 10).cast("bigint")


def prepared(rows: DataFrame, features: list[str], labels: list[str], bins: int, key: list[str], edges: list | None = None, held: str | None = None, raw: bool = False) -> tuple[DataFrame, list]:
    """(key.., bins, [x,] labels..) as a stored table, and the bins' edges: the design is worked out once, whatever is grown on it.

    held: a boolean column of the key; such rows don't make the bins. ``raw``: keeps the features as ``x``, which boosting needs.
    """
    design = cut(rows.select(*key, *features, *[F.col(x).cast("double").alias(x) for x in labels if x not in features]))
    edges = bin_edges(design if held is None else design.where(~F.col(held)), features, bins) if edges is None else edges
    values = [F.array(*[F.col(f).cast("double") for f in features]).alias("x")] if raw else []
    return cut(binned(design, features, edges).select(*key, "bins", *values, *[F.col(x).cast("double").alias(x) for x in labels])), edges


def grow(rows: DataFrame, features: list[str], objective: Objective, depth: int = 3, bins: int = 32, min_leaf: int = 5, how: str = "score", edges: list | None = None) -> list[Node]:
    """One tree; node ids are issued in order of level and id."""
    data, edges = prepared(rows, features, objective.labels, bins, [], edges)
    return grow_many(data, edges, objective, Growth(depth, bins, min_leaf, how), [0], [])[0]


def _table(values: list[list], kind: str) -> Column:
    """A constant array of arrays: its elements are looked up, not searched."""
    return F.from_json(F.lit(json.dumps(values)), f"array<array<{kind}>>")


def _column(trees: list[dict[int, Node]], f) -> list[list]:
    return [[f(t[i]) for i in sorted(t)] for t in trees]


def _walk(tree: Column, splits: list[Column], levels: int, place) -> Column:
    """The node that a row ends in, of tree number ``tree``; place(feature, node) tells whether it goes left."""
    feature, left = (lambda n: F.get(F.get(splits[0], tree), n)), (lambda n: F.get(F.get(splits[1], tree), n))
    step = lambda n, _: F.when(feature(n) < 0, n).when(place(feature(n), n), left(n)).otherwise(left(n) + 1)
    return F.aggregate(F.sequence(F.lit(1), F.lit(levels)), F.lit(0), step) if levels else F.lit(0)


def _assigned(data: DataFrame, trees: list[dict[int, Node]], cuts: list[dict[int, int]], open_: list[set], levels: int, growth: Growth, seeds: list[int], key: list[str]) -> DataFrame:
    """data with ``node`` (tree << 32 | node id), a row for each tree that drew it and has it in an open node."""
    splits = [_table(_column(trees, lambda x: x.feature), "int"), _table(_column(trees, lambda x: x.left), "int")]
    bins = _table([[c.get(i, -1) for i in sorted(t)] for t, c in zip(trees, cuts, strict=True)], "int")
    live = _table([[int(i in o) for i in sorted(t)] for t, o in zip(trees, open_, strict=True)], "int")
    seed = F.from_json(F.lit(json.dumps(seeds)), "array<bigint>")

    def of(t: Column) -> Column:
        node = _walk(t, splits, levels, lambda f, n: F.get("bins", f) <= F.get(F.get(bins, t), n))
        found = F.get(F.transform(F.array(node), lambda n: F.when(F.get(F.get(live, t), n) == 1, F.shiftleft(t.cast("bigint"), 32) + n)), 0)
        return found if growth.row_share >= 1 else F.when(draw(key, F.get(seed, t)) < int(growth.row_share * 2**32), found)

    nodes = F.array_compact(F.transform(F.sequence(F.lit(0), F.lit(len(trees) - 1)), of))
    return data.withColumn("node", F.explode(nodes))


def _node_table(spark, trees: list[dict[int, Node]], open_: list[set], objective: Objective, growth: Growth, width: int, draws: list[np.random.RandomState], own: list) -> tuple[DataFrame | None, DataFrame | None]:
    """Small tables of what is drawn for open nodes: (node, p) of the features allowed, (node, w_g..) of the weights."""
    n = min(width, int(growth.feature_share * width) + 1) if growth.feature_share < 1 else width
    allowed, weights, groups = [], [], sorted(set(objective.groups))
    for t, (some, rng) in enumerate(zip(open_, draws, strict=True)):
        for i in sorted(some):
            if n < width:
                if growth.by_node or own[t] is None:
                    own[t] = rng.permutation(width)[:n].tolist()
                allowed += [((t << 32) + i, p) for p in own[t]]
            if growth.weight_mode == "dirichlet":
                weights.append(((t << 32) + i, *map(float, rng.dirichlet([growth.alpha] * len(groups)))))
            elif growth.weight_mode == "onehot":
                weights.append(((t << 32) + i, *map(float, np.eye(len(groups))[rng.randint(len(groups))])))
    return (spark.createDataFrame(allowed, "node long, p int") if allowed else None, spark.createDataFrame(weights, "node long, " + ", ".join(f"w_{g} double" for g in groups)) if weights else None)


def grow_many(data: DataFrame, edges: list, objective: Objective, growth: Growth, seeds: list[int], key: list[str]) -> list[list[Node]]:
    """A tree for each seed, all grown together: one job a level over ``prepared`` data."""
    spark, labels, groups = data.sparkSession, objective.labels, sorted(set(objective.groups))
    trees: list[dict[int, Node]] = [{0: Node(0, 0, 0, [])} for _ in seeds]
    cuts: list[dict[int, int]] = [{} for _ in seeds]
    open_ = [{0} for _ in seeds]
    draws, own = [np.random.RandomState(s % 2**32) for s in seeds], [None] * len(seeds)
    for r in _assigned(data, trees, cuts, open_, 0, growth, seeds, key).groupBy("node").agg(F.count("*").alias("n"), *[F.avg(x).alias(x) for x in labels]).collect():
        trees[r["node"] >> 32][0] = Node(0, 0, r["n"], [r[x] for x in labels])
    for level in range(growth.depth):
        open_ = [{i for i in o if t[i].n >= 2 * growth.min_leaf} for t, o in zip(trees, open_, strict=True)]
        if not any(open_):
            break
        hist = histogram(_assigned(data, trees, cuts, open_, level, growth, seeds, key), labels, growth.gain_threshold > 0)
        found = split_candidates(hist, objective, growth.min_leaf, sums=True)
        allowed, weights = _node_table(spark, trees, open_, objective, growth, len(edges), draws, own)
        if allowed is not None:
            found = found.join(F.broadcast(allowed), ["node", "p"], "left_semi")  # some rows a node
        if weights is not None:
            found = found.join(F.broadcast(weights), "node")
        open_ = [set() for _ in seeds]
        for r in sorted(best_splits(found, objective, growth.how).collect(), key=lambda r: r["node"]):
            t, i, p = r["node"] >> 32, r["node"] & 0xFFFFFFFF, r["p"]
            if growth.gain_threshold > 0:
                w = [r[f"w_{g}"] if weights is not None else v for g, v in zip(groups, objective.group_weights, strict=False)]
                share = [min(1.0, max(0.0, r[f"gain_{g}"] / r[f"v_{g}"])) if r[f"v_{g}"] > 0 else 0.0 for g in groups]
                if sum(a * b for a, b in zip(share, w, strict=False)) / max(sum(w), 1e-12) < growth.gain_threshold:
                    continue
            x, top = trees[t][i], len(trees[t])
            x.feature, x.threshold, x.left, x.right = p, 0.5 * (edges[p][r["bin"]][1] + edges[p][r["next_bin"]][0]), top, top + 1
            for child, n, total in ((top, r["n_left"], [r[f"l_{y}"] for y in labels]), (top + 1, r["n_right"], [r[f"a_{y}"] - r[f"l_{y}"] for y in labels])):
                trees[t][child] = Node(child, level + 1, n, [s / n for s in total])
            open_[t] |= {top, top + 1}
            cuts[t][i] = r["bin"]
    return [[t[i] for i in sorted(t)] for t in trees]


def node_means(nodes: list[Node]) -> Column:
    """The means of the node of a row with features ``x``."""
    tree = {i.node_id: i for i in nodes}
    splits = [_table(_column([tree], lambda i: i.feature), "int"), _table(_column([tree], lambda i: i.left), "int")]
    thresholds, means = _table(_column([tree], lambda i: i.threshold or 0.0), "double"), _table([i.means for i in nodes], "double")
    node = _walk(F.lit(0), splits, max(i.depth for i in nodes), lambda f, n: F.get("x", f) < F.get(F.get(thresholds, F.lit(0)), n))
    return F.get(means, node)


#: Rounds between two stored tables of residuals: a lost executor repeats no more than that.
STORE_EVERY = 5


@dataclass
class Boosting:
    trees: list[list[Node]]
    rate: float
    history: list[float]


def boost(data: DataFrame, edges: list, objective: Objective, growth: Growth, rounds: int, rate: float, seeds: list[int], key: list[str], held: str | None = None, patience: int = 40, metric: str = "mse", scale: str | None = None, min_delta: float = 0.0) -> Boosting:
    """Boosted trees on ``prepared`` data with ``x``, at any size: a first tree of depth one, unshrunk, then trees on the residuals of all labels.

    held: a boolean column of rows that are not learnt from; their loss over the targets (group 0) ends the rounds after ``patience`` without an
    improvement over ``min_delta``. metric "mase" divides absolute errors by column ``scale`` and leaves out rows without a positive one.
    """
    labels = objective.labels
    targets = [x for x, g in zip(labels, objective.groups, strict=True) if g == min(objective.groups)]
    learnt = lambda d: d if held is None else d.where(~F.col(held))

    def less(d: DataFrame, nodes: list[Node], by: float) -> DataFrame:
        p = d.withColumn("_p", node_means(nodes))
        return p.withColumns({x: F.col(x) - by * F.get("_p", F.lit(k)) for k, x in enumerate(labels)}).drop("_p")

    def loss(d: DataFrame) -> float:
        rows = d.where(F.col(held))
        if metric == "mse":
            e = sum((F.col(x) * F.col(x) for x in targets), F.lit(0.0))
        else:
            rows = rows.where((F.col(scale) > 0) & (F.col(scale) < math.inf))
            e = sum((F.abs(x) for x in targets), F.lit(0.0)) / F.col(scale)
        found = rows.agg(F.avg(e / len(targets))).first()[0]
        return math.nan if found is None else found

    first = grow_many(learnt(data), edges, objective, replace(growth, depth=1, row_share=1.0, feature_share=1.0), seeds[:1], key)[0]
    trees, history, best, best_at = [first], [], math.inf, 0
    left = less(data, first, 1.0)
    for k in range(rounds):
        nodes = grow_many(learnt(left), edges, objective, growth, [seeds[k + 1]], key)[0]
        trees.append(nodes)
        left = less(left, nodes, rate)
        if (k + 1) % STORE_EVERY == 0:
            left = cut(left)
        if held is not None:
            history.append(loss(left))
            if history[-1] < best - max(min_delta, 1e-12 * abs(best) if best < math.inf else 0.0):
                best, best_at = history[-1], k
            elif k - best_at >= patience:
                break
    return Boosting(trees[: best_at + 2] if held is not None else trees, rate, history)


def nodes_frame(spark, nodes: list[Node], tree_id: int = 0) -> DataFrame:
    """A model is a table of nodes."""
    return spark.createDataFrame([(tree_id, x.node_id, x.depth, x.n, x.feature, x.threshold, x.left, x.right, x.means) for x in nodes], "tree_id int, node_id int, depth int, n long, feature int, threshold double, left int, right int, means array<double>")


def leaf(nodes: list[Node], features: list[str], max_depth: int = 99) -> Column:
    """The node that a row ends in, as one nested CASE: for shallow trees."""
    by = {x.node_id: x for x in nodes}

    def at(i: int) -> Column:
        x = by[i]
        if x.threshold is None or x.depth >= max_depth:
            return F.lit(i)
        return F.when(F.col(features[x.feature]) < x.threshold, at(x.left)).otherwise(at(x.right))

    return at(0)


def predict(rows: DataFrame, nodes: list[Node], features: list[str], max_depth: int = 99) -> DataFrame:
    """Adds node_id and ``pred``, the node's means; a depth cap gives the inner node's means."""
    means = F.create_map(*[y for x in nodes for y in (F.lit(x.node_id), F.array(*map(F.lit, x.means)))])
    return rows.withColumn("node_id", leaf(nodes, features, max_depth)).withColumn("pred", F.element_at(means, F.col("node_id")))
