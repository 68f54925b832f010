"""Weighted trees that are grown by sums: extremely random ones, and second-order boosting on histograms.

Rows stay where they are.  Each step of growth is one aggregation whose result
is as large as the model (nodes, features and bins), never as the data; it comes
to the driver, where splits are chosen.  A row's node is an expression of its
features, so nothing is shuffled but the sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronofold.staging import written

#: Bins of a feature, at most.
BINS = 32


@dataclass
class Node:
    """A leaf with its value, or a split: rows with feature <= cut go left; those without the feature as ``missing_left`` says."""

    value: float = 0.0
    feature: str | None = None
    cut: float = 0.0
    missing_left: bool = False
    left: Node | None = None
    right: Node | None = None
    number: int = 0

    def column(self, leaf=lambda node: F.lit(node.value)) -> Column:
        if self.feature is None:
            return leaf(self)
        return F.when(_goes_left(self), self.left.column(leaf)).otherwise(self.right.column(leaf))

    def leaves(self) -> list[Node]:
        return [self] if self.feature is None else self.left.leaves() + self.right.leaves()


def _known(feature: str) -> Column:
    """The feature, with NaN as null."""
    c = F.col(feature).cast("double")
    return F.when(~F.isnan(c), c)


def _goes_left(node: Node) -> Column:
    return F.coalesce(_known(node.feature) <= node.cut, F.lit(node.missing_left))


def _checked(df: DataFrame, label: str, weight: str) -> None:
    """Both outcomes, and weights that are finite and positive."""
    w, y = F.col(weight), F.col(label)
    r = df.agg(F.count_if(~F.coalesce((w > 0) & (w < float("inf")), F.lit(False)) | ~F.coalesce(y.isin(0, 1), F.lit(False))).alias("bad"), F.count_distinct(y).alias("n")).first()
    if r.bad or r.n != 2:
        raise ValueError("outcomes must be 0 and 1, both there, and weights finite and positive")


# ---------------------------------------------------------------- extra trees


def extra_trees(df: DataFrame, features: Sequence[str], *, label: str, weight: str, trees: int = 20, depth: int = 8, least_rows: int = 3, tried: int | None = None, seed: int = 0) -> list[Node]:
    """Trees whose cuts are drawn at random: of ``tried`` features of a node (the square root of all), each cut anywhere between its least and greatest value, the one that lowers the weighted Gini impurity most.

    All trees grow at once, level by level, in two aggregations: bounds of the
    features in each node, then sums on both sides of each cut.  Features that
    are missing go right, so fill them in before.  Draws depend on the seed, the
    tree and the node alone, so the result does not depend on partitions.
    """
    _checked(df, label, weight)
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), *[_known(f).alias(f) for f in features])
    tried = tried or max(1, math.isqrt(len(features)))
    made = [Node(number=1) for _ in range(trees)]
    total = rows.agg((F.sum(F.col("_w") * F.col("_y")) / F.sum("_w")).alias("p")).first().p
    for tree in made:
        tree.value = total
    for level in range(depth):
        growing = [(t, leaf) for t, tree in enumerate(made) for leaf in tree.leaves() if leaf.number.bit_length() == level + 1]
        if not growing:
            break
        wanted = F.array(*[F.struct(F.lit(t).alias("t"), tree.column(lambda n: F.lit(n.number)).alias("n")) for t, tree in enumerate(made)])
        placed = rows.select("*", F.inline(wanted)).where(F.col("n") >= 1 << level)
        bounds = {(r.t, r.n): r for r in placed.groupBy("t", "n").agg(F.count("*").alias("_rows"), F.sum("_w").alias("_all"), F.sum(F.col("_w") * F.col("_y")).alias("_pos"), *[f(c).alias(f"{f.__name__}_{i}") for i, c in enumerate(features) for f in (F.min, F.max)]).collect()}
        cuts: dict[tuple[int, int], dict[int, float]] = {}
        for (t, n), r in bounds.items():
            if r._rows >= 2 * least_rows and 0 < r._pos < r._all:
                cuts[t, n] = draw_cuts([(r[f"min_{i}"], r[f"max_{i}"]) for i in range(len(features))], tried, [seed, t, n])
        cuts = {k: c for k, c in cuts.items() if c}
        if not cuts:
            break
        listed = df.sparkSession.createDataFrame([(t, n, [c.get(i) for i in range(len(features))]) for (t, n), c in cuts.items()], "t int, n int, cuts array<double>")
        left = lambda i: F.col(features[i]) <= F.col("cuts")[i]
        w, y = F.col("_w"), F.col("_y")
        sums = [x.alias(f"{name}_{i}") for i in range(len(features)) for name, x in (("w", F.sum(F.when(left(i), w))), ("y", F.sum(F.when(left(i), w * y))), ("k", F.count_if(left(i))))]
        sides = {(r.t, r.n): r for r in placed.join(F.broadcast(listed), ["t", "n"]).groupBy("t", "n").agg(*sums).collect()}
        for t, leaf in growing:
            key = (t, leaf.number)
            if key in cuts:
                r, s = bounds[key], sides[key]
                options = [(i, cut, s[f"w_{i}"], s[f"y_{i}"], s[f"k_{i}"]) for i, cut in cuts[key].items()]
                best = best_gini(options, r._all, r._pos, r._rows, least_rows)
                if best is not None:
                    i, cut, lw, ly, _ = best
                    leaf.feature, leaf.cut = features[i], cut
                    leaf.left, leaf.right = Node(ly / lw, number=2 * leaf.number), Node((r._pos - ly) / (r._all - lw), number=2 * leaf.number + 1)
    return made


def draw_cuts(bounds: Sequence[tuple[float | None, float | None]], tried: int, seed: Sequence[int]) -> dict[int, float]:
    """A cut for each of ``tried`` features of which a node has different values."""
    rng = np.random.default_rng(list(seed))
    out: dict[int, float] = {}
    for i in rng.permutation(len(bounds)).tolist():
        low, high = bounds[i]
        at = rng.random()
        if len(out) < tried and low is not None and low < high:
            out[i] = low + at * (high - low) if low + at * (high - low) < high else low
    return out


def best_gini(options, all_weight: float, positive: float, rows: int, least_rows: int):
    """The option (feature, cut, weight, positive weight and rows to the left) with the least impurity; of equal ones the first."""
    best, least = None, math.inf
    for option in options:
        _, _, lw, ly, k = option
        if k < least_rows or rows - k < least_rows:
            continue
        rw, ry = all_weight - lw, positive - ly
        impurity = ly * (1 - ly / lw) + ry * (1 - ry / rw)
        if impurity < least - 1e-12 * all_weight:
            best, least = option, impurity
    return best


def average(trees: Sequence[Node]) -> Column:
    """The mean of the trees' scores."""
    return sum((t.column() for t in trees[1:]), trees[0].column()) / len(trees)


# ---------------------------------------------------------------- boosting


@dataclass(frozen=True)
class Boosting:
    """Rounds, and how a tree grows: to ``depth`` level by level, or with ``leaves`` by the best split first."""

    rounds: int = 50
    rate: float = 0.1
    depth: int = 3
    leaves: int | None = None
    l2: float = 1.0
    l1: float = 0.0
    gain: float = 0.0
    least_curvature: float = 1.0
    least_rows: int = 1
    bins: int = BINS


@dataclass
class Boosted:
    base: float
    trees: list[Node]

    def margin(self) -> Column:
        return sum((t.column() for t in self.trees), F.lit(self.base))

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.margin()))


def boost(df: DataFrame, features: Sequence[str], *, label: str, weight: str, how: Boosting = Boosting()) -> Boosted:  # noqa: B008  frozen
    """Trees on the gradient and curvature of the weighted log loss.

    Features are cut into bins by quantiles; a node's histogram has the sums of
    gradient and curvature of each bin, and of the rows without the feature,
    which go to the side where they gain more.  A split gains
    s(G_left) ** 2 / (H_left + l2) + s(G_right) ** 2 / (H_right + l2) - s(G) ** 2 / (H + l2),
    half of it, less ``gain``; s draws towards zero by ``l1``.  Each level, or
    each split of a tree that grows by leaves, is one aggregation; margins are
    written after each round.
    """
    _checked(df, label, weight)
    shares = [i / how.bins for i in range(1, how.bins)]
    asked = df.agg((F.sum(F.col(weight) * F.col(label)) / F.sum(weight)).alias("p"), *[F.percentile_approx(_known(f), shares, 10_000).alias(f"e{i}") for i, f in enumerate(features)]).first()
    edges = [sorted(set(asked[f"e{i}"] or [])) for i in range(len(features))]
    base = math.log(asked.p / (1 - asked.p))
    bins = F.array(*[_bin(_known(f), e) for f, e in zip(features, edges, strict=True)])
    rows = df.select(F.col(label).cast("double").alias("_y"), F.col(weight).cast("double").alias("_w"), *[_known(f).alias(f) for f in features], bins.alias("_bins"), F.lit(base).alias("_m"))
    rows, model = written(rows, "boosting"), Boosted(base, [])
    for _ in range(how.rounds):
        p = 1 / (1 + F.exp(-F.col("_m")))
        told = rows.withColumns({"_g": F.col("_w") * (p - F.col("_y")), "_h": F.col("_w") * p * (1 - p)})
        tree = _grow(told, features, edges, how)
        if tree.feature is None:
            break
        model.trees.append(tree)
        rows = written(rows.withColumn("_m", F.col("_m") + tree.column()), "boosting")
    return model


def _bin(c: Column, edges: list[float]) -> Column:
    """How many edges lie below; -1 for missing ones, which counts from the end of a histogram."""
    below = F.filter(F.array(*[F.lit(x) for x in edges]).cast("array<double>"), lambda x: x < c)
    return F.when(c.isNotNull(), F.size(below)).otherwise(-1)


def _grow(rows: DataFrame, features: Sequence[str], edges: list[list[float]], how: Boosting) -> Node:
    root, made = Node(number=0), 1
    open_, ready = [(root, 0)], []
    while open_:
        ready += [(split, leaf, depth) for leaf, depth, h in _histograms(rows, root, open_, len(features), how) if (split := best_split(h, edges, how))]
        ready.sort(key=lambda x: -x[0][0])
        open_ = []
        for _ in range(1 if how.leaves else len(ready)):
            if not ready or (how.leaves and len(root.leaves()) >= how.leaves):
                break
            (_, i, cut, missing_left, left, right), leaf, depth = ready.pop(0)
            leaf.feature, leaf.cut, leaf.missing_left = features[i], cut, missing_left
            leaf.left, leaf.right = Node(left, number=made), Node(right, number=made + 1)
            made += 2
            if how.leaves or depth + 1 < how.depth:
                open_ += [(leaf.left, depth + 1), (leaf.right, depth + 1)]
    return root


def _histograms(rows: DataFrame, root: Node, open_: list[tuple[Node, int]], n: int, how: Boosting):
    """Sums of gradient, curvature and rows for each bin of each feature of the open leaves; the last bin is that of missing ones."""
    numbers = [leaf.number for leaf, _ in open_]
    placed = rows.withColumn("_n", root.column(lambda x: F.lit(x.number))).where(F.col("_n").isin(numbers)).select("_n", "_g", "_h", F.posexplode("_bins").alias("_f", "_b"))
    out = {k: np.zeros((n, how.bins + 1, 3)) for k in numbers}
    for r in placed.groupBy("_n", "_f", "_b").agg(F.sum("_g").alias("g"), F.sum("_h").alias("h"), F.count("*").alias("k")).collect():
        out[r._n][r._f, r._b] = r.g, r.h, r.k
    return [(leaf, depth, out[leaf.number]) for leaf, depth in open_]


def best_split(histogram: np.ndarray, edges: list[list[float]], how: Boosting):
    """(gain, feature, cut, missing go left, value left, value right) of the best split of a node; None if none gains.  Of equal ones the first feature, cut and side."""
    drawn = lambda g: np.sign(g) * np.maximum(np.abs(g) - how.l1, 0)
    worth = lambda x: drawn(x[..., 0]) ** 2 / (x[..., 1] + how.l2)
    value = lambda x: float(-how.rate * drawn(x[0]) / (x[1] + how.l2))
    best = None
    for i, cuts in enumerate(edges):
        missing, total = histogram[i, -1], histogram[i].sum(axis=0)
        upto = np.cumsum(histogram[i, : len(cuts)], axis=0)
        for missing_left in (False, True):
            left = upto + missing * missing_left
            right = total - left
            gain = (worth(left) + worth(right) - worth(total)) / 2 - how.gain
            fits = np.minimum(left[:, 1], right[:, 1]) >= how.least_curvature
            fits &= np.minimum(left[:, 2], right[:, 2]) >= max(1, how.least_rows)
            gain = np.where(fits, gain, -np.inf)
            k = int(np.argmax(gain)) if len(cuts) else -1
            if k >= 0 and gain[k] > 1e-9 and (best is None or gain[k] > best[0] + 1e-9):
                best = (float(gain[k]), i, cuts[k], missing_left, value(left[k]), value(right[k]))
    return best
