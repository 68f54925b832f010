"""Trees that are grown by sums against plain ones in numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronofold.operators import trees


@pytest.fixture(scope="module")
def data():
    rng = random.Random(11)
    rows = []
    for i in range(500):
        a, b, c = rng.random(), rng.choice([0.0, 1.0, 2.0, 3.0]), rng.gauss(0, 1)
        y = int(rng.random() < (0.85 if (a > 0.6) != (b > 1) else 0.15))
        rows.append((i, a, b, None if rng.random() < 0.2 else float("nan") if rng.random() < 0.1 else c, y, rng.choice([0.5, 1.0, 4.0])))
    return rows


NAMES = ["a", "b", "c"]
SCHEMA = "i long, a double, b double, c double, y int, w double"


def plain_extra(x, y, w, count, depth, least_rows, seed):
    def grow(rows, t, number, level):
        node = trees.Node((w[rows] * y[rows]).sum() / w[rows].sum(), number=number)
        if level < depth and len(rows) >= 2 * least_rows and 0 < (w[rows] * y[rows]).sum() < w[rows].sum():
            cuts = trees.draw_cuts([(x[rows, i].min(), x[rows, i].max()) for i in range(x.shape[1])], max(1, math.isqrt(x.shape[1])), [seed, t, number])
            best, least = None, math.inf
            for i, cut in cuts.items():
                left, right = rows[x[rows, i] <= cut], rows[x[rows, i] > cut]
                if min(len(left), len(right)) < least_rows:
                    continue
                impurity = 0
                for side in (left, right):
                    p = (w[side] * y[side]).sum() / w[side].sum()
                    impurity += w[side].sum() * p * (1 - p)
                if impurity < least - 1e-9:
                    best, least = (i, cut, left, right), impurity
            if best:
                i, node.cut, left, right = best
                node.feature, node.left, node.right = NAMES[i], grow(left, t, 2 * number, level + 1), grow(right, t, 2 * number + 1, level + 1)
        return node

    return [grow(np.arange(len(y)), t, 1, 0) for t in range(count)]


def shape(node):
    """Splits and values, rounded."""
    if node.feature is None:
        return round(node.value, 8)
    return node.feature, round(node.cut, 8), node.missing_left, shape(node.left), shape(node.right)


def test_extra_trees(spark, data):
    rows = [(i, a, b, 0.0 if c is None or math.isnan(c) else c, y, w) for i, a, b, c, y, w in data]
    x, y, w = (np.array([r[1:4] for r in rows]), np.array([r[4] for r in rows], float), np.array([r[5] for r in rows]))
    want = plain_extra(x, y, w, 5, 4, 3, 42)
    for parts in (1, 5):
        made = trees.extra_trees(spark.createDataFrame(rows, SCHEMA).repartition(parts), NAMES, label="y", weight="w", trees=5, depth=4, least_rows=3, seed=42)
        assert [shape(t) for t in made] == [shape(t) for t in want]
    scores = spark.createDataFrame(rows, SCHEMA).select("y", trees.average(made).alias("s")).groupBy("y").agg(F.avg("s").alias("s")).collect()
    by = {r.y: r.s for r in scores}
    assert by[1] > by[0] + 0.05


def plain_boost(x, y, w, edges, how):
    """The same rule on rows instead of histograms: each cut is tried on the node's rows."""
    m = np.full(len(y), math.log((w * y).sum() / w.sum() / (1 - (w * y).sum() / w.sum())))
    made = []
    draw = lambda g: math.copysign(max(abs(g) - how.l1, 0), g)
    for _ in range(how.rounds):
        p = 1 / (1 + np.exp(-m))
        g, h = w * (p - y), w * p * (1 - p)
        worth = lambda rows: draw(g[rows].sum()) ** 2 / (h[rows].sum() + how.l2)
        value = lambda rows: -how.rate * draw(g[rows].sum()) / (h[rows].sum() + how.l2)

        def split(rows):
            best = None
            for i, cuts in enumerate(edges):
                v = x[rows, i]
                gone = np.isnan(v)
                for missing_left in (False, True):
                    for cut in cuts:
                        to_left = np.where(gone, missing_left, v <= cut)
                        left, right = rows[to_left], rows[~to_left]
                        if min(len(left), len(right)) < max(1, how.least_rows) or min(h[left].sum(), h[right].sum()) < how.least_curvature:
                            continue
                        gain = (worth(left) + worth(right) - worth(rows)) / 2 - how.gain
                        if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                            best = gain, i, cut, missing_left, left, right
            return best

        root = trees.Node()
        spots = [(root, np.arange(len(y)), 0)]
        whole = {id(root): np.arange(len(y))}
        while True:
            ready = [(s, node, depth) for node, rows, depth in spots if node.feature is None and (how.leaves or depth < how.depth) and (s := split(rows))]
            if not ready or (how.leaves and len(root.leaves()) >= how.leaves):
                break
            ready.sort(key=lambda r: -r[0][0])
            for (_, i, cut, missing_left, left, right), node, depth in ready[: 1 if how.leaves else None]:
                node.feature, node.cut, node.missing_left = NAMES[i], cut, missing_left
                node.left, node.right = trees.Node(value(left)), trees.Node(value(right))
                spots += [(node.left, left, depth + 1), (node.right, right, depth + 1)]
                whole |= {id(node.left): left, id(node.right): right}
        if root.feature is None:
            break
        for leaf in root.leaves():
            m[whole[id(leaf)]] += leaf.value
        made.append(root)
    return made, m


@pytest.mark.parametrize("how", [trees.Boosting(rounds=3, depth=3, l2=2, l1=0.5, least_curvature=1, bins=8), trees.Boosting(rounds=3, leaves=5, l2=1, least_rows=15, bins=6), trees.Boosting(rounds=2, depth=2, gain=3, bins=4)])
def test_boosting(spark, data, how):
    df = spark.createDataFrame(data, SCHEMA).repartition(4)
    x = np.array([[math.nan if v is None else v for v in r[1:4]] for r in data])
    y, w = np.array([r[4] for r in data], float), np.array([r[5] for r in data])
    shares = [i / how.bins for i in range(1, how.bins)]
    edges = []
    for i in range(3):
        v = np.sort(x[~np.isnan(x[:, i]), i])
        edges.append(sorted({float(v[max(0, math.ceil(s * len(v)) - 1)]) for s in shares}))
    want, margin = plain_boost(x, y, w, edges, how)
    got = trees.boost(df, NAMES, label="y", weight="w", how=how)
    assert [shape(t) for t in got.trees] == [shape(t) for t in want]
    scored = {r.i: r.m for r in df.select("i", got.margin().alias("m")).collect()}
    assert np.allclose([scored[i] for i in range(len(y))], margin)
    loss = lambda s: -(w * (y * np.log(s) + (1 - y) * np.log(1 - s))).sum()
    assert loss(1 / (1 + np.exp(-margin))) < loss(np.full(len(y), (w * y).sum() / w.sum()))


def test_refused(spark):
    frame = lambda rows: spark.createDataFrame(rows, "a double, y int, w double")
    for rows in ([(1.0, 1, 1.0)], [(1.0, 1, 1.0), (2.0, 0, 0.0)], [(1.0, 1, 1.0), (2.0, 0, None)], [(1.0, 2, 1.0), (2.0, 0, 1.0)], []):
        for fit in (trees.extra_trees, trees.boost):
            with pytest.raises(ValueError, match="outcomes"):
                fit(frame(rows), ["a"], label="y", weight="w")


def test_a_feature_of_nulls(spark):
    df = spark.createDataFrame([(None, float(i), i % 2, 1.0) for i in range(40)], "a double, b double, y int, w double")
    model = trees.boost(df, ["a", "b"], label="y", weight="w", how=trees.Boosting(rounds=2, least_curvature=0.1))
    assert all(t.feature == "b" for t in model.trees)
    assert len(trees.extra_trees(df, ["a", "b"], label="y", weight="w", trees=2)) == 2
