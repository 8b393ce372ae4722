"""Boosted trees against a plain grower that looks at every cut of every node."""

import math

import numpy as np
import pytest

from navspark.plans.boosting import GRAIN, Growth, boost, in_sample, leaf_of

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(7)
    x = np.round(draw.normal(size=(500, 4)), 2)
    x[:, 3] = draw.integers(0, 3, 500)
    y = ((x[:, 0] * x[:, 1] > 0) ^ (draw.random(500) < 0.1)).astype(int)
    return [(*map(float, v), int(t)) for v, t in zip(x, y, strict=True)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y int").repartition(parts)


def plain(rows, cuts, growth):
    """Scores of all rows; every tree as a list of nodes."""
    bins = np.array([[sum(e < v for e in edges) for v, edges in zip(r[:4], cuts, strict=True)] for r in rows])
    y = np.array([r[4] for r in rows], float)
    margin = np.full(len(y), math.log(y.mean() / (1 - y.mean())))
    counts = []
    for _ in range(growth.rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * GRAIN), np.rint(p * (1 - p) * GRAIN)

        def value(own):
            return -growth.step * (g[own].sum() / GRAIN) / (h[own].sum() / GRAIN + growth.l2)

        def best(own, depth):
            found = (0.0, None)
            if growth.depth is not None and depth >= growth.depth:
                return found
            score = lambda s: (g[s].sum() / GRAIN) ** 2 / (h[s].sum() / GRAIN + growth.l2)
            for f in range(4):
                for c in range(growth.bins - 1):
                    left, right = own & (bins[:, f] <= c), own & (bins[:, f] > c)
                    if min(left.sum(), right.sum()) < max(1, growth.min_rows) or min(h[left].sum(), h[right].sum()) < growth.min_hessian * GRAIN:
                        continue
                    gain = score(left) + score(right) - score(own)
                    if gain > found[0]:
                        found = (gain, (left, right))
            return found

        everything = np.ones(len(y), bool)
        leaves = [(everything, 0, best(everything, 0))]
        while growth.leaves is None or len(leaves) < growth.leaves:
            at = max(range(len(leaves)), key=lambda i: leaves[i][2][0])
            own, depth, (gain, sides) = leaves[at]
            if not gain > 0:
                break
            leaves.pop(at)
            leaves += [(s, depth + 1, best(s, depth + 1)) for s in sides]
        counts.append((len(leaves), max(d for _, d, _ in leaves)))
        for own, _, _ in leaves:
            margin = margin + value(own) * own
    return 1 / (1 + np.exp(-margin)), counts


LEVEL = Growth(rounds=4, step=0.3, depth=4, l2=1.0, min_hessian=1.0, bins=16)
LEAF = Growth(rounds=4, step=0.1, depth=None, leaves=9, l2=0.0, min_hessian=1e-3, min_rows=20, bins=16)


def shape(tree):
    left, depth = tree[2], [0] * len(tree[2])
    for node in range(len(left)):
        if left[node] >= 0:
            depth[tree[2][node]] = depth[tree[3][node]] = depth[node] + 1
    return int((left < 0).sum()), max(depth)


@pytest.mark.parametrize("growth", [LEVEL, LEAF], ids=["level", "leaf"])
def test_equals_plain_grower(spark, rows, growth):
    model = boost(frame(spark, rows), COLUMNS, "y", growth)
    expected, counts = plain(rows, model.cuts, growth)
    assert [shape(t) for t in model.trees] == counts
    scored = model.score(frame(spark, rows, 2)).collect()
    found = {tuple(r[:5]): r["score"] for r in scored}
    for r, s in zip(rows, expected, strict=True):
        assert found[r] == pytest.approx(s, abs=1e-9)
    assert all(r["pred"] == (r["score"] > 0.5) for r in scored)
    again = boost(frame(spark, rows, 9), COLUMNS, "y", growth)
    assert all((a == b).all() for s, t in zip(model.trees, again.trees, strict=True) for a, b in zip(s, t, strict=True))


def test_policies_grow_different_trees(spark, rows):
    table = frame(spark, rows)
    level = boost(table, COLUMNS, "y", Growth(rounds=1, depth=3, bins=16))
    leaf = boost(table, COLUMNS, "y", Growth(rounds=1, depth=None, leaves=12, bins=16, min_rows=3, l2=0.0, min_hessian=1e-3))
    assert shape(level.trees[0])[1] == 3
    assert shape(leaf.trees[0])[0] == 12 and shape(leaf.trees[0]) != shape(level.trees[0])


def test_sampling_and_margins_kept(spark, rows):
    growth = Growth(rounds=11, depth=2, subsample=0.8, columns=0.5, bins=16)
    model = boost(frame(spark, rows), COLUMNS, "y", growth)
    # Half of the columns are open to each tree, but not to all the same.
    used = [set(t[0][t[2] >= 0].tolist()) for t in model.trees]
    assert all(len(u) <= 2 for u in used) and len(set().union(*used)) > 2
    share = in_sample(np.arange(100_000), 3, growth).mean()
    assert share == pytest.approx(0.8, abs=0.01)
    right = model.score(frame(spark, rows)).where("pred = y").count()
    assert right > 0.7 * len(rows)


def test_odd_tables(spark):
    for rows in ([], [(1.0, 1.0, 1.0, 1.0, 1)] * 5, [(None, float("nan"), 0.0, 0.0, i % 2) for i in range(6)]):
        model = boost(frame(spark, rows), COLUMNS, "y", Growth(rounds=2, depth=2, bins=8))
        out = model.score(frame(spark, rows)).collect()
        assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)


def test_rows_reach_their_leaf():
    tree = (np.array([0, 0, 1, 0, 0]), np.array([3, 0, 0, 0, 0]), np.array([1, -1, 3, -1, -1]), np.array([2, -1, 4, -1, -1]), np.zeros(5))
    assert leaf_of(tree, np.array([[3, 9], [4, 0], [4, 1]], np.uint8)).tolist() == [1, 3, 4]
