"""Deep forests against a plain recursive grower on the same draws."""

import numpy as np
import pytest

from navspark.plans.forest import _KINDS, Forest, child, draws, feature_order, grow_forest

COLUMNS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def rows():
    draw = np.random.default_rng(11)
    x = np.round(draw.normal(size=(400, 4)), 1)
    x[:, 3] = 7.0
    y = ((x[:, 0] * x[:, 1] > 0) ^ (draw.random(400) < 0.15)).astype(int)
    return [(*map(float, v), int(t)) for v, t in zip(x, y, strict=True)]


def frame(spark, rows, parts=3):
    return spark.createDataFrame(rows, "a double, b double, c double, d double, y int").repartition(parts)


def hashes(spark, rows):
    found = frame(spark, rows).selectExpr("xxhash64(y, a, b, c, d) AS row", "a", "b", "c", "d", "y").collect()
    return {tuple(r[1:]): r["row"] for r in found}


def plain(rows, row_of, forest, tree):
    """Share of class 1 in the leaf of each row; depths and sizes of the nodes that were cut."""
    ids = np.array([row_of[r] for r in rows], np.int64)
    w, y = draws(ids, tree, forest.seed).astype(float), np.array([r[4] for r in rows])
    x = np.array([r[:4] for r in rows])
    k = np.array(forest.weights)[y] * w
    out, made = np.full(len(rows), np.nan), []

    def cost(who):
        a, b = k[who & (y == 0)].sum(), k[who & (y == 1)].sum()
        return 2 * a * b / (a + b)

    def grow(sampled, all_rows, path, depth):
        n = int(sampled.sum())
        best = None
        if n >= forest.min_split and len(set(y[sampled])) == 2 and (forest.depth is None or depth < forest.depth):
            looked, varied = 0, 0
            for f in feature_order(tree, path, 4, forest.seed):
                if looked >= 2 and varied:
                    break
                looked += 1
                values = np.unique(x[sampled, f])
                varied += len(values) > 1
                for low, high in zip(values[:-1], values[1:], strict=True):
                    left, right = sampled & (x[:, f] <= low), sampled & (x[:, f] >= high)
                    if min(left.sum(), right.sum()) < forest.min_leaf:
                        continue
                    found = cost(left) + cost(right)
                    if best is None or found < best[0] - 1e-9:
                        best = (found, f, (low + high) / 2)
        if best is None:
            a, b = k[sampled & (y == 0)].sum(), k[sampled & (y == 1)].sum()
            out[all_rows] = b / (a + b)
            return
        made.append((depth, n))
        goes = x[:, best[1]] <= best[2]
        grow(sampled & goes, all_rows & goes, child(path, 0), depth + 1)
        grow(sampled & ~goes, all_rows & ~goes, child(path, 1), depth + 1)

    grow(w > 0, np.ones(len(rows), bool), 1, 0)
    return out, made


def scores(model, table):
    return {tuple(r[:5]): r["score"] for r in model.score(table).collect()}


@pytest.mark.parametrize(
    "forest",
    [Forest(trees=3, together=2), Forest(trees=3, min_split=5, min_leaf=2, balanced=True), Forest(trees=2, depth=3)],
    ids=["default", "adjusted", "shallow"],
)
def test_equals_plain_grower(spark, rows, forest):
    row_of = hashes(spark, rows)
    sizes = [sum(r[4] == c for r in rows) for c in (0, 1)]
    weighted = Forest(**{**forest.__dict__, "weights": tuple(len(rows) / (2 * s) for s in sizes) if forest.balanced else (1.0, 1.0)})
    expected = np.mean([plain(rows, row_of, weighted, t)[0] for t in range(forest.trees)], axis=0)
    found = scores(grow_forest(frame(spark, rows), COLUMNS, "y", forest), frame(spark, rows, 2))
    assert [found[r] for r in rows] == pytest.approx(expected.tolist(), abs=1e-9)


@pytest.mark.parametrize("handoff", [300, 60, 12])
def test_where_nodes_are_handed_over_changes_nothing(spark, rows, handoff):
    whole = scores(grow_forest(frame(spark, rows), COLUMNS, "y", Forest(trees=3)), frame(spark, rows))
    model = grow_forest(frame(spark, rows, 5), COLUMNS, "y", Forest(trees=3, handoff=handoff))
    assert handoff >= 300 or all(len(top[0]) > 3 for tops, _ in model.groups for top in tops.values())
    # Rows that a tree has not drawn may lie between two of its cuts; those drawn by all trees go the same way.
    row_of = hashes(spark, rows)
    ids = np.array([row_of[r] for r in rows], np.int64)
    drawn = np.all([draws(ids, t, 42) > 0 for t in range(3)], axis=0)
    found = scores(model, frame(spark, rows))
    inside = [r for r, d in zip(rows, drawn, strict=True) if d]
    assert len(inside) > 50
    assert [found[r] for r in inside] == pytest.approx([whole[r] for r in inside], abs=1e-9)


def cut_nodes(model):
    """(depth, left, right) walks of every subtree: depths of its cut nodes."""
    for _, subtrees in model.groups:
        for r in subtrees.collect():
            left, right = (np.frombuffer(r[c], k) for c, k in (("left", _KINDS[2]), ("right", _KINDS[3])))
            depth = np.zeros(len(left), int)
            for i in range(len(left)):
                if left[i] >= 0:
                    depth[left[i]] = depth[right[i]] = depth[i] + 1
            yield depth.max(), left


def test_deeper_than_thirty_and_no_small_node_is_cut(spark):
    chain = spark.createDataFrame([(float(i), 0.0, i % 2) for i in range(400)], "a double, b double, y int")
    model = grow_forest(chain, ["a", "b"], "y", Forest(trees=4))
    deepest = max(d for d, _ in cut_nodes(model))
    assert deepest > 30
    # With a least size of 5, every node that is cut holds five drawn rows at least.
    ids = {r["a"]: r["row"] for r in chain.selectExpr("xxhash64(y, a, b) AS row", "a").collect()}
    careful = grow_forest(chain, ["a", "b"], "y", Forest(trees=4, min_split=5))
    for tree in range(4):
        w = draws(np.array([ids[float(i)] for i in range(400)], np.int64), tree, 42)
        record = careful.groups[0][1].where(f"tree = {tree}").first()
        feature, cut, left, right, _ = (np.frombuffer(record[c], k) for c, k in zip(("feature", "cut", "left", "right", "value"), _KINDS, strict=True))
        own = {0: np.flatnonzero(w > 0)}
        for node in range(len(left)):
            if left[node] >= 0:
                assert len(own[node]) >= 5 and feature[node] == 0
                goes = own[node] <= cut[node]
                own[left[node]], own[right[node]] = own[node][goes], own[node][~goes]


def test_partitions_do_not_matter_and_columns_stay(spark, rows):
    one = scores(grow_forest(frame(spark, rows, 1), COLUMNS, "y", Forest(trees=3, handoff=50)), frame(spark, rows, 1))
    many = scores(grow_forest(frame(spark, rows, 11), COLUMNS, "y", Forest(trees=3, handoff=50)), frame(spark, rows, 7))
    assert one == many
    model = grow_forest(frame(spark, rows), COLUMNS, "y", Forest(trees=5))
    out = model.score(frame(spark, rows).selectExpr("*", "'x' AS tree", "1 AS node"))
    assert out.columns == [*COLUMNS, "y", "tree", "node", "score", "pred"]
    assert out.where("pred = y").count() > 0.8 * len(rows)


def test_draws_are_a_bootstrap():
    w = draws(np.arange(200_000), 3, 42)
    assert w.mean() == pytest.approx(1.0, abs=0.01) and (w == 0).mean() == pytest.approx(np.exp(-1), abs=0.005)
    assert (w != draws(np.arange(200_000), 4, 42)).mean() > 0.5


def test_odd_tables(spark):
    same = [(1.0, 1.0, 1.0, 1.0, i % 2) for i in range(40)]
    for rows in ([], [(1.0, 1.0, 1.0, 1.0, 1)] * 5, [(None, float("nan"), 0.0, 0.0, i % 2) for i in range(6)], same):
        for handoff in (1000, 2):
            out = grow_forest(frame(spark, rows), COLUMNS, "y", Forest(trees=3, handoff=handoff)).score(frame(spark, rows)).collect()
            assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)


def test_a_subtree_travels_once_however_many_slices_end_in_its_node(spark, rows, monkeypatch):
    model = grow_forest(frame(spark, rows), COLUMNS, "y", Forest(trees=3, handoff=60))
    expected = scores(model, frame(spark, rows))
    monkeypatch.setattr("navspark.plans.forest._SLICE", 5)
    assert scores(model, frame(spark, rows)) == expected
    # Joined, every slice would carry a copy of its subtree to Python.
    plan = model.votes(frame(spark, rows).selectExpr("monotonically_increasing_id() AS __row", "*"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
