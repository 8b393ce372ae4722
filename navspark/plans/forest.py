"""Random forests without a depth limit: large nodes by histograms, small ones whole in their own task.

While a node holds more than ``handoff`` rows, counts by (node, feature, bin) are added up in the tasks and a small
group per node finds its cut. A node of at most ``handoff`` rows is handed over: its rows meet in one group, which
grows everything below it on exact values. Counts are whole numbers and every draw is a hash, so neither the partitioning
nor a repeated task can move a cut. Subtrees stay a table; rows to be scored are joined to those they end in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navspark.plans.boosting import Tree, _floats, _matrix, binned, leaf_of, quantile_cuts
from navspark.session import stage

#: Votes are added as whole multiples of this share.
VOTE = float(1 << 40)
#: Nodes counted in a task before it passes their counts on.
_HELD = 256
#: Partial counts of so many tasks are added before the last step.
_PARTS = 64
#: Rows that travel to their subtree together.
_SLICE = 2048
#: Chances of a row to be drawn at most 0, 1, 2, ... times (Poisson with mean 1).
_DRAWN = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))


@dataclass(frozen=True)
class Forest:
    """How a forest grows. ``features`` None looks at the square root of the columns in each node; ``weights`` are those of classes 0 and 1."""

    trees: int = 500
    depth: int | None = None
    min_split: int = 2
    min_leaf: int = 1
    features: int | None = None
    balanced: bool = False
    weights: tuple[float, float] = (1.0, 1.0)
    bins: int = 256
    handoff: int = 32_768
    together: int = 64
    seed: int = 42


def _mixed(x: np.ndarray) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(rows: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's bootstrap sample, by the row's hash."""
    key = np.uint64((seed * 1_000_003 + tree + 1) * 0x9E3779B97F4A7C15 % 2**64)
    share = (_mixed(rows.view(np.uint64) ^ key) >> np.uint64(11)).astype(float) / 2.0**53
    return np.searchsorted(_DRAWN, share, side="right").astype(np.uint8)


def child(path: int, side: int) -> int:
    """The number of a child, which stands for the way to it from the root (number 1)."""
    return int(_mixed(np.array([path * 2 + side + 1], np.uint64))[0] >> np.uint64(2))


def feature_order(tree: int, path: int, width: int, seed: int) -> np.ndarray:
    return np.random.default_rng([seed, tree, path]).permutation(width)


def gains(left: np.ndarray, total: np.ndarray, forest: Forest) -> np.ndarray:
    """Gini gain, up to a constant of the node, of cuts with the sums ``left`` (rows, draws of class 0, of class 1); -1 where not allowed."""
    k = np.array(forest.weights)
    right = total[:, None] - left
    out = np.zeros(left.shape[1])
    for part in (left, right):
        a, b = part[1] * k[0], part[2] * k[1]
        out += (a * a + b * b) / np.maximum(a + b, 1e-300)
    least = max(1, forest.min_leaf)
    return np.where((left[0] >= least) & (right[0] >= least), out, -1.0)


def search(order: Iterable[int], look: Callable[[int], tuple | None], most: int) -> tuple[tuple | None, bool]:
    """Best cut of a node, and whether any feature looked at varies.

    ``look`` gives (gain, ...) of a feature, None if it is constant in the node. More than ``most`` features are looked at
    only while all were constant. Of equal gains the first feature's counts.
    """
    best, varies = None, False
    for seen, f in enumerate(order):
        if seen >= most and varies:
            break
        if (found := look(f)) is None:
            continue
        varies = True
        if found[0] >= 0 and (best is None or found[0] > best[1]):
            best = (int(f), *found)
    return best, varies


def _ends(total: np.ndarray, depth: int, forest: Forest) -> bool:
    """Whether a node with these sums must be a leaf."""
    return total[0] < max(2, forest.min_split) or not total[1] or not total[2] or (forest.depth is not None and depth >= forest.depth)


def _share(total: np.ndarray, forest: Forest) -> float:
    a, b = total[1] * forest.weights[0], total[2] * forest.weights[1]
    return float(b / (a + b)) if a + b > 0 else 0.0


def _most(forest: Forest, width: int) -> int:
    return forest.features or max(1, int(width**0.5))


def subtree(x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: int, path: int, depth: int, forest: Forest) -> tuple:
    """(feature, cut, left, right, value) of everything below a node, from its rows; cuts lie midway between values."""
    width = x.shape[1]
    most = _most(forest, width)
    sums = np.stack([np.ones(len(y), np.int64), np.where(y == 0, w, 0), np.where(y == 1, w, 0)]).astype(np.int64)
    out = Tree()
    work = [(0, np.arange(len(y)), path, depth)]
    while work:
        node, own, path, depth = work.pop()
        total = sums[:, own].sum(axis=1)
        best = None
        if not _ends(total, depth, forest):

            def look(f: int, own=own, total=total):
                v = x[own, f]
                by = np.argsort(v, kind="stable")
                v = v[by]
                steps = np.flatnonzero(v[1:] > v[:-1])
                if not len(steps):
                    return None
                gain = gains(sums[:, own[by]].cumsum(axis=1)[:, steps], total, forest)
                at = int(gain.argmax())
                low, high = v[steps[at]], v[steps[at] + 1]
                middle = low / 2 + high / 2
                return gain[at], middle if low <= middle < high else low

            best, _ = search(feature_order(tree, path, width, forest.seed), look, most)
        if best is None:
            out.value[node] = _share(total, forest)
            continue
        f, _, cut = best
        goes = x[own, f] <= cut
        for side, (new, rows) in enumerate(zip(out.add(node, f, cut), (own[goes], own[~goes]), strict=True)):
            work.append((new, rows, child(path, side), depth + 1))
    return out.arrays()


def _state(rows: DataFrame, columns: list[str], y: str, cuts: list[np.ndarray]) -> DataFrame:
    """(row, y, bins, x): equal rows have one hash and are drawn alike; missing values lie below all others."""
    values = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    chosen = rows.select(F.col(y).cast("int").alias("y"), *values)
    chosen = chosen.select(F.xxhash64("y", *[f"c{i}" for i in range(len(columns))]).alias("row"), "y", *[f"c{i}" for i in range(len(columns))])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [_floats(batch.column(i + 2)) for i in range(len(cuts))]
            bins, exact = binned(values, cuts), _exact(values)
            packed = [pa.array([r.tobytes() for r in m], pa.binary()) for m in (bins, exact)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["row", "y", "bins", "x"])

    return stage(chosen.mapInArrow(pack, "row long, y int, bins binary, x binary"), "forest")


def _exact(values: list[np.ndarray]) -> np.ndarray:
    x = np.column_stack(values)
    return np.where(np.isnan(x), -np.inf, x)


def _counts(state: DataFrame, tops: dict[int, tuple], asked: dict[tuple[int, int], np.ndarray], width: int, forest: Forest) -> DataFrame:
    """(tree, node, part, h): counts of the rows in each node asked for, by feature in the order asked, kind of sum and bin."""
    shared = state.sparkSession.sparkContext.broadcast((tops, asked))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, asked = shared.value
        held: dict[tuple[int, int], np.ndarray] = {}

        def passed_on(part: int) -> pa.RecordBatch:
            keys = list(held)
            columns = [[k[0] for k in keys], [k[1] for k in keys], [part] * len(keys), [held[k].tobytes() for k in keys]]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["tree", "node", "part", "h"])

        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, y, bins = np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2), width)
            part = int(rows[0]) % _PARTS
            for tree, top in tops.items():
                w = draws(rows, tree, forest.seed)
                at = leaf_of(top, bins)
                for node in np.unique(at[w > 0]).tolist():
                    if (tree, node) not in asked:
                        continue
                    own = np.flatnonzero((at == node) & (w > 0))
                    features = asked[tree, node]
                    h = held.setdefault((tree, node), np.zeros((len(features), 3, forest.bins), np.int64))
                    weights = (None, np.where(y[own] == 0, w[own], 0), np.where(y[own] == 1, w[own], 0))
                    for i, f in enumerate(features):
                        for kind, weight in enumerate(weights):
                            h[i, kind] += np.bincount(bins[own, f], weight, forest.bins).astype(np.int64)
                    if len(held) >= _HELD:
                        yield passed_on(part)
        if held:
            yield passed_on(part)

    schema = "tree int, node int, part int, h binary"

    def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = np.frombuffer(rows["h"].iloc[0], np.int64).copy()
        for h in rows["h"].iloc[1:]:
            total += np.frombuffer(h, np.int64)
        return pd.DataFrame([[*key, total.tobytes()]], columns=["tree", "node", "part", "h"])

    return state.select("row", "y", "bins").mapInArrow(add, schema).groupBy("tree", "node", "part").applyInPandas(together, schema)


def _cuts(counts: DataFrame, asked: dict[tuple[int, int], np.ndarray], width: int, forest: Forest) -> list:
    """(tree, node, varies, feature, cut, sums in all, sums left) of each counted node; no feature where none may be cut."""
    shared = counts.sparkSession.sparkContext.broadcast(asked)
    most = _most(forest, width)

    def best(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        features = shared.value[key]
        h = sum(np.frombuffer(b, np.int64) for b in rows["h"]).reshape(len(features), 3, forest.bins)
        total = h[0].sum(axis=1)
        place = {f: i for i, f in enumerate(features.tolist())}

        def look(f: int):
            own = h[place[f]]
            if np.count_nonzero(own[0]) < 2:
                return None
            left = own.cumsum(axis=1)[:, :-1]
            gain = gains(left, total, forest)
            at = int(gain.argmax())
            return gain[at], at, left[:, at]

        found, varies = search(features.tolist(), look, most)
        f, _, cut, left = found or (None, 0.0, None, np.zeros(3, np.int64))
        return pd.DataFrame([[*key, varies, f, cut, total.tolist(), left.tolist()]], columns=["tree", "node", "varies", "feature", "cut", "total", "left"])

    return counts.groupBy("tree", "node").applyInPandas(best, "tree int, node int, varies boolean, feature int, cut int, total array<long>, left array<long>").collect()


_SUBTREE = "tree int, node int, feature binary, cut binary, left binary, right binary, value binary"
_KINDS = (np.int32, np.float64, np.int32, np.int32, np.float64)


def _packed(tree: int, node: int, arrays: tuple) -> list:
    return [tree, node, *[np.asarray(a).astype(k).tobytes() for a, k in zip(arrays, _KINDS, strict=True)]]


def _tops(state: DataFrame, trees: range, n: int, width: int, forest: Forest) -> tuple[dict[int, Tree], dict[tuple[int, int], tuple[int, int]], list]:
    """Upper parts of trees; (path, depth) of the nodes to hand over; and the leaves among the large nodes."""
    tops = {t: Tree() for t in trees}
    most = _most(forest, width)
    handed, leaves, asked = {}, [], {}
    places = {(t, 0): (1, 0) for t in trees}
    if n <= forest.handoff:
        return tops, places, leaves
    order = {key: feature_order(key[0], places[key][0], width, forest.seed) for key in places}
    asked = {key: order[key][:most] for key in places}
    while asked:
        current = {t: tops[t].arrays() for t in {k[0] for k in asked}}
        again: dict[tuple[int, int], np.ndarray] = {}
        for r in _cuts(_counts(state, current, asked, width, forest), asked, width, forest):
            key, total = (r["tree"], r["node"]), np.array(r["total"])
            path, depth = places[key]
            if total[0] <= forest.handoff:
                handed[key] = places[key]
            elif not r["varies"] and len(asked[key]) < width:
                again[key] = order[key]
            elif r["feature"] is None or _ends(total, depth, forest):
                leaves.append(_packed(*key, ([0], [0.0], [-1], [-1], [_share(total, forest)])))
            else:
                left = np.array(r["left"])
                for side, (new, own) in enumerate(zip(tops[key[0]].add(key[1], r["feature"], r["cut"]), (left, total - left), strict=True)):
                    below = (key[0], new)
                    places[below] = (child(path, side), depth + 1)
                    if own[0] <= forest.handoff:
                        handed[below] = places[below]
                    elif _ends(own, depth + 1, forest):
                        leaves.append(_packed(*below, ([0], [0.0], [-1], [-1], [_share(own, forest)])))
                    else:
                        order[below] = feature_order(below[0], places[below][0], width, forest.seed)
                        again[below] = order[below][:most]
        asked = again
    return tops, handed, leaves


def _finished(state: DataFrame, tops: dict[int, tuple], handed: dict[tuple[int, int], tuple[int, int]], width: int, forest: Forest) -> DataFrame:
    """Subtrees of the nodes handed over, each grown where its rows meet."""
    shared = state.sparkSession.sparkContext.broadcast((tops, handed))

    def hand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tops, handed = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, y, bins = np.asarray(batch.column(0)), np.asarray(batch.column(1)).astype(np.uint8), _matrix(batch.column(2), width)
            x = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.float64).reshape(-1, width)
            for tree, top in tops.items():
                w, at = draws(rows, tree, forest.seed), leaf_of(top, bins)
                out = []
                for node in np.unique(at[w > 0]).tolist():
                    if (tree, node) in handed:
                        own = np.flatnonzero((at == node) & (w > 0))
                        out.append((tree, node, y[own].tobytes(), w[own].tobytes(), x[own].tobytes()))
                if out:
                    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds, strict=True)], ["tree", "node", "y", "w", "x"])

    def finish(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        y, w = (np.frombuffer(b"".join(rows[c]), np.uint8) for c in ("y", "w"))
        x = np.frombuffer(b"".join(rows["x"]), np.float64).reshape(-1, width)
        path, depth = shared.value[1][key]
        return pd.DataFrame([_packed(*key, subtree(x, y, w, key[0], path, depth, forest))], columns=[c.split()[0] for c in _SUBTREE.split(", ")])

    moved = state.mapInArrow(hand, "tree int, node int, y binary, w binary, x binary")
    return moved.groupBy("tree", "node").applyInPandas(finish, _SUBTREE)


@dataclass
class Grown:
    """Groups of trees: their upper parts over values, and the table of their subtrees."""

    columns: list[str]
    groups: list[tuple[dict[int, tuple], DataFrame]]

    def votes(self, rows: DataFrame) -> DataFrame:
        """(__row, vote): the mean share of class 1 over the trees, for rows numbered by ``__row``."""
        width = len(self.columns)
        values = rows.select("__row", *[F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(self.columns)])
        parts = None
        for tops, subtrees in self.groups:
            slices = values.mapInArrow(_routed(rows, tops, width), "tree int, node int, ids binary, x binary")
            # Each subtree travels once, ahead of the slices that end in its node; joined, it would be repeated for every slice.
            met = subtrees.withColumn("later", F.lit(0)).unionByName(slices.withColumn("later", F.lit(1)), allowMissingColumns=True)
            met = met.repartition("tree", "node").sortWithinPartitions("tree", "node", "later")
            part = met.mapInArrow(_voted(width), "__row long, vote long")
            parts = part if parts is None else parts.unionByName(part)
        if parts is None:
            return values.select("__row", F.lit(0.0).alias("vote"))
        return parts.groupBy("__row").agg((F.sum("vote") / F.count("*") / VOTE).alias("vote"))

    def score(self, df: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
        """``df`` with score and verdict; 0 where no tree has seen a row."""
        rows = stage(df.withColumn("__row", F.monotonically_increasing_id()), "scored")
        voted = rows.join(self.votes(rows), "__row", "left")
        scored = voted.select(*[F.col(f"`{c}`") for c in df.columns if c not in (score, pred)], F.coalesce("vote", F.lit(0.0)).alias(score))
        return scored.withColumn(pred, (F.col(score) > 0.5).cast("int"))


def _routed(rows: DataFrame, tops: dict[int, tuple], width: int):
    """Slices of rows by the node of each upper part in which they end."""
    shared = rows.sparkSession.sparkContext.broadcast(tops)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, _SLICE):
                batch = whole.slice(start, _SLICE)
                ids = np.asarray(batch.column(0))
                x = _exact([_floats(batch.column(i + 1)) for i in range(width)])
                for tree, top in shared.value.items():
                    at = leaf_of(top, x)
                    nodes = np.unique(at)
                    own = [np.flatnonzero(at == node) for node in nodes]
                    columns = [
                        pa.array(np.full(len(nodes), tree, np.int32)), pa.array(nodes.astype(np.int32)),
                        pa.array([ids[o].tobytes() for o in own], pa.binary()), pa.array([x[o].tobytes() for o in own], pa.binary()),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["tree", "node", "ids", "x"])

    return route


def _voted(width: int):
    """Shares of class 1 in the leaves that slices of rows reach; one subtree is held at a time."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, arrays = None, ()
        for batch in batches:
            trees, nodes, later = (batch.column(c).to_numpy() for c in ("tree", "node", "later"))
            for i in range(batch.num_rows):
                if not later[i]:
                    held = (trees[i], nodes[i])
                    arrays = tuple(np.frombuffer(batch.column(c)[i].as_py(), k) for c, k in zip(("feature", "cut", "left", "right", "value"), _KINDS, strict=True))
                elif held == (trees[i], nodes[i]):
                    ids = np.frombuffer(batch.column("ids")[i].as_py(), np.int64)
                    x = np.frombuffer(batch.column("x")[i].as_py(), np.float64).reshape(-1, width)
                    share = np.rint(arrays[4][leaf_of(arrays, x)] * VOTE).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(share)], ["__row", "vote"])

    return vote


def grow_forest(train: DataFrame, columns: list[str], y: str, forest: Forest) -> Grown:
    """Fit to labels 0 and 1; rows without a label take no part. ``balanced`` weighs a class by ``n / (2 * n_class)``."""
    train = train.where(F.col(y).isNotNull())
    sizes = {int(r["y"]): r["count"] for r in train.groupBy(F.col(y).cast("int").alias("y")).count().collect()}
    n = sum(sizes.values())
    if not n:
        return Grown(columns, [])
    if forest.balanced:
        forest = replace(forest, weights=tuple(n / (len(sizes) * sizes[c]) if c in sizes else 1.0 for c in (0, 1)))
    cuts = quantile_cuts(train, columns, forest.bins)
    state = _state(train, columns, y, cuts)
    groups = []
    for start in range(0, forest.trees, forest.together):
        trees = range(start, min(start + forest.together, forest.trees))
        tops, handed, leaves = _tops(state, trees, n, len(columns), forest)
        subtrees = _finished(state, {t: top.arrays() for t, top in tops.items()}, handed, len(columns), forest)
        if leaves:
            subtrees = subtrees.unionByName(state.sparkSession.createDataFrame(leaves, _SUBTREE))
        groups.append(({t: _over_values(top, cuts) for t, top in tops.items()}, stage(subtrees, "subtrees")))
    return Grown(columns, groups)


def _over_values(top: Tree, cuts: list[np.ndarray]) -> tuple:
    """A tree over bins as one over values: a bin is at most the cut if the value is at most its upper edge."""
    feature, cut, left, right, value = top.arrays()
    edges = np.array([cuts[f][c] if leaf >= 0 else 0.0 for f, c, leaf in zip(feature, cut, left, strict=True)], float)
    return feature, edges, left, right, value
