"""Second-order boosting of histogram trees: by level, or best leaf first.

Rows are binned once. A tree is grown in passes: each pass adds up gradients and hessians by (node, feature,
bin) inside the tasks, and one small group per feature turns the sums into the best split of every new
node. Only the smaller child of a split is counted, its sibling is the parent less the child. Sums are taken
over whole multiples of 2**-24, so neither partitioning nor a repeated task can move a split.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from navspark.session import stage

GRAIN = float(1 << 24)
#: Trees after which the rows' margins are written anew.
_KEPT = 8
#: Partial sums of so many tasks are added before the last step.
_PARTS = 64


@dataclass(frozen=True)
class Growth:
    """How trees grow. ``leaves`` None grows level by level to ``depth``; a number grows the best leaf until there are so many."""

    rounds: int = 500
    step: float = 0.3
    depth: int | None = 6
    leaves: int | None = None
    l2: float = 1.0
    min_hessian: float = 1.0
    min_rows: int = 1
    subsample: float = 1.0
    columns: float = 1.0
    bins: int = 256
    seed: int = 42


@dataclass
class Tree:
    """Node 0 is the root; a leaf has no left child. Rows go left if their bin is at most ``cut``."""

    feature: list[int] = field(default_factory=lambda: [0])
    cut: list[int] = field(default_factory=lambda: [0])
    left: list[int] = field(default_factory=lambda: [-1])
    right: list[int] = field(default_factory=lambda: [-1])
    value: list[float] = field(default_factory=lambda: [0.0])
    depth: list[int] = field(default_factory=lambda: [0])

    def arrays(self) -> tuple:
        return tuple(np.array(x) for x in (self.feature, self.cut, self.left, self.right, self.value))

    def add(self, node: int, feature: int, cut: int) -> tuple[int, int]:
        first = len(self.left)
        for _ in range(2):
            self.feature.append(0)
            self.cut.append(0)
            self.left.append(-1)
            self.right.append(-1)
            self.value.append(0.0)
            self.depth.append(self.depth[node] + 1)
        self.feature[node], self.cut[node], self.left[node], self.right[node] = feature, cut, first, first + 1
        return first, first + 1


def leaf_of(tree: tuple, bins: np.ndarray) -> np.ndarray:
    """Node in which each row ends."""
    feature, cut, left, right, _ = tree
    at = np.zeros(len(bins), np.int64)
    while True:
        rows = np.flatnonzero(left[at] >= 0)
        if not len(rows):
            return at
        node = at[rows]
        at[rows] = np.where(bins[rows, feature[node]] <= cut[node], left[node], right[node])


def best_cuts(g: np.ndarray, h: np.ndarray, n: np.ndarray, growth: Growth) -> tuple:
    """Per node (first axis) of one feature: gain, cut, and sums left of it; gain 0 if nothing may be cut."""
    gl, hl, nl = (x.cumsum(axis=1)[:, :-1] for x in (g, h, n))
    gt, ht, nt = (x.sum(axis=1)[:, None] for x in (g, h, n))
    score = lambda a, b: (a / GRAIN) ** 2 / np.maximum(b / GRAIN + growth.l2, 1e-300)
    gain = score(gl, hl) + score(gt - gl, ht - hl) - score(gt, ht)
    least = growth.min_hessian * GRAIN
    allowed = (hl >= least) & (ht - hl >= least) & (nl >= growth.min_rows) & (nt - nl >= growth.min_rows) & (nl > 0) & (nl < nt)
    gain = np.where(allowed, gain, 0.0)
    at = gain.argmax(axis=1)
    rows = np.arange(len(gain))
    return gain[rows, at], at, gl[rows, at], hl[rows, at], nl[rows, at]


def quantile_cuts(rows: DataFrame, columns: list[str], bins: int) -> list[np.ndarray]:
    """Upper bin edges of each column, at most ``bins`` - 1. A missing value is in the lowest bin."""
    shares = [i / bins for i in range(1, bins)]
    row = rows.agg(*[F.percentile_approx(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(None)), shares, 10_000).alias(f"c{i}") for i, c in enumerate(columns)]).first()
    return [np.unique(np.array(x or [], float)) for x in row]


def binned(columns: list[np.ndarray], cuts: list[np.ndarray]) -> np.ndarray:
    """Bin numbers, a row for each row: how many edges lie below the value."""
    out = np.empty((len(columns[0]), len(columns)), np.uint8)
    for i, (x, edges) in enumerate(zip(columns, cuts, strict=True)):
        out[:, i] = np.where(np.isnan(x), 0, np.searchsorted(edges, x, side="left"))
    return out


def _floats(array: pa.Array) -> np.ndarray:
    return array.cast(pa.float64()).to_numpy(zero_copy_only=False)


def _state(rows: DataFrame, columns: list[str], y: str, cuts: list[np.ndarray]) -> DataFrame:
    """(row, y, margin, bins): a row's hash of its values stands for it wherever chance is asked for."""
    values = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    chosen = rows.select(F.col(y).cast("double").alias("y"), *values)
    chosen = chosen.select(F.xxhash64("y", *[f"c{i}" for i in range(len(columns))]).alias("row"), "y", *[f"c{i}" for i in range(len(columns))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = binned([_floats(batch.column(i + 2)) for i in range(len(cuts))], cuts)
            packed = pa.array([r.tobytes() for r in bins], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.zeros(len(bins))), packed], ["row", "y", "margin", "bins"])

    return stage(chosen.mapInArrow(cut, "row long, y double, margin double, bins binary"), "bins")


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), width)


def in_sample(rows: np.ndarray, number: int, growth: Growth) -> np.ndarray:
    """Rows that tree ``number`` sees, by their hash."""
    if growth.subsample >= 1:
        return np.ones(len(rows), bool)
    x = rows.view(np.uint64) ^ np.uint64((growth.seed * 1_000_003 + number) * 0x9E3779B97F4A7C15 % 2**64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(11)).astype(float) / 2.0**53 < growth.subsample


def gradients(y: np.ndarray, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the logistic loss, in whole grains."""
    p = 1 / (1 + np.exp(-margin))
    return np.rint((p - y) * GRAIN).astype(np.int64), np.rint(np.maximum(p * (1 - p), 1e-16) * GRAIN).astype(np.int64)


def _sums(state: DataFrame, done: list[tuple], tree: tuple, targets: list[int], chosen: list[int], number: int, width: int, growth: Growth) -> DataFrame:
    """(feature, part, g, h, n): sums of the rows in each target node, by bin; one row a feature and task."""
    shared = state.sparkSession.sparkContext.broadcast((done, tree))
    slot_of = np.full(len(tree[2]), -1)
    slot_of[targets] = np.arange(len(targets))
    shape = (len(chosen), len(targets) * growth.bins)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, tree = shared.value
        sums = [np.zeros(shape, np.int64) for _ in range(3)]
        part = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = int(np.asarray(batch.column(0))[0]) % _PARTS
            bins = _matrix(batch.column(3), width)
            margin = _floats(batch.column(2))
            for t in done:
                margin = margin + t[4][leaf_of(t, bins)]
            slot = slot_of[leaf_of(tree, bins)]
            mine = np.flatnonzero((slot >= 0) & in_sample(np.asarray(batch.column(0)), number, growth))
            g, h = gradients(_floats(batch.column(1))[mine], margin[mine])
            base = slot[mine] * growth.bins
            for i, f in enumerate(chosen):
                cell = base + bins[mine, f]
                for total, weights in zip(sums, (g, h, None), strict=True):
                    # Sums of a batch stay below 2**53 grains, so doubles hold them exactly.
                    total[i] += np.bincount(cell, weights, shape[1]).astype(np.int64)
        lists = [pa.array(x.tolist(), pa.list_(pa.int64())) for x in sums]
        parts = pa.array(np.full(len(chosen), part, np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(chosen, pa.int32()), parts, *lists], ["feature", "part", "g", "h", "n"])

    out = state.select("row", "y", "margin", "bins").mapInArrow(add, "feature int, part int, g array<long>, h array<long>, n array<long>")
    if state.rdd.getNumPartitions() <= _PARTS:
        return out

    def together(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({c: [rows[c].iloc[0]] for c in ("feature", "part")} | {c: [np.sum(np.stack(rows[c]), axis=0)] for c in "ghn"})

    return out.groupBy("feature", "part").applyInPandas(together, out.schema)


_FOUND = "feature int, g array<long>, h array<long>, n array<long>, gain array<double>, cut array<int>, gl array<long>, hl array<long>, nl array<long>, gt array<long>, ht array<long>, nt array<long>"


def _splits(sums: DataFrame, before: DataFrame | None, places: list[tuple[int, bool]], growth: Growth) -> DataFrame:
    """Sums and best cuts of new nodes, a row for each feature.

    ``sums`` holds the counted child of each split, ``before`` the nodes of the last passes; ``places`` says which of those is its
    parent, and whether the counted child is the left one. Without ``before`` the sums are the root's.
    """
    def both(part: pd.DataFrame, parents: pd.DataFrame | None) -> pd.DataFrame:
        small = [np.sum(np.stack(part[c]), axis=0).reshape(-1, growth.bins) for c in "ghn"]
        if parents is None:
            new = small
        else:
            whole = [np.array(parents[c].iloc[0]).reshape(-1, growth.bins)[[p for p, _ in places]] for c in "ghn"]
            first = np.array([left for _, left in places])[:, None]
            new = []
            for s, w in zip(small, whole, strict=True):
                pair = np.stack([np.where(first, s, w - s), np.where(first, w - s, s)], axis=1)
                new.append(pair.reshape(-1, growth.bins))
        gain, cut, gl, hl, nl = best_cuts(*new, growth)
        totals = [x.sum(axis=1) for x in new]
        row = [part["feature"].iloc[0], *[x.ravel() for x in new], gain, cut.astype(np.int32), gl, hl, nl, *totals]
        return pd.DataFrame([row], columns=[c.split()[0] for c in _FOUND.split(", ")])

    if before is None:
        return stage(sums.groupBy("feature").applyInPandas(lambda part: both(part, None), _FOUND), "splits")
    return stage(sums.groupBy("feature").cogroup(before.groupBy("feature")).applyInPandas(lambda a, b: both(a, b), _FOUND), "splits")


def _best(found: DataFrame, nodes: list[int]) -> dict[int, tuple]:
    """(gain, feature, cut, sums left, sums in all) of each node; of equal gains the first feature's."""
    best: dict[int, tuple] = {}
    for r in sorted(found.drop("g", "h", "n").collect(), key=lambda r: r["feature"]):
        for i, node in enumerate(nodes):
            if node not in best or r["gain"][i] > best[node][0]:
                best[node] = (r["gain"][i], r["feature"], r["cut"][i], (r["gl"][i], r["hl"][i], r["nl"][i]), (r["gt"][i], r["ht"][i], r["nt"][i]))
    return best


def grow(state: DataFrame, done: list[tuple], number: int, width: int, growth: Growth) -> Tree:
    """One tree. Leaves that are sure to be split, or may be, are cut in one pass together, so passes grow with the depth, not with the leaves."""
    tree = Tree()
    draw = np.random.default_rng([growth.seed, number])
    share = max(1, round(growth.columns * width))
    chosen = sorted(draw.choice(width, share, replace=False).tolist()) if share < width else list(range(width))
    found = _splits(_sums(state, done, tree.arrays(), [0], chosen, number, width, growth), None, [], growth)
    best = _best(found, [0])
    totals = {0: best[0][4]}
    held = {0: (found, 0)}
    cut: dict[int, tuple[int, int]] = {}
    limit = growth.leaves or 2**31
    queue = [(-best[0][0], 0)] if best[0][0] > 0 else []
    leaves, kept = 1, set()
    while queue and leaves < limit:
        node = queue[0][1]
        last = growth.depth is not None and tree.depth[node] + 1 >= growth.depth
        if node not in cut and not last and limit - leaves > 1:
            # No leaf beyond the first limit - leaves can still be reached.
            ahead = [q[1] for q in heapq.nsmallest(limit - leaves, queue) if q[1] not in cut]
            ahead = [q for q in ahead if growth.depth is None or tree.depth[q] + 1 < growth.depth]
            for source in {id(held[q][0]): held[q][0] for q in ahead}.values():
                group = [q for q in ahead if held[q][0] is source]
                places, targets = [], []
                for q in group:
                    _, feature, at, left, total = best[q]
                    cut[q] = tree.add(q, feature, at)
                    smaller = 2 * left[2] <= total[2]
                    places.append((held[q][1], smaller))
                    targets.append(cut[q][0 if smaller else 1])
                sums = _sums(state, done, tree.arrays(), targets, chosen, number, width, growth)
                found = _splits(sums, source, places, growth)
                nodes = [c for q in group for c in cut[q]]
                best |= _best(found, nodes)
                held |= {c: (found, i) for i, c in enumerate(nodes)}
            continue
        heapq.heappop(queue)
        if node not in cut:
            cut[node] = tree.add(node, best[node][1], best[node][2])
        kept.add(node)
        leaves += 1
        left, total = best[node][3], best[node][4]
        for child, own in zip(cut[node], (left, tuple(t - x for t, x in zip(total, left, strict=True))), strict=True):
            totals[child] = own
            if child in best and best[child][0] > 0:
                heapq.heappush(queue, (-best[child][0], child))
    return _pruned(tree, kept, totals, growth)


def _pruned(tree: Tree, kept: set[int], totals: dict[int, tuple], growth: Growth) -> Tree:
    """The splits that were made, without those only looked at, and the value of every leaf."""
    out, pairs = Tree(), [(0, 0)]
    while pairs:
        old, new = pairs.pop()
        if old in kept:
            left, right = out.add(new, tree.feature[old], tree.cut[old])
            pairs += [(tree.left[old], left), (tree.right[old], right)]
        else:
            g, h, _ = totals[old]
            out.value[new] = -growth.step * (g / GRAIN) / max(h / GRAIN + growth.l2, 1e-300)
    return out


@dataclass
class Boosted:
    """Trees over bins of ``columns``; rows start at ``base``."""

    columns: list[str]
    cuts: list[np.ndarray]
    base: float
    trees: list[tuple]

    def score(self, df: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.cuts, self.base, self.trees))

        @F.arrow_udf("double")
        def probability(*columns: pa.Array) -> pa.Array:
            cuts, base, trees = shared.value
            bins = binned([_floats(c) for c in columns], cuts)
            margin = np.full(len(bins), base)
            for t in trees:
                margin += t[4][leaf_of(t, bins)]
            return pa.array(1 / (1 + np.exp(-margin)))

        scored = df.withColumn(score, probability(*[F.col(f"`{c}`").cast("double") for c in self.columns]))
        return scored.withColumn(pred, (F.col(score) > 0.5).cast("int"))


def boost(train: DataFrame, columns: list[str], y: str, growth: Growth) -> Boosted:
    """Fit ``growth.rounds`` trees to labels 0 and 1, starting from the log odds of the labels. Rows without a label take no part."""
    train = train.where(F.col(y).isNotNull())
    cuts = quantile_cuts(train, columns, growth.bins)
    n, positive = train.agg(F.count("*"), F.sum(F.col(y).cast("double"))).first()
    share = min(max((positive or 0.0) / max(n, 1), 1e-6), 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    state = _state(train, columns, y, cuts).withColumn("margin", F.lit(base))
    trees: list[tuple] = []
    done: list[tuple] = []
    for number in range(growth.rounds if n else 0):
        tree = grow(state, done, number, len(columns), growth).arrays()
        trees.append(tree)
        done.append(tree)
        if len(done) == _KEPT and number + 1 < growth.rounds:
            state, done = _moved(state, done, len(columns)), []
    return Boosted(columns, cuts, base, trees)


def _moved(state: DataFrame, done: list[tuple], width: int) -> DataFrame:
    """The rows with the new trees in their margins, written so that later passes need not apply them again."""
    shared = state.sparkSession.sparkContext.broadcast(done)

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = _matrix(batch.column(3), width), _floats(batch.column(2))
            for t in shared.value:
                margin = margin + t[4][leaf_of(t, bins)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(margin), batch.column(3)], ["row", "y", "margin", "bins"])

    return stage(state.select("row", "y", "margin", "bins").mapInArrow(move, "row long, y double, margin double, bins binary"), "margins")
