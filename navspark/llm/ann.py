"""Nearest neighbours by a hierarchical k-means tree searched best bin first."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.session import stage

NEIGHBOURS = 20
SAMPLE = 60_000
LEAF = 200
BRANCHING = 16
CALIBRATION = 256
RECALL = 0.95
#: Rows that meet their queries in one task.
BLOCK = 4096


class Tree:
    """Centres of a k-means hierarchy; node 0 is the root, a node without children is a leaf."""

    def __init__(self, sample: np.ndarray, leaves: int, seed: int = 7) -> None:
        self.centres: list[np.ndarray] = [sample.mean(axis=0)]
        self.children: list[list[int]] = [[]]
        draw = np.random.default_rng(seed)
        todo = [(0, sample)]
        most = max(2, -(-len(sample) // max(1, leaves)))
        while todo:
            node, rows = todo.pop()
            if len(rows) <= most:
                continue
            centres, label = _lloyd(rows, min(BRANCHING, -(-len(rows) // most)), draw)
            if len(centres) < 2:
                continue
            for i, centre in enumerate(centres):
                child = len(self.centres)
                self.centres.append(centre)
                self.children.append([])
                self.children[node].append(child)
                todo.append((child, rows[label == i]))
        self.matrix = np.array(self.centres)

    def leaf_of(self, rows: np.ndarray) -> np.ndarray:
        """Leaf that each row falls into, nearest centre by nearest centre."""
        at = np.zeros(len(rows), np.int64)
        moving = np.arange(len(rows))
        while len(moving):
            left = []
            for node in np.unique(at[moving]):
                own, kids = moving[at[moving] == node], self.children[node]
                if kids:
                    centres = self.matrix[kids]
                    at[own] = np.array(kids)[(rows[own] @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)]
                    left.append(own)
            moving = np.concatenate(left) if left else moving[:0]
        return at

    def visits(self, query: np.ndarray, sizes: dict[int, int], leaves: int, rows: int) -> list[int]:
        """The first leaves that a best-bin-first walk reaches: ``leaves`` of them, and more until they hold ``rows`` rows."""
        near = self.matrix @ query
        queue, out, held = [(-near[0], 0)], [], 0
        while queue and (len(out) < leaves or held < rows):
            _, node = heapq.heappop(queue)
            if self.children[node]:
                for kid in self.children[node]:
                    heapq.heappush(queue, (-near[kid], kid))
            elif sizes.get(node):
                out.append(node)
                held += sizes[node]
        return out


def _lloyd(rows: np.ndarray, k: int, draw: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    distinct = np.unique(rows[draw.permutation(len(rows))[: 50 * k]], axis=0)
    centres = distinct[draw.permutation(len(distinct))[:k]]
    for _ in range(8):
        label = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        used, label = np.unique(label, return_inverse=True)
        count = np.bincount(label, minlength=len(used))
        centres = np.stack([np.bincount(label, rows[:, d], len(used)) for d in range(rows.shape[1])], axis=1) / count[:, None]
    label = (rows @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    used, label = np.unique(label, return_inverse=True)
    return centres[used], label


def _grid(column: pa.Array, dims: int) -> np.ndarray:
    return np.asarray(column.flatten()).astype(np.float64).reshape(-1, dims)


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed dimension by dimension, so equal vectors score equally wherever they lie."""
    out = np.zeros((len(queries), len(rows)))
    for d in range(rows.shape[1]):
        out += queries[:, d, None] * rows[None, :, d]
    return out


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> list[np.ndarray]:
    """Places of the k best of each line, ties to the smaller id."""
    if scores.shape[1] > 4 * k:
        edge = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
        picks = [np.flatnonzero(line >= e) for line, e in zip(scores, edge, strict=True)]
    else:
        picks = [np.arange(scores.shape[1])] * len(scores)
    return [p[np.lexsort((ids[p], -line[p]))[:k]] for p, line in zip(picks, scores, strict=True)]


def _usable(vector: Column, dims: int) -> Column:
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & (F.size(vector) == dims) & sound & F.exists(vector, lambda x: x != 0)


def _nearest(index: DataFrame, wanted: DataFrame, dims: int, k: int) -> DataFrame:
    """(q, vid, score): per query its k best rows among the leaves it visits.

    ``index`` has (vid, vector, leaf, block), ``wanted`` (q, vector, bound, leaves, block): a query once for each
    block of neighbouring leaves. What scores below a query's bound cannot be among its best and stays behind.
    """

    def meet(rows: pa.Table, queries: pa.Table) -> pa.Table:
        parts: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            rows = rows.sort_by("leaf")
            names, grid, leaf = np.asarray(rows["vid"].combine_chunks()), _grid(rows["vector"].combine_chunks(), dims), np.asarray(rows["leaf"])
            asked, asks = np.asarray(queries["q"].combine_chunks()), _grid(queries["vector"].combine_chunks(), dims)
            bound, lists = np.asarray(queries["bound"].combine_chunks()), queries["leaves"].combine_chunks()
            owner = np.repeat(np.arange(len(asked)), np.diff(np.asarray(lists.offsets)))
            visited = np.asarray(lists.flatten())
            for x in np.unique(leaf):
                own = slice(*np.searchsorted(leaf, [x, x + 1]))
                sure = owner[visited == x]
                for start in range(0, len(sure), 256):
                    some = sure[start : start + 256]
                    found = _scores(asks[some], grid[own])
                    found[found < bound[some, None]] = -np.inf
                    for i, line, places in zip(some, found, _best(found, names[own], k), strict=True):
                        places = places[line[places] > -np.inf]
                        parts.append((np.full(len(places), i), names[own][places], line[places]))
        if not parts:
            return pa.table({"q": pa.array([], pa.int64()), "vid": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        i, vid, score = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((vid, -score, i))
        i, vid, score = i[order], vid[order], score[order]
        rank = np.arange(len(i)) - np.searchsorted(i, i)
        return pa.table({"q": asked[i[rank < k]], "vid": vid[rank < k], "score": score[rank < k]})

    pairs = index.groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(meet, "q long, vid long, score double")
    place = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vid"))
    return pairs.withColumn("_place", place).where(F.col("_place") <= k).drop("_place")


def _blocks(sizes: dict[int, int]) -> dict[int, tuple[int, int]]:
    """First block of each leaf and how many it fills: neighbours in the tree share blocks of about ``BLOCK`` rows, a large leaf has several."""
    out, block, held = {}, 0, 0
    for leaf in sorted(sizes):
        if held and held + sizes[leaf] > BLOCK:
            block, held = block + 1, 0
        parts = -(-sizes[leaf] // BLOCK)
        out[leaf] = (block, parts)
        held += sizes[leaf]
        if parts > 1:
            block, held = block + parts, 0
    return out


def search(
    vectors: DataFrame, is_query: Column, k: int = NEIGHBOURS, recall: float = RECALL, sample: int = SAMPLE,
    leaf: int = LEAF, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each query row, by inner product.

    The tree is fitted on at most ``sample`` rows, chosen by the hash of their ids; every row is
    placed in a leaf and can be found. ``CALIBRATION`` queries are answered exactly over all rows, and leaf
    visits widen until their mean recall reaches ``recall``. Equal vectors are searched once,
    under their k + 1 smallest ids, which is all that any result can show of them; ties go to the
    smaller id. Rows without id, or whose vector is null, zero, of another length than most or holds null
    or non-finite components, take no part. Repeated rows of one id are one row. With fewer
    than k other rows all are returned; an empty table gives no rows.
    """
    out = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    vector = F.col(vector_col)
    common = vectors.where(F.size(vector) > 0).groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    if common is None:
        return spark.createDataFrame([], out)
    dims = common["d"]
    rows = vectors.where(F.col(id_col).isNotNull() & _usable(vector, dims)).select(
        F.col(id_col).cast("long").alias("vec_id"), vector.cast("array<double>").alias("vector"), is_query.alias("asks")
    )
    rows = rows.withColumn("key", F.struct(F.xxhash64("vector"), F.hash("vector")))
    first = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    few = rows.dropDuplicates(["key", "vec_id"]).withColumn("_n", first).where(F.col("_n") <= k + 1)
    kinds = few.groupBy("key").agg(F.min("vec_id").alias("vid"), F.first("vector").alias("vector"), F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = stage(kinds, "kinds")
    asked = stage(rows.where("asks").select("vec_id", "key").distinct(), "asked")
    queries = stage(kinds.join(asked.select("key").distinct(), "key", "left_semi").select(F.col("vid").alias("q"), "vector"), "queries")
    total = kinds.count()
    if not total:
        return spark.createDataFrame([], out)
    drawn = kinds.orderBy(F.xxhash64("vid"), "vid").limit(sample).select("vector").toArrow()
    tree = Tree(_grid(drawn["vector"].combine_chunks(), dims), max(1, total // leaf))
    shared = spark.sparkContext.broadcast(tree)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = shared.value.leaf_of(_grid(batch.column(1), dims))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(leaves)], ["vid", "vector", "leaf"])

    index = stage(kinds.select("vid", "vector").mapInArrow(place, "vid long, vector array<double>, leaf long"), "index")
    # One row per leaf, of which there are at most as many as rows in the sample.
    sizes = {r["leaf"]: r["count"] for r in index.groupBy("leaf").count().collect()}
    test = queries.orderBy(F.xxhash64("q", F.lit(1)), "q").limit(CALIBRATION)
    parts = max(1, -(-total // BLOCK))
    low, zero = F.lit(float("-inf")), F.lit(0).cast("long")
    exact = _nearest(
        index.select("vid", "vector", zero.alias("leaf"), F.pmod(F.xxhash64("vid"), F.lit(parts)).alias("block")),
        test.select(
            "q", "vector", low.alias("bound"), F.array(zero).alias("leaves"), F.explode(F.sequence(zero, F.lit(parts - 1).cast("long"))).alias("block")
        ),
        dims, k,
    )
    truth = exact.join(index.select("vid", "leaf"), "vid").groupBy("q").agg(F.collect_list("leaf").alias("leaves"))
    truth = truth.join(test, "q").select("vector", "leaves").collect()
    ranks: list[int] = []
    for r in truth:
        order = {x: i for i, x in enumerate(tree.visits(np.array(r["vector"]), sizes, len(sizes), 0))}
        ranks += [order[x] for x in r["leaves"]]
    ranks.sort()
    visits = ranks[min(len(ranks) - 1, int(np.ceil(recall * len(ranks))))] + 1 if ranks else 1
    layout = _blocks(sizes)
    laid = spark.sparkContext.broadcast((sizes, layout))

    def walk(some: DataFrame, first: bool) -> DataFrame:
        """Visits of each query, by block: the leaf it starts in, or those after it."""

        def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, blocks = laid.value
            for batch in batches:
                row, block, lists = [], [], []
                for i, query in enumerate(_grid(batch.column(1), dims)):
                    start = shared.value.visits(query, held, 1, k + 1)
                    way = start if first else shared.value.visits(query, held, visits, k + 1)[len(start) :]
                    met: dict[int, list] = {}
                    for x in way:
                        for b in range(blocks[x][0], blocks[x][0] + blocks[x][1]):
                            met.setdefault(b, []).append(x)
                    row += [i] * len(met)
                    block += met.keys()
                    lists += met.values()
                taken = [c.take(pa.array(row, pa.int64())) for c in batch.columns]
                yield pa.RecordBatch.from_arrays([*taken, pa.array(lists, pa.list_(pa.int64())), pa.array(block, pa.int64())], ["q", "vector", "bound", "leaves", "block"])

        return some.mapInArrow(step, "q long, vector array<double>, bound double, leaves array<long>, block long")

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = laid.value[1]
        for batch in batches:
            start, cuts = (np.array([blocks[x][i] for x in batch.column(2).to_pylist()], np.int64) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(start + np.asarray(batch.column(3)) % cuts)], ["vid", "vector", "leaf", "block"])

    dealt = index.withColumn("spread", F.pmod(F.xxhash64("vid"), F.lit(1 << 30)))
    dealt = stage(dealt.mapInArrow(deal, "vid long, vector array<double>, leaf long, block long"), "dealt")
    near = stage(_nearest(dealt, walk(queries.withColumn("bound", low), True), dims, k + 1), "near")
    bounds = near.groupBy("q").agg(F.when(F.count("*") > k, F.min("score")).otherwise(low).alias("bound"))
    wider = _nearest(dealt, walk(queries.join(bounds, "q").select("q", "vector", "bound"), False), dims, k + 1)
    best = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vid"))
    found = near.unionByName(wider).withColumn("_n", best).where(F.col("_n") <= k + 1).drop("_n")
    each = found.join(kinds.select("vid", "key", "ids"), "vid").select("q", "score", F.explode("ids").alias("vec_id"))
    line = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    short = each.withColumn("_n", line).where(F.col("_n") <= k + 1)
    lists = short.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("_n", "vec_id", "score"))).alias("best"))
    lists = lists.join(kinds.select(F.col("vid").alias("q"), "key"), "q").select("key", "best")
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists, "key")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    flat = own.select("query_id", F.posexplode(others).alias("at", "b"))
    return flat.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"))
