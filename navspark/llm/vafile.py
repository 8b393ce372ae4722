"""Exact integer k-means over a vector-approximation file."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.session import stage

WIDTH = 64
CENTROIDS = 40
ROUNDS = 5
SCALE = 256
#: Of a cell number; 2**BITS cells a dimension.
BITS = 6
#: Components are held within this, so that squared distances of 64 of them stay exact in 64 bits.
LARGEST = 2**27
_BLOCK = 2_048


def _components(vector: str, width: int) -> Column:
    """Whole numbers floor(256 * x) of a vector's components; null if it is no vector of ``width`` finite numbers."""
    finite = f"forall({vector}, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    whole = f"transform({vector}, x -> int(floor(greatest(-{LARGEST}D, least({LARGEST}D, {SCALE}D * x)))))"
    return F.expr(f"CASE WHEN size({vector}) = {width} AND {finite} THEN {whole} END")


def _grid(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of a list column as a matrix, without copying."""
    return np.asarray(column.flatten()).reshape(-1, width)


def _marks() -> np.ndarray:
    """Bin edges of the histogram, about 1 % apart, so that single huge components do not blur the others."""
    up = np.unique(np.round(2 ** (np.arange(64 * LARGEST.bit_length()) / 64)).astype(np.int64))
    return np.concatenate([-up[::-1], [0], up])


def _edges(vectors: DataFrame, width: int, cells: int) -> np.ndarray:
    """Cell edges of each dimension: smallest and largest component, and between them quantiles of a fine histogram.

    Both passes take every vector, and send at most ``width`` rows, or ``width`` times the bins, from a task. Any
    increasing edges that enclose the values give the right clusters; these keep cells about equally full.
    """

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grids = [_grid(batch.column(0), width) for batch in batches if batch.num_rows]
        if grids:
            low, high = (np.min([g.min(axis=0) for g in grids], axis=0), np.max([g.max(axis=0) for g in grids], axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(range(width), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], ["d", "low", "high"])

    ends = vectors.select("v").mapInArrow(spans, "d int, low long, high long").groupBy("d").agg(F.min("low"), F.max("high")).collect()
    ends = np.array([r[1:] for r in sorted(ends)], np.int64)
    marks = _marks()

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width * len(marks), np.int64)
        for batch in batches:
            number = np.searchsorted(marks, _grid(batch.column(0), width), side="right") - 1 + np.arange(width) * len(marks)
            counts += np.bincount(number.ravel(), minlength=len(counts))
        full = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(full), pa.array(counts[full])], ["bin", "n"])

    counts = np.zeros(width * len(marks), np.int64)
    for r in vectors.select("v").mapInArrow(bins, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect():
        counts[r["bin"]] = r["n"]
    before = counts.reshape(width, len(marks)).cumsum(axis=1)
    shares = before[:, -1:] * np.arange(1, cells) // cells
    inner = np.array([np.searchsorted(b, s, side="right") for b, s in zip(before, shares, strict=True)])
    return np.column_stack([ends[:, :1], np.clip(marks[inner], ends[:, :1], ends[:, 1:]), ends[:, 1:]])


def _packed(per_dimension: np.ndarray, bits: int, join) -> np.ndarray:
    """Neighbouring dimensions (axis 1) taken together, as many as a byte holds."""
    while bits * 2 <= 8:
        if per_dimension.shape[1] % 2:
            per_dimension = np.concatenate([per_dimension, np.zeros_like(per_dimension[:, :1])], axis=1)
        per_dimension, bits = join(per_dimension[:, 0::2], per_dimension[:, 1::2], bits), bits * 2
    return per_dimension


def _cells(grid: np.ndarray, edges: np.ndarray, bits: int) -> np.ndarray:
    """Bytes of cell numbers of each vector; cell i of a dimension holds edges[i] <= x <= edges[i + 1]."""
    number = np.stack([np.searchsorted(edges[d, 1:-1], grid[:, d], side="right") for d in range(grid.shape[1])], axis=1)
    return _packed(number, bits, lambda x, y, b: x << b | y).astype(np.uint8)


def _tables(centroids: np.ndarray, edges: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest squared distance to each centroid by the cells in each byte: (bytes, values, centroids)."""
    low, high = edges[None, :, :-1], edges[None, :, 1:]
    c = centroids[:, :, None]
    least = np.maximum(np.maximum(low - c, c - high), 0) ** 2
    most = np.maximum(np.abs(c - low), np.abs(c - high)) ** 2

    def both(x: np.ndarray, y: np.ndarray, _: int) -> np.ndarray:
        return (x[..., :, None] + y[..., None, :]).reshape(*x.shape[:2], -1)

    least, most = (np.ascontiguousarray(_packed(t, bits, both).transpose(1, 2, 0)) for t in (least, most))
    return least, most


def nearest(cells: np.ndarray, grid: np.ndarray, centroids: np.ndarray, tables: tuple) -> tuple[np.ndarray, int]:
    """Number of the nearest centroid of each row, the smaller of equals, and how many full vectors that took.

    A row whose least upper bound lies below every other centroid's lower bound is decided by
    its cells. Of the others the full vector is read, and compared with the centroids
    whose interval reaches below that bound.
    """
    least, most = tables
    out, fetched = np.empty(len(cells), np.int64), 0
    for start in range(0, len(cells), _BLOCK):
        part = cells[start : start + _BLOCK]
        lower, upper = (sum(t[b][part[:, b]] for b in range(part.shape[1])) for t in (least, most))
        open_ = lower <= upper.min(axis=1)[:, None]
        chosen = open_.argmax(axis=1)
        doubtful = np.flatnonzero(open_.sum(axis=1) > 1)
        if len(doubtful):
            fetched += len(doubtful)
            full = grid[start + doubtful].astype(np.int64)
            distance = np.full((len(doubtful), len(centroids)), np.iinfo(np.int64).max)
            for k in range(len(centroids)):
                near = np.flatnonzero(open_[doubtful, k])
                distance[near, k] = ((full[near] - centroids[k]) ** 2).sum(axis=1)
            chosen[doubtful] = distance.argmin(axis=1)
        out[start : start + _BLOCK] = chosen
    return out, fetched


def _round(file: DataFrame, centroids: np.ndarray, edges: np.ndarray, width: int, bits: int) -> tuple[np.ndarray, int, int]:
    """Next centroids; vectors, and vectors compared in full. A task sends one row of sums for each centroid it met."""
    shared = file.sparkSession.sparkContext.broadcast((centroids, edges))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, edges = shared.value
        tables = _tables(centroids, edges, bits)
        n, total, fetched = np.zeros(len(centroids), np.int64), np.zeros((len(centroids), width), np.int64), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = _grid(batch.column(1), width)
            cells = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(len(grid), -1)
            found, read = nearest(cells, grid, centroids, tables)
            fetched += read
            n += np.bincount(found, minlength=len(centroids))
            for k in np.unique(found):
                total[k] += grid[found == k].sum(axis=0, dtype=np.int64)
        met = np.flatnonzero(n)
        # The counts travel as two more places of the sums.
        rows = np.column_stack([total[met], n[met], np.where(np.arange(len(met)) == 0, fetched, 0)])
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["k", "sums"])

    parts = file.select("cells", "v").mapInArrow(sums, "k long, sums array<long>")
    added = parts.select("k", F.posexplode("sums").alias("at", "x")).groupBy("k", "at").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    met: dict[int, dict[int, int]] = {}
    for r in added.collect():
        met.setdefault(r["k"], {})[r["at"]] = int(r["x"])
    after = centroids.copy()
    for k, own in met.items():
        after[k] = [own[d] // own[width] for d in range(width)]
    return after, sum(own[width] for own in met.values()), sum(own[width + 1] for own in met.values())


def cluster(
    vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, bits: int = BITS, seed: int = 2,
    id_col: str = "vec_id", vector_col: str = "embedding", log: list | None = None,
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every usable vector.

    Usable are vectors of exactly ``width`` finite components; others, and null ones, take no part.
    A component x counts as floor(256 * x), held within plus and minus 2**27. The first
    centroids are the ``k`` vectors whose ids hash lowest, the smaller vector of equal ids first; with fewer vectors there
    are fewer centroids, and an empty table gives no rows. Vectors without an id are assigned like all others
    but never start a cluster. Repeated rows each count. All of it is integer
    arithmetic: neither partitioning nor a repeated task can change a digit.

    The file is written once: per vector ``bits`` (1 to 8) bits a dimension beside the vector itself. Spark has no cheap
    random access, so both lie in one row and a scan passes them on together; distances
    are taken from table look-ups on the cells and only where intervals overlap from the
    vector. ``log`` collects (vectors, full vectors compared) of every round. What returns to the driver is k rows of sums.
    """
    spark = vectors.sparkSession
    kept = vectors.select(F.col(id_col).cast("long").alias("vec_id"), _components(f"`{vector_col}`", width).alias("v")).where("v IS NOT NULL")
    kept = stage(kept, "vectors")
    named = kept.where("vec_id IS NOT NULL").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("h", "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["v"] for r in first], np.int64)
    edges = _edges(kept, width, 1 << bits)

    def approximate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                cells = _cells(_grid(batch.column(1), width), edges, bits)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.tobytes() for c in cells], pa.binary()), batch.column(1)], ["vec_id", "cells", "v"])

    file = stage(kept.mapInArrow(approximate, "vec_id long, cells binary, v array<int>"), "cells")
    for _ in range(rounds):
        centroids, rows, fetched = _round(file, centroids, edges, width, bits)
        if log is not None:
            log.append((rows, fetched))
    shared = spark.sparkContext.broadcast((centroids, edges))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centroids, edges = shared.value
        tables = _tables(centroids, edges, bits)
        for batch in batches:
            if not batch.num_rows:
                continue
            grid = _grid(batch.column(2), width)
            cells = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint8).reshape(len(grid), -1)
            found, _ = nearest(cells, grid, centroids, tables)
            distance = np.concatenate([
                ((grid[i : i + _BLOCK].astype(np.int64) - centroids[found[i : i + _BLOCK]]) ** 2).sum(axis=1) for i in range(0, len(grid), _BLOCK)
            ])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.astype(np.int32)), pa.array(distance)], ["vec_id", "cluster", "distance"])

    placed = stage(file.mapInArrow(assign, "vec_id long, cluster int, distance long"), "placed")
    sums = placed.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()
    held = lambda x: min(int(x), 2**63 - 1)
    prints = spark.createDataFrame([(i, ",".join(map(str, c.tolist()))) for i, c in enumerate(centroids)], "cluster int, line string")
    totals = spark.createDataFrame([(r["cluster"], held(r["s"]), held(sum(x["s"] for x in sums))) for r in sums], "cluster int, cluster_inertia long, inertia long")
    # k rows at most.
    facts = F.broadcast(totals.join(prints, "cluster").withColumn("centroid_sha256", F.sha2("line", 256)).drop("line"))
    return placed.join(facts, "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
