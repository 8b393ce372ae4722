"""Exact Jaccard self-join of word n-gram sets: tiles, bitmap bounds, sorted intersections."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.common import short_batches, small
from navspark.llm.components import connected_components
from navspark.llm.tokens import mix64, shingle_sets
from navspark.session import stage

WIDTH = 5
PERCENT = 75
#: At most so many shingles are known as frequent; the rest is told apart by the tiles themselves.
FREQUENT = 262_144
#: Times that a task must meet a shingle to report it, and how many it counts at once.
_LOCAL = 2
_HELD = 2_000_000
_LANES = 8
_SALTS = 16
_PROBE = "shingle long, sid long, n int, salt int, rank int"


def _needed(size: int, percent: int) -> int:
    """Fewest common shingles of a set with any partner it may link with."""
    return -(-percent * size // 100)


def _bitmap(shingles: np.ndarray, lanes: int = _LANES) -> np.ndarray:
    bits = np.zeros(64 * lanes, np.uint8)
    bits[(shingles >> np.uint64(20)) % np.uint64(64 * lanes)] = 1
    return np.packbits(bits).view(np.int64)


def _wide(shingles: np.ndarray) -> np.ndarray | None:
    """For a set too large for ``_LANES``: a bitmap with at least three bits for each shingle."""
    lanes = _LANES
    while 64 * lanes < 3 * len(shingles):
        lanes *= 2
    return _bitmap(shingles, lanes) if lanes > _LANES else None


def _name(shingles: np.ndarray) -> int:
    """A set's name: equal sets have the same one."""
    return int(mix64(shingles ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(shingles) else 0


def _scan(docs: DataFrame, text: str, key: str, width: int) -> DataFrame:
    """Per row of ``docs`` its set's name, size and bitmap; besides, shingles that a task meets again and again, and how often.

    Counted are repetitions within about a megabyte of text, added up over the task.
    """
    fields = ["doc_id", "sid", "n", *[f"b{i}" for i in range(_LANES)], "shingle", "times"]
    schema = pa.schema([*[(f, pa.int64()) for f in fields], ("wide", pa.list_(pa.int64()))])

    def counted(seen: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        every, at = np.unique(np.concatenate([x for x, _ in seen]), return_inverse=True)
        times = np.bincount(at, np.concatenate([t for _, t in seen]), len(every)).astype(np.int64)
        common = times >= _LOCAL
        n = int(common.sum())
        rows = [pa.array(every[common].view(np.int64)), pa.array(times[common], pa.int64())]
        return pa.RecordBatch.from_arrays([*[pa.nulls(n, pa.int64())] * (len(fields) - 2), *rows, pa.nulls(n, pa.list_(pa.int64()))], schema=schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [(np.zeros(0, np.uint64), np.zeros(0, np.int64))], 0
        for batch in batches:
            for first, sets in shingle_sets(batch.column(1), width):
                grid = np.array([_bitmap(s) for s in sets])
                own = [batch.column(0).slice(first, len(sets)), pa.array([_name(s) for s in sets], pa.int64())]
                own += [pa.array([len(s) for s in sets], pa.int64()), *[pa.array(grid[:, i]) for i in range(_LANES)]]
                wide = pa.array([_wide(s) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([*own, *[pa.nulls(len(sets), pa.int64())] * 2, wide], schema=schema)
                every = np.sort(np.concatenate(sets))
                at = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
                times = np.diff(np.append(at, len(every)))
                seen.append((every[at][times > 1], times[times > 1]))
                held += len(seen[-1][0])
                if held >= _HELD:
                    yield counted(seen)
                    seen, held = seen[:1], 0
        yield counted(seen)

    chosen = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    columns = ", ".join(f"{f} long" for f in fields) + ", wide array<long>"
    return stage(chosen.mapInArrow(scan, columns), "scan")


def _frequent(scanned: DataFrame) -> list[int]:
    """Shingles seen to be common, the most common first, at most ``FREQUENT``.

    They only decide the order in which a set's shingles are probed; the join is exact for any order.
    """
    top = scanned.where("times IS NOT NULL").groupBy("shingle").agg(F.sum("times").alias("n"))
    return [r["shingle"] for r in top.orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").collect()]


def _probe_rows(docs: DataFrame, text: str, frequent: list[int], width: int, percent: int) -> DataFrame:
    """Probe shingles of each distinct set, once per task: (shingle, sid, n, salt, rank); salt is over 0 for frequent ones.

    Two sets that link share a shingle among the first size - needed + 1 of each, in any
    common order. Here rare shingles come first, the most frequent last; rank is the place in that order, from 0.
    """
    order = np.array(frequent[::-1], np.int64).view(np.uint64)
    by_value = np.argsort(order)
    shared = docs.sparkSession.sparkContext.broadcast((order[by_value], by_value))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, places = shared.value
        seen: set[int] = set()
        for batch in batches:
            for _, sets in shingle_sets(batch.column(0), width):
                probes, names, sizes, salts, ranks = [], [], [], [], []
                for s in sets:
                    sid = _name(s)
                    if not len(s) or sid in seen:
                        continue
                    seen.add(sid)
                    take = len(s) - _needed(len(s), percent) + 1
                    at = np.minimum(np.searchsorted(known, s), max(len(known) - 1, 0))
                    common = known[at] == s if len(known) else np.zeros(len(s), bool)
                    rare, rest = s[~common][:take], s[:0]
                    if len(rare) < take:
                        rest = s[common][np.argsort(places[at[common]])][: take - len(rare)]
                    mixed = mix64(rest ^ np.uint64(sid & (2**64 - 1))) % np.uint64(_SALTS)
                    probes += [rare, rest]
                    salts += [np.zeros(len(rare), np.int32), mixed.astype(np.int32) + np.int32(1)]
                    names.append(np.full(take, sid, np.int64))
                    sizes.append(np.full(take, len(s), np.int32))
                    ranks.append(np.arange(take, dtype=np.int32))
                if names:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(probes).view(np.int64)), *[pa.array(np.concatenate(x)) for x in (names, sizes, salts, ranks)]],
                        ["shingle", "sid", "n", "salt", "rank"],
                    )

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(split, _PROBE)


def _shared_only(rows: DataFrame) -> DataFrame:
    """Probe rows whose shingle another set has too; rows of frequent shingles and of documents pass.

    Rows arrive sorted by shingle and set, so a look at the neighbours decides.
    """
    schema = pa.schema([("shingle", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("salt", pa.int32()), ("rank", pa.int32())])

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, paired = None, False
        for batch in batches:
            grid = [np.asarray(batch.column(i)) for i in range(len(schema))]
            if last is not None:
                grid = [np.concatenate(([x], g)) for x, g in zip(last, grid, strict=True)]
            shingle, sid, _, salt, _ = grid
            if not len(shingle):
                continue
            fresh = np.concatenate(([True], (shingle[1:] != shingle[:-1]) | (sid[1:] != sid[:-1]) | (salt[1:] != salt[:-1])))
            grid = [g[fresh] for g in grid]
            shingle, _, _, salt, _ = grid
            same = shingle[1:] == shingle[:-1]
            found = (salt > 0) | np.concatenate(([paired], same)) | np.append(same, False)
            last, paired = tuple(g[-1] for g in grid), bool(same[-1]) if len(same) else paired
            out = [g[:-1][found[:-1]] for g in grid]
            yield pa.RecordBatch.from_arrays([pa.array(g, f.type) for g, f in zip(out, schema, strict=True)], schema=schema)
        if last is not None and (paired or last[3] > 0):
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(last, schema, strict=True)], schema=schema)

    dealt = rows.repartition(F.col("shingle"), F.col("salt")).sortWithinPartitions("shingle", "salt", "sid")
    return dealt.mapInArrow(keep, _PROBE)


def _possible(n: Column, m: Column, missing: Column, surplus: Column, percent: int) -> Column:
    """Can sets of n and m shingles link, if so many of either are not in the other?"""
    most = F.least(n - missing, m - surplus)
    # 100 * most >= percent * (n + m - most), with the long term named once.
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & ((100 + percent) * most >= percent * (n + m))


def _bound(left: str, right: str, percent: int) -> Column:
    """Each bit that only one bitmap has stands for a shingle that only that set has."""
    def only(x: str, y: str) -> Column:
        return reduce(lambda p, q: p + q, (F.bit_count(F.expr(f"{x}.b{i} & ~{y}.b{i}")) for i in range(_LANES)))

    return _possible(F.col(f"{left}.n"), F.col(f"{right}.n"), only(left, right), only(right, left), percent)


def _wide_bound(left: str, right: str, percent: int) -> Column:
    """The same for the longer bitmaps of large sets; of unequal ones the longer is folded."""
    def only(x: str, y: str) -> Column:
        bits = f"zip_with({x}, {y}, (a, b) -> bit_count(a & ~b))"
        return F.expr(f"aggregate({bits}, 0L, (s, c) -> s + c)")

    def folded(x: str) -> str:
        half = f"size({x}) div 2"
        return f"transform(slice({x}, 1, {half}), (v, i) -> v | {x}[i + {half}])"

    def both(x: str, y: str) -> Column:
        return _possible(F.col(f"{left}.n"), F.col(f"{right}.n"), only(x, y), only(y, x), percent)

    x, y = f"{left}.wide", f"{right}.wide"
    small = F.col(x).isNull() | F.col(y).isNull()
    equal, longer, shorter = (F.expr(f"{k} * size({x}) = {m} * size({y})") for k, m in ((1, 1), (1, 2), (2, 1)))
    either = F.when(equal, both(x, y)).when(longer, both(folded(x), y)).when(shorter, both(x, folded(y)))
    return F.when(small, True).otherwise(either.otherwise(False))


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, text: str, key: str, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) of set names whose exact Jaccard similarity reaches the threshold."""
    pairs = stage(pairs, "pairs")
    ends = pairs.select(F.col("a").alias("sid")).unionByName(pairs.select(F.col("b").alias("sid"))).distinct()
    wanted = small(sets.join(ends, "sid").select("sid", F.col("first_doc").alias("_doc")), "wanted")

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows in shingle_sets(batch.column(1), width):
                sets = pa.array([r.view(np.int64) for r in rows], pa.list_(pa.int64()))
                # Rows of one id may differ in text: keep the set that bears the name.
                mine = pc.equal(batch.column(0).slice(first, len(rows)), pa.array([_name(r) for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(rows)).filter(mine), sets.filter(mine)], ["sid", "shingles"]
                )

    texts = docs.select(F.col(key).cast("long").alias("_doc"), F.col(text).cast("string").alias("_text"))
    rows = texts.join(wanted, "_doc").select("sid", "_text").mapInArrow(arrays, "sid long, shingles array<long>")
    rows = stage(rows.dropDuplicates(["sid"]), "arrays")
    left = rows.select(F.col("sid").alias("a"), F.col("shingles").alias("x"))
    right = rows.select(F.col("sid").alias("b"), F.col("shingles").alias("y"))

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.asarray(x.values).view(np.uint64), np.asarray(y.values).view(np.uint64)
                if len(x) > len(y):
                    x, y = y, x
                common = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
                found.append(len(x) > 0 and 100 * common >= percent * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(pa.array(found, pa.bool_())) for i in (0, 1)], ["a", "b"])

    both = pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y")
    return stage(both.mapInArrow(linked, "a long, b long").distinct(), "links")


def _across(tiles: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of sets in different components that may link and whose first shared probe may be this tile's.

    What comes before the first shared probe in either set's order is missing in the other, so each link is found in that tile.
    """
    # Bands of sizes that may link: a set meets those of its own and of the next band.
    band = F.floor(F.log("n") / (math.log(100 / percent) + 1e-9)).cast("int")
    left = stage(tiles.withColumn("band", band), "left")
    x, y = left.alias("x"), left.withColumn("band", F.explode(F.array("band", F.col("band") - 1))).alias("y")
    return x.join(
        y,
        (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.band") == F.col("y.band")) & (F.col("x.root") != F.col("y.root"))
        & F.expr("x.n < y.n OR x.n = y.n AND x.sid < y.sid") & _possible(*[F.col(c) for c in ("x.n", "y.n", "x.rank", "y.rank")], percent),
    ).select(F.col("x.sid").alias("a"), F.col("y.sid").alias("b"))


def near_duplicates(
    docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, n_links, component_id.

    Sets of word n-grams link when 100 * common >= ``percent`` * union. The component is the
    smallest id reachable by links. Null, empty and blank texts have no shingles, no links
    and are their own component; equal sets are always linked. ``n_links`` counts the
    different sets a set was verified to link with: enough to tie its component together,
    not all of them, and 0 where its only partners are copies. Repeated ids are rows of their own
    that share a component. A null id stays null, names no
    component and finds no partner but copies of its text.

    Equal sets are one from the start. Candidates share a tile, that is one of the probe
    shingles of each; sets of sizes too far apart or bitmaps too different are dropped before
    the exact check. A first pass verifies each set with its neighbours in size in every tile; what
    those links have joined need not be compared again, so a group of copies costs about its
    size. The second pass compares the rest of each tile across components, in bands of sizes, and only where the tile may be
    the first the two share: what comes before it in either's order is missing in the other.
    """
    short_batches(docs.sparkSession)
    bits = [f"b{i}" for i in range(_LANES)]
    scanned = _scan(docs, text_col, id_col, width)
    named = scanned.where("times IS NULL").select("doc_id", "sid", "n", *bits, "wide")
    tiles = stage(_shared_only(_probe_rows(docs, text_col, _frequent(scanned), width, percent)), "tiles")
    check = partial(_verified, docs=docs, text=text_col, key=id_col, width=width, percent=percent)
    sets = stage(
        named.where("n > 0").groupBy("sid", "n").agg(F.min("doc_id").alias("first_doc"), *[F.first(b).alias(b) for b in (*bits, "wide")]),
        "sets",
    )
    maps = sets.select("sid", "n", *bits)

    def bounded(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        x, y = maps.alias("x"), maps.alias("y")
        with_x = pairs.join(x, F.col("a") == F.col("x.sid"))
        return with_x.join(y, F.col("b") == F.col("y.sid")).where(_bound("x", "y", percent)).select("a", "b")

    def still_possible(pairs: DataFrame) -> DataFrame:
        wide = sets.select("sid", "n", "wide")
        with_x = stage(pairs, "bounded").join(wide.alias("x"), F.col("a") == F.col("x.sid"))
        return with_x.join(wide.alias("y"), F.col("b") == F.col("y.sid")).where(_wide_bound("x", "y", percent)).select("a", "b")

    by_size = Window.partitionBy("shingle", "salt").orderBy("n", "sid")
    alike = F.expr(f"b IS NOT NULL AND 100 * least(n, m) >= {percent} * greatest(n, m)")
    chained = tiles.select(F.col("sid").alias("a"), "n", F.lag("sid").over(by_size).alias("b"), F.lag("n").over(by_size).alias("m")).where(alike).select("a", "b")
    by_chance = Window.partitionBy("shingle", "salt").orderBy(F.xxhash64("sid"), "sid")
    shuffled = tiles.where("salt > 0").select(F.col("sid").alias("a"), "n", F.lag("sid").over(by_chance).alias("b"), F.lag("n").over(by_chance).alias("m"))
    shuffled = shuffled.where(alike).select("a", "b")
    heads = tiles.where("salt > 0").groupBy("shingle", "salt").agg(F.min(F.struct("n", "sid")).alias("h"))
    heads = heads.select(
        F.col("h.sid").alias("a"), F.lag("h.sid").over(Window.partitionBy("shingle").orderBy("h.n", "h.sid")).alias("b")
    ).where("b IS NOT NULL")
    first = check(still_possible(bounded(chained.unionByName(shuffled).unionByName(heads))), sets=sets)
    roots = stage(connected_components(first), "roots")
    grown = tiles.join(roots, tiles["sid"] == roots["node"], "left").select("shingle", "sid", "n", "rank", F.coalesce("root", "sid").alias("root"))
    grown = stage(grown.distinct(), "grown")
    mixed = grown.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("shingle")
    across = _across(grown.join(mixed, "shingle"), percent)
    second = check(still_possible(bounded(across).join(first, ["a", "b"], "left_anti")), sets=sets)
    links = first.unionByName(second).distinct()
    roots = stage(connected_components(links), "roots")
    degree = links.select(F.explode(F.array("a", "b")).alias("sid")).groupBy("sid").agg(F.count("*").alias("n_links"))
    classes = sets.join(roots, sets["sid"] == roots["node"], "left").select(
        "sid", "n", "first_doc", F.coalesce("root", "sid").alias("root")
    )
    least = classes.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    classes = classes.join(least, "root").join(degree, "sid", "left").select(
        "sid", "n", "component_id", F.coalesce("n_links", F.lit(0)).alias("n_links")
    )
    out = named.select("doc_id", "sid", "n").join(classes, ["sid", "n"], "left")
    return out.select(
        "doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "doc_id").alias("component_id"),
    )
