"""Near-duplicate lines by a segment-partition edit-distance join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import small
from navspark.session import stage

EDITS = 2
SHORTEST = 20
_CLASSES = 8
_PARTS = 16
#: Lines of a tile that all others are compared with first.
_HEADS = 4
#: Bits of a key that come from the digest.
_KEY = 0xFFFFFFFFFFFE0000


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and length of the edits + 1 nearly equal segments of a line."""
    parts = edits + 1
    small, longer = divmod(length, parts)
    out, at = [], 0
    for i in range(parts):
        n = small + (i >= parts - longer)
        out.append((at, n))
        at += n
    return out


def probes(length: int, edits: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, length) of the substrings of a line that shorter or equal lines are probed with.

    If the i-th segment (from 0) is the first to match, at most i edits lie before it and at most
    edits - i after it; other starts need not be tried.
    """
    out = []
    for other in range(length - edits, length + 1):
        shift = length - other
        for i, (at, n) in enumerate(segments(other, edits)):
            low = max(0, at - i, at + shift - (edits - i))
            high = min(length - n, at + i, at + shift + (edits - i))
            out += [(other, i, start, n) for start in range(low, high + 1)]
    return out


def within(left: str, right: str, edits: int) -> bool:
    """Is the edit distance at most ``edits``? Bit d of word e says: with e edits, on diagonal d of the band."""
    if abs(len(left) - len(right)) > edits:
        return False
    head = 0
    most = min(len(left), len(right))
    while head < most and left[head] == right[head]:
        head += 1
    left, right = left[head:], right[head:]
    most = min(len(left), len(right))
    tail = 0
    while tail < most and left[-1 - tail] == right[-1 - tail]:
        tail += 1
    left, right = left[: len(left) - tail], right[: len(right) - tail]
    band = (1 << (2 * edits + 1)) - 1
    where: dict[str, int] = {}
    for j, c in enumerate(right):
        where[c] = where.get(c, 0) | 1 << (j + edits)
    words = [((1 << (e + 1)) - 1) << edits & band for e in range(edits + 1)]
    for i, c in enumerate(left):
        match = where.get(c, 0) >> i & band
        before, fresh = 0, 0
        for e, word in enumerate(words):
            fresh = (word & match) | before | before >> 1 | (fresh << 1 if e else 0)
            before, words[e] = word, fresh & band
            fresh &= band
        if not words[-1]:
            return False
    return bool(words[-1] >> (len(right) - len(left) + edits) & 1)


def _letters(line: str) -> int:
    """Counts of eight classes of characters, modulo 16, four bits each."""
    points = np.frombuffer(line.encode("utf-32-le"), np.uint32)
    counts = np.bincount(points % _CLASSES, minlength=_CLASSES) & 15
    return int((counts << np.arange(0, 4 * _CLASSES, 4)).sum())


def _near(left: np.ndarray, right: np.ndarray, edits: int) -> np.ndarray:
    """May lines with these letters be within ``edits``? An edit changes the sum of the counts' differences by 2 at most."""
    apart = np.zeros(len(left), np.int64)
    for i in range(_CLASSES):
        gap = np.abs((left >> 4 * i & 15) - (right >> 4 * i & 15))
        apart += np.minimum(gap, 16 - gap)
    return apart <= 2 * edits


def _near_sql(left: str, right: str, edits: int) -> str:
    gaps = [f"abs((shiftright({left}, {4 * i}) & 15) - (shiftright({right}, {4 * i}) & 15))" for i in range(_CLASSES)]
    return " + ".join(f"least({g}, 16 - {g})" for g in gaps) + f" <= {2 * edits}"


def _exploded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.posexplode(F.split(text_col, "\n", -1)).alias("line_no", "line"))
    return rows.where("trim(line) <> ''")


def _keys(lines: DataFrame, edits: int) -> DataFrame:
    """Index and probe keys of each different line, once per task: (key, h, mark).

    An even key indexes a line and probes with it, an odd one only probes. Of a digest 47 bits are kept: a chance meeting costs a look, no
    result, and zeros take no room in a shuffle. ``mark`` has the line's place, roughly, in its upper half and its letters in the lower one.
    """

    def cuts(size: int) -> list[tuple[int, int, int, int]]:
        own = [(size * 64 + i, at, at + n) for i, (at, n) in enumerate(segments(size, edits))]
        tried = [(other * 64 + i, at, at + n) for other, i, at, n in probes(size, edits)]
        return [(seed, 0, a, b) for seed, a, b in own] + [(seed, 1, a, b) for seed, a, b in tried if (seed, a, b) not in own]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        plans: dict[int, list] = {}
        digest = xxhash.xxh3_64_intdigest
        for batch in batches:
            keys, names, marks, sent = [], [], [], []
            places = np.maximum(np.asarray(batch.column(2)), 0).astype(np.float32).view(np.int32)
            for h, line, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), places.tolist(), strict=True):
                if h in seen:
                    continue
                seen.add(h)
                plan = plans.get(len(line))
                if plan is None:
                    plan = plans[len(line)] = cuts(len(line))
                keys += [digest(line[a:b].encode(), seed) & _KEY | side for seed, side, a, b in plan]
                names.append(h)
                marks.append(place << 32 | _letters(line))
                sent.append(len(plan))
            spread = [np.repeat(np.array(x, np.int64), sent) for x in (names, marks)]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), *map(pa.array, spread)], ["key", "h", "mark"])

    return lines.mapInArrow(emit, "key long, h long, mark long")


def _met(keys: DataFrame, edits: int) -> DataFrame:
    """(kind, key, h, mark, other): what comes of each tile, the lines that share a key.

    Every probing line is paired with the first ``_HEADS`` indexed ones, in the order of their places (kind 0). Of tiles with more
    of them, the remaining indexed lines (kind 1) and the probing ones (kind 2) are handed on. Tiles are streamed, sorted, and never held.
    """
    schema = pa.schema([("kind", pa.int8()), *[(c, pa.int64()) for c in ("key", "h", "mark", "other")]])

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Of the tile that the last batch ended in: its heads, and how many were indexed beside them.
        heads, more, tail = np.zeros((3, 0), np.int64), 0, None
        for batch in batches:
            grid = np.stack([np.asarray(batch.column(i)) for i in range(3)])
            if not grid.shape[1]:
                continue
            if heads.shape[1] and heads[0, 0] >> 1 != grid[0, 0] >> 1:
                heads, more = heads[:, :0], 0
            # A line seen by several tasks comes once, with its first place.
            key, h = grid[:2]
            fresh = np.concatenate(([(key[0], h[0]) != tail], (key[1:] != key[:-1]) | (h[1:] != h[:-1])))
            tail = (key[-1], h[-1])
            grid = np.concatenate((heads, grid[:, fresh]), axis=1)
            if not grid.shape[1]:
                continue
            grid = grid[:, np.lexsort((grid[2], grid[0]))]
            key, h, mark = grid
            tile = np.cumsum(np.concatenate(([0], key[1:] >> 1 != key[:-1] >> 1)))
            starts = np.searchsorted(tile, np.arange(tile[-1] + 2))
            indexed = np.add.reduceat((key & 1) == 0, starts[:-1])
            extra = np.zeros(len(indexed), np.int64)
            extra[0] = more
            rank = np.arange(len(key)) - starts[:-1][tile]
            probing = (key & 1) == 1
            asks = np.flatnonzero(probing)
            out = []
            for j in range(_HEADS):
                who = asks[indexed[tile[asks]] > j]
                head = starts[:-1][tile[who]] + j
                good = (h[who] != h[head]) & _near(mark[who], mark[head], edits)
                who, head = who[good], head[good]
                out.append((np.zeros(len(who), np.int8), key[who], h[who], mark[who], h[head]))
            large = (indexed + extra > _HEADS)[tile]
            rest = np.flatnonzero(~probing & (rank >= _HEADS))
            open_ = np.flatnonzero(probing & large)
            for kind, rows in ((1, rest), (2, open_)):
                out.append((np.full(len(rows), kind, np.int8), key[rows] & ~np.int64(1), h[rows], mark[rows], np.zeros(len(rows), np.int64)))
            last = slice(starts[-2], starts[-1])
            own = grid[:, last][:, (key[last] & 1) == 0]
            more = int(max(own.shape[1] - _HEADS, 0) + extra[-1])
            heads = own[:, :_HEADS]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), f.type) for x, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    # One row for both uses travels; only where tiles meet are there two.
    uses = F.when(F.col("key").bitwiseAND(F.lit(1)) == 0, F.array("key", F.col("key") + 1)).otherwise(F.array("key"))
    dealt = keys.repartition(F.shiftright("key", 1)).select(F.explode(uses).alias("key"), "h", "mark").sortWithinPartitions("key", "h", "mark")
    return dealt.mapInArrow(pair, "kind byte, key long, h long, mark long, other long")


def repeated_lines(
    docs: DataFrame, edits: int = EDITS, shortest: int = SHORTEST, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, n_lines, dropped) of every document: the numbers of lines, from 0, that repeat an earlier one.

    A line goes if an equal line, or for lines of at least ``shortest`` characters one within ``edits``
    edits, comes before it by (doc_id, line number). Lines end at a line feed; blank lines
    stay and are no copies. Null text has no lines, empty text one, which is blank. Repeated rows of an id are
    one document. Rows without an id are left out.

    Lines that share a key form a tile. Each is compared with the tile's first four; what that shows to be a repeat
    is compared no further, all others with the rest of the tile, so a group of near copies costs about its size.
    """
    docs = docs.where(F.col(id_col).isNotNull())
    every = _exploded(docs, id_col, text_col).withColumn("h", F.xxhash64("line"))
    rows = stage(every.select("doc_id", "line_no", "h", F.length("line").alias("n")), "lines")
    kinds = stage(rows.groupBy("h", "n").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("times")), "kinds")
    long_ = every.where(F.length("line") >= shortest)
    met = stage(_met(_keys(long_.select("h", "line", "doc_id"), edits), edits), "met")
    # Only lines that met another are asked for their place again, a small part: the table of all lines moves once for it.
    ids = small(met.select(F.explode(F.array("h", "other")).alias("h")).distinct(), "ids")
    firsts = stage(kinds.select("h", "first").join(ids, "h"), "firsts")

    def later(pairs: DataFrame, name: str) -> DataFrame:
        """The later line of each pair that is within the distance."""
        pairs = stage(pairs, name)
        wanted = small(pairs.select(F.explode(F.array("a", "b")).alias("h")).distinct(), "wanted")
        texts = stage(long_.select("h", "line").join(wanted, "h").dropDuplicates(["h"]).join(firsts, "h"), "texts")
        left = texts.select(F.col("h").alias("a"), F.col("line").alias("x"), F.col("first").alias("x_first"))
        right = texts.select(F.col("h").alias("b"), F.col("line").alias("y"), F.col("first").alias("y_first"))

        def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [within(x, y, edits) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good, pa.bool_()))], ["h"])

        both = pairs.join(left, "a").join(right, "b").select(F.when(F.col("x_first") < F.col("y_first"), F.col("b")).otherwise(F.col("a")).alias("h"), "x", "y")
        return stage(both.mapInArrow(verify, "h long").distinct(), "near")

    heads = met.where("kind = 0").select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()
    near = later(heads, "heads")
    # Lines already known to repeat one need no other proof, but still are one for others.
    open_ = stage(met.where("kind = 2").select("key", "h", "mark").join(near, "h", "left_anti").join(firsts, "h"), "open")
    rest = met.where("kind = 1").select("key", F.col("h").alias("other"), F.col("mark").alias("other_mark")).join(firsts.select(F.col("h").alias("other"), F.col("first").alias("other_first")), "other")
    pairs = open_.join(rest, "key").where((F.col("h") != F.col("other")) & F.expr(_near_sql("mark", "other_mark", edits)))
    # From the other side, too: an indexed line may be the later of the two.
    known = near.select(F.col("h").alias("other"), F.lit(True).alias("known"))
    back = met.where("kind = 2").select("key", "h", "mark").join(firsts, "h").join(rest.join(known, "other", "left_anti"), "key")
    back = back.where((F.col("h") != F.col("other")) & (F.col("first") < F.col("other_first")) & F.expr(_near_sql("mark", "other_mark", edits)))
    pairs = pairs.where(F.col("other_first") < F.col("first")).select("h", "other").unionByName(back.select("h", "other"))
    pairs = pairs.select(F.least("h", "other").alias("a"), F.greatest("h", "other").alias("b")).distinct()
    near = near.unionByName(later(pairs.join(heads, ["a", "b"], "left_anti"), "rest")).distinct()
    near = small(near.withColumn("near", F.lit(True)), "repeats")
    judged = kinds.join(near, "h", "left").where("times > 1 OR near").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    place = F.struct("doc_id", "line_no")
    # A very common line would meet its many occurrences in one task: both sides are dealt into parts.
    judged = judged.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(_PARTS - 1))))
    dealt = rows.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)).cast("int"))
    gone = dealt.join(judged, ["h", "part"]).where(F.col("near") | (F.col("first") < place)).groupBy("doc_id")
    gone = gone.agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    lines = F.when(F.col(text_col).isNull(), 0).otherwise(F.regexp_count(F.col(text_col), F.lit("\n")) + 1)
    whole = docs.groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(lines).cast("long").alias("n_lines"))
    return whole.join(gone, "doc_id", "left").select("doc_id", "n_lines", F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))


def without_lines(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the dropped lines taken out of the text."""
    gone = dropped.select(F.col("doc_id").alias("gone_id"), F.col("dropped").alias("gone_lines"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).join(gone, F.col(f"row.{id_col}") == F.col("gone_id"), "left")
    none = F.array().cast("array<int>")
    kept = F.filter(F.split(f"row.{text_col}", "\n", -1), lambda _, i: ~F.array_contains(F.coalesce("gone_lines", none), i))
    return rows.select(F.col("row").withField(text_col, F.array_join(kept, "\n")).alias("row")).select("row.*")
