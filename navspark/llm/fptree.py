"""Ranked lexical search: branch and bound over trees of shared term prefixes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.tokens import slices, word_hashes
from navspark.session import stage

RANKS = 20
#: Characters of item text taken on in one pass over the documents.
ITEM_CHARS = 4_000_000
_LEAF = 32
_ROWS = 8_192
#: Numbers held by the nodes of one tree.
_CELLS = 40_000_000
_PARTS = 64
#: Bytes that end a term: all of ASCII but letters and digits.
_OUTSIDE = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def weight(n: int, df: int) -> int:
    """A term's weight in a corpus of n documents with terms, df of which hold it."""
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _gain(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """What a weight is multiplied by: grows with tf, falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 12 * m)


class Tree:
    """Documents of one block as a tree of term prefixes, frequent terms first.

    ``starts`` cuts ``terms`` and ``tfs`` into the documents' vectors, each ascending in term
    (terms are numbered by falling frequency). Documents with a common prefix are neighbours after
    sorting, so a node is a run of them; runs of up to ``leaf`` are leaves, and small neighbouring runs share one.
    A node keeps the largest tf of every term and the smallest m below it.
    """

    def __init__(self, ids: np.ndarray, m: np.ndarray, starts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, size: int, leaf: int = _LEAF):
        keys = [terms[a:b].astype(">u4").tobytes() for a, b in zip(starts[:-1], starts[1:], strict=True)]
        order = np.array(sorted(range(len(ids)), key=keys.__getitem__), np.int64)
        lengths = np.diff(starts)[order]
        self.starts = np.concatenate(([0], np.cumsum(lengths)))
        at = np.repeat(starts[:-1][order] - self.starts[:-1], lengths) + np.arange(self.starts[-1])
        self.ids, self.m, self.terms, self.tfs = ids[order], m[order], terms[at], tfs[at].astype(np.int64)
        self.gains = _gain(self.tfs, np.repeat(self.m, lengths))
        self.spans: list[tuple[int, int]] = []
        self.children: list[list[int]] = []
        self._grow(leaf)
        self.tf_most = np.zeros((len(self.spans), size), np.int32)
        self.m_least = np.zeros(len(self.spans), np.int64)
        for node in range(len(self.spans) - 1, -1, -1):
            low, high = self.spans[node]
            self.m_least[node] = self.m[low:high].min()
            if self.children[node]:
                self.tf_most[node] = self.tf_most[self.children[node]].max(axis=0)
            else:
                own = slice(self.starts[low], self.starts[high])
                np.maximum.at(self.tf_most[node], self.terms[own], self.tfs[own].astype(np.int32))

    def _grow(self, leaf: int) -> None:
        """Nodes in an order in which children follow their parent; node 0 is the root."""
        self.spans, self.children, pending = [(0, len(self.ids))], [[]], [(0, 0)]
        while pending:
            node, depth = pending.pop()
            low, high = self.spans[node]
            if high - low <= leaf:
                continue
            # Sorted, so what the outer two share all of them share.
            first, last = (self.terms[self.starts[i] + depth : self.starts[i + 1]] for i in (low, high - 1))
            short = min(len(first), len(last))
            differ = np.flatnonzero(first[:short] != last[:short])
            depth += int(differ[0]) if len(differ) else short
            if not len(differ) and len(first) == len(last):
                continue  # one vector many times
            at = self.starts[low:high] + depth
            inside = at < self.starts[low + 1 : high + 1]
            following = np.where(inside, self.terms[np.minimum(at, len(self.terms) - 1)], -1)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(following)) + 1, [high - low])) + low
            merged = [int(cuts[0])]
            for i in range(1, len(cuts) - 1):
                if cuts[i + 1] - merged[-1] > leaf:
                    merged.append(int(cuts[i]))
            for a, b in zip(merged, [*merged[1:], high], strict=True):
                self.children[node].append(len(self.spans))
                pending.append((len(self.spans), depth))
                self.spans.append((a, b))
                self.children.append([])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: tuple, ranks: int) -> tuple:
        """The best (scores, ids) after this tree, given those before it; highest first, ties to the smaller id."""
        bounds = (_gain(self.tf_most[:, terms].astype(np.int64), self.m_least[:, None]) * weights).sum(axis=1)
        of_term = np.zeros(self.tf_most.shape[1], np.int64)
        of_term[terms] = weights
        stack = [0]
        while stack:
            node = stack.pop()
            least = best[0][-1] if len(best[0]) == ranks else 1
            # A bound equal to the last score still admits a smaller id.
            if bounds[node] < max(least, 1):
                continue
            if self.children[node]:
                stack += sorted(self.children[node], key=bounds.__getitem__)
                continue
            low, high = self.spans[node]
            a, b = self.starts[low], self.starts[high]
            sums = np.concatenate(([0], np.cumsum(of_term[self.terms[a:b]] * self.gains[a:b])))
            scores = np.diff(sums[self.starts[low : high + 1] - a])
            good = np.flatnonzero(scores >= max(least, 1))
            if len(good):
                scores, ids = np.concatenate((best[0], scores[good])), np.concatenate((best[1], self.ids[low + good]))
                first = np.lexsort((ids, -scores))[:ranks]
                best = scores[first], ids[first]
        return best


def _vectors(docs: DataFrame, id_col: str, text_col: str, vocabulary: np.ndarray) -> DataFrame:
    """(doc_id, n, terms, tfs) of each document: number of its terms, and those of the vocabulary it holds, ascending."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            for first, data, offsets in slices(batch.column(1)):
                hashes, rows = word_hashes(data, offsets, _OUTSIDE)
                n = len(offsets) - 1
                at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
                met = known[at] == hashes
                keys, tfs = np.unique(rows[met] * len(known) + at[met], return_counts=True)
                starts = pa.array(np.searchsorted(keys, np.arange(n + 1) * len(known)), pa.int32())
                lists = [pa.ListArray.from_arrays(starts, pa.array(x, pa.int32())) for x in (keys % len(known), tfs)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(np.bincount(rows, minlength=n), pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"]
                )

    chosen = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    counted = chosen.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<int>")
    return stage(counted.where("n > 0"), "vectors")


def _found(vectors: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], size: int, ranks: int) -> DataFrame:
    """(item, rank, doc_id, score): each task builds trees of its rows and keeps its best for every item."""
    totals = vectors.agg(F.count("*"), F.sum("n")).first()
    n, every = totals[0], totals[1] or 1
    df = np.zeros(size, np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).collect():
        df[r["t"]] = r["df"]
    by_frequency = np.argsort(-df, kind="stable")
    place = np.empty(size, np.int64)
    place[by_frequency] = np.arange(size)
    weights = np.array([weight(n, x) for x in df.tolist()], np.int64)
    queries = [(place[terms], weights[terms] * times) for terms, times in items]
    shared = vectors.sparkSession.sparkContext.broadcast((place, queries))
    rows = max(256, min(_ROWS, _CELLS // max(size, 1)))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, queries = shared.value
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(queries)
        for whole in batches:
            for first in range(0, whole.num_rows, rows):
                batch = whole.slice(first, rows)
                lengths = np.asarray(batch.column(2).value_lengths())
                starts = np.concatenate(([0], np.cumsum(lengths)))
                terms = place[np.asarray(batch.column(2).flatten())]
                tfs = np.asarray(batch.column(3).flatten())
                sort = np.lexsort((terms, np.repeat(np.arange(len(lengths)), lengths)))
                m = 75 + (25 * np.asarray(batch.column(1)) * n) // every
                tree = Tree(np.asarray(batch.column(0)), m, starts, terms[sort], tfs[sort], len(place))
                for i, (wanted, worth) in enumerate(queries):
                    best[i] = tree.search(wanted, worth, best[i], ranks)
        item = np.repeat(np.arange(len(best)), [len(s) for s, _ in best])
        scores, ids = (np.concatenate([np.zeros(0, np.int64), *[b[k] for b in best]]) for k in (0, 1))
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(ids), pa.array(scores)], ["item", "doc_id", "score"])

    found = vectors.where("doc_id IS NOT NULL AND size(terms) > 0").mapInArrow(search, "item int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id")]
    # In two steps, so that no task meets all tasks' lists of an item.
    found = found.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(_PARTS)))
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).where(F.col("rank") <= ranks)
    found = found.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).where(F.col("rank") <= ranks)
    return found.select("item", "rank", "doc_id", "score")


def ranked_documents(
    docs: DataFrame, items: DataFrame, ranks: int = RANKS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text: str = "text", item_chars: int = ITEM_CHARS,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``ranks`` best documents of each item, highest score first, ties to the smaller id.

    Terms are runs of letters and digits, where every character beyond ASCII is a letter and only A-Z are
    lower-cased. Scores are the whole numbers that the weights and lengths of the corpus
    give; documents that score 0 are not returned. Null and empty texts, of documents or items, have no terms. Repeated
    documents are ranked each. A document without an id counts in the statistics but is not returned. Equal item rows are
    one item; an id with different texts gets a ranking for each of them.

    Items are searched in blocks of about ``item_chars`` characters, each block against all documents; a
    block's terms are what travels to the tasks. The first pass cuts every document down to terms of the
    block; the statistics come from those vectors. The second builds trees from them without a shuffle.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("text")).distinct()
    asked = stage(asked, "asked")
    blocks = max(1, -(-(asked.agg(F.sum(F.length("text"))).first()[0] or 0) // item_chars))
    results = None
    for block in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        data = pa.array([r["text"] for r in part], pa.string())
        hashes, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        for first, chunk, offsets in slices(data):
            words, rows = word_hashes(chunk, offsets, _OUTSIDE)
            hashes.append(words)
            owners.append(rows + first)
        vocabulary, terms = np.unique(np.concatenate(hashes), return_inverse=True)
        if not len(vocabulary):
            continue
        owner = np.concatenate(owners)
        queries = [np.unique(terms[owner == i], return_counts=True) for i in range(len(part))]
        vectors = _vectors(docs, id_col, text_col, vocabulary)
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(part)], "item int, item_id long")
        found = _found(vectors, queries, len(vocabulary), ranks).join(F.broadcast(names), "item")
        found = found.select("item_id", "rank", "doc_id", "score")
        results = found if results is None else results.unionByName(found)
    return results if results is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
