"""Word-first language identification with back-off to character n-grams."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import short_batches
from navspark.session import stage

#: A word in training and prediction alike: letters with the marks that belong to them.
WORD = regex.compile(r"[\p{L}\p{M}]+")
LETTER = regex.compile(r"\p{L}")
ORDERS = (4, 3, 2, 1)
SMOOTHING = 0.5
UNKNOWN = "und"
#: Characters of text judged, or counted, at a time.
_SLICE = 500_000


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text)


@dataclass
class Table(Mapping):
    """Log frequencies of words or n-grams, only for the languages that have them.

    ``floors`` is what an entry counts in a language that lacks it, ``above`` how much more it counts in
    the others: entry i holds ``langs`` and ``above`` from ``starts[i]`` to ``starts[i + 1]``. Entries go by hash;
    their names stay on the driver.
    """

    hashes: np.ndarray
    starts: np.ndarray
    langs: np.ndarray
    above: np.ndarray
    floors: np.ndarray
    names: list[str] | None = None

    def rows(self, names: list[str]) -> np.ndarray:
        """Entry of each name, -1 if unknown."""
        if not len(self.hashes) or not names:
            return np.full(len(names), -1)
        asked = np.fromiter(map(_hash, names), np.uint64, len(names))
        at = np.minimum(np.searchsorted(self.hashes, asked), len(self.hashes) - 1)
        return np.where(self.hashes[at] == asked, at, -1)

    def expanded(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(position in ``rows``, language, log frequency above the floor) of all that the rows hold."""
        counts = self.starts[rows + 1] - self.starts[rows]
        owner = np.repeat(np.arange(len(rows)), counts)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts) + self.starts[rows][owner]
        return owner, self.langs[at], self.above[at]

    def __getitem__(self, name: str) -> tuple:
        row = self.rows([name])
        if row[0] < 0:
            raise KeyError(name)
        out = self.floors.copy()
        _, langs, above = self.expanded(row)
        out[langs] += above
        return tuple(out.tolist())

    def __iter__(self):
        return iter(self.names or [])

    def __len__(self) -> int:
        return len(self.hashes)


def _table(kept: DataFrame, totals: list[int]) -> Table:
    """``kept`` has name and counts: (lang, n) of the languages that have it."""
    found = kept.select("name", F.col("counts.lang").alias("langs"), F.col("counts.n").alias("ns")).toArrow().combine_chunks()
    names = found.column("name").to_pylist()
    floors = np.log(SMOOTHING) - np.log(np.array(totals, float) + SMOOTHING * (len(names) + 1))
    keys = np.fromiter(map(_hash, names), np.uint64, len(names))
    lists = found.column("langs").combine_chunks(), found.column("ns").combine_chunks()
    langs, ns = (np.asarray((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c).flatten()) if names else np.zeros(0, int) for c in lists)
    lengths = np.asarray(found.column("langs").combine_chunks().value_lengths()) if names else np.zeros(0, int)
    order = np.argsort(keys)
    starts = np.concatenate(([0], np.cumsum(lengths[order])))
    at = np.repeat((np.cumsum(lengths) - lengths)[order] - starts[:-1], lengths[order]) + np.arange(starts[-1])
    above = np.log(ns[at] + SMOOTHING) - np.log(SMOOTHING)
    return Table(keys[order], starts.astype(np.int64), langs[at].astype(np.int32), above, floors, [names[i] for i in order])


def _word_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, word, n), added up within slices of text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tallies: dict[str, Counter] = {}
            size = 0
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_py()
                tallies.setdefault(batch.column(0)[i].as_py(), Counter()).update(WORD.findall(content.lower()))
                size += len(content)
                if size >= _SLICE or i == batch.num_rows - 1:
                    rows = [(code, w, n) for code, tally in tallies.items() for w, n in tally.items()]
                    tallies, size = {}, 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
                        ["lang", "word", "n"],
                    )

    chosen = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return chosen.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def learn(
    docs: DataFrame, text: str = "text", lang: str = "lang", word_share: float = 2e-6, gram_share: float = 1e-5
) -> dict:
    """Log frequencies of words and of character n-grams per language.

    Counts cover every row with a language. Kept are words with at least
    ``word_share`` of all words of any one language, and n-grams with at least ``gram_share`` of
    those of their length in any one: at most languages / share entries each, so the model's size is bounded
    whatever the corpus, and a small language keeps its own statistics. An entry lists only languages that have it.
    Rows without text, letters or language teach nothing; without any
    language the model is empty and every text is ``und``.
    """
    spark = docs.sparkSession
    short_batches(spark)
    counts = stage(_word_counts(docs, text, lang), "words")
    totals = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    codes = sorted(totals)
    if not codes:
        return {"langs": [], "words": {}, "grams": {}}
    marked = F.concat(F.lit("_"), "word", F.lit("_"))
    parts = []
    for order in ORDERS:
        whole = marked if order > 1 else F.col("word")
        starts = F.sequence(F.lit(1), F.greatest(F.length(whole) - (order - 1), F.lit(1)))
        cut = _cuts(whole, order, starts)
        parts.append(F.when(F.length(whole) >= order, cut).otherwise(F.array().cast("array<struct<order:int,name:string>>")))
    grams = counts.select("lang", "n", F.inline(F.concat(*parts)))
    grams = stage(grams.groupBy("order", "lang", "name").agg(F.sum("n").alias("n")), "grams")
    sums = {(r["order"], r["lang"]): r["n"] for r in grams.groupBy("order", "lang").agg(F.sum("n").alias("n")).collect()}

    def table(entries: DataFrame, total: list[int], share: float) -> Table:
        index = spark.createDataFrame([(code, i, n) for i, (code, n) in enumerate(zip(codes, total, strict=True))], "lang string, i int, total long")
        rows = entries.join(index, "lang").groupBy("name").agg(
            F.max(F.col("n") >= share * F.col("total")).alias("kept"), F.sort_array(F.collect_list(F.struct(F.col("i").alias("lang"), "n"))).alias("counts")
        )
        return _table(rows.where("kept"), total)

    words = table(counts.withColumnRenamed("word", "name"), [totals[c] for c in codes], word_share)
    of_order = {k: table(grams.where(F.col("order") == k), [sums.get((k, c), 0) for c in codes], gram_share) for k in ORDERS}
    return {"langs": codes, "words": words, "grams": of_order}


def _cuts(whole, order: int, starts):
    return F.transform(starts, lambda i: F.struct(F.lit(order).alias("order"), F.substring(whole, i, F.lit(order)).alias("name")))


def _backed_off(words: list[str], model: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For unseen words the order that is known of each (0: none), and (word, language, mean above the floor) of its n-grams."""
    order_of = np.zeros(len(words), np.int64)
    entries = [(np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0))]
    pending = list(range(len(words)))
    for order in ORDERS:
        grams, owners = [], []
        for w in pending:
            marked = f"_{words[w]}_" if order > 1 else words[w]
            cut = [marked[i : i + order] for i in range(len(marked) - order + 1)]
            grams += cut
            owners += [w] * len(cut)
        rows = model["grams"][order].rows(grams)
        known, owner = rows >= 0, np.array(owners, np.int64)
        found = np.bincount(owner[known], minlength=len(words))
        order_of[found > 0] = order
        at, langs, above = model["grams"][order].expanded(rows[known])
        of_word = owner[known][at]
        entries.append((of_word, langs, above / found[of_word]))
        pending = [w for w in pending if not found[w]]
    return order_of, *(np.concatenate([e[i] for e in entries]) for i in range(3))


def decided(texts: list[str | None], model: dict) -> list[tuple[str, float]]:
    """Language of each text and its share among the languages, both from all of its words.

    A known word adds its log frequency in every language; an unseen one the mean over its
    longest n-grams that are known, if any.
    """
    names, n = model["langs"], len(texts)
    numbers: dict[str, int] = {}
    rows, words, times = [], [], []
    for i, text in enumerate(texts):
        if text and names and LETTER.search(text):
            tally = Counter(WORD.findall(text.lower()))
            rows += [i] * len(tally)
            words += [numbers.setdefault(w, len(numbers)) for w in tally]
            times += tally.values()
    if not rows:
        return [(UNKNOWN, 0.0)] * n
    row, word, times = np.array(rows), np.array(words), np.array(times, float)
    listed = list(numbers)
    at = model["words"].rows(listed)
    known, unseen = np.flatnonzero(at >= 0), np.flatnonzero(at < 0)
    own, langs, above = model["words"].expanded(at[known])
    order_of, far, far_langs, far_above = _backed_off([listed[w] for w in unseen], model)
    # Floors: words, then each order of n-grams.
    floor_of = np.zeros(len(listed), np.int64)
    floor_of[unseen] = order_of + (order_of == 0) * -1
    owner = np.concatenate((known[own], unseen[far]))
    sort = np.argsort(owner, kind="stable")
    langs, above = np.concatenate((langs, far_langs))[sort], np.concatenate((above, far_above))[sort]
    starts = np.searchsorted(owner[sort], np.arange(len(listed) + 1))
    size = (starts[1:] - starts[:-1])[word]
    each = np.repeat(np.arange(len(word)), size)
    place = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size) + starts[:-1][word][each]
    width = len(names)
    totals = np.bincount(row[each] * width + langs[place], times[each] * above[place], n * width).reshape(n, width)
    used = np.zeros(n)
    for floor, table in [(0, model["words"]), *model["grams"].items()]:
        mine = floor_of[word] == floor
        count = np.bincount(row[mine], times[mine], n)
        used += count
        totals += count[:, None] * table.floors
    # Words repeat their neighbours' evidence: more than twenty of them add no certainty.
    best = totals.max(axis=1)
    shares = np.exp(np.maximum(-700.0, (totals - best[:, None]) * np.minimum(1.0, 20 / np.maximum(used, 1))[:, None]))
    named = np.bincount(row, minlength=n) > 0
    return [(names[k], s) if ok else (UNKNOWN, 0.0) for k, s, ok in zip(totals.argmax(axis=1), (1 / shares.sum(axis=1)).tolist(), named, strict=True)]


def decide(text: str | None, model: dict, cache: dict | None = None) -> tuple[str, float]:
    """``decided`` for a single text."""
    return decided([text], model)[0]


def identify(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (0 to 1), replacing columns of those names.

    A null text, an empty one or one without a letter is ``und`` with score 0. Of equally
    likely languages the first in code point order wins. Every row is kept as it is. A long text is judged whole; others go
    by about half a megabyte at a time, so a task holds little besides the model.
    """
    short_batches(docs.sparkSession)
    bare = {k: _unnamed(v) if k == "words" else {o: _unnamed(t) for o, t in v.items()} if k == "grams" else v for k, v in model.items()}
    shared = docs.sparkSession.sparkContext.broadcast(bare)

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found, part, size = [], [], 0
            for value in batch:
                content = value.as_py()
                part.append(content)
                size += len(content or "")
                if size >= _SLICE:
                    found += decided(part, shared.value)
                    part, size = [], 0
            found += decided(part, shared.value)
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["lang_pred", "score"]
            )

    found = docs.withColumn("_language", predict(F.col(text).cast("string")))
    return found.withColumns({"lang_pred": F.col("_language.lang_pred"), "score": F.col("_language.score")}).drop("_language")


def _unnamed(table: Table | dict) -> Table | dict:
    return Table(table.hashes, table.starts, table.langs, table.above, table.floors) if isinstance(table, Table) else table
