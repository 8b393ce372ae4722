"""Benchmark decontamination: item-sized windows found by SimHash in Hamming blocks and by rare shingles, exact check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from navspark.llm.common import word_array
from navspark.session import stage

WIDTH = 5
SIMILARITY = 0.75
RADIUS = 15
_BLOCKS = 4
#: Largest number of distinct benchmark shingles that is broadcast; more of them are joined by a shuffle.
BROADCAST = 2_000_000


def _hashes(text: Column) -> Column:
    return F.transform(word_array(F.lower(text)), lambda w: F.xxhash64(w))


def _shingles(words: Column, width: int) -> Column:
    """Hash of each run of ``width`` words, in order; fewer words make one run."""
    def run(start: Column) -> Column:
        return F.xxhash64(*[F.get(words, start + i) for i in range(width)])

    last = F.greatest(F.size(words) - width, F.lit(0))
    return F.when(F.size(words) > 0, F.transform(F.sequence(F.lit(0), last), run)).otherwise(F.array().cast("array<bigint>"))


def _fingerprints(windows: DataFrame, keys: list[str]) -> DataFrame:
    """64-bit SimHash of the words of each window.

    Sixteen sums hold the 64 bit counters, four to a sum in lanes of 16 bits; a window has fewer words than that.
    """
    word = windows.select(*keys, F.size("words").alias("_n"), F.explode("words").alias("_w"))
    lanes = [
        F.sum(F.shiftrightunsigned("_w", j).bitwiseAND(F.lit(0x0001000100010001))).alias(f"s{j}") for j in range(16)
    ]
    sums = word.groupBy(*keys).agg(F.first("_n").alias("_n"), *lanes)
    # A loop and not 64 terms: written out, they make the plans, which the driver holds and compiles, several times as large.
    lanes = F.array(*[F.col(f"s{j}") for j in range(16)])
    bit = "if((shiftrightunsigned(get(lanes, k % 16), k - k % 16) & 65535) * 2 > _n, shiftleft(1L, k), 0L)"
    sums = sums.select(*keys, "_n", lanes.alias("lanes"))
    return sums.select(*keys, F.expr(f"aggregate(sequence(0, {16 * _BLOCKS - 1}), 0L, (x, k) -> x | {bit})").alias("print"))


def _blocks(print_: Column) -> Column:
    """The four blocks of a fingerprint, each with its number above its 16 bits."""
    return F.array(*[F.shiftrightunsigned(print_, 16 * b).bitwiseAND(F.lit(0xFFFF)) + (b << 16) for b in range(_BLOCKS)])


def _rarest(rows: DataFrame, keys: list[str], width: int, known: DataFrame, needed) -> DataFrame:
    """The first size - needed + 1 shingles of each row, those in few items first; the k-th repetition is a shingle of its own.

    A row with at least ``needed`` shingles in common with another shares one of these with
    it, if the other's are cut likewise.
    """
    runs = rows.select(*keys, F.explode(_shingles(F.col("words"), width)).alias("shingle"))
    runs = runs.groupBy(*keys, "shingle").agg(F.count("*").alias("times")).join(known, "shingle", "left")
    each = F.transform(F.sequence(F.lit(1), F.col("times")), lambda k: F.struct(F.coalesce("items", F.lit(0)).alias("items"), F.xxhash64("shingle", k).alias("token")))
    lists = runs.groupBy(*keys).agg(F.sort_array(F.flatten(F.collect_list(each))).alias("tokens"))
    size = F.size("tokens")
    kept = F.slice("tokens", F.lit(1), size - F.ceil(F.round(needed(size), 9)).cast("int") + 1)
    return lists.select(*keys, F.explode(kept).alias("t")).where("t.items > 0").select(*keys, F.col("t.token").alias("token"))


def contaminated(
    docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, similarity: float = SIMILARITY, radius: int = RADIUS,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """Pairs (doc_id, item_id, start_word, similarity): a window of the document repeats the item.

    A window has as many words as the item; a shorter document is one window. Fingerprints
    of windows and items within ``radius`` bits meet in one of four 16-bit blocks, where they differ by at
    most radius / 4 bits; the items' blocks are listed with all such neighbours. A pair that reaches the
    similarity can lie further apart than that, so windows and items that share one of their
    rarest shingles are candidates too; no pair that reaches it fails to, and none is lost. Pairs
    found are compared exactly: common over all word shingles, counted with their
    repetitions. The best window of each pair is returned, the first of equals.

    Windows start at shingles that the benchmark has, and hold enough of them to reach the similarity; no
    other window can pass the exact check unless one of these does. An item of fewer than ``width``
    words is no passage and matches only a document of just these words. Null, empty and blank texts, on either side,
    match nothing. An item repeated under several ids matches under each; repeated documents
    give one row per id and item. Rows without an id are left out.
    """
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), _hashes(F.col(item_text)).alias("words"))
    items = stage(items.where("size(words) > 0").withColumn("shingles", _shingles(F.col("words"), width)), "items")
    lengths = items.select(F.explode(F.array_distinct("shingles")).alias("shingle"), F.size("words").alias("length"))
    lengths = stage(lengths.groupBy("shingle").agg(F.collect_set("length").alias("lengths"), F.count("*").alias("items")), "lengths")
    few = lengths.count() <= BROADCAST
    known, common_to = (F.broadcast(t) if few else t for t in (lengths.select("shingle", "lengths"), lengths.select("shingle", "items")))
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    places = (
        texts.select("doc_id", _hashes(F.col("text")).alias("words"))
        .select("doc_id", F.size("words").alias("n"), F.posexplode(_shingles(F.col("words"), width)).alias("at", "shingle"))
        .join(known, "shingle").select("doc_id", "n", "at", "lengths")
    )
    # A document's matches are fewer than its words, so these lists stay as small as texts.
    found = places.groupBy("doc_id", "n").agg(F.sort_array(F.collect_set(F.struct("at", "lengths"))).alias("hits"))
    starts = found.select("doc_id", "n", "hits", F.posexplode("hits").alias("k", "hit"))
    starts = starts.select("doc_id", "n", "hits.at", "k", F.col("hit.at").alias("p"), F.explode("hit.lengths").alias("length"))
    own = F.greatest(F.least("length", "n") - (width - 1), F.lit(1))
    starts = starts.withColumn("size", F.least("length", "n")).withColumn("start", F.least(F.col("p"), F.greatest(F.col("n") - F.col("length"), F.lit(0))))
    full = F.greatest(F.col("length") - (width - 1), F.lit(1))
    least = F.ceil(F.round((full + own) * similarity / (1 + similarity), 9)).cast("int")
    enough = F.get(F.col("at"), F.col("k") + least - 1) < F.col("start") + own
    windows = stage(starts.where(enough).select("doc_id", "n", "start", "size").distinct(), "windows")
    cuts = windows.groupBy("doc_id", "n").agg(F.collect_set(F.struct("start", "size")).alias("cuts"))
    words = texts.join(cuts.select("doc_id", F.col("n").alias("words_n"), "cuts"), "doc_id")
    words = words.withColumn("words", _hashes(F.col("text"))).where(F.size("words") == F.col("words_n"))
    cut = words.select("doc_id", "words", "words_n", F.explode("cuts").alias("c")).select(
        "doc_id", "words_n", F.col("c.start").alias("start"), F.slice("words", F.col("c.start") + 1, F.col("c.size")).alias("words")
    )
    # Named by content: windows of the same words, in whatever documents, are compared once.
    cut = cut.withColumn("window", F.xxhash64("words"))
    cut = stage(cut.withColumn("size", F.size("words")), "cuts")
    kinds = stage(cut.groupBy("window", "size").agg(F.first("words").alias("words")), "kinds")
    prints = _fingerprints(kinds, ["window", "size"])
    each = radius // _BLOCKS
    # A table of some 700 rows; as a literal, each of its numbers would be a node of every plan made from here on.
    masks = docs.sparkSession.range(1 << 16).where(F.bit_count("id") <= each).select(F.col("id").alias("mask"))
    listed = _fingerprints(items.select("item_id", "words"), ["item_id"]).select("item_id", F.col("print").alias("item_print"), F.explode(_blocks(F.col("print"))).alias("value"))
    # A mask leaves the block's number alone. Three numbers a row: item, fingerprint, block.
    listed = listed.crossJoin(F.broadcast(masks)).select("item_id", "item_print", F.col("value").bitwiseXOR(F.col("mask")).alias("block"))
    probes = prints.select("*", F.explode(_blocks(F.col("print"))).alias("block"))
    apart = F.bit_count(F.col("print").bitwiseXOR(F.col("item_print")))
    # The list is some 2,800 times the rows it is estimated by: unasked, it would be gathered on the driver and broadcast.
    alike_bits = probes.join(listed.hint("merge"), "block").where(apart <= radius).select("window", "size", "item_id")
    # A window is never longer than the item, so common is at least 2s / (1 + s) of the window's shingles and s of the item's.
    tokens = _rarest(kinds, ["window", "size"], width, common_to, lambda n: n * (2 * similarity / (1 + similarity)))
    shared = tokens.join(_rarest(items.select("item_id", "words"), ["item_id"], width, common_to, lambda n: n * similarity), "token")
    pairs = alike_bits.unionByName(shared.select("window", "size", "item_id")).distinct()
    pairs = pairs.join(items.select("item_id", F.size("words").alias("length")), "item_id")
    pairs = stage(pairs.where("size <= length"), "pairs")

    def bag(rows: DataFrame, keys: list[str], count: str) -> DataFrame:
        return rows.select(*keys, F.explode(_shingles(F.col("words"), width)).alias("shingle")).groupBy(*keys, "shingle").agg(F.count("*").alias(count))

    both = pairs.join(bag(kinds, ["window", "size"], "c"), ["window", "size"]).join(bag(items, ["item_id"], "d"), ["item_id", "shingle"])
    total = F.greatest(F.col("size") - (width - 1), F.lit(1)) + F.greatest(F.col("length") - (width - 1), F.lit(1))
    common = both.groupBy("window", "size", "item_id", "length").agg(F.sum(F.least("c", "d")).alias("common"))
    alike = common.withColumn("similarity", F.col("common") / (total - F.col("common"))).where(F.col("similarity") >= similarity)
    # A window shorter than the item counts only as a whole document.
    hits = cut.join(alike, ["window", "size"]).where("size = length OR size = words_n")
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    out = hits.groupBy("doc_id", "item_id").agg(best.alias("best"))
    return out.select("doc_id", "item_id", F.col("best.start").cast("long").alias("start_word"), F.col("best.similarity").alias("similarity"))
