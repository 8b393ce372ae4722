"""Personal data, and the terms that give it away: spans and sanitised text in DataFrame expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.common import small
from navspark.session import stage

#: Share of an entity's information content that a term may not give away.
DISCLOSURE = 1.0
#: Different texts in which a term has to stand beside an entity before it counts as evidence.
SUPPORT = 2
#: Characters on either side of an entity that are its context.
REACH = 200
TERM_LETTERS = 4
TERM = "term"
_PREFIX = 4

# Fixed patterns. Possessive quantifiers and look-behinds change no match; they keep long runs linear and off the stack.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?[0-9]){15,18}(?![ -]?[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
KINDS = [*PATTERNS]


def _possible(text: Column, kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    if kind in ("email", "phone"):
        return F.contains(text, F.lit("@" if kind == "email" else "+"))
    return text.rlike(r"[0-9]\.[0-9]" if kind == "ip" else r"[0-9](?:[ -]?[0-9]){15}")


def _valid() -> Column:
    digits = F.regexp_replace("value", "[^0-9]", "")
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    small_parts = F.forall(F.split("value", r"\."), lambda p: (F.length(part(p)) < 3) | ((F.length(part(p)) == 3) & (part(p) <= "255")))
    return (
        F.when(F.col("kind") == "ip", small_parts)
        .when(F.col("kind") == "card", F.length(digits).between(16, 19) & F.call_function("luhn_check", digits))
        .when(F.col("kind") == "phone", F.length(digits).between(8, 15))
        .otherwise(True)
    )


def _lowered(text: Column) -> Column:
    """A-Z lower-cased; no other letter, so that lengths stay."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _key(text: Column) -> Column:
    """128 bits that stand for a text."""
    return F.struct(F.xxhash64(text).alias("a"), F.xxhash64(F.lit(7), text).alias("b"))


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(_key(text).alias("key"), text.alias("text")).where("text <> ''")


def _pieces(text: Column, pattern: str, kind: str, reach: int) -> Column:
    """What stands between the matches of a pattern, each piece with the match that ends it; the last has none.

    Of a piece its length and its two ends travel on, not the piece.
    """
    def piece(z: Column, i: Column) -> Column:
        return F.struct(
            F.lit(kind).alias("kind"), i.alias("i"), F.length(z["p"]).alias("before"), F.left(z["p"], F.lit(reach)).alias("head"),
            F.right(z["p"], F.lit(reach)).alias("tail"), z["m"].alias("value"),
        )

    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("p"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    return F.transform(zipped, piece)


def _placed(pieces: DataFrame) -> DataFrame:
    """(key, kind, start, end, value, head, tail) of the matches; copies of a text are one from here on.

    A text's matches are numbered by a window over that text; no larger group is ever gathered.
    """
    once = pieces.groupBy("key", "kind", "i").agg(*[F.first(c).alias(c) for c in ("before", "head", "tail", "value")])
    along = Window.partitionBy("key", "kind").orderBy("i")
    upto = F.sum(F.col("before") + F.coalesce(F.length("value"), F.lit(0))).over(along.rowsBetween(Window.unboundedPreceding, 0))
    rows = once.select(
        "key", "kind", "value", "tail", (F.col("before") > F.length("tail")).alias("tail_cut"), upto.alias("end"),
        F.lead("head").over(along).alias("head"), F.lead("before").over(along).alias("after"),
    )
    return rows.where("value IS NOT NULL").select(
        "key", "kind", (F.col("end") - F.length("value")).alias("start"), "end", "value", "tail", "tail_cut", "head",
        (F.col("after") > F.length("head")).alias("head_cut"),
    )


def mentions(docs: DataFrame, text_col: str = "text", reach: int = REACH) -> DataFrame:
    """(key, kind, start, end, value, entity, context) of the personal data in each different text.

    Code points from 0, end exclusive. ``entity`` is the value without its notation, ``context`` the
    whole words within ``reach`` characters, up to the next match of that kind.
    """
    text = F.col("text")
    found = F.concat(*[
        F.when(_possible(text, kind), _pieces(text, pattern, kind, reach)).otherwise(F.array().cast("array<struct<kind:string,i:int,before:int,head:string,tail:string,value:string>>"))
        for kind, pattern in PATTERNS.items()
    ])
    some = _possible(text, KINDS[0])
    for kind in KINDS[1:]:
        some = some | _possible(text, kind)
    pieces = _texts(docs, text_col).where(some).select("key", F.inline(found))
    rows = _placed(pieces).where(_valid())
    letters = r"[\p{L}\p{M}]+"
    tail = F.when(F.col("tail_cut"), F.regexp_replace("tail", f"^{letters}", "")).otherwise(F.col("tail"))
    head = F.when(F.col("head_cut"), F.regexp_replace("head", f"{letters}$", "")).otherwise(F.col("head"))
    plain = F.when(F.col("kind") == "email", _lowered(F.col("value"))).when(F.col("kind") == "ip", F.col("value")).otherwise(F.regexp_replace("value", "[^0-9]", ""))
    return rows.select(
        "key", "kind", "start", "end", "value", F.concat("kind", F.lit(":"), plain).alias("entity"),
        _lowered(F.concat(tail, F.lit(" "), head)).alias("context"),
    )


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(_lowered(text), F.lit(rf"[\p{{L}}\p{{M}}]{{{TERM_LETTERS},}}"), F.lit(0))


def _held(docs: DataFrame, terms: DataFrame, text_col: str) -> DataFrame:
    """(key, term) of every row that holds one of ``terms``."""
    return _texts(docs, text_col).select("key", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(terms, "term")


def disclosures(
    docs: DataFrame, found: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, text_col: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Terms that give an entity away, and (term, key) of the texts that hold them.

    The first has entity, term, together, with_term, with_entity, pmi, ic. Probabilities are shares of the
    rows with a text: with N of them, PMI = log2(N * together / (with_entity * with_term)) and IC = log2(N / with_entity).
    A term is disclosed if PMI >= ``disclosure`` * IC, that is if at least
    (with_entity / N) ** (1 - disclosure) of the rows with the term have it beside the entity; at 1 all of them. A term met beside
    an entity in fewer than ``support`` different texts proves nothing, copies being one, nor does an entity that every row has.
    """
    keys = small(found.select("key").distinct(), "keys")
    rows = docs.select(_key(F.col(text_col).cast("string")).alias("key")).where(F.col(text_col).isNotNull())
    copies = stage(rows.join(keys, "key").groupBy("key").agg(F.count("*").alias("copies")), "copies")
    beside = found.select("key", "entity", F.explode(F.array_distinct(_terms(F.col("context")))).alias("term")).distinct()
    together = beside.join(copies, "key").groupBy("entity", "term").agg(F.count("*").alias("texts"), F.sum("copies").alias("together"))
    together = stage(together.where(F.col("texts") >= support), "together")
    of_entity = found.select("key", "entity").distinct().join(copies, "key").groupBy("entity").agg(F.sum("copies").alias("with_entity"))
    of_term = _held(docs, small(together.select("term").distinct(), "candidates"), text_col).groupBy("term").agg(F.count("*").alias("with_term"))
    counts = together.join(of_entity, "entity").join(of_term, "term").withColumn("n", F.lit(rows.count()))
    share = F.col("together") / F.col("with_term")
    given = counts.where((F.col("with_entity") < F.col("n")) & (share >= F.pow(F.col("with_entity") / F.col("n"), F.lit(1.0 - disclosure))))
    given = stage(
        given.select(
            "entity", "term", "together", "with_term", "with_entity", F.log2(F.col("n") * share / F.col("with_entity")).alias("pmi"),
            F.log2(F.col("n") / F.col("with_entity")).alias("ic"),
        ),
        "disclosed",
    )
    return given, _held(docs, small(given.select("term").distinct(), "given"), text_col).distinct()


def spans(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = SUPPORT, reach: int = REACH, text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, kind, start, end, word) of all spans of each different text, and the disclosed terms.

    Spans of base kinds and of disclosed terms; a term inside a base span adds nothing. ``word`` is the term, null for base spans.
    """
    found = stage(mentions(docs, text_col, reach), "mentions")
    given, held = disclosures(docs, found, disclosure, support, text_col)
    held = stage(held, "held")
    wanted = small(held.select("key").distinct(), "wanted")
    pattern = rf"[\p{{L}}\p{{M}}]{{{TERM_LETTERS},}}"
    words = _texts(docs, text_col).join(wanted, "key").select("key", F.inline(_pieces(_lowered(F.col("text")), pattern, TERM, 0)))
    terms = _placed(words).select("key", "kind", "start", "end", F.col("value").alias("word"))
    terms = terms.join(held.select("key", F.col("term").alias("word")), ["key", "word"]).select("key", "kind", "start", "end", "word")
    base = found.select("key", "kind", "start", "end", F.lit(None).cast("string").alias("word"))
    order = Window.partitionBy("key").orderBy("start", "end")
    own = lambda c: F.when(F.col("kind") != TERM, F.col(c))
    before = F.max(own("end")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    after = F.min(own("start")).over(Window.partitionBy("key").orderBy(F.desc("start"), F.desc("end")).rowsBetween(Window.unboundedPreceding, -1))
    every = base.unionByName(terms).withColumns({"_before": before, "_after": after})
    clear = (F.col("kind") != TERM) | ((F.coalesce("_before", F.lit(0)) <= F.col("start")) & (F.coalesce("_after", F.col("end")) >= F.col("end")))
    return stage(every.where(clear).drop("_before", "_after"), "spans"), given


def _listed(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def private_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans.

    ``spans`` lists kind:start:end of all spans, the base kinds in their order, then the disclosed terms, each by
    start. Null and empty texts have none. Equal texts have equal spans; an id, null or repeated, plays no part. ``options``: disclosure,
    support and reach.
    """
    found, _ = spans(docs, text_col=text_col, **options)
    number = F.array_position(F.array(*map(F.lit, [*KINDS, TERM])), F.col("kind"))
    each = F.sort_array(F.collect_list(F.struct(number.alias("number"), "start", "end", "kind"))).alias("each")
    lists = stage(found.groupBy("key").agg(each), "lists")
    base = F.filter("each", lambda s: s["kind"] != TERM)

    def counted(kind: str) -> Column:
        return F.size(F.filter("each", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    lists = lists.select("key", *map(counted, KINDS), F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("each")).alias("spans"))
    lists = small(lists, "lines")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), _key(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("key"))
    none = {f"n_{kind}": F.lit(0) for kind in KINDS} | {"base_sha256": F.sha2(F.lit(""), 256), "spans": F.lit("")}
    joined = rows.join(lists, "key", "left")
    return joined.select("doc_id", *[F.coalesce(c, x.cast("long") if c.startswith("n_") else x).alias(c) for c, x in none.items()])


def sanitised(docs: DataFrame, text_col: str = "text", **options) -> DataFrame:
    """``docs`` with personal data replaced by its kind in brackets, and disclosed terms generalised or removed.

    A term is generalised to its first letters and an ellipsis if, taken together, the words that begin with them no longer
    give the entity away (words of at least twice as many texts as rows have the term); else it is removed. A null text stays null. Row order and all other columns stay.
    """
    found, given = spans(docs, text_col=text_col, **options)
    first = F.concat(F.substring("term", 1, _PREFIX), F.lit("…"))
    terms = given.groupBy("term").agg(F.max("with_term").alias("with_term")).withColumn("first", first)
    starts = small(terms.select("first").distinct(), "starts")
    begins = F.array_distinct(F.transform(_terms(F.col("text")), lambda w: F.concat(F.substring(w, 1, _PREFIX), F.lit("…"))))
    # Counted by sketch: the only thing that hangs on it is how much of a term stays.
    counts = _texts(docs, text_col).select("key", F.explode(begins).alias("first")).join(starts, "first")
    counts = counts.groupBy("first").agg(F.approx_count_distinct("key").alias("with_first"))
    general = terms.join(counts, "first").where(F.col("with_first") >= 2 * F.col("with_term")).select(F.col("term").alias("word"), "first")
    shown = F.when(F.col("kind") == TERM, F.coalesce("first", F.lit(""))).otherwise(F.concat(F.lit("["), F.upper("kind"), F.lit("]")))
    # Of overlapping base spans the later one is cut to what the earlier ones leave.
    upto = F.coalesce(F.max("end").over(Window.partitionBy("key").orderBy("start", "end", "kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = found.join(general, "word", "left").select("key", F.greatest("start", upto).alias("start"), F.greatest("end", upto).alias("end"), shown.alias("shown"), (F.col("end") <= upto).alias("inside"))
    cuts = cuts.where("NOT inside").groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "end", "shown"))).alias("cuts"))
    key = _key(F.coalesce(F.col(f"row.{text_col}").cast("string"), F.lit("")))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("key", key)
    joined = rows.join(small(cuts, "cuts"), "key", "left")
    letters = F.split(F.col(f"row.{text_col}"), "")

    def kept(i: Column, c: Column) -> Column:
        left = F.when(i == 0, 0).otherwise(F.get(F.col("ends"), i - 1))
        return F.concat(F.array_join(F.slice("letters", left + 1, c["start"] - left), ""), c["shown"])

    changed = joined.where("cuts IS NOT NULL").select("row", "cuts", F.col("cuts.end").alias("ends"), letters.alias("letters"))
    rest = F.array_join(F.slice("letters", F.element_at("ends", -1) + 1, F.greatest(F.size("letters") - F.element_at("ends", -1), F.lit(0))), "")
    text = F.concat(F.array_join(F.transform("cuts", lambda c, i: kept(i, c)), ""), rest)
    changed = changed.select(F.col("row").withField(text_col, text).alias("row"))
    return changed.unionByName(joined.where("cuts IS NULL").select("row")).select("row.*")
