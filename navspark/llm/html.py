"""Main text of web pages: page structure first, then differencing with the nearest page of the host."""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from navspark.llm.common import small
from navspark.session import stage

OPENING = re.compile(r"<!--|<(/?)([A-Za-z][^\s/><]*)|<[!?]")
ENDING = re.compile("[>\"']")
LABEL = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: Content that is never read as markup.
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
#: Parts of a page that are not its main text.
ASIDE = frozenset("head nav header footer aside form button select menu dialog svg canvas object template".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr".split()
)
MAIN = frozenset("article main".split())
#: Words in a class, id or role that mark such parts.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement banner sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs "
    "header masthead footer sidebar aside widget related recommended share sharing social cookie cookies consent notice notices alert "
    "popup modal overlay newsletter subscribe subscription signup login search comment comments discussion reply replies disqus pagination "
    "pager complementary contentinfo toolbar skip copyright".split()
)
WHITE = re.compile(r"\s+")


def _marked(attributes: str) -> bool:
    for found in LABEL.finditer(attributes):
        value = (found[1] or found[2] or found[3] or "").lower()
        if any(word in MARKS for word in re.split(r"[^a-z0-9]+", value)):
            return True
    return False


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of quotes and closing brackets, and where a tag ends whose attributes begin before each: -1 if nowhere.

    A bracket inside quotes ends nothing, and a quote that is not closed leaves the tag open. Found from the back, so each
    place is looked at once however many tags are left open.
    """
    places = [m.start() for m in ENDING.finditer(page)]
    ends = [-1] * (len(places) + 1)
    following = {'"': -1, "'": -1}
    for i in range(len(places) - 1, -1, -1):
        mark = page[places[i]]
        if mark == ">":
            ends[i] = places[i]
        else:
            other = following[mark]
            ends[i] = ends[other + 1] if other >= 0 else -1
            following[mark] = i
    return places, ends


def tokens(page: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, "/" or nothing, name, attributes) of every tag; comments and declarations have no name. What never ends is text.

    The receiver may send the place to go on from.
    """
    places, ends = _tag_ends(page)
    last, at = page.rfind(">"), 0
    while found := OPENING.search(page, at):
        start, end = found.start(), -1
        if found[0] == "<!--":
            end = page.find("-->", found.end())
            end = len(page) if end < 0 else end + 3
        elif found[2]:
            end = ends[bisect_left(places, found.end())] + 1
        elif found.end() <= last:
            end = page.find(">", found.end()) + 1
        if end <= 0:
            at = found.end()
            continue
        at = end
        moved = yield start, end, found[1] or "", (found[2] or "").lower(), page[found.end() : end - 1] if found[2] else ""
        if moved is not None:
            at = moved


def page_blocks(page: str | None) -> list[tuple[str, bool, bool]]:
    """The page's text blocks in order, whether each lies in an article or main element, and whether its element or label leaves it out.

    Tags are matched leniently: an end tag closes what is open inside it, one without
    a start is ignored, what is not closed lasts to the end. Time grows with the page's length, broken or not.
    """
    blocks: list[tuple[str, bool, bool]] = []
    pieces: list[str] = []
    left: list[str] = []
    open_: list[tuple[str, bool, bool]] = []  # tag, leaves out, is main
    names: Counter = Counter()
    out = inside = at = 0

    def close(texts: list[str]) -> None:
        text = WHITE.sub(" ", entities.unescape("".join(texts))).strip()
        if text:
            blocks.append((text, inside > 0, texts is left))
        texts.clear()

    page = page or ""
    found = tokens(page)
    moved = None
    while True:
        try:
            token = found.send(moved)
        except StopIteration:
            break
        start, end, ending, tag, attributes = token
        moved = None
        if start > at:
            (left if out else pieces).append(page[at:start])
        at = end
        if not tag:
            continue
        if tag not in INLINE:
            close(left if out else pieces)
        if ending:
            # Only what is open is looked for, so the search ends with what it removes.
            while names[tag]:
                name, left_out, main = open_.pop()
                names[name] -= 1
                out -= left_out
                if left_out and not out:
                    close(left)
                inside -= main
                if name == tag:
                    break
        elif tag in RAW:
            last = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = moved = last.end() if last else len(page)
        elif tag not in VOID and not attributes.endswith("/"):
            left_out = (tag in ASIDE or _marked(attributes)) and tag not in ("body", "html", "main")
            left_out = left_out and not (tag == "header" and inside)
            main = not left_out and (tag in MAIN or "role=\"main\"" in attributes)
            open_.append((tag, left_out, main))
            names[tag] += 1
            out += left_out
            inside += main
    if at < len(page):
        (left if out else pieces).append(page[at:])
    close(left)
    close(pieces)
    return blocks


def page_lines(page: str | None) -> list[tuple[str, bool]]:
    """The blocks that are not left out, and whether each lies in an article or main element."""
    return [(text, inside) for text, inside, left in page_blocks(page) if not left]


def common_lines(left: list, right: list) -> set[int]:
    """Places in ``left`` of a longest common subsequence with ``right``, by growing chains of matches."""
    head = 0
    while head < min(len(left), len(right)) and left[head] == right[head]:
        head += 1
    where: dict = {}
    for j in range(len(right) - 1, head - 1, -1):
        where.setdefault(right[j], []).append(j)
    ends: list[int] = []
    chain: list[tuple[int, tuple | None]] = []
    for i in range(head, len(left)):
        for j in where.get(left[i], ()):
            k = bisect_left(ends, j)
            link = (i, chain[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                chain.append(link)
            else:
                ends[k], chain[k] = j, link
    found, link = set(range(head)), chain[-1] if chain else None
    while link:
        found.add(link[0])
        link = link[1]
    return found


def boilerplate(own: list, other: list, chars: dict) -> tuple[list[int], list[bool], bool]:
    """Places of ``own`` shared with ``other``, which of them the two pages alone prove to be boilerplate, and whether the pages are no copies.

    Pages are no copies if what they share is at most three quarters of the shorter one's characters (``chars`` has the
    length of each line). Of such pages the shared lines that both begin or end with are proved; of any, a line that
    the two repeat a different number of times.
    """
    places = sorted(common_lines(own, other))
    shorter = min(sum(chars[x] for x in own), sum(chars[x] for x in other))
    apart = 4 * sum(chars[own[i]] for i in places) <= 3 * shorter
    head = tail = 0
    most = min(len(own), len(other))
    while head < most and own[head] == other[head]:
        head += 1
    while tail < most and own[-1 - tail] == other[-1 - tail]:
        tail += 1
    times, also = Counter(own), Counter(other)
    edge = [apart and (i < head or i >= len(own) - tail) for i in places]
    return places, [e or times[own[i]] != also[own[i]] for e, i in zip(edge, places, strict=True)], apart


def _neighbours(pages: DataFrame) -> DataFrame:
    """Each page's nearest page of its host: of the two beside it in path order, the one whose path agrees longer.

    Pages are ordered by range, so a host of any size lies over many tasks; the rows at
    the edges of the ranges, two for each, are compared apart.
    """
    columns = ["host", "path", "row"]
    schema = pa.schema([(c, pa.string()) for c in ("host", "path", "row", "path_before", "before", "path_after", "after", "edge")])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        older, last, start = None, None, True
        for batch in batches:
            out = []
            for now in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if last is not None:
                    out.append(beside(older, last, now, "first" if start else None))
                    start = False
                older, last = last, now
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*out, strict=True)], schema=schema)
        if last is not None:
            edge = "both" if start else "last"
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.string()) for c in beside(older, last, None, edge)], schema=schema)

    def beside(older: tuple | None, own: tuple, newer: tuple | None, edge: str | None) -> tuple:
        before = older[1:] if older and older[0] == own[0] else (None, None)
        after = newer[1:] if newer and newer[0] == own[0] else (None, None)
        return (*own, *before, *after, edge)

    dealt = pages.select(*columns).repartitionByRange(*columns).sortWithinPartitions(*columns)
    near = stage(dealt.mapInArrow(look, ", ".join(f"{f.name} string" for f in schema)), "beside")
    order = Window.orderBy(*columns)
    edges = near.where("edge IS NOT NULL")
    for name, step in (("before", F.lag), ("after", F.lead)):
        side = step(F.struct("host", "path", "row")).over(order)
        same = side["host"].eqNullSafe(F.col("host"))
        edges = edges.withColumn(f"_{name}", F.when(same, side))
    for name in ("before", "after"):
        edges = edges.withColumn(f"path_{name}", F.coalesce(f"path_{name}", f"_{name}.path")).withColumn(name, F.coalesce(name, f"_{name}.row"))
    whole = near.where("edge IS NULL").unionByName(edges.select(*near.columns))
    shared = F.pandas_udf(_agreement, "int")
    longer = shared("path", "path_after") > shared("path", "path_before")
    nearest = F.when(F.col("before").isNull() | (F.col("after").isNotNull() & longer), F.col("after")).otherwise(F.col("before"))
    return whole.select("row", nearest.alias("partner")).where("partner IS NOT NULL")


def _agreement(left: pd.Series, right: pd.Series) -> pd.Series:
    def length(x: str, y: str | None) -> int:
        n = 0
        for a, b in zip(x, y or "", strict=False):
            if a != b:
                break
            n += 1
        return n

    return pd.Series([length(x, y) for x, y in zip(left, right, strict=True)], dtype="int32")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per row of ``pages``: page_id, url, text, n_chars.

    Menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts and styles are left out
    by their element or label. Pages of a host are paired by URL path with the nearest other page, and every page is aligned
    with that one by longest common subsequence. A page that has an article or main element is reduced to it: all its blocks
    are aligned, those left out as well, and a shared line in the element is deleted if its host shows it to be a menu line or
    the like, left out on three and more different pages and on more than half of them. Other shared lines stay: articles and passages
    are copied between pages, and still main text. Of a page without such an element the
    lines not left out are aligned. A shared one is deleted only as boilerplate: ``boilerplate`` proves it, or it is on three
    and more different pages of the host and on more than half of them. If the two pages are copies of each other, it
    must besides be on twice as many pages as the rarest line they share. What stays undecided is kept,
    so copies among few pages keep their menus. Blocks are joined by a space in page order.
    Null and empty html give ''. A null URL belongs to the host ''; a page alone on its host loses
    nothing. Repeated rows are one page when pairing and all come back.
    """
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://", "")
    named = pages.select(
        F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"),
        F.lower(F.regexp_extract(rest, r"^([^/?#]*)", 1)).alias("host"),
        F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1).alias("path"),
        F.md5(F.concat_ws("\x00", F.col(id_col).cast("string"), url, F.md5(F.coalesce(F.col(html_col), F.lit("")).cast("binary"))).cast("binary")).alias("row"),
    )

    def outline(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks, open_, sizes, whole, main, aside = [], [], [], [], [], []
            for page in batch.column(3).to_pylist():
                blocks = [(xxhash.xxh3_64_intdigest(t) - (1 << 63), len(t), inside, left) for t, inside, left in page_blocks(page)]
                kept = [x for x in blocks if not x[3]]
                marks.append([x[0] for x in kept])
                open_.append(not any(x[2] for x in kept))
                sizes.append([x[1] for x in kept])
                whole.append([x[0] for x in blocks])
                main.append([x[2] and not x[3] for x in blocks])
                aside.append(sorted({x[0] for x in blocks if x[3]}))
            hashes, flags = pa.list_(pa.int64()), pa.list_(pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [
                    *batch.columns[:3], pa.array(marks, hashes), pa.array(open_), pa.array(sizes, pa.list_(pa.int32())),
                    pa.array(whole, hashes), pa.array(main, flags), pa.array(aside, hashes),
                ],
                ["host", "path", "row", "lines", "open", "sizes", "blocks", "main", "aside"],
            )

    columns = "host string, path string, row string, lines array<long>, open boolean, sizes array<int>, blocks array<long>, main array<boolean>, aside array<long>"
    outlines = named.select("host", "path", "row", "html").mapInArrow(outline, columns)
    outlines = stage(outlines.dropDuplicates(["row"]), "outlines")
    pairs = _neighbours(outlines)
    left = outlines.select("row", "host", "open", "main", F.when(F.col("open"), F.col("lines")).otherwise(F.col("blocks")).alias("own"), F.col("sizes").alias("own_sizes"))
    right = outlines.select(F.col("row").alias("partner"), "lines", "blocks", F.col("sizes").alias("other_sizes"))

    @F.pandas_udf("places array<int>, proved array<boolean>, apart boolean")
    def compared(open_: pd.Series, main: pd.Series, own: pd.Series, own_sizes: pd.Series, other: pd.Series, other_sizes: pd.Series) -> pd.DataFrame:
        out = []
        for o, m, a, p, b, q in zip(open_, main, own, own_sizes, other, other_sizes, strict=True):
            a, b = list(a), list(b)
            if o:
                out.append(boilerplate(a, b, dict(zip(a, p, strict=True)) | dict(zip(b, q, strict=True))))
            else:
                places = [i for i in sorted(common_lines(a, b)) if m[i]]
                out.append((places, [False] * len(places), False))
        return pd.DataFrame(out, columns=["places", "proved", "apart"])

    other = F.when(F.col("open"), F.col("lines")).otherwise(F.col("blocks"))
    both = pairs.join(left, "row").join(right, "partner").withColumn("c", compared("open", "main", "own", "own_sizes", other, "other_sizes"))
    both = stage(both.select("row", "host", "own", "open", "c.*").where("size(places) > 0"), "compared")
    lines = both.select("row", "host", "own", "open", "apart", F.explode(F.arrays_zip("places", "proved")).alias("p"))
    lines = lines.select("row", "host", "open", "apart", "p.*", F.get("own", F.col("p.places")).alias("line"))
    # Pages of the same lines count once: a mirror proves nothing.
    asked = small(lines.select("host", "line").distinct(), "asked")
    different = outlines.select("host", F.xxhash64("lines").alias("_text"), "lines").dropDuplicates(["host", "_text"])
    different = different.join(small(both.select("host").distinct(), "hosts"), "host", "left_semi")
    pages_of = different.groupBy("host").agg(F.count("*").alias("pages"))
    on = different.select("host", F.explode(F.array_distinct("lines")).alias("line")).join(asked, ["host", "line"], "left_semi")
    on = on.groupBy("host", "line").agg(F.count("*").alias("times")).join(pages_of, "host")
    marked = outlines.select("host", F.xxhash64("lines").alias("_text"), F.explode("aside").alias("line")).join(asked, ["host", "line"], "left_semi")
    marked = marked.groupBy("host", "line").agg(F.count_distinct("_text").alias("marked"))
    on = on.join(marked, ["host", "line"], "left")
    told = lines.join(small(on, "on"), ["host", "line"])
    rarest = told.groupBy("row").agg(F.min("times").alias("rarest"))
    wide = (F.col("times") >= 3) & (2 * F.col("times") > F.col("pages")) & (F.col("apart") | (F.col("times") >= 2 * F.col("rarest")))
    menu = (F.col("marked") >= 3) & (2 * F.col("marked") > F.col("pages"))
    gone = told.join(rarest, "row").where(F.when(F.col("open"), F.col("proved") | wide).otherwise(menu)).groupBy("row").agg(F.collect_list("places").alias("gone"))
    gone = stage(gone, "gone")

    @F.pandas_udf("string")
    def text(pages: pd.Series, gone: pd.Series) -> pd.Series:
        out = []
        for page, places in zip(pages, gone, strict=True):
            cut = set() if places is None else set(places)
            blocks = page_blocks(page)
            if any(inside and not left for _, inside, left in blocks):
                kept = [t for i, (t, inside, left) in enumerate(blocks) if inside and not left and i not in cut]
            else:
                kept = [t for i, (t, _, _) in enumerate(b for b in blocks if not b[2]) if i not in cut]
            out.append(" ".join(kept))
        return pd.Series(out)

    final = named.select("page_id", "url", "html", "row").join(gone, "row", "left").select("page_id", "url", text("html", "gone").alias("text"))
    return final.withColumn("n_chars", F.length("text").cast("long"))
