import random

from navspark.llm.html import common_lines, main_text, page_blocks, page_lines

SCHEMA = "page_id long, url string, html string, text string, host string, row string"


def texts(spark, rows):
    frame = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], SCHEMA)
    return main_text(frame).collect()


def test_blocks_and_what_is_left_out():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="page"><nav><a>Menu</a></nav>
    <div class="top-ad">Buy</div><script>var t="</p>";</script><!-- <p>no</p> --><p>Fish &amp; chips&nbsp;<b>n</b>ow<br>here<p>5 &lt; 6 &am
    <ul><li>one<li>two</ul><form>Name</form><section id=comments><p>First!</p></section><footer>End</footer></body></html>"""
    assert page_lines(page) == [(t, False) for t in ("Fish & chips now", "here", "5 < 6 &am", "one", "two")]
    assert page_lines("<nav>never closed <p>all gone") == []
    assert page_lines("plain text") == [("plain text", False)]
    assert page_lines(None) == page_lines("") == []
    assert page_lines("<article><header><h1>A</h1></header>b</article>c") == [("A", True), ("b", True), ("c", False)]


def test_common_subsequence():
    draw = random.Random(1)
    for _ in range(300):
        a, b = ([draw.choice("abcd") for _ in range(draw.randrange(9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        places = sorted(common_lines(a, b))
        assert len(places) == best[-1][-1]
        rest = iter(b)
        assert all(a[i] in rest for i in places)


def test_shared_lines_go_between_neighbours(spark):
    def page(*lines):
        return "".join(f"<p>{x}</p>" for x in lines)

    rows = [
        (1, "http://h.org/a/1", page("Top", "one", "Bottom")), (2, "http://h.org/a/2", page("Top", "two", "x", "Bottom")),
        (3, "http://h.org/b/1", page("Other", "three")), (4, "http://h.org/b/2?q=1", page("Other", "four", "Bottom")),
        (5, "http://lone.org/", page("Top", "five")), (6, "http://m.org/1", "<article>" + page("same") + "</article>" + page("Top")),
        (7, "http://m.org/2", "<article>" + page("same") + "</article>"), (8, None, None), (9, "http://h.org/c", ""),
        (5, "http://lone.org/", page("Top", "five")),
    ]
    out = texts(spark, rows)
    assert len(out) == len(rows)
    found = {r["page_id"]: r["text"] for r in out}
    assert found == {1: "one", 2: "two x", 3: "three", 4: "four Bottom", 5: "Top five", 6: "same", 7: "same", 8: "", 9: ""}
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert {r["url"] for r in out if r["page_id"] == 8} == {None}


def test_copies_without_an_article_keep_their_text(spark):
    def page(*lines):
        return "".join(f"<p>{x}</p>" for x in lines)

    body = [f"Paragraph {i} of a text that is long enough to be more than the menus are." for i in range(4)]
    rows = [
        (1, "http://two.org/a", page(*body)), (2, "http://two.org/a?page=2", page(*body)),
        (3, "http://print.org/a", page("Menu", *body, "End")), (4, "http://print.org/a/print", page(*body, "Printed")),
        (5, "http://quote.org/1", page("Top", "own one", body[0], "own two", "x" * 90)),
        (6, "http://quote.org/2", page("Top", "else", body[0], "y" * 90, "more")),
        (7, "http://part.org/a", page(body[0])), (8, "http://part.org/b", page(*body)),
    ]
    # A host of many pages tells menus from a text that two of them have, also for these two.
    rows += [(10 + i, f"http://big.org/{i}", page("Menu", f"text {i} " * 9, "Also read", f"note {i} " * 9)) for i in range(6)]
    rows += [(20 + i, f"http://big.org/z{i}", page("Menu", *body, "Also read")) for i in range(2)]
    found = {r["page_id"]: r["text"] for r in texts(spark, rows)}
    whole = " ".join(body)
    assert found[1] == found[2] == whole
    assert found[3] == f"Menu {whole} End" and found[4] == f"{whole} Printed"
    assert found[5] == f"own one {body[0]} own two {'x' * 90}" and found[6] == f"else {body[0]} {'y' * 90} more"
    assert found[7] == body[0] and found[8] == whole
    assert all(found[10 + i] == f"{('text %d ' % i * 9).strip()} {('note %d ' % i * 9).strip()}" for i in range(6))
    assert found[20] == found[21] == whole


def test_long_page_and_empty_table(spark):
    long_ = "<p>" + "word " * 100_000 + "</p>" + "<p>x</p>" * 5000
    out = texts(spark, [(1, "http://h.org/1", long_), (2, "http://h.org/2", "<p>x</p>")])
    assert {r["page_id"]: r["n_chars"] for r in out} == {1: 499_999 + 2 * 4999, 2: 0}
    assert texts(spark, []) == []


def test_broken_pages_take_time_in_proportion():
    import time

    for page in ("<a " * 350_000, '<a "x ' * 180_000 + ">", "<div>" * 60_000 + "</p>" * 150_000, "<!x " * 250_000, "<a<b" * 250_000 + ' " >', "<p>x" * 250_000):
        started = time.process_time()
        page_lines(page)
        assert time.process_time() - started < 8, page[:20]


def test_quotes_hide_brackets():
    assert page_lines('<p title="a > b">one</p><p title=\'"\'>two</p>') == [("one", False), ("two", False)]
    assert page_lines('before <p title="never closed>after') == [('before <p title="never closed>after', False)]
    assert page_lines("a < b <c d") == [("a < b <c d", False)]


def test_pages_with_an_article_are_aligned_too(spark):
    def page(article, rest="<footer>Follow us</footer>"):
        return f"<nav><p>Start</p></nav><article>{''.join(f'<p>{x}</p>' for x in article)}</article>{rest}"

    rows = [(i, f"http://h.org/a/{i}", page(["Passage", f"text {i}", "Ending"])) for i in range(4)]
    rows += [(4, "http://h.org/a/4", page(["Passage", "text 4", "Start", "Ending", "Follow us"], ""))]
    # Too few pages show what is a menu line here, and a copied article is no menu.
    rows += [(5, "http://few.org/1", page(["Copied", "Follow us"])), (6, "http://few.org/2", page(["Copied", "Follow us"]))]
    found = {r["page_id"]: r["text"] for r in texts(spark, rows)}
    assert found == {**{i: f"Passage text {i} Ending" for i in range(4)}, 4: "Passage text 4 Start Ending", 5: "Copied Follow us", 6: "Copied Follow us"}


def test_blocks_that_are_left_out_keep_their_places():
    page = "<nav>Menu<ul><li>one</ul></nav><article>a <span class=ad>buy</span> b<aside>also</aside></article>end"
    assert page_blocks(page) == [("Menu", False, True), ("one", False, True), ("buy", True, True), ("a b", True, False), ("also", True, True), ("end", False, False)]
