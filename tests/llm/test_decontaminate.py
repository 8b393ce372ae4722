import random

from navspark.llm.decontaminate import _fingerprints, contaminated


def plain(docs, items):
    """Best similarity of any window of any item's length, by trying them all."""
    from collections import Counter

    runs = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))
    out = {}
    for d, text in docs:
        words = (text or "").lower().split()
        for i, item in items:
            other = (item or "").lower().split()
            if not words or not other or (len(other) < 5 and len(words) != len(other)):
                continue
            n, b = min(len(other), len(words)), runs(other)
            for at in range(len(words) - n + 1):
                a = runs(words[at : at + n])
                common = (a & b).total()
                s = common / (a.total() + b.total() - common)
                if s >= 0.75:
                    out[d, i] = max(s, out.get((d, i), 0))
    return out


def test_against_all_windows(spark, documents):
    draw = random.Random(8)
    some = lambda n: ["w%d" % draw.randrange(5000) for _ in range(n)]
    items = [(i, some(draw.choice([2, 4, 5, 12, 30, 45]))) for i in range(25)]
    items += [(25, items[3][1]), (26, ["a", "b", "c", "d", "e", "f"] * 6)]
    docs = []
    for d in range(60):
        words = some(draw.choice([0, 3, 20, 150]))
        if d % 2:
            part = list(draw.choice(items)[1])
            if d % 4 == 1 and len(part) > 5:
                part[draw.choice([0, -1, len(part) // 2])] = "other"
            at = draw.choice([0, len(words) // 2, len(words)])
            words = words[:at] + part + words[at:]
        docs.append((d, " ".join(words).title()))
    docs += [(100, None), (101, ""), (102, " "), (103, " ".join(items[10][1])), (104, " ".join(items[12][1][:-1]))]
    benchmark = [(i, " ".join(w)) for i, w in items] + [(90, None), (91, ""), (None, "x y z")]
    frame = spark.createDataFrame(benchmark, "item_id long, text string")
    out = contaminated(documents([(d, t, None, None) for d, t in docs]), frame).collect()
    found = {(r["doc_id"], r["item_id"]): r["similarity"] for r in out}
    assert found == plain(docs, benchmark[:-1])
    assert len(found) == len(out) > 20
    # Repeated documents change nothing.
    twice = documents([(d, t, None, None) for d, t in docs[:10] * 2])
    assert {(r["doc_id"], r["item_id"]) for r in contaminated(twice, frame).collect()} == {k for k in found if k[0] < 10}


def test_ends_cut_down_to_the_similarity(spark, documents):
    draw = random.Random(5)
    items = [(i, " ".join("v%d" % draw.randrange(10**9) for _ in range(draw.randrange(80, 201)))) for i in range(300)]
    docs, expected = [], {}
    for i, item in items:
        words = item.split()
        runs = len(words) - 4
        # The largest cut at one end that leaves 0.75, filled up with other words; at the start, the middle or the end of the document.
        cut = max(c for c in range(runs) if 4 * (runs - c) >= 3 * (runs + c))
        other = ["o%d" % draw.randrange(10**9) for _ in range(cut)]
        part = other + words[cut:] if i % 2 else words[:-cut] + other
        text = " ".join((["x", "y"] if i % 3 == 1 else []) + part + (["z"] if i % 3 == 2 else []))
        docs.append((i, text))
        expected |= plain([(i, text)], [(i, item)])
    assert len(expected) == 300
    frame = spark.createDataFrame(items, "item_id long, text string")
    found = contaminated(documents([(d, t, None, None) for d, t in docs]), frame).collect()
    assert {(r["doc_id"], r["item_id"]): r["similarity"] for r in found} == expected


def test_empty_tables(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert contaminated(documents([(1, "a b c d e f", None, None)]), none).collect() == []
    assert contaminated(documents([]), one).collect() == []


def test_the_list_of_items_is_not_gathered_on_the_driver(spark, monkeypatch):
    from navspark.llm import decontaminate

    plans, kept = {}, decontaminate.stage

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().sparkPlan().toString()
        return kept(df, name)

    monkeypatch.setattr(decontaminate, "stage", noted)
    words = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {words} b"), (2, "none of it")], "doc_id long, text string")
    items = spark.createDataFrame([(7, words)], "item_id long, text string")
    assert [(r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.contaminated(docs, items).collect()] == [(1, 7, 1)]
    assert [line for line in plans["pairs"].splitlines() if "SortMergeJoin [block" in line]
    assert not [line for line in plans["pairs"].splitlines() if "BroadcastHashJoin [block" in line]


def test_fingerprints_are_majorities_and_their_plan_is_short(spark):
    rows = [(1, [5, -7, 3]), (2, [-1]), (3, [2**62 + 11, 9, 9, -(2**63)])]
    found = _fingerprints(spark.createDataFrame(rows, "k long, words array<long>"), ["k"])
    for r in found.collect():
        words = dict(rows)[r["k"]]
        bits = [sum(w >> b & 1 for w in words) * 2 > len(words) for b in range(64)]
        assert r["print"] & (2**64 - 1) == sum(1 << b for b, on in enumerate(bits) if on)
    # The driver holds such plans, and analyses them anew for every step built on them.
    assert len(found._jdf.queryExecution().analyzed().toString()) < 4000
