import random

import pytest

from navspark.llm import jaccard
from navspark.llm.components import connected_components


def plain(rows):
    """Sets, links and components by comparing all pairs."""
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for i, text in rows:
        words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", (text or "").translate(table)) if w]
        sets.append((i, {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()))
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets}


def corpus(seed):
    draw = random.Random(seed)
    word = lambda: "w%d" % draw.randrange(3000)
    rows, at = [], 0
    passage = [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(draw.choice([3, 7, 40, 90, 900]))]
        if draw.random() < 0.5:
            base = base + passage
        for _ in range(draw.choice([1, 2, 8])):
            copy = list(base)
            for _ in range(draw.choice([0, 0, 1, 2, 4])):
                copy[draw.randrange(len(copy))] = word()
            rows.append((at, draw.choice([" ", "\n", "\t  "]).join(copy)))
            at += 1
    rows += [(at, None), (at + 1, ""), (at + 2, " \n "), (at + 3, "A B c"), (at + 4, "a b\tC"), (at + 5, "a b c d"), (at + 6, "x " * 3000)]
    return rows


@pytest.mark.parametrize("frequent", [True, False])
def test_against_all_pairs(spark, documents, monkeypatch, frequent):
    if frequent:
        monkeypatch.setattr(jaccard, "_LOCAL", 3)  # many shingles count as common
    rows = corpus(3 + frequent)
    out = jaccard.near_duplicates(documents([(i, t, None, None) for i, t in rows])).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == plain(rows)
    assert len(out) == len(rows)


def test_repeated_and_nameless_rows(documents):
    rows = [(5, "one two three four five six", None, None)] * 2 + [(None, "one two three four five six", None, None), (3, "One two three four five six", None, None)]
    out = sorted(((r["doc_id"], r["component_id"]) for r in jaccard.near_duplicates(documents(rows)).collect()), key=str)
    assert out == [(3, 3), (5, 3), (5, 3), (None, 3)]


def test_sets_meet_only_where_their_first_shared_probe_may_be(spark):
    # 100 sets near one group of 100: every pair shares the ten last probes of 26, and only the last two sets an early one.
    rows = [(k, i, 100, 16 + k, i) for i in range(200) for k in range(10)] + [(50, 198, 100, 14, 198), (50, 199, 100, 3, 199)]
    tiles = spark.createDataFrame(rows, "shingle long, sid long, n int, rank int, root long")
    assert [tuple(r) for r in jaccard._across(tiles, 75).distinct().collect()] == [(198, 199)]


def test_empty_table(documents):
    assert jaccard.near_duplicates(documents([])).collect() == []


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000), (500, 400), (None, 3)]
    out = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert out == {**{i: 0 for i in range(201)}, 500: 400, 400: 400}
