import math
import random
import re
from collections import Counter

import numpy as np

from navspark.llm.fptree import Tree, ranked_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain(docs, items, ranks=20):
    """Every document scored for every item, term by term."""
    counted = [(d, Counter(terms(t))) for d, t in docs]
    counted = [(d, c) for d, c in counted if c]
    every = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        scored = []
        for d, c in counted:
            m = 75 + 25 * sum(c.values()) * len(counted) // every
            score = sum(
                math.floor(1000 * math.log((2 * len(counted) + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                for t in terms(text) if c[t]
            )
            if score > 0 and d is not None:
                scored.append((-score, d))
        out += [(item, rank, d, -s) for rank, (s, d) in enumerate(sorted(scored)[:ranks], 1)]
    return sorted(out, key=str)


def found(spark, documents, docs, items, **options):
    frame = documents([(d, t, "en", "s") for d, t in docs]).repartition(3)
    asked = spark.createDataFrame([(*i, "x", 1) for i in items], "item_id long, text string, rank string, score int")
    return sorted((tuple(r) for r in ranked_documents(frame, asked, **options).collect()), key=str)


def corpus(n, seed=9):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["Straße", "été", "हिन्दी", "ÄÖ", "a1b2"]
    share = [1 / (i + 1) for i in range(len(words))]
    texts = [" ".join(draw.choices(words, share, k=draw.choice([0, 1, 3, 30, 200]))) for _ in range(n)]
    return list(enumerate(texts)), words


def test_equals_plain_ranking(spark, documents):
    docs, words = corpus(900)
    docs += [(2000 + i, "W1 w2, w50; w51 été") for i in range(300)]  # many copies, all of them ties
    docs += [(3000, None), (3001, ""), (3002, " .,;"), (3003, "w1 " * 30_000), (7, "w59 w58"), (7, "w59 w58"), (None, "w59 w58 w57")]
    items = [(1, "w50 w51 w51"), (2, "été STRASSE Straße"), (3, "w0 w1 w2 w3"), (4, None), (5, ""), (6, "unheard of"), (1, "w50 w51 w51"), (1, "w9 a1b2")]
    items += [(100 + i, " ".join(random.Random(i).choices(words, k=12))) for i in range(12)]
    truth = plain(docs, items)
    assert found(spark, documents, docs, items) == truth
    # In several blocks of items the ranking is the same.
    assert found(spark, documents, docs, items, item_chars=100) == truth


def test_empty_tables(spark, documents):
    assert found(spark, documents, [], [(1, "a")]) == []
    assert found(spark, documents, [(1, "a")], []) == []
    assert found(spark, documents, [(1, None)], [(1, "a b")]) == []
    assert found(spark, documents, [(1, "a b")], [(1, None)]) == []


def test_tree_bounds_and_pruning():
    draw = np.random.default_rng(2)
    vectors = [np.unique(draw.geometric(0.05, size=draw.integers(1, 30)) % 80) for _ in range(1500)]
    starts = np.concatenate(([0], np.cumsum([len(v) for v in vectors])))
    tfs = draw.integers(1, 6, starts[-1])
    m = draw.integers(75, 200, len(vectors))
    tree = Tree(np.arange(1500), m, starts, np.concatenate(vectors), tfs, 80)
    leaves = [n for n in range(len(tree.spans)) if not tree.children[n]]
    assert sorted(i for n in leaves for i in range(*tree.spans[n])) == list(range(1500))
    for node, (low, high) in enumerate(tree.spans):
        own = slice(tree.starts[low], tree.starts[high])
        assert tree.m_least[node] == tree.m[low:high].min()
        for t in np.unique(tree.terms[own]):
            assert tree.tf_most[node, t] == tree.tfs[own][tree.terms[own] == t].max()
    read = []
    rows, spans = tree.starts, tree.spans

    class Watched(list):
        def __getitem__(self, node):
            read.append(node)
            return spans[node]

    tree.spans = Watched(spans)
    wanted, worth = np.array([40, 60, 70, 75]), np.array([5000, 6000, 7000, 8000])
    scores, ids = tree.search(wanted, worth, (np.zeros(0, np.int64), np.zeros(0, np.int64)), 5)
    assert len(read) < 0.7 * len(leaves)
    all_scores = [sum(int(worth[wanted == t][0]) * int(g) for t, g in zip(tree.terms[a:b], tree.gains[a:b], strict=True) if t in wanted) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    best = sorted(zip((-s for s in all_scores), tree.ids.tolist(), strict=True))[:5]
    assert [(-int(s), int(i)) for s, i in zip(scores, ids, strict=True)] == best
