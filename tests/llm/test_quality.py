import random

import numpy as np
import pytest

from navspark.llm.quality import Attention, learn, passages, score


def rows(n, seed):
    draw = random.Random(seed)
    out = []
    for i in range(n):
        good = draw.random() < 0.7
        words = ["".join(draw.choice("abcdefgh") for _ in range(draw.randrange(1, 9))) for _ in range(draw.choice([20, 150, 400]))]
        if not good:  # one bad passage among good ones
            at = draw.randrange(len(words))
            words[at : at + 30] = ["%$#" + w for w in words[at : at + 30]] + ["again"] * 30
        out.append((i, " ".join(words), int(good)))
    return out


def test_learns_which_passage_matters(spark, documents):
    train, test = rows(600, 1), rows(200, 2)
    labels = spark.createDataFrame([(i, q) for i, _, q in train] + [(5, None), (None, 1), (7, 9)], "doc_id long, quality int")
    model = learn(documents([(i, t, None, None) for i, t, _ in train]), labels)
    asked = [(i, t, None, None) for i, t, _ in test] + [(900, None, None, None), (901, "", None, None), (902, "abc def " * 60000, None, None), (902, "abc", None, None)]
    out = score(documents(asked), model).collect()
    assert len(out) == len(asked) and all(0 <= r["score"] <= 1 for r in out)
    truth = {i: q for i, _, q in test}
    right = [(r["score"] >= 0.3) == (truth[r["doc_id"]] == 1) for r in out if r["doc_id"] in truth]
    assert np.mean(right) > 0.95


def test_without_labels(spark, documents):
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = learn(documents([(1, "a b", None, None)]), none)
    assert [r["score"] for r in score(documents([(1, "a b", None, None)]), model).collect()] == [0.5]
    assert score(documents([]), None).collect() == []


def test_passages_cover_whole_texts():
    texts = ["", "one two", "w " * 250, "%%% $$$"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0, *map(len, texts)])
    grid, bags = passages(data, offsets)
    assert bags.tolist() == [[0, 1], [1, 1], [2, 3], [5, 1]] and grid.shape == (6, 18)
    assert np.expm1(grid[:, 8]).round().tolist() == [0, 2, 100, 100, 50, 2]


def test_gradient():
    draw = np.random.default_rng(1)
    grid, number, labels = draw.normal(size=(9, 18)), np.array([2, 3, 4]), np.array([0.0, 1.0, 1.0])
    model = Attention(grid, np.array([[0, 2], [2, 3], [5, 4]]), labels)

    def loss():
        p = model.score(grid, number)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    found = model._gradient(grid, number, labels)
    for name in ("W", "V", "U", "w", "c", "d"):
        flat = model.p[name].reshape(-1)
        before = flat[0]
        flat[0] = before + 1e-5
        up = loss()
        flat[0] = before - 1e-5
        down = loss()
        flat[0] = before
        weight = 1e-4 * before if name != "d" else 0
        assert found[name].reshape(-1)[0] - weight == pytest.approx((up - down) / 2e-5, abs=1e-6)
