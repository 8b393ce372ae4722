import random
from collections import defaultdict

import numpy as np
import pytest

from navspark.llm.mixing import mix, mixed, single_copies, source_targets


def test_targets_are_capped_and_reshared():
    totals = {"b": 100, "a": 10, None: 50, "c": 1000}
    # a, b, c, null weigh 5, 2, 1, 5; of 1740 words a may take 20 and b 200, null 100, the rest is c's.
    assert source_targets(totals) == pytest.approx({"a": 20, "b": 200, None: 100, "c": 1420})
    assert source_targets({"a": 0}) == {"a": 0}
    assert source_targets({}) == {}


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(4)
    return [(i, " ".join(["w"] * draw.choice([0, 1, 5, 20, 21, 300])), "en", draw.choice(["s1", "s2", "s3", None, "s0"])) for i in range(400)]


def test_mix_meets_targets(documents, rows):
    rows = [*rows, (1000, None, "en", "s1"), (1001, " \t\n", "en", None), *[(2000, "a b c", "en", "s2")] * 3]
    out = mix(documents(rows)).collect()
    again = mix(documents(rows).repartition(7)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert len(out) == len(rows)
    totals, taken, targets = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert 0 <= r["taken"] <= 2 * r["size"] and r["taken"] == r["copies"] * r["size"]
        totals[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        targets[r["source"]] = r["target"]
    assert targets == pytest.approx(source_targets(dict(totals)))
    for s, t in targets.items():
        assert abs(taken[s] - t) <= 21
    assert {r["source_size"] == totals[r["source"]] for r in out} == {True}


def test_mixed_repeats_rows(documents, rows):
    rows = [*rows[:60], *[(2000, "a b c", "en", "s2")] * 3]
    frame = documents(rows)
    counts, out = defaultdict(int), defaultdict(int)
    for r in mix(frame).collect():
        counts[r["doc_id"]] += r["copies"]
    result = mixed(frame)
    assert result.columns == frame.columns
    for r in result.collect():
        out[r["doc_id"]] += 1
    assert out == {k: v for k, v in counts.items() if v}


def test_empty_table(documents):
    assert mix(documents([])).collect() == []
    assert mixed(documents([])).collect() == []


def test_single_copies_leave_no_useful_one():
    draw = random.Random(8)
    for _ in range(300):
        n = draw.randint(1, 8)
        sizes = np.array(draw.sample(range(1, 60), n))
        spare, taken = (np.array([draw.randint(0, 4) for _ in range(n)]) for _ in range(2))
        gap = draw.uniform(-300, 300)
        change = single_copies(gap, sizes, spare, taken)
        assert (change <= spare).all() and (-change <= taken).all()
        left = gap - float((change * sizes).sum())
        assert abs(left) <= abs(gap)
        free = sizes[(spare - change > 0) if left > 0 else (taken + change > 0)]
        assert not len(free) or abs(left) <= free.min() / 2 + 1e-9
    # 147.2 words by copies of 21 and less; 300 would overstep by more.
    assert single_copies(147.2, np.array([300, 21, 5, 1]), np.array([1, 6, 4, 9]), np.zeros(4)).tolist() == [0, 6, 4, 1]


def test_reruns_repeat_the_same_rows(documents):
    # One id, source and size, different texts: which of them is repeated may not hang on the order of tasks.
    rows = [(1, f"w{i} a b", "en", "s") for i in range(9)] + [(2, "x " * 30, "en", "t")]
    first, second = (sorted(map(str, mixed(documents(rows).repartition(n)).collect())) for n in (1, 6))
    assert first == second
