import numpy as np
from pyspark.sql import functions as F

from navspark.llm.ann import search

SCHEMA = "vec_id long, embedding array<float>, label int, leaf string, q string"


def plain(rows, k):
    """The k best partners of each query among all usable rows."""
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good[i] = np.array(v, np.float32).astype(float)
    ids = np.array(sorted(good))
    grid = np.array([good[i] for i in ids]).reshape(-1, 8)
    out = {}
    for i in ids[ids % 5 == 0]:
        s = np.zeros(len(ids))
        for d in range(8):
            s += good[i][d] * grid[:, d]
        order = [n for n in np.lexsort((ids, -s)) if ids[n] != i][:k]
        out[int(i)] = [(int(ids[n]), float(s[n])) for n in order]
    return out


def found(spark, rows, **options):
    frame = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    out = {}
    for r in sorted(search(frame, F.col("vec_id") % 5 == 0, **options).collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
        assert r["rank"] == len(out[r["query_id"]])
    return out


def test_recall_ties_and_odd_rows(spark):
    draw = np.random.default_rng(3)
    centres = draw.normal(size=(12, 8))
    rows = [(i, [float(x) for x in centres[i % 12] + 0.3 * draw.normal(size=8)]) for i in range(900)]
    rows += [(i, [1.0] + [0.5] * 7) for i in range(1000, 1200)]  # one vector many times
    odd = [(2000, None), (2005, [0.0] * 8), (2010, [1.0, None] * 4), (2015, [float("nan")] * 8), (2020, [float("inf")] * 8), (2025, [1.0]), (2030, [])]
    rows += [*odd, (None, [1.0] * 8), (3, rows[3][1])]
    truth, out = plain(rows, 6), found(spark, rows, k=6, leaf=40)
    assert out.keys() == truth.keys()
    hits = sum(len(set(out[q]) & set(truth[q])) for q in truth)
    assert hits >= 0.9 * 6 * len(truth)
    # With every query calibrated and all of their neighbours asked for, nothing is missed, ties included.
    assert found(spark, rows, k=6, leaf=40, recall=1.0) == truth


def test_few_rows(spark):
    rows = [(0, [1.0] * 8), (5, [2.0] * 8), (7, [2.0] * 8)]
    assert found(spark, rows) == plain(rows, 20)
    assert found(spark, [(5, [1.0] * 8)]) == {}
    assert found(spark, []) == {}
    assert found(spark, [(1, None), (2, [0.0] * 8)]) == {}
