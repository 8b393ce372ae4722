import hashlib
import math

import numpy as np

from navspark.llm.vafile import cluster

SCHEMA = "vec_id long, embedding array<float>, cluster int, v string, cells string, distance string"


def plain(rows, k, rounds, width, seed=2):
    """The contract in Python integers, one vector at a time."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [max(-(2**27), min(2**27, math.floor(256 * float(np.float32(x))))) for x in v]))
    named = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in named[:k]]

    def best(v):
        return min((sum((x - y) ** 2 for x, y in zip(v, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, v in kept:
            members.setdefault(best(v)[1], []).append(v)
        for j, own in members.items():
            centroids[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    placed = [(i, *best(v)) for i, v in kept]
    inertia = {j: sum(d for _, d, m in placed if m == j) for _, _, j in placed}
    prints = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted((str(i), j, d, inertia[j], sum(inertia.values()), prints[j]) for i, d, j in placed)


def found(spark, rows, parts=3, **options):
    frame = spark.createDataFrame([(*r, 7, "x", "y", "z") for r in rows], SCHEMA).repartition(parts)
    return sorted((str(r[0]), *r[1:]) for r in cluster(frame, **options).collect())


def test_equals_plain_arithmetic(spark):
    draw = np.random.default_rng(11)
    centres = draw.normal(size=(9, 6))
    rows = [(i, [float(x) for x in centres[i % 9] + 0.2 * draw.normal(size=6)]) for i in range(700)]
    rows += [(i, [0.25, -0.5, 0.0, 1.0, -1.0, 0.125]) for i in range(1000, 1300)]  # one vector many times
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 5), (2003, [1.0, None] * 3), (2004, [float("nan")] * 6), (2005, [float("inf")] * 6)]
    rows += [(2006, [3e38, -3e38, 0.0, 0.0, 0.0, 0.0]), (2007, [0.0] * 6)]
    log = []
    truth = plain(rows, 12, 5, 6)
    assert found(spark, rows, k=12, width=6, log=log) == truth
    assert found(spark, rows, parts=7, k=12, width=6) == truth
    assert len(log) == 5
    # Finer cells leave fewer vectors in doubt.
    finer = []
    assert found(spark, rows, k=12, width=6, bits=8, log=finer) == truth
    assert all(n == len(truth) for n, _ in log)
    assert all(0 < fine <= full < 0.6 * n for (n, full), (_, fine) in zip(log[1:], finer[1:], strict=True))


def test_odd_widths_and_few_rows(spark):
    rows = [(1, [0.5, 1.5, -2.0]), (2, [0.5, 1.5, -2.0]), (9, [4.0, 0.0, 0.0])]
    assert found(spark, rows, k=2, width=3) == plain(rows, 2, 5, 3)
    assert found(spark, rows, k=40, width=3) == plain(rows, 40, 5, 3)
    assert found(spark, [], k=3, width=3) == []
    assert found(spark, [(1, None), (2, [1.0])], k=3, width=3) == []
    assert found(spark, [(None, [1.0, 1.0, 1.0])], k=3, width=3) == []
