"""The kernel machine against an exact one in plain numpy."""

import numpy as np
import pytest

from navspark.plans.kernel import BENDS, expansion, fit_kernel_machine, hinge, kernel


def circles(n, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 3))
    y = ((x[:, 0] ** 2 + x[:, 1] ** 2 > 1.6) ^ (draw.random(n) < 0.08)).astype(int)
    return x, y


def frame(spark, x, y, parts=3):
    return spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int").repartition(parts)


def exact_decision(x, y, new, cost, gamma, weight):
    """Dual coordinate ascent on the hinge loss; a constant in the kernel stands for the bias."""
    sign = np.where(y == 1, 1.0, -1.0)
    grid = kernel(x, x, gamma) + 100.0
    alpha, field = np.zeros(len(y)), np.zeros(len(y))
    for _ in range(400):
        for i in range(len(y)):
            step = np.clip(alpha[i] + (1 - sign[i] * field[i]) / grid[i, i], 0, cost * weight[i]) - alpha[i]
            alpha[i] += step
            field += step * sign[i] * grid[i]
    return (kernel(new, x, gamma) + 100.0) @ (alpha * sign)


def auc(score, y):
    ranks = np.argsort(np.argsort(score)) + 1
    n = y.sum()
    return (ranks[y == 1].sum() - n * (n + 1) / 2) / (n * (len(y) - n))


@pytest.mark.parametrize("cost,balanced", [(1.0, False), (10.0, True)])
def test_close_to_the_exact_machine(spark, cost, balanced):
    x, y = circles(240, 1)
    new, truth = circles(400, 2)
    share = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum())) if balanced else np.ones(len(y))
    train = frame(spark, np.column_stack([x, share])[:, :3], y)
    if balanced:
        from pyspark.sql import functions as F

        train = train.withColumn("w", F.when(F.col("y") == 1, float(share[y == 1][0])).otherwise(float(share[y == 0][0])))
    model = fit_kernel_machine(train, ["a", "b", "c"], "y", cost, landmarks=120, weight="w" if balanced else None)
    assert model.gamma == pytest.approx(1 / (3 * x.var()))
    found = {tuple(r[:3]): r["score"] for r in model.score(frame(spark, new, truth)).collect()}
    score = np.array([found[tuple(map(float, r))] for r in new])
    exact = exact_decision(x, y, new, cost, model.gamma, share)
    assert abs(auc(score, truth) - auc(exact, truth)) < 0.01
    assert balanced or ((score > 0) == (exact > 0)).mean() > 0.93
    assert auc(score, truth) > 0.85


def test_expansion_reproduces_the_kernel():
    x, _ = circles(40, 3)
    lifted = kernel(x, x, 0.3) @ expansion(x, 0.3)
    assert np.allclose(lifted @ lifted.T, kernel(x, x, 0.3), atol=1e-6)


def test_hinge_is_smooth():
    at = np.linspace(-1, 2, 3001)
    loss, slope, curve = hinge(at, BENDS[-1])
    assert np.allclose(np.gradient(loss, at)[1:-1], slope[1:-1], atol=2e-3)
    assert loss[-1] == 0 and loss[0] == pytest.approx(2 - BENDS[-1] / 2) and curve.max() == 1 / BENDS[-1]


def test_few_rows(spark):
    for x, y in ((np.zeros((0, 3)), np.zeros(0)), (np.ones((4, 3)), np.array([1, 1, 1, 1])), (np.ones((4, 3)), np.array([0, 1, 0, 1]))):
        model = fit_kernel_machine(frame(spark, x, y), ["a", "b", "c"], "y")
        out = model.score(frame(spark, np.zeros((2, 3)), np.zeros(2))).collect()
        assert len(out) == 2 and all(np.isfinite(r["score"]) for r in out)
