"""Kernel machine with a Gaussian kernel on landmarks, solved in the primal."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from navspark.session import stage

#: Widths of the quadratic bend that makes the hinge smooth: each solution starts the next, and the last one counts.
BENDS = (2.0, 1.0, 0.5, 0.25)
_STEPS = (1.0, 0.5, 0.25, 0.125, 0.03, 0.01)


def kernel(x: np.ndarray, landmarks: np.ndarray, gamma: float) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (landmarks**2).sum(axis=1)[None, :] - 2 * x @ landmarks.T
    return np.exp(-gamma * np.maximum(square, 0.0))


def expansion(landmarks: np.ndarray, gamma: float) -> np.ndarray:
    """Maps kernel values with the landmarks to features whose inner products are the kernel between landmarks.

    Directions in which the landmarks' kernel is flat are left out; the inverse root of their eigenvalue would only blow up noise.
    """
    values, vectors = np.linalg.eigh(kernel(landmarks, landmarks, gamma))
    kept = values > 1e-9 * values[-1]
    return vectors[:, kept] / np.sqrt(values[kept])


def hinge(margin: np.ndarray, bend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smooth hinge loss of label times decision, its slope and curvature."""
    short = 1.0 - margin
    bent = (short > 0) & (short < bend)
    loss = np.where(short >= bend, short - bend / 2, np.where(bent, short**2 / (2 * bend), 0.0))
    return loss, np.where(short >= bend, -1.0, np.where(bent, -short / bend, 0.0)), bent / bend


def _grid(batch: pa.RecordBatch, first: int) -> np.ndarray:
    return np.column_stack([batch.column(i).cast(pa.float64()).to_numpy(zero_copy_only=False) for i in range(first, batch.num_columns)])


@dataclass
class KernelMachine:
    columns: list[str]
    landmarks: np.ndarray
    gamma: float
    map: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, df: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
        """``df`` with the decision value, and 1 where it is above 0."""
        shared = df.sparkSession.sparkContext.broadcast((self.landmarks, self.map @ self.weights))
        gamma, bias = self.gamma, self.bias

        @F.arrow_udf("double")
        def decision(*columns: pa.Array) -> pa.Array:
            landmarks, weights = shared.value
            x = np.column_stack([c.cast(pa.float64()).to_numpy(zero_copy_only=False) for c in columns])
            return pa.array(kernel(x, landmarks, gamma) @ weights + bias)

        scored = df.withColumn(score, decision(*[F.col(f"`{c}`").cast("double") for c in self.columns]))
        return scored.withColumn(pred, (F.col(score) > 0).cast("int"))


def fit_kernel_machine(
    train: DataFrame, columns: list[str], y: str, cost: float = 1.0, landmarks: int = 512, weight: str | None = None, rounds: int = 20
) -> KernelMachine:
    """Minimise half the squared norm plus ``cost`` times the (weighted) smooth hinge of every row.

    ``train`` is scaled and has no missing values. The kernel's width is one over (columns x variance of the matrix). The
    landmarks are the rows whose values hash lowest, up to ``landmarks`` different ones: a bounded sample that says in which
    functions the solution is sought. All rows enter the loss. Each Newton step is one pass: tasks send gradient and
    curvature as one row per feature of the expansion, and the loss of the step before at several lengths.
    """
    spread = train.agg(*[F.avg(F.col(f"`{c}`") ** 2) for c in columns], *[F.avg(f"`{c}`") for c in columns], F.count("*")).first()
    if not spread[-1]:
        return KernelMachine(columns, np.zeros((1, len(columns))), 1.0, np.ones((1, 1)), np.zeros(1), 0.0)
    squares, means = np.array(spread[: len(columns)], float), np.array(spread[len(columns) : -1], float)
    gamma = 1.0 / (len(columns) * max(float(squares.mean() - means.mean() ** 2), 1e-12))
    values = [F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns)]
    sign = F.when(F.col(y) == 1, 1.0).otherwise(-1.0).alias("sign")
    rows = stage(train.select(sign, (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"), *values), "kernel")
    names = [f"c{i}" for i in range(len(columns))]
    first = rows.select(*names).distinct().orderBy(F.xxhash64(*names), *names).limit(landmarks).collect()
    chosen = np.array([list(r) for r in first], float)
    mapped = expansion(chosen, gamma)
    size = mapped.shape[1] + 1  # the last place is the bias, which is not shrunk
    shrink = np.append(np.ones(size - 1), 0.0)

    def evaluated(start: np.ndarray, along: np.ndarray, length: float, bend: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Losses at the step lengths from ``start``, and gradient and curvature at the one given."""
        shared = rows.sparkSession.sparkContext.broadcast((chosen, mapped, start, along))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chosen, mapped, start, along = shared.value
            losses, table = np.zeros(size), np.zeros((size, size + 1))
            for batch in batches:
                if not batch.num_rows:
                    continue
                sign, weight = (np.asarray(batch.column(i)) for i in (0, 1))
                lifted = np.column_stack([kernel(_grid(batch, 2), chosen, gamma) @ mapped, np.ones(batch.num_rows)])
                here, change = sign * (lifted @ start), sign * (lifted @ along)
                for i, step in enumerate(_STEPS[:size]):
                    losses[i] += (weight * hinge(here + step * change, bend)[0]).sum()
                _, slope, curve = hinge(here + length * change, bend)
                table[:, -1] += lifted.T @ (weight * sign * slope)
                near = curve > 0
                table[:, :-1] += lifted[near].T @ (lifted[near] * (weight * curve)[near, None])
            part = TaskContext.get().partitionId()
            cells = [pa.array(r.tolist()) for r in table]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(size), pa.int32()), pa.array([part] * size, pa.int32()), pa.array(losses), pa.array([c.to_pylist() for c in cells], pa.list_(pa.float64()))],
                ["i", "part", "loss", "cells"],
            )

        def together(group: pd.DataFrame) -> pd.DataFrame:
            # Always in the order of the tasks, so that reruns agree.
            group = group.sort_values("part")
            return pd.DataFrame({"i": group["i"].iloc[:1], "loss": [group["loss"].sum()], "cells": [np.sum(np.stack(group["cells"]), axis=0)]})

        parts = rows.mapInArrow(add, "i int, part int, loss double, cells array<double>")
        found = sorted(parts.groupBy("i").applyInPandas(together, "i int, loss double, cells array<double>").collect())
        table = np.array([r["cells"] for r in found])
        return np.array([r["loss"] for r in found]), table[:, -1], table[:, :-1]

    at = np.zeros(size)
    for bend in BENDS:
        losses, slope, curve = evaluated(at, np.zeros(size), 0.0, bend)
        objective = 0.5 * (shrink * at**2).sum() + cost * losses[0]
        for _ in range(rounds):
            along = -np.linalg.solve(cost * curve + np.diag(shrink) + 1e-8 * np.eye(size), shrink * at + cost * slope)
            losses, slope, curve = evaluated(at, along, 1.0, bend)
            steps = _STEPS[: len(losses)]
            ends = [0.5 * (shrink * (at + s * along) ** 2).sum() + cost * losses[i] for i, s in enumerate(steps)]
            best = int(np.argmin(ends))
            gain, worth = objective - ends[best], objective
            if gain <= 0:
                break
            at, objective = at + steps[best] * along, ends[best]
            if gain <= 1e-5 * worth:
                break
            if best:
                _, slope, curve = evaluated(at, np.zeros(size), 0.0, bend)
    return KernelMachine(columns, chosen, gamma, mapped, at[:-1], float(at[-1]))
