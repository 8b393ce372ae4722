"""Detectors: forests, boosted trees and the kernel machine of this package."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from navspark.plans.boosting import Growth, boost
from navspark.plans.forest import Forest, grow_forest
from navspark.plans.kernel import fit_kernel_machine


@dataclass(frozen=True)
class Detector:
    """A named configuration. ``kind`` is ``rf``, ``svm``, or boosted trees: ``level`` grows them level by level, ``leaf`` best leaf first."""

    name: str
    kind: str
    seed: int = 42
    trees: int = 500
    depth: int | None = None
    leaves: int = 31
    min_leaf: int = 1
    min_split: int = 2
    rounds: int = 500
    step: float = 0.3
    subsample: float = 1.0
    columns: float = 1.0
    min_hessian: float = 1.0
    balanced: bool = False
    cost: float = 1.0
    landmarks: int = 512

    @property
    def needs_scaling(self) -> bool:
        return self.kind == "svm"


def model_zoo(tier: str, seed: int, trees: int = 500, rounds: int = 500, depth: int | None = None, svm: bool = True) -> list[Detector]:
    """``default``, ``adjusted`` or ``both`` sets of detectors."""
    if tier not in ("default", "adjusted", "both"):
        raise ValueError(f"unknown tier {tier!r}")
    common = dict(seed=seed, trees=trees, rounds=rounds)
    zoo = []
    if tier in ("default", "both"):
        zoo += [
            Detector("RF-default", "rf", depth=depth, **common),
            Detector("XGB-default", "level", depth=6, step=0.3, **common),
            Detector("LGBM-default", "leaf", depth=None, step=0.1, min_leaf=20, min_hessian=1e-3, **common),
        ]
        zoo += [Detector("SVM-default", "svm", cost=1.0, **common)] if svm else []
    if tier in ("adjusted", "both"):
        zoo += [
            Detector("RF-adjusted", "rf", depth=depth, min_leaf=2, min_split=5, balanced=True, **common),
            Detector("XGB-adjusted", "level", depth=6, step=0.1, subsample=0.8, columns=0.8, min_hessian=3.0, **common),
            Detector("LGBM-adjusted", "leaf", depth=6, step=0.1, columns=0.8, min_leaf=20, min_hessian=1e-3, **common),
        ]
        zoo += [Detector("SVM-adjusted", "svm", cost=10.0, balanced=True, **common)] if svm else []
    return zoo


def sweep_zoo(groups: list[str], seed: int, trees: int = 500, rounds: int = 500, depth: int | None = None) -> list[Detector]:
    """Forest and/or boosted detectors of the generalization sweep."""
    zoo = []
    if "rf" in groups:
        zoo.append(Detector("RF", "rf", seed=seed, trees=trees, depth=depth))
    if "gbm" in groups:
        zoo.append(Detector("XGB", "level", seed=seed, rounds=rounds, depth=6, step=0.3))
        zoo.append(Detector("LGBM", "leaf", seed=seed, rounds=rounds, depth=None, step=0.1, min_leaf=20, min_hessian=1e-3))
    return zoo


def class_weights(train: DataFrame, y: str) -> Column:
    """``n / (2 * n_class)`` per row."""
    sizes = {r[y]: r["count"] for r in train.groupBy(y).count().collect()}
    total = sum(sizes.values())
    weight = F.lit(1.0)
    for value, n in sizes.items():
        weight = F.when(F.col(y) == value, F.lit(total / (len(sizes) * n))).otherwise(weight)
    return weight


@dataclass
class Fitted:
    """A trained detector that adds a score and a verdict to any prepared rows."""

    detector: Detector
    model: object
    columns: list[str]

    def score(self, df: DataFrame, score: str = "score", pred: str = "pred") -> DataFrame:
        return self.model.score(df, score, pred)


def growth(detector: Detector) -> Growth:
    """Settings of boosted trees; without a named one, the penalty is that of the policy's family."""
    leaf = detector.kind == "leaf"
    return Growth(
        rounds=detector.rounds, step=detector.step, depth=detector.depth, leaves=detector.leaves if leaf else None, l2=0.0 if leaf else 1.0,
        min_hessian=detector.min_hessian, min_rows=detector.min_leaf, subsample=detector.subsample, columns=detector.columns, seed=detector.seed,
    )


def fit(detector: Detector, train: DataFrame, columns: list[str], y: str = "y") -> Fitted:
    """Train on prepared rows (scaled ones for the SVM)."""
    if detector.kind in ("level", "leaf"):
        return Fitted(detector, boost(train, columns, y, growth(detector)), columns)
    if detector.kind == "rf":
        forest = Forest(
            trees=detector.trees, depth=detector.depth, min_split=detector.min_split, min_leaf=detector.min_leaf,
            balanced=detector.balanced, seed=detector.seed,
        )
        return Fitted(detector, grow_forest(train, columns, y, forest), columns)
    if detector.kind != "svm":
        raise ValueError(f"unknown kind {detector.kind!r}")
    weighted = train.withColumn("_w", class_weights(train, y) if detector.balanced else F.lit(1.0))
    return Fitted(detector, fit_kernel_machine(weighted, columns, y, detector.cost, detector.landmarks, "_w"), columns)
