"""Generalization sweep: presets, leave-one-speed-out, extrapolation, threshold study.

Each (split, model group) is a unit whose rows are appended to one part table. Units
already present are skipped, so an interrupted sweep continues where it stopped.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.operators.audit import feature_columns
from navspark.operators.metrics import confusion_metrics, roc_auc
from navspark.operators.prep import LIGHT, fit_prep
from navspark.operators.splits import HOLDOUT_PRESETS, split_by_tag
from navspark.operators.thresholds import evaluate_thresholds, max_f1_threshold, pick_threshold
from navspark.plans.models import fit, sweep_zoo
from navspark.plans.train import BASELINE, carve_out, labelled
from navspark.schema import drop_families
from navspark.session import stage

# Fixed values.
SEEDS = (42, 7, 123)
EXTRAPOLATION = "preset:a3_speed_low"
PART_SCHEMA = (
    "unit string, split string, model string, seed int, f1 double, precision double, recall double, "
    "auc double, fpr double, n_excluded long, held_out_speed double"
)


def read_parts(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(PART_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], PART_SCHEMA)


def sweep_columns(df: DataFrame, ablate=("snr", "gsa")) -> list[str]:
    return drop_families(feature_columns(df, ("_error", "baseline_pred", "y")), ablate)


class Sweep:
    """A labelled table with ``baseline_pred`` and the folder its results go to."""

    def __init__(self, df: DataFrame, out_dir: str, ablate=("snr", "gsa"), groups=("rf", "gbm"), seeds=SEEDS,
                 trees: int = 500, rounds: int = 500, depth: int | None = None):
        self.columns = sweep_columns(df, ablate)
        self.df = labelled(df)
        self.out, self.parts = out_dir.rstrip("/"), f"{out_dir.rstrip('/')}/parts"
        self.groups, self.seeds = list(groups), list(seeds)
        self.size = dict(trees=trees, rounds=rounds, depth=depth)

    def sides(self, tag: str) -> tuple[DataFrame, DataFrame]:
        split = split_by_tag(self.df, tag)
        keep = ["filename", "param_2_value", "y", "baseline_pred", *self.columns]
        train, test = (stage(split.where(side).select(*keep), side) for side in ("is_train", "is_test"))
        return train, test

    def prepared(self, tag: str):
        train, test = self.sides(tag)
        prep = fit_prep(train, self.columns, LIGHT)
        return prep.columns, stage(prep.transform(train), "fit"), stage(prep.transform(test), "eval")

    def done(self) -> set[str]:
        parts = read_parts(self.df.sparkSession, self.parts)
        return {r["unit"] for r in parts.select("unit").distinct().collect()}

    def append(self, rows: DataFrame, unit: str, split: str, speed: float | None) -> None:
        full = rows.withColumn("unit", F.lit(unit)).withColumn("split", F.lit(split)).withColumn(
            "held_out_speed", F.lit(speed).cast("double")
        )
        if "n_excluded" not in full.columns:
            full = full.withColumn("n_excluded", F.lit(None).cast("long"))
        fields = [part.split() for part in PART_SCHEMA.split(", ")]
        full.select(*[F.col(n).cast(t if t != "long" else "bigint").alias(n) for n, t in fields]).coalesce(1).write.mode(
            "append"
        ).parquet(self.parts)

    def run_unit(self, tag: str, group: str, finished: set[str], speed: float | None = None) -> None:
        """One split and one model group (``rf``, ``gbm`` or ``baseline``)."""
        unit = f"{tag.replace(':', '_')}__{group}"
        if unit in finished:
            return
        split = "loso_speed" if tag.startswith("speed:") else tag
        keys = ["model", "seed"]
        if group == "baseline":
            test = split_by_tag(self.df, tag).where("is_test")
            valid = F.coalesce(F.col("baseline_pred").isin(0, 1), F.lit(False))
            scored = test.where(valid).select(
                F.lit(BASELINE).alias("model"), F.lit(-1).alias("seed"), "y", F.col("baseline_pred").cast("int").alias("pred")
            )
            rows = confusion_metrics(scored, keys).withColumn("auc", F.lit(None).cast("double")).withColumn(
                "n_excluded", F.lit(test.where(~valid).count())
            )
        else:
            columns, train, test = self.prepared(tag)
            scored = None
            for seed in self.seeds:
                for detector in sweep_zoo([group], seed, **self.size):
                    one = fit(detector, train, columns).score(test).select(
                        F.lit(detector.name).alias("model"), F.lit(seed).alias("seed"), "y", "pred", "score"
                    )
                    scored = one if scored is None else scored.unionByName(one)
            scored = stage(scored, "scored")
            rows = confusion_metrics(scored, keys).join(roc_auc(scored, keys), keys, "left")
        self.append(rows, unit, split, speed)

    def presets(self) -> None:
        finished = self.done()
        for tag in ["repetition", *[f"preset:{p}" for p in HOLDOUT_PRESETS]]:
            for group in [*self.groups, "baseline"]:
                self.run_unit(tag, group, finished)

    def leave_one_speed_out(self) -> None:
        finished = self.done()
        speeds = self.df.where((F.col("scenario") == "A3") & (F.col("param_2_name") == "shift_speed"))
        for row in speeds.select("param_2_value").distinct().orderBy("param_2_value").collect():
            for group in [*self.groups, "baseline"]:
                self.run_unit(f"speed:{row[0]}", group, finished, speed=row[0])

    def extrapolation(self) -> DataFrame:
        """Recall per speed by majority vote over seeds. A missing baseline verdict counts as a miss here."""
        columns, train, test = self.prepared(EXTRAPOLATION)
        positives = test.where("y = 1")
        votes, names = None, []
        for seed in self.seeds:
            for detector in sweep_zoo(self.groups, seed, **self.size):
                names += [detector.name] if detector.name not in names else []
                one = fit(detector, train, columns).score(positives).select(
                    "filename", "param_2_value", F.lit(detector.name).alias("model"), "pred"
                )
                votes = one if votes is None else votes.unionByName(one)
        shares = votes.groupBy("filename", "param_2_value", "model").agg(F.avg("pred").alias("share"))
        recall = shares.groupBy(F.col("param_2_value").alias("speed")).pivot("model", names).agg(
            F.avg((F.col("share") >= 0.5).cast("int"))
        )
        flagged = F.coalesce((F.col("baseline_pred") == 1).cast("int"), F.lit(0))
        baseline = positives.groupBy(F.col("param_2_value").alias("speed")).agg(F.avg(flagged).alias(BASELINE))
        out = recall.join(baseline, "speed")
        out.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/extrapolation_per_speed")
        return self.df.sparkSession.read.parquet(f"{self.out}/extrapolation_per_speed")

    def threshold_study(self, targets=(0.01, 0.05), seed: int = 42, val_fraction: float = 0.25) -> DataFrame:
        """Policies picked on a carve-out, evaluated under extrapolation, with the test ceiling."""
        columns, train, test = self.prepared(EXTRAPOLATION)
        marked = stage(carve_out(train, val_fraction, seed), "marked")
        table = None
        for detector in sweep_zoo(self.groups, seed, **self.size):
            fitted = fit(detector, marked.where("NOT is_val"), columns)
            val = stage(fitted.score(marked.where("is_val")).select("y", "score"), "val")
            final = stage(fitted.score(test).select("y", "score"), "final")
            chosen = {
                "default_0.5": pick_threshold(val, "default"),
                "val_max_f1": pick_threshold(val, "val_max_f1"),
                **{f"fpr_target_{t:g}": pick_threshold(val, "fpr_target", t) for t in targets},
                "oracle_test_ceiling": float(max_f1_threshold(final, []).first()["threshold"]),
            }
            auc = roc_auc(final, []).first()["auc"]
            rows = evaluate_thresholds(final, chosen).select(
                F.lit(detector.name).alias("model"), "policy", "threshold", "recall", "fpr", "f1",
                F.lit(auc).cast("double").alias("auc_test"),
            )
            table = rows if table is None else table.unionByName(rows)
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.out}/threshold_study")
        return self.df.sparkSession.read.parquet(f"{self.out}/threshold_study")

    def report(self) -> dict[str, DataFrame]:
        """Preset summary and recall by held-out speed, both also the data of the figures."""
        parts = read_parts(self.df.sparkSession, self.parts)
        return {"sweep_all": parts, "preset_summary": preset_summary(parts), "loso_recall_by_speed": recall_by_speed(parts)}


def preset_summary(parts: DataFrame) -> DataFrame:
    return parts.where("split <> 'loso_speed'").groupBy("split", "model").agg(
        *[
            agg
            for c in ("f1", "precision", "recall", "fpr")
            for agg in (F.round(F.avg(c), 4).alias(f"{c}_mean"), F.round(F.stddev_samp(c), 4).alias(f"{c}_std"))
        ]
    )


def recall_by_speed(parts: DataFrame) -> DataFrame:
    loso = parts.where("split = 'loso_speed'")
    models = [r["model"] for r in loso.select("model").distinct().orderBy("model").collect()]
    if not models:
        return loso.select("held_out_speed")
    return loso.groupBy("held_out_speed").pivot("model", models).agg(F.round(F.avg("recall"), 4))
