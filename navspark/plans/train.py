"""Train and evaluate detectors on one split, and write the report tables."""

from __future__ import annotations

import json
import os
import platform
import time

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.config import Settings
from navspark.operators.audit import feature_columns
from navspark.operators.intervals import base_rate_analysis, mcnemar_table
from navspark.operators.metrics import confusion_metrics, contingency, roc_auc
from navspark.operators.prep import PrepOptions, fit_prep
from navspark.operators.splits import (
    HOLDOUT_PRESETS,
    class_quota,
    kfold_repetition,
    param_holdout,
    repetition_split,
    stratified_pick,
)
from navspark.operators.thresholds import evaluate_thresholds, pick_threshold
from navspark.plans.models import Detector, fit, model_zoo
from navspark.schema import META_COLUMNS
from navspark.session import stage
from navspark.sources.tables import write_report

BASELINE = "BASELINE"
METRIC_COLUMNS = ["accuracy", "precision", "recall", "f1", "auc_roc", "tn", "fp", "fn", "tp"]


def prep_options(pre: Settings) -> PrepOptions:
    return PrepOptions(
        ablate_families=tuple(pre.get("ablate_families") or ()),
        zero_variance_eps=pre["zero_variance_eps"],
        max_null_rate=pre["nan_col_drop_threshold"],
        skew_limit=pre["skew_threshold"],
        winsor_quantiles=tuple(pre["winsorize_quantiles"]) if pre["winsorize"] else None,
        correlation_limit=pre["correlation_threshold"],
    )


def labelled(df: DataFrame) -> DataFrame:
    return df.withColumn("y", (F.col("label") == "spoofed").cast("int"))


def carve_out(train: DataFrame, fraction: float, seed: int, name: str = "is_val") -> DataFrame:
    """Mark a stratified validation share, exact in size."""
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    total = sum(sizes.values())
    wanted = int(-(-total * fraction // 1))
    return stratified_pick(train, "y", "filename", class_quota(sizes, wanted), seed, name)


def subsample(train: DataFrame, size: int, seed: int) -> DataFrame:
    """Exactly ``size`` rows, classes in proportion (all rows if there are no more)."""
    sizes = {r["y"]: r["count"] for r in train.groupBy("y").count().collect()}
    if sum(sizes.values()) <= size:
        return train
    return stratified_pick(train, "y", "filename", class_quota(sizes, size), seed, "_in").where("_in").drop("_in")


def long_scores(scored: DataFrame, names: list[str], extra: list[str]) -> DataFrame:
    """One row per (recording, classifier): ``classifier, pred, score`` beside ``extra``."""
    cells = F.array(
        *[
            F.struct(
                F.lit(n).alias("classifier"), F.col(f"`pred_{n}`").alias("pred"), F.col(f"`score_{n}`").alias("score")
            )
            for n in names
        ]
    )
    return scored.select(*extra, F.inline(cells))


def metric_table(long: DataFrame, keys: list[str]) -> DataFrame:
    counts = confusion_metrics(long, keys).drop("fpr")
    return counts.join(roc_auc(long, keys).withColumnRenamed("auc", "auc_roc"), keys, "left").select(
        *keys, *METRIC_COLUMNS
    )


def run_split(
    df: DataFrame,
    settings: Settings,
    out_dir: str,
    baseline: DataFrame | None = None,
    zoo: list[Detector] | None = None,
) -> dict[str, DataFrame]:
    """Fit and evaluate on a table with ``is_train``/``is_test``; returns the report tables."""
    spark = df.sparkSession
    columns = feature_columns(df, ("_error", "is_train", "is_test", "fold"))
    table = labelled(df.drop("_error", "fold"))
    train = stage(table.where("is_train").drop("is_train", "is_test"), "train")
    test = stage(table.where("is_test").drop("is_train", "is_test"), "test")

    prep = fit_prep(train, columns, prep_options(settings.preprocessing))
    seed, models, th = settings.models.seed, settings.models, settings.thresholds
    zoo = zoo or model_zoo(models.tier, seed, models.trees, models.rounds, models.max_depth, models.svm.enabled)
    forms = {False: stage(prep.transform(train), "plain")}
    if any(d.needs_scaling for d in zoo):
        forms[True] = stage(prep.transform(train, scaled=True), "scaled")

    scored, timing, policies = None, [], []
    key = [c for c in META_COLUMNS if c in test.columns] + ["y"]
    for detector in zoo:
        rows = forms[detector.needs_scaling]
        sampled = False
        if detector.kind == "svm" and not models.svm.train_on_full_set:
            smaller = subsample(rows, models.svm.subsample_size, seed)
            sampled = smaller is not rows
            rows = smaller
        started = time.time()
        fitted = fit(detector, rows, prep.columns)
        fit_s = time.time() - started
        name = detector.name
        verdicts = fitted.score(
            prep.transform(test, scaled=detector.needs_scaling), f"score_{name}", f"pred_{name}"
        ).select(*key, f"`score_{name}`", f"`pred_{name}`")
        started = time.time()
        verdicts = stage(verdicts, "verdicts")
        n_test = verdicts.count()
        timing.append((name, fit_s, (time.time() - started) / max(n_test, 1) * 1000.0, sampled, rows.count()))
        scored = verdicts if scored is None else scored.join(
            verdicts.select("filename", f"`score_{name}`", f"`pred_{name}`"), "filename"
        )
        if th.enabled:
            # The carve-out sees rows that were prepared together with the fitting rows.
            marked = stage(carve_out(rows, th.val_fraction, seed), "marked")
            refit = fit(detector, marked.where("NOT is_val").drop("is_val"), prep.columns)
            val = stage(refit.score(marked.where("is_val").drop("is_val")).select("y", "score"), "val")
            final = stage(
                refit.score(prep.transform(test, scaled=detector.needs_scaling)).select("y", "score"), "final"
            )
            policies.append(policy_rows(val, final, th.target_fprs).withColumn("classifier", F.lit(name)))

    names = [d.name for d in zoo]
    long = long_scores(scored, names, ["filename", "scenario", "y"])
    times = spark.createDataFrame(
        timing, "classifier string, train_time_s double, inference_ms_per_sample double, svm_subsampled boolean, n_train long"
    )
    reports = {
        "preprocessing_log": spark.createDataFrame(
            [(r["step"], r["n_dropped"], r["columns"]) for r in prep.log], "step string, n_dropped int, columns string"
        ),
        "final_features": spark.createDataFrame([(c,) for c in prep.columns], "feature string"),
        "overall_results": metric_table(long, ["classifier"]).join(times, "classifier", "left"),
        "per_scenario_results": metric_table(long, ["classifier", "scenario"]),
        "test_predictions": scored.drop(*[f"score_{n}" for n in names]),
    }
    if policies:
        table = policies[0]
        for more in policies[1:]:
            table = table.unionByName(more)
        reports["threshold_results"] = table
    if baseline is not None:
        reports = with_baseline(reports, long, scored, baseline, names)
    reports["base_rate_analysis"] = base_rate_analysis(reports["overall_results"], ["classifier"])
    for name, report in reports.items():
        if name == "test_predictions":
            report.write.mode("overwrite").option("header", "true").csv(os.path.join(out_dir, name + ".csv"))
        else:
            write_report(report, os.path.join(out_dir, name + ".csv"))
    return reports


def policy_rows(val: DataFrame, test: DataFrame, targets: list[float]) -> DataFrame:
    """Threshold policies picked on validation scores and evaluated on test scores."""
    chosen = {
        "default_0.5": pick_threshold(val, "default"),
        "val_max_f1": pick_threshold(val, "val_max_f1"),
        **{f"fpr_target_{t:g}": pick_threshold(val, "fpr_target", t) for t in targets},
    }
    auc = roc_auc(test, []).first()["auc"]
    return evaluate_thresholds(test, chosen).withColumn("auc_roc", F.lit(auc).cast("double"))


def with_baseline(
    reports: dict[str, DataFrame], long: DataFrame, scored: DataFrame, baseline: DataFrame, names: list[str]
) -> dict[str, DataFrame]:
    """Add the external detector, compared on exactly the rows it gave a verdict for."""
    verdict = F.col("baseline_pred")
    merged = scored.join(baseline.select("filename", "baseline_pred"), "filename", "left").withColumn(
        "valid", F.coalesce(verdict.isin(0, 1), F.lit(False))
    )
    merged = stage(merged, "baseline")
    valid = merged.where("valid").select(
        F.lit(BASELINE).alias("classifier"), "filename", "scenario", "y", verdict.cast("int").alias("pred"),
        F.lit(None).cast("double").alias("score"),
    )
    n_excluded = merged.where("NOT valid").count()
    overall = metric_table(valid, ["classifier"]).withColumn("n_excluded", F.lit(n_excluded))
    out = dict(reports)
    out["overall_results"] = reports["overall_results"].unionByName(overall, allowMissingColumns=True)
    out["per_scenario_results"] = reports["per_scenario_results"].unionByName(
        metric_table(valid, ["classifier", "scenario"])
    )
    both = long_scores(merged.where("valid"), names, ["filename", "scenario", "y", verdict.alias("baseline")])
    if n_excluded:
        same_rows = both.select("classifier", "y", "pred").unionByName(valid.select("classifier", "y", "pred"))
        out["overall_results_baseline_subset"] = confusion_metrics(same_rows, ["classifier"])
    tables = contingency(both, ["classifier"], F.col("pred") == F.col("y"), F.col("baseline") == F.col("y"))
    out["mcnemar"] = mcnemar_table(tables).select(
        "classifier", F.lit(BASELINE).alias("vs"), "p_value"
    )
    return out


def library_versions() -> dict[str, str | None]:
    found: dict[str, str | None] = {"python": platform.python_version()}
    for module in ("pyspark", "numpy", "pandas", "pyarrow"):
        try:
            found[module] = __import__(module).__version__
        except ImportError:
            found[module] = None
    return found


def train_and_evaluate(
    df: DataFrame, settings: Settings, out_dir: str, baseline: DataFrame | None = None, zoo: list[Detector] | None = None
) -> DataFrame:
    """Run the configured regime. Returns overall results (fold summary for k-fold)."""
    spark: SparkSession = df.sparkSession
    regime = settings.split.regime
    root = os.path.join(out_dir, regime)
    manifest = {
        "regime": regime, "tier": settings.models.tier, "seed": settings.models.seed,
        "ablate_families": list(settings.preprocessing.ablate_families), "library_versions": library_versions(),
    }
    if regime == "repetition":
        result = run_split(repetition_split(df), settings, root, baseline, zoo)["overall_results"]
    elif regime == "param_holdout":
        preset = settings.split.param_holdout_preset
        manifest["preset"] = {**HOLDOUT_PRESETS[preset], "name": preset}
        split = param_holdout(df, **HOLDOUT_PRESETS[preset])
        result = run_split(split, settings, os.path.join(root, preset), baseline, zoo)["overall_results"]
    elif regime == "kfold":
        folds, everything = kfold_repetition(df, settings.split.kfold_n), None
        for k in range(settings.split.kfold_n):
            one = run_split(folds.where(F.col("fold") == k), settings, os.path.join(root, f"fold{k}"), baseline, zoo)
            rows = stage(one["overall_results"].withColumn("fold", F.lit(k)), "fold")
            everything = rows if everything is None else everything.unionByName(rows, allowMissingColumns=True)
        result = fold_summary(everything)
        write_report(result, os.path.join(root, "kfold_summary.csv"), ["classifier"])
    else:
        raise ValueError(f"unknown split regime {regime!r}")
    text = json.dumps(manifest, indent=2)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(
        os.path.join(root, "run_manifest.json")
    )
    return result


def fold_summary(rows: DataFrame) -> DataFrame:
    """Mean and sample deviation over folds. Descriptive only: folds share training data."""
    return rows.groupBy("classifier").agg(
        *[agg for c in ("f1", "precision", "recall") for agg in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))]
    )
