"""Command line: ``spark-submit``-able programs, one per stage of the study."""

from __future__ import annotations

import argparse
import os

from navspark.config import load_settings
from navspark.session import build_session, clear_staging


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="navspark", description=__doc__)
    top.add_argument("--master", default=None, help="Spark master; left to the launcher by default")
    sub = top.add_subparsers(dest="program", required=True)

    def add(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--config", default=None)
        return p

    p = add("extract-features", "captures to a feature table")
    p.add_argument("--dataset-dir")
    p.add_argument("--profile", choices=["full", "deployable"])
    p.add_argument("--no-epoch-series", action="store_true")

    p = add("extract-windows", "interleaved vessel logs to windows")
    p.add_argument("--real-dir")
    p.add_argument("--out", default="real_windows")
    p.add_argument("--window", type=float)
    p.add_argument("--stride", type=float)
    p.add_argument("--profile", choices=["full", "deployable"], default="deployable")

    p = add("prepare-cruise", "split-family archive of one cruise to evaluation assets")
    p.add_argument("--cruise-id", required=True)
    p.add_argument("--rx1", required=True)
    p.add_argument("--rx2")
    p.add_argument("--out-dir", default="results/real")
    p.add_argument("--window", type=float, default=120.0)
    p.add_argument("--stride", type=float, default=60.0)
    p.add_argument("--min-epochs", type=int, default=100)
    p.add_argument("--transit-sog-kn", type=float, default=3.0)
    p.add_argument("--transit-cog-deg", type=float, default=5.0)
    p.add_argument("--labelled-features", help="feature table whose clean class is compared")
    p.add_argument("--no-checksums", action="store_true")

    p = add("train", "train and evaluate detectors")
    p.add_argument("--split", choices=["repetition", "kfold", "param_holdout"])
    p.add_argument("--preset")
    p.add_argument("--tier", choices=["default", "adjusted", "both"])
    p.add_argument("--profile-tag", default="")

    p = add("sweep", "generalization sweep and threshold study")
    p.add_argument("--stage", default="all", choices=["presets", "loso", "extrap", "thresh", "report", "all"])
    p.add_argument("--models", default="rf,gbm")
    p.add_argument("--seeds", default="42,7,123")

    p = add("audit", "single-feature AUC screen")
    p.add_argument("--features")
    p.add_argument("--out", default="results/audit")

    p = add("onset-check", "kinematic traces of a few replay recordings per class")
    p.add_argument("--dataset-dir")
    p.add_argument("--n", type=int, default=3)
    p.add_argument("--out", default="results/audit/onset_traces")
    return top


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    option = vars(args).get
    settings = load_settings(
        args.config,
        {
            "paths.dataset_dir": option("dataset_dir"),
            "paths.real_data_dir": option("real_dir"),
            "features.profile": option("profile"),
            "real_data.window_s": option("window"),
            "real_data.stride_s": option("stride"),
            "split.regime": option("split"),
            "split.param_holdout_preset": option("preset"),
            "models.tier": option("tier"),
        },
    )
    spark = build_session("navspark", args.master)
    try:
        PROGRAMS[args.program](spark, args, settings)
    finally:
        clear_staging(spark)


def _features(spark, settings, path=None):
    from navspark.sources.tables import read_feature_table

    return read_feature_table(spark, path or settings.paths.features, settings.features.format)


def _baseline(spark, settings):
    from pyspark.errors import AnalysisException

    from navspark.sources.tables import read_predictions

    try:
        return read_predictions(spark, settings.paths.baseline_predictions, settings.paths.baseline_column)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        print("no baseline predictions found; the external detector is left out")
        return None


def extract_features(spark, args, settings):
    from navspark.plans.extract import error_rows, extract_features as run, label_balance

    ids = {tuple(settings.receivers.rx1): 1, tuple(settings.receivers.rx2): 2}
    series = settings.extraction.save_epoch_series and not args.no_epoch_series
    table = run(
        spark, settings.paths.dataset_dir, settings.paths.features, settings.features.profile,
        settings.paths.epochs_dir if series else None, ids, settings.extraction.validate_checksums,
        settings.features.format,
    )
    label_balance(table).show()
    error_rows(table).show(truncate=False)


def extract_windows(spark, args, settings):
    from navspark.plans.cruise import log_windows

    real = settings.real_data
    log_windows(
        spark, settings.paths.real_data_dir, args.out, real.window_s, real.stride_s, real.min_epochs, args.profile
    )


def prepare_cruise(spark, args, settings):
    from navspark.plans.cruise import baseline_document, prepare_cruise as run

    labelled = _features(spark, settings, args.labelled_features) if args.labelled_features else None
    result = run(
        spark, args.cruise_id, args.rx1, args.rx2, args.out_dir, args.window, args.stride, args.min_epochs,
        args.transit_sog_kn, args.transit_cog_deg, not args.no_checksums, labelled,
    )
    print(baseline_document(result, args.cruise_id))
    if labelled is not None:
        result["ks_audit"].show(8, truncate=False)


def train(spark, args, settings):
    from navspark.plans.train import train_and_evaluate

    tag = f"_{args.profile_tag}" if args.profile_tag else ""
    out = settings.paths.results_dir + tag
    train_and_evaluate(_features(spark, settings), settings, out, _baseline(spark, settings)).show(truncate=False)


def sweep(spark, args, settings):
    from pyspark.sql import functions as F

    from navspark.plans.sweep import Sweep
    from navspark.sources.tables import write_report

    df, verdicts = _features(spark, settings), _baseline(spark, settings)
    if verdicts is None:
        df = df.withColumn("baseline_pred", F.lit(None).cast("double"))
    else:
        df = df.join(verdicts, "filename", "left")
    models = settings.models
    job = Sweep(
        df, os.path.join(settings.paths.results_dir, "sweep"), settings.preprocessing.ablate_families,
        [g.strip() for g in args.models.split(",") if g.strip()], [int(s) for s in args.seeds.split(",")],
        models.trees, models.rounds, models.max_depth,
    )
    stages = {
        "presets": job.presets, "loso": job.leave_one_speed_out, "extrap": job.extrapolation,
        "thresh": job.threshold_study,
    }
    for name, run in stages.items():
        if args.stage in (name, "all"):
            run()
    if args.stage in ("report", "all"):
        for name, table in job.report().items():
            write_report(table, f"{job.out}/{name}.csv")


def audit(spark, args, settings):
    from navspark.operators.audit import audit as run, family_summary, zero_intensity_separators
    from navspark.session import stage
    from navspark.sources.tables import write_report

    found = stage(run(_features(spark, settings, args.features)), "audit")
    write_report(found, os.path.join(args.out, "single_feature_auc_screen.csv"), ["feature"])
    found.where("oracle_any_scenario").show(200, truncate=False)
    if "zero_intensity_separator" in found.columns:
        zero_intensity_separators(found).show(200, truncate=False)
    family_summary(found).show(truncate=False)


def onset_check(spark, args, settings):
    from navspark.plans.extract import labelled_epochs
    from navspark.plans.onset import pick_per_class, receiver_traces
    from navspark.sources.tables import read_manifest

    root = settings.paths.dataset_dir
    picks = pick_per_class(read_manifest(spark, os.path.join(root, "dataset.json")), "A2", args.n)
    epochs, _ = labelled_epochs(spark, picks, root)
    receiver_traces(epochs, picks).write.mode("overwrite").option("header", "true").csv(args.out)


PROGRAMS = {
    "extract-features": extract_features,
    "extract-windows": extract_windows,
    "prepare-cruise": prepare_cruise,
    "train": train,
    "sweep": sweep,
    "audit": audit,
    "onset-check": onset_check,
}

if __name__ == "__main__":
    main()
