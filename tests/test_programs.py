"""Programs end to end on small tables, with small detectors."""

import copy
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from navspark import __main__ as cli
from navspark.config import DEFAULTS, Settings, load_settings
from navspark.plans.cruise import divergence_audit
from navspark.plans.models import Detector, fit, model_zoo, sweep_zoo
from navspark.plans.sweep import Sweep, read_parts
from navspark.plans.train import subsample, train_and_evaluate
from tests.test_evaluation import frame, labelled_table
from tests.test_sources import recordings  # noqa: F401  (fixture)

SMALL = [Detector("RF-default", "rf", trees=5, depth=4), Detector("SVM-default", "svm", landmarks=16)]


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("features"))
    pdf = labelled_table().drop(columns=["void"])
    pdf = pdf[(pdf.scenario == "A1") | pdf.param_2_value.isin([0.0, 8.0, 16.0, 24.0, 40.0, 60.0])]
    frame(spark, pdf).withColumn("_error", F.lit("")).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def verdicts(spark, table):
    score = F.when(F.col("index") == 19, F.lit(None)).otherwise((F.col("speed_gap") > 1).cast("double"))
    return table.select("filename", score.alias("baseline_pred"))


def settings(**sections):
    merged = copy.deepcopy(DEFAULTS)
    for section, values in sections.items():
        merged[section].update(values)
    return Settings(merged)


def test_settings(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"models": {"seed": 7}}))
    s = load_settings(str(path), {"split.regime": "kfold", "models.tier": None})
    assert s.models.seed == 7 and s.models.tier == "default" and s.split.regime == "kfold"
    assert DEFAULTS["models"]["seed"] == 42
    with pytest.raises(AttributeError):
        s.models.missing


def test_zoo():
    assert [d.name for d in model_zoo("both", 1)] == [
        "RF-default", "XGB-default", "LGBM-default", "SVM-default",
        "RF-adjusted", "XGB-adjusted", "LGBM-adjusted", "SVM-adjusted",
    ]
    assert [d.name for d in model_zoo("default", 1, svm=False)][-1] == "LGBM-default"
    assert [d.name for d in sweep_zoo(["gbm"], 3)] == ["XGB", "LGBM"]
    with pytest.raises(ValueError):
        model_zoo("other", 1)


def test_detectors_learn(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 2))
    import pandas as pd

    pdf = pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "y": ((x**2).sum(axis=1) > 1.2).astype(int)})
    df = frame(spark, pdf).cache()
    for detector in (
        Detector("rf", "rf", trees=10, depth=6), Detector("level", "level", rounds=5, depth=4), Detector("leaf", "leaf", rounds=5, depth=None, leaves=8),
        Detector("svm", "svm", landmarks=200, balanced=True, cost=10.0),
    ):
        scored = fit(detector, df, ["a", "b"]).score(df)
        right = scored.agg(F.avg((F.col("pred") == F.col("y")).cast("int"))).first()[0]
        assert right > 0.85, detector.name  # not separable by a line


def test_repetition_split_reports(spark, table, verdicts, tmp_path):
    out = str(tmp_path)
    overall = {r["classifier"]: r for r in train_and_evaluate(table, settings(), out, verdicts, SMALL).collect()}
    assert set(overall) == {"RF-default", "SVM-default", "BASELINE"}
    n_test = table.where("index >= 16").count()
    rf = overall["RF-default"]
    assert rf["tn"] + rf["fp"] + rf["fn"] + rf["tp"] == n_test and 0.5 < rf["auc_roc"] <= 1.0
    assert overall["BASELINE"]["n_excluded"] == n_test // 4 and overall["BASELINE"]["auc_roc"] is None

    def report(name):
        return spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/repetition/{name}.csv")

    assert report("threshold_results").count() == 2 * 4
    assert report("per_scenario_results").count() == 3 * 2
    assert report("base_rate_analysis").count() == 3 * 5
    assert report("test_predictions").count() == n_test
    subset = report("overall_results_baseline_subset")
    assert {r["classifier"]: r["tn"] + r["fp"] + r["fn"] + r["tp"] for r in subset.collect()} == dict.fromkeys(overall, n_test * 3 // 4)
    assert {r["vs"] for r in report("mcnemar").collect()} == {"BASELINE"}
    assert "mean_snr_median" not in {r["feature"] for r in report("final_features").collect()}
    assert [r["step"] for r in report("preprocessing_log").collect()][0] == "artifact_ablation"
    manifest = json.loads(spark.read.text(f"{out}/repetition/run_manifest.json", wholetext=True).first()[0])
    assert manifest["regime"] == "repetition" and manifest["library_versions"]["pyspark"]


def test_kfold_and_holdout(spark, table, tmp_path):
    quick = [Detector("RF-default", "rf", trees=2, depth=2)]
    off = dict(thresholds={"enabled": False})
    summary = train_and_evaluate(table, settings(split={"regime": "kfold", "kfold_n": 2}, **off), str(tmp_path), None, quick)
    row = summary.first()
    assert row["classifier"] == "RF-default" and row["f1_std"] is not None
    held = train_and_evaluate(table, settings(split={"regime": "param_holdout"}, **off), str(tmp_path), None, quick)
    assert held.count() == 1
    with pytest.raises(ValueError):
        train_and_evaluate(table, settings(split={"regime": "other"}), str(tmp_path), None, quick)


def test_subsample(spark, table):
    df = table.withColumn("y", (F.col("label") == "spoofed").cast("int"))
    part = subsample(df, 101, 3)
    assert part.count() == 101 and sorted(r["count"] for r in part.groupBy("y").count().collect()) == [50, 51]
    assert subsample(df, 10**6, 3) is df


def test_sweep_resumes(spark, table, verdicts, tmp_path):
    df = table.join(verdicts, "filename", "left")
    job = Sweep(df, str(tmp_path), groups=["rf"], seeds=[1, 2], trees=2, depth=2)
    assert job.done() == set() and "mean_snr_median" not in job.columns
    for unit in (("repetition", "rf"), ("repetition", "baseline"), ("speed:8.0", "rf"), ("speed:8.0", "baseline")):
        job.run_unit(*unit, job.done(), speed=8.0 if unit[0].startswith("speed") else None)
    before = read_parts(spark, job.parts).count()
    assert before == 6
    job.run_unit("repetition", "rf", job.done())
    assert read_parts(spark, job.parts).count() == before
    report = job.report()
    presets = {(r["split"], r["model"]): r for r in report["preset_summary"].collect()}
    assert set(presets) == {("repetition", "RF"), ("repetition", "BASELINE")}
    speeds = report["loso_recall_by_speed"].collect()
    assert len(speeds) == 1 and speeds[0]["held_out_speed"] == 8.0 and speeds[0]["RF"] is not None
    per_speed = job.extrapolation().orderBy("speed").collect()
    assert [r["speed"] for r in per_speed] == [0.0, 8.0, 16.0]
    # A missing verdict is a miss here, one repetition in twenty.
    expected = df.where("scenario = 'A3' AND label = 'spoofed' AND param_2_value = 16").agg(
        F.avg(F.coalesce((F.col("baseline_pred") == 1).cast("int"), F.lit(0)))
    ).first()[0]
    assert per_speed[2]["BASELINE"] == pytest.approx(expected)
    study = {r["policy"]: r for r in job.threshold_study().collect()}
    assert set(study) == {"default_0.5", "val_max_f1", "fpr_target_0.01", "fpr_target_0.05", "oracle_test_ceiling"}
    assert study["oracle_test_ceiling"]["f1"] >= max(r["f1"] for r in study.values()) - 1e-12


def test_divergence_audit(spark, table):
    windows = table.where("label = 'spoofed'").select("noise", "speed_gap", "mean_snr_median")
    rows = divergence_audit(windows, table).collect()
    assert [r["feature"] for r in rows] == ["speed_gap", "noise"]
    assert divergence_audit(windows, table, top=1).count() == 1


def test_command_line(spark, recordings, table, tmp_path, monkeypatch):  # noqa: F811
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)
    config = tmp_path / "c.json"
    features, out = str(tmp_path / "features"), str(tmp_path / "out")
    config.write_text(json.dumps({"paths": {"features": features, "epochs_dir": str(tmp_path / "epochs"), "results_dir": out}}))
    cli.main(["extract-features", "--config", str(config), "--dataset-dir", str(recordings), "--profile", "deployable"])
    assert spark.read.parquet(features).count() == 11
    cli.main(["onset-check", "--config", str(config), "--dataset-dir", str(recordings), "--n", "1", "--out", str(tmp_path / "onset")])
    traces = spark.read.option("header", True).csv(str(tmp_path / "onset"))
    assert traces.columns == ["filename", "label", "seconds", "cog_deg", "sog_knots"]
    assert {r["label"] for r in traces.collect()} == {"spoofed", "unspoofed"} and {r["sog_knots"] for r in traces.collect()} <= {"11.0", None}
    table.write.parquet(str(tmp_path / "labelled"))
    cli.main(["audit", "--features", str(tmp_path / "labelled"), "--out", str(tmp_path / "audit")])
    assert spark.read.option("header", True).csv(str(tmp_path / "audit" / "single_feature_auc_screen.csv")).count() > 3
