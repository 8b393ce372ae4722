import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from navspark.functions.geo import M_PER_DEG_LAT, haversine_m
from navspark.operators import splits as sp
from navspark.operators.audit import audit, family_summary, ks_two_sample, zero_intensity_separators
from navspark.operators.inject import inject
from navspark.operators import intervals
from navspark.operators.intervals import base_rate_analysis, error_tail
from navspark.operators.metrics import confusion_metrics, roc_auc
from navspark.operators.ordered import column_quantiles, exact_quantiles, running_totals
from navspark.operators.prep import LIGHT, PrepOptions, correlation_matrix, fit_prep, iterative_corr_filter, skewness_after_fill
from navspark.operators.thresholds import evaluate_thresholds, max_f1_threshold, pick_threshold


def frame(spark, pdf):
    clean = pdf.astype(object).where(pdf.notna(), None)
    kinds = {"i": "bigint", "f": "double", "O": "string", "b": "boolean"}
    schema = ", ".join(f"`{c}` {kinds[pdf[c].dtype.kind]}" for c in pdf.columns)
    return spark.createDataFrame([tuple(r) for r in clean.itertuples(index=False)], schema)


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(5)
    n = 900
    pdf = pd.DataFrame({"g": rng.choice(["a", "b"], n, p=[0.8, 0.2]), "y": rng.integers(0, 2, n).astype(int)})
    # Many ties at one value, a continuous rest and heavy tails.
    pdf["score"] = np.where(rng.random(n) < 0.3, 0.25, rng.standard_cauchy(n) * 0.1 + pdf.y * 0.2).round(3)
    pdf.loc[::50, "score"] = np.nan
    return pdf


def pairwise_auc(part):
    part = part.dropna()
    p, n = part[part.y == 1].score.to_numpy(), part[part.y == 0].score.to_numpy()
    return np.mean((p[:, None] > n[None, :]) + 0.5 * (p[:, None] == n[None, :]))


def test_auc_is_the_pairwise_probability(spark, scores):
    got = {r["g"]: r["auc"] for r in roc_auc(frame(spark, scores), ["g"]).collect()}
    for g, part in scores.groupby("g"):
        assert got[g] == pytest.approx(pairwise_auc(part), abs=1e-12)
    whole = roc_auc(frame(spark, scores), []).first()["auc"]
    assert whole == pytest.approx(pairwise_auc(scores), abs=1e-12)
    single = roc_auc(frame(spark, scores[scores.y == 1]), []).first()["auc"]
    assert single is None


def test_quantiles_match_numpy(spark, scores):
    probs = {"lo": 0.01, "mid": 0.5, "hi": 0.99, "top": 1.0}
    df = frame(spark, scores)
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "score", probs).collect()}
    for g, part in scores.groupby("g"):
        for name, p in probs.items():
            assert got[g][name] == pytest.approx(np.quantile(part.score.dropna(), p), abs=1e-12)
    row = exact_quantiles(df, [], "score", probs).first()
    assert row["mid"] == pytest.approx(np.nanmedian(scores.score), abs=1e-12)
    wide = column_quantiles(df, [], ["score", "y"], {"m": 0.5}).first()
    assert wide["score_m"] == pytest.approx(np.nanmedian(scores.score)) and wide["y_m"] == np.median(scores.y)


def test_groups_without_values_keep_their_row(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 5.0), (None, None)], "g string, v double")
    got = {r["g"]: r["m"] for r in exact_quantiles(df, ["g"], "v", {"m": 0.5}).collect()}
    assert got == {"a": 1.5, "b": None, None: 5.0}
    assert exact_quantiles(df.where("false"), [], "v", {"m": 0.5}).first()["m"] is None


def test_correlation_with_gaps_and_small_spread(spark):
    rng = np.random.default_rng(5)
    grid = rng.normal(size=(300, 20))
    grid[:, 1] = 1 + 1e-8 * (grid[:, 0] + grid[:, 1])
    grid[:, 2] = 7.0
    pdf = pd.DataFrame(grid, columns=[f"c{i}" for i in range(20)])
    holes = rng.random((300, 17)) < 0.3
    pdf.iloc[:, 3:] = pdf.iloc[:, 3:].mask(holes)
    got = correlation_matrix(frame(spark, pdf), list(pdf.columns))
    want = pdf.corr().to_numpy()
    assert np.isnan(got[2, [0, 1, 3]]).all() and got[0, 1] == pytest.approx(want[0, 1], abs=1e-6)
    rest = [i for i in range(20) if i != 2]
    assert np.allclose(got[np.ix_(rest, rest)], want[np.ix_(rest, rest)], atol=1e-6)


def test_running_totals_across_ranges(spark):
    pdf = pd.DataFrame({"g": ["a"] * 500, "v": np.arange(500.0), "c": np.arange(500)})
    got = running_totals(frame(spark, pdf), ["g"], "v", ["c"]).orderBy("v").toPandas()
    assert list(got.c_upto) == list(np.cumsum(pdf.c))


def ks_by_hand(a, b):
    grid = np.concatenate([a, b])
    return max(abs((a <= x).mean() - (b <= x).mean()) for x in grid)


def test_ks(spark):
    rng = np.random.default_rng(1)
    parts = []
    for name, na, nb in (("x", 120, 75), ("few", 19, 50), ("edge", 20, 20)):
        parts.append(pd.DataFrame({"feature": name, "value": rng.normal(0, 1, na).round(2), "is_first": True}))
        parts.append(pd.DataFrame({"feature": name, "value": rng.normal(0.3, 2, nb).round(2), "is_first": False}))
    pdf = pd.concat(parts, ignore_index=True)
    got = {r["feature"]: r for r in ks_two_sample(frame(spark, pdf)).collect()}
    assert set(got) == {"x", "edge"}
    for name in got:
        a = pdf[(pdf.feature == name) & pdf.is_first].value.to_numpy()
        b = pdf[(pdf.feature == name) & ~pdf.is_first].value.to_numpy()
        assert got[name]["ks_stat"] == pytest.approx(ks_by_hand(a, b), abs=1e-12)
        assert got[name]["first_median"] == pytest.approx(np.median(a))
        assert got[name]["second_median"] == pytest.approx(np.median(b))


def test_thresholds(spark, scores):
    part = scores.dropna()
    df = frame(spark, part)
    best = None
    for t in sorted(part.score.unique()):
        flagged = part.score >= t
        tp = (flagged & (part.y == 1)).sum()
        p, r = tp / flagged.sum(), tp / (part.y == 1).sum()
        f1 = 2 * p * r / max(p + r, 1e-12)
        if best is None or f1 > best[0] + 1e-15:
            best = (f1, t)
    assert max_f1_threshold(df, []).first()["threshold"] == best[1]
    assert pick_threshold(df, "fpr_target", 0.05) == pytest.approx(
        np.quantile(part[part.y == 0].score, 0.95), abs=1e-12
    )
    assert pick_threshold(df, "default") == 0.5
    assert pick_threshold(df.where("y = 1"), "fpr_target") == 0.5
    with pytest.raises(ValueError):
        pick_threshold(df, "other")
    rows = {r["policy"]: r for r in evaluate_thresholds(df, {"a": 0.25, "b": 9e9}).collect()}
    assert rows["a"]["tp"] == int(((part.score >= 0.25) & (part.y == 1)).sum()) and rows["b"]["f1"] == 0.0


def test_confusion(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1), (1, 0)], "y int, pred int")
    row = confusion_metrics(df, []).first()
    assert (row["tn"], row["fp"], row["fn"], row["tp"]) == (1, 1, 1, 2)
    assert row["precision"] == pytest.approx(2 / 3) and row["fpr"] == 0.5 and row["accuracy"] == 0.6
    none = confusion_metrics(df.where("y = 0").withColumn("pred", F.lit(0)), []).first()
    assert none["precision"] == none["recall"] == none["f1"] == 0.0


def labelled_table():
    rng = np.random.default_rng(9)
    rows = []
    for scen, p1, p2 in (("A1", "distance", "time_difference"), ("A3", "shift_angle", "shift_speed")):
        for speed in range(0, 76, 4):
            for rep in range(20):
                for label in ("spoofed", "unspoofed"):
                    hit = label == "spoofed"
                    rows.append(
                        {"filename": f"{scen}-{speed}-{rep}-{label}", "scenario": scen, "label": label, "index": rep,
                         "param_1_name": p1, "param_1_value": float(rng.integers(0, 180)) * (speed > 0),
                         "param_2_name": p2, "param_2_value": float(speed),
                         "mean_snr_median": 41.0 + 0.07 * hit + 0.001 * rng.random(), "pdop_mean": 1.5,
                         "speed_gap": rng.normal(0.05 * speed * hit, 1.0), "noise": rng.normal(),
                         "gappy": rng.normal() if rng.random() < 0.7 else np.nan, "void": np.nan}
                    )
    return pd.DataFrame(rows)


@pytest.fixture(scope="module")
def table(spark):
    return frame(spark, labelled_table()).cache()


def test_splits(table):
    n = table.count()
    rep = sp.repetition_split(table)
    assert rep.where("is_test").count() == n * 4 // 20 and rep.where("is_test AND is_train").count() == 0
    assert rep.where("is_test OR is_train").count() == n
    folds = sp.kfold_repetition(table)
    assert folds.where("is_test").count() == n and folds.count() == 5 * n
    three = sp.kfold_repetition(table, 3)
    assert three.where("is_test AND index >= 18").count() == 0
    low = sp.split_by_tag(table, "preset:a3_speed_low")
    assert low.where("is_test").count() == 200 and low.where("is_train").count() == 560
    assert low.where("is_test AND is_train").count() == 0
    assert low.where("is_test").select("label").distinct().count() == 2
    assert low.where("(is_test OR is_train) AND scenario = 'A1'").count() == 0
    joint = sp.param_holdout(table, other_scenarios="train", **sp.HOLDOUT_PRESETS["a3_speed_low"])
    assert joint.where("is_train AND scenario = 'A1'").count() == n // 2
    one = sp.split_by_tag(table, "speed:8.0")
    assert {r[0] for r in one.where("is_test").select("param_2_value").distinct().collect()} == {8.0}
    for bad in (dict(), dict(test_values=[1], test_max=2), dict(test_max=1, other_scenarios="x")):
        with pytest.raises(ValueError):
            sp.param_holdout(table, "A3", "shift_speed", **bad)
    with pytest.raises(ValueError):
        sp.split_by_tag(table, "other")


def test_stratified_pick_is_exact_and_stable(table):
    quota = sp.class_quota({"spoofed": 760, "unspoofed": 760}, 381)
    assert sum(quota.values()) == 381
    first = sp.stratified_pick(table, "label", "filename", quota, seed=1)
    got = {r["label"]: r["count"] for r in first.where("is_picked").groupBy("label").count().collect()}
    assert got == quota and first.count() == table.count()
    again = sp.stratified_pick(table.repartition(5), "label", "filename", quota, seed=1)
    assert first.exceptAll(again.select(*first.columns)).count() == 0
    other = sp.stratified_pick(table, "label", "filename", quota, seed=2)
    assert first.where("is_picked").join(other.where("is_picked"), "filename").count() < 200
    gaps = table.withColumn("label", F.when(F.col("index") > 0, F.col("label")))
    kept = sp.stratified_pick(gaps, "label", "filename", {"spoofed": 100}, seed=1)
    assert kept.count() == table.count()
    assert [(r["label"], r["count"]) for r in kept.where("is_picked").groupBy("label").count().collect()] == [("spoofed", 100)]


def test_audit(spark, table):
    rows = {r["feature"]: r for r in audit(table).collect()}
    assert rows["mean_snr_median"]["oracle_any_scenario"] and rows["mean_snr_median"]["family"] == "snr"
    assert rows["mean_snr_median"]["A3"] == 1.0 and rows["mean_snr_median"]["zero_intensity_separator"]
    assert rows["pdop_mean"]["overall"] is None and rows["void"]["overall"] is None
    pdf = labelled_table()
    zero = pdf[(pdf.scenario == "A3") & (pdf.param_2_value == 0)]
    a = pairwise_auc(pd.DataFrame({"y": (zero.label == "spoofed").astype(int), "score": zero.speed_gap}))
    assert rows["speed_gap"]["A3_speed0"] == pytest.approx(max(a, 1 - a), abs=1e-12)
    filled = pdf.gappy.fillna(pdf.gappy.median())
    a = pairwise_auc(pd.DataFrame({"y": (pdf.label == "spoofed").astype(int), "score": filled}))
    assert rows["gappy"]["overall"] == pytest.approx(max(a, 1 - a), abs=1e-12)
    assert "A1_zero" in rows["noise"].asDict()
    found = audit(table.select(*[c for c in table.columns if c not in ("gappy", "void", "noise")]))
    summary = {r["family"]: r for r in family_summary(found).collect()}
    assert summary["snr"]["overall"] == 1.0 and summary["gsa"]["overall"] is None
    assert zero_intensity_separators(found).first()["feature"] == "mean_snr_median"


def prep_table():
    rng = np.random.default_rng(3)
    n = 400
    base = rng.normal(0, 1, n)
    pdf = pd.DataFrame(
        {"base": base, "copy_b": base * 2 + rng.normal(0, 0.01, n), "copy_a": -base + rng.normal(0, 0.2, n),
         "skewed": np.exp(rng.normal(0, 2.5, n)), "gappy": rng.normal(5, 1, n), "sparse": rng.normal(0, 1, n),
         "flat": 3.0, "mean_snr_x": rng.normal(0, 1, n), "solo": rng.uniform(0, 1, n)}
    )
    pdf.loc[rng.random(n) < 0.2, ["gappy", "skewed"]] = np.nan
    pdf.loc[rng.random(n) < 0.7, "sparse"] = np.nan
    return pdf


def prep_by_hand(pdf, options):
    x = pdf.drop(columns=["mean_snr_x", "flat", "sparse"])
    x = x.fillna(x.median())
    centred = x - x.mean()
    skew = (centred**3).mean() / (centred**2).mean() ** 1.5
    for c in skew[skew.abs() > options.skew_limit].index:
        x[c] = np.sign(x[c]) * np.log1p(x[c].abs())
    x = x.clip(x.quantile(0.01), x.quantile(0.99), axis=1)
    return x, skew


def test_preparation(spark):
    pdf = prep_table()
    options = PrepOptions()
    df = frame(spark, pdf.assign(id=range(len(pdf))))
    model = fit_prep(df, list(pdf.columns), options)
    x, skew = prep_by_hand(pdf, options)
    steps = {r["step"]: r["columns"] for r in model.log}
    assert steps["artifact_ablation"] == "mean_snr_x" and steps["zero_variance"] == "flat"
    assert steps["nan_columns"] == "sparse" and steps["log_transform"] == "skewed"
    assert abs(skew["skewed"]) > 5
    dropped = steps["correlation_iterative"].split(",")
    assert dropped == iterative_corr_filter(list(x.columns), x.corr().to_numpy())
    kept = [c for c in x.columns if c not in dropped]
    assert model.columns == kept and len(kept) == len(x.columns) - 2
    got = model.transform(df).orderBy("id").toPandas()
    assert np.allclose(got[kept].to_numpy(dtype=float), x[kept].to_numpy(), atol=1e-9)
    scaled = model.transform(df, scaled=True).orderBy("id").toPandas()
    z = (x[kept] - x[kept].mean()) / x[kept].std(ddof=0)
    assert np.allclose(scaled[kept].to_numpy(dtype=float), z.to_numpy(), atol=1e-9)


def test_preparation_never_looks_at_test_rows(spark):
    pdf = prep_table()
    train = frame(spark, pdf)
    model = fit_prep(train, list(pdf.columns), LIGHT)
    wild = frame(spark, pdf.assign(gappy=np.nan, solo=1e6))
    out = model.transform(wild).toPandas()
    assert set(out.gappy) == {pdf.gappy.median()} and set(out.solo) == {1e6}


def test_skewness_after_fill():
    x = np.array([1.0, 2.0, 7.0, 9.0, 30.0])
    m2 = x.var()
    profile = {"n": 5, "rows": 8, "mean": x.mean(), "m2": m2, "skew": ((x - x.mean()) ** 3).mean() / m2**1.5, "median": 7.0}
    full = np.r_[x, 7.0, 7.0, 7.0]
    expected = ((full - full.mean()) ** 3).mean() / full.var() ** 1.5
    assert skewness_after_fill(profile) == pytest.approx(expected, abs=1e-12)


def test_corr_filter_ties_go_to_the_smaller_name():
    matrix = np.array([[1, 0.99, 0.0], [0.99, 1, 0.0], [0.0, 0.0, 1]])
    assert iterative_corr_filter(["time_delta_std", "clock_regularity", "x"], matrix) == ["clock_regularity"]
    assert iterative_corr_filter(["a", "b"], np.array([[1, np.nan], [np.nan, 1]])) == []


def _over(spark, rows, schema, column):
    """Values of a column expression, in the order of the rows; null is NaN."""
    numbered = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rows)], f"i int, {schema}")
    out = [list(r) for r in numbered.select("i", *column).orderBy("i").drop("i").collect()]
    return [np.array([math.nan if v is None else v for v in c]) for c in zip(*out, strict=True)]


@pytest.fixture
def exact_interval(spark):
    def ends(hits, trials, alpha=0.05):
        both = intervals.exact_interval(F.col("k"), F.col("n"), alpha)
        return _over(spark, list(zip(hits, trials, strict=True)), "k double, n double", [both["low"].alias("low"), both["high"].alias("high")])

    return ends


@pytest.fixture
def mcnemar_p(spark):
    def values(first, second):
        p = intervals.mcnemar_p(F.col("a"), F.col("b")).alias("p")
        return _over(spark, list(zip(first, second, strict=True)), "a double, b double", [p])[0]

    return values


def test_error_tail(spark):
    z = [0.0, 1e-9, 0.3, 1.0, 1.999, 2.0, 2.5, 6.0, 20.0]
    found = _over(spark, [(x,) for x in z], "z double", [error_tail(F.col("z")).alias("t")])[0]
    assert found == pytest.approx([math.erfc(x) for x in z], rel=1e-12)


def test_corr_filter_equals_looking_at_everything():
    draw = np.random.default_rng(12)
    for _ in range(60):
        p = int(draw.integers(1, 9))
        r = np.round(draw.choice([0.0, 0.3, 0.96, 0.97, 0.99], (p, p)) * draw.choice([-1, 1], (p, p)), 2)
        r = np.triu(r, 1) + np.triu(r, 1).T + np.eye(p)
        if p > 2 and draw.random() < 0.3:
            r[0, 1] = r[1, 0] = np.nan
        names = [f"n{i}" for i in draw.permutation(p)]
        left, expected = set(range(p)), []
        while True:
            pairs = [i for i in left if any(j != i and abs(r[i, j]) > 0.95 for j in left)]
            if not pairs:
                break
            mean = lambda i: sum(abs(r[i, j]) for j in left if j != i and r[i, j] == r[i, j]) / sum(r[i, j] == r[i, j] for j in left)
            best = max(round(mean(i), 9) for i in pairs)
            gone = min((i for i in pairs if round(mean(i), 9) == best), key=lambda i: names[i])
            expected.append(names[gone])
            left.remove(gone)
        assert iterative_corr_filter(names, r) == expected


def test_intervals_invert_the_binomial_tails(exact_interval):
    for k, n in ((1, 2), (4, 31), (77, 150), (640, 641)):
        (lo,), (hi,) = exact_interval([k], [n])
        term = lambda p, i: math.comb(n, i) * p**i * (1 - p) ** (n - i)
        assert sum(term(lo, i) for i in range(k, n + 1)) == pytest.approx(0.025, abs=1e-9)
        assert sum(term(hi, i) for i in range(k + 1)) == pytest.approx(0.025, abs=1e-9)
    low, high = exact_interval([0, 7, 0], [9, 7, 0], alpha=0.1)
    # Closed forms at the ends: (1 - p) ** 9 = 0.05 and p ** 7 = 0.05.
    assert low[0] == 0 and high[0] == pytest.approx(1 - 0.05 ** (1 / 9), abs=1e-12)
    assert high[1] == 1 and low[1] == pytest.approx(0.05 ** (1 / 7), abs=1e-12)
    assert np.isnan([low[2], high[2]]).all()
    # A billion trials: the normal limit.
    (lo,), (hi,) = exact_interval([500_000_000], [1_000_000_000])
    assert hi - lo == pytest.approx(2 * 1.959963985 * 0.5 / math.sqrt(1e9), rel=1e-4)


def test_mcnemar(mcnemar_p):
    sure, even = mcnemar_p([0, 1], [6, 1])
    assert sure == pytest.approx(2 / 64) and even == 1.0
    assert mcnemar_p([0], [0])[0] == 1.0
    z = (abs(40 - 71) - 1) / math.sqrt(111)
    assert mcnemar_p([71], [40])[0] == pytest.approx(math.erfc(z / math.sqrt(2)))
    for a in range(0, 25, 6):
        b = 24 - a
        tail = 2 * sum(math.comb(24, i) for i in range(min(a, b) + 1)) / 2**24
        assert mcnemar_p([a], [b])[0] == pytest.approx(min(1.0, tail), abs=1e-14)
    # As many of either kind: the correction oversteps by one, and a p-value stays one.
    assert mcnemar_p([30], [30])[0] == pytest.approx(math.erfc(1 / math.sqrt(120)))


def test_base_rates(spark):
    counts = spark.createDataFrame([("x", 4300, 0, 5, 95), ("y", 0, 0, 1, 1)], "classifier string, tn long, fp long, fn long, tp long")
    rows = {(r["classifier"], r["prevalence"]): r for r in base_rate_analysis(counts, ["classifier"]).collect()}
    assert len(rows) == 10
    r = rows[("x", 0.001)]
    assert r["precision_at_prevalence"] == 1.0 and r["precision_lo"] < 0.6 and r["precision_hi"] == 1.0
    assert rows[("y", 0.5)]["fpr"] is None and rows[("y", 0.5)]["tpr"] == 0.5


def test_injection(spark):
    east = 4.0 / (M_PER_DEG_LAT * math.cos(math.radians(40.0)))
    rows = [
        (rec, rx, 1000.0 + i, 40.0 + i * 3.0 / M_PER_DEG_LAT, -70.0 + (east if rx == 2 else 0.0))
        for rec in ("p", "q") for i in range(120) for rx in (1, 2)
    ]
    clean = spark.createDataFrame(rows, "recording string, receiver int, utc_time double, lat_deg double, lon_deg double")
    attacked = inject(clean, ["recording"], "drift", drift_mps=0.5, onset_frac=0.5, seed=1)
    pdf = attacked.toPandas()
    onset = pdf.onset_utc.iloc[0]
    assert onset == 1000.0 + 0.5 * 119

    def gap(df, t, rec="p"):
        a = df[(df.utc_time == t) & (df.recording == rec)].sort_values("receiver")
        (la, lo), (lb, lb2) = a[["lat_deg", "lon_deg"]].to_numpy()
        return spark.range(1).select(haversine_m(*[F.lit(float(v)) for v in (la, lo, lb, lb2)])).first()[0]

    assert 3.5 < gap(pdf, 1010.0) < 4.5 and gap(pdf, 1110.0) < 2.0
    both = attacked.alias("a").join(clean.alias("c"), ["recording", "receiver", "utc_time"])
    moved = both.where("receiver = 1 AND utc_time = 1119.0").select(
        haversine_m(*[F.col(c) for c in ("c.lat_deg", "c.lon_deg", "a.lat_deg", "a.lon_deg")])
    ).first()[0]
    assert moved == pytest.approx(0.5 * (1119.0 - onset), abs=2.0)
    again = inject(clean.repartition(6), ["recording"], "drift", drift_mps=0.5, onset_frac=0.5, seed=1).toPandas()
    order = ["recording", "receiver", "utc_time"]
    assert pdf.sort_values(order).lat_deg.to_list() == again.sort_values(order).lat_deg.to_list()
    noise = inject(clean, ["recording"], "drift", drift_mps=0.0, capture_sigma_m=2.0, onset_frac=0.0, seed=3).toPandas()
    two = noise[noise.receiver == 2].sort_values(order).lat_deg.to_numpy()
    one = noise[noise.receiver == 1].sort_values(order).lat_deg.to_numpy()
    assert np.std((two - one) * M_PER_DEG_LAT) == pytest.approx(2.0, rel=0.25)
    replay = inject(clean, ["recording"], "replay", offset_m=50.0, seed=1).toPandas()
    assert gap(replay, 1110.0) < 2.0
    with pytest.raises(ValueError):
        inject(clean, ["recording"], "jam")
