"""Split, preparation and distribution queries over ``orders`` and ``lineitem``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navspark.catalogue import Query, read, rounded
from navspark.operators.audit import ks_two_sample
from navspark.operators.ordered import column_quantiles, exact_quantiles, melt
from navspark.operators.prep import PrepOptions, correlation_matrix, fit_prep, iterative_corr_filter
from navspark.operators.splits import (
    class_quota,
    kfold_repetition,
    param_holdout,
    repetition_split,
    split_by_tag,
    stratified_pick,
)

# Orders read as recordings with scenario, label, repetition and two parameters.
META = {
    "filename": "CAST(o_orderkey AS STRING)",
    "scenario": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'A1' WHEN '2' THEN 'A2' ELSE 'A3' END",
    "label": "CASE WHEN o_orderstatus = 'F' THEN 'spoofed' ELSE 'unspoofed' END",
    "index": "CAST(o_orderkey % 20 AS INT)",
    "param_1_name": "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'distance' WHEN '2' THEN 'delay' ELSE 'shift_angle' END",
    "param_1_value": "CAST(o_custkey % 180 AS DOUBLE)",
    "param_2_name": "CASE WHEN o_totalprice < 20000 THEN NULL WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'time_difference' ELSE 'shift_speed' END",
    "param_2_value": "floor(o_totalprice / 6000e0)",
}


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(*[F.expr(sql).alias(name) for name, sql in META.items()])


META_SQL = "meta AS (SELECT " + ", ".join(f'{sql} AS "{name}"' for name, sql in META.items()) + " FROM orders)"
_SIDES = ["filename", "scenario", "is_train", "is_test"]


def split_repetition(spark, sf_dir):
    return repetition_split(recordings(spark, sf_dir)).select(*_SIDES)


SPLIT_REPETITION_SQL = f"""
WITH {META_SQL}
SELECT filename, scenario, "index" BETWEEN 0 AND 15 AS is_train, "index" BETWEEN 16 AND 19 AS is_test FROM meta"""


def split_kfold(spark, sf_dir):
    folds = kfold_repetition(recordings(spark, sf_dir), 3)
    return folds.groupBy("fold", "scenario").agg(
        F.count_if("is_train").alias("n_train"), F.count_if("is_test").alias("n_test")
    )


SPLIT_KFOLD_SQL = f"""
WITH {META_SQL}, folds AS (SELECT CAST(unnest([0, 1, 2]) AS INT) AS fold)
SELECT fold, scenario,
       count(*) FILTER (WHERE NOT ("index" >= fold * 6 AND "index" < (fold + 1) * 6)) AS n_train,
       count(*) FILTER (WHERE "index" >= fold * 6 AND "index" < (fold + 1) * 6) AS n_test
FROM meta CROSS JOIN folds GROUP BY fold, scenario"""


def split_param_holdout(spark, sf_dir):
    """A range, an angle band, explicit values, and a range with other scenarios trained on."""
    meta = recordings(spark, sf_dir)
    cases = {
        "low": split_by_tag(meta, "preset:a3_speed_low"),
        "band": split_by_tag(meta, "preset:a3_angle_band"),
        "one": split_by_tag(meta, "speed:7"),
        "joint": param_holdout(meta, "A3", "shift_speed", test_max=16, other_scenarios="train"),
    }
    parts = [df.select(F.lit(name).alias("regime"), *_SIDES) for name, df in cases.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


_SPEED = "CASE WHEN param_2_name = 'shift_speed' THEN param_2_value WHEN param_1_name = 'shift_speed' THEN param_1_value END"
_ANGLE = _SPEED.replace("shift_speed", "shift_angle")
SPLIT_HOLDOUT_SQL = f"""
WITH {META_SQL},
v AS (SELECT *, {_SPEED} AS speed, {_ANGLE} AS angle, scenario = 'A3' AS here FROM meta)
SELECT 'low' AS regime, filename, scenario, here AND coalesce(speed > 16, false) AS is_train, here AND coalesce(speed <= 16, false) AS is_test FROM v
UNION ALL
SELECT 'band', filename, scenario, here AND coalesce(NOT angle BETWEEN 60 AND 120, false), here AND coalesce(angle BETWEEN 60 AND 120, false) FROM v
UNION ALL
SELECT 'one', filename, scenario, here AND coalesce(speed <> 7, false), here AND coalesce(speed = 7, false) FROM v
UNION ALL
SELECT 'joint', filename, scenario, (here AND coalesce(speed > 16, false)) OR NOT here, here AND coalesce(speed <= 16, false) FROM v"""


def stratified_carve_out(spark, sf_dir):
    """A quarter of the rows, exact per class; reported as counts per class and side."""
    meta = recordings(spark, sf_dir)
    sizes = {r["label"]: r["count"] for r in meta.groupBy("label").count().collect()}
    wanted = -(-sum(sizes.values()) // 4)
    picked = stratified_pick(meta, "label", "filename", class_quota(sizes, wanted), seed=42)
    return picked.groupBy("label", "is_picked").agg(F.count(F.lit(1)).alias("n"))


STRATIFIED_SQL = f"""
WITH {META_SQL},
sizes AS (SELECT label, count(*) AS n, sum(count(*)) OVER () AS total FROM meta GROUP BY label),
shares AS (SELECT *, ceil(total / 4) AS wanted, ceil(total / 4) * n / total AS share FROM sizes),
quota AS (
  SELECT label, n, CAST(floor(share) + CASE WHEN row_number() OVER (ORDER BY share - floor(share) DESC, label)
         <= wanted - sum(floor(share)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS q FROM shares
)
SELECT label, true AS is_picked, q AS n FROM quota UNION ALL SELECT label, false, n - q FROM quota"""

# Line items read as numeric features, one of them with gaps and one skewed.
FEATURES = {
    "qty": "l_quantity",
    "price": "CASE WHEN l_discount > 0.085 THEN NULL ELSE l_extendedprice END",
    "disc": "l_discount",
    "tax": "l_tax",
    "cube": "l_extendedprice * l_extendedprice * l_extendedprice / 1e9",
    "flat": "l_tax * 0",
    "gaps": "CASE WHEN l_quantity < 30 THEN NULL ELSE l_quantity END",
    "pdop_like": "l_quantity / 7",
}
NUMERIC = list(FEATURES)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_shipdate",
        *[F.expr(sql).cast("double").alias(name) for name, sql in FEATURES.items()],
    )


FEATURES_SQL = (
    "feats AS (SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus, l_shipdate, "
    + ", ".join(f"CAST({sql} AS DOUBLE) AS {name}" for name, sql in FEATURES.items())
    + " FROM lineitem)"
)
_LONG_SQL = "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, l_returnflag, l_linestatus, {c} AS value FROM feats" for c in NUMERIC
) + ")"


def column_profile(spark, sf_dir):
    """NULL rate, sample deviation, population skewness and exact quantiles per column."""
    rows = features(spark, sf_dir)
    stats = rows.agg(
        *[F.expr(f"avg(CASE WHEN {c} IS NULL THEN 1.0D ELSE 0.0D END) AS {c}__null_rate") for c in NUMERIC],
        *[F.expr(f"stddev_samp({c}) AS {c}__std") for c in NUMERIC],
        *[F.expr(f"skewness({c}) AS {c}__skew") for c in NUMERIC],
    )
    cuts = column_quantiles(rows, [], NUMERIC, {"q01": 0.01, "median": 0.5, "q99": 0.99})
    both = stats.withColumn("_one", F.lit(1)).join(cuts.withColumn("_one", F.lit(1)), "_one")
    table = F.array(
        *[
            F.struct(
                F.lit(c).alias("feature"),
                *[F.col(f"{c}__{s}").alias(s) for s in ("null_rate", "std", "skew")],
                *[F.col(f"{c}_{q}").alias(q) for q in ("q01", "median", "q99")],
            )
            for c in NUMERIC
        ]
    )
    out = both.select(F.inline(table))
    # A constant column has no skewness; engines disagree between NULL and NaN.
    out = out.withColumn("skew", F.when(F.col("std") > 0, F.col("skew")))
    return rounded(out, ["null_rate", "std", "skew", "q01", "median", "q99"], 5)


COLUMN_PROFILE_SQL = f"""
WITH {FEATURES_SQL}, {_LONG_SQL},
m AS (SELECT feature, avg(value) AS mu FROM long GROUP BY feature),
s AS (
  SELECT feature, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS null_rate, stddev_samp(value) AS std,
         avg(pow(value - mu, 3)) AS m3, avg(pow(value - mu, 2)) AS m2,
         quantile_cont(value, 0.01) AS q01, median(value) AS median, quantile_cont(value, 0.99) AS q99
  FROM long JOIN m USING (feature) GROUP BY feature
)
SELECT feature, round(null_rate, 5) AS null_rate, round(std, 5) AS std, round(CASE WHEN std > 0 THEN m3 / pow(m2, 1.5) END, 5) AS skew,
       round(q01, 5) AS q01, round(median, 5) AS median, round(q99, 5) AS q99
FROM s"""

PREP = PrepOptions(max_null_rate=0.4, skew_limit=0.8, winsor_quantiles=(0.01, 0.99), correlation_limit=0.99)


def impute_clip_scale(spark, sf_dir):
    """Preparation fitted on the shipped lines ('F') and applied to all lines."""
    rows = features(spark, sf_dir)
    model = fit_prep(rows.where(F.col("l_linestatus") == "F"), NUMERIC, PREP)
    out = model.transform(rows.select("l_orderkey", "l_linenumber", *NUMERIC), scaled=True)
    return rounded(out, model.columns, 5)


IMPUTE_SQL = f"""
WITH {FEATURES_SQL},
fit AS (SELECT median(qty) AS qty, median(price) AS price, median(disc) AS disc, median(tax) AS tax, median(cube) AS cube FROM feats WHERE l_linestatus = 'F'),
filled AS (
  SELECT l_orderkey, l_linenumber, l_linestatus, coalesce(f.qty, fit.qty) AS qty, coalesce(f.price, fit.price) AS price,
         coalesce(f.disc, fit.disc) AS disc, coalesce(f.tax, fit.tax) AS tax,
         sign(coalesce(f.cube, fit.cube)) * ln(1 + abs(coalesce(f.cube, fit.cube))) AS cube
  FROM feats f, fit
),
cuts AS (SELECT {', '.join(f'quantile_cont({c}, {q}) AS {c}_{n}' for c in ('qty', 'price', 'disc', 'tax', 'cube') for n, q in (('lo', 0.01), ('hi', 0.99)))}
         FROM filled WHERE l_linestatus = 'F'),
clipped AS (SELECT l_orderkey, l_linenumber, l_linestatus, {', '.join(f'least(greatest({c}, {c}_lo), {c}_hi) AS {c}' for c in ('qty', 'price', 'disc', 'tax', 'cube'))}
            FROM filled, cuts),
mom AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_pop({c}) AS {c}_s' for c in ('qty', 'price', 'disc', 'tax', 'cube'))} FROM clipped WHERE l_linestatus = 'F')
SELECT l_orderkey, l_linenumber, {', '.join(f'round(({c} - {c}_m) / {c}_s, 5) AS {c}' for c in ('qty', 'price', 'disc', 'tax', 'cube'))}
FROM clipped, mom"""

_CORR = ["qty", "disc", "tax", "cube", "pdop_like"]


def corr_pairs(spark, sf_dir):
    """Absolute Pearson correlation of every pair of columns, from one pass."""
    matrix = correlation_matrix(features(spark, sf_dir), _CORR)
    cells = [
        (_CORR[i], _CORR[j], round(abs(float(matrix[i, j])), 6))
        for i in range(len(_CORR)) for j in range(i + 1, len(_CORR))
    ]
    return spark.createDataFrame(cells, "a string, b string, r double")


CORR_SQL = f"WITH {FEATURES_SQL} " + " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, round(abs(corr({a}, {b})), 6) AS r FROM feats"
    for i, a in enumerate(_CORR) for b in _CORR[i + 1:]
)


_DIMS = 64


def corr_pairs_wide(spark, sf_dir):
    """Correlation of every pair of vector components, each with gaps of its own: rows that have both count."""
    rows = read(spark, sf_dir, "embeddings").select(
        *[F.when(F.col("vec_id") % 7 != i % 7, F.get("embedding", F.lit(i)).cast("double")).alias(f"c{i}") for i in range(_DIMS)]
    )
    matrix = correlation_matrix(rows, rows.columns)
    cells = [(i, j, round(float(matrix[i, j]), 6)) for i in range(_DIMS) for j in range(i + 1, _DIMS)]
    return spark.createDataFrame(cells, "a long, b long, r double")


CORR_WIDE_SQL = f"""
WITH cells AS (
  SELECT vec_id, i, CAST(embedding[i + 1] AS DOUBLE) AS x FROM embeddings, range({_DIMS}) t(i) WHERE vec_id % 7 <> i % 7
)
SELECT p.i AS a, q.i AS b, round(corr(p.x, q.x), 6) AS r FROM cells p JOIN cells q ON p.vec_id = q.vec_id AND p.i < q.i GROUP BY ALL"""


def quantiles_with_empty_group(spark, sf_dir):
    """Quantiles per class; one class has no value at all and keeps its row."""
    rows = features(spark, sf_dir).select("l_returnflag", F.when(F.col("l_returnflag") != "N", F.col("cube")).alias("cube"))
    return rounded(exact_quantiles(rows, ["l_returnflag"], "cube", {"q10": 0.1, "median": 0.5, "q99": 0.99}), ["q10", "median", "q99"])


EMPTY_GROUP_SQL = f"""
WITH {FEATURES_SQL}, x AS (SELECT l_returnflag, CASE WHEN l_returnflag <> 'N' THEN cube END AS cube FROM feats)
SELECT l_returnflag, {', '.join(f'round(quantile_cont(cube, {q}), 6) AS {n}' for n, q in (('q10', 0.1), ('median', 0.5), ('q99', 0.99)))}
FROM x GROUP BY l_returnflag"""


def corr_filter(spark, sf_dir):
    """Columns an iterative correlation filter drops, in order, with near copies present."""
    rows = features(spark, sf_dir).select(
        *_CORR, (F.col("qty") * 2 + F.col("tax")).alias("qty_twice"), (F.col("cube") + F.col("disc")).alias("cube_near")
    )
    names = rows.columns
    dropped = iterative_corr_filter(names, correlation_matrix(rows, names))
    return spark.createDataFrame(list(enumerate(dropped)), "step long, feature string")


_FILTER_COLUMNS = {**{c: c for c in _CORR}, "qty_twice": "qty * 2 + tax", "cube_near": "cube + disc"}
_FILTER_PAIRS = " UNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, abs(corr({x}, {y})) AS r FROM feats"
    for a, x in _FILTER_COLUMNS.items() for b, y in _FILTER_COLUMNS.items() if a < b
)
CORR_FILTER_SQL = f"""
WITH RECURSIVE {FEATURES_SQL}, half AS MATERIALIZED ({_FILTER_PAIRS}),
m AS MATERIALIZED (SELECT a, b, r FROM half WHERE NOT isnan(r) UNION ALL SELECT b, a, r FROM half WHERE NOT isnan(r)),
steps AS (
  SELECT 0 AS step, CAST([] AS VARCHAR[]) AS dropped
  UNION ALL
  SELECT step + 1, list_append(dropped, next) FROM (
    SELECT step, dropped, arg_max(a, (mean, -place)) AS next FROM (
      SELECT step, dropped, a, sum(r) / (count(*) + 1) AS mean, max(r) AS top,
        list_position({sorted(_FILTER_COLUMNS)!r}, a) AS place
      FROM steps JOIN m ON NOT list_contains(dropped, a) AND NOT list_contains(dropped, b) GROUP BY step, dropped, a
    ) WHERE top > 0.95 GROUP BY step, dropped
  ) WHERE next IS NOT NULL
),
last AS (SELECT dropped FROM steps ORDER BY step DESC LIMIT 1)
SELECT CAST(unnest(range(len(dropped))) AS BIGINT) AS step, unnest(dropped) AS feature FROM last"""


def _ks(spark, sf_dir) -> DataFrame:
    """Lines of return flag A against all others."""
    long = melt(features(spark, sf_dir), ["l_returnflag"], NUMERIC)
    return ks_two_sample(long.withColumn("is_first", F.col("l_returnflag") == "A"))


def ks_two_sample_query(spark, sf_dir):
    return rounded(_ks(spark, sf_dir), ["ks_stat", "first_median", "second_median"])


_KS_SQL = f"""
WITH {FEATURES_SQL}, {_LONG_SQL},
x AS (SELECT feature, value, l_returnflag = 'A' AS a FROM long WHERE value IS NOT NULL),
n AS (SELECT feature, count(*) FILTER (WHERE a) AS n_first, count(*) FILTER (WHERE NOT a) AS n_second,
             median(value) FILTER (WHERE a) AS first_median, median(value) FILTER (WHERE NOT a) AS second_median FROM x GROUP BY feature),
c AS (SELECT feature, value, count(*) FILTER (WHERE a) AS ca, count(*) FILTER (WHERE NOT a) AS cb FROM x GROUP BY feature, value),
r AS (SELECT feature, sum(ca) OVER w AS ra, sum(cb) OVER w AS rb FROM c WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (
  SELECT feature, max(abs(ra / n_first - rb / n_second)) AS ks_stat, any_value(first_median) AS first_median,
         any_value(second_median) AS second_median, any_value(n_first) AS n_first, any_value(n_second) AS n_second
  FROM r JOIN n USING (feature) WHERE n_first >= 20 AND n_second >= 20 GROUP BY feature
)"""
_KS_COLS = "feature, round(ks_stat, 6) AS ks_stat, round(first_median, 6) AS first_median, round(second_median, 6) AS second_median, n_first, n_second"


def topn_ks(spark, sf_dir):
    """The three most divergent features (a top-k report)."""
    out = rounded(_ks(spark, sf_dir), ["ks_stat"]).select("feature", "ks_stat")
    return out.orderBy(F.col("ks_stat").desc(), "feature").limit(3)


def sweep_pivot(spark, sf_dir):
    """Mean of a rate by year and class, classes as columns."""
    rows = features(spark, sf_dir).select(F.year("l_shipdate").cast("long").alias("held_out"), "l_returnflag", "disc")
    out = rows.groupBy("held_out").pivot("l_returnflag", ["A", "N", "R"]).agg(F.avg("disc"))
    return rounded(out, ["A", "N", "R"])


SWEEP_PIVOT_SQL = f"""
WITH {FEATURES_SQL}
SELECT year(l_shipdate) AS held_out, {', '.join(f"round(avg(disc) FILTER (WHERE l_returnflag = '{f}'), 6) AS {f}" for f in 'ANR')}
FROM feats GROUP BY 1"""


def group_summary(spark, sf_dir):
    """Mean and sample deviation per group, as in fold and preset summaries."""
    rows = features(spark, sf_dir)
    out = rows.groupBy("l_returnflag", "l_linestatus").agg(
        *[agg for c in ("qty", "disc", "tax") for agg in (F.avg(c).alias(f"{c}_mean"), F.stddev_samp(c).alias(f"{c}_std"))],
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("price").isNull()).alias("n_excluded"),
    )
    return rounded(out, [f"{c}_{s}" for c in ("qty", "disc", "tax") for s in ("mean", "std")])


GROUP_SUMMARY_SQL = f"""
WITH {FEATURES_SQL}
SELECT l_returnflag, l_linestatus, {', '.join(f'round(avg({c}), 6) AS {c}_mean, round(stddev_samp({c}), 6) AS {c}_std' for c in ('qty', 'disc', 'tax'))},
       count(*) AS n, count(*) FILTER (WHERE price IS NULL) AS n_excluded
FROM feats GROUP BY ALL"""

QUERIES = {
    "split_repetition": Query(split_repetition, SPLIT_REPETITION_SQL),
    "split_kfold": Query(split_kfold, SPLIT_KFOLD_SQL),
    "split_param_holdout": Query(split_param_holdout, SPLIT_HOLDOUT_SQL),
    "stratified_carve_out": Query(stratified_carve_out, STRATIFIED_SQL),
    "column_profile": Query(column_profile, COLUMN_PROFILE_SQL),
    "impute_clip_scale": Query(impute_clip_scale, IMPUTE_SQL),
    "corr_pairs": Query(corr_pairs, CORR_SQL),
    "corr_pairs_wide": Query(corr_pairs_wide, CORR_WIDE_SQL),
    "quantiles_with_empty_group": Query(quantiles_with_empty_group, EMPTY_GROUP_SQL),
    "corr_filter": Query(corr_filter, CORR_FILTER_SQL),
    "ks_two_sample": Query(ks_two_sample_query, f"{_KS_SQL} SELECT {_KS_COLS} FROM ks"),
    "topn_ks": Query(topn_ks, f"{_KS_SQL} SELECT feature, round(ks_stat, 6) AS ks_stat FROM ks ORDER BY 2 DESC, 1 LIMIT 3"),
    "sweep_pivot": Query(sweep_pivot, SWEEP_PIVOT_SQL),
    "group_summary": Query(group_summary, GROUP_SUMMARY_SQL),
}
