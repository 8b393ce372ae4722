"""Train/test regimes over a feature table, as boolean columns ``is_train``/``is_test``."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, functions as F

# Repetition indices and the named holdout regions.
REPETITIONS = 20
TRAIN_REPETITIONS = tuple(range(0, 16))
TEST_REPETITIONS = tuple(range(16, 20))
HOLDOUT_PRESETS = {
    "a3_speed_low": dict(scenario="A3", param_name="shift_speed", test_max=16),
    "a3_speed_high": dict(scenario="A3", param_name="shift_speed", test_min=52),
    "a3_angle_band": dict(scenario="A3", param_name="shift_angle", test_min=60, test_max=120),
    "a2_delay_low": dict(scenario="A2", param_name="delay", test_max=0.06),
}
_BUCKETS = 4096


def repetition_split(
    df: DataFrame,
    train_indices: Iterable[int] = TRAIN_REPETITIONS,
    test_indices: Iterable[int] = TEST_REPETITIONS,
) -> DataFrame:
    index = F.col("index").cast("int")
    return df.withColumn("is_train", index.isin(*train_indices)).withColumn("is_test", index.isin(*test_indices))


def kfold_repetition(df: DataFrame, n_folds: int = 5) -> DataFrame:
    """Every row once per fold. Folds are contiguous repetitions of size ``20 // n_folds``.

    Repetitions left over by an uneven division are in no test side.
    """
    size = REPETITIONS // n_folds
    index = F.col("index").cast("int")
    spread = df.withColumn("fold", F.explode(F.array(*[F.lit(k) for k in range(n_folds)])))
    tested = (index >= F.col("fold") * size) & (index < (F.col("fold") + 1) * size)
    known = index.between(0, REPETITIONS - 1)
    return spread.withColumn("is_test", tested & known).withColumn("is_train", known & ~tested)


def param_value(param_name: str) -> Column:
    """Value of a named parameter from whichever slot holds it; the second slot wins."""
    return F.when(F.col("param_2_name") == param_name, F.col("param_2_value")).when(
        F.col("param_1_name") == param_name, F.col("param_1_value")
    )


def param_holdout(
    df: DataFrame,
    scenario: str,
    param_name: str,
    test_values: Iterable[float] | None = None,
    test_min: float | None = None,
    test_max: float | None = None,
    other_scenarios: str = "exclude",
) -> DataFrame:
    """Hold out a region of one scenario's parameter axis.

    The region is either explicit values or a range. Rows of the scenario inside it
    are tested, the others that carry the parameter are trained on; rows of other
    scenarios are left out or, with ``other_scenarios='train'``, added to training.
    """
    has_range = test_min is not None or test_max is not None
    if (test_values is not None) == has_range:
        raise ValueError("give either test_values or a test_min/test_max range")
    if other_scenarios not in ("exclude", "train"):
        raise ValueError("other_scenarios must be 'exclude' or 'train'")
    value = param_value(param_name)
    if test_values is not None:
        region = value.isin(*[float(v) for v in test_values])
    else:
        region = F.lit(True)
        if test_min is not None:
            region = region & (value >= test_min)
        if test_max is not None:
            region = region & (value <= test_max)
    region = F.coalesce(region & value.isNotNull(), F.lit(False))
    here = F.coalesce(F.col("scenario") == scenario, F.lit(False))
    train = here & ~region & value.isNotNull()
    if other_scenarios == "train":
        train = train | ~here
    return df.withColumn("is_train", train).withColumn("is_test", here & region)


def split_by_tag(df: DataFrame, tag: str) -> DataFrame:
    """``repetition``, ``preset:<name>`` or ``speed:<value>``."""
    kind, _, rest = tag.partition(":")
    if kind == "repetition" and not rest:
        return repetition_split(df)
    if kind == "preset":
        return param_holdout(df, **HOLDOUT_PRESETS[rest])
    if kind == "speed":
        return param_holdout(df, "A3", "shift_speed", test_values=[float(rest)])
    raise ValueError(f"unknown split {tag!r}")


def class_quota(class_sizes: dict, wanted: int) -> dict:
    """Whole numbers per class that add up to ``wanted``, nearest to proportional."""
    total = sum(class_sizes.values())
    shares = {c: wanted * n / total for c, n in class_sizes.items()}
    quota = {c: int(share) for c, share in shares.items()}
    by_remainder = sorted(shares, key=lambda c: (quota[c] - shares[c], str(c)))
    for c in by_remainder[: wanted - sum(quota.values())]:
        quota[c] += 1
    return quota


def stratified_pick(df: DataFrame, label: str, row_id: str, quota: dict, seed: int, name: str = "is_picked") -> DataFrame:
    """Mark exactly ``quota[class]`` rows of each class, chosen by a seeded hash of the row id.

    The hash is cut into equal buckets. Whole buckets below the quota are taken; the one bucket per
    class that straddles it is cut again, and only what straddles the quota there is
    ranked, so no class is ever sorted as a whole. Rows without a label, or of a class without a quota, are not picked.
    """
    code = F.xxhash64(F.lit(seed), F.col(row_id))
    room = F.lit(0)
    for value, n in quota.items():
        room = F.when(F.col(label) == value, F.lit(n)).otherwise(room)
    coarse = df.withColumn("_code", code).withColumn("_room", room.cast("long"))
    settled, open_ = _whole_buckets(coarse, label, F.pmod("_code", F.lit(_BUCKETS)), name)
    finer, rest = _whole_buckets(open_, label, F.pmod(F.shiftrightunsigned("_code", 16), F.lit(_BUCKETS)), name)
    rank = Window.partitionBy(label).orderBy("_code", row_id)
    last = rest.withColumn(name, F.row_number().over(rank) <= F.col("_room"))
    columns = [*df.columns, name]
    return settled.select(*columns).unionByName(finer.select(*columns)).unionByName(last.select(*columns))


def _whole_buckets(rows: DataFrame, label: str, bucket: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """Rows whose bucket lies wholly inside or outside the room of its class, marked, and the others with what room is left."""
    rows = rows.withColumn("_bucket", bucket)
    upto = Window.partitionBy("_class").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy(F.col(label).alias("_class"), F.col("_bucket").alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    plan = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(upto), F.lit(0)))
    # At most buckets x classes rows: bounded, whatever the data.
    joined = rows.join(F.broadcast(plan), F.col(label).eqNullSafe(F.col("_class")) & (F.col("_bucket") == F.col("_part")))
    joined = joined.withColumn("_room", F.col("_room") - F.col("_before"))
    straddles = (F.col("_room") > 0) & (F.col("_room") < F.col("_size"))
    extra = ("_class", "_part", "_size", "_before", "_bucket")
    return joined.where(~straddles).withColumn(name, F.col("_room") >= F.col("_size")), joined.where(straddles).drop(*extra)
