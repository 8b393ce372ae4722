"""Vessel archives that log each sentence family to its own daily file.

``COM18-CNAV-GGA-RAW_20180529-000001.raw`` holds only GGA. VTG has no UTC field, so
it is attached by clock: the device's logging latency is the median of (external
clock - UTC) over the anchor lines, and each VTG goes to the nearest epoch.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from navspark.functions.clock import absolute_utc, split_log_lines
from navspark.functions.nmea import ANCHORS, FIELD_SOURCES, parse_sentences
from navspark.operators.asof import nearest_asof
from navspark.operators.epochs import canonical_motion
from navspark.operators.ordered import exact_quantiles
from navspark.session import stage
from navspark.sources.textlog import read_lines

# File name layout, families and their roles.
FILE_NAME = r"(?i)/(COM\d+)-([A-Za-z0-9]+)-([A-Z]{3})-RAW_(\d{8}-\d{6})(_\d+)?\.raw$"
ANCHOR_FAMILIES = ("GGA", "RMC")
ATTACH_FAMILIES = ("VTG",)
FAMILIES = ANCHOR_FAMILIES + ATTACH_FAMILIES
ATTACH_TOL_S = 0.6
ATTACHABLE = ("RMC", "GGA", "GSA", "VTG")


def discover_files(spark: SparkSession, device_dir: str, families=FAMILIES) -> DataFrame:
    """``family, stamp, path`` of the files to read, one copy per family and stamp.

    Downloads contain ``_2`` copies; the plain name wins over a suffixed one.
    """
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(device_dir)
        .select(F.col("_metadata.file_path").alias("path"))
    )
    named = listing.select(
        "path",
        F.upper(F.regexp_extract("path", FILE_NAME, 3)).alias("family"),
        F.regexp_extract("path", FILE_NAME, 4).alias("stamp"),
        (F.regexp_extract("path", FILE_NAME, 5) != "").alias("_copy"),
    ).where(F.col("family").isin(*families))
    best = Window.partitionBy("family", "stamp").orderBy("_copy", "path")
    return named.withColumn("_rank", F.row_number().over(best)).where("_rank = 1").select("family", "stamp", "path")


def read_device_lines(spark: SparkSession, device_dir: str, families=FAMILIES) -> DataFrame:
    """Lines of the discovered files with ``family`` and ``stamp`` from the file name.

    A pattern of file names keeps the scan off the many families nobody asks for; the
    copies among the rest are left out by a join with the files chosen.
    """
    def caseless(text: str) -> str:
        return "".join(f"[{c.upper()}{c.lower()}]" for c in text)

    names = ",".join(caseless(f) for f in families)
    lines = read_lines(spark, device_dir, recursive=True, names=f"*-{{{names}}}-{caseless('RAW')}_*.{caseless('raw')}")
    chosen = discover_files(spark, device_dir, families)
    return lines.join(chosen, "path")


def earliest_per_bucket(rows: DataFrame, by: list[str], on: str, bucket_s: float = 1.0) -> DataFrame:
    """One row per bucket: the earliest. Others are dropped, not merged."""
    first = Window.partitionBy(*[F.col(c) for c in by], F.floor(F.col(on) / bucket_s)).orderBy(on)
    return rows.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")


def split_family_epochs(
    lines: DataFrame,
    by: list[str],
    validate_checksums: bool = True,
    decimate_1hz: bool = True,
    attach_tol: float = ATTACH_TOL_S,
) -> tuple[DataFrame, DataFrame]:
    """Epochs and per-device statistics (``lag_s, attached, attach_dropped, n_epochs``).

    Latency, epoch grid, attachment and statistics all start from the parsed lines, so
    these and the grid are written once instead of being parsed again for each.
    """
    parsed = parse_sentences(split_log_lines(lines), validate_checksums=validate_checksums)
    rows = stage(parsed.drop("line", "snrs"), "sentences")
    readable = rows.where(F.col("family").isin(*ANCHOR_FAMILIES) & F.col("source").isin(*ANCHORS))
    anchors = readable.withColumn(
        "utc_time", absolute_utc(F.col("utc_of_day"), F.col("ext_clock"))
    ).where(F.col("utc_time").isNotNull())

    lags = exact_quantiles(
        anchors.select(*by, (F.col("ext_clock") - F.col("utc_time")).alias("_offset")),
        by, "_offset", {"lag_s": 0.5},
    ).withColumn("lag_s", F.coalesce("lag_s", F.lit(0.0)))
    # One row per device; written, its real size decides how it is joined.
    lags = stage(lags, "lags")

    # RMC files are read after GGA files and overwrite them. One shuffle on the second
    # serves numbering, merging and decimation alike.
    seconds = anchors.withColumn("_second", F.floor("utc_time"))
    family_rank = F.when(F.col("family") == "RMC", F.lit(1)).otherwise(F.lit(0))
    order = Window.partitionBy(*by, "_second").orderBy(family_rank, "stamp", "path", "block", "row")
    numbered = seconds.withColumn("seq", F.row_number().over(order))
    merged = numbered.groupBy(*by, "_second", "utc_time").agg(
        *[
            F.max_by(F.col(name), F.when(F.col("source").isin(*sources), F.col("seq"))).alias(name)
            for name, sources in FIELD_SOURCES.items()
        ],
        F.max(F.col("source") == "RMC").alias("_has_rmc"),
        F.max(F.col("source") == "GGA").alias("_has_gga"),
    )
    if decimate_1hz:
        first = Window.partitionBy(*by, "_second").orderBy("utc_time")
        merged = merged.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth")
    grid = stage(merged.drop("_second"), "grid")

    clocked = rows.where(F.col("family").isin(*ATTACH_FAMILIES)).join(lags, by)
    eligible = F.col("fmt").isin(*ATTACHABLE) & F.col("ext_clock").isNotNull()
    targets = clocked.where(eligible).withColumn("utc_time", F.col("ext_clock") - F.col("lag_s"))
    snapped = nearest_asof(
        targets, grid.select(*by, "utc_time"), by, "utc_time", [], attach_tol, tie="earlier"
    ).withColumn("epoch_time", F.col("match.utc_time"))
    arrival = Window.partitionBy(*by, "epoch_time").orderBy("stamp", "path", "block", "row")
    ordered = snapped.where(F.col("epoch_time").isNotNull()).withColumn("seq", F.row_number().over(arrival))
    attached = ordered.groupBy(*by, F.col("epoch_time").alias("utc_time")).agg(
        *[
            F.min_by(F.col(name), F.when(F.col("source").isin(*sources), F.col("seq"))).alias(f"_a_{name}")
            for name, sources in FIELD_SOURCES.items()
        ],
        F.count(F.lit(1)).alias("_n_attached"),
    )

    joined = stage(grid.join(attached, [*by, "utc_time"], "left"), "attached")

    def settled(name: str, sources: tuple[str, ...]):
        held = F.lit(False)
        if "RMC" in sources:
            held = held | F.col("_has_rmc")
        if "GGA" in sources:
            held = held | F.col("_has_gga")
        # First writer wins: a field the anchors carry is never filled from an attachment.
        return F.when(held, F.col(name)).otherwise(F.col(f"_a_{name}")).alias(name)

    epochs = joined.select(*by, "utc_time", *[settled(n, s) for n, s in FIELD_SOURCES.items()])
    for name in ("mean_snr", "std_snr", "min_snr", "max_snr"):
        epochs = epochs.withColumn(name, F.lit(None).cast("double"))
    epochs = canonical_motion(epochs.withColumn("num_sats_with_snr", F.lit(0).cast("long")))

    used = joined.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_epochs"),
        F.coalesce(F.sum("_n_attached"), F.lit(0)).alias("attached"),
    )
    offered = clocked.groupBy(*by).agg(F.count(F.lit(1)).alias("_offered"))
    stats = (
        used.join(lags, by).join(offered, by, "left")
        .withColumn("attach_dropped", F.coalesce("_offered", F.lit(0)) - F.col("attached"))
        .select(*by, "lag_s", "attached", "attach_dropped", "n_epochs")
    )
    return epochs, stats


def read_pair(
    spark: SparkSession, cruise_id: str, rx1_dir: str, rx2_dir: str | None = None, **options
) -> tuple[DataFrame, DataFrame]:
    """Epochs and statistics of one or two devices, keyed ``cruise_id, receiver``."""
    parts = [
        read_device_lines(spark, where).withColumn("cruise_id", F.lit(cruise_id)).withColumn("receiver", F.lit(rx))
        for rx, where in ((1, rx1_dir), (2, rx2_dir))
        if where
    ]
    lines = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return split_family_epochs(lines, ["cruise_id", "receiver"], **options)
