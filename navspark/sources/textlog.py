"""Text logs read with Spark's own splittable text source, arrival order kept.

Arrival order matters (a VTG belongs to the last GGA before it), and a text scan
has no line numbers. Inside one split the scan is sequential, so
``(file, block start, row id)`` orders lines exactly as they lie in the file. Only
the relative order inside a block is used, never the ids themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from navspark.functions.clock import absolute_utc, split_log_lines
from navspark.functions.nmea import parse_sentences
from navspark.operators.epochs import attach_to_anchor, merge_epochs
from navspark.operators.neighbours import Lookup, lookup_neighbours
from navspark.session import stage


def read_lines(spark: SparkSession, paths: str | list[str], recursive: bool = False, names: str | None = None) -> DataFrame:
    """``path, block, row, line``: text lines with their place in the file.

    ``names`` is a pattern of file names to read. Undecodable bytes are dropped.
    """
    reader = spark.read.option("recursiveFileLookup", str(recursive).lower())
    raw = (reader.option("pathGlobFilter", names) if names else reader).text(paths)
    clean = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
        clean.alias("line"),
    )


def carry_clock(sentences: DataFrame, by: list[str]) -> DataFrame:
    """Lines without a time stamp take the last external clock seen before them.

    Runs before formatter and checksum filters: a rejected line still moves the clock.
    """
    carried = lookup_neighbours(
        sentences, by, ["path", "block"], "row",
        [Lookup("_clock", F.col("ext_clock").isNotNull(), ("ext_clock",), "back")],
    )
    return carried.withColumn("ext_clock", F.col("_clock.ext_clock")).drop("_clock")


def interleaved_epochs(
    lines: DataFrame,
    by: list[str],
    validate_checksums: bool = True,
    durable: bool = True,
) -> DataFrame:
    """Epochs of devices that log all sentence families into one stream of files.

    ``lines`` has ``by`` (device identity) plus ``path, block, row, line``. Files of a
    device follow each other by path. The text is taken apart once; ``durable`` writes
    the typed result to the staging folder, because clock and anchor carrying each look
    at the rows twice (segment summaries and detail) and must see the same blocks even
    if the scan would be split differently later.
    """
    parsed = parse_sentences(split_log_lines(lines), validate_checksums=validate_checksums, keep_rejected=True)
    parsed = parsed.drop("line")
    if durable:
        parsed = stage(parsed, "sentences")
    clocked = carry_clock(parsed, by)
    timed = clocked.withColumn("anchor_time", absolute_utc(F.col("utc_of_day"), F.col("ext_clock")))
    # Without a sentence clock the row anchors nothing, whatever the logger says.
    timed = timed.withColumn("anchor_time", F.when(F.col("utc_of_day").isNotNull(), F.col("anchor_time")))
    attached = attach_to_anchor(timed, by, ["path", "block"], "row")
    # Within one epoch the writers are few; number them in arrival order.
    arrival = Window.partitionBy(*by, "utc_time").orderBy("path", "block", "row")
    return merge_epochs(attached.withColumn("seq", F.row_number().over(arrival)), by, "seq")


def read_devices(spark: SparkSession, root: str, pattern: str = r"/([^/]+)/rx([12])/[^/]+$") -> DataFrame:
    """Lines under ``root/<cruise>/rx1|rx2/`` with ``cruise_id`` and ``receiver`` from the path."""
    lines = read_lines(spark, root, recursive=True)
    cruise = F.regexp_extract("path", pattern, 1)
    receiver = F.regexp_extract("path", pattern, 2).try_cast("int")
    return lines.withColumn("cruise_id", cruise).withColumn("receiver", receiver).where(receiver.isNotNull())
