"""Text files as numbered lines: files of any length are read by splits, and each line still has its own file's number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def numbered_lines(spark: SparkSession, path: str, blank: bool = True, section: Column | None = None) -> DataFrame:
    """``(file, line_no, line)``, numbers from 0; without blank lines, which then have no number, if ``blank`` is false.

    A split counts its lines from its own first one, and the lines of the splits before it are added, so no
    file is in one value or one task. ``section`` is a condition on ``line``: a column ``section`` then has
    how many lines up to this one have met it.
    """
    at = ["file", "_start"]
    raw = spark.read.text(path, recursiveFileLookup=True)
    raw = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.col("value").alias("line"))
    raw = raw if blank else raw.where(F.trim(F.regexp_replace("line", "\r", "")) != "")
    # a split is read in order by one task, so ids count on within it
    raw = raw.withColumn("_id", F.monotonically_increasing_id())
    met = section.cast("long") if section is not None else F.lit(0).cast("long")
    splits = raw.groupBy(*at).agg(F.min("_id").alias("_first"), F.count("*").alias("_lines"), F.sum(F.coalesce(met, F.lit(0))).alias("_met"))
    before = Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a file has splits
    splits = splits.select(*at, "_first", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_lines", "_met")])
    lines = raw.join(splits, at)
    number = (F.col("_lines_before") + F.col("_id") - F.col("_first")).alias("line_no")
    if section is None:
        return lines.select("file", number, "line")
    so_far = F.sum(F.coalesce(met, F.lit(0))).over(Window.partitionBy(*at).orderBy("_id"))  # within a split
    return lines.select("file", number, "line", (F.col("_met_before") + so_far).alias("section"))
