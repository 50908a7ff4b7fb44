"""Text tables: configuration, square matrices, residue maps, lists of clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered_lines


def parse_config(lines: DataFrame, value: str = "value") -> DataFrame:
    """``(key, value)`` of ``key = value`` lines; comments, indented or not, and blank lines are left out; more ``=`` belong to the value."""
    text = F.trim(F.col(value))
    kept = lines.where((text != "") & ~text.startswith("#") & text.contains("="))
    parts = F.split(F.col(value), "=", 2)
    return kept.select(F.trim(parts[0]).alias("key"), F.trim(parts[1]).alias("value"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    return parse_config(spark.read.text(path))


def range_of(value: F.Column) -> F.Column:
    """The numbers of ``lo-hi``, both included; null for anything else."""
    lo, hi = F.regexp_extract(value, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1), F.regexp_extract(value, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2)
    return F.when(lo != "", F.sequence(lo.try_cast("int"), hi.try_cast("int")))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(file, i, j, value)`` of square matrices in CSV; rows are named by an unnamed first column, else in the header's order.

    Files are read by splits; a row's number is its own file's, and files of different labels can be read at once.
    """
    lines = numbered_lines(spark, path, blank=False).withColumn("cells", F.split(F.regexp_replace("line", '["\r]', ""), ","))
    head = lines.where("line_no = 0").withColumn("named", F.col("cells")[0] == "")
    head = head.select("file", "named", F.when(F.col("named"), F.slice("cells", F.lit(2), F.size("cells"))).otherwise(F.col("cells")).alias("names"))
    rows = lines.where("line_no > 0").join(head, "file")
    name = F.when(F.col("named"), F.col("cells")[0]).otherwise(F.get("names", (F.col("line_no") - 1).cast("int")))
    rows = rows.select("file", "names", name.alias("i"), F.when(F.col("named"), F.slice("cells", F.lit(2), F.size("cells"))).otherwise(F.col("cells")).alias("cells"))
    flat = rows.select("file", "i", F.explode(F.arrays_zip(F.col("names").alias("j"), F.col("cells").alias("v"))).alias("c"))
    return flat.select("file", "i", "c.j", F.col("c.v").try_cast("double").alias("value")).where("value is not null and not isnan(value)")


def read_residue_map(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="node_id int, chain string, residue int, system string").withColumn("label", F.concat("chain", "residue"))


def cluster_listing(clusters: DataFrame, key: str, order: str, path: str) -> DataFrame:
    """Two lines a cluster in the manner of sequence files: a name line and its nodes."""
    name = F.concat(F.lit(">"), F.concat_ws("|", F.col(key).cast("string"), F.col(order).cast("string")))
    return clusters.select(key, F.posexplode(F.array(name, F.concat_ws("-", path))).alias("part", "line"), order).select(key, order, "part", "line")
