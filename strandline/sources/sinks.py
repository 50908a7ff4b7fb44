"""Writing tables: partitioned files, and what to do when a result is there already."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POLICIES = {"skip": "ignore", "overwrite": "overwrite", "append": "append", "fail": "errorifexists"}


def write_table(df: DataFrame, path: str, by: list[str] | None = None, policy: str = "skip", kind: str = "parquet") -> None:
    """One folder a value of ``by``; ``skip`` leaves a result that is there, as a re-run of a study does."""
    writer = df.write.mode(POLICIES[policy]).format(kind)
    if kind == "csv":
        writer = writer.option("header", True)
    (writer.partitionBy(*by) if by else writer).save(path)


def read_if_there(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None where there is none, as of a system that wasn't computed."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return None


def first_of_pairs(results: DataFrame, pairs: DataFrame, first: str, second: str, order: str) -> DataFrame:
    """Each of ``pairs`` with its first result by ``order``, nulls where it has none."""
    rest = [c for c in results.columns if c not in (first, second)]
    one = results.groupBy(first, second).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return pairs.join(one, [first, second], "left").select(*pairs.columns, *[F.col(f"_r.{c}").alias(c) for c in rest])


def read_or_make(spark: SparkSession, path: str, make, by: list[str] | None = None, again: bool = False) -> DataFrame:
    """The table at ``path``; made and written first if it isn't there or ``again`` is asked for. Partition columns prune."""
    write_table(make(), path, by, "overwrite" if again else "skip")
    return spark.read.parquet(path)
