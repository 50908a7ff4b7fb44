"""Parameters of runs: a log that only grows, and its latest state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_latest(final: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``final`` without the scripts that ``new`` has rows of, and ``new``; columns that one lacks are null."""
    return final.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def latest(history: DataFrame, keys: list[str], at: str = "timestamp") -> DataFrame:
    """The newest row of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), *[F.desc(c) for c in history.columns if c not in (*keys, at)])
    return history.withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def append(history: DataFrame, new: DataFrame) -> DataFrame:
    return history.unionByName(new, allowMissingColumns=True)
