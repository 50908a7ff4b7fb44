"""Choosing atoms, residues and rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ELEMENTS = ["C", "N", "O", "S", "P", "CA"]


def by_element(atoms: DataFrame, name: str = "name", elements: list[str] = ELEMENTS) -> DataFrame:
    return atoms.where(F.col(name).isin(elements))


def in_ranges(number: Column, ranges: list[tuple[int, int]]) -> Column:
    out = F.lit(False)
    for low, high in ranges:
        out = out | number.between(low, high)
    return out


def alpha_carbons(atoms: DataFrame, ranges: list[tuple[int, int]]) -> DataFrame:
    return atoms.where((F.col("name") == "CA") & in_ranges(F.col("resno"), ranges))


def differences(found: DataFrame, expected: DataFrame, keys: list[str]) -> DataFrame:
    """What is in one and not in the other, with a ``side``; empty where both agree, repeats counted."""
    a, b = found.select(*keys), expected.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("extra")).unionByName(b.exceptAll(a).withColumn("side", F.lit("missing")))


def preferred(df: DataFrame, keys: list[str], kind: str, kinds: list[str], tie: list[str]) -> DataFrame:
    """One row a key: of the first of ``kinds`` that the key has, then by ``tie``; keys with none of them are dropped."""
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col(kind))
    w = Window.partitionBy(*keys).orderBy(rank, *tie)
    return df.where(F.col(kind).isin(kinds)).withColumn("_turn", F.row_number().over(w)).where("_turn = 1").drop("_turn")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row a key, that of the least ``order``, as a partial aggregate."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*")


def annotate_ranges(df: DataFrame, number: str, ranges: DataFrame, keys: list[str]) -> DataFrame:
    """``df`` with the name of the range (``name, low, high, ordinal``) that its number lies in; of several the last defined, else null.

    The ranges are a short list of definitions, so they are joined as they are, by a nested loop.
    """
    hit = df.join(F.broadcast(ranges), F.col(number).between(F.col("low"), F.col("high")), "left")
    return hit.groupBy(*keys, number).agg(F.max_by("name", "ordinal").alias("range_name"))


def outside(number: Column, low: int, high: int) -> Column:
    """Whether a number lies outside a range; true where it is null."""
    return number.isNull() | (number < low) | (number > high)


def slice_between(axis: DataFrame, label: str, order: str, a: str, b: str) -> DataFrame:
    """Positions between two labels that exist, whichever comes first; fails if one is missing."""
    ends = axis.where(F.col(label).isin(a, b)).agg(F.min(order).alias("_a"), F.max(order).alias("_b"), F.countDistinct(label).alias("_n"))
    checked = ends.withColumn("_ok", F.when(F.col("_n") == F.lit(len({a, b})), True).otherwise(F.raise_error(F.lit(f"no such label: {a} or {b}")).cast("boolean")))
    return axis.crossJoin(F.broadcast(checked)).where(F.col("_ok") & F.col(order).between(F.col("_a"), F.col("_b"))).drop("_a", "_b", "_n", "_ok")


def slice_nearest(axis: DataFrame, order: str, low: tuple[str, int], high: tuple[str, int]) -> DataFrame:
    """Positions from the first of the low chain at or above its number to the last of the high chain at or below its number.

    ``axis`` has ``chain, number`` and a position; where an end has no such node the result is empty.
    """
    ends = axis.agg(
        F.min(F.when((F.col("chain") == low[0]) & (F.col("number") >= low[1]), F.col(order))).alias("_a"),
        F.max(F.when((F.col("chain") == high[0]) & (F.col("number") <= high[1]), F.col(order))).alias("_b"),
    )
    return axis.crossJoin(F.broadcast(ends)).where(F.col(order).between(F.least("_a", "_b"), F.greatest("_a", "_b"))).drop("_a", "_b")


def top_rows(df: DataFrame, keys: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each key in a total order, with ``rank``; k may depend on the row."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
