"""Catalogue of runs: names, replicas, pairing of files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def discover(spark: SparkSession, path: str, pattern: str = "*.dcd") -> DataFrame:
    """Names of the files under ``path`` by suffix, without reading them; fails if there are none."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    names = found.select("path", F.element_at(F.split("path", "/"), -1).alias("file"))
    if names.isEmpty():
        raise FileNotFoundError(f"no {pattern} under {path}")
    return names


def run_name(file: Column) -> dict[str, Column]:
    """Structure, variant and replica of ``S_V_repN.ext``."""
    parts = F.split(F.regexp_replace(file, r"\.[A-Za-z0-9]+$", ""), "_")
    return {"structure": F.get(parts, F.lit(0)), "variant": F.get(parts, F.lit(1)), "replica": F.regexp_extract(F.get(parts, F.lit(2)), "[0-9]+", 0).cast("int")}


def condition_of(file: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(file, r"\.[A-Za-z0-9]+$", ""), "_rep[0-9]+$", "")


def artifact_name(file: Column, families: dict[str, str]) -> dict[str, Column]:
    """System, replica (null if none) and family by suffix, ``unknown`` for others."""
    stem = F.regexp_replace(file, r"\.[A-Za-z0-9]+$", "")
    family = F.lit("unknown")
    for suffix, name in families.items():
        family = F.when(stem.endswith(suffix), name).otherwise(family)
    replica = F.regexp_extract(stem, "_rep([0-9]+)", 1)
    return {"system": F.concat_ws("_", F.slice(F.split(stem, "_"), 1, 2)), "replica": F.when(replica != "", replica.cast("int")), "family": family}


def pair_topology(runs: DataFrame, tops: DataFrame, key: str) -> DataFrame:
    """Each run with its topology where exactly one has the expected name, else null."""
    one = tops.groupBy(key).agg(F.when(F.count("*") == 1, F.first("file")).alias("topology"))
    return runs.join(one, key, "left")


def missing_replicas(runs: DataFrame, keys: list[str], replica: str = "replica") -> DataFrame:
    """Replicas between a key's least and largest one that it doesn't have."""
    wide = runs.groupBy(*keys).agg(F.min(replica).alias("_a"), F.max(replica).alias("_b"))
    every = wide.select(*keys, F.explode(F.sequence("_a", "_b")).alias(replica))
    return every.join(runs, [*keys, replica], "left_anti")


def replica_summary(runs: DataFrame, keys: list[str], replica: str = "replica") -> DataFrame:
    return runs.groupBy(*keys).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(replica)), lambda r: r.cast("string")), ",").alias("replicas"),
        F.min(replica).alias("first_replica"), F.max(replica).alias("last_replica"), F.count("*").alias("n_replicas"),
    )


def exclude(runs: DataFrame, banned: DataFrame, keys: list[str]) -> DataFrame:
    return runs.join(banned, keys, "left_anti")


def dense_index(df: DataFrame, keys: list[str], order: list[str], name: str = "node_id") -> DataFrame:
    """Positions from 1 in an order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def comparisons(systems: DataFrame, first_structure: str, first_variant: str) -> DataFrame:
    """Pairs of systems ``(a, b)`` to compare: within a variant the first structure with each other one, within a structure the first variant with each other one.

    ``systems`` is a catalogue of ``structure, variant``, so the pairs are few.
    """
    a = systems.select(F.col("structure").alias("s1"), F.col("variant").alias("v1")).distinct()
    b = systems.select(F.col("structure").alias("s2"), F.col("variant").alias("v2")).distinct()
    by_structure = a.where(F.col("s1") == first_structure).join(b.where(F.col("s2") != first_structure), F.col("v1") == F.col("v2"))
    by_variant = a.where(F.col("v1") == first_variant).join(b.where(F.col("v2") != first_variant), F.col("s1") == F.col("s2"))
    name = lambda s, v: F.concat_ws("_", s, v)
    return by_structure.unionByName(by_variant).select(name("s1", "v1").alias("a"), name("s2", "v2").alias("b"))


def reorder(df: DataFrame, axis: DataFrame, keys: list[str], order: str, group: list[str] | None = None) -> DataFrame:
    """``df`` with the axis' positions, of groups that the axis covers wholly; others keep null positions. Without ``group`` all rows are one."""
    joined = df.join(axis, keys, "left")
    whole = joined.groupBy(*(group or [])).agg((F.count(order) == F.count(F.lit(1))).alias("_whole"))
    joined = joined.join(whole, group) if group else joined.crossJoin(F.broadcast(whole))  # one row
    return joined.withColumn(order, F.when(F.col("_whole"), F.col(order))).drop("_whole")
