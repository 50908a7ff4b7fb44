"""Labelled matrices as rows ``(keys, i, j, value)``; an absent cell is an absent row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def to_full(m: DataFrame, i: str = "i", j: str = "j") -> DataFrame:
    """Both triangles from one; the diagonal stands once."""
    flipped = m.where(F.col(i) != F.col(j)).select(*[F.col(j).alias(i) if c == i else F.col(i).alias(j) if c == j else F.col(c) for c in m.columns])
    return m.unionByName(flipped)


def from_edges(edges: DataFrame, keys: list[str], a: str, b: str, weight: str) -> DataFrame:
    """Sums of edge weights in both directions; a self-loop counts twice."""
    ways = edges.select(*keys, F.col(a).alias("i"), F.col(b).alias("j"), weight).unionByName(edges.select(*keys, F.col(b).alias("i"), F.col(a).alias("j"), weight))
    return ways.groupBy(*keys, "i", "j").agg(F.sum(weight).alias("value"))


def add(parts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Sum on the union of cells; what is missing counts as 0."""
    return parts.groupBy(*keys, "i", "j").agg(F.sum(value).alias(value))


def replica_mean(parts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, variance and standard error over the replicas that have a cell; one value has no variance."""
    n = F.count(value)
    return parts.groupBy(*keys, "i", "j").agg(F.avg(value).alias("mean"), F.when(n > 1, F.var_samp(value)).alias("variance"), F.when(n > 1, F.stddev_samp(value) / F.sqrt(n)).alias("se"), n.alias("n"))


def pool_replicas(stats: DataFrame, keys: list[str], n: str = "n", mean: str = "mean", var: str = "var") -> DataFrame:
    """Mean and variance of all rows from replicas' numbers, means and variances, exactly.

    The second pass joins each key's mean to its replicas, so it is the sum of within and between parts.
    """
    total = stats.groupBy(*keys).agg(F.sum(n).alias("_n"), (F.sum(F.col(n) * F.col(mean)) / F.sum(n)).alias("_mean"))
    parts = (F.col(n) - 1) * F.coalesce(F.col(var), F.lit(0.0)) + F.col(n) * (F.col(mean) - F.col("_mean")) * (F.col(mean) - F.col("_mean"))
    joined = stats.join(total, keys)
    out = joined.groupBy(*keys).agg(F.max("_n").alias("n_total"), F.max("_mean").alias("pooled_mean"), (F.sum(parts) / F.greatest(F.max("_n") - 1, F.lit(1))).alias("pooled_var"))
    return out.withColumn("norm_var", F.col("pooled_var") / (F.col("pooled_mean") * F.col("pooled_mean") + F.lit(1e-12)))


def align(values: DataFrame, onto: DataFrame, keys: list[str], value: str = "value", fill: float | None = None) -> DataFrame:
    """``onto``'s cells with the values of another matrix, null or ``fill`` where it has none."""
    out = onto.select(*keys, "i", "j").join(values, [*keys, "i", "j"], "left")
    return out if fill is None else out.withColumn(value, F.coalesce(value, F.lit(fill)))


def canvas(values: DataFrame, axis: DataFrame, label: str = "label", value: str = "value") -> DataFrame:
    """All pairs of an axis with a matrix's values: for export, as large as the axis squared."""
    a = axis.select(F.col(label).alias("i"))
    return a.crossJoin(axis.select(F.col(label).alias("j"))).join(values, ["i", "j"], "left")


def hybrid(first: DataFrame, second: DataFrame, i: Column, j: Column) -> DataFrame:
    """The upper triangle of one matrix and the lower of another, by positions."""
    return first.where(i < j).unionByName(second.where(i > j))


def sentinel_delta(a: DataFrame, b: DataFrame, keys: list[str], share: float = 0.0005, mark: float = 999.0) -> DataFrame:
    """Change from a to b: ``appear`` (+mark), ``vanish`` (-mark) or ``keep`` (difference); null where both are absent or on the diagonal.

    A value counts as present at ``share`` of the largest of both or more.
    """
    both = a.select(*keys, "i", "j", F.col("value").alias("_a")).join(b.select(*keys, "i", "j", F.col("value").alias("_b")), [*keys, "i", "j"], "full")
    x, y = F.coalesce("_a", F.lit(0.0)), F.coalesce("_b", F.lit(0.0))
    top = both.groupBy(*keys).agg((F.lit(share) * F.greatest(F.max("_a"), F.max("_b"))).alias("_t"))
    both = both.join(top, keys) if keys else both.crossJoin(F.broadcast(top))  # one row
    in_a, in_b = x >= F.col("_t"), y >= F.col("_t")
    in_a, in_b = in_a & (x > 0), in_b & (y > 0)
    status = F.when(F.col("i") == F.col("j"), None).when(in_a & in_b, "keep").when(in_b, "appear").when(in_a, "vanish")
    delta = F.when(status == "keep", y - x).when(status == "appear", F.lit(mark)).when(status == "vanish", F.lit(-mark))
    return both.select(*keys, "i", "j", status.alias("status"), delta.alias("delta"))


# The category of a change in a variant against the same change in the wild type.
CATEGORY = (
    ("appear", "appear", 0.0), ("appear", "keep", 2.0), ("appear", "vanish", 999.0),
    ("keep", "appear", -2.0), ("keep", "keep", 0.0), ("keep", "vanish", 1.0),
    ("vanish", "appear", -999.0), ("vanish", "keep", -1.0), ("vanish", "vanish", 0.0),
)


def category_delta(variant: DataFrame, wild: DataFrame, keys: list[str]) -> DataFrame:
    """The category of two changes, null unless both are present; nine cases, so an expression and no join."""
    both = variant.select(*keys, "i", "j", F.col("status").alias("_v")).join(wild.select(*keys, "i", "j", F.col("status").alias("_w")), [*keys, "i", "j"])
    out = F.lit(None).cast("double")
    for v, w, value in CATEGORY:
        out = F.when((F.col("_v") == v) & (F.col("_w") == w), value).otherwise(out)
    return both.select(*keys, "i", "j", out.alias("category"))


def numeric_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """b less a where both have a cell."""
    return a.select(*keys, "i", "j", F.col(value).alias("_a")).join(b.select(*keys, "i", "j", F.col(value).alias("_b")), [*keys, "i", "j"]).select(*keys, "i", "j", (F.col("_b") - F.col("_a")).alias("delta"))


def field_delta(a: DataFrame, b: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """b less a over the keys of either; what is missing counts as 0."""
    both = a.select(*keys, F.col(value).alias("_a")).join(b.select(*keys, F.col(value).alias("_b")), keys, "full")
    return both.select(*keys, (F.coalesce("_b", F.lit(0.0)) - F.coalesce("_a", F.lit(0.0))).alias("delta"))


def over_largest(df: DataFrame, value: Column, name: str) -> DataFrame:
    """``df`` with ``name``, the largest of ``value`` over all its rows: one row, which is broadcast."""
    return df.crossJoin(F.broadcast(df.agg(F.max(value).alias(name))))
