"""Ordered time series: smoothing, burn-in, summaries, quantile limits, histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def rolling_mean(df: DataFrame, keys: list[str], order: str, value: str, k: int = 5, name: str = "smooth") -> DataFrame:
    """Centred mean of k rows; null where the window isn't full or holds a null."""
    half = k // 2
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(-half, k - 1 - half)
    return df.withColumn(name, F.when(F.count(value).over(w) == k, F.avg(value).over(w)))


def burn_in(df: DataFrame, frame: str = "frame", drop: int = 101, stride: int = 1, last: int | None = None) -> DataFrame:
    """Frames after the first ``drop`` ones, every ``stride``-th of them, up to ``last``."""
    out = df.where((F.col(frame) > drop) & (F.pmod(F.col(frame) - drop - 1, F.lit(stride)) == 0))
    return out if last is None else out.where(F.col(frame) <= last)


def frame_time(frame: Column, step: float = 0.1) -> Column:
    return (frame - 1) * F.lit(step)


def finite(df: DataFrame, value: str) -> DataFrame:
    return df.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))


def summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean, sample deviation and number of rows; the deviation of one row is null."""
    return df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), F.count("*").alias("n"))


def value_range(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min(value).alias("low"), F.max(value).alias("high"))


def mean_of_variances(df: DataFrame, system: str, group: list[str], value: str) -> DataFrame:
    """Variance of each system, then the mean of a group's variances and its standard error over all rows."""
    each = df.groupBy(*group, system).agg(F.var_samp(value).alias("variance"))
    return each.groupBy(*group).agg(F.avg("variance").alias("mean_variance"), (F.stddev_samp("variance") / F.sqrt(F.count("*"))).alias("se"))


def quantile_limits(df: DataFrame, keys: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """Interpolated (type 7) quantiles, exact, without a buffer of a group's values.

    An approximate quantile to either side brackets each rank; what is under the bracket is counted,
    and only the distinct values inside, some ten-thousandths of a large group, are put in order.
    """
    steps, names = 10_000, list(at)
    x = F.col(value)
    rows = df.where(x.isNotNull()).select(*keys, value)
    near = [F.percentile_approx(x, F.lit(min(1.0, max(0.0, at[k] + side * 2 / steps))), F.lit(steps)).alias(f"_{end}{i}") for i, k in enumerate(names) for side, end in ((-1, "a"), (1, "b"))]
    figures = rows.groupBy(*keys).agg(F.count("*").alias("_n"), F.min(x).alias("_min"), F.max(x).alias("_max"), *near)
    few = F.col("_n") <= 10 * steps  # there all of a group is inside
    part = F.array(*[F.struct(F.lit(i).alias("i"), F.when(few, F.col("_min")).otherwise(F.col(f"_a{i}")).alias("a"), F.when(few, F.col("_max")).otherwise(F.col(f"_b{i}")).alias("b"), F.lit(at[k]).alias("p")) for i, k in enumerate(names)])
    figures = figures.select(*[F.col(k).alias(f"_k{n}") for n, k in enumerate(keys)], "_n", part.alias("_parts"))
    met = rows.join(figures, [F.col(k).eqNullSafe(F.col(f"_k{n}")) for n, k in enumerate(keys)]) if keys else rows.crossJoin(F.broadcast(figures))  # one row
    met = met.select(*keys, value, "_n", F.explode("_parts").alias("_q")).select(*keys, "_n", "_q.i", "_q.p", F.when(x < F.col("_q.a"), F.lit(None)).otherwise(x).alias("v"), (x <= F.col("_q.b")).alias("_in"))
    counts = met.where("_in").groupBy(*keys, "i", "v").agg(F.count("*").alias("c"), F.first("_n").alias("_n"), F.first("p").alias("p"))
    # what is under the bracket is one row, with a null value, which comes first
    upto = F.sum("c").over(Window.partitionBy(*keys, "i").orderBy(F.col("v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    place = (F.col("_n") - 1) * F.col("p")
    at_rank = lambda r: F.max(F.when((F.col("upto") - F.col("c") <= r) & (r < F.col("upto")), F.col("v")))
    ranked = counts.withColumn("upto", upto).groupBy(*keys, "i").agg(at_rank(F.floor(place)).alias("low"), at_rank(F.ceil(place)).alias("high"), F.first(place - F.floor(place)).alias("share"))
    ranked = ranked.withColumn("q", F.col("low") + (F.col("high") - F.col("low")) * F.col("share"))
    return ranked.groupBy(*keys).agg(*[F.max(F.when(F.col("i") == i, F.col("q"))).alias(k) for i, k in enumerate(names)])


def histogram(df: DataFrame, keys: list[str], value: str, bins: int = 35) -> DataFrame:
    """Counts of ``bins`` equal bins between the least and the largest value of all rows; the last bin is closed."""
    limits = df.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), F.least(F.floor((F.col(value) - F.col("_low")) / ((F.col("_high") - F.col("_low")) / F.lit(bins))), F.lit(bins - 1))).otherwise(0)
    return df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(limits)).groupBy(*keys, at.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def common_limit(df: DataFrame, value: str, margin: float = 1.05, floor: float = 0.01) -> DataFrame:
    """One upper limit for all plots: the largest finite value and a margin, ``floor`` where there is none above 0."""
    top = F.max(F.when(~F.isnan(value), F.col(value))) * F.lit(margin)
    return df.agg(F.when(top > 0, top).otherwise(F.lit(floor)).alias("limit"))


def cumulative_share(df: DataFrame, keys: list[str], order: str, value: str, reach: float = 0.8) -> DataFrame:
    """Running share of the total in an order, and the first position at which it reaches ``reach``."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = df.withColumn("share", F.sum(value).over(w) / F.sum(value).over(Window.partitionBy(*keys)))
    return out.withColumn("first_at", F.min(F.when(F.col("share") >= reach, F.col(order))).over(Window.partitionBy(*keys)))


def quality_flag(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``WARN`` where more than half of the values are missing or more than nine tenths are zero."""
    missing = F.avg((F.col(value).isNull() | F.isnan(value)).cast("double"))
    zero = F.avg(F.coalesce((F.col(value) == 0).cast("double"), F.lit(0.0)))
    return df.groupBy(*keys).agg(F.when((missing > 0.5) | (zero > 0.9), "WARN").otherwise("OK").alias("flag"))
