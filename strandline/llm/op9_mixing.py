"""Mixing sources to target weights by systematic sampling; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

WEIGHTS = (5, 2, 1)
MOST = 3
#: Strata of a source and size class: so many, or a power of two that leaves about so many rows of all to each.
LEAST_STRATA = 64
STRATUM_ROWS = 1 << 20


def word_count(text: str) -> Column:
    """Number of runs of ``[^\\x20\\x09-\\x0D]+``; null counts as empty."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """``(source, source_size, target)`` for each row of ``(source, source_size)``, one a source.

    Sources in code-point order, null last, weigh ``weights`` in turn and share the sum of all sizes.
    A target stops at ``most`` times its source's size and the excess goes to the others by weight:
    with sources sorted by size over weight, the first that isn't above its limit fixes the share
    of all after it. The windows have no key, as there is one row a source.
    """
    order = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    turn = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (turn + 1).cast("int")).cast("long")
    rows = sizes.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), F.col("source").isNull(), F.encode("source", "UTF-8"))
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    rows = rows.withColumn("share", left.cast("double") / F.sum("weight").over(after).cast("double"))
    free = F.when(F.col("share") * F.col("weight") <= F.col("cap"), F.col("share"))
    # shares only fall while sources above their limit are taken out: the first that fits is the largest that does
    rows = rows.withColumn("fits", F.first(free, ignorenulls=True).over(by_ratio.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    target = F.least(F.col("fits") * F.col("weight"), F.col("cap").cast("double"))
    return rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix_sources(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """``docs``' ids with ``size, source_size, target, copies, taken``, and the columns named in ``keep``.

    A source's documents, in an order by size class, stratum, size and id, each expect
    ``target / source_size`` copies; one offset a source, from ``seed`` and its name, is added to
    the running sum and a copy falls on each integer crossed. The order spreads the choice over all
    sizes, so taken words come near the target. Positions come from counts of
    (source, class, stratum), so no window holds a whole source: strata are hash values of the id,
    64 or as many as leave about a million rows of the whole table to each. Reruns agree, also where ids repeat: such rows are ordered by size, then text hash,
    and rows equal in all of these are interchangeable. Null sources are one source; null or empty
    texts have size 0, belong to their source's order and take 0 words. A source without words has
    target 0 and takes nothing. An empty table gives an empty result. Positions are kept beside rows
    in a written table, as both passes have to see the same rows.
    """
    rows = docs.select(
        F.col(id_column).alias("_id"), word_count(text).alias("size"), F.col(source).alias("_source"),
        *([F.xxhash64(text).alias("_tie")] if keep else [F.lit(0).cast("long").alias("_tie")]), *[F.col(c).alias(f"_keep_{i}") for i, c in enumerate(keep)],
    )
    rows = rows.withColumn("_class", F.floor(F.log2(F.col("size") + 1.0) * 4).cast("int"))
    rows = cut(rows.withColumn("_hash", F.conv(F.substring(F.md5(F.coalesce(F.col("_id").cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("long")))
    strata = max(LEAST_STRATA, 1 << max(0, (rows.count() - 1) // STRATUM_ROWS).bit_length())
    rows = rows.withColumn("_stratum", (F.col("_hash") % strata).cast("int")).drop("_hash")
    groups = rows.groupBy("_source", "_class", "_stratum").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    groups = cut(groups)
    sizes = groups.groupBy(F.col("_source").alias("source")).agg(F.sum("words").alias("source_size"))
    plan = source_targets(sizes, weights, most).withColumnRenamed("source", "_of")
    before = Window.partitionBy("_source").orderBy("_class", "_stratum").rowsBetween(Window.unboundedPreceding, -1)
    starts = groups.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n", "words")
    starts = starts.join(plan, F.col("_source").eqNullSafe(F.col("_of"))).drop("_of")
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce("_source", F.lit("")), F.when(F.col("_source").isNull(), "null").otherwise("")).cast("binary"))
    starts = starts.withColumn("offset", F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))
    starts = starts.select(F.col("_source").alias("_of"), F.col("_class").alias("_c"), F.col("_stratum").alias("_s"), "first", "source_size", "target", "offset")
    within = Window.partitionBy("_source", "_class", "_stratum").orderBy("size", F.col("_id").isNull(), "_id", "_tie")
    rows = rows.withColumn("at", F.row_number().over(within))
    rows = rows.join(starts, F.col("_source").eqNullSafe(F.col("_of")) & (F.col("_class") == F.col("_c")) & (F.col("_stratum") == F.col("_s")))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    place = F.col("first") + F.col("at")
    copies = F.floor(place * each + F.col("offset")) - F.floor((place - 1) * each + F.col("offset"))
    return rows.select(
        F.col("_id").alias(id_column), "size", "source_size", "target", copies.cast("long").alias("copies"),
        (copies * F.col("size")).cast("long").alias("taken"), *[F.col(f"_keep_{i}").alias(f"_{c}" if c in (id_column, "size", "source_size", "target", "copies", "taken") else c) for i, c in enumerate(keep)],
    )


def take(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """``docs`` as the mix has them: each row as often as it is taken, all columns as they were."""
    columns = docs.columns
    hidden = docs.select(*[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(columns)])
    at = {c: f"_c{columns.index(c)}" for c in (id_column, text, source)}
    mixed = mix_sources(hidden.withColumn("_doc", F.struct(*hidden.columns)), at[id_column], at[text], at[source], keep=("_doc",), **options)
    return mixed.where("copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col(f"_doc._c{i}").alias(c) for i, c in enumerate(columns)])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words the mix takes of each of ``documents``."""
    return mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % (SELECT greatest(64, CASE WHEN count(*) > 1048576 THEN (1 << (floor(log2((count(*) - 1) // 1048576)) + 1)::INTEGER) ELSE 1 END) FROM documents) AS stratum
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [5, 2, 1][((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3) + 1]::BIGINT AS weight
  FROM d GROUP BY source
), r AS (
  SELECT *, 3 * source_size AS cap,
    (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
      / (sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS share,
    row_number() OVER o AS turn
  FROM s WINDOW o AS (ORDER BY (3 * source_size)::DOUBLE / weight, source IS NULL, encode(source))
), f AS (
  SELECT arg_min(share, turn) FILTER (share * weight <= cap) AS fits FROM r
), t AS (
  SELECT source, source_size, coalesce(least(fits * weight, cap::DOUBLE), 0.0) AS target,
    ('0x' || substr(md5('0:' || coalesce(source, '') || CASE WHEN source IS NULL THEN 'null' ELSE '' END), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE AS shift
  FROM r, f
), p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.shift, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS each,
    row_number() OVER (PARTITION BY d.source ORDER BY floor(log2(size + 1.0::DOUBLE) * 4), stratum, size, doc_id) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  ((floor(place * each + shift) - floor((place - 1) * each + shift)) * size)::BIGINT AS taken
FROM p
"""
