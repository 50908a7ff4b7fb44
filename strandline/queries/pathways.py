"""Queries of whole pathway studies over the trade network."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markov
from ..plans import pathways
from ..proxies import table
from .common import registry, rounded
from .graphs import _FLOWS, _flags, _flows, keep
from .sequences import _known

QUERIES, ORACLES, _query = registry()

#: The largest three nodes are the targets, as edges lead from smaller to larger ones.
TARGETS = [22, 23, 24]


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A node's chain and number, four to a number."""
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").select(n.alias("node"), F.concat(F.substring(F.lit("ABCD"), n % 4 + 1, F.lit(1)), F.floor(n / 4).cast("string")).alias("label"))


@_query(f"""WITH {_FLOWS}, e AS (SELECT system, target, src, dst, sum(fwd) AS fwd, sum(rev) AS rev FROM flows GROUP BY 1, 2, 3, 4),
  m AS (SELECT system, 'undirected' AS mode, target, src, dst, fwd + rev AS weight FROM e UNION ALL SELECT system, 'directed_fwd', target, src, dst, fwd FROM e UNION ALL SELECT system, 'directed_rev', target, src, dst, rev FROM e),
  t AS (SELECT * FROM m UNION ALL SELECT system, mode, 'total', src, dst, weight FROM m) SELECT system, mode, target, src, dst, round(sum(weight), 6) AS weight FROM t GROUP BY 1, 2, 3, 4, 5 HAVING sum(weight) > 0""")
def flow_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _flows(spark, sf_dir).groupBy("system", "target", "src", "dst").agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev")).withColumn("total", F.col("fwd") + F.col("rev"))
    return rounded(pathways.flow_modes(e, ["system"]))


@_query()
def rivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best path of each cluster of the flow's paths, for each system."""
    found = pathways.decomposition_study(_flags(spark, sf_dir), "system", list(range(25)), TARGETS, _labels(spark, sf_dir), _known(spark, sf_dir), keep, least_length=3, target_numbers=[5, 6])
    return rounded(found["rivers"].withColumn("nodes", F.concat_ws("-", "nodes")))


@_query()
def reconstruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of the likeliest paths to the targets from all nodes, for each system."""
    t = keep(markov.transition(_flags(spark, sf_dir), ["system"]))
    gone = spark.createDataFrame([(n,) for n in TARGETS], "node int")
    visits = keep(markov.fundamental_solve(t, "system", gone))
    seeds = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("node"), F.lit(1.0).alias("weight")).where(~F.col("node").isin(TARGETS))
    out = pathways.reconstruction_study(t, visits, seeds, TARGETS, ["system"], _labels(spark, sf_dir), _known(spark, sf_dir), keep)
    return rounded(out["auto_members"].select("system", "item", F.concat_ws("-", "nodes").alias("nodes"), "n_duplicates", "importance", "log_prob", "cluster", "n_clusters", "cut_height"))
