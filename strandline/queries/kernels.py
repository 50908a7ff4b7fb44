"""Queries whose core is linear algebra or a sequential kernel, one group a task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import build3d, cluster, dynamics, modes
from ..proxies import frames
from ..sources import pdb
from .common import registry, rounded
from .graphs import _flags, keep

QUERIES, ORACLES, _query = registry()


def _structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of each system, in angstroms."""
    f = frames(spark, sf_dir)
    first = f.groupBy("system").agg(F.min("frame").alias("frame"))
    return f.join(first, ["system", "frame"]).select("system", "atom", *[(F.col(c) * 20).alias(c) for c in "xyz"])


def _modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keep(modes.normal_modes(_structures(spark, sf_dir), "system"))


@_query()
def mode_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eigenvalues but for the trivial ones, and their share of the whole spread from the softest on."""
    from ..operators.series import cumulative_share

    m = _modes(spark, sf_dir).where(F.col("mode") > modes.TRIVIAL).select("system", "mode", F.round("eigenvalue", 3).alias("eigenvalue"), (1 / F.col("eigenvalue")).alias("spread"))
    return rounded(cumulative_share(m, ["system"], "mode", "spread").drop("spread"), 4)


@_query()
def fluctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modes.fluctuations(_modes(spark, sf_dir), "system"), 4)


@_query()
def mode_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modes.mode_correlation(_modes(spark, sf_dir), "system"), 4)


@_query()
def rmsip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modes.rmsip(_modes(spark, sf_dir), "system"), 4)


@_query()
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _structures(spark, sf_dir)
    d = dynamics.displacement(s, s.withColumn("system", (F.col("system") + 1) % 10), ["system", "atom"]).drop("norm")
    return rounded(modes.overlaps(_modes(spark, sf_dir), d, "system"), 4)


@_query()
def deformation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(modes.deformation(_modes(spark, sf_dir), _structures(spark, sf_dir), "system", [2, 3, 4, 5, 6]), 4)


@_query()
def mode_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each frame is from the structure, as a mode's sign is arbitrary."""
    s = _structures(spark, sf_dir)
    p = modes.mode_path(_modes(spark, sf_dir), s, "system")
    return rounded(dynamics.rmsd(p.withColumn("at", F.struct("system", "atom")), s.withColumn("at", F.struct("system", "atom")), ["system", "frame"], "at"), 4)


@_query()
def walktrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(cluster.walktrap(_flags(spark, sf_dir), "system"), 5)


@_query()
def strand_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = build3d.with_end(_structures(spark, sf_dir), ["system"], "atom")
    return rounded(build3d.backbones(build3d.guides(s, ["system"], "atom"), "system", ["atom", "step"]), 4)


@_query()
def strand_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = build3d.backbones(build3d.guides(_structures(spark, sf_dir), ["system"], "atom"), "system", ["atom", "step"])
    letters = build3d.as_chains(b.select("system").distinct().withColumn("one", F.lit(1)), ["one"], "system").select("system", "chain")
    return pdb.strand_lines(b.join(letters, "system").withColumn("model", F.lit("all")), "model")


@_query()
def deformation_by_residue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over chains, three residues each, of the atoms' deformation, and whether it is of use."""
    from ..operators.series import quality_flag

    d = modes.deformation(_modes(spark, sf_dir), _structures(spark, sf_dir), "system", [2, 3, 4, 5, 6]).withColumn("resno", F.col("atom") % 7)
    flags = quality_flag(d, ["system"], "deformation")
    return rounded(d.groupBy("system", "resno").agg(F.avg("deformation").alias("deformation")).join(flags, "system"), 4)


@_query()
def mean_fluctuation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over systems, as replicas, of each atom's fluctuation."""
    return rounded(modes.fluctuations(_modes(spark, sf_dir), "system").groupBy("atom").agg(F.avg("fluctuation").alias("fluctuation"), F.count("*").alias("n")), 4)
