"""Paths in space: guide points between residues and a strand of backbone atoms along them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance

# Step and spacing of guides, and bond lengths of the backbone, in angstroms.
LONGEST, SPACING = 5.0, 3.8
C_N, N_CA, CA_C, C_O = 1.329, 1.458, 1.525, 1.231


def guides(points: DataFrame, keys: list[str], order: str, longest: float = LONGEST, spacing: float = SPACING) -> DataFrame:
    """``points`` with equally spaced points in each gap of more than ``longest``: n = max(2, ceil(gap / spacing)) steps there."""
    w = Window.partitionBy(*keys).orderBy(order)
    p = points.select(*keys, order, "x", "y", "z", *[F.lead(c).over(w).alias(f"n{c}") for c in "xyz"])
    d = distance(["x", "y", "z"], ["nx", "ny", "nz"])
    n = F.when(d > longest, F.greatest(F.lit(2), F.ceil(d / F.lit(spacing)))).otherwise(F.lit(1)).cast("int")
    rows = p.withColumn("_n", n).withColumn("step", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return rows.select(*keys, order, "step", *[F.when(F.col("step") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"n{c}") - F.col(c)) * F.col("step") / F.col("_n")).alias(c) for c in "xyz"])


def with_end(points: DataFrame, keys: list[str], order: str, reach: float = SPACING) -> DataFrame:
    """``points`` and one more beyond the last of each key, ``reach`` along x."""
    last = points.groupBy(*keys).agg(F.max(order).alias("_o"), F.max_by(F.struct("x", "y", "z"), order).alias("p"))
    return points.select(*keys, order, "x", "y", "z").unionByName(last.select(*keys, (F.col("_o") + 1).alias(order), (F.col("p.x") + reach).alias("x"), F.col("p.y").alias("y"), F.col("p.z").alias("z")))


def strand(p: np.ndarray) -> np.ndarray:
    """N, CA, C and O of a residue at each point, the chain's bond between residues kept at its length.

    A normal is carried along by the least turn and never flips; it alternates from residue to residue as in a strand.
    """
    n = len(p)
    way = np.gradient(p, axis=0) if n > 1 else np.array([[1.0, 0, 0]])
    way /= np.maximum(np.linalg.norm(way, axis=1, keepdims=True), 1e-9)
    side = np.cross(way[0], [0, 0, 1.0])
    if np.linalg.norm(side) < 1e-6:
        side = np.cross(way[0], [0, 1.0, 0])
    side /= np.linalg.norm(side)
    out, last_c = np.zeros((n, 4, 3)), None
    for i in range(n):
        carried = side - way[i] * (side @ way[i])
        if np.linalg.norm(carried) > 1e-6:
            carried /= np.linalg.norm(carried)
            side = carried if carried @ side >= 0 else -carried
        up = side if i % 2 == 0 else -side
        ca = p[i] + 0.4 * up
        nitrogen = ca - way[i] * N_CA * 0.9 - up * N_CA * np.sqrt(1 - 0.81)
        if last_c is not None:
            link = nitrogen - last_c
            nitrogen = last_c + link / max(np.linalg.norm(link), 1e-9) * C_N
        carbon = ca + way[i] * CA_C * 0.9 - up * CA_C * np.sqrt(1 - 0.81)
        oxygen = carbon + np.cross(way[i], up) * C_O
        out[i] = nitrogen, ca, carbon, oxygen
        last_c = carbon
    return out


def backbones(guide_points: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``(key, residue, name, x, y, z)`` of a strand along each key's points; a path is sequential, so a key is one task's."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        atoms = strand(pdf.sort_values(order)[["x", "y", "z"]].to_numpy(float))
        n = len(atoms)
        flat = atoms.reshape(-1, 3)
        return pd.DataFrame({key: pdf[key].iloc[0], "residue": np.repeat(np.arange(1, n + 1), 4), "name": ["N", "CA", "C", "O"] * n, "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})

    return guide_points.groupBy(key).applyInPandas(run, f"{key} {dict(guide_points.dtypes)[key]}, residue int, name string, x double, y double, z double")


def as_chains(clusters: DataFrame, keys: list[str], rank: str, most: int = 62) -> DataFrame:
    """The clusters of a key that get a chain letter, as many as there are letters."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    w = Window.partitionBy(*keys).orderBy(rank)
    return clusters.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).withColumn("chain", F.substring(F.lit(letters), F.col("_k"), F.lit(1))).drop("_k")
