"""Normal modes of an elastic network and what is made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRIVIAL = 6


def hessian(x: np.ndarray) -> np.ndarray:
    """Second derivatives of a C-alpha network with pair constants that are linear at short and a sixth power at long distance.

    Constants after Hinsen and others, 2000, in kJ / (mol nm2), distances in angstroms.
    """
    n = len(x)
    d = x[:, None] - x[None]
    r2 = (d**2).sum(axis=2)
    np.fill_diagonal(r2, 1.0)
    r = np.sqrt(r2)
    # The published force constants.
    k = np.where(r < 4.0, 8.6e2 * r - 2.39e3, 128e4 / np.maximum(r, 1e-6) ** 6)
    k = np.maximum(k, 0.0)
    np.fill_diagonal(k, 0.0)
    block = -(k / r2)[:, :, None, None] * d[:, :, :, None] * d[:, :, None, :]
    block[np.arange(n), np.arange(n)] = -block.sum(axis=1)
    return block.transpose(0, 2, 1, 3).reshape(3 * n, 3 * n)


def normal_modes(atoms: DataFrame, key: str, order: str = "atom", most: int = 206) -> DataFrame:
    """``(key, mode, eigenvalue, vec)`` from the stiffest axis of least motion up, the six trivial modes first; one structure a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        values, vectors = np.linalg.eigh(hessian(pdf[["x", "y", "z"]].to_numpy(float)))
        k = min(most, len(values))
        return pd.DataFrame({key: pdf[key].iloc[0], "mode": np.arange(1, k + 1), "eigenvalue": values[:k], "vec": list(vectors[:, :k].T)})

    return atoms.groupBy(key).applyInPandas(run, f"{key} {dict(atoms.dtypes)[key]}, mode int, eigenvalue double, vec array<double>")


def components(modes: DataFrame, key: str) -> DataFrame:
    """One row a mode and atom: ``x, y, z`` of its vector."""
    n = (F.size("vec") / 3).cast("int")
    at = lambda k: F.element_at("vec", F.col("atom") * 3 - k)
    return modes.withColumn("atom", F.explode(F.sequence(F.lit(1), n))).select(key, "mode", "eigenvalue", "atom", at(2).alias("x"), at(1).alias("y"), at(0).alias("z"))


def fluctuations(modes: DataFrame, key: str, first: int = TRIVIAL + 1, last: int = TRIVIAL + 200) -> DataFrame:
    """Sum over modes of squared motion over eigenvalue, for each atom."""
    c = components(modes.where(F.col("mode").between(first, last)), key)
    return c.groupBy(key, "atom").agg(F.sum((F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2) / F.col("eigenvalue")).alias("fluctuation"))


def mode_correlation(modes: DataFrame, key: str, first: int = TRIVIAL + 1) -> DataFrame:
    """Cross-correlation of atoms from modes, i <= j: a self-join on the mode."""
    c = components(modes.where(F.col("mode") >= first), key)
    a = c.select(key, "mode", "eigenvalue", F.col("atom").alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = c.select(key, "mode", F.col("atom").alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    p = a.join(b, [key, "mode"]).where("i <= j").groupBy(key, "i", "j").agg(F.sum((F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")) / F.col("eigenvalue")).alias("p"))
    own = p.where("i = j")
    out = p.join(own.select(key, "i", F.col("p").alias("pi")), [key, "i"]).join(own.select(key, "j", F.col("p").alias("pj")), [key, "j"])
    return out.select(key, "i", "j", (F.col("p") / F.sqrt(F.col("pi") * F.col("pj"))).alias("c"))


def dot_arrays(a: str, b: str) -> F.Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def rmsip(modes: DataFrame, key: str, n: int = 10) -> DataFrame:
    """Root mean square inner product of the first n modes of each two structures of the same size."""
    low = modes.where(F.col("mode").between(TRIVIAL + 1, TRIVIAL + n))
    a = low.select(F.col(key).alias("first"), F.size("vec").alias("size"), "mode", F.col("vec").alias("u"))
    b = low.select(F.col(key).alias("second"), F.size("vec").alias("size"), F.col("mode").alias("other"), F.col("vec").alias("v"))
    pairs = a.join(b, "size").where("first < second")
    d = dot_arrays("u", "v")
    out = pairs.groupBy("first", "second").agg(F.sqrt(F.sum(d * d) / n).alias("rmsip"))
    return out.withColumn("converged", F.col("rmsip") > 0.7)


def overlaps(modes: DataFrame, displacement: DataFrame, key: str, most: int = 200) -> DataFrame:
    """Squared overlap of each mode with a displacement ``(key, atom, dx, dy, dz)``, and its running sum."""
    c = components(modes.where(F.col("mode") > TRIVIAL).where(F.col("mode") <= TRIVIAL + most), key).join(displacement, [key, "atom"])
    g = c.groupBy(key, "mode").agg(F.sum(F.col("x") * F.col("dx") + F.col("y") * F.col("dy") + F.col("z") * F.col("dz")).alias("p"), F.sum(F.col("x") ** 2 + F.col("y") ** 2 + F.col("z") ** 2).alias("u"), F.sum(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2).alias("d"))
    o = g.select(key, "mode", F.when(F.col("u") * F.col("d") > 0, F.col("p") ** 2 / (F.col("u") * F.col("d"))).otherwise(0.0).alias("overlap"))
    return o.withColumn("cumulative", F.sum("overlap").over(Window.partitionBy(key).orderBy("mode").rowsBetween(Window.unboundedPreceding, 0)))


def mode_path(modes: DataFrame, atoms: DataFrame, key: str, mode: int = TRIVIAL + 1, frames: int = 40, reach: float = 4.0) -> DataFrame:
    """Atoms moved along a mode there and back, ``reach`` deviations each way."""
    c = components(modes.where(F.col("mode") == mode), key).withColumnsRenamed({"x": "ux", "y": "uy", "z": "uz"})
    at = F.sin(F.lit(2 * np.pi) * F.col("frame") / frames) * reach / F.sqrt(F.greatest(F.col("eigenvalue"), F.lit(1e-9)))
    return c.join(atoms, [key, "atom"]).withColumn("frame", F.explode(F.sequence(F.lit(1), F.lit(frames)))).select(key, "frame", "atom", *[(F.col(x) + at * F.col(f"u{x}")).alias(x) for x in "xyz"])


def deformation(modes: DataFrame, atoms: DataFrame, key: str, chosen: list[int]) -> DataFrame:
    """Local deformation of each atom over chosen non-trivial modes: half the energy of its pair springs, per mode energy.

    Pairs meet by a self-join on structure and mode; the spring constants are those of the network.
    """
    c = components(modes.where(F.col("mode").isin([m + TRIVIAL for m in chosen])), key).withColumnsRenamed({"x": "ux", "y": "uy", "z": "uz"}).join(atoms, [key, "atom"])
    a, b = c, c.select(key, "mode", *[F.col(n).alias(f"o_{n}") for n in ("atom", "x", "y", "z", "ux", "uy", "uz")])
    p = a.join(b, [key, "mode"]).where("atom <> o_atom")
    d = [F.col(x) - F.col(f"o_{x}") for x in "xyz"]
    r2 = d[0] ** 2 + d[1] ** 2 + d[2] ** 2
    r = F.sqrt(r2)
    k = F.greatest(F.lit(0.0), F.when(r < 4.0, 8.6e2 * r - 2.39e3).otherwise(F.lit(128e4) / (r2 * r2 * r2)))
    along = sum((F.col(f"u{x}") - F.col(f"o_u{x}")) * d[i] for i, x in enumerate("xyz")) / r
    each = p.groupBy(key, "atom", "mode", "eigenvalue").agg((F.sum(k * along * along) / 2).alias("e"))
    return each.groupBy(key, "atom").agg(F.sum(F.col("e") / F.greatest(F.abs("eigenvalue"), F.lit(1e-9))).alias("deformation"))
