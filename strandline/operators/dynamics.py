"""Coordinates over frames: distances, correlation, mean structures, superposition, axes, bends."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import distance, full_angle, minus


def pair_distances(frames: DataFrame, keys: list[str], atom: str = "atom", within: float | None = None) -> DataFrame:
    """Distance of each pair of atoms i < j in each frame, of those up to ``within`` if it is given.

    All pairs are a self-join on the frame, so their rows grow with atoms squared; with a reach atoms meet
    those of their own cube and its neighbours alone (see ``in_reach``).
    """
    a = frames.select(*keys, F.col(atom).alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = frames.select(*keys, F.col(atom).alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    d = distance(["ax", "ay", "az"], ["bx", "by", "bz"])
    if within is None:
        return a.join(b, keys).where("i < j").select(*keys, "i", "j", d.alias("d"))
    # half of the neighbours: each pair of cubes meets once, and a cube's own pairs are told by their order
    a = cubes(a, ["ax", "ay", "az"], within, FORWARD)
    b = cubes(b, ["bx", "by", "bz"], within).drop("_own")
    met = a.join(b, [*keys, "_cx", "_cy", "_cz"]).where(((F.col("i") < F.col("j")) | ~F.col("_own")) & (F.col("i") != F.col("j")))
    return met.select(*keys, F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), d.alias("d")).where(F.col("d") <= within)


#: A cube, its neighbours, and half of these.
HERE = [(0, 0, 0)]
AROUND = [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
FORWARD = [c for c in AROUND if c >= (0, 0, 0)]


def cubes(points: DataFrame, axes: list[str], width: float, offsets: list[tuple[int, int, int]] = HERE) -> DataFrame:
    """``points`` with a row for each cube ``_cx, _cy, _cz`` at ``offsets`` from their own, which ``_own`` marks; points without a place are left out.

    Cubes are wider than ``width`` by a billionth, so that rounding takes no point two cubes on.
    """
    found = points.where(" and ".join(f"abs({c}) < double('infinity')" for c in axes))
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(c, "xyz", strict=True)]) for c in offsets]))
    found = found.withColumn("_o", near)
    at = [(F.floor(F.col(c) / F.lit(width * (1 + 1e-9))) + F.col(f"_o.{n}")).alias(f"_c{n}") for c, n in zip(axes, "xyz", strict=True)]
    own = (F.col("_o.x") == 0) & (F.col("_o.y") == 0) & (F.col("_o.z") == 0)
    return found.select(*points.columns, *at, own.alias("_own"))


def in_reach(atoms: DataFrame, targets: DataFrame, keys: list[str], within: float) -> DataFrame:
    """The rows of ``atoms`` within a distance of any of ``targets`` in the same frame: a semi-join over the targets' cubes and their neighbours."""
    t = targets.select(*keys, *[F.col(c).alias(f"_t{c}") for c in "xyz"])
    t = cubes(t, ["_tx", "_ty", "_tz"], within, AROUND).drop("_own")
    a = cubes(atoms, ["x", "y", "z"], within).drop("_own")
    hit = distance(["x", "y", "z"], ["_tx", "_ty", "_tz"]) <= within
    same = [a[c].eqNullSafe(t[c]) if c in keys else a[c] == t[c] for c in [*keys, "_cx", "_cy", "_cz"]]
    return a.join(t, [*same, hit], "left_semi").select(*atoms.columns)


def contact_shares(frames: DataFrame, system: list[str], frame: str, within: float, atom: str = "atom") -> DataFrame:
    """``(system, i, j, n_frames, share, least)`` of pairs that are in contact in some frame: in how many, of all the system's frames, and the least distance."""
    met = pair_distances(frames, [*system, frame], atom, within)
    pairs = met.groupBy(*system, "i", "j").agg(F.count("*").alias("n_frames"), F.min("d").alias("least"))
    whole = frames.groupBy(*system).agg(F.countDistinct(frame).alias("_all"))
    return pairs.join(whole, system).select(*system, "i", "j", "n_frames", (F.col("n_frames") / F.col("_all")).alias("share"), "least")


def distance_statistics(pairs: DataFrame, keys: list[str], cutoffs: tuple[float, ...] = (4.0, 8.0, 12.0), value: str = "d") -> DataFrame:
    """Number, mean, sample variance (0 for one frame) and share of frames under each cutoff, in one mergeable pass."""
    near = [F.avg((F.col(value) < c).cast("double")).alias(f"contact_{int(c)}") for c in cutoffs]
    return pairs.groupBy(*keys, "i", "j").agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("var"), *near)


def frame_blocks(wide: DataFrame, key: str, frame: str, vector: str, atoms: int, per_block: int = 256) -> DataFrame:
    """``(key, i, j, n, mean, m2)`` of all pair distances by blocks of frames, for many atoms: partial moments, a matrix a block.

    ``merge_blocks`` makes them whole. Frames are blocked by number, so one long run spreads over tasks.
    """
    kind = dict(wide.dtypes)[key]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf[vector].to_numpy())[:, : 3 * atoms].astype(float).reshape(len(pdf), atoms, 3)
        n, mean, m2 = 0, np.zeros((atoms, atoms)), np.zeros((atoms, atoms))
        for f in x:
            d = np.sqrt(((f[:, None] - f[None]) ** 2).sum(axis=2))
            n += 1
            step = d - mean
            mean += step / n
            m2 += step * (d - mean)
        i, j = np.triu_indices(atoms, 1)
        return pd.DataFrame({key: pdf[key].iloc[0], "i": i + 1, "j": j + 1, "n": n, "mean": mean[i, j], "m2": m2[i, j]})

    rows = wide.withColumn("_block", F.floor(F.col(frame) / per_block))
    return rows.groupBy(key, "_block").applyInPandas(run, f"{key} {kind}, i int, j int, n long, mean double, m2 double")


def merge_blocks(blocks: DataFrame, keys: list[str], counts: list[str] | None = None) -> DataFrame:
    """Number, mean and sample variance from partial moments, and shares from counts, as one aggregate of sums."""
    n, s, q = F.sum("n"), F.sum(F.col("n") * F.col("mean")), F.sum(F.col("m2") + F.col("n") * F.col("mean") * F.col("mean"))
    return blocks.groupBy(*keys, "i", "j").agg(n.alias("n"), (s / n).alias("mean"), F.when(n > 1, F.greatest(F.lit(0.0), q - s * s / n) / (n - 1)).otherwise(F.lit(0.0)).alias("var"), *[(F.sum(c) / n).alias(c) for c in counts or []])


def frame_vectors(frames: DataFrame, keys: list[str], frame: str = "frame", atom: str = "atom") -> DataFrame:
    """``(keys, frame, atoms, xyz)``: a row a frame, with its atoms in order and their coordinates."""
    points = F.array_sort(F.collect_list(F.struct(F.col(atom).alias("a"), "x", "y", "z")))
    rows = frames.groupBy(*keys, frame).agg(points.alias("_p"))
    return rows.select(*keys, frame, F.transform("_p", lambda p: p["a"]).alias("atoms"), F.flatten(F.transform("_p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("xyz"))


def _by_blocks(frames: DataFrame, keys: list[str], frame: str, atom: str, per_block: int, moments: Callable[[np.ndarray], dict], columns: str) -> DataFrame:
    """``(keys, i, j)`` and what ``moments`` makes of each block of frames ``(frame, atom, 3)`` with the same atoms, a matrix a block."""
    kinds = dict(frames.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names = np.asarray(pdf["atoms"].iloc[0])
        found = moments(np.stack(pdf["xyz"].to_numpy()).reshape(len(pdf), len(names), 3))
        i, j = np.triu_indices(len(names))
        return pd.DataFrame({**{k: pdf[k].iloc[0] for k in keys}, "i": names[i], "j": names[j], "n": len(pdf), **{k: m[i, j] for k, m in found.items()}})

    wide = frame_vectors(frames, keys, frame, atom).withColumn("_block", F.floor(F.col(frame) / per_block))
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), f"i {kinds[atom]}", f"j {kinds[atom]}", "n long", columns])
    return wide.groupBy(*keys, "_block", "atoms").applyInPandas(run, schema)


def distance_blocks(frames: DataFrame, keys: list[str], frame: str = "frame", atom: str = "atom", per_block: int = 256, cutoffs: tuple[float, ...] = ()) -> DataFrame:
    """Number, mean, sample variance and shares under ``cutoffs`` of each pair's distance, as ``distance_statistics`` gives them, by partial moments of blocks of frames.

    Rows are pairs times blocks, not pairs times frames.
    """
    near = [f"contact_{int(c)}" for c in cutoffs]

    def moments(x: np.ndarray) -> dict:
        size = (x.shape[1], x.shape[1])
        mean, m2, under = np.zeros(size), np.zeros(size), [np.zeros(size) for _ in cutoffs]
        for n, f in enumerate(x, 1):
            d = np.sqrt(((f[:, None] - f[None]) ** 2).sum(axis=2))
            step = d - mean
            mean += step / n
            m2 += step * (d - mean)
            for k, c in enumerate(cutoffs):
                under[k] += d < c
        return {"mean": mean, "m2": m2, **dict(zip(near, under, strict=True))}

    blocks = _by_blocks(frames, keys, frame, atom, per_block, moments, ", ".join(["mean double", "m2 double", *(f"{c} double" for c in near)])).where("i < j")
    return merge_blocks(blocks, keys, near)


def correlation_blocks(frames: DataFrame, keys: list[str], frame: str = "frame", atom: str = "atom", per_block: int = 256) -> DataFrame:
    """``(i, j, c)`` for i <= j as ``cross_correlation`` gives it, by partial co-moments of blocks of frames."""

    def moments(x: np.ndarray) -> dict:
        mean = x.mean(axis=0)
        d = (x - mean).transpose(1, 0, 2).reshape(x.shape[1], -1)
        own = np.broadcast_to(mean[:, None, :], (len(mean), len(mean), 3))
        return {"c": d @ d.T, **{f"{a}{c}": own[:, :, k] if a == "a" else own[:, :, k].T for a in "ab" for k, c in enumerate("xyz")}}

    blocks = _by_blocks(frames, keys, frame, atom, per_block, moments, ", ".join(["c double", *(f"{a}{c} double" for a in "ab" for c in "xyz")]))
    n = F.sum("n")
    # the blocks' own co-moments, and those of their means about the mean of all
    between = sum((F.sum(F.col("n") * F.col(f"a{c}") * F.col(f"b{c}")) - F.sum(F.col("n") * F.col(f"a{c}")) * F.sum(F.col("n") * F.col(f"b{c}")) / n for c in "xyz"), F.lit(0.0))
    dots = blocks.groupBy(*keys, "i", "j").agg(((F.sum("c") + between) / n).alias("p"))
    own = dots.where("i = j")
    out = dots.join(own.select(*keys, "i", F.col("p").alias("pi")), [*keys, "i"]).join(own.select(*keys, "j", F.col("p").alias("pj")), [*keys, "j"])
    return out.select(*keys, "i", "j", (F.col("p") / F.sqrt(F.col("pi") * F.col("pj"))).alias("c"))


def cross_correlation(frames: DataFrame, keys: list[str], frame: str = "frame", atom: str = "atom") -> DataFrame:
    """``(i, j, c)`` for i <= j: mean product of deviations from mean positions over the root of their mean squares."""
    mean = frames.groupBy(*keys, atom).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    d = frames.join(mean, [*keys, atom]).select(*keys, frame, F.col(atom), (F.col("x") - F.col("mx")).alias("x"), (F.col("y") - F.col("my")).alias("y"), (F.col("z") - F.col("mz")).alias("z"))
    a = d.select(*keys, frame, F.col(atom).alias("i"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = d.select(*keys, frame, F.col(atom).alias("j"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    dots = a.join(b, [*keys, frame]).where("i <= j").groupBy(*keys, "i", "j").agg(F.avg(F.col("ax") * F.col("bx") + F.col("ay") * F.col("by") + F.col("az") * F.col("bz")).alias("p"))
    own = dots.where("i = j")
    out = dots.join(own.select(*keys, "i", F.col("p").alias("pi")), [*keys, "i"]).join(own.select(*keys, "j", F.col("p").alias("pj")), [*keys, "j"])
    return out.select(*keys, "i", "j", (F.col("p") / F.sqrt(F.col("pi") * F.col("pj"))).alias("c"))


def mean_structure(frames: DataFrame, system: list[str], replica: list[str], atom: str = "atom") -> DataFrame:
    """Mean over replicas of each replica's mean, whatever their numbers of frames."""
    each = frames.groupBy(*system, *replica, atom).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))
    return each.groupBy(*system, atom).agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("z").alias("z"))


def offset_pairs(frames: DataFrame, keys: list[str], chain: str, shifted: Column) -> DataFrame:
    """Distance of each row to the row of the same keys whose chain is ``shifted``, an expression of the row's."""
    a = frames.select(*keys, F.col(chain).alias("chain"), shifted.alias("other"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("z").alias("az"))
    b = frames.select(*keys, F.col(chain).alias("other"), F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    return a.join(b, [*keys, "other"]).select(*keys, "chain", "other", distance(["ax", "ay", "az"], ["bx", "by", "bz"]).alias("d"))


def principal_axis(points: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, ax, ay, az, spread)``: the first principal axis of each group's points; its sign is arbitrary.

    The 3 x 3 covariance is a partial aggregate; only it goes to numpy.
    """
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    cov = points.groupBy(*keys).agg(F.array(*[F.covar_pop(a, b) for a, b in pairs]).alias("cov"))

    @F.pandas_udf("ax double, ay double, az double, spread double")
    def axis(c: pd.Series) -> pd.DataFrame:
        m = np.stack(c.to_numpy())[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3)
        values, vectors = np.linalg.eigh(m)
        return pd.DataFrame(np.column_stack([vectors[:, :, 2], values[:, 2]]), columns=["ax", "ay", "az", "spread"])

    return cov.withColumn("a", axis("cov")).select(*keys, "a.*")


def superpose(mobile: DataFrame, fixed: DataFrame, keys: list[str], atom: str = "atom") -> DataFrame:
    """``mobile`` laid on ``fixed`` by the rigid motion of least squares, each group of ``keys`` by its own.

    Centres and the 3 x 3 products of both are partial aggregates; the rotation is made from them and
    goes back to the atoms by a join. Reflections are ruled out.
    """
    f = fixed.select(F.col(atom), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    j = mobile.join(f, atom)
    ms, fs = ["x", "y", "z"], ["fx", "fy", "fz"]
    sums = j.groupBy(*keys).agg(F.array(*[F.avg(c) for c in ms]).alias("mc"), F.array(*[F.avg(c) for c in fs]).alias("fc"), F.array(*[F.covar_pop(a, b) for a in ms for b in fs]).alias("h"))

    @F.pandas_udf("array<double>")
    def rotation(h: pd.Series) -> pd.Series:
        m = np.stack(h.to_numpy()).reshape(-1, 3, 3)
        u, _, vt = np.linalg.svd(m)
        turn = np.sign(np.linalg.det(u @ vt))
        u[:, :, 2] *= turn[:, None]
        return pd.Series(list((u @ vt).reshape(-1, 9)))

    r = sums.withColumn("r", rotation("h"))
    moved = mobile.join(r.select(*keys, "mc", "fc", "r"), keys)
    d = [F.col(c) - F.col("mc")[k] for k, c in enumerate(ms)]
    new = [(d[0] * F.col("r")[k] + d[1] * F.col("r")[3 + k] + d[2] * F.col("r")[6 + k] + F.col("fc")[k]).alias(c) for k, c in enumerate(ms)]
    return moved.select(*keys, F.col(atom), *new)


def rmsd(a: DataFrame, b: DataFrame, keys: list[str], atom: str = "atom") -> DataFrame:
    f = b.select(F.col(atom), F.col("x").alias("fx"), F.col("y").alias("fy"), F.col("z").alias("fz"))
    d = distance(["x", "y", "z"], ["fx", "fy", "fz"])
    return a.join(f, atom).groupBy(*keys).agg(F.sqrt(F.avg(d * d)).alias("rmsd"))


def displacement(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """b less a for the atoms that both have, and its length."""
    other = b.select(*keys, F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"))
    d = minus(["bx", "by", "bz"], ["x", "y", "z"])
    out = a.join(other, keys).select(*keys, d[0].alias("dx"), d[1].alias("dy"), d[2].alias("dz"))
    return out.withColumn("norm", F.sqrt(F.col("dx") ** 2 + F.col("dy") ** 2 + F.col("dz") ** 2))


def local_bend(points: DataFrame, keys: list[str], order: str = "atom", step: int = 2) -> DataFrame:
    """At each point the angle between the way from ``step`` places before and the way to ``step`` places after; null at the ends.

    180 less that angle, so a straight run gives 180.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    before = [F.lag(c, step).over(w) for c in "xyz"]
    after = [F.lead(c, step).over(w) for c in "xyz"]
    out = points.select(*keys, order, "x", "y", "z", *[b.alias(f"b{c}") for b, c in zip(before, "xyz", strict=True)], *[a.alias(f"a{c}") for a, c in zip(after, "xyz", strict=True)])
    back, on = minus(["x", "y", "z"], ["bx", "by", "bz"]), minus(["ax", "ay", "az"], ["x", "y", "z"])
    return out.select(*keys, order, (F.lit(180.0) - full_angle(back, on)).alias("bend"))


def ensemble_check(frames: DataFrame, system: list[str], replica: str, frame: str = "frame") -> DataFrame:
    """Whether a system's replicas have the same numbers of atoms in all frames, and of frames."""
    each = frames.groupBy(*system, replica, frame).agg(F.count("*").alias("atoms"))
    reps = each.groupBy(*system, replica).agg(F.count("*").alias("frames"), F.min("atoms").alias("low"), F.max("atoms").alias("high"))
    return reps.groupBy(*system).agg(F.count("*").alias("replicas"), (F.min("low") == F.max("high")).alias("atoms_agree"), (F.min("frames") == F.max("frames")).alias("frames_agree"))


def starts_at_mean(frames: DataFrame, mean: DataFrame, system: list[str], replica: str, frame: str = "frame", atom: str = "atom", least: float = 1e-3) -> DataFrame:
    """``(system, least_rmsd, matches_initial)``: the smallest distance of a replica's first frame to the mean, and whether it is that frame.

    ``mean`` is ``(system, atom, x, y, z)``; the distance is the root of the mean square over atoms.
    """
    first = frames.join(frames.groupBy(*system, replica).agg(F.min(frame).alias(frame)), [*system, replica, frame], "left_semi")
    m = mean.select(*system, atom, *[F.col(c).alias(f"m{c}") for c in "xyz"])
    gap = sum(((F.col(c) - F.col(f"m{c}")) ** 2 for c in "xyz"), F.lit(0.0))
    each = first.join(m, [*system, atom]).groupBy(*system, replica).agg(F.sqrt(F.avg(gap)).alias("rmsd"))
    return each.groupBy(*system).agg(F.min("rmsd").alias("least_rmsd")).withColumn("matches_initial", F.col("least_rmsd") < least)


def pair_similarity(points: DataFrame, keys: list[str], atom: str = "atom", sigma: float = 8.0, least: float | None = None) -> DataFrame:
    """``(i, j, similarity)`` in both orders without the diagonal: distance decayed by ``sigma``; of those from ``least`` on if it is given, without all pairs."""
    within = None if least is None else -sigma * math.log(least)
    d = pair_distances(points, keys, atom, within).select(*keys, "i", "j", F.exp(-F.col("d") / F.lit(sigma)).alias("similarity"))
    return d.unionByName(d.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "similarity"))
