"""Distributions: one or two normal components by BIC, density curves."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .series import quantile_limits

GRID = 300


def _normal(x: np.ndarray, mean: float, sd: float) -> np.ndarray:
    return np.exp(-0.5 * ((x - mean) / sd) ** 2) / (sd * np.sqrt(2 * np.pi))


def fit_two(x: np.ndarray, equal: bool, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log likelihood, weights, means and deviations of two normals by expectation maximisation from the halves."""
    s = np.sort(x)
    halves = (s[: len(s) // 2], s[len(s) // 2 :])
    w, m = np.array([0.5, 0.5]), np.array([h.mean() for h in halves])
    floor = max(1e-6, 1e-3 * x.std())
    sd = np.maximum([h.std() for h in halves], floor)
    last = -np.inf
    for _ in range(rounds):
        p = np.stack([w[k] * _normal(x, m[k], sd[k]) for k in (0, 1)]) + 1e-300
        like = float(np.log(p.sum(axis=0)).sum())
        r = p / p.sum(axis=0)
        n = r.sum(axis=1)
        w, m = n / len(x), (r @ x) / n
        var = np.array([(r[k] * (x - m[k]) ** 2).sum() for k in (0, 1)])
        sd = np.maximum(np.sqrt(np.full(2, var.sum() / len(x)) if equal else var / n), floor)
        if like - last < 1e-8 * abs(like):
            break
        last = like
    return like, w, m, sd


def _decide(n: int, spread: float, mean: float, sd: float, base: float, fits: list[tuple], least_weight: float = 0.10, least_apart: float = 0.50) -> dict:
    """``choose`` from figures alone: ``base`` is one component's log likelihood, ``fits`` are those of two, of equal deviations and of own ones."""
    one = {"components": 1, "weights": [1.0], "means": [float(mean)], "sds": [float(sd) if sd > 0 else 1.0]}
    if n <= 10 or spread <= 0:
        return one
    bic = lambda like, k: 2 * like - k * np.log(n)
    best, (_, w, m, s) = max(((bic(f[0], k), f) for k, f in zip((4, 5), fits, strict=True)), key=lambda x: x[0])
    if best > bic(base, 2) and w.min() >= least_weight and abs(m[0] - m[1]) / s.mean() >= least_apart:
        order = np.argsort(m)
        return {"components": 2, "weights": w[order].tolist(), "means": m[order].tolist(), "sds": s[order].tolist()}
    return one


def choose(x: np.ndarray, least_weight: float = 0.10, least_apart: float = 0.50) -> dict:
    """Two components where BIC prefers them, each has weight enough and their means are apart; else one."""
    sd = x.std(ddof=1) if len(x) > 1 else 0.0
    plain = len(x) <= 10 or np.ptp(x) <= 0
    base = 0.0 if plain else float(np.log(_normal(x, x.mean(), x.std()) + 1e-300).sum())
    return _decide(len(x), float(np.ptp(x)), x.mean(), sd, base, [] if plain else [fit_two(x, e) for e in (True, False)], least_weight, least_apart)


#: Bins between a group's least and largest value that mixtures are fitted to. Values of a bin share the place of their
#: mean, so a figure is off by about a 24th of the square of a bin's width over the component's deviation.
FINE = 1 << 16


def fit_binned(n: np.ndarray, at: np.ndarray, spread: np.ndarray, start: tuple[np.ndarray, np.ndarray], floor: float, equal: bool, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """``fit_two`` on ``n`` values at each place, whose squares add up to ``spread`` about it; ``start`` has means and deviations."""
    total = n.sum()
    w, (m, sd) = np.array([0.5, 0.5]), start
    sd = np.maximum(sd, floor)
    last = -np.inf
    for _ in range(rounds):
        p = np.stack([w[k] * _normal(at, m[k], sd[k]) for k in (0, 1)]) + 1e-300
        like = float((n * np.log(p.sum(axis=0))).sum())
        r = p / p.sum(axis=0)
        own = r @ n
        w, m = own / total, (r @ (n * at)) / own
        var = np.array([(r[k] * (n * (at - m[k]) ** 2 + spread)).sum() for k in (0, 1)])
        sd = np.maximum(np.sqrt(np.full(2, var.sum() / total) if equal else var / own), floor)
        if like - last < 1e-8 * abs(like):
            break
        last = like
    return like, w, m, sd


def mixtures(df: DataFrame, key: str, value: str, keep: Callable[[DataFrame], DataFrame] | None = None, rounds: int = 200, fine: int = FINE) -> DataFrame:
    """``(key, n, low, high, components, weights, means, sds)`` of each group's finite values, as ``choose`` gives them.

    A group's values are aggregated once, to at most ``fine`` bins with number, mean and squares about it, and
    its mixtures are fitted to these in one task; nothing goes through the driver. The halves that a fit starts from are cut at
    an approximate median, exact up to 100,000 values.
    """
    kind, x = dict(df.dtypes)[key], F.col("_x")
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value)).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_x"))
    rows = keep(rows) if keep else rows
    figures = rows.groupBy("_k").agg(F.count("*").alias("n"), F.min(x).alias("low"), F.max(x).alias("high"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.percentile_approx(x, 0.5, 100_000).alias("mid")).withColumnRenamed("_k", "_key")
    figures = keep(figures) if keep else figures
    met = rows.join(figures, F.col("_k").eqNullSafe(F.col("_key")))
    # values under the middle, at it and above it are told apart, so that halves are those of the values
    side = F.signum(x - F.col("mid")).cast("int")
    width = (F.col("high") - F.col("low")) / fine
    bin_ = F.when(width > 0, F.least(F.floor((x - F.col("low")) / width), F.lit(fine - 1))).otherwise(0)
    d = x - F.col("mean")
    bins = met.withColumn("_d", d).groupBy("_key", bin_.alias("_bin"), side.alias("_side")).agg(F.count("*").alias("c"), F.avg("_d").alias("m"), (F.count("*") * F.var_pop("_d")).alias("q"))
    bins = bins.withColumnRenamed("_key", "_k").join(figures, F.col("_k").eqNullSafe(F.col("_key")))

    def fit(t: pa.Table) -> pa.Table:
        t = t.sort_by([("_bin", "ascending"), ("_side", "ascending")])
        r = t.slice(0, 1).to_pylist()[0]
        c, m, q, side = (t[name].to_numpy().astype(float) for name in ("c", "m", "q", "_side"))
        n, pop = r["n"], r["sd"]
        fits, base = [], 0.0
        if n > 10 and r["high"] > r["low"]:
            less, equal = c[side < 0].sum(), c[side == 0].sum()
            take = min(max(n // 2 - less, 0), equal)
            first = np.where(side < 0, 1.0, np.where(side == 0, take / max(equal, 1), 0.0))
            halves = [(w * c, (w * c * m).sum() / (w * c).sum()) for w in (first, 1 - first)]
            sds = [np.sqrt(max(0.0, ((w * ((m - at) ** 2)).sum() + (w / c * q).sum()) / w.sum())) for w, at in halves]
            start = np.array([at for _, at in halves]), np.array(sds)
            floor = max(1e-6, 1e-3 * pop)
            fits = [fit_binned(c, m, q, start, floor, e, rounds) for e in (True, False)]
            base = float((c * np.log(_normal(m, 0.0, pop) + 1e-300)).sum() - 0.5 * q.sum() / pop**2)
        sd = pop * np.sqrt(n / (n - 1)) if n > 1 else 0.0
        out = _decide(n, r["high"] - r["low"], 0.0, sd, base, fits)
        row = {key: r["_k"], "n": n, "low": r["low"], "high": r["high"], "components": out["components"], "weights": out["weights"], "means": [x + r["mean"] for x in out["means"]], "sds": out["sds"]}
        many = pa.list_(pa.float64())
        return pa.Table.from_pylist([row], pa.schema([(key, t.schema.field("_k").type), ("n", pa.int64()), ("low", pa.float64()), ("high", pa.float64()), ("components", pa.int32()), ("weights", many), ("means", many), ("sds", many)]))

    schema = f"{key} {kind}, n long, low double, high double, components int, weights array<double>, means array<double>, sds array<double>"
    return bins.drop("_key").groupBy("_k").applyInArrow(fit, schema)


def density_curve(mix: DataFrame, key: str, bins: int = 35, points: int = GRID) -> DataFrame:
    """Each group's density over a grid from its least to its largest value, and scaled to counts of ``bins`` bins."""
    rows = mix.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("low") + F.col("k") * (F.col("high") - F.col("low")) / (points - 1))
    part = F.transform(F.arrays_zip("weights", "means", "sds"), lambda s: s["weights"] * F.exp(-0.5 * F.pow((F.col("x") - s["means"]) / s["sds"], 2)) / (s["sds"] * float(np.sqrt(2 * np.pi))))
    density = F.aggregate(part, F.lit(0.0), lambda a, b: a + b)
    return rows.select(key, "k", "x", density.alias("density"), (density * F.col("n") * (F.col("high") - F.col("low")) / bins).alias("count"))


#: Bins of a bandwidth, terms of the expansion about a bin's middle, and bandwidths beyond which a value adds nothing. An
#: eighth of a bandwidth to the eighth power over the root of 8! leaves an error under 1e-9 of a value's peak.
PER_BANDWIDTH, TERMS, REACH = 4, 8, 9.0


def _hermite(terms: int) -> list[list[int]]:
    """Coefficients of the Hermite polynomials He_0, He_1 and so on."""
    out = [[1], [0, 1]]
    for p in range(1, terms - 1):
        last = [0, *out[p]]
        out.append([a - p * b for a, b in zip(last, [*out[p - 1], 0, 0], strict=True)])
    return out[:terms]


def kernel_density(df: DataFrame, key: str, value: str, points: int = 64) -> DataFrame:
    """Gaussian kernel density on a grid that goes three bandwidths beyond the values; Silverman's bandwidth.

    Values are aggregated to bins of a quarter of the bandwidth with sums of their powers about the bin's middle,
    from which the sum of their kernels follows at any place by Hermite polynomials; bins, not values, meet the grid, each
    at the places in its reach.
    """
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(value))
    s = rows.groupBy(key).agg(F.count("*").alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"), F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("sd"))
    s = s.join(quantile_limits(rows, [key], value, {"q1": 0.25, "q3": 0.75}), key)
    spread = F.when(F.col("q3") > F.col("q1"), F.least(F.col("sd"), (F.col("q3") - F.col("q1")) / 1.34)).otherwise(F.col("sd"))
    s = s.withColumn("h", F.greatest(F.lit(0.9) * spread * F.pow(F.col("n"), F.lit(-0.2)), F.lit(1e-9)))
    s = s.withColumn("_step", (F.col("hi") - F.col("lo") + 6 * F.col("h")) / (points - 1)).select(key, "n", "lo", "hi", "h", "_step")
    middle = (F.floor((F.col(value) - F.col("lo")) / F.col("h") * PER_BANDWIDTH) + 0.5) / PER_BANDWIDTH  # in bandwidths above the least
    placed = rows.select(key, value).join(s, key).withColumn("_c", middle).withColumn("_d", (F.col(value) - F.col("lo")) / F.col("h") - F.col("_c"))
    sums = [(F.sum(F.pow("_d", F.lit(p))) / math.factorial(p)).alias(f"_m{p}") for p in range(TERMS)]
    bins = placed.groupBy(key, "_c").agg(*sums).join(s, key)
    place = lambda away: (F.col("_c") + 3 + away) * F.col("h") / F.col("_step")  # noqa: E731  in steps of the grid
    low, high = F.greatest(F.lit(0), F.floor(place(-REACH))), F.least(F.lit(points - 1), F.ceil(place(REACH)))
    met = bins.withColumn("k", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    met = met.withColumn("_u", F.col("k") * F.col("_step") / F.col("h") - 3 - F.col("_c"))
    table = _hermite(TERMS)
    whole = F.lit(0.0)
    for q in range(TERMS - 1, -1, -1):  # one polynomial of the place, from the highest power down
        whole = whole * F.col("_u") + sum((F.col(f"_m{p}") * float(table[p][q]) for p in range(q, TERMS) if table[p][q]), F.lit(0.0))
    total = met.groupBy(key, "k").agg(F.sum(whole * F.exp(-0.5 * F.col("_u") * F.col("_u"))).alias("_sum"))
    grid = s.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", F.col("lo") - 3 * F.col("h") + F.col("k") * F.col("_step"))
    return grid.join(total, [key, "k"], "left").select(key, "k", "x", (F.coalesce("_sum", F.lit(0.0)) / (F.col("n") * F.col("h") * float(np.sqrt(2 * np.pi)))).alias("density"))
