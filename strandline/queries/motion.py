"""Queries over time series and frames of atoms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import acute_angle, full_angle, mid_vector_angle, triangle_angle
from ..functions.labels import shift_chain
from ..operators import build3d, dynamics, matrix, series, stats
from ..plans import studies
from ..proxies import FRAMES_SQL, SERIES_SQL, frame_points, frames, table
from ..proxies import series as series_of
from .common import registry, rounded
from .graphs import keep

QUERIES, ORACLES, _query = registry()


@_query(f"""WITH {SERIES_SQL} SELECT chain, frame, round((frame - 1) * 0.1::DOUBLE, 6) AS time_ns, value,
  round(CASE WHEN count(value) OVER w = 5 THEN avg(value) OVER w END, 6) AS smooth FROM series WINDOW w AS (PARTITION BY chain ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def roll5_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = series.rolling_mean(series_of(spark, sf_dir), ["chain"], "frame", "value")
    return s.select("chain", "frame", F.round(series.frame_time(F.col("frame")), 6).alias("time_ns"), "value", F.round("smooth", 6).alias("smooth"))


@_query(f"WITH {SERIES_SQL} SELECT condition, chain, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM series GROUP BY 1, 2")
def angle_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.summary(series_of(spark, sf_dir), ["condition", "chain"], "value"))


@_query(f"WITH {SERIES_SQL} SELECT condition, min(value) AS low, max(value) AS high FROM series GROUP BY 1")
def angle_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.value_range(series_of(spark, sf_dir), ["condition"], "value")


@_query(f"WITH {SERIES_SQL} SELECT condition, frame, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, count(*) AS n FROM series GROUP BY 1, 2")
def mean_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.summary(series_of(spark, sf_dir), ["condition", "frame"], "value"))


@_query(f"WITH {SERIES_SQL} SELECT chain, frame, value FROM series WHERE frame > 11 AND (frame - 12) % 3 = 0 AND frame <= 60")
def burnin_stride(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.burn_in(series.finite(series_of(spark, sf_dir), "value"), drop=11, stride=3, last=60).select("chain", "frame", "value")


@_query(f"""WITH {SERIES_SQL}, v AS (SELECT condition, chain, var_samp(value) AS variance FROM series GROUP BY 1, 2)
  SELECT condition, round(avg(variance), 4) AS mean_variance, round(stddev_samp(variance) / sqrt(count(*)), 4) AS se FROM v GROUP BY 1""")
def variance_by_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.mean_of_variances(series_of(spark, sf_dir), "chain", ["condition"], "value"), 4)


@_query(f"WITH {SERIES_SQL} SELECT condition, round(quantile_cont(value, 0.05), 4) AS q05, round(quantile_cont(value, 0.95), 4) AS q95, round(quantile_cont(value, 0.995), 4) AS q995 FROM series GROUP BY 1")
def quantile_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.quantile_limits(series_of(spark, sf_dir), ["condition"], "value", {"q05": 0.05, "q95": 0.95, "q995": 0.995}), 4)


@_query(f"""WITH {SERIES_SQL}, l AS (SELECT min(value) AS a, max(value) AS b FROM series)
  SELECT condition, least(floor((value - a) / ((b - a) / 35.0::DOUBLE)), 34)::INTEGER AS bin, count(*) AS n FROM series, l GROUP BY 1, 2""")
def histogram35(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.histogram(series_of(spark, sf_dir), ["condition"], "value")


@_query(f"""WITH {SERIES_SQL}, t AS (SELECT chain, frame, avg(value) AS v FROM series WHERE condition IN ('click', 'view') GROUP BY 1, 2)
  SELECT frame, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n FROM t GROUP BY 1""")
def curve_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    picked = series_of(spark, sf_dir).where(F.col("condition").isin("click", "view")).groupBy("chain", "frame").agg(F.avg("value").alias("v"))
    return rounded(series.summary(picked, ["frame"], "v"))


@_query(f"WITH {SERIES_SQL} SELECT round(max(value) * 1.05::DOUBLE, 6) AS \"limit\" FROM series")
def common_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.common_limit(series_of(spark, sf_dir), "value"))


@_query(f"""WITH {SERIES_SQL}, c AS (SELECT condition, frame, sum(value::DECIMAL(18,4))::DOUBLE AS v FROM series GROUP BY 1, 2), s AS (SELECT condition, frame, v, sum(v) OVER (PARTITION BY condition ORDER BY frame ROWS UNBOUNDED PRECEDING) / sum(v) OVER (PARTITION BY condition) AS share FROM c)
  SELECT condition, frame, round(share, 6) AS share, min(CASE WHEN share >= 0.8 THEN frame END) OVER (PARTITION BY condition) AS first_at FROM s""")
def cumulative_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = series_of(spark, sf_dir).groupBy("condition", "frame").agg(F.sum(F.col("value").cast("decimal(18,4)")).cast("double").alias("v"))
    return rounded(series.cumulative_share(c, ["condition"], "frame", "v").drop("v"))


@_query(f"WITH {SERIES_SQL} SELECT condition, CASE WHEN avg((value IS NULL OR isnan(value))::INTEGER) > 0.5 OR avg((value = 0)::INTEGER) > 0.9 THEN 'WARN' ELSE 'OK' END AS flag FROM series GROUP BY 1")
def quality_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.quality_flag(series_of(spark, sf_dir), ["condition"], "value")


_D = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z))"
_PAIRS = f"{FRAMES_SQL}, pairs AS (SELECT a.system, a.frame, a.atom AS i, b.atom AS j, {_D} AS d FROM frames a JOIN frames b ON a.system = b.system AND a.frame = b.frame AND a.atom < b.atom)"


@_query(f"""WITH {_PAIRS} SELECT system, i, j, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(var_samp(d), 0.0), 6) AS var,
  round(avg((d < 0.1)::INTEGER), 6) AS contact_0, round(avg((d < 1)::INTEGER), 6) AS contact_1 FROM pairs GROUP BY 1, 2, 3""")
def dist_welford(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.distance_blocks(frames(spark, sf_dir), ["system"], cutoffs=(0.1, 1.0)))


@_query(f"WITH {_PAIRS} SELECT system, i, j, count(*) AS n, round(avg(d), 6) AS mean, round(coalesce(var_samp(d), 0.0), 6) AS var FROM pairs GROUP BY 1, 2, 3")
def dist_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("system"), F.col("vec_id").alias("frame"), "embedding")
    return rounded(dynamics.merge_blocks(dynamics.frame_blocks(e, "system", "frame", "embedding", 21), ["system"]))


@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM frames GROUP BY 1, 2),
  d AS (SELECT f.system, f.frame, f.atom, x - mx AS x, y - my AS y, z - mz AS z FROM frames f JOIN m USING (system, atom)),
  p AS (SELECT a.system, a.atom AS i, b.atom AS j, avg(a.x * b.x + a.y * b.y + a.z * b.z) AS p FROM d a JOIN d b ON a.system = b.system AND a.frame = b.frame AND a.atom <= b.atom GROUP BY 1, 2, 3)
  SELECT p.system, p.i, p.j, round(p.p / sqrt(u.p * v.p), 6) + 0.0 AS c FROM p JOIN p u ON u.system = p.system AND u.i = p.i AND u.j = p.i JOIN p v ON v.system = p.system AND v.i = p.j AND v.j = p.j""")
def dccm_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.cross_correlation(frames(spark, sf_dir), ["system"]))


@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM frames GROUP BY 1, 2),
  d AS (SELECT f.system, f.frame, f.atom, x - mx AS x, y - my AS y, z - mz AS z FROM frames f JOIN m USING (system, atom)),
  p AS (SELECT a.system, a.atom AS i, b.atom AS j, avg(a.x * b.x + a.y * b.y + a.z * b.z) AS p FROM d a JOIN d b ON a.system = b.system AND a.frame = b.frame AND a.atom <= b.atom GROUP BY 1, 2, 3)
  SELECT p.system, p.i, p.j, round(p.p / sqrt(u.p * v.p), 6) + 0.0 AS c FROM p JOIN p u ON u.system = p.system AND u.i = p.i AND u.j = p.i JOIN p v ON v.system = p.system AND v.i = p.j AND v.j = p.j""")
def dccm_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.correlation_blocks(frames(spark, sf_dir), ["system"]))


@_query(f"""WITH {FRAMES_SQL}, r AS (SELECT system, frame % 3 AS replica, atom, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM frames GROUP BY 1, 2, 3)
  SELECT system, atom, round(avg(x), 6) + 0.0 AS x, round(avg(y), 6) + 0.0 AS y, round(avg(z), 6) + 0.0 AS z FROM r GROUP BY 1, 2""")
def mean_of_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.mean_structure(frames(spark, sf_dir).withColumn("replica", F.col("frame") % 3), ["system"], ["replica"]))


@_query(f"""WITH {_PAIRS}, s AS (SELECT system, frame % 3 AS replica, i, j, d FROM pairs)
  SELECT system, i, j, count(*) AS n_total, round(avg(d), 6) AS pooled_mean, round(coalesce(var_samp(d), 0.0), 6) AS pooled_var, round(coalesce(var_samp(d), 0.0) / (avg(d) * avg(d) + 1e-12::DOUBLE), 6) AS norm_var FROM s GROUP BY 1, 2, 3""")
def distogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.distogram(frames(spark, sf_dir).withColumn("replica", F.col("frame") % 3), "system", "replica"))


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The atoms as residues of four chains in turn."""
    place = F.col("atom") - 1
    return frames(spark, sf_dir).withColumn("residue", F.floor(place / 4).cast("int")).withColumn("chain", F.substring(F.lit("ABCD"), place % 4 + 1, F.lit(1)))


@_query(f"""WITH {FRAMES_SQL}, c AS (SELECT system, frame, ((atom - 1) // 4)::INTEGER AS residue, substr('ABCD', (atom - 1) % 4 + 1, 1) AS chain, (atom - 1) % 4 AS place, x, y, z FROM frames)
  SELECT a.system, a.frame, a.residue, a.chain, b.chain AS other, round({_D}, 6) AS d FROM c a JOIN c b ON a.system = b.system AND a.frame = b.frame AND a.residue = b.residue AND b.place = (a.place + 1) % 4""")
def chain_shift_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.offset_pairs(_chains(spark, sf_dir), ["system", "frame", "residue"], "chain", shift_chain(F.col("chain"), 1)))


@_query(f"""WITH {FRAMES_SQL}, c AS (SELECT system, frame, ((atom - 1) // 4)::INTEGER AS residue, substr('ABCD', (atom - 1) % 4 + 1, 1) AS chain, (atom - 1) % 4 AS place, x, y, z FROM frames),
  p AS (SELECT a.system, a.frame, {_D} AS d FROM c a JOIN c b ON a.system = b.system AND a.frame = b.frame AND a.residue = b.residue AND b.place = (a.place + 1) % 4)
  SELECT system, frame, round(avg(d), 6) AS mean, round(stddev_samp(d), 6) AS sd, count(*) AS n FROM p GROUP BY 1, 2""")
def pair_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.summary(dynamics.offset_pairs(_chains(spark, sf_dir), ["system", "frame", "residue"], "chain", shift_chain(F.col("chain"), 1)), ["system", "frame"], "d"))


def _cos(a: str, b: str) -> str:
    dot = " + ".join(f"{a}.{c} * {b}.{c}" for c in "xyz")
    size = lambda v: "sqrt(" + " + ".join(f"{v}.{c} * {v}.{c}" for c in "xyz") + ")"
    return f"greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({dot}) / ({size(a)} * {size(b)})))"


@_query(f"""WITH {FRAMES_SQL} SELECT a.system, a.frame, a.atom, round(degrees(acos(abs({_cos('a', 'b')}))), 5) AS acute, round(degrees(acos({_cos('a', 'b')})), 5) AS angle
  FROM frames a JOIN frames b ON a.system = b.system AND a.frame = b.frame AND b.atom = a.atom + 1""")
def axis_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir)
    b = f.select("system", "frame", (F.col("atom") - 1).alias("atom"), *[F.col(c).alias(f"o{c}") for c in "xyz"])
    j = f.join(b, ["system", "frame", "atom"])
    return rounded(j.select("system", "frame", "atom", acute_angle(["x", "y", "z"], ["ox", "oy", "oz"]).alias("acute"), full_angle(["x", "y", "z"], ["ox", "oy", "oz"]).alias("angle")), 5)


@_query(f"""WITH {FRAMES_SQL}, w AS (SELECT system, frame, atom, {", ".join(f"{c} - lag({c}, 2) OVER o AS b{c}, lead({c}, 2) OVER o - {c} AS a{c}" for c in "xyz")} FROM frames WINDOW o AS (PARTITION BY system, frame ORDER BY atom))
  SELECT system, frame, atom, round(CASE WHEN bx IS NOT NULL AND ax IS NOT NULL THEN 180.0::DOUBLE - degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (bx * ax + by_ * ay + bz * az) / (sqrt(bx * bx + by_ * by_ + bz * bz) * sqrt(ax * ax + ay * ay + az * az)))))) END, 5) AS bend FROM w""".replace("AS by,", "AS by_,"))
def local_bend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dynamics.local_bend(frames(spark, sf_dir), ["system", "frame"]), 5)


def _ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frame_points(spark, sf_dir)


_ENDS = """p AS (SELECT system, frame, {cols} FROM frames GROUP BY 1, 2)"""
_MID = ", ".join(f"max({c}) FILTER (atom = 1) AS f{c}, max({c}) FILTER (atom = 11) AS m{c}, max({c}) FILTER (atom = 21) AS l{c}" for c in "xyz")


@_query(f"""WITH {FRAMES_SQL}, {_ENDS.format(cols=_MID)}, v AS (SELECT system, frame, {", ".join(f"m{c} - f{c} AS a{c}, l{c} - m{c} AS b{c}" for c in "xyz").replace("AS by", "AS b_y")} FROM p)
  SELECT system, frame, round(180.0::DOUBLE - degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, (ax * bx + ay * b_y + az * bz) / (sqrt(ax * ax + ay * ay + az * az) * sqrt(bx * bx + b_y * b_y + bz * bz)))))), 5) AS bend FROM v""")
def global_bend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ordered(spark, sf_dir).select("system", "frame", mid_vector_angle("points").alias("bend")), 5)


def _angle(u: list[str], v: list[str]) -> str:
    dot = lambda a, b: " + ".join(f"({x}) * ({y})" for x, y in zip(a, b, strict=True))
    return f"degrees(acos(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, ({dot(u, v)}) / (sqrt({dot(u, u)}) * sqrt({dot(v, v)}))))))"


_ENDS_OF = ", ".join(f"max({c}) FILTER (atom = 1) AS f{c}, max({c}) FILTER (atom = 21) AS l{c}" for c in "xyz")
_ALONG = "((x - fx) * (lx - fx) + (y - fy) * (ly - fy) + (z - fz) * (lz - fz)) / sqrt((lx - fx) * (lx - fx) + (ly - fy) * (ly - fy) + (lz - fz) * (lz - fz))"


@_query(f"""WITH {FRAMES_SQL}, e AS (SELECT system, frame, {_ENDS_OF} FROM frames GROUP BY 1, 2),
  a AS (SELECT *, {_ALONG} AS along FROM frames JOIN e USING (system, frame)),
  d AS (SELECT *, sqrt(greatest(0.0::DOUBLE, (x - fx) * (x - fx) + (y - fy) * (y - fy) + (z - fz) * (z - fz) - along * along)) AS away FROM a),
  c AS (SELECT *, row_number() OVER (PARTITION BY system, frame ORDER BY away DESC, atom) AS r FROM d)
  SELECT system, frame, round(180.0::DOUBLE - {_angle(["fx - x", "fy - y", "fz - z"], ["lx - x", "ly - y", "lz - z"])}, 5) AS bend FROM c WHERE r = 1""")
def triangle_bend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_ordered(spark, sf_dir).select("system", "frame", triangle_angle("points").alias("bend")), 5)


@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM frames GROUP BY 1, 2), s AS (SELECT system, frame % 3 AS replica, min(frame) AS frame FROM frames GROUP BY 1, 2),
  r AS (SELECT system, replica, sqrt(avg((x - mx) * (x - mx) + (y - my) * (y - my) + (z - mz) * (z - mz))) AS rmsd FROM frames JOIN s USING (system, frame) JOIN m USING (system, atom) GROUP BY 1, 2)
  SELECT system, round(min(rmsd), 6) AS least_rmsd, min(rmsd) < 1e-3 AS matches_initial FROM r GROUP BY 1""")
def ensemble_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("replica", F.col("frame") % 3)
    return rounded(dynamics.starts_at_mean(f, dynamics.mean_structure(f, ["system"], []), ["system"], "replica"))


@_query(f"""WITH {FRAMES_SQL}, e AS (SELECT system, frame, count(*) AS a FROM frames GROUP BY 1, 2), r AS (SELECT system, frame % 3 AS replica, count(*) AS f, min(a) AS lo, max(a) AS hi FROM e GROUP BY 1, 2)
  SELECT system, count(*) AS replicas, min(lo) = max(hi) AS atoms_agree, min(f) = max(f) AS frames_agree FROM r GROUP BY 1""")
def ensemble_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dynamics.ensemble_check(frames(spark, sf_dir).withColumn("replica", F.col("frame") % 3), ["system"], "replica")


@_query(f"""WITH {FRAMES_SQL}, n AS (SELECT system, frame, atom, {", ".join(f"{c} * 20 AS {c}, lead({c} * 20) OVER o AS n{c}" for c in "xyz")} FROM frames WINDOW o AS (PARTITION BY system, frame ORDER BY atom)),
  d AS (SELECT *, sqrt((x - nx) * (x - nx) + (y - ny) * (y - ny) + (z - nz) * (z - nz)) AS d FROM n), k AS (SELECT *, CASE WHEN d > 5 THEN greatest(2, ceil(d / 3.8::DOUBLE))::INTEGER ELSE 1 END AS k FROM d),
  s AS (SELECT *, unnest(range(0, k))::INTEGER AS step FROM k)
  SELECT system, frame, atom, step, {", ".join(f"round(CASE WHEN step = 0 THEN {c} ELSE {c} + (n{c} - {c}) * step / k END, 6) + 0.0 AS {c}" for c in "xyz")} FROM s""")
def guides_interp(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).select("system", "frame", "atom", *[(F.col(c) * 20).alias(c) for c in "xyz"])
    return rounded(build3d.guides(f, ["system", "frame"], "atom"))


@_query(f"""WITH {FRAMES_SQL}, r AS (SELECT system, frame, frame % 3 AS replica, atom, x, y, z FROM frames), a AS (SELECT * FROM r WHERE system = 0), m AS (SELECT atom, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM a GROUP BY 1),
  o AS (SELECT atom, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM r WHERE system = 1 GROUP BY 1)
  SELECT m.atom, round(o.x - m.x, 6) + 0.0 AS dx, round(o.y - m.y, 6) + 0.0 AS dy, round(o.z - m.z, 6) + 0.0 AS dz, round(sqrt((o.x - m.x) * (o.x - m.x) + (o.y - m.y) * (o.y - m.y) + (o.z - m.z) * (o.z - m.z)), 6) AS norm FROM m JOIN o USING (atom)""")
def displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dynamics.mean_structure(frames(spark, sf_dir), ["system"], [])
    return rounded(dynamics.displacement(m.where("system = 0").drop("system"), m.where("system = 1").drop("system"), ["atom"]))


@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) AS mx, avg(y) AS my, avg(z) AS mz FROM frames GROUP BY 1, 2),
  d AS (SELECT f.system, f.frame, f.atom, x - mx AS x, y - my AS y, z - mz AS z FROM frames f JOIN m USING (system, atom)),
  p AS (SELECT a.system, a.atom AS i, b.atom AS j, avg(a.x * b.x + a.y * b.y + a.z * b.z) AS p FROM d a JOIN d b ON a.system = b.system AND a.frame = b.frame AND a.atom <= b.atom GROUP BY 1, 2, 3),
  c AS (SELECT p.system, p.i, p.j, abs(p.p / sqrt(u.p * v.p)) AS w FROM p JOIN p u ON u.system = p.system AND u.i = p.i AND u.j = p.i JOIN p v ON v.system = p.system AND v.i = p.j AND v.j = p.j WHERE p.i < p.j)
  SELECT l.level, system, i AS src, j AS dst, round(w, 6) AS weight FROM c, (VALUES (0.17::DOUBLE), (0.18::DOUBLE), (0.19::DOUBLE)) l(level) WHERE w >= level""")
def threshold_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(studies.correlation_network(frames(spark, sf_dir), "system", [0.17, 0.18, 0.19]))


@_query(f"""WITH {SERIES_SQL}, p AS (SELECT condition, chain, frame % 4 AS replica, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM series GROUP BY 1, 2, 3)
  SELECT condition, chain AS i, chain AS j, round(avg(m), 6) AS mean, round(CASE WHEN count(m) > 1 THEN var_samp(m) END, 6) AS variance, round(CASE WHEN count(m) > 1 THEN stddev_samp(m) / sqrt(count(m)) END, 6) AS se, count(m) AS n FROM p GROUP BY 1, 2""")
def replica_se(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = series_of(spark, sf_dir).groupBy("condition", "chain", (F.col("frame") % 4).alias("replica")).agg(F.avg("value").alias("value"))
    return rounded(matrix.replica_mean(p.select("condition", F.col("chain").alias("i"), F.col("chain").alias("j"), "replica", "value"), ["condition"]))


_LI = "SELECT l_returnflag AS system, l_linenumber % 3 AS replica, l_quantity AS q, l_partkey % 5 AS part FROM lineitem"


@_query(f"""WITH l AS ({_LI}) SELECT system, part, count(*) AS n_total, round(avg(q), 6) AS pooled_mean, round(var_samp(q), 6) AS pooled_var, round(var_samp(q) / (avg(q) * avg(q) + 1e-12::DOUBLE), 6) AS norm_var FROM l GROUP BY 1, 2""")
def pooled_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("system"), (F.col("l_linenumber") % 3).alias("replica"), F.col("l_quantity").alias("q"), (F.col("l_partkey") % 5).alias("part"))
    each = li.groupBy("system", "part", "replica").agg(F.count("*").alias("n"), F.avg("q").alias("mean"), F.var_samp("q").alias("var"))
    return rounded(matrix.pool_replicas(each, ["system", "part"]))


@_query()
def gmm2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.mixtures(series_of(spark, sf_dir), "condition", "value", keep).select("condition", "n", "low", "high", "components", F.element_at("means", 1).alias("mean_1"), F.element_at("sds", 1).alias("sd_1")), 4)


@_query()
def density_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.density_curve(stats.mixtures(series_of(spark, sf_dir), "condition", "value", keep), "condition"), 6)


_Q = "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)"


@_query(f"""WITH {SERIES_SQL}, s AS (SELECT condition, count(*) AS n, min(value) AS lo, max(value) AS hi, coalesce(stddev_samp(value), 0) AS sd, {_Q} AS q FROM series GROUP BY 1),
  h AS (SELECT *, greatest(0.9::DOUBLE * CASE WHEN q > 0 THEN least(sd, q / 1.34::DOUBLE) ELSE sd END * pow(n, -0.2::DOUBLE), 1e-9::DOUBLE) AS h FROM s), g AS (SELECT *, unnest(range(0, 64))::INTEGER AS k FROM h), x AS (SELECT *, lo - 3 * h + k * (hi - lo + 6 * h) / 63 AS x FROM g)
  SELECT condition, k, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * ((x - value) / h) * ((x - value) / h))) / (first(n) * first(h) * sqrt(2 * pi())), 6) AS density FROM series JOIN x USING (condition) GROUP BY condition, k, x""")
def violin_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(stats.kernel_density(series_of(spark, sf_dir), "condition", "value"), 6)


def _axes_sql(source: str, keys: str) -> str:
    """The first axis of the points of each key: the largest root of the covariance's polynomial, refined by Newton's steps, and the longest product of two rows less it."""
    less = "(a - t)*((d - t)*(f - t) - e*e) - b*(b*(f - t) - c*e) + c*(b*e - c*(d - t))"
    slope = "-((d - t)*(f - t) - e*e) - ((a - t)*(f - t) - c*c) - ((a - t)*(d - t) - b*b)"
    cross = lambda u, v: f"[{u}[2]*{v}[3] - {u}[3]*{v}[2], {u}[3]*{v}[1] - {u}[1]*{v}[3], {u}[1]*{v}[2] - {u}[2]*{v}[1]]"
    return f"""cov AS (SELECT {keys}, covar_pop(x, x) AS a, covar_pop(x, y) AS b, covar_pop(x, z) AS c, covar_pop(y, y) AS d, covar_pop(y, z) AS e, covar_pop(z, z) AS f FROM {source} GROUP BY ALL),
  shifted AS (SELECT *, (a + d + f) / 3 AS q, sqrt(((a - (a + d + f) / 3)**2 + (d - (a + d + f) / 3)**2 + (f - (a + d + f) / 3)**2 + 2 * (b*b + c*c + e*e)) / 6) AS p FROM cov),
  turned AS (SELECT *, least(1.0::DOUBLE, greatest(-1.0::DOUBLE, ((a - q)*((d - q)*(f - q) - e*e) - b*(b*(f - q) - c*e) + c*(b*e - c*(d - q))) / (2 * p*p*p))) AS r FROM shifted),
  roots AS (SELECT *, list_reduce(list_prepend(q + 2 * p * cos(acos(r) / 3), [0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE]), lambda t, k: t - ({less}) / ({slope})) AS l FROM turned),
  rows3 AS (SELECT *, [a - l, b, c] AS r1, [b, d - l, e] AS r2, [c, e, f - l] AS r3 FROM roots),
  products AS (SELECT *, list_reverse_sort(list_transform([{cross('r1', 'r2')}, {cross('r1', 'r3')}, {cross('r2', 'r3')}], lambda v: {{'n': sqrt(v[1]*v[1] + v[2]*v[2] + v[3]*v[3]), 'v': v}}))[1] AS best FROM rows3),
  axes AS (SELECT {keys}, best.v[1] / best.n AS ax, best.v[2] / best.n AS ay, best.v[3] / best.n AS az, l AS spread FROM products)"""


@_query(f"WITH {FRAMES_SQL}, {_axes_sql('frames', 'system, frame')} SELECT system, frame, round(abs(ax), 5) AS ax, round(abs(ay), 5) AS ay, round(abs(az), 5) AS az, round(spread, 5) AS spread, round(ax*ax + ay*ay + az*az, 5) AS length FROM axes")
def helix_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size of each axis' components, as its sign is arbitrary, and that it is a unit vector."""
    a = dynamics.principal_axis(frames(spark, sf_dir), ["system", "frame"])
    return rounded(a.select("system", "frame", *[F.abs(c).alias(c) for c in ("ax", "ay", "az")], "spread", (F.col("ax") ** 2 + F.col("ay") ** 2 + F.col("az") ** 2).alias("length")), 5)


@_query(f"""WITH {FRAMES_SQL}, named AS (SELECT *, CASE WHEN atom <= 10 THEN 'first' ELSE 'second' END AS axis FROM frames), {_axes_sql('named', 'system, frame, axis')},
  t AS (SELECT u.system, u.frame, degrees(acos(least(1.0::DOUBLE, abs(u.ax*v.ax + u.ay*v.ay + u.az*v.az)))) AS angle FROM axes u JOIN axes v ON u.system = v.system AND u.frame = v.frame AND u.axis = 'first' AND v.axis = 'second')
  SELECT system, frame, round(angle, 4) AS angle, round(CASE WHEN count(*) OVER w = 5 THEN avg(angle) OVER w END, 4) AS smooth FROM t WINDOW w AS (PARTITION BY system ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def interhelix_angle(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames(spark, sf_dir).withColumn("axis", F.when(F.col("atom") <= 10, "first").otherwise("second"))
    axes = dynamics.principal_axis(f, ["system", "frame", "axis"])
    return rounded(studies.angle_series(axes, ["system"], "first", "second", "frame"), 4)


#: The least distance over all turns by the largest root of a quartic in the products' invariants, which needs no turn.
_FIT = """m AS (SELECT atom, avg(x) AS x, avg(y) AS y, avg(z) AS z FROM frames WHERE system = 0 GROUP BY 1),
  s AS (SELECT a.system, a.frame, avg((a.x - m.x)**2 + (a.y - m.y)**2 + (a.z - m.z)**2) AS before, var_pop(a.x) + var_pop(a.y) + var_pop(a.z) + var_pop(m.x) + var_pop(m.y) + var_pop(m.z) AS g,
    [covar_pop(a.x, m.x), covar_pop(a.x, m.y), covar_pop(a.x, m.z), covar_pop(a.y, m.x), covar_pop(a.y, m.y), covar_pop(a.y, m.z), covar_pop(a.z, m.x), covar_pop(a.z, m.y), covar_pop(a.z, m.z)] AS h FROM frames a JOIN m USING (atom) GROUP BY 1, 2),
  i AS (SELECT *, list_sum(list_transform(h, lambda v: v*v)) AS two, h[1]*(h[5]*h[9] - h[6]*h[8]) - h[2]*(h[4]*h[9] - h[6]*h[7]) + h[3]*(h[4]*h[8] - h[5]*h[7]) AS det,
    list_sum(list_transform([h[1]*h[1] + h[4]*h[4] + h[7]*h[7], h[2]*h[2] + h[5]*h[5] + h[8]*h[8], h[3]*h[3] + h[6]*h[6] + h[9]*h[9]], lambda v: v*v)) + 2 * ((h[1]*h[2] + h[4]*h[5] + h[7]*h[8])**2 + (h[1]*h[3] + h[4]*h[6] + h[7]*h[9])**2 + (h[2]*h[3] + h[5]*h[6] + h[8]*h[9])**2) AS four FROM s),
  l AS (SELECT *, list_reduce(list_prepend(g / 2, list_transform(range(60), lambda k: 0.0::DOUBLE)), lambda t, k: t - (t**4 - 2*two*t*t - 8*det*t + 2*four - two*two) / (4*t**3 - 4*two*t - 8*det)) AS top FROM i)"""


@_query(f"WITH {FRAMES_SQL}, {_FIT} SELECT system, frame, round(sqrt(before), 5) AS before, round(sqrt(greatest(0.0::DOUBLE, g - 2*top)), 5) AS after FROM l")
def superpose_rmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Root mean square distance to the mean of system 0 before and after superposition; after is never more."""
    f = frames(spark, sf_dir)
    fixed = dynamics.mean_structure(f.where("system = 0"), [], ["frame"])
    moved = dynamics.superpose(f, fixed, ["system", "frame"])
    after = dynamics.rmsd(moved, fixed, ["system", "frame"]).withColumnRenamed("rmsd", "after")
    return rounded(dynamics.rmsd(f, fixed, ["system", "frame"]).withColumnRenamed("rmsd", "before").join(after, ["system", "frame"]), 5)



@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) * 20 AS x, avg(y) * 20 AS y, avg(z) * 20 AS z FROM frames GROUP BY 1, 2)
  SELECT a.system, a.atom AS i, b.atom AS j, round(exp(-{_D} / 8.0::DOUBLE), 6) AS similarity FROM m a JOIN m b ON a.system = b.system AND a.atom <> b.atom""")
def pair_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = dynamics.mean_structure(frames(spark, sf_dir), ["system"], []).select("system", "atom", *[(F.col(c) * 20).alias(c) for c in "xyz"])
    return rounded(dynamics.pair_similarity(m, ["system"]))


@_query(f"""WITH {_PAIRS}, n AS (SELECT system, count(DISTINCT frame) AS n FROM frames GROUP BY 1)
  SELECT system, i, j, count(*) AS n_frames, round(count(*) / any_value(n.n), 6) AS share, round(min(d), 6) AS least FROM pairs JOIN n USING (system) WHERE d <= 0.1 GROUP BY 1, 2, 3""")
def near_contacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of atoms in contact by a cutoff, over all frames, by cubes of the cutoff's width."""
    return rounded(dynamics.contact_shares(frames(spark, sf_dir), ["system"], "frame", 0.1))


@_query(f"""WITH {FRAMES_SQL} SELECT a.system, a.frame, a.atom FROM frames a WHERE EXISTS (SELECT 1 FROM frames b WHERE b.system = a.system AND b.frame = a.frame AND b.atom IN (1, 8, 15) AND {_D} <= 0.15)""")
def reach_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atoms within reach of any of some atoms of their frame."""
    f = frames(spark, sf_dir)
    return dynamics.in_reach(f, f.where(F.col("atom").isin(1, 8, 15)), ["system", "frame"], 0.15).select("system", "frame", "atom")


@_query(f"""WITH {FRAMES_SQL}, m AS (SELECT system, atom, avg(x) * 20 AS x, avg(y) * 20 AS y, avg(z) * 20 AS z FROM frames GROUP BY 1, 2)
  SELECT a.system, a.atom AS i, b.atom AS j, round(exp(-{_D} / 8.0::DOUBLE), 6) AS similarity FROM m a JOIN m b ON a.system = b.system AND a.atom <> b.atom AND {_D} <= -8.0::DOUBLE * ln(0.9::DOUBLE)""")
def near_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Similarities from 0.9 on, of pairs within the distance that this is."""
    m = dynamics.mean_structure(frames(spark, sf_dir), ["system"], []).select("system", "atom", *[(F.col(c) * 20).alias(c) for c in "xyz"])
    return rounded(dynamics.pair_similarity(m, ["system"], least=0.9))
