"""Queries over labelled matrices and their changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.labels import scale_symmetric, scale_to_cap
from ..operators import matrix, select
from ..proxies import MATRICES_SQL, NETWORK_SQL, condition_matrices, network, table
from .common import registry, rounded

QUERIES, ORACLES, _query = registry()


@_query(f"WITH {MATRICES_SQL} SELECT condition, i, j, round(sum(value), 2) AS value FROM matrices GROUP BY 1, 2, 3")
def matrix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.add(condition_matrices(spark, sf_dir), ["condition"]), 2)


@_query(f"WITH {MATRICES_SQL}, u AS (SELECT i, j, value FROM matrices UNION ALL SELECT j, i, value FROM matrices WHERE i <> j) SELECT i, j, round(sum(value), 2) AS value FROM u GROUP BY 1, 2")
def edge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.to_full(condition_matrices(spark, sf_dir).select("i", "j", "value"))
    return rounded(matrix.add(m, []), 2)


@_query(f"WITH {NETWORK_SQL}, u AS (SELECT src AS i, dst AS j, weight FROM network UNION ALL SELECT dst, src, weight FROM network) SELECT i, j, round(sum(weight), 6) AS value FROM u GROUP BY 1, 2")
def network_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(matrix.from_edges(network(spark, sf_dir), [], "src", "dst", "weight"))


@_query(f"""WITH {MATRICES_SQL} SELECT condition, i, j, round(avg(value), 4) AS mean, round(CASE WHEN count(*) > 1 THEN var_samp(value) END / 1000000, 4) AS variance, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END, 4) AS se, count(*) AS n FROM matrices GROUP BY 1, 2, 3""")
def matrix_replicas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.replica_mean(condition_matrices(spark, sf_dir), ["condition"])
    return rounded(m.withColumn("variance", F.col("variance") / 1000000), 4)


def _sparse(sql_cut: int) -> str:
    return f"{MATRICES_SQL}, s AS (SELECT * FROM matrices WHERE value > {sql_cut})"


def _delta_sql(a: str, b: str) -> str:
    return f"""SELECT coalesce(a.variant, b.variant) AS variant, coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, a.value AS va, b.value AS vb,
      0.0005::DOUBLE * max(greatest(coalesce(a.value, 0), coalesce(b.value, 0))) OVER (PARTITION BY coalesce(a.variant, b.variant)) AS t
      FROM (SELECT * FROM s WHERE condition = '{a}') a FULL JOIN (SELECT * FROM s WHERE condition = '{b}') b ON a.variant = b.variant AND a.i = b.i AND a.j = b.j"""


_STATUS = """CASE WHEN va >= t AND vb >= t THEN 'keep' WHEN vb >= t THEN 'appear' WHEN va >= t THEN 'vanish' END"""
CUT = 150000


def _delta(spark: SparkSession, sf_dir: str, a: str, b: str) -> DataFrame:
    m = condition_matrices(spark, sf_dir).where(F.col("value") > CUT)
    pick = lambda c: m.where(F.col("condition") == c).drop("condition")
    return matrix.sentinel_delta(pick(a), pick(b), ["variant"])


@_query(f"""WITH {_sparse(CUT)}, d AS ({_delta_sql('A', 'N')}), e AS (SELECT *, {_STATUS} AS status FROM d)
  SELECT variant, i, j, status, round(CASE status WHEN 'keep' THEN vb - va WHEN 'appear' THEN 999.0::DOUBLE WHEN 'vanish' THEN -999.0::DOUBLE END, 4) + 0.0 AS delta FROM e""")
def delta_sentinel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_delta(spark, sf_dir, "A", "N"), 4)


@_query(f"""WITH {_sparse(CUT)}, d AS ({_delta_sql('A', 'N')}), e AS (SELECT *, {_STATUS} AS status FROM d),
  c(v, w, category) AS (VALUES ('appear', 'appear', 0.0), ('appear', 'keep', 2.0), ('appear', 'vanish', 999.0), ('keep', 'appear', -2.0), ('keep', 'keep', 0.0), ('keep', 'vanish', 1.0), ('vanish', 'appear', -999.0), ('vanish', 'keep', -1.0), ('vanish', 'vanish', 0.0))
  SELECT m.variant, m.i, m.j, category::DOUBLE AS category FROM e m JOIN e w ON w.variant = 'BUILDING' AND m.variant <> 'BUILDING' AND m.i = w.i AND m.j = w.j LEFT JOIN c ON c.v = m.status AND c.w = w.status""")
def dd_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _delta(spark, sf_dir, "A", "N")
    wild = d.where("variant = 'BUILDING'").select("i", "j", "status")
    mutant = d.where("variant <> 'BUILDING'")
    names = mutant.select("variant").distinct()
    return matrix.category_delta(mutant, wild.crossJoin(F.broadcast(names)), ["variant"])


@_query(f"""WITH {MATRICES_SQL}, d AS (SELECT b.variant, b.i, b.j, b.value - a.value AS delta FROM matrices a JOIN matrices b ON a.condition = 'A' AND b.condition = 'N' AND a.variant = b.variant AND a.i = b.i AND a.j = b.j)
  SELECT m.variant, m.i, m.j, round(m.delta - w.delta, 2) + 0.0 AS delta FROM d m JOIN d w ON w.variant = 'BUILDING' AND m.variant <> 'BUILDING' AND m.i = w.i AND m.j = w.j""")
def delta_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = condition_matrices(spark, sf_dir)
    pick = lambda c: m.where(F.col("condition") == c).drop("condition")
    d = matrix.numeric_delta(pick("A"), pick("N"), ["variant"]).withColumnRenamed("delta", "value")
    mutant = d.where("variant <> 'BUILDING'")
    wild = d.where("variant = 'BUILDING'").drop("variant").crossJoin(F.broadcast(mutant.select("variant").distinct()))
    return rounded(matrix.numeric_delta(wild, mutant, ["variant"]), 2)


@_query(f"""WITH {MATRICES_SQL}, v AS (SELECT i, j, max(value) FILTER (condition = 'A') AS a, max(value) FILTER (condition = 'N') AS n, max(value) FILTER (condition = 'R') AS r FROM matrices WHERE variant = 'BUILDING' GROUP BY 1, 2)
  SELECT i, j, round(n - r, 2) + 0.0 AS direct, round((n - a) - (r - a), 2) + 0.0 AS through FROM v WHERE a IS NOT NULL AND n IS NOT NULL AND r IS NOT NULL""")
def cap_heat(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = condition_matrices(spark, sf_dir).where("variant = 'BUILDING'").drop("variant")
    pick = lambda c: m.where(F.col("condition") == c).drop("condition")
    direct = matrix.numeric_delta(pick("R"), pick("N"), []).withColumnRenamed("delta", "direct")
    to = lambda c: matrix.numeric_delta(pick("A"), pick(c), []).withColumnRenamed("delta", "value")
    through = matrix.numeric_delta(to("R"), to("N"), []).withColumnRenamed("delta", "through")
    return rounded(direct.join(through, ["i", "j"]), 2)


@_query(f"""WITH {MATRICES_SQL}, f AS (SELECT variant, i, j, value FROM matrices WHERE condition = 'A' UNION ALL SELECT variant, j, i, value FROM matrices WHERE condition = 'A')
  SELECT i, j, round(value, 2) AS value FROM f WHERE (variant = 'BUILDING' AND i < j) OR (variant = 'MACHINERY' AND i > j)""")
def hybrid_triangle(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix.to_full(condition_matrices(spark, sf_dir).where("condition = 'A'").select("variant", "i", "j", "value"))
    pick = lambda v: m.where(F.col("variant") == v).drop("variant")
    return rounded(matrix.hybrid(pick("BUILDING"), pick("MACHINERY"), F.col("i"), F.col("j")), 2)


_AXIS = "axis AS (SELECT n_nationkey AS pos, substr('ABCD', n_regionkey % 4 + 1, 1) AS chain, (n_nationkey * 3 + 100)::INTEGER AS number FROM nation)"


def _axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("pos"), F.substring(F.lit("ABCD"), F.col("n_regionkey") % 4 + 1, F.lit(1)).alias("chain"), (F.col("n_nationkey") * 3 + 100).alias("number"))


@_query(f"WITH {_AXIS}, e AS (SELECT min(pos) AS a, max(pos) AS b FROM axis WHERE number IN (112, 151)) SELECT pos, chain, number FROM axis, e WHERE pos BETWEEN a AND b")
def zoom_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.slice_between(_axis(spark, sf_dir), "number", "pos", 112, 151)


@_query(f"WITH {_AXIS}, e AS (SELECT min(pos) FILTER (chain = 'A' AND number >= 101) AS a, max(pos) FILTER (chain = 'B' AND number <= 160) AS b FROM axis) SELECT pos, chain, number FROM axis, e WHERE pos BETWEEN least(a, b) AND greatest(a, b)")
def zoom_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.slice_nearest(_axis(spark, sf_dir), "pos", ("A", 101), ("B", 160))


@_query(f"""WITH {MATRICES_SQL}, m AS (SELECT i, j, value FROM matrices WHERE condition = 'A' AND variant = 'BUILDING' AND value > {CUT})
  SELECT a.n_nationkey AS i, b.n_nationkey AS j, round(m.value, 2) AS value FROM nation a CROSS JOIN nation b LEFT JOIN m ON m.i = a.n_nationkey AND m.j = b.n_nationkey""")
def canvas(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = condition_matrices(spark, sf_dir).where(f"condition = 'A' and variant = 'BUILDING' and value > {CUT}").select("i", "j", "value")
    return rounded(matrix.canvas(m, table(spark, sf_dir, "nation"), "n_nationkey"), 2)


@_query(f"""WITH {MATRICES_SQL}, d AS (SELECT i, j FROM matrices WHERE condition = 'R' AND variant = 'BUILDING'), f AS (SELECT i, j, value FROM matrices WHERE condition = 'A' AND variant = 'BUILDING' AND value > {CUT}),
  x AS (SELECT d.i, d.j, coalesce(f.value, 0.0::DOUBLE) AS value, f.value > 0 AS mark, max(f.value) OVER () AS top FROM d LEFT JOIN f USING (i, j))
  SELECT i, j, round(value, 2) AS value, coalesce(mark, false) AS mark, least(100, greatest(1, floor(value / top * 99 + 0.5) + 1))::INTEGER AS colour FROM x""")
def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = condition_matrices(spark, sf_dir).where("variant = 'BUILDING'")
    ground = m.where("condition = 'R'").select("i", "j")
    flow = m.where(f"condition = 'A' and value > {CUT}").select("i", "j", "value")
    x = matrix.over_largest(matrix.align(flow, ground, [], fill=0.0), F.col("value"), "top")
    share = F.col("value") / F.col("top")
    return x.select("i", "j", F.round("value", 2).alias("value"), (F.col("value") > 0).alias("mark"), F.least(F.lit(100), F.greatest(F.lit(1), F.floor(share * 99 + 0.5) + 1)).cast("int").alias("colour"))


_FIELD = "fields AS (SELECT l_returnflag AS system, l_suppkey % 50 AS resno, sum(l_quantity::DECIMAL(18,2))::DOUBLE AS value FROM lineitem GROUP BY 1, 2)"


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("system"), (F.col("l_suppkey") % 50).alias("resno")).agg(F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("value"))


@_query(f"WITH {_FIELD} SELECT system, resno, round(value / max(value) OVER (PARTITION BY system) * 99.99::DOUBLE, 4) AS b FROM fields")
def scale_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    return rounded(_fields(spark, sf_dir).select("system", "resno", scale_to_cap(F.col("value"), F.max("value").over(Window.partitionBy("system"))).alias("b")), 4)


@_query(f"""WITH {_FIELD}, d AS (SELECT coalesce(a.resno, b.resno) AS resno, coalesce(b.value, 0) - coalesce(a.value, 0) AS delta FROM (SELECT * FROM fields WHERE system = 'A') a FULL JOIN (SELECT * FROM fields WHERE system = 'N' AND resno > 4) b USING (resno))
  SELECT resno, round(greatest(-99.99::DOUBLE, least(99.99::DOUBLE, delta / max(abs(delta)) OVER () * 99.99::DOUBLE)), 4) + 0.0 AS b FROM d""")
def delta_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _fields(spark, sf_dir)
    d = matrix.field_delta(f.where("system = 'A'").drop("system"), f.where("system = 'N' and resno > 4").drop("system"), ["resno"])
    d = matrix.over_largest(d, F.abs("delta"), "top")
    return rounded(d.select("resno", scale_symmetric(F.col("delta"), F.col("top")).alias("b")), 4)


@_query(f"""WITH {_sparse(CUT)}, d AS ({_delta_sql('A', 'N')}), e AS (SELECT variant, i, j, CASE {_STATUS} WHEN 'keep' THEN vb - va WHEN 'appear' THEN 999.0::DOUBLE WHEN 'vanish' THEN -999.0::DOUBLE END AS v FROM d),
  f AS (SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.v, 0) AS va, coalesce(b.v, 0) AS vb, 0.0005::DOUBLE * max(greatest(a.v, b.v)) OVER () AS t FROM (SELECT * FROM e WHERE variant = 'BUILDING') a FULL JOIN (SELECT * FROM e WHERE variant = 'MACHINERY') b ON a.i = b.i AND a.j = b.j)
  SELECT i, j, CASE WHEN va >= t AND va > 0 AND vb >= t AND vb > 0 THEN 'keep' WHEN vb >= t AND vb > 0 THEN 'appear' WHEN va >= t AND va > 0 THEN 'vanish' END AS status FROM f""")
def delta_of_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentinel delta of two sentinel deltas, as a compatible form: marks count as values and what fell as absent."""
    d = _delta(spark, sf_dir, "A", "N").select("variant", "i", "j", F.col("delta").alias("value"))
    pick = lambda v: d.where(F.col("variant") == v).drop("variant")
    return matrix.sentinel_delta(pick("BUILDING"), pick("MACHINERY"), []).select("i", "j", "status")
