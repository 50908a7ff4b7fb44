"""Queries over the flow network: sums, exports, seeds, Markov chains, maximum flow, paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import markov, network, paths, select
from ..plans import studies
from ..proxies import MILLION, NETWORK_SQL, TRADES_SQL, table, trades
from ..proxies import network as network_of
from ..session import cut as keep
from .common import registry, rounded

QUERIES, ORACLES, _query = registry()
ABSORBING = 24


@_query(f"WITH {NETWORK_SQL}, e AS (SELECT src AS node, weight FROM network UNION ALL SELECT dst, weight FROM network) SELECT node, round(sum(weight), 6) AS flow FROM e GROUP BY 1")
def node_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.incident_sum(network_of(spark, sf_dir), []))


@_query(f"WITH {NETWORK_SQL} SELECT src AS \"Source\", dst AS \"Target\", 'undirected' AS type, round(weight / max(weight) OVER (), 6) AS weight, round(weight, 6) AS weight_abs FROM network WHERE weight > 0.5")
def gephi_undirected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.export_undirected(network_of(spark, sf_dir), least=0.5))


_FLOWS = f"""{TRADES_SQL}, flows AS (SELECT flag AS target, segment AS family, status AS system, least(src, dst) AS src, greatest(src, dst) AS dst,
  coalesce(sum(price) FILTER (trades.src < trades.dst), 0)::DOUBLE / 1000003.0::DOUBLE AS fwd, coalesce(sum(price) FILTER (trades.src > trades.dst), 0)::DOUBLE / 1000003.0::DOUBLE AS rev FROM trades GROUP BY 1, 2, 3, 4, 5)"""


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    part = lambda ok: (F.sum(F.when(ok, F.col("price")).otherwise(F.lit(0).cast("decimal(18,2)"))).cast("double") / MILLION)
    return t.groupBy(F.col("flag").alias("target"), F.col("segment").alias("family"), F.col("status").alias("system"), F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("dst_")).agg(part(F.col("src") < F.col("dst")).alias("fwd"), part(F.col("src") > F.col("dst")).alias("rev")).withColumnsRenamed({"a": "src", "dst_": "dst"})


@_query(f"""WITH {_FLOWS}, t AS (SELECT target, src, dst, sum(fwd) AS fwd, sum(rev) AS rev FROM flows GROUP BY 1, 2, 3),
  r AS (SELECT target AS goal, src AS s, dst AS t, fwd AS w FROM t UNION ALL SELECT target, dst, src, rev FROM t)
  SELECT goal, s AS "Source", t AS "Target", 'directed' AS type, round(w / max(w) OVER (PARTITION BY goal), 6) AS weight, round(w, 6) AS weight_abs FROM r WHERE w > 0.000001""")
def gephi_directed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _flows(spark, sf_dir).groupBy(F.col("target").alias("goal"), "src", "dst").agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"))
    return rounded(network.export_directed(t, ["goal"]))


_SEEDS = f"""{_FLOWS}, e AS (SELECT system, target, src, dst, sum(fwd) AS fwd FROM flows GROUP BY 1, 2, 3, 4),
  seeds AS (SELECT system, target, src AS node, sum(fwd) AS seed_score, CASE WHEN sum(fwd) > 0 THEN max(fwd) / sum(fwd) ELSE 0.0::DOUBLE END AS max_t FROM e GROUP BY 1, 2, 3)"""


def _seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _flows(spark, sf_dir).groupBy("system", "target", "src", "dst").agg(F.sum("fwd").alias("fwd"))
    return network.seed_scores(e, ["system"], "target")


@_query(f"WITH {_SEEDS} SELECT system, target, node, round(seed_score, 6) AS seed_score, round(max_t, 6) AS max_t FROM seeds")
def seed_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_seeds(spark, sf_dir))


@_query(f"WITH {_SEEDS} SELECT system, target, node, round(seed_score, 6) AS seed_score, round(max_t, 6) AS max_t, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY system, target ORDER BY round(seed_score, 6) DESC, node) AS rank FROM seeds WHERE node < 3 OR node > 5) WHERE rank <= CASE system WHEN 'F' THEN 10 ELSE 4 END")
def seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = rounded(_seeds(spark, sf_dir)).where(select.outside(F.col("node"), 3, 5))
    return select.top_rows(kept, ["system", "target"], [F.desc("seed_score"), F.col("node")], F.when(F.col("system") == "F", 10).otherwise(4))


@_query(f"""WITH {_SEEDS} SELECT system, target, node, round(seed_score, 6) AS seed_score, round(max_t, 6) AS max_t FROM seeds
  UNION ALL SELECT a.system, 'both', a.node, round((a.seed_score + b.seed_score) / 2, 6), round(a.max_t, 6) FROM seeds a JOIN seeds b ON a.system = b.system AND a.node = b.node AND a.target = 'A' AND b.target = 'N' WHERE a.seed_score > 0 AND b.seed_score > 0""")
def seed_both(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.both_targets(_seeds(spark, sf_dir), ["system"], "A", "N"))


@_query(f"""WITH {_SEEDS} SELECT a.system, a.target, a.node, round(max(a.seed_score), 6) AS seed_score, count(b.node) AS n_equivalent FROM seeds a LEFT JOIN seeds b ON a.node = b.node AND a.target = b.target AND a.system <> b.system AND b.seed_score >= 0.10 * a.seed_score GROUP BY 1, 2, 3""")
def seed_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.equivalents(_seeds(spark, sf_dir), "system"))


@_query(f"WITH {_FLOWS} SELECT src, dst, family, target, round(sum(fwd), 6) AS fwd, round(sum(rev), 6) AS rev FROM flows GROUP BY GROUPING SETS ((src, dst, family, target), (src, dst, family), (src, dst))")
def family_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.with_totals(_flows(spark, sf_dir), "family", "target"))


@_query(f"""WITH {_SEEDS}, b AS (SELECT system, target, node, seed_score FROM seeds UNION ALL
    SELECT x.system, 'both', x.node, (x.seed_score + y.seed_score) / 2 FROM seeds x JOIN seeds y USING (system, node) WHERE x.target = 'A' AND y.target = 'N' AND x.seed_score > 0 AND y.seed_score > 0),
  l AS (SELECT * FROM b UNION ALL SELECT system, 'A', node, seed_score FROM b WHERE target = 'both' UNION ALL SELECT system, 'N', node, seed_score FROM b WHERE target = 'both')
  SELECT b.system, b.target, b.node, (b.node // 4)::INTEGER AS number, round(max(b.seed_score), 6) AS seed_score, {", ".join(f"count(*) FILTER (l.system = '{x}' AND l.seed_score >= 0.10 * b.seed_score) AS equiv_{x}" for x in "FOP")}
  FROM b JOIN l ON l.target = b.target AND l.node // 4 = b.node // 4 GROUP BY 1, 2, 3""")
def seed_equiv_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each system the nodes of the same number and target: a node stands for chain ``node % 4`` and number ``node / 4``."""
    both = network.both_targets(_seeds(spark, sf_dir), ["system"], "A", "N").withColumn("number", F.floor(F.col("node") / 4).cast("int"))
    return rounded(network.equivalent_counts(both, ["system", "target", "node"], ["F", "O", "P"], "number", both=("A", "N")))


@_query(f"""WITH {_FLOWS} SELECT src, dst, family, target, CASE grouping(family) * 2 + grouping(target) WHEN 0 THEN 'family_target' WHEN 1 THEN 'family' WHEN 2 THEN 'target' ELSE 'total' END AS level,
  round(sum(fwd), 6) AS fwd, round(sum(rev), 6) AS rev FROM flows GROUP BY GROUPING SETS ((src, dst, family, target), (src, dst, family), (src, dst, target), (src, dst))""")
def family_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(network.by_level(_flows(spark, sf_dir), "family", "target"))


_T = f"{NETWORK_SQL}, t AS (SELECT src AS i, dst AS j, weight / sum(weight) OVER (PARTITION BY src) AS t FROM network WHERE weight > 0)"
_N = f"""{_T}, q AS (SELECT * FROM t WHERE i <> {ABSORBING} AND j <> {ABSORBING}), nodes AS (SELECT i AS node FROM t UNION SELECT j FROM t),
  r(k, i, j, v) AS (SELECT 0, node, node, 1.0::DOUBLE FROM nodes WHERE node <> {ABSORBING} UNION ALL SELECT k + 1, r.i, q.j, sum(r.v * q.t) FROM r JOIN q ON r.j = q.i WHERE k < 30 GROUP BY k + 1, r.i, q.j),
  n AS (SELECT i, j, sum(v) AS n FROM r GROUP BY 1, 2)"""


def _transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markov.transition(network_of(spark, sf_dir), [])


def _absorbing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(ABSORBING,)], "node int")


def _visits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The chain and its expected visits."""
    t = keep(_transition(spark, sf_dir))
    nodes = t.select(F.col("i").alias("node")).union(t.select("j")).distinct()
    return t, keep(markov.fundamental_blocks(t, [], _absorbing(spark), keep, nodes))


@_query(f"WITH {_T} SELECT i, j, round(t, 6) AS t FROM t")
def transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_transition(spark, sf_dir))


@_query(f"WITH RECURSIVE {_N} SELECT i, j, round(n, 6) AS n FROM n")
def fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_visits(spark, sf_dir)[1])


_FLAGS_SQL = f"{TRADES_SQL}, flags AS (SELECT flag AS system, least(src, dst) AS src, greatest(src, dst) AS dst, sum(price)::DOUBLE / 1000003.0::DOUBLE AS weight FROM trades GROUP BY 1, 2, 3)"


@_query(f"""WITH RECURSIVE {_FLAGS_SQL}, t AS (SELECT system, src AS i, dst AS j, weight / sum(weight) OVER (PARTITION BY system, src) AS t FROM flags), q AS (SELECT * FROM t WHERE i <> {ABSORBING} AND j <> {ABSORBING}),
  nodes AS (SELECT system, i AS node FROM t UNION SELECT system, j FROM t),
  r(k, system, i, j, v) AS (SELECT 0, system, node, node, 1.0::DOUBLE FROM nodes WHERE node <> {ABSORBING} UNION ALL SELECT k + 1, r.system, r.i, q.j, sum(r.v * q.t) FROM r JOIN q ON r.system = q.system AND r.j = q.i WHERE k < 30 GROUP BY k + 1, r.system, r.i, q.j)
  SELECT system, i, j, round(sum(v), 6) AS n FROM r GROUP BY 1, 2, 3""")
def fundamental_solve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for the chain of each system by a linear system each, as for graphs that a task can hold."""
    return rounded(markov.fundamental_solve(markov.transition(_flags(spark, sf_dir), ["system"]), "system", _absorbing(spark)))


@_query(f"""WITH RECURSIVE {_N}, m AS (SELECT j AS node, sum(n) AS w FROM n GROUP BY 1), e AS (SELECT i, j, t * w AS e FROM t JOIN m ON node = i), u AS (SELECT i, j, e FROM e UNION ALL SELECT j, i, e FROM e)
  SELECT i, j, round(sum(e) / 2, 6) AS e FROM u GROUP BY 1, 2""")
def edge_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, n = _visits(spark, sf_dir)
    return rounded(markov.edge_importance(t, markov.node_importance(n, []), []))


@_query(f"""WITH RECURSIVE {_N}, s(node, w) AS (VALUES (1, 1.0::DOUBLE), (2, 2.0::DOUBLE), (3, 1.0::DOUBLE), (99, 5.0::DOUBLE)), p AS (SELECT * FROM s WHERE node IN (SELECT i FROM n))
  SELECT j AS node, round(sum(w * n) / (SELECT sum(w) FROM p), 6) AS field FROM n JOIN p ON n.i = p.node GROUP BY 1""")
def visitation_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    seeds = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 1.0), (99, 5.0)], "node int, weight double")
    return rounded(markov.visitation_field(_visits(spark, sf_dir)[1], seeds, []))


def _nodes(e: DataFrame) -> DataFrame:
    return e.select(F.col("src").alias("node")).union(e.select("dst")).distinct()


def _pairs(nodes: DataFrame) -> DataFrame:
    """Every source with every other node as target."""
    return nodes.select(F.col("node").alias("source")).crossJoin(nodes.select(F.col("node").alias("target"))).where("source <> target")


#: The lesser of the two cuts that part one node from all others; in graphs as dense as this one no cut is less.
_VALUES = f"""{NETWORK_SQL}, s AS (SELECT node, sum(weight) AS strength FROM (SELECT src AS node, weight FROM network UNION ALL SELECT dst, weight FROM network) GROUP BY 1),
  flow AS (SELECT a.node AS source, b.node AS target, least(a.strength, b.strength) AS value FROM s a, s b WHERE a.node <> b.node)"""


@_query(f"WITH {_VALUES} SELECT source, target, round(value, 6) AS value FROM flow")
def maxflow_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The maximum flow between all pairs by the equivalent-flow tree."""
    e = keep(network_of(spark, sf_dir))
    return rounded(network.tree_values(network.flow_tree(e, [], keep), []))


@_query(f"WITH {NETWORK_SQL}, n AS (SELECT src AS node FROM network UNION SELECT dst FROM network) SELECT a.node AS source, b.node AS target, TRUE AS is_cut, TRUE AS within, TRUE AS conserved FROM n a, n b WHERE a.node <> b.node")
def flow_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """That each value of the tree is a maximum: a flow has it, it is the capacity of a cut, flow keeps within capacities and is conserved."""
    e = keep(network_of(spark, sf_dir))
    tree = network.tree_values(network.flow_tree(e, [], keep), []).withColumnRenamed("value", "by_tree")
    checks = network.flow_checks(e, _pairs(_nodes(e)), []).join(tree, ["source", "target"])
    is_cut = (F.abs(F.col("value") - F.col("cut")) < 1e-6) & (F.abs(F.col("value") - F.col("by_tree")) < 1e-6)
    return checks.select("source", "target", is_cut.alias("is_cut"), (F.col("over") < 1e-9).alias("within"), (F.col("loss") < 1e-6).alias("conserved"))


@_query(f"""WITH {_VALUES}, p AS (SELECT * FROM flow WHERE source < 22 AND target >= 22)
  SELECT node, round(sum(v), 5) AS net FROM (SELECT source AS node, value AS v FROM p UNION ALL SELECT target, -value FROM p) GROUP BY 1""")
def flow_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the accumulated flow of all sources to all targets takes out of each node, which is the sum of its pairs' values."""
    e = keep(network_of(spark, sf_dir))
    pairs = _pairs(_nodes(e)).where("source < 22 and target >= 22")
    f = network.flow_sums(e, pairs, []).withColumn("net", F.col("fwd") - F.col("rev"))
    ends = f.select(F.col("src").alias("node"), "net").unionByName(f.select(F.col("dst").alias("node"), (-F.col("net")).alias("net")))
    return rounded(ends.groupBy("node").agg(F.sum("net").alias("net")), 5)


@_query()
def flow_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = keep(network_of(spark, sf_dir))
    nodes = _nodes(e)
    seeds = nodes.where("node < 22").withColumn("weight", F.lit(1.0))
    return rounded(studies.flow_field(e, _pairs(nodes), nodes.where("node >= 22"), seeds, [], keep))


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trades(spark, sf_dir)
    return t.groupBy(F.col("flag").alias("system"), F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("price").cast("double") / MILLION).alias("weight"))


@_query()
def flow_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(paths.decompose(_flags(spark, sf_dir), ["system"], list(range(25)), [22, 23, 24], least_length=3))


@_query()
def consolidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    label = n.select(F.col("n_nationkey").alias("node"), F.concat(F.substring(F.lit("ABCD"), F.col("n_nationkey") % 4 + 1, F.lit(1)), (F.floor(F.col("n_nationkey") / 4) + 300).cast("string")).alias("label"))
    g = studies.consolidated_paths(_flags(spark, sf_dir), "system", list(range(25)), [22, 23, 24], label, keep, least_length=3, target_numbers=[305, 306])
    return rounded(g.select("system", F.concat_ws("-", "relative").alias("relative"), F.concat_ws("-", "path").alias("path"), "n_chains", "n_paths", "length", "flow_sum", "score"))


_LENGTHS = f"""{NETWORK_SQL}, t AS (SELECT src, dst, weight / sum(weight) OVER (PARTITION BY src) AS t FROM network), g AS (SELECT src, dst, greatest(0.0::DOUBLE, -ln(t + 1e-10::DOUBLE)) AS length FROM t)"""


_KSHORT = f"""WITH RECURSIVE {_LENGTHS}, p(seed, node, nodes, length) AS (SELECT node, node, [node], 0.0::DOUBLE FROM (SELECT src AS node FROM g UNION SELECT dst FROM g) UNION ALL
  SELECT seed, dst, list_append(nodes, dst), total FROM (SELECT seed, dst, nodes, p.length + g.length AS total, row_number() OVER (PARTITION BY seed, dst ORDER BY p.length + g.length, nodes) AS turn FROM p JOIN g ON p.node = g.src) WHERE turn <= 5),
  f AS (SELECT seed, node AS target, nodes, length, row_number() OVER (PARTITION BY seed, node ORDER BY length, nodes) AS turn FROM p WHERE seed <> node),
  r AS (SELECT *, row_number() OVER (PARTITION BY seed ORDER BY length, target, turn) - 1 AS place FROM f WHERE turn <= 5)
  SELECT seed, target, round(length, 5) AS length, place::INTEGER AS rank FROM r WHERE place < 5"""


@_query(_KSHORT)
def kshort_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k shortest paths of all seeds to all targets; the SQL goes by steps, as edges lead from smaller to larger nodes."""
    return kshort_network(spark, sf_dir)


@_query(_KSHORT)
def kshort_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, held against all simple paths of a small graph in the tests."""
    e = network_of(spark, sf_dir)
    g = markov.log_weights(markov.transition(e, []), None, [])
    return rounded(paths.best_paths(g, _nodes(e), list(range(25))).select("seed", "target", "length", "rank"), 5)
