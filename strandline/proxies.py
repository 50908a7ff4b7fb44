"""The driver's tables read as the domain's: frames of atoms, time series, a flow network, ordered paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


#: Values with few decimals are scaled by this, as their means would often end in a 5 that engines round either way.
UNTIE = 1.000003141592653
MILLION = 1000003.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(system, frame, atom, x, y, z)``: 21 atoms from the first 63 components of each embedding."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k: F.element_at("embedding", (F.lit(3) * F.col("atom") - k).cast("int")).cast("double")
    return e.select(F.col("label").alias("system"), F.col("vec_id").alias("frame"), "embedding", F.explode(F.sequence(F.lit(1), F.lit(21))).alias("atom")).select("system", "frame", "atom", at(2).alias("x"), at(1).alias("y"), at(0).alias("z"))


def frame_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(system, frame, points)``: the points of ``frames`` in the order of atoms; a frame's are shuffled as one row."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda k, j: F.element_at("embedding", (F.lit(3) * k - j).cast("int")).cast("double")
    point = lambda k: F.struct(k.alias("atom"), at(k, 2).alias("x"), at(k, 1).alias("y"), at(k, 0).alias("z"))
    own = e.select(F.col("label").alias("system"), F.col("vec_id").alias("frame"), F.transform(F.sequence(F.lit(1), F.lit(21)), point).alias("own"))
    return own.groupBy("system", "frame").agg(F.array_sort(F.flatten(F.collect_list("own"))).alias("points"))


FRAMES_SQL = """frames AS (
  SELECT label AS system, vec_id AS frame, a.atom::INTEGER AS atom,
    embedding[3 * a.atom - 2]::DOUBLE AS x, embedding[3 * a.atom - 1]::DOUBLE AS y, embedding[3 * a.atom]::DOUBLE AS z
  FROM embeddings, range(1, 22) a(atom))"""


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(chain, frame, condition, value)``: each user's events in order; frames count from 1."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.select(F.col("user_id").alias("chain"), F.row_number().over(order).alias("frame"), F.col("event_type").alias("condition"), (F.col("value") * F.lit(UNTIE)).alias("value"))


SERIES_SQL = """series AS (
  SELECT user_id AS chain, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id))::INTEGER AS frame, event_type AS condition, value * 1.000003141592653::DOUBLE AS value FROM events)"""


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, price, flag, status, segment)``: lineitems from the customer's nation to the supplier's."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("price"), F.col("l_returnflag").alias("flag"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderstatus").alias("status"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("src"), F.col("c_mktsegment").alias("segment"))
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dst"))
    j = li.join(o, li.l_orderkey == o.o_orderkey).join(c, o.o_custkey == c.c_custkey).join(s, li.l_suppkey == s.s_suppkey)
    return j.where("src <> dst").select("src", "dst", "price", "flag", "status", "segment")


TRADES_SQL = """trades AS (
  SELECT c_nationkey AS src, s_nationkey AS dst, l_extendedprice::DECIMAL(18,2) AS price, l_returnflag AS flag, o_orderstatus AS status, c_mktsegment AS segment
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE c_nationkey <> s_nationkey)"""


def network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(src, dst, weight)``: undirected, ``src < dst``, weight in about millions."""
    t = trades(spark, sf_dir)
    return t.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg((F.sum("price").cast("double") / MILLION).alias("weight"))


NETWORK_SQL = f"""{TRADES_SQL}, network AS (
  SELECT least(src, dst) AS src, greatest(src, dst) AS dst, sum(price)::DOUBLE / 1000003.0::DOUBLE AS weight FROM trades GROUP BY 1, 2)"""


def condition_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(condition, variant, i, j, value)``: the network by return flag and market segment, upper triangle."""
    t = trades(spark, sf_dir)
    return t.groupBy(F.col("flag").alias("condition"), F.col("segment").alias("variant"), F.least("src", "dst").alias("i"), F.greatest("src", "dst").alias("j")).agg(F.sum("price").cast("double").alias("value"))


MATRICES_SQL = f"""{TRADES_SQL}, matrices AS (
  SELECT flag AS condition, segment AS variant, least(src, dst) AS i, greatest(src, dst) AS j, sum(price)::DOUBLE AS value FROM trades GROUP BY 1, 2, 3, 4)"""


def order_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(path_id, flow, nodes)``: an order's supplier nations in line order as labels such as ``B17``; the chain is the line number's."""
    li = table(spark, sf_dir, "lineitem")
    s = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    label = F.concat(F.substring(F.lit("ABCD"), F.pmod(F.col("l_linenumber"), F.lit(4)).cast("int") + 1, F.lit(1)), F.col("s_nationkey"))
    rows = li.join(s, li.l_suppkey == s.s_suppkey).select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", label.alias("label")).alias("step"), F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    g = rows.groupBy(F.col("l_orderkey").alias("path_id")).agg(F.array_sort(F.collect_list("step")).alias("steps"), F.sum("price").cast("double").alias("flow"))
    return g.select("path_id", "flow", F.transform("steps", lambda s: s["label"]).alias("nodes"))


PATHS_SQL = """paths AS (
  SELECT l_orderkey AS path_id, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS flow,
    list(substr('ABCD', (l_linenumber % 4 + 1)::INTEGER, 1) || s_nationkey::VARCHAR ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, substr('ABCD', (l_linenumber % 4 + 1)::INTEGER, 1) || s_nationkey::VARCHAR) AS nodes
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_orderkey)"""
