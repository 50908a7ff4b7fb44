"""Catalogue, selection, registry and file-format queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels
from ..operators import catalog, registry, select
from ..proxies import table
from ..sources import pdb, tables
from .common import registry as registry_of_queries

QUERIES, ORACLES, _query = registry_of_queries()

_RUNS = """runs AS (SELECT s_suppkey AS id, CASE s_nationkey % 3 WHEN 0 THEN '7LP9' WHEN 1 THEN '7LPB' ELSE '7LPE' END || '_' ||
  CASE s_nationkey % 4 WHEN 0 THEN 'WT' WHEN 1 THEN 'M1' WHEN 2 THEN 'M2' ELSE 'M3' END || '_rep' || (s_suppkey % 7 + 1)::VARCHAR || '.dcd' AS file FROM supplier)"""


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    pick = lambda c, names: F.element_at(F.array(*[F.lit(n) for n in names]), (F.pmod(F.col(c), F.lit(len(names))) + 1).cast("int"))
    return s.select(F.col("s_suppkey").alias("id"), F.concat(pick("s_nationkey", ["7LP9", "7LPB", "7LPE"]), F.lit("_"), pick("s_nationkey", ["WT", "M1", "M2", "M3"]), F.lit("_rep"), (F.col("s_suppkey") % 7 + 1).cast("string"), F.lit(".dcd")).alias("file"))


@_query(f"""WITH {_RUNS} SELECT id, split_part(file, '_', 1) AS structure, split_part(file, '_', 2) AS variant,
  regexp_extract(split_part(file, '_', 3), '[0-9]+')::INTEGER AS replica, regexp_replace(file, '_rep[0-9]+\\.dcd$', '') AS condition,
  CASE split_part(file, '_', 1) WHEN '7LP9' THEN 'Apo' WHEN '7LPB' THEN 'Cap' ELSE 'Heat' END AS state FROM runs""")
def catalog_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    n = catalog.run_name(F.col("file"))
    return r.select("id", *[c.alias(k) for k, c in n.items()], catalog.condition_of(F.col("file")).alias("condition"), labels.condition_label(n["structure"], {"7LP9": "Apo", "7LPB": "Cap"}, "Heat").alias("state"))


@_query(f"""WITH {_RUNS}, r AS (SELECT DISTINCT split_part(file, '_', 1) AS structure, split_part(file, '_', 2) AS variant, regexp_extract(split_part(file, '_', 3), '[0-9]+')::INTEGER AS replica FROM runs),
  w AS (SELECT structure, variant, min(replica) AS a, max(replica) AS b FROM r GROUP BY 1, 2),
  e AS (SELECT structure, variant, unnest(range(a, b + 1))::INTEGER AS replica FROM w) SELECT * FROM e EXCEPT SELECT * FROM r""")
def missing_replica(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir)
    n = catalog.run_name(F.col("file"))
    return catalog.missing_replicas(r.select(*[c.alias(k) for k, c in n.items()]).distinct(), ["structure", "variant"])


@_query(f"""WITH {_RUNS}, r AS (SELECT DISTINCT split_part(file, '_', 1) AS structure, split_part(file, '_', 2) AS variant, regexp_extract(split_part(file, '_', 3), '[0-9]+')::INTEGER AS replica FROM runs)
  SELECT structure, variant, string_agg(replica::VARCHAR, ',' ORDER BY replica) AS replicas, min(replica) AS first_replica, max(replica) AS last_replica, count(*) AS n_replicas FROM r GROUP BY 1, 2""")
def replica_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.run_name(F.col("file"))
    return catalog.replica_summary(_runs(spark, sf_dir).select(*[c.alias(k) for k, c in n.items()]).distinct(), ["structure", "variant"])


@_query(f"""WITH {_RUNS}, t AS (SELECT regexp_replace(file, '\\.dcd$', '') AS stem, file FROM runs WHERE id % 3 = 0),
  one AS (SELECT stem, CASE WHEN count(*) = 1 THEN min(file) END AS topology FROM t GROUP BY 1)
  SELECT id, file, topology FROM (SELECT id, file, regexp_replace(file, '\\.dcd$', '') AS stem FROM runs) r LEFT JOIN one USING (stem)""")
def topology_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).withColumn("stem", F.regexp_replace("file", r"\.dcd$", ""))
    return catalog.pair_topology(r, r.where("id % 3 = 0").select("stem", "file"), "stem").select("id", "file", "topology")


@_query(f"""WITH {_RUNS} SELECT id, file FROM runs r WHERE NOT (split_part(file, '_', 1) = '7LPB' AND id % 2 = 0) AND regexp_matches(file, '^7LP[9B]')""")
def replica_exclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _runs(spark, sf_dir).where(F.col("file").rlike("^7LP[9B]"))
    return catalog.exclude(r, r.where(F.col("file").startswith("7LPB") & (F.col("id") % 2 == 0)).select("id"), ["id"])


@_query("""WITH f AS (SELECT p_partkey AS id, 'S' || p_size::VARCHAR || '_V_rep' || (p_partkey % 3)::VARCHAR || CASE p_partkey % 3 WHEN 0 THEN '_intra' WHEN 1 THEN '_lbd' ELSE '_x' END || '.rds' AS file FROM part)
  SELECT id, split_part(file, '_', 1) || '_' || split_part(file, '_', 2) AS system, regexp_extract(file, '_rep([0-9]+)', 1)::INTEGER AS replica,
  CASE WHEN file LIKE '%!_intra.rds' ESCAPE '!' THEN 'intracellular' WHEN file LIKE '%!_lbd.rds' ESCAPE '!' THEN 'ligand' ELSE 'unknown' END AS family FROM f""")
def artifact_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    end = F.element_at(F.array(F.lit("_intra"), F.lit("_lbd"), F.lit("_x")), (F.col("p_partkey") % 3 + 1).cast("int"))
    f = p.select(F.col("p_partkey").alias("id"), F.concat(F.lit("S"), F.col("p_size").cast("string"), F.lit("_V_rep"), (F.col("p_partkey") % 3).cast("string"), end, F.lit(".rds")).alias("file"))
    return f.select("id", *[c.alias(k) for k, c in catalog.artifact_name(F.col("file"), {"_intra": "intracellular", "_lbd": "ligand"}).items()])


@_query("""SELECT o_custkey, o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE o_orderpriority WHEN '1-URGENT' THEN 1 ELSE 2 END, o_orderkey) AS t
  FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) WHERE t = 1""")
def rep_atom_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.preferred(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), ["o_custkey"], "o_orderpriority", ["1-URGENT", "2-HIGH"], ["o_orderkey"])


@_query("""WITH r(name, low, high, ordinal) AS (VALUES ('S1', 1, 12, 1), ('S2', 10, 20, 2), ('S3', 25, 30, 3), ('S4', 28, 45, 4))
  SELECT p_partkey, p_size, max_by(name, ordinal) AS range_name FROM part LEFT JOIN r ON p_size BETWEEN low AND high GROUP BY 1, 2""")
def range_annotate(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.createDataFrame([("S1", 1, 12, 1), ("S2", 10, 20, 2), ("S3", 25, 30, 3), ("S4", 28, 45, 4)], "name string, low int, high int, ordinal int")
    return select.annotate_ranges(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size", r, ["p_partkey"])


@_query("""SELECT p_partkey, p_size FROM part WHERE (p_size BETWEEN 5 AND 12 OR p_size BETWEEN 30 AND 40) AND (p_retailprice < 950 OR p_retailprice > 1200)""")
def range_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.where(select.in_ranges(F.col("p_size"), [(5, 12), (30, 40)]) & select.outside(F.col("p_retailprice"), 950, 1200)).select("p_partkey", "p_size")


@_query("""(SELECT c_nationkey, 'extra' AS side FROM (SELECT c_nationkey FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier))
  UNION ALL (SELECT s_nationkey, 'missing' FROM (SELECT s_nationkey FROM supplier EXCEPT ALL SELECT c_nationkey FROM customer))""")
def selection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_nationkey")
    return select.differences(c, table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("c_nationkey")), ["c_nationkey"])


_HISTORY = """h AS (SELECT 'script' || (o_custkey % 9)::VARCHAR AS script, o_orderpriority AS variable, o_totalprice::DECIMAL(18,2)::VARCHAR AS value, o_orderkey AS timestamp FROM orders)"""


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.concat(F.lit("script"), (F.col("o_custkey") % 9).cast("string")).alias("script"), F.col("o_orderpriority").alias("variable"), F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("value"), F.col("o_orderkey").alias("timestamp"))


@_query(f"WITH {_HISTORY} SELECT script, variable, value, timestamp FROM (SELECT *, row_number() OVER (PARTITION BY script, variable ORDER BY timestamp DESC, value DESC) AS t FROM h) WHERE t = 1")
def registry_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.latest(_history(spark, sf_dir), ["script", "variable"])


@_query(f"""WITH {_HISTORY}, n AS (SELECT script, variable, value, timestamp, 'fwd' AS run_type FROM h WHERE script IN ('script1', 'script3'))
  SELECT *, NULL AS run_type FROM h WHERE script NOT IN (SELECT script FROM n) UNION ALL SELECT * FROM n""")
def registry_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    new = h.where("script in ('script1', 'script3')").withColumn("run_type", F.lit("fwd"))
    return registry.replace_latest(h, new, ["script"])


@_query(f"""WITH {_HISTORY} SELECT *, NULL AS run_type FROM h WHERE timestamp % 2 = 0 UNION ALL SELECT *, 'rev' FROM h WHERE timestamp % 2 = 1""")
def registry_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = _history(spark, sf_dir)
    return registry.append(h.where("timestamp % 2 = 0"), h.where("timestamp % 2 = 1").withColumn("run_type", F.lit("rev")))


@_query("""WITH l(n, s) AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '  # note = 1' WHEN 1 THEN 'helix_S' || p_partkey::VARCHAR || ' = ' || p_size::VARCHAR || '-' || (p_size + 5)::VARCHAR WHEN 2 THEN '' ELSE 'path' || p_partkey::VARCHAR || '=a=b ' END FROM part)
  SELECT trim(substr(s, 1, instr(s, '=') - 1)) AS key, trim(substr(s, instr(s, '=') + 1)) AS value,
  CASE WHEN regexp_matches(s, '[0-9]+-[0-9]+$') THEN regexp_extract(s, '([0-9]+)-([0-9]+)$', 2)::INTEGER - regexp_extract(s, '([0-9]+)-([0-9]+)$', 1)::INTEGER + 1 END AS n_numbers FROM l WHERE trim(s) <> '' AND trim(s) NOT LIKE '#%'""")
def config_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k, s = F.col("p_partkey").cast("string"), F.col("p_size")
    line = F.when(F.col("p_partkey") % 4 == 0, "  # note = 1").when(F.col("p_partkey") % 4 == 1, F.concat(F.lit("helix_S"), k, F.lit(" = "), s.cast("string"), F.lit("-"), (s + 5).cast("string"))).when(F.col("p_partkey") % 4 == 2, "").otherwise(F.concat(F.lit("path"), k, F.lit("=a=b ")))
    c = tables.parse_config(p.select(line.alias("value")))
    return c.select("key", "value", F.when(tables.range_of(F.col("value")).isNotNull(), F.size(tables.range_of(F.col("value")))).alias("n_numbers"))


_ATOMS = """a AS (SELECT p_partkey AS serial, CASE p_partkey % 3 WHEN 0 THEN 'CA' WHEN 1 THEN 'CB' ELSE 'N' END AS name, CASE p_partkey % 5 WHEN 0 THEN 'GLY' ELSE 'ALA' END AS resname,
  substr('ABCD', p_size % 4 + 1, 1) AS chain, (p_partkey // 3 % 900 + 1)::INTEGER AS resno, round(p_retailprice / 10, 3) AS x, p_size::DOUBLE AS y, (p_partkey % 100)::DOUBLE AS z FROM part)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pick = lambda e, names: F.element_at(F.array(*[F.lit(n) for n in names]), (e + 1).cast("int"))
    line = pdb.atom_line(
        F.col("p_partkey").cast("int"), pick(F.col("p_partkey") % 3, ["CA", "CB", "N"]), pick(F.least(F.col("p_partkey") % 5, F.lit(1)), ["GLY", "ALA"]), F.substring(F.lit("ABCD"), F.col("p_size") % 4 + 1, F.lit(1)),
        (F.floor(F.col("p_partkey") / 3) % 900 + 1).cast("int"), F.round(F.col("p_retailprice") / 10, 3), F.col("p_size").cast("double"), (F.col("p_partkey") % 100).cast("double"), F.lit(1.0), F.lit(0.0),
    )
    return p.select(F.col("p_partkey").alias("line_no"), line.alias("line"))


@_query(f"WITH {_ATOMS} SELECT serial::INTEGER AS serial, name, resname, chain, resno, x, y, z FROM a")
def pdb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdb.atoms(_lines(spark, sf_dir)).select("serial", "name", "resname", "chain", "resno", "x", "y", "z")


@_query(f"WITH {_ATOMS} SELECT chain, resno, min_by(x, serial) AS x, min_by(y, serial) AS y, min_by(z, serial) AS z FROM a WHERE name = CASE WHEN resname = 'GLY' THEN 'CA' ELSE 'CB' END GROUP BY 1, 2")
def representative_atoms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pdb.representative(pdb.atoms(_lines(spark, sf_dir)), [])


@_query(f"""WITH {_ATOMS}, f AS (SELECT chain, resno, count(*)::DOUBLE AS value FROM a WHERE resno % 2 = 0 GROUP BY 1, 2)
  SELECT serial AS line_no, printf('%6.2f', coalesce(value, 0.0::DOUBLE)) AS b FROM a LEFT JOIN f USING (chain, resno)""")
def bfactor_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir)
    field = pdb.atoms(lines).where("resno % 2 = 0").groupBy("chain", "resno").agg(F.count("*").cast("double").alias("value"))
    return pdb.with_values(lines, field).select("line_no", F.substring("line", 61, 6).alias("b"))


@_query(f"WITH {_ATOMS} SELECT chain, resno, serial, row_number() OVER (PARTITION BY chain ORDER BY resno, serial)::INTEGER AS node_id, chain || resno::VARCHAR AS label FROM a WHERE name = 'CA'")
def residue_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = select.by_element(pdb.atoms(_lines(spark, sf_dir)), elements=["CA"]).select("chain", "resno", F.col("serial").cast("long").alias("serial"))
    return catalog.dense_index(a, ["chain"], ["resno", "serial"]).withColumn("label", labels.make_label("chain", "resno"))


@_query(f"""WITH {_RUNS}, s AS (SELECT DISTINCT split_part(file, '_', 1) AS s, split_part(file, '_', 2) AS v FROM runs)
  SELECT a.s || '_' || a.v AS a, b.s || '_' || b.v AS b FROM s a JOIN s b ON (a.s = '7LP9' AND b.s <> '7LP9' AND a.v = b.v) OR (a.v = 'WT' AND b.v <> 'WT' AND a.s = b.s)""")
def comparison_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = catalog.run_name(F.col("file"))
    return catalog.comparisons(_runs(spark, sf_dir).select(n["structure"].alias("structure"), n["variant"].alias("variant")), "7LP9", "WT")
