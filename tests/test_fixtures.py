"""Hand-worked cases of the operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.functions import geometry, labels
from strandline.operators import build3d, catalog, cluster, dynamics, markov, matrix, network, paths, registry, select, seqalign, series, stats
from strandline.sources import dcd, pdb, sinks, tables
from strandline.streaming import windows


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_names_and_missing_replica(spark):
    files = spark.createDataFrame([("7LP9_WT_rep1.dcd",), ("7LP9_WT_rep3.dcd",)], "file string")
    n = catalog.run_name(F.col("file"))
    runs = files.select("file", *[c.alias(k) for k, c in n.items()]).withColumn("stem", F.regexp_replace("file", r"\.dcd$", ""))
    tops = spark.createDataFrame([("7LP9_WT_rep1.pdb", "7LP9_WT_rep1")], "file string, stem string")
    got = {r.replica: r.topology for r in catalog.pair_topology(runs, tops, "stem").collect()}
    assert got == {1: "7LP9_WT_rep1.pdb", 3: None}
    assert [r.replica for r in catalog.missing_replicas(runs.select("structure", "variant", "replica"), ["structure", "variant"]).collect()] == [2]


def test_config(spark, tmp_path):
    (tmp_path / "c.txt").write_text("# c\n\n  # indented = 1\na = 1\nhelix_S1=430-453\nb = x=y\n")
    got = {r.key: r.value for r in tables.read_config(spark, str(tmp_path / "c.txt")).collect()}
    assert got == {"a": "1", "helix_S1": "430-453", "b": "x=y"}
    r = one(spark, F.size(tables.range_of(F.lit("430-453"))).alias("n"), tables.range_of(F.lit("1")).alias("none"))
    assert r.n == 24 and r.none is None


def line(serial, name, alt, resname, chain, resno, x):
    return f"ATOM  {serial:5d}  {name:<3s}{alt}{resname} {chain}{resno:4d}    {x:8.3f}{0:8.3f}{0:8.3f}{1:6.2f}{0:6.2f}"


def test_structure_file(spark):
    text = [line(1, "CA", " ", "ALA", "A", 10, 1), line(2, "CB", "A", "ALA", "A", 10, 2), line(3, "CB", "B", "ALA", "A", 10, 3), line(4, "CA", " ", "GLY", "A", 11, 4), line(5, "CA", " ", "SER", "A", 12, 5), "END"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_no int, line string")
    atoms = pdb.atoms(lines)
    assert {r.resno: r.x for r in pdb.representative(atoms, []).collect()} == {10: 2.0, 11: 4.0}
    any_ = select.preferred(atoms, ["chain", "resno"], "name", ["CB", "CA"], ["serial"])
    assert {r.resno: r.x for r in any_.collect()} == {10: 2.0, 11: 4.0, 12: 5.0}
    field = spark.createDataFrame([("A", 10, 62.49)], "chain string, resno int, value double")
    out = {r.line_no: r.line for r in pdb.with_values(lines, field).collect()}
    assert out[0][60:66] == " 62.49" and out[4][60:66] == "  0.00" and out[5] == "END" and out[0][:60] == text[0][:60]


def test_trajectory_file(spark, tmp_path):
    x = np.arange(5 * 3 * 3, dtype="f4").reshape(5, 3, 3)
    (tmp_path / "t.dcd").write_bytes(dcd.encode(x))
    for df in (dcd.read(spark, [str(tmp_path / "t.dcd")], 2), dcd.read_anywhere(spark, str(tmp_path))):
        got = {r.frame: list(r.xyz) for r in df.collect()}
        assert got == {k + 1: x[k].ravel().tolist() for k in range(5)}
    assert catalog.discover(spark, str(tmp_path)).count() == 1


def test_matrix_file(spark, tmp_path):
    (tmp_path / "m.csv").write_text('"","A1","A2"\n"A1",1,2\n"A2",NA,4\n')
    (tmp_path / "n.csv").write_text("A1,A2\n5,6\n7,8\n")
    got = {(r.file.rsplit("/", 1)[1][0], r.i, r.j): r.value for r in tables.read_matrix(spark, str(tmp_path)).collect()}
    assert got == {("m", "A1", "A1"): 1, ("m", "A1", "A2"): 2, ("m", "A2", "A2"): 4, ("n", "A1", "A1"): 5, ("n", "A1", "A2"): 6, ("n", "A2", "A1"): 7, ("n", "A2", "A2"): 8}


def atoms(spark, rows):
    return spark.createDataFrame([(1, f, a, float(x), float(y), 0.0) for f, a, x, y in rows], "system int, frame int, atom int, x double, y double, z double")


def test_cross_correlation(spark):
    rows = [(f, a, *p[f]) for a, p in {1: [(0, 0), (1, 0), (2, 0)], 2: [(0, 0), (2, 0), (4, 0)], 3: [(4, 0), (2, 0), (0, 0)], 4: [(0, 0), (0, 1), (0, 0)]}.items() for f in range(3)]
    got = {(r.i, r.j): r.c for r in dynamics.cross_correlation(atoms(spark, rows), ["system"]).collect()}
    assert got[1, 2] == pytest.approx(1) and got[1, 3] == pytest.approx(-1) and got[1, 4] == pytest.approx(0) and all(got[k, k] == pytest.approx(1) for k in range(1, 5))


def test_distance_statistics_and_pooling(spark):
    d = spark.createDataFrame([(1, 1, 2, float(v)) for v in (1, 2, 3, 4, 6)] + [(2, 1, 2, 5.0)], "system int, i int, j int, d double")
    got = {r.system: (r.mean, r["var"]) for r in dynamics.distance_statistics(d, ["system"], ()).collect()}
    assert got[1] == (pytest.approx(3.2), pytest.approx(3.7)) and got[2] == (5.0, 0.0)
    s = spark.createDataFrame([(1, 3, 2.0, 1.0), (1, 2, 5.0, 2.0)], "system int, n int, mean double, var double")
    r = matrix.pool_replicas(s, ["system"]).first()
    assert (r.n_total, r.pooled_mean, r.pooled_var) == (5, pytest.approx(3.2), pytest.approx(3.7))


def test_rolling_mean(spark):
    df = spark.createDataFrame([(1, k, float(k)) for k in range(1, 8)], "g int, k int, v double")
    assert [r.smooth for r in series.rolling_mean(df, ["g"], "k", "v").orderBy("k").collect()] == [None, None, 3.0, 4.0, 5.0, None, None]
    assert series.quantile_limits(spark.createDataFrame([(1, float(k)) for k in range(1, 5)], "g int, v double"), ["g"], "v", {"q": 0.95}).first().q == pytest.approx(3.85)


EDGES = [(1, 2, 3.0), (1, 3, 2.0), (2, 3, 1.0), (2, 4, 2.0), (3, 4, 3.0)]


def test_maximum_flow(spark):
    e = spark.createDataFrame(EDGES, "src int, dst int, weight double")
    r = network.max_flows(e, spark.createDataFrame([(1, 4)], "source int, target int"), []).first()
    assert r.value == pytest.approx(5) and [x.flow for x in r.edges] == pytest.approx([3, 2, 1, 2, 3]) and {x.src for x in r.edges if x.src_side} == {1}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 7), st.integers(0, 7), st.integers(1, 9)), min_size=1, max_size=20))
def test_flow_is_certified_by_its_cut(rows):
    edges = [(a, b, float(w)) for a, b, w in rows if a != b]
    value, flows, side = network.FlowNet(edges).run(0, 7)
    assert value == pytest.approx(sum(w for a, b, w in edges if (a in side) != (b in side)))
    assert all(abs(f) <= w + 1e-9 for (_, _, w), f in zip(edges, flows, strict=True))
    for n in range(1, 7):
        assert sum(f * ((b == n) - (a == n)) for (a, b, _), f in zip(edges, flows, strict=True)) == pytest.approx(0)


def test_markov(spark):
    flow = spark.createDataFrame(EDGES, "src int, dst int, weight double")
    t = markov.transition(flow, []).cache()
    gone = spark.createDataFrame([(4,)], "node int")
    nodes = spark.createDataFrame([(k,) for k in range(1, 5)], "node int")
    n = markov.fundamental_series(t, [], gone, nodes, lambda d: d.cache())
    solved = markov.fundamental_solve(t.withColumn("g", F.lit(1)), "g", gone)
    want = {(1, 1): 1, (1, 2): 0.6, (1, 3): 0.6, (2, 2): 1, (2, 3): 1 / 3, (3, 3): 1}
    for got in (n, solved):
        assert {(r.i, r.j): r.n for r in got.collect() if r.n > 1e-12} == {k: pytest.approx(v) for k, v in want.items()}
    imp = markov.node_importance(n, [])
    e = {(r.i, r.j): r.e for r in markov.edge_importance(t, imp, []).collect()}
    assert [e[k] for k in ((1, 2), (1, 3), (2, 3), (2, 4), (3, 4))] == pytest.approx([0.3, 0.2, 0.266667, 0.533333, 0.966667], abs=1e-6)
    seeds = spark.createDataFrame([(1, 1.0), (2, 1.0), (9, 1.0)], "node int, weight double")
    assert {r.node: r.field for r in markov.visitation_field(n, seeds, []).collect()} == {1: pytest.approx(0.5), 2: pytest.approx(0.8), 3: pytest.approx(0.466667, abs=1e-6)}
    g = markov.log_weights(t, None, [])
    p = paths.best_paths(g, seeds.where("node = 1"), [4]).orderBy("rank").collect()
    assert [r.length for r in p] == pytest.approx([0.916291, 0.916291, 1.609438], abs=1e-5) and sorted(map(tuple, (r.nodes for r in p[:2]))) == [(1, 2, 4), (1, 3, 4)] and list(p[2].nodes) == [1, 2, 3, 4]


def test_labels(spark):
    arr = lambda *n: F.array(*[F.lit(x) for x in n])
    r = one(spark, labels.relative_path(arr("C300", "D310", "A320")).alias("a"), labels.rotate_path(arr("A399", "D500")).alias("b"), labels.rotate_path(arr("A450", "D500")).alias("c"), labels.parse_path(F.lit("A12-x 7")).alias("d"), labels.scale_to_cap(F.lit(0.5), F.lit(0.8)).alias("e"))
    assert (r.a, r.b, r.c, r.d) == (["A300", "B310", "C320"], ["B399", "A500"], ["A450", "D500"], ["A12", "A7"]) and round(r.e, 2) == 62.49


def test_angles(spark):
    v = lambda *x: [F.lit(float(k)) for k in x]
    r = one(spark, geometry.acute_angle(v(1, 0, 0), v(-1, 1, 0)).alias("a"), geometry.full_angle(v(1, 0, 0), v(-1, 1, 0)).alias("b"), geometry.full_angle(v(0, 0, 0), v(1, 0, 0)).alias("c"))
    assert (round(r.a, 6), round(r.b, 6), r.c) == (45.0, 135.0, None)
    pts = spark.createDataFrame([(1, k, float(k), 0.0, 0.0) for k in range(5)], "g int, atom int, x double, y double, z double")
    assert [r.bend for r in dynamics.local_bend(pts, ["g"]).orderBy("atom").collect()] == [None, None, pytest.approx(180), None, None]
    p = pts.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("atom", "x", "y", "z"))).alias("p")).select(geometry.mid_vector_angle("p").alias("m"), geometry.triangle_angle("p").alias("t")).first()
    assert p.m == pytest.approx(180) and p.t is None


def test_alignment():
    a, b = ["a", "b", "c"], ["a", "c"]
    score = lambda x, y: seqalign._steps(x, y, {})
    s = [seqalign.local_align(x, y, score(x, y))[0] for x, y in ((a, a), (b, b), (a, b))]
    assert s == [6, 4, 2] and 1 - s[2] / math.sqrt(s[0] * s[1]) == pytest.approx(0.591752, abs=1e-6)
    same = lambda x, y: seqalign._similarity(x, y, {}, 8.0)
    assert seqalign.global_align(a, b, same(a, b))[0] == 1.5 and seqalign.global_distance(a, b, same(a, b)) == 0.5
    assert seqalign.global_distance(a, ["x", "y", "z"], same(a, ["x", "y", "z"])) == 1 and seqalign.global_distance([], [], np.zeros((0, 0))) == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=8), st.lists(st.sampled_from("abcd"), max_size=8))
def test_alignment_properties(x, y):
    sim = lambda p, q: seqalign._similarity(p, q, {}, 8.0)
    assert seqalign.global_distance(x, x, sim(x, x)) == 0
    assert seqalign.global_distance(x, y, sim(x, y)) == pytest.approx(seqalign.global_distance(y, x, sim(y, x)))
    columns = seqalign.global_align(x, y, sim(x, y))[1]
    assert [p for p, _ in columns if p] == x and [q for _, q in columns if q] == y


def test_changes(spark):
    m = lambda rows: spark.createDataFrame(rows, "i int, j int, value double")
    got = {(r.i, r.j): (r.status, r.delta) for r in matrix.sentinel_delta(m([(1, 2, 10.0), (1, 3, 0.001), (2, 3, 5.0)]), m([(1, 2, 12.0), (1, 3, 7.0)]), []).collect()}
    assert got == {(1, 2): ("keep", 2.0), (1, 3): ("appear", 999.0), (2, 3): ("vanish", -999.0)}
    cells = [(k, k + 1, v, w, c) for k, (v, w, c) in enumerate(matrix.CATEGORY)]
    s = lambda at: spark.createDataFrame([(a, b, (v, w)[at]) for a, b, v, w, _ in cells], "i int, j int, status string")
    assert {r.i: r.category for r in matrix.category_delta(s(0), s(1), []).collect()} == {a: c for a, _, _, _, c in cells}
    f = matrix.from_edges(spark.createDataFrame([("A", "B", 2.0), ("B", "A", 3.0)], "a string, b string, w double"), [], "a", "b", "w")
    assert {(r.i, r.j): r.value for r in f.collect()} == {("A", "B"): 5.0, ("B", "A"): 5.0}
    r = {x.i: (x["mean"], x.se) for x in matrix.replica_mean(m([(1, 1, 1.0), (1, 1, 2.0), (2, 2, 1.0)]), []).collect()}
    assert r == {1: (1.5, pytest.approx(0.5)), 2: (1.0, None)}


def test_registry(spark):
    old = spark.createDataFrame([("x", "a"), ("y", "b")], "script string, value string")
    new = spark.createDataFrame([("x", "c", "fwd")], "script string, value string, run_type string")
    assert sorted((r.script, r.value) for r in registry.replace_latest(old, new, ["script"]).collect()) == [("x", "c"), ("y", "b")]
    assert registry.append(old, new).count() == 3


def test_selection(spark):
    axis = spark.createDataFrame([(k, c, n) for k, (c, n) in enumerate([("A", 300), ("A", 302), ("B", 299), ("B", 305)], 1)], "pos int, chain string, number int")
    assert [r.pos for r in select.slice_nearest(axis, "pos", ("A", 301), ("B", 304)).orderBy("pos").collect()] == [2, 3]
    with pytest.raises(Exception, match="no such label"):
        select.slice_between(axis, "number", "pos", 300, 999).collect()
    ranges = spark.createDataFrame([("S1", 10, 20, 1), ("S2", 15, 30, 2)], "name string, low int, high int, ordinal int")
    assert select.annotate_ranges(spark.createDataFrame([(1, 17)], "id int, n int"), "n", ranges, ["id"]).first().range_name == "S2"


def test_paths(spark):
    raw = spark.createDataFrame([(1, ["A1", "B2"], 2.0, -1.0, "A1"), (2, ["C1", "D2"], 3.0, -3.0, "C1")], "path_id int, nodes array<string>, importance double, log_prob double, seed string")
    r = paths.dedup_paths(raw, []).first()
    assert (r.n_duplicates, r.importance, r.log_prob, r.chain_origins) == (2, 5.0, -2.0, ["A", "C"])


def test_equivalents(spark):
    s = spark.createDataFrame([("me", "t", 1, 100.0), ("a", "t", 1, 10.0), ("b", "t", 1, 9.99), ("c", "t", 1, 50.0)], "system string, target string, node int, seed_score double")
    assert {r.system: r.n_equivalent for r in network.equivalents(s, "system").collect()}["me"] == 2


def test_guides(spark):
    p = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0), (1, 2, 10.0, 0.0, 0.0), (2, 1, 0.0, 0.0, 0.0), (2, 2, 4.0, 0.0, 0.0)], "g int, k int, x double, y double, z double")
    got = build3d.guides(p, ["g"], "k").orderBy("g", "k", "step").collect()
    assert [round(r.x, 3) for r in got if r.g == 1] == [0, 3.333, 6.667, 10] and sum(r.g == 2 for r in got) == 2
    atoms_ = build3d.strand(np.array([[3.5 * k, 0.1 * k, 0.0] for k in range(6)]))
    assert np.linalg.norm(atoms_[1:, 0] - atoms_[:-1, 2], axis=1) == pytest.approx(np.full(5, build3d.C_N))


def test_superposition(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(8, 3))
    c, s = np.cos(0.7), np.sin(0.7)
    y = x @ np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) + 3
    rows = lambda m: [(1, k, *map(float, p)) for k, p in enumerate(m)]
    a, b = (spark.createDataFrame(rows(m), "g int, atom int, x double, y double, z double") for m in (x, y))
    moved = dynamics.superpose(b, a.drop("g"), ["g"])
    assert dynamics.rmsd(moved, a.drop("g"), ["g"]).first().rmsd == pytest.approx(0, abs=1e-9)


def test_clusters():
    d = np.array([[0, 1, 9, 9], [1, 0, 9, 9], [9, 9, 0, 1], [9, 9, 1, 0]], float)
    m = cluster.linkage(d)
    assert [x[2] for x in m] == [1, 1, 9] and cluster.cut_tree(m, 4, 2).tolist() == [1, 1, 2, 2] and cluster.auto_number(d, m) == 2
    assert cluster.neighbour_joining(d, list("abcd")).count(",") == 3


def test_mixture():
    rng = np.random.default_rng(1)
    assert stats.choose(rng.normal(0, 1, 400))["components"] == 1
    two = stats.choose(np.concatenate([rng.normal(0, 1, 300), rng.normal(8, 1, 300)]))
    assert two["components"] == 2 and two["means"] == pytest.approx([0, 8], abs=0.3)


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:01:00", 1, 1.0), ("2024-01-01 00:30:00", 1, 3.0), ("2024-01-01 03:00:00", 1, 9.0)], "t string, k int, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    q = windows.windowed_statistics(stream, "k", "t", "v").writeStream.format("memory").queryName("stats").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r["mean"], r["var"]) for r in spark.table("stats").collect()) == [(1, 9.0, 0.0), (2, 2.0, 2.0)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_partitions_don_t_matter(spark, parts):
    rng = np.random.default_rng(2)
    rows = [(1, f, a, *map(float, rng.normal(size=3))) for f in range(12) for a in range(6)]
    f = spark.createDataFrame(rows, "system int, frame int, atom int, x double, y double, z double").repartition(parts)
    got = {(r.i, r.j): round(r.c, 9) for r in dynamics.cross_correlation(f, ["system"]).collect()}
    x = np.array([r[3:] for r in rows]).reshape(12, 6, 3)
    d = x - x.mean(axis=0)
    p = np.einsum("fic,fjc->ij", d, d)
    assert got == {(i, j): round(p[i, j] / math.sqrt(p[i, i] * p[j, j]), 9) for i in range(6) for j in range(i, 6)}


def test_written_once(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "g string, v int")
    path = f"{tmp_path}/t"
    assert sinks.read_or_make(spark, path, lambda: df, ["g"]).count() == 2
    assert sinks.read_or_make(spark, path, lambda: df.limit(0), ["g"]).count() == 2
    sinks.write_table(df, f"{tmp_path}/c", policy="overwrite", kind="csv")
    assert spark.read.csv(f"{tmp_path}/c", header=True).count() == 2


def test_comparisons(spark):
    s = spark.createDataFrame([(a, b) for a in ("P", "Q", "R") for b in ("WT", "X", "Y", "Z")], "structure string, variant string")
    assert catalog.comparisons(s, "P", "WT").count() == 17
