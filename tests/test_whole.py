"""That queries feed their operators all rows, on a small folder of tables against brute force."""

import itertools
import math
from collections import defaultdict

import numpy as np
import pytest

from strandline import queries

NATIONS = [0, 3, 7, 9, 15, 21, 22, 24]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables with a trade each way between most nations, and the trades: ``(flag, src, dst): price``."""
    path, rng = str(tmp_path_factory.mktemp("trades")), np.random.default_rng(5)
    customers = [(k + 1, n, "S") for k, n in enumerate(NATIONS)]
    suppliers = [(k + 1, n) for k, n in enumerate(NATIONS)]
    orders = [(k + 1, c, "O") for k, c in enumerate(c for c, *_ in customers for _ in range(3))]
    trades, lines = defaultdict(float), []
    for o, c, _ in orders:
        for s, n in suppliers:
            price = float(rng.integers(100_000, 9_000_000))
            flag = "ANR"[int(rng.integers(0, 3))]
            lines.append((o, s, price, flag))
            if n != NATIONS[c - 1]:
                trades[flag, *sorted((n, NATIONS[c - 1]))] += price / 1000003.0
    for name, rows, schema in (
        ("customer", customers, "c_custkey long, c_nationkey int, c_mktsegment string"), ("supplier", suppliers, "s_suppkey long, s_nationkey int"),
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderstatus string"), ("lineitem", lines, "l_orderkey long, l_suppkey long, l_extendedprice double, l_returnflag string"),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{path}/{name}.parquet")
    return path, dict(trades)


def network_of(trades):
    e = defaultdict(float)
    for (_, a, b), w in trades.items():
        e[a, b] += w
    return e


def test_maximum_flow_of_all_pairs(spark, folder):
    path, trades = folder
    e = network_of(trades)
    got = {(r.source, r.target): r.value for r in queries.QUERIES["maxflow_value"](spark, path).collect()}
    for s, t in itertools.permutations(NATIONS, 2):
        rest = [n for n in NATIONS if n not in (s, t)]
        sides = ({s, *c} for k in range(len(rest) + 1) for c in itertools.combinations(rest, k))
        assert got.pop((s, t)) == pytest.approx(min(sum(w for (a, b), w in e.items() if (a in x) != (b in x)) for x in sides), abs=1e-5)
    assert not got
    r = queries.QUERIES["flow_certificate"](spark, path).collect()
    assert len(r) == len(NATIONS) * (len(NATIONS) - 1) and all(x.is_cut and x.within and x.conserved for x in r)


def test_flow_field_of_all_pairs_and_seeds(spark, folder):
    from strandline.operators.network import FlowNet

    path, trades = folder
    e = sorted((a, b, w) for (a, b), w in network_of(trades).items())
    net, fwd = FlowNet(e), np.zeros(len(e))
    for s, t in itertools.permutations(NATIONS, 2):
        fwd += np.maximum(net.run(s, t)[1], 0)
    inner = [n for n in NATIONS if n < 22]
    out = {n: sum(f for (a, _, _), f in zip(e, fwd, strict=True) if a == n) for n in NATIONS}
    q = np.zeros((len(inner), len(inner)))
    for (a, b, _), f in zip(e, fwd, strict=True):
        if a in inner and b in inner and out[a] > 0:
            q[inner.index(a), inner.index(b)] = f / out[a]
    want = np.linalg.inv(np.eye(len(inner)) - q).sum(axis=0) / len(inner)
    got = {r.node: r.field for r in queries.QUERIES["flow_field"](spark, path).collect()}
    assert got == {n: pytest.approx(v, abs=1e-5) for n, v in zip(inner, want, strict=True)}


def test_paths_and_communities_of_whole_networks(spark, folder):
    from strandline.queries.graphs import _flags

    path, trades = folder
    assert {(r.system, r.src, r.dst): r.weight for r in _flags(spark, path).collect()} == {k: pytest.approx(w) for k, w in trades.items()}
    got = queries.QUERIES["flow_paths"](spark, path).collect()
    used = defaultdict(float)
    for r in got:
        for a, b in itertools.pairwise(r.nodes):
            used[r.system, *sorted((a, b))] += r.flow
    assert {r.nodes[0] for r in got} & {9, 15, 21} and all(w <= trades[k] + 1e-5 for k, w in used.items())
    assert {(r.system, r.node) for r in queries.QUERIES["walktrap"](spark, path).collect()} == {(k[0], n) for k in trades for n in k[1:]}


def test_shortest_paths_of_the_whole_network(spark, folder):
    path, trades = folder
    e = network_of(trades)
    out = {a: sum(w for (x, _), w in e.items() if x == a) for a in NATIONS}
    length = {k: max(0.0, -math.log(w / out[k[0]] + 1e-10)) for k, w in e.items()}
    got = defaultdict(list)
    for r in queries.QUERIES["kshort_network"](spark, path).orderBy("seed", "rank").collect():
        got[r.seed].append((r.target, r.length))
    for s in NATIONS:
        found = []
        for k in range(1, len(NATIONS)):
            for p in itertools.permutations([n for n in NATIONS if n > s], k):
                if all(x in length for x in itertools.pairwise((s, *p))):
                    found.append((sum(length[x] for x in itertools.pairwise((s, *p))), p[-1]))
        assert [x[1] for x in got[s]] == pytest.approx([d for d, _ in sorted(found)[:5]], abs=1e-4)


def test_all_pairs_of_150_paths_a_group(spark):
    from strandline.queries import sequences

    got = {k: queries.QUERIES[k](spark, "/root/testdata/sf0.001") for k in ("nw_distance", "sw_distance", "sw_columns", "cluster_upgma")}
    assert sequences.TOP == 150
    for k in ("nw_distance", "sw_distance"):
        assert {r.g: r["count"] for r in got[k].groupBy("g").count().collect()} == dict.fromkeys(range(3), 150 * 149 // 2)
    close = {(r.g, r.i, r.j) for r in got["sw_distance"].where("distance < 1").collect()}
    assert {(r.g, r.i, r.j) for r in got["sw_columns"].select("g", "i", "j").distinct().collect()} >= close and max(x[2] for x in close) > 100
    assert {r.g: r["count"] for r in got["cluster_upgma"].groupBy("g").count().collect()} == dict.fromkeys(range(3), 150)


def test_mixtures_are_aggregates(spark):
    from strandline.operators import stats

    rng = np.random.default_rng(8)
    groups = {"two": np.r_[rng.normal(0, 1, 301), rng.normal(6, 2, 200)], "ties": np.round(np.r_[rng.normal(0, 1, 150), rng.normal(9, 1, 100)]), "one": rng.normal(3, 1, 200), "few": rng.normal(0, 1, 5), "flat": np.full(20, 2.0), None: rng.normal(0, 1, 40)}
    df = spark.createDataFrame([(k, float(v)) for k, x in groups.items() for v in x], "g string, v double")
    got = stats.mixtures(df, "g", "v")
    assert "Pandas" not in got._jdf.queryExecution().toString()
    got = {r.g: r for r in got.collect()}
    assert set(got) == set(groups)
    for k, x in groups.items():
        want, r = stats.choose(x), got[k]
        assert (r.n, r.low, r.high, r.components) == (len(x), x.min(), x.max(), want["components"])
        for c in ("weights", "means", "sds"):
            assert r[c] == pytest.approx(want[c], abs=1e-6)
    assert {k: got[k].components for k in groups} == {"two": 2, "ties": 2, "one": 1, "few": 1, "flat": 1, None: got[None].components}
