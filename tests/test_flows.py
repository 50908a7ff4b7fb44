"""Flows of all pairs: the tree against every cut of small graphs, sums against single flows, groups of each size."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import network
from strandline.session import cut as keep


def graphs(seed):
    """Edges ``(g, src, dst, weight)``: dense, sparse, a path with a cycle, two parts without a way between them, parallel edges."""
    r = random.Random(seed)
    rows = [("dense", a, b, float(r.randint(1, 9))) for a in range(9) for b in range(a + 1, 9)]
    rows += [("sparse", a, b, float(r.randint(1, 9))) for a in range(10) for b in range(a + 1, 10) if r.random() < 0.3 or b == a + 1]
    rows += [("path", a, a + 1, float(r.randint(1, 9))) for a in range(7)] + [("path", 2, 6, 1.0)]
    rows += [("parts", 0, 1, 2.0), ("parts", 1, 2, 3.0), ("parts", 5, 6, 4.0), ("double", 3, 4, 1.0), ("double", 3, 4, 2.0)]
    return rows


def least_cuts(rows):
    out = {}
    for g in {x[0] for x in rows}:
        edges = [x[1:] for x in rows if x[0] == g]
        nodes = sorted({n for a, b, _ in edges for n in (a, b)})
        for size in range(1, len(nodes)):
            for side in map(set, itertools.combinations(nodes, size)):
                value = sum(w for a, b, w in edges if (a in side) != (b in side))
                for s in side:
                    for t in set(nodes) - side:
                        out[g, s, t] = min(value, out.get((g, s, t), value))
    return out


@pytest.mark.parametrize("at_once,per_task", [(1, 64), (3, 2), (256, 64)])
def test_tree_has_the_least_cut_of_each_pair(spark, at_once, per_task):
    rows = graphs(at_once)
    edges = keep(spark.createDataFrame(rows, "g string, src int, dst int, weight double").repartition(3))
    tree = network.flow_tree(edges, ["g"], keep, at_once, per_task)
    got = {(x.g, x.source, x.target): x.value for x in network.tree_values(tree, ["g"], per_task).collect()}
    assert got == pytest.approx(least_cuts(rows))


def test_sums_are_those_of_single_flows(spark):
    rows = graphs(5)
    edges = keep(spark.createDataFrame(rows, "g string, src int, dst int, weight double"))
    nodes = edges.select("g", F.explode(F.array("src", "dst")).alias("n")).distinct()
    pairs = nodes.select("g", F.col("n").alias("source")).join(nodes.select("g", F.col("n").alias("target")), "g").where("source < target")
    each = network.max_flows(edges, pairs, ["g"], 5).select("g", F.explode("edges").alias("e")).groupBy("g", "e.src", "e.dst")
    want = {(x.g, x.src, x.dst): (x.f, x.r) for x in each.agg(F.sum(F.greatest("e.flow", F.lit(0.0))).alias("f"), F.sum(F.greatest(-F.col("e.flow"), F.lit(0.0))).alias("r")).collect() if x.g != "double"}
    for per_task in (1, 100):
        got = {(x.g, x.src, x.dst): (x.fwd, x.rev) for x in network.flow_sums(edges, pairs, ["g"], per_task).collect() if x.g != "double"}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    values = least_cuts(rows)
    for x in network.flow_checks(edges, pairs, ["g"]).collect():
        assert x.value == pytest.approx(values[x.g, x.source, x.target]) and x.cut == pytest.approx(x.value) and x.over < 1e-9 and x.loss < 1e-9


def test_rows_of_the_kernel_are_edges_times_tasks(spark):
    edges = spark.createDataFrame([(a, b, 1.0) for a in range(12) for b in range(a + 1, 12)], "src int, dst int, weight double")
    pairs = spark.createDataFrame([(a, b) for a in range(12) for b in range(12) if a != b], "source int, target int")
    plan = network.flow_sums(edges, pairs, [], per_task=33)
    assert plan.count() == 66 and plan.agg(F.sum("total")).first()[0] > 0
    assert "edges array" not in plan._jdf.queryExecution().toString()


def test_no_edges(spark):
    edges = keep(spark.createDataFrame([], "g string, src int, dst int, weight double"))
    assert network.flow_tree(edges, ["g"], keep).count() == 0
