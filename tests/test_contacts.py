"""Contacts by cubes against all pairs: points on borders, repeated ones, ones without a place."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import dynamics

SCHEMA = "system int, frame int, atom int, x double, y double, z double"


def points(seed, n=60):
    r = random.Random(seed)
    rows = [(s, f, k, *(r.uniform(-6, 6) for _ in range(3))) for s in range(2) for f in range(3) for k in range(n)]
    rows += [(0, 0, n + k, float(k - 4), 0.0, -2.0) for k in range(9)]  # exactly a reach apart, on borders of cubes
    rows += [(0, 0, n + 20, 1.5, 1.5, 1.5), (0, 0, n + 21, 1.5, 1.5, 1.5), (0, 1, n + 20, None, 0.0, 0.0), (0, 1, n + 21, math.nan, 0.0, 0.0), (0, 1, n + 22, math.inf, 0.0, 0.0), (0, 1, n + 23, 1e9, 1e9, 1e9)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("within", [0.1, 1.0, 2.0, 50.0])
def test_cubes_find_the_pairs(spark, within):
    f = spark.createDataFrame(points(int(within * 10)), SCHEMA).repartition(4)
    keys = ["system", "frame"]
    want = sorted((*r[:4], round(r.d, 9)) for r in dynamics.pair_distances(f, keys).where(F.col("d") <= within).collect())
    got = sorted((*r[:4], round(r.d, 9)) for r in dynamics.pair_distances(f, keys, within=within).collect())
    assert got == want and len(got) == len(set(got))


def test_pairs_farther_than_neighbours_never_meet(spark):
    f = spark.createDataFrame([(0, 0, k, float(k), 0.0, 0.0) for k in range(400)], SCHEMA)
    a = dynamics.cubes(f.withColumnsRenamed({"x": "ax", "y": "ay", "z": "az"}), ["ax", "ay", "az"], 1.0, dynamics.FORWARD)
    b = dynamics.cubes(f, ["x", "y", "z"], 1.0)
    assert a.join(b, ["system", "frame", "_cx", "_cy", "_cz"]).count() < 3 * 400
    assert len(dynamics.FORWARD) == 14


@pytest.mark.parametrize("within", [0.7, 1.0, 3.0])
def test_reach(spark, within):
    rows = points(7)
    f = spark.createDataFrame(rows, SCHEMA)
    got = {tuple(r)[:3] for r in dynamics.in_reach(f, f.where("atom % 13 = 0"), ["system", "frame"], within).collect()}
    ok = [r for r in rows if all(v is not None and math.isfinite(v) for v in r[3:])]
    want = {a[:3] for a in ok for b in ok if a[:2] == b[:2] and b[2] % 13 == 0 and math.dist(a[3:], b[3:]) <= within}
    assert got == want


def test_shares_and_similarities(spark):
    f = spark.createDataFrame(points(9), SCHEMA)
    all_ = dynamics.pair_distances(f, ["system", "frame"]).where("d <= 1.5").collect()
    got = dynamics.contact_shares(f, ["system"], "frame", 1.5).collect()
    assert {(r.system, r.i, r.j): r.n_frames for r in got} == {k: sum((r.system, r.i, r.j) == k for r in all_) for k in {(r.system, r.i, r.j) for r in all_}}
    assert all(r.share == pytest.approx(r.n_frames / 3) for r in got)
    one = f.where("frame = 0 and system = 0")
    want = {(r.i, r.j): r.similarity for r in dynamics.pair_similarity(one, ["system"]).where("similarity >= 0.8").collect()}
    assert {(r.i, r.j): r.similarity for r in dynamics.pair_similarity(one, ["system"], least=0.8).collect()} == pytest.approx(want)
