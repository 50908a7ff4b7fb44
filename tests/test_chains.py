"""The fundamental matrix in blocks against a dense inverse: acyclic, cyclic, never absorbed, each size of block."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import markov
from strandline.session import cut as keep


def chains(seed):
    r = random.Random(seed)
    rows = []
    for key, nodes, up in (("acyclic", 13, True), ("cyclic", 11, False), ("far", 6, False)):
        for i in range(nodes):
            to = [j for j in range(nodes) if (j > i if up else j != i) and r.random() < 0.6] or ([i + 1] if up and i + 1 < nodes else [0 if i else 1])
            if i == nodes - 1 and up:
                continue
            if key == "far" and i != 3 and 3 not in to:
                to.append(3)  # where it is absorbed
            w = [r.random() for _ in to]
            far = 1000 if key == "far" else 0
            rows += [(key, i + far, j + far, x / sum(w) * (1 if up or key == "far" else 0.99)) for j, x in zip(to, w, strict=True)]
    return rows + [("loop", 1, 2, 1.0), ("loop", 2, 1, 1.0), ("loop", 3, 1, 1.0)]


def dense(rows, gone, eps):
    names = sorted({i for i, j, _ in rows if i not in gone} | {j for i, j, _ in rows if i not in gone and j not in gone})
    q = np.zeros((len(names), len(names)))
    for i, j, t in rows:
        if i in names and j in names:
            q[names.index(i), names.index(j)] += t
    n = np.linalg.inv(np.eye(len(names)) * (1 + eps) - q)
    return {(a, b): n[x, y] for x, a in enumerate(names) for y, b in enumerate(names) if abs(n[x, y]) > 1e-12}


@pytest.mark.parametrize("size", [4, 256])
def test_blocks_are_the_inverse(spark, size):
    rows, gone = chains(size), {12, 1003}
    t = spark.createDataFrame(rows, "g string, i int, j int, t double").repartition(3)
    absorbing = spark.createDataFrame([(x,) for x in gone], "node int")
    got = {(r.g, r.i, r.j): r.n for r in markov.fundamental_blocks(t, ["g"], absorbing, keep, size=size, eps=0.01).collect()}
    want = {}
    for g in {r[0] for r in rows}:
        want |= {(g, *k): v for k, v in dense([r[1:] for r in rows if r[0] == g], gone, 0.01 if g == "loop" else 0.0).items()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)


def test_one_chain_without_a_key(spark):
    rows = [r[1:] for r in chains(3) if r[0] == "acyclic"]
    t = spark.createDataFrame(rows, "i int, j int, t double")
    nodes = spark.createDataFrame([(k,) for k in range(20)], "node int")
    gone = spark.createDataFrame([(12,)], "node int")
    got = {(r.i, r.j): r.n for r in markov.fundamental_blocks(t, [], gone, keep, nodes, size=4).collect()}
    by_series = {(r.i, r.j): r.n for r in markov.fundamental_series(t, [], gone, nodes, keep).collect()}
    assert got == pytest.approx(by_series) and got[19, 19] == 1.0


def test_product_of_blocks(spark):
    r = np.random.default_rng(1)
    a, b = r.random((7, 9)), r.random((9, 8))
    a[:4, :3] = 0
    rows = lambda m: spark.createDataFrame([(int(i), int(j), float(v)) for (i, j), v in np.ndenumerate(m) if v], "i long, j long, v double")
    got = markov.from_blocks(markov.multiply(markov.to_blocks(rows(a), [], 3), markov.to_blocks(rows(b), [], 3), [], 3), [], "long", 3).collect()
    out = np.zeros((7, 8))
    for x in got:
        out[x.i, x.j] = x.v
    assert np.allclose(out, a @ b)
    assert markov.to_blocks(rows(a), [], 3).where(F.col("bi") == 0).count() == 2  # the block of zeros isn't there


def test_empty_chain(spark):
    t = spark.createDataFrame([], "g string, i int, j int, t double")
    assert markov.fundamental_blocks(t, ["g"], spark.createDataFrame([(1,)], "node int"), keep).count() == 0
