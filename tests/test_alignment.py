"""Batches of alignments against tables that are filled a cell at a time."""

import numpy as np
import pytest

from strandline.operators import seqalign

NODES = [f"n{k}" for k in range(9)]


def known(seed):
    r = np.random.default_rng(seed)
    return {(a, b): float(r.uniform(0, 20)) for a in NODES for b in NODES if a != b and r.random() < 0.6}


def distance(a, b, d):
    return 0.0 if a == b else d.get((a, b), d.get((b, a)))


def step(a, b, d):
    x = distance(a, b, d)
    return -2.0 if x is None else 2.0 if x < 5 else 1.0 if x < 10 else -1.0 if x < 15 else -2.0


def decay(a, b, d):
    x = distance(a, b, d)
    return 0.0 if x is None else float(np.exp(-x / 8.0))


def local(a, b, d, first=4.0, more=1.0):
    n, m = len(a), len(b)
    h, up, left = np.zeros((n + 1, m + 1)), np.full((n + 1, m + 1), -np.inf), np.full((n + 1, m + 1), -np.inf)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            up[i, j] = max(h[i - 1, j] - first, up[i - 1, j] - more)
            left[i, j] = max(h[i, j - 1] - first, left[i, j - 1] - more)
            h[i, j] = max(0.0, h[i - 1, j - 1] + step(a[i - 1], b[j - 1], d), up[i, j], left[i, j])
    if h.max() <= 0:
        return 0.0, []
    i, j = np.unravel_index(h.argmax(), h.shape)
    out, state = [], "h"
    while i > 0 and j > 0 and (state != "h" or h[i, j] > 0):
        if state == "h" and h[i, j] == h[i - 1, j - 1] + step(a[i - 1], b[j - 1], d):
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif state == "h":
            state = "up" if h[i, j] == up[i, j] else "left"
        elif state == "up":
            out.append((a[i - 1], "-"))
            state = "h" if up[i, j] == h[i - 1, j] - first else "up"
            i -= 1
        else:
            out.append(("-", b[j - 1]))
            state = "h" if left[i, j] == h[i, j - 1] - first else "left"
            j -= 1
    return h.max(), out[::-1]


def whole(a, b, d, gap=0.5):
    n, m = len(a), len(b)
    h = np.zeros((n + 1, m + 1))
    h[:, 0], h[0, :] = -gap * np.arange(n + 1), -gap * np.arange(m + 1)
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            h[i, j] = max(h[i - 1, j - 1] + decay(a[i - 1], b[j - 1], d), h[i - 1, j] - gap, h[i, j - 1] - gap)
    out, i, j = [], n, m
    while i or j:
        if i and j and np.isclose(h[i, j], h[i - 1, j - 1] + decay(a[i - 1], b[j - 1], d)):
            out.append((a[i - 1], b[j - 1]))
            i, j = i - 1, j - 1
        elif i and (not j or np.isclose(h[i, j], h[i - 1, j] - gap)):
            out.append((a[i - 1], "-"))
            i -= 1
        else:
            out.append(("-", b[j - 1]))
            j -= 1
    return h[n, m], out[::-1]


def made(seed):
    r = np.random.default_rng(seed)
    path = lambda: [str(x) for x in r.choice([*NODES, "unknown"], r.integers(0, 14))]
    return [(k, path(), path()) for k in range(120)] + [(120, [], []), (121, ["n1"], []), (122, ["n1"] * 40, ["n1"] * 3), (123, None, ["n1"])]


@pytest.mark.parametrize("seed,cells", [(1, 1 << 21), (2, 900)])
def test_batches_are_the_cellwise_ones(spark, seed, cells):
    rows, d = made(seed), known(seed)
    pairs = spark.createDataFrame(rows, "k int, a array<string>, b array<string>").repartition(3)
    for kind, table in (("local", local), ("global", whole)):
        got = {x.k: x.distance for x in seqalign.distances(pairs, kind, d, cells=cells).collect()}
        columns = {}
        for x in seqalign.aligned_columns(pairs, kind, d, cells=cells).orderBy("k", "pos").collect():
            columns.setdefault(x.k, []).append((x.left, x.right))
        for k, a, b in rows:
            a, b = a or [], b or []
            score, want = table(a, b, d)
            assert columns.get(k, []) == want
            if kind == "local":
                size = np.sqrt(table(a, a, d)[0] * table(b, b, d)[0])
                assert got[k] == pytest.approx(1.0 if size == 0 else 1 - min(1.0, score / size))
            elif a and b:
                assert got[k] == pytest.approx(min(1.0, max(0.0, 1 - max(0.0, score) / max(len(a), len(b)))))
            else:
                assert got[k] == float(bool(a) != bool(b))


def test_one_pair_is_a_batch_of_one():
    a, b, d = ["n1", "n2", "n3", "n4"], ["n1", "n3", "n4"], {}
    columns = lambda found: [(x or "-", y or "-") for x, y in found]
    assert columns(seqalign.local_align(a, b, seqalign._steps(a, b, d))[1]) == local(a, b, d)[1]
    assert columns(seqalign.global_align(a, b, seqalign._similarity(a, b, d, 8.0))[1]) == whole(a, b, d)[1]
