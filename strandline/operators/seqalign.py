"""Alignment of paths: local with affine gaps, global with linear gaps, distances, consensus."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType


#: Cells of all tables of pairs that are filled together.
CELLS = 1 << 21
STOP, MATCH, UP, LEFT = 0, 1, 2, 3
UP_OPENS, LEFT_OPENS = 4, 8


class Known:
    """Distances between nodes as arrays, from which the score matrix of any nodes is made; ``(a, b)`` goes before ``(b, a)``."""

    def __init__(self, known: dict):
        names = sorted({x for pair in known for x in pair})
        self.code = {x: k for k, x in enumerate(names)}
        self.a, self.b = (np.array([self.code[pair[side]] for pair in known], np.int64) for side in (0, 1))
        self.d = np.array(list(known.values()), float)

    def matrix(self, nodes: list) -> np.ndarray:
        """Distances between ``nodes``, 0 to themselves and nan where unknown."""
        place = np.full(len(self.code) + 1, -1)
        for k, x in enumerate(nodes):
            if x in self.code:
                place[self.code[x]] = k
        out = np.full((len(nodes), len(nodes)), np.nan)
        a, b = place[self.a], place[self.b]
        both = (a >= 0) & (b >= 0)
        out[b[both], a[both]] = self.d[both]
        out[a[both], b[both]] = self.d[both]
        np.fill_diagonal(out, 0.0)
        return out


def step_scores(d: np.ndarray) -> np.ndarray:
    """Step scores by distance; equal nodes have the best, unknown pairs the worst."""
    return np.select([d < 5, d < 10, d < 15], [2.0, 1.0, -1.0], -2.0)


def decay_scores(d: np.ndarray, sigma: float) -> np.ndarray:
    """Scores that fall with distance; equal nodes have 1, unknown pairs 0."""
    return np.where(np.isnan(d), 0.0, np.exp(-d / sigma))


class Batch:
    """Pairs of coded sequences, padded to one length, whose tables are filled an anti-diagonal at a time.

    An anti-diagonal is an array of a row a pair and a column for each place in ``a``: cell ``(i, d - i)`` is in
    column i. Padding has a code of its own, which scores so low that no alignment takes it.
    """

    def __init__(self, a: list[np.ndarray], b: list[np.ndarray], score: np.ndarray):
        self.na, self.nb = np.array([len(x) for x in a]), np.array([len(x) for x in b])
        self.n, self.m = int(self.na.max(initial=0)), int(self.nb.max(initial=0))
        rows, columns = score.shape
        self.score = np.full((rows + 1, columns + 1), -1e9)
        self.score[:rows, :columns] = score
        self.a = self._padded(a, self.n, rows) * (columns + 1)
        self.b = self._padded(b, self.m, columns)

    @staticmethod
    def _padded(x: list[np.ndarray], width: int, code: int) -> np.ndarray:
        out = np.full((len(x), width), code, np.int64)
        for k, own in enumerate(x):
            out[k, : len(own)] = own
        return out

    def diagonals(self) -> Iterator[tuple[int, int, int, np.ndarray]]:
        """``(d, low, high, scores)``: the places low <= i < high of each anti-diagonal inside the table, and their scores."""
        flat = self.score.ravel()
        for d in range(2, self.n + self.m + 1):
            low, high = max(1, d - self.m), min(self.n, d - 1) + 1
            yield d, low, high, flat[self.a[:, low - 1 : high - 1] + self.b[:, d - high : d - low][:, ::-1]]

    def local(self, first: float = 4.0, more: float = 1.0, trace: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Best local scores with affine gaps, and the columns as places in a and b, -1 for a gap.

        Going back prefers a match, then a gap in b, then one in a; of equal ends the first in a, then in b, counts.
        """
        p, wide = len(self.na), self.n + 1
        h1, h2 = np.zeros((p, wide)), np.zeros((p, wide))  # the anti-diagonals before
        up, left = np.full((p, wide), -np.inf), np.full((p, wide), -np.inf)
        best, at_i, at_d = np.zeros(p), np.zeros(p, np.int64), np.zeros(p, np.int64)
        codes: dict[int, np.ndarray] = {}
        every = np.arange(p)
        for d, low, high, score in self.diagonals():
            here, there = slice(low, high), slice(low - 1, high - 1)
            up_open, left_open = h1[:, there] - first, h1[:, here] - first
            new_up, new_left = np.full((p, wide), -np.inf), np.full((p, wide), -np.inf)
            new_up[:, here] = np.maximum(up_open, up[:, there] - more)
            new_left[:, here] = np.maximum(left_open, left[:, here] - more)
            match = h2[:, there] + score
            h = np.zeros((p, wide))
            h[:, here] = np.maximum(np.maximum(np.maximum(match, new_up[:, here]), new_left[:, here]), 0.0)
            if trace:
                own = h[:, here]
                code = np.zeros((p, wide), np.uint8)
                code[:, here] = np.where(own <= 0, STOP, np.where(own == match, MATCH, np.where(own == new_up[:, here], UP, LEFT))) + UP_OPENS * (new_up[:, here] == up_open) + LEFT_OPENS * (new_left[:, here] == left_open)
                codes[d] = code
            i = h.argmax(axis=1)
            top = h[every, i]
            better = (top > best) | (top == best) & (top > 0) & (i < at_i)
            best, at_i, at_d = np.where(better, top, best), np.where(better, i, at_i), np.where(better, d, at_d)
            h1, h2, up, left = h, h1, new_up, new_left
        return best, self._back(codes, at_i, at_d - at_i, local=True) if trace else []

    def whole(self, gap: float = 0.5, trace: bool = False) -> tuple[np.ndarray, list[list[tuple[int, int]]]]:
        """Global scores with linear gaps, and the columns; going back prefers a match, then a gap in b."""
        p, wide = len(self.na), self.n + 1
        edge = -gap * np.arange(max(self.n, self.m) + 1)
        h2 = np.zeros((p, wide))
        h1 = np.zeros((p, wide))
        h1[:, : min(2, wide)] = edge[min(1, len(edge) - 1)]
        total = np.where(self.na == 0, edge[self.nb], np.where(self.nb == 0, edge[self.na], 0.0))
        codes: dict[int, np.ndarray] = {}
        every, ends = np.arange(p), self.na + self.nb
        for d, low, high, score in self.diagonals():
            here, there = slice(low, high), slice(low - 1, high - 1)
            match, up = h2[:, there] + score, h1[:, there] - gap
            h = np.zeros((p, wide))
            h[:, here] = np.maximum(np.maximum(match, up), h1[:, here] - gap)
            if d <= self.m:
                h[:, 0] = edge[d]
            if d <= self.n:
                h[:, d] = edge[d]
            if trace:
                code = np.zeros((p, wide), np.uint8)
                code[:, here] = np.where(np.isclose(h[:, here], match), MATCH, np.where(np.isclose(h[:, here], up), UP, LEFT))
                codes[d] = code
            done = (ends == d) & (self.na > 0) & (self.nb > 0)
            total[done] = h[every[done], self.na[done]]
            h1, h2 = h, h1
        return total, self._back(codes, self.na, self.nb, local=False) if trace else []

    def _back(self, codes: dict[int, np.ndarray], i: np.ndarray, j: np.ndarray, local: bool) -> list[list[tuple[int, int]]]:
        """The columns of all pairs, a step of each at a time, from the directions that were stored."""
        p = len(i)
        i, j, state = i.copy(), j.copy(), np.full(p, MATCH)
        table = np.stack([codes.get(d, np.zeros((p, self.n + 1), np.uint8)) for d in range(self.n + self.m + 1)])
        every = np.arange(p)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while True:
            inside = (i > 0) & (j > 0)
            code = np.where(inside, table[np.where(inside, i + j, 0), every, np.where(inside, i, 0)], 0)
            move = code & 3
            if local:
                on = inside & ((state != MATCH) | (move != STOP))
                move = np.where(on, np.where(state == MATCH, move, state), STOP)
            else:
                on = (i > 0) | (j > 0)
                move = np.where(inside, move, np.where(i > 0, UP, LEFT)) * on
            if not on.any():
                break
            steps.append((np.where((move == MATCH) | (move == UP), i - 1, -1) - 2 * (move == STOP), np.where((move == MATCH) | (move == LEFT), j - 1, -1)))
            if local:
                state = np.where(move == UP, np.where(code & UP_OPENS, MATCH, UP), np.where(move == LEFT, np.where(code & LEFT_OPENS, MATCH, LEFT), MATCH))
            i, j = i - ((move == MATCH) | (move == UP)), j - ((move == MATCH) | (move == LEFT))
        if not steps:
            return [[] for _ in range(p)]
        a, b = (np.stack([s[k] for s in steps]) for k in (0, 1))
        return [[(int(x), int(y)) for x, y in zip(a[::-1, k], b[::-1, k], strict=True) if x > -2] for k in range(p)]


def _steps(a: list, b: list, known: dict) -> np.ndarray:
    """Step scores between two sequences."""
    return _between(a, b, known, step_scores)


def _similarity(a: list, b: list, known: dict, sigma: float) -> np.ndarray:
    """Decay scores between two sequences."""
    return _between(a, b, known, lambda d: decay_scores(d, sigma))


def _between(a: list, b: list, known: dict, scores: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    names = list(dict.fromkeys([*a, *b]))
    place = {x: k for k, x in enumerate(names)}
    return scores(Known(known).matrix(names))[np.ix_([place[x] for x in a], [place[x] for x in b])] if a and b else np.zeros((len(a), len(b)))


def _one(a: list, b: list, score: np.ndarray) -> Batch:
    return Batch([np.arange(len(a))], [np.arange(len(b))], score)


def _named(a: list, b: list, columns: list[tuple[int, int]]) -> list:
    return [(a[x] if x >= 0 else None, b[y] if y >= 0 else None) for x, y in columns]


def local_align(a: list, b: list, score: np.ndarray, first: float = 4.0, more: float = 1.0) -> tuple[float, list]:
    """Best local score of one pair and its columns ``(a or None, b or None)``; a gap costs ``first``, then ``more`` a place."""
    best, columns = _one(a, b, score).local(first, more, trace=True)
    return float(best[0]), _named(a, b, columns[0])


def global_align(a: list, b: list, score: np.ndarray, gap: float = 0.5) -> tuple[float, list]:
    """Global score and columns of one pair with linear gaps."""
    total, columns = _one(a, b, score).whole(gap, trace=True)
    return float(total[0]), _named(a, b, columns[0])


def global_distance(a: list, b: list, score: np.ndarray, gap: float = 0.5) -> float:
    return float(_global_distances(np.array([len(a)]), np.array([len(b)]), _one(a, b, score).whole(gap)[0])[0])


def _global_distances(na: np.ndarray, nb: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 less the score over the longer length; 0 for two empty sequences and 1 for one."""
    longer = np.maximum(na, nb)
    d = np.clip(1 - np.maximum(0.0, total) / np.maximum(longer, 1), 0.0, 1.0)
    return np.where((na > 0) & (nb > 0), d, np.where(longer > 0, 1.0, 0.0))


def _local_distances(na: np.ndarray, nb: np.ndarray, best: np.ndarray) -> np.ndarray:
    """1 less the score over the root of both self scores, which are 2 a node; 1 where one is empty."""
    size = np.sqrt(2.0 * na * 2.0 * nb)
    return np.where(size > 0, 1 - np.minimum(1.0, best / np.where(size > 0, size, 1.0)), 1.0)


def _batches(a: pa.Array, b: pa.Array, known: Known, kind: str, sigma: float, cells: int) -> Iterator[tuple[np.ndarray, Batch, list]]:
    """``(rows, batch, names)`` of pairs of about one size, whose tables have about ``cells`` cells together."""
    flat = [x.flatten() for x in (a, b)]
    coded = pc.dictionary_encode(pa.chunked_array(flat)).combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    names = coded.dictionary.to_pylist()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    score = known.matrix(names)
    score = decay_scores(score, sigma) if kind == "global" else step_scores(score)
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False).astype(np.int64) for x in (a, b)]
    starts = [np.append(0, np.cumsum(s)) for s in sizes]
    starts[1] += len(flat[0])
    order = np.lexsort((sizes[1], sizes[0]))
    at = 0
    while at < len(order):
        upto, n, m = at, 0, 0
        while upto < len(order):
            n, m = max(n, sizes[0][order[upto]]), max(m, sizes[1][order[upto]])
            if upto > at and (upto + 1 - at) * (n + 1) * (n + m + 1) > cells:
                break
            upto += 1
        rows = order[at:upto]
        yield rows, Batch(*([codes[s[k] : s[k + 1]] for k in rows] for s in starts), score), names
        at = upto


def all_pairs(paths: DataFrame, keys: list[str], order: str, nodes: str = "nodes") -> DataFrame:
    """Pairs of paths of a group with i < j: for the top paths of a group, whose number is a parameter."""
    a = paths.select(*keys, F.col(order).alias("i"), F.col(nodes).alias("a"))
    b = paths.select(*keys, F.col(order).alias("j"), F.col(nodes).alias("b"))
    return a.join(b, keys).where("i < j")


def distances(pairs: DataFrame, kind: str, known: dict | None = None, sigma: float = 8.0, cells: int = CELLS) -> DataFrame:
    """``pairs`` with ``distance``: ``local`` is 1 less the score over the root of both self scores, ``global`` by length.

    Pairs are aligned many at a time. ``known`` has distances between nodes, as many as a structure has; it is
    broadcast. A null path is an empty one.
    """
    shared = pairs.sparkSession.sparkContext.broadcast(Known(known or {}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            out = np.zeros(t.num_rows)
            for rows, batch, _ in _batches(t.column("a"), t.column("b"), shared.value, kind, sigma, cells):
                out[rows] = _global_distances(batch.na, batch.nb, batch.whole()[0]) if kind == "global" else _local_distances(batch.na, batch.nb, batch.local()[0])
            yield pa.RecordBatch.from_arrays([*t.columns, pa.array(out)], names=[*t.schema.names, "distance"])

    return pairs.mapInArrow(run, StructType([*pairs.schema.fields, StructField("distance", DoubleType())]))


def aligned_columns(pairs: DataFrame, kind: str = "local", known: dict | None = None, sigma: float = 8.0, cells: int = CELLS) -> DataFrame:
    """One row a column of each pair's alignment: ``pos, left, right``, ``-`` for a gap."""
    shared = pairs.sparkSession.sparkContext.broadcast(Known(known or {}))
    own = [f for f in pairs.schema.fields if f.name not in ("a", "b")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            for rows, batch, names in _batches(t.column("a"), t.column("b"), shared.value, kind, sigma, cells):
                columns = (batch.whole(trace=True) if kind == "global" else batch.local(trace=True))[1]
                many = np.array([len(c) for c in columns])
                of = np.repeat(np.arange(len(columns)), many)
                flat = np.array([c for x in columns for c in x], np.int64).reshape(-1, 2)
                pos = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
                words = pa.array([*names, "-"], pa.string())
                sides = [np.where(flat[:, k] >= 0, coded[of, np.maximum(flat[:, k], 0)], len(names)) for k, coded in ((0, batch.a // batch.score.shape[1]), (1, batch.b))] if len(of) else [of, of]
                part = t.take(pa.array(rows[of]))
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in own), pa.array(pos, pa.int32()), *(words.take(pa.array(x)) for x in sides)], names=[*(f.name for f in own), "pos", "left", "right"])

    return pairs.mapInArrow(run, StructType([*own, StructField("pos", IntegerType()), StructField("left", StringType()), StructField("right", StringType())]))


def consensus(members: DataFrame, medoids: DataFrame, keys: list[str], order: str, nodes: str = "nodes", known: dict | None = None) -> DataFrame:
    """For each group the medoid's columns, each with the commonest node of the members aligned to it; ties go to the first member's, gaps are left out."""
    pairs = members.select(*keys, order, F.col(nodes).alias("b")).join(medoids.select(*keys, F.col(nodes).alias("a")), keys)
    rows = aligned_columns(pairs, "global", known)
    w = Window.partitionBy(*keys, order).orderBy("pos")
    placed = rows.withColumn("column", F.sum((F.col("left") != "-").cast("int")).over(w)).where("left <> '-' and right <> '-'")
    votes = placed.groupBy(*keys, "column", "right").agg(F.count("*").alias("n"), F.min(order).alias("first"))
    best = votes.groupBy(*keys, "column").agg(F.max_by("right", F.struct("n", -F.col("first"))).alias("node"))
    return best.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("column", "node"))), lambda s: s["node"]).alias("consensus"))


def medoids(distance_rows: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, cluster, item, mean_distance)``: of each cluster the item of least mean distance to its others, ties to the smaller item."""
    both = distance_rows.select(*keys, "i", "j", "distance").unionByName(distance_rows.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "distance"))
    a = labels.select(*keys, F.col("item").alias("i"), "cluster")
    b = labels.select(*keys, F.col("item").alias("j"), F.col("cluster").alias("_c"))
    inside = both.join(a, [*keys, "i"]).join(b, [*keys, "j"]).where("cluster = _c").groupBy(*keys, "cluster", "i").agg(F.avg("distance").alias("mean_distance"))
    every = a.join(inside, [*keys, "cluster", "i"], "left").withColumn("mean_distance", F.coalesce("mean_distance", F.lit(0.0)))
    best = every.groupBy(*keys, "cluster").agg(F.min(F.struct("mean_distance", "i")).alias("_b"))
    return best.select(*keys, "cluster", F.col("_b.i").alias("item"), F.col("_b.mean_distance").alias("mean_distance"))


#: Ranges of values that a cluster is dealt into where its medoid is found by prefix sums.
RANGES = 1024


def line_medoids(values: DataFrame, digits: int = 6) -> DataFrame:
    """``(cluster, item, mean_distance)`` as of ``medoids`` for items on a line, by prefix sums instead of pairs.

    ``values`` is ``(cluster, item, value)`` with whole numbers and items that are all different; an item's distance to another is
    the difference of their values. Means are rounded to ``digits`` before they are compared, ties go to the smaller item. An item
    without a value, or without others that have one, has the mean 0. Equal values are one row; a cluster's rows are dealt
    into at most ``RANGES + 1`` ranges by quantiles, so only a row a range meets in one task.
    """
    same = values.groupBy("cluster", "value").agg(F.count("*").alias("n"), F.min("item").alias("item"))
    lone = same.where("value is null").select("cluster", "item", F.lit(0.0).alias("mean_distance"))
    rows = same.where("value is not null")
    cuts = rows.groupBy(F.col("cluster").alias("_c")).agg(F.percentile_approx("value", [k / RANGES for k in range(1, RANGES)], 100 * RANGES).alias("cuts"))
    dealt = rows.join(F.broadcast(cuts), F.col("cluster").eqNullSafe(F.col("_c"))).withColumn("range", F.size(F.filter("cuts", lambda c: c < F.col("value")))).drop("cuts", "_c")
    sums = dealt.groupBy(F.col("cluster").alias("_c"), F.col("range").alias("_r")).agg(F.sum("n").alias("rn"), F.sum(F.col("n") * F.col("value")).alias("rs"))
    over = Window.partitionBy("_c")
    before = over.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("_c", "_r", *[F.coalesce(F.sum(a).over(before), F.lit(0)).alias(b) for a, b in (("rn", "n0"), ("rs", "s0"))], F.sum("rn").over(over).alias("many"), F.sum("rs").over(over).alias("total"))
    joined = dealt.join(F.broadcast(sums), F.col("cluster").eqNullSafe(F.col("_c")) & (F.col("range") == F.col("_r")))
    inside = Window.partitionBy("cluster", "range").orderBy("value")  # up to the value itself, which adds nothing to its own distance
    joined = joined.withColumn("n1", F.col("n0") + F.sum("n").over(inside)).withColumn("s1", F.col("s0") + F.sum(F.col("n") * F.col("value")).over(inside))
    distance = F.col("value") * (2 * F.col("n1") - F.col("many")) + F.col("total") - 2 * F.col("s1")
    mean = F.when(F.col("many") > 1, F.round(distance / (F.col("many") - 1), digits)).otherwise(F.lit(0.0))
    every = joined.select("cluster", "item", mean.alias("mean_distance")).unionByName(lone)
    return every.groupBy("cluster").agg(F.min(F.struct("mean_distance", "item")).alias("_b")).select("cluster", "_b.item", "_b.mean_distance")

