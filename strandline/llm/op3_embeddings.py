"""Embedding near-dedup with an inverted multi-index over two halves of the vectors."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, least_ids
from .op7_minhash import stars
from .shared import cut

THRESHOLD = 0.9
#: Vectors that codebooks are trained on at most, and that recall is measured with, the first by a hash.
TRAIN_ROWS = 20_000
#: Probes are added step by step until so many have neighbours to learn from.
PROBE_ROWS = (400, 1600, 6400)
INFORMED_PROBES = 100
TARGET_RECALL = 0.995
LEAST_VISITS = 8
#: Where recall needs more cells than these, or isn't known, all cells that can hold a link are visited.
MOST_VISITS = 1024
#: Members, or queries, of a cell that one group compares at a time.
BLOCK = 2048


def unit_rows(raw: list[bytes]) -> np.ndarray:
    x = np.stack([np.frombuffer(r, "<f8") for r in raw]) if raw else np.zeros((0, 2))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from distinct rows spread over the sample; an empty cell keeps its centre."""
    c = np.unique(x, axis=0)
    c = c[np.linspace(0, len(c) - 1, min(k, len(c))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, c).argmin(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        n = np.bincount(near, minlength=len(c))
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances of rows to centres."""
    return np.maximum((x**2).sum(axis=1)[:, None] - 2 * x @ c.T + (c**2).sum(axis=1)[None], 0)


def multi_sequence(d1: np.ndarray, d2: np.ndarray, visits: int) -> list[int]:
    """The first ``visits`` cells of the product grid in the order of the sum of both halves' distances.

    A cell is offered once both cells before it, along either half, have been taken.
    """
    o1, o2 = np.argsort(d1, kind="stable"), np.argsort(d2, kind="stable")
    s1, s2 = d1[o1].tolist(), d2[o2].tolist()
    heap, out, taken = [(s1[0] + s2[0], 0, 0)], [], set()
    while heap and len(out) < visits:
        _, i, j = heapq.heappop(heap)
        out.append(int(o1[i]) * len(s2) + int(o2[j]))
        taken.add((i, j))
        if i + 1 < len(s1) and (j == 0 or (i + 1, j - 1) in taken):
            heapq.heappush(heap, (s1[i + 1] + s2[j], i + 1, j))
        if j + 1 < len(s2) and (i == 0 or (i - 1, j + 1) in taken):
            heapq.heappush(heap, (s1[i] + s2[j + 1], i, j + 1))
    return out


def vectors(rows: DataFrame, id_column: str, vector: str) -> DataFrame:
    """``(id, key, dim, vec)`` of vectors that can link: all components finite, not all zero; others have a null ``vec``.

    ``vec`` is scaled by its largest component, so no norm over- or underflows; vectors that are then
    equal have one ``key``. One of a single component gets a second one, zero, and keeps its ``dim``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, dims, raws = [], [], []
            for v in b.column(1):
                raw = None
                if v.is_valid and v.values.null_count == 0 and len(v.values):
                    x = np.asarray(v.values).astype("<f8")
                    most = np.abs(x).max()
                    if np.isfinite(most) and most > 0:
                        x = x / most + 0.0  # no negative zeros
                        raw = (x if len(x) > 1 else np.append(x, 0.0)).tobytes()
                raws.append(raw)
                dims.append(len(v.values) if raw else None)
                keys.append(xxhash.xxh3_128_digest(raw) if raw else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(dims, pa.int32()), pa.array(raws, pa.binary())], names=["id", "key", "dim", "vec"])

    return rows.select(F.col(id_column).cast("long").alias("id"), F.col(vector)).mapInArrow(run, "id long, key binary, dim int, vec binary")


class MultiIndex:
    """Two codebooks and what traversal needs of them."""

    def __init__(self, c1: np.ndarray, c2: np.ndarray):
        self.c1, self.c2, self.half = c1, c2, c1.shape[1]

    def distances(self, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return nearest(unit[:, : self.half], self.c1), nearest(unit[:, self.half :], self.c2)

    def cells(self, unit: np.ndarray) -> np.ndarray:
        d1, d2 = self.distances(unit)
        return d1.argmin(axis=1) * len(self.c2) + d2.argmin(axis=1)

    def visits(self, unit: np.ndarray, number: int) -> np.ndarray:
        d1, d2 = self.distances(unit)
        number = min(number, len(self.c1) * len(self.c2))
        return np.array([multi_sequence(a, b, number) for a, b in zip(d1, d2, strict=True)], np.int32).reshape(len(unit), number)

    def within(self, unit: np.ndarray, radii: tuple[np.ndarray, np.ndarray], reach: float) -> Iterator[np.ndarray]:
        """All cells that can hold a vector within the squared distance ``reach``, by the triangle inequality in both halves."""
        d1, d2 = (np.maximum(np.sqrt(d) - r[None], 0) ** 2 for d, r in zip(self.distances(unit), radii, strict=True))
        for a, b in zip(d1, d2, strict=True):
            yield np.flatnonzero(a[:, None] + b[None] <= reach + 1e-6).astype(np.int32)


def train_index(classes: DataFrame, rows: int, dim: int) -> MultiIndex:
    """Codebooks of a bounded sample, fitted in one task; their size grows with the fourth root of 16ths of the rows, squared."""
    dim = max(dim, 2)
    codes = int(2 ** np.clip(round(np.log2(max(rows, 1) / 16) / 2), 2, 10))
    half = dim // 2

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        unit = unit_rows([bytes(v) for f in frames for v in f["vec"]])
        yield pd.DataFrame({"c1": [k_means(unit[:, :half], codes).tobytes()], "c2": [k_means(unit[:, half:], codes).tobytes()]})

    sample = classes.select("key", "vec").orderBy(F.xxhash64("key"), "key").limit(TRAIN_ROWS)
    got = sample.repartition(1).sortWithinPartitions("key").mapInPandas(learn, "c1 binary, c2 binary").first()
    return MultiIndex(np.frombuffer(got["c1"]).reshape(-1, half), np.frombuffer(got["c2"]).reshape(-1, dim - half))


def needed_visits(seen: list[tuple[int, int, int]], target: float) -> int:
    """Cells to visit by ``(probe, rank of the cell, links)``, so that probes reach the target on average.

    Recall is a mean over probes, and it has to be reached by probes of each order of magnitude of
    links (powers of 2) by themselves: a large group has neither more weight nor more say than small ones.
    """
    probe, rank, n = (np.array(x) for x in zip(*seen, strict=True))
    links = np.bincount(probe, weights=n)
    order = np.argsort(rank, kind="stable")
    most = 0
    for size in np.unique(np.log2(links[links > 0]).astype(int)):
        own = (links > 0) & (np.log2(np.maximum(links, 1)).astype(int) == size)
        at = order[own[probe[order]]]
        recall = np.cumsum(n[at] / links[probe[at]]) / own.sum()
        most = max(most, int(rank[at][np.searchsorted(recall, target - 1e-9)]) + 1)
    return most


def visits_for(classes: DataFrame, index: MultiIndex, threshold: float, target: float, rows: int) -> int | None:
    """Cells that queries visit: twice as many as give the target recall to probes compared with all rows.

    None where that can't be said as too few of the most probes have neighbours, or where it takes too many cells.
    """
    cells, seen, done = len(index.c1) * len(index.c2), [], 0
    for upto in PROBE_ROWS:
        probes = classes.orderBy(F.xxhash64("key", F.lit(1)), "key").limit(upto).select("key", "vec").collect()[done:]
        unit = unit_rows([bytes(r["vec"]) for r in probes])
        if not len(unit):
            break
        shared = classes.sparkSession.sparkContext.broadcast((unit, index, {bytes(r["key"]): k for k, r in enumerate(probes)}))

        def run(frames: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            q, ix, names = shared.value
            for f in frames:
                own = unit_rows([bytes(v) for v in f["vec"]])
                cos = q @ own.T
                for j, key in enumerate(f["key"]):
                    if (i := names.get(bytes(key))) is not None:
                        cos[i, j] = -1.0  # the probe itself
                i, j = np.nonzero(cos >= threshold)
                at, n = np.unique(i.astype(np.int64) * cells + ix.cells(own)[j], return_counts=True)
                yield pd.DataFrame({"at": at, "n": n})

        found = classes.select("key", "vec").mapInPandas(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
        d1, d2 = index.distances(unit)
        for r in found:
            i, cell = divmod(r["at"], cells)
            total = d1[i, cell // len(index.c2)] + d2[i, cell % len(index.c2)]
            # the last place among cells of equal sums
            rank = int(np.searchsorted(np.sort(d2[i]), total + 1e-12 - d1[i], "right").sum()) - 1
            seen.append((done + i, rank, r["n"]))
        done += len(unit)
        if len({x[0] for x in seen}) >= INFORMED_PROBES or done >= rows:
            break
    if done < rows and len({x[0] for x in seen}) < INFORMED_PROBES:
        return None
    number = max(LEAST_VISITS, 2 * needed_visits(seen, target)) if seen else LEAST_VISITS
    return number if number <= min(MOST_VISITS, cells) else cells if cells <= MOST_VISITS else None


def cell_radii(classes: DataFrame, index: MultiIndex) -> tuple[np.ndarray, np.ndarray]:
    """The largest distance of a member to each code of both halves."""
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for half, d in enumerate(shared.value.distances(unit_rows([bytes(v) for v in f["vec"]]))):
                yield pd.DataFrame({"half": half, "code": d.argmin(axis=1), "r": np.sqrt(d.min(axis=1))}).groupby(["half", "code"], as_index=False).max()

    out = (np.full(len(index.c1), -np.inf), np.full(len(index.c2), -np.inf))
    for r in classes.select("vec").mapInPandas(run, "half int, code int, r double").groupBy("half", "code").agg(F.max("r").alias("r")).collect():
        out[r["half"]][r["code"]] = r["r"]
    return out


def place(classes: DataFrame, threshold: float, target: float, rows: int, dim: int) -> DataFrame:
    """``(dim, node, m, vec, cell, visited)`` of the vectors of one length."""
    index = train_index(classes, rows, dim)
    number = visits_for(classes, index, threshold, target, rows)
    radii = cell_radii(classes, index) if number is None else None
    shared = classes.sparkSession.sparkContext.broadcast(index)

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            unit = unit_rows([v.as_py() for v in b.column(3)])
            visited = shared.value.visits(unit, number) if radii is None else shared.value.within(unit, radii, 2 - 2 * threshold)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shared.value.cells(unit), pa.int32()), pa.array(list(visited), pa.list_(pa.int32()))], names=["dim", "node", "m", "vec", "cell", "visited"])

    return classes.select("dim", "node", "m", "vec").mapInArrow(locate, "dim int, node long, m long, vec binary, cell int, visited array<int>")


def near_vectors(rows: DataFrame, threshold: float = THRESHOLD, target: float = TARGET_RECALL, id_column: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row a vector: ``id_column, n_links, component_id, kept``.

    Equal vectors are one class with a count. Independent codebooks on both halves of the unit
    vectors form a grid; each class stands in its own cell and visits the nearest cells by
    multi-sequence traversal, as many as give the target recall to probes compared with all rows,
    and what it meets there is verified by cosine in double precision. Where probes can't say how many
    that are, it visits all cells that can hold a link. Each length of vectors has its own index,
    few vectors one of few codes. A pair that only one of both finds counts for both.
    Cells are compared in blocks of bounded size; blocks give counts and stars that join what their
    links join, never all pairs.

    Vectors that are null, zero, empty, or hold null or non-finite components link with nothing;
    those of different lengths don't link. A row with a null id links with nothing, has a null
    component and is kept. Each row is a node of its own, also where rows share an id; a component
    is named by the smallest id of its rows. An empty table gives an empty result; columns that
    aren't named aren't read.
    """
    own = cut(vectors(rows, id_column, vector))
    classes = own.where("vec is not null and id is not null").groupBy("dim", "key").agg(F.min("id").alias("id"), F.count("*").alias("m"), F.min("vec").alias("vec"))
    classes = cut(classes.withColumn("node", F.monotonically_increasing_id()))
    placed = classes.select("dim", "node", "m", "vec", F.lit(0).alias("cell"), F.array(F.lit(0)).alias("visited")).limit(0)
    for r in classes.groupBy("dim").agg(F.count("*").alias("rows")).orderBy("dim").collect():
        placed = placed.unionByName(place(classes.where(F.col("dim") == r["dim"]), threshold, target, r["rows"], r["dim"]))
    placed = cut(placed)
    # at most one row a cell of the grid, whose size is bounded by the codebooks'
    asked = placed.select("dim", F.explode("visited").alias("cell")).groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("q_blocks"))
    sizes = cut(placed.groupBy("dim", "cell").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("m_blocks")).join(asked, ["dim", "cell"]))
    turn = lambda n, seed: F.pmod(F.xxhash64("node", F.lit(seed)), F.col(n)).cast("int")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    members = placed.join(sizes, ["dim", "cell"]).withColumn("mb", turn("m_blocks", 1)).withColumn("qb", upto("q_blocks"))
    members = members.select("dim", "cell", "mb", "qb", F.lit(True).alias("member"), "node", "m", "vec", F.col("cell").alias("home"), "visited")
    queries = placed.select("dim", "node", "m", "vec", F.col("cell").alias("home"), F.explode("visited").alias("cell")).join(sizes, ["dim", "cell"]).withColumn("qb", turn("q_blocks", 2)).withColumn("mb", upto("m_blocks"))
    queries = queries.select("dim", "cell", "mb", "qb", F.lit(False).alias("member"), "node", "m", "vec", "home", F.lit(None).cast("array<int>").alias("visited"))
    groups = members.unionByName(queries).withColumn("part", F.xxhash64("cell", "mb", "qb"))

    def verify(pdf: pd.DataFrame) -> pd.DataFrame:
        is_member = pdf["member"].to_numpy()
        a, b = pdf[~is_member], pdf[is_member]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": [], "b": [], "n": []}, dtype="int64")
        qa, mb = a["node"].to_numpy(), b["node"].to_numpy()
        x, y = unit_rows([bytes(v) for v in a["vec"]]), unit_rows([bytes(v) for v in b["vec"]])
        ma, mm = a["m"].to_numpy(), b["m"].to_numpy()
        hit = x @ y.T >= threshold
        count_q = hit @ mm
        # members whose own traversal doesn't come to the query's cell get the link from here
        home = a["home"].to_numpy()
        lists = b["visited"].to_numpy()
        visited = np.full((len(b), max(map(len, lists))), -1, np.int32)
        for k, cells_ in enumerate(lists):
            visited[k, : len(cells_)] = cells_
        count_m = np.zeros(len(b), np.int64)
        for c in np.unique(home[hit.any(axis=1)]):
            rows_ = home == c
            unseen = ~(visited == c).any(axis=1)
            if unseen.any():
                count_m[unseen] += ma[rows_] @ hit[rows_][:, unseen]
        ids = np.concatenate([qa, mb])
        i, j = np.nonzero(hit & (qa[:, None] != mb[None]))
        tree = stars(np.stack([i, j + len(qa)], axis=1), len(ids)) if len(i) else []
        edges = [(int(ids[p]), int(ids[q]), 0) for p, q in tree]
        counts = [(int(k), None, int(n)) for k, n in zip(ids, np.concatenate([count_q, count_m]), strict=True) if n]
        return pd.DataFrame(edges + counts, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = cut(groups.groupBy("dim", "part").applyInPandas(verify, "a long, b long, n long"))
    links = found.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    parts = connected_components(found.where("b is not null").select("a", "b"))
    named = least_ids(classes.select("dim", "key", "node", "id", "m"), parts).join(links, "node", "left").select("dim", "key", (F.coalesce("n", "m") - 1).alias("n"), F.col("component_id").alias("c"))
    out = own.select("id", "dim", "key").join(named, ["dim", "key"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("c", "id"))
    linked = F.when(F.col("id").isNotNull(), F.coalesce("n", F.lit(0))).otherwise(0)
    return out.select(F.col("id").alias(id_column), linked.cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept"))


def op3_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``embeddings`` by cosine 0.9 or more, and the number of links of each vector."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
