"""Paths through flow: decomposition, shortest paths, regrouping, edges, scores."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import number_of, path_score, relative_path
from .network import by_graph


def path_edges(paths: DataFrame, keys: list[str], nodes: str = "nodes", weight: str = "weight") -> DataFrame:
    """Each step of each path, with the path's weight; direction is kept."""
    n = F.col(nodes)
    steps = F.arrays_zip(F.slice(n, F.lit(1), F.greatest(F.size(n) - 1, F.lit(0))).alias("a"), F.slice(n, F.lit(2), F.greatest(F.size(n) - 1, F.lit(0))).alias("b"))
    return paths.select(*keys, weight, F.posexplode(steps).alias("at", "s")).select(*keys, "at", F.col("s.a").alias("src"), F.col("s.b").alias("dst"), weight)


def edge_sums(paths: DataFrame, keys: list[str], nodes: str = "nodes", weight: str = "weight") -> DataFrame:
    return path_edges(paths, keys, nodes, weight).groupBy(*keys, "src", "dst").agg(F.sum(weight).alias("weight"))


def group_paths(paths: DataFrame, keys: list[str], nodes: str = "nodes", flow: str = "flow") -> DataFrame:
    """Paths that are equal once their chains are turned: source chains, flow, the path of most flow, coverage, score."""
    rows = paths.withColumn("relative", relative_path(F.col(nodes)))
    best = F.max_by(nodes, F.struct(F.col(flow), F.col("path_id")))
    g = rows.groupBy(*keys, "relative").agg(
        F.countDistinct(F.substring(F.element_at(nodes, 1), 1, 1)).alias("n_chains"), F.sum(flow).alias("flow_sum"), F.max(flow).alias("flow_max"), best.alias("path"), F.count("*").alias("n_paths"),
    )
    g = g.withColumn("length", F.size("relative")).withColumn("all_four", F.col("n_chains") == 4).withColumn("two_or_more", F.col("n_chains") >= 2)
    return g.withColumn("score", path_score(F.col("flow_sum"), F.col("length")))


def dedup_paths(paths: DataFrame, keys: list[str], nodes: str = "nodes", importance: str = "importance", log_prob: str = "log_prob", seed: str = "seed") -> DataFrame:
    """Equal turned paths once: number, summed importance, mean log probability, chains and seeds, and the first path."""
    rows = paths.withColumn("relative", relative_path(F.col(nodes)))
    return rows.groupBy(*keys, "relative").agg(
        F.count("*").alias("n_duplicates"), F.sum(importance).alias("importance"), F.avg(log_prob).alias("log_prob"),
        F.array_sort(F.collect_set(F.substring(F.element_at(nodes, 1), 1, 1))).alias("chain_origins"), F.array_sort(F.collect_set(seed)).alias("seeds"), F.min_by(nodes, "path_id").alias("path"),
    )


def walk_sums(paths: DataFrame, edges: DataFrame, keys: list[str], value: str, floor: float | None = None, nodes: str = "nodes", on: list[str] | None = None) -> DataFrame:
    """For each path the sum of its steps' values, or of the logs of values no less than ``floor``; a step without an edge adds 0."""
    steps = path_edges(paths.withColumn("_w", F.lit(1)), keys, nodes, "_w")
    on = on or []
    got = steps.join(edges.select(*on, "src", "dst", value), [*on, "src", "dst"], "left")
    each = F.col(value) if floor is None else F.log(F.greatest(F.col(value), F.lit(floor)))
    return got.groupBy(*keys).agg(F.coalesce(F.sum(each), F.lit(0.0)).alias("total"))


def edge_accumulation(paths: DataFrame, importance: DataFrame, keys: list[str], nodes: str = "nodes") -> DataFrame:
    """Steps weighed by importance times copies, or by copies where that is 0; mirrored and halved."""
    steps = path_edges(paths, keys, nodes, "n_duplicates").join(importance.select("src", "dst", "e"), ["src", "dst"], "left")
    w = F.when(F.col("e") > 0, F.col("e") * F.col("n_duplicates")).otherwise(F.col("n_duplicates").cast("double"))
    rows = steps.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), w.alias("w"))
    both = rows.unionByName(rows.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    return both.groupBy(*keys, "i", "j").agg((F.sum("w") / 2).alias("value"))


def keep_long(paths: DataFrame, least: int, nodes: str = "nodes") -> DataFrame:
    return paths.where(F.size(nodes) >= least)


def best_of(paths: DataFrame, keys: list[str], score: str, tie: str, k: int = 1) -> DataFrame:
    """The k rows of each key with the highest score, ties by ``tie``; a null key is a key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return paths.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def shortest(graph: dict, source: int, targets: set, banned_nodes: frozenset = frozenset(), banned_edges: frozenset = frozenset()) -> tuple[float, list] | None:
    """Least-length path to any of ``targets``, ties to the lexicographically least; lengths aren't negative."""
    heap, seen = [(0.0, [source])], set()
    while heap:
        d, path = heapq.heappop(heap)
        x = path[-1]
        if x in seen:
            continue
        seen.add(x)
        if x in targets:
            return d, path
        for y, w in graph.get(x, {}).items():
            if y not in seen and y not in banned_nodes and (x, y) not in banned_edges:
                heapq.heappush(heap, (d + w, [*path, y]))
    return None


def k_shortest(graph: dict, source: int, target: int, k: int) -> list[tuple[float, list]]:
    """Yen's k shortest simple paths."""
    first = shortest(graph, source, {target})
    if first is None:
        return []
    done, waiting = [first], []
    while len(done) < k:
        prior = done[-1][1]
        for i in range(len(prior) - 1):
            root = prior[: i + 1]
            banned = frozenset((p[i], p[i + 1]) for _, p in done if p[: i + 1] == root and len(p) > i + 1)
            tail = shortest(graph, root[-1], {target}, frozenset(root[:-1]), banned)
            if tail:
                path = root[:-1] + tail[1]
                total = sum(graph[a][b] for a, b in zip(path, path[1:], strict=False))
                if (total, path) not in waiting:
                    heapq.heappush(waiting, (total, path))
        if not waiting:
            break
        done.append(heapq.heappop(waiting))
    return done


def best_paths(edges: DataFrame, seeds: DataFrame, targets: list[int], k: int = 5, keys: list[str] | None = None, per_task: int = 8) -> DataFrame:
    """``(keys, seed, rank, target, length, nodes)``: of up to k paths to each target the k shortest of each seed, ties by target and rank.

    ``seeds`` is ``(keys, node)``, or ``(node)`` for all keys. A key's seeds are dealt to tasks of about ``per_task``, each of which builds the graph once.
    """
    keys, kinds = keys or [], dict(edges.dtypes)
    own = [c for c in keys if c not in seeds.columns]
    asked = seeds.withColumnRenamed("node", "seed")
    asked = asked.join(edges.select(*keys).distinct(), [c for c in keys if c not in own]) if own and len(own) < len(keys) else asked.crossJoin(edges.select(*keys).distinct()) if own else asked

    def solve(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        adjacent: dict[int, dict[int, float]] = {}
        for a, b, d in sorted(zip(g["src"].tolist(), g["dst"].tolist(), g["length"].tolist(), strict=True)):
            adjacent.setdefault(a, {})[b] = d
        out = [(s, t, at, d, p) for s in q["seed"].tolist() for t in targets if s != t for at, (d, p) in enumerate(k_shortest(adjacent, s, t, k))]
        frame = pd.DataFrame(out, columns=["seed", "target", "at", "length", "nodes"])
        for c in keys:
            frame[c] = q[c].iloc[0] if len(q) else None
        return frame[[*keys, "seed", "target", "at", "length", "nodes"]]

    node = dict(seeds.dtypes)["node"]
    schema = "".join(f"{c} {kinds[c]}, " for c in keys) + f"seed {node}, target int, at int, length double, nodes array<int>"
    found = by_graph(edges.select(*keys, "src", "dst", "length"), asked.select(*keys, "seed"), keys, ["seed"], per_task, solve, schema)
    w = Window.partitionBy(*keys, "seed").orderBy("length", "target", "at")
    return found.withColumn("rank", F.row_number().over(w) - 1).where(F.col("rank") < k).drop("at")


def decompose(edges: DataFrame, keys: list[str], sources: list | None, targets: list | Callable[..., bool], least_flow: float = 1e-6, max_paths: int = 500, least_length: int = 8, top_sources: int = 600, targets_of: tuple[str, dict[str, list[int]]] | None = None) -> DataFrame:
    """``(keys, path_id, flow, nodes)``: flow taken apart into paths from sources to targets, one graph a group.

    In turn: the target with most flow left at its edges; shortest paths from it by 1 / flow to the
    sources, which are those of the ``top_sources`` nodes with most flow left that have more than
    ``least_flow`` and aren't targets; of those paths of ``least_length`` nodes the one with the widest
    narrowest edge, whose narrowest flow is taken off. Where there is none wider than ``least_flow``,
    the target's edges lose ``least_flow`` each and the turn counts, though not for the nodes' flow.
    Ties go to the smaller node. It stops when no target has ``least_flow`` left, no source is left, or
    after ``max_paths`` turns. With ``targets_of``, a key and the targets of each of its values, a group
    goes to those of its value; all of ``targets`` are still no sources. ``targets`` may be a test of a
    node, and without ``sources`` all others are sources.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left: dict[int, dict[int, float]] = {}
        for a, b, f in zip(pdf["src"].tolist(), pdf["dst"].tolist(), pdf["weight"].tolist(), strict=True):
            left.setdefault(a, {})[b] = f
            left.setdefault(b, {})[a] = f
        through = {x: sum(n.values()) for x, n in left.items()}
        all_ends = {x for x in left if (targets(x) if callable(targets) else x in targets)}
        wanted = targets_of[1][pdf[targets_of[0]].iloc[0]] if targets_of else all_ends
        ends, starts = {t for t in wanted if t in left}, set(left if sources is None else sources)
        out = []
        for _ in range(max_paths):
            open_ = [(-sum(left[t].values()), t) for t in ends]
            if not open_ or -min(open_)[0] < least_flow:
                break
            t = min(open_)[1]
            top = sorted(through, key=lambda x: (-through[x], x))[:top_sources]
            eligible = sorted(x for x in top if through[x] > least_flow and x in starts and x not in all_ends)
            if not eligible:
                break
            dist, back, heap = {t: 0.0}, {}, [(0.0, t)]
            while heap:
                d, x = heapq.heappop(heap)
                if d > dist[x]:
                    continue
                for y, f in left[x].items():
                    if f > least_flow and d + 1 / f < dist.get(y, float("inf")) - 1e-15:
                        dist[y], back[y] = d + 1 / f, x
                        heapq.heappush(heap, (d + 1 / f, y))
            best = None
            for s in eligible:
                if s not in dist:
                    continue
                path = [s]
                while path[-1] != t:
                    path.append(back[path[-1]])
                if len(path) >= least_length:
                    width = min(left[a][b] for a, b in zip(path, path[1:], strict=False))
                    if best is None or width > best[0]:
                        best = (width, path)
            if best is None or best[0] <= least_flow:
                for y in left[t]:
                    left[t][y] = left[y][t] = max(0.0, left[t][y] - least_flow)
                continue
            width, path = best
            for a, b in zip(path, path[1:], strict=False):
                rest = max(0.0, left[a][b] - width)
                for x in (a, b):
                    through[x] -= left[a][b] - rest
                left[a][b] = left[b][a] = rest
            out.append((len(out) + 1, width, path))
        frame = pd.DataFrame(out, columns=["path_id", "flow", "nodes"])
        for k in keys:
            frame[k] = pdf[k].iloc[0]
        return frame[[*keys, "path_id", "flow", "nodes"]]

    kinds = dict(edges.dtypes)
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + f"path_id int, flow double, nodes array<{kinds['src']}>"
    return edges.groupBy(*keys).applyInPandas(run, schema)


def truncate_at(paths: DataFrame, numbers: list[int], nodes: str = "nodes") -> DataFrame:
    from ..functions.labels import cut_at_first

    return paths.withColumn(nodes, cut_at_first(F.col(nodes), numbers))


__all__ = ["best_of", "best_paths", "decompose", "dedup_paths", "edge_accumulation", "edge_sums", "group_paths", "k_shortest", "keep_long", "number_of", "path_edges", "shortest", "truncate_at", "walk_sums"]
