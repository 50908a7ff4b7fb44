"""Weighted graphs: thresholds, incident sums, exports, maximum flow and its accumulation."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def threshold_network(c: DataFrame, near: DataFrame | None, levels: list[float], keys: list[str], value: str = "value") -> DataFrame:
    """Edges of each level: pairs i < j with an absolute value at or above it, in contact if ``near`` is given."""
    edges = c.where("i < j").withColumn("weight", F.abs(F.col(value)))
    if near is not None:
        edges = edges.join(near.select(*keys, "i", "j"), [*keys, "i", "j"], "left_semi")
    return edges.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]))).where("weight >= level").select("level", *keys, F.col("i").alias("src"), F.col("j").alias("dst"), "weight")


def incident_sum(edges: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """Sum of the weights at each node."""
    ends = edges.select(*keys, F.explode(F.array("src", "dst")).alias("node"), weight)
    return ends.groupBy(*keys, "node").agg(F.sum(weight).alias("flow"))


def export_undirected(edges: DataFrame, weight: str = "weight", least: float = 1e-6) -> DataFrame:
    """``Source, Target, type, weight, weight_abs`` of edges above ``least``; weight over the largest of all."""
    kept = edges.where(F.col(weight) > least)
    top = F.col("_top")
    kept = kept.crossJoin(F.broadcast(kept.agg(F.max(weight).alias("_top"))))  # one row
    return kept.select(F.col("src").alias("Source"), F.col("dst").alias("Target"), F.lit("undirected").alias("type"), (F.col(weight) / top).alias("weight"), F.col(weight).alias("weight_abs"))


def export_directed(flows: DataFrame, keys: list[str], least: float = 1e-6) -> DataFrame:
    """A row of ``fwd`` and a swapped row of ``rev`` for each edge, over the largest of each key."""
    there = flows.select(*keys, F.col("src").alias("Source"), F.col("dst").alias("Target"), F.col("fwd").alias("weight_abs"))
    back = flows.select(*keys, F.col("dst").alias("Source"), F.col("src").alias("Target"), F.col("rev").alias("weight_abs"))
    rows = there.unionByName(back).where(F.col("weight_abs") > least)
    return rows.select(*keys, "Source", "Target", F.lit("directed").alias("type"), (F.col("weight_abs") / F.max("weight_abs").over(Window.partitionBy(*keys))).alias("weight"), "weight_abs")


def seed_scores(flows: DataFrame, keys: list[str], target: str) -> DataFrame:
    """For each node and target, the sum of forward flow over edges that start there and the largest share of one edge."""
    return flows.groupBy(*keys, target, F.col("src").alias("node")).agg(F.sum("fwd").alias("seed_score"), F.when(F.sum("fwd") > 0, F.max("fwd") / F.sum("fwd")).otherwise(F.lit(0.0)).alias("max_t"))


def both_targets(scores: DataFrame, keys: list[str], first: str, second: str) -> DataFrame:
    """``scores`` and, where a node has a positive score for both targets, a row ``both`` with their mean; its other columns are the first's."""
    a = scores.where((F.col("target") == first) & (F.col("seed_score") > 0))
    b = scores.where((F.col("target") == second) & (F.col("seed_score") > 0)).select(*keys, "node", F.col("seed_score").alias("_other"))
    joined = a.join(b, [*keys, "node"]).withColumn("seed_score", (F.col("seed_score") + F.col("_other")) / 2).withColumn("target", F.lit("both")).drop("_other")
    return scores.unionByName(joined)


def equivalents(scores: DataFrame, system: str, share: float = 0.10) -> DataFrame:
    """For each row, how many other systems have the same node and target at ``share`` of its score or more; see ``equivalent_counts`` for each system."""
    o = scores.select(F.col(system).alias("_s"), F.col("target").alias("_t"), F.col("node").alias("_n"), F.col("seed_score").alias("_o"))
    hit = (F.col("_t") == F.col("target")) & (F.col("_n") == F.col("node")) & (F.col("_s") != F.col(system)) & (F.col("_o") >= F.lit(share) * F.col("seed_score"))
    return scores.join(o, hit, "left").groupBy(system, "target", "node").agg(F.max("seed_score").alias("seed_score"), F.count("_o").alias("n_equivalent"))


def equivalent_counts(scores: DataFrame, keys: list[str], systems: list[str], number: str, share: float = 0.10, both: tuple[str, ...] = ()) -> DataFrame:
    """``scores`` with a column ``equiv_<system>`` for each of ``systems``: its rows of the same residue number and target at ``share`` of the score or more.

    ``keys`` tell rows of ``scores`` apart (``system, target`` and a node). Any chain's node of that
    number counts, the row's own system too. Rows of target ``both`` also count for each target that
    ``both`` names, beside that target's own rows, so such a node counts twice.
    """
    looked = scores.select(F.col("system").alias("_s"), F.col("target").alias("_t"), F.col(number).alias("_n"), F.col("seed_score").alias("_o"))
    for target in both:
        looked = looked.unionByName(looked.where("_t = 'both'").withColumn("_t", F.lit(target)))
    near = scores.join(looked, (F.col("_t") == F.col("target")) & (F.col("_n") == F.col(number)), "left")
    hit = F.col("_o") >= F.lit(share) * F.col("seed_score")
    counts = [F.count(F.when((F.col("_s") == name) & hit, 1)).alias(f"equiv_{name}") for name in systems]
    return near.groupBy(*keys, number).agg(F.first("seed_score").alias("seed_score"), *counts)


class FlowNet:
    """Maximum flow by shortest augmenting paths in layers; undirected edges are arcs of equal capacity both ways."""

    def __init__(self, edges: list[tuple[int, int, float]]):
        self.at: dict[int, list[int]] = {}
        self.to: list[int] = []
        self.left: list[float] = []
        for a, b, c in edges:
            for x, y in ((a, b), (b, a)):
                self.at.setdefault(x, []).append(len(self.to))
                self.to.append(y)
                self.left.append(c)
        self.full = list(self.left)

    def _layers(self, s: int) -> dict[int, int]:
        depth, todo = {s: 0}, deque([s])
        while todo:
            x = todo.popleft()
            for e in self.at.get(x, ()):
                if self.left[e] > 1e-12 and self.to[e] not in depth:
                    depth[self.to[e]] = depth[x] + 1
                    todo.append(self.to[e])
        return depth

    def run(self, s: int, t: int) -> tuple[float, list[float], set[int]]:
        """Value, signed flow of each edge, and the nodes on the source's side of a least cut."""
        self.left = list(self.full)
        value = 0.0
        while t in (depth := self._layers(s)):
            turn = dict.fromkeys(depth, 0)
            path: list[int] = []
            x = s
            while True:
                if x == t:
                    step = min(self.left[e] for e in path)
                    value += step
                    for e in path:
                        self.left[e] -= step
                        self.left[e ^ 1] += step
                    path, x = [], s
                    continue
                arcs = self.at.get(x, [])
                while turn[x] < len(arcs):
                    e = arcs[turn[x]]
                    if self.left[e] > 1e-12 and depth.get(self.to[e]) == depth[x] + 1:
                        break
                    turn[x] += 1
                if turn[x] < len(arcs):
                    path.append(arcs[turn[x]])
                    x = self.to[arcs[turn[x]]]
                elif x == s:
                    break
                else:
                    e = path.pop()
                    x = self.to[e ^ 1]
                    turn[x] += 1
        return value, [(self.full[e] - self.left[e]) for e in range(0, len(self.to), 2)], set(depth)


def by_graph(edges: DataFrame, asked: DataFrame, keys: list[str], order: list[str], per_task: int, solve: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``solve(a graph's edges, rows that ask of it)`` for each key: its rows are dealt by a hash of ``order`` to tasks, of about ``per_task`` rows of the largest key, each of which gets the graph once."""
    graph, rows = (df.select(*[(F.col(c)).alias(f"_{n}") for n, c in enumerate(df.columns)]).toDF(*df.columns) for df in (edges, asked))  # new columns, should one come of the other
    most = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] if keys else rows.count()
    chunks = max(1, -(-(most or 0) // per_task))
    rows = rows.withColumn("_chunk", F.pmod(F.xxhash64(*order), F.lit(chunks)).cast("int"))
    graph = graph.withColumn("_chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))

    def run(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        return solve(g, q.sort_values(order))

    return graph.groupBy(*keys, "_chunk").cogroup(rows.groupBy(*keys, "_chunk")).applyInPandas(run, schema)


#: Pairs whose flows one task solves, on average.
PER_TASK = 64


def _each_flow(edges: DataFrame, pairs: DataFrame, keys: list[str], per_task: int, out: str, give: Callable[[list, Iterator], pd.DataFrame]) -> DataFrame:
    """``give(edges as (src, dst, weight), the flows of a task's pairs as (source, target, value, flows, side))`` with the keys before it."""
    kinds = dict(edges.dtypes)

    def solve(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["src", "dst", "weight"])
        ends = list(zip(g["src"].tolist(), g["dst"].tolist(), g["weight"].tolist(), strict=True))
        net = FlowNet(ends)
        frame = give(ends, ((s, t, *net.run(s, t)) for s, t in zip(q["source"].tolist(), q["target"].tolist(), strict=True)))
        for n, k in enumerate(keys):
            frame.insert(n, k, (q if len(q) else g)[k].iloc[0])
        return frame

    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + out
    return by_graph(edges.select(*keys, "src", "dst", "weight"), pairs.select(*keys, "source", "target"), keys, ["source", "target"], per_task, solve, schema)


def max_flows(edges: DataFrame, pairs: DataFrame, keys: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``(keys, source, target, value, edges)`` with the signed flow of each edge and whether its ends are on the source's side of a cut.

    For a look at some pairs: rows hold all edges. ``flow_sums`` and ``flow_checks`` take all pairs, and
    ``flow_tree`` gives the values alone. Which edges carry the flow isn't unique; the value is, and the cut proves it.
    """
    node = dict(pairs.dtypes)["source"]

    def give(ends: list, found: Iterator) -> pd.DataFrame:
        done = [(s, t, value, [{"src": a, "dst": b, "flow": f, "src_side": a in side, "dst_side": b in side} for (a, b, _), f in zip(ends, flows, strict=True)]) for s, t, value, flows, side in found]
        return pd.DataFrame(done, columns=["source", "target", "value", "edges"])

    return _each_flow(edges, pairs, keys, per_task, f"source {node}, target {node}, value double, edges array<struct<src:int,dst:int,flow:double,src_side:boolean,dst_side:boolean>>", give)


def flow_checks(edges: DataFrame, pairs: DataFrame, keys: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``(keys, source, target, value, cut, over, loss)``: each pair's flow, the capacity of a cut, the most by which an edge or a node between misses its law."""
    node = dict(pairs.dtypes)["source"]

    def give(ends: list, found: Iterator) -> pd.DataFrame:
        capacity = np.array([w for _, _, w in ends])
        names, place = np.unique([x for a, b, _ in ends for x in (a, b)], return_inverse=True)
        place = place.reshape(-1, 2)
        out = []
        for s, t, value, flows, side in found:
            f = np.array(flows)
            inside = np.isin(names, list(side))[place]
            net = np.bincount(place[:, 0], f, len(names)) - np.bincount(place[:, 1], f, len(names))
            loss = np.abs(net[(names != s) & (names != t)]).max(initial=0.0)
            out.append((s, t, value, capacity[inside[:, 0] != inside[:, 1]].sum(), (np.abs(f) - capacity).max(initial=0.0), loss))
        return pd.DataFrame(out, columns=["source", "target", "value", "cut", "over", "loss"])

    return _each_flow(edges, pairs, keys, per_task, f"source {node}, target {node}, value double, cut double, over double, loss double", give)


def flow_sums(edges: DataFrame, pairs: DataFrame, keys: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``(keys, src, dst, fwd, rev, total)``: forward, reverse and absolute flow of each edge over all pairs.

    A task adds its pairs' flows itself and gives a row an edge, so rows are edges times tasks and not times pairs.
    """
    kinds = dict(edges.dtypes)

    def give(ends: list, found: Iterator) -> pd.DataFrame:
        fwd, rev = np.zeros(len(ends)), np.zeros(len(ends))
        for _, _, _, flows, _ in found:
            f = np.array(flows)
            fwd += np.maximum(f, 0)
            rev += np.maximum(-f, 0)
        return pd.DataFrame({"src": [a for a, _, _ in ends], "dst": [b for _, b, _ in ends], "fwd": fwd, "rev": rev})

    parts = _each_flow(edges, pairs, keys, per_task, f"src {kinds['src']}, dst {kinds['dst']}, fwd double, rev double", give)
    return parts.groupBy(*keys, "src", "dst").agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"), (F.sum("fwd") + F.sum("rev")).alias("total"))


#: Cuts that are made at once of the nodes that hang on one node of the tree.
AT_ONCE = 256


def flow_tree(edges: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame], at_once: int = AT_ONCE, per_task: int = PER_TASK) -> DataFrame:
    """``(keys, node, parent, capacity)``: the equivalent-flow tree, in which the least capacity on the way between two nodes is their maximum flow.

    One cut a node but the first, instead of a flow a pair. All nodes hang on that with most weight at first; a node's
    least cut from what it hangs on takes over those that hang there too and lie on its side. Cuts of a
    round are made beside each other in tasks and settled in order, and a node that was taken over in the
    meantime is cut again in the next round; dense graphs, whose least cuts are single nodes, take one or two rounds.
    Nodes that no flow reaches have capacity 0.
    """
    kind = dict(edges.dtypes)["src"]
    node = keep(incident_sum(edges, keys))
    first = F.max_by("node", F.struct("flow", -F.col("node"))).cast(kind)
    if keys:
        state = node.join(node.groupBy(*keys).agg(first.alias("parent")), keys)
    else:
        state = node.withColumn("parent", F.lit(node.agg(first).first()[0]).cast(kind))
    state = state.where("node <> parent").drop("flow")
    state = keep(state.withColumn("capacity", F.lit(None).cast("double")))
    head = "".join(f"{k} {dict(edges.dtypes)[k]}, " for k in keys)

    def give(ends: list, found: Iterator) -> pd.DataFrame:
        return pd.DataFrame([(s, t, value, sorted(side)) for s, t, value, _, side in found], columns=["source", "target", "value", "side"])

    def settle(rows: pd.DataFrame, cuts: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", ignore_index=True)
        names, parent = rows["node"].to_numpy(), rows["parent"].to_numpy().copy()
        place = {x: k for k, x in enumerate(names.tolist())}
        capacity = np.full(len(rows), np.nan)
        for s, t, value, side in cuts.sort_values("source")[["source", "target", "value", "side"]].itertuples(index=False):
            at = place[s]
            if parent[at] != t:
                continue  # an earlier cut of this round took it over
            capacity[at] = value
            parent[np.isin(names, side) & (parent == t) & np.isnan(capacity)] = s
        return rows.assign(parent=parent, capacity=pd.Series([None if np.isnan(c) else c for c in capacity], dtype=object))

    order = Window.partitionBy(*keys, "parent").orderBy("node")
    while True:
        open_ = state.where("capacity is null")
        if open_.isEmpty():
            return state
        picked = open_.withColumn("_turn", F.row_number().over(order)).where(F.col("_turn") <= at_once)
        cuts = _each_flow(edges, picked.select(*keys, F.col("node").alias("source"), F.col("parent").alias("target")), keys, per_task, f"source {kind}, target {kind}, value double, side array<{kind}>", give)
        hung = [*keys, "parent"]
        rows = open_.groupBy(*hung).cogroup(cuts.withColumn("parent", F.col("target")).groupBy(*hung))
        state = keep(state.where("capacity is not null").unionByName(rows.applyInPandas(settle, f"{head}node {kind}, parent {kind}, capacity double")))


def tree_values(tree: DataFrame, keys: list[str], per_task: int = PER_TASK) -> DataFrame:
    """``(keys, source, target, value)`` of all ordered pairs: the least capacity on the way between them in the tree."""
    kind = dict(tree.dtypes)["node"]
    sources = tree.select(*keys, F.explode(F.array("node", "parent")).alias("source")).distinct()

    def solve(g: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        beside: dict[int, list[tuple[int, float]]] = {}
        for a, b, c in zip(g["node"].tolist(), g["parent"].tolist(), g["capacity"].tolist(), strict=True):
            beside.setdefault(a, []).append((b, c))
            beside.setdefault(b, []).append((a, c))
        out = []
        for s in q["source"].tolist():
            todo, seen = [(s, float("inf"))], {s}
            while todo:
                x, least = todo.pop()
                for y, c in beside[x]:
                    if y not in seen:
                        seen.add(y)
                        todo.append((y, min(least, c)))
                        out.append((s, y, min(least, c)))
        frame = pd.DataFrame(out, columns=["source", "target", "value"])
        for n, k in enumerate(keys):
            frame.insert(n, k, (q if len(q) else g)[k].iloc[0])
        return frame

    schema = "".join(f"{k} {dict(tree.dtypes)[k]}, " for k in keys) + f"source {kind}, target {kind}, value double"
    return by_graph(tree.select(*keys, "node", "parent", "capacity"), sources, keys, ["source"], per_task, solve, schema)


def with_totals(flows: DataFrame, family: str, target: str) -> DataFrame:
    """Edge sums by family and target, by family, and over all, rolled up; a total has null keys. See ``by_level`` for targets over families."""
    return flows.rollup("src", "dst", family, target).agg(F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev")).where("dst is not null")


def by_level(flows: DataFrame, family: str, target: str) -> DataFrame:
    """Edge sums by family and target, by family, by target over families, and over all; ``level`` tells totals from null keys."""
    sets = [["src", "dst", family, target], ["src", "dst", family], ["src", "dst", target], ["src", "dst"]]
    level = F.element_at(F.array(*[F.lit(x) for x in ("family_target", "family", "target", "total")]), (F.grouping(F.col(family)) * 2 + F.grouping(F.col(target)) + 1).cast("int"))
    return flows.groupingSets([[F.col(c) for c in s] for s in sets], "src", "dst", family, target).agg(level.alias("level"), F.sum("fwd").alias("fwd"), F.sum("rev").alias("rev"))
