"""Studies of pathways: flow modes, replicas, decomposition to clusters, and clusters and fields as structures."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import number_of
from ..operators import build3d, cluster, markov, matrix, paths, seqalign
from ..sources import pdb, tables
from .studies import consolidated_paths

#: Paths of each group that are aligned and clustered.
TOP_PATHS = 150


def flow_modes(flows: DataFrame, keys: list[str], totals: bool = True) -> DataFrame:
    """``(keys, mode, target, src, dst, weight)`` of every mode and target from ``(keys, target, src, dst, total, fwd, rev)``.

    ``undirected`` is the total flow, ``directed_fwd`` and ``directed_rev`` each way's; the target
    ``total`` is the sum over all targets. Edges without flow are left out.
    """
    modes = F.array(*[F.struct(F.lit(m).alias("mode"), F.col(c).alias("weight")) for m, c in (("undirected", "total"), ("directed_fwd", "fwd"), ("directed_rev", "rev"))])
    each = flows.select(*keys, "target", "src", "dst", F.explode(modes).alias("m")).select(*keys, "m.mode", "target", "src", "dst", "m.weight")
    if totals:
        each = each.withColumn("target", F.explode(F.array("target", F.lit("total"))))
    return each.groupBy(*keys, "mode", "target", "src", "dst").agg(F.sum("weight").alias("weight")).where("weight > 0")


def replica_matrices(transitions: DataFrame, visits: DataFrame, keys: list[str], replica: str = "replica") -> DataFrame:
    """Mean, variance and error over replicas of transition and visits, told apart by ``kind``, for each of ``keys`` (system, direction, target)."""
    cells = transitions.select(F.lit("T").alias("kind"), *keys, replica, "i", "j", F.col("t").alias("value")).unionByName(visits.select(F.lit("N").alias("kind"), *keys, replica, "i", "j", F.col("n").alias("value")))
    return matrix.replica_mean(cells, ["kind", *keys])


def scored_rivers(grouped: DataFrame, key: str, known: dict, keep: Callable[[DataFrame], DataFrame], top: int = TOP_PATHS, number: int = 10) -> dict[str, DataFrame]:
    """The top paths of each group, their local alignment distances, tree, clusters by mean distance, and the best path of each cluster.

    ``grouped`` is ``(key, path, score)`` with labels as nodes.
    """
    ranked = keep(paths.best_of(grouped.select(key, F.col("path").alias("nodes"), "score").withColumn("_tie", F.concat_ws("-", "nodes")), [key], "score", "_tie", top).select(key, F.col("rank").alias("item"), "nodes", "score"))
    d = keep(seqalign.distances(seqalign.all_pairs(ranked, [key], "item").repartition(key, "i", "j"), "local", known).select(key, "i", "j", "distance"))
    own = keep(cluster.clusters(d, key, "average", number=number))
    rivers = paths.best_of(ranked.join(own.select(key, "item", "cluster"), [key, "item"]), [key, "cluster"], "score", "item").drop("rank")
    return {"paths": ranked, "distances": d, "tree": cluster.trees(d, key), "clusters": own, "rivers": rivers}


def decomposition_study(edges: DataFrame, key: str, sources: list[int], targets: list[int], label: DataFrame, known: dict, keep: Callable[[DataFrame], DataFrame], **options) -> dict[str, DataFrame]:
    """Flow to paths, turned, consolidated and scored, then aligned, clustered and drawn as rivers; see ``consolidated_paths`` for ``options``."""
    grouped = keep(consolidated_paths(edges, key, sources, targets, label, keep, **options))
    return {"consolidated": grouped, **scored_rivers(grouped, key, known, keep)}


def reconstruction_study(t: DataFrame, visits: DataFrame, seeds: DataFrame, targets: list[int], keys: list[str], label: DataFrame, known: dict, keep: Callable[[DataFrame], DataFrame], weighted: bool = True, k: int = 5, fixed: int = 10) -> dict[str, DataFrame]:
    """Paths of most probability for each of ``keys`` (system, direction, target), once each, clustered twice on the same distances.

    ``seeds`` is ``(node, weight)`` with or without keys; ``weighted`` multiplies a step by its start's
    visits from the seeds. Clusters are made by silhouette or gap (``auto``) and as ``fixed`` many, each
    with members, medoids, consensus, profiles and a listing.
    """
    importance = markov.visitation_field(visits, seeds, keys).withColumnRenamed("field", "importance") if weighted else None
    edge = keep(markov.edge_importance(t, markov.node_importance(visits, keys), keys))
    own = [c for c in keys if c in seeds.columns]
    raw = keep(paths.best_paths(markov.log_weights(t, importance, keys), seeds.select(*own, "node"), targets, k, keys))
    rows = raw.withColumn("path_id", F.struct("seed", "rank"))
    steps = rows.select(*keys, "path_id", F.posexplode("nodes").alias("at", "node"))
    scored = paths.walk_sums(rows, edge.select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), "e"), [*keys, "path_id"], "e", on=keys).withColumnRenamed("total", "importance")
    likely = paths.walk_sums(rows, t.select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), "t"), [*keys, "path_id"], "t", floor=1e-10, on=keys).withColumnRenamed("total", "log_prob")
    named = steps.join(label, "node").groupBy(*keys, "path_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("nodes"))
    named = named.join(scored, [*keys, "path_id"]).join(likely, [*keys, "path_id"]).withColumn("seed", F.element_at("nodes", 1))
    unique = paths.dedup_paths(named, keys).withColumn("_name", F.concat_ws("-", "relative"))
    unique = keep(unique.withColumn("item", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("importance"), "_name"))).drop("_name"))
    group = F.concat_ws("|", *[F.col(c).cast("string") for c in keys])
    items = unique.withColumn("study", group).withColumnRenamed("relative", "nodes")
    d = keep(seqalign.distances(seqalign.all_pairs(items, ["study"], "item").repartition("study", "i", "j"), "global", known).select("study", "i", "j", "distance"))
    out = {"raw": raw, "paths": unique, "distances": d}
    for name, number in (("auto", None), ("fixed", fixed)):
        found = keep(cluster.clusters(d, "study", "complete", number=number))
        members = keep(items.join(found, ["study", "item"]))
        medoid = keep(seqalign.medoids(d, members.select("study", "item", "cluster"), ["study"]).join(items.select("study", "item", "nodes"), ["study", "item"]))
        out |= {
            f"{name}_members": members, f"{name}_medoids": medoid, f"{name}_consensus": seqalign.consensus(members, medoid, ["study", "cluster"], "item", known=known),
            f"{name}_profiles": cluster.profiles(members.withColumnRenamed("nodes", "relative"), ["study", "cluster"]), f"{name}_listing": tables.cluster_listing(medoid, "study", "cluster", "nodes"),
        }
    return out


def path_structures(medoids: DataFrame, places: DataFrame, system: str, rank: str) -> DataFrame:
    """Lines of a structure file a system: each cluster's path as a strand through its residues, a chain a cluster, in the order of ``rank``.

    ``medoids`` is ``(system, rank, nodes)`` and ``places`` ``(system, label, x, y, z)``. Residues without a place are left out.
    """
    letters = build3d.as_chains(medoids, [system], rank).select(system, rank, "chain")
    steps = medoids.select(system, rank, F.posexplode("nodes").alias("at", "label")).join(places, [system, "label"])
    line = F.struct(F.col(system), F.col(rank).alias("rank"))
    guide = build3d.guides(build3d.with_end(steps.withColumn("line", line), ["line"], "at"), ["line"], "at")
    strands = build3d.backbones(guide.withColumn("line", F.to_json("line")), "line", ["at", "step"])
    named = letters.withColumn("line", F.to_json(line))
    return pdb.strand_lines(strands.join(named.select("line", "chain", system), "line"), system)


def field_structures(fields: DataFrame, lines: DataFrame, cap: float = 99.99) -> DataFrame:
    """Structure lines that hold a field in place of temperature factors, one structure an item in their set order.

    ``fields`` is ``(direction, target, label, value)``. Items are each direction and target, then each
    direction over targets, then all, numbered in that order, and scaled to ``cap`` by their own
    largest value. ``lines`` is ``(line_no, line)``.
    """
    one = fields.withColumn("item", F.concat_ws("_", "direction", "target")).withColumn("turn", F.lit(1))
    both = fields.withColumn("item", F.concat_ws("_", "direction", F.lit("total"))).withColumn("turn", F.lit(2))
    every = fields.withColumn("item", F.lit("all")).withColumn("turn", F.lit(3))
    sums = one.unionByName(both).unionByName(every).groupBy("turn", "item", "label").agg(F.sum("value").alias("value"))
    top = sums.groupBy("turn", "item").agg(F.max("value").alias("top"))
    order = top.select("turn", "item", "top", F.row_number().over(Window.orderBy("turn", "item")).alias("place"))  # an item a combination
    scaled = sums.join(order, ["turn", "item"]).select("place", "item", F.substring("label", 1, 1).alias("_chain"), number_of(F.col("label")).alias("_resno"), F.when(F.col("top") > 0, F.col("value") / F.col("top") * cap).otherwise(0.0).alias("_value"))
    copies = lines.crossJoin(F.broadcast(order.select("place", "item")))  # a copy of the structure for each item
    return pdb.with_values(copies, scaled.select("place", F.col("_chain").alias("chain"), F.col("_resno").alias("resno"), F.col("_value").alias("value")), on=["place"])
