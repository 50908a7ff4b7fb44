"""Whole studies as compositions of operators; what is written between steps is a table, never an object."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import acute_angle
from ..functions.labels import relative_path
from ..operators import dynamics, markov, matrix, network, paths, series


def angle_series(axes: DataFrame, keys: list[str], first: str, second: str, order: str, k: int = 5) -> DataFrame:
    """Angle between two named axes of the same frame, and its centred mean: ``(keys, order, angle, smooth)``."""
    a = axes.where(F.col("axis") == first).select(*keys, order, F.col("ax").alias("x1"), F.col("ay").alias("y1"), F.col("az").alias("z1"))
    b = axes.where(F.col("axis") == second).select(*keys, order, F.col("ax").alias("x2"), F.col("ay").alias("y2"), F.col("az").alias("z2"))
    angle = a.join(b, [*keys, order]).select(*keys, order, acute_angle(["x1", "y1", "z1"], ["x2", "y2", "z2"]).alias("angle"))
    return series.rolling_mean(angle, keys, order, "angle", k)


def distogram(frames: DataFrame, system: str, replica: str, frame: str = "frame") -> DataFrame:
    """Mean and variance of pair distances over all replicas of a system, pooled exactly from the replicas' own."""
    each = dynamics.distance_blocks(frames, [system, replica], frame)
    return matrix.pool_replicas(each, [system, "i", "j"])


def correlation_network(frames: DataFrame, system: str, levels: list[float], contact: float | None = None) -> DataFrame:
    """Edges of each level from cross-correlation, in contact by mean distance if a cutoff is given."""
    c = dynamics.correlation_blocks(frames, [system]).withColumnRenamed("c", "value")
    near = None
    if contact is not None:
        mean = dynamics.mean_structure(frames, [system], [])
        near = dynamics.pair_distances(mean, [system], within=contact)
    return network.threshold_network(c, near, levels, [system])


def flow_field(edges: DataFrame, pairs: DataFrame, absorbing: DataFrame, seeds: DataFrame, keys: list[str], keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Visits of a chain that follows the accumulated flow of ``pairs`` into absorbing nodes, from weighted seeds."""
    flow = keep(network.flow_sums(edges, pairs, keys))
    t = keep(markov.transition(flow.withColumnRenamed("fwd", "weight"), keys))
    return markov.visitation_field(keep(markov.fundamental_blocks(t, keys, absorbing, keep)), seeds, keys)


def consolidated_paths(edges: DataFrame, key: str, sources: list[int] | None, targets: list[int], label: DataFrame, keep: Callable[[DataFrame], DataFrame], least_length: int = 8, rounds: int = 1, target_numbers: list[int] | None = None) -> DataFrame:
    """Flow taken apart into paths, cut at the target, turned, grouped and scored; then the turned paths' edges are taken apart again.

    ``label`` gives a node its chain and number. A round adds the flow of the grouped paths by their
    turned edges, takes that graph apart from all its labels to those of ``target_numbers``, turns, cuts
    and groups. The reference allows two rounds, but compares the first with itself, so one is made;
    more of them stop once the paths are those of the round before. A round without paths, or without
    target numbers, leaves what was there.
    """
    found = paths.decompose(edges, [key], sources, targets, least_length=least_length)
    steps = found.select(key, "path_id", "flow", F.posexplode("nodes").alias("at", "node")).join(label, "node")
    named = steps.groupBy(key, "path_id", "flow").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "label"))), lambda s: s["label"]).alias("nodes"))
    cut = lambda rows: paths.keep_long(paths.truncate_at(rows, target_numbers) if target_numbers else rows, least_length)
    grouped = keep(paths.group_paths(cut(named), [key]))
    for _ in range(rounds if target_numbers else 0):
        turned = paths.edge_sums(grouped.select(key, F.col("relative").alias("nodes"), F.col("flow_sum").alias("weight")), [key])
        merged = turned.groupBy(key, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.sum("weight").alias("weight"))
        again = paths.decompose(merged, [key], None, lambda x: int(x[1:]) in target_numbers, least_length=least_length)
        now = keep(paths.group_paths(cut(again.withColumn("nodes", relative_path(F.col("nodes")))), [key]))
        whole = grouped.join(now.select(key).distinct(), key, "left_anti").unionByName(now)  # a group without paths stays as it was
        same = grouped.select(key, "relative").exceptAll(whole.select(key, "relative")).isEmpty() and whole.select(key, "relative").exceptAll(grouped.select(key, "relative")).isEmpty()
        grouped = keep(whole)
        if same:
            break
    return grouped
