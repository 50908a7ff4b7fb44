"""Agglomerative clustering of small groups by their pair distances, one group a task."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def linkage(d: np.ndarray, kind: str = "complete") -> list[tuple[int, int, float, int]]:
    """Merges ``(a, b, height, size)``; new clusters are numbered on from the items; ties go to the lowest pair.

    ``complete`` joins by the largest distance, ``average`` by the mean.
    """
    n = len(d)
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    names, sizes, out = list(range(n)), [1] * n, []
    while len(names) > 1:
        i, j = sorted(int(k) for k in np.unravel_index(int(d.argmin()), d.shape))
        height = float(d[i, j])
        row = np.maximum(d[i], d[j]) if kind == "complete" else (sizes[i] * d[i] + sizes[j] * d[j]) / (sizes[i] + sizes[j])
        out.append((names[i], names[j], height, sizes[i] + sizes[j]))
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        sizes[i] += sizes[j]
        names[i] = n + len(out) - 1
        del names[j], sizes[j]
    return out


def cut_tree(merges: list, n: int, k: int) -> np.ndarray:
    """Cluster numbers from 1, in the order of first items, with at most k clusters; merges of equal height are made together."""
    members = {i: [i] for i in range(n)}
    done = max(0, n - k)
    while 0 < done < len(merges) and merges[done][2] == merges[done - 1][2]:
        done += 1
    for step, (a, b, _, _) in enumerate(merges[:done]):
        members[n + step] = members.pop(a) + members.pop(b)
    out = np.zeros(n, int)
    for c, items in enumerate(sorted(members.values(), key=min), 1):
        out[items] = c
    return out


def silhouette(d: np.ndarray, labels: np.ndarray) -> float:
    total = 0.0
    for i in range(len(d)):
        own = labels == labels[i]
        if own.sum() < 2:
            continue
        a = d[i][own].sum() / (own.sum() - 1)
        b = min(d[i][labels == c].mean() for c in set(labels.tolist()) - {int(labels[i])})
        total += (b - a) / max(a, b) if max(a, b) > 0 else 0.0
    return total / len(d)


def gap_number(merges: list, n: int, most: int = 10) -> int:
    """Clusters before the largest jump of merge heights, of equal ones the topmost; equal heights give ``most``."""
    if n <= 2:
        return n
    jumps = np.diff([m[2] for m in merges])[::-1]
    if not len(jumps):
        return 2
    if np.all(jumps == 0):
        return min(most, n)
    return int(min(most, max(2, int(np.argmax(jumps)) + 2)))


def cut_height(merges: list, n: int, k: int) -> float:
    """Midway between the last merge made for k clusters and the next one; half the first height where none is made."""
    if not merges:
        return 0.0
    made = min(n - k, len(merges))
    if made <= 0:
        return merges[0][2] / 2
    above = merges[made][2] if made < len(merges) else merges[made - 1][2] + 1e-6
    return (merges[made - 1][2] + above) / 2


def auto_number(d: np.ndarray, merges: list, least: float = 0.10, most: int = 10) -> int:
    """The number of clusters of the best silhouette if that is ``least`` or more, else by the largest gap."""
    n = len(d)
    if n <= 2:
        return n
    cuts = {k: cut_tree(merges, n, k) for k in range(2, min(most, n - 1) + 1)}
    best = max(((silhouette(d, c), -k) for k, c in cuts.items() if c.max() > 1), default=(-1.0, -2))
    return -best[1] if best[0] >= least else gap_number(merges, n, most)


def neighbour_joining(d: np.ndarray, names: list[str]) -> str:
    """A tree in Newick form, by neighbour joining; negative lengths become 0."""
    nodes, d = list(names), d.astype(float).copy()
    while len(nodes) > 2:
        n = len(nodes)
        r = d.sum(axis=1)
        q = (n - 2) * d - r[:, None] - r[None]
        np.fill_diagonal(q, np.inf)
        i, j = sorted(int(k) for k in np.unravel_index(int(q.argmin()), q.shape))
        li = max(0.0, d[i, j] / 2 + (r[i] - r[j]) / (2 * (n - 2)))
        lj = max(0.0, d[i, j] - li)
        row = (d[i] + d[j] - d[i, j]) / 2
        nodes[i] = f"({nodes[i]}:{li:.6f},{nodes[j]}:{lj:.6f})"
        d[i], d[:, i] = row, row
        d[i, i] = 0
        d = np.delete(np.delete(d, j, 0), j, 1)
        del nodes[j]
    return (f"({nodes[0]}:{d[0, 1]:.6f},{nodes[1]}:0)" if len(nodes) == 2 else nodes[0] if nodes else "") + ";"


def _square(pdf: pd.DataFrame) -> tuple[list, np.ndarray]:
    items = sorted(set(pdf["i"]) | set(pdf["j"]))
    d = np.zeros((len(items), len(items)))
    a, b = np.searchsorted(items, pdf["i"]), np.searchsorted(items, pdf["j"])
    d[a, b] = d[b, a] = pdf["distance"]
    return items, d


def clusters(distance_rows: DataFrame, key: str, kind: str = "complete", number: int | None = None) -> DataFrame:
    """``(key, item, cluster, n_clusters, cut_height)``; the number of clusters is chosen by silhouette or gap unless given.

    A group's distances are one task's, so groups hold as many items as the top list that they come from.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, d = _square(pdf)
        merges = linkage(d, kind)
        k = 1 if d.max() <= 0 else min(number, len(items)) if number else auto_number(d, merges)
        made = cut_tree(merges, len(items), k)
        return pd.DataFrame({key: pdf[key].iloc[0], "item": items, "cluster": made, "n_clusters": int(made.max()), "cut_height": cut_height(merges, len(items), k)})

    kinds = dict(distance_rows.dtypes)
    return distance_rows.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, item {kinds['i']}, cluster int, n_clusters int, cut_height double")


def trees(distance_rows: DataFrame, key: str) -> DataFrame:
    """``(key, newick)`` of each group by neighbour joining."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        items, d = _square(pdf)
        return pd.DataFrame({key: [pdf[key].iloc[0]], "newick": [neighbour_joining(d, [str(i) for i in items])]})

    return distance_rows.groupBy(key).applyInPandas(run, f"{key} {dict(distance_rows.dtypes)[key]}, newick string")


def walktrap(edges: DataFrame, key: str, steps: int = 3) -> DataFrame:
    """``(key, node, community)`` by short random walks: neighbouring clusters merge by least rise of walk distance; best modularity.

    One graph a task: its walk matrix has its nodes squared.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes = np.unique(np.concatenate([pdf["src"], pdf["dst"]]))
        a, b = np.searchsorted(nodes, pdf["src"]), np.searchsorted(nodes, pdf["dst"])
        w = np.zeros((len(nodes), len(nodes)))
        w[a, b] += pdf["weight"]
        w[b, a] += pdf["weight"]
        loops = w + np.diag(np.where(w.sum(axis=1) > 0, w.sum(axis=1) / np.maximum((w > 0).sum(axis=1), 1), 1.0))
        degree = loops.sum(axis=1)
        walk = np.linalg.matrix_power(loops / degree[:, None], steps) / np.sqrt(degree)[None]
        label = np.arange(len(nodes))
        total = w.sum()
        groups = {i: ([i], walk[i]) for i in range(len(nodes))}

        def modularity() -> float:
            same = label[:, None] == label[None]
            s = w.sum(axis=1)
            return float(((w - np.outer(s, s) / total) * same).sum() / total)

        best, kept = modularity(), label.copy()
        while len(groups) > 1:
            cost = []
            for x, (mx, px) in groups.items():
                for y, (my, py) in groups.items():
                    if x < y and w[np.ix_(mx, my)].any():
                        cost.append((len(mx) * len(my) / (len(mx) + len(my)) * ((px - py) ** 2).sum(), x, y))
            if not cost:
                break
            _, x, y = min(cost)
            (mx, px), (my, py) = groups[x], groups.pop(y)
            groups[x] = (mx + my, (len(mx) * px + len(my) * py) / (len(mx) + len(my)))
            label[my] = label[mx[0]]
            if (q := modularity()) > best + 1e-12:
                best, kept = q, label.copy()
        _, community = np.unique(kept, return_inverse=True)
        return pd.DataFrame({key: pdf[key].iloc[0], "node": nodes, "community": community + 1, "modularity": best})

    kinds = dict(edges.dtypes)
    return edges.groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, node {kinds['src']}, community int, modularity double")


def profiles(members: DataFrame, keys: list[str]) -> DataFrame:
    """A cluster's members, copies, chains, seeds, importance, log probability and length."""
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    return members.groupBy(*keys).agg(
        F.count("*").alias("n_members"), F.sum("n_duplicates").alias("n_paths"), F.size(flat("chain_origins")).alias("n_chains"), flat("seeds").alias("seeds"),
        F.avg("importance").alias("mean_importance"), F.sum("importance").alias("total_importance"), F.avg("log_prob").alias("mean_log_prob"), F.avg(F.size("relative")).alias("mean_length"),
    )
