"""Absorbing Markov chains over flow: transition, fundamental matrix, importance and visitation."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def transition(flow: DataFrame, keys: list[str], weight: str = "weight") -> DataFrame:
    """``(i, j, t)``: each positive flow over its row's sum; a row without flow has no cells."""
    w = Window.partitionBy(*keys, "src")
    return flow.where(F.col(weight) > 0).select(*keys, F.col("src").alias("i"), F.col("dst").alias("j"), (F.col(weight) / F.sum(weight).over(w)).alias("t"))


def fundamental_series(t: DataFrame, keys: list[str], absorbing: DataFrame, nodes: DataFrame, keep: Callable[[DataFrame], DataFrame], max_rounds: int = 64) -> DataFrame:
    """Expected visits ``(i, j, n)`` between transient nodes as the sum of powers of the transient part, by joins.

    Exact and finite where edges only go up in an order, as those of an undirected edge list do; the
    loop ends when a power is empty and fails after ``max_rounds``. ``keep`` cuts lineage.
    """
    inner = t.join(absorbing.select(F.col("node").alias("i")), "i", "left_anti").join(absorbing.select(F.col("node").alias("j")), "j", "left_anti")
    inner = keep(inner.select(*keys, F.col("i").alias("_m"), F.col("j"), "t"))
    state = keep(nodes.join(absorbing, "node", "left_anti").select(*keys, F.col("node").alias("i"), F.col("node").alias("j"), F.lit(1.0).alias("n")))
    powers = [state]
    for _ in range(max_rounds):
        step = state.withColumnRenamed("j", "_m").join(inner, [*keys, "_m"]).groupBy(*keys, "i", "j").agg(F.sum(F.col("n") * F.col("t")).alias("n"))
        state = keep(step.where("n > 0"))
        if state.isEmpty():
            break
        powers.append(state)
    else:
        raise RuntimeError("the chain has a cycle: use fundamental_solve")
    out = powers[0]
    for p in powers[1:]:
        out = out.unionByName(p)
    return out.groupBy(*keys, "i", "j").agg(F.sum("n").alias("n"))


#: Rows and columns of a block of a chain's matrix.
BLOCK = 256


def to_blocks(entries: DataFrame, keys: list[str], size: int = BLOCK) -> DataFrame:
    """``(keys, bi, bj, body, mass)`` of rows ``(keys, i, j, v)`` with whole numbers as nodes: dense blocks by rows, only where there is an entry."""
    kinds = dict(entries.dtypes)

    def fill(pdf: pd.DataFrame) -> pd.DataFrame:
        body = np.zeros((size, size))
        np.add.at(body, (pdf["i"].to_numpy() % size, pdf["j"].to_numpy() % size), pdf["v"].to_numpy())
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in [*keys, "bi", "bj"]}, "body": [body.tobytes()], "mass": body.sum()})

    at = entries.select(*keys, *[F.floor(F.col(c) / size).cast("long").alias(f"b{c}") for c in "ij"], "i", "j", "v")
    return at.groupBy(*keys, "bi", "bj").applyInPandas(fill, "".join(f"{k} {kinds[k]}, " for k in keys) + "bi long, bj long, body binary, mass double")


def from_blocks(blocks: DataFrame, keys: list[str], kind: str, size: int = BLOCK) -> DataFrame:
    """The entries ``(keys, i, j, v)`` other than 0."""
    kinds = dict(blocks.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                body = np.frombuffer(b.column("body")[r].as_py()).reshape(size, size)
                i, j = np.nonzero(body)
                own = b.slice(r, 1).take(pa.array(np.zeros(len(i), np.int64)))
                yield pa.RecordBatch.from_arrays([*(own.column(k) for k in keys), *(pa.array(x + b.column(c)[r].as_py() * size) for x, c in ((i, "bi"), (j, "bj"))), pa.array(body[i, j])], names=[*keys, "i", "j", "v"])

    out = blocks.select(*keys, "bi", "bj", "body").mapInArrow(run, "".join(f"{k} {kinds[k]}, " for k in keys) + "i long, j long, v double")
    return out.select(*keys, F.col("i").cast(kind).alias("i"), F.col("j").cast(kind).alias("j"), "v")


#: Blocks of sums that a task holds before it hands them on.
HELD = 64


def multiply(left: DataFrame, right: DataFrame, keys: list[str], size: int = BLOCK, plus: DataFrame | None = None) -> DataFrame:
    """The product of block matrices, ``(keys, bi, bj, body, mass)``, and ``plus``; ``keys`` may name columns that ``left`` alone has.

    Blocks meet on the inner index, tasks add up the products they make, and the sums of tasks meet by
    their place, with the blocks of ``plus``. Blocks of zeros are left out; ``mass`` is the sum of a block's entries.
    """
    kinds = dict(left.dtypes)
    both = [k for k in keys if k in right.columns]
    met = left.select(*keys, "bi", F.col("bj").alias("_m"), F.col("body").alias("_a")).join(right.select(*both, F.col("bi").alias("_m"), "bj", F.col("body").alias("_b")), [*both, "_m"])
    place = [*keys, "bi", "bj"]
    schema = "".join(f"{k} {kinds[k]}, " for k in keys) + "bi long, bj long, body binary"

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, np.ndarray] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(*k, v.tobytes()) for k, v in held.items()], columns=[*place, "body"])
            held.clear()
            return out

        for f in frames:
            for at, x, y in zip(f[place].itertuples(index=False, name=None), f["_a"], f["_b"], strict=True):
                one = np.frombuffer(x).reshape(size, size) @ np.frombuffer(y).reshape(size, size)
                if at in held:
                    held[at] += one
                elif one.any():
                    held[at] = one
                if len(held) >= HELD:
                    yield flush()
        yield flush()

    parts = met.select(*place, "_a", "_b").mapInPandas(products, schema)

    def total(pdf: pd.DataFrame) -> pd.DataFrame:
        body = np.frombuffer(pdf["body"].iloc[0]).copy()
        for x in pdf["body"].iloc[1:]:
            body += np.frombuffer(x)
        return pdf.iloc[:1].assign(body=[body.tobytes()], mass=body.sum()) if body.any() else pdf.iloc[:0].assign(mass=0.0)

    if plus is not None:
        parts = parts.unionByName(plus.select(*place, "body"))
    return parts.groupBy(*place).applyInPandas(total, f"{schema}, mass double")


def fundamental_blocks(t: DataFrame, keys: list[str], absorbing: DataFrame, keep: Callable[[DataFrame], DataFrame], nodes: DataFrame | None = None, size: int = BLOCK, eps: float = 1e-6, scale: float = 1.0) -> DataFrame:
    """Expected visits ``(keys, i, j, n)`` between transient nodes of chains of any size, by repeated squaring of block matrices.

    With Q the transient part, the sum of its powers is (I + Q)(I + Q^2)(I + Q^4)...: a round
    doubles the powers that are in, so an acyclic chain takes about log2 of its longest path, and one that is absorbed
    about log2 of the steps until it is. A key whose Q keeps its mass is never absorbed, so its sum has no end; as in
    ``fundamental_solve`` it is then solved with ``eps`` on the diagonal, which is Q and the sum over 1 + ``eps``. Nodes are
    whole numbers; ``nodes`` names those that have no edge, too. ``keep`` cuts lineage.
    """
    kind = dict(t.dtypes)["i"]
    gone = absorbing.select("node")
    inner = t.join(gone.withColumnRenamed("node", "i"), "i", "left_anti")
    live = inner.join(gone.withColumnRenamed("node", "j"), "j", "left_anti")
    names = inner.select(*keys, "i").union(live.select(*keys, "j"))
    if nodes is not None:
        names = names.union(nodes.join(gone, "node", "left_anti").select(*keys, "node"))
    power = to_blocks(live.select(*keys, "i", "j", (F.col("t") * F.lit(scale)).alias("v")), keys, size).withColumn("_is", F.lit(1))
    series = to_blocks(names.distinct().select(*keys, "i", F.col("i").alias("j"), F.lit(1.0).alias("v")), keys, size).withColumn("_is", F.lit(0))
    both = keep(power.unionByName(series))
    before: dict[tuple, float] = {}
    stuck: set[tuple] = set()
    while True:
        series, power = both.where("_is = 0"), both.where("_is = 1")
        mass = {tuple(r)[:-1]: r["mass"] for r in power.groupBy(*keys).agg(F.sum("mass").alias("mass")).collect() if r["mass"] is not None}  # a number a key
        ended = {k for k, m in mass.items() if m < 1e-16}
        still = {k for k, m in mass.items() if k not in ended and before.get(k, 0) > 0 and m > before[k] * (1 - 1e-13)}
        stuck |= still
        before = {k: m for k, m in mass.items() if k not in ended | still}
        if not before:
            break
        if ended | still and keys:
            power = power.join(_key_rows(power, keys, ended | still), keys, "left_anti")
        both = keep(multiply(series.unionByName(power), power.drop("_is"), [*keys, "_is"], size, plus=series))
    out = from_blocks(series, keys, kind, size).select(*keys, "i", "j", (F.col("v") * F.lit(scale)).alias("n"))
    if not stuck:
        return out
    if scale != 1.0:
        raise RuntimeError("the chain's rows sum to more than 1")
    if not keys:
        return fundamental_blocks(t, keys, absorbing, keep, nodes, size, eps, 1 / (1 + eps))
    some = _key_rows(power, keys, stuck)
    again = fundamental_blocks(t.join(some, keys, "left_semi"), keys, absorbing, keep, nodes.join(some, keys, "left_semi") if nodes is not None else None, size, eps, 1 / (1 + eps))
    return out.join(some, keys, "left_anti").unionByName(again)


def _key_rows(like: DataFrame, keys: list[str], rows: set[tuple]) -> DataFrame:
    kinds = dict(like.dtypes)
    return F.broadcast(like.sparkSession.createDataFrame(sorted(rows), ", ".join(f"{k} {kinds[k]}" for k in keys)))


def fundamental_solve(t: DataFrame, key: str, absorbing: DataFrame, eps: float = 1e-6) -> DataFrame:
    """The same for any chain, one linear system a key; where it is singular, with ``eps`` on the diagonal."""
    inner = t.join(absorbing.select(F.col("node").alias("i")), "i", "left_anti").withColumn("_end", F.lit(False))
    ends = absorbing.select(F.col("node").alias("j"), F.lit(True).alias("_gone"))
    rows = inner.join(ends, "j", "left")

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        gone = pdf["_gone"].notna()
        names = np.unique(np.concatenate([pdf["i"], pdf["j"][~gone]]))
        q = np.zeros((len(names), len(names)))
        live = pdf[~gone]
        q[np.searchsorted(names, live["i"]), np.searchsorted(names, live["j"])] = live["t"]
        a = np.eye(len(names)) - q
        try:
            n = np.linalg.solve(a, np.eye(len(names)))
        except np.linalg.LinAlgError:
            n = np.linalg.solve(a + eps * np.eye(len(names)), np.eye(len(names)))
        i, j = np.nonzero(n)
        return pd.DataFrame({key: pdf[key].iloc[0] if len(pdf) else None, "i": names[i], "j": names[j], "n": n[i, j]})

    kinds = dict(t.dtypes)
    return rows.groupBy(key).applyInPandas(solve, f"{key} {kinds[key]}, i {kinds['i']}, j {kinds['j']}, n double")


def node_importance(n: DataFrame, keys: list[str]) -> DataFrame:
    """Visits of each node summed over all starts."""
    return n.groupBy(*keys, F.col("j").alias("node")).agg(F.sum("n").alias("importance"))


def edge_importance(t: DataFrame, importance: DataFrame, keys: list[str]) -> DataFrame:
    """Transition times the importance of where it starts, mirrored and halved."""
    e = t.join(importance.withColumnRenamed("node", "i"), [*keys, "i"]).select(*keys, "i", "j", (F.col("t") * F.col("importance")).alias("e"))
    both = e.unionByName(e.select(*keys, F.col("j").alias("i"), F.col("i").alias("j"), "e"))
    return both.groupBy(*keys, "i", "j").agg((F.sum("e") / 2).alias("e"))


def visitation_field(n: DataFrame, seeds: DataFrame, keys: list[str]) -> DataFrame:
    """Visits from weighted seeds, for all keys or each its own; a key's weights are over those of the seeds that are rows of its ``n``."""
    own = [k for k in keys if k in seeds.columns]
    present = n.select(*keys, F.col("i").alias("node")).distinct().join(seeds, [*own, "node"]).withColumnRenamed("node", "i")
    total = present.groupBy(*keys).agg(F.sum("weight").alias("_w"))
    rows = n.join(present, [*keys, "i"])
    rows = rows.join(total, keys) if keys else rows.crossJoin(F.broadcast(total))  # one row
    return rows.groupBy(*keys, F.col("j").alias("node")).agg(F.sum(F.col("weight") / F.col("_w") * F.col("n")).alias("field"))


def log_weights(t: DataFrame, importance: DataFrame | None, keys: list[str], eps: float = 1e-10) -> DataFrame:
    """Edge lengths ``-log(t + eps)``, or of ``t`` times the importance of the start; never under 0, missing values left out."""
    p = F.col("t")
    rows = t
    if importance is not None:
        rows = t.join(importance.withColumnRenamed("node", "i"), [*keys, "i"])
        p = p * F.col("importance")
    return rows.where((p > 0) & ~F.isnan(p)).select(*keys, F.col("i").alias("src"), F.col("j").alias("dst"), F.greatest(F.lit(0.0), -F.log(p + F.lit(eps))).alias("length"))
