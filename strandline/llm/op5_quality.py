"""Quality: a linear-chain conditional random field over a document's lines."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op2_toxicity import held_out, labelled_texts
from .shared import SPACE, blocks, packed, prefix_sums, span_hashes, words

#: Labelled rows of each class that a model is fitted on at most, the first by a hash of their id.
MAX_PER_CLASS = 1500
THRESHOLD = 0.5


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_KINDS = {
    "upper": _class(bytes(range(65, 91))),
    "lower": _class(bytes(range(97, 123))),
    "digit": _class(bytes(range(48, 58))),
    "stop": _class(b".,;:?"),
    "loud": _class(b"!"),
    "bar": _class(b"|/\\<>{}[]=_~^"),
    "sign": _class(b"#%&*$@+"),
    "high": _class(bytes(range(128, 256))),
}
OWN = 17
WIDTH = 3 * OWN


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of each line with those of the lines before and after, its bytes, and each row's first line.

    Lines end at ``\\n``; a row has one line more than line ends, so an empty row has one empty line.
    """
    ends = np.flatnonzero(data == 10)
    rows = len(offsets) - 1
    inner = np.searchsorted(ends, offsets)
    number = np.diff(inner) + 1
    first = np.concatenate([[0], np.cumsum(number)])
    start = np.empty(first[-1], np.int64)
    stop = np.empty(first[-1], np.int64)
    is_first = np.zeros(first[-1], bool)
    is_first[first[:-1]] = True
    is_last = np.zeros(first[-1], bool)
    is_last[first[1:] - 1] = True
    start[is_first], stop[is_last] = offsets[:-1], offsets[1:]
    start[~is_first], stop[~is_last] = ends + 1, ends
    size = stop - start
    n = np.maximum(size, 1)

    def count(table: np.ndarray) -> np.ndarray:
        total = np.zeros(len(data) + 1, np.int32)
        np.cumsum(table[data], out=total[1:])
        return (total[stop] - total[start]).astype(np.float64)

    kind = {k: count(t) for k, t in _KINDS.items()}
    letters = kind["upper"] + kind["lower"] + 1
    edges = np.append(start, len(data)) if len(start) else np.zeros(1, np.int64)
    w0, w1, _ = words(data, offsets, ~SPACE)
    line_of = np.searchsorted(edges[:-1], w0, side="right") - 1 if len(w0) else np.zeros(0, np.int64)
    n_words = np.bincount(line_of, minlength=len(start)).astype(np.float64)
    sums = prefix_sums(data)
    h = span_hashes(sums, w0, w1)
    again = np.zeros(len(start))
    distinct = np.zeros(len(start))
    if len(h):
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (line_of[1:] == line_of[:-1])])
        again = np.bincount(line_of, weights=same, minlength=len(start))
        order = np.lexsort((h, line_of))
        new = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (line_of[order][1:] != line_of[order][:-1])])
        distinct = np.bincount(line_of[order], weights=new, minlength=len(start))
    of = np.repeat(np.arange(rows), number)
    whole = span_hashes(sums, start, stop)
    order = np.lexsort((np.arange(len(start)), whole, of))
    twin = np.concatenate([[False], (whole[order][1:] == whole[order][:-1]) & (of[order][1:] == of[order][:-1])])
    repeated = np.zeros(len(start))
    repeated[order] = twin & (size[order] > 0)
    some = np.maximum(n_words, 1)
    own = np.stack(
        [
            np.ones(len(start)), size == 0, np.log1p(size) / 8, kind["upper"] / letters, (kind["upper"] > 0.5 * letters), kind["digit"] / n, kind["stop"] / some,
            np.minimum(kind["loud"] / some, 2), np.minimum(kind["bar"] / some, 2), np.minimum(kind["sign"] / some, 4), kind["high"] / n, again / some, distinct / some,
            np.log1p(n_words) * (1 - distinct / some) / 4, repeated, np.minimum(size / some, 20) / 10, n_words <= 3,
        ],
        axis=1,
    ).astype(np.float64)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[is_first], after[is_last] = 0, 0
    return np.concatenate([own, before, after], axis=1), size, first


def marginals(emit: np.ndarray, first: np.ndarray, start: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many chains at once: each line's probability of state 1, expected moves, and first states.

    ``emit`` is the score of state 1 over state 0 of each line and ``first`` the first line of each
    chain. Chains are stepped together, the longest first, so those that ended are left out.
    """
    number = np.diff(first)
    order = np.argsort(-number, kind="stable")
    begin, length = first[:-1][order], number[order]
    alpha = np.zeros((len(emit), 2))
    beta = np.zeros((len(emit), 2))
    e = np.stack([np.zeros(len(emit)), emit], axis=1)
    e -= e.max(axis=1, keepdims=True)
    e = np.exp(e)
    a, s = np.exp(move - move.max()), np.exp(start - start.max())
    most = int(length[0]) if len(length) else 0
    live = np.searchsorted(-length, -np.arange(most), side="left")  # chains longer than t
    for t in range(most):
        at = begin[: live[t]] + t
        x = (s if t == 0 else alpha[at - 1] @ a) * e[at]
        alpha[at] = x / x.sum(axis=1, keepdims=True)
    for t in range(most - 1, -1, -1):
        at = begin[: live[t]] + t
        beta[at] = 0.5
        inner = at[length[: live[t]] > t + 1]
        if len(inner):
            x = (beta[inner + 1] * e[inner + 1]) @ a.T
            beta[inner] = x / x.sum(axis=1, keepdims=True)
    p = alpha * beta
    p /= p.sum(axis=1, keepdims=True)
    inner = np.ones(len(emit), bool)
    inner[first[1:] - 1] = False
    k = np.flatnonzero(inner)
    pair = alpha[k][:, :, None] * a[None] * (beta[k + 1] * e[k + 1])[:, None, :]
    pair /= pair.sum(axis=(1, 2), keepdims=True)
    return p, pair, k


def fit(x: np.ndarray, first: np.ndarray, labels: np.ndarray, weight: np.ndarray, rounds: int = 250) -> dict[str, np.ndarray]:
    """Weights by gradient ascent on the likelihood of chains whose lines all carry their document's label."""
    w, start, move = np.zeros(x.shape[1]), np.zeros(2), np.zeros((2, 2))
    of = np.repeat(np.arange(len(labels)), np.diff(first))
    y, each = labels[of], (weight / np.maximum(np.diff(first), 1))[of]
    each = each / each.sum()
    size = w.size + 2 + 4
    m, v, theta = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, rounds + 1):
        w, start, move = theta[: w.size], theta[w.size : w.size + 2], theta[w.size + 2 :].reshape(2, 2)
        p, pair, k = marginals(x @ w, first, start, move)
        g = x.T @ (each * (p[:, 1] - y)) + 1e-4 * w
        own = each[first[:-1]]
        gs = (own[:, None] * (p[first[:-1]] - np.eye(2)[labels])).sum(axis=0) + 1e-3 * start
        gm = (each[k][:, None, None] * (pair - np.eye(2)[y[k]][:, :, None] * np.eye(2)[y[k]][:, None, :])).sum(axis=0) + 1e-2 * move
        grad = np.concatenate([g, gs, gm.ravel()])
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        theta = theta - 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return {"w": theta[: w.size].copy(), "start": theta[w.size : w.size + 2].copy(), "move": theta[w.size + 2 :].reshape(2, 2).copy()}


def train(labelled: DataFrame, id_column: str, text: str, label: str, max_per_class: int = MAX_PER_CLASS, counts: dict[int, int] | None = None) -> dict[str, np.ndarray] | None:
    """A field fitted in one task on the first ``max_per_class`` rows of each label by a hash of the id, then of the text.

    Rows are weighed to the shares of all rows, or to ``counts`` where ``labelled`` is a sample already.
    """
    counts = counts if counts is not None else {r[0]: r[1] for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    if not counts:
        return None
    first = (F.xxhash64("i"), F.col("i"), F.xxhash64("t"), F.col("t"))
    picked = [labelled.where(F.col(label) == k).select(F.col(id_column).alias("i"), F.col(text).alias("t"), F.col(label).cast("int").alias("y")).orderBy(*first).limit(max_per_class) for k in (0, 1)]

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        xs, number, ys = [], [], []
        for f in frames:
            data, offsets = packed(pa.array(f["t"], pa.large_string()))
            for i, j in blocks(offsets):
                x, _, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                xs.append(x)
                number.append(np.diff(first))
                ys.append(f["y"].to_numpy()[i:j])
        y = np.concatenate(ys).astype(np.int64)
        seen = np.bincount(y, minlength=2)
        weight = np.array([counts.get(k, 0) / max(seen[k], 1) for k in (0, 1)])[y]
        got = fit(np.concatenate(xs), np.concatenate([[0], np.cumsum(np.concatenate(number))]), y, weight)
        yield pd.DataFrame({k: [x.tobytes()] for k, x in got.items()})

    row = picked[0].unionByName(picked[1]).repartition(1).sortWithinPartitions("i", F.xxhash64("t"), "y").mapInPandas(learn, "w binary, start binary, move binary").first()
    return {"w": np.frombuffer(row["w"]), "start": np.frombuffer(row["start"]), "move": np.frombuffer(row["move"]).reshape(2, 2)}


def score_quality(docs: DataFrame, model: dict[str, np.ndarray] | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, score, n_lines, n_bad``: the lines' probabilities of being good, weighed by their bytes.

    An empty line weighs one byte. Null counts as the empty text, which is one empty line. Without a
    model, for want of labelled rows, every score is 0.5. Repeated rows and ids, null ids too, are
    scored each for itself; an empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = shared.value
        for b in batches:
            data, offsets = packed(b.column(1))
            score, lines, bad = np.full(b.num_rows, 0.5), np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            for i, j in blocks(offsets) if field else []:
                x, size, first = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                p, _, _ = marginals(x @ field["w"], first, field["start"], field["move"])
                of = np.repeat(np.arange(j - i), np.diff(first))
                weight = np.maximum(size, 1)
                score[i:j] = np.bincount(of, weights=p[:, 1] * weight, minlength=j - i) / np.bincount(of, weights=weight, minlength=j - i)
                lines[i:j] = np.diff(first)
                bad[i:j] = np.bincount(of, weights=p[:, 1] < 0.5, minlength=j - i)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.clip(score, 0, 1)), pa.array(lines), pa.array(bad)], names=["_id", "score", "n_lines", "n_bad"])

    return docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text)).mapInArrow(run, "_id long, score double, n_lines long, n_bad long").withColumnRenamed("_id", id_column)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every whole text of ``documents``, by a field of the labels of rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    counts, sample = labelled_texts(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "quality", 3, 1, MAX_PER_CLASS)
    scored = score_quality(docs, train(sample, "doc_id", "text", "_label", counts=counts))
    return scored.select("doc_id", F.coalesce(held_out("doc_id", 3, 1), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "n_lines", "n_bad")
