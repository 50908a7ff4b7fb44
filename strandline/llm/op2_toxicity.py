"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import LOWER, SPACE, blocks, cut, mix, packed, powers, prefix_sums, quoted

BITS = 20
ORDERS = (4, 5)
#: Labelled rows of each class that a model is fitted on at most, the first by a hash of their id.
MAX_PER_CLASS = 4096
#: Parameters of the model, the same at every size of input: each bucket of n-grams is a feature if so many of the sampled
#: rows have it and its likelihood-ratio statistic is so large, which chance seldom reaches. Others have weight 0.
LEAST_SEEN = 5
LEAST_GAIN = 6.0
#: Entries of the sample's matrix that one step of the fit looks at together.
PART = 1 << 20
THRESHOLD = 0.3


def gram_buckets(data: np.ndarray, offsets: np.ndarray, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the hashed bucket of each window of so many bytes and whether it lies in one row.

    A-Z are lower-cased and all white space is one byte value, so a window may span a line's end.
    """
    flat = np.where(SPACE[data], np.uint8(32), LOWER[data])
    sums = prefix_sums(flat)
    _, down = powers(len(sums))
    for n in orders:
        m = len(flat) - n + 1
        if m <= 0:
            continue
        h = mix((sums[n:] - sums[:-n]) * down[:m]) >> np.uint64(64 - bits)
        ok = np.ones(m, bool)
        ends = offsets[1:-1]
        for back in range(1, n):
            at = ends - back
            ok[at[(at >= 0) & (at < m)]] = False
        yield h.astype(np.int32), ok


def features(text_column: pa.Array, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> list[np.ndarray]:
    """For each text, its distinct hashed n-grams, sorted; an empty text has none."""
    data, offsets = packed(text_column)
    out: list[np.ndarray] = []
    for i, j in blocks(offsets):
        off = offsets[i : j + 1] - offsets[i]
        grams = [(h, ok) for h, ok in gram_buckets(data[offsets[i] : offsets[j]], off, orders, bits)]
        for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
            own = [h[a:b][ok[a:b]] for h, ok in grams]
            out.append(np.unique(np.concatenate(own)) if own else np.zeros(0, np.int32))
    return out


def fit(rows: list[np.ndarray], labels: np.ndarray, prior: float, bits: int = BITS, rounds: int = 150) -> tuple[np.ndarray, float]:
    """Weights of all buckets (0 for most) and a bias, by logistic regression on scaled presence.

    A bucket's scale is the log ratio of its smoothed shares among the n-grams of either class;
    those that chance doesn't explain are features, however many they are. ``prior`` is the true share of
    label 1, to which the bias is moved from that of the sample.
    """
    size = 1 << bits
    weights = np.zeros(size, np.float32)
    y = labels.astype(np.float64)
    if not len(rows) or y.min() == y.max():
        p = min(max(prior, 1e-6), 1 - 1e-6)
        return weights, float(np.log(p / (1 - p)))
    # a row's buckets are distinct; one row at a time, as all of them at once would be large
    pos, seen = np.zeros(size), np.zeros(size)
    for r, label in zip(rows, y, strict=True):
        seen[r] += 1
        if label:
            pos[r] += 1
    neg = seen - pos
    n1, n0 = y.sum(), (1 - y).sum()
    ratio = np.log(((pos + 1) / (pos + 1).sum()) / ((neg + 1) / (neg + 1).sum()))
    p1, p0, p = (pos + 0.5) / (n1 + 1), (neg + 0.5) / (n0 + 1), (pos + neg + 0.5) / (n1 + n0 + 1)
    gain = pos * np.log(p1 / p) + neg * np.log(p0 / p)
    gain[pos + neg < LEAST_SEEN] = 0
    chosen = np.flatnonzero(gain > min(LEAST_GAIN, 0.5 * gain.max()))
    if not len(chosen):
        return weights, float(np.log(prior / (1 - prior)))
    place = np.full(size, -1, np.int32)
    place[chosen] = np.arange(len(chosen))
    own = [(x := place[r])[x >= 0] for r in rows]
    starts, col = np.append(0, np.cumsum([len(x) for x in own])), np.concatenate(own)
    parts = list(blocks(starts, PART))  # of rows
    scale = ratio[chosen]
    w, bias = np.ones(len(chosen)) * 0.1, 0.0
    m, v = np.zeros(len(chosen) + 1), np.zeros(len(chosen) + 1)
    for t in range(1, rounds + 1):
        x = scale * w
        total, rest = np.zeros(len(chosen)), 0.0
        for a, b in parts:
            here, n = col[starts[a] : starts[b]], np.diff(starts[a : b + 1])
            z = np.bincount(np.repeat(np.arange(b - a), n), weights=x[here], minlength=b - a) + bias
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[a:b]) / len(rows)
            total += np.bincount(here, weights=np.repeat(g, n), minlength=len(chosen))
            rest += g.sum()
        grad = np.append(scale * total + 1e-4 * w, rest)
        m = 0.9 * m + 0.1 * grad
        v = 0.99 * v + 0.01 * grad * grad
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, bias = w - step[:-1], bias - step[-1]
    weights[chosen] = scale * w
    prior = min(max(prior, 1e-6), 1 - 1e-6)
    return weights, float(bias + np.log(prior / (1 - prior)) - np.log(n1 / n0))


def train(labelled: DataFrame, id_column: str, text: str, label: str, max_per_class: int = MAX_PER_CLASS, counts: dict[int, int] | None = None) -> tuple[np.ndarray, float]:
    """A model of ``labelled`` rows: class shares over all of them, weights from a bounded sample.

    The sample is the first ``max_per_class`` rows of each label by a hash of the id, then of the
    text. Its n-grams are made where the rows are and fitted in one task; the driver gets only the
    weights. ``counts`` gives the class sizes where ``labelled`` is a sample already.
    """
    shares = counts if counts is not None else {r[0]: r[1] for r in labelled.where(F.col(label).isin(0, 1)).groupBy(label).count().collect()}
    n1, n0 = shares.get(1, 0), shares.get(0, 0)
    if not n1 + n0:
        return np.zeros(1 << BITS, np.float32), 0.0
    prior = n1 / (n1 + n0)
    first = (F.xxhash64("_id"), F.col("_id"), F.xxhash64("_text"), F.col("_text"))
    picked = [labelled.where(F.col(label) == k).select(F.col(id_column).alias("_id"), F.col(text).alias("_text"), F.col(label).cast("int").alias("_y")).orderBy(*first).limit(max_per_class) for k in (0, 1)]

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = features(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(2), pa.array([x.astype("<i4").tobytes() for x in found], pa.binary())], names=["y", "grams"])

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = [f for f in frames if len(f)]
        rows = [np.frombuffer(x, "<i4") for f in got for x in f["grams"]]
        y = np.concatenate([f["y"].to_numpy() for f in got]) if got else np.zeros(0)
        weights, bias = fit(rows, y, prior)
        yield pd.DataFrame({"weights": [weights.tobytes()], "bias": [bias]})

    sample = picked[0].unionByName(picked[1]).repartition(8, "_id").mapInArrow(extract, "y int, grams binary")
    row = sample.repartition(1).sortWithinPartitions("y", F.xxhash64("grams")).mapInPandas(learn, "weights binary, bias double").first()
    return np.frombuffer(row["weights"], np.float32), row["bias"]


def score(docs: DataFrame, model: tuple[np.ndarray, float], id_column: str = "doc_id", text: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """``id_column``, the columns of ``keep`` and, as ``name``, the model's probability of each whole text.

    Null counts as empty; the empty text has the score of the bias alone. Repeated rows and ids, null
    ids too, are scored each for itself; an empty table gives an empty result. Columns that aren't
    named aren't read; ``name`` must differ from those that are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast((np.asarray(model[0]), float(model[1])))
    kept = [id_column, *(c for c in keep if c != id_column)]
    read = kept if text in kept else [*kept, text]
    rows = docs.select(*[F.col(quoted(c)) for c in read])
    schema = docs.select(*[F.col(quoted(c)) for c in kept]).schema.add(name, "double")
    at, width = read.index(text), len(kept)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        used = weights != 0
        for b in batches:
            data, offsets = packed(b.column(at))
            z = np.full(b.num_rows, bias)
            for i, j in blocks(offsets):
                off = offsets[i : j + 1] - offsets[i]
                row, gram = [], []
                for h, ok in gram_buckets(data[offsets[i] : offsets[j]], off):
                    found = np.flatnonzero(used[h] & ok)
                    row.append(np.searchsorted(off, found, side="right") - 1)
                    gram.append(h[found].astype(np.int64))
                if row:
                    pair = np.unique((np.concatenate(row).astype(np.int64) << BITS) | np.concatenate(gram))
                    z[i:j] += np.bincount(pair >> BITS, weights=weights[pair & ((1 << BITS) - 1)].astype(np.float64), minlength=j - i)
            p = 1 / (1 + np.exp(-np.clip(z, -40, 40)))
            yield pa.RecordBatch.from_arrays([*b.columns[:width], pa.array(p, pa.float64())], names=[*b.schema.names[:width], name])

    return rows.mapInArrow(run, schema)


def held_out(id_column: str, parts: int, out: int) -> F.Column:
    return F.pmod(F.crc32(F.col(id_column).cast("string").cast("binary")), F.lit(parts)) == out


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, parts: int, out: int, per_class: int, id_column: str = "doc_id", text: str = "text") -> tuple[dict[int, int], DataFrame]:
    """Sizes of both classes over all labelled documents, and the texts of the first ``per_class`` ids of each.

    Ids are chosen by a hash among those that aren't held out and stand in both tables, from narrow
    columns alone; then the texts of these are fetched, at most twice ``per_class`` ids, so no text is
    shuffled to find them. A label that is neither 0 nor 1, a null id and an id with both labels don't
    count; repeated labels of an id count once. Returns rows ``(id_column, text, _label)``.
    """
    known = labels.select(F.col(id_column), F.col(label).alias("_label")).where(F.col("_label").isin(0, 1) & F.col(id_column).isNotNull() & ~held_out(id_column, parts, out))
    known = known.groupBy(id_column).agg(F.min("_label").alias("_label"), F.max("_label").alias("_most")).where("_label = _most").drop("_most")
    known = cut(known.join(docs.select(id_column), id_column, "left_semi"))
    counts = {r[0]: r[1] for r in known.groupBy("_label").count().collect()}
    first = [known.where(F.col("_label") == k).orderBy(F.xxhash64(id_column), id_column).limit(per_class) for k in (0, 1)]
    return counts, docs.select(id_column, text).join(F.broadcast(first[0].unionByName(first[1])), id_column)


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", parts: int = 4, out: int = 2, id_column: str = "doc_id", text: str = "text", max_per_class: int = MAX_PER_CLASS) -> tuple[np.ndarray, float]:
    """A model of the labels of rows that aren't held out; see ``labelled_texts`` for those that don't count."""
    counts, sample = labelled_texts(docs, labels, label, parts, out, max_per_class, id_column, text)
    return train(sample, id_column, text, "_label", max_per_class, counts)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every whole text of ``documents``, by a model of the labels of rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select("doc_id", F.coalesce(held_out("doc_id", 4, 2), F.lit(False)).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
