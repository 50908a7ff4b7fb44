"""Language ID: a byte convolutional network, trained in numpy and applied to fixed-length windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .op2_toxicity import held_out
from .shared import blocks, packed

WINDOW = 256
DIM = 8
WIDTHS = (2, 3, 4)
FILTERS = 16
#: Labelled rows of each language that a model is fitted on, about, by a hash; all windows of their texts are learned from.
PER_LANGUAGE = 600
_LETTERS = np.zeros(256, bool)
_LETTERS[[*range(65, 91), *range(97, 123)]] = True


class Network:
    """Byte embedding, convolutions of several widths, max pooling over the window, softmax.

    All kernels are laid into one matrix over the widest window, with zeros where a kernel is
    narrower, so a batch is one product. Byte 0 is padding.
    """

    def __init__(self, classes: list[str], seed: int = 1):
        rng = np.random.default_rng(seed)
        self.classes = classes
        wide = max(WIDTHS)
        self.emb = rng.normal(0, 0.3, (256, DIM)).astype(np.float32)
        self.mask = np.zeros((wide * DIM, FILTERS * len(WIDTHS)), np.float32)
        for k, w in enumerate(WIDTHS):
            self.mask[: w * DIM, k * FILTERS : (k + 1) * FILTERS] = 1
        self.kernel = (rng.normal(0, 0.3, self.mask.shape) * self.mask).astype(np.float32)
        self.bias = np.zeros(self.mask.shape[1], np.float32)
        self.out = rng.normal(0, 0.1, (self.mask.shape[1], len(classes))).astype(np.float32)
        self.out_bias = np.zeros(len(classes), np.float32)

    def _columns(self, windows: np.ndarray) -> np.ndarray:
        e = self.emb[windows]
        wide = max(WIDTHS)
        m = windows.shape[1] - wide + 1
        return np.concatenate([e[:, k : k + m] for k in range(wide)], axis=2)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        pooled = [np.max(self._columns(windows[i : i + 64]) @ self.kernel, axis=1) for i in range(0, len(windows), 64)]
        return np.maximum(np.concatenate(pooled) + self.bias, 0) @ self.out + self.out_bias

    def gradient(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """The derivative of the mean loss of windows ``x`` of classes ``y``, each weighed by its class."""
        columns = self._columns(x)
        z = columns @ self.kernel
        top = z.argmax(axis=1)
        hidden = np.take_along_axis(z, top[:, None, :], axis=1)[:, 0] + self.bias
        active = np.maximum(hidden, 0)
        u = active @ self.out + self.out_bias
        p = np.exp(u - u.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        du = p * weight[y][:, None] / len(y)
        dh = (du @ self.out.T) * (hidden > 0)
        at = columns[np.arange(len(y))[:, None], top]
        back = dh[:, :, None] * self.kernel.T[None]
        demb = np.zeros_like(self.emb)
        for k in range(max(WIDTHS)):
            byte = np.take_along_axis(x, top + k, axis=1).ravel()
            np.add.at(demb, byte, back[:, :, k * DIM : (k + 1) * DIM].reshape(-1, DIM))
        return {"emb": demb, "kernel": np.einsum("nf,nfk->kf", dh, at) * self.mask, "bias": dh.sum(axis=0), "out": active.T @ du, "out_bias": du.sum(axis=0)}

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 2, batch: int = 64, rate: float = 0.01) -> None:
        """Steps scaled by moments of the gradient, over at least 200 batches; classes count alike."""
        rng = np.random.default_rng(2)
        names = ["emb", "kernel", "bias", "out", "out_bias"]
        state = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in names}
        share = np.bincount(labels, minlength=len(self.classes)) / len(labels)
        weight = (1 / np.maximum(share, 1e-9) / len(self.classes)).astype(np.float32)
        turn = 0
        for _ in range(max(epochs, -(-200 * batch // len(labels)))):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), batch):
                own = order[i : i + batch]
                grad = self.gradient(windows[own], labels[own], weight)
                turn += 1
                for n in names:
                    m, v = state[n]
                    m += 0.1 * (grad[n] - m)
                    v += 0.001 * (grad[n] ** 2 - v)
                    step = rate * (m / (1 - 0.9**turn)) / (np.sqrt(v / (1 - 0.999**turn)) + 1e-8)
                    setattr(self, n, (getattr(self, n) - step).astype(np.float32))


def cut_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all rows, padded with 0; the row and the number of bytes of each. An empty row has none."""
    lengths = np.diff(offsets)
    each = -(-lengths // WINDOW)
    row = np.repeat(np.arange(len(lengths)), each)
    turn = np.arange(len(row)) - np.repeat(np.cumsum(each) - each, each)
    start = offsets[row] + turn * WINDOW
    size = np.minimum(WINDOW, offsets[row + 1] - start)
    at = start[:, None] + np.arange(WINDOW)
    valid = np.arange(WINDOW) < size[:, None]
    return np.where(valid, data[np.minimum(at, max(len(data) - 1, 0))], 0).astype(np.uint8) if len(data) else np.zeros((0, WINDOW), np.uint8), row, size


def train(labelled: DataFrame, id_column: str, text: str, label: str, per_language: int = PER_LANGUAGE) -> Network | None:
    """A network of the languages of ``labelled``, fitted in one task on about ``per_language`` rows of each by a hash of id and text.

    Twice as many rows as that are taken at most, should copies of one row make it so. Rows with a
    null language don't count.
    """
    known = labelled.where(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in known.groupBy(label).count().collect()}
    classes = sorted(counts)
    if not classes:
        return None
    scale = 1 << 20
    share = F.lit(0)
    for name in classes:
        share = F.when(F.col(label) == name, int(min(1.0, per_language / counts[name]) * scale)).otherwise(share)
    hashed = F.xxhash64(F.col(id_column), F.col(text))
    sample = known.where(F.pmod(hashed, F.lit(scale)) < share).select(hashed.alias("h"), F.col(text).alias("t"), F.col(label).alias("l"))
    sample = sample.orderBy("h", "l").limit(2 * per_language * len(classes))

    def learn(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        x, y = [], []
        for f in frames:
            data, offsets = packed(pa.array(f["t"], pa.large_string()))
            windows, row, _ = cut_windows(data, offsets)
            x.append(windows)
            y.append(np.searchsorted(classes, f["l"].to_numpy())[row])
        net = Network(classes)
        if sum(map(len, x)):
            net.fit(np.concatenate(x), np.concatenate(y))
        yield pd.DataFrame({n: [getattr(net, n).tobytes()] for n in ("emb", "kernel", "bias", "out", "out_bias")})

    got = sample.repartition(1).sortWithinPartitions("h", "l").mapInPandas(learn, "emb binary, kernel binary, bias binary, out binary, out_bias binary").first()
    net = Network(classes)
    for n in ("emb", "kernel", "bias", "out", "out_bias"):
        setattr(net, n, np.frombuffer(got[n], np.float32).reshape(getattr(net, n).shape))
    return net


def identify(docs: DataFrame, net: Network | None, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_column, lang_pred, score``: the language of each whole text by the evidence of all its windows.

    Log-probabilities of windows are added in proportion to their bytes. A text that is null, or has
    no letter, or a table without labelled rows has ``und`` with score 0. Repeated rows and ids, null
    ids too, are judged each for itself; an empty table gives an empty result; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in batches:
            data, offsets = packed(b.column(1))
            names: list[str] = []
            scores: list[float] = []
            for i, j in blocks(offsets):
                off = offsets[i : j + 1] - offsets[i]
                part = data[offsets[i] : offsets[j]]
                lengths = np.diff(off)
                seen = np.zeros(len(part) + 1, np.int64)
                np.cumsum(_LETTERS[part], out=seen[1:])
                letter = seen[off[1:]] > seen[off[:-1]]
                for k in np.flatnonzero(~letter & (lengths > 0)):
                    letter[k] = any(map(str.isalpha, part[off[k] : off[k + 1]].tobytes().decode(errors="replace")))
                if model is None:
                    names += ["und"] * (j - i)
                    scores += [0.0] * (j - i)
                    continue
                windows, row, size = cut_windows(part, off)
                total = np.zeros((j - i, len(model.classes)))
                if len(windows):
                    z = model.logits(windows).astype(np.float64)
                    z -= z.max(axis=1, keepdims=True)
                    z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
                    np.add.at(total, row, z * (size / WINDOW)[:, None])
                best = total.argmax(axis=1)
                p = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names += [model.classes[c] if ok else "und" for c, ok in zip(best, letter, strict=True)]
                scores += np.where(letter, p, 0.0).tolist()
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["_id", "lang_pred", "score"])

    return docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text)).mapInArrow(run, "_id long, lang_pred string, score double").withColumnRenamed("_id", id_column)


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text of ``documents``, by a network of rows that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id", 5, 0))
    net = train(known, "doc_id", "text", "lang")
    return identify(docs, net).select("doc_id", F.coalesce(held_out("doc_id", 5, 0), F.lit(False)).alias("held_out"), "lang_pred", "score")
