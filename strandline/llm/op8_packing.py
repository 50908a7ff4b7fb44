"""Harmonic packing of tokenised documents into sequences of a fixed capacity."""

from __future__ import annotations

import functools
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut, partitions

CAPACITY = 1024
END = 0
#: Remainders are cut into halves, quarters and so on of the capacity down to this length; what is left stays as it is.
LEAST = 64
#: Chunks in one generation of the store, and the length up to which they are stored: 60 MB or so at most.
CACHE_ENTRIES, CACHE_LENGTH = 400_000, 48
STOPS = (".", ",", ";", ":", "!", "?")
#: How byte-level vocabularies write bytes: printable ones as they are, others from U+0100 on in order.
_PRINTED = {*range(33, 127), *range(161, 173), *range(174, 256)}
_OTHERS = iter(range(256, 512))
BYTE_CHARS = {b: b if b in _PRINTED else next(_OTHERS) for b in range(256)}


class Tokens:
    """Ids of texts under a byte-level BPE of the ``tokenizers`` library, kept by space-led chunk.

    Pre-tokens never cross the start of a run of white space, nor the space before a word, so a text
    without double spaces is cut at its spaces and each chunk is encoded once; other texts are
    encoded whole. The store has two generations of a bounded number of short chunks: what is asked for again moves to the
    younger one, which becomes the older when it is full. It lives as long as its Python worker.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        return array("I", self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _word(self, chunk: str) -> bytes:
        """The ids of one pre-token, by the library's model alone."""
        return array("I", [x.id for x in self.model.tokenize(chunk.encode().decode("latin-1").translate(BYTE_CHARS))]).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        """A space and letters are one pre-token, and a stop after them another, so they skip the library's splitting."""
        stop = chunk[-1:] if chunk[-1:] in STOPS else ""
        word = chunk[: len(chunk) - len(stop)]
        if (word[1:] if word[:1] == " " else word).isalpha() and (word.isascii() or max(word) < "\u0250"):
            return self._word(word) + (self._word(stop) if stop else b"")
        return self._encode(chunk)

    def _find(self, chunk: str) -> bytes:
        if len(chunk) > CACHE_LENGTH:
            return self._chunk(chunk)
        ids = self.young.get(chunk)
        if ids is None:
            ids = self.old.get(chunk)
            if len(self.young) >= CACHE_ENTRIES:
                self.young, self.old = {}, self.young
            self.young[chunk] = ids = self._chunk(chunk) if ids is None else ids
        return ids

    def __call__(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if "  " in text or "\0" in text:
            return self._encode(text)
        parts = text.replace(" ", "\0 ").split("\0")
        found = list(map(self.young.get, parts))
        if None in found:
            for k, ids in enumerate(found):
                if ids is None:
                    found[k] = self._find(parts[k])
        return b"".join(found)


@functools.cache
def tokens(path: str) -> Tokens:
    """One store a worker and vocabulary, so that tasks that follow each other share it."""
    return Tokens(path)


def pieces(n: int, capacity: int = CAPACITY, least: int = LEAST) -> list[tuple[int, int]]:
    """``(start, length)`` of the pieces of n tokens: full sequences, then binary fractions, then a tail."""
    out, at = [], 0
    size = capacity
    while size >= least:
        while n - at >= size:
            out.append((at, size))
            at += size
        size //= 2
    if n > at:
        out.append((at, n - at))
    return out


def _tokenise(batches: Iterator[pa.RecordBatch], path: str, capacity: int, least: int, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    encode = tokens(path)
    end = np.array([END], "<u4").tobytes()
    for batch in batches:
        doc, start, length, crc, total, ids = [], [], [], [], [], []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = encode(text.as_py() or "") + end
            n = len(raw) // 4
            for at, size in pieces(n, capacity, least):
                piece = raw[4 * at : 4 * (at + size)]
                doc.append(doc_id)
                start.append(at)
                length.append(size)
                crc.append(zlib.crc32(piece))
                total.append(n)
                if keep_ids:
                    ids.append(np.frombuffer(piece, "<i4"))
        out = [pa.array(x, pa.int64()) for x in (doc, start, length, crc, total)]
        names = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
        if keep_ids:
            out.append(pa.array(ids, pa.list_(pa.int32())))
            names.append("ids")
        yield pa.RecordBatch.from_arrays(out, names=names)


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text: str = "text", capacity: int = CAPACITY, least: int = LEAST, keep_ids: bool = False) -> DataFrame:
    """One row a piece: ``id_column, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, if asked for, ``ids``.

    A document is its ids and an end id 0. It is cut into full sequences, then into halves, quarters
    and so on of ``capacity`` down to ``least``, and a tail. A piece of length l belongs to the
    harmonic class ``capacity // l``, whose sequences hold just that many pieces; with binary
    fractions they are full. Workers fill sequences independently: pieces are numbered within
    (class, salt) and a class's numbers start where the salts before it end, from counts of
    (class, salt) alone. The pieces that are left over in each class, fewer than its number, are
    bounded by the capacity and not the input (some 4,000 pieces for 1,024); one task lays them into
    sequences, longest first, each where it fits first.

    Null or empty text has the end id alone. Repeated ids are separate documents, told apart by a
    row number; null ids are allowed. An empty table gives an empty result. Extra columns are not read.
    """
    columns = "_id long, start long, length long, ids_crc32 long, doc_tokens long" + (", ids array<int>" if keep_ids else "")
    read = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text"))
    rows = read.mapInArrow(lambda it: _tokenise(it, tokenizer, capacity, least, keep_ids), columns)
    rows = rows.withColumn("_class", F.floor(F.lit(capacity) / F.col("length")).cast("int"))
    rows = cut(rows.withColumn("_salt", F.pmod(F.xxhash64("_id", "start"), F.lit(4 * partitions(docs.sparkSession))).cast("int")))
    counts = rows.groupBy("_class", "_salt").agg(F.count("*").alias("n"))
    by_class = Window.partitionBy("_class").orderBy("_salt")
    counts = counts.withColumn("_before", F.coalesce(F.sum("n").over(by_class.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("n").over(Window.partitionBy("_class")))
    sizes = counts.groupBy("_class").agg(F.first("_all").alias("_all")).withColumn("_bins", F.floor(F.col("_all") / F.col("_class")))
    sizes = sizes.withColumn("_first_bin", F.coalesce(F.sum("_bins").over(Window.orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    plan = cut(counts.drop("n", "_all").join(sizes, "_class"))
    order = Window.partitionBy("_class", "_salt").orderBy(F.col("_id").isNull(), "_id", "start", "length", "doc_tokens", "ids_crc32")
    rows = rows.withColumn("_at", F.row_number().over(order) - 1).join(plan, ["_class", "_salt"])
    rows = rows.withColumn("_at", F.col("_at") + F.col("_before"))
    within = Window.partitionBy("_bin").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    full = rows.where(F.col("_at") < F.col("_bins") * F.col("_class")).withColumn("_bin", F.col("_first_bin") + F.floor(F.col("_at") / F.col("_class")))
    full = full.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)))
    names = [F.col("_id").alias(id_column), "start", "length", "ids_crc32", "doc_tokens"]
    ids = ["ids"] if keep_ids else []
    filled = full.select(*names, F.col("_bin").alias("sequence_id"), "offset", *ids)
    rest = rows.where(F.col("_at") >= F.col("_bins") * F.col("_class")).drop("_bins", "_first_bin", "_before")
    bins = sizes.agg(F.coalesce(F.sum("_bins"), F.lit(0)).alias("_bins"))
    rest = rest.select("_id", "start", "length", "ids_crc32", "doc_tokens", "_class", "_at", *ids).crossJoin(F.broadcast(bins))  # one row
    out = f"{id_column} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if keep_ids else "")
    left = rest.groupBy("_bins").applyInPandas(lambda pdf: _lay(pdf, id_column, capacity, ids), out)
    return filled.unionByName(left)


def _lay(pdf: pd.DataFrame, id_column: str, capacity: int, ids: list[str]) -> pd.DataFrame:
    """Lay the leftover pieces into sequences, longest first, each where it fits first."""
    pdf = pdf.sort_values(["_class", "_at"]).reset_index(drop=True)
    room: list[int] = []
    where, offset = [], []
    for size in pdf["length"].tolist():
        k = next((k for k, free in enumerate(room) if free >= size), len(room))
        if k == len(room):
            room.append(capacity)
        where.append(k)
        offset.append(capacity - room[k])
        room[k] -= size
    pdf["sequence_id"] = pdf["_bins"] + np.array(where, np.int64)
    pdf["offset"] = offset
    return pdf.rename(columns={"_id": id_column})[[id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *ids]]


def public_path(name: str = "byte_bpe_50k") -> str:
    """The installed vocabulary as ``tokenizers`` reads it."""
    import public_tokenizers

    return public_tokenizers.path(f"{name}.json")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_path())
