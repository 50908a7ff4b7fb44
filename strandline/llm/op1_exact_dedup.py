"""Exact dedup with a bucketed cuckoo-filter index of live digests."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, partitions

SLOTS = 4
#: Partial rows that a bucket of the index has on average at most; the number of buckets follows from the input.
BUCKET_ROWS = 50_000


class CuckooFilter:
    """16-bit fingerprints in buckets of four slots, with the full keys kept beside for verification.

    A key may stand in two buckets, the second being the first xor a hash of the fingerprint. An
    insertion that finds no free slot after ``kicks`` displacements doubles the table and refills it
    from the stored keys. ``payload`` holds what belongs to each live key, by its full digest.
    """

    def __init__(self, capacity: int = 64, kicks: int = 64):
        self.kicks = kicks
        self.resizes = 0
        self.payload: dict[bytes, list[int]] = {}
        self._clear(max(2, 1 << int(np.ceil(np.log2(max(capacity, SLOTS) / SLOTS / 0.9)))))

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.rows: list[list[int]] = [[] for _ in range(buckets)]

    def _places(self, key: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(key[-2:], "little") or 1
        first = int.from_bytes(key[-10:-2], "little") & self.mask
        return mark, first, (first ^ (mark * 0x5BD1E995)) & self.mask

    def maybe(self, key: bytes) -> bool:
        """Whether the filter may hold the key; no means no."""
        mark, i, j = self._places(key)
        return mark in self.rows[i] or mark in self.rows[j]

    def holds(self, key: bytes) -> bool:
        """Whether the key is live: a hit of the filter, verified against the stored keys."""
        return self.maybe(key) and key in self.payload

    def _place(self, key: bytes) -> bool:
        mark, i, j = self._places(key)
        for k in (i, j):
            if len(self.rows[k]) < SLOTS:
                self.rows[k].append(mark)
                return True
        at = i
        for turn in range(self.kicks):
            slot = (mark + turn) % SLOTS
            mark, self.rows[at][slot] = self.rows[at][slot], mark
            at = (at ^ (mark * 0x5BD1E995)) & self.mask
            if len(self.rows[at]) < SLOTS:
                self.rows[at].append(mark)
                return True
        return False

    def insert(self, key: bytes, payload: list[int]) -> None:
        self.payload[key] = payload
        if not self._place(key):
            self._grow()

    def _grow(self) -> None:
        while True:
            self.resizes += 1
            self._clear(2 * (self.mask + 1))
            if all(self._place(key) for key in self.payload):
                return

    def delete(self, key: bytes) -> bool:
        """Take out a live key; its fingerprint leaves one of its two buckets."""
        if not self.holds(key):
            return False
        del self.payload[key]
        mark, i, j = self._places(key)
        row = self.rows[i] if mark in self.rows[i] else self.rows[j]
        row.remove(mark)
        return True

    def add(self, key: bytes, low: int, count: int) -> None:
        """Count ``count`` more rows of a key whose smallest id is ``low``."""
        if self.holds(key):
            kept = self.payload[key]
            kept[0], kept[1] = min(kept[0], low), kept[1] + count
        else:
            self.insert(key, [low, count])


def digest(text: str) -> Column:
    """SHA-256 of the text with each run of white space made one space; null counts as empty.

    The expression only touches runs that are not one space already, as those are rare.
    """
    normal = F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")
    return F.sha2(F.encode(normal, "UTF-8"), 256)


def _combine(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield f.groupby("key", sort=False, as_index=False).agg(low=("id", "min"), n=("id", "size"))


def _rows(live: CuckooFilter) -> pd.DataFrame:
    found = live.payload.values()
    return pd.DataFrame({"key": list(live.payload), "keep_id": [x[0] for x in found], "group_size": [x[1] for x in found]}, columns=["key", "keep_id", "group_size"])


def _index(pdf: pd.DataFrame, repeated: bool) -> pd.DataFrame:
    live = CuckooFilter(len(pdf))
    for key, low, n in zip(pdf["key"], pdf["low"], pdf["n"], strict=True):
        live.add(bytes(key), int(low), int(n))
    if repeated:
        for key in [k for k, x in live.payload.items() if x[1] == 1]:
            live.delete(key)
    return _rows(live)


def bucketed(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))


def folded(rows: DataFrame, key: Column, id_column: str) -> DataFrame:
    """``(key, low, n)``: the copies of each batch in one row a digest; rows with a null id or digest are left out."""
    rows = rows.select(key.alias("key"), F.col(id_column).cast("long").alias("id")).where("id is not null and key is not null")
    return rows.mapInPandas(_combine, "key binary, low long, n long")


def live_digests(digested: DataFrame, id_column: str, key: str, buckets: int, repeated: bool = False) -> DataFrame:
    """``(key, keep_id, group_size)`` of each distinct digest, by one cuckoo index a bucket of digests.

    Each batch first folds its copies into one row a digest, so a digest that a third of the rows
    share reaches its bucket as a row a batch. If only ``repeated`` ones are asked for, digests that
    stand alone are deleted from the index once all are in it.
    """
    part = bucketed(folded(digested, F.unhex(key), id_column), buckets)
    return part.groupBy("bucket").applyInPandas(lambda pdf: _index(pdf, repeated), "key binary, keep_id long, group_size long")


def update_index(index: DataFrame, batch: DataFrame, delete: bool = False, key: str = "key", id_column: str = "id", buckets: int = 1024, copies: DataFrame | None = None) -> DataFrame:
    """Insert a batch of ``(key, id)`` into, or delete it from, a ``(key, keep_id, group_size)`` index.

    The index and the batch meet bucket by bucket; each bucket refills its filter from its stored
    keys, applies the batch and returns the live rows. Deletion takes out copies: a digest's
    ``group_size`` falls by the copies that go, and the digest goes with its last one. ``copies``,
    the live ``(key, id)`` rows before the deletion, says which of the batch are live and which id is
    then the smallest; without it each row of the batch counts as a live copy and ``keep_id`` stays.
    Deleting a key that isn't live changes nothing. Rows with a null id or key are left out.
    """
    old = bucketed(index.select("key", F.col("keep_id").alias("low"), F.col("group_size").alias("n")), buckets)
    new = folded(batch, F.col(key), id_column)
    if delete and copies is not None:
        gone = batch.select(F.col(key).alias("key"), F.col(id_column).cast("long").alias("id")).where("id is not null and key is not null")
        held = copies.select(F.col(key).alias("key"), F.col(id_column).cast("long").alias("id")).where("id is not null").join(gone.select("key").distinct(), "key", "left_semi")
        left = held.withColumn("n", F.lit(1)).unionByName(gone.withColumn("n", F.lit(-1))).groupBy("key", "id").agg(F.sum("n").alias("n")).where("n > 0")
        left = left.groupBy("key").agg(F.min("id").alias("low"), F.sum("n").alias("n"))
        new = gone.select("key").distinct().join(left, "key", "left").select("key", F.coalesce("low", F.lit(0)).alias("low"), F.coalesce("n", F.lit(0)).alias("n"))

    known = copies is not None

    def apply(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        live = CuckooFilter(len(a))
        for k, low, n in zip(a["key"], a["low"], a["n"], strict=True):
            live.insert(bytes(k), [int(low), int(n)])
        for k, low, n in zip(map(bytes, b["key"]), b["low"], b["n"], strict=True):
            if not delete:
                live.add(k, int(low), int(n))
            elif live.holds(k):
                kept = live.payload[k]
                kept[0], kept[1] = (kept[0], kept[1] - int(n)) if not known else (int(low), int(n))
                if kept[1] <= 0:
                    live.delete(k)
        return _rows(live)

    return old.groupBy("bucket").cogroup(bucketed(new, buckets).groupBy("bucket")).applyInPandas(apply, "key binary, keep_id long, group_size long")


def exact_dedup(docs: DataFrame, id_column: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row a document with the group of equal texts that it is in.

    Returns ``id_column, keep_id, group_size, kept, text_sha256``. Null text counts as empty; of
    equal texts the row with the smallest id stays, and where ids repeat each of these rows does.
    A row with a null id belongs to no group: it is kept, with a null ``keep_id`` and a size of 1.
    An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    digested = cut(docs.select(F.col(id_column).cast("long").alias("_id"), digest(text).alias("text_sha256")))
    many = buckets or max(partitions(spark), -(-digested.count() // BUCKET_ROWS))
    groups = live_digests(digested, "_id", "text_sha256", many, repeated=True).select(F.lower(F.hex("key")).alias("text_sha256"), "keep_id", "group_size")
    named = F.col("_id").isNotNull()
    keep = F.coalesce("keep_id", "_id")
    return digested.join(groups, "text_sha256", "left").select(
        F.col("_id").alias(id_column),
        F.when(named, keep).alias("keep_id"),
        F.when(named, F.coalesce("group_size", F.lit(1))).otherwise(1).cast("long").alias("group_size"),
        F.coalesce(keep == F.col("_id"), F.lit(True)).alias("kept"),
        "text_sha256",
    )


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of ``documents``."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents
), g AS (
  SELECT text_sha256, min(doc_id) AS keep_id, count(*)::BIGINT AS group_size FROM d GROUP BY 1
)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, d.text_sha256 FROM d JOIN g USING (text_sha256)
"""
