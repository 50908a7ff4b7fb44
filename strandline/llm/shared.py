"""Helpers that the text operators share: cutting lineage, byte blocks, words and their hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut

#: ``[\x20\x09-\x0D]``, the white space of every operator here.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MULT = 0x9E3779B97F4A7C15 | 1
_BASE = 0xD6E8FEB86659FD93 | 3
_INV = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}


def decided(docs: DataFrame, marks: DataFrame, ids: Column, texts: Column) -> DataFrame:
    """The rows of ``docs`` that stay by ``marks``, rows ``(id, text_key, kept)`` of each of them, decided by row.

    A row goes if a mark of its id and text says so; of rows that are the same in both one stays.
    ``ids`` and ``texts`` make id and key of a row of ``docs``, whatever its other columns are called. Rows with
    a null id stay. Only ids and keys of those that go are shuffled beside the rows.
    """
    names = docs.columns
    rows = docs.select(ids.alias("_i"), F.coalesce(texts, F.lit("")).alias("_k"), *[F.col(quoted(c)).alias(f"_c{n}") for n, c in enumerate(names)])
    marks = cut(marks.select("id", F.coalesce("text_key", F.lit("")).alias("text_key"), "kept").where("id is not null"))
    gone = marks.where("not kept").select("id", "text_key").distinct()
    again = cut(marks.where("kept").groupBy("id", "text_key").count().where("count > 1").drop("count"))
    same = (F.col("_i") == F.col("id")) & (F.col("_k") == F.col("text_key"))
    columns = [F.col(f"_c{n}").alias(c) for n, c in enumerate(names)]
    if again.isEmpty():
        return rows.join(gone, same, "left_anti").select(*columns)
    stay = rows.join(gone.unionByName(again), same, "left_anti").select(*columns)
    whole = F.struct(*[F.col(f"_c{n}") for n in range(len(names))])
    one = rows.join(again, same, "left_semi").groupBy("_i", "_k").agg(F.min_by(whole, F.xxhash64(whole)).alias("_row"))
    return stay.unionByName(one.select(*[F.col("_row").getField(f"_c{n}").alias(c) for n, c in enumerate(names)]))


def quoted(name: str) -> str:
    """A column's name as it stands, with whatever signs."""
    return "`" + name.replace("`", "``") + "`"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def packed(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string or binary column, and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least; rows are never cut."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + limit, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        size = max(n, 1 << 21)
        for name, base in (("up", _BASE), ("down", _INV)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[name] = np.multiply.accumulate(out)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, so that all bits of a sum of products depend on all bytes."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Prefix sums of byte value times base power; the difference of two is a window's polynomial hash."""
    up, _ = powers(len(data))
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def span_hashes(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for each pair."""
    _, down = powers(len(sums))
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def words(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of word bytes, and the index of each row's first word (one more entry at the end)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = is_word[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = w.copy(), w.copy()
    start[1:] &= ~w[:-1] | edge[1:-1]
    end[:-1] &= ~w[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def shingles(data: np.ndarray, offsets: np.ndarray, k: int) -> list[np.ndarray]:
    """For each row, the sorted distinct 64-bit hashes of its k-word shingles.

    Words are runs of bytes other than white space, A-Z lower-cased. A row of fewer words has its
    whole sequence as its only shingle, a row without words none.
    """
    starts, ends, first = words(data, offsets, ~SPACE)
    h = span_hashes(prefix_sums(LOWER[data]), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    if len(h) >= k:
        grams = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            grams = grams * np.uint64(_MULT) + h[j : len(h) - k + 1 + j]
        grams = mix(grams)
    else:
        grams = h[:0]
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(grams[a : b - k + 1]))
        elif b > a:
            whole = h[a : a + 1].copy()
            for j in range(a + 1, b):
                whole = whole * np.uint64(_MULT) + h[j : j + 1]
            out.append(mix(whole + np.uint64(b - a)))
        else:
            out.append(h[:0])
    return out
