"""Ranked lexical search: document-sharded CSR postings with integer impacts, term-at-a-time accumulators.

``build_index`` writes a table with a row a shard of documents: sorted term hashes, the terms themselves, row
pointers, and for each posting the document's row and its integer impact. ``search`` scores a block of queries
against every shard: the postings of a term are added to a dense accumulator of the shard's documents, the best
of a shard are selected with ties by document, and the best of all shards are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import LOWER, blocks, cut, packed, prefix_sums, span_hashes, words

#: Bytes that terms consist of: 0-9, A-Z, a-z and those of all other than ASCII signs.
IN_TERM = np.zeros(256, bool)
IN_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: Bytes of text in a shard (one document at least), and shards in a file, which bounds what is read at once.
SHARD_BYTES, FILE_SHARDS = 2 << 20, 8
#: Terms of the queries that are scored in one pass over the index; each pass's queries are sent to all tasks.
BLOCK_TERMS = 1 << 16

SHARD = "doc_ids array<long>, hashes binary, terms binary, term_ends binary, pointers binary, rows binary, impacts binary"


def term_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends and hashes of all terms, and the index of each text's first term."""
    flat = LOWER[data]
    starts, ends, first = words(flat, offsets, IN_TERM)
    hashes = span_hashes(prefix_sums(flat), starts, ends) if len(starts) else np.zeros(0, np.uint64)
    return flat, starts, ends, hashes, first


def gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all spans one after the other, and where each ends."""
    until = np.cumsum(ends - starts)
    at = np.arange(int(until[-1]) if len(until) else 0) + np.repeat(starts - (until - (ends - starts)), ends - starts)
    return data[at], until


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Number of documents with a term, and of all terms with repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = size = 0
        for b in batches:
            data, offsets = packed(b.column(0))
            for i, j in blocks(offsets):
                _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], IN_TERM)
                n, size = n + int((np.diff(first) > 0).sum()), size + int(first[-1])
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([size])], names=["n", "size"])

    row = docs.select(F.col(text)).mapInArrow(run, "n long, size long").agg(F.sum("n"), F.sum("size")).first()
    return row[0] or 0, row[1] or 0


def lengths_norm(lengths: list[int], n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of so many terms: 10 for none, 100 for the mean length."""
    return np.array([100 - 90 + 90 * n * n_docs // n_terms if n else 10 for n in lengths], np.int64)


def shard(ids: list[int | None], data: np.ndarray, offsets: np.ndarray, n_docs: int, n_terms: int) -> dict:
    """The CSR postings of some documents, whose rows are in the order of their ids, null last."""
    flat, starts, ends, hashes, first = term_spans(data, offsets)
    lengths = np.diff(first)
    order = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0))
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    rows = np.repeat(rank, lengths)
    at = np.lexsort((rows, hashes))
    rows, sorted_hashes = rows[at], hashes[at]
    new_term = np.ones(len(at), bool)
    new_term[1:] = sorted_hashes[1:] != sorted_hashes[:-1]
    new_posting = new_term.copy()
    new_posting[1:] |= rows[1:] != rows[:-1]
    posting = np.flatnonzero(new_posting)
    tf = np.diff(np.append(posting, len(at)))
    m = lengths_norm(lengths.tolist(), n_docs, n_terms)[order]
    impacts = (1_000_000_000 * tf) // (1000 * tf + 8 * m[rows[posting]])
    terms = at[new_term]
    text, until = gathered(flat, starts[terms], ends[terms])
    return {
        "doc_ids": [ids[k] for k in order],
        "hashes": hashes[terms].tobytes(),
        "terms": text.tobytes(),
        "term_ends": until.astype(np.int64).tobytes(),
        "pointers": np.append(np.flatnonzero(new_term[posting]), len(posting)).astype(np.int64).tobytes(),
        "rows": rows[posting].astype(np.int32).tobytes(),
        "impacts": impacts.astype(np.int32).tobytes(),
    }


class Index:
    """The shards' table and the number of documents with a term."""

    def __init__(self, shards: DataFrame, n_docs: int):
        self.shards, self.n_docs = shards, n_docs


def build_index(docs: DataFrame, id_column: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> Index:
    """Index all terms of all whole texts.

    Null text has no term. Rows that share an id, null ids too, are documents each for itself; equal scores go by
    ascending id, null last. Very long texts make a shard of their own; an empty table has no shard. Other columns are
    not read. Terms of a shard meet by 64-bit hashes and are compared with a query's term by their bytes.
    """
    n_docs, n_terms = totals(docs, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_ids", pa.list_(pa.int64())), *[(c, pa.binary()) for c in ("hashes", "terms", "term_ends", "pointers", "rows", "impacts")]])
        for b in batches:
            data, offsets = packed(b.column(1))
            for i, j in blocks(offsets, shard_bytes):
                yield pa.RecordBatch.from_pylist([shard(b.column(0).slice(i, j - i).to_pylist(), data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n_docs, n_terms)], schema)

    shards = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, SHARD)
    return Index(cut(shards, rows_per_file=FILE_SHARDS), n_docs)


def item_terms(items: DataFrame, id_column: str = "item_id", text: str = "text") -> DataFrame:
    """``(item_id, terms)``: the distinct terms of each item; rows that share an id are one item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = packed(b.column(1))
            flat, starts, ends, _, first = term_spans(data, offsets)
            own = [list({flat[s:e].tobytes() for s, e in zip(starts[i:j].tolist(), ends[i:j].tolist(), strict=True)}) for i, j in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own, pa.list_(pa.binary()))], names=["item_id", "terms"])

    found = items.select(F.col(id_column).cast("long").alias("item_id"), F.col(text)).mapInArrow(run, "item_id long, terms array<binary>")
    return found.select("item_id", F.explode("terms").alias("term")).groupBy("item_id").agg(F.array_sort(F.collect_set("term")).alias("terms"))


class Lookup:
    """Finds the terms of a block of queries in a shard."""

    def __init__(self, terms: list[bytes]):
        self.terms = terms
        sizes = np.array([0, *map(len, terms)], np.int64).cumsum()
        self.hashes = span_hashes(prefix_sums(np.frombuffer(b"".join(terms), np.uint8)), sizes[:-1], sizes[1:])

    def find(self, hashes: bytes, text: bytes, ends: bytes) -> list[tuple[int, int]]:
        """Pairs of a term's number here and in the shard."""
        own, until = np.frombuffer(hashes, np.uint64), np.frombuffer(ends, np.int64)
        if not len(own):
            return []
        at = np.minimum(np.searchsorted(own, self.hashes), len(own) - 1)
        found = np.flatnonzero(own[at] == self.hashes)
        return [(k, p) for k, p in zip(found.tolist(), at[found].tolist(), strict=True) if text[until[p - 1] if p else 0 : until[p]] == self.terms[k]]


def document_counts(index: Index, terms: list[bytes]) -> np.ndarray:
    """In how many documents each term is, over all shards."""
    lookup = Lookup(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(terms), np.int64)
        for b in batches:
            for r in range(b.num_rows):
                hashes, text, ends, pointers = (b.column(k)[r].as_py() for k in range(4))
                size = np.diff(np.frombuffer(pointers, np.int64))
                for k, p in lookup.find(hashes, text, ends):
                    counts[k] += size[p]
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], names=["term", "n"])

    rows = index.shards.select("hashes", "terms", "term_ends", "pointers").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(len(terms), np.int64)
    for r in rows:
        out[r.term] = r.n
    return out


def weight(df: int, n_docs: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Rows of the k highest scores above 0, the first of equal ones."""
    found = np.flatnonzero(scores > 0)
    if len(found) <= k:
        return found
    own = scores[found]
    least = own[np.argpartition(own, len(own) - k)[len(own) - k]]
    above, equal = found[own > least], found[own == least]
    return np.concatenate([above, equal[: k - len(above)]])


def search_block(index: Index, items: list[tuple[int | None, list[bytes]]], k: int) -> DataFrame:
    """``(item, doc_id, score)``: the k best of each task's shards for each item, by its number here."""
    terms = sorted({t for _, own in items for t in own})
    number = {t: n for n, t in enumerate(terms)}
    weights = [weight(n, index.n_docs) for n in document_counts(index, terms).tolist()]
    asked = [[number[t] for t in own] for _, own in items]
    lookup = Lookup(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top: list[list[tuple[int, bool, int]]] = [[] for _ in asked]
        for b in batches:
            for r in range(b.num_rows):
                ids = b.column(0)[r].as_py()
                hashes, text, ends, pointers, rows, impacts = (b.column(c)[r].as_py() for c in range(1, 7))
                until, rows, impacts = np.frombuffer(pointers, np.int64), np.frombuffer(rows, np.int32), np.frombuffer(impacts, np.int32).astype(np.int64)
                slices = {t: (rows[until[p] : until[p + 1]], weights[t] * impacts[until[p] : until[p + 1]]) for t, p in lookup.find(hashes, text, ends)}
                scores = np.zeros(len(ids), np.int64)
                for n, own in enumerate(asked):
                    scores[:] = 0
                    for t in own:
                        if t in slices:
                            at, gain = slices[t]
                            scores[at] += gain
                    here = best(scores, k)
                    if len(here):
                        top[n] = sorted([*top[n], *((-int(scores[x]), ids[x] is None, ids[x] or 0) for x in here)])[:k]
        found = [(n, None if lost else doc, -score) for n, own in enumerate(top) for score, lost, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in range(3)], names=["item", "doc_id", "score"])

    return index.shards.mapInArrow(run, "item long, doc_id long, score long")


def search(index: Index, items: DataFrame, k: int = 10, id_column: str = "item_id", text: str = "text", block_terms: int = BLOCK_TERMS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: each item's k documents of highest score above 0, equal scores by ascending id.

    Items are dealt to blocks of about ``block_terms`` terms; each block is one pass over the index and all that the
    driver holds. Rows that share an item_id, null too, are one item with the terms of all; items without terms, or
    an index without documents, give no rows.
    """
    spark = items.sparkSession
    asked = cut(item_terms(items, id_column, text))
    n_terms = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    many = max(1, -(-n_terms // block_terms))
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
    found = None
    for b in range(many):
        block = [(r.item_id, [bytes(t) for t in r.terms]) for r in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(many)) == b).orderBy("item_id").collect()]
        ids = spark.createDataFrame([(n, i) for n, (i, _) in enumerate(block)], "item long, item_id long")
        ranked = search_block(index, block, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        part = ranked.join(F.broadcast(ids), "item").select("item_id", "rank", "doc_id", "score")  # as many rows as the block's
        part = cut(part) if many > 1 else part
        found = part if found is None else found.unionByName(part)
    return found


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 best of all ``documents`` for each ``benchmark`` item."""
    return search(build_index(spark.read.parquet(f"{sf_dir}/documents.parquet")), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
s AS (SELECT count(*) FILTER (len(w) > 0)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d),
tf AS (SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY 1, 2),
q AS (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
df AS (SELECT t, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM tf, s GROUP BY 1),
m AS (SELECT r, doc_id, 100 - 90 + (90 * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, s WHERE len(w) > 0),
p AS (
  SELECT item_id, doc_id, r, sum(df.w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM q JOIN tf USING (t) JOIN df USING (t) JOIN m USING (r) GROUP BY 1, 2, 3
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM p WHERE score > 0) WHERE rank <= 10
"""
