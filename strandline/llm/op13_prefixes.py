"""Conversation prefix trie: shared prefixes of conversations as nodes, with what sharing them saves.

Each conversation's turns are chained into prefix digests, every prefix becomes a row, rows of the same depth and
digest are a node, and each node is exploded to its ancestors for sums over subtrees. A node of depth d is
exploded to the ancestors in its own block of ``BLOCK`` depths only; the tops of blocks carry the sums of what is
below them to the tops above and from there into the block, so a conversation of D turns makes at most
``BLOCK * D + (D / BLOCK) ** 2`` rows and not ``D ** 2``. The result is the same for each size of block.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import cut

#: Depths that one explosion to ancestors spans.
BLOCK = 64
#: Every so many conversations begin with turns of the first of them, at most ``MOST_SHARED - 1``.
FAMILY, MOST_SHARED = 100, 6
#: Of an end list, ids of the same range of 2 ** 12 are joined before the list is hashed.
PIECE_BITS = 12
ROWS = 4096

CHAIN = "conv_id long, depth long, key binary, parent binary, path array<binary>, above array<binary>, tops array<binary>, chars long, last boolean"
EMPTY = hashlib.sha256(b"").digest()


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, digest, chars)``: turns from 1 by turn, null first, ties by role and text; a turn is its role and text, null as empty."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), F.sha2(text, 256).alias("digest"), F.char_length(text).cast("long").alias("chars")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    # the role's length goes first, so that no role and text can be mistaken for others
    whole = F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), "role", "digest"), 256))
    return turns.select("conv_id", F.row_number().over(order).alias("pos"), whole.alias("digest"), "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns ``(conv_id, pos, digest, chars)`` of the rebuilt conversations in the order of pos, and all ids.

    Conversation c has the first h turns of conversation c - c % 100 and then its own after its first h, where h is
    crc32 of its decimal id modulo 6.
    """
    turns = cut(numbered_turns(conversations))
    ids = turns.select("conv_id").distinct()
    shared = (F.crc32(F.col("conv_id").cast("string")) % MOST_SHARED).alias("shared")
    own = turns.where(F.col("pos") > shared)
    first = turns.where((F.col("conv_id") % FAMILY == 0) & (F.col("pos") < MOST_SHARED)).withColumnRenamed("conv_id", "base")
    borrowers = ids.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("base"), shared)
    borrowed = borrowers.join(first, "base").where("pos <= shared").select(*turns.columns)
    return own.unionByName(borrowed), ids


def chains(turns: DataFrame, ids: DataFrame, block: int = BLOCK) -> DataFrame:
    """A row for each prefix of each conversation, the empty one too, by chained digests.

    Conversations stream through tasks in the order of their turns; a task keeps the digests of one block and of the
    blocks' tops. ``path`` has the digests from the block's top to the prefix itself; a top also has ``above``, those
    of the block before, and ``tops``, the tops down to itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("depth", pa.int64()), ("key", pa.binary()), ("parent", pa.binary()), ("path", pa.list_(pa.binary())), ("above", pa.list_(pa.binary())), ("tops", pa.list_(pa.binary())), ("chars", pa.int64()), ("last", pa.bool_())])
        out: list[dict] = []
        row: dict | None = None  # the prefix before, which is written when it is known whether it is the last
        path: list[bytes] = []
        tops: list[bytes] = []
        for b in batches:
            for conv, pos, digest, chars in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                if row is not None:
                    out.append(row | {"last": row["conv_id"] != conv})
                above: list[bytes] = []
                if pos == 0:
                    depth, key, parent, path, tops = 0, EMPTY, None, [EMPTY], [EMPTY]
                else:
                    depth, parent = row["depth"] + 1, row["key"]
                    key = hashlib.sha256(struct.pack(">q", depth) + parent + digest).digest()
                    if depth % block:
                        path = [*path, key]
                    else:
                        path, above, tops = [key], path, [*tops, key]
                row = {"conv_id": conv, "depth": depth, "key": key, "parent": parent, "path": path, "above": above, "tops": tops if above else [], "chars": chars}
                if len(out) >= ROWS:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if row is not None:
            yield pa.RecordBatch.from_pylist([*out, row | {"last": True}], schema)

    roots = ids.select("conv_id", F.lit(0).alias("pos"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("chars"))
    ordered = turns.unionByName(roots).select("conv_id", "pos", "digest", "chars").repartition("conv_id").sortWithinPartitions("conv_id", "pos")
    return ordered.mapInArrow(run, CHAIN)


def end_hashes(ends: DataFrame) -> DataFrame:
    """``(key, ends_sha256)`` of rows ``(key, conv_id)``: the hash of each key's ids in order, joined by commas.

    Ids of one range are joined to a piece of at most 2 ** 12 ids; pieces stream through the hash in order, so no list is
    ever whole.
    """
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = ends.groupBy("key", F.shiftright("conv_id", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, hashlib.sha256()
        for b in batches:
            done: list[tuple[bytes, str]] = []
            for k, text in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if k == key:
                    state.update(b",")
                else:
                    if key is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256()
                state.update(text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.binary()), pa.array([x[1] for x in done], pa.string())], names=["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(run, "key binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """One row a node of the trie of rebuilt conversations, by its digest ``key`` and that of its ``parent``.

    ``conv_id`` is the smallest member, ``n_convs`` the number of members, ``n_children`` and ``n_leaves`` those of
    children and of childless nodes below (itself included), ``saved_tokens`` the sum over the subtree of each node's
    members but one times the code points of its last text, ``ends_sha256`` the hash of the ids that end here.

    Null roles and texts count as empty; a null turn comes first; turns of the same number follow each other by role
    and by the text's digest, so repeated rows are turns after each other. Rows without a conv_id belong to
    no conversation. An empty table has no conversation and no node; other columns are not read.
    """
    prefixes = cut(chains(*rebuilt(conversations), block=block))
    same = [F.first(c).alias(c) for c in ("parent", "path", "above", "tops", "chars")]  # the digest says what these are
    nodes = prefixes.groupBy("depth", "key").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *same)
    inner = prefixes.where("not last").select("key").distinct()
    nodes = cut(nodes.join(inner.withColumn("inner", F.lit(True)), "key", "left").select(
        *nodes.columns, F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved")
    ))

    def sums(rows: DataFrame) -> DataFrame:
        return rows.groupBy("key").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))

    in_block = sums(nodes.select(F.explode("path").alias("key"), "leaf", "saved"))
    tops = cut(in_block.join(nodes.where(F.size("tops") > 0).select("key", "tops", "above"), "key"))
    below = sums(tops.select(F.explode("tops").alias("key"), "leaf", "saved")).join(tops.select("key", "above"), "key")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    totals = sums(in_block.unionByName(below.select(F.explode("above").alias("key"), "leaf", "saved"))).join(children, "key", "left")
    ends = end_hashes(prefixes.where("last").select("key", "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return (
        nodes.drop("path", "above", "tops", "chars", "leaf", "saved").join(totals, "key").join(ends, "key", "left").join(parents, "parent", "left")
        .select(
            "key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(EMPTY.hex())).alias("ends_sha256"),
        )
    )


def op13_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prefix trie of all ``conversations``."""
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet")).drop("key", "parent")


#: crc32 isn't among DuckDB's functions: it is made bit by bit over the decimal digits.
ORACLE = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (SELECT conv_id, list(turn ORDER BY pos) AS own FROM t GROUP BY 1),
crc AS (
  SELECT conv_id, 0 AS i, 4294967295::BIGINT AS v FROM c
  UNION ALL
  SELECT conv_id, i + 1, list_reduce(
    list_prepend(xor(v, ascii(substr(conv_id::VARCHAR, i + 1, 1))::BIGINT), range(8)::BIGINT[]),
    lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)
  FROM crc WHERE i < length(conv_id::VARCHAR)
), h AS (
  SELECT conv_id, xor(v, 4294967295::BIGINT) % 6 AS h FROM crc WHERE i = length(conv_id::VARCHAR)
), built AS (
  SELECT c.conv_id, list_concat(list_slice(coalesce(b.own, []), 1, h.h), list_slice(c.own, h.h + 1, len(c.own))) AS turns
  FROM c JOIN h USING (conv_id) LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100
), p AS (
  SELECT conv_id, d AS depth, list_slice(turns, 1, d) AS pre, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), n AS (
  SELECT depth, pre, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256,
    coalesce((count(*) - 1) * length(pre[depth].t), 0) AS saved
  FROM p GROUP BY 1, 2
), k AS (
  SELECT depth - 1 AS depth, list_slice(pre, 1, depth - 1) AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2
), s AS (
  SELECT a AS depth, list_slice(pre, 1, a) AS pre, sum(saved)::BIGINT AS saved_tokens, sum(leaf)::BIGINT AS n_leaves
  FROM (SELECT n.*, CASE WHEN k.pre IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(n.depth + 1)) AS a FROM n LEFT JOIN k USING (depth, pre)) GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM n JOIN s USING (depth, pre) LEFT JOIN k USING (depth, pre) LEFT JOIN n u ON u.depth = n.depth - 1 AND u.pre = list_slice(n.pre, 1, n.depth - 1)
"""
