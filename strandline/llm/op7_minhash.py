"""MinHash near-dedup with min-max signatures, verified on full shingle sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components, least_ids
from .shared import blocks, cut, packed, partitions, shingles

PERMUTATIONS = 63
BANDS = 21
#: Members of a bucket that one task compares at a time; a larger bucket is dealt out as pairs of such blocks.
BLOCK = 256
#: Log2 of the most bits of the bitmap of candidates.
MOST_BITS = 27
#: Texts of candidates in one comparing task, on average; there are 32 tasks a partition at least.
PART_TEXTS = 512

_rng = np.random.default_rng(7)
_A = (_rng.integers(1, 1 << 62, PERMUTATIONS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)


def min_max_signature(grams: np.ndarray, permutations: int = PERMUTATIONS) -> np.ndarray:
    """The minimum and the maximum of a set under each permutation, as two values a permutation.

    Both ends agree between two sets with a probability of their Jaccard similarity, so the share of
    equal values estimates it without bias from half the hash evaluations.
    """
    out = np.empty(2 * permutations, np.uint64)
    for k in range(permutations):
        h = grams * _A[k] + _B[k]
        h ^= h >> np.uint64(29)
        out[2 * k], out[2 * k + 1] = h.min(), h.max()
    return out


def signatures(docs: DataFrame, words: int, bands: int, id_column: str, text: str) -> DataFrame:
    """``(id, text_hash, n_shingles, key, bands)``: a 128-bit digest of the set and one 64-bit hash a band of its signature."""
    wide = 2 * PERMUTATIONS // bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, offsets = packed(b.column(1))
            for i, j in blocks(offsets):
                sets = shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)
                keys, hashes = [], []
                for s in sets:
                    keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                    sig = min_max_signature(s).tobytes() if len(s) else b""
                    hashes.append([xxhash.xxh3_64_intdigest(sig[8 * k * wide : 8 * (k + 1) * wide], seed=k) - (1 << 63) for k in range(bands)] if sig else [])
                out = [b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), pa.array(hashes, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(out, names=["id", "text_hash", "n_shingles", "key", "bands"])

    return docs.select(F.col(id_column).cast("long").alias("id"), F.col(text), F.xxhash64(text)).mapInArrow(run, "id long, text_hash long, n_shingles long, key binary, bands array<long>")


def stars(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Stars that join the same rows as the links between n rows, given as an array of pairs."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(find(x), x) for x in range(n) if find(x) != x]


def verified_links(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_hundred: int) -> np.ndarray:
    """Pairs (i in left, j in right, i <> j) with 100 * intersection >= per_hundred * union.

    Sets are rows of an incidence matrix over the hashes that two of them share, multiplied in
    slices of columns, so memory is bounded by the block.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    _, column, times = np.unique(grams, return_inverse=True, return_counts=True)
    shared = times[column] > 1
    owner, column = owner[shared], column[shared]
    place = np.cumsum(np.bincount(column, minlength=len(times)) > 0) - 1 if len(times) else np.zeros(0, np.int64)
    column = place[column] if len(column) else column
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.zeros((len(left), len(right)), np.float32)
    wide = 4096
    total = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, total, wide):
        a, b = np.searchsorted(column, [start, start + wide])
        m = np.zeros((len(sets), min(wide, total - start)), np.float32)
        m[owner[a:b], column[a:b] - start] = 1
        both += m[left] @ m[right].T
    both = both.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    hit = 100 * both >= per_hundred * union
    hit &= left[:, None] != right[None, :]
    i, j = np.nonzero(hit)
    return np.stack([left[i], right[j]], axis=1)


def candidate_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(node, text)`` of the rows of ``docs``, ``(id, text_hash, text)``, that ``wanted``, ``(node, id, text_hash)``, names.

    Rows whose id isn't in a bitmap of the wanted ids' hashes are left out before the join shuffles
    texts. The bitmap has 32 bits an id, up to 16 MB, so its broadcast is bounded; where ids are more
    than it can tell apart, more texts are shuffled and the result is the same. It is made of blocks
    of 4 KB by ``bitmap_construct_agg``.
    """
    n = wanted.count()
    bits = 1 << min(max(32 * n, 1 << 20).bit_length(), MOST_BITS)
    place = F.pmod(F.xxhash64("id", F.lit(5)), F.lit(bits))
    block, bit = F.bitmap_bucket_number(place), F.bitmap_bit_position(place)
    bitmap = wanted.groupBy(block.alias("_block")).agg(F.bitmap_construct_agg(bit).alias("_bitmap"))
    byte = F.conv(F.hex(F.substring("_bitmap", (F.col("_bit") / 8).cast("int") + 1, 1)), 16, 10).cast("int")
    inside = docs.withColumn("_bit", bit).join(F.broadcast(bitmap), block == F.col("_block")).where(F.getbit(byte, (F.col("_bit") % 8).cast("int")) == 1)
    found = wanted.join(inside.select("id", "text_hash", "text").dropDuplicates(["id", "text_hash"]), ["id", "text_hash"])
    return cut(found.select("node", "text"))


def compare(texts: DataFrame, groups: DataFrame, words: int, per_hundred: int) -> DataFrame:
    """Links ``(a, b)`` within groups: stars that join what those join that hold between side 1 and side 2, or among all of side 0.

    ``texts`` is ``(node, text)`` and ``groups`` ``(node, g, side)``. Groups are small and share calls.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: set[tuple[int, int]] = set()
        data, offsets = packed(pa.array(pdf["text"], pa.large_string()))
        sets = [s for i, j in blocks(offsets) for s in shingles(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], words)]
        every, sides = pdf["node"].to_numpy(), pdf["side"].to_numpy()
        for at in pdf.groupby("g", sort=False).indices.values():
            ids, side = every[at], sides[at]
            found = verified_links([sets[k] for k in at], np.flatnonzero(side != 2), np.flatnonzero(side != 1), per_hundred)
            out.update((int(ids[a]), int(ids[b])) for a, b in stars(found, len(ids)))
        return pd.DataFrame(sorted(out), columns=["a", "b"], dtype="int64")

    many = max(32 * partitions(texts.sparkSession), -(-texts.count() // PART_TEXTS))
    rows = groups.join(texts, "node").withColumn("part", F.pmod(F.xxhash64("g"), F.lit(many)))
    return rows.groupBy("part").applyInPandas(run, "a long, b long")


def near_components(banded: DataFrame, fetch: Callable[[DataFrame], DataFrame], words: int, per_hundred: int, block: int = BLOCK) -> DataFrame:
    """``(node, component)`` of the verified links between candidates; nodes without candidates are left out.

    ``banded`` is ``(node, bucket)``; nodes that share a bucket are candidates, and ``fetch`` gives the
    ``(node, text)`` of those, once. A chain of candidates of at most ``block`` nodes is compared in full,
    each text read once. A longer chain is dealt at random into blocks, each compared in full with up
    to four of the chain's members besides, so rows stay in proportion to members. Where a bucket is
    then in one component, as a group of copies is, nothing more can join; otherwise its members
    outside its largest component are compared with all its members, in pairs of blocks. So no link
    between candidates is lost for what components need.
    """
    # written, so that Spark can split a hot bucket's rows where they meet their minimum
    low = cut(banded.groupBy("bucket").agg(F.min("node").alias("low"), F.count("*").alias("n")).where("n > 1").drop("n"))
    shared = cut(banded.join(low, "bucket").select("node", "bucket", "low"))
    chains = connected_components(shared.where("node <> low").select(F.col("node").alias("a"), F.col("low").alias("b")))
    sizes = chains.groupBy("component").agg(F.ceil(F.count("*") / F.lit(block)).cast("int").alias("blocks"))
    chains = cut(chains.join(sizes, "component").select("node", F.col("component").alias("chain"), "blocks"))
    texts = fetch(chains.select("node"))
    own = chains.withColumn("own", F.pmod(F.xxhash64("node", F.lit(9)), F.col("blocks")).cast("int"))
    leads = chains.where("blocks > 1").groupBy("chain", "blocks").agg(F.array(*[F.min(F.struct(F.xxhash64("node", F.lit(k)).alias("h"), "node"))["node"] for k in range(4)]).alias("leads"))
    leads = leads.select(F.explode(F.array_distinct("leads")).alias("node"), "chain", "blocks").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = own.select("node", "chain", "own").unionByName(leads.select("node", "chain", "own")).distinct()
    links = cut(compare(texts, rows.select("node", F.xxhash64("chain", "own").alias("g"), F.lit(0).alias("side")), words, per_hundred))
    parts = connected_components(links)
    large = chains.where("blocks > 1").select("node")
    if large.isEmpty():
        return parts
    parts = cut(parts)
    large = shared.join(large, "node", "left_semi").select("node", "bucket")
    labelled = cut(large.join(parts, "node", "left").select("node", "bucket", F.coalesce("component", "node").alias("component")))
    counts = labelled.groupBy("bucket", "component").agg(F.count("*").alias("c"))
    main = counts.groupBy("bucket").agg(F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("kinds"), F.sum("c").alias("n"), F.max("c").alias("most")).where("kinds > 1")
    main = cut(main.select("bucket", "main", F.ceil((F.col("n") - F.col("most")) / F.lit(block)).cast("int").alias("other"), F.ceil(F.col("most") / F.lit(block)).cast("int").alias("blocks")))
    open_ = labelled.join(main, "bucket").withColumn("inside", F.col("component") == F.col("main"))
    open_ = cut(open_.withColumn("own", F.pmod(F.xxhash64("node", F.lit(11)), F.when(F.col("inside"), F.col("blocks")).otherwise(F.col("other"))).cast("int")))
    if open_.isEmpty():
        return parts
    against = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    beside = F.explode(F.sequence(F.lit(0), F.col("other") - 1))
    outer = open_.where("not inside")
    pairs = outer.withColumn("w", against).select("node", F.xxhash64("bucket", F.lit(0), "own", "w").alias("g"), F.lit(1).alias("side"))
    pairs = pairs.unionByName(open_.where("inside").withColumn("w", beside).select("node", F.xxhash64("bucket", F.lit(0), "w", "own").alias("g"), F.lit(2).alias("side")))
    pairs = pairs.unionByName(outer.withColumn("w", beside).select("node", F.xxhash64("bucket", F.lit(1), F.least("own", "w"), F.greatest("own", "w")).alias("g"), F.lit(0).alias("side")))
    return connected_components(links.unionByName(compare(texts, pairs.distinct(), words, per_hundred)))


def near_dedup(docs: DataFrame, words: int = 5, per_hundred: int = 80, bands: int = BANDS, id_column: str = "doc_id", text: str = "text", one: bool = False) -> DataFrame:
    """One row a document: ``id_column, n_shingles, component_id, kept, text_hash``.

    A document's set holds its distinct ``words``-word shingles; one of fewer words has its whole
    sequence as its only shingle, and one without words or text links with nothing. Documents with
    equal sets are one class, and only classes are compared. Those that agree on a band of min-max
    values are candidates, and linked if 100 * intersection >= per_hundred * union on the full sets,
    which are made again from the text. A component's id is the smallest document id of its rows.

    Each row is a node of its own: rows that share an id but not a text may be in different
    components. Rows with a null id are kept with a null component and link nothing. An empty table
    gives an empty result. ``text_hash`` is ``xxhash64`` of the text, to tell rows of an id apart;
    ``kept`` holds for rows with the component's id, or, with ``one``, only those of its first text hash.
    """
    signed = cut(signatures(docs, words, bands, id_column, text))
    first = F.min(F.struct("id", "text_hash"))
    classes = signed.where("id is not null and n_shingles > 0").groupBy("key").agg(first.alias("first"), F.first("bands").alias("bands"))
    classes = cut(classes.select(F.monotonically_increasing_id().alias("node"), "key", "first.*", "bands"))
    banded = classes.select("node", F.explode("bands").alias("bucket")).distinct()
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text")).where("id is not null and text is not null")
    components = cut(near_components(banded, lambda nodes: candidate_texts(texts, classes.select("node", "id", "text_hash").join(nodes, "node", "left_semi")), words, per_hundred))
    named = least_ids(classes.select("node", "key", "id"), components).select("key", "component_id")
    out = signed.select("id", "text_hash", "n_shingles", "key").join(named, "key", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    kept = F.coalesce(component == F.col("id"), F.lit(True))
    out = out.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"), kept.alias("kept"), "text_hash")
    if not one:
        return out
    # several texts of one id may be in a component; rows without words are no copies of others
    out = cut(out)
    rest = out.where(F.col("kept") & F.col(id_column).isNotNull() & (F.col("n_shingles") > 0)).groupBy("component_id").agg(F.min("text_hash").alias("_first"), F.max("text_hash").alias("_last")).where("_first <> _last")
    rest = rest.select(F.col("component_id").alias("_of"), "_first")
    out = out.join(rest, (F.col("component_id") == F.col("_of")) & (F.col("n_shingles") > 0), "left")
    return out.withColumn("kept", F.col("kept") & F.coalesce(F.col("text_hash") == F.col("_first"), F.lit(True))).drop("_of", "_first")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicates of ``documents``: three-word shingles, a similarity of 0.85 or more."""
    return near_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=3, per_hundred=85).drop("text_hash")
