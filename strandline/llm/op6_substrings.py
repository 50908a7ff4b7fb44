"""Repeated substrings across documents, by prefix-free parsing and suffix order of the dictionary."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import blocks, mix, packed, partitions, powers, prefix_sums, span_hashes

LENGTH = 50
#: A window opens a phrase if its hash is a multiple of this, so phrases have about as many bytes besides the overlap.
TRIGGER = 256
#: Bytes of text that a dictionary is made of.
CHUNK = 32 << 20
#: Bytes of the seed that says where a window is compared.
SEED = 12
#: Windows of a bucket that are compared at a time; a bucket with more goes in rounds by their hashes.
ROUND = 4 << 20
#: Bytes of text in one bucket, on average; there are 16 buckets a partition at least.
BUCKET_BYTES = 4 << 20


def window_hashes(sums: np.ndarray, n: int) -> np.ndarray:
    """The rolling hash of each window of n bytes."""
    _, down = powers(len(sums))
    return mix((sums[n:] - sums[:-n]) * down[: len(sums) - n])


def phrase_starts(hashes: np.ndarray, trigger: int = TRIGGER) -> np.ndarray:
    """Where a window's rolling hash is a trigger. A phrase runs from one to the next one's last byte but one."""
    return hashes % np.uint64(trigger) == 0


def seed_places(sums: np.ndarray, length: int = LENGTH, seed: int = SEED) -> np.ndarray:
    """For each window of ``length`` bytes, where in the text its least seed starts, the first of equal ones."""
    keys = (window_hashes(sums, seed) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(sums) - seed, dtype=np.uint64)
    span, done = length - seed + 1, 1
    while 2 * done <= span:
        keys = np.minimum(keys[:-done], keys[done:])
        done *= 2
    if done < span:
        keys = np.minimum(keys[: len(keys) - (span - done)], keys[span - done :])
    return (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edge = np.zeros(len(flags) + 2, np.int8)  # a byte a flag: a list beside them would make it eight
    edge[1:-1] = flags
    edge = np.diff(edge)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def pack_pieces(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray) -> bytes:
    """Pieces in the order of their documents in few bytes: ids by their differences, starts and sizes as narrow as they may be."""
    return b"".join([np.diff(doc, prepend=0).astype("<i8").tobytes(), tag.astype("<u4").tobytes(), start.astype("<u4").tobytes(), size.astype("<u2").tobytes()])


def unpack_pieces(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(raw) // 18
    doc = np.cumsum(np.frombuffer(raw, "<i8", n))
    tag, start = (np.frombuffer(raw, "<u4", n, at).astype(np.int64) for at in (8 * n, 12 * n))
    return doc, tag, start, np.frombuffer(raw, "<u2", n, 16 * n).astype(np.int64)


def parse(batch: pa.RecordBatch, buckets: int, length: int = LENGTH) -> Iterator[tuple[int, bytes, bytes]]:
    """What a batch of ``(tag, id, text)`` has to compare: rows ``(bucket, meta, body)``.

    Documents are taken in the order of their ids and parsed into phrases that overlap by
    ``length - 1`` bytes, so each window lies in one phrase. The dictionary holds each phrase once,
    with the smallest id that has it: in a later document it is repeated as a whole. Phrases of the
    dictionary are cut where the least seed of their windows changes, so equal windows have equal
    seeds and meet in the seed's bucket; pieces that recur in the batch are kept once as well. Rows
    of bucket -1 hold ``(id, tag, start, end)`` of the windows known to be repeated.
    """
    ids = np.asarray(batch.column(1))
    order = np.argsort(ids, kind="stable")
    batch = batch.take(pa.array(order))
    ids, tags = ids[order], np.asarray(batch.column(0))
    data, offsets = packed(batch.column(2))
    phrases: dict[bytes, int] = {}
    known: list[tuple[np.ndarray, ...]] = []
    parts: list[tuple[np.ndarray, ...]] = []
    for i, j in blocks(offsets):
        base = offsets[i]
        part, off = data[base : offsets[j]], offsets[i : j + 1] - base
        if len(part) < length:
            continue
        sums = prefix_sums(part)
        hashes = window_hashes(sums, length)
        inside = np.ones(len(hashes), bool)
        for back in range(1, length):
            at = off[1:-1] - back
            inside[at[(at >= 0) & (at < len(hashes))]] = False
        first = phrase_starts(hashes)
        first[off[:-1][off[:-1] < len(hashes)]] = True
        opened = np.flatnonzero(first & inside)
        if not len(opened):
            continue
        row = np.searchsorted(off, opened, side="right") - 1
        last = np.minimum(np.append(opened[1:], len(hashes)), off[row + 1] - length + 1)
        raw = memoryview(part)
        fresh = np.ones(len(opened), bool)
        for k, (a, b, doc) in enumerate(zip(opened.tolist(), (last + length - 1).tolist(), ids[i + row].tolist(), strict=True)):
            if phrases.setdefault(xxhash.xxh3_128_digest(raw[a:b]), doc) < doc:
                fresh[k] = False
        old = ~fresh
        known.append((ids[i + row[old]], tags[i + row[old]], (opened - off[row])[old], (last - off[row])[old]))
        place = seed_places(sums, length)
        depth = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(depth, opened[fresh], 1)
        np.add.at(depth, last[fresh], -1)
        live = np.cumsum(depth[:-1]) > 0
        turn = live.copy()
        turn[1:] &= ~live[:-1] | first[1:] | (place[1:] != place[:-1])
        begin = np.flatnonzero(turn)
        if not len(begin):
            continue
        stop = live & ~np.append(live[1:], False)
        stop[:-1] |= live[:-1] & turn[1:]
        end = np.flatnonzero(stop) + 1
        row = np.searchsorted(off, begin, side="right") - 1
        seed = span_hashes(sums, place[begin], place[begin] + SEED) % np.uint64(buckets)
        parts.append((begin + base, end - begin + length - 1, i + row, span_hashes(sums, begin, end + length - 1), seed.astype(np.int32)))
    if parts:
        begin, size, row, content, bucket = (np.concatenate(x) for x in zip(*parts, strict=True))
        parts.clear()
        doc = ids[row]
        # only pieces whose hash recurs are compared byte by byte, with the one of the smallest id
        order = np.lexsort((doc, content))
        head = np.concatenate([[True], content[order][1:] != content[order][:-1]])
        lead = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
        keep = np.ones(len(begin), bool)
        raw = memoryview(data)
        for k, m in zip(order[~head].tolist(), lead[~head].tolist(), strict=True):
            if doc[m] < doc[k] and size[m] == size[k] and raw[begin[m] : begin[m] + size[m]] == raw[begin[k] : begin[k] + size[k]]:
                keep[k] = False
        start = begin - offsets[row]
        old = ~keep
        known.append((doc[old], tags[row[old]], start[old], (start + size - length + 1)[old]))
        kept = np.flatnonzero(keep)
        kept = kept[np.argsort(bucket[kept], kind="stable")]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[kept])) + 1, [len(kept)]])
        squeeze = zstandard.ZstdCompressor(level=3)
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            own = kept[a:b]
            if len(own):
                n = size[own]
                at = np.repeat(begin[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
                yield int(bucket[own[0]]), squeeze.compress(pack_pieces(doc[own], tags[row[own]], start[own], n)), squeeze.compress(data[at].tobytes())
    if known:
        flat = np.stack([np.concatenate(x) for x in zip(*known, strict=True)])
        if flat.shape[1]:
            yield -1, zstandard.compress(flat.astype("<i8").tobytes()), b""


def suffix_classes(body: np.ndarray, at: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``at`` in the order of the ``length`` bytes from there, and the number of each one's class of equals.

    The order is lexicographic, by big-endian words of eight bytes.
    """
    keys = []
    for k in range(0, length, 8):
        word = np.zeros(len(at), np.uint64)
        for c in range(8):
            byte = body[at + k + c] if k + c < length else np.uint8(0)
            word = (word << np.uint64(8)) | byte
        keys.append(word)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(at), bool)
    for word in keys:
        new[1:] |= word[order][1:] != word[order][:-1]
    return at[order], np.cumsum(new)


def piece_blocks(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of pieces of about a megabyte, so that what is made of their bytes is never as large as a bucket."""
    return blocks(np.concatenate([[0], np.cumsum(size)]))


def within(begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``begin[k], begin[k] + 1, ...``, ``n[k]`` of them, one range after the other."""
    return np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())


def dictionary(body: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """For each piece of ``body`` the first piece that has the same bytes: the dictionary, and the parse as numbers into it."""
    content = np.empty(len(first), np.uint64)
    for i, j in piece_blocks(size):
        at = first[i:j] - first[i]
        content[i:j] = span_hashes(prefix_sums(body[first[i] : first[j - 1] + size[j - 1]]), at, at + size[i:j])
    order = np.lexsort((size, content))
    new = np.ones(len(order), bool)
    new[1:] = (content[order][1:] != content[order][:-1]) | (size[order][1:] != size[order][:-1])
    entry = np.empty(len(order), np.int64)
    # lexsort is stable, so the head of a run is its first piece
    entry[order] = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    again = np.flatnonzero(entry != np.arange(len(entry)))
    for i, j in piece_blocks(size[again]):
        own = again[i:j]
        n = size[own]
        same = body[within(first[own], n)] == body[within(first[entry[own]], n)]
        other = own[~np.logical_and.reduceat(same, np.cumsum(n) - n)]
        entry[other] = other  # of equal hash only; entries of its own
    return entry


def recurring_windows(body: np.ndarray, first: np.ndarray, size: np.ndarray, length: int, most: int) -> Iterator[np.ndarray]:
    """Where the windows of the given pieces stand whose 64-bit hash isn't alone, those of equal hash in one array.

    More than ``most`` windows go in rounds by the low bits of their hashes, and a round's result in
    parts of about as many rows, so memory besides the pieces is bounded.
    """
    many = size - length + 1
    before = np.cumsum(many) - many
    hashes = np.empty(int(many.sum()), np.uint64)
    for i, j in piece_blocks(size):
        text = body[within(first[i:j], size[i:j])]
        hashes[before[i] : before[j - 1] + many[j - 1]] = window_hashes(prefix_sums(text), length)[within(np.cumsum(size[i:j]) - size[i:j], many[i:j])]
    rounds = -(-len(hashes) // most)
    for turn in range(rounds):
        at = np.flatnonzero(hashes % np.uint64(rounds) == turn) if rounds > 1 else np.arange(len(hashes))
        h = hashes[at]
        order = np.argsort(h)
        at, h = at[order], h[order]
        del order
        same = np.zeros(len(h) + 1, bool)
        same[1:-1] = h[1:] == h[:-1]
        chosen = same[:-1] | same[1:]
        at, new = at[chosen], ~same[:-1][chosen]
        piece = np.searchsorted(before, at, side="right") - 1
        at = first[piece] + at - before[piece]
        heads = np.flatnonzero(new)
        ends = np.append(heads[1:], len(at))
        # classes of equal hash are never cut
        for i, j in blocks(np.concatenate([[0], ends]), max(1, most // 8)) if len(heads) else ():
            yield at[heads[i] : ends[j - 1]]


def repeated_windows(doc: np.ndarray, tag: np.ndarray, start: np.ndarray, size: np.ndarray, body: np.ndarray, length: int = LENGTH, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(id, tag, start, end)`` of runs of windows that also stand in a document with a smaller id.

    ``body`` has the pieces one after the other. Equal pieces are one entry of the dictionary, with the
    least id of the documents that the parse says have it. Entries' windows whose 64-bit hash stands
    alone can't be repeated; the dictionary's suffix order is made of the others, equal neighbours in it
    are a class, and a class has the least id of its entries. The parse takes that back to the
    documents: all of an entry is repeated where it stands in a later document than its first, and
    there a window is repeated if the least id of its class is smaller. Windows are taken in rounds of
    about ``most`` (see ``recurring_windows``).
    """
    most = most or ROUND
    first = np.cumsum(size) - size
    entry = dictionary(body, first, size)
    low = np.full(len(doc), np.iinfo(np.int64).max)
    np.minimum.at(low, entry, doc)
    whole = doc > low[entry]
    owner = np.flatnonzero(entry == np.arange(len(entry)))
    flags = np.zeros(len(body), bool)
    for at in recurring_windows(body, first[owner], size[owner], length, most):
        sorted_at, group = suffix_classes(body, at, length)
        ids = low[np.searchsorted(first, sorted_at, side="right") - 1]
        heads = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1])
        least = np.minimum.reduceat(ids, heads)[group]
        flags[sorted_at[ids > least]] = True
    # a piece ends in length - 1 bytes that open no window, so runs never pass from one piece to the next
    a, b = runs(flags)
    of = np.searchsorted(first, a, side="right") - 1
    found = [(doc[whole], tag[whole], start[whole], (start + size - length + 1)[whole])]
    # the runs of an entry hold for each place where its first document has it
    places = np.flatnonzero(~whole)
    places = places[np.argsort(entry[places], kind="stable")]
    begin, end = np.searchsorted(entry[places], of, "left"), np.searchsorted(entry[places], of, "right")
    n = end - begin
    k = np.repeat(np.arange(len(of)), n)
    there = places[within(begin, n)]
    found.append((doc[there], tag[there], start[there] + (a - first[of])[k], start[there] + (b - first[of])[k]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def repeated_spans(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """``(id, tag, start, end)``: runs of starts of repeated windows of ``docs``, rows of ``(tag, id, text)`` without nulls.

    A tag is 32 bits that tell texts of the same id apart, 0 where no id is repeated.
    """
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    many = buckets or max(16 * partitions(docs.sparkSession), -(-size // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, offsets = packed(b.column(2))
            for i, j in blocks(offsets, CHUNK):
                chunk = b.slice(i, j - i)
                for bucket, meta, body in parse(chunk, many, length):
                    named = bucket if bucket >= 0 else -1 - xxhash.xxh3_64_intdigest(meta) % many  # any task will do
                    yield pa.RecordBatch.from_arrays([pa.array([named], pa.int64()), pa.array([meta], pa.binary()), pa.array([body], pa.binary())], names=["bucket", "meta", "body"])

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        loose = zstandard.ZstdDecompressor()
        if int(pdf["bucket"].iloc[0]) < 0:
            found = np.concatenate([np.frombuffer(loose.decompress(m), "<i8").reshape(4, -1) for m in pdf["meta"]], axis=1)
        else:
            doc, tag, start, size = (np.concatenate(x) for x in zip(*(unpack_pieces(loose.decompress(m)) for m in pdf["meta"]), strict=True))
            body = np.frombuffer(b"".join(loose.decompress(x) for x in pdf["body"]), np.uint8)
            found = repeated_windows(doc, tag, start, size, body, length)
        return pd.DataFrame(dict(zip(("id", "tag", "start", "end"), found, strict=True)))

    return docs.select("tag", "id", "text").mapInArrow(run, "bucket long, meta binary, body binary").groupBy("bucket").applyInPandas(match, "id long, tag long, start long, end long")


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", length: int = LENGTH, keep_text: bool = False) -> DataFrame:
    """One row a document: ``id_column, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept_text`` as bytes.

    Texts are UTF-8 bytes, null counts as empty. A byte goes if it is covered by a ``length``-byte
    string that also starts in a document with a smaller id; all strings are judged on the input.
    Rows that share an id don't remove each other's text; a row with a null id removes nothing and
    loses nothing. Texts shorter than ``length`` stay whole. An empty table gives an empty result.
    """
    key = F.col(id_column).cast("long").alias("id")
    # a tag beside the id costs 4 bytes a phrase, so it is only made where it tells texts apart
    repeated = not docs.select(key).where("id is not null").groupBy("id").count().where("count > 1").isEmpty()
    tag = F.pmod(F.xxhash64(id_column, text), F.lit(1 << 32)) if repeated else F.lit(0).cast("long")
    keyed = docs.select(tag.alias("tag"), key, F.col(text).alias("text"))
    spans = repeated_spans(keyed.where("id is not null and text is not null"), length)
    span = F.shiftleft("start", 32).bitwiseOR(F.col("end") - F.col("start"))
    spans = spans.groupBy("id", "tag").agg(F.collect_list(span).alias("spans"))
    columns = "_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept_text binary" if keep_text else "")

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=1)
        for b in batches:
            data, offsets = packed(b.column(2))
            raw = memoryview(data)
            rows = [small.compress(raw[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], names=["tag", "id", "body"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loose = zstandard.ZstdDecompressor()
        for b in batches:
            body, found = b.column(1), b.column(2)
            total, gone, number, digest, rest = [], [], [], [], []
            for k in range(b.num_rows):
                raw = np.frombuffer(loose.decompress(body[k].as_buffer()), np.uint8)
                kept = raw
                own = found[k].values if found[k].is_valid else None
                n = 0
                if own is not None and len(own):
                    start, size = np.divmod(np.asarray(own), 1 << 32)
                    depth = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(depth, start, 1)
                    np.add.at(depth, start + size + length - 1, -1)
                    covered = np.cumsum(depth[:-1]) > 0
                    n = len(runs(covered)[0])
                    kept = raw[~covered]
                total.append(len(raw))
                gone.append(len(raw) - len(kept))
                number.append(n)
                bytes_ = kept.tobytes()
                digest.append(hashlib.sha256(bytes_).hexdigest())
                if keep_text:
                    rest.append(bytes_)
            out = [b.column(0), *[pa.array(x, pa.int64()) for x in (total, gone, number)], pa.array(digest, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [pa.array(rest, pa.binary())] * keep_text, names=["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text)

    # texts are shuffled compressed
    bodies = keyed.mapInArrow(squeeze, "tag long, id long, body binary")
    joined = bodies.join(spans, ["id", "tag"], "left").select(F.col("id").alias("_id"), "body", "spans")
    return joined.mapInArrow(run, columns).withColumnRenamed("_id", id_column)


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of each of ``documents`` without the 50-byte strings that documents of smaller ids have."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
