"""License scans: exact phrases, and short notices within a few edits of a text."""

from __future__ import annotations

import bisect
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The phrases of the base search and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
# Short notices of the fuzzy search, as words, and their labels.
NOTICES = (
    ("licensed under the apache license version 2 0", "apache"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge", "mit"),
    ("redistribution and use in source and binary forms", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under cc by sa 4 0", "cc-by-sa"),
    ("licensed under cc by 4 0", "cc-by"),
    ("this work is licensed under the gnu general public license", "gpl"),
    ("gnu general public license version 3", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("mozilla public license version 2 0", "mpl"),
    ("all rights reserved", "reserved"),
    ("dedicated to the public domain", "public-domain"),
)
#: A notice of n characters may differ by n // 10 edits.
CHARS_PER_ERROR = 10

_kept = np.zeros(256, bool)
_kept[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_TO = bytes((b + 32 if 65 <= b < 91 else b) if _kept[b + 32 if 65 <= b < 91 else b] else 0x20 for b in range(256))
SPAN = "array<struct<label:string,first_word:bigint,n_words:bigint,errors:int,score:double>>"


class Notice:
    """A phrase that may be found with up to ``errors`` edits.

    Cut into ``errors + 1`` parts, one of them stands unchanged in any such place, so the exact
    places of the parts are all that the bounded-error search has to look at.
    """

    def __init__(self, phrase: str, label: str, per_error: int = CHARS_PER_ERROR):
        self.phrase, self.label, self.errors = phrase, label, len(phrase) // per_error
        edges = [len(phrase) * k // (self.errors + 1) for k in range(self.errors + 2)]
        self.seeds = [(a, phrase[a:b]) for a, b in zip(edges, edges[1:], strict=False)]
        self.pattern = regex.compile(f"(?b)(?:{regex.escape(phrase, literal_spaces=True)}){{e<={self.errors}}}")

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """``(start, end, errors)`` of non-overlapping places in ``text``, the best first and of equals the leftmost.

        Each place of a seed gives a window that any match around it lies in. A window whose best
        match overlaps a better one is searched again in the parts that are left of it, so no place
        that doesn't overlap a chosen one is missed.
        """
        windows = set()
        for at, seed in self.seeds:
            p = text.find(seed)
            while p >= 0:
                windows.add((max(0, p - at - self.errors), min(len(text), p - at + len(self.phrase) + self.errors)))
                p = text.find(seed, p + 1)
        heap: list[tuple[int, int, int, int, int]] = []

        def search(a: int, b: int) -> None:
            if b - a >= len(self.phrase) - self.errors and (m := self.pattern.search(text, a, b)):
                heapq.heappush(heap, (sum(m.fuzzy_counts), m.start(), m.end(), a, b))

        for a, b in windows:
            search(a, b)
        out = Disjoint()
        while heap:
            errors, start, end, a, b = heapq.heappop(heap)
            clash = out.overlapping(start, end)
            if clash is None:
                out.add(start, end, errors)
            else:
                search(a, min(clash[0], b))
                search(max(clash[1], a), b)
        return out.spans


class Disjoint:
    """Spans ``(start, end, what)`` in the order of their starts, none of which overlaps another."""

    def __init__(self) -> None:
        self.spans: list[tuple] = []

    def overlapping(self, start: int, end: int) -> tuple | None:
        k = bisect.bisect_left(self.spans, end, key=lambda s: s[0])
        return self.spans[k - 1] if k and self.spans[k - 1][1] > start else None

    def add(self, start: int, end: int, what: object) -> None:
        self.spans.insert(bisect.bisect_left(self.spans, start, key=lambda s: s[0]), (start, end, what))


def normalise(raw: bytes) -> tuple[str, int]:
    """A text's words with a space before and after each, and their number."""
    found = raw.translate(_TO).split()
    return " " + b" ".join(found).decode() + " " if found else " ", len(found)


def places(text: str, phrase: str) -> list[int]:
    """Word numbers at which the phrase's words stand one after the other."""
    out, needle, p, seen, upto = [], f" {phrase} ", -1, -1, 0
    while (p := text.find(needle, p + 1)) >= 0:
        seen, upto = seen + text.count(" ", upto, p + 1), p + 1
        out.append(seen)
    return out


def best_spans(spans: list[dict]) -> list[dict]:
    """Of spans that overlap those with the best score, then the most words; in the order of the text."""
    kept = Disjoint()
    for s in sorted(spans, key=lambda s: (-s["score"], -s["n_words"], s["first_word"], s["label"])):
        if kept.overlapping(s["first_word"], s["first_word"] + s["n_words"]) is None:
            kept.add(s["first_word"], s["first_word"] + s["n_words"], s)
    return [s[2] for s in kept.spans]


def word_spans(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """``(first_word, n_words, errors)`` of places of normalised text, widened to whole words."""
    spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 0x20) if found else np.zeros(0, np.int64)
    out = []
    for start, end, errors in found:
        first = max(int(np.searchsorted(spaces, start, "right")) - 1, 0)
        last = int(np.searchsorted(spaces, end - 1, "left")) - 1
        out.append((first, last - first + 1, errors))
    return out


def scan_licenses(docs: DataFrame, id_column: str = "doc_id", text: str = "text", phrases: tuple = PHRASES, notices: tuple = NOTICES) -> DataFrame:
    """One row a document: ``id_column, n_words, base, fuzzy``, both lists of spans.

    A span has a label, its first word (from 0), its number of words, its edits and its score, which
    is 1 less the share of edits in the notice's characters. ``base`` has each place where a phrase's
    words stand one after the other, whatever is between them; ``fuzzy`` the best places of
    notices within their edits, over the words joined by single spaces, widened to whole words and
    without overlaps. Null counts as empty and has no word; repeated rows and ids, null ids too, are
    scanned each for itself; an empty table gives an empty result; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = [Notice(*n) for n in notices]
        for b in batches:
            n_words, base, fuzzy = [], [], []
            for value in b.column(1):
                words, n = normalise(value.as_buffer().to_pybytes() if value.is_valid else b"")
                n_words.append(n)
                base.append([{"label": label, "first_word": w, "n_words": phrase.count(" ") + 1, "errors": 0, "score": 1.0} for phrase, label in phrases for w in places(words, phrase)])
                spans = []
                for s in searches:
                    spans += [{"label": s.label, "first_word": w, "n_words": k, "errors": e, "score": 1 - e / len(s.phrase)} for w, k, e in word_spans(words, s.find(words))]
                fuzzy.append(best_spans(spans))
            kind = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int32()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(base, kind), pa.array(fuzzy, kind)], names=["_id", "n_words", "base", "fuzzy"])

    read = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text))
    return read.mapInArrow(run, f"_id long, n_words long, base {SPAN}, fuzzy {SPAN}").withColumnRenamed("_id", id_column)


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of every whole text of ``documents``."""
    spans = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    labels = lambda x: F.concat_ws(",", F.array_sort(F.array_distinct(x)))
    scores = F.concat(F.transform("base", lambda s: s["score"]), F.transform("fuzzy", lambda s: s["score"]))
    return spans.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min(F.col("base.first_word")).alias("first_word"), F.array_max(F.col("base.first_word")).alias("last_word"),
        labels(F.col("base.label")).alias("base_labels"), labels(F.concat(F.col("base.label"), F.col("fuzzy.label"))).alias("labels"),
        F.coalesce(F.array_max(scores), F.lit(0.0)).alias("score"),
    )
