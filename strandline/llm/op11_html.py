"""HTML extraction: wrappers of hosts by union-free regular-expression inference, and the main text by them.

A page becomes an expression of its elements, in which repeats are folded and texts are slots. Distinct
expressions of a host are aligned one after the other: what one of two lacks becomes optional, what stands
after itself becomes a repeated group, and texts that differ a slot. The host's expression, with what is known
of the texts in each slot, decides which slots are the main text; each page is then read by it.

Pages of a host that have the same expression are one row with a count, and rows are aligned in rounds of groups
of about ``FAN``, so no task holds a host's pages, whatever share of all they are.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import markup
from .shared import cut

#: Expressions that one task aligns in a round, on average; and how many a task counts before it hands them on.
FAN, HELD = 32, 2048

SEEN = "host string, skeleton string, slots array<struct<n:long,low:long,high:long,chars:long,links:long>>"


def host_of(url: Column) -> Column:
    """The host's name in lower case, without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def bare(items: list) -> list:
    """An expression without what is known of its texts."""
    return [[key, flags, [] if key == markup.SLOT else bare(rest)] for key, flags, rest in items]


def skeletons(pages: DataFrame, host: str = "host", html: str = "html") -> DataFrame:
    """``(host, skeleton, slots)``: each host's distinct expressions, with pages, least and greatest hash, code points and link text of each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, str], list[list]] = {}

        def flush() -> pa.RecordBatch:
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("n", "low", "high", "chars", "links")]))
            rows = [[dict(zip(("n", "low", "high", "chars", "links"), s, strict=True)) for s in own] for own in seen.values()]
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(rows, kind)], names=["host", "skeleton", "slots"])
            seen.clear()
            return out

        for b in batches:
            for name, page in zip(b.column(0), b.column(1), strict=True):
                items = markup.skeleton(markup.parse(page.as_py() or ""))
                own = [s[2] for s in markup.slots(items)]
                key = name.as_py(), json.dumps(bare(items), ensure_ascii=True, separators=(",", ":"))
                seen[key] = [markup.together(x, y, True) for x, y in zip(seen[key], own, strict=True)] if key in seen else own
                if len(seen) >= HELD:
                    yield flush()
        yield flush()

    parts = pages.select(F.col(host).alias("host"), F.col(html)).mapInArrow(run, SEEN)
    at = parts.select("host", "skeleton", F.posexplode_outer("slots").alias("pos", "s"))
    sums = at.groupBy("host", "skeleton", "pos").agg(F.sum("s.n").alias("n"), F.min("s.low").alias("low"), F.max("s.high").alias("high"), F.sum("s.chars").alias("chars"), F.sum("s.links").alias("links"))
    # as many rows as an expression has slots
    own = F.sort_array(F.collect_list(F.struct("pos", "n", "low", "high", "chars", "links")))
    return sums.groupBy("host", "skeleton").agg(F.transform(own, lambda s: F.array(s["n"], s["low"], s["high"], s["chars"], s["links"])).alias("slots"))


def known(skeleton: str, slots: list) -> list:
    """The expression of a row of ``skeletons``."""
    items = json.loads(skeleton)
    for s, own in zip(markup.slots(items), slots, strict=False):
        s[2] = [int(x) for x in own]
    return items


def expressions(pages: DataFrame, host: str = "host", html: str = "html", fan: int = FAN) -> DataFrame:
    """``(host, expression)``: the union-free expression of each host's pages as JSON, with what is known of each slot's texts."""

    def first(frame: pd.DataFrame) -> pd.DataFrame:
        return joined(frame, [known(s, x) for s, x in zip(frame["skeleton"], frame["slots"], strict=True)])

    def next_(frame: pd.DataFrame) -> pd.DataFrame:
        return joined(frame, [json.loads(s) for s in frame["skeleton"]])

    def joined(frame: pd.DataFrame, found: list[list]) -> pd.DataFrame:
        order = sorted(range(len(found)), key=lambda k: frame["skeleton"].iloc[k])
        items = found[order[0]]
        for k in order[1:]:
            items = markup.aligned(items, found[k])
        return pd.DataFrame({"host": [frame["host"].iloc[0]], "skeleton": [json.dumps(items, separators=(",", ":"))]})

    rows = cut(skeletons(pages, host, html))
    step = first
    while True:
        most = rows.groupBy("host").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most // fan) if most > 2 * fan else 1
        rows = rows.groupBy("host", F.pmod(F.xxhash64("skeleton"), F.lit(groups)).alias("group")).applyInPandas(step, "host string, skeleton string")
        if groups == 1:
            return rows.withColumnRenamed("skeleton", "expression")
        rows, step = cut(rows), next_


def infer_wrappers(pages: DataFrame, url: str = "url", html: str = "html", fan: int = FAN) -> DataFrame:
    """``(host, wrapper, pattern)``: what to take of each host's pages, and the expression to read."""

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [json.loads(x.as_py()) for x in b.column(1)]
            wrappers = [json.dumps(markup.choose(x), separators=(",", ":")) for x in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(wrappers, pa.string()), pa.array(list(map(markup.pattern, found)), pa.string())], names=["host", "wrapper", "pattern"])

    named = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html"))
    return expressions(named, fan=fan).select("host", "expression").mapInArrow(decide, "host string, wrapper string, pattern string")


def extract_text(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", fan: int = FAN) -> DataFrame:
    """``(page_id, url, text)``: the main text of each page by its host's wrapper, one line a block.

    Null and empty pages have empty text; pages without a host in their url, or a null url, are one host's.
    Pages of any length are read whole; equal pages and ids are rows each for itself; pages that don't close their
    elements are read as browsers do. An empty table gives an empty result; other columns are not read.
    """
    wrappers = cut(infer_wrappers(pages, url, html, fan).select("host", "wrapper"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels: dict[str, markup.Level] = {}
        for b in batches:
            texts = []
            for page, wrapper in zip(b.column(2), b.column(3), strict=True):
                w = wrapper.as_py()
                if w not in levels:
                    if len(levels) > 256:
                        levels.clear()
                    levels[w] = markup.Level(json.loads(w))
                texts.append(markup.extract(markup.parse(page.as_py() or ""), levels[w]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["_id", "_url", "text"])

    rows = pages.select(F.col(id_column).cast("long").alias("_id"), F.col(url).alias("_url"), F.col(html).alias("_html"), host_of(F.col(url)).alias("host"))
    read = rows.join(wrappers, "host").select("_id", "_url", "_html", "wrapper")
    return read.mapInArrow(run, "_id long, _url string, text string").select(F.col("_id").alias(id_column), F.col("_url").alias(url), "text")


def op11_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all ``pages``."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).withColumn("n_chars", F.char_length("text").cast("long"))
