"""Ranked search against a brute-force one: shards of each size, several passes, ties, odd rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from strandline.llm import op12_search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, item_id string, score int"
ITEMS = "item_id long, text string, doc_id int"


def terms(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    bags = [(d, Counter(terms(t))) for d, t, *_ in docs]
    bags = [(d, b) for d, b in bags if b]
    n, size = len(bags), sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    asked = {}
    for i, t, *_ in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for i, own in asked.items():
        scored = []
        for d, b in bags:
            m = 100 - 90 + 90 * sum(b.values()) * n // size
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * b[t] // (1000 * b[t] + 8 * m)) for t in own if b[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(i, rank, x[3], -x[0]) for rank, x in enumerate(sorted(scored)[:k], 1)]
    return out


def made(seed, n=400):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["Éa", "éa", "ÀB", "x1", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    text = lambda m: r.choice([" ", "-", "\t\n", "_"]).join(r.choices(vocabulary, weights, k=m))
    docs = [(k, text(r.randint(0, 40)), "x", 1) for k in range(n)]
    docs += [(n, None, "x", 1), (None, text(9), "x", 1), (n + 1, "", None, None), (n + 2, " .,;", "x", 1), (n + 3, text(30_000), "x", 1), (5, "W1 w1 w2", "x", 1), (5, "W1 w1 w2", "x", 1)]
    docs += [(1000 + k, "same rare text", "x", 1) for k in range(40)]  # equal scores
    items = [(k, text(r.randint(1, 6)), 0) for k in range(30)] + [(77, "rare", 0), (78, None, 0), (79, "", 0), (80, "nowhere", 0), (3, "RARE also", 0), (None, "w1 text", 0)]
    r.shuffle(docs)
    return docs, items


@pytest.mark.parametrize("shard,block,k", [(1, 1 << 16, 10), (400, 20, 3), (1 << 23, 1 << 16, 10)])
def test_search_is_the_brute_one(spark, shard, block, k):
    docs, items = made(k + block)
    index = op12_search.build_index(spark.createDataFrame(docs, DOCS).repartition(5), shard_bytes=shard)
    got = op12_search.search(index, spark.createDataFrame(items, ITEMS), k, block_terms=block)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(brute(docs, items, k), key=repr)


def test_ties_at_the_last_place_go_by_row():
    scores = np.array([3, 9, 0, 3, 3, 1, 3], np.int64)
    assert sorted(op12_search.best(scores, 3).tolist()) == [0, 1, 3]
    assert sorted(op12_search.best(scores, 20).tolist()) == [0, 1, 3, 4, 5, 6] and len(op12_search.best(scores[2:3], 5)) == 0


def test_no_documents_and_no_items(spark):
    docs, items = spark.createDataFrame(made(1, 9)[0], DOCS), spark.createDataFrame(made(1, 9)[1], ITEMS)
    assert op12_search.search(op12_search.build_index(docs.limit(0)), items).count() == 0
    assert op12_search.search(op12_search.build_index(docs), items.limit(0)).count() == 0


def test_index_holds_all_postings(spark):
    docs, _ = made(4, 50)
    index = op12_search.build_index(spark.createDataFrame(docs, DOCS), shard_bytes=500)
    got = Counter()
    for s in index.shards.collect():
        until = np.frombuffer(s.term_ends, np.int64).tolist()
        names = [bytes(s.terms)[a:b].decode() for a, b in zip([0, *until[:-1]], until, strict=True)]
        p = np.frombuffer(s.pointers, np.int64)
        rows = np.frombuffer(s.rows, np.int32)
        for n, name in enumerate(names):
            got.update((s.doc_ids[x], name) for x in rows[p[n] : p[n + 1]].tolist())
    assert got == Counter((d, t) for d, text, *_ in docs for t in set(terms(text)))
