"""The prefix trie against a brute-force one: odd rows, long conversations, each size of block."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandline.llm import op13_prefixes

SCHEMA = "conv_id long, turn long, role string, text string, key string, depth int"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def brute(rows):
    own = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", hashlib.sha256((text or "").encode()).hexdigest(), text or ""))
    turns = {c: [(x[2], x[4]) for x in sorted(v)] for c, v in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c, mine in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        whole = tuple(turns.get(c - c % 100, [])[:h] + mine[h:])
        for d in range(len(whole) + 1):
            nodes[whole[:d]].append(c)
        ends[whole].append(c)
    children = defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for n, members in nodes.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(members) - 1) * len(n[-1][1]) if n else 0
    return sorted(
        ((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n], hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in nodes.items()), key=repr
    )


def made(seed):
    r = random.Random(seed)
    rows = []
    for conv in [*range(0, 240, 3), 100, 7_000_000, 7_000_001]:
        script = r.choice(["ab", "abc", "b", "cab", "abcabcab"])
        for k, x in enumerate(script):
            rows.append((conv, k, r.choice(["user", "user", "user", None]), x * r.randint(1, 2), "odd", 9))
    rows += [(0, None, "system", "first é", "x", 1), (3, 1, "user", "a", "x", 1), (3, 1, "user", "a", "x", 1), (6, 2, None, None, None, None), (None, 1, "user", "lost", "x", 1), (9, 9, "", "", "", 0)]
    rows += [(c, k, "user", f"deep {k}", "x", 1) for c in (500, 600) for k in range(150 + c // 100)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("block", [1, 3, 64])
def test_trie_is_the_brute_one(spark, block):
    rows = made(block)
    got = op13_prefixes.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(5), block)
    assert sorted((tuple(x) for x in got.select(*COLUMNS).collect()), key=repr) == brute(rows)


def test_ancestors_of_long_conversations_do_not_grow_with_their_square(spark):
    rows = [(100, k, "user", f"t{k}") for k in range(2000)]
    chains = op13_prefixes.chains(*op13_prefixes.rebuilt(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    made = chains.agg(F.sum(F.size("path") + F.size("above") + F.size("tops"))).first()[0]
    assert made < 2001 * (op13_prefixes.BLOCK + 2)


def test_pieces_of_end_lists_join_in_order(spark):
    ids = [-5000, -1, 0, 4095, 4096, 9, 12288, 1 << 40]
    ends = spark.createDataFrame([(bytearray(b"k"), i) for i in ids] + [(bytearray(b"l"), 3)], "key binary, conv_id long").repartition(4)
    got = {bytes(r.key): r.ends_sha256 for r in op13_prefixes.end_hashes(ends).collect()}
    assert got == {b"k": hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest(), b"l": hashlib.sha256(b"3").hexdigest()}


def test_no_conversation(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    lost = spark.createDataFrame([(None, 1, "user", "x")], "conv_id long, turn long, role string, text string")
    assert op13_prefixes.prefix_trie(empty).count() == 0 and op13_prefixes.prefix_trie(lost).count() == 0
