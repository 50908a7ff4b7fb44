"""The ten operators against brute force and on awkward input."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandline.llm import op1_exact_dedup, op2_toxicity, op3_embeddings, op4_language, op5_quality, op6_substrings, op7_minhash, op8_packing, op9_mixing, op10_licenses
from strandline.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, spans string"
LONG = " ".join(f"w{k % 977}x{k % 31}" for k in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog and runs far away from every hunter in the wood"


def awkward(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "A b\tc  d", "en", "s1"), (2, "A b c\nd", "en", "s1"), (3, None, None, None), (4, "", "fr", "s2"), (5, "   \n ", "fr", "s2"), (6, LONG, "en", "s1"), (7, LONG, None, None),
        (8, "x" + PASSAGE + " one", "en", "s3"), (9, "y" + PASSAGE + " two", "en", "s3"), (9, "y" + PASSAGE + " two", "en", "s3"), (None, PASSAGE, "en", "s1"), (10, "12 34 !!", "de", "s2"),
        (11, "été " * 40, "fr", "s2"), (12, "a", "en", "s1"),
    ]
    return spark.createDataFrame([(*r, 1, 0.5, 7, "z") for r in rows], SCHEMA)


def rows_of(df, key="doc_id"):
    return sorted((r.asDict() for r in df.collect()), key=lambda r: (r[key] is None, r[key] or 0))


def test_cuckoo_filter_inserts_deletes_and_grows():
    live = op1_exact_dedup.CuckooFilter(8)
    keys = [hashlib.sha256(str(k).encode()).digest() for k in range(3000)]
    for k in keys:
        live.add(k, 5, 1)
    assert live.resizes > 0 and all(live.holds(k) for k in keys)
    live.add(keys[0], 2, 3)
    assert live.payload[keys[0]] == [2, 4]
    assert all(live.delete(k) for k in keys[:1000]) and not live.delete(keys[0])
    assert not any(live.holds(k) for k in keys[:1000]) and all(live.holds(k) for k in keys[1000:])
    gone = sum(live.maybe(hashlib.sha256(f"no{k}".encode()).digest()) for k in range(3000))
    assert gone < 60


def test_exact_dedup(spark):
    got = rows_of(op1_exact_dedup.exact_dedup(awkward(spark)))
    groups = {}
    for r in awkward(spark).collect():
        if r.doc_id is not None:
            groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), []).append(r.doc_id)
    want = sorted((d, min(g), len(g), d == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for d in g)
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in got if r["doc_id"] is not None) == want
    assert [(r["keep_id"], r["group_size"], r["kept"]) for r in got if r["doc_id"] is None] == [(None, 1, True)]


def test_index_update(spark):
    key = lambda s: hashlib.sha256(s.encode()).digest()
    index = spark.createDataFrame([(key("a"), 4, 1), (key("b"), 7, 2)], "key binary, keep_id long, group_size long")
    batch = spark.createDataFrame([(key("a"), 2), (key("c"), 9)], "key binary, id long")
    got = {bytes(r.key): (r.keep_id, r.group_size) for r in op1_exact_dedup.update_index(index, batch, buckets=4).collect()}
    assert got == {key("a"): (2, 2), key("b"): (7, 2), key("c"): (9, 1)}
    left = op1_exact_dedup.update_index(index, batch, delete=True, buckets=4).collect()
    assert [bytes(r.key) for r in left] == [key("b")]


def test_toxicity_learns_and_scores_everything(spark):
    docs = spark.createDataFrame([(k, f"the calm river {k} flows " * 5 + ("you stupid moron" if k % 3 == 0 else "you dear friend")) for k in range(240)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    model = op2_toxicity.fit_on(docs, labels)
    got = op2_toxicity.score(docs, model).withColumn("held", op2_toxicity.held_out("doc_id", 4, 2)).where("held").collect()
    assert got and all((r.score >= 0.3) == (r.doc_id % 3 == 0) for r in got)
    odd = op2_toxicity.score(awkward(spark), model, keep=("score",), name="_s").collect()
    assert len(odd) == 14 and all(0 <= r._s <= 1 for r in odd)
    none = op2_toxicity.fit_on(docs.limit(0), labels)
    assert all(0 <= r.score <= 1 for r in op2_toxicity.score(docs, none).collect())


def test_embeddings(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(40, 16))
    x = [b + rng.normal(size=16) * 0.08 for b in base for _ in range(8)] + [rng.normal(size=16) for _ in range(200)]
    rows = [(k, v.astype("f4").tolist()) for k, v in enumerate(x)]
    rows += [(900, rows[3][1]), (900, rows[3][1]), (901, None), (902, [0.0] * 16), (903, [float("nan")] + [1.0] * 15), (904, [None] + [1.0] * 15), (905, []), (906, [1.0, 2.0]), (None, rows[3][1])]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, cell int")
    got = op3_embeddings.near_vectors(df).collect()
    assert len(got) == len(rows)
    good = [(k, np.array(v, float)) for k, v in rows if k is not None and v and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    u = np.stack([v / np.linalg.norm(v) for _, v in good])
    hit = u @ u.T >= 0.9
    want = Counter((k, int(n) - 1) for (k, _), n in zip(good, hit.sum(axis=1), strict=True))
    found = Counter((r.vec_id, r.n_links) for r in got if r.vec_id in {k for k, _ in good})
    assert sum((want & found).values()) >= 0.97 * sum(want.values())
    assert all(r.n_links == 0 and r.component_id == r.vec_id for r in got if r.vec_id in (901, 902, 903, 904, 905, 906))
    assert {r.component_id for r in got if r.vec_id == 900} == {r.component_id for r in got if r.vec_id == 3}
    assert op3_embeddings.near_vectors(df.limit(0)).collect() == []


def links_of(x, threshold=0.9):
    u = np.stack(x) / np.linalg.norm(x, axis=1, keepdims=True)
    return (u @ u.T >= threshold).sum(axis=1) - 1


def test_embeddings_of_small_groups_beside_a_large_one(spark):
    rng = np.random.default_rng(3)
    around = lambda c, n, by: [c + rng.normal(size=16) * by for _ in range(n)]
    x = around(rng.normal(size=16), 1500, 0.01) + [rng.normal(size=16) for _ in range(1500)]
    x += [v for _ in range(375) for v in around(rng.normal(size=16), 4, 0.22)]
    got = {r.vec_id: r.n_links for r in op3_embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    want = links_of(x)
    small = [k for k in range(3000, 4500) if want[k]]
    assert sum(got[k] for k in small) >= 0.985 * sum(want[k] for k in small) and all(got[k] <= want[k] for k in got)


def test_visits_give_each_size_of_group_its_recall():
    large = [(k, 0, 10_000) for k in range(130)]
    small = [(200 + k, 30, 2) for k in range(20)]
    assert op3_embeddings.needed_visits(large + small, 0.995) == 31 and op3_embeddings.needed_visits(large, 0.995) == 1


def test_embeddings_without_a_measure_are_exact(spark, monkeypatch):
    rng = np.random.default_rng(4)
    x = [rng.normal(size=16) for _ in range(900)]
    x += [x[k] + rng.normal(size=16) * 0.25 for k in range(60)]
    for name, value in {"BLOCK": 64, "PROBE_ROWS": (5,), "MOST_VISITS": 4}.items():
        monkeypatch.setattr(op3_embeddings, name, value)
    got = {r.vec_id: r.n_links for r in op3_embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    assert [got[k] for k in range(len(x))] == links_of(x).tolist() and any(got.values())


def test_embeddings_of_each_length(spark):
    rows = [(0, [1.0, 2.0, 3.0]), (1, [1.0, 2.0, 3.1]), (2, [1.0, 2.0]), (3, [1.0, 2.1]), (4, [1.0, 2.1]), (5, [-1.0, 1.0, 0.0, 0.0]), (6, [1.0, 1.0, 1.0]), (7, [5.0, -1.0, 0.0])]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op3_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (2, 0), 1: (2, 0), 2: (2, 2), 3: (2, 2), 4: (2, 2), 5: (0, 5), 6: (2, 0), 7: (0, 7)}


def test_multi_sequence_is_sorted():
    rng = np.random.default_rng(1)
    a, b = rng.random(7), rng.random(5)
    order = op3_embeddings.multi_sequence(a, b, 35)
    sums = [a[c // 5] + b[c % 5] for c in order]
    assert sorted(order) == list(range(35)) and sums == sorted(sums)


def test_language(spark):
    said = {"en": "the house and the river with that thing", "de": "das haus und der fluss mit dem ding", "fr": "la maison et le fleuve avec cette chose"}
    docs = spark.createDataFrame([(k, " ".join(np.random.default_rng(k).permutation(t.split() * 6)), lang) for lang, t in said.items() for k in range(60)], "doc_id long, text string, lang string")
    net = op4_language.train(docs, "doc_id", "text", "lang")
    got = op4_language.identify(docs.withColumn("doc_id", F.monotonically_increasing_id()), net)
    right = docs.withColumn("doc_id", F.monotonically_increasing_id()).join(got, "doc_id").where("lang = lang_pred").count()
    assert right >= 0.97 * 180
    odd = {r.doc_id: r for r in op4_language.identify(awkward(spark), net).collect()}
    assert all(odd[k].lang_pred == "und" for k in (3, 4, 5, 10)) and all(0 <= r.score <= 1 for r in odd.values()) and odd[6].lang_pred in said
    assert op4_language.identify(docs, op4_language.train(docs.limit(0), "doc_id", "text", "lang")).first().lang_pred == "und"


def brute_marginals(emit, start, move):
    n = len(emit)
    total, mass = 0.0, np.zeros(n)
    for code in range(1 << n):
        y = [(code >> k) & 1 for k in range(n)]
        p = np.exp(start[y[0]] + sum(emit[k] for k in range(n) if y[k]) + sum(move[a, b] for a, b in zip(y, y[1:], strict=False)))
        total += p
        mass += p * np.array(y)
    return mass / total


def test_field_marginals_are_exact():
    rng = np.random.default_rng(3)
    sizes = [1, 5, 3, 7]
    first = np.concatenate([[0], np.cumsum(sizes)])
    emit, start, move = rng.normal(size=first[-1]), rng.normal(size=2), rng.normal(size=(2, 2))
    p, _, _ = op5_quality.marginals(emit, first, start, move)
    for a, b in zip(first, first[1:], strict=False):
        assert np.allclose(p[a:b, 1], brute_marginals(emit[a:b], start, move))


def test_quality(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("aeioubcdfglmnrst"), 5))
    good = lambda: "\n".join(" ".join(word() for _ in range(9)) + "." for _ in range(4))
    bad = lambda: "\n".join(" ".join(word().upper() + "!!" for _ in range(9)) for _ in range(4))
    docs = spark.createDataFrame([(k, bad() if k % 3 == 0 else good(), int(k % 3 > 0)) for k in range(120)], "doc_id long, text string, y int")
    field = op5_quality.train(docs.where("doc_id < 90"), "doc_id", "text", "y")
    got = op5_quality.score_quality(docs, field).where("doc_id >= 90").collect()
    assert all((r.score >= 0.5) == (r.doc_id % 3 > 0) for r in got)
    assert all(0 <= r.score <= 1 for r in op5_quality.score_quality(awkward(spark), field).collect())
    assert op5_quality.score_quality(docs, op5_quality.train(docs.limit(0), "doc_id", "text", "y")).first().score == 0.5


def brute_repeats(docs, length=50):
    least = {}
    for i, b in docs:
        for k in range(len(b) - length + 1):
            g = b[k : k + length]
            least[g] = min(i, least.get(g, i))
    out = []
    for i, b in docs:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - length + 1):
            if least[b[k : k + length]] < i:
                gone[k : k + length] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = int(((gone[1:] > gone[:-1]).sum() + gone[0]) if len(gone) else 0)
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_substrings(spark):
    rng = np.random.default_rng(5)
    bits = ["".join(rng.choice(list("abé \n"), 70)) for _ in range(6)]
    texts = ["".join(bits[j] for j in rng.integers(0, 6, 3)) + "".join(rng.choice(list("abc"), int(rng.integers(0, 60)))) for _ in range(60)]
    texts += ["ab" * 200, "ab" * 80, "z" * 49, "z" * 50, "z" * 51, LONG[:3000], LONG[1000:4000], "", "ab" * 200]
    rows = [(k * 7 % 101, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in op6_substrings.remove_repeats(df).collect())
    assert got == brute_repeats([(i, t.encode()) for i, t in rows])
    odd = op6_substrings.remove_repeats(awkward(spark), keep_text=True).collect()
    assert len(odd) == 14 and all(r.n_removed == 0 for r in odd if r.doc_id is None)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in odd)
    assert [r.n_removed > 0 for r in odd if r.doc_id == 9] == [True, True]


def test_suffix_order_is_lexicographic():
    body = np.frombuffer(b"banana bandana banana bandana panama", np.uint8)
    at = np.arange(len(body) - 9)
    order, group = op6_substrings.suffix_classes(body, at, 10)
    windows = [body[k : k + 10].tobytes() for k in order]
    assert windows == sorted(windows) and [a == b for a, b in zip(windows, windows[1:], strict=False)] == [a == b for a, b in zip(group, group[1:], strict=False)]


def brute_near(docs, words, per_hundred):
    sets = {}
    for i, t in docs:
        w = [x for x in re.split(rb"[\x20\x09-\x0d]+", (t or "").encode().lower()) if x]
        sets.setdefault(i, []).append({tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()))
    ids = sorted(sets)
    comp = {i: i for i in ids}

    def find(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and any(100 * len(p & q) >= per_hundred * len(p | q) and p for p in sets[a] for q in sets[b]):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_fixture():
    rng = np.random.default_rng(6)
    docs = []
    for g in range(12):
        words = [f"t{rng.integers(0, 5000)}" for _ in range(90)]
        for _ in range(int(rng.integers(1, 9))):
            own = list(words)
            for _ in range(int(rng.integers(0, 4))):
                own[int(rng.integers(0, 90))] = f"new{rng.integers(0, 9)}"
            docs.append((len(docs), " ".join(own)))
    return docs


@pytest.mark.parametrize("block", [256, 4])
def test_minhash(spark, block, monkeypatch):
    monkeypatch.setattr(op7_minhash.near_components, "__defaults__", (block,))
    docs = near_fixture() + [(500, "one two"), (501, "ONE  two"), (502, ""), (503, None), (504, LONG), (505, LONG)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: r for r in op7_minhash.near_dedup(df, words=3, per_hundred=85).collect()}
    want = brute_near(docs, 3, 85)
    assert {i: r.component_id for i, r in got.items()} == want
    assert got[502].n_shingles == 0 and got[500].n_shingles == 1 and all(r.kept == (r.component_id == i) for i, r in got.items())


def test_minhash_awkward(spark):
    assert len(op7_minhash.near_dedup(awkward(spark)).collect()) == 14
    assert op7_minhash.near_dedup(awkward(spark).limit(0)).collect() == []


def test_min_max_estimates_similarity():
    rng = np.random.default_rng(8)
    a = rng.integers(1, 1 << 62, 1000, dtype=np.uint64)
    b = np.concatenate([a[:800], rng.integers(1, 1 << 62, 200, dtype=np.uint64)])
    same = (op7_minhash.min_max_signature(a) == op7_minhash.min_max_signature(b)).mean()
    assert abs(same - 800 / 1200) < 0.15


def test_components(spark):
    rng = np.random.default_rng(9)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in root}


def check_packing(pieces, ids, capacity=1024):
    seqs = {}
    for p in pieces:
        assert zlib.crc32(np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        assert p.doc_tokens == len(ids[p.doc_id])
        seqs.setdefault(p.sequence_id, []).append(p)
    for own in seqs.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
    padding = sum(0 if n & (n - 1) == 0 else capacity - n for n in (sum(p.length for p in own) for own in seqs.values()))
    return padding


def test_packing(spark):
    from tokenizers import Tokenizer

    path = op8_packing.public_path()
    whole = Tokenizer.from_file(path)
    texts = [LONG, "", None, "a", "two  spaces \n and\ttabs ", " lead", "x " * 700, "été ñ <|endoftext|> 漢字 'll don't   z"] + [LONG[k * 90 : k * 190] for k in range(1, 60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    ids = {k: [*whole.encode(t or "", add_special_tokens=False).ids, 0] for k, t in enumerate(texts)}
    got = op8_packing.pack(df, path, keep_ids=True).collect()
    padding = check_packing(got, ids)
    assert Counter({k: len(v) for k, v in ids.items()}) == sum((Counter({p.doc_id: p.length}) for p in got), Counter())
    assert padding <= 2 * 1024 and all(ids[p.doc_id][p.start : p.start + p.length] == list(p.ids) for p in got)
    assert op8_packing.pack(df.limit(0), path).collect() == []
    assert len({(p.doc_id) for p in op8_packing.pack(awkward(spark), path).collect()}) == 13


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["word", " ", "  ", "Été", "naïve,", "x.", "!", "don't", "\n", "\t", "12", "a1", "漢字", "ß:", "\u00a0", "<|endoftext|>", "…", "I'll", "?!", "ǅ", "ª", "\0"]), max_size=14))
def test_tokens_are_the_library_s(parts):
    store, text = op8_packing.tokens(op8_packing.public_path()), "".join(parts)
    assert store(text) == np.array(store.whole.encode(text, add_special_tokens=False).ids if text else [], "<u4").tobytes()


def test_mixing(spark):
    rng = np.random.default_rng(10)
    rows = [(k, "w " * int(rng.integers(1, 60)), ["a", "b", "c", None][int(rng.integers(0, 4) ** 2 // 3)]) for k in range(2000)] + [(5000, None, "a"), (5001, "", "empty"), (5001, "", "empty")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = op9_mixing.mix_sources(df, keep=("source",)).collect()
    by = {}
    for r in got:
        by.setdefault(r.source, []).append(r)
        assert r.taken <= 3 * r.size
    total = sum(r.size for r in got)
    assert abs(sum(v[0].target for v in by.values()) - total) < 1e-6 * total
    for v in by.values():
        assert v[0].source_size == sum(r.size for r in v) and v[0].target <= 3 * v[0].source_size + 1e-9
        assert abs(sum(r.taken for r in v) - v[0].target) <= max(0.03 * v[0].target, 200)
    again = op9_mixing.mix_sources(df.repartition(7), keep=("source",)).collect()
    assert Counter((r.doc_id, r.taken) for r in got) == Counter((r.doc_id, r.taken) for r in again)
    taken = op9_mixing.take(df)
    assert taken.columns == df.columns and taken.count() == sum(r.copies for r in got)
    assert op9_mixing.take(awkward(spark)).columns == awkward(spark).columns
    assert op9_mixing.mix_sources(df.limit(0)).collect() == []


def test_source_targets(spark):
    got = {r.source: r.target for r in op9_mixing.source_targets(spark.createDataFrame([("a", 10), ("b", 1000), ("c", 90)], "source string, source_size long")).collect()}
    assert got["a"] == 30 and got["c"] == 270 and abs(got["b"] - 800) < 1e-9


def test_licenses(spark):
    texts = ["Licensed under the Apache License, Version 2.0.", "licensed under teh Apache Licence version 2 0", "CC BY cc-by", "All rights reserved. all  rights\nreserved", "nothing", "", None, "General Public License", "éCC BY"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string")
    got = {r.doc_id: r for r in op10_licenses.scan_licenses(df).collect()}
    assert [s.label for s in got[0].fuzzy] == ["apache"] and got[0].fuzzy[0].errors == 0 and got[0].fuzzy[0].n_words == 8
    assert [s.label for s in got[1].fuzzy] == ["apache"] and got[1].fuzzy[0].errors == 3
    assert [s.first_word for s in got[2].base] == [0, 2] and [s.first_word for s in got[3].base] == [0, 3]
    assert got[4].n_words == 1 and not got[4].base and got[5].n_words == 0 and got[6].n_words == 0 and [s.label for s in got[7].base] == ["gpl"] and not got[8].base
    assert len(op10_licenses.scan_licenses(awkward(spark)).collect()) == 14


def test_fuzzy_search_finds_all_that_a_full_search_does():
    import regex

    rng = np.random.default_rng(11)
    phrase = "licensed under the apache license version 2 0"
    notice = op10_licenses.Notice(phrase, "apache")
    full = regex.compile(f"(?:{regex.escape(phrase, literal_spaces=True)}){{e<={notice.errors}}}")
    for _ in range(60):
        s = list(phrase)
        for _ in range(int(rng.integers(0, 7))):
            k = int(rng.integers(0, len(s)))
            s[k] = ["", "q", s[k] + "e"][int(rng.integers(0, 3))]
        text = f" some words {''.join(s)} more words "
        assert bool(notice.find(text)) == bool(full.search(text))


def test_fuzzy_search_finds_each_of_several_places():
    rng = np.random.default_rng(12)
    phrase = "licensed under cc by 4 0"
    notice = op10_licenses.Notice(phrase, "cc-by")
    first = notice.find(" licensed undr cc by 4 0 licensed under cc by 4 0 ")
    assert [x[2] for x in first] == [1, 0]
    for _ in range(25):
        parts = []
        for _ in range(4):
            s = list(phrase)
            for _ in range(int(rng.integers(0, 3))):
                k = int(rng.integers(0, len(s)))
                s[k] = ["", "q", s[k] + "e"][int(rng.integers(0, 3))]
            parts.append("".join(s) + " word" * int(rng.integers(0, 3)))
        text = f" {' '.join(parts)} "
        found = notice.find(text)
        assert all(x[1] <= y[0] for x, y in zip(found, found[1:], strict=False))
        for start in range(len(text)):
            row = list(range(len(phrase) + 1))
            for end in range(start + 1, min(len(text), start + len(phrase) + notice.errors) + 1):
                last, row = row, [row[0] + 1]
                for k, c in enumerate(phrase):
                    row.append(min(last[k] + (c != text[end - 1]), last[k + 1] + 1, row[k] + 1))
                assert row[-1] > notice.errors or any(x[0] < end and start < x[1] and x[2] <= row[-1] for x in found)
