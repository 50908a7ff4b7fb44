"""Scores against naive ones, cases of repeated ids and odd columns, and each registered query on a small folder."""

import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from strandline.llm import op1_exact_dedup, op2_toxicity, op3_embeddings, op4_language, op5_quality, op7_minhash, op10_licenses
from strandline.llm.queries import QUERIES
from strandline.llm.shared import decided

WORDS = {
    "en": "the house and river with that thing under cloud while seven birds".split(),
    "de": "das haus und der fluss mit dem ding unter wolken sieben vogel".split(),
    "fr": "la maison et le fleuve avec cette chose sous nuage sept oiseau".split(),
}


def test_toxicity_score_is_the_naive_one(spark):
    rng = np.random.default_rng(1)
    texts = ["You Stupid\tMoron", "", None, "abc", "x" * 40] + ["".join(rng.choice(list("abé \nST"), 30)) for _ in range(20)]
    weights, bias = rng.normal(size=1 << op2_toxicity.BITS).astype(np.float32), -0.3
    got = {r.doc_id: r.score for r in op2_toxicity.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), (weights, bias)).collect()}
    for k, t in enumerate(texts):
        flat = re.sub(rb"[\x09-\x0D]", b" ", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
        grams = {(n, flat[i : i + n]) for n in op2_toxicity.ORDERS for i in range(len(flat) - n + 1)}
        buckets = {int(op2_toxicity.features(pa.array([g], pa.binary()), (n,))[0][0]) for n, g in grams}
        assert got[k] == pytest.approx(1 / (1 + np.exp(-np.clip(bias + sum(float(weights[b]) for b in buckets), -40, 40))))


def test_labels_that_count(spark):
    docs = spark.createDataFrame([(k, f"text {k}") for k in range(40)] + [(None, "x")], "doc_id long, text string")
    labels = [(k, k % 2) for k in range(40)] + [(0, 1), (2, 0), (3, 7), (5, None), (None, 1), (99, 1)]
    counts, sample = op2_toxicity.labelled_texts(docs, spark.createDataFrame(labels, "doc_id long, toxic int"), "toxic", 4, 2, 6)
    known = [k for k in range(1, 40) if zlib.crc32(str(k).encode()) % 4 != 2]
    assert counts == Counter(k % 2 for k in known)
    rows = sample.collect()
    assert Counter(r._label for r in rows) == {0: 6, 1: 6} and all(r.doc_id in known and r._label == r.doc_id % 2 and r.text == f"text {r.doc_id}" for r in rows)


def naive_logits(net, window):
    out = np.zeros(net.kernel.shape[1])
    for f in range(len(out)):
        width = op4_language.WIDTHS[f // op4_language.FILTERS]
        at = [sum(float(net.emb[window[p + d]] @ net.kernel[d * op4_language.DIM : (d + 1) * op4_language.DIM, f]) for d in range(width)) for p in range(len(window) - max(op4_language.WIDTHS) + 1)]
        out[f] = max(0.0, max(at) + net.bias[f])
    return out @ net.out + net.out_bias


def test_network_is_the_naive_one():
    rng = np.random.default_rng(2)
    net = op4_language.Network(["a", "b", "c"])
    net.bias = rng.normal(size=net.bias.shape).astype(np.float32)
    windows = rng.integers(0, 256, (3, 40)).astype(np.uint8)
    assert np.allclose(net.logits(windows), [naive_logits(net, w) for w in windows], atol=1e-4)


def test_a_step_of_training_goes_down_the_loss(monkeypatch):
    """With plain steps in place of scaled ones the change of each weight is its numerical derivative."""
    rng = np.random.default_rng(3)
    windows, labels = rng.integers(1, 256, (6, 24)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss(net):
        z = net.logits(windows).astype(float)
        return float(-(z - np.log(np.exp(z).sum(axis=1, keepdims=True)))[np.arange(6), labels].mean())

    net = op4_language.Network(["a", "b", "c"])
    grad = net.gradient(windows, labels, np.ones(3, np.float32))
    for name in grad:
        whole = getattr(net, name)
        for at in {tuple(int(rng.integers(0, n)) for n in whole.shape) for _ in range(12)} | {tuple(int(x) for x in np.unravel_index(np.abs(grad[name]).argmax(), whole.shape))}:
            found = []
            for step in (1e-2, -1e-2):
                whole[at] += step
                found.append(loss(net))
                whole[at] -= step
            if name != "kernel" or net.mask[at]:
                assert grad[name][at] == pytest.approx((found[0] - found[1]) / 2e-2, abs=2e-3)


def ids(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


def test_vectors_of_one_component_of_any_size_and_of_shared_ids(spark):
    near = lambda rows: ids(op3_embeddings.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")), "vec_id", "n_links", "component_id")
    assert near([(1, [1.0]), (2, [2.0]), (3, [-1.0]), (4, [1.0, 0.0]), (7, [1e200, 0.0, 0.0]), (8, [1e200, 0.0, 0.0]), (9, [5e-324, 0.0, 0.0])]) == [(1, 1, 1), (2, 1, 1), (3, 0, 3), (4, 0, 4), (7, 2, 7), (8, 2, 7), (9, 2, 7)]
    assert near([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.0]), (3, [0.0, 1.0])]) == [(1, 1, 1), (1, 1, 1), (2, 1, 1), (3, 1, 1)]


def test_documents_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(60)) for c in "ab")
    docs = spark.createDataFrame([(3, a), (5, a + " end"), (5, b), (6, b + " end"), (9, None), (None, a)], "doc_id long, text string")
    got = op7_minhash.near_dedup(docs).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in got) == [(0, 0, True), (3, 3, True), (5, 3, False), (5, 5, True), (6, 5, False), (9, 9, True)]


def test_deletion_of_copies(spark):
    key = lambda s: s.encode() * 32
    live = [("a", 1), ("a", 2), ("a", 3), ("b", 7), ("c", 5), ("c", 6)]
    copies = spark.createDataFrame([(key(k), i) for k, i in live], "key binary, id long")
    index = spark.createDataFrame([(key("a"), 1, 3), (key("b"), 7, 1), (key("c"), 5, 2)], "key binary, keep_id long, group_size long")
    batch = spark.createDataFrame([(key("a"), 1), (key("a"), 99), (key("b"), 7), (key("d"), 4), (key("a"), None), (None, 2)], "key binary, id long")
    gone = op1_exact_dedup.update_index(index, batch, delete=True, buckets=3, copies=copies)
    assert {bytes(r.key): (r.keep_id, r.group_size) for r in gone.collect()} == {key("a"): (2, 2), key("c"): (5, 2)}
    added = op1_exact_dedup.update_index(index, batch, buckets=3)
    assert {bytes(r.key): (r.keep_id, r.group_size) for r in added.collect()} == {key("a"): (1, 5), key("b"): (7, 2), key("c"): (5, 2), key("d"): (4, 1)}


def test_spans_are_chosen_as_by_comparing_all():
    rng = np.random.default_rng(4)
    for _ in range(200):
        spans = [{"label": str(rng.integers(0, 3)), "first_word": int(rng.integers(0, 30)), "n_words": int(rng.integers(1, 6)), "errors": 0, "score": float(rng.integers(1, 4))} for _ in range(int(rng.integers(0, 25)))]
        kept = []
        for s in sorted(spans, key=lambda s: (-s["score"], -s["n_words"], s["first_word"], s["label"])):
            if all(s["first_word"] >= k["first_word"] + k["n_words"] or k["first_word"] >= s["first_word"] + s["n_words"] for k in kept):
                kept.append(s)
        assert op10_licenses.best_spans(spans) == sorted(kept, key=lambda s: s["first_word"])


def test_adjacent_and_overlapping_notices(spark):
    texts = [
        "Licensed under teh apache licence version 2 0 licensed under the apache license version 2 0", "licensed under the apache license version 2 0 licensed under teh apache licence version 2 0",
        "this work is licensed under the gnu general public license version 3", "released under the mit license released undr the mit license all rights reserved",
    ]
    got = {r.doc_id: r for r in op10_licenses.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    spans = lambda k: [(s.label, s.first_word, s.n_words, s.errors) for s in got[k].fuzzy]
    assert spans(0) == [("apache", 0, 8, 3), ("apache", 8, 8, 0)] and spans(1) == [("apache", 0, 8, 0), ("apache", 8, 8, 3)]
    assert spans(2) == [("gpl", 0, 10, 0)] and spans(3) == [("mit", 0, 5, 0), ("mit", 5, 5, 1), ("reserved", 10, 3, 0)]


def brute_base(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    words = [w.decode(errors="replace") for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)]
    found = [(k, label) for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")) for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in found]
    return len(words), len(found), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in found}))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Documents in three languages, a fifth of them toxic and another fifth of bad lines, with licence lines, copies and odd rows."""
    rng, path, docs, labels = np.random.default_rng(6), str(tmp_path_factory.mktemp("tables")), [], []
    for k in range(240):
        lang = sorted(WORDS)[k % 3]
        text = ". \n".join(" ".join(rng.choice(WORDS[lang], 8)) for _ in range(5))
        if k % 5 == 0:
            text += " you stupid worthless moron"
        if k % 5 == 1:
            text = "\n".join("BUY NOW!!! $$$ " + str(rng.integers(0, 9999)) for _ in range(6))
        if k % 40 == 2:
            text += " CC-BY licenced. All rights reserved"
        docs.append((k, text, None if k % 11 == 0 else lang, f"s{k % 4}", len(text)))
        labels.append((k, int(k % 5 != 1), int(k % 5 == 0)))
    docs += [(300 + k, docs[k][1], "en", "s1", 1) for k in range(0, 60, 7)] + [(400, None, None, None, None), (401, "", None, "s0", 0), (402, "12 !!", "en", "s0", 5)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    vectors = [(k, k % 3, rng.normal(size=8).tolist()) for k in range(50)]
    vectors += [(50 + k, 0, (np.array(vectors[k][2]) + rng.normal(size=8) * 0.05).tolist()) for k in range(20)]
    spark.createDataFrame(vectors, "vec_id long, label int, embedding array<double>").write.parquet(f"{path}/embeddings.parquet")
    return path, {d[0]: d for d in docs}, {x[0]: x for x in labels}, vectors


COLUMNS = {
    "op1_exact_dedup": "doc_id keep_id group_size kept text_sha256", "op2_toxicity": "doc_id held_out score predicted", "op3_embeddings": "vec_id n_links component_id kept", "op4_language": "doc_id held_out lang_pred score",
    "op5_quality": "doc_id held_out score predicted", "op6_substrings": "doc_id n_bytes n_removed n_spans kept_sha256", "op7_minhash": "doc_id n_shingles component_id kept",
    "op8_packing": "doc_id start length ids_crc32 doc_tokens sequence_id offset", "op9_mixing": "doc_id size source_size target taken", "op10_licenses": "doc_id n_words n_base first_word last_word base_labels labels score",
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_query(spark, folder, name):
    path, docs, labels, vectors = folder
    df = QUERIES[name](spark, path)
    assert df.columns[: len(COLUMNS[name].split())] == COLUMNS[name].split()
    got = df.collect()
    if name == "op3_embeddings":
        u = np.array([v[2] for v in vectors])
        u /= np.linalg.norm(u, axis=1, keepdims=True)
        assert {r.vec_id: r.n_links for r in got} == {k: int(n) - 1 for (k, _, _), n in zip(vectors, (u @ u.T >= 0.9).sum(axis=1), strict=True)}
        return
    assert {r.doc_id for r in got} == set(docs) and (name == "op8_packing" or len(got) == len(docs))
    held = {"op2_toxicity": (4, 2), "op4_language": (5, 0), "op5_quality": (3, 1)}.get(name)
    if held:
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % held[0] == held[1]) and 0 <= r.score <= 1 for r in got)
    if name in ("op2_toxicity", "op5_quality"):
        at, least = (2, 0.3) if name == "op2_toxicity" else (1, 0.5)
        assert all(r.predicted == int(r.score >= least) for r in got)
        own = [r for r in got if r.doc_id in labels and r.held_out]
        assert own and sum(r.predicted == labels[r.doc_id][at] for r in own) >= 0.97 * len(own)
    if name == "op4_language":
        own = [r for r in got if r.doc_id < 240 and r.doc_id % 5 != 1]
        assert sum(r.lang_pred == sorted(WORDS)[r.doc_id % 3] for r in own) >= 0.97 * len(own) and {r.lang_pred for r in got if r.doc_id in (400, 401, 402)} == {"und"}
    if name == "op10_licenses":
        assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_base(docs[r.doc_id][1]) for r in got)
        assert all(set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1 for r in got) and any(r.n_base for r in got)


def test_decisions_by_row(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(3, "A x", 1), (5, "A x", 1), (5, "B unique", 2), (7, "C", 1), (7, "C", 2), (None, "A x", 1), (None, "A x", 1)], "doc_id long, text string, `a.b` int")
    found = op1_exact_dedup.exact_dedup(docs)
    left = decided(docs, found.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("text_key"), "kept"), F.col("doc_id"), op1_exact_dedup.digest("text"))
    assert left.columns == docs.columns
    assert sorted(((r[0] or 0), r[1]) for r in left.collect()) == [(0, "A x"), (0, "A x"), (3, "A x"), (5, "B unique"), (7, "C")]


def test_stages_on_odd_and_empty_tables(spark, folder):
    path, texts, _, _ = folder
    good = texts[2][1]
    rows = [(1, good), (2, good), (2, good + " so"), (2, "other words here"), (2, "other words here"), (None, good), (4, None), (4, ""), (5, "   "), (6, "x " * 20_000)]
    docs = spark.createDataFrame([(i, t, None, None, None, 0.5, 1, "z") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, _toxicity double, `a.b` int, copies string")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept, none = stage(spark, docs, path), stage(spark, docs.limit(0), path)
        assert kept.columns == docs.columns and none.columns == docs.columns and none.collect() == []
        got = Counter((r.doc_id, r.text) for r in kept.collect())
        if name == "toxicity":
            assert got == Counter(rows)
        if name == "exact dedup":
            assert got == Counter([(1, good), (2, good + " so"), (2, "other words here"), (None, good), (4, None), (5, "   "), (6, "x " * 20_000)]) or got == Counter([(1, good), (2, good + " so"), (2, "other words here"), (None, good), (4, ""), (5, "   "), (6, "x " * 20_000)])
        if name == "MinHash near-dedup":
            assert got[1, good] == 1 and (2, good) not in got and (2, good + " so") not in got and got[2, "other words here"] == 1 and got[None, good] == 1 and got[6, "x " * 20_000] == 1
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), path).collect() == []
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()} == {1, 2, 4, 5, 6, None}


def test_quality_of_conflicting_and_empty_rows(spark):
    docs = spark.createDataFrame([(1, ""), (1, None), (None, "a"), (2, "b\nc")], "doc_id long, text string")
    assert len(op5_quality.score_quality(docs, None).collect()) == 4 and op5_quality.score_quality(docs.limit(0), None).collect() == []


def test_repeated_windows_by_dictionary_and_parse():
    from strandline.llm import op6_substrings

    rng = np.random.default_rng(0)
    for _ in range(150):
        bits = [bytes(rng.integers(97, 100, int(rng.integers(12, 30)), dtype=np.uint8)) for _ in range(5)]
        pieces = [b"".join(bits[k] for k in rng.integers(0, 5, int(rng.integers(1, 4)))) for _ in range(int(rng.integers(2, 14)))]
        doc, start = rng.integers(0, 6, len(pieces)).astype(np.int64), rng.integers(0, 50, len(pieces)).astype(np.int64)
        got = op6_substrings.repeated_windows(doc, np.arange(len(pieces)), start, np.array([len(x) for x in pieces]), np.frombuffer(b"".join(pieces), np.uint8), 10)
        least = {}
        for d, x in zip(doc, pieces, strict=True):
            for k in range(len(x) - 9):
                least[x[k : k + 10]] = min(d, least.get(x[k : k + 10], 99))
        want = Counter((i, int(start[i]) + k) for i, (d, x) in enumerate(zip(doc, pieces, strict=True)) for k in range(len(x) - 9) if least[x[k : k + 10]] < d)
        assert Counter((int(i), k) for _, i, a, b in zip(*got, strict=True) for k in range(int(a), int(b))) == want


def test_windows_of_a_large_bucket_in_rounds():
    """Memory beside a bucket of 16 MB stays a small multiple of it, and rounds don't change the result."""
    import tracemalloc

    from strandline.llm import op6_substrings

    rng = np.random.default_rng(1)
    n = (16 << 20) // 71
    body = rng.integers(97, 123, (n, 71), dtype=np.uint8)
    body[n // 2 : n // 2 + n // 4, 10:] = body[: n // 4, 10:]
    doc, zero, size, body = np.arange(n), np.zeros(n, np.int64), np.full(n, 71), body.reshape(-1)
    tracemalloc.start()
    whole = op6_substrings.repeated_windows(doc, zero, zero, size, body)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 20 * len(body)
    assert len(whole[0]) == n // 4 and set(whole[3].tolist()) == {22} and whole[2].max() == 10  # a letter before it agrees by chance
    small = 71 * 2000
    pick = np.concatenate([np.arange(1000), np.arange(n // 2, n // 2 + 1000)])
    part = body.reshape(n, 71)[pick].reshape(-1)
    args = (doc[pick], zero[:2000], zero[:2000], size[:2000], part)
    assert len(part) == small
    for a, b in zip(op6_substrings.repeated_windows(*args), op6_substrings.repeated_windows(*args, most=700), strict=True):
        assert a.tolist() == b.tolist()


def test_empty_tables_and_repeated_rows(spark):
    from strandline.llm import op6_substrings, op8_packing, op9_mixing

    docs = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    weights = (np.zeros(1 << op2_toxicity.BITS, np.float32), 0.0)
    for f in (
        lambda d: op2_toxicity.score(d, weights), lambda d: op4_language.identify(d, None), lambda d: op5_quality.score_quality(d, None), lambda d: op6_substrings.remove_repeats(d), lambda d: op8_packing.pack(d, op8_packing.public_path()),
        lambda d: op9_mixing.mix_sources(d, keep=("source",)), lambda d: op10_licenses.scan_licenses(d), lambda d: op1_exact_dedup.exact_dedup(d),
    ):
        assert f(docs.limit(0)).collect() == [] and Counter(r.doc_id for r in f(docs).collect()) == {1: 2, None: 1}


def test_kept_columns_don_t_clash(spark):
    from strandline.llm import op9_mixing

    docs = spark.createDataFrame([(1, "a b", "s", 1, 2)], "doc_id long, text string, source string, copies int, source_size int")
    df = op9_mixing.mix_sources(docs, keep=("copies", "source_size", "source"))
    assert len(set(df.columns)) == len(df.columns) and (df.first()._copies, df.first()._source_size, df.first().source) == (1, 2, "s")
