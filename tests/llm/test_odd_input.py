"""Input that is empty where a worker begins, very long, shared by all rows, or dealt to other numbers of partitions."""

import hashlib
import os
import subprocess
import sys

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandline.llm import op1_exact_dedup, op2_toxicity, op3_embeddings, op4_language, op5_quality, op6_substrings, op7_minhash, op8_packing, op9_mixing, op10_licenses, op11_html, op12_search, op13_prefixes
from strandline.llm.queries import ORACLES, QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DIR = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"

FRESH = {
    "powers": "from strandline.llm import shared; a, b = shared.powers(0); assert len(a) == len(b) == 0",
    "op2": "import pyarrow as pa; from strandline.llm import op2_toxicity as o; assert [len(x) for x in o.features(pa.array(['', None, '']))] == [0, 0, 0]",
    "op4": "import numpy as np; from strandline.llm import op4_language as o; o.cut_windows(np.zeros(0, np.uint8), np.zeros(2, np.int64))",
    "op5": "import numpy as np; from strandline.llm import op5_quality as o; o.line_features(np.zeros(0, np.uint8), np.zeros(3, np.int64))",
    "op6": "import pyarrow as pa; from strandline.llm import op6_substrings as o; assert not list(o.parse(pa.RecordBatch.from_arrays([pa.array([0]), pa.array([1]), pa.array([''])], names=['tag', 'id', 'text']), 4))",
    "op7": "import numpy as np; from strandline.llm import shared; assert [len(x) for x in shared.shingles(np.zeros(0, np.uint8), np.zeros(3, np.int64), 5)] == [0, 0]",
    "op10": "from strandline.llm import op10_licenses as o; assert o.normalise(b'')[1] == 0",
    "op11": "from strandline.llm import markup as m; assert m.skeleton(m.parse('')) == [] and m.extract(m.parse(''), m.Level([])) == ''",
    "op12": "import numpy as np; from strandline.llm import op12_search as o; s = o.shard([1, None], np.zeros(0, np.uint8), np.zeros(3, np.int64), 0, 0); assert s['hashes'] == b'' and s['doc_ids'] == [1, None]",
}


@pytest.mark.parametrize("name", sorted(FRESH))
def test_first_block_of_a_fresh_interpreter_is_empty(name):
    done = subprocess.run([sys.executable, "-c", FRESH[name]], cwd=ROOT, env=os.environ | {"PYTHONPATH": ROOT}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_rows_without_text_alone(spark):
    """A row a partition, each null or empty, through all operators."""
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "", None, "s", 0), (None, None, None, None, None), (4, " \n", "en", None, 2)], DOCS).repartition(5)
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0), (3, 1, 1), (4, 0, 0)], "doc_id long, quality int, toxic int")
    assert {r.doc_id: r.group_size for r in op1_exact_dedup.exact_dedup(docs).collect() if r.doc_id} == {1: 3, 2: 3, 3: 3, 4: 1}
    toxic = op2_toxicity.score(docs, op2_toxicity.fit_on(docs, labels)).collect()
    assert len(toxic) == 5 and all(0 <= r.score <= 1 for r in toxic)
    quality = op5_quality.score_quality(docs, op5_quality.train(docs.join(labels, "doc_id"), "doc_id", "text", "quality")).collect()
    assert len(quality) == 5 and all(0 <= r.score <= 1 for r in quality)
    assert {r.lang_pred for r in op4_language.identify(docs, op4_language.train(docs, "doc_id", "text", "lang")).collect()} == {"und"}
    assert all(r.n_removed == 0 for r in op6_substrings.remove_repeats(docs).collect())
    assert all(r.kept for r in op7_minhash.near_dedup(docs).collect())
    assert sum(r.length for r in op8_packing.pack(docs, op8_packing.public_path()).collect()) >= 5
    assert {r.taken for r in op9_mixing.mix_sources(docs).collect()} == {0}
    assert all(r.n_words == 0 and not r.fuzzy for r in op10_licenses.scan_licenses(docs).collect())
    pages = docs.select(F.col("doc_id").alias("page_id"), F.col("lang").alias("url"), F.col("text").alias("html"))
    assert {r.text for r in op11_html.extract_text(pages).collect()} == {""}
    assert op12_search.search(op12_search.build_index(docs), docs.withColumnRenamed("doc_id", "item_id")).count() == 0
    turns = docs.select(F.col("doc_id").alias("conv_id"), F.lit(None).cast("long").alias("turn"), F.col("lang").alias("role"), "text")
    assert op13_prefixes.prefix_trie(turns).where("depth = 0").first().n_convs == 4


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_rows_without_text(spark, tmp_path, name, stage):
    docs = spark.createDataFrame([(k, None if k % 2 else "", None, None, 0) for k in range(6)], DOCS).repartition(6)
    spark.createDataFrame([(k, 1, k % 2) for k in range(6)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = stage(spark, docs, str(tmp_path))
    assert out.count() >= 0 and (name == "packing" or out.columns == docs.columns)


def test_long_text_without_spaces(spark):
    """A few MB in one word, and one text of many short lines."""
    r = np.random.default_rng(2)
    word = "".join(r.choice(list("abcdefghij"), 3_000_000).tolist())
    lines = "\n".join(f"a{k}" for k in range(60_000))
    docs = spark.createDataFrame([(1, word), (2, lines), (3, "short one")], "doc_id long, text string")
    pieces = op8_packing.pack(docs, op8_packing.public_path(), keep_ids=True).collect()
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(op8_packing.public_path())
    for doc, text in ((1, word), (2, lines), (3, "short one")):
        own = sorted((x.start, x.length) for x in pieces if x.doc_id == doc)
        assert own[-1][0] + own[-1][1] == len(whole.encode(text, add_special_tokens=False).ids) + 1
    store = op8_packing.tokens(op8_packing.public_path())
    store(word)
    assert all(len(k) <= op8_packing.CACHE_LENGTH for k in (*store.young, *store.old))
    scored = op5_quality.score_quality(docs, None).collect()
    assert len(scored) == 3


def test_store_of_tokens_is_bounded_within_a_text(monkeypatch):
    monkeypatch.setattr(op8_packing, "CACHE_ENTRIES", 50)
    store = op8_packing.Tokens(op8_packing.public_path())
    text = " ".join(f"w{k}" for k in range(2_000))
    assert store(text) == np.array(store.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert len(store.young) <= 50 and len(store.old) <= 50


def brute_removed(rows, length=50):
    first = {}
    for doc, text in sorted(rows):
        raw = text.encode()
        for k in range(len(raw) - length + 1):
            first.setdefault(raw[k : k + length], doc)
    out = {}
    for doc, text in rows:
        raw = text.encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            if first[raw[k : k + length]] < doc:
                gone[k : k + length] = True
        out[doc] = (int(gone.sum()), hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~gone])).hexdigest())
    return out


@pytest.mark.parametrize("partitions", [4, 64])
def test_one_passage_in_all_documents(spark, partitions):
    """A seed that all rows have, and results that don't depend on the number of partitions."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        r = np.random.default_rng(7)
        common = "this passage stands in each document of the table and is longer than fifty bytes. "
        rows = [(k, " ".join(r.choice(list("abcdefgh"), 30)) + " " + common + " ".join(r.choice(["red", "green", "blue", "grey"], 12)) + common * (k % 3)) for k in range(120)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(9)
        got = {x.doc_id: (x.n_removed, x.kept_sha256) for x in op6_substrings.remove_repeats(docs).collect()}
        assert got == brute_removed(rows)
        near = {x.doc_id: x.component_id for x in op7_minhash.near_dedup(docs.union(docs.selectExpr("doc_id + 1000", "text"))).collect()}
        assert all(near[k + 1000] == near[k] <= k for k in range(120))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def planted(n, dim, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, dim))
    for k in range(n // 4):  # groups of two and more, some at the threshold
        x[n - 1 - k] = x[k % (n // 8)] + r.normal(size=dim) * r.choice([0.05, 0.3, 0.45])
    x[5] = x[6] * (1 + 1e-9)
    return x


@pytest.mark.parametrize("n", [12, 500, 2000])
def test_index_finds_links_at_each_size(spark, monkeypatch, n):
    """Codebooks and traversal are made for few vectors, too."""
    trained = []
    train = op3_embeddings.train_index
    monkeypatch.setattr(op3_embeddings, "train_index", lambda *a: trained.append(train(*a)) or trained[-1])
    x = planted(n, 16, n)
    got = {r.vec_id: r.n_links for r in op3_embeddings.near_vectors(spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = (u @ u.T >= 0.9).sum(axis=1) - 1
    assert len(trained) == 1 and len(trained[0].c1) > 1
    assert all(got[k] <= want[k] for k in range(n)) and sum(got.values()) >= 0.9 * want.sum() and want.sum() > 0


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
def test_recall_on_the_tables_vectors(spark, monkeypatch):
    path = "/root/testdata/sf0.1"
    trained = []
    train = op3_embeddings.train_index
    monkeypatch.setattr(op3_embeddings, "train_index", lambda *a: trained.append(train(*a)) or trained[-1])
    rows = spark.read.parquet(f"{path}/embeddings.parquet").select("vec_id", "embedding").collect()
    u = np.array([r.embedding for r in rows], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    for threshold in (0.9, 0.4):  # the tables hold few links at 0.9
        want = {r.vec_id: int(n) - 1 for r, n in zip(rows, (u @ u.T >= threshold).sum(axis=1), strict=True)}
        got = {r.vec_id: r.n_links for r in op3_embeddings.near_vectors(spark.read.parquet(f"{path}/embeddings.parquet"), threshold).collect()}
        assert all(got[k] <= want[k] for k in want) and sum(got.values()) >= 0.9 * sum(want.values())
    assert len(trained) == 2


@pytest.mark.skipif(not os.path.isdir(DIR), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    df = QUERIES[name](spark, DIR)
    found = con.execute(ORACLES[name])
    names, want = [c[0] for c in found.description], found.fetchall()
    assert sorted(df.columns) == sorted(names)
    text = lambda x: "" if x is None else f"{x:.6f}" if isinstance(x, float) else str(x)
    rows = lambda columns, found: sorted([text(r[columns.index(c)]) for c in sorted(columns)] for r in found)
    assert rows(df.columns, df.collect()) == rows(names, want)
