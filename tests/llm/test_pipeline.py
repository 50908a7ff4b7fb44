"""Each stage of the pipeline on a small folder of tables."""

import re

import numpy as np

import corpus_pipeline
from strandline.llm import op9_mixing


def folder(spark, path):
    rng = np.random.default_rng(0)
    rows = []
    for k in range(400):
        text = " ".join(f"v{rng.integers(0, 900)}" for _ in range(60))
        rows.append((k, text + (" you stupid worthless moron" if k % 5 == 0 else " you dear friend"), "en", f"s{k % 3}", len(text)))
    rows += [(400 + k, rows[k][1].replace(" ", "  ", 1), "en", "s1", 1) for k in range(1, 40)]
    rows += [(500 + k, rows[k][1] + " end", "en", "s1", 1) for k in range(1, 40)] + [(600, None, None, None, None), (601, "", None, "s0", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(r[0], 1, int("stupid" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return {r[0]: r[1] for r in rows}


def test_pipeline(spark, tmp_path):
    texts = folder(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append(docs)
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    clean = {i for i, t in texts.items() if "stupid" not in (t or "")}
    assert {r.doc_id for r in seen[0].collect()} == clean
    first = {}
    for i in sorted(clean):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i] or ""), i)
    assert {r.doc_id for r in seen[1].collect()} == set(first.values())
    assert {r.doc_id for r in seen[2].collect()} == {i for i in first.values() if i < 500 or i >= 600}
    mixed = op9_mixing.mix_sources(seen[2]).collect()
    assert seen[3].count() == sum(r.copies for r in mixed)
    assert {r.doc_id for r in seen[4].collect()} == {r.doc_id for r in seen[3].collect()}
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == seen[4].count()
