"""The corpus pipeline: toxicity, exact dedup, near dedup, mixing, packing, each stage written and read again.

Rows with null or empty text or null sources pass all stages like others. Dedup decides by row: rows
that share an id but not a text are judged each for itself, and of rows equal in both one stays. Rows
with a null id are no copies of others and stay. Extra columns are carried along, whatever their names.
Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import op1_exact_dedup, op2_toxicity, op7_minhash, op8_packing, op9_mixing
from strandline.llm.shared import cut, decided


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is under the threshold; the model knows no label of held-out rows.

    A document goes where the classifier rejects it. The labels of the folder are those of its
    documents, so the model is fitted on the rows of ``docs`` that have one.
    """
    model = op2_toxicity.fit_on(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    columns = docs.columns
    hidden = docs.toDF(*[f"c{k}" for k in range(len(columns))])  # so that no name clashes
    scored = op2_toxicity.score(hidden, model, hidden.columns[columns.index("doc_id")], hidden.columns[columns.index("text")], keep=tuple(hidden.columns), name="score")
    return scored.where(F.col("score") < op2_toxicity.THRESHOLD).select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(columns)])


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row of smallest id of each group of equal texts; of rows equal in id and text, one."""
    found = op1_exact_dedup.exact_dedup(docs)
    return decided(docs, found.select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("text_key"), "kept"), F.col("doc_id"), op1_exact_dedup.digest("text"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near-duplicates, that of smallest id: five-word shingles, similarity 0.8."""
    found = op7_minhash.near_dedup(docs, words=5, per_hundred=80, one=True)
    return decided(docs, found.select(F.col("doc_id").alias("id"), F.col("text_hash").cast("string").alias("text_key"), "kept"), F.col("doc_id"), F.xxhash64("text").cast("string"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return op9_mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 1,024 tokens."""
    return op8_packing.pack(docs, op8_packing.public_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("MinHash near-dedup", drop_near_copies),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: A trained classifier, shingle components and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``; each stage's result is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
