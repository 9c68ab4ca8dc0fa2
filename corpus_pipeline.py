"""From raw documents to packed training sequences: reject junk, keep one of each near-duplicate group, replace
personal values, pack. Each stage's output is written to the shared folder and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import ngram_join, packing, pii, quality
from tidemark.llm.queries import PII_KEY
from tidemark.llm.workspace import Workspace


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score at least quality.CUT; fitted on the labelled rows among them that are not held out."""
    return quality.keep_good(docs, quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group linked by word 5-grams at a similarity of 0.75."""
    return ngram_join.keep_one(docs)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal values; n_chars follows the new text."""
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    new = pii.pseudonymise(docs, PII_KEY, keep=others)
    if "n_chars" in others:
        new = new.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return new.select(*docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences of 2048 tokens."""
    return packing.pack(docs, room=2048)


STAGES = [("quality classifier", quality_classifier), ("n-gram Jaccard join", ngram_jaccard_join), ("PII", pii_pseudonyms), ("best-fit packing", best_fit_packing)]

#: SQL expresses neither the classifier nor the packing; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, ws = spark.read.parquet(f"{sf_dir}/documents.parquet"), Workspace(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = ws.table(stage(spark, docs, sf_dir), f"stage{k}")
        if k:
            ws.drop(f"stage{k - 1}")
    return docs
