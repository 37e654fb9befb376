"""From documents to packed training sequences: five stages, each written and read again.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, of the
columns of documents for all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelight.llm.minhash import without_near_duplicates
from quirelight.llm.mixing import mixed_documents
from quirelight.llm.packing import packed_documents, word_bpe_path
from quirelight.llm.quality import fit_quality, scored
from quirelight.llm.rows import fresh
from quirelight.llm.secrets import redacted_documents
from quirelight.plans.storage import Scratch
from quirelight.plans.tables import read


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score 0.5 or more)."""
    model = fit_quality(docs.select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score, attention = (fresh(c, docs.columns) for c in ("score", "attention"))
    return scored(docs, model, score, attention).filter(F.col(score) >= 0.5).drop(score, attention)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked at a similarity of 0.8."""
    return without_near_duplicates(docs, 80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark."""
    found = redacted_documents(docs)
    return found.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else found


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to the weights 5, 2, 1: documents stay, go, are repeated or cut as the mix takes them, in its order."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the tokenised documents, placed in sequences of 4096 tokens."""
    return packed_documents(docs, word_bpe_path())


STAGES = [
    ("quality classifier", quality),
    ("near-duplicates", near_duplicates),
    ("secret scans", secrets),
    ("source mixing", mixing),
    ("packing", packing),
]

#: None: SQL expresses none of the classifier, the components and the tokenizer. A test holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.save(stage(spark, docs, sf_dir), f"stage-{i}")
    return docs
