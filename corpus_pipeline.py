"""Documents to packed training sequences, in five stages.

Each stage takes what its predecessor kept, written as Parquet and read again.
All but the last return the columns of ``documents``, with any further columns,
whatever their names.

Null and empty texts are scored like others and go or stay by their score; they
have no near duplicates, no benchmark passages and no secrets, and pack as an end
marker alone. Rows with a null id stay unless a stage's rule drops their text. Of
equal rows the near-duplicate stage keeps one, but for texts without words, which
all stay. An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parcelyard.llm import common, decontamination, jaccard_join, packing, quality_classifier, secret_ledger
from parcelyard.llm.queries import read, vocabulary
from parcelyard.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.5 or more."""
    ship(spark)
    return quality_classifier.keep(docs, read(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group linked by Jaccard of 0.8 or more."""
    ship(spark)
    return jaccard_join.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a verbatim window of eight words of a benchmark item, or a whole shorter item."""
    ship(spark)
    return decontamination.remove(docs, read(spark, sf_dir, "benchmark"), least_items=1)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by a mark."""
    return secret_ledger.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces placed in sequences of at most 2048 tokens."""
    ship(spark)
    return packing.pack_documents(docs, vocabulary())


STAGES = [
    ("quality_classifier", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontaminated),
    ("secret_scans", without_secrets),
    ("best_fit_packing", packed),
]

#: Trained scores and packing have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = common.table(docs)
    return docs
