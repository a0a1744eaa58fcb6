"""From raw documents to packed training sequences, stage by stage.

    python -c "import corpus_pipeline; ..."   # or the registered query ``pipeline``

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor
kept and returns a DataFrame, which is written as Parquet and read again for
the next stage.  ``docs`` has the columns of ``documents``; all stages but the
last return them unchanged for the documents they keep.  Labels and benchmark
items are read from ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm import bradley_terry, fm_toxicity, hilbert_packing, minhash_dedup, wu_manber
from foliomill.llm.common import table, write_table
from foliomill.llm.queries import tokenizer_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents at or above the quality cut."""
    model = bradley_terry.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return bradley_terry.good_documents(docs, model)


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents below the toxicity cut."""
    model = fm_toxicity.learn(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return fm_toxicity.harmless_documents(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least doc_id of each group of near duplicates."""
    return minhash_dedup.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents in which no window of a benchmark item occurs."""
    return wu_manber.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their places in sequences of 1024 tokens."""
    return hilbert_packing.packed(docs, tokenizer_path(), end=0)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: The first stage learns its model from labelled texts, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
