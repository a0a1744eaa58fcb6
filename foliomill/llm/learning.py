"""Bounded labelled samples and small fitting helpers for the classifiers.

A model is fitted on the driver from at most ``rows`` labelled documents (each
operator states its bound); features of those documents are made on the
executors.  Scoring goes over all documents and all of their text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

_WHOLE = 1 << 40


def sample(labelled: DataFrame, share: Column, rows: int, seed: int = 7) -> DataFrame:
    """At most ``rows`` of the rows (doc_id, label), picked by a hash of the doc_id at the given share."""
    place = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(_WHOLE))
    picked = labelled.withColumn("_place", place).where(F.col("_place") < share * _WHOLE)
    return picked.orderBy("_place", "doc_id").limit(rows).select("doc_id", "label")


def agreed_labels(labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, label (0 or 1); a null label and labels that contradict each other for one doc_id are left out."""
    given = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & learn)
    given = given.groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("_most"))
    return given.where(F.col("label") == F.col("_most")).select("doc_id", "label")


def all_labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column) -> DataFrame:
    """doc_id, label, text of every labelled document for which ``learn`` holds; of rows that repeat a doc_id the least text."""
    given = agreed_labels(labels, label, learn).hint("merge")
    found = docs.select("doc_id", "text").where(F.col("text").isNotNull() & learn).join(given, "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def labelled_texts(docs: DataFrame, labels: DataFrame, label: str, learn: Column, rows: int) -> DataFrame:
    """doc_id, label (0 or 1), text of at most ``rows`` labelled documents for which ``learn`` holds.

    A null label and labels that contradict each other for one doc_id are left
    out; of rows that repeat a doc_id the least text is taken.
    """
    given = agreed_labels(labels, label, learn)
    share = F.lit(min(1.0, 1.1 * rows / max(1, given.count())))
    return texts_of(docs, sample(given, share, rows))


def texts_of(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """The texts of picked documents; ``picked`` has a bounded number of rows, so it is broadcast."""
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(picked), "doc_id")
    return found.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def score_documents(docs: DataFrame, score: Callable[[pa.Array], np.ndarray], name: str = "score") -> DataFrame:
    """doc_id and score of every row, from its text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch["doc_id"], name: pa.array(score(batch["text"]), pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, {name} double")


def keep_documents(docs: DataFrame, keep: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """The rows, with all their columns, whose text the function keeps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch["text"])))

    return map_arrow(docs, run, docs.schema)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


#: The score from which a document counts as label 1.
CUT = 0.7
CUT_LOGIT = float(np.log(CUT / (1 - CUT)))


class Adam:
    """First-order steps with running moments, one instance per parameter array."""

    def __init__(self, value: np.ndarray, rate: float) -> None:
        self.value, self.rate, self.step = value, rate, 0
        self.first, self.second = np.zeros_like(value), np.zeros_like(value)

    def move(self, slope: np.ndarray) -> None:
        self.step += 1
        self.first += 0.1 * (slope - self.first)
        self.second += 0.001 * (slope * slope - self.second)
        first = self.first / (1 - 0.9**self.step)
        second = self.second / (1 - 0.999**self.step)
        self.value -= self.rate * first / (np.sqrt(second) + 1e-8)
