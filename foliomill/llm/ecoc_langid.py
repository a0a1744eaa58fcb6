"""Language identification by error-correcting output codes.

Each language gets a codeword of signs, far from all others.  One binary
logistic classifier per column of the code predicts that bit from hashed byte
n-grams (one to four bytes of the folded text).  Decoding sums, per language,
the logistic losses of all bits against its codeword, each weighted by how well
its classifier did; the least loss wins.  A text is ambiguous when the second
language is nearly as close.

Every language of the training rows is learned.  The fit uses about ``PER_LANGUAGE`` documents
of each, fewer where that would be more than ``ROWS`` in all, but two at least, both
parameters; the languages themselves are a list that every worker holds.  Defined results: ``und`` with score 0 for a
null text, a text without a letter, or when nothing could be learned; with one
learned language every other text gets it with score 1; rows without lang teach
nothing; extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches
from .learning import Adam, sigmoid, texts_of
from .textbytes import LOWER, SPACE, mix, text_bytes, text_slices

PER_LANGUAGE = 1200
ROWS = 12_000
SIZE = 2048
AMBIGUOUS = 0.2
_ORDERS = (1, 2, 3, 4)
_FOLD = LOWER.copy()
_FOLD[SPACE] = 32
_FOLD[ord("0") : ord("9") + 1] = ord("0")


def features(column: pa.Array) -> np.ndarray:
    """Square roots of the shares of hashed n-grams, each order on its own scale."""
    data, offsets = text_bytes(column)
    out = [np.zeros((0, SIZE), np.float32)]
    for a, b in text_slices(offsets, limit=1 << 19, most=1024):
        piece, at, n = _FOLD[data[offsets[a] : offsets[b]]], offsets[a : b + 1] - offsets[a], b - a
        text = np.repeat(np.arange(n), np.diff(at))
        length = np.maximum(1, np.diff(at))[:, None]
        total = np.zeros((n, SIZE), np.float32)
        gram = np.zeros(len(piece), np.uint64)
        for order in _ORDERS:
            stop = len(piece) - order + 1
            if stop <= 0:
                break
            gram = (gram[:stop] << np.uint64(8)) | piece[order - 1 :].astype(np.uint64)
            whole = text[:stop] == text[order - 1 :]
            slot = (mix(gram + np.uint64(order << 40)) & np.uint64(SIZE - 1)).astype(np.int64)
            count = np.bincount((text[:stop] * SIZE + slot)[whole], minlength=n * SIZE).reshape(n, SIZE)
            total += np.sqrt(count / length, dtype=np.float32)
        out.append(total)
    return np.concatenate(out)


def codewords(n: int, seed: int = 11) -> np.ndarray:
    """n rows of signs; every two-way split for up to five languages, else the best of random codes (beyond 300 one, half as long again)."""
    if n < 2:
        return np.ones((n, 1))
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1.0, -1.0)
    width = max(15, int(np.ceil(8 * np.log2(n))))
    random = np.random.default_rng(seed)
    if n > 300:
        return random.choice([-1.0, 1.0], (n, width * 3 // 2))
    best, far = np.zeros((n, 0)), -1
    for _ in range(200):
        code = random.choice([-1.0, 1.0], (n, width))
        near = (width - code @ code.T) / 2 + width * np.eye(n)
        if near.min() > far and (np.abs(code.sum(axis=0)) < n).all():
            best, far = code, near.min()
    return best


@dataclass
class Decoder:
    languages: list[str]
    code: np.ndarray
    mean: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def predict(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, score and ambiguity of each text."""
        n = len(column)
        if len(self.languages) < 2:
            return np.zeros(n, np.int64), np.ones(n), np.zeros(n, bool)
        margin = np.clip((features(column) - self.mean) @ self.weight + self.bias, -20, 20)
        # The weighted loss of each bit if the codeword has it, and if it does not.
        loss = (np.log1p(np.exp(-margin)) * self.trust) @ (self.code > 0).T + (np.log1p(np.exp(margin)) * self.trust) @ (self.code < 0).T
        best = loss.argmin(axis=1)
        share = np.exp(-(loss - loss.min(axis=1, keepdims=True)))
        share /= share.sum(axis=1, keepdims=True)
        top = np.sort(share, axis=1)
        return best, top[:, -1], top[:, -1] - top[:, -2] < AMBIGUOUS


def fit(x: np.ndarray, y: np.ndarray, languages: list[str], seed: int = 13) -> Decoder:
    code = codewords(len(languages))
    width = code.shape[1]
    mean = x.mean(axis=0) if len(x) else np.zeros(SIZE)
    weight, bias = Adam(np.zeros((SIZE, width)), 0.02), Adam(np.zeros(width), 0.02)
    bits = code[y]
    random = np.random.default_rng(seed)
    order = random.permutation(len(x))
    if len(languages) > 1:
        for _ in range(max(6, min(60, 60_000 // len(x)))):
            for at in range(0, len(x), 256):
                rows = order[at : at + 256]
                z = x[rows] - mean
                slope = -bits[rows] * sigmoid(-bits[rows] * (z @ weight.value + bias.value)) / len(rows)
                weight.move(z.T @ slope + 1e-5 * weight.value)
                bias.move(slope.sum(axis=0))
            random.shuffle(order)
    hit = ((x - mean) @ weight.value + bias.value) * bits > 0
    trust = np.maximum(0.05, 2 * hit.mean(axis=0) - 1) if len(x) else np.ones(width)
    return Decoder(languages, code, mean.astype(np.float32), weight.value.astype(np.float32), bias.value, trust / trust.mean())


def learn(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE, rows: int = ROWS) -> Decoder:
    """Fit on documents for which ``learn`` holds and whose lang is known.

    Languages have their own sampling shares, so a frequent one does not crowd
    out the others; rows that share a doc_id and lang count once.
    """
    given = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & learn)
    given = given.select("doc_id", F.col("lang").alias("label"))
    known = given.groupBy("label").agg(F.count("*").alias("n")).collect()
    names = sorted(r.label for r in known)
    if not names:
        return fit(np.zeros((0, SIZE), np.float32), np.zeros(0, int), [])
    per_language = max(2, min(per_language, rows // len(names)))
    shares = docs.sparkSession.createDataFrame([(r.label, min(1.0, per_language / r.n)) for r in known], "label string, share double")
    # A share of 1 takes all rows of a rare language; the others are picked by a hash, about as many as wanted.
    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 40))
    picked = given.distinct().join(F.broadcast(shares), "label").where(place < F.col("share") * (1 << 40)).select("doc_id", "label")

    def run(batch: pa.RecordBatch) -> dict:
        """The features that are not zero, which is what travels to the driver."""
        x = features(batch["text"])
        row, at = np.nonzero(x)
        offsets = pa.array(np.searchsorted(row, np.arange(len(x) + 1)), pa.int32())
        lists = (pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (at.astype(np.int16), x[row, at]))
        return {"doc_id": batch["doc_id"], "label": batch["label"], **dict(zip(("at", "x"), lists, strict=True))}

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = map_batches(texts_of(docs, picked), run, f"doc_id {kind}, label string, at array<smallint>, x array<float>").toArrow().sort_by([("doc_id", "ascending"), ("label", "ascending")])
    x = np.zeros((got.num_rows, SIZE), np.float32)
    lists = got["at"].combine_chunks()
    x[np.repeat(np.arange(len(x)), lists.value_lengths().to_numpy()), lists.flatten().to_numpy()] = got["x"].combine_chunks().flatten().to_numpy()
    place = {name: k for k, name in enumerate(names)}
    return fit(x, np.array([place[v] for v in got["label"].to_pylist()], int), names)


def predicted(docs: DataFrame, model: Decoder) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) and whether the decision is ambiguous, for every row."""
    names = pa.array([*model.languages, "und"])
    known = bool(model.languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, close = model.predict(batch["text"])
            letters = batch["letters"].to_numpy(zero_copy_only=False) & known
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch["doc_id"],
                    "lang_pred": names.take(pa.array(np.where(letters, best, len(names) - 1))),
                    "score": pa.array(np.where(letters, score, 0.0)),
                    "ambiguous": pa.array(letters & close),
                }
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    return map_arrow(docs.select("doc_id", "text", letters.alias("letters")), run, f"doc_id {kind}, lang_pred string, score double, ambiguous boolean")
