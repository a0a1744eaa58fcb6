"""Toxicity: a factorization machine over hashed terms.

The logit of a document is ``bias + sum of w over its terms + sum over pairs of
terms of <v_i, v_j>``: a weight for each term and, through the factor vectors,
one for each pair, so that a word can count for more beside another one.  Terms
are hashed words and word beginnings of 4 to 7 bytes (inflected forms share
them), once for presence and once for presence more than once.

Of the hashed terms those enter the machine that differ most between the labels
of the fitted documents (chi-square), at most ``TERMS``.  A fifth of the fitted
documents sets the cut, so that it sees terms the weights have not seen.

The fit uses at most ``LABELLED`` documents, a parameter.  Defined results: a
null or empty text has no terms and gets the bias; without labels of both kinds
every score is the share of label 1 (0 without labels); extra columns take no part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, write_table
from .learning import CUT, CUT_LOGIT, Adam, keep_documents, labelled_texts, score_documents, sigmoid
from .textbytes import ALNUM, LOWER, span_hash, text_bytes, text_slices, words

LABELLED = 20_000
TERMS = 2048
FACTORS = 8
LEAST_CHI2 = 10.0
_BITS = 20
_BEGINNINGS = (4, 5, 6, 7)


def _terms(piece: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed term of every word and word beginning."""
    _, start, end, first = words(piece, at, LOWER, ALNUM)
    text = np.repeat(np.arange(len(at) - 1), np.diff(first))
    folded = LOWER[piece]
    texts, found = [text], [span_hash(folded, start, end)]
    for n in _BEGINNINGS:
        long = end - start > n
        texts.append(text[long])
        found.append(span_hash(folded, start[long], start[long] + n) ^ np.uint64(n))
    return np.concatenate(texts), (np.concatenate(found) >> np.uint64(64 - _BITS)).astype(np.int64)


def _counted(text: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, term), and the term's second form where it occurs more than once; sorted by text."""
    key, count = np.unique((text << _BITS) | term, return_counts=True)
    text, term = key >> _BITS, key & ((1 << _BITS) - 1)
    again = count > 1
    text, term = np.concatenate([text, text[again]]), np.concatenate([term, term[again] + (1 << _BITS)])
    order = np.argsort(text, kind="stable")
    return text[order], term[order]


@dataclass
class Machine:
    terms: np.ndarray  # sorted ids
    bias: float
    weight: np.ndarray
    factor: np.ndarray
    cut: float = 0.0
    constant: float | None = None

    def logit(self, text: np.ndarray, slot: np.ndarray, n: int) -> np.ndarray:
        v = self.factor[slot]
        total = np.zeros((n, v.shape[1]))
        np.add.at(total, text, v)
        squares = np.bincount(text, weights=(v * v).sum(axis=1), minlength=n)
        return self.bias + np.bincount(text, weights=self.weight[slot], minlength=n) + 0.5 * ((total * total).sum(axis=1) - squares)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        wanted = np.zeros(1 << _BITS, bool)
        wanted[self.terms & ((1 << _BITS) - 1)] = True
        data, offsets = text_bytes(column)
        out = [np.zeros(0)]
        for a, b in text_slices(offsets):
            text, term = _terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            keep = wanted[term]
            text, term = _counted(text[keep], term[keep])
            slot = np.minimum(np.searchsorted(self.terms, term), len(self.terms) - 1)
            keep = self.terms[slot] == term
            out.append(self.logit(text[keep], slot[keep], b - a))
        return sigmoid(np.concatenate(out) - self.cut + CUT_LOGIT)


def fit(first: np.ndarray, slot: np.ndarray, y: np.ndarray, terms: np.ndarray, seed: int = 3) -> Machine:
    """Fit on documents given as slots of ``terms``; ``first`` has the n + 1 offsets."""
    n, m = len(y), len(terms)
    if not n or y.min() == y.max() or not m:
        return Machine(terms, 0.0, np.zeros(m), np.zeros((m, FACTORS)), constant=float(y.mean()) if n else 0.0)
    random = np.random.default_rng(seed)
    order = random.permutation(n)
    checked, learned = order[: n // 5], order[n // 5 :]
    bias, weight = Adam(np.zeros(1), 0.02), Adam(np.zeros(m), 0.02)
    factor = Adam(0.05 * random.standard_normal((m, FACTORS)), 0.01)
    rare = np.sqrt((y == 0).sum() / (y == 1).sum())

    def dense(rows: np.ndarray) -> np.ndarray:
        x = np.zeros((len(rows), m))
        for i, r in enumerate(rows):
            x[i, slot[first[r] : first[r + 1]]] = 1
        return x

    for _ in range(max(8, min(60, 200_000 // len(learned)))):
        for at in range(0, len(learned), 256):
            rows = learned[at : at + 256]
            x = dense(rows)
            total = x @ factor.value
            pairs = 0.5 * ((total * total).sum(axis=1) - x @ (factor.value**2).sum(axis=1))
            slope = sigmoid(bias.value[0] + x @ weight.value + pairs) - y[rows]
            slope *= np.where(y[rows] == 1, rare, 1) / len(rows)
            pull = x.T @ slope
            bias.move(np.array([slope.sum()]))
            weight.move(pull + 1e-4 * weight.value)
            factor.move(x.T @ (slope[:, None] * total) - pull[:, None] * factor.value + 1e-3 * factor.value)
        random.shuffle(learned)
    made = Machine(terms, float(bias.value[0]), weight.value, factor.value)

    def logits(rows: np.ndarray) -> np.ndarray:
        x = dense(rows)
        total = x @ made.factor
        return made.bias + x @ made.weight + 0.5 * ((total * total).sum(axis=1) - x @ (made.factor**2).sum(axis=1))

    seen = np.concatenate([logits(checked[i : i + 256]) for i in range(0, len(checked), 256)]) if len(checked) else np.zeros(0)
    truth = y[checked]
    if truth.any() and not truth.all():
        made.cut = _best_cut(seen, truth)
    return made


def _best_cut(logit: np.ndarray, y: np.ndarray) -> float:
    """The middle of the widest-scoring gap: the cut with the best F1 between two neighbouring logits."""
    order = np.argsort(-logit)
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    at = int(np.argmax(f1))
    low = logit[order[at + 1]] if at + 1 < len(y) else logit[order[at]] - 1
    return float((logit[order[at]] + low) / 2)


def learn(docs: DataFrame, labels: DataFrame, learn: Column, rows: int = LABELLED, terms: int = TERMS) -> Machine:
    """Fit on labelled documents for which ``learn`` (a condition on the labels' doc_id) holds."""

    def run(batch: pa.RecordBatch) -> dict:
        data, offsets = text_bytes(batch["text"])
        ends, found = [np.zeros(1, np.int64)], [np.zeros(0, np.int64)]
        for a, b in text_slices(offsets):
            text, term = _counted(*_terms(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
            ends.append(ends[-1][-1] + np.searchsorted(text, np.arange(1, b - a + 1)))
            found.append(term)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(ends), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
        return {"doc_id": batch["doc_id"], "label": batch["label"], "terms": lists}

    texts = labelled_texts(docs, labels, "toxic", learn, rows).select("doc_id", F.col("label").cast("int").alias("label"), "text")
    seen = write_table(map_batches(texts, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, label int, terms array<int>"), "terms")
    n, ones = (int(x or 0) for x in seen.agg(F.count("*"), F.sum("label")).first())
    if not 0 < ones < n:
        return fit(np.zeros(n + 1, int), np.zeros(0, int), np.full(n, ones / n if n else 0.0), np.zeros(0, int))
    counts = seen.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("c"), F.sum("label").alias("t"))
    # Chi-square of the two by two table of a term's presence and the label.
    a, c = F.col("t"), F.col("c")
    off = a * (n - ones) - (c - a) * ones
    chi2 = off * off * float(n) / (c * (n - c) * float(ones * (n - ones)))
    best = counts.where((c < n) & (c > 2)).select("term", chi2.alias("chi2")).where(F.col("chi2") > LEAST_CHI2)
    chosen = np.sort([r.term for r in best.orderBy(F.desc("chi2"), "term").limit(terms).collect()]).astype(np.int64)
    known = F.array(*[F.lit(int(x)) for x in chosen]) if len(chosen) else F.array().cast("array<int>")
    got = seen.select("doc_id", "label", F.array_intersect("terms", known).alias("terms")).toArrow().sort_by("doc_id").combine_chunks()
    lists = got["terms"].combine_chunks()
    first = np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
    slot = np.searchsorted(chosen, lists.flatten().to_numpy())
    return fit(first, slot, got["label"].to_numpy(), chosen)


def scored(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id, score of every document."""
    return score_documents(docs, model.score)


def harmless_documents(docs: DataFrame, model: Machine) -> DataFrame:
    """The documents, with all their columns, below the cut."""
    return keep_documents(docs, lambda column: model.score(column) < CUT)
