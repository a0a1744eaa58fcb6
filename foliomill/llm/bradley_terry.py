"""Quality: document scores learned from preference pairs (Bradley-Terry).

Each pair says that a document of label 1 is preferred to one of label 0.  The
probability of the preference is the logistic function of the difference of the
two scores, so the loss needs only differences of features.  The cut between
good and bad is a quantile of the fitted documents' scores, at their share of
label 0, and scores are shown as probabilities that put the cut at 0.7.

Features describe the shape of a text, not its language: how often one class of
character follows another, and lengths, repetitions and variety of words.

The fit uses every labelled document.  They are dealt by a hash of the doc_id into blocks of
about ``BLOCK``; all pairs inside a block count, so each document meets those of the other label
there.  A Newton step adds up one gradient and curvature over the blocks; the cut is the exact quantile of all.
Defined results: a null or empty text has the features of an empty text; without
labels of both kinds every score is the share of label 1 (0.5 without labels);
extra columns take no part.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lines import as_binary, whole_groups
from .common import map_arrow, map_batches, write_table
from .learning import CUT, CUT_LOGIT, all_labelled_texts, keep_documents, score_documents, sigmoid
from .textbytes import AS_IS, LOWER, NOT_SPACE, mix, text_bytes, text_slices, words

BLOCK = 2_000
STEPS = 12
PENALTY = 1e-3
#: Sums over blocks are whole multiples of this, so that they do not depend on the order.
_GRAIN = 2.0**-20
_BINS = 4096

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".,;:", "!?", "'\"()[]{}-", "|", "*#&%$@", "_=+<>/\\~^`")
_OTHER = len(_CLASSES)
KINDS = _OTHER + 1
_KIND = np.full(256, _OTHER, np.int64)
for _k, _characters in enumerate(_CLASSES):
    _KIND[[ord(x) for x in _characters]] = _k
_WORD_FEATURES = 12
FEATURES = KINDS * KINDS + KINDS + _WORD_FEATURES


def _per_text(text: np.ndarray, n: int, weight: np.ndarray | None = None) -> np.ndarray:
    return np.bincount(text, weights=weight, minlength=n).astype(np.float64)


def _distinct(text: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, the number of different values and the highest count of one."""
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    most = np.zeros(n)
    np.maximum.at(most, text[at], np.diff(np.append(at, len(text))))
    return _per_text(text[at], n), most


def features(column: pa.Array) -> np.ndarray:
    """One row of FEATURES numbers for each text."""
    data, offsets = text_bytes(column)
    out = [np.zeros((0, FEATURES), np.float32)]
    for a, b in text_slices(offsets):
        piece, at, n = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], b - a
        size = np.maximum(1.0, np.diff(at))
        text = np.repeat(np.arange(n), np.diff(at))
        kind = _KIND[piece]
        single = _per_text(text * KINDS + kind, n * KINDS).reshape(n, KINDS) / size[:, None]
        inner = text[1:] == text[:-1] if len(text) else np.zeros(0, bool)
        pair = (text[1:] * KINDS * KINDS + kind[:-1] * KINDS + kind[1:])[inner]
        double = _per_text(pair, n * KINDS * KINDS).reshape(n, KINDS * KINDS) / size[:, None]
        hashes, start, end, first = words(piece, at, LOWER, NOT_SPACE)
        count = np.diff(first).astype(np.float64)
        some = np.maximum(1.0, count)
        word = np.repeat(np.arange(n), np.diff(first))
        length = (end - start).astype(np.float64)
        different, top = _distinct(word, hashes, n)
        near = word[3:] == word[:-3] if len(word) > 3 else np.zeros(0, bool)
        triple = mix(mix(hashes[:-3] * np.uint64(3) + hashes[1:-2]) * np.uint64(3) + hashes[2:-1])[near] if len(word) > 3 else hashes[:0]
        triples, top_triple = _distinct(word[3:][near] if len(word) > 3 else word[:0], triple, n)
        of_triples = np.maximum(1.0, count - 3)
        breaks = np.flatnonzero(piece == 10)
        lines = np.maximum(1.0, _per_text(text[breaks], n) + 1)
        last = _KIND[AS_IS[piece[end - 1]]] if len(end) else kind[:0]
        head = _KIND[piece[start]] if len(start) else kind[:0]
        stats = [
            np.log1p(size), np.log1p(count), _per_text(word, n, length) / some, _per_text(word, n, length * length) / some,
            different / some, top / some, triples / of_triples, top_triple / of_triples, np.log1p(lines), np.log1p(count / lines),
            _per_text(word, n, (last > 2).astype(float)) / some, _per_text(word, n, (head == 1).astype(float)) / some,
        ]
        out.append(np.hstack([np.sqrt(single), np.sqrt(double), np.stack(stats, axis=1)]).astype(np.float32))
    return np.concatenate(out)


@dataclass
class Ranking:
    """Weights of standardised features; the score of a document is one inner product."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    cut: float
    slope: float
    constant: float | None = None

    def raw(self, x: np.ndarray) -> np.ndarray:
        # A matrix product may sum a row in another order in another batch; equal texts have equal scores.
        return (np.clip((x - self.mean) / self.scale, -8, 8) * self.weight).sum(axis=1)

    def score(self, column: pa.Array) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(column), self.constant)
        return sigmoid(self.slope * (self.raw(features(column)) - self.cut) + CUT_LOGIT)


def _block_slope(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Pairs, gradient and curvature of the loss of all pairs of a 1 and a 0, flat."""
    good, bad = z[y == 1], z[y == 0]
    miss = sigmoid((bad @ weight)[None, :] - (good @ weight)[:, None])
    bend = miss * (1 - miss)
    slope = miss.sum(axis=0) @ bad - miss.sum(axis=1) @ good
    mixed = good.T @ (bend @ bad)
    curve = (good.T * bend.sum(axis=1)) @ good + (bad.T * bend.sum(axis=0)) @ bad - mixed - mixed.T
    return np.concatenate([[len(good) * len(bad)], slope, curve.ravel()])


def _over_blocks(blocks: DataFrame, work: Callable[[np.ndarray, np.ndarray], np.ndarray], merge: bool = True) -> np.ndarray:
    """``work(x, y)`` of every block: their sum, rounded block by block, or one row each in order of the blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for block, x, y in zip(batch["block"].to_pylist(), batch["x"], batch["y"], strict=True):
                found = work(np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES), np.frombuffer(y.as_buffer(), np.int8))
                if merge:
                    whole = np.rint(found / _GRAIN).astype(np.int64)
                    total = whole if total is None else total + whole
                else:
                    yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64()), "found": pa.array([found.astype(np.float64).tobytes()])})
        if total is not None:
            yield pa.RecordBatch.from_pydict({"block": pa.array([0], pa.int64()), "found": pa.array([total.tobytes()])})

    rows = map_arrow(blocks, run, "block bigint, found binary").toArrow().sort_by("block")["found"].to_pylist()
    if merge:
        return sum(np.frombuffer(r, np.int64) for r in rows) * _GRAIN
    return np.stack([np.frombuffer(r) for r in rows])


def _quantile(blocks: DataFrame, raw: Callable[[np.ndarray], np.ndarray], share: float, n: int, low: float, high: float) -> float:
    """The value at a share of all, between its two neighbours as NumPy does, from counts and the few values around it."""
    at = share * (n - 1)
    edges = np.linspace(low, high, _BINS + 1)[1:-1]

    def bin_of(x: np.ndarray) -> np.ndarray:
        return np.searchsorted(edges, raw(x), side="right")

    before = np.concatenate([[0], np.cumsum(_over_blocks(blocks, lambda x, y: np.bincount(bin_of(x), minlength=_BINS).astype(float)))])
    first, last = (int(np.searchsorted(before, k, side="right")) - 1 for k in (int(at), min(int(at) + 1, n - 1)))

    def near(batch: pa.RecordBatch) -> dict:
        found = [np.zeros(0)]
        for x in batch["x"]:
            x = np.frombuffer(x.as_buffer(), np.float32).reshape(-1, FEATURES)
            place = bin_of(x)
            found.append(raw(x)[(place >= first) & (place <= last)])
        return {"raw": pa.array(np.concatenate(found))}

    values = map_batches(blocks, near, "raw double").groupBy("raw").count().orderBy("raw").toArrow()
    upto = np.cumsum(values["count"].to_numpy()) + int(round(before[first]))
    a, b = (values["raw"].to_numpy()[np.searchsorted(upto, k, side="right")] for k in (int(at), min(int(at) + 1, n - 1)))
    return float(a + (b - a) * (at - int(at)))


def learn(docs: DataFrame, labels: DataFrame, learn: Column, block: int = BLOCK) -> Ranking:
    """Fit on all labelled documents for which ``learn`` (a condition on the doc_id) holds."""
    texts = all_labelled_texts(docs, labels, "quality", learn)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def described(batch: pa.RecordBatch) -> dict:
        x = features(batch["text"])
        return {"doc_id": batch["doc_id"], "label": batch["label"], "x": as_binary(x.ravel(), np.full(len(x), FEATURES))}

    seen = write_table(map_batches(texts.select("doc_id", F.col("label").cast("int").alias("label"), "text"), described, f"doc_id {kind}, label int, x binary"), "features")
    n, ones = (int(v or 0) for v in seen.agg(F.count("*"), F.sum("label")).first())
    none = np.zeros(FEATURES)
    if not 0 < ones < n:
        return Ranking(none, none + 1, none, 0.0, 1.0, ones / n if n else 0.5)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, ("block",)):
            for a, b in zip(start, np.append(start[1:], len(table)), strict=True):
                part = table.slice(a, b - a)
                x, y = b"".join(part["x"].to_pylist()), part["label"].to_numpy().astype(np.int8).tobytes()
                yield pa.RecordBatch.from_pydict({"block": part["block"].combine_chunks()[:1], "x": pa.array([x]), "y": pa.array([y])})

    place = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(-(-n // block)))
    dealt = seen.withColumn("block", place).repartition("block").sortWithinPartitions("block", "doc_id")
    blocks = write_table(map_arrow(dealt.select("block", "label", "x"), gathered, "block bigint, x binary, y binary"), "blocks")

    sums = _over_blocks(blocks, lambda x, y: x.sum(axis=0, dtype=np.float64), merge=False)
    mean = sums.sum(axis=0) / n
    scale = np.sqrt(_over_blocks(blocks, lambda x, y: ((x - mean) ** 2).sum(axis=0), merge=False).sum(axis=0) / n) + 1e-3
    weight = np.zeros(FEATURES)
    for _ in range(STEPS):
        found = _over_blocks(blocks, lambda x, y, w=weight: _block_slope(np.clip((x - mean) / scale, -8, 8), y, w))
        pairs = found[0]
        if not pairs:
            break
        curve = found[1 + FEATURES :].reshape(FEATURES, FEATURES) / pairs + PENALTY * np.eye(FEATURES)
        step = np.linalg.solve(curve, found[1 : 1 + FEATURES] / pairs + PENALTY * weight)
        weight = weight - step
        if np.abs(step).max() < 1e-4:
            break
    made = Ranking(mean, scale, weight, 0.0, 1.0)
    stats = _over_blocks(blocks, lambda x, y: (lambda r: np.array([r.sum(), (r * r).sum(), r.min(), r.max()]))(made.raw(x)), merge=False)
    total, squares = stats[:, 0].sum(), stats[:, 1].sum()
    spread = np.sqrt(max(squares / n - (total / n) ** 2, 0.0))
    made.cut = _quantile(blocks, made.raw, (n - ones) / n, n, stats[:, 2].min(), stats[:, 3].max())
    made.slope = float(4.0 / (spread + 1e-9))
    return made


def scored(docs: DataFrame, model: Ranking) -> DataFrame:
    """doc_id, score of every document."""
    return score_documents(docs, model.score)


def good_documents(docs: DataFrame, model: Ranking) -> DataFrame:
    """The documents, with all their columns, at or above the cut."""
    return keep_documents(docs, lambda column: model.score(column) >= CUT)
