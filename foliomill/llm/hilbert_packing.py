"""Packing along a space-filling curve.

A document's token ids are counted in hashed bins, the root of the counts is
brought to length one and projected on ``DIMENSIONS`` fixed random directions;
the point's place on a Hilbert curve is its key.  Documents are dealt and sorted
by ranges of key and doc_id, so that neighbours on the curve are packed next to
each other, and each task lays its documents end to end and cuts the row of ids
into sequences of ``LENGTH``.  What remains at a task's end is cut into powers
of two, which need no padding, so there is no padding at all.

The doc_id in the range key splits a group of equal texts over many tasks.
Defined results: a null text is empty, a document of the end id only; rows that
repeat a doc_id are packed one by one; ties on the curve follow doc_id (null
first), then the ids; extra columns take no part.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, map_batches, write_table
from .textbytes import mix
from .tokens import Encoder, with_end

LENGTH = 1024
DIMENSIONS, BITS = 4, 15
_BINS = 256
_DIRECTIONS = np.random.default_rng(17).standard_normal((_BINS, DIMENSIONS))


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of points with coordinates of ``bits`` bits (n x dimensions)."""
    x = points.astype(np.int64).T.copy()
    n = len(x)
    # Undo the excess rotations and reflections of each cube, from the largest to the smallest ...
    for level in range(bits - 1, 0, -1):
        one, below = 1 << level, (1 << level) - 1
        for i in range(n):
            set_ = (x[i] & one) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] ^= np.where(set_, below, swap)
            x[i] ^= swap
    # ... then Gray-code the coordinates against each other.
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, 0, -1):
        flip ^= np.where(x[n - 1] & (1 << level), (1 << level) - 1, 0)
    x ^= flip
    key = np.zeros(x.shape[1], np.int64)
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> level) & 1)
    return key


def curve_keys(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The key of each document from its token ids."""
    n = len(offsets) - 1
    value = mix(np.arange(int(ids.max(initial=0)) + 1, dtype=np.uint64) + np.uint64(99))[ids]
    text = np.repeat(np.arange(n), np.diff(offsets))
    count = np.bincount(text * _BINS + (value & np.uint64(_BINS - 1)).astype(np.int64), minlength=n * _BINS).reshape(n, _BINS)
    vector = np.sqrt(count)
    vector /= np.maximum(1e-9, np.linalg.norm(vector, axis=1, keepdims=True))
    # Directions of mean 0 would meet mostly the part that all texts share; a steep slope spreads the rest.
    place = 1 / (1 + np.exp(-4 * (vector @ _DIRECTIONS - _DIRECTIONS.mean(axis=0) * np.sqrt(_BINS) * 0.8)))
    return hilbert_keys(np.minimum((place * (1 << BITS)).astype(np.int64), (1 << BITS) - 1), BITS)


def _encoded(batch: pa.RecordBatch, tokenizer: str, end: int) -> dict:
    encoder = Encoder.of(tokenizer)
    ids, offsets = with_end(*encoder.encode(batch["text"]), end)
    raw = pa.py_buffer(ids.astype(encoder.dtype, copy=False).tobytes())
    bytes_ = pa.array(offsets * encoder.dtype.itemsize, pa.int32())
    packed = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, bytes_.buffers()[1], raw])
    return {"doc_id": batch["doc_id"], "key": pa.array(curve_keys(ids, offsets)), "ids": packed}


def _pieces(batches: Iterator[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """Cut the ids of one task into pieces; holds back what is less than a sequence."""
    base = TaskContext.get().partitionId() << 32
    sequence = 0
    held: list[tuple] = []  # (doc_id, start, bytes, doc_tokens)
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    kinds = (pa.int64(),) * 7

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))

    def emit(goal: int) -> list[tuple]:
        """One sequence of ``goal`` ids from the front of what is held."""
        nonlocal sequence
        rows, filled, used = [], 0, 0
        for doc, start, ids, total in held:
            take = min(goal - filled, len(ids) // width)
            now = ids[: take * width]
            rows.append((doc, start, take, zlib.crc32(np.frombuffer(now, f"<u{width}").astype("<u4").tobytes()), total, base + sequence, filled))
            filled += take
            if take * width < len(ids):
                held[used] = (doc, start + take, ids[take * width :], total)
                break
            used += 1
            if filled == goal:
                break
        del held[:used]
        sequence += 1
        return rows

    size = 0
    for batch in batches:
        rows: list[tuple] = []
        for doc, ids in zip(batch["doc_id"].to_pylist(), batch["ids"], strict=True):
            ids = memoryview(ids.as_buffer())
            held.append((doc, 0, ids, len(ids) // width))
            size += len(ids) // width
            while size >= length:
                rows += emit(length)
                size -= length
            if len(rows) >= 50_000:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)
    rows = []
    for bit in range(length.bit_length() - 1, -1, -1):
        if size >> bit & 1:
            rows += emit(1 << bit)
    if rows:
        yield batch_of(rows)


def packed(docs: DataFrame, tokenizer: str, end: int, length: int = LENGTH) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``length`` is a power of two.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = map_batches(docs, lambda x: _encoded(x, tokenizer, end), "doc_id bigint, key bigint, ids binary")
    width = Encoder.of(tokenizer).dtype.itemsize
    along = write_table(made, "encoded").repartitionByRange("key", "doc_id").sortWithinPartitions("key", "doc_id", "ids")
    return map_arrow(
        along,
        lambda batches: _pieces(batches, length, width),
        "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    )
