"""Benchmark decontamination: Wu-Manber search for many word windows at once.

Symbols are words (ASCII letters lowered; runs of digits, letters and everything
beyond ASCII).  A window is ``window`` consecutive words of a benchmark item; an
item with fewer words, but not none, is one window.  The windows of one length
form a searcher: a shift table over blocks of two words says how far the end of
the search window may jump, the block at a window's end and the block at its
start select the test windows, and a direct comparison confirms each one, first
by word numbers and then by the bytes of the words.  Many texts are searched in
step: each has a cursor, and every step moves all cursors by their own shifts.

Defined results: a null or empty text has no words and no hits; an item without
words is never found; an item without id marks words but is not listed; rows
that repeat an item id are one item; with no items nothing is hit; rows that
repeat a document give one row each.  Extra columns of the documents take no part.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow
from .textbytes import ALNUM, LOWER, mix, text_bytes, words

WINDOW = 10
#: Bytes of benchmark text that one broadcast searcher may hold; more text is searched in several passes.
PART_BYTES = 8 << 20
_SLOTS = 1 << 18
_STRIDE = 512


def _block_slot(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    key = first.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + second.astype(np.uint64)
    return (mix(key) & np.uint64(_SLOTS - 1)).astype(np.int64)


@dataclass
class Searcher:
    """Tables for all windows of one length over numbered words."""

    length: int
    codes: np.ndarray  # windows x length, distinct rows
    shift: np.ndarray = field(init=False)
    key: np.ndarray = field(init=False)  # (suffix slot, prefix slot) of each window, sorted
    order: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        m, c = self.length, self.codes.astype(np.int64)
        self.block = min(2, m)
        back = self.block - 1
        self.shift = np.full(_SLOTS, m - back, np.int64)
        for j in range(back, m):
            np.minimum.at(self.shift, _block_slot(c[:, j - back], c[:, j]), m - 1 - j)
        key = _block_slot(c[:, m - 1 - back], c[:, m - 1]) * _SLOTS + _block_slot(c[:, 0], c[:, back])
        self.order = np.argsort(key, kind="stable")
        self.key = key[self.order]

    def find(self, code: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First word and window number of every occurrence; no occurrence spans two texts."""
        m, back = self.length, self.block - 1
        low, high = first[:-1] + m - 1, first[1:]
        parts = np.maximum(0, -(-(high - low) // _STRIDE))
        text = np.repeat(np.arange(len(low)), parts)
        part = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        end = low[text] + part * _STRIDE
        stop = np.minimum(end + _STRIDE, high[text])
        seen = []
        while len(end):
            jump = self.shift[_block_slot(code[end - back], code[end])]
            seen.append(end[jump == 0])
            end = end + np.maximum(jump, 1)
            live = end < stop
            end, stop = end[live], stop[live]
        end = np.concatenate(seen) if seen else np.zeros(0, np.int64)
        start = end - m + 1
        key = _block_slot(code[end - back], code[end]) * _SLOTS + _block_slot(code[start], code[start + back])
        a, b = np.searchsorted(self.key, key, "left"), np.searchsorted(self.key, key, "right")
        n = b - a
        window = self.order[np.repeat(a, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
        start = np.repeat(start, n)
        same = np.ones(len(start), bool)
        for j in range(m):
            same[same] = code[start[same] + j] == self.codes[window[same], j]
        return start[same], window[same]


@dataclass
class Index:
    """All windows of a part of the benchmark."""

    hashes: np.ndarray
    vocabulary: list[bytes]
    searchers: list[Searcher]
    items: list[list[list[str]]]  # by searcher and window

    @classmethod
    def build(cls, rows: list[tuple[str | None, str | None]], window: int) -> Index:
        data, offsets = text_bytes(pa.array([text for _, text in rows], pa.string()))
        hashes, start, end, first = words(data, offsets, LOWER, ALNUM)
        known, at, code = np.unique(hashes, return_index=True, return_inverse=True)
        vocabulary = [LOWER[data[start[i] : end[i]]].tobytes() for i in at]
        found: dict[int, dict[tuple[int, ...], set]] = {}
        for (item, _), a, b in zip(rows, first[:-1], first[1:], strict=True):
            m = min(window, int(b - a))
            for i in range(a, b - m + 1 if m else a):
                found.setdefault(m, {}).setdefault(tuple(code[i : i + m].tolist()), set()).add(item)
        searchers = [Searcher(m, np.array(list(w), np.int32).reshape(-1, m)) for m, w in sorted(found.items())]
        items = [[sorted(x for x in v if x is not None) for v in w.values()] for _, w in sorted(found.items())]
        return cls(known, vocabulary, searchers, items)

    def search(self, column: pa.Array) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, int]]]:
        """Word offsets of the texts, and for each window length the confirmed occurrences."""
        data, offsets = text_bytes(column)
        hashes, start, end, first = words(data, offsets, LOWER, ALNUM)
        if not len(self.hashes):
            return first, []
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        code = np.where(self.hashes[at] == hashes, at, len(self.hashes)).astype(np.int32)
        out = []
        for k, searcher in enumerate(self.searchers):
            where, window = searcher.find(code, first)
            sure = np.ones(len(where), bool)
            for i, (s, w) in enumerate(zip(where.tolist(), window.tolist(), strict=True)):
                want = [self.vocabulary[c] for c in searcher.codes[w]]
                sure[i] = want == [LOWER[data[a:b]].tobytes() for a, b in zip(start[s : s + len(want)], end[s : s + len(want)], strict=True)]
            out.append((where[sure], window[sure], k))
        return first, out


def _lists(rows: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """One list for each of n rows from values that are sorted by row."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), values)


def _marked(index: Index, batch: pa.RecordBatch) -> dict:
    """Add one part's occurrences to the spans and items that earlier parts have found."""
    n = batch.num_rows
    first, found = index.search(batch["text"])
    edge = np.zeros(first[-1] + n + 1, np.int64)  # one place between texts, so that no span runs on
    shifted = lambda at, row: at + row
    pairs = [set(x or ()) for x in batch["items"].to_pylist()]
    for row, spans in enumerate(batch["spans"].to_pylist()):
        for span in spans or ():
            edge[first[row] + row + span["first"]] += 1
            edge[first[row] + row + span["end"]] -= 1
    for where, window, k in found:
        row = np.searchsorted(first, where, "right") - 1
        np.add.at(edge, shifted(where, row), 1)
        np.add.at(edge, shifted(where, row) + index.searchers[k].length, -1)
        for r, w in set(zip(row.tolist(), window.tolist(), strict=True)):
            pairs[r].update(index.items[k][w])
    hit = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8), [0]])
    step = np.diff(hit)
    begin, stop = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    base = first[:-1] + np.arange(n)
    row = np.searchsorted(base, begin, "right") - 1
    spans = pa.StructArray.from_arrays([pa.array(begin - base[row], pa.int64()), pa.array(stop - base[row], pa.int64())], ["first", "end"])
    total = np.concatenate([[0], np.cumsum(stop - begin)])
    at = np.searchsorted(row, np.arange(n + 1))
    return {
        "doc_id": batch["doc_id"],
        "text": batch["text"],
        "n_words": pa.array(np.diff(first), pa.int64()),
        "n_hit": pa.array(total[at[1:]] - total[at[:-1]], pa.int64()),
        "spans": _lists(row, spans, n),
        "items": pa.array([sorted(x) for x in pairs], pa.list_(pa.string())),
    }


def _indexes(items: DataFrame, window: int, part_bytes: int) -> list:
    """Broadcast searchers, each over a part of the benchmark of about ``part_bytes`` at most.

    The parts are read one by one, so neither the driver nor a worker holds more than one.
    """
    items = items.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, math.ceil(size / part_bytes))
    share = items.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(parts)))
    context = items.sparkSession.sparkContext
    for k in range(parts):
        rows = [(r.item_id, r.text) for r in share.where(F.col("part") == k).collect()]
        yield context.broadcast(Index.build(rows, window))


def occurrences(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, spans (hit words as first and end), items (ids of items with occurring windows)."""
    schema = "doc_id {}, text string, n_words bigint, n_hit bigint, spans array<struct<first:bigint,end:bigint>>, items array<string>".format(
        docs.schema["doc_id"].dataType.simpleString()
    )
    state = docs.select(
        "doc_id",
        "text",
        F.array().cast("array<struct<first:bigint,end:bigint>>").alias("spans"),
        F.array().cast("array<string>").alias("items"),
    )
    for index in _indexes(items, window, part_bytes):

        def run(batches, index=index):
            for batch in batches:
                yield pa.RecordBatch.from_pydict(_marked(index.value, batch))

        state = map_arrow(state.select("doc_id", "text", "spans", "items"), run, schema)
    return state.drop("text")


def clean_documents(docs: DataFrame, items: DataFrame, window: int = WINDOW, part_bytes: int = PART_BYTES) -> DataFrame:
    """The documents, with all their columns, in which no window occurs."""
    for index in _indexes(items, window, part_bytes):

        def run(batches, index=index):
            for batch in batches:
                first, found = index.value.search(batch["text"])
                hit = np.zeros(batch.num_rows, bool)
                for where, _, _ in found:
                    hit[np.searchsorted(first, where, "right") - 1] = True
                yield batch.filter(pa.array(~hit))

        docs = map_arrow(docs, run, docs.schema)
    return docs
