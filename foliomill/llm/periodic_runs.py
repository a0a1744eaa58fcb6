"""Runs of consecutive words that repeat with a period, by longest common extensions.

A run with period q and at least ``TIMES * q`` words holds two words q apart that
start at a multiple of ``(TIMES - 1) * q``, so it is enough to look at those places for
every q (a harmonic grid, about ``n * log(n) / 3`` of them).  Where the two words and
two neighbouring pairs are equal, the longest common extension to both sides gives the
maximal run.

Extensions are answered by a difference cover: of each ``COVER_STEP`` (64) places only the
15 of a cover are sampled, which hold, for any two places, a common distance below
64 after which both are sampled.  Only the sampled suffixes are sorted, as rows of
blocks of 64 words, by doubling; a sparse table over the common prefixes of
neighbours answers the minimum between any two.  A query compares the few words up to
the synchronised samples, takes the minimum, and compares the words of the first
block that differs.  The same over the reversed words extends to the left.

All steps work on arrays over many texts, with a symbol of its own at each end of a
text, which no extension passes.  Words are known by 64-bit hashes.

Defined results: a null, empty or blank text has no words and no run, its collapsed text is
empty; words are compared as they are, upper and lower case apart; rows that repeat a doc_id are
scanned one by one; a null doc_id stays null; runs that overlap are all listed; extra
columns take no part.  One text is worked on in one task, in memory and time that grow with n and n log n.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches
from .textbytes import AS_IS, NOT_SPACE, mix, text_bytes, text_slices, words

#: A run has at least this many words and this many periods.
LEAST, TIMES = 6, 4
_ROOT = 8
COVER_STEP = _ROOT * _ROOT
SLICE_BYTES = 4 << 20


def _cover() -> tuple[np.ndarray, np.ndarray]:
    """Whether a residue is sampled, and the least distance after which two residues both are."""
    cover = np.zeros(COVER_STEP, bool)
    cover[:_ROOT] = True
    cover[::_ROOT] = True
    place = np.arange(COVER_STEP)
    both = cover[(place[:, None, None] + place) % COVER_STEP] & cover[(place[None, :, None] + place) % COVER_STEP]
    return cover, both.argmax(axis=2)


_SAMPLED, _DISTANCE = _cover()
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


class CoverExtensions:
    """Longest common extensions to the right in an array whose last symbol occurs once."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.symbols, n = symbols, len(symbols)
        at = np.flatnonzero(_SAMPLED[np.arange(n) % COVER_STEP])
        many = len(at)
        index = np.full(n + 1, many, np.int64)
        index[at] = np.arange(many)
        levels = [np.append(self._blocks(at), -1)]
        while len(levels) < 2 or levels[-1].max() + 1 < many:
            now = levels[-1]
            after = now[index[np.minimum(at + (COVER_STEP << (len(levels) - 1)), n)]]
            levels.append(np.append(np.unique(now[:-1] * (many + 2) + after + 1, return_inverse=True)[1], -1))
        rank = levels.pop()[:-1]
        order = np.argsort(rank)
        left, right = at[order[:-1]], at[order[1:]]
        common = np.zeros(max(0, many - 1), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = levels[k][index[np.minimum(left, n)]] == levels[k][index[np.minimum(right, n)]]
            common += same.astype(np.int64) << k
            left, right = left + (same * (COVER_STEP << k)), right + (same * (COVER_STEP << k))
        self.rank, self.index = rank, index
        self.least = [common]
        while 2 << (len(self.least) - 1) <= len(common):
            row, half = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(row[:-half], row[half:]))

    def _blocks(self, at: np.ndarray) -> np.ndarray:
        """A number for the block of words at each sampled place, equal for equal blocks."""
        n = len(self.symbols)
        total = np.zeros(n + COVER_STEP + 1, np.uint64)
        with np.errstate(over="ignore"):
            np.cumsum(mix(self.symbols.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, n), out=total[1 : n + 1])
            total[n + 1 :] = total[n]
            value = (total[at + COVER_STEP] - total[at]) * _powers(_INVERSE, n)[at]
        return np.unique(value, return_inverse=True)[1]

    def _compared(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of the first ``most`` symbols from i and j on are equal."""
        out, open_ = np.zeros(len(i), np.int64), np.flatnonzero(most > 0)
        while len(open_):
            same = self.symbols[i[open_] + out[open_]] == self.symbols[j[open_] + out[open_]]
            open_ = open_[same]
            out[open_] += 1
            open_ = open_[out[open_] < most[open_]]
        return out

    def extend(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Number of equal symbols from i and j (i <> j) on."""
        far = _DISTANCE[i % COVER_STEP, j % COVER_STEP]
        out = self._compared(i, j, far)
        on = np.flatnonzero(out == far)
        a, b = self.rank[self.index[i[on] + far[on]]], self.rank[self.index[j[on] + far[on]]]
        a, b = np.minimum(a, b), np.maximum(a, b)
        level = np.frexp(b - a)[1] - 1
        blocks = np.zeros(len(on), np.int64)
        for k in np.unique(level).tolist():
            here = np.flatnonzero(level == k)
            row = self.least[k]
            blocks[here] = np.minimum(row[a[here]], row[b[here] - (1 << k)])
        out[on] += blocks * COVER_STEP
        out[on] += self._compared(i[on] + out[on], j[on] + out[on], np.full(len(on), COVER_STEP))
        return out


def _grid(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places x and periods q of the grid where three neighbouring words, that at x among them, recur q words on."""
    places, periods = [], []
    for q in range(1, longest // TIMES + 1):
        step = (TIMES - 1) * q
        right = symbols[q::step]
        hit = np.flatnonzero(symbols[: len(right) * step : step][: len(right)] == right)
        if len(hit):
            places.append(hit * step)
            periods.append(np.full(len(hit), q))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, q = np.concatenate(places), np.concatenate(periods)
    ends = np.arange(4, dtype=np.uint64)
    padded = np.concatenate([ends[:2], symbols, ends[2:]])
    near = {k: padded[x + 2 + k] == padded[x + q + 2 + k] for k in (-2, -1, 1, 2)}
    keep = (near[1] & near[2]) | (near[-1] & near[1]) | (near[-1] & near[-2])
    return x[keep], q[keep]


def _with_ends(values: np.ndarray, first: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The values with one of the n + 1 end symbols before, between and after the texts."""
    out = np.empty(len(values) + len(first), values.dtype)
    ended = first + np.arange(len(first))
    out[ended] = ends
    inside = np.ones(len(out), bool)
    inside[ended] = False
    out[inside] = values
    return out


def find_runs(values: np.ndarray, first: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Rows (text, start, length, period) of all runs, in that order; ``values`` are the words of all texts."""
    n = len(first) - 1
    none = np.zeros((0, 4), np.int64)
    size = np.diff(first)
    if not size.max(initial=0):
        return none
    symbols = _with_ends(values, first, mix(np.arange(n + 1, dtype=np.uint64)))
    x, q = _grid(symbols, int(size.max()))
    if not len(x):
        return none
    # Text k is at first[k] + k + 1 of the symbols; a hit on an end symbol is refused by the extension.
    text = np.clip(np.searchsorted(first + np.arange(n + 1), x, side="right") - 1, 0, n - 1)
    x = x - (first[text] + text + 1)
    keep = (x >= 0) & (x + q < size[text])
    x, q, text = x[keep], q[keep], text[keep]
    if not len(x):
        return none
    # Only texts with a candidate go on, their words numbered.
    chosen, at = np.unique(text, return_inverse=True)
    there = np.zeros(n, bool)
    there[chosen] = True
    number = np.unique(values[np.repeat(there, size)], return_inverse=True)[1].astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(size[chosen])])
    many = int(number.max()) + 1
    symbols = _with_ends(number, begin, many + np.arange(len(begin)))
    x = x + begin[at] + at + 1
    right = CoverExtensions(symbols).extend(x, x + q)
    left = CoverExtensions(symbols[::-1].copy()).extend(len(symbols) - x, len(symbols) - x - q)
    length = left + right + q
    long = (length >= np.maximum(least, TIMES * q)) & (right > 0)
    found = np.stack([chosen[at], x - left - begin[at] - at - 1, length, q], axis=1)[long]
    found = np.unique(found, axis=0)
    # A multiple of a run's period finds the same stretch again; the smallest comes first.
    new = np.ones(len(found), bool)
    new[1:] = (found[1:, :3] != found[:-1, :3]).any(axis=1)
    found = found[new]
    return found[np.lexsort((found[:, 3], found[:, 1], found[:, 0]))]


def kept_words(first: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether each word stays when of every run only the first period does."""
    change = np.zeros(int(first[-1]) + 1, np.int64)
    start = first[runs[:, 0]] + runs[:, 1]
    np.add.at(change, start + runs[:, 3], 1)
    np.add.at(change, start + runs[:, 2], -1)
    return np.cumsum(change)[:-1] == 0


def _joined(data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> pa.Array:
    """Texts of the given words (byte spans), joined by one space."""
    size = end - start + 1
    total = np.concatenate([[0], np.cumsum(size)])
    out = np.full(int(total[-1]) + 1, 0x20, np.uint8)
    if len(start):
        place = np.arange(int(total[-1]), dtype=np.int64) + np.repeat(start - total[:-1], size)
        place[total[1:] - 1] = start
        out[:-1] = data[place]
        out[total[1:] - 1] = 0x20
    begin, stop = total[first[:-1]], total[first[1:]]
    stop = np.where(stop > begin, stop - 1, stop)
    # The space after a text's last word is dropped by taking every text without it.
    keep = np.ones(int(total[-1]), bool)
    keep[stop[stop < total[first[1:]]]] = False
    offsets = np.concatenate([[0], np.cumsum(stop - begin)])
    return pa.Array.from_buffers(pa.large_binary(), len(first) - 1, [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(out[:-1][keep].tobytes())])


def _scanned(batch: pa.RecordBatch, edit: Callable[[int | None, int], tuple[int, int] | None] | None) -> dict:
    data, offsets = text_bytes(batch["text"])
    ids = batch["doc_id"].to_pylist() if edit else []
    counts, lists, texts = [], [], []
    for a, b in text_slices(offsets, SLICE_BYTES):
        part = data[offsets[a] : offsets[b]]
        hashes, start, end, first = words(part, offsets[a : b + 1] - offsets[a], AS_IS, NOT_SPACE)
        size = np.diff(first)
        if edit:
            source = np.arange(len(hashes))
            for k in range(b - a):
                if told := edit(ids[a + k], int(size[k])):
                    i, p = told
                    source[first[k] + i : first[k + 1]] = first[k] + i + np.arange(size[k] - i) % p
            hashes, start, end = hashes[source], start[source], end[source]
        runs = find_runs(hashes, first)
        keep = kept_words(first, runs)
        kept = np.concatenate([[0], np.cumsum(keep)])
        texts.append(_joined(part, start[keep], end[keep], kept[first]))
        rows = pa.StructArray.from_arrays([pa.array(runs[:, i]) for i in (1, 2, 3)], ["start", "length", "period"])
        lists.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(runs[:, 0], np.arange(b - a + 1)), pa.int32()), rows))
        counts.append(size)
    return {
        "doc_id": batch["doc_id"],
        "n_words": pa.array(np.concatenate(counts), pa.int64()),
        "runs": pa.concat_arrays(lists),
        "collapsed": pa.concat_arrays(texts).cast(pa.large_string()).cast(pa.string()),
    }


def scan(docs: DataFrame, edit: Callable[[int | None, int], tuple[int, int] | None] | None = None) -> DataFrame:
    """doc_id, n_words, runs (start word, length, period; by start, then period) and the collapsed text.

    ``edit`` may answer (a, p) for a doc_id and its number of words: the words from a on are
    then read as the p words from a on, over and over.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(docs, lambda x: _scanned(x, edit), "doc_id bigint, n_words bigint, runs array<struct<start bigint, length bigint, period bigint>>, collapsed string")
