"""Words of whole text columns as NumPy arrays.

A text column arrives as an Arrow array: one byte buffer and one offset per
text.  Everything here works on those buffers, in pieces of about a megabyte,
so memory follows the batch and not the number of words times a Python object.
A word is known by the 64-bit value of a polynomial over its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


def byte_table(*ranges: tuple[int, int]) -> np.ndarray:
    """True for the byte values inside the given closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


AS_IS = np.arange(256, dtype=np.uint8)
LOWER = AS_IS.copy()
LOWER[ord("A") : ord("Z") + 1] += 32
SPACE = byte_table((0x20, 0x20), (0x09, 0x0D))
#: Words of everything but ASCII white space.
NOT_SPACE = ~SPACE
#: Words of ASCII digits, lower-case letters and every character beyond ASCII.
ALNUM = byte_table((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the n + 1 offsets; a null is an empty text."""
    if pa.types.is_null(column.type):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1].copy()
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class _Powers:
    """Powers of the base and of its inverse, grown when a piece is longer."""

    up = np.zeros(0, np.uint64)
    down = np.zeros(0, np.uint64)

    @classmethod
    def of(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            cls.up = _powers(n, int(_BASE))
            cls.down = _powers(n, pow(int(_BASE), -1, 2**64))
        return cls.up, cls.down


def span_hash(piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit value of each byte span of a piece; equal spans have equal values."""
    up, down = _Powers.of(len(piece) + 1)
    total = np.zeros(len(piece) + 1, np.uint64)
    np.cumsum(_BYTE_VALUE[piece] * up[: len(piece)], out=total[1:])
    value = (total[end] - total[start]) * down[start]
    return mix(value + (end - start).astype(np.uint64) * np.uint64(0xA0761D6478BD642F))


def _piece_end(data: np.ndarray, at: int, offsets: np.ndarray, inside: np.ndarray) -> int:
    """First place from ``at`` on where no word is cut: a text's start or a byte outside words."""
    if at >= len(data):
        return len(data)
    k = np.searchsorted(offsets, at)
    limit = int(offsets[k]) if k < len(offsets) else len(data)
    while at < limit:
        out = np.flatnonzero(~inside[data[at : min(at + 65536, limit)]])
        if len(out):
            return at + int(out[0])
        at = min(at + 65536, limit)
    return limit


def words(
    data: np.ndarray, offsets: np.ndarray, fold: np.ndarray = LOWER, inside: np.ndarray = NOT_SPACE
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of each word, and the n + 1 word offsets of the texts."""
    inside = inside[fold]
    hashes, starts, ends = [], [], []
    at = 0
    while at < len(data):
        stop = _piece_end(data, at + PIECE, offsets, inside)
        piece = fold[data[at:stop]]
        flag = inside[data[at:stop]]
        left, right = flag.copy(), flag.copy()
        left[1:] &= ~flag[:-1]
        right[:-1] &= ~flag[1:]
        cut = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at
        left[cut] = flag[cut]
        cut = cut[cut > 0] - 1
        right[cut] = flag[cut]
        start, end = np.flatnonzero(left), np.flatnonzero(right) + 1
        hashes.append(span_hash(piece, start, end))
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return (
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64),
        start,
        np.concatenate(ends) if ends else none,
        np.searchsorted(start, offsets),
    )


def text_slices(offsets: np.ndarray, limit: int = PIECE, most: int = 4096) -> list[tuple[int, int]]:
    """Runs of at most ``most`` whole texts of about ``limit`` bytes; a longer text is a run of its own."""
    out, at, n = [], 0, len(offsets) - 1
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        out.append((at, min(stop, at + most, n)))
        at = out[-1][1]
    return out
