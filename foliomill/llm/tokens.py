"""Token ids of whole text columns with the ``tokenizers`` library.

A byte-level BPE works inside the pieces its splitting pattern makes.  Texts are
cut into units at places where the pattern always ends a piece (before white
space that follows a visible character, and between an ASCII letter and ASCII
punctuation); each different unit is encoded once by the tokenizer and its ids
are put together again by array indexing.  The result is that of encoding the
whole text; the cut may only be used with tokenizers that pass ``fits_units``.
An added token of the tokenizer file (``<|endoftext|>``) is a unit of its own wherever it
occurs in a text, and becomes its id, as the library does by default.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from .textbytes import AS_IS, PIECE, SPACE, byte_table, span_hash, text_bytes

_VISIBLE = byte_table((0x21, 0x7E))
_LETTER = byte_table((0x41, 0x5A), (0x61, 0x7A))
_MARK = _VISIBLE & ~_LETTER & ~byte_table((0x30, 0x39))
_LEAD = byte_table((0xC3, 0xDF))  # of two-byte characters, none of which is white space
#: Units and ids of a full generation of the store; units encoded as one text.
_MOST_UNITS, _MOST_IDS, _CHAIN = 300_000, 3_000_000, 256


def _unit_starts(piece: np.ndarray) -> np.ndarray:
    """Whether a unit may start at each byte of a piece, judged from the two bytes before it."""
    before, lead = np.zeros(len(piece), np.uint8), np.zeros(len(piece), np.uint8)
    before[1:], lead[2:] = piece[:-1], piece[:-2]
    visible = _VISIBLE[before] | ((before >= 0x80) & _LEAD[lead])
    return (SPACE[piece] & visible) | (_LETTER[before] & _MARK[piece])


def fits_units(path: str) -> bool:
    """Whether a tokenizer file is a byte-level BPE that splits by the usual pattern and changes no text."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    split = made.get("pre_tokenizer") or {}
    plain = not made.get("normalizer") and not split.get("add_prefix_space") and split.get("use_regex", True)
    added = made.get("added_tokens") or []
    plain = plain and not any(x[k] for x in added for k in ("single_word", "lstrip", "rstrip")) and len({x["normalized"] for x in added}) < 2
    return made["model"]["type"] == "BPE" and split.get("type") == "ByteLevel" and plain


def _added_tokens(path: str, as_text: bool) -> re.Pattern | None:
    """Finds the added tokens, the longest first; special ones only if they are not ``as_text``."""
    with open(path, encoding="utf-8") as file:
        made = json.load(file).get("added_tokens") or []
    found = sorted((x["content"].encode() for x in made if not (as_text and x["special"])), key=len, reverse=True)
    return re.compile(b"|".join(map(re.escape, found))) if found else None


class _Store:
    """Units by hash (sorted), and where their ids are."""

    def __init__(self, dtype: np.dtype) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.start, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, dtype)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place of each key, and whether it is there."""
        place = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return place, self.keys[place] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def add(self, keys: np.ndarray, size: np.ndarray, ids: np.ndarray) -> None:
        """Add units (sorted keys that are not there) with their ids, one after the other."""
        at = np.searchsorted(self.keys, keys)
        self.keys = np.insert(self.keys, at, keys)
        self.start = np.insert(self.start, at, len(self.ids) + np.cumsum(size) - size)
        self.size = np.insert(self.size, at, size)
        self.ids = np.concatenate([self.ids, ids])

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the units at the places."""
        size = self.size[place]
        total = np.cumsum(size)
        return size, self.ids[np.repeat(self.start[place] - total + size, size) + np.arange(total[-1] if len(total) else 0)]


class Encoder:
    """One tokenizer file in one worker, with a bounded store of the units it has seen.

    The store has two generations: when the young one is full it becomes the old one, and
    units found there move on, so a unit that keeps coming is encoded once.
    ``as_text`` reads special tokens in a text as ordinary text; the operators do not (``of``).
    """

    _made: dict[str, Encoder] = {}

    def __init__(self, path: str, as_text: bool = True) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not fits_units(path):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = as_text
        self.added = _added_tokens(path, as_text)
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = np.dtype("<u2") if self.tokenizer.get_vocab_size() <= 1 << 16 else np.dtype("<u4")
        # A character of a token stands for one byte.
        self.bytes_of = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes_of[list(vocabulary.values())] = [len(x) for x in vocabulary]
        self.young, self.old = _Store(self.dtype), _Store(self.dtype)

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._made:
            cls._made[path] = cls(path, as_text=False)
        return cls._made[path]

    def _ids(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _chain(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray] | None:
        """Sizes and ids of units that may follow each other; they are encoded as a few texts and told apart by their bytes."""
        parts = [b"".join(units[i : i + _CHAIN]) for i in range(0, len(units), _CHAIN)]
        ids = np.concatenate([np.array(x, np.int64) for x in self._ids([x.decode() for x in parts])])
        end = np.cumsum(self.bytes_of[ids])
        last = np.searchsorted(end, np.cumsum([len(x) for x in units]))
        if len(ids) == 0 or last[-1] != len(ids) - 1 or (end[last] != np.cumsum([len(x) for x in units])).any():
            return None
        return np.diff(last, prepend=-1), ids.astype(self.dtype)

    def _encoded(self, piece: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sizes and ids of the units between the given bytes."""
        raw = piece.tobytes()
        first, last, lead = piece[start], piece[end - 1], np.where(end - start > 1, piece[end - 2], 0)
        visible = _VISIBLE[last] | ((last >= 0x80) & _LEAD[lead])
        spaced = SPACE[first] & visible
        marked = _MARK[first] & _LETTER[last]
        size, places, parts = np.zeros(len(start), np.int64), [], []
        for chosen in (spaced, marked, ~spaced & ~marked):
            at = np.flatnonzero(chosen)
            if not len(at):
                continue
            units = [raw[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
            told = self._chain(units) if spaced[at[0]] or marked[at[0]] else None
            if told is None:
                found = self._ids([x.decode() for x in units])
                told = np.fromiter(map(len, found), np.int64, len(found)), np.fromiter((x for ids in found for x in ids), self.dtype)
            size[at] = told[0]
            places.append(at)
            parts.append(told[1])
        # The ids of the three kinds back into the order of the units.
        place, ids = np.concatenate(places), np.concatenate(parts)
        owner = np.repeat(place, size[place])
        return size, ids[np.argsort(owner, kind="stable")]

    def _known(self, hashes: np.ndarray, start: np.ndarray, end: np.ndarray, piece: np.ndarray) -> np.ndarray:
        """Places of the units (distinct, in order of their hashes) in the young store; those it lacks are added."""
        if len(self.young.keys) > _MOST_UNITS or len(self.young.ids) > _MOST_IDS:
            self.young, self.old = _Store(self.dtype), self.young
        new = np.flatnonzero(~self.young.find(hashes)[1])
        if len(new):
            place, there = self.old.find(hashes[new])
            moved = new[there]
            if len(moved):
                self.young.add(hashes[moved], *self.old.of(place[there]))
            new = new[~there]
            if len(new):
                self.young.add(hashes[new], *self._encoded(piece, start[new], end[new]))
        return self.young.find(hashes)[0]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts and the n + 1 offsets; a null is an empty text."""
        data, offsets = text_bytes(column)
        first_added, end_added = self._added(data, offsets)
        parts, sizes, starts = [np.zeros(0, self.dtype)], [], []
        at = 0
        while at < len(data):
            stop = self._piece_end(data, at + PIECE, offsets)
            k = int(np.searchsorted(end_added, stop, side="right"))
            if k < len(first_added) and first_added[k] < stop:
                stop = int(end_added[k])
            piece = data[at:stop]
            begin = _unit_starts(piece)
            i, k = np.searchsorted(first_added, [at, stop])
            if i < k:
                left, right = first_added[i:k] - at, end_added[i:k] - at
                inside = np.zeros(len(piece) + 1, np.int8)
                np.add.at(inside, left, 1)
                np.add.at(inside, right, -1)
                begin &= np.cumsum(inside)[:-1] == 0
                begin[left] = True
                begin[right[right < len(piece)]] = True
            begin[0] = True
            begin[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, stop)] - at] = True
            start = np.flatnonzero(begin)
            end = np.append(start[1:], len(piece))
            hashes, first, inverse = np.unique(span_hash(AS_IS[piece], start, end), return_index=True, return_inverse=True)
            place = self._known(hashes, start[first], end[first], piece)[inverse]
            size, ids = self.young.of(place)
            parts.append(ids)
            sizes.append(size)
            starts.append(start + at)
            at = stop
        ids = np.concatenate(parts)
        if not sizes:
            return ids, np.zeros(len(offsets), np.int64)
        total = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])
        return ids, total[np.searchsorted(np.concatenate(starts), offsets)]

    def _added(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end byte of each added token; none reaches from one text into the next."""
        found = []
        raw = data.tobytes() if self.added else b""
        if self.added and self.added.search(raw):
            found = [x.span() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True) for x in self.added.finditer(raw, a, b)]
        spans = np.array(found, np.int64).reshape(-1, 2)
        return spans[:, 0], spans[:, 1]

    @staticmethod
    def _piece_end(data: np.ndarray, at: int, offsets: np.ndarray) -> int:
        """First place from ``at`` on where a text or a unit starts."""
        k = int(np.searchsorted(offsets, at))
        limit = int(offsets[k]) if k < len(offsets) else len(data)
        while at < limit:
            begin = np.flatnonzero(_unit_starts(data[at - 2 : min(at + 65536, limit)])[2:])
            if len(begin):
                return at + int(begin[0])
            at = min(at + 65536, limit)
        return min(limit, len(data))


def with_end(ids: np.ndarray, offsets: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Append one id to each text."""
    return np.insert(ids, offsets[1:], end), offsets + np.arange(len(offsets))
