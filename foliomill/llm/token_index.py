"""Token ids in binary shards with a minimal perfect hash index.

Documents are dealt by ranges of doc_id, encoded, and written in ascending order
as shards in the shared folder.  A shard is two files:

* ``shard-N.ids``: the raw ids of all its documents, little-endian, two bytes
  each for vocabularies of up to 65,536 ids and four beyond, nothing else;
* ``shard-N.idx``: a header line of JSON that names the arrays after it with
  type and length, then the arrays: the levels of the hash, a 32-bit
  fingerprint, first record and number of records of each slot, and the doc_id,
  null mark and first id of each record.

The minimal perfect hash throws the keys at a bit array of twice their number;
keys that are alone in their place stay, the others go on to the next, smaller
level; a key's slot is the number of set bits before its own.  A lookup hashes
once per level (about 1.5 on average), compares the fingerprint, so that a key
that was never stored is refused (but for one in 2^32), and reads one range of
the payload.

Files are written under the attempt's own name and then moved, so a repeated
attempt replaces equal files.  Defined results: a null text is empty and has
only the end id; rows that repeat a doc_id are records of one key, in the order
of their texts; rows without doc_id come first and have no key.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import fresh_shared_path
from .common import map_arrow, write_table
from .textbytes import mix
from .tokens import Encoder, with_end

SHARD_BYTES = 32 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _hash(keys: np.ndarray, level: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(keys.astype(np.uint64) + np.uint64(level + 1) * _STEP)


@dataclass
class PerfectHash:
    """Slots 0 .. n - 1 for n different keys."""

    sizes: np.ndarray
    bits: np.ndarray  # all levels, one after the other
    ranks: np.ndarray  # set bits before each 64-bit word

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, sizes, levels = keys.astype(np.uint64), [], []
        while len(keys):
            size = 64 * math.ceil(2 * len(keys) / 64)
            place = (_hash(keys, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(place, minlength=size) == 1
            sizes.append(size)
            levels.append(alone)
            keys = keys[~alone[place]]
        flat = np.concatenate(levels) if levels else np.zeros(0, bool)
        bits = np.packbits(flat, bitorder="little").view("<u8")
        ranks = np.concatenate([[0], np.cumsum(flat.reshape(-1, 64).sum(axis=1))])
        return cls(np.array(sizes, "<i8"), bits, ranks.astype("<i8"))

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for a key that no level can hold."""
        keys = keys.astype(np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes.tolist()):
            place = (_hash(keys[open_], level) % np.uint64(size)).astype(np.int64) + base
            word, bit = self.bits[place >> 6], (place & 63).astype(np.uint64)
            there = (word >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(word & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            out[open_[there]] = (self.ranks[place >> 6] + below)[there]
            open_, base = open_[~there], base + size
        return out


def _fingerprint(keys: np.ndarray) -> np.ndarray:
    return (_hash(keys, 1 << 20) >> np.uint64(32)).astype("<u4")


def _dump(arrays: dict[str, np.ndarray], width: int) -> bytes:
    head = {"width": width, "arrays": [[name, a.dtype.str, len(a)] for name, a in arrays.items()]}
    return json.dumps(head).encode() + b"\n" + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays.values())


class Shard:
    """One shard for keyed reads."""

    def __init__(self, path: str) -> None:
        files, place = fs.FileSystem.from_uri(path)
        with files.open_input_stream(place + ".idx") as stream:
            raw = stream.read()
        head, _, body = raw.partition(b"\n")
        at, arrays = 0, {}
        said = json.loads(head)
        for name, kind, n in said["arrays"]:
            arrays[name] = np.frombuffer(body, kind, n, at)
            at += arrays[name].nbytes
        self.width = said["width"]
        self.hash = PerfectHash(arrays["sizes"], arrays["bits"], arrays["ranks"])
        self.fingerprint, self.first, self.count = arrays["fingerprint"], arrays["first"], arrays["count"]
        self.keys, self.missing, self.offsets = arrays["keys"], arrays["missing"], arrays["offsets"]
        self.payload = files.open_input_file(place + ".ids")

    def records(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First record and number of records of each key, 0 of them for a key that isn't stored."""
        slot = self.hash.slots(keys)
        known = slot >= 0
        known[known] = self.fingerprint[slot[known]] == _fingerprint(keys[known])
        first, count = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[known], count[known] = self.first[slot[known]], self.count[slot[known]]
        return first, count

    def read(self, record: int, records: int = 1) -> np.ndarray:
        a, b = int(self.offsets[record]), int(self.offsets[record + records])
        return np.frombuffer(self.payload.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")

    def get(self, key: int) -> list[np.ndarray]:
        """The ids of each document stored under a key."""
        first, count = self.records(np.array([key], np.int64))
        return [self.read(r) for r in range(int(first[0]), int(first[0] + count[0]))]


def _write_shard(batches: Iterator[pa.RecordBatch], path: str, tokenizer: str, end: int) -> Iterator[pa.RecordBatch]:
    encoder, context = Encoder.of(tokenizer), TaskContext.get()
    files, folder = fs.FileSystem.from_uri(path)
    name = f"shard-{context.partitionId():08d}"
    own = f"{folder}/{name}-{context.taskAttemptId()}"
    keys, missing, sizes = [], [], []
    stream = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, offsets = with_end(*encoder.encode(batch["text"]), end)
        if stream is None:
            stream = files.open_output_stream(own + ".ids")
        stream.write(ids.astype(encoder.dtype, copy=False).tobytes())
        keys.append(batch["doc_id"].fill_null(0).to_numpy())
        missing.append(batch["doc_id"].is_null().to_numpy(zero_copy_only=False))
        sizes.append(np.diff(offsets))
    if stream is None:
        return
    stream.close()
    key, missed = np.concatenate(keys).astype("<i8"), np.concatenate(missing)
    offsets = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype("<i8")
    given = np.flatnonzero(~missed)
    distinct, first, count = np.unique(key[given], return_index=True, return_counts=True)
    made = PerfectHash.build(distinct)
    slot = made.slots(distinct)
    by_slot = {"fingerprint": np.zeros(len(slot), "<u4"), "first": np.zeros(len(slot), "<i8"), "count": np.zeros(len(slot), "<i8")}
    by_slot["fingerprint"][slot], by_slot["first"][slot], by_slot["count"][slot] = _fingerprint(distinct), given[first], count
    arrays = {"sizes": made.sizes, "bits": made.bits, "ranks": made.ranks, **by_slot, "keys": key, "missing": missed.astype("u1"), "offsets": offsets}
    with files.open_output_stream(own + ".idx") as out:
        out.write(_dump(arrays, encoder.dtype.itemsize))
    for kind in (".ids", ".idx"):
        files.move(own + kind, f"{folder}/{name}{kind}")
    yield pa.RecordBatch.from_pydict(
        {
            "path": pa.array([f"{path}/{name}"]),
            "part": pa.array([context.partitionId()], pa.int64()),
            "docs": pa.array([len(key)], pa.int64()),
            "ids": pa.array([int(offsets[-1])], pa.int64()),
        }
    )


def write_shards(docs: DataFrame, tokenizer: str, end: int, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Write all documents and return one row per shard: path, part, docs, ids, start (ids of all shards before it)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = docs.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    spark, path = docs.sparkSession, fresh_shared_path(docs.sparkSession, "tokens")
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    shared = where.getFileSystem(spark._jsc.hadoopConfiguration())
    shared.mkdirs(where)
    shared.deleteOnExit(where)
    dealt = docs.repartitionByRange(max(1, math.ceil(size / shard_bytes)), "doc_id").sortWithinPartitions(F.asc_nulls_first("doc_id"), "text")
    shards = map_arrow(dealt, lambda batches: _write_shard(batches, path, tokenizer, end), "path string, part bigint, docs bigint, ids bigint")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return write_table(shards, "shards").withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, each read from the files through its key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                shard = Shard(path)
                lost = np.flatnonzero(shard.missing)
                first, count = shard.records(np.unique(shard.keys[shard.missing == 0]))
                record = np.concatenate([lost, np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())])
                crc = [zlib.crc32(shard.read(int(r)).astype("<u4").tobytes()) for r in record]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array(shard.keys[record], pa.int64(), mask=shard.missing[record] == 1),
                        "start": pa.array(base + shard.offsets[record]),
                        "n_tokens": pa.array(shard.offsets[record + 1] - shard.offsets[record]),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                )

    dealt = shards.select("path", "start").repartition("path")
    return map_arrow(dealt, run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
