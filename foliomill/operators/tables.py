"""Chains of per-value maps as one table per page.

Level correction, white balance, curves, inversion and their like map each
sample by its value and channel alone.  A chain of them needs the page's counts
once: every step makes its 256-entry table from the counts before it, the counts
are pushed through the table, and the tables are composed.  So a chain with several
page statistics reads the samples twice, once to count and once to map, and only
the tables, a row per page, are kept between its steps.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.lines import as_binary, as_lists, blocks, flat_bytes, flat_lines, lines_of, map_batches, whole_groups
from ..functions.scale import PAGE_BAND, cut_lineage, join_page_stats
from .tone import apply_lut

#: A step is a fixed table, or makes one per page and channel from counts (pages x 3 x 256).
Step = Sequence[int] | Callable[[np.ndarray], np.ndarray]
_VALUES = np.arange(256)
#: Of the 768 counts in a row, by half its bytes over 768.
_COUNT_TYPES = (np.uint8, np.uint16, np.uint32)


def _byte(x: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(x + 0.5), 0, 255).astype(np.int64)


def _identity(counts: np.ndarray) -> np.ndarray:
    return np.broadcast_to(_VALUES, counts.shape)


def _coloured(counts: np.ndarray) -> np.ndarray:
    return counts[:, 1].sum(axis=1) > 0


def _mean(counts: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Mean per page and channel of values[page, channel, v], counted."""
    return (counts * values).sum(axis=2) / np.maximum(1, counts.sum(axis=2))


def _ends(counts: np.ndarray, clip: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First value from each end (of the last axis) whose running count exceeds ``clip``."""
    up = np.cumsum(counts, axis=-1) > clip[..., None]
    down = np.cumsum(counts[..., ::-1], axis=-1) > clip[..., None]
    low = np.where(up.any(axis=-1), up.argmax(axis=-1), 0)
    high = np.where(down.any(axis=-1), 255 - down.argmax(axis=-1), 255)
    return low, high


def white_balance(counts: np.ndarray) -> np.ndarray:
    """Gray-world gains; a dead channel or a gray page stays as it is."""
    mean = _mean(counts, _identity(counts))
    alive = _coloured(counts) & (mean.min(axis=1) >= 1e-6)
    middle = (mean[:, 0] + mean[:, 1] + mean[:, 2]) / 3.0
    gain = middle[:, None] / np.where(alive[:, None], mean, 1.0)
    return np.where(alive[:, None, None], _byte(_VALUES * gain[:, :, None]), _VALUES)


def auto_levels(clip_percent: float = 0.5) -> Callable[[np.ndarray], np.ndarray]:
    """Stretch between the points that the pooled counts of a page give."""
    share = max(0.0, min(20.0, clip_percent)) / 100.0

    def table(counts: np.ndarray) -> np.ndarray:
        pooled = counts.sum(axis=1)
        black, white = _ends(pooled, share * pooled.sum(axis=1))
        kept = (white <= black) | ((black == 0) & (white == 255))
        span = np.maximum(white - black, 1)
        made = _byte(np.clip((_VALUES - black[:, None]) / span[:, None], 0.0, 1.0) * 255.0)
        return np.broadcast_to(np.where(kept[:, None], _VALUES, made)[:, None], counts.shape)

    return table


def restore_fading(counts: np.ndarray) -> np.ndarray:
    """Stretch per channel and soft gray-world gain of its outcome; gray pages stay."""
    low, high = _ends(counts, np.maximum(np.floor(counts.sum(axis=2) * 0.005), 1))
    high = np.where(high <= low, np.minimum(low + 1, 255), high)
    span = (high - low)[:, :, None]
    part = np.where(span == 0, -1.0, (_VALUES - low[:, :, None]) / np.where(span == 0, 1, span))
    stretched = _byte(np.clip(part, 0.0, 1.0) * 255.0)
    mean = _mean(counts, stretched)
    alive = mean.min(axis=1) >= 1e-6
    middle = (mean[:, 0] + mean[:, 1] + mean[:, 2]) / 3.0
    gain = np.where(alive[:, None], (middle[:, None] / np.where(alive[:, None], mean, 1.0) - 1.0) * 0.85 + 1.0, 1.0)
    return np.where(_coloured(counts)[:, None, None], _byte(stretched * gain[:, :, None]), _VALUES)


def composed(counts: np.ndarray, steps: Sequence[Step]) -> np.ndarray:
    """One table per page and channel for all steps in order."""
    pages = len(counts)
    out = np.broadcast_to(_VALUES, (pages, 3, 256)).copy()
    row = np.arange(pages * 3)[:, None] * 256
    for step in steps:
        table = step(counts) if callable(step) else np.broadcast_to(np.asarray(step), (pages, 3, 256))
        out = np.take_along_axis(table, out, axis=2)
        # Whole numbers below 2^53 stay exact as weights.
        moved = np.bincount((row + table.reshape(-1, 256)).ravel(), weights=counts.ravel(), minlength=counts.size)
        counts = moved.astype(np.int64).reshape(counts.shape)
    return out


def _channel(size: np.ndarray, line: np.ndarray, bpp: np.ndarray) -> np.ndarray:
    """The channel of flat samples; ``size`` of them have a row, ``line`` of them a line of it."""
    total = int(size.sum())
    one = int(bpp[0]) if len(bpp) else 1
    if one in (1, 3, 4) and (bpp == one).all() and not (line % one).any():
        return np.tile(np.arange(one, dtype=np.int32), total // one)
    place = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
    return (place % np.repeat(np.maximum(line, 1), size) % np.repeat(np.maximum(bpp, 1), size)).astype(np.int32)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of the colour samples, one deflated row of 3 * 256 per page and piece of a batch."""
    for whole in batches:
        for at in range(0, whole.num_rows, 1024):
            batch = whole.slice(at, 1024)
            v, size = flat_lines(batch["row"])
            code = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            _, first, page = np.unique(code, return_index=True, return_inverse=True)
            reach = np.zeros(len(first), np.int64)
            np.maximum.at(reach, page, batch["y"].to_numpy(zero_copy_only=False).astype(np.int64) + 1)
            of = _channel(size, size, batch["bpp"].to_numpy(zero_copy_only=False).astype(np.int64))
            key = np.repeat((page * 1024).astype(np.int32), size) + of * np.int32(256) + v
            counts = np.bincount(key, minlength=len(first) * 1024).reshape(-1, 1024)[:, :768]
            ids = batch["page_id"].take(pa.array(first))
            # Small counts take a byte each.
            wide = np.searchsorted([1 << 8, 1 << 16], counts.max(axis=1), side="right")
            data = [zlib.compress(one.astype(_COUNT_TYPES[w]), 1) for one, w in zip(counts, wide.tolist())]
            yield pa.RecordBatch.from_arrays([ids, pa.array(reach), pa.array(data, pa.binary())], names=["page_id", "reach", "counts"])


def page_tables(strips: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """page_id, tables: ``bytes``, three times 256 values (red, green, blue; a gray page uses the first),
    and ``reach``, at least the lines of the page.

    Counts travel deflated, one row per page and piece of a batch.
    """
    kind = strips.schema["page_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, ("page_id",)):
            # Some hundred pages at a time.
            for at in range(0, len(start), 512):
                mine = start[at : at + 512]
                part = table.slice(mine[0], (start[at + 512] if at + 512 < len(start) else len(table)) - mine[0]).combine_chunks()
                raw = list(map(zlib.decompress, part["counts"].to_pylist()))
                counts = np.stack([np.frombuffer(one, _COUNT_TYPES[len(one) // 1536]) for one in raw]).astype(np.uint32)
                dense = np.add.reduceat(counts, mine - mine[0], axis=0, dtype=np.int64).reshape(-1, 3, 256)
                made = composed(dense, steps).astype(np.uint8).ravel()
                reach = np.minimum(np.add.reduceat(part["reach"].to_numpy(), mine - mine[0]), 1 << 30)
                both = [pa.array(reach, pa.int32()), as_binary(made, np.full(len(mine), 768))]
                ids = part["page_id"].combine_chunks().take(pa.array(mine - mine[0]))
                yield pa.RecordBatch.from_arrays([ids, pa.StructArray.from_arrays(both, names=["reach", "bytes"])], names=["page_id", "tables"])

    counted = map_batches(strips, _counted, f"page_id {kind}, reach bigint, counts binary", ["page_id", "bpp", "y", "row"])
    parts = counted.repartition("page_id").sortWithinPartitions("page_id")
    return parts.mapInArrow(make, f"page_id {kind}, tables struct<reach: int, bytes: binary>")


def with_page_tables(strips: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """Strips with the tables of their page as ``_tables_0``, ... (BINARY, null without), all from one join.

    Stretches of lines are joined, not lines.
    """
    return _joined(blocks(strips, PAGE_BAND), tables, None)


def _joined(stretches: DataFrame, tables: Sequence[DataFrame], change: Callable | None) -> DataFrame:
    given = tables[0].select("page_id", F.col("tables.reach").alias("_reach"), F.col("tables.bytes").alias("_tables_0"))
    for k, more in enumerate(tables[1:], 1):
        more = more.select("page_id", F.col("tables.reach").alias("_more"), F.col("tables.bytes").alias(f"_tables_{k}"))
        given = given.join(more.hint("merge"), "page_id", "full_outer").withColumn("_reach", F.greatest("_reach", "_more")).drop("_more")
    joined = join_page_stats(stretches, given, "left", reach=F.col("_reach")).drop("_reach")
    return lines_of(joined, change, tuple(f"_tables_{k}" for k in range(1 if change else 0, len(tables))))


def _through(samples: np.ndarray, size: np.ndarray, line: np.ndarray, bpp: np.ndarray, column: pa.Array, gray: bool = True) -> np.ndarray:
    """Flat samples mapped by their channel's table; ``size`` samples have a row of ``column``, ``line`` of them a line."""
    coded = column.dictionary_encode()
    tables, _ = flat_bytes(coded.dictionary)
    has = column.is_valid().to_numpy(zero_copy_only=False)
    # The last table keeps what has none; so does the one behind the three of a page for alpha.
    kept = np.arange(256, dtype=np.int32)
    tables = np.concatenate([tables.reshape(-1, 768), np.tile(kept, 3)[None]]).astype(np.int32)
    tables = np.concatenate([tables, np.tile(kept, (len(tables), 1))], axis=1)
    mine = np.where(has & (gray | (bpp != 1)), coded.indices.fill_null(0).to_numpy(zero_copy_only=False), len(tables) - 1) * 1024
    at = np.repeat(mine.astype(np.int32), size)
    at += _channel(size, line, bpp) * np.int32(256)
    at += samples
    return tables.reshape(-1).take(at)


def _first(samples: np.ndarray, rows: pa.RecordBatch, size: np.ndarray) -> np.ndarray:
    return _through(samples, size, rows["size"].to_numpy().astype(np.int64), rows["bpp"].to_numpy(zero_copy_only=False).astype(np.int64), rows["_tables_0"])


def _first_of_colour(samples: np.ndarray, rows: pa.RecordBatch, size: np.ndarray) -> np.ndarray:
    """As ``_first``, but gray lines stay whatever their page's tables are."""
    return _through(samples, size, rows["size"].to_numpy().astype(np.int64), rows["bpp"].to_numpy(zero_copy_only=False).astype(np.int64), rows["_tables_0"], False)


def apply_tables(strips: DataFrame, column: str) -> DataFrame:
    """Map the colour samples of every line through the tables in ``column``, which is dropped."""
    schema = StructType([f for f in strips.schema.fields if f.name != column])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = flat_lines(batch["row"])
            made = as_lists(_through(v, size, size, batch["bpp"].to_numpy(zero_copy_only=False).astype(np.int64), batch[column]), size)
            yield pa.RecordBatch.from_arrays([made if c == "row" else batch[c] for c in schema.names], names=schema.names)

    return map_batches(strips, run, schema)


def apply_page_tables(strips: DataFrame, tables: DataFrame, gray: bool = True) -> DataFrame:
    """Map the colour samples of every page through its own tables, and those of gray lines if ``gray``."""
    return _joined(blocks(strips, PAGE_BAND), [tables], _first if gray else _first_of_colour)


def apply_chain(strips: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """All steps in order, as one map."""
    if not any(callable(step) for step in steps):
        table = list(range(256))
        for step in steps:
            table = [int(step[v]) for v in table]
        return apply_lut(strips, table)
    return checked(apply_page_tables(strips, cut_lineage(page_tables(strips, steps))), steps)


def checked(done: DataFrame, steps: Sequence[Step]) -> DataFrame:
    """What a chain with a white balance has made of a four-channel page is an error."""

    def refuse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if pc.any(pc.equal(batch["bpp"], 4)).as_py():
                raise ValueError("white_balance: unsupported pixel format Rgba8")
            yield batch

    return map_batches(done, refuse, done.schema) if white_balance in steps else done
