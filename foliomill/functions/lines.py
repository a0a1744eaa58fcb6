"""Raster lines as NumPy arrays, one Arrow batch at a time.

An expression inside a lambda costs some hundred nanoseconds per sample and an
exploded sample about as much again; a batch of lines is one array here.  The
batches are bounded in bytes, however long the lines are.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, StructField, StructType

BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(df: DataFrame) -> DataFrame:
    """Limit the session's Arrow batches to BATCH_BYTES; a smaller limit that it has set is kept."""
    spark = df.sparkSession
    said = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_LIMIT, str(1 << 30)))
    if not 0 < said <= BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about BATCH_BYTES: large ones are cut, small ones put together, empty ones dropped."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        mine = batch.nbytes
        if held and (size + mine > BATCH_BYTES or not batch.schema.equals(held[0].schema)):
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
        if mine < BATCH_BYTES // 4:
            held.append(batch)
            size += mine
            continue
        yield from (pa.Table.from_batches(held).combine_chunks().to_batches() if held else [])
        held, size = [], 0
        most = max(1, batch.num_rows * BATCH_BYTES // max(mine, BATCH_BYTES))
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: StructType | str, columns: Sequence[str] | None = None) -> DataFrame:
    """``df.mapInArrow``; functions that follow each other at once share a task's Python process.

    Between two ``mapInArrow`` Spark would copy each line to its own rows and back, sample by sample, and
    keep a process for each.  A frame remembers the functions that made it, so the next one is put after them.
    ``run`` takes its columns by name; ``columns`` are all it needs.
    """
    source, steps = vars(df).get("_made_by", (df, ())) if not df.is_cached else (df, ())
    if columns is not None and not steps:
        source = df.select(*columns)
    steps = (*steps, run)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, step in enumerate(steps):
            batches = step(_pieces(batches) if n else batches)
        return batches

    out = bound_batches(source).mapInArrow(in_turn if len(steps) > 1 else run, schema)
    out._made_by = (source, steps)
    return out


def as_lists(samples: np.ndarray, size: np.ndarray | None = None) -> pa.Array:
    """Lines of samples as an Arrow list column; ``size`` per line if ``samples`` is flat."""
    if size is None:
        size = np.full(len(samples), samples[0].size if len(samples) else 0)
    at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(samples.reshape(-1).astype(np.int32, copy=False)))


def as_binary(values: np.ndarray, size: np.ndarray, bits: pa.Buffer | None = None) -> pa.Array:
    """A flat array as a BINARY column of ``size`` values each; ``bits`` marks the ones that are not null."""
    at = (np.concatenate([[0], np.cumsum(size)]) * values.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(size), [bits, pa.py_buffer(at.tobytes()), pa.py_buffer(values.tobytes())])


def flat_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All samples of a list column (a null counts as 0), and the number of each line."""
    size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().fill_null(0).to_numpy(zero_copy_only=False), size


def flat_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a BINARY column (a null is empty), and where each row begins, with the end."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]], at - at[0]


def with_column(batch: pa.RecordBatch, name: str, column: pa.Array) -> pa.RecordBatch:
    kept = {c: batch[c] for c in batch.schema.names}
    return pa.RecordBatch.from_pydict(kept | {name: column})


def map_lines(
    strips: DataFrame, change: Callable[[np.ndarray, pa.RecordBatch], np.ndarray], bpp_out: int | None = None, drop: tuple[str, ...] = ()
) -> DataFrame:
    """Replace ``row`` by ``change(samples, rows)``; samples are (line, x, channel), rows all columns of those lines.

    Lines of one width and number of channels are changed together.  ``drop``
    names columns that only ``change`` needs.
    """
    fields = [StructField("row", ArrayType(IntegerType())) if f.name == "row" else f for f in strips.schema.fields if f.name not in drop]
    schema = StructType([StructField(f.name, f.dataType) for f in fields])
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, bpp = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "bpp"))
            shape = width * 8 + bpp
            for one in np.unique(shape):
                part = batch if (shape == one).all() else batch.filter(pa.array(shape == one))
                w, b = int(one) // 8, int(one) % 8
                samples, size = flat_lines(part["row"])
                if (size != w * b).any():
                    raise ValueError("a line does not have width times channels samples")
                out = change(samples.reshape(len(size), w, b), part)
                part = with_column(part, "row", as_lists(out))
                if bpp_out is not None:
                    part = with_column(part, "bpp", pa.array(np.full(len(size), bpp_out), pa.int32()))
                yield part.select(names)

    return map_batches(strips, run, schema)


def luma_of(samples: np.ndarray) -> np.ndarray:
    """BT.601 luma in 8-bit fixed point of (..., channel) samples; one channel is its own luma."""
    if samples.shape[-1] == 1:
        return samples[..., 0]
    return (samples[..., 0] * 77 + samples[..., 1] * 150 + samples[..., 2] * 29) >> 8


def clamped(value: np.ndarray) -> np.ndarray:
    """Round half away from zero, then limit to 0..255 (as ``clamp_byte``)."""
    return np.clip(np.floor(value + 0.5), 0, 255).astype(np.int32)


def unpacked(df: DataFrame, packed: str, row: str = "row", table: bytes | None = None) -> DataFrame:
    """Replace a BINARY column by ``row``, its bytes as ARRAY<INT>, each read through ``table`` if given."""
    fields = [StructField(f.name, f.dataType) for f in df.schema.fields if f.name != packed]
    schema = StructType([*fields, StructField(row, ArrayType(IntegerType()))])
    look = None if table is None else np.frombuffer(table, np.uint8).astype(np.int32)
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch[packed].cast(pa.large_binary()).fill_null(b"")
            at = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
            data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
            values = look[data] if look is not None else data
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], as_lists(values, np.diff(at))], names=[*names, row])

    return map_batches(df, run, schema)


def packed(df: DataFrame, row: str, out: str) -> DataFrame:
    """Replace an ARRAY<INT> column of bytes by BINARY: a quarter of the bytes to shuffle."""
    fields = [StructField(f.name, f.dataType) for f in df.schema.fields if f.name != row]
    schema = StructType([*fields, StructField(out, BinaryType())])
    names = [f.name for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size = flat_lines(batch[row])
            if len(values) and (values.min() < 0 or values.max() > 255):
                raise ValueError("a sample is not a byte")
            bits = pa.array(batch[row].is_valid()).buffers()[1] if batch[row].null_count else None
            data = as_binary(values.astype(np.uint8), size, bits)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], data], names=[*names, out])

    return map_batches(df, run, schema)


def blocks(strips: DataFrame, band: int, given: str | None = None) -> DataFrame:
    """Stretches of consecutive lines inside a band as one deflated row each: page_id, width, height, bpp, y (the first), lines, size, data.

    That is what lines cost least as when they move or are written; other columns are dropped.
    Bands are ``band`` lines each, or what the column ``given`` says, which is kept.
    """
    stretches, cut = vars(strips).get("_stretches", (None, 0))
    if cut == band and given is None:
        return stretches
    kinds = {c: strips.schema[c].dataType.simpleString() for c in ("page_id", "width", "height", "bpp", "y", *[given] * (given is not None))}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, size = flat_lines(batch["row"])
            if not len(size):
                continue
            if len(values) and (values.min() < 0 or values.max() > 255):
                raise ValueError("a sample is not a byte")
            y = batch["y"].to_numpy(zero_copy_only=False).astype(np.int64)
            page = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(len(y), bool)
            new[1:] = y[1:] != y[:-1] + 1
            bands = y // band if given is None else batch[given].to_numpy(zero_copy_only=False)
            for of in (page, size, bands, *(batch[c].to_numpy(zero_copy_only=False) for c in ("width", "height", "bpp"))):
                new[1:] |= of[1:] != of[:-1]
            start = np.flatnonzero(new)
            at = np.append((np.cumsum(size) - size)[start], len(values))
            samples = values.astype(np.uint8)
            data = [zlib.compress(samples[s:e], 1) for s, e in zip(at[:-1].tolist(), at[1:].tolist())]
            kept = batch.select([*kinds]).take(pa.array(start))
            many = [np.diff(np.append(start, len(y))), size[start]]
            yield pa.RecordBatch.from_arrays([*[kept[c] for c in kinds], *[pa.array(v, pa.int32()) for v in many], pa.array(data, pa.binary())], names=[*kinds, "lines", "size", "data"])

    return map_batches(strips, run, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "lines int, size int, data binary"]), [*kinds, "row"])


def lines_of(
    stretches: DataFrame, change: Callable[[np.ndarray, pa.RecordBatch, np.ndarray], np.ndarray] | None = None, kept: tuple[str, ...] = (), band: int = 0
) -> DataFrame:
    """The strips of ``blocks``.  ``change(samples, rows, size)`` may map the flat samples, of which each
    row of the batch has ``size``; columns in ``kept`` go to every line of the stretch.
    Stretches said to be of ``band`` are not made again when ``blocks`` asks for them."""
    names = ["page_id", "width", "height", "bpp"]
    schema = StructType([*[StructField(c, stretches.schema[c].dataType) for c in (*names, "y")], StructField("row", ArrayType(IntegerType())), *[stretches.schema[c] for c in kept]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            # Columns that go to every line are tables of a page.
            full = np.cumsum(whole["lines"].to_numpy().astype(np.int64) * (whole["size"].to_numpy() + 24 + 768 * len(kept))) // BATCH_BYTES
            for part in np.split(np.arange(whole.num_rows), np.flatnonzero(full[1:] != full[:-1]) + 1):
                if not len(part):
                    continue
                rows = whole.slice(part[0], len(part))
                lines, size, y = (rows[c].to_numpy().astype(np.int64) for c in ("lines", "size", "y"))
                samples = np.frombuffer(b"".join(map(zlib.decompress, rows["data"].to_pylist())), np.uint8)
                if change is not None:
                    samples = change(samples, rows, lines * size)
                of = np.repeat(np.arange(len(lines)), lines)
                each = rows.select([*names, *kept]).take(pa.array(of))
                y = y[of] + np.arange(len(of)) - np.repeat(np.cumsum(lines) - lines, lines)
                yield pa.RecordBatch.from_arrays([*[each[c] for c in names], pa.array(y, pa.int32()), as_lists(samples, size[of]), *[each[c] for c in kept]], names=schema.names)

    out = map_batches(stretches, run, schema)
    if band and change is None and not kept:
        out._stretches = (stretches, band)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of complete groups from batches sorted by ``keys``, and the row at which each group begins.

    Many small groups come as one table; only the rows of the last group wait for the next batch.
    """
    held: list[pa.RecordBatch] = []

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for name in keys:
            code = table[name].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        if len(starts(pa.Table.from_batches([*held[-1:], batch]))) == 1:
            held.append(batch)
            continue
        table = pa.Table.from_batches([*held, batch])
        at = starts(table)
        held = table.slice(at[-1]).combine_chunks().to_batches()
        yield table.slice(0, at[-1]), at[:-1]
    if held:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def portions(table: pa.Table, start: np.ndarray, weight: np.ndarray, most: int = BATCH_BYTES // 2) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """A table of whole groups in pieces whose rows weigh about ``most``, or one group, and where groups begin there."""
    full, ends = np.cumsum(np.add.reduceat(weight, start)) // most, np.append(start[1:], len(table))
    for some in np.split(np.arange(len(start)), np.flatnonzero(full[1:] != full[:-1]) + 1):
        begin = start[some[0]]
        yield table.slice(begin, ends[some[-1]] - begin).combine_chunks(), start[some] - begin
