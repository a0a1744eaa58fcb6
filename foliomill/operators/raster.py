"""Page rasters as tables.

``pages``   page_id, width, height, fmt (Gray8 | Rgb8 | Rgba8), content BINARY
``strips``  page_id, width, height, bpp, y, row ARRAY<INT>   main physical form
``pixels``  page_id, y, x, c, v                              late, for joins
Samples are INT because Spark's TINYINT is signed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import indices, int_div, let, luma, to_int
from ..functions.lines import BATCH_BYTES, as_binary, as_lists, bound_batches, flat_bytes, flat_lines, map_batches, map_lines
from ..functions.scale import join_page_stats

# Fixed limits of one decoded page.
MAX_AXIS = 65_535
MAX_PAGE_BYTES = 512 * 1024 * 1024

STRIP_COLUMNS = ["page_id", "width", "height", "bpp", "y", "row"]

# Operators that refuse four-channel pages.
NO_ALPHA_OPERATORS = ("desaturate", "white_balance", "saturation", "hue_shift", "apply_profile")


def bytes_per_pixel(fmt: Column) -> Column:
    return F.when(fmt == "Gray8", 1).when(fmt == "Rgb8", 3).when(fmt == "Rgba8", 4)


def admission_reason(width: Column, height: Column, bpp: Column, length: Column | None = None) -> Column:
    """Null when the page is admissible, else the first violated rule."""
    size = width.cast("bigint") * height.cast("bigint") * bpp.cast("bigint")
    reason = (
        F.when(bpp.isNull(), "unsupported pixel format")
        .when((width <= 0) | (height <= 0), "width and height must be positive")
        .when((width > MAX_AXIS) | (height > MAX_AXIS), "axis exceeds 65535 pixels")
        .when(size > MAX_PAGE_BYTES, "buffer exceeds 536870912 bytes")
    )
    if length is not None:
        reason = reason.when(length != size, "packed length mismatch")
    return reason


def page_admission(pages: DataFrame, check_content: bool = True) -> DataFrame:
    """Add ``reason``; null means admitted.  Narrow: one projection, no shuffle."""
    length = F.octet_length("content").cast("bigint") if check_content else None
    return pages.withColumn(
        "reason",
        admission_reason(F.col("width"), F.col("height"), bytes_per_pixel(F.col("fmt")), length),
    )


def split_admitted(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good pages and quarantined pages (with ``reason``)."""
    checked = page_admission(pages)
    return checked.where("reason is null").drop("reason"), checked.where("reason is not null")


def unpack_bytes(packed: Column) -> Column:
    """BINARY to ARRAY<INT>: ISO-8859-1 maps byte n to code point n."""
    chars = F.split(F.decode(packed, "ISO-8859-1"), "")
    return F.when(F.octet_length(packed) > 0, F.transform(chars, lambda c: F.ascii(c))).otherwise(
        F.array().cast("array<int>")
    )


def pack_bytes(row: Column) -> Column:
    """ARRAY<INT> samples back to BINARY (one byte per sample)."""
    return F.encode(F.array_join(F.transform(row, lambda v: F.char(v)), ""), "ISO-8859-1")


def to_strips(pages: DataFrame, table: bytes | None = None) -> DataFrame:
    """Packed bytes to one row per raster line; no shuffle.

    ``table`` gives the sample for each of the 256 byte values, if they are not the samples.
    """
    whole = pages.select("page_id", "width", "height", bytes_per_pixel(F.col("fmt")).alias("bpp"), "content")
    names = STRIP_COLUMNS[:4]
    kinds = ", ".join(f"{c} {whole.schema[c].dataType.simpleString()}" for c in names)
    look = None if table is None else np.frombuffer(table, np.uint8)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, first = flat_bytes(batch["content"])
            width, height, bpp = (batch[c].fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64) for c in names[1:])
            height = np.maximum(height, 0)
            of = np.repeat(np.arange(len(height)), height)
            y = np.arange(len(of)) - np.repeat(np.cumsum(height) - height, height)
            line = np.maximum(width * bpp, 0)[of]
            # A line that the content ends before is short or empty.
            begin = np.minimum(first[:-1][of] + y * line, first[1:][of])
            size = np.minimum(line, first[1:][of] - begin)
            full = np.cumsum(size + 8) // (BATCH_BYTES // 4)
            for part in np.split(np.arange(len(of)), np.flatnonzero(full[1:] != full[:-1]) + 1):
                if not len(part):
                    continue
                at, many = begin[part], size[part]
                if (at[1:] == at[:-1] + many[:-1]).all():
                    values = data[at[0] : at[-1] + many[-1]]
                else:
                    values = data[np.arange(many.sum()) + np.repeat(at - (np.cumsum(many) - many), many)]
                kept = batch.select(names).take(pa.array(of[part]))
                made = as_lists(values if look is None else look[values], many)
                yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(y[part], pa.int32()), made], names=STRIP_COLUMNS)

    return map_batches(whole, cut, f"{kinds}, y int, row array<int>")


def to_pixels(strips: DataFrame) -> DataFrame:
    """One row per sample; ``idx = (y*w + x)*bpp + c``."""
    return strips.select("page_id", "bpp", "y", F.posexplode("row").alias("i", "v")).select(
        "page_id",
        "y",
        to_int(int_div(F.col("i"), F.col("bpp"))).alias("x"),
        (F.col("i") % F.col("bpp")).alias("c"),
        "v",
    )


def from_pixels(pixels: DataFrame, shape: DataFrame) -> DataFrame:
    """Samples back to strips; ``shape`` has page_id, width, height, bpp.

    The samples of a line that come in one Arrow batch leave it as one row with packed
    places (``4 * x + c``) and values, so a line, not a sample, is what is shuffled.
    A group holds one raster line, so its size is bounded by the axis limit.
    """
    kind = pixels.schema["page_id"].dataType.simpleString()

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pages = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            y, x, c, v = (batch[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("y", "x", "c", "v"))
            place, order = x * 4 + c, np.arange(len(y))
            new = np.ones(len(y), bool)
            new[1:] = (pages[1:] != pages[:-1]) | (y[1:] != y[:-1])
            if new.sum() > len(y) // 8:  # samples do not come line by line
                order = np.lexsort((y, pages))
                pages, y, place, v = pages[order], y[order], place[order], v[order]
                new[1:] = (pages[1:] != pages[:-1]) | (y[1:] != y[:-1])
            start = np.flatnonzero(new)
            size = np.diff(np.append(start, len(y)))
            if (v < 0).any() or (v > 255).any():
                raise ValueError("a sample is not a byte")
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"].take(pa.array(order[start])), pa.array(y[start], pa.int32()), as_binary(place.astype(np.int32), size), as_binary(v.astype(np.uint8), size)],
                names=["page_id", "y", "_place", "_value"],
            )

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch["_parts"]
            of = np.repeat(np.arange(len(parts)), parts.value_lengths().to_numpy(zero_copy_only=False))
            given = parts.flatten()
            place, value = (np.frombuffer(b"".join(given.field(n).to_pylist()), t) for n, t in (("_place", np.int32), ("_value", np.uint8)))
            line = np.repeat(of, pc.binary_length(given.field("_value")).to_numpy(zero_copy_only=False))
            key = (line.astype(np.int64) << 32) + (place.astype(np.int64) << 8) + value
            key.sort()
            made = as_lists(key & 255, np.bincount(line, minlength=len(parts)))
            yield pa.RecordBatch.from_arrays([*[batch[n] for n in STRIP_COLUMNS[:-1]], made], names=STRIP_COLUMNS)

    some = bound_batches(pixels).select("page_id", "y", "x", "c", "v")
    packed_lines = some.mapInArrow(pieces, f"page_id {kind}, y int, _place binary, _value binary")
    lines = packed_lines.groupBy("page_id", "y").agg(F.collect_list(F.struct("_place", "_value")).alias("_parts"))
    joined = join_page_stats(lines, shape).select(*STRIP_COLUMNS[:-1], "_parts")
    kinds = ", ".join(f"{n} {joined.schema[n].dataType.simpleString()}" for n in STRIP_COLUMNS[:-1])
    return joined.mapInArrow(rows, f"{kinds}, row array<int>")


def strips_to_pages(strips: DataFrame) -> DataFrame:
    """Strips back to packed pages (bounded by the page byte limit).

    The lines are joined once, as text with one character per byte; folding
    them with ``concat`` would copy the growing page for every line.
    """
    lines = F.sort_array(F.collect_list(F.struct("y", F.array_join(F.transform("row", lambda v: F.char(v)), "").alias("text"))))
    fmt = F.when(F.col("bpp") == 1, "Gray8").when(F.col("bpp") == 3, "Rgb8").otherwise("Rgba8")
    whole = F.array_join(F.transform("_lines", lambda s: s["text"]), "")
    return (
        strips.groupBy("page_id", "width", "height", "bpp")
        .agg(lines.alias("_lines"))
        .select("page_id", "width", "height", fmt.alias("fmt"), F.encode(whole, "ISO-8859-1").alias("content"))
    )


def luma_row(row: Column, bpp: Column) -> Column:
    """The luma line of one strip; Gray8 passes."""
    colour = let(
        row,
        lambda r: F.transform(
            indices(int_div(F.size(r), bpp)),
            lambda x: luma(r[x * bpp], r[x * bpp + 1], r[x * bpp + 2]),
        ),
    )
    return F.when(bpp == 1, row).otherwise(colour)


def to_luma(strips: DataFrame) -> DataFrame:
    return strips.withColumn("row", luma_row(F.col("row"), F.col("bpp"))).withColumn("bpp", F.lit(1))


def to_rgb(strips: DataFrame) -> DataFrame:
    """Gray is replicated, alpha is dropped."""
    return map_lines(strips, lambda v, _: np.repeat(v, 3, axis=2) if v.shape[2] == 1 else v[:, :, :3], bpp_out=3)


def to_rgba(strips: DataFrame) -> DataFrame:
    """Opaque alpha is added; an existing alpha is kept."""

    def opaque(v: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        if v.shape[2] == 4:
            return v
        colour = np.repeat(v, 3, axis=2) if v.shape[2] == 1 else v
        return np.concatenate([colour, np.full((*v.shape[:2], 1), 255, v.dtype)], axis=2)

    return map_lines(strips, opaque, bpp_out=4)


def over_white(strips: DataFrame) -> DataFrame:
    """Composite a four-channel page on white; other pages pass."""

    def blend(channel: Column, alpha: Column) -> Column:
        return to_int(int_div(channel * alpha + (F.lit(255) - alpha) * 255 + 127, 255))

    flat = let(
        F.col("row"),
        lambda r: F.flatten(
            F.transform(
                indices(F.col("width")),
                lambda x: F.array(*[blend(r[x * 4 + c], r[x * 4 + 3]) for c in range(3)]),
            )
        ),
    )
    has_alpha = F.col("bpp") == 4
    return strips.select(
        "page_id",
        "width",
        "height",
        F.when(has_alpha, 3).otherwise(F.col("bpp")).alias("bpp"),
        "y",
        F.when(has_alpha, flat).otherwise(F.col("row")).alias("row"),
    )


def refuse_alpha(operator: str, result: Column, bpp: Column | None = None) -> Column:
    """An unsupported layout is an error, never a silent pass."""
    bpp = F.col("bpp") if bpp is None else bpp
    return F.when(bpp == 4, F.raise_error(F.lit(f"{operator}: unsupported pixel format Rgba8"))).otherwise(result)


def unsupported_pages(strips: DataFrame, operators: tuple[str, ...] = NO_ALPHA_OPERATORS) -> DataFrame:
    """Quarantine report: which pages the listed operators would refuse."""
    return (
        strips.where((F.col("bpp") == 4) & (F.col("y") == 0))
        .select("page_id", F.explode(F.array(*[F.lit(o) for o in operators])).alias("operator"))
        .withColumn("reason", F.concat(F.col("operator"), F.lit(": unsupported pixel format Rgba8")))
    )


def split_supported(strips: DataFrame, operator: str) -> tuple[DataFrame, DataFrame]:
    """Strips the operator accepts, and the quarantined rest."""
    if operator not in NO_ALPHA_OPERATORS:
        return strips, strips.where(F.lit(False))
    return strips.where("bpp <> 4"), strips.where("bpp = 4")


def page_checksum(strips: DataFrame) -> DataFrame:
    """Size and three order-sensitive integer sums per page.

    Samples are summed per line inside an Arrow batch, so only a few longs per
    line leave it; they are combined before the shuffle.
    """
    sums = ("samples", "sum_v", "sum_at", "sum_mix")
    keys = ["page_id", "width", "height", "bpp"]
    kinds = [f"{c} {strips.schema[c].dataType.simpleString()}" for c in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v, size = flat_lines(batch["row"])
            some = np.flatnonzero(size)
            if not len(some):
                continue
            start = (np.cumsum(size) - size)[some]
            y, width, bpp = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "width", "bpp"))
            v = v.astype(np.int64)
            at = np.arange(len(v)) + np.repeat((y * width * bpp)[some] - start, size[some])
            found = [size[some], *[np.add.reduceat(x, start) for x in (v, v * (at + 1), v * v * (at % 97 + 1))]]
            yield pa.RecordBatch.from_arrays([*[batch[c].take(pa.array(some)) for c in keys], *map(pa.array, found)], names=[*keys, *sums])

    lines = map_batches(strips, run, ", ".join([*kinds, *[f"{c} bigint" for c in sums]]), [*keys, "y", "row"])
    return lines.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])
