"""Geometry: crop, mirror, rotate, resample, skew and content bounds."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clamp, indices, int_div, let, to_int
from ..functions.lines import as_binary, as_lists, bound_batches, flat_bytes, flat_lines, luma_of, map_batches, packed, portions, whole_groups, with_column
from ..functions.scale import DEFAULT_SALTS, PAGE_BAND, cut_lineage, join_page_stats
from .filters import banded
from .raster import STRIP_COLUMNS, luma_row

ROTATE_TILE = 32
MAX_SKEW = 45.0


# --- crop and mirror ------------------------------------------------------


def crop_reason(width: Column, height: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """Null when the rectangle is usable on the page."""
    long = [c.cast("bigint") for c in (x, w, y, h)]
    return F.when((x < 0) | (y < 0) | (w < 1) | (h < 1), "invalid crop region").when(
        (long[0] + long[1] > width) | (long[2] + long[3] > height), "crop region out of bounds"
    )


def crop_columns(strips: DataFrame, x: Column, y: Column, w: Column, h: Column) -> DataFrame:
    """Crop with per-row rectangles; strips outside vanish before any shuffle."""
    bpp = F.col("bpp")
    return strips.where((F.col("y") >= y) & (F.col("y") < y + h)).select(
        "page_id",
        to_int(w).alias("width"),
        to_int(h).alias("height"),
        "bpp",
        to_int(F.col("y") - y).alias("y"),
        F.slice("row", to_int(x) * bpp + 1, to_int(w) * bpp).alias("row"),
    )


def crop(strips: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    """Pages the rectangle does not fit are in ``crop_rejected``."""
    rect = [F.lit(v) for v in (x, y, width, height)]
    fits = crop_reason(F.col("width"), F.col("height"), *rect).isNull()
    return crop_columns(strips.where(fits), *rect)


def crop_rejected(strips: DataFrame, x: int, y: int, width: int, height: int) -> DataFrame:
    reason = crop_reason(F.col("width"), F.col("height"), *[F.lit(v) for v in (x, y, width, height)])
    return strips.where("y = 0").select("page_id", reason.alias("reason")).where("reason is not null")


def _mirrored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with the order of their pixels turned round; of colour lines that have more than their width, the first ones."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = batch["row"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        width, bpp = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "bpp"))
        if (size == width * bpp).all() and (bpp == bpp[:1]).all() and not batch["row"].null_count:
            pixels = batch["row"].flatten()
            if not pixels.null_count:
                last = np.cumsum(width) * 2 - width - 1
                turned = pixels.to_numpy().reshape(-1, int(bpp[0]))[np.repeat(last, width) - np.arange(len(pixels) // int(bpp[0]))]
                yield with_column(batch, "row", as_lists(turned, size))
                continue
        most = np.where(bpp == 1, size, np.minimum(size, width * bpp))
        begin, step = np.repeat(np.cumsum(size) - size, most), np.repeat(bpp, most)
        place = np.arange(len(begin)) - np.repeat(np.cumsum(most) - most, most)
        # The sample at a place comes from the pixel as far from the other end; the last pixel may be a part.
        part = np.repeat(most % bpp, most)
        turned = np.where(place < part, np.repeat(most, most) - part + place, np.repeat(most - most % bpp, most) - ((place - part) // step + 1) * step + (place - part) % step)
        values = batch["row"].flatten().take(pa.array(begin + turned))
        at = np.concatenate([[0], np.cumsum(most)]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(at), values, mask=batch["row"].is_null() if batch["row"].null_count else None)
        yield with_column(batch, "row", lists)


def flip_h(strips: DataFrame) -> DataFrame:
    return map_batches(strips, _mirrored, strips.schema)


def flip_v(strips: DataFrame) -> DataFrame:
    return strips.withColumn("y", F.col("height") - 1 - F.col("y"))


_TILE_KEYS = ("page_id", "width", "height", "bpp", "_turn", "_tile")


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lines cut into column tiles, one row per stretch of consecutive lines and tile.

    The samples of a tile are turned already (by column, then in the order of the target line) and deflated.
    """
    for batch in batches:
        batch = batch.filter(pc.is_in(batch["_turn"], pa.array([90, 270], pa.int32())))
        page = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        of = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height", "bpp", "_turn", "y")}
        order = np.lexsort((of["y"], of["_turn"], of["bpp"], of["height"], of["width"], page))
        rows, page, of = batch.take(pa.array(order)), page[order], {c: v[order] for c, v in of.items()}
        data, first = flat_bytes(rows["data"])
        if (np.diff(first) != of["width"] * of["bpp"]).any():
            raise ValueError("a line does not have width times channels samples")
        new = np.ones(len(page), bool)
        new[1:] = (page[1:] != page[:-1]) | (of["y"][1:] != of["y"][:-1] + 1)
        for c in ("width", "height", "bpp", "_turn"):
            new[1:] |= of[c][1:] != of[c][:-1]
        start = np.flatnonzero(new)
        found: list[tuple[int, int, int, bytes]] = []
        for s, e in zip(start.tolist(), [*start[1:].tolist(), len(page)]):
            block = data[first[s] : first[e]].reshape(e - s, int(of["width"][s]), int(of["bpp"][s]))
            if of["_turn"][s] == 90:
                block = block[::-1]
            turned = block.transpose(1, 0, 2)
            found += [(s, t, e - s, zlib.compress(turned[t * ROTATE_TILE : (t + 1) * ROTATE_TILE].tobytes(), 1)) for t in range(-(-turned.shape[0] // ROTATE_TILE))]
        if not found:
            continue
        owner, tile, lines, samples = zip(*found)
        kept = rows.select([*_TILE_KEYS[:-1], "y"]).take(pa.array(owner))
        yield pa.RecordBatch.from_arrays(
            [*[kept[c] for c in _TILE_KEYS[:-1]], pa.array(tile, pa.int32()), kept["y"], pa.array(lines, pa.int32()), pa.array(samples, pa.binary())],
            names=[*_TILE_KEYS, "y", "lines", "data"],
        )


def _turned_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Target lines from all stretches of a column tile, which come in order of their lines."""
    for table, start in whole_groups(batches, _TILE_KEYS):
        # Some megabytes of samples at a time, but all stretches of a tile.
        samples = np.minimum(ROTATE_TILE, table["width"].to_numpy()) * table["bpp"].to_numpy().astype(np.int64) * table["lines"].to_numpy()
        for part, begin in portions(table, start, samples):
            yield from _turned_lines_of(part, begin)


def _turned_lines_of(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Target lines of whole tiles, which begin at ``start``."""
    width, bpp, turn, tile, y, lines = (table[c].to_numpy().astype(np.int64) for c in ("width", "bpp", "_turn", "_tile", "y", "lines"))
    data = table["data"].combine_chunks()
    found, columns, size = [], [], []
    for s, e in zip(start.tolist(), [*start[1:].tolist(), len(table)]):
        many, b, back = int(min(ROTATE_TILE, width[s] - tile[s] * ROTATE_TILE)), int(bpp[s]), turn[s] == 90
        parts = [np.frombuffer(zlib.decompress(data[i].as_py()), np.uint8).reshape(many, int(lines[i]), b) for i in (range(e - 1, s - 1, -1) if back else range(s, e))]
        whole = parts[0] if e - s == 1 else np.concatenate(parts, axis=1)
        if (y[s + 1 : e] < y[s : e - 1] + lines[s : e - 1]).any():
            # Pages that share a key: lines of one number go by their samples.
            at = [np.arange(y[i], y[i] + lines[i])[:: -1 if back else 1] for i in (range(e - 1, s - 1, -1) if back else range(s, e))]
            at = np.concatenate(at).tolist()
            whole = whole[:, sorted(range(len(at)), key=lambda i: (at[i], whole[:, i].tobytes()), reverse=bool(back))]
        found.append(whole.reshape(-1))
        columns.append(many)
        size.append(whole.shape[1] * b)
    columns = np.array(columns)
    owner = np.repeat(start, columns)
    column = np.arange(len(owner)) - np.repeat(np.cumsum(columns) - columns, columns) + tile[owner] * ROTATE_TILE
    target = np.where(turn[owner] == 90, column, width[owner] - 1 - column).astype(np.int32)
    kept = table.select(STRIP_COLUMNS[:4]).take(pa.array(owner)).combine_chunks()
    made = as_lists(np.concatenate(found), np.repeat(size, columns))
    yield from pa.table([kept["page_id"], kept["height"], kept["width"], kept["bpp"], pa.array(target), made], names=STRIP_COLUMNS).to_batches()


def _mirrored_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed lines of pages that stand on their head turned round, the others as they are; none of a quarter turn."""
    for batch in batches:
        batch = batch.filter(pc.invert(pc.is_in(batch["_turn"], pa.array([90, 270], pa.int32()))))
        width, height, bpp, y, turn = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height", "bpp", "y", "_turn"))
        data, first = flat_bytes(batch["data"])
        over = turn == 180
        out, size = data.astype(np.int32), np.diff(first)
        for one in np.unique((size * 8 + bpp)[over]):
            mine = np.flatnonzero(over & (size * 8 + bpp == one))
            at = first[:-1][mine, None] + np.arange(one // 8)
            out[at] = data[at].reshape(len(mine), -1, one % 8)[:, ::-1].reshape(at.shape)
        lines = pa.array(np.where(over, height - 1 - y, y).astype(np.int32))
        yield pa.RecordBatch.from_arrays([*[batch[c] for c in STRIP_COLUMNS[:4]], lines, as_lists(out, size)], names=STRIP_COLUMNS)


def _quarter_turns(lines: DataFrame) -> DataFrame:
    """Packed lines with ``_turn`` (90 or 270): cut into column tiles, shuffle tiles, put them together.

    Only whole tile slices move (not single pixels), deflated; one group is a tile column
    of one page, so its size is bounded by the axis limit.
    """
    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in _TILE_KEYS[:-1])
    parts = map_batches(lines, _tiles, f"{kinds}, _tile int, y int, lines int, data binary")
    whole = parts.repartition("page_id", "_tile").sortWithinPartitions(*_TILE_KEYS, "y")
    return map_batches(whole, _turned_tiles, _strip_kinds(lines))


def _strip_kinds(lines: DataFrame) -> str:
    return f"page_id {lines.schema['page_id'].dataType.simpleString()}, width int, height int, bpp int, y int, row array<int>"


def _turned_pages(lines: DataFrame) -> DataFrame:
    """Packed lines with ``_turn`` per page; only the tiles of pages turned by a quarter are shuffled.

    The tasks pick their lines themselves: a filter on either side would keep Spark from moving the lines just once for both.
    """
    plain = bound_batches(lines).mapInArrow(_mirrored_lines, _strip_kinds(lines))
    return plain.unionByName(_quarter_turns(lines))


def rotate(strips: DataFrame, degrees: int) -> DataFrame:
    """Clockwise quarter turns; any other angle leaves the page alone."""
    turn = degrees % 360
    if turn == 180:
        return flip_v(flip_h(strips))
    if turn in (90, 270):
        return _quarter_turns(packed(_with_turn(strips, turn), "row", "data"))
    return strips


def _with_turn(strips: DataFrame, turn: int) -> DataFrame:
    """The strips with one ``_turn`` for all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in STRIP_COLUMNS], pa.array(np.full(batch.num_rows, turn), pa.int32())], names=[*STRIP_COLUMNS, "_turn"])

    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in STRIP_COLUMNS)
    return map_batches(strips, run, f"{kinds}, _turn int", STRIP_COLUMNS)


def rotate_by(strips: DataFrame, degrees: str) -> DataFrame:
    """Rotate each page by its own angle column; only turned pages shuffle."""
    return _turned_pages(packed(strips.select(*STRIP_COLUMNS, _turn_of(degrees).alias("_turn")), "row", "data"))


def _turn_of(degrees: str) -> Column:
    return to_int(F.pmod(F.coalesce(F.col(degrees), F.lit(0)), F.lit(360)))


# --- resampling -----------------------------------------------------------


def resize_nearest(strips: DataFrame, width: int, height: int) -> DataFrame:
    """``src = dst * srcN div dstN``.  Each strip emits the target lines it
    feeds, so neither a join nor a shuffle is needed."""
    h, w = F.col("height").cast("bigint"), F.col("width").cast("bigint")

    def first_target(y: Column) -> Column:
        return int_div(y.cast("bigint") * height + h - 1, h)

    start, stop = first_target(F.col("y")), first_target(F.col("y") + 1)
    targets = F.when(stop > start, F.sequence(start, stop - 1)).otherwise(F.array().cast("array<bigint>"))
    bpp = F.col("bpp")
    picked = let(
        F.col("row"),
        lambda r: F.flatten(
            F.transform(
                indices(F.lit(width)),
                lambda x: F.slice(r, to_int(int_div(x * w, width)) * bpp + 1, bpp),
            )
        ),
    )
    same = (F.col("width") == width) & (F.col("height") == height)
    # The generator stays in its own projection: next to it, names would bind
    # to the new width and height.
    fed = strips.select("page_id", "width", "height", "bpp", "row", F.explode(targets).alias("_y"))
    return fed.withColumn("row", F.when(same, F.col("row")).otherwise(picked)).select(
        "page_id",
        F.lit(width).alias("width"),
        F.lit(height).alias("height"),
        "bpp",
        to_int(F.col("_y")).alias("y"),
        "row",
    )


def fit_extent(df: DataFrame, source: tuple[str, str], want: tuple[str, str]) -> DataFrame:
    """Target size keeping the aspect ratio; zero leaves an axis free."""
    sw, sh = (F.col(c).cast("bigint") for c in source)
    rw, rh = (F.col(c).cast("bigint") for c in want)

    def scaled(value: Column, numerator: Column, denominator: Column) -> Column:
        return clamp(F.call_function("div", value * numerator + int_div(denominator, 2), F.nullif(denominator, F.lit(0))), 1, 4_294_967_295)

    empty = (sw == 0) | (sh == 0) | ((rw == 0) & (rh == 0))
    by_width = (rh == 0) | ((rw != 0) & (rw * sh <= rh * sw))
    return df.withColumn(
        "fit_width", F.when(empty, sw).when(by_width, rw).otherwise(scaled(sw, rh, sh))
    ).withColumn("fit_height", F.when(empty, sh).when(by_width, scaled(sh, rw, sw)).otherwise(rh))


def fit_within(df: DataFrame, source: tuple[str, str], cell_width: int, cell_height: int) -> DataFrame:
    """Largest size with the source aspect that fits the cell."""
    sw, sh = (F.greatest(F.col(c), F.lit(1)).cast("bigint") for c in source)
    wide = sw * cell_height >= sh * cell_width
    tall = clamp(int_div(sh * cell_width + int_div(sw, 2), sw), 1, cell_height)
    broad = clamp(int_div(sw * cell_height + int_div(sh, 2), sh), 1, cell_width)
    return df.withColumn("thumb_width", F.when(wide, F.lit(cell_width).cast("bigint")).otherwise(broad)).withColumn(
        "thumb_height", F.when(wide, tall).otherwise(F.lit(cell_height).cast("bigint"))
    )


# --- skew -----------------------------------------------------------------


def dark_grid(strips: DataFrame, threshold: int = 200) -> DataFrame:
    """Dark grid positions per line (page_id, y, xs) of pages with both sides >= 8.

    The grid step is part of the rule; the line filter comes first, so skipped
    lines are never unpacked.
    """
    step = F.greatest(to_int(int_div(F.least("width", "height"), 128)), F.lit(1))
    kept = strips.where((F.col("width") >= 8) & (F.col("height") >= 8) & (F.col("y") % step == 0)).withColumn("_step", step)
    kind = strips.schema["page_id"].dataType.simpleString()

    def dark(batches):
        for batch in batches:
            v, size = flat_lines(batch["row"])
            bpp, every = (np.repeat(batch[c].to_numpy(zero_copy_only=False), size) for c in ("bpp", "_step"))
            line = np.repeat(np.arange(len(size)), size)
            at = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            if (bpp > 1).any():
                first = np.flatnonzero((at % bpp == 0) & (bpp > 1))
                v = v.copy()
                v[first] = (v[first] * 77 + v[first + 1] * 150 + v[first + 2] * 29) >> 8
            hit = np.flatnonzero((at % bpp == 0) & (v < threshold))
            x = at[hit] // bpp[hit]
            on = x % every[hit] == 0
            xs = as_lists(x[on], np.bincount(line[hit][on], minlength=len(size)))
            yield pa.RecordBatch.from_arrays([batch["page_id"], batch["y"], xs], names=["page_id", "y", "xs"])

    return bound_batches(kept).select("page_id", "bpp", "y", "_step", "row").mapInArrow(dark, f"page_id {kind}, y int, xs array<int>")


def projection_moments(lines: DataFrame, angles: list[float]) -> DataFrame:
    """page_id, i, k, s, q: per angle the occupied bins, samples and squared counts.

    Each sample falls into one bin per angle.  As rows that is sixty times the
    input through a hash aggregate (about three times slower), so the grids of whole pages,
    which the grid step keeps small, are counted many at a time and leave three integers per
    page and angle.
    """
    turns = [(math.sin(math.radians(a)), math.cos(math.radians(a))) for a in angles]
    kind = lines.schema["page_id"].dataType.simpleString()

    def moments(batches):
        for table, start in whole_groups(batches, ("page_id",)):
            spots = table["xs"].combine_chunks()
            x, size = flat_lines(spots)
            if not len(x):
                continue
            page = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
            of = np.repeat(page, size)
            x, y = x.astype(np.float64), np.repeat(table["y"].to_numpy(), size).astype(np.float64)
            # Every page has bins of its own, from its greatest x below zero to its greatest sum of both.
            reach, low = np.zeros(len(start)), np.zeros(len(start))
            np.maximum.at(reach, of, x + 1)
            np.maximum.at(low, of, y)
            room = (low + 2 * reach + 2).astype(np.int64)
            base = np.cumsum(room) - room
            shift = (base + reach.astype(np.int64))[of]
            some = np.unique(of)
            for i, (sin, cos) in enumerate(turns):
                counts = np.zeros(int(room.sum()), dtype=np.int64)
                # Short slices keep the working arrays inside the CPU cache.
                for at in range(0, len(x), 65_536):
                    p = y[at : at + 65_536] * cos - x[at : at + 65_536] * sin
                    bins = (p + np.copysign(0.5, p)).astype(np.int64) + shift[at : at + 65_536]
                    first = int(base[of[at]])
                    seen = np.bincount(bins - first)
                    counts[first : first + len(seen)] += seen
                found = [np.add.reduceat(c, base)[some] for c in ((counts > 0).astype(np.int64), counts, counts * counts)]
                ids = table["page_id"].take(pa.array(start[some])).combine_chunks()
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(np.full(len(some), i), pa.int32()), *map(pa.array, found)], names=["page_id", "i", "k", "s", "q"]
                )

    parts = bound_batches(lines).repartition("page_id").sortWithinPartitions("page_id")
    return parts.mapInArrow(moments, f"page_id {kind}, i int, k bigint, s bigint, q bigint")


def skew_estimate(strips: DataFrame, max_angle: float = 15.0, threshold: int = 200) -> DataFrame:
    """page_id, angle: the projection angle with the highest count variance.

    The score is compared as an exact ratio rounded to nine digits, and the
    smallest angle wins ties.
    """
    steps = int(max(0.0, min(MAX_SKEW, max_angle)) * 2.0)
    scores = projection_moments(dark_grid(strips, threshold), [k * 0.5 for k in range(-steps, steps + 1)])
    score = F.round((F.col("k") * F.col("q") - F.col("s") * F.col("s")).cast("double") / (F.col("k") * F.col("k")), 9)
    best = scores.groupBy("page_id").agg(
        F.max_by("i", F.struct(score, -F.col("i"))).alias("i"), F.first("s").alias("samples")
    )
    found = best.select(
        "page_id",
        F.when(F.col("samples") < 20, F.lit(0.0)).otherwise(F.col("i") * F.lit(0.5) - F.lit(steps * 0.5)).alias("angle"),
    )
    pages = strips.where("y = 0").select("page_id")
    return pages.join(found, "page_id", "left").select("page_id", F.coalesce("angle", F.lit(0.0)).alias("angle"))


def _canvas(angle: Column) -> DataFrame | Column:
    """Per-page rotation constants as one struct column."""
    width, height = F.col("width").cast("double"), F.col("height").cast("double")
    cos, sin = F.cos(F.radians(angle)), F.sin(F.radians(angle))
    cx, cy = (width - 1.0) / 2.0, (height - 1.0) / 2.0
    corners = [(F.lit(0.0), F.lit(0.0)), (width - 1.0, F.lit(0.0)), (F.lit(0.0), height - 1.0), (width - 1.0, height - 1.0)]
    xs = [cos * (x - cx) - sin * (y - cy) + cx for x, y in corners]
    ys = [sin * (x - cx) + cos * (y - cy) + cy for x, y in corners]
    out_w = F.greatest(to_int(F.ceil(F.greatest(*xs) - F.least(*xs) + 1.0)), F.lit(1))
    out_h = F.greatest(to_int(F.ceil(F.greatest(*ys) - F.least(*ys) + 1.0)), F.lit(1))
    return F.struct(
        cos.alias("cos"), sin.alias("sin"), cx.alias("cx"), cy.alias("cy"), out_w.alias("w"), out_h.alias("h"),
        ((out_w - 1.0) / 2.0).alias("ox"), ((out_h - 1.0) / 2.0).alias("oy"), "width", "height",
    )


def _half_away(value: np.ndarray) -> np.ndarray:
    return np.where(value >= 0, np.floor(value + 0.5), np.ceil(value - 0.5)).astype(np.int64)


#: What a row on the way to a target band holds: a line that is not turned, the size of the page, runs of samples.
STILL, LINES, RUNS = 0, 1, 2
_PARTS = ["page_id", "_band", "kind", "width", "height", "bpp", "at", "data"]


def _turned_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Target samples that packed source lines feed, one row per stretch of lines and target band.

    Consecutive lines of a page are worked on together.  For each target line the target
    samples that can come from them are one interval; the exact rounding decides inside it.
    ``at`` holds (target line, first x, samples) of each run of one source line.
    """
    for batch in batches:
        get = {c: batch[c].to_numpy(zero_copy_only=False) for c in ("y", "width", "height", "bpp", "still")}
        data, first = flat_bytes(batch["data"])
        still = np.flatnonzero(get["still"])
        if len(still):
            kept = batch.take(pa.array(still))
            at = np.zeros((len(still), 3), np.int32)
            at[:, 0] = get["y"][still]
            yield pa.RecordBatch.from_arrays(
                [kept["page_id"], pa.array((at[:, 0] // PAGE_BAND).astype(np.int32)), pa.array(np.full(len(still), STILL), pa.int32()),
                 *[kept[c] for c in ("width", "height", "bpp")], as_binary(at.reshape(-1), np.full(len(still), 3)), kept["data"]],
                names=_PARTS,
            )
        turn = np.flatnonzero(~get["still"].astype(bool))
        if not len(turn):
            continue
        rows = batch.take(pa.array(turn))
        k = {c: rows["k"].field(c).to_numpy(zero_copy_only=False) for c in ("cos", "sin", "cx", "cy", "w", "h", "ox", "oy", "width", "height")}
        y, bpp = get["y"][turn].astype(np.int64), get["bpp"][turn].astype(np.int64)
        begin, size = first[:-1][turn], np.diff(first)[turn]
        page = rows["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new = np.ones(len(turn), bool)
        new[1:] = (page[1:] != page[:-1]) | (y[1:] != y[:-1] + 1) | (bpp[1:] != bpp[:-1])
        for c in ("cos", "sin", "w", "h", "width", "height"):
            new[1:] |= k[c][1:] != k[c][:-1]
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(turn))
        held = np.cumsum(size)
        # Some hundred thousand samples at a time, whole stretches.
        slot = (held[stop - 1] - 1) // 250_000
        for one in np.split(np.arange(len(start)), np.flatnonzero(slot[1:] != slot[:-1]) + 1):
            s, e = start[one], stop[one]
            p = {c: v[s] for c, v in k.items()}
            top, low = y[s], y[e - 1]
            # Target lines in reach of the four corners of the stretch, then per line the interval of x.
            ends = [p["sin"] * (x - p["cx"]) + p["cos"] * (v - p["cy"]) + p["oy"] for x in (-0.5, p["width"] - 0.5) for v in (top - 0.5, low + 0.5)]
            least = np.clip(np.floor(np.minimum.reduce(ends)) - 2, 0, p["h"]).astype(np.int64)
            many = np.clip(np.ceil(np.maximum.reduce(ends)) + 3, least, p["h"]).astype(np.int64) - least
            of = np.repeat(np.arange(len(one)), many)
            ty = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + least[of]
            sin, cos = p["sin"][of], p["cos"][of]
            left, right = np.zeros(len(of)), p["w"][of].astype(np.float64)
            along = sin * (ty - p["oy"][of]) + p["cx"][of]
            across = cos * (ty - p["oy"][of]) + p["cy"][of]
            for slope, lo, hi in ((cos, -0.5 - along, p["width"][of] - 0.5 - along), (-sin, top[of] - 0.5 - across, low[of] + 0.5 - across)):
                sure = np.abs(slope) > 1e-9
                by = np.where(sure, slope, 1.0)
                a, b = lo / by + p["ox"][of], hi / by + p["ox"][of]
                left = np.where(sure, np.maximum(left, np.floor(np.minimum(a, b)) - 1), left)
                right = np.where(sure, np.minimum(right, np.ceil(np.maximum(a, b)) + 2), right)
            left = np.minimum(left, p["w"][of])
            many = np.maximum(right - left, 0).astype(np.int64)
            line = np.repeat(np.arange(len(of)), many)
            tx = np.arange(len(line)) - np.repeat(np.cumsum(many) - many, many) + left.astype(np.int64)[line]
            q = {c: p[c][of[line]] for c in ("cos", "sin", "cx", "cy", "ox", "oy")}
            dx, dy = tx - q["ox"], ty[line] - q["oy"]
            sx = _half_away(q["cos"] * dx + q["sin"] * dy + q["cx"])
            sy = _half_away(-q["sin"] * dx + q["cos"] * dy + q["cy"])
            part = of[line]
            on = (sx >= 0) & (sx < p["width"][part]) & (sy >= top[part]) & (sy <= low[part]) & (sy < p["height"][part])
            line, tx, sx, sy, part = line[on], tx[on], sx[on], sy[on], part[on]
            if not len(line):
                continue
            source = s[part] + sy - top[part]
            run = np.ones(len(line), bool)
            run[1:] = (line[1:] != line[:-1]) | (sy[1:] != sy[:-1])
            run = np.flatnonzero(run)
            length = np.diff(np.append(run, len(line)))
            b = bpp[source]
            pick = np.repeat(begin[source] + sx * b, b) + np.arange(b.sum()) - np.repeat(np.cumsum(b) - b, b)
            at = np.stack([ty[line[run]], tx[run], length], axis=1).astype(np.int32)
            band = at[:, 0] // PAGE_BAND
            row = np.ones(len(run), bool)
            row[1:] = (part[run][1:] != part[run][:-1]) | (band[1:] != band[:-1])
            row = np.flatnonzero(row)
            bytes_of = np.add.reduceat(length * b[run], row)
            owner = s[part[run[row]]]
            yield pa.RecordBatch.from_arrays(
                [rows["page_id"].take(pa.array(owner)), pa.array(band[row].astype(np.int32)), pa.array(np.full(len(row), RUNS), pa.int32()),
                 *[pa.array(v[owner].astype(np.int32)) for v in (k["w"], k["h"], bpp)],
                 as_binary(at.reshape(-1), np.diff(np.append(row, len(run))) * 3), as_binary(data[pick], bytes_of)],
                names=_PARTS,
            )


def _turned_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole target lines of bands: white, the runs in order of x, white."""
    for table, start in whole_groups(batches, ("page_id", "_band")):
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
        kind, width, height, bpp, band = (table[c].to_numpy().astype(np.int64) for c in ("kind", "width", "height", "bpp", "_band"))
        still = np.flatnonzero(kind == STILL)
        if len(still):
            kept = table.take(pa.array(still)).combine_chunks()
            at, _ = flat_bytes(kept["at"].combine_chunks())
            data, first = flat_bytes(kept["data"].combine_chunks())
            lines = pa.array(at.view(np.int32).reshape(-1, 3)[:, 0])
            yield from pa.table([kept["page_id"], *[kept[c] for c in ("width", "height", "bpp")], lines, as_lists(data, np.diff(first))], names=STRIP_COLUMNS).to_batches()
        # Every target line of a page, reached or not; a page that is there twice has each line twice.
        head = np.flatnonzero(kind == LINES)
        if not len(head):
            continue
        many = np.minimum(height[head] - band[head] * PAGE_BAND, PAGE_BAND)
        of = np.repeat(head, many)
        place = group[of] * PAGE_BAND + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        place, line, copies = np.unique(place, return_inverse=True, return_counts=True)
        w, h, b = (np.zeros(len(place), np.int64) for _ in range(3))
        for out, value in ((w, width), (h, height), (b, bpp)):
            np.maximum.at(out, line, value[of])
        runs = np.flatnonzero(kind == RUNS)
        part = table.take(pa.array(runs)).combine_chunks()
        at, first = flat_bytes(part["at"].combine_chunks())
        at = at.view(np.int32).reshape(-1, 3).astype(np.int64)
        data, _ = flat_bytes(part["data"].combine_chunks())
        row = np.repeat(runs, np.diff(first) // 12)
        size = at[:, 2] * bpp[row]
        begin = np.cumsum(size) - size
        line = np.searchsorted(place, group[row] * PAGE_BAND + at[:, 0] - band[row] * PAGE_BAND)
        end = at[:, 1] + at[:, 2]
        order = np.lexsort((end, at[:, 1], line))
        twin = (line[order][1:] == line[order][:-1]) & (at[order, 1][1:] == at[order, 1][:-1]) & (end[order][1:] == end[order][:-1])
        if twin.any():
            # Pages that share a key: their runs go by their samples, as any order by value does.
            samples = [data[begin[i] : begin[i] + size[i]].tobytes() for i in range(len(at))]
            order = np.array(sorted(range(len(at)), key=lambda i: (line[i], at[i, 1], end[i], samples[i])), dtype=np.int64)
        line, size, begin, end, x = line[order], size[order], begin[order], end[order], at[order, 1]
        head = np.ones(len(line), bool)
        head[1:] = line[1:] != line[:-1]
        head = np.flatnonzero(head)
        tail = np.append(head[1:], len(line))[: len(head)] - 1
        left, inside, right = np.zeros(len(place), np.int64), np.bincount(line, weights=size, minlength=len(place)).astype(np.int64), w * b
        if len(head):
            some = line[head]
            left[some] = np.where(copies[some] == 1, x[head] * b[some], 0)
            right[some] = np.maximum(w[some] - end[tail], 0) * b[some]
        total = left + inside + right
        out = np.full(int(total.sum()), 255, np.uint8)
        if len(line):
            before = np.cumsum(size) - size
            to = (np.cumsum(total) - total + left)[line] + before - np.repeat(before[head], tail - head + 1)
            inner = np.arange(int(size.sum())) - np.repeat(before, size)
            out[np.repeat(to, size) + inner] = data[np.repeat(begin, size) + inner]
        owner = start[place // PAGE_BAND]
        ids = table["page_id"].take(pa.array(owner)).combine_chunks()
        lines = [pa.array(v.astype(np.int32)) for v in (w, h, b, band[owner] * PAGE_BAND + place % PAGE_BAND)]
        yield from pa.table([ids, *lines, as_lists(out, total)], names=STRIP_COLUMNS).to_batches()


def deskew(strips: DataFrame, angles: DataFrame) -> DataFrame:
    """Rotate each page by its angle (``angles``: page_id, angle) on an enlarged
    white canvas, nearest inverse mapping.

    Stretches of packed source lines become one row for each band of target lines
    they feed, with the runs of all their lines; a target band is put together from
    these rows.  Spark does the cutting: neither side holds more than a band.
    """
    angles = angles.select("page_id", F.coalesce("angle", F.lit(0.0)).alias("angle"))
    # One small row per page, read by the lines and by the target bands: written once.
    heads = strips.where("y = 0").select("page_id", "width", "height", "bpp").join(angles.hint("merge"), "page_id")
    heads = cut_lineage(heads.where(F.abs("angle") >= 0.05).select("page_id", "bpp", _canvas(F.col("angle")).alias("k")))
    pages = heads.groupBy("page_id").agg(F.collect_list("k").alias("_pages"))
    stats = angles.join(pages.hint("merge"), "page_id", "left")
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(DEFAULT_SALTS - 1)))).hint("merge")
    salted = packed(strips.select(STRIP_COLUMNS), "row", "data").withColumn("_salt", to_int(int_div(F.col("y"), PAGE_BAND) % DEFAULT_SALTS))
    still = F.coalesce(F.abs("angle"), F.lit(0.0)) < 0.05
    joined = salted.join(copies, ["page_id", "_salt"], "left").withColumn("still", still).where("still OR _pages IS NOT NULL")
    columns = ["page_id", "y", "width", "height", "bpp", "still", "data"]
    placed = joined.select(*columns, F.explode_outer(F.when(~F.col("still"), F.col("_pages"))).alias("k"))
    kind = strips.schema["page_id"].dataType.simpleString()
    parts = bound_batches(placed.sortWithinPartitions("page_id", "y")).mapInArrow(
        _turned_runs, f"page_id {kind}, _band int, kind int, width int, height int, bpp int, at binary, data binary"
    )
    bands = F.explode(indices(to_int(int_div(F.col("k.h") + PAGE_BAND - 1, PAGE_BAND))))
    empty = F.lit(None).cast("binary")
    every = heads.select("page_id", "bpp", "k", bands.alias("_band")).select(
        "page_id", "_band", F.lit(LINES).alias("kind"), F.col("k.w").alias("width"), F.col("k.h").alias("height"), "bpp", empty.alias("at"), empty.alias("data")
    )
    keys = ("page_id", "_band")
    whole = bound_batches(parts.unionByName(every).repartition(*keys)).sortWithinPartitions(*keys)
    return whole.mapInArrow(_turned_lines, f"page_id {kind}, width int, height int, bpp int, y int, row array<int>")


def deskew_by(strips: DataFrame, angle: float) -> DataFrame:
    """Explicit angle for every page."""
    if angle != angle or angle in (float("inf"), float("-inf")):
        raise ValueError("deskew angle must be finite")
    if abs(angle) < 0.05:
        return strips
    return deskew(strips, strips.where("y = 0").select("page_id", F.lit(float(angle)).alias("angle")))


def auto_deskew(strips: DataFrame, max_angle: float = 15.0, threshold: int = 200) -> DataFrame:
    """Undo the estimated slope by turning the other way."""
    # One small row per page, read by several branches below: written once.
    found = cut_lineage(skew_estimate(strips, max_angle, threshold))
    return deskew(strips, found.select("page_id", (-F.col("angle")).alias("angle")))


# --- content bounds and orientation ---------------------------------------


def auto_crop_bounds(strips: DataFrame, threshold: int = 240, margin: int = 2) -> DataFrame:
    """page_id, x, y, w, h, confidence, method of the inked area."""
    limit = max(0, min(255, threshold))
    inked = F.transform(luma_row(F.col("row"), F.col("bpp")), lambda v: v < limit)
    edges = strips.select("page_id", "width", "height", "y", inked.alias("ink")).select(
        "page_id",
        "width",
        "height",
        F.when(F.array_contains("ink", True), F.col("y")).alias("y"),
        F.nullif(to_int(F.array_position("ink", True)) - 1, F.lit(-1)).alias("left"),
        F.when(F.array_contains("ink", True), F.col("width") - to_int(F.array_position(F.reverse("ink"), True))).alias("right"),
    )
    box = edges.groupBy("page_id", "width", "height").agg(
        F.min("left").alias("x0"), F.max("right").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")
    )
    x, y = F.greatest(F.col("x0") - margin, F.lit(0)), F.greatest(F.col("y0") - margin, F.lit(0))
    w = F.greatest(F.least(F.col("x1") + margin, F.col("width") - 1) - x + 1, F.lit(1))
    h = F.greatest(F.least(F.col("y1") + margin, F.col("height") - 1) - y + 1, F.lit(1))
    empty = F.col("x1").isNull()
    area = w.cast("double") * h / F.greatest(F.col("width").cast("double") * F.col("height"), F.lit(1.0))
    return box.select(
        "page_id",
        F.when(empty, 0).otherwise(x).alias("x"),
        F.when(empty, 0).otherwise(y).alias("y"),
        F.when(empty, F.col("width")).otherwise(w).alias("w"),
        F.when(empty, F.col("height")).otherwise(h).alias("h"),
        F.when(empty, 0.0).otherwise(clamp(F.lit(1.0) - area + 0.2, 0.0, 1.0)).alias("confidence"),
        F.when(empty, "full-frame-empty").otherwise("luma-threshold-bbox").alias("method"),
    )


def auto_crop(strips: DataFrame, threshold: int = 240, margin: int = 2) -> DataFrame:
    bounds = auto_crop_bounds(strips, threshold, margin).select(
        "page_id", *[F.col(c).alias(f"_{c}") for c in ("x", "y", "w", "h")]
    )
    return crop_columns(join_page_stats(strips, bounds), *[F.col(f"_{c}") for c in ("x", "y", "w", "h")])


def _luma_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed luma of every line."""
    names = ["page_id", "width", "height", "y"]
    for whole in batches:
        bpp = whole["bpp"].to_numpy(zero_copy_only=False)
        for one in np.unique(bpp):
            batch = whole if (bpp == one).all() else whole.filter(pa.array(bpp == one))
            v, size = flat_lines(batch["row"])
            if (size % one).any():
                raise ValueError("a line does not have width times channels samples")
            gray = luma_of(v.reshape(-1, int(one))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], as_binary(gray, size // one)], names=[*names, "data"])


_SUMS = ["gx", "gy", "top", "bottom"]


def _gradient_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Differences along and across the lines of a band, and the sums of its lines near the top and bottom of the page."""
    for table, start in whole_groups(batches, ("page_id", "_band")):
        width, height, y, band = (table[c].to_numpy().astype(np.int64) for c in ("width", "height", "y", "_band"))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(y))))
        for one in np.unique(width):
            mine = np.flatnonzero(width == one)
            part = table if len(mine) == len(table) else table.take(pa.array(mine))
            data, first = flat_bytes(part["data"].combine_chunks())
            if (np.diff(first) != one).any():
                raise ValueError("a line does not have width times channels samples")
            v, g, at, h = data.reshape(len(mine), one).astype(np.int16), group[mine], y[mine], height[mine]
            own = np.flatnonzero(at // PAGE_BAND == band[mine])
            if not len(own):
                continue
            up, down = np.maximum(own - 1, 0), np.minimum(own + 1, len(mine) - 1)
            inner = (at[own] > 0) & (at[own] < h[own] - 1) & (one >= 3)
            beside = inner & (own > 0) & (own < len(mine) - 1) & (g[up] == g[own]) & (g[down] == g[own])
            found = np.zeros((4, len(own)), np.int64)
            if one >= 3:
                found[0, inner] = np.abs(v[own[inner], 2:] - v[own[inner], :-2]).sum(axis=1, dtype=np.int64)
                found[1, beside] = np.abs(v[down[beside], 1:-1] - v[up[beside], 1:-1]).sum(axis=1, dtype=np.int64)
            total, edge = v[own].sum(axis=1, dtype=np.int64), np.maximum(h[own] // 20, 1)
            found[2] = np.where(at[own] < edge, total, 0)
            found[3] = np.where(at[own] >= h[own] - edge, total, 0)
            new = np.ones(len(own), bool)
            new[1:] = (g[own][1:] != g[own][:-1]) | (h[own][1:] != h[own][:-1])
            begin = np.flatnonzero(new)
            kept = part.select(["page_id", "width", "height"]).take(pa.array(own[begin])).combine_chunks()
            sums = [pa.array(np.add.reduceat(one, begin)) for one in found]
            yield from pa.table([*kept.columns, *sums], names=[*kept.column_names, *_SUMS]).to_batches()


def orientation_detect(strips: DataFrame) -> DataFrame:
    """page_id, degrees, confidence, method from gradient energy.

    Packed luma lines go to bands with a line of the neighbours; a row of sums per band leaves them.
    """
    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in ("page_id", "width", "height"))
    lines = bound_batches(strips.select(STRIP_COLUMNS)).mapInArrow(_luma_lines, f"{kinds}, y int, data binary")
    parts = banded(lines, 1).repartition("page_id", "_band").sortWithinPartitions("page_id", "_band", "y")
    sums = parts.mapInArrow(_gradient_sums, f"{kinds}, " + ", ".join(f"{c} bigint" for c in _SUMS))
    page = sums.groupBy("page_id", "width", "height").agg(*[F.sum(c).alias(c) for c in _SUMS])
    band = F.greatest(to_int(int_div(F.col("height"), 20)), F.lit(1))
    cells = (band * F.col("width")).cast("double")
    whole = (F.col("gx") + F.col("gy") + 1).cast("double")
    upright = F.col("gx") / whole >= F.col("gy") / whole
    upside = upright & (F.col("top") / cells < F.col("bottom") / cells - 8.0)
    small = (F.col("width") < 3) | (F.col("height") < 3)
    return page.select(
        "page_id",
        F.when(small, 0).when(upside, 180).when(upright, 0).otherwise(90).alias("degrees"),
        F.when(small, 0.0)
        .when(upside, F.least(F.col("gx") / whole + 0.1, F.lit(1.0)))
        .when(upright, F.least(F.col("gx") / whole, F.lit(1.0)))
        .otherwise(F.least(F.col("gy") / whole, F.lit(1.0)))
        .alias("confidence"),
        F.when(small, "too-small").otherwise("gradient-energy").alias("method"),
    )


def orientation_apply(strips: DataFrame, degrees: int | None = None) -> DataFrame:
    if degrees is not None:
        return rotate(strips, degrees)
    found = cut_lineage(orientation_detect(strips).select("page_id", F.col("degrees").alias("_degrees")))
    lines = join_page_stats(packed(strips.select(STRIP_COLUMNS), "row", "data"), found, "left")
    return _turned_pages(lines.withColumn("_turn", _turn_of("_degrees")))
