"""Text layer: ink components, glyphs, reading order and OCR tables."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..constants import NO_TEXT, glyph_bits
from ..functions.columns import indices, int_div, let, to_int
from ..functions.lines import as_binary, as_lists, bound_batches, flat_bytes, flat_lines, map_batches, portions, whole_groups
from ..functions.scale import PAGE_BAND, cut_lineage, prefix_scan, salted_join

INK_LIMIT = 128
MAX_PAGE_TEXT = 1024 * 1024
MAX_DOCUMENT_TEXT = 16 * 1024 * 1024
MAX_CODES = 65_535
#: Bands whose seams are united in one group.
SEAM_BANDS = 64


# --- connected ink components ---------------------------------------------


def _ink(batch: pa.RecordBatch, limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Whether each pixel of a batch of strips is ink, flat, and the pixels of each line."""
    v, size = flat_lines(batch["row"])
    bpp = batch["bpp"].to_numpy(zero_copy_only=False).astype(np.int64)
    if (bpp == 1).all():
        return v < limit, size
    pixels = size // bpp
    at = np.repeat(np.cumsum(size) - size, pixels)
    step = np.repeat(bpp, pixels)
    at = at + (np.arange(len(at)) - np.repeat(np.cumsum(pixels) - pixels, pixels)) * step
    colour = step > 1
    green, blue = np.where(colour, at + 1, at), np.where(colour, at + 2, at)
    return np.where(colour, (v[at] * 77 + v[green] * 150 + v[blue] * 29) >> 8, v[at]) < limit, pixels


def _runs_of(ink: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Line, first and last place (exclusive) of every ink run of flat lines."""
    begin = np.cumsum(size) - size
    # A gap after each line keeps the runs of neighbouring lines apart.
    line = np.repeat(np.arange(len(size)), size)
    wide = np.zeros(len(ink) + len(size) + 1, np.int8)
    wide[np.arange(len(ink)) + line + 1] = ink
    edge = np.diff(wide)
    x0, x1 = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # Empty lines have no place of their own, so lines are found by their beginnings in the gapped array.
    of = np.searchsorted(begin + np.arange(len(size)), x0, side="right") - 1
    return of, x0 - begin[of] - of, x1 - begin[of] - of


def ink_runs(strips: DataFrame, limit: int = INK_LIMIT) -> DataFrame:
    """Horizontal ink runs: page_id, width, height, y, x0, x1 (exclusive).

    Found inside the strip, so runs (not pixels) are the graph's nodes.
    """
    names = ["page_id", "width", "height", "y"]

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, x0, x1 = _runs_of(*_ink(batch, limit))
            kept = batch.select(names).take(pa.array(of))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(x0.astype(np.int32)), pa.array(x1.astype(np.int32))], names=[*names, "x0", "x1"])

    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(strips, runs, f"{kinds}, x0 int, x1 int", [*names, "bpp", "row"])


def ink_lines(strips: DataFrame, limit: int = INK_LIMIT, band_rows: int = PAGE_BAND) -> DataFrame:
    """page_id, width, height, y, _band, size, ink: a line's pixels as one bit each, a thirty-second of its samples to shuffle."""
    names = ["page_id", "width", "height", "y"]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits_, octets, size = _ink_bits(batch, limit)
            band = pa.array(batch["y"].to_numpy(zero_copy_only=False) // band_rows, pa.int32())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in names], band, pa.array(size, pa.int32()), as_binary(bits_, octets)], names=[*names, "_band", "size", "ink"])

    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(strips, bits, f"{kinds}, _band int, size int, ink binary", [*names, "bpp", "row"])


def _ink_bits(batch: pa.RecordBatch, limit: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ink of a batch of strips packed by line, the bytes of each line, and its pixels."""
    ink, size = _ink(batch, limit)
    octets = (size + 7) // 8
    if (size == octets * 8).all():
        return np.packbits(ink), octets, size
    begin = np.cumsum(octets * 8) - octets * 8
    room = np.zeros(int(octets.sum()) * 8, np.uint8)
    room[np.arange(len(ink)) + np.repeat(begin - (np.cumsum(size) - size), size)] = ink
    return np.packbits(room), octets, size


def ink_stretches(strips: DataFrame, limit: int = INK_LIMIT, band_rows: int = PAGE_BAND) -> DataFrame:
    """page_id, width, height, y, _band, lines, size, ink: the packed pixels of consecutive lines of a band, from line ``y`` on, as one row."""
    names = ["page_id", "width", "height", "y"]

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            packed, octets, size = _ink_bits(batch, limit)
            y = batch["y"].to_numpy(zero_copy_only=False).astype(np.int64)
            page = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new = np.ones(len(y), bool)
            new[1:] = (y[1:] != y[:-1] + 1) | (y[1:] % band_rows == 0)
            for of in (page, size, *(batch[c].to_numpy(zero_copy_only=False) for c in ("width", "height"))):
                new[1:] |= of[1:] != of[:-1]
            start = np.flatnonzero(new)
            kept = batch.select(names).take(pa.array(start))
            counted = [y[start] // band_rows, np.diff(np.append(start, len(y))), size[start]]
            ink = as_binary(packed, np.add.reduceat(octets, start))
            yield pa.RecordBatch.from_arrays([*kept.columns, *[pa.array(v, pa.int32()) for v in counted], ink], names=[*names, "_band", "lines", "size", "ink"])

    kinds = ", ".join(f"{c} {strips.schema[c].dataType.simpleString()}" for c in names)
    return map_batches(strips, bits, f"{kinds}, _band int, lines int, size int, ink binary", [*names, "bpp", "row"])


def _unpacked_ink(column: pa.Array, size: np.ndarray) -> np.ndarray:
    """The pixels of packed ink lines, flat; a row of the column may hold several lines."""
    data, _ = flat_bytes(column)
    octets = (size + 7) // 8
    if (size == octets * 8).all():
        return np.unpackbits(data)
    begin = np.repeat((np.cumsum(octets) - octets) * 8 - (np.cumsum(size) - size), size)
    return np.unpackbits(data)[np.arange(len(begin)) + begin]


def least_labels(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For nodes 0 .. n - 1 joined by the edges a - b, the least node each one reaches.

    Every round hangs the larger root of each open edge on the smaller one, then
    points all nodes at their roots by doubling; the open edges at least halve the roots they touch.
    """
    root = np.arange(n)
    while len(a):
        left, right = root[a], root[b]
        open_ = left != right
        a, b, left, right = a[open_], b[open_], left[open_], right[open_]
        np.minimum.at(root, np.maximum(left, right), np.minimum(left, right))
        while (after := root[root]).tobytes() != root.tobytes():
            root = after
    return root


def _joined(y: np.ndarray, x0: np.ndarray, x1: np.ndarray) -> np.ndarray:
    """For runs sorted by line and place, the first run that each one reaches."""
    # Runs of a line are disjoint and sorted, so those of the line above that overlap a run are consecutive.
    line = int(x1.max()) + 1
    first = np.searchsorted(y * line + x1, (y - 1) * line + x0, side="right")
    many = np.maximum(np.searchsorted(y * line + x0, (y - 1) * line + x1) - first, 0)
    below = np.repeat(np.arange(len(y)), many)
    above = first[below] + np.arange(len(below)) - np.repeat(np.cumsum(many) - many, many)
    return least_labels(above, below, len(y))


def _band(table: pa.Table) -> pa.Table:
    """Label the runs of one band with the least node each one reaches inside it."""
    y, x0, x1, node = (table[c].to_numpy().astype(np.int64) for c in ("y", "x0", "x1", "node"))
    order = np.lexsort((x0, y))
    y, x0, x1, node = y[order], x0[order], x1[order], node[order]
    label = node[_joined(y, x0, x1)]
    keep = table.take(pa.array(order)).drop_columns(["band"])
    return keep.append_column("local", pa.array(label))


def band_labels(runs: DataFrame, band_rows: int = PAGE_BAND) -> DataFrame:
    """page_id, width, height, y, x0, x1, node, local: smallest node id that a
    run reaches inside its own band of lines (a group bounded by the band height)."""
    keyed = runs.select(
        "*",
        (F.col("y").cast("bigint") * F.col("width") + F.col("x0")).alias("node"),
        to_int(int_div(F.col("y"), band_rows)).alias("band"),
    )
    schema = "page_id bigint, width int, height int, y int, x0 int, x1 int, node bigint, local bigint"
    return keyed.groupBy("page_id", "band").applyInArrow(_band, schema)


def seam_edges(labelled: DataFrame, band_rows: int = PAGE_BAND) -> DataFrame:
    """page_id, seam, a, b: band-local components that touch across the upper end of band ``seam``.

    Only the last line of a band and the first of the next take part.  Runs of
    one line are disjoint, so a run meets few others.
    """
    upper = labelled.where(F.col("y") % band_rows == band_rows - 1).select(
        "page_id", (F.col("y") + 1).alias("y"), F.col("local").alias("a"), F.col("x0").alias("u0"), F.col("x1").alias("u1")
    )
    lower = labelled.where(F.col("y") % band_rows == 0).select("page_id", "y", F.col("local").alias("b"), "x0", "x1")
    met = upper.join(lower, ["page_id", "y"]).where("u0 < x1 AND x0 < u1")
    return met.select("page_id", to_int(int_div(F.col("y"), band_rows)).alias("seam"), "a", "b").distinct()


def _united(table: pa.Table) -> pa.Table:
    """page_id, u, label of the ends of the edges (a, b) of one group."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = nodes[least_labels(at[: len(a)], at[len(a) :], len(nodes))]
    page = np.full(len(nodes), table["page_id"][0].as_py())
    return pa.table({"page_id": page, "u": nodes, "label": label})


def merge_labels(edges: DataFrame, bands: int = SEAM_BANDS) -> DataFrame:
    """page_id, u, label: smallest node of each component of the seam edges.

    Two levels, whatever the shape of the ink: the seams inside each block of ``bands`` bands are
    united in one group, then the seams between the blocks of a page, whose
    ends carry the labels of the first level.  With 64 bands of 64 lines a page of 65,535 lines has at
    most 63 seams in a group of the first level and 15 in its one group of the second.
    """
    schema = "page_id bigint, u bigint, label bigint"
    inside = edges.where(F.col("seam") % bands != 0).withColumn("block", to_int(int_div(F.col("seam"), bands)))
    first = inside.select("page_id", "block", "a", "b").groupBy("page_id", "block").applyInArrow(_united, schema)
    between = edges.where(F.col("seam") % bands == 0).select("page_id", "a", "b")
    for end in ("a", "b"):
        told = first.select("page_id", F.col("u").alias(end), F.col("label").alias("_label"))
        between = between.join(told, ["page_id", end], "left").withColumn(end, F.coalesce("_label", end)).drop("_label")
    second = between.select("page_id", "a", "b").groupBy("page_id").applyInArrow(_united, schema)
    second = second.select("page_id", F.col("u").alias("label"), F.col("label").alias("least"))
    # A label of the first level that no seam between blocks holds stays; one that only the second level knows stands for itself.
    moved = first.join(second, ["page_id", "label"], "left").select("page_id", "u", F.coalesce("least", "label").alias("label"))
    alone = second.join(first.select("page_id", F.col("u").alias("label")), ["page_id", "label"], "left_anti")
    return moved.unionByName(alone.select("page_id", F.col("label").alias("u"), F.col("least").alias("label")))


def _components(group: np.ndarray, label: np.ndarray, first: np.ndarray, width: np.ndarray, height: np.ndarray, plain: bool) -> tuple[np.ndarray, np.ndarray]:
    """A number for each run's component (of one page size) in a group, and a run of each.

    If no line is there twice and a group has one page size (``plain``), that is the first run it reaches.
    """
    if plain:
        new = first == np.arange(len(first))
        return (np.cumsum(new) - 1)[first], np.flatnonzero(new)
    _, at, code = np.unique(np.stack([group, label, width, height]), axis=1, return_index=True, return_inverse=True)
    return code.reshape(-1), at


def _is_kept(width, height, page_width, page_height):
    """Whether a box has the size of a glyph."""
    return (height >= 3) & (height <= np.maximum(page_height // 2, 3)) & (width >= 1) & (width <= np.maximum(page_width * 2 // 5, 1))


def band_parts(strips: DataFrame, limit: int = INK_LIMIT, band_rows: int = PAGE_BAND, closed: bool = False) -> DataFrame:
    """page_id, width, height, local, x0, y0, x1, y1, seams: the components of each band of lines.

    ``y1`` is the last line.  ``seams`` are the runs (y, x0, x1) of the component on the first and last line of the band,
    by which it may touch others; all other runs stay inside the task.  Many small bands are labelled at a time.

    With ``closed``, components that cannot touch another band are no rows: those of a glyph's size are in
    ``boxes``, one deflated row of four lists (x0, y0, x1, end of y) per band, and other columns are null there.
    """
    names = ["page_id", "width", "height"]
    places = ["x0", "y0", "x1", "y1"]
    kind = strips.schema["page_id"].dataType.simpleString()
    schema = f"page_id {kind}, width int, height int, local bigint, x0 int, y0 int, x1 int, y1 int, seams array<int>" + (", boxes binary" if closed else "")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, ("page_id", "_band")):
            pixels = table["lines"].to_numpy().astype(np.int64) * (table["size"].to_numpy() + 8)
            for part, begin in portions(table, start, pixels):
                yield from labelled(part, begin)

    def labelled(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        many = table["lines"].to_numpy().astype(np.int64)
        stretch = np.repeat(np.arange(len(table)), many)
        size = table["size"].to_numpy().astype(np.int64)[stretch]
        line = table["y"].to_numpy().astype(np.int64)[stretch] + np.arange(len(stretch)) - np.repeat(np.cumsum(many) - many, many)
        row, x0, x1 = _runs_of(_unpacked_ink(table["ink"].combine_chunks(), size), size)
        if not len(row):
            return
        y, row = line[row], stretch[row]
        width, height = (table[c].to_numpy().astype(np.int64)[row] for c in ("width", "height"))
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))[row]
        node = y * width + x0
        # A place for each line of each band, with a free one between bands.
        place = group * (band_rows + 1) + y % band_rows + 1
        far = (place[1:] - place[:-1], x0[1:] - x0[:-1])
        if not ((far[0] > 0) | (far[0] == 0) & (far[1] >= 0)).all():
            # A line that is there twice has its runs in order, too.
            order = np.lexsort((x0, place))
            row, x0, x1, y, width, height, group, node, place = (v[order] for v in (row, x0, x1, y, width, height, group, node, place))
        first = _joined(place, x0, x1)
        label = node[first]
        same = group[1:] == group[:-1]
        plain = not ((place[1:] == place[:-1]) & (x0[1:] < x1[:-1])).any() and not (same & ((width[1:] != width[:-1]) | (height[1:] != height[:-1]))).any()
        part, at = _components(group, label, first, width, height, plain)
        box = [np.full(len(at), 1 << 40), np.full(len(at), 1 << 40), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)]
        for to, value, least in zip(box, (x0, y, x1, y), (np.minimum, np.minimum, np.maximum, np.maximum)):
            least.at(to, part, value)
        end = (y % band_rows == 0) | (y % band_rows == band_rows - 1)
        shut = np.zeros(len(at), bool)
        if closed:
            end &= y > 0
            # Parts of a component that differ in page size are open together.
            _, whole = (None, np.arange(len(at))) if plain else np.unique(np.stack([group[at], label[at]]), axis=1, return_inverse=True)
            open_ = np.zeros(len(at), bool)
            open_[whole.reshape(-1)[part[end]]] = True
            shut = ~open_[whole.reshape(-1)]
            whole_box = np.flatnonzero(shut & _is_kept(box[2] - box[0], box[3] + 1 - box[1], width[at], height[at]))
            if len(whole_box):
                of = group[at][whole_box]
                if not plain:
                    whole_box, of = whole_box[np.argsort(of, kind="stable")], np.sort(of)
                found = np.stack([box[0], box[1], box[2], box[3] + 1])[:, whole_box].astype(np.int32)
                begin = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
                data = [zlib.compress(found[:, s:e].tobytes(), 1) for s, e in zip(begin.tolist(), [*begin[1:].tolist(), len(of)])]
                ids = table["page_id"].combine_chunks().take(pa.array(start[of[begin]]))
                nothing = [pa.nulls(len(begin), t) for t in (*[pa.int32()] * 2, pa.int64(), *[pa.int32()] * 4, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays([ids, *nothing, pa.array(data, pa.binary())], names=[*names, "local", *places, "seams", "boxes"])
        left = np.flatnonzero(~shut)
        if not len(left):
            return
        mine = np.flatnonzero(end)
        mine = mine[np.argsort(part[mine], kind="stable")]
        runs = as_lists(np.stack([y, x0, x1], axis=1)[mine], np.bincount(part[mine], minlength=len(at))[left] * 3)
        kept = table.select(names).take(pa.array(row[at[left]])).combine_chunks()
        columns = [*[kept[c] for c in names], pa.array(label[at[left]]), *[pa.array(v[left].astype(np.int32)) for v in box], runs]
        columns += [pa.nulls(len(left), pa.binary())] * closed
        yield from pa.table(columns, names=[*names, "local", *places, "seams", *["boxes"] * closed]).to_batches()

    keys = ("page_id", "_band")
    lines = bound_batches(ink_stretches(strips, limit, band_rows).repartition(*keys)).sortWithinPartitions(*keys, "y")
    return map_batches(lines, parts, schema)


def _boxes_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The boxes of deflated rows, one row each."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            some = batch.slice(at, 256)
            found = [np.frombuffer(zlib.decompress(b), np.int32).reshape(4, -1) for b in some["boxes"].to_pylist()]
            ids = some["page_id"].take(pa.array(np.repeat(np.arange(len(found)), [f.shape[1] for f in found])))
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, np.concatenate(found, axis=1))], names=["page_id", "x0", "y0", "x1", "y1"])


def ink_components(strips: DataFrame, limit: int = INK_LIMIT, band_rows: int = PAGE_BAND) -> DataFrame:
    """Glyph-sized boxes of 4-connected ink: page_id, x0, y0, x1, y1.

    Runs are united inside bands first; only the few components that touch a
    band boundary go on to the blocks of bands and to the page, all others leave their band as boxes, deflated.
    """
    parts = cut_lineage(band_parts(strips, limit, band_rows, True))
    kind = parts.schema["page_id"].dataType.simpleString()
    shut = map_batches(parts.where("boxes is not null").select("page_id", "boxes"), _boxes_of, f"page_id {kind}, x0 int, y0 int, x1 int, y1 int")
    parts = parts.where("boxes is null").drop("boxes")
    run = lambda i: F.element_at("seams", F.col("_i") * 3 + i)
    ends = parts.select("page_id", "local", "seams", F.explode(indices(F.size("seams") / 3)).alias("_i")).select(
        "page_id", "local", run(1).alias("y"), run(2).alias("x0"), run(3).alias("x1")
    )
    merged = merge_labels(cut_lineage(seam_edges(ends, band_rows)))
    parts = parts.groupBy("page_id", "local", "width", "height").agg(
        F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")
    )
    whole = parts.join(merged.select("page_id", F.col("u").alias("local"), "label"), ["page_id", "local"], "left")
    box = (
        whole.groupBy("page_id", F.coalesce("label", "local").alias("label"), "width", "height")
        .agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), (F.max("y1") + 1).alias("y1"))
    )
    tall, wide = F.col("y1") - F.col("y0"), F.col("x1") - F.col("x0")
    keep = tall.between(3, F.greatest(int_div(F.col("height"), 2), F.lit(3))) & wide.between(
        1, F.greatest(int_div(F.col("width") * 2, 5), F.lit(1))
    )
    return shut.unionByName(box.where(keep).select("page_id", "x0", "y0", "x1", "y1"))


# --- glyphs ---------------------------------------------------------------


def _cell_counts(lines: pa.Table, group: np.ndarray, boxes: pa.Table, owner: np.ndarray, band: np.ndarray, band_rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Ink in each of the 7 x 5 cells of boxes, from the lines of one band each, and whether there is a line."""
    size = lines["size"].to_numpy().astype(np.int64)
    total = np.concatenate([[0], np.cumsum(_unpacked_ink(lines["ink"].combine_chunks(), size), dtype=np.int64)])
    begin = np.cumsum(size) - size
    place = group * band_rows + lines["y"].to_numpy().astype(np.int64) % band_rows
    x0, y0, x1, y1 = (boxes[c].to_numpy().astype(np.int64) for c in ("x0", "y0", "x1", "y1"))
    wide, tall = x1 - x0, y1 - y0
    top, low = np.maximum(y0, band * band_rows), np.minimum(y1, (band + 1) * band_rows)
    many = np.maximum(low - top, 0)
    of = np.repeat(np.arange(len(x0)), many)
    at = owner[of] * band_rows + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + (top - band * band_rows)[of]
    first, last = np.searchsorted(place, at), np.searchsorted(place, at, side="right")
    copies = last - first
    cells = np.arange(5)
    left = (cells * wide[:, None]) // 5
    right = np.maximum(((cells + 1) * wide[:, None]) // 5, left + 1)
    left, right = left + x0[:, None], right + x0[:, None]
    found = np.zeros((len(of) + 1, 5), np.int64)
    for n in range(int(copies.max(initial=0))):
        some = np.flatnonzero(copies > n)
        line = first[some] + n
        a, b = (np.clip(v[of[some]], 0, size[line][:, None]) + begin[line][:, None] for v in (left, right))
        found[some + 1] += total[b] - total[a]
    found = np.cumsum(found, axis=0)
    rows = np.arange(7)
    start = (rows * tall[:, None]) // 7
    stop = np.maximum(((rows + 1) * tall[:, None]) // 7, start + 1)
    offset = (np.cumsum(many) - many)[:, None]
    start, stop = (np.clip(v + (y0 - top)[:, None], 0, many[:, None]) + offset for v in (start, stop))
    met = np.concatenate([[0], np.cumsum(copies)])
    held = met[np.cumsum(many)] - met[np.cumsum(many) - many]
    return (found[stop] - found[start]).reshape(len(x0), 35), held > 0


def glyph_match(strips: DataFrame, boxes: DataFrame, limit: int = INK_LIMIT, band_rows: int = PAGE_BAND) -> DataFrame:
    """Best 5x7 template per box: page_id, x0, y0, x1, y1, ch, same (equal cells of 35), score.

    Boxes meet the lines, packed as one bit per pixel, in bands of lines; a box of
    several bands has its 35 ink counts of each added up.  A box becomes a 35-bit
    mask, so comparing it with a template is one XOR and a bit count.
    """
    place = ["x0", "y0", "x1", "y1"]
    key = ["page_id", *place]
    kind = strips.schema["page_id"].dataType.simpleString()
    ink = ink_lines(strips, limit, band_rows).where("page_id IS NOT NULL")
    nothing = [F.lit(None).cast("int").alias(c) for c in place]
    ink = ink.select("page_id", "_band", F.lit(0).alias("copies"), *nothing, "y", "size", "ink")
    # Equal boxes are one, as often as they come.
    some = boxes.where("page_id IS NOT NULL AND y1 > y0").select("page_id", *[to_int(F.col(c)).alias(c) for c in place])
    last = int_div(F.col("y1") - 1, band_rows)
    bands = F.explode(F.sequence(to_int(int_div(F.greatest("y0", F.lit(0)), band_rows)), to_int(F.greatest(last, int_div(F.greatest("y0", F.lit(0)), band_rows)))))
    asked = some.select("page_id", bands.alias("_band"), F.lit(1).alias("copies"), *place, F.lit(-1).alias("y"), F.lit(0).alias("size"), F.lit(None).cast("binary").alias("ink"))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, ("page_id", "_band")):
            table = table.combine_chunks()
            group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))
            box = table["copies"].to_numpy() > 0
            here, lines = np.flatnonzero(box), np.flatnonzero(~box)
            if not len(here) or not len(lines):
                continue
            mine = table.take(pa.array(here))
            found, met = _cell_counts(table.take(pa.array(lines)), group[lines], mine, group[here], mine["_band"].to_numpy().astype(np.int64), band_rows)
            kept = mine.filter(pa.array(met)).select(key).combine_chunks()
            cells = as_binary(found[met].astype(np.int64).reshape(-1), np.full(int(met.sum()), 35))
            yield from pa.table([*[kept[c] for c in key], cells], names=[*key, "cells"]).to_batches()

    near = ("page_id", "_band")
    parts = bound_batches(ink.unionByName(asked).repartition(*near)).sortWithinPartitions(*near, "y")
    parts = parts.mapInArrow(counts, f"page_id {kind}, x0 int, y0 int, x1 int, y1 int, cells binary")
    whole = bound_batches(parts.repartition(*key)).sortWithinPartitions(*key)
    glyphs = glyph_bits()
    masks = np.array([mask for _, mask in glyphs], dtype=np.int64)
    names = pa.array([ch for ch, _ in glyphs])

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, tuple(key)):
            data, _ = flat_bytes(table["cells"].combine_chunks())
            found = np.add.reduceat(data.view(np.int64).reshape(-1, 35), start, axis=0).reshape(len(start), 7, 5)
            boxes_ = table.select(key).take(pa.array(start)).combine_chunks()
            x0, y0, x1, y1 = (boxes_[c].to_numpy().astype(np.int64) for c in place)
            sides = []
            for size, parts_ in ((y1 - y0, 7), (x1 - x0, 5)):
                k = np.arange(parts_)
                low = (k * size[:, None]) // parts_
                sides.append(np.maximum(((k + 1) * size[:, None]) // parts_, low + 1) - low)
            on = found * 2 > sides[0][:, :, None] * sides[1][:, None, :]
            bits = (on.reshape(len(start), 35) * (1 << np.arange(35, dtype=np.int64))).sum(axis=1)
            # The highest ordinal wins a tie.
            kinds, of = np.unique(bits, return_inverse=True)
            same = 35 - np.bitwise_count(kinds[:, None] ^ masks).astype(np.int64)
            best = same.shape[1] - 1 - same[:, ::-1].argmax(axis=1)
            most = same[np.arange(len(kinds)), best]
            yield from pa.table(
                [*[boxes_[c] for c in key], names.take(pa.array(best[of])), pa.array(most[of], pa.int32()), pa.array(most[of] / 35.0)],
                names=[*key, "ch", "same", "score"],
            ).to_batches()

    return whole.mapInArrow(match, f"page_id {kind}, x0 int, y0 int, x1 int, y1 int, ch string, same int, score double")


# --- reading order --------------------------------------------------------


def reading_lines(boxes: DataFrame) -> DataFrame:
    """Attach ``line`` (0, 1, ... top down) to every box.

    Boxes are taken by (y0, x0); a box joins the last line when its middle lies
    in the line's growing span.  A line begins with its topmost box, so only its lower
    end grows: the sweep carries a page, a line number and that end from row to row
    and batch to batch, and holds no more of a page than one batch.
    """
    schema = StructType([*boxes.schema.fields, StructField("line", IntegerType())])

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        page = bottom = line = None
        for batch in batches:
            out = []
            for at, top, end in zip(*(batch[c].to_pylist() for c in ("page_id", "y0", "y1")), strict=True):
                if line is None or at != page:
                    page, bottom, line = at, end, 0
                elif (top + end) // 2 < bottom:
                    bottom = max(bottom, end)
                else:
                    bottom, line = end, line + 1
                out.append(line)
            yield batch.append_column("line", pa.array(out, pa.int32()))

    return boxes.repartition("page_id").sortWithinPartitions("page_id", "y0", "x0", "y1", "x1").mapInArrow(sweep, schema)


def line_text(glyphs: DataFrame, cells: int = 35) -> DataFrame:
    """page_id, text, confidence, glyphs from boxes with line, ch and same.

    A gap wider than half the previous glyph is a word space.  Strings are
    built per line first, then the lines of a page are joined.  ``same`` is the
    whole number of equal cells, out of ``cells``: whole numbers are summed and
    divided once, so the order of rows cannot change the confidence.
    """
    along = Window.partitionBy("page_id", "line").orderBy("x0", "y0", "y1", "x1")
    gap = F.greatest(F.col("x0") - F.lag("x1").over(along), F.lit(0))
    spaced = gap * 2 > F.lag("x1").over(along) - F.lag("x0").over(along)
    marked = glyphs.select(
        "page_id",
        "line",
        F.row_number().over(along).alias("at"),
        F.concat(F.when(F.coalesce(spaced, F.lit(False)), " ").otherwise(""), F.col("ch")).alias("piece"),
        "same",
    )
    lines = marked.groupBy("page_id", "line").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "piece"))), lambda p: p["piece"]), "").alias("body"),
        F.sum("same").alias("same"),
        F.count(F.lit(1)).alias("n"),
    )
    return lines.groupBy("page_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "body"))), lambda p: p["body"]), "\n").alias("text"),
        (F.sum("same") / (F.sum("n") * cells)).alias("confidence"),
        F.sum("n").alias("glyphs"),
    )


def recognized_pages(pages: DataFrame, texts: DataFrame) -> DataFrame:
    """Every page has a result; no glyph means the placeholder and zero."""
    return pages.select("page_id").join(texts, "page_id", "left").select(
        "page_id",
        F.coalesce("text", F.lit(NO_TEXT)).alias("text"),
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


# --- OCR tables -----------------------------------------------------------


def ocr_words(tsv: DataFrame, column: str = "tsv") -> DataFrame:
    """Word rows of a 12-column TSV text: page_id, level, conf, text."""
    lines = tsv.select("page_id", F.posexplode(F.split(F.col(column), r"\r?\n")).alias("at", "line")).where("at > 0")
    parts = F.split("line", "\t")
    return lines.where(F.size(parts) > 11).select(
        "page_id",
        parts[0].alias("level"),
        F.regexp_replace(parts[10], r"(?U)^\s+|\s+$", "").try_cast("double").alias("conf"),
        parts[11].alias("text"),
    )


def ocr_confidence(words: DataFrame, pages: DataFrame) -> DataFrame:
    """Mean word confidence (0..1) per page; no counted word gives zero."""
    visible = F.regexp_replace("text", r"\s+", "") != ""
    counted = words.where((F.col("level").cast("string") == "5") & (F.col("conf") >= 0) & visible)
    means = counted.groupBy("page_id").agg(F.avg("conf").alias("mean"), F.count(F.lit(1)).alias("words"))
    return pages.select("page_id").join(means, "page_id", "left").select(
        "page_id",
        F.least(F.coalesce(F.col("mean") / 100.0, F.lit(0.0)), F.lit(1.0)).alias("confidence"),
        F.coalesce("words", F.lit(0)).alias("words"),
    )


def direct_text(text: Column) -> Column:
    """Trimmed text, or the placeholder when nothing was read."""
    trimmed = F.regexp_replace(text, r"(?U)^\s+|\s+$", "")
    return F.when(F.coalesce(trimmed, F.lit("")) == "", NO_TEXT).otherwise(trimmed)


def layer_text(text: Column) -> Column:
    """Text for the page layer: the placeholder must not be findable."""
    return F.when(text == NO_TEXT, "").otherwise(text)


def text_budget(pages: DataFrame, page_limit: int = MAX_PAGE_TEXT, total_limit: int = MAX_DOCUMENT_TEXT) -> DataFrame:
    """job_id, page_no, bytes, total, reason.  The running total follows page
    order; ``reason`` marks pages over their own limit or the job's."""
    sized = pages.select("job_id", "page_no", F.octet_length("text").cast("bigint").alias("bytes"))
    ran = prefix_scan(sized, ["job_id"], "page_no", (), F.col("bytes"), "total")
    return ran.select(
        "job_id",
        "page_no",
        "bytes",
        "total",
        F.when(F.col("bytes") > page_limit, "page text exceeds the limit")
        .when(F.col("total") > total_limit, "document text exceeds the limit")
        .alias("reason"),
    )


def budget_rejections(pages: DataFrame, page_limit: int = MAX_PAGE_TEXT, total_limit: int = MAX_DOCUMENT_TEXT) -> DataFrame:
    """First violation per job: job_id, page_no, reason."""
    bad = text_budget(pages, page_limit, total_limit).where("reason is not null")
    return bad.groupBy("job_id").agg(F.min("page_no").alias("page_no"), F.min_by("reason", "page_no").alias("reason"))


def char_codes(pages: DataFrame) -> DataFrame:
    """job_id, ch, code: distinct characters of a job numbered by code point.

    Characters are made distinct inside the page first, then per job with a
    map-side combine; the window sees at most one alphabet.
    """
    chars = pages.select("job_id", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''").distinct()
    # UTF-8 byte order is code point order.
    by_point = Window.partitionBy("job_id").orderBy(F.hex(F.encode("ch", "UTF-8")))
    return chars.select("job_id", "ch", F.row_number().over(by_point).alias("code"))


def encode_text_rejects(codes: DataFrame) -> DataFrame:
    """job_id, codes, reason of the jobs whose alphabet does not fit two bytes."""
    most = codes.groupBy("job_id").agg(F.max("code").cast("bigint").alias("codes")).where(F.col("codes") > MAX_CODES)
    return most.withColumn("reason", F.lit("codes beyond two bytes"))


def encode_text(pages: DataFrame, codes: DataFrame) -> DataFrame:
    """Attach ``encoded``: two big-endian bytes per character.

    Pages of the jobs in ``encode_text_rejects`` are left out here.

    Only a page's own alphabet meets the code table; the text never leaves its
    row.  Codes that are not valid characters take the list look-up instead.
    """
    pages = pages.join(encode_text_rejects(codes).select("job_id"), "job_id", "left_anti")
    alphabet = pages.select("job_id", "page_no", F.explode(F.array_distinct(F.split("text", ""))).alias("ch")).where("ch <> ''")
    found = salted_join(alphabet, codes.groupBy("job_id", "ch").agg(F.first("code").alias("code")), ["job_id", "ch"], F.col("page_no"))
    tables = found.groupBy("job_id", "page_no").agg(
        F.sort_array(F.collect_list(F.struct("code", "ch"))).alias("_codes")
    )
    two = lambda code: F.lpad(F.hex(code.cast("bigint")), 4, F.lit("0"))
    source = F.array_join(F.transform("_codes", lambda c: c["ch"]), "")
    target = F.decode(F.unhex(F.array_join(F.transform("_codes", lambda c: two(c["code"])), "")), "UTF-16BE")
    fast = F.encode(F.call_function("translate", F.col("text"), source, target), "UTF-16BE")
    slow = F.unhex(
        F.array_join(
            let(
                F.struct(
                    F.transform("_codes", lambda c: c["ch"]).alias("ch"), F.transform("_codes", lambda c: two(c["code"])).alias("hex")
                ),
                lambda t: F.transform(F.split("text", ""), lambda ch: F.element_at(t["hex"], F.array_position(t["ch"], ch).cast("int"))),
            ),
            "",
        )
    )
    simple = F.element_at("_codes", -1)["code"] < 0xD800
    joined = pages.join(tables, ["job_id", "page_no"], "left")
    encoded = F.when(F.col("_codes").isNull(), F.lit(b"").cast("binary")).when(simple, fast).otherwise(slow)
    return joined.withColumn("encoded", encoded).drop("_codes")
