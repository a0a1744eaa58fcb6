"""Neighbourhood filters over strips.

The vertical neighbours of a line come from ``lag``/``lead`` inside row bands.
A band is a fixed run of lines plus the few halo lines the radius needs, so one
page is worked on by many tasks and a window partition stays small.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import indices, int_div, let, luma, to_int
from ..functions.lines import as_lists, blocks, clamped, flat_lines, map_batches, map_lines, portions, whole_groups
from ..functions.scale import PAGE_BAND
from .raster import STRIP_COLUMNS

# Fixed tier spellings and settings.
TIER_ALIASES = {
    "light": "light", "l": "light", "low": "light",
    "medium": "medium", "true": "medium", "on": "medium", "yes": "medium", "1": "medium",
    "heavy": "heavy", "h": "heavy", "high": "heavy", "strong": "heavy",
}
TIER_OFF = ("", "off", "none", "false", "0", "no")
GRAIN = {"light": (1, 0.35), "medium": (1, 0.7), "heavy": (2, 0.9)}
DUST = {"light": (1, 45), "medium": (2, 30), "heavy": (3, 18)}


def tier_of(label: str, value: str | None) -> str | None:
    text = "" if value is None else value.strip().lower()
    if text in TIER_OFF:
        return None
    if text not in TIER_ALIASES:
        raise ValueError(f"{label} unknown tier")
    return TIER_ALIASES[text]


def with_neighbours(strips: DataFrame, radius: int, band_rows: int = PAGE_BAND) -> DataFrame:
    """Add ``up_1..up_r`` and ``down_1..down_r``; null beyond the page edge."""
    near = Window.partitionBy("page_id", "_band").orderBy("y")
    out = banded(strips, radius, band_rows).select(
        "*",
        *[F.lag("row", k).over(near).alias(f"up_{k}") for k in range(1, radius + 1)],
        *[F.lead("row", k).over(near).alias(f"down_{k}") for k in range(1, radius + 1)],
    )
    return out.where(int_div(F.col("y"), band_rows) == F.col("_band")).drop("_band")


def drop_neighbours(df: DataFrame, radius: int) -> DataFrame:
    return df.drop(*[f"{side}_{k}" for side in ("up", "down") for k in range(1, radius + 1)])


def banded(strips: DataFrame, radius: int, band_rows: int = PAGE_BAND) -> DataFrame:
    """Strips with the band they are needed in: their own and, within
    ``radius`` of a boundary, the neighbour's."""
    y = F.col("y")
    bands = F.array_distinct(
        F.array(
            *[
                to_int(int_div(at, band_rows))
                for at in (F.greatest(y - radius, F.lit(0)), y, F.least(y + radius, F.col("height") - 1))
            ]
        )
    )
    return strips.withColumn("_band", F.explode(bands))


class Lines:
    """Lines of whole bands in order of band and y, as (line, x, channel) bytes.

    ``own`` are the places of the lines to be made, the others are their neighbours.
    """

    def __init__(self, samples: np.ndarray, start: np.ndarray, y: np.ndarray, own: np.ndarray) -> None:
        self.samples, self.own = samples, own
        size = np.diff(np.append(start, len(y)))
        self.first, self.last = np.repeat(start, size), np.repeat(start + size - 1, size)
        self.place = np.repeat(np.arange(len(start)), size) * (1 << 40) + y

    def beside(self, of: np.ndarray, by: int) -> np.ndarray:
        """Places ``by`` lines further in the same band; beyond its ends, the end."""
        return np.clip(of + by, self.first[of], self.last[of])

    def within(self, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """For each own line, where the lines up to ``radius`` away begin and end."""
        at = self.place[self.own]
        return np.searchsorted(self.place, at - radius), np.searchsorted(self.place, at + radius, side="right")


def by_band(strips: DataFrame, radius: int, change: Callable[[Lines], np.ndarray], band_rows: int = PAGE_BAND, out: str = "row", least: int = 0) -> DataFrame:
    """Lines made from their neighbours: ``change`` gives one new line for each own line.

    Bands go to NumPy as deflated stretches of lines, sorted, many small ones at a time.  The lines that another
    band needs of a batch go to it as a stretch of its own: a band is at most ``band_rows + 2 * radius`` lines of one page.
    Pages with a side below ``least`` are kept.
    """
    names = [c for c in STRIP_COLUMNS if c != "row"]
    lists = ["row"] if out == "row" else ["row", out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, ("page_id", "_band")):
            bytes_ = table["lines"].to_numpy().astype(np.int64) * (table["size"].to_numpy() + 24)
            for part, begin in portions(table, start, bytes_):
                yield from made(part, begin)

    def made(table: pa.Table, start: np.ndarray) -> Iterator[pa.RecordBatch]:
        width, bpp, height, y, band, many, size = (table[c].to_numpy().astype(np.int64) for c in ("width", "bpp", "height", "y", "_band", "lines", "size"))
        data = np.frombuffer(b"".join(map(zlib.decompress, table["data"].to_pylist())), np.uint8)
        of = np.repeat(np.arange(len(many)), many)
        y = y[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
        group = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(table))))[of]
        at = np.cumsum(size[of]) - size[of]
        # Stretches of a band may hold the same lines.
        order = None
        if ((group[1:] == group[:-1]) & (y[1:] < y[:-1])).any():
            order = np.lexsort((y, group))
            of, y, group, at = of[order], y[order], group[order], at[order]
        shape = (width * 8 + bpp)[start][group]
        for one in np.unique(shape):
            mine = np.flatnonzero(shape == one)
            w, b = int(one) // 8, int(one) % 8
            if (size[of[mine]] != w * b).any():
                raise ValueError("a line does not have width times channels samples")
            own = np.flatnonzero(y[mine] // band_rows == band[of[mine]])
            if not len(own):
                continue
            whole = order is None and len(mine) == len(of)
            samples = (data if whole else data[at[mine, None] + np.arange(w * b)]).reshape(len(mine), w, b)
            first = np.flatnonzero(np.append(True, np.diff(group[mine]) != 0))
            found = change(Lines(samples, first, y[mine], own)).reshape(samples[own].shape)
            kept = mine[own]
            small = np.minimum(width, height)[of[kept]] < least
            if small.any():
                found = np.where(small[:, None, None], samples[own], found)
            rows = table.select([c for c in names if c != "y"]).take(pa.array(of[kept])).combine_chunks()
            lines = [as_lists(samples[own]), as_lists(found)][-len(lists) :]
            columns = [pa.array(y[kept], kind_of_y) if c == "y" else rows[c] for c in names]
            yield from pa.table([*columns, *lines], names=[*names, *lists]).to_batches()

    kinds = {c: strips.schema[c].dataType.simpleString() for c in names}
    kind_of_y = pa.int64() if kinds["y"] == "bigint" else pa.int32()
    schema = ", ".join([f"{c} {k}" for c, k in kinds.items()] + [f"`{c}` array<int>" for c in lists])
    keys = ("page_id", "_band")
    parts = band_blocks(strips, radius, band_rows).repartition(*keys)
    return map_batches(parts.sortWithinPartitions(*keys, "y"), run, schema)


def band_blocks(strips: DataFrame, radius: int, band_rows: int = PAGE_BAND) -> DataFrame:
    """Deflated stretches (as ``blocks``) for each band (``_band``) that they are needed in, as ``banded`` deals lines."""
    kinds = {c: strips.schema[c].dataType.simpleString() for c in STRIP_COLUMNS if c != "row"}

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y, height = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("y", "height"))
            own, up, down = (at // band_rows for at in (y, np.maximum(y - radius, 0), np.minimum(y + radius, height - 1)))
            for band, some in ((own, None), (up, up != own), (down, (down != own) & (down != up))):
                if some is None or some.any():
                    part = batch if some is None else batch.filter(pa.array(some))
                    yield part.append_column("_band", pa.array(band if some is None else band[some], pa.int32()))

    lines = map_batches(strips, deal, ", ".join([*[f"{c} {k}" for c, k in kinds.items()], "row array<int>, _band int"]), STRIP_COLUMNS)
    return blocks(lines, band_rows, "_band")


def median_of(planes: list[np.ndarray]) -> np.ndarray:
    """Element-wise median of an odd number of arrays.

    Of a few more than half of them the least and the greatest cannot be the median;
    both are dropped and one more array comes in, until one is left.
    """
    have, rest = [p.copy() for p in planes[: len(planes) // 2 + 2]], list(planes[len(planes) // 2 + 2 :])
    while True:
        least, most = have[0], have[-1]
        for p in have[1:]:
            low = np.minimum(least, p)
            np.maximum(least, p, out=p)
            least = low
        for p in have[1:-1]:
            high = np.maximum(most, p)
            np.minimum(most, p, out=p)
            most = high
        have = have[1:-1]
        if not rest:
            return have[0]
        have.append(rest.pop().copy())


def with_median(strips: DataFrame, radius: int, out: str = "_median", band_rows: int = PAGE_BAND) -> DataFrame:
    """Add the median line of the (2r+1)^2 box, edges replicated, per channel.

    Ordering a box of samples per sample is not something a built-in expression
    does well (array sorts inside lambdas took about four times as long).
    """
    r = max(1, radius)
    side = 2 * r + 1

    def medians(lines: Lines) -> np.ndarray:
        width, bpp = lines.samples.shape[1:]
        wide = np.pad(lines.samples, ((0, 0), (r, r), (0, 0)), mode="edge")
        found = np.empty((len(lines.own), width, bpp), dtype=np.uint8)
        # Short pieces keep the working arrays inside the CPU cache.
        step = max(1, 32_768 // max(1, width * bpp))
        for start in range(0, len(lines.own), step):
            part = lines.own[start : start + step]
            near = [wide[lines.beside(part, dy)] for dy in range(-r, r + 1)]
            found[start : start + step] = median_of([n[:, dx : dx + width] for n in near for dx in range(side)])
        return found

    return by_band(strips, r, medians, band_rows, out)


def median(strips: DataFrame, radius: int = 1, band_rows: int = PAGE_BAND) -> DataFrame:
    return with_median(strips, radius, "_median", band_rows).withColumn("row", F.col("_median")).drop("_median")


def sharpen(strips: DataFrame, amount: float, band_rows: int = PAGE_BAND) -> DataFrame:
    """(1+a)v - a/4 * the four neighbours, replicated edges."""
    if abs(amount) < 1e-9:
        return strips
    a = max(0.0, min(5.0, amount))
    centre, side = 1.0 + a, -a / 4.0

    def sharper(lines: Lines) -> np.ndarray:
        mid, up, down = (lines.samples[lines.beside(lines.own, k)].astype(np.float64) for k in (0, -1, 1))
        wide = np.pad(mid, ((0, 0), (1, 1), (0, 0)), mode="edge")
        return clamped(centre * mid + side * (wide[:, :-2] + wide[:, 2:] + up + down))

    return by_band(strips, 1, sharper, band_rows, least=3)


def box_blur(strips: DataFrame, radius: int = 1, band_rows: int = PAGE_BAND) -> DataFrame:
    """Two truncating mean passes; the frame is clipped at the edges.

    Sums over a frame are differences of running totals, along the lines and
    then down them, so the work does not grow with the radius.  One band at a
    time goes to NumPy, at most ``band_rows + 2 * radius`` lines of one page.
    """
    r = max(1, radius)

    def blurred(lines: Lines) -> np.ndarray:
        def means(values, first, end):
            total = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
            return (total[end] - total[first]) // (end - first).reshape(-1, *[1] * (values.ndim - 1))

        x = np.arange(lines.samples.shape[1])
        across = means(lines.samples.transpose(1, 0, 2), np.maximum(x - r, 0), np.minimum(x + r + 1, len(x))).transpose(1, 0, 2)
        return means(across, *lines.within(r))

    return by_band(strips, r, blurred, band_rows)


def near_median(
    strips: DataFrame, radius: int, change: Callable[[np.ndarray, np.ndarray], np.ndarray], band_rows: int = PAGE_BAND
) -> DataFrame:
    """Each line replaced by ``change(samples, medians)``, both (line, x, channel); see ``with_median``."""

    def changed(samples: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
        return change(samples, flat_lines(rows["_median"])[0].reshape(samples.shape))

    return map_lines(with_median(strips, radius, "_median", band_rows), changed, drop=("_median",))


def _blend(strips: DataFrame, radius: int, share: float, band_rows: int) -> DataFrame:
    return near_median(strips, radius, lambda v, m: clamped(v * (1.0 - share) + m * share), band_rows)


def denoise(strips: DataFrame, strength: float, band_rows: int = PAGE_BAND) -> DataFrame:
    share = max(0.0, min(1.0, strength))
    return strips if share < 1e-9 else _blend(strips, 1, share, band_rows)


def grain_reduction(strips: DataFrame, amount: str | None, band_rows: int = PAGE_BAND) -> DataFrame:
    tier = tier_of("grain reduction tier", amount)
    return strips if tier is None else _blend(strips, *GRAIN[tier], band_rows)


def descreen_radius(dpi: int) -> int:
    return max(1, min(4, int(150.0 / max(25, min(300, dpi)) + 0.5)))


def descreen(strips: DataFrame, dpi: int = 75, band_rows: int = PAGE_BAND) -> DataFrame:
    return box_blur(strips, descreen_radius(dpi), band_rows)


def dust_clean(strips: DataFrame, amount: str | None, band_rows: int = PAGE_BAND) -> DataFrame:
    """Replace a pixel by its median when any colour differs by more than the
    tier's threshold; alpha never moves."""
    tier = tier_of("infrared clean tier", amount)
    if tier is None:
        return strips
    radius, threshold = DUST[tier]

    def cleaned(v: np.ndarray, m: np.ndarray) -> np.ndarray:
        colours = slice(0, min(3, v.shape[2]))
        far = (np.abs(v[..., colours] - m[..., colours]) > threshold).any(axis=2, keepdims=True)
        out = v.copy()
        out[..., colours] = np.where(far, m[..., colours], v[..., colours])
        return out

    return near_median(strips, radius, cleaned, band_rows)


def hole_punch(strips: DataFrame) -> DataFrame:
    """Dark pixels near a page corner become paper.  Row-local, no shuffle."""
    bpp, width, height, y = F.col("bpp"), F.col("width"), F.col("height"), F.col("y")
    reach = to_int(F.floor(F.greatest(F.least(width, height) * F.lit(0.04), F.lit(4.0))))
    # Squared vertical distance to the nearer top or bottom edge line.
    dy = F.least(y, height - 1 - y)

    def pixel(r: Column, x: Column) -> Column:
        dx = F.least(x, width - 1 - x)
        at = x * bpp
        shade = F.when(bpp >= 3, luma(F.get(r, at), F.get(r, at + 1), F.get(r, at + 2))).otherwise(r[at])
        hit = (dx * dx + dy * dy <= reach * reach) & (shade < 40)
        paper = F.concat(F.array_repeat(F.lit(245), F.least(bpp, F.lit(3))), F.slice(r, at + 4, F.greatest(bpp - 3, F.lit(0))))
        return F.when(hit, paper).otherwise(F.slice(r, at + 1, bpp))

    changed = let(F.col("row"), lambda r: F.flatten(F.transform(indices(width), lambda x: pixel(r, x))))
    return strips.withColumn("row", F.when(dy <= reach, changed).otherwise(F.col("row")))
