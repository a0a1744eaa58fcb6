"""Per-sample tone and colour maps, and the page statistics that drive them."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import clamp, clamp_byte, indices, let, to_int
from ..functions.lines import as_lists, clamped, flat_lines, luma_of, map_batches, map_lines, with_column
from ..functions.scale import join_page_stats
from .raster import luma_row, refuse_alpha

TINTS = {"blue": (0.7, 0.85, 1.15), "sepia": (1.15, 1.0, 0.75)}  # fixed factors
TINT_NAMES = {"sepia": "sepia", "warm": "sepia", "blue": "blue", "cool": "blue"}


def _half_away(value: float) -> int:
    return int(math.floor(abs(value) + 0.5) * (1 if value >= 0 else -1))


def _byte(value: float) -> int:
    return max(0, min(255, _half_away(value)))


def colour_samples(row: Column, bpp: Column, fn: Callable[[Column], Column]) -> Column:
    """Apply ``fn`` to every sample except the alpha sample.

    The layout is tested once per line, not once per sample.
    """
    with_alpha = F.transform(row, lambda v, i: F.when(i % 4 == 3, v).otherwise(fn(v)))
    return F.when(bpp == 4, with_alpha).otherwise(F.transform(row, lambda v: fn(v)))


def apply_lut(strips: DataFrame, table: Sequence[int]) -> DataFrame:
    """Map colour samples through a plan-constant table; alpha is kept."""
    lut = pa.array([int(v) for v in table], pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch["row"].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            values = batch["row"].flatten()
            made = lut.take(values)
            four = batch["bpp"].fill_null(0).to_numpy(zero_copy_only=False) == 4
            if four.any():
                place = np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)
                made = pc.if_else(pa.array(np.repeat(four, size) & (place % 4 == 3)), values, made)
            at = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(at), made, mask=batch["row"].is_null() if batch["row"].null_count else None)
            yield with_column(batch, "row", lists)

    return map_batches(strips, run, strips.schema)


def rgb_pixels(row: Column, bpp: Column, width: Column, fn: Callable[..., Sequence[Column]]) -> Column:
    """Rewrite the three colour samples of each pixel; alpha is carried along."""

    def pixel(r: Column, at: Column) -> Column:
        out = F.array(*[to_int(c) for c in fn(r[at], r[at + 1], r[at + 2])])
        return F.when(bpp == 4, F.concat(out, F.slice(r, at + 4, F.lit(1)))).otherwise(out)

    return let(row, lambda r: F.flatten(F.transform(indices(width), lambda x: pixel(r, x * bpp))))


def map_rgb(strips: DataFrame, fn: Callable[..., Sequence[Column]], operator: str | None = None) -> DataFrame:
    """Colour operator; gray strips pass through."""
    mapped = rgb_pixels(F.col("row"), F.col("bpp"), F.col("width"), fn)
    row = F.when(F.col("bpp") == 1, F.col("row")).otherwise(mapped)
    return strips.withColumn("row", refuse_alpha(operator, row) if operator else row)


# --- plan-constant tables -------------------------------------------------


def brightness_contrast_table(brightness: int = 0, contrast: int = 0) -> list[int]:
    b, c = (max(-100, min(100, value)) for value in (brightness, contrast))
    offset, factor = _half_away(b * 2.55), (100 + c) / 100.0
    return [max(0, min(255, _half_away((v - 128.0) * factor + 128.0) + offset)) for v in range(256)]


def brightness_contrast(strips: DataFrame, brightness: int = 0, contrast: int = 0) -> DataFrame:
    if brightness == 0 and contrast == 0:
        return strips
    return apply_lut(strips, brightness_contrast_table(brightness, contrast))


def invert(strips: DataFrame) -> DataFrame:
    return strips.withColumn("row", colour_samples(F.col("row"), F.col("bpp"), lambda v: F.lit(255) - v))


def levels_table(black: int = 0, white: int = 255, gamma: float = 1.0) -> list[int] | None:
    """None means identity."""
    if not math.isfinite(gamma):
        raise ValueError("levels gamma must be finite")
    black, white = (max(0, min(255, value)) for value in (black, white))
    if black == 0 and white == 255 and abs(gamma - 1.0) < 1e-9:
        return None
    span, power = max(1, white - black), 1.0 / (gamma if gamma > 0 else 1.0)
    return [_byte(min(1.0, max(0.0, (v - black) / span)) ** power * 255.0) for v in range(256)]


def levels(strips: DataFrame, black: int = 0, white: int = 255, gamma: float = 1.0) -> DataFrame:
    table = levels_table(black, white, gamma)
    return strips if table is None else apply_lut(strips, table)


def curve_table(points: Sequence[Sequence[int]] | None) -> list[int] | None:
    """Piecewise-linear table; None means identity (fewer than two points)."""
    if points is None or len(points) < 2:
        return None
    knots = sorted(((max(0, min(255, x)), max(0, min(255, y))) for x, y in points), key=lambda p: p[0])
    (first_x, first_y), (last_x, last_y) = knots[0], knots[-1]
    table = []
    for v in range(256):
        if v <= first_x:
            value = float(first_y)
        elif v >= last_x:
            value = float(last_y)
        else:
            left = max(k for k in range(len(knots)) if knots[k][0] <= v)
            (x0, y0), (x1, y1) = knots[left], knots[left + 1]
            t = (v - x0) / (x1 - x0)
            value = y0 * (1.0 - t) + y1 * t
        table.append(_byte(value))
    return table


def curves(strips: DataFrame, points: Sequence[Sequence[int]] | None) -> DataFrame:
    table = curve_table(points)
    return strips if table is None else apply_lut(strips, table)


def flatten_table() -> list[int]:
    return [_byte((v / 255.0 + (1.0 - v / 255.0) * 0.12 * (v / 255.0)) * 255.0) for v in range(256)]


def flatten_paper(strips: DataFrame) -> DataFrame:
    """Lift midtones toward paper white."""
    return apply_lut(strips, flatten_table())


# --- per-pixel colour maps ------------------------------------------------


def map_colours(strips: DataFrame, fn: Callable[[np.ndarray], np.ndarray], operator: str) -> DataFrame:
    """Colour operator on (..., 3) samples, pixel by pixel; gray lines pass through, four channels are refused."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, bpp = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "bpp"))
            values, size = flat_lines(batch["row"])
            if (size != width * bpp).any():
                raise ValueError("a line does not have width times channels samples")
            if (bpp == 4).any():
                raise ValueError(f"{operator}: unsupported pixel format Rgba8")
            if (bpp == 3).all():
                made = fn(values.reshape(-1, 3)).reshape(-1)
            else:
                made, colour = values.astype(np.int32), np.repeat(bpp == 3, size)
                made[colour] = fn(values[colour].reshape(-1, 3)).reshape(-1)
            yield with_column(batch, "row", as_lists(made, size))

    return map_batches(strips, run, strips.schema)


def desaturate(strips: DataFrame) -> DataFrame:
    return map_colours(strips, lambda v: np.repeat(luma_of(v)[..., None], 3, axis=-1), "desaturate")


def saturation(strips: DataFrame, amount: float) -> DataFrame:
    amount = max(-100.0, min(100.0, amount))
    if abs(amount) < 1e-9:
        return strips
    factor = 1.0 + amount / 100.0

    def moved(v: np.ndarray) -> np.ndarray:
        gray = luma_of(v)[..., None]
        return clamped(gray + (v - gray) * factor)

    return map_colours(strips, moved, "saturation")


def hue_shift(strips: DataFrame, degrees: float) -> DataFrame:
    """Turn the hue in HSV space."""
    shift = math.fmod(math.fmod(degrees, 360.0) + 360.0, 360.0)
    if abs(shift) < 1e-9:
        return strips

    # Each step is bound once; the tree would otherwise repeat it per use.
    def parts(r: Column, at: Column) -> Column:
        return F.struct(*[(r[at + k] / F.lit(255.0)).alias(n) for k, n in enumerate("rgb")])

    def extent(p: Column) -> Column:
        top = F.greatest(p["r"], p["g"], p["b"])
        return F.struct(top.alias("top"), (top - F.least(p["r"], p["g"], p["b"])).alias("delta"))

    def polar(p: Column, e: Column) -> Column:
        top, delta = e["top"], e["delta"]
        hue = (
            F.when(delta < 1e-9, F.lit(0.0))
            .when(F.abs(top - p["r"]) < 1e-12, F.pmod((p["g"] - p["b"]) / delta, F.lit(6.0)) * 60.0)
            .when(F.abs(top - p["g"]) < 1e-12, ((p["b"] - p["r"]) / delta + 2.0) * 60.0)
            .otherwise(((p["r"] - p["g"]) / delta + 4.0) * 60.0)
        )
        sat = F.when((delta < 1e-9) | (top == 0), F.lit(0.0)).otherwise(delta / top)
        return F.struct((F.pmod(hue + shift, F.lit(360.0)) / 60.0).alias("h"), (top * sat).alias("c"), top.alias("v"))

    def levels_of(q: Column) -> Column:
        """The three byte values a pixel of this chroma can take."""
        low = q["v"] - q["c"]
        middle = q["c"] * (F.lit(1.0) - F.abs(F.pmod(q["h"], F.lit(2.0)) - 1.0))
        return F.struct(
            to_int(F.floor(q["h"])).alias("sector"),
            *[clamp_byte((part + low) * 255.0).alias(n) for part, n in ((q["c"], "c"), (middle, "x"), (F.lit(0.0), "o"))],
        )

    def placed(t: Column) -> Column:
        order = ("cxo", "xco", "ocx", "oxc", "xoc")
        out = F.array(t["c"], t["o"], t["x"])
        for sector, names in enumerate(order):
            out = F.when(t["sector"] == sector, F.array(*[t[n] for n in names])).otherwise(out)
        return out

    def turned(r: Column, at: Column) -> Column:
        return let(parts(r, at), lambda p: let(let(let(extent(p), lambda e: polar(p, e)), levels_of), placed))

    mapped = let(
        F.col("row"),
        lambda r: F.flatten(
            F.transform(indices(F.col("width")), lambda x: turned(r, x * 3))
        ),
    )
    row = F.when(F.col("bpp") == 1, F.col("row")).otherwise(mapped)
    return strips.withColumn("row", refuse_alpha("hue_shift", row))


def restore_colors(strips: DataFrame) -> DataFrame:
    """Modest green and blue boost (fixed exponents and gains)."""
    tables = [
        F.array(*[F.lit(_byte((v / 255.0) ** power * 255.0 * gain)) for v in range(256)])
        for power, gain in ((1.05, 0.98), (0.92, 1.06), (0.94, 1.04))
    ]

    def boosted(r: Column, g: Column, b: Column) -> list[Column]:
        green, blue = tables[1][g], tables[2][b]
        lift = F.lit(1.03)
        return [
            tables[0][r],
            F.when((g >= r) & (g >= b) & (g > 40), clamp_byte(green * lift)).otherwise(green),
            F.when((b >= r) & (b > g) & (b > 40), clamp_byte(blue * lift)).otherwise(blue),
        ]

    return map_rgb(strips, boosted)


def colorize(strips: DataFrame, mode: str | None = "sepia") -> DataFrame:
    """Luma times a tint; the result always has three channels."""
    name = ("sepia" if mode is None else mode).strip().lower()
    if name in ("", "off", "none", "false"):
        return strips
    if name not in TINT_NAMES:
        raise ValueError("colorize mode must be off or one of: sepia, blue, warm, cool")
    factors = TINTS[TINT_NAMES[name]]
    tinted = np.stack([clamped(np.arange(256) / 255.0 * f * 255.0) for f in factors], axis=1)

    def change(samples: np.ndarray, _: pa.RecordBatch) -> np.ndarray:
        # Gray pages are replicated first, so their luma is that of (v, v, v).
        return tinted[luma_of(np.repeat(samples, 3, axis=2) if samples.shape[2] == 1 else samples)]

    return map_lines(strips, change, bpp_out=3)


# --- page statistics ------------------------------------------------------


def _row_counts(rows: DataFrame) -> DataFrame:
    """page_id, c, v, n: how often each value occurs per page and channel, summed per Arrow batch only.

    ``rows`` has page_id, first, step and row: sample i is channel ``first + i % step``.
    A batch leaves at most 256 rows per page and channel, so samples never become rows.
    """
    kind = rows.schema["page_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch["row"]
            size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            start = np.cumsum(size) - size
            step, first = (np.repeat(batch[c].to_numpy(), size) for c in ("step", "first"))
            channel = first + (np.arange(len(value)) - np.repeat(start, size)) % np.maximum(step, 1)
            pages = batch["page_id"].dictionary_encode()
            page = np.repeat(pages.indices.to_numpy(zero_copy_only=False), size)
            key, n = np.unique((page * 8 + channel) * 256 + value, return_counts=True)
            yield pa.RecordBatch.from_pydict(
                {
                    "page_id": pages.dictionary.take(pa.array(key // 2048)),
                    "c": pa.array(key // 256 % 8, pa.int32()),
                    "v": pa.array(key % 256, pa.int32()),
                    "n": pa.array(n, pa.int64()),
                }
            )

    return rows.select("page_id", "first", "step", "row").mapInArrow(count, f"page_id {kind}, c int, v int, n bigint")


def sample_counts(strips: DataFrame, pooled: bool = False) -> DataFrame:
    """Counts per page, channel and value; alpha is not a colour value.

    At most 256 rows per page and channel, counted per batch first, so every
    later window over a histogram is small whatever the page size.
    """
    found = _row_counts(strips.select("page_id", F.lit(0).alias("first"), F.col("bpp").alias("step"), "row")).where("c < 3")
    keys = ["page_id", "v"] if pooled else ["page_id", "c", "v"]
    return found.groupBy(*keys).agg(F.sum("n").alias("n"))


def page_histogram(strips: DataFrame) -> DataFrame:
    """page_id, channel (gray | r g b luma), pixels, bins ARRAY<BIGINT>[256]."""
    # Channels stay small integers until the counts are in: 0 1 2 are r g b,
    # 3 is alpha (left out), 4 is luma and 5 gray.
    luma_part = strips.where("bpp > 1").select(
        "page_id", F.lit(4).alias("first"), F.lit(1).alias("step"), luma_row(F.col("row"), F.col("bpp")).alias("row")
    )
    plain = strips.select("page_id", F.when(F.col("bpp") == 1, 5).otherwise(0).alias("first"), F.col("bpp").alias("step"), "row")
    names = F.array(*[F.lit(n) for n in ("r", "g", "b", "a", "luma", "gray")])
    counts = (
        _row_counts(plain.unionByName(luma_part))
        .where("c <> 3")
        .groupBy("page_id", "c", "v")
        .agg(F.sum("n").alias("n"))
        .select("page_id", names[F.col("c")].alias("channel"), "v", "n")
    )
    sums = counts.groupBy("page_id", "channel").agg(
        F.sum("n").alias("pixels"),
        F.map_from_entries(F.collect_list(F.struct("v", "n"))).alias("_bins"),
    )
    return sums.select(
        "page_id",
        "channel",
        "pixels",
        let(
            F.col("_bins"),
            lambda m: F.transform(F.sequence(F.lit(0), F.lit(255)), lambda v: F.coalesce(m[v], F.lit(0).cast("bigint"))),
        ).alias("bins"),
    )


def channel_means(strips: DataFrame) -> DataFrame:
    """page_id, bpp, mean_0..mean_2 (null where the channel is absent).

    Line sums are taken inside the strip; only one small row per strip is
    aggregated, with a map-side combine.
    """

    def line_sum(channel: int) -> Column:
        picked = F.filter(F.col("row"), lambda v, i: i % F.col("bpp") == channel)
        return F.when(
            F.col("bpp") > channel,
            F.aggregate(picked, F.lit(0).cast("bigint"), lambda acc, v: acc + v),
        )

    lines = strips.select(
        "page_id", "width", "height", "bpp", *[line_sum(c).alias(f"s{c}") for c in range(3)]
    )
    pixels = F.greatest(F.lit(1), F.first("width").cast("bigint") * F.first("height")).cast("double")
    return lines.groupBy("page_id", "bpp").agg(
        *[(F.sum(f"s{c}").cast("double") / pixels).alias(f"mean_{c}") for c in range(3)]
    )


def exposure_gains(strips: DataFrame) -> DataFrame:
    means = channel_means(strips)

    def gain(column: str) -> Column:
        return F.lit(128.0) / F.greatest(F.col(column), F.lit(1.0))

    gray = F.col("bpp") == 1
    return means.select(
        "page_id",
        gain("mean_0").alias("gain_r"),
        F.when(gray, gain("mean_0")).otherwise(gain("mean_1")).alias("gain_g"),
        F.when(gray, gain("mean_0")).otherwise(gain("mean_2")).alias("gain_b"),
        F.when(gray, "gray-mean").otherwise("rgb-mean").alias("method"),
    )


def white_balance(strips: DataFrame) -> DataFrame:
    """Gray-world gains per page; a dead channel leaves the page alone."""
    means = channel_means(strips.where("bpp = 3"))
    mean = (F.col("mean_0") + F.col("mean_1") + F.col("mean_2")) / 3.0
    alive = F.least("mean_0", "mean_1", "mean_2") >= 1e-6
    gains = means.select(
        "page_id", *[F.when(alive, mean / F.col(f"mean_{c}")).otherwise(1.0).alias(f"_g{c}") for c in range(3)]
    )
    joined = join_page_stats(strips, gains, "left")
    balanced = rgb_pixels(
        F.col("row"),
        F.col("bpp"),
        F.col("width"),
        lambda r, g, b: [clamp_byte(v * F.col(f"_g{c}")) for c, v in enumerate((r, g, b))],
    )
    row = F.when(F.col("bpp") == 1, F.col("row")).otherwise(balanced)
    return joined.withColumn("row", refuse_alpha("white_balance", row)).drop("_g0", "_g1", "_g2")


def _with_clipped_ends(counts: DataFrame, keys: list[str], clip: Column) -> DataFrame:
    """Add ``low``/``high``: first value from each end whose running count
    exceeds ``clip``.  The windows run over at most 256 rows per key.
    """
    up = Window.partitionBy(*keys).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*keys).orderBy(F.desc("v")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    running = (
        counts.withColumn("_total", F.sum("n").over(whole))
        .withColumn("_up", F.sum("n").over(up))
        .withColumn("_down", F.sum("n").over(down))
        .withColumn("_clip", clip)
    )
    return (
        running.withColumn("low", F.min(F.when(F.col("_up") > F.col("_clip"), F.col("v"))).over(whole))
        .withColumn("high", F.max(F.when(F.col("_down") > F.col("_clip"), F.col("v"))).over(whole))
        .drop("_total", "_up", "_down", "_clip")
    )


def auto_level_points(strips: DataFrame, clip_percent: float = 0.5) -> DataFrame:
    """page_id, black, white from the pooled histogram of all colour samples."""
    share = max(0.0, min(20.0, clip_percent)) / 100.0
    ends = _with_clipped_ends(sample_counts(strips, pooled=True), ["page_id"], F.lit(share) * F.col("_total"))
    return ends.groupBy("page_id").agg(
        F.coalesce(F.first("low"), F.lit(0)).alias("black"),
        F.coalesce(F.first("high"), F.lit(255)).alias("white"),
    )


def auto_levels(strips: DataFrame, clip_percent: float = 0.5) -> DataFrame:
    """Stretch between the page's own points.

    The points become one 256-entry table per page before the join, so a sample
    costs one look-up.
    """
    black, white = F.col("black"), F.col("white")
    span = F.greatest(white - black, F.lit(1))
    table = F.transform(
        F.sequence(F.lit(0), F.lit(255)), lambda v: clamp_byte(clamp((v - black) / span, 0.0, 1.0) * 255.0)
    )
    kept = (white <= black) | ((black == 0) & (white == 255))
    tables = auto_level_points(strips, clip_percent).select("page_id", F.when(~kept, table).alias("_table"))
    joined = join_page_stats(strips, tables, "left")
    mapped = colour_samples(F.col("row"), F.col("bpp"), lambda v: F.col("_table")[v])
    return joined.withColumn("row", F.when(F.col("_table").isNull(), F.col("row")).otherwise(mapped)).drop("_table")


def fading_points(strips: DataFrame) -> DataFrame:
    """Per page and channel: low, high of the stretch, and its gray-world gain.

    The mean after the stretch follows from the histogram alone, so the pixels
    are scanned once, not twice.
    """
    counts = sample_counts(strips.where("bpp >= 3"))
    clip = F.greatest(F.floor(F.col("_total").cast("double") * 0.005), F.lit(1))
    low, high = F.coalesce("low", F.lit(0)), F.coalesce("high", F.lit(255))
    ends = _with_clipped_ends(counts, ["page_id", "c"], clip).select(
        "page_id",
        "c",
        "v",
        "n",
        low.alias("low"),
        F.when(high <= low, F.least(low + 1, F.lit(255))).otherwise(high).alias("high"),
    )
    stretched = ends.withColumn("s", stretch(F.col("v"), F.col("low"), F.col("high")))
    means = stretched.groupBy("page_id", "c").agg(
        F.first("low").alias("low"),
        F.first("high").alias("high"),
        (F.sum(F.col("s").cast("bigint") * F.col("n")).cast("double") / F.sum("n")).alias("mean"),
    )
    wide = means.groupBy("page_id").agg(
        *[F.max(F.when(F.col("c") == c, F.col(name))).alias(f"_{name}{c}") for c in range(3) for name in ("low", "high", "mean")]
    )
    mean = (F.col("_mean0") + F.col("_mean1") + F.col("_mean2")) / 3.0
    alive = F.least("_mean0", "_mean1", "_mean2") >= 1e-6
    return wide.select(
        "page_id",
        *[F.col(f"_{name}{c}") for c in range(3) for name in ("low", "high")],
        *[
            F.when(alive, (mean / F.col(f"_mean{c}") - 1.0) * 0.85 + 1.0).otherwise(1.0).alias(f"_gain{c}")
            for c in range(3)
        ],
    )


def stretch(v: Column, low: Column, high: Column) -> Column:
    """Linear stretch of one channel; a single-value white channel becomes 0."""
    part = F.coalesce(F.try_divide((v - low).cast("double"), (high - low).cast("double")), F.lit(-1.0))
    return clamp_byte(clamp(part, 0.0, 1.0) * 255.0)


def restore_fading(strips: DataFrame) -> DataFrame:
    """Per-channel stretch and soft gray-world gain, as one table per page and channel.

    The counts of a page are one row per batch, not one per value, and lines meet the tables as deflated stretches.
    """
    from . import tables  # its chains end in maps of this module

    def colour(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater_equal(batch["bpp"], 3))

    given = tables.page_tables(map_batches(strips, colour, strips.schema), [tables.restore_fading])
    return tables.apply_page_tables(strips, given, gray=False)
