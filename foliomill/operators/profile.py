"""Scanner colour profiles: chart reading, fitting, validation, application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import IT8_BASES, IT8_COLUMNS, IT8_ROWS, IT8_SCALES
from ..functions.columns import clamp, clamp_byte, int_div, to_int
from ..functions.scale import lookup_join
from .raster import STRIP_COLUMNS, refuse_alpha
from .tone import rgb_pixels

PROFILE_SCHEMA = "struct<format:string,version:bigint,kind:string,matrix:array<array<variant>>,gamma:array<variant>>"
PROFILE_KIND = "scanner_it8"
MAX_GAIN = 16.0


def it8_reference(spark: SparkSession) -> DataFrame:
    """patch, ref_r, ref_g, ref_b: base colours by scale, then the gray ramp."""
    rows = [(base[0] * s, base[1] * s, base[2] * s) for s in IT8_SCALES for base in IT8_BASES]
    rows += [(i / (IT8_COLUMNS - 1.0),) * 3 for i in range(IT8_COLUMNS)]
    return spark.createDataFrame(
        [(n, *row) for n, row in enumerate(rows)], "patch int, ref_r double, ref_g double, ref_b double"
    )


def _centre(index: Column, size: Column, limit: Column) -> tuple[Column, Column]:
    start = index * size + to_int(int_div(size, 4))
    stop = F.least(F.greatest(index * size + to_int(int_div(size * 3, 4)), start + 1), limit)
    return start, stop


def it8_patch_means(strips: DataFrame) -> DataFrame:
    """page_id, patch, mean_r, mean_g, mean_b (0..1) of the 30 cell centres, error.

    Only three-channel pages are charts; any other page is one row with an error.
    """
    other = strips.where("y = 0 AND bpp <> 3").select("page_id", F.lit("not a three-channel page").alias("error"))
    means = _chart_means(strips).withColumn("error", F.lit(None).cast("string"))
    return means.unionByName(other, allowMissingColumns=True)


def _chart_means(strips: DataFrame) -> DataFrame:
    """The means of the pages that are charts.

    Line sums are built inside the strip; a cell that lies outside a small page
    reads as zero.
    """
    rgb = strips.where("bpp = 3")
    cell_w = F.greatest(to_int(int_div(F.col("width"), IT8_COLUMNS)), F.lit(1))
    cell_h = F.greatest(to_int(int_div(F.col("height"), IT8_ROWS)), F.lit(1))
    line = to_int(int_div(F.col("y"), cell_h))
    top, bottom = _centre(line, cell_h, F.col("height"))
    hit = rgb.where((line < IT8_ROWS) & (F.col("y") >= top) & (F.col("y") < bottom))

    def cell(col: Column) -> Column:
        left, right = _centre(col, cell_w, F.col("width"))
        part = F.slice("row", left * 3 + 1, F.greatest(right - left, F.lit(0)) * 3)

        def total(channel: int) -> Column:
            return F.aggregate(
                F.filter(part, lambda v, i: i % 3 == channel), F.lit(0).cast("bigint"), lambda acc, v: acc + v
            )

        inside = right > left
        return F.struct(
            (line * IT8_COLUMNS + col).alias("patch"),
            F.when(inside, right - left).otherwise(0).alias("n"),
            *[F.when(inside, total(c)).otherwise(F.lit(0).cast("bigint")).alias(f"s{c}") for c in range(3)],
        )

    cells = hit.select("page_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(IT8_COLUMNS - 1)), cell)).alias("p"))
    sums = cells.groupBy("page_id", F.col("p.patch").alias("patch")).agg(
        F.sum("p.n").alias("n"), *[F.sum(f"p.s{c}").alias(f"s{c}") for c in range(3)]
    )
    every = rgb.where("y = 0").select(
        "page_id", F.explode(F.sequence(F.lit(0), F.lit(IT8_COLUMNS * IT8_ROWS - 1))).alias("patch")
    )
    scale = F.when(F.coalesce("n", F.lit(0)) > 0, F.lit(1.0) / (F.col("n") * F.lit(255.0))).otherwise(0.0)
    return every.join(sums, ["page_id", "patch"], "left").select(
        "page_id",
        "patch",
        *[(F.coalesce(f"s{c}", F.lit(0)) * scale).alias(f"mean_{n}") for c, n in enumerate("rgb")],
    )


def it8_profile(strips: DataFrame) -> DataFrame:
    """page_id, gain_r, gain_g, gain_b, error: one gain per channel and chart.

    A page that is not a chart, because it has not three channels, is a row with an error.
    """
    ref = it8_reference(strips.sparkSession)
    sums = (
        lookup_join(_chart_means(strips), ref, ["patch"], how="inner")
        .groupBy("page_id")
        .agg(*[F.sum(f"{side}_{n}").alias(f"{side}_{n}") for side in ("mean", "ref") for n in "rgb"])
    )

    def gain(n: str) -> Column:
        value = F.try_divide(F.col(f"ref_{n}"), F.col(f"mean_{n}"))
        bad = (F.col(f"mean_{n}") <= 1e-9) | value.isNull() | (value > MAX_GAIN)
        return F.when(~bad, value)

    gains = sums.select("page_id", *[gain(n).alias(f"gain_{n}") for n in "rgb"])
    dead = F.col("gain_r").isNull() | F.col("gain_g").isNull() | F.col("gain_b").isNull()
    fitted = gains.withColumn("error", F.when(dead, "capture too dark or a channel is dead"))
    other = strips.where("y = 0 AND bpp <> 3").select("page_id", F.lit("not a three-channel page").alias("error"))
    return fitted.unionByName(other, allowMissingColumns=True)


def _number(v: Column) -> Column:
    """A JSON number as double; text and other kinds are null."""
    numeric = F.schema_of_variant(v).rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    return F.when(numeric, F.try_variant_get(v, "$", "double"))


def profile_error(p: Column, expected_format: str) -> Column:
    """First violated rule of a parsed profile, null when valid."""
    sure = lambda test: F.coalesce(test, F.lit(False))
    within = lambda v: sure(F.abs(_number(v)) <= 16.0)
    return (
        F.when(~sure(p["format"] == expected_format), "unsupported format")
        .when(~sure(p["version"] == 1), "unsupported version")
        .when(~sure(p["kind"] == PROFILE_KIND), "unsupported kind")
        .when(
            ~sure((F.size(p["matrix"]) == 3) & F.forall(p["matrix"], lambda r: sure(F.size(r) == 3))), "matrix must be 3x3"
        )
        .when(~F.forall(p["matrix"], lambda r: F.forall(r, within)), "matrix entry not a number within 16")
        .when(~sure(F.size(p["gamma"]) == 3), "gamma must contain three values")
        .when(~F.forall(p["gamma"], lambda v: sure(_number(v).between(0.05, 8.0))), "gamma entry not within 0.05..8")
    )


def read_profiles(df: DataFrame, column: str = "profile_json", expected_format: str = "scanner-profile") -> DataFrame:
    """Parse and validate profile JSON text; ``error`` is null for good ones,
    which then carry ``matrix`` and ``gamma``."""
    parsed = df.withColumn("_p", F.from_json(F.col(column), PROFILE_SCHEMA))
    checked = parsed.withColumn("error", profile_error(F.col("_p"), expected_format))
    good = F.col("error").isNull()
    return (
        checked.withColumn("matrix", F.when(good, F.transform("_p.matrix", lambda r: F.transform(r, _number))))
        .withColumn("gamma", F.when(good, F.transform("_p.gamma", _number)))
        .drop("_p")
    )


def apply_profile(strips: DataFrame, profiles: DataFrame, key: str = "profile_id") -> DataFrame:
    """3x3 matrix, clamp, inverse gamma.  ``profiles``: key, matrix, gamma."""
    one = profiles.select(key, F.col("matrix").alias("_m"), F.col("gamma").alias("_g"))
    joined = lookup_join(strips, one, [key], F.xxhash64("page_id", "y"))

    def mixed(n: int, parts: list[Column]) -> Column:
        m, inverse = F.col("_m")[n], F.lit(1.0) / F.col("_g")[n]
        linear = clamp(m[0] * parts[0] + m[1] * parts[1] + m[2] * parts[2], 0.0, 1.0)
        return clamp_byte(F.when(inverse == 1.0, linear).otherwise(F.pow(linear, inverse)) * 255.0)

    def pixel(r: Column, g: Column, b: Column) -> list[Column]:
        parts = [v / F.lit(255.0) for v in (r, g, b)]
        return [mixed(n, parts) for n in range(3)]

    colour = rgb_pixels(F.col("row"), F.col("bpp"), F.col("width"), pixel)
    plain = (F.col("bpp") == 1) | F.col("_m").isNull()
    row = F.when(plain, F.col("row")).otherwise(refuse_alpha("apply_profile", colour))
    return joined.withColumn("row", row).select(STRIP_COLUMNS)
