"""Film conversion and column calibration."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import film_profiles
from ..functions.columns import clamp, clamp_byte, int_div, let, to_int
from ..functions.lines import luma_of, map_lines, packed
from ..functions.scale import lookup_join
from .raster import STRIP_COLUMNS

FILM_SCHEMA = (
    "ordinal int, film_id string, name string, kind string, manufacturer string, note string, "
    "mask_r double, mask_g double, mask_b double, contrast double, gamma double"
)


def film_catalog(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(film_profiles(), FILM_SCHEMA)


def film_lookup(df: DataFrame, catalog: DataFrame, column: str = "film_id") -> DataFrame:
    """Attach the profile; an unknown id gets ``error``.

    A catalog of a counted, small size is broadcast; a larger one is joined by key.
    """
    found = lookup_join(df, catalog.withColumnRenamed("film_id", column), [column])
    return found.withColumn(
        "error", F.when(F.col("kind").isNull(), F.concat(F.lit("film profile not found: "), F.col(column)))
    )


def film_tables(catalog: DataFrame) -> DataFrame:
    """film_id, bw, gray table, and one table per colour channel.

    Inversion, mask removal and the tone curve are each per-sample, so they
    fold into one table per channel, built once per profile, not per page.
    """
    negative = F.col("kind").contains("negative")
    mean = (F.col("mask_r") + F.col("mask_g") + F.col("mask_b")) / 3.0
    gamma = F.when(F.col("gamma") <= 0, F.lit(1.0)).otherwise(F.col("gamma"))

    def tone(v: Column) -> Column:
        part = clamp((v / F.lit(255.0) - 0.5) * F.col("contrast") + 0.5, 0.0, 1.0)
        return clamp_byte(F.pow(part, F.lit(1.0) / gamma) * 255.0)

    def turned(v: Column) -> Column:
        return F.when(negative, F.lit(255) - v).otherwise(v)

    def unmasked(v: Column, mask: str) -> Column:
        gain = F.when(F.col(mask) > 1e-6, mean / F.col(mask)).otherwise(1.0)
        return F.when(F.col(mask).isNull(), v).otherwise(clamp_byte(v * gain))

    grid = F.sequence(F.lit(0), F.lit(255))

    def channel(mask: str) -> Column:
        return F.transform(grid, lambda v: tone(unmasked(turned(v), mask))).alias(f"_{mask}")

    return catalog.select(
        "film_id",
        F.col("kind").startswith("bw").alias("_bw"),
        F.transform(grid, lambda v: tone(turned(v))).alias("_gray"),
        *[channel(m) for m in ("mask_r", "mask_g", "mask_b")],
    )


def film_convert(strips: DataFrame, catalog: DataFrame, film_column: str = "film_id") -> DataFrame:
    """Convert strips that carry a film id; unknown ids raise (look them up with
    ``film_lookup`` first to quarantine)."""
    found = film_tables(catalog).withColumnRenamed("film_id", film_column)
    whole = found.select(film_column, "_bw", F.concat("_gray", "_mask_r", "_mask_g", "_mask_b").alias("_tables"))
    tables = packed(whole, "_tables", "_tables")
    joined = lookup_join(strips, tables, [film_column], F.xxhash64("page_id", "y"))

    def change(samples: np.ndarray, rows: pa.RecordBatch) -> np.ndarray:
        found = rows["_tables"]
        if found.null_count:
            missing = rows[film_column].filter(found.is_null())[0].as_py()
            raise ValueError(f"film profile not found: {'null' if missing is None else missing}")
        tables = np.frombuffer(b"".join(found.to_pylist()), np.uint8).reshape(len(samples), 1024)
        line = np.arange(len(samples))[:, None, None]
        if samples.shape[2] == 1:
            return tables[line, samples]
        out = samples.copy()
        out[..., :3] = tables[line, samples[..., :3] + np.arange(1, 4) * 256]
        mono = np.flatnonzero(rows["_bw"].to_numpy(zero_copy_only=False))
        out[mono, :, :3] = luma_of(out[mono])[..., None]
        return out

    return map_lines(joined, change, drop=("_tables", "_bw")).select(STRIP_COLUMNS)


def flat_dark_cal(strips: DataFrame, dark: Sequence[int], flat: Sequence[float]) -> DataFrame:
    """Column-wise dark subtract and flat-field multiply; alpha is untouched."""
    if not flat:
        return strips
    n = len(flat)
    dark = [int(dark[i]) if i < len(dark) else 0 for i in range(n)]
    darks, flats = F.array(*[F.lit(d) for d in dark]), F.array(*[F.lit(float(f)) for f in flat])
    bpp, width = F.col("bpp"), F.col("width")

    def corrected(v: Column, i: Column) -> Column:
        x = to_int(int_div(i, bpp))
        at = F.when(width > 1, to_int(int_div(x * (n - 1), F.greatest(width - 1, F.lit(1))))).otherwise(0)
        fixed = let(
            at, lambda k: clamp_byte(F.greatest(v - darks[k], F.lit(0)) * flats[k] + darks[k] * F.lit(0.25))
        )
        return F.when((bpp == 4) & (i % 4 == 3), v).otherwise(fixed)

    return strips.withColumn("row", F.transform("row", corrected))
