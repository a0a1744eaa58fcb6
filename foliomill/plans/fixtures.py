"""Inputs the registered queries share, derived from the given tables.

Every rule here is written twice: as Spark columns, and (``*_SQL``) as the SQL
text the oracle uses.  Page rasters come from the whole UTF-8 text of a
document: one byte is one sample, the last line is padded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import spread_small_input
from ..operators.raster import to_strips

SHAPES = {"Gray8": (64, 1), "Rgb8": (32, 3), "Rgba8": (16, 4)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_pages(spark: SparkSession, sf_dir: str, fmt: str = "Rgb8") -> DataFrame:
    """page_id, width, height, fmt, content from whole document texts."""
    width, bpp = SHAPES[fmt]
    line = width * bpp
    docs = spread_small_input(table(spark, sf_dir, "documents").select("doc_id", "text"))
    packed = docs.select(F.col("doc_id").alias("page_id"), F.encode("text", "UTF-8").alias("_raw")).where(
        F.octet_length("_raw") > 0
    )
    height = F.ceil(F.octet_length("_raw") / F.lit(float(line))).cast("int")
    return packed.select(
        "page_id",
        F.lit(width).alias("width"),
        height.alias("height"),
        F.lit(fmt).alias("fmt"),
        F.rpad("_raw", height * line, F.lit(b"\xff")).alias("content"),
    )


_SPREAD = bytes((v * 37 + 28) % 256 for v in range(256))


def spread_samples(strips: DataFrame) -> DataFrame:
    """Spread text bytes over the whole 0..255 range."""
    return strips.withColumn("row", F.transform("row", lambda v: (v * 37 + 28) % 256))


def page_strips(spark: SparkSession, sf_dir: str, fmt: str = "Rgb8") -> DataFrame:
    """Strips of the texts, with their bytes spread over the whole 0..255 range."""
    return to_strips(text_pages(spark, sf_dir, fmt), _SPREAD)


def px_sql(fmt: str = "Rgb8", spread: bool = True) -> str:
    """CTEs ending in ``px(page_id, width, height, y, x, c, v)``."""
    width, bpp = SHAPES[fmt]
    line = width * bpp
    value = "(b * 37 + 28) % 256" if spread else "b"
    return f"""
WITH raw AS (SELECT doc_id AS page_id, hex(encode(text)) AS hx, octet_length(encode(text)) AS n FROM documents),
sized AS (SELECT page_id, hx, n, CAST(ceil(n / {line}.0) AS INT) AS h FROM raw WHERE n > 0),
samples AS (
  SELECT page_id, h,
         unnest(list_concat(list_transform(regexp_extract_all(hx, '..'), lambda s: CAST(('0x' || s) AS INT)),
                            list_resize(CAST([] AS INT[]), h * {line} - n, 255))) AS b,
         unnest(range(0, h * {line})) AS i
  FROM sized),
px AS (
  SELECT page_id, {width} AS width, h AS height, CAST(i // {line} AS INT) AS y,
         CAST((i % {line}) // {bpp} AS INT) AS x, CAST(i % {bpp} AS INT) AS c, {value} AS v
  FROM samples)"""


def rgb_sql(src: str = "px", name: str = "rgb") -> str:
    """CTE ``name`` with one row per pixel and columns r, g, b (and a)."""
    return f"""
{name} AS (SELECT page_id, width, height, y, x,
   max(v) FILTER (WHERE c = 0) AS r, max(v) FILTER (WHERE c = 1) AS g,
   max(v) FILTER (WHERE c = 2) AS b, max(v) FILTER (WHERE c = 3) AS a
   FROM {src} GROUP BY page_id, width, height, y, x)"""


def unrgb_sql(src: str, r: str, g: str, b: str, name: str = "out") -> str:
    """CTE turning per-pixel expressions back into samples."""
    return f"""
{name}_p AS (SELECT page_id, width, height, y, x, [{r}, {g}, {b}] AS vs FROM {src}),
{name} AS (SELECT page_id, width, height, y, x, unnest([0, 1, 2]) AS c, unnest(vs) AS v FROM {name}_p)"""


LUMA_SQL = "((77 * r + 150 * g + 29 * b) >> 8)"


def byte_sql(expr: str) -> str:
    return f"CAST(least(greatest(round({expr}), 0), 255) AS INT)"


def checksum_sql(bpp: int, src: str = "out") -> str:
    at = f"(CAST(y AS BIGINT) * width * {bpp} + x * {bpp} + c)"
    return f"""
SELECT page_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, CAST({bpp} AS INT) AS bpp,
       count(*) AS samples, CAST(sum(v) AS BIGINT) AS sum_v,
       CAST(sum(v * ({at} + 1)) AS BIGINT) AS sum_at,
       CAST(sum(v * v * ({at} % 97 + 1)) AS BIGINT) AS sum_mix
FROM {src} GROUP BY page_id, width, height"""
