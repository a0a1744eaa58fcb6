"""File sources and sinks: page containers, numbered pages, lists, profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import CONTAINER_PREFIXES, WEBP_RIFF_HEX, WEBP_TAG_HEX
from ..functions.columns import let
from ..operators.catalogs import device_list
from ..operators.profile import read_profiles
from ..operators.raster import over_white, pack_bytes, strips_to_pages, to_strips


# --- containers -----------------------------------------------------------


def container_of(content: Column) -> Column:
    """Container name from the first twelve bytes, null when unknown."""
    head = F.substring(content, 1, 12)
    starts = lambda text: F.startswith(head, F.unhex(F.lit(text)))
    webp = starts(WEBP_RIFF_HEX) & (F.substring(content, 9, 4) == F.unhex(F.lit(WEBP_TAG_HEX)))
    chain = F.when(webp, "webp")
    for prefix, name in CONTAINER_PREFIXES:
        chain = chain.when(starts(prefix), name)
    return chain


def page_sniff(files: DataFrame, column: str = "content") -> DataFrame:
    return files.withColumn("container", container_of(F.col(column)))


def read_page_files(spark: SparkSession, folder: str, extension: str = "png") -> DataFrame:
    """Page files of a folder as path, length, content; other names and
    unfinished ``.part`` files are never opened."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", f"page_*.{extension}")
        .option("recursiveFileLookup", "true")
        .load(folder)
    )


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """Decoded pages through the built-in image source: path, page columns.

    The source delivers BGR(A); channels are reordered, transparent pages are
    composited on white, gray stays gray.  Decoding runs on the executors.
    """
    raw = spark.read.format("image").option("dropInvalid", "false").load(folder).select(
        F.col("image.origin").alias("path"),
        F.col("image.width").alias("width"),
        F.col("image.height").alias("height"),
        F.col("image.nChannels").alias("channels"),
        F.col("image.data").alias("content"),
    )
    fmt = F.when(F.col("channels") == 1, "Gray8").when(F.col("channels") == 3, "Rgb8").when(F.col("channels") == 4, "Rgba8")
    named = raw.select(F.xxhash64("path").alias("page_id"), "path", "width", "height", fmt.alias("fmt"), "content")
    return named


def image_errors(images: DataFrame) -> DataFrame:
    """page_id, path, reason of the images that could not be decoded, which have no strips."""
    return images.where("fmt is null").select("page_id", "path", F.lit("not a decodable image").alias("reason"))


def image_strips(images: DataFrame) -> DataFrame:
    """Strips of ``read_images`` rows with red first and alpha removed; the rest is in ``image_errors``."""
    strips = to_strips(images.where("fmt is not null").select("page_id", "width", "height", "fmt", "content"))
    bpp = F.col("bpp")
    swapped = let(
        F.col("row"),
        lambda r: F.transform(
            r, lambda v, i: F.when(i % bpp == 0, F.get(r, i + 2)).when(i % bpp == 2, F.get(r, i - 2)).otherwise(v)
        ),
    )
    return over_white(strips.withColumn("row", F.when(bpp == 1, F.col("row")).otherwise(swapped)))


# --- numbered pages -------------------------------------------------------


def page_number(path: Column, extension: str) -> Column:
    """Number of a complete ``page_<digits>.<ext>`` file, else null."""
    digits = F.regexp_extract(path, rf"(?:^|/)page_([0-9]+)\.{extension}\z", 1)
    return F.when(digits != "", digits.try_cast("bigint"))


def page_files(paths: DataFrame, extension: str = "png", column: str = "path") -> DataFrame:
    """Complete page files with ``number``; sort by it for page order (10 after 9)."""
    numbered = paths.withColumn("number", page_number(F.col(column), extension))
    return numbered.where(F.col("number").isNotNull() & (F.col("number") <= 4_294_967_295))


# --- sinks ----------------------------------------------------------------


def page_write(strips: DataFrame, path: str, overwrite: bool = False, partition_by: str | None = None) -> None:
    """Publish strips as Parquet with packed lines.

    The job committer makes the result visible at once; an existing destination
    is an error unless ``overwrite`` is given.
    """
    packed = strips.withColumn("row", pack_bytes(F.col("row")))
    writer = packed.write.mode("overwrite" if overwrite else "errorifexists")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    writer.parquet(path)


def page_write_with_raw(processed: DataFrame, raw: DataFrame, path: str, overwrite: bool = False) -> None:
    """Publish processed pages and, beside them, the pages before processing."""
    page_write(processed, f"{path}/pages", overwrite)
    page_write(raw, f"{path}/raw", overwrite)


def read_strips(spark: SparkSession, path: str) -> DataFrame:
    """Read what ``page_write`` published."""
    from ..operators.raster import STRIP_COLUMNS, unpack_bytes

    stored = spark.read.parquet(path)
    return stored.withColumn("row", unpack_bytes(F.col("row"))).select(*STRIP_COLUMNS)


def page_write_packed(strips: DataFrame, path: str, overwrite: bool = False) -> None:
    """Publish one row per page with packed content."""
    strips_to_pages(strips).write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


# --- text and JSON sources ------------------------------------------------


def read_device_lists(spark: SparkSession, path: str, id_prefix: str, display_prefix: str, kind: str) -> DataFrame:
    return device_list(spark.read.text(path), "value", id_prefix, display_prefix, kind)


def read_profile_files(spark: SparkSession, path: str, expected_format: str = "scanner-profile") -> DataFrame:
    """Colour-profile JSON files with ``profile`` and ``error``."""
    text = spark.read.text(path, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    return read_profiles(text.withColumnRenamed("value", "profile_json"), "profile_json", expected_format)


def read_translations(spark: SparkSession, folder: str) -> DataFrame:
    """One JSON object per language file to lang, key, text."""
    text = spark.read.text(folder, wholetext=True).withColumn("path", F.col("_metadata.file_path"))
    lang = F.regexp_extract("path", r"([^/]+)\.json\z", 1)
    return text.select(
        lang.alias("lang"), F.explode(F.from_json("value", "map<string,string>")).alias("key", "text")
    )
