"""Pages as a stream: picked up once complete, numbered, measured."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.raster import to_strips
from ..operators.tone import sample_counts
from ..sources.files import page_number

BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def read_page_stream(spark: SparkSession, folder: str, extension: str = "png", max_files: int | None = None) -> DataFrame:
    """Complete ``page_<digits>`` files as they appear; the query checkpoint
    makes each file arrive exactly once.  Unfinished ``.part`` files never match."""
    reader = (
        spark.readStream.format("binaryFile")
        .schema(BINARY_FILE_SCHEMA)
        .option("pathGlobFilter", f"page_*.{extension}")
        .option("recursiveFileLookup", "true")
    )
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    pages = reader.load(folder).withColumn("number", page_number(F.col("path"), extension))
    return pages.where("number is not null")


def run_page_stream(
    pages: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, limit: int | None = None
):
    """Hand each trigger's pages to ``handle`` in page order.

    More pages than ``limit`` over the life of the query is an error, raised
    before the trigger that exceeds it is handled.
    """

    def each(batch: DataFrame, batch_id: int) -> None:
        if limit is not None:
            beyond = batch.agg(F.max("number")).first()[0]
            if beyond is not None and beyond > limit:
                raise ValueError(f"page {beyond} came, which is beyond the requested limit of {limit}")
        handle(batch.orderBy("number"), batch_id)

    return (
        pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    )


def write_page_stats(pages: DataFrame, target: str, checkpoint: str):
    """Statistics of streamed pages (page_id, width, height, fmt, content):
    channel means and the number of distinct sample values, one folder per
    trigger so a replay leaves one copy."""

    def each(batch: DataFrame, batch_id: int) -> None:
        # Means, levels and sizes all follow from the counts, so the samples are unpacked once.
        counts = sample_counts(to_strips(batch)).groupBy("page_id", "v").agg(
            *[F.sum(F.when(F.col("c") == c, F.col("n"))).alias(f"n{c}") for c in range(3)], F.sum("n").alias("n")
        )
        counts.groupBy("page_id").agg(
            *[F.try_divide(F.sum(F.col("v") * F.col(f"n{c}")).cast("double"), F.sum(f"n{c}")).alias(f"mean_{c}") for c in range(3)],
            F.count(F.lit(1)).alias("levels"),
            F.sum("n").alias("samples"),
        ).write.mode("overwrite").parquet(f"{target}/trigger={batch_id}")

    return (
        pages.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).trigger(availableNow=True).start()
    )
