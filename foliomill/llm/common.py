"""Shared pieces of the document operators: tables, folds, written intermediates."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scale import fresh_shared_path

BATCH_BYTES = 4 << 20
_BATCH_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(key: str | Column, folds: int, fold: int) -> Column:
    """Whether a row's key falls in the fold that learning must not see; a null key is not held out."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write a step into the shared folder and read it back; Spark removes the files at its end.

    The step is then computed once, and a lost executor costs a read, not the step.
    """
    spark = df.sparkSession
    path = fresh_shared_path(spark, name)
    df.write.parquet(path)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def write_buckets(df: DataFrame, name: str, key: str, buckets: int) -> DataFrame:
    """``write_table`` in buckets by a key: joins on it with rows in as many hash partitions leave the table in place.

    Only tables of the catalog have buckets, so it is one until it is read; its files stay.
    """
    spark = df.sparkSession
    path, known_as = fresh_shared_path(spark, name), f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(known_as)
    files, where = _files(spark, path)
    files.deleteOnExit(where)
    out = spark.table(known_as)
    spark.sql(f"DROP TABLE {known_as}")
    return out


def remove_table(df: DataFrame) -> None:
    """Remove the files of a written step at once, when all that is made of it is written too."""
    for path in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        files, where = _files(df.sparkSession, path)
        files.delete(where, True)


def _files(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def release(spark: SparkSession) -> None:
    """Let go of the broadcasts and shuffle files of steps that are done.

    Spark frees them, on executors too, when the driver's garbage collector finds that nobody
    holds them; between many small steps it may not run for long.
    """
    spark._jvm.System.gc()


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow`` with batches of about BATCH_BYTES, however long the texts are.

    Spark's own limits are 10,000 rows and hundreds of megabytes, which JVM and Python
    would each hold more than once.  A smaller limit that the session has set is kept.
    """
    spark = df.sparkSession
    said = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(_BATCH_LIMIT, str(1 << 30)))
    if not 0 < said <= BATCH_BYTES:
        spark.conf.set(_BATCH_LIMIT, str(BATCH_BYTES))
    return df.mapInArrow(function, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | dict], schema: str) -> DataFrame:
    """Apply a function of one Arrow batch to every batch; it may return columns by name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = function(batch)
                yield pa.RecordBatch.from_pydict(out) if isinstance(out, dict) else out

    return map_arrow(df, run, schema)
