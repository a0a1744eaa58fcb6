"""Helpers that keep one heavy key from landing in one task."""

from __future__ import annotations

import gc
import os
import tempfile
import time
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from .columns import int_div
from .lines import packed, unpacked

PAGE_BAND = 64
DEFAULT_SALTS = 8
ORDER_BLOCK = 4096


def spread_small_input(df: DataFrame) -> DataFrame:
    """Redistribute a source that arrives in fewer partitions than cores.

    One-row-group files give one task.  A large scan already has more splits
    than cores and passes through untouched, so no shuffle is added there.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < want:
        return df.repartition(want)
    return df


def join_page_stats(
    strips: DataFrame, stats: DataFrame, how: str = "inner", salts: int = DEFAULT_SALTS, reach: Column | None = None
) -> DataFrame:
    """Attach one stats row per page to every strip of that page.

    The strips of a page are split over ``salts`` join keys by row band, so the
    largest page does not become the slowest task; the one-row side is copied.
    That side grows with the pages, so it is never broadcast; Spark would judge its
    size before the copies and arrays are made.  Lines move as packed bytes.
    ``reach`` (of ``stats``) is at least the lines of the page: a page of few bands gets as few copies.
    """
    last = F.lit(salts - 1)
    if reach is not None:
        last = F.greatest(F.least(last, int_div(reach - 1, PAGE_BAND).cast("int")), F.lit(0))
    copies = stats.withColumn("_salt", F.explode(F.sequence(F.lit(0), last))).hint("merge")
    salted = strips.withColumn("_salt", (int_div(F.col("y"), PAGE_BAND) % salts).cast("int"))
    if "row" not in strips.columns:
        return salted.join(copies, ["page_id", "_salt"], how).drop("_salt")
    joined = packed(salted, "row", "row").join(copies, ["page_id", "_salt"], how).drop("_salt")
    return unpacked(joined, "row", "row").select(*strips.columns, *[c for c in stats.columns if c != "page_id"])


def salted_join(
    many: DataFrame,
    one: DataFrame,
    keys: Sequence[str],
    spread: Column,
    how: str = "inner",
    salts: int = 16,
) -> DataFrame:
    """Join many rows per key to one row per key without a hot partition.

    ``spread`` must be a deterministic column of the many side (an ordinal, a
    path hash), so a retried task puts every row back in the same place.
    The copies are never broadcast; Spark would judge their size before they are made.
    """
    copies = one.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).hint("merge")
    salted = many.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    return salted.join(copies, [*keys, "_salt"], how).drop("_salt")


def lookup_join(
    many: DataFrame, one: DataFrame, keys: Sequence[str], spread: Column | None = None, how: str = "left", most: int = 4096
) -> DataFrame:
    """Attach one row per key from a catalog.

    The catalog's rows are counted up to ``most`` first: only so small a catalog
    is broadcast, and then the many side is not moved at all.  A larger one is
    joined by key, with hot keys split by ``spread`` where it is given.
    """
    if len(one.limit(most + 1).select(*keys).collect()) <= most:
        return many.join(F.broadcast(one), list(keys), how)
    return many.join(one, list(keys), how) if spread is None else salted_join(many, one, keys, spread, how)


def _running(batches: Iterator[pa.RecordBatch], keys: Sequence[str], func: str, inclusive: bool) -> Iterator[pa.RecordBatch]:
    """Running value inside one sorted partition, carried from batch to batch; null before a key's first value."""
    import pandas as pd
    from pyspark import TaskContext

    block = TaskContext.get().partitionId()
    held: tuple | None = None  # key and running value of the row before
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        new = np.zeros(n, bool)
        for name in keys:
            code = batch[name].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            new[1:] |= code[1:] != code[:-1]
        first, last = (tuple(batch[name][i].as_py() for name in keys) for i in (0, n - 1))
        part = np.cumsum(new)
        value = pd.Series(batch["_value"].to_pandas(), dtype="Int64").groupby(part)
        whole = value.cumsum() if func == "sum" else value.cummax()
        # A null keeps the value before it.
        whole = whole.groupby(part).ffill()
        if held is not None and held[0] == first and held[1] is not None:
            here = part == 0
            whole[here] = whole[here].fillna(0) + held[1] if func == "sum" else whole[here].fillna(held[1]).clip(lower=held[1])
        before = whole.groupby(part).shift(1)
        if held is not None and held[0] == first and held[1] is not None:
            before.iloc[0] = held[1]
        held = (last, None if pd.isna(whole.iloc[-1]) else int(whole.iloc[-1]))
        out = whole if inclusive else before
        yield batch.append_column("_local", pa.array(out, pa.int64())).append_column("_block", pa.array(np.full(n, block), pa.int32()))


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    ties: Sequence[str] = (),
    value: Column | None = None,
    out: str = "running",
    func: str = "sum",
    inclusive: bool = True,
) -> DataFrame:
    """Running sum, count or max per key in the order of a column, ties by further columns.

    A plain window would put a whole key into one task.  Here the rows are dealt
    by ranges of key, order and ties, so a task gets its share of rows however sparse or equal
    the orders are and however large a key is, and runs over them once.  Only the first
    key of a task can have begun before it: the totals per task and key give each
    task at most one starting value, one row per task, which is broadcast.
    ``value`` defaults to 1, so the plain call yields ``row_number``.  Rows that agree
    in key, order and ties stay together.
    """
    value = F.lit(1) if value is None else value
    valued = df.withColumn("_value", value.cast("bigint"))
    along = [*keys, order, *ties]
    dealt = valued.repartitionByRange(*along).sortWithinPartitions(*along)
    schema = StructType([*dealt.schema.fields, StructField("_local", LongType()), StructField("_block", IntegerType())])
    local = cut_lineage(dealt.mapInArrow(lambda batches: _running(batches, keys, func, inclusive), schema))
    agg = {"sum": F.sum, "max": F.max}[func]
    totals = local.groupBy(*keys, "_block").agg(agg("_value").alias("_total"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("_block").alias("_at"), agg("_total").over(before).alias("_start"))
    same = F.col("_block") == F.col("_at")
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    joined = local.join(F.broadcast(starts.where("_start is not null")), same, "left")
    if func == "sum":
        total = F.coalesce(F.col("_start"), F.lit(0)) + F.coalesce(F.col("_local"), F.lit(0))
    else:
        total = F.greatest(F.col("_start"), F.col("_local"))
    return joined.withColumn(out, total).select(*df.columns, out)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a session on one machine (tests) may name none: a folder is made and
    set as the checkpoint directory.  On a cluster that is an error, because
    other machines could not read it.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(named)
        return named
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="foliomill-")
    sc.setCheckpointDir(made)
    return made


def fresh_shared_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a step that several later steps read (reliable checkpoint)."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let go of the shuffle files of steps that a checkpoint has replaced.

    Spark frees them when the driver's garbage collector finds that nobody holds them; until it
    runs by itself, they would lie beside those of the steps that follow.  Frames hold each other in
    circles, and the bridge to Java drops what Python has let go of about once a second.
    """
    gc.collect()
    dropped = getattr(spark.sparkContext._gateway._gateway_client, "finalizer_deque", ())
    until = time.time() + 5
    while dropped and time.time() < until:
        time.sleep(0.1)
    # What the first round lets go of may hold more.
    for _ in range(2):
        time.sleep(0.3)
        spark._jvm.System.gc()
