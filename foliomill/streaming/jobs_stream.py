"""Job events reduced continuously.

State is kept per job and path bucket, so a job that owns most of the events is
spread over many state partitions; the small pieces are merged when read.  A finish
that sets the sides of its job goes to all buckets: each keeps the set value and the
positions of the pages after it, and forgets the pages before it.  State that nobody
has touched for ``ttl_ms`` is dropped, so a job's events must come within that time of each
other; every ``COMPACT`` triggers the written pieces are brought to the latest of each
bucket and what they replace is deleted.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scale import fresh_shared_path
from ..operators.jobs import REPORT, file_rows, merge_reports

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_PIECE = (
    "moved_seq bigint, phase string, ended_seq bigint, terminal string, error string, reason string, "
    "assigned_seq bigint, assigned bigint, pages_after bigint, files bigint, events bigint"
)
PIECE_SCHEMA = "job_id bigint, bucket int, " + _PIECE
_NAMES = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
BUCKETS = 32
TTL_MS = 7 * 24 * 3600 * 1000
#: Triggers after which the written pieces are compacted.
COMPACT = 16


class ReportPieces(StatefulProcessor):
    """Running piece of one (job, bucket): last phase, last end, set sides, pages after them, paths."""

    def __init__(self, ttl_ms: int | None = TTL_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.piece = handle.getValueState("piece", _PIECE, self.ttl_ms)
        self.paths = handle.getMapState("paths", "path string", "seen boolean", self.ttl_ms)
        self.pages = handle.getMapState("pages", "seq bigint", "times bigint", self.ttl_ms)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        state = self.piece.get() if self.piece.exists() else (None,) * 8 + (0, 0, 0)
        moved_seq, phase, ended_seq, terminal, error, reason, assigned_seq, assigned, after, files, events = state
        was = assigned_seq
        for row in rows:
            # Events of a trigger may arrive in any order; positions decide.
            if row.assigned is not None and (assigned_seq is None or (row.seq, row.assigned) > (assigned_seq, assigned)):
                assigned_seq, assigned = row.seq, row.assigned
            if row.copy:
                continue
            if row.head:
                events += 1
                if row.moved is not None and (moved_seq is None or (row.seq, row.moved) > (moved_seq, phase)):
                    moved_seq, phase = row.seq, row.moved
                if row.ended is not None and (ended_seq is None or row.seq > ended_seq):
                    ended_seq, terminal, error, reason = row.seq, row.ended, row.error, row.reason
            if row.page and (assigned_seq is None or row.seq > assigned_seq):
                times = self.pages.getValue((row.seq,))[0] if self.pages.containsKey((row.seq,)) else 0
                self.pages.updateValue((row.seq,), (times + 1,))
                after += 1
            if row.path is not None and not self.paths.containsKey((row.path,)):
                self.paths.updateValue((row.path,), (True,))
                files += 1
        if assigned_seq != was:
            gone = [(seq, times) for (seq,), (times,) in self.pages.iterator() if seq <= assigned_seq]
            for seq, times in gone:
                self.pages.removeKey((seq,))
                after -= times
        piece = (moved_seq, phase, ended_seq, terminal, error, reason, assigned_seq, assigned, after, files, events)
        self.piece.update(piece)
        yield Row(**dict(zip(_NAMES, (*key, *piece), strict=True)))

    def close(self) -> None:
        pass


def report_pieces(events: DataFrame, ttl_ms: int | None = TTL_MS) -> DataFrame:
    """Streaming DataFrame of updated pieces (update mode)."""
    rows = file_rows(events)
    spread = F.when(F.col("path").isNotNull(), F.col("path")).otherwise(F.col("seq").cast("string"))
    own = F.pmod(F.xxhash64(spread), F.lit(BUCKETS)).cast("int")
    # A finish that sets the sides is told to every bucket; its copies carry nothing else.
    everywhere = F.when(F.col("head") & F.col("assigned").isNotNull(), F.sequence(F.lit(0), F.lit(BUCKETS - 1))).otherwise(F.array(own))
    prepared = rows.withColumn("own", own).withColumn("bucket", F.explode(everywhere)).withColumn("copy", F.col("bucket") != F.col("own"))
    return (
        prepared.select("job_id", "bucket", "seq", "head", "copy", "moved", "ended", "error", "reason", "assigned", "page", "path")
        .groupBy("job_id", "bucket")
        .transformWithState(
            statefulProcessor=ReportPieces(ttl_ms), outputStructType=PIECE_SCHEMA, outputMode="update", timeMode="ProcessingTime" if ttl_ms else "None"
        )
    )


def _folders(spark: SparkSession, target: str) -> tuple[list[int], list[int]]:
    """Numbers of the complete base folders and of the triggers in ``target``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(target)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(where):
        return [], []
    found: dict[str, list[int]] = {"base": [], "trigger": []}
    for status in files.listStatus(where):
        kind, _, number = status.getPath().getName().partition("=")
        if kind in found and files.exists(spark._jvm.org.apache.hadoop.fs.Path(status.getPath(), "_SUCCESS")):
            found[kind].append(int(number))
    return sorted(found["base"]), sorted(found["trigger"])


def read_pieces(spark: SparkSession, target: str) -> DataFrame:
    """Latest piece per (job, bucket): of the last base and the triggers after it."""
    bases, triggers = _folders(spark, target)
    base = bases[-1] if bases else -1
    paths = [f"{target}/base={base}"] if bases else []
    paths += [f"{target}/trigger={n}" for n in triggers if n > base]
    schema = PIECE_SCHEMA + ", version bigint"
    pieces = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    value = F.struct(*[c for c in pieces.columns if c not in ("job_id", "bucket")])
    return pieces.groupBy("job_id", "bucket").agg(F.max_by(value, "version").alias("p")).select("job_id", "bucket", "p.*")


def compact(spark: SparkSession, target: str, batch_id: int) -> None:
    """Write the latest pieces up to a trigger as a base, then delete what it replaces."""
    bases, triggers = _folders(spark, target)
    if batch_id not in bases:
        read_pieces(spark, target).write.mode("overwrite").parquet(f"{target}/base={batch_id}")
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    files = hadoop(target).getFileSystem(spark._jsc.hadoopConfiguration())
    for name in [f"base={n}" for n in bases if n < batch_id] + [f"trigger={n}" for n in triggers if n <= batch_id]:
        files.delete(hadoop(target, name), True)


@contextmanager
def _settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings that hold while a query starts; it keeps them."""
    values = {k.replace("__", "."): v for k, v in values.items()}
    kept = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in kept.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def write_report_pieces(
    events: DataFrame, target: str, checkpoint: str, ttl_ms: int | None = TTL_MS, every: int = COMPACT, seconds: int | None = None
):
    """Start the query: each trigger appends the updated pieces to ``target``.

    A trigger writes its own folder with overwrite, so a replayed trigger
    leaves one copy; pieces of a trigger that a base holds already are written again, equal.
    The query runs every ``seconds``, or over what is there and then ends.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("version", F.lit(batch_id).cast("bigint")).write.mode("overwrite").parquet(f"{target}/trigger={batch_id}")
        if (batch_id + 1) % every == 0:
            compact(batch.sparkSession, target, batch_id)

    writer = report_pieces(events, ttl_ms).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(publish)
    writer = writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)
    # State with a time to live asks for one more trigger after each, so a query that is to end takes none without data.
    with _settings(events.sparkSession, spark__sql__streaming__noDataMicroBatches__enabled=str(bool(seconds)).lower()):
        return writer.start()


def read_reports(spark: SparkSession, target: str) -> DataFrame:
    """The latest pieces merged to one report per job."""
    latest = read_pieces(spark, target)
    parts = latest.select(
        "job_id",
        F.when(F.col("moved_seq").isNotNull(), F.struct(F.col("moved_seq").alias("seq"), "phase")).alias("moved"),
        F.when(F.col("ended_seq").isNotNull(), F.struct(F.col("ended_seq").alias("seq"), "terminal", "error", "reason")).alias("ended"),
        "files",
        "events",
    )
    # All buckets of a job know its last assignment, but for those it has never reached.
    sides = latest.groupBy("job_id").agg(F.max(F.struct("assigned_seq", "assigned")).alias("set"), F.sum("pages_after").alias("after"))
    sides = sides.select("job_id", (F.coalesce("set.assigned", F.lit(0)) + F.col("after")).alias("sides_complete"))
    return merge_reports(parts).join(sides, "job_id").select(*REPORT)


def drain_job_reports(spark: SparkSession, events: DataFrame, name: str = "job-reports") -> DataFrame:
    """Run everything available through the stream and return the reports."""
    with _settings(spark, spark__sql__streaming__stateStore__providerClass=STATE_PROVIDER):
        root = fresh_shared_path(spark, name)
        write_report_pieces(events, f"{root}/pieces", f"{root}/checkpoint").awaitTermination()
        return read_reports(spark, f"{root}/pieces")
