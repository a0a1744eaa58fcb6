"""The skew helpers give what plain windows and joins give."""

from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foliomill.functions.scale import join_page_stats, lookup_join, prefix_scan, salted_join
from foliomill.operators import manifest, textlayer


def hot(spark, rows=3000):
    """One key owns two thirds of the rows."""
    return spark.range(rows).selectExpr(
        "CASE WHEN id % 3 < 2 THEN 1 ELSE 10 + id % 7 END AS job_id", "(id * 7919) % 100003 AS seq", "id % 11 - 3 AS v"
    )


def test_prefix_scan_equals_window(spark):
    df = hot(spark)
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    for value, func, plain in ((None, "sum", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))), (F.col("v"), "sum", F.sum("v").over(w)), (F.col("v"), "max", F.max("v").over(w))):
        got = prefix_scan(df, ["job_id"], "seq", (), value, "got", func)
        want = df.withColumn("want", plain)
        bad = got.join(want, ["job_id", "seq"]).where("got <> want").count()
        assert bad == 0 and got.count() == df.count()


@pytest.mark.parametrize("order", ["id * 1000003", "7", "CAST(id / 1000 AS BIGINT)"])
@pytest.mark.parametrize("key", ["1", "id % 3", "CASE WHEN id % 2 = 0 THEN NULL ELSE id END"])
def test_scan_tasks_are_bounded(spark, order, key):
    """Sparse, equal and few orders of one key, few and many keys: every task has its share, the input is read once."""
    n = 8000
    df = spark.range(n).selectExpr(f"{key} AS k", f"{order} AS at", "(id * 7919) % 8000 AS tie", "CASE WHEN id % 5 > 0 THEN id % 11 - 3 END AS v")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for func in ("sum", "max"):
            for inclusive in (True, False):
                found = prefix_scan(df, ["k"], "at", ("tie",), F.col("v"), "got", func, inclusive)
                got = sorted((repr(r.k), r.at, r.tie, r.got) for r in found.collect())
                want, held = [], {}
                for r in sorted(df.collect(), key=lambda r: (r.at, r.tie)):
                    was = held.get(r.k)
                    now = was if r.v is None else r.v if was is None else was + r.v if func == "sum" else max(was, r.v)
                    held[r.k] = now
                    told = now if inclusive else was
                    want.append((repr(r.k), r.at, r.tie, (told or 0) if func == "sum" else told))
                assert got == sorted(want, key=lambda x: x[:3])
        # The partition sizes of what was written.
        sizes = [r["n"] for r in found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
        assert max(sizes) < n / 2
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_prefix_scan_exclusive_and_negative_order(spark):
    df = spark.createDataFrame([(1, -5, 2), (1, 0, 3), (1, 7, 4)], "job_id int, seq int, v int")
    got = prefix_scan(df, ["job_id"], "seq", (), F.col("v"), "got", inclusive=False).orderBy("seq").collect()
    assert [r["got"] for r in got] == [0, 2, 5]


def test_salted_join_keeps_every_row(spark):
    df = hot(spark)
    totals = manifest.job_totals(df)
    for how in ("inner", "left"):
        got = salted_join(df, totals, ["job_id"], F.col("seq"), how)
        assert got.count() == df.count()
        assert got.where("job_id = 1").select("total").distinct().collect()[0][0] == 2000


def test_page_stats_join(spark):
    strips = spark.range(1000).selectExpr("id % 2 AS page_id", "CAST(id AS INT) AS y")
    stats = spark.createDataFrame([(0, "a")], "page_id bigint, s string")
    assert join_page_stats(strips, stats).count() == 500
    assert join_page_stats(strips, stats, "left").where("s is null").count() == 500


def test_scan_windows_never_span_a_whole_key(spark):
    """The only window keyed by the job alone reads block totals."""
    plan = prefix_scan(hot(spark), ["job_id"], "seq", out="n")._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if line.strip(" :+-").startswith("Window")]
    assert any("_block" in line for line in windows)


def test_reading_lines_match_one_fold(spark):
    """Staggered boxes get the lines that a fold over all of them gives."""
    rows = [(1, (k * 37) % 90, (k // 5) * 6 + (k * 5) % 9, (k * 37) % 90 + 4, (k // 5) * 6 + (k * 5) % 9 + 5 + k % 3) for k in range(120)]
    got = textlayer.reading_lines(spark.createDataFrame(rows, "page_id int, x0 int, y0 int, x1 int, y1 int")).collect()
    lines, expected = [], {}
    for _, x0, y0, x1, y1 in sorted(rows, key=lambda b: (b[2], b[1], b[4], b[3])):
        middle = (y0 + y1) // 2
        if lines and lines[-1][0] <= middle < lines[-1][1]:
            lines[-1] = [min(lines[-1][0], y0), max(lines[-1][1], y1)]
        else:
            lines.append([y0, y1])
        expected[(x0, y0, x1, y1)] = len(lines) - 1
    assert {(r["x0"], r["y0"], r["x1"], r["y1"]): r["line"] for r in got} == expected


def test_many_staggered_boxes_are_one_sweep(spark):
    """100,000 boxes, each reaching over the next, are numbered in seconds and over many batches."""
    n = 100_000
    boxes = spark.range(n).selectExpr("CAST(id % 2 AS INT) AS page_id", "CAST(id % 50 AS INT) AS x0", "CAST(id AS INT) AS y0", "CAST(id % 50 + 4 AS INT) AS x1", "CAST(id + 7 + id % 3 AS INT) AS y1")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        began = time.time()
        got = textlayer.reading_lines(boxes).toPandas()
        assert time.time() - began < 30
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for page, part in got.groupby("page_id"):
        bottom = line = -1
        for y0, y1, at in part.sort_values("y0")[["y0", "y1", "line"]].itertuples(index=False):
            bottom, line = (max(bottom, y1), line) if (y0 + y1) // 2 < bottom else (y1, line + 1)
            assert at == line


def test_band_of_many_runs_and_long_seams(spark):
    """A band of 100,000 runs is united in seconds; a comb, a spiral and a zigzag over all seams are one component."""
    runs = pa.table({"page_id": np.ones(100_000, np.int64), "width": np.full(100_000, 6400, np.int32), "height": np.full(100_000, 64, np.int32), "y": np.repeat(np.arange(50), 2000).astype(np.int32), "x0": np.tile(np.arange(2000) * 3, 50).astype(np.int32) + np.repeat(np.arange(50) % 2, 2000).astype(np.int32), "x1": np.tile(np.arange(2000) * 3 + 2, 50).astype(np.int32) + np.repeat(np.arange(50) % 2, 2000).astype(np.int32)})
    runs = runs.append_column("node", pa.array(np.arange(100_000))).append_column("band", pa.array(np.zeros(100_000, np.int32)))
    began = time.time()
    labels = np.unique(textlayer._band(runs)["local"].to_numpy())
    assert time.time() - began < 10 and len(labels) == 2000
    rng = np.random.default_rng(2)
    # A seam joins nodes of the band above (s - 1) and of its own.
    edges = [(1, int(s), int(s - 1) * 10 + int(a), int(s) * 10 + int(b)) for s, a, b in zip(rng.integers(1, 40, 300), rng.integers(0, 10, 300), rng.integers(0, 10, 300))]
    edges += [(2, k, k, k + 1) for k in range(1, 500)] + [(3, 500 - k, k, k + 1) for k in range(1, 500)]
    got = textlayer.merge_labels(spark.createDataFrame(edges, "page_id long, seam int, a long, b long"), 8).collect()
    want = {(p, n): (p, n) for p, _, a, b in edges for n in (a, b)}
    for _ in range(600):
        before = dict(want)
        for p, _, a, b in edges:
            want[p, a] = want[p, b] = min(want[p, a], want[p, b])
        if before == want:
            break
    assert {(r.page_id, r.u): (r.page_id, r.label) for r in got} == want and len(got) == len(want)


def test_path_claimed_often_is_one_row(spark):
    outputs = spark.range(5000).selectExpr("1 AS job_id", "'doc' AS label", "concat('a/./b/../', 'x.pdf') AS path", "CAST(NULL AS BIGINT) AS page_no")
    got = manifest.output_conflicts(outputs).collect()
    assert len(got) == 1 and got[0]["claims"] == 5000 and got[0]["target"] == "a/x.pdf"


def test_small_catalogs_do_not_move_the_many(spark):
    """A counted catalog is broadcast; a larger one still gives the same rows."""
    many = spark.range(1000).select((F.col("id") % 7).alias("k"), "id")
    one = spark.range(6).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    small = lookup_join(many, one, ["k"], F.col("id"))
    large = lookup_join(many, one, ["k"], F.col("id"), most=2)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning(k" not in plan
    rows = lambda df: sorted(map(tuple, df.select("k", "id", "v").collect()), key=repr)
    assert rows(small) == rows(large) and len(rows(small)) == 1000
