"""Files, images, sinks and streams."""

from __future__ import annotations

import json
import os
import random
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.operators import jobs, raster
from foliomill.plans.table_queries import event_rows
from foliomill.sources import files
from foliomill.streaming import jobs_stream, page_stream
from rasters import lcg, to_arrays, to_df


def png(a: np.ndarray) -> bytes:
    h, w, bpp = a.shape

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    lines = b"".join(b"\0" + a[y].astype(np.uint8).tobytes() for y in range(h))
    head = struct.pack(">IIBBBBB", w, h, 8, {1: 0, 3: 2, 4: 6}[bpp], 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_image_source_order_and_alpha(spark, tmp_path):
    pages = {"g": lcg(5, 4, "Gray8"), "c": lcg(5, 4, "Rgb8"), "t": lcg(5, 4, "Rgba8")}
    for name, a in pages.items():
        (tmp_path / f"{name}.png").write_bytes(png(a))
    images = files.read_images(spark, str(tmp_path))
    names = {r["page_id"]: r["path"].rsplit("/", 1)[1][0] for r in images.select("page_id", "path").collect()}
    got = {names[k]: a for k, a in to_arrays(files.image_strips(images)).items()}
    assert np.array_equal(got["g"], pages["g"]) and np.array_equal(got["c"], pages["c"])
    c, alpha = pages["t"][..., :3], pages["t"][..., 3:]
    assert np.array_equal(got["t"], (c * alpha + 255 * (255 - alpha) + 127) // 255)


def test_page_write_refuses_to_replace(spark, tmp_path):
    strips = to_df(spark, {1: lcg(5, 4, "Rgba8")})
    target = str(tmp_path / "out")
    files.page_write(strips, target)
    with pytest.raises(Exception, match="already exists"):
        files.page_write(strips, target)
    files.page_write(strips, target, overwrite=True)
    assert np.array_equal(to_arrays(files.read_strips(spark, target))[1], lcg(5, 4, "Rgba8"))
    files.page_write_with_raw(strips, strips, str(tmp_path / "both"))
    assert sorted(os.listdir(tmp_path / "both")) == ["pages", "raw"]


def test_numbered_files(spark, tmp_path):
    for name in ("page_2.png", "page_10.png", "page_3.png.part", "other.png"):
        (tmp_path / name).write_bytes(b"x")
    found = files.page_files(files.read_page_files(spark, str(tmp_path))).orderBy("number")
    assert [r["number"] for r in found.collect()] == [2, 10]


def test_text_sources(spark, tmp_path):
    (tmp_path / "devices.txt").write_text("a | A\n\nb\n")
    assert files.read_device_lists(spark, str(tmp_path / "devices.txt"), "wia", "WIA", "wia").count() == 2
    folder = tmp_path / "profiles"
    folder.mkdir()
    good = {"format": "scanner-profile", "version": 1, "kind": "scanner_it8", "matrix": [[1, 0, 0], [0, 1, 0], [0, 0, 1.5]], "gamma": [1, 1, 2.2]}
    (folder / "a.json").write_text(json.dumps(good, indent=1))
    (folder / "b.json").write_text(json.dumps({**good, "gamma": [1, 1, 9]}))
    got = {r["path"].rsplit("/", 1)[1]: (r["error"], r["matrix"]) for r in files.read_profile_files(spark, str(folder)).collect()}
    assert got["a.json"] == (None, [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.5]])
    assert got["b.json"][0] == "gamma entry not within 0.05..8"
    words = tmp_path / "words"
    words.mkdir()
    (words / "de.json").write_text('{"scan": "Scannen", "open": "Öffnen"}')
    assert {(r["lang"], r["key"], r["text"]) for r in files.read_translations(spark, str(words)).collect()} == {("de", "scan", "Scannen"), ("de", "open", "Öffnen")}


def test_admission_splits(spark):
    pages = spark.createDataFrame(
        [(1, 2, 2, "Gray8", bytearray(4)), (2, 2, 2, "Rgb8", bytearray(4)), (3, 0, 2, "Gray8", bytearray(0)), (4, 70000, 1, "Gray8", bytearray(1))],
        "page_id int, width int, height int, fmt string, content binary",
    )
    good, bad = raster.split_admitted(pages)
    assert [r["page_id"] for r in good.collect()] == [1]
    assert {r["page_id"]: r["reason"] for r in bad.collect()} == {2: "packed length mismatch", 3: "width and height must be positive", 4: "axis exceeds 65535 pixels"}


@pytest.fixture
def stream_state(spark):
    kept = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", jobs_stream.STATE_PROVIDER)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", kept)


@pytest.mark.parametrize("split", ["seq % 3", "pmod(xxhash64(seq), 4)", "-floor(seq / 700)"])
def test_job_stream_equals_batch_over_triggers(spark, sf_dir, tmp_path, stream_state, split):
    """Triggers overlap in order or come backwards: seq alone decides; pieces are compacted on the way."""
    rows = event_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    feed = str(tmp_path / "feed")
    parts = sorted(r[0] for r in rows.selectExpr(f"CAST({split} AS int)").distinct().collect())
    assert len(parts) > 1
    for part in parts:
        rows.where(F.expr(split) == part).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(rows.schema).parquet(feed)
        jobs_stream.write_report_pieces(stream, str(tmp_path / "pieces"), str(tmp_path / "cp"), every=2).awaitTermination()
    got = sorted(map(tuple, jobs_stream.read_reports(spark, str(tmp_path / "pieces")).collect()), key=str)
    assert got == sorted(map(tuple, jobs.job_report(rows).collect()), key=str)
    folders = {x.name for x in (tmp_path / "pieces").iterdir() if x.is_dir()}
    assert len([x for x in folders if x.startswith("base=")]) <= 1 and len(folders) <= 2


EVENTS = "job_id bigint, seq bigint, kind string, phase string, path string, output string, error string, paths array<string>, reason string"


def plain_report(rows):
    """Events applied one after the other in the order of seq."""
    out = {}
    for job, _, kind, phase, path, output, error, paths, reason in sorted(rows, key=lambda r: (r[0], r[1])):
        r = out.setdefault(job, {"phase": "Preparing", "end": (None, None, None), "sides": 0, "files": {}, "events": 0})
        r["events"] += 1
        if kind == "progress":
            r["phase"] = jobs.PHASES.get(phase, r["phase"])
        if kind == "publishing":
            r["phase"] = "Publishing"
        if kind in ("published", "raw"):
            r["sides"] += kind == "published" and output == "page"
            if path is not None:
                r["files"].setdefault(path, "raw" if kind == "raw" else output)
        if kind == "finish" and paths is not None:
            for p in paths:
                r["files"].setdefault(p, output or "page")
            r["sides"] = len(paths)
        if kind in jobs.TERMINALS:
            r["phase"], r["end"] = "Finished", (jobs.TERMINALS[kind], error if kind == "fail" else None, reason if kind == "finish" else None)
    return out


def random_events(seed, n=400, jobs_=6):
    pick = random.Random(seed)
    kinds = ["progress", "published", "published", "published", "raw", "publishing", "finish", "cancel", "fail"]
    rows = []
    for seq in pick.sample(range(10 * n), n):
        kind = pick.choice(kinds)
        paths = pick.choice([None, [], ["a"], ["b", "c", "b"], ["a", "x", "z"]])
        rows.append((0 if pick.random() < 0.4 else pick.randrange(jobs_), seq, kind, pick.choice([*jobs.PHASES, "idle", None]), pick.choice(["a", "b", "d", None, str(seq)]),
                     pick.choice(["page", "document", None]), "e", paths, pick.choice(["limit_reached", "feeder_exhausted", None])))
    return rows


@pytest.mark.parametrize("block", [4096, 64])
def test_end_rules(spark, monkeypatch, block):
    """Finish adds its files and sets the sides, raw files are no sides, the end's reason stays."""
    monkeypatch.setattr(jobs, "ORDER_BLOCK", block)
    rows = random_events(5) + [(99, 1, "progress", "idle", None, None, None, None, None)]
    events = spark.createDataFrame(rows, EVENTS).repartition(4)
    want = plain_report(rows)
    got = {r.job_id: r for r in jobs.job_report(events).collect()}
    assert set(got) == set(want)
    for job, w in want.items():
        r = got[job]
        assert (r.phase, (r.terminal, r.error, r.end_reason), r.sides_complete, r.published_files, r.events) == (w["phase"], w["end"], w["sides"], len(w["files"]), w["events"]), job
    files = {(r.job_id, r.path): r.output for r in jobs.published_files(events).where("path is not null").collect()}
    assert files == {(j, p): k for j, w in want.items() for p, k in w["files"].items()}


def test_end_rules_on_the_stream(spark, tmp_path, stream_state):
    """A finish that comes late or early sets the sides in every bucket."""
    rows = random_events(8)
    feed = str(tmp_path / "feed")
    for part in range(4):
        spark.createDataFrame(rows[part::4], EVENTS).coalesce(1).write.mode("append").parquet(feed)
        stream = spark.readStream.schema(EVENTS).parquet(feed)
        jobs_stream.write_report_pieces(stream, str(tmp_path / "pieces"), str(tmp_path / "cp"), ttl_ms=None).awaitTermination()
    got = sorted(map(tuple, jobs_stream.read_reports(spark, str(tmp_path / "pieces")).collect()), key=str)
    assert got == sorted(map(tuple, jobs.job_report(spark.createDataFrame(rows, EVENTS)).collect()), key=str)
    kept = {r.job_id: r.sides_complete for r in jobs_stream.read_reports(spark, str(tmp_path / "pieces")).collect()}
    assert kept == {j: w["sides"] for j, w in plain_report(rows).items()}


REQUEST = "job_id int, out string, raw_out string, out_dir string, pages int, format string, multipage_out string, multipage_tiff string, multipage_pdf string, contact_sheet string, overwrite boolean"


def test_requested_outputs_and_destinations(spark):
    requests = spark.createDataFrame(
        [
            (1, "a/x.PDF", "a/x.png", None, None, None, None, None, None, None, None),
            (2, None, None, "b/", 2, ".png", "b/all", None, None, "b/sheet", False),
            (3, None, None, "b", 1, "jpg", "b/all.jpg", "b/page_001.jpg", "b/.pdf", "./b/page_001.jpg", True),
            (4, "noext", None, None, None, None, None, None, None, None, None),
            (5, None, None, None, 3, "png", "all", None, None, None, None),
            (6, None, None, "c", 0, "png", None, None, None, None, None),
        ],
        REQUEST,
    )
    got = {(r.job_id, r.kind, r.path): r.error for r in jobs.requested_outputs(requests).collect()}
    assert got == {
        (1, "document", "a/x.PDF"): None,
        (1, "raw", "a/x.png"): None,
        (2, "page", "b/page_001.png"): None,
        (2, "page", "b/page_002.png"): None,
        (2, "document", "b/all.tif"): None,
        (2, "contact_sheet", "b/sheet.bmp"): None,
        (3, "page", "b/page_001.jpg"): None,
        (3, "document", "b/all.jpg"): "extension not allowed: jpg",
        (3, "document", "b/page_001.jpg"): "extension not allowed: jpg",
        (3, "document", "b/.pdf"): "no extension",
        (3, "contact_sheet", "./b/page_001.jpg"): None,
        (4, "image", "noext"): "no extension",
    }
    present = spark.createDataFrame([("b//page_002.png",), ("b/page_001.jpg",)], "path string")
    problems = {(r.job_id, r.path, r.places, r.problem) for r in jobs.destination_problems(requests, present).collect()}
    assert problems == {
        (2, "b/page_002.png", "page", "exists"),
        (3, "b/all.jpg", "multipage_out", "extension not allowed: jpg"),
        (3, "b/page_001.jpg", "multipage_tiff", "extension not allowed: jpg"),
        (3, "b/.pdf", "multipage_pdf", "no extension"),
        (3, "b/page_001.jpg", "contact_sheet,multipage_tiff,page", "claimed more than once"),
        (4, "noext", "out", "no extension"),
    }


def test_pages_of_a_batch_stay_one_row(spark):
    """Batches of a job that share names, odd formats and folders, pages met by named files; nothing but what is claimed twice or exists becomes a row."""
    rows = [
        (1, None, "b/./x/..", 5, "png", None, None, None, None, "b//page_004.png", True),
        (1, None, "b/", 3, ".png", None, None, None, None, None, False),
        (1, None, "b", 3, "png", None, None, None, None, None, True),
        (2, None, "/", 1200, "tar.gz", "/page_1200.tar.gz", "/page_001.tar.gz", None, None, "/page_0007.tar.gz", None),
        (3, None, "c", 3, None, None, None, None, None, None, False),
        (4, None, "c", 2, "x/../y", None, None, None, None, None, False),
        (None, None, "d", 2, "png", None, None, None, None, "d/page_002.png", False),
        (5, None, "e", 130, "png", None, None, None, None, None, False),
        (5, None, "e", 0, "png", None, None, None, None, None, None),
    ]
    names = "job_id int, out string, out_dir string, pages int, format string, raw_out string, multipage_out string, multipage_tiff string, multipage_pdf string, contact_sheet string, overwrite boolean"
    requests = spark.createDataFrame(rows, names)
    present = spark.createDataFrame([(p,) for p in ("b/page_005.png", "e/page_064.png", "e/page_65.png", "e/x/../page_130.png", "e/page_131.png", "e/page_064.png", "d/page_001.png", "c", "page_99999999999999999999.png", None)], "path string")
    problems = sorted(tuple(r) for r in jobs.destination_problems(requests, present).where("job_id is null or problem not like 'ext%'").select(F.coalesce("job_id", F.lit(0)), "path", "places", "problem").collect())
    more = "claimed more than once"
    assert problems == [
        (0, "d/page_002.png", "contact_sheet,page", more),
        (1, "b/page_001.png", "page", more),
        (1, "b/page_002.png", "page", more),
        (1, "b/page_003.png", "page", more),
        (1, "b/page_004.png", "contact_sheet,page", more),
        (1, "b/page_005.png", "page", "exists"),
        (2, "/page_0007.tar.gz", "contact_sheet,page", more),
        (2, "/page_1200.tar.gz", "page,raw_out", more),
        (3, "c", "page", more),
        (3, "c", "page", "exists"),
        (4, "c/y", "page", more),
        (5, "e/page_064.png", "page", "exists"),
        (5, "e/page_130.png", "page", "exists"),
    ]
    many = spark.range(200).selectExpr("CAST(id AS INT) AS job_id", "CAST(NULL AS STRING) AS out", "'f' AS out_dir", "500 AS pages", "'png' AS format", *[f"CAST(NULL AS STRING) AS {c}" for c in ("raw_out", "multipage_out", "multipage_tiff", "multipage_pdf", "contact_sheet")])
    plan = jobs.destination_problems(many)
    assert plan.count() == 0
    # Before, every page was a row of the hash tables that look for common paths.
    assert "collect_set" not in plan._jdf.queryExecution().toString()


def test_repeated_page_event_counts_a_side_but_not_a_file(spark):
    rows = [(1, 1, "published", None, "a", "page", None), (1, 2, "published", None, "a", "page", None), (1, 3, "finish", None, None, None, None), (1, 4, "progress", "idle", None, None, None)]
    events = spark.createDataFrame(rows, "job_id bigint, seq bigint, kind string, phase string, path string, output string, error string")
    got = jobs.job_report(events).first()
    assert (got["phase"], got["terminal"], got["sides_complete"], got["published_files"]) == ("Finished", "Completed", 2, 1)


def test_page_stream_order_once_and_limit(spark, tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    seen: list[list[int]] = []

    def run(limit=None):
        pages = page_stream.read_page_stream(spark, str(folder))
        page_stream.run_page_stream(
            pages, lambda batch, _: seen.append([r["number"] for r in batch.select("number").collect()]), str(tmp_path / "cp"), limit
        ).awaitTermination()

    for n in (10, 2, 1):
        (folder / f"page_{n}.png").write_bytes(b"x")
    (folder / "page_3.png.part").write_bytes(b"x")
    run()
    (folder / "page_3.png").write_bytes(b"x")
    run()
    assert seen == [[1, 2, 10], [3]]
    (folder / "page_11.png").write_bytes(b"x")
    with pytest.raises(Exception, match="beyond the requested limit"):
        run(10)
    assert seen == [[1, 2, 10], [3]]


@pytest.mark.parametrize("name", ["page_stream", "page_stream_stats", "job_report_stream"])
def test_streamed_table_is_a_folder_of_files_or_empty(spark, sf_dir, tmp_path, name):
    from foliomill.plans.registry import all_queries

    run = all_queries()[name]
    for table in ("pages", "documents", "events"):
        rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
        rows.repartition(3).write.parquet(str(tmp_path / f"cut/{table}.parquet"))
        rows.limit(0).write.parquet(str(tmp_path / f"none/{table}.parquet"))
    whole = run(spark, sf_dir)
    assert sorted(map(str, run(spark, str(tmp_path / "cut")).collect())) == sorted(map(str, whole.collect()))
    assert run(spark, str(tmp_path / "none")).select(whole.columns).collect() == []
