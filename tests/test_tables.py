"""Hand-made cases for manifests, catalogs, settings, text and languages."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from foliomill.constants import manufacturers
from foliomill.operators import catalogs, film, geometry, i18n, manifest, scoring, settings, textlayer
from foliomill.sources import capabilities, files


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"`{k}` {'string' if isinstance(v, str) or v is None else 'int'}" for k, v in values.items()))
    return row.select(column.alias("c")).first()["c"]


def many(spark, values, make, kind="string"):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], f"n int, v {kind}")
    return [r["c"] for r in df.orderBy("n").select(make(F.col("v")).alias("c")).collect()]


def test_page_names_keep_order(spark):
    name = lambda p, t: one(spark, manifest.page_name(F.col("p"), F.col("t"), F.lit("png")), p=p, t=t)
    assert name(1, 1) == "page_001.png" and name(7, 1000) == "page_0007.png" and name(1000, 1000) == "page_1000.png"


def test_fit_within(spark):
    rows = spark.createDataFrame([(400, 300), (100, 400), (1000, 1)], "w int, h int")
    got = [(r["thumb_width"], r["thumb_height"]) for r in geometry.fit_within(rows, ("w", "h"), 160, 120).collect()]
    assert got == [(160, 120), (30, 120), (160, 1)]


def test_fit_extent(spark):
    rows = spark.createDataFrame([(640, 480, 320, 0), (640, 480, 0, 240), (640, 480, 100, 100), (640, 480, 0, 0)], "sw int, sh int, rw int, rh int")
    got = [(r["fit_width"], r["fit_height"]) for r in geometry.fit_extent(rows, ("sw", "sh"), ("rw", "rh")).collect()]
    assert got == [(320, 240), (320, 240), (100, 75), (640, 480)]


def test_output_names(spark):
    good = ["scan", "Brief 2026-11-08", "a.b", "COM10", "console"]
    bad = ["", ".", "..", "a/b", "a\\b", "../x", "x.", "x ", "a:b", "a\x07b", "CON", "con.txt", "COM1", "lpt9.pdf", "NUL", "a" * 129]
    assert many(spark, good, settings.output_name_error) == [None] * len(good)
    assert all(many(spark, bad, settings.output_name_error))


def test_vid_forms(spark):
    got = many(spark, ["usb:04b8", "0x04b8", "VID_04B8&PID_0122", "fi-7160", "04b8x"], catalogs.vid_of)
    assert got == ["04b8", "04b8", "04b8", "", ""]


def test_name_tokens(spark):
    queries = ["fi-7160", "wifi-x", "HP ScanJet", "xhp", "my (hp)", "Epson", "", "mfc dcp-1", "é-hp-é"]
    got = many(spark, queries, lambda c: catalogs.resolve_columns(c)["id"])
    assert got == ["fujitsu", None, "hp", None, "hp", "epson", None, "brother", "hp"]


def test_catalog_order_decides(spark):
    entries = [dict(m) for m in manufacturers()]
    assert many(spark, ["canon epson"], lambda c: catalogs.resolve_columns(c, entries)["id"]) == ["epson"]


def test_hidden_characters_go(spark):
    df = spark.createDataFrame([("a​b‮c﻿\x1b" + "d" * 200,)], "name string").selectExpr("name", "'x' AS kind")
    got = catalogs.device_normalize(df).first()["name"]
    assert got == "abc" + "d" * 125


def test_device_lines(spark):
    lines = spark.createDataFrame([(" id1 | Name one ",), ("solo",), ("",), ("| nameless",), ("a|b|c",)], "line string")
    got = [(r["id"], r["name"]) for r in catalogs.device_list(lines, "line", "sane", "SANE", "sane").collect()]
    assert got == [("sane:id1", "SANE: Name one"), ("sane:solo", "SANE: solo"), ("sane:a", "SANE: b|c")]


def test_resolution_pick(spark):
    caps = spark.createDataFrame(
        [("d", 0, "discrete", 200, 200), ("d", 1, "discrete", 600, 600)], "device string, ordinal int, kind string, x bigint, y bigint"
    )
    for name in ("min_x", "max_x", "step_x", "min_y", "max_y", "step_y"):
        caps = caps.withColumn(name, F.lit(None).cast("bigint"))
    spans = spark.createDataFrame([("r", 0, "range", 75, 1200, 25, 100, 600, 50)], "device string, ordinal int, kind string, min_x bigint, max_x bigint, step_x bigint, min_y bigint, max_y bigint, step_y bigint")
    caps = caps.unionByName(spans.withColumn("x", F.lit(None).cast("bigint")).withColumn("y", F.lit(None).cast("bigint")))
    asks = spark.createDataFrame([(1, "d", 300, 300), (2, "d", 400, 400), (3, "r", 311, 10000), (4, "none", 300, 300)], "request_id int, device string, dpi_x int, dpi_y int")
    got = {r["request_id"]: (r["pick_x"], r["pick_y"]) for r in catalogs.resolution_pick(asks, caps).collect()}
    assert got == {1: (200, 200), 2: (200, 200), 3: (300, 600), 4: (300, 300)}


def test_snap_stays_inside(spark):
    assert one(spark, catalogs.snap(F.col("w"), F.lit(100), F.lit(590), F.lit(200)), w=9999) == 500


def test_auto_paper_has_no_pixels(spark):
    assert many(spark, ["auto", "bogus", None, "a4"], lambda c: catalogs.paper_pixels(c, F.lit(300), 0)) == [None, None, None, 2480]


def test_scan_extent_precedence(spark):
    rows = spark.createDataFrame(
        [(1, 300, 150, "a4", "a5", 10, None, 100, 100), (2, 300, 150, "auto", "a5", None, None, 100, 101), (3, 150, 150, None, "a6", None, None, 7, 7)],
        "id int, dpi int, default_dpi int, paper string, config_paper string, width int, height int, default_width int, default_height int",
    )
    got = {r["id"]: (r["extent_width"], r["extent_height"]) for r in catalogs.scan_extent(rows).collect()}
    assert got == {1: (10, 3508), 2: (200, 202), 3: (620, 874)}


def test_curves(spark):
    texts = ["0:0, 128:200,255:255", "", "5:1", "0:0,0:1", "0:0,300:1", "a:1,2:2", "1:2:3,4:5", "0:0,9:x"]
    errors = many(spark, texts, lambda c: settings.curve_parse(c)["error"])
    assert errors == [
        None, None, "curve: too few points", "curve: x not rising",
        "curve point 2: outside 0-255", "curve point 1: bad x", "curve point 1: not x:y",
        "curve point 2: bad y",
    ]
    assert many(spark, texts[:2], lambda c: settings.curve_format(settings.curve_parse(c)["points"])) == ["0:0,128:200,255:255", ""]


def test_tiers(spark):
    got = many(spark, ["low", "TRUE", "strong", "no", "0", " ", None, "hevy"], lambda c: settings.tier_column(c)["tier"])
    assert got == ["light", "medium", "heavy", None, None, None, None, None]


def test_settings_layers(spark):
    rows = spark.createDataFrame(
        [(1, '{"default_width":320,"default_height":240,"film_type":"x","surprise":1}', "none", None), (2, None, None, 450), (3, '{"brightness":"many"}', "", 5)],
        "id int, config string, g_film string, g_rotate int",
    )
    done = settings.settings_resolve(settings.settings_load(rows), {"film_type": "g_film", "rotate": "g_rotate"})
    got = {r["id"]: r for r in done.collect()}
    assert (got[1]["s"]["default_width"], got[1]["s"]["film_type"], got[1]["error"]) == (0, None, None)
    assert (got[2]["s"]["rotate"], got[2]["s"]["levels_white"]) == (90, 255)
    assert got[3]["error"] == "config parse: brightness"


def test_default_settings_break_no_rule(spark):
    rows = settings.settings_load(spark.createDataFrame([(1, "{}")], "id int, config string"))
    assert settings.settings_validate(rows, "id").count() == 0


def test_redaction_is_recursive(spark):
    got = many(spark, ['{"a":1,"License":"x","n":{"SERIAL":3,"b":[{"drm":1}],"c":"q"}}'], settings.redact_keys)
    assert got == ['{"a":1,"n":{"b":[{"drm":1}],"c":"q"}}']


def test_redaction_has_no_depth_limit(spark):
    deep = '{"a":' * 200 + '{"serial":"S","k":1}' + "}" * 200
    got = many(spark, [deep, None, "[1]", "{broken"], settings.redact_keys)
    assert got == ['{"a":' * 200 + '{"k":1}' + "}" * 200, None, None, None]


def test_short_arrays_break_a_rule_and_not_the_job(spark):
    texts = ['{"crop":[1,2]}', '{"curves":[[0],[9,9]]}', '{"crop":[0,0,5,5]}', '{"curves":[[0,0],[9,9]]}']
    rows = settings.settings_load(spark.createDataFrame(list(enumerate(texts)), "id int, config string"))
    assert {(r["id"], r["rule"]) for r in settings.settings_validate(rows, "id").collect()} == {(0, "crop"), (1, "curves")}


def test_languages(spark):
    tags = {t: "tw" for t in ("zh-TW", "zh_TW", "zh-Hant", "zh-HK", "zh_MO", "zh-Hant-TW")}
    tags |= {t: "zh" for t in ("zh", "zh-CN", "zh-Hans", "zh-Hans-HK", "zh_Hans_MO", "zh-SG")}
    tags |= {t: "no" for t in ("nb", "nn", "nb-NO", "nn_NO")} | {"pt-BR": "pb", "xx": "en", "": "en", "pt": "pt"}
    assert many(spark, list(tags), i18n.lang_normalize) == list(tags.values())


def test_translation_fallbacks(spark):
    words = spark.createDataFrame([("en", "scan", "Scan"), ("en", "about", "v {version}"), ("de", "scan", "Scannen")], "lang string, key string, text string")
    asks = spark.createDataFrame([(1, "de", "button.scan_plus"), (2, "fr", "scan"), (3, "de", "nope"), (4, "de", "about"), (5, "de", "button.zoom_in")], "id int, language string, key string").withColumn(
        "arguments", F.array(F.struct(F.lit("version").alias("name"), F.lit("9").alias("value")))
    )
    got = {r["id"]: r["text"] for r in i18n.translate_resolve(asks, words, "id", "arguments").collect()}
    assert got == {1: "Scannen +1", 2: "Scan", 3: "nope", 4: "v 9", 5: "+"}


def test_word_confidence(spark):
    tsv = "\n".join(
        ["level\tpage\tblock\tpar\tline\tword\tleft\ttop\twidth\theight\tconf\ttext", "1\t1\t0\t0\t0\t0\t0\t0\t640\t200\t-1\t",
         "5\t1\t1\t1\t1\t1\t20\t20\t180\t60\t96.123\tHello", "5\t1\t1\t1\t1\t2\t220\t20\t200\t60\t88.5\tscanner",
         "5\t1\t1\t1\t1\t3\t440\t20\t180\t60\t0\t.", "5\t1\t1\t1\t1\t4\t640\t20\t10\t60\t-1\tghost", "5\t1\t1\t1\t1\t5\t660\t20\t10\t60\t99\t "]
    )
    pages = spark.createDataFrame([(1, tsv), (2, "header")], "page_id int, tsv string")
    got = {r["page_id"]: r["confidence"] for r in textlayer.ocr_confidence(textlayer.ocr_words(pages), pages).collect()}
    assert abs(got[1] - (96.123 + 88.5) / 300) < 1e-9 and got[2] == 0.0


def test_encoding_past_the_surrogates(spark):
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 60) if c]
    codes = spark.createDataFrame([(1, ch, 0xD7F0 + n) for n, ch in enumerate(alphabet)], "job_id int, ch string, code int")
    pages = spark.createDataFrame([(1, 1, "".join(alphabet)), (1, 2, alphabet[0] * 2), (1, 3, "")], "job_id int, page_no int, text string")
    got = {r["page_no"]: bytes(r["encoded"]) for r in textlayer.encode_text(pages, codes).collect()}
    assert got[1] == b"".join((0xD7F0 + n).to_bytes(2, "big") for n in range(len(alphabet)))
    assert got[2] == (0xD7F0).to_bytes(2, "big") * 2 and got[3] == b""


def test_glyph_round_trip(spark):
    """Drawn templates are read back, spaces and lines included."""
    import numpy as np

    from foliomill.constants import glyphs
    from rasters import to_df

    cells = dict(glyphs())

    def draw(size, placed):
        """Cells are 4 apart and 5 wide, so diagonal strokes stay 4-connected."""
        page = np.full((size, 200, 1), 255)
        for left, top, ch in placed:
            for n, cell in enumerate(cells[ch]):
                if cell == "#":
                    y, x = top + n // 5 * 4, left + n % 5 * 4
                    page[y : y + 5, x : x + 5] = 0
        return page

    words = {1: "2", 2: "5", 3: "R", 4: "W", 5: "HL", 6: "HH H\nT"}
    pages = {n: draw(80, [(20, 20, words[n])]) for n in range(1, 5)}
    pages[5] = draw(100, [(44, 20, "L"), (20, 21, "H")])
    pages[6] = draw(200, [(20, 20, "H"), (44, 20, "H"), (100, 20, "H"), (20, 100, "T")])
    pages[7] = np.full((20, 20, 1), 255)
    strips = to_df(spark, pages)
    boxes = textlayer.ink_components(strips)
    texts = textlayer.line_text(textlayer.reading_lines(textlayer.glyph_match(strips, boxes)))
    done = {r["page_id"]: r for r in textlayer.recognized_pages(strips.where("y = 0"), texts).collect()}
    assert {n: done[n]["text"] for n in words} == words
    assert (done[7]["text"], done[7]["confidence"]) == ("[no text recognized]", 0.0)


def test_capability_ranges(spark):
    xml = """<?xml version="1.0"?><a:Caps xmlns:a="http://x/a"><a:Adf><a:AdfDuplexInputCaps><a:ResolutionRange>
<a:XResolutionRange><a:Min>75</a:Min><a:Max>1200</a:Max><a:Step>25</a:Step></a:XResolutionRange>
<a:YResolutionRange><a:Min>100</a:Min><a:Max>600</a:Max></a:YResolutionRange></a:ResolutionRange>
<a:ResolutionRange><a:XResolutionRange><a:Min>0</a:Min><a:Max>9</a:Max></a:XResolutionRange><a:YResolutionRange><a:Min>1</a:Min><a:Max>9</a:Max></a:YResolutionRange></a:ResolutionRange>
</a:AdfDuplexInputCaps></a:Adf></a:Caps>"""
    got = capabilities.capability_resolutions(spark.createDataFrame([("d", xml)], "device string, xml string")).collect()
    assert [(r["source"], r["step_x"], r["step_y"], r["max_x"]) for r in got] == [("adf_duplex", 25, 1, 1200)]


CAPS = """<a:ScannerCapabilities xmlns:a="http://x/a"><a:MakeAndModel>  Old </a:MakeAndModel><a:MakeAndModel>Maker 7</a:MakeAndModel>
<a:ColorMode>Loose</a:ColorMode><a:InputSource>ADF Duplex</a:InputSource><a:InputSource>nothing</a:InputSource>
<a:PlatenCaps><a:MaxWidth> 2550 </a:MaxWidth><a:MaxHeight>x</a:MaxHeight><a:MaxHeight>3300</a:MaxHeight>
<a:ColorMode>RGB24</a:ColorMode><a:ColorMode>rgb24 </a:ColorMode><a:ColorMode> </a:ColorMode>
<a:Resolution><a:XResolution>300</a:XResolution><a:YResolution>0</a:YResolution></a:Resolution>
<a:Resolution><a:XResolution>+300</a:XResolution><a:YResolution>600</a:YResolution></a:Resolution>
<a:XResolution>9</a:XResolution><a:Min>4</a:Min></a:PlatenCaps>
<a:Transparency><a:FeederCaps><a:MaxScanWidth>99999999999</a:MaxScanWidth></a:FeederCaps></a:Transparency></a:ScannerCapabilities>"""


def test_capability_documents_in_one_pass(spark):
    """Names, limits and sources of one document; bad documents are error rows and spoil no other."""
    deep = "<a>" * 200 + "</a>" * 200
    docs = [("d", CAPS), ("cut", CAPS[:300]), ("deep", deep), ("none", None), ("dtd", "<!DOCTYPE a [<!ENTITY b 'c'>]><a>&b;</a>"), ("empty", "<a/>")]
    df = spark.createDataFrame(docs, "device string, xml string").repartition(2)
    values = {(r.source, r.kind, r.value) for r in capabilities.capability_values(df).where("device = 'd'").collect()}
    assert values == {("default", "color_mode", "Loose"), ("platen", "color_mode", "RGB24")}
    pairs = [(r.device, r.source, r.kind, r.x, r.y) for r in capabilities.capability_resolutions(df).collect()]
    assert pairs == [("d", "platen", "discrete", 300, 600)]
    got = {(r.device, r.source): (r.make_and_model, r.max_width, r.max_height) for r in capabilities.capability_sources(df).where("error is null").collect()}
    assert got == {
        ("d", "default"): ("Maker 7", None, None),
        ("d", "adf_duplex"): ("Maker 7", None, None),
        ("d", "platen"): ("Maker 7", 2550, 3300),
        ("d", "adf_simplex"): ("Maker 7", None, None),
        ("d", "film"): ("Maker 7", None, None),  # the element around the feeder's
        ("empty", "default"): (None, None, None),
    }
    bad = {r.device for r in capabilities.capability_sources(df).where("error is not null").collect()}
    assert bad == {"cut", "deep", "none", "dtd"}


def test_containers_and_page_numbers(spark):
    content = [b"\x89PNG\r\n\x1a\n....", b"RIFF\0\0\0\0WEBP", b"RIFF\0\0\0\0WAVE", b"", b"\xff\x0a", b"%PDF-1.7"]
    assert many(spark, [bytearray(c) for c in content], files.container_of, "binary") == ["png", "webp", None, None, "jxl", "pdf"]
    names = ["in/page_2.png", "page_10.png", "page_000001.png.part", "page_.png", "xpage_1.png", "page_1a.png", "page_3.jpg"]
    assert many(spark, names, lambda c: files.page_number(c, "png")) == [2, 10, None, None, None, None, None]


def test_tensor_sizes(spark):
    rows = spark.createDataFrame([(100, 200), (0, 5), (9000, 8000)], "h int, w int").select(scoring.tensor_size(F.col("h"), F.col("w")).alias("t"))
    got = [(r["t"]["h"], r["t"]["w"]) for r in rows.collect()]
    assert got[:2] == [(100, 200), (1, 5)] and 3 * got[2][0] * got[2][1] <= 16 * 1024 * 1024
    assert scoring.resolve_layout([1, 8, 8, 3]) == "nhwc" and scoring.resolve_layout([1, 3, 8, 8]) == "nchw"


def test_summary_of_odd_tensors(spark):
    inf, nan = float("inf"), float("nan")
    rows = spark.createDataFrame([(1, [1.0, 2.0, 4.0]), (2, []), (3, [1.0, inf, nan])], "id int, v array<float>")
    got = {r["id"]: r for r in scoring.tensor_summary(rows, "v").collect()}
    assert (got[1]["min"], got[1]["max"], round(got[1]["mean"], 6)) == (1.0, 4.0, 2.333333)
    assert (got[2]["size"], got[2]["min"], got[2]["mean"]) == (0, 0.0, 0.0)
    assert got[3]["sample"] == [1.0, None, None]


def test_film_lookup_names_the_unknown(spark):
    asked = spark.createDataFrame([("kodak_tri_x_400",), ("nothing",)], "film_id string")
    got = {r["film_id"]: r["error"] for r in film.film_lookup(asked, film.film_catalog(spark)).collect()}
    assert got == {"kodak_tri_x_400": None, "nothing": "film profile not found: nothing"}
    assert film.film_catalog(spark).select("film_id").distinct().count() == 51


def test_batch_end_states(spark):
    jobs = spark.createDataFrame(
        [(1, 2, 2, "limit_reached", False), (2, 3, 2, "limit_reached", False), (3, 9, 0, "feeder_exhausted", False), (4, 8, 3, "feeder_exhausted", True), (5, 2, 5, "limit_reached", False)],
        "job_id int, requested int, reported int, end_reason string, duplex boolean",
    )
    pages = spark.createDataFrame([(1,), (1,), (2,), (2,), (4,), (4,), (4,), (5,)], "job_id int")
    got = {r["job_id"]: r["status"] for r in manifest.batch_complete(jobs, pages).collect()}
    assert got[1] == "complete" and got[2].startswith("stopped at 2 of 3") and got[3] == "no pages"
    assert "odd duplex count (3 sides)" in got[4] and got[5] == "reported 5, published 1"


def test_cache_stops_at_first_miss(spark):
    loads = spark.createDataFrame([(1, "a", 1, 75), (1, "b", 2, 75), (1, "a", 3, 75), (1, "c", 4, 200), (1, "d", 5, 1)], "job_id int, path string, load_no int, pixel_bytes int")
    got = {r["path"]: r["admitted"] for r in manifest.cache_admission(loads, 250).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": False}


@pytest.mark.parametrize("path,want", [("a/./b", "a/b"), ("/a/../b", "/b"), ("../a", "../a"), ("a/../../b", "../b"), ("a//b/", "a/b")])
def test_normal_paths(spark, path, want):
    assert many(spark, [path], manifest.normal_path) == [want]
