"""Raster operators against a naive model, and hand-made cases."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliomill.operators import filters, geometry, profile, raster, tables, textlayer, tone
from foliomill.plans import page_plan
from foliomill.constants import glyph_bits
from rasters import BPP, blur, byte, components, half_away, lcg, median, sharpen, to_arrays, to_df

SHAPES = [(13, 11), (2, 3), (1, 5)]


@pytest.fixture(scope="module", params=list(BPP))
def pages(request):
    return {n: lcg(w, h, request.param, 12345 + n) for n, (w, h) in enumerate(SHAPES)}


def same(got, want):
    assert got.keys() == want.keys()
    for key in want:
        assert np.array_equal(got[key], want[key]), key


@pytest.mark.parametrize("band_rows", [3, 4, 64])
@pytest.mark.parametrize("radius", [1, 2, 3])
def test_median(spark, pages, radius, band_rows):
    same(to_arrays(filters.median(to_df(spark, pages), radius, band_rows)), {k: median(a, radius) for k, a in pages.items()})


@pytest.mark.parametrize("band_rows", [4, 64])
@pytest.mark.parametrize("radius", [1, 4])
def test_blur(spark, pages, radius, band_rows):
    same(to_arrays(filters.box_blur(to_df(spark, pages), radius, band_rows)), {k: blur(a, radius) for k, a in pages.items()})


@pytest.mark.parametrize("band_rows", [2, 64])
def test_sharpen(spark, pages, band_rows):
    same(to_arrays(filters.sharpen(to_df(spark, pages), 1.3, band_rows)), {k: sharpen(a, 1.3) for k, a in pages.items()})


@pytest.mark.parametrize("tier", ["light", "medium", "heavy"])
def test_dust_tiers(spark, pages, tier):
    radius, limit = filters.DUST[tier]

    def clean(a):
        m = median(a, radius)
        colours = min(3, a.shape[2])
        far = np.abs(a - m)[..., :colours].max(axis=-1) > limit
        out = a.copy()
        out[far, :colours] = m[far, :colours]
        return out

    same(to_arrays(filters.dust_clean(to_df(spark, pages), tier)), {k: clean(a) for k, a in pages.items()})


@pytest.mark.parametrize("tier", ["low", "yes", "strong"])
def test_grain_tiers(spark, pages, tier):
    radius, share = filters.GRAIN[filters.TIER_ALIASES[tier]]
    want = {k: byte(a * (1 - share) + median(a, radius) * share) for k, a in pages.items()}
    same(to_arrays(filters.grain_reduction(to_df(spark, pages), tier)), want)


def test_unknown_tier_is_refused(spark, pages):
    with pytest.raises(ValueError):
        filters.grain_reduction(to_df(spark, pages), "hevy")


def test_geometry(spark, pages):
    df = to_df(spark, pages)
    for turns, degrees in ((3, 90), (2, 180), (1, 270)):
        same(to_arrays(geometry.rotate(df, degrees)), {k: np.rot90(a, turns).copy() for k, a in pages.items()})
    same(to_arrays(geometry.rotate(df, 45)), pages)
    same(to_arrays(geometry.flip_h(df)), {k: a[:, ::-1] for k, a in pages.items()})
    same(to_arrays(geometry.flip_v(df)), {k: a[::-1] for k, a in pages.items()})
    want = {k: a[(np.arange(7) * a.shape[0]) // 7][:, (np.arange(9) * a.shape[1]) // 9] for k, a in pages.items()}
    same(to_arrays(geometry.resize_nearest(df, 9, 7)), want)


def test_wide_rotation_crosses_tiles(spark):
    pages = {1: lcg(70, 5, "Rgb8")}
    same(to_arrays(geometry.rotate(to_df(spark, pages), 90)), {1: np.rot90(pages[1], 3).copy()})


def test_round_trips(spark, pages):
    df = to_df(spark, pages)
    same(to_arrays(raster.to_strips(raster.strips_to_pages(df))), pages)
    shape = df.where("y = 0").select("page_id", "width", "height", "bpp")
    same(to_arrays(raster.from_pixels(raster.to_pixels(df), shape)), pages)


def test_alpha_is_refused_not_ignored(spark):
    df = to_df(spark, {1: lcg(4, 4, "Rgba8")})
    for op in (tone.desaturate, tone.white_balance, lambda s: tone.saturation(s, 10), lambda s: tone.hue_shift(s, 10)):
        with pytest.raises(Exception, match="unsupported pixel format"):
            op(df).collect()
    good, bad = raster.split_supported(df, "desaturate")
    assert good.count() == 0 and bad.count() == 4


def test_gray_passes_colour_operators(spark):
    pages = {1: lcg(6, 4, "Gray8")}
    df = to_df(spark, pages)
    for op in (tone.desaturate, tone.white_balance, tone.restore_colors, tone.restore_fading, lambda s: tone.hue_shift(s, 30)):
        same(to_arrays(op(df)), pages)


def test_auto_levels_ignores_alpha(spark):
    page = np.array([[[10, 10, 10, 255], [100, 100, 100, 255], [200, 200, 200, 255]]])
    got = to_arrays(tone.auto_levels(to_df(spark, {1: page}), 0.5))[1]
    assert got[0, :, 0].tolist() == [0, 121, 255] and got[0, :, 3].tolist() == [255] * 3


def test_single_value_channel_fades_to_zero(spark):
    page = np.full((4, 4, 3), 255)
    page[..., 1:] = lcg(4, 4, "Rgb8")[..., 1:]
    points = tone.fading_points(to_df(spark, {1: page})).first()
    assert (points["_low0"], points["_high0"]) == (255, 255)
    assert (to_arrays(tone.restore_fading(to_df(spark, {1: page})))[1][..., 0] == 0).all()


def test_hole_punch_fills_dark_corner(spark):
    page = np.full((40, 40, 1), 200)
    page[:2, :2] = 5
    page[20, 20] = 5
    got = to_arrays(filters.hole_punch(to_df(spark, {1: page})))[1]
    assert (got[:2, :2] == 245).all() and got[20, 20, 0] == 5


def test_skew_is_found_and_removed(spark):
    page = np.full((300, 400, 1), 255)
    for base in (60, 110, 160, 210):
        for x in range(20, 380):
            y = base + int(round(x * np.tan(np.radians(3.0))))
            page[y : y + 2, x] = 0
    df = to_df(spark, {1: page})
    assert abs(geometry.skew_estimate(df).first()["angle"] - 3.0) <= 0.5
    straight = geometry.auto_deskew(df)
    assert abs(geometry.skew_estimate(straight).first()["angle"]) <= 0.5


def test_small_pages_have_no_skew(spark):
    assert geometry.skew_estimate(to_df(spark, {1: lcg(7, 40, "Gray8")})).first()["angle"] == 0.0


def test_empty_page_keeps_full_frame(spark):
    box = geometry.auto_crop_bounds(to_df(spark, {1: np.full((5, 9, 1), 255)})).first()
    assert (box["x"], box["y"], box["w"], box["h"], box["confidence"], box["method"]) == (0, 0, 9, 5, 0.0, "full-frame-empty")


def test_orientation_of_stripes(spark):
    """Stripes across have all their change down the page, so they are turned; stripes of one line have none that the gradient sees."""
    two = np.where(np.arange(40)[:, None, None] % 4 < 2, 255, 0) + np.zeros((40, 40, 1), dtype=np.int64)
    one = np.where(np.arange(40)[:, None, None] % 2 < 1, 255, 0) + np.zeros((40, 40, 1), dtype=np.int64)
    pages = {1: two, 2: two.transpose(1, 0, 2), 3: one, 4: one.transpose(1, 0, 2)}
    found = geometry.orientation_detect(to_df(spark, pages)).orderBy("page_id").collect()
    assert [r["degrees"] for r in found] == [90, 0, 0, 0]
    assert geometry.orientation_detect(to_df(spark, {3: lcg(2, 9, "Gray8")})).first()["method"] == "too-small"


def test_orientation_moves_each_line_once_as_bytes(spark):
    """One join brings the degrees, its shuffled lines serve turned and other pages, and no shuffled row holds integers."""
    pages = {1: np.where(np.arange(40)[:, None, None] % 4 < 2, 255, 0) + np.zeros((40, 70, 3), dtype=np.int64), 2: lcg(7, 150, "Gray8"), 3: lcg(2, 9, "Rgb8")}
    pages[4] = np.linspace(0, 90, 50).astype(np.int64)[:, None, None] + np.where(np.arange(40)[None, :, None] % 4 < 2, 90, 0)
    df = to_df(spark, pages)
    degrees = {r.page_id: r.degrees for r in geometry.orientation_detect(df).collect()}
    assert degrees[1] == 90 and degrees[4] == 180
    out = geometry.orientation_apply(df)
    same(to_arrays(out), {k: np.rot90(a, -degrees[k] // 90) for k, a in pages.items()})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "collect_list" not in plan
    joined = out._jdf.queryExecution().optimizedPlan().toString()
    assert joined.count("LeftOuter") == 2 and "Inner" not in joined


def test_crop_outside_is_reported(spark):
    df = to_df(spark, {1: lcg(5, 5, "Gray8"), 2: lcg(9, 9, "Gray8")})
    assert [r["page_id"] for r in geometry.crop_rejected(df, 4, 4, 3, 3).collect()] == [1]
    same(to_arrays(geometry.crop(df, 4, 4, 3, 3)), {2: lcg(9, 9, "Gray8")[4:7, 4:7]})


@pytest.mark.parametrize("band_rows", [4, 5, 64])
def test_components_against_flood_fill(spark, band_rows):
    pages = {n: lcg(31, 29, "Gray8", 7 + n) for n in range(6)}
    limit = 150
    got = textlayer.ink_components(to_df(spark, pages), limit, band_rows).collect()
    for n, a in pages.items():
        mine = {(r["x0"], r["y0"], r["x1"], r["y1"]) for r in got if r["page_id"] == n}
        assert mine == components(a[..., 0] < limit)


def test_components_of_a_long_snake(spark):
    page = np.full((41, 12, 1), 255)
    for y in range(0, 41, 2):
        page[y, 1:11] = 0
    for k, y in enumerate(range(1, 41, 2)):
        page[y, 10 if k % 2 == 0 else 1] = 0
    page[5:9, 0] = 255
    runs = textlayer.band_labels(textlayer.ink_runs(to_df(spark, {1: page})), 4)
    merged = textlayer.merge_labels(textlayer.seam_edges(runs, 4))
    assert merged.select("label").distinct().count() == 1


def test_it8_chart_gives_unit_gains(spark):
    ref = profile.it8_reference(spark).orderBy("patch").collect()
    page = np.zeros((50, 60, 3), dtype=np.int64)
    for n, r in enumerate(ref):
        y, x = divmod(n, 6)
        page[y * 10 : y * 10 + 10, x * 10 : x * 10 + 10] = byte(np.array([r["ref_r"], r["ref_g"], r["ref_b"]]) * 255)
    fit = profile.it8_profile(to_df(spark, {1: page, 2: np.zeros_like(page)})).orderBy("page_id").collect()
    assert all(abs(fit[0][f"gain_{n}"] - 1.0) < 0.01 for n in "rgb") and fit[0]["error"] is None
    assert fit[1]["gain_r"] is None and fit[1]["error"] is not None


def test_patch_means_of_other_pages_are_errors(spark):
    df = to_df(spark, {1: lcg(60, 50, "Rgb8"), 2: lcg(60, 50, "Gray8"), 3: lcg(6, 5, "Rgba8")})
    got = profile.it8_patch_means(df).collect()
    assert sorted((r.page_id, r.patch) for r in got if r.error is None) == [(1, k) for k in range(30)]
    assert sorted((r.page_id, r.patch, r.mean_r) for r in got if r.error) == [(2, None, None), (3, None, None)]


def test_plan_order_and_disabled_stages(spark):
    page = {1: lcg(6, 4, "Rgb8")}
    df = to_df(spark, page)
    same(to_arrays(page_plan.process_pages(df, {})), page)
    cropped = page[1][0:2, 1:5]
    want = np.rot90(cropped, 3)[:, ::-1][::-1]
    same(to_arrays(page_plan.process_pages(df, dict(crop=(1, 0, 4, 2), rotate=90, flip_h=True, flip_v=True))), {1: want})
    assert [n for n, _, _ in page_plan.plan_stages(dict(infrared_clean="off", film_type=" None "))] == []
    with pytest.raises(ValueError):
        page_plan.process_pages(df, {"blur": 1})


CHAINS = [
    dict(brightness=-8, contrast=20, levels_black=9, levels_white=230, white_balance=True, curves=[[0, 10], [90, 70], [255, 250]], auto_levels=True, invert=True),
    dict(white_balance=True, saturation=20.0, auto_levels=True, restore_fading=True, flatten=True),
    dict(auto_levels=True, sharpen_amount=0.5, restore_fading=True),
    dict(contrast=100, white_balance=True, restore_fading=True),
]


@pytest.mark.parametrize("plan", CHAINS)
def test_chains_equal_single_stages(spark, plan):
    """Statistics taken from pushed counts give what taking them from the samples gives."""
    pages = {1: lcg(9, 14, "Rgb8"), 2: lcg(7, 5, "Gray8"), 3: np.zeros((4, 6, 3), np.int64), 4: np.full((5, 5, 3), 255), 5: np.full((3, 4, 1), 77), 6: lcg(30, 20, "Rgb8", 5) // 3 + 60}
    pages[7] = pages[1].copy()
    pages[7][..., 1] = 0
    df = to_df(spark, pages)
    one_by_one = df
    for _, _, transform in page_plan.plan_stages(plan):
        one_by_one = transform(one_by_one)
    same(to_arrays(page_plan.process_pages(df, plan)), to_arrays(one_by_one))


def test_chains_write_only_tables(spark, monkeypatch):
    """No samples are checkpointed for stages that map values, whatever their statistics."""
    cut = []

    def spy(module):
        kept = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df: cut.append(df.columns) or kept(df))

    spy(tables)
    spy(page_plan)
    df = to_df(spark, {1: lcg(9, 14, "Rgb8")})
    page_plan.process_pages(df, {**CHAINS[0], **CHAINS[1]})
    assert cut == [["page_id", "tables"]] * 2
    cut.clear()
    page_plan.process_pages(df, dict(rotate=90, auto_levels=True, saturation=9.0, restore_fading=True))
    assert [c == ["page_id", "tables"] for c in cut] == [False, True]


def test_plan_moves_and_writes_lines_as_bytes(spark, monkeypatch):
    """Samples are written as deflated stretches, the tables of two chains meet the lines in one join, small pages take few copies."""
    cut = []
    kept = page_plan.cut_lineage
    monkeypatch.setattr(page_plan, "cut_lineage", lambda df: cut.append(df) or kept(df))
    pages = {1: lcg(9, 150, "Rgb8"), 2: lcg(70, 9, "Rgb8", 7), 3: lcg(5, 3, "Gray8")}
    out = page_plan.process_pages(to_df(spark, pages), dict(rotate=90, white_balance=True, saturation=-30.0, auto_levels=True))
    assert not [f.name for f in cut[0].schema.fields if f.dataType.simpleString() == "array<int>"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 1
    one_by_one = to_df(spark, {k: np.rot90(a, 3) for k, a in pages.items()})
    for _, _, transform in page_plan.plan_stages(dict(white_balance=True, saturation=-30.0, auto_levels=True)):
        one_by_one = transform(one_by_one)
    same(to_arrays(out), to_arrays(one_by_one))


def test_pages_sharing_a_key_are_turned_as_before(spark):
    """Lines of one number stand beside each other in order of their samples."""
    a, b = lcg(35, 4, "Rgb8"), lcg(35, 4, "Rgb8", 9)
    df = to_df(spark, {1: a}).unionByName(to_df(spark, {1: b})).repartition(3)
    for degrees in (90, 270):
        got = {r.y: r.row for r in geometry.rotate(df, degrees).collect()}
        for x in range(35):
            tile = slice(x // 32 * 32, x // 32 * 32 + 32)
            lines = sorted(((y, p[y, tile].reshape(-1).tolist(), p[y, x].tolist()) for p in (a, b) for y in range(4)), reverse=degrees == 90)
            assert got[x if degrees == 90 else 34 - x] == [v for *_, px in lines for v in px]


def test_alpha_pages_are_refused_in_chains(spark):
    df = to_df(spark, {1: lcg(4, 4, "Rgba8")})
    with pytest.raises(Exception, match="white_balance"):
        page_plan.process_pages(df, dict(white_balance=True, invert=True)).collect()
    out = to_arrays(page_plan.process_pages(df, dict(auto_levels=True, invert=True)))[1]
    assert (out[..., 3] == lcg(4, 4, "Rgba8")[..., 3]).all()


def test_pages_in_are_pages_out_or_rejected(spark):
    df = to_df(spark, {n: lcg(4 + n, 5 + n, "Gray8") for n in range(8)})
    plans = spark.createDataFrame([(n, t) for n, t in enumerate(['{"crop": [1, 1, 7, 8]}'] * 4 + ['{"crop": [0, -1, 2, 2]}', None, "{}"])], "page_id int, prefs string")
    pages, rejects = page_plan.process_by_plan(df, plans, group=1)
    done = {r.page_id for r in pages.select("page_id").distinct().collect()}
    gone = {r.page_id: r.reason for r in rejects.collect()}
    assert done | set(gone) == set(range(8)) and not done & set(gone) and gone[4] == "invalid crop region" and len(gone) > 2
    out, _, bad = page_plan.page_kernel(df, {"crop": [1, 1, 7, 8], "invert": True})
    assert {r.page_id for r in out.collect()} ^ {r.page_id for r in bad.collect()} == set(range(8))


def test_user_transform_hook(spark):
    page = {1: lcg(6, 4, "Gray8")}
    got = page_plan.page_transform(to_df(spark, page), lambda s: s.withColumn("row", F.transform("row", lambda v: v * 0 + 7)))
    assert (to_arrays(got)[1] == 7).all()
    with pytest.raises(ValueError):
        page_plan.page_transform(to_df(spark, page), lambda s: s.drop("row"))


def turned(a: np.ndarray, angle: float) -> np.ndarray:
    """Nearest inverse mapping on an enlarged white canvas, sample by sample."""
    h, w, _ = a.shape
    cos, sin = np.cos(np.radians(angle)), np.sin(np.radians(angle))
    cx, cy = (w - 1) / 2, (h - 1) / 2
    corners = [(x - cx, y - cy) for x in (0, w - 1) for y in (0, h - 1)]
    xs, ys = [cos * x - sin * y for x, y in corners], [sin * x + cos * y for x, y in corners]
    wide, tall = int(np.ceil(max(xs) - min(xs) + 1)), int(np.ceil(max(ys) - min(ys) + 1))
    dx, dy = np.meshgrid(np.arange(wide) - (wide - 1) / 2, np.arange(tall) - (tall - 1) / 2)
    sx, sy = half_away(cos * dx + sin * dy + cx).astype(int), half_away(-sin * dx + cos * dy + cy).astype(int)
    inside = (sx >= 0) & (sx < w) & (sy >= 0) & (sy < h)
    return np.where(inside[..., None], a[np.clip(sy, 0, h - 1), np.clip(sx, 0, w - 1)], 255)


def test_deskew_across_bands(spark):
    """Wide, high and small pages at flat and steep angles; a page without an angle stays."""
    shapes = {1: (150, 40, "Rgb8", 7.3), 2: (30, 200, "Gray8", -41.0), 3: (70, 130, "Rgba8", 0.4), 4: (3, 2, "Gray8", 133.7), 5: (5, 9, "Rgb8", 0.01), 6: (9, 90, "Gray8", None)}
    pages = {i: lcg(w, h, fmt, i) for i, (w, h, fmt, _) in shapes.items()}
    angles = spark.createDataFrame([(i, s[3]) for i, s in shapes.items() if i != 6], "page_id bigint, angle double")
    got = to_arrays(geometry.deskew(to_df(spark, pages), angles))
    assert set(got) == set(pages)
    for i, (_, _, _, angle) in shapes.items():
        want = turned(pages[i], angle) if angle and abs(angle) >= 0.05 else pages[i]
        assert got[i].shape == want.shape and (got[i] == want).all(), i


def test_deskew_moves_bands_not_runs(spark):
    """What travels to the target lines is a row per stretch of lines and band, not per run of a line."""
    df = to_df(spark, {1: lcg(256, 128, "Gray8")})
    plan = geometry.deskew_by(df, 30.0)._jdf.queryExecution().optimizedPlan().toString()
    assert "_turned_runs" in plan and "x0" not in plan


@pytest.mark.parametrize("band_rows", [4, 64])
def test_glyphs_across_bands(spark, band_rows):
    """Boxes lower and higher than a band, also twice and beyond the lines of a page; the ink is counted cell by cell."""
    pages = {1: lcg(40, 61, "Gray8", 3), 2: lcg(23, 70, "Rgb8", 4)}
    rows = [(1, 0, 0, 5, 7), (1, 3, 2, 10, 40), (1, 20, 30, 24, 33), (2, 1, 60, 9, 70), (2, 1, 60, 9, 70), (2, 4, 1, 23, 69), (2, 0, 200, 5, 210), (3, 0, 0, 5, 7)]
    boxes = spark.createDataFrame(rows, "page_id bigint, x0 int, y0 int, x1 int, y1 int")
    got = {tuple(r)[:5]: (r.ch, r.same) for r in textlayer.glyph_match(to_df(spark, pages), boxes, 128, band_rows).collect()}
    assert set(got) == {r for r in rows if r[0] != 3 and r[2] != 200}
    for (page, x0, y0, x1, y1), found in got.items():
        a = pages[page]
        ink = (a[..., 0] if a.shape[2] == 1 else (a @ np.array([77, 150, 29])) >> 8) < 128
        mask = 0
        for z in range(7):
            for c in range(5):
                top, left = z * (y1 - y0) // 7, c * (x1 - x0) // 5
                low, right = max((z + 1) * (y1 - y0) // 7, top + 1), max((c + 1) * (x1 - x0) // 5, left + 1)
                n = int(ink[y0 + top : y0 + low, x0 + left : x0 + right].sum()) * rows.count((page, x0, y0, x1, y1))
                mask |= (n * 2 > (low - top) * (right - left)) << (z * 5 + c)
        want = max((35 - bin(mask ^ m).count("1"), n, ch) for n, (ch, m) in enumerate(glyph_bits()))
        assert found == (want[2], want[0])


def test_glyphs_and_components_move_bits(spark):
    """Lines travel as one bit per pixel; neither a line of a box nor a run inside a band is a row of its own."""
    df = to_df(spark, {1: np.full((64, 64, 1), 0)})
    boxes = spark.createDataFrame([(1, 0, 0, 60, 60)], "page_id bigint, x0 int, y0 int, x1 int, y1 int")
    plan = textlayer.glyph_match(df, boxes)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 0 and "aggregate(" not in plan
    part = textlayer.band_parts(to_df(spark, {1: np.where(np.arange(64 * 64).reshape(64, 64, 1) % 2, 255, 0)}), 128, 64)
    assert part.selectExpr("sum(size(seams) / 3)").first()[0] == 64
