"""What moves or is written by raster queries: packed stretches and sums, not a row per line, component or sample."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from rasters import byte, components, lcg, to_arrays, to_df

from foliomill.functions import lines
from foliomill.operators import filters, geometry, manifest, raster, textlayer, tone
from foliomill.plans import page_plan


@pytest.fixture
def cut(monkeypatch):
    """The frames that ink_components writes."""
    frames = []
    kept = textlayer.cut_lineage
    monkeypatch.setattr(textlayer, "cut_lineage", lambda df: frames.append(out := kept(df)) or out)
    return frames


def test_components_inside_a_band_are_not_rows(spark, cut):
    """Twelve blocks of a band are one written row; only the block across two bands goes on as its two parts."""
    page = np.full((128, 90, 1), 255)
    want = set()
    for k in range(12):
        y, x = 5 + k // 6 * 20, 3 + k % 6 * 14
        page[y : y + 5, x : x + 4] = 0
        want.add((x, y, x + 4, y + 5))
    page[60:70, 10:14] = 0
    got = textlayer.ink_components(to_df(spark, {1: page})).collect()
    assert {tuple(r)[1:] for r in got} == want | {(10, 60, 14, 70)} == components(page[..., 0] < 128)
    assert cut[0].count() == 3


def test_lines_of_a_band_move_as_one_row(spark):
    strips = to_df(spark, {1: lcg(30, 130, "Gray8")}).coalesce(1).sortWithinPartitions("y")
    got = textlayer.ink_stretches(strips).orderBy("y").collect()
    assert [(r.y, r._band, r.lines, r.size, len(r.ink)) for r in got] == [(0, 0, 64, 30, 256), (64, 1, 64, 30, 256), (128, 2, 2, 30, 8)]


@pytest.mark.parametrize("other", [0, 40])
def test_components_of_pages_that_share_a_key(spark, cut, other):
    """Equal pages give each box once; the boxes of pages of other heights are told apart by what may be kept of them."""
    page = np.full((66 + other, 40, 1), 255)
    page[2:6, 3:9] = 0
    page[60:66, 20:25] = 0
    df = to_df(spark, {1: page[:66]}).unionByName(to_df(spark, {1: page})).repartition(3)
    got = sorted(tuple(r)[1:] for r in textlayer.ink_components(df).collect())
    assert got == sorted([(3, 2, 9, 6), (20, 60, 25, 66)] * (2 if other else 1))


def test_components_of_pages_without_a_key(spark):
    """Boxes of null keys stay in their bands, as seams meet by key."""
    page = np.full((70, 40, 1), 255)
    page[2:6, 3:9] = 0
    page[58:70, 20:25] = 0
    df = to_df(spark, {1: page}).withColumn("page_id", F.lit(None).cast("bigint"))
    got = {tuple(r) for r in textlayer.ink_components(df).collect()}
    assert got == {(None, 3, 2, 9, 6), (None, 20, 58, 25, 64), (None, 20, 64, 25, 70)}


def faded(page: np.ndarray) -> np.ndarray:
    """Fading restored sample by sample."""
    out = []
    for c in range(3):
        v = np.sort(page[..., c].reshape(-1))
        clip = max(int(len(v) * 0.005), 1)
        low, high = (int(v[clip]), int(v[-1 - clip])) if len(v) > clip else (0, 255)
        high = high if high > low else min(low + 1, 255)
        out.append(byte(np.clip((page[..., c] - low) / (high - low), 0, 1) * 255) if high > low else np.zeros(page.shape[:2], np.int64))
    means = [o.mean() for o in out]
    gains = [1.0] * 3 if min(means) < 1e-6 else [(sum(means) / 3 / m - 1) * 0.85 + 1 for m in means]
    return np.stack([byte(o * g) for o, g in zip(out, gains)] + [page[..., k] for k in range(3, page.shape[2])], axis=2)


def test_fading_against_the_formula(spark):
    pages = {1: lcg(9, 140, "Rgb8") // 2 + 40, 2: lcg(7, 5, "Rgba8", 3), 3: lcg(6, 6, "Gray8"), 4: np.full((3, 4, 3), 255), 5: lcg(30, 20, "Rgb8", 5) // 3, 6: lcg(1, 1, "Rgb8")}
    got = to_arrays(tone.restore_fading(to_df(spark, pages)))
    assert set(got) == set(pages)
    for n, a in pages.items():
        assert (got[n] == (a if n == 3 else faded(a))).all(), n


def test_fading_of_pages_that_share_a_key(spark):
    """Counts are those of all colour lines of a key; its gray lines stay; lines without a key stay."""
    a, b, gray = lcg(8, 6, "Rgb8") // 2, lcg(8, 6, "Rgb8", 7) // 2 + 90, lcg(8, 3, "Gray8")
    df = to_df(spark, {1: a}).unionByName(to_df(spark, {1: b})).unionByName(to_df(spark, {1: gray}))
    df = df.unionByName(to_df(spark, {1: a}).withColumn("page_id", F.lit(None).cast("bigint")))
    got = [(r.page_id, r.bpp, r.y, r.row) for r in tone.restore_fading(df).collect()]
    both = faded(np.concatenate([a, b]))
    want = [(1, 3, n % 6, row.reshape(-1).tolist()) for n, row in enumerate(both)] + [(1, 1, n, row.reshape(-1).tolist()) for n, row in enumerate(gray)]
    want += [(None, 3, n, row.reshape(-1).tolist()) for n, row in enumerate(a)]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_fading_moves_neither_values_nor_lines(spark):
    """Counts of a page and its stretches are shuffled, and no window runs over its values."""
    plan = tone.restore_fading(to_df(spark, {1: lcg(9, 14, "Rgb8")}))._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "_packed" not in plan and "transform" not in plan
    moved = [line for line in plan.splitlines() if "RepartitionByExpression" in line or "Join" in line]
    assert moved and not [line for line in moved if "row" in line or "[v" in line]


def test_functions_in_a_row_are_one_step(spark):
    """A line does not leave the Python process between functions of batches."""
    strips = to_df(spark, {1: lcg(9, 14, "Rgb8"), 2: lcg(5, 4, "Rgba8")})
    table = [(v * 7 + 3) % 256 for v in range(256)]
    out = tone.apply_lut(tone.apply_lut(strips, table), table)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    twice = np.array(table)[np.array(table)]
    got = to_arrays(out)
    assert (got[1] == twice[lcg(9, 14, "Rgb8")]).all()
    assert (got[2][..., :3] == twice[lcg(5, 4, "Rgba8")[..., :3]]).all() and (got[2][..., 3] == lcg(5, 4, "Rgba8")[..., 3]).all()
    kept = tone.apply_lut(strips, table).cache()
    assert "InMemoryRelation" in tone.apply_lut(kept, table)._jdf.queryExecution().withCachedData().toString()
    kept.unpersist()


def test_cut_pages_keep_odd_contents(spark):
    """Contents shorter or longer than the page, null ones, unknown formats and pages without lines."""
    rows = [(1, 2, 3, "Gray8", b"abcde"), (2, 2, 2, "Gray8", b"abcdefgh"), (3, 2, 2, "Cmyk", b"abcd"), (4, 2, 2, "Gray8", None), (5, 2, None, "Gray8", b"ab"), (6, 2, 0, "Gray8", b"ab"), (None, 1, 1, "Rgb8", b"abc")]
    pages = spark.createDataFrame(rows, "page_id bigint, width int, height int, fmt string, content binary")
    got = [tuple(r) for r in raster.to_strips(pages).collect()]
    assert got == [
        (1, 2, 3, 1, 0, [97, 98]), (1, 2, 3, 1, 1, [99, 100]), (1, 2, 3, 1, 2, [101]), (2, 2, 2, 1, 0, [97, 98]), (2, 2, 2, 1, 1, [99, 100]),
        (3, 2, 2, None, 0, []), (3, 2, 2, None, 1, []), (4, 2, 2, 1, 0, []), (4, 2, 2, 1, 1, []), (None, 1, 1, 3, 0, [97, 98, 99]),
    ]


def thumbnail(page: np.ndarray, cell_width: int, cell_height: int) -> np.ndarray:
    """Area-weighted means of the source samples under each target sample, in whole numbers."""
    h, w, _ = page.shape
    if w * cell_height >= h * cell_width:
        tw, th = cell_width, min(max((h * cell_width + w // 2) // w, 1), cell_height)
    else:
        tw, th = min(max((w * cell_height + h // 2) // h, 1), cell_width), cell_height
    share = lambda n, t: np.array([[max(min((s + 1) * t, (k + 1) * n) - max(s * t, k * n), 0) for s in range(n)] for k in range(t)])
    total = np.einsum("ys,xt,stc->yxc", share(h, th), share(w, tw), page)
    return (total * 2 + w * h) // (w * h * 2)


@pytest.mark.parametrize("cell", [(12, 9), (5, 40), (400, 30), (1, 1)])
def test_thumbnails_against_the_formula(spark, cell):
    """Smaller and larger than the page, of one and several blocks of target lines, from lines in any order."""
    pages = {1: lcg(31, 70, "Rgb8"), 2: lcg(5, 3, "Gray8"), 3: lcg(7, 9, "Rgba8"), 4: lcg(1, 50, "Gray8"), 5: lcg(64, 1, "Rgb8"), 6: lcg(31, 70, "Rgb8", 9)}
    got = {}
    for r in manifest.thumbnails(to_df(spark, pages).repartition(4, "y"), *cell).collect():
        got.setdefault(r.page_id, {})[r.y, r.x, r.c] = (r.v, r.width, r.height)
    assert set(got) == set(pages)
    for n, a in pages.items():
        want = thumbnail(a, *cell)
        assert got[n] == {at: (v, want.shape[1], want.shape[0]) for at, v in np.ndenumerate(want)}, n


def test_thumbnails_of_shared_keys_and_missing_lines(spark):
    """Pages of one key and size are added up; target lines that no line feeds are none."""
    page = lcg(24, 18, "Gray8")
    df = to_df(spark, {1: page, 2: page, 3: page}).unionByName(to_df(spark, {1: page, 3: page}))
    df = df.withColumn("page_id", F.when(F.col("page_id") < 3, F.col("page_id"))).where("page_id <> 2 OR page_id IS NULL OR y >= 12")
    got = {(r.page_id, r.y, r.x): r.v for r in manifest.thumbnails(df, 12, 9).collect()}
    total = page[..., 0].reshape(9, 2, 12, 2).sum(axis=(1, 3))
    want = {(n, y, x): (k * total[y, x] * 2 + 4) // 8 for n, k in ((1, 2), (None, 2), (2, 1)) for y in range(9) for x in range(12) if n != 2 or y >= 6}
    assert got == want


def test_thumbnails_move_sums_of_blocks(spark):
    """A page of one batch is one shuffled row, and no sample is a row or a lambda's variable before it."""
    strips = to_df(spark, {n: lcg(24, 18, "Rgb8", n) for n in range(5)}).coalesce(1)
    plan = manifest.thumbnails(strips, 12, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "explode" not in plan and "aggregate(" not in plan and plan.count("RepartitionByExpression") == 1
    moved = next(line for line in plan.splitlines() if "RepartitionByExpression" in line)
    assert "sums" in moved or "block" in moved


def test_mirrored_lines_of_all_layouts(spark):
    """Layouts in one batch; of a colour line longer than its page only the first pixels stay."""
    pages = {1: lcg(5, 3, "Gray8"), 2: lcg(7, 4, "Rgb8"), 3: lcg(3, 5, "Rgba8"), 4: lcg(1, 1, "Rgb8")}
    for some in (pages, {2: pages[2], 4: pages[4]}):
        got = to_arrays(geometry.flip_h(to_df(spark, some).coalesce(1)))
        assert set(got) == set(some) and all((got[n] == a[:, ::-1]).all() for n, a in some.items())
    rows = [(1, 2, 1, 3, 0, list(range(9))), (2, 2, 1, 1, 0, [1, 2, 3]), (3, 3, 1, 3, 0, [1, 2, 3, 4, 5]), (4, 2, 1, 3, 0, None), (5, 1, 1, 3, 0, [1, None, 3])]
    odd = spark.createDataFrame(rows, "page_id bigint, width int, height int, bpp int, y int, row array<int>")
    assert [r.row for r in geometry.flip_h(odd).orderBy("page_id").collect()] == [[3, 4, 5, 0, 1, 2], [3, 2, 1], [4, 5, 1, 2, 3], None, [1, None, 3]]


def test_filters_of_pages_that_share_a_key(spark):
    """Lines of one number follow each other, also across bands."""
    page = lcg(6, 70, "Rgb8")
    df = to_df(spark, {1: page}).unionByName(to_df(spark, {1: page})).repartition(3)
    twice = np.repeat(page, 2, axis=0).astype(float)
    wide = np.pad(twice, ((1, 1), (1, 1), (0, 0)), mode="edge")
    want = byte(1.5 * twice - 0.125 * (wide[1:-1, :-2] + wide[1:-1, 2:] + wide[:-2, 1:-1] + wide[2:, 1:-1]))
    got = filters.sharpen(df, 0.5).withColumn("height", F.lit(70)).collect()
    assert sorted((r.y, r.row) for r in got) == sorted((n // 2, line.reshape(-1).tolist()) for n, line in enumerate(want))


def test_plan_takes_lines_out_of_stretches_once(spark):
    """Stages between two shuffles are one step: no line is a row of Spark's, a lambda's variable or packed on its own."""
    pages = {1: lcg(9, 150, "Rgb8"), 2: lcg(70, 9, "Rgb8", 7), 3: lcg(5, 3, "Rgb8")}
    prefs = dict(rotate=90, flip_h=True, white_balance=True, saturation=-30.0, auto_levels=True, invert=True, sharpen_amount=0.8, flatten=True)
    out = page_plan.process_pages(to_df(spark, pages), prefs)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    # Stretches with their tables to bands, bands to lines.
    assert plan.count("MapInArrow") == 2 and "transform(" not in plan and "explode(array" not in plan
    one_by_one = to_df(spark, pages)
    for _, _, transform in page_plan.plan_stages(prefs):
        one_by_one = transform(one_by_one)
    want, got = to_arrays(one_by_one), to_arrays(out)
    assert set(got) == set(pages) and all((got[n] == want[n]).all() for n in pages)


def test_written_stretches_are_not_made_again(spark):
    strips = to_df(spark, {1: lcg(9, 150, "Rgb8")})
    stretches = lines.blocks(strips, 64)
    assert lines.blocks(lines.lines_of(stretches, band=64), 64) is stretches
    assert lines.blocks(lines.lines_of(stretches, band=64), 32) is not stretches
    assert lines.blocks(tone.invert(lines.lines_of(stretches, band=64)), 64) is not stretches


def test_small_batches_are_put_together():
    """What steps hand on is of about one size, in order."""
    some = [pa.RecordBatch.from_pydict({"n": pa.array(np.arange(at, at + n))}) for at, n in ((0, 3), (3, 0), (3, 5), (8, 2_000_000), (2_000_008, 4))]
    got = list(lines._pieces(iter(some)))
    assert np.array_equal(np.concatenate([b["n"].to_numpy() for b in got]), np.arange(2_000_012))
    assert got[0].num_rows == 8 and max(b.nbytes for b in got) <= lines.BATCH_BYTES


def test_counts_of_all_widths(spark):
    """Counts of a byte, two and four; the tables come from their sums."""
    pages = {1: np.full((600, 300, 1), 90), 2: np.full((40, 30, 1), 70), 3: lcg(9, 14, "Gray8")}
    pages[1][:3] = 20
    got = to_arrays(tone.auto_levels(to_df(spark, pages)))
    out = to_arrays(page_plan.process_pages(to_df(spark, pages), dict(auto_levels=True)))
    assert all((got[n] == out[n]).all() for n in pages)
