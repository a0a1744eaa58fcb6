"""Registered queries over page rasters, each with its SQL counterpart."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..constants import film_profiles
from ..functions.scale import lookup_join
from ..operators import film, filters, geometry, profile, raster, tone
from .fixtures import (
    LUMA_SQL, byte_sql, checksum_sql, page_strips, px_sql, rgb_sql, spread_samples, table, text_pages, unrgb_sql,
)

QUERIES: dict = {}
SQL: dict = {}


def _register(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def _checked(name, transform, sql_middle, fmt="Rgb8", bpp_out=None):
    """Query = checksum of ``transform`` over whole pages."""
    bpp = {"Gray8": 1, "Rgb8": 3, "Rgba8": 4}[fmt] if bpp_out is None else bpp_out
    _register(
        name,
        lambda spark, sf: raster.page_checksum(transform(page_strips(spark, sf, fmt))),
        px_sql(fmt) + "," + sql_middle + checksum_sql(bpp),
    )


def _map_sql(expr: str, where_alpha: str = "") -> str:
    value = f"CASE WHEN c = 3 THEN v ELSE {expr} END"
    return f"\nout AS (SELECT page_id, width, height, y, x, c, {value} AS v FROM px)"


# --- form conversions ------------------------------------------------------

_register(
    "to_strips",
    lambda spark, sf: raster.page_checksum(raster.to_strips(text_pages(spark, sf, "Rgb8"))),
    px_sql("Rgb8", spread=False) + checksum_sql(3, "px"),
)
_register(
    "to_pixels",
    lambda spark, sf: raster.to_pixels(page_strips(spark, sf))
    .groupBy("page_id", "c")
    .agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("v").alias("sum_v"),
        F.sum(F.col("v") * F.col("x")).cast("bigint").alias("sum_vx"),
        F.sum(F.col("v").cast("bigint") * F.col("y")).alias("sum_vy"),
    ),
    px_sql() + """
SELECT page_id, c, count(*) AS n, CAST(sum(v) AS BIGINT) AS sum_v, CAST(sum(v * x) AS BIGINT) AS sum_vx,
       CAST(sum(CAST(v AS BIGINT) * y) AS BIGINT) AS sum_vy FROM px GROUP BY page_id, c""",
)


def _round_trip(spark, sf):
    strips = page_strips(spark, sf)
    shape = strips.where("y = 0").select("page_id", "width", "height", "bpp")
    return raster.page_checksum(raster.from_pixels(raster.to_pixels(strips), shape))


_register("from_pixels", _round_trip, px_sql() + checksum_sql(3, "px"))


def _repack(spark, sf):
    packed = raster.strips_to_pages(page_strips(spark, sf))
    return packed.select("page_id", "width", "height", "fmt", F.md5("content").alias("content_md5"))


_register(
    "strips_to_pages",
    _repack,
    px_sql() + """
SELECT page_id, CAST(width AS INT) AS width, CAST(height AS INT) AS height, 'Rgb8' AS fmt,
       md5(unhex(string_agg(printf('%02X', v), '' ORDER BY y, x, c))) AS content_md5
FROM px GROUP BY page_id, width, height""",
)
_checked(
    "to_luma",
    raster.to_luma,
    rgb_sql() + f",\nout AS (SELECT page_id, width, height, y, x, 0 AS c, {LUMA_SQL} AS v FROM rgb)",
    bpp_out=1,
)
_checked("to_rgb", raster.to_rgb, "\nout AS (SELECT page_id, width, height, y, x, unnest([0, 1, 2]) AS c, v FROM px)", "Gray8", 3)
_checked(
    "to_rgba",
    raster.to_rgba,
    "\nout AS (SELECT * FROM px UNION ALL SELECT page_id, width, height, y, x, 3, 255 FROM px WHERE c = 0)",
    "Rgb8",
    4,
)
_checked(
    "page_ingest",
    raster.over_white,
    rgb_sql() + "," + unrgb_sql("rgb", *[f"({n} * a + 255 * (255 - a) + 127) // 255" for n in "rgb"]),
    "Rgba8",
    3,
)
_register(
    "page_quarantine",
    lambda spark, sf: raster.unsupported_pages(page_strips(spark, sf, "Rgba8")),
    px_sql("Rgba8") + """, ops AS (SELECT unnest(['desaturate','white_balance','saturation','hue_shift','apply_profile']) AS operator)
SELECT page_id, operator, operator || ': unsupported pixel format Rgba8' AS reason
FROM (SELECT DISTINCT page_id FROM px), ops""",
)

_ADMIT = dict(
    width="CAST(l_partkey * 97 % 70000 - 3 AS INT)",
    height="CAST(l_suppkey * 1009 % 66000 AS INT)",
    fmt="CASE l_linenumber % 4 WHEN 0 THEN 'Gray8' WHEN 1 THEN 'Rgb8' WHEN 2 THEN 'Rgba8' ELSE 'Cmyk8' END",
)


def _admission(spark, sf):
    li = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[f"{v} AS {k}" for k, v in _ADMIT.items()]
    )
    return raster.page_admission(li, check_content=False)


_register(
    "page_admission",
    _admission,
    f"""SELECT *, CASE WHEN bpp IS NULL THEN 'unsupported pixel format'
  WHEN width <= 0 OR height <= 0 THEN 'width and height must be positive'
  WHEN width > 65535 OR height > 65535 THEN 'axis exceeds 65535 pixels'
  WHEN CAST(width AS BIGINT) * height * bpp > 536870912 THEN 'buffer exceeds 536870912 bytes' END AS reason
FROM (SELECT * EXCLUDE bpp, bpp FROM (SELECT *, CASE fmt WHEN 'Gray8' THEN 1 WHEN 'Rgb8' THEN 3 WHEN 'Rgba8' THEN 4 END AS bpp
  FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {", ".join(f"{v} AS {k}" for k, v in _ADMIT.items())} FROM lineitem)))""".replace(
        "SELECT *, CASE WHEN bpp", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, width, height, fmt, CASE WHEN bpp"
    ),
)

# --- geometry --------------------------------------------------------------

_checked(
    "crop",
    lambda s: geometry.crop(s, 3, 2, 20, 4),
    "\nout AS (SELECT page_id, 20 AS width, 4 AS height, y - 2 AS y, x - 3 AS x, c, v FROM px"
    " WHERE height >= 6 AND x >= 3 AND x < 23 AND y >= 2 AND y < 6)",
)
_register(
    "crop_rejected",
    lambda spark, sf: geometry.crop_rejected(page_strips(spark, sf), 3, 2, 20, 4),
    px_sql() + "\nSELECT DISTINCT page_id, 'crop region out of bounds' AS reason FROM px WHERE height < 6",
)
_PLACE = "\nout AS (SELECT page_id, {w} AS width, {h} AS height, {y} AS y, {x} AS x, c, v FROM px)"
for _name, _op, _fmt, _kw in (
    ("flip_h", geometry.flip_h, "Rgb8", dict(w="width", h="height", y="y", x="width - 1 - x")),
    ("flip_v", geometry.flip_v, "Rgb8", dict(w="width", h="height", y="height - 1 - y", x="x")),
    ("rotate", lambda s: geometry.rotate(s, 90), "Rgb8", dict(w="height", h="width", y="x", x="height - 1 - y")),
    ("rotate_180", lambda s: geometry.rotate(s, -180), "Rgba8", dict(w="width", h="height", y="height - 1 - y", x="width - 1 - x")),
    ("rotate_270", lambda s: geometry.rotate(s, 270), "Gray8", dict(w="height", h="width", y="width - 1 - x", x="y")),
):
    _checked(_name, _op, _PLACE.format(**_kw), _fmt)
_checked(
    "resize_nearest",
    lambda s: geometry.resize_nearest(s, 40, 30),
    """
grid AS (SELECT DISTINCT page_id, width AS w, height AS h FROM px),
out AS (SELECT p.page_id, 40 AS width, 30 AS height, CAST(ty AS INT) AS y, CAST(tx AS INT) AS x, p.c, p.v
  FROM grid, range(30) a(ty), range(40) b(tx)
  JOIN px p ON p.page_id = grid.page_id AND p.y = ty * grid.h // 30 AND p.x = tx * grid.w // 40)""",
)

_SIZES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_partkey % 2480 AS INT) AS sw, CAST(l_suppkey * 53 % 3508 AS INT) AS sh"
_WANT = ", CAST(CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE l_quantity * 10 END AS INT) AS rw, CAST(CASE WHEN l_linenumber % 4 = 1 THEN 0 ELSE l_quantity * 17 END AS INT) AS rh"
_register(
    "fit_extent",
    lambda spark, sf: geometry.fit_extent(
        table(spark, sf, "lineitem").selectExpr(*_split_columns(_SIZES + _WANT)), ("sw", "sh"), ("rw", "rh")
    ),
    f"""WITH s AS (SELECT {_SIZES}{_WANT} FROM lineitem), k AS (SELECT *,
  (sw = 0 OR sh = 0 OR (rw = 0 AND rh = 0)) AS keep,
  (rh = 0 OR (rw <> 0 AND CAST(rw AS BIGINT) * sh <= CAST(rh AS BIGINT) * sw)) AS byw FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sw, sh, rw, rh,
  CAST(CASE WHEN keep THEN sw WHEN byw THEN rw ELSE greatest((CAST(sw AS BIGINT) * rh + sh // 2) // nullif(sh, 0), 1) END AS BIGINT) AS fit_width,
  CAST(CASE WHEN keep THEN sh WHEN byw THEN greatest((CAST(sh AS BIGINT) * rw + sw // 2) // nullif(sw, 0), 1) ELSE rh END AS BIGINT) AS fit_height
FROM k""",
)
_register(
    "fit_within",
    lambda spark, sf: geometry.fit_within(
        table(spark, sf, "lineitem").selectExpr(*_split_columns(_SIZES)), ("sw", "sh"), 160, 120
    ),
    f"""WITH s AS (SELECT {_SIZES} FROM lineitem), k AS (SELECT *, CAST(greatest(sw, 1) AS BIGINT) AS w, CAST(greatest(sh, 1) AS BIGINT) AS h FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, sw, sh,
  CAST(CASE WHEN w * 120 >= h * 160 THEN 160 ELSE least(greatest((w * 120 + h // 2) // h, 1), 160) END AS BIGINT) AS thumb_width,
  CAST(CASE WHEN w * 120 >= h * 160 THEN least(greatest((h * 160 + w // 2) // w, 1), 120) ELSE 120 END AS BIGINT) AS thumb_height
FROM k""",
)


def _split_columns(text: str) -> list[str]:
    """Split a select list at top-level commas."""
    out, depth, start = [], 0, 0
    for at, ch in enumerate(text):
        depth += (ch == "(") - (ch == ")")
        if ch == "," and depth == 0:
            out.append(text[start:at].strip())
            start = at + 1
    return [*out, text[start:].strip()]


_SKEW = """
dark AS (SELECT page_id, x, y FROM px WHERE width >= 8 AND height >= 8 AND v < 200
  AND x % greatest(least(width, height) // 128, 1) = 0 AND y % greatest(least(width, height) // 128, 1) = 0),
angles AS (SELECT CAST(i AS INT) AS i, i * 0.5 - 15.0 AS angle FROM range(61) t(i)),
bins AS (SELECT page_id, i, CAST(round(-CAST(x AS DOUBLE) * sin(radians(CAST(angle AS DOUBLE))) + CAST(y AS DOUBLE) * cos(radians(CAST(angle AS DOUBLE)))) AS INT) AS bin, count(*) AS n
  FROM dark, angles GROUP BY 1, 2, 3),
scores AS (SELECT page_id, i, count(*) AS k, sum(n) AS s, sum(n * n) AS q FROM bins GROUP BY 1, 2),
ranked AS (SELECT page_id, i, s, row_number() OVER (PARTITION BY page_id
  ORDER BY round(CAST(k * q - s * s AS DOUBLE) / CAST(k * k AS DOUBLE), 9) DESC, i) AS rn FROM scores),
skew AS (SELECT p.page_id, CASE WHEN r.s >= 20 THEN CAST(r.i * 0.5 - 15.0 AS DOUBLE) ELSE 0.0 END AS angle
  FROM (SELECT DISTINCT page_id FROM px) p LEFT JOIN (SELECT * FROM ranked WHERE rn = 1) r USING (page_id))"""
_register(
    "skew_estimate",
    lambda spark, sf: geometry.skew_estimate(page_strips(spark, sf, "Gray8")),
    px_sql("Gray8") + "," + _SKEW + "\nSELECT page_id, CAST(angle AS DOUBLE) AS angle FROM skew",
)


def _deskew_sql(bpp: int) -> str:
    """Needs ``angles_by(page_id, angle)``."""
    return f"""
dims AS (SELECT DISTINCT page_id, width AS w, height AS h FROM px),
geo AS (SELECT d.*, a.angle, cos(radians(a.angle)) AS co, sin(radians(a.angle)) AS si, (w - 1.0) / 2.0 AS cx, (h - 1.0) / 2.0 AS cy
  FROM dims d JOIN angles_by a USING (page_id)),
box AS (SELECT *, list_transform([[0.0, 0.0], [w - 1.0, 0.0], [0.0, h - 1.0], [w - 1.0, h - 1.0]],
    lambda p: co * (CAST(p[1] AS DOUBLE) - CAST(cx AS DOUBLE)) - si * (CAST(p[2] AS DOUBLE) - CAST(cy AS DOUBLE)) + CAST(cx AS DOUBLE)) AS xs,
  list_transform([[0.0, 0.0], [w - 1.0, 0.0], [0.0, h - 1.0], [w - 1.0, h - 1.0]],
    lambda p: si * (CAST(p[1] AS DOUBLE) - CAST(cx AS DOUBLE)) + co * (CAST(p[2] AS DOUBLE) - CAST(cy AS DOUBLE)) + CAST(cy AS DOUBLE)) AS ys FROM geo),
canvas AS (SELECT page_id, w, h, angle, co, si, CAST(cx AS DOUBLE) AS cx, CAST(cy AS DOUBLE) AS cy,
  greatest(CAST(ceil(list_max(xs) - list_min(xs) + 1.0) AS INT), 1) AS ow,
  greatest(CAST(ceil(list_max(ys) - list_min(ys) + 1.0) AS INT), 1) AS oh FROM box),
target AS (SELECT page_id, w, h, ow, oh, CAST(tx AS INT) AS tx, CAST(ty AS INT) AS ty, co, si, cx, cy,
  CAST((ow - 1.0) / 2.0 AS DOUBLE) AS ox, CAST((oh - 1.0) / 2.0 AS DOUBLE) AS oy
  FROM canvas, range(oh) a(ty), range(ow) b(tx) WHERE abs(angle) >= 0.05),
mapped AS (SELECT page_id, ow, oh, tx, ty,
  CAST(round(co * (tx - ox) + si * (ty - oy) + cx) AS INT) AS sx,
  CAST(round(-si * (tx - ox) + co * (ty - oy) + cy) AS INT) AS sy FROM target),
out AS (
  SELECT m.page_id, ow AS width, oh AS height, ty AS y, tx AS x, ch.c, coalesce(p.v, 255) AS v
  FROM mapped m CROSS JOIN (SELECT unnest(range({bpp})) AS c) ch
  LEFT JOIN px p ON p.page_id = m.page_id AND p.x = m.sx AND p.y = m.sy AND p.c = ch.c
  UNION ALL SELECT px.page_id, width, height, y, x, c, v FROM px JOIN canvas USING (page_id) WHERE abs(angle) < 0.05)"""


_checked(
    "deskew",
    lambda s: geometry.deskew_by(s, 7.3),
    "\nangles_by AS (SELECT DISTINCT page_id, CAST(7.3 AS DOUBLE) AS angle FROM px)," + _deskew_sql(3),
)
_checked(
    "auto_deskew",
    geometry.auto_deskew,
    _SKEW + ",\nangles_by AS (SELECT page_id, CAST(-angle AS DOUBLE) AS angle FROM skew)," + _deskew_sql(1),
    "Gray8",
)
_BOUNDS = """
ink AS (SELECT page_id, width, height, min(x) FILTER (WHERE v < 60) AS x0, max(x) FILTER (WHERE v < 60) AS x1,
   min(y) FILTER (WHERE v < 60) AS y0, max(y) FILTER (WHERE v < 60) AS y1 FROM px GROUP BY page_id, width, height),
cropped AS (SELECT *, greatest(x0 - 2, 0) AS bx, greatest(y0 - 2, 0) AS b_y, least(x1 + 2, width - 1) AS ex, least(y1 + 2, height - 1) AS ey FROM ink),
bounds AS (SELECT page_id, width, height, CASE WHEN x1 IS NULL THEN 0 ELSE bx END AS x, CASE WHEN x1 IS NULL THEN 0 ELSE b_y END AS y,
   CASE WHEN x1 IS NULL THEN width ELSE ex - bx + 1 END AS w, CASE WHEN x1 IS NULL THEN height ELSE ey - b_y + 1 END AS h,
   CASE WHEN x1 IS NULL THEN 0.0 ELSE least(greatest(CAST(1.0 AS DOUBLE) - CAST((ex - bx + 1) * (ey - b_y + 1) AS DOUBLE) / CAST(width * height AS DOUBLE) + CAST(0.2 AS DOUBLE), 0.0), 1.0) END AS confidence,
   CASE WHEN x1 IS NULL THEN 'full-frame-empty' ELSE 'luma-threshold-bbox' END AS method FROM cropped)"""
_register(
    "auto_crop_bounds",
    lambda spark, sf: geometry.auto_crop_bounds(page_strips(spark, sf, "Gray8"), 60, 2).withColumn(
        "confidence", F.round("confidence", 9)
    ),
    px_sql("Gray8") + "," + _BOUNDS + """
SELECT page_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(w AS INT) AS w, CAST(h AS INT) AS h,
       round(CAST(confidence AS DOUBLE), 9) AS confidence, method FROM bounds""",
)
_checked(
    "auto_crop",
    lambda s: geometry.auto_crop(s, 60, 2),
    _BOUNDS + """,
out AS (SELECT p.page_id, b.w AS width, b.h AS height, p.y - b.y AS y, p.x - b.x AS x, c, v FROM px p JOIN bounds b USING (page_id)
  WHERE p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h)""",
    "Gray8",
)
_ORIENT = """
near AS (SELECT *, lag(v) OVER h AS l, lead(v) OVER h AS r, lag(v) OVER d AS u, lead(v) OVER d AS dn FROM px
  WINDOW h AS (PARTITION BY page_id, y ORDER BY x), d AS (PARTITION BY page_id, x ORDER BY y)),
sums AS (SELECT page_id, width, height,
  coalesce(sum(abs(r - l)) FILTER (WHERE x > 0 AND x < width - 1 AND y > 0 AND y < height - 1), 0) AS gx,
  coalesce(sum(abs(dn - u)) FILTER (WHERE x > 0 AND x < width - 1 AND y > 0 AND y < height - 1), 0) AS gy,
  avg(v) FILTER (WHERE y < greatest(height // 20, 1)) AS top,
  avg(v) FILTER (WHERE y >= height - greatest(height // 20, 1)) AS bottom FROM near GROUP BY page_id, width, height),
share AS (SELECT *, gx / CAST(gx + gy + 1 AS DOUBLE) AS hs, gy / CAST(gx + gy + 1 AS DOUBLE) AS vs FROM sums),
orient AS (SELECT page_id, CASE WHEN width < 3 OR height < 3 THEN 0 WHEN hs < vs THEN 90 WHEN top < bottom - 8.0 THEN 180 ELSE 0 END AS degrees,
  CASE WHEN width < 3 OR height < 3 THEN 0.0 WHEN hs < vs THEN vs WHEN top < bottom - 8.0 THEN least(hs + 0.1, 1.0) ELSE hs END AS confidence,
  CASE WHEN width < 3 OR height < 3 THEN 'too-small' ELSE 'gradient-energy' END AS method FROM share)"""
_register(
    "orientation_detect",
    lambda spark, sf: geometry.orientation_detect(page_strips(spark, sf, "Gray8")).withColumn(
        "confidence", F.round("confidence", 9)
    ),
    px_sql("Gray8") + "," + _ORIENT + "\nSELECT page_id, CAST(degrees AS INT) AS degrees, round(CAST(confidence AS DOUBLE), 9) AS confidence, method FROM orient",
)
_checked(
    "orientation_apply",
    geometry.orientation_apply,
    _ORIENT + """,
out AS (SELECT page_id, CASE WHEN degrees = 90 THEN height ELSE width END AS width, CASE WHEN degrees = 90 THEN width ELSE height END AS height,
  CASE degrees WHEN 90 THEN x WHEN 180 THEN height - 1 - y ELSE y END AS y,
  CASE degrees WHEN 90 THEN height - 1 - y WHEN 180 THEN width - 1 - x ELSE x END AS x, c, v FROM px JOIN orient USING (page_id))""",
    "Gray8",
)

# --- tone and colour -------------------------------------------------------

_checked(
    "brightness_contrast",
    lambda s: tone.brightness_contrast(s, 12, -25),
    _map_sql("CAST(least(greatest(round((v - 128.0) * 0.75 + 128.0) + 31, 0), 255) AS INT)"),
)
_checked("invert", tone.invert, _map_sql("255 - v"), "Rgba8")
_checked(
    "levels",
    lambda s: tone.levels(s, 20, 220, 1.4),
    _map_sql(byte_sql("pow(least(greatest((v - 20) / CAST(200.0 AS DOUBLE), 0.0), 1.0), CAST(1.0 AS DOUBLE) / CAST(1.4 AS DOUBLE)) * 255.0")),
)
_CURVE = [[0, 10], [64, 40], [128, 160], [255, 240]]
_checked(
    "curves",
    lambda s: tone.curves(s, _CURVE),
    """
knots AS (SELECT unnest([0, 64, 128, 255]) AS kx, unnest([10, 40, 160, 240]) AS ky),
segs AS (SELECT kx, ky, lead(kx) OVER (ORDER BY kx) AS nx, lead(ky) OVER (ORDER BY kx) AS ny FROM knots),
out AS (SELECT page_id, width, height, y, x, c, """
    + byte_sql("CASE WHEN nx IS NULL OR v = 0 THEN ky ELSE ky * (CAST(1.0 AS DOUBLE) - (v - kx) / CAST(nx - kx AS DOUBLE)) + ny * ((v - kx) / CAST(nx - kx AS DOUBLE)) END")
    + " AS v FROM px JOIN segs ON v >= kx AND (v < nx OR nx IS NULL))",
)
_checked(
    "apply_lut",
    lambda s: tone.apply_lut(s, [(v * 7 + 3) % 256 for v in range(256)]),
    _map_sql("(v * 7 + 3) % 256"),
    "Rgba8",
)
_checked("desaturate", tone.desaturate, rgb_sql() + "," + unrgb_sql("rgb", LUMA_SQL, LUMA_SQL, LUMA_SQL))
_checked(
    "saturation",
    lambda s: tone.saturation(s, 40.0),
    rgb_sql() + "," + unrgb_sql("rgb", *[byte_sql(f"{LUMA_SQL} + ({n} - {LUMA_SQL}) * CAST(1.4 AS DOUBLE)") for n in "rgb"]),
)
_checked(
    "hue_shift",
    lambda s: tone.hue_shift(s, -75.0),
    rgb_sql() + """,
hsv AS (SELECT *, greatest(r, g, b) / 255.0::DOUBLE AS mx, least(r, g, b) / 255.0::DOUBLE AS mn, r / 255.0::DOUBLE AS rf, g / 255.0::DOUBLE AS gf, b / 255.0::DOUBLE AS bf FROM rgb),
hs AS (SELECT *, mx - mn AS d FROM hsv),
hh AS (SELECT *, CASE WHEN d < 1e-9 THEN 0.0::DOUBLE
   WHEN r >= g AND r >= b THEN 60.0::DOUBLE * (CASE WHEN (gf - bf) / d < 0 THEN (gf - bf) / d + 6.0::DOUBLE ELSE (gf - bf) / d END)
   WHEN g >= b THEN 60.0::DOUBLE * ((bf - rf) / d + 2.0::DOUBLE) ELSE 60.0::DOUBLE * ((rf - gf) / d + 4.0::DOUBLE) END AS h0,
   CASE WHEN d < 1e-9 OR mx = 0 THEN 0.0::DOUBLE ELSE d / mx END AS s FROM hs),
h1 AS (SELECT *, CASE WHEN h0 + 285.0::DOUBLE >= 360.0::DOUBLE THEN h0 + 285.0::DOUBLE - 360.0::DOUBLE ELSE h0 + 285.0::DOUBLE END AS h FROM hh),
cx AS (SELECT *, mx * s AS ch, (mx * s) * (1.0::DOUBLE - abs(fmod(h / 60.0::DOUBLE, 2.0::DOUBLE) - 1.0::DOUBLE)) AS xx, mx - mx * s AS m FROM h1),"""
    + unrgb_sql(
        "cx",
        byte_sql("((CASE WHEN h < 60 OR h >= 300 THEN ch WHEN h < 120 OR h >= 240 THEN xx ELSE 0 END) + m) * 255.0::DOUBLE"),
        byte_sql("((CASE WHEN h < 60 THEN xx WHEN h < 180 THEN ch WHEN h < 240 THEN xx ELSE 0 END) + m) * 255.0::DOUBLE"),
        byte_sql("((CASE WHEN h < 120 THEN 0 WHEN h < 180 THEN xx WHEN h < 300 THEN ch ELSE xx END) + m) * 255.0::DOUBLE"),
    ),
)
_checked("flatten", tone.flatten_paper, _map_sql(byte_sql("(v / 255.0::DOUBLE + (1.0::DOUBLE - v / 255.0::DOUBLE) * 0.12::DOUBLE * (v / 255.0::DOUBLE)) * 255.0::DOUBLE")))
_POW = {n: byte_sql(f"pow({n} / 255.0::DOUBLE, {p}::DOUBLE) * 255.0::DOUBLE * {k}::DOUBLE") for n, p, k in (("r", 1.05, 0.98), ("g", 0.92, 1.06), ("b", 0.94, 1.04))}
_checked(
    "restore_colors",
    tone.restore_colors,
    rgb_sql() + "," + unrgb_sql(
        "rgb",
        _POW["r"],
        f"CASE WHEN g >= r AND g >= b AND g > 40 THEN {byte_sql(_POW['g'] + ' * 1.03::DOUBLE')} ELSE {_POW['g']} END",
        f"CASE WHEN b >= r AND b > g AND b > 40 THEN {byte_sql(_POW['b'] + ' * 1.03::DOUBLE')} ELSE {_POW['b']} END",
    ),
)
_checked(
    "colorize",
    lambda s: tone.colorize(s, "cool"),
    rgb_sql() + "," + unrgb_sql("rgb", *[byte_sql(f"({LUMA_SQL} / 255.0::DOUBLE) * {f}::DOUBLE * 255.0::DOUBLE") for f in (0.7, 0.85, 1.15)]),
)


def _histogram(spark, sf):
    found = tone.page_histogram(page_strips(spark, sf))
    return found.select("page_id", "channel", "pixels", F.array_join(F.transform("bins", lambda n: n.cast("string")), ",").alias("bins"))


_register(
    "page_histogram",
    _histogram,
    px_sql() + "," + rgb_sql() + f""",
vals AS (SELECT page_id, CASE c WHEN 0 THEN 'r' WHEN 1 THEN 'g' ELSE 'b' END AS channel, v FROM px
  UNION ALL SELECT page_id, 'luma', {LUMA_SQL} FROM rgb),
cnt AS (SELECT page_id, channel, v, count(*) AS n FROM vals GROUP BY 1, 2, 3),
keys AS (SELECT page_id, channel, sum(n) AS pixels FROM cnt GROUP BY 1, 2)
SELECT k.page_id, k.channel, CAST(k.pixels AS BIGINT) AS pixels, string_agg(CAST(coalesce(cnt.n, 0) AS VARCHAR), ',' ORDER BY bin) AS bins
FROM keys k CROSS JOIN range(256) t(bin) LEFT JOIN cnt ON cnt.page_id = k.page_id AND cnt.channel = k.channel AND cnt.v = bin
GROUP BY k.page_id, k.channel, k.pixels""",
)
_register(
    "channel_means",
    lambda spark, sf: tone.channel_means(page_strips(spark, sf)).select(
        "page_id", *[F.round(f"mean_{c}", 9).alias(f"mean_{c}") for c in range(3)]
    ),
    px_sql() + "\nSELECT page_id, " + ", ".join(
        f"round(CAST(sum(v) FILTER (WHERE c = {c}) AS DOUBLE) / (width * height), 9) AS mean_{c}" for c in range(3)
    ) + " FROM px GROUP BY page_id, width, height",
)
_register(
    "exposure_gains",
    lambda spark, sf: tone.exposure_gains(page_strips(spark, sf)).select(
        "page_id", *[F.round(f"gain_{c}", 9).alias(f"gain_{c}") for c in "rgb"], "method"
    ),
    px_sql() + "\nSELECT page_id, " + ", ".join(
        f"round(128.0::DOUBLE / greatest(CAST(sum(v) FILTER (WHERE c = {c}) AS DOUBLE) / (width * height), 1.0::DOUBLE), 9) AS gain_{n}"
        for c, n in enumerate("rgb")
    ) + ", 'rgb-mean' AS method FROM px GROUP BY page_id, width, height",
)
_checked(
    "white_balance",
    tone.white_balance,
    """
ms AS (SELECT page_id, """ + ", ".join(f"CAST(sum(v) FILTER (WHERE c = {c}) AS DOUBLE) / (width * height) AS m{c}" for c in range(3)) + """ FROM px GROUP BY page_id, width, height),
gains AS (SELECT page_id, [m0, m1, m2] AS ms, (m0 + m1 + m2) / 3.0::DOUBLE AS m FROM ms),
out AS (SELECT p.page_id, width, height, y, x, c, CASE WHEN list_min(ms) < 1e-6 THEN v ELSE """
    + byte_sql("v * (m / ms[c + 1])") + " END AS v FROM px p JOIN gains USING (page_id))",
)
_LEVEL_POINTS = """
hist AS (SELECT page_id, v, count(*) AS n FROM px GROUP BY 1, 2),
cum AS (SELECT page_id, v, sum(n) OVER (PARTITION BY page_id ORDER BY v) AS up, sum(n) OVER (PARTITION BY page_id ORDER BY v DESC) AS dn,
  sum(n) OVER (PARTITION BY page_id) * 0.005::DOUBLE AS clip FROM hist),
pts AS (SELECT page_id, min(v) FILTER (WHERE up > clip) AS black, max(v) FILTER (WHERE dn > clip) AS white FROM cum GROUP BY page_id)"""
_checked(
    "auto_levels",
    tone.auto_levels,
    _LEVEL_POINTS + """,
out AS (SELECT p.page_id, width, height, y, x, c, CASE WHEN white <= black THEN v ELSE """
    + byte_sql("least(greatest((v - black) / CAST(white - black AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE")
    + " END AS v FROM px p JOIN pts USING (page_id))",
)


def level_report(spark, sf):
    """Which points would automatic levels use, and what mean results."""
    strips = page_strips(spark, sf)
    points = tone.auto_level_points(strips)
    means = tone.channel_means(tone.auto_levels(strips))
    return points.join(means, "page_id").select(
        "page_id", "black", "white", F.round((F.col("mean_0") + F.col("mean_1") + F.col("mean_2")) / 3.0, 6).alias("mean_after")
    )


_register(
    "auto_level_points",
    level_report,
    px_sql() + "," + _LEVEL_POINTS + """,
out AS (SELECT p.page_id, black, white, c, CASE WHEN white <= black THEN v ELSE """
    + byte_sql("least(greatest((v - black) / CAST(white - black AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE")
    + """ END AS v FROM px p JOIN pts USING (page_id))
SELECT page_id, black, white, round((avg(v) FILTER (WHERE c = 0) + avg(v) FILTER (WHERE c = 1) + avg(v) FILTER (WHERE c = 2)) / 3.0::DOUBLE, 6) AS mean_after
FROM out GROUP BY page_id, black, white""",
)
_checked(
    "restore_fading",
    tone.restore_fading,
    """
hist AS (SELECT page_id, c, v, count(*) AS n FROM px GROUP BY 1, 2, 3),
cum AS (SELECT page_id, c, v, sum(n) OVER (PARTITION BY page_id, c ORDER BY v) AS up, sum(n) OVER (PARTITION BY page_id, c ORDER BY v DESC) AS dn,
  greatest(floor(sum(n) OVER (PARTITION BY page_id, c) * 0.005::DOUBLE), 1) AS clip FROM hist),
ends AS (SELECT page_id, c, coalesce(min(v) FILTER (WHERE up > clip), 0) AS lo, coalesce(max(v) FILTER (WHERE dn > clip), 255) AS hi0 FROM cum GROUP BY 1, 2),
spans AS (SELECT page_id, c, lo, CASE WHEN hi0 <= lo THEN least(lo + 1, 255) ELSE hi0 END AS hi FROM ends),
st AS (SELECT p.page_id, width, height, y, x, p.c, CASE WHEN hi = lo THEN 0 ELSE """
    + byte_sql("least(greatest((v - lo) / CAST(hi - lo AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE")
    + """ END AS s FROM px p JOIN spans USING (page_id, c)),
ms AS (SELECT page_id, [avg(s) FILTER (WHERE c = 0), avg(s) FILTER (WHERE c = 1), avg(s) FILTER (WHERE c = 2)] AS ms FROM st GROUP BY page_id),
gain AS (SELECT page_id, CASE WHEN list_min(ms) < 1e-6 THEN [1.0::DOUBLE, 1.0::DOUBLE, 1.0::DOUBLE]
   ELSE list_transform(ms, lambda q: 1.0::DOUBLE + ((ms[1] + ms[2] + ms[3]) / 3.0::DOUBLE / q - 1.0::DOUBLE) * 0.85::DOUBLE) END AS gs FROM ms),
out AS (SELECT st.page_id, width, height, y, x, c, """ + byte_sql("s * gs[c + 1]") + " AS v FROM st JOIN gain USING (page_id))",
)

# --- neighbourhood filters -------------------------------------------------


def _median_sql(radius: int, bpp: int) -> str:
    """CTE ``med`` with columns v (source) and m (median)."""
    ups = [f"coalesce({', '.join(f'lag(r, {j}) OVER w' for j in range(k, 0, -1))}, r) AS u{k}" for k in range(1, radius + 1)]
    dns = [f"coalesce({', '.join(f'lead(r, {j}) OVER w' for j in range(k, 0, -1))}, r) AS d{k}" for k in range(1, radius + 1)]
    lines = [f"u{k}" for k in range(radius, 0, -1)] + ["r"] + [f"d{k}" for k in range(1, radius + 1)]
    cells = ", ".join(
        f"{line}[CAST(greatest(0, least(width - 1, x + {dx})) * {bpp} + c + 1 AS INT)]" for line in lines for dx in range(-radius, radius + 1)
    )
    half = (2 * radius + 1) ** 2 // 2 + 1
    return f"""
st AS (SELECT page_id, width, height, y, list(v ORDER BY x, c) AS r FROM px GROUP BY page_id, width, height, y),
nb AS (SELECT *, {', '.join(ups + dns)} FROM st WINDOW w AS (PARTITION BY page_id ORDER BY y)),
med AS (SELECT page_id, width, height, y, CAST(x AS INT) AS x, CAST(c AS INT) AS c, r[CAST(x * {bpp} + c + 1 AS INT)] AS v,
  list_sort([{cells}])[{half}] AS m FROM nb, range(width) a(x), range({bpp}) b(c))"""


def _blend_sql(share: str, keep: str) -> str:
    return ",\nout AS (SELECT page_id, width, height, y, x, c, " + byte_sql(f"v * {keep}::DOUBLE + m * {share}::DOUBLE") + " AS v FROM med)"


_checked(
    "sharpen",
    lambda s: filters.sharpen(s, 1.5),
    """
nb AS (SELECT *, coalesce(lag(v) OVER h, v) AS l, coalesce(lead(v) OVER h, v) AS r, coalesce(lag(v) OVER d, v) AS u, coalesce(lead(v) OVER d, v) AS dn FROM px
  WINDOW h AS (PARTITION BY page_id, y, c ORDER BY x), d AS (PARTITION BY page_id, x, c ORDER BY y)),
out AS (SELECT page_id, width, height, y, x, c, CASE WHEN height < 3 THEN v ELSE """ + byte_sql("v * 2.5::DOUBLE - 0.375::DOUBLE * (l + r + u + dn)") + " END AS v FROM nb)",
    "Rgba8",
)
_checked("median", filters.median, _median_sql(1, 3) + ",\nout AS (SELECT page_id, width, height, y, x, c, m AS v FROM med)")


def _blur_sql(radius: int) -> str:
    frame = f"ROWS BETWEEN {radius} PRECEDING AND {radius} FOLLOWING"
    return f"""
hz AS (SELECT page_id, width, height, y, x, c, sum(v) OVER w // count(*) OVER w AS v FROM px
  WINDOW w AS (PARTITION BY page_id, y, c ORDER BY x {frame})),
out AS (SELECT page_id, width, height, y, x, c, sum(v) OVER w // count(*) OVER w AS v FROM hz
  WINDOW w AS (PARTITION BY page_id, x, c ORDER BY y {frame}))"""


_checked("box_blur", lambda s: filters.box_blur(s, 3), _blur_sql(3))
_checked("descreen", filters.descreen, _blur_sql(2), "Rgba8")
_checked("denoise", lambda s: filters.denoise(s, 0.6), _median_sql(1, 1) + _blend_sql("0.6", "(1.0::DOUBLE - 0.6::DOUBLE)"), "Gray8")
_checked("grain_reduction", lambda s: filters.grain_reduction(s, "Strong"), _median_sql(2, 1) + _blend_sql("0.9", "(1.0::DOUBLE - 0.9::DOUBLE)"), "Gray8")
_checked(
    "dust_clean",
    lambda s: filters.dust_clean(s, "on"),
    _median_sql(2, 3) + """,
far AS (SELECT *, max(abs(v - m)) OVER (PARTITION BY page_id, y, x) AS res FROM med),
out AS (SELECT page_id, width, height, y, x, c, CASE WHEN res > 30 THEN m ELSE v END AS v FROM far)""",
)
_checked(
    "hole_punch",
    filters.hole_punch,
    rgb_sql() + """,
hit AS (SELECT page_id, y, x FROM (SELECT *, CAST(floor(greatest(least(width, height) * 0.04, 4.0)) AS INT) AS rr FROM rgb) q,
  (SELECT unnest([0, 1, 0, 1]) AS fx, unnest([0, 0, 1, 1]) AS fy) k
  WHERE (x - fx * (width - 1)) ** 2 + (y - fy * (height - 1)) ** 2 <= rr * rr AND """ + LUMA_SQL + """ < 40),
out AS (SELECT p.page_id, width, height, p.y, p.x, c, CASE WHEN h.page_id IS NOT NULL THEN 245 ELSE v END AS v
  FROM px p LEFT JOIN (SELECT DISTINCT page_id, y, x FROM hit) h ON h.page_id = p.page_id AND h.y = p.y AND h.x = p.x)""",
)

# --- film, calibration, profile --------------------------------------------

_FILM_ROWS = ", ".join(
    "({ordinal}, '{film_id}', '{kind}', {m}, {contrast}::DOUBLE, {gamma}::DOUBLE)".format(
        m=", ".join("NULL::DOUBLE" if f[k] is None else f"{f[k]}::DOUBLE" for k in ("mask_r", "mask_g", "mask_b")), **f
    )
    for f in film_profiles()
)
_FILM_SQL = f"film AS (SELECT * FROM (VALUES {_FILM_ROWS}) t(ordinal, film_id, kind, mr, mg, mb, contrast, gamma))"


def _film(spark, sf):
    catalog = film.film_catalog(spark)
    ids = F.array(*[F.lit(p["film_id"]) for p in film_profiles()])
    strips = page_strips(spark, sf).withColumn("film_id", ids[(F.col("page_id") % 51).cast("int")])
    return raster.page_checksum(film.film_convert(strips, catalog))


def _film_sample(n: str, k: int) -> str:
    inv = f"(CASE WHEN kind LIKE '%negative%' THEN 255 - {n} ELSE {n} END)"
    unmasked = f"(CASE WHEN mr IS NULL THEN {inv} ELSE {byte_sql(f'{inv} * (((mr + mg + mb) / 3.0::DOUBLE) / m{k})')} END)"
    return byte_sql(f"pow(least(greatest(({unmasked} / 255.0::DOUBLE - 0.5::DOUBLE) * contrast + 0.5::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 1.0::DOUBLE / gamma) * 255.0::DOUBLE")


_register(
    "film_convert",
    _film,
    px_sql() + "," + rgb_sql() + "," + _FILM_SQL + f""",
conv AS (SELECT page_id, width, height, y, x, kind, {_film_sample('r', 'r')} AS r, {_film_sample('g', 'g')} AS g, {_film_sample('b', 'b')} AS b
  FROM rgb JOIN film ON page_id % 51 = ordinal),"""
    + unrgb_sql("conv", *[f"CASE WHEN kind LIKE 'bw%' THEN {LUMA_SQL} ELSE {n} END" for n in "rgb"])
    + checksum_sql(3),
)


def _film_lookup(spark, sf):
    parts = table(spark, sf, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 7 = 0 THEN concat('roll_', p_size) ELSE concat('kodak_gold_', 100 * (p_size % 6)) END AS film_id"
    )
    return film.film_lookup(parts, film.film_catalog(spark)).select("p_partkey", "film_id", "kind", "manufacturer", "contrast", "gamma", "error")


_register(
    "film_catalog",
    _film_lookup,
    "WITH " + _FILM_SQL + """,
asked AS (SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN concat('roll_', p_size) ELSE concat('kodak_gold_', 100 * (p_size % 6)) END AS film_id FROM part)
SELECT p_partkey, film_id, kind, CASE WHEN kind IS NULL THEN NULL ELSE 'Kodak' END AS manufacturer, contrast, gamma,
  CASE WHEN kind IS NULL THEN 'film profile not found: ' || film_id END AS error FROM asked LEFT JOIN film USING (film_id)""",
)

# Column tables by rule: constant dark level, flat field rising to the borders.
_DARK = [2] * 64
_FLAT = [math.floor((1.0 + 0.04 * abs(i / 63 - 0.5) * 2.0) * 10_000.0 + 0.5) / 10_000.0 for i in range(64)]
_checked(
    "flat_dark_cal",
    lambda s: film.flat_dark_cal(s, _DARK, _FLAT),
    f"""
tab AS (SELECT unnest(range(64)) AS k, unnest([{', '.join(f'{f}::DOUBLE' for f in _FLAT)}]) AS f),
out AS (SELECT page_id, width, height, y, x, c, CASE WHEN c = 3 THEN v ELSE """
    + byte_sql("greatest(v - 2, 0) * f + 0.5::DOUBLE")
    + " END AS v FROM px JOIN tab ON k = x * 63 // (width - 1))",
    "Rgba8",
)
_IT8 = """
cells AS (SELECT page_id, width, height, v, c, greatest(width // 6, 1) AS cw, greatest(height // 5, 1) AS chh, x, y FROM px),
hits AS (SELECT page_id, v, c, (y // chh) * 6 + x // cw AS patch FROM cells
  WHERE x // cw < 6 AND y // chh < 5
    AND x >= (x // cw) * cw + cw // 4 AND x < least(greatest((x // cw) * cw + 3 * cw // 4, (x // cw) * cw + cw // 4 + 1), width)
    AND y >= (y // chh) * chh + chh // 4 AND y < least(greatest((y // chh) * chh + 3 * chh // 4, (y // chh) * chh + chh // 4 + 1), height)),
got AS (SELECT page_id, patch, avg(v) FILTER (WHERE c = 0) / 255.0::DOUBLE AS r, avg(v) FILTER (WHERE c = 1) / 255.0::DOUBLE AS g, avg(v) FILTER (WHERE c = 2) / 255.0::DOUBLE AS b
  FROM hits GROUP BY 1, 2),
means AS (SELECT p.page_id, CAST(k AS INT) AS patch, coalesce(r, 0) AS mean_r, coalesce(g, 0) AS mean_g, coalesce(b, 0) AS mean_b
  FROM (SELECT DISTINCT page_id FROM px) p CROSS JOIN range(30) t(k) LEFT JOIN got ON got.page_id = p.page_id AND got.patch = k)"""
_register(
    "it8_patch_means",
    lambda spark, sf: profile.it8_patch_means(page_strips(spark, sf)).select(
        "page_id", "patch", *[F.round(f"mean_{n}", 9).alias(f"mean_{n}") for n in "rgb"]
    ),
    px_sql() + "," + _IT8 + "\nSELECT page_id, patch, round(CAST(mean_r AS DOUBLE), 9) AS mean_r, round(CAST(mean_g AS DOUBLE), 9) AS mean_g, round(CAST(mean_b AS DOUBLE), 9) AS mean_b FROM means",
)


def _chart_residuals(spark, sf):
    """How far every measured patch is from its reference colour."""
    joined = lookup_join(profile.it8_patch_means(page_strips(spark, sf)), profile.it8_reference(spark), ["patch"], how="inner")
    return joined.select(
        "page_id", "patch", *[F.round(F.col(f"mean_{n}") - F.col(f"ref_{n}"), 9).alias(f"off_{n}") for n in "rgb"]
    )


_register(
    "it8_reference",
    _chart_residuals,
    px_sql() + "," + _IT8 + """,
base AS (SELECT * FROM (VALUES (0, 1, 0, 0), (1, 0, 1, 0), (2, 0, 0, 1), (3, 1, 1, 0), (4, 0, 1, 1), (5, 1, 0, 1)) t(k, r, g, b)),
ref AS (SELECT CAST(j * 6 + k AS INT) AS patch, r * s AS r, g * s AS g, b * s AS b FROM base, (SELECT unnest(range(4)) AS j, unnest([1.0, 0.75, 0.5, 0.3]::DOUBLE[]) AS s)
  UNION ALL SELECT CAST(24 + i AS INT), i / 5.0::DOUBLE, i / 5.0::DOUBLE, i / 5.0::DOUBLE FROM range(6) t(i))
SELECT page_id, patch, round(CAST(mean_r AS DOUBLE) - r, 9) AS off_r, round(CAST(mean_g AS DOUBLE) - g, 9) AS off_g, round(CAST(mean_b AS DOUBLE) - b, 9) AS off_b FROM means JOIN ref USING (patch)""",
)
# Each channel of the reference sums to 3 * (1 + .75 + .5 + .3) + 3.
# Some gains are fractions that stand exactly between two roundings, where the last bit of a sum would decide; the offset keeps them off.
_register(
    "it8_profile",
    lambda spark, sf: profile.it8_profile(page_strips(spark, sf)).select(
        "page_id", *[F.round(F.col(f"gain_{n}") + F.lit(1e-11), 9).alias(f"gain_{n}") for n in "rgb"], "error"
    ),
    px_sql() + "," + _IT8 + """,
base AS (SELECT * FROM (VALUES (1, 0, 0), (0, 1, 0), (0, 0, 1), (1, 1, 0), (0, 1, 1), (1, 0, 1)) t(r, g, b)),
refs AS (SELECT r * s AS r, g * s AS g, b * s AS b FROM base, (SELECT unnest([1.0, 0.75, 0.5, 0.3]::DOUBLE[]) AS s)
  UNION ALL SELECT i / 5.0::DOUBLE, i / 5.0::DOUBLE, i / 5.0::DOUBLE FROM range(6) t(i)),
ref AS (SELECT sum(r) AS r, sum(g) AS g, sum(b) AS b FROM refs),
tot AS (SELECT page_id, sum(mean_r) AS r, sum(mean_g) AS g, sum(mean_b) AS b FROM means GROUP BY page_id),
gn AS (SELECT page_id, """ + ", ".join(f"CASE WHEN tot.{n} > 1e-9 AND ref.{n} / tot.{n} <= 16.0 THEN ref.{n} / tot.{n} END AS g{n}" for n in "rgb") + """ FROM tot, ref)
SELECT page_id, round(gr + 1e-11::DOUBLE, 9) AS gain_r, round(gg + 1e-11::DOUBLE, 9) AS gain_g, round(gb + 1e-11::DOUBLE, 9) AS gain_b,
  CASE WHEN gr IS NULL OR gg IS NULL OR gb IS NULL THEN 'capture too dark or a channel is dead' END AS error FROM gn""",
)
_MATRIX = [[1.1, -0.05, 0.02], [0.03, 0.94, 0.06], [-0.02, 0.08, 1.2]]
_GAMMA = [1.0, 1.8, 2.2]


def _apply_profile(spark, sf):
    profiles = spark.createDataFrame([(0, _MATRIX, _GAMMA)], "profile_id int, matrix array<array<double>>, gamma array<double>")
    # Two pages in three are bound to the profile; the rest have none and pass.
    strips = page_strips(spark, sf).withColumn("profile_id", F.when(F.col("page_id") % 3 != 2, 0).otherwise(1))
    return raster.page_checksum(profile.apply_profile(strips, profiles))


def _profile_sample(n: int) -> str:
    m = _MATRIX[n]
    mix = f"least(greatest({m[0]}::DOUBLE * (r / 255.0::DOUBLE) + {m[1]}::DOUBLE * (g / 255.0::DOUBLE) + {m[2]}::DOUBLE * (b / 255.0::DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE)"
    curved = mix if _GAMMA[n] == 1.0 else f"pow({mix}, 1.0::DOUBLE / {_GAMMA[n]}::DOUBLE)"
    return f"CASE WHEN page_id % 3 = 2 THEN {'rgb'[n]} ELSE {byte_sql(curved + ' * 255.0::DOUBLE')} END"


_register(
    "apply_profile",
    _apply_profile,
    px_sql() + "," + rgb_sql() + "," + unrgb_sql("rgb", *[_profile_sample(n) for n in range(3)]) + checksum_sql(3),
)
