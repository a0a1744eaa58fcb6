"""Layered settings, validation rules and small text formats."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import IMAGE_FORMATS, MULTIPAGE_FORMATS, OCR_ENGINES, PAPER_MM, REDACTED_KEYS, film_profiles
from ..functions.columns import let
from .filters import TIER_ALIASES, TIER_OFF
from .raster import MAX_AXIS, MAX_PAGE_BYTES
from .tone import TINT_NAMES

# Processing settings: name, type, default.
PROCESSING = (
    ("rotate", "int", 0), ("flip_h", "boolean", False), ("flip_v", "boolean", False),
    ("brightness", "int", 0), ("contrast", "int", 0), ("desaturate", "boolean", False),
    ("levels_black", "int", 0), ("levels_white", "int", 255), ("levels_gamma", "double", 1.0),
    ("saturation", "double", 0.0), ("hue", "double", 0.0), ("curves", "array<array<int>>", None),
    ("crop", "array<int>", None), ("auto_deskew", "boolean", False), ("deskew_angle", "double", 0.0),
    ("auto_orient", "boolean", False), ("auto_crop", "boolean", False), ("white_balance", "boolean", False),
    ("auto_levels", "boolean", False), ("sharpen_amount", "double", 0.0), ("infrared_clean", "string", None),
    ("descreen", "boolean", False), ("descreen_dpi", "int", 75), ("restore_colors", "boolean", False),
    ("restore_fading", "boolean", False), ("grain_reduction", "string", None), ("flatten", "boolean", False),
    ("hole_punch", "boolean", False), ("colorize_mode", "string", None), ("film_type", "string", None),
)
# Acquisition and output settings.
ACQUISITION = (
    ("last_device_id", "string", "mock"), ("default_dpi", "int", 150), ("default_width", "int", 0),
    ("default_height", "int", 0), ("paper_size", "string", "auto"), ("config_version", "int", 1),
    ("duplex", "boolean", False), ("batch_pages", "int", 1), ("output_name", "string", "scan"),
    ("output_format", "string", "png"), ("multipage", "boolean", False), ("multipage_format", "string", "pdf"),
    ("contact_sheet", "boolean", False), ("ocr_engine", "string", "offline"), ("ocr_language", "string", "eng"),
    ("language", "string", "en"),
)
SETTINGS = PROCESSING + ACQUISITION
# Settings an override may switch off by name.
DISABLEABLE = ("infrared_clean", "grain_reduction", "colorize_mode", "film_type")
OFF_WORDS = ("off", "none", "false")

CONFIG_SCHEMA = ", ".join(f"{name} {kind}" for name, kind, _ in SETTINGS)
MAX_OUTPUT_NAME_BYTES = 128
MAX_LANGUAGE_BYTES = 64


def is_off(value: Column) -> Column:
    text = F.lower(F.trim(value))
    return (text == "") | text.isin(*OFF_WORDS)


def settings_load(df: DataFrame, column: str = "config") -> DataFrame:
    """Parse stored JSON into ``s``: absent fields take their default, unknown
    ones are ignored, old records are upgraded; a wrongly typed field sets
    ``error``."""
    parsed = df.withColumn("_c", F.from_json(F.col(column), CONFIG_SCHEMA))
    bad = [
        F.when(F.col(f"_c.{name}").isNull() & F.get_json_object(column, f"$.{name}").isNotNull(), F.lit(name))
        for name, _, default in SETTINGS
        if default is not None
    ]
    # A record written before versioning has no version field at all.
    version = F.when(F.col(column).isNull(), 1).otherwise(F.coalesce("_c.config_version", F.lit(0)))
    legacy = (version < 1) & (F.col("_c.default_width") == 320) & (F.col("_c.default_height") == 240)

    def value(name: str, kind: str, default) -> Column:
        stored = F.col(f"_c.{name}")
        if name in ("default_width", "default_height"):
            stored = F.when(legacy, F.lit(0)).otherwise(stored)
        if name == "config_version":
            stored = F.greatest(version, F.lit(1))
        return (stored if default is None else F.coalesce(stored, F.lit(default))).cast(kind).alias(name)

    return (
        parsed.withColumn("s", F.struct(*[value(*field) for field in SETTINGS]))
        .withColumn("error", F.when(F.coalesce(*bad).isNotNull(), F.concat(F.lit("config parse: "), F.coalesce(*bad))))
        .drop("_c")
    )


def override_text(stored: Column, given: Column) -> Column:
    """Blank or absent keeps, an off word clears, anything else replaces."""
    text = F.trim(given)
    return F.when(given.isNull() | (text == ""), stored).when(is_off(given), F.lit(None).cast("string")).otherwise(text)


def settings_resolve(df: DataFrame, overrides: dict[str, str]) -> DataFrame:
    """Apply override columns (setting name -> column name) on top of ``s``."""
    known = {name: kind for name, kind, _ in PROCESSING}

    def field(name: str, kind: str) -> Column:
        stored = F.col(f"s.{name}")
        if name not in overrides or name not in known:
            out = stored
        elif name in DISABLEABLE:
            out = override_text(stored, F.col(overrides[name]))
        else:
            out = F.coalesce(F.col(overrides[name]).cast(kind), stored)
        if name == "rotate":
            turn = F.pmod(out, F.lit(360))
            out = F.when(turn.isin(90, 180, 270), turn).otherwise(0)
        return out.alias(name)

    return df.withColumn("s", F.struct(*[field(name, kind) for name, kind, _ in SETTINGS]))


def tier_column(value: Column) -> Column:
    """Struct(tier, error): canonical tier, null when disabled."""
    text = F.lower(F.trim(value))
    tier = F.lit(None).cast("string")
    for name in ("light", "medium", "heavy"):
        tier = F.when(text.isin(*[a for a, t in TIER_ALIASES.items() if t == name]), name).otherwise(tier)
    off = text.isNull() | text.isin(*TIER_OFF)
    bad = ~off & ~text.isin(*TIER_ALIASES)
    return F.struct(
        F.when(~off, tier).alias("tier"),
        F.when(bad, F.lit("unknown tier")).alias("error"),
    )


def curve_parse(text: Column) -> Column:
    """Struct(points, error) from ``x:y,x:y``; blank text is no curve."""
    # The spaces are only looked at where a plain cast, which knows fewer of them, fails.
    trimmed = lambda t: F.regexp_replace(t, r"(?U)^\s+|\s+$", "")
    number = lambda t: F.coalesce(t.try_cast("int"), trimmed(t).try_cast("int"))

    def point(q: Column) -> Column:
        return F.struct(F.size(q).alias("n"), number(q[0]).alias("x"), number(F.get(q, F.lit(1))).alias("y"))

    def checked(ps: Column, p: Column, i: Column) -> Column:
        at = F.concat(F.lit("curve point "), (i + 1).cast("string"))
        return (
            F.when(p["n"] != 2, F.concat(at, F.lit(": not x:y")))
            .when(p["x"].isNull(), F.concat(at, F.lit(": bad x")))
            .when(p["y"].isNull(), F.concat(at, F.lit(": bad y")))
            .when(~p["x"].between(0, 255) | ~p["y"].between(0, 255), F.concat(at, F.lit(": outside 0-255")))
            .when((i > 0) & (p["x"] <= F.get(ps, i - 1)["x"]), F.lit("curve: x not rising"))
        )

    def judged(ps: Column) -> Column:
        first = F.get(F.filter(F.transform(ps, lambda p, i: checked(ps, p, i)), lambda e: e.isNotNull()), F.lit(0))
        return let(F.coalesce(first, F.when(F.size(ps) < 2, "curve: too few points")), lambda error: _curve(ps, error))

    def _curve(ps: Column, error: Column) -> Column:
        points = F.transform(ps, lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
        return F.struct(F.when(error.isNull(), points).alias("points"), error.alias("error"))

    # Every number is read once: the points are bound before the rules look at them.
    parts = F.transform(F.split(text, ","), lambda p: let(F.split(p, ":"), point))
    nothing = F.struct(F.lit(None).cast("array<struct<x:int,y:int>>").alias("points"), F.lit(None).cast("string").alias("error"))
    given = text.isNotNull() & text.rlike(r"(?U)\S")
    return let(F.when(given, let(parts, judged)).otherwise(nothing), lambda made: made)


def curve_format(points: Column) -> Column:
    """Points back to text; no curve is an empty string."""
    text = F.array_join(
        F.transform(points, lambda p: F.concat(p["x"].cast("string"), F.lit(":"), p["y"].cast("string"))), ","
    )
    return F.coalesce(text, F.lit(""))


def output_name_error(name: Column) -> Column:
    """First violated rule of a portable file name, null when fine."""
    stem = F.upper(F.substring_index(name, ".", 1))
    return (
        F.when((name == "") | (F.octet_length(name) > MAX_OUTPUT_NAME_BYTES), "length")
        .when(name.isin(".", ".."), "not a file name")
        .when(name.rlike(r"[. ]\z"), "ends with a dot or space")
        .when(name.rlike(r'[\p{Cc}/\\:*?"<>|]'), "reserved character")
        .when(stem.rlike(r"\A(CON|PRN|AUX|NUL|(COM|LPT)[1-9])\z"), "reserved device name")
    )


def ocr_language_error(language: Column, engine: Column) -> Column:
    """Length, control characters, and the one language of the small engine."""
    text = F.regexp_replace(language, r"(?U)^\s+|\s+$", "")
    return (
        F.when((text == "") | (F.octet_length(text) > MAX_LANGUAGE_BYTES), "length")
        .when(text.rlike(r"\p{Cc}"), "control characters")
        .when((F.lower(engine) == "ocrs") & (language != "eng"), "engine supports only eng")
    )


def setting_rules() -> list[tuple[str, Column]]:
    """(rule, violated) pairs over the settings struct ``s``."""
    c = lambda name: F.col(f"s.{name}")
    films = [p["film_id"] for p in film_profiles()]
    tiers = [*TIER_ALIASES, *TIER_OFF]
    crop, w, h = c("crop"), c("default_width"), c("default_height")
    size = F.greatest(w, F.lit(1)).cast("bigint") * F.greatest(h, F.lit(1)) * 3
    not_in = lambda name, allowed: ~F.lower(c(name)).isin(*allowed)
    finite = lambda name: ~F.isnan(c(name))
    side = lambda i: F.get(crop, F.lit(i))
    short = F.exists(c("curves"), lambda p: p.isNull() | (F.size(p) != 2))
    points = F.transform(c("curves"), lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("y")))
    return [
        ("output_name", output_name_error(c("output_name")).isNotNull()),
        ("output_format", not_in("output_format", IMAGE_FORMATS)),
        ("multipage_format", not_in("multipage_format", MULTIPAGE_FORMATS)),
        ("ocr_engine", not_in("ocr_engine", OCR_ENGINES)),
        ("ocr_language", ocr_language_error(c("ocr_language"), c("ocr_engine")).isNotNull()),
        ("dpi", c("default_dpi") < 50),
        ("both extents or neither", (w == 0) != (h == 0)),
        ("extent", (F.greatest(w, h) > MAX_AXIS) | (size > MAX_PAGE_BYTES)),
        ("paper_size", not_in("paper_size", PAPER_MM)),
        ("batch_pages", ~c("batch_pages").between(1, 1000)),
        ("saturation", ~finite("saturation") | ~c("saturation").between(-100.0, 100.0)),
        ("hue", ~finite("hue") | ~c("hue").between(-180.0, 180.0)),
        ("curves", F.coalesce(short, F.lit(False)) | curve_parse(curve_format(points))["error"].isNotNull()),
        ("rotate", c("rotate") % 90 != 0),
        ("levels_gamma", ~finite("levels_gamma") | (c("levels_gamma") <= 0)),
        ("deskew_angle", ~finite("deskew_angle") | (F.abs(c("deskew_angle")) > 45.0)),
        ("film_type", c("film_type").isNotNull() & ~is_off(c("film_type")) & ~F.trim(c("film_type")).isin(*films)),
        ("brightness", ~c("brightness").between(-100, 100)),
        ("contrast", ~c("contrast").between(-100, 100)),
        ("levels range", ~c("levels_black").between(0, 255) | ~c("levels_white").between(0, 255)),
        ("levels order", c("levels_black") >= c("levels_white")),
        ("sharpen_amount", ~finite("sharpen_amount") | ~c("sharpen_amount").between(0.0, 5.0)),
        ("descreen_dpi", ~c("descreen_dpi").between(25, 1200)),
        ("infrared_clean", ~F.lower(F.trim(c("infrared_clean"))).isin(*tiers)),
        ("grain_reduction", ~F.lower(F.trim(c("grain_reduction"))).isin(*tiers)),
        ("colorize_mode", ~is_off(c("colorize_mode")) & ~F.lower(F.trim(c("colorize_mode"))).isin(*TINT_NAMES)),
        ("crop", crop.isNotNull() & ((F.size(crop) != 4) | (side(0) < 0) | (side(1) < 0) | (side(2) < 1) | (side(3) < 1))),
    ]


def settings_validate(df: DataFrame, key: str) -> DataFrame:
    """One row per violated rule: key, rule.  A narrow generate, no shuffle."""
    flags = F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in setting_rules()])
    return df.select(key, F.explode(F.filter(flags, lambda r: r.isNotNull())).alias("rule"))


def redact_keys(text: Column) -> Column:
    """Drop licence, serial and DRM keys of a JSON object, also in objects
    inside it at any depth; arrays are left as they are.

    A JSON text has no fixed depth, so each is walked by a small function over
    Arrow batches with a list of open objects instead of a nested expression.
    Null stays null; a text that is not a JSON object gives null.
    """
    return _redacted(text)


@F.pandas_udf(T.StringType())
def _redacted(texts: pd.Series) -> pd.Series:
    secret = frozenset(REDACTED_KEYS)

    def clean(text: str | None) -> str | None:
        try:
            whole = json.loads(text) if text is not None else None
        except (ValueError, RecursionError):
            return None
        if not isinstance(whole, dict):
            return None
        open_ = [whole]
        while open_:
            here = open_.pop()
            for key in [k for k in here if k.lower() in secret]:
                del here[key]
            open_ += [v for v in here.values() if isinstance(v, dict)]
        return json.dumps(whole, ensure_ascii=False, separators=(",", ":"))

    return texts.map(clean)
