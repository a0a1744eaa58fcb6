"""The processing plan: a fixed order of optional stages over page strips."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lines import blocks, lines_of
from ..functions.scale import PAGE_BAND, cut_lineage, join_page_stats, release
from ..operators import film as film_ops
from ..operators import filters, geometry, profile, tables, tone
from ..operators.raster import STRIP_COLUMNS

OFF = ("", "off", "none", "false")
DEFAULTS = {
    "crop": None, "rotate": 0, "flip_h": False, "flip_v": False, "deskew_angle": 0.0, "auto_deskew": False,
    "brightness": 0, "contrast": 0, "desaturate": False, "levels_black": 0, "levels_white": 255, "levels_gamma": 1.0,
    "white_balance": False, "saturation": 0.0, "hue": 0.0, "curves": None, "auto_levels": False, "invert": False,
    "sharpen_amount": 0.0, "infrared_clean": None, "descreen": False, "descreen_dpi": 75, "grain_reduction": None,
    "restore_colors": False, "restore_fading": False, "flatten": False, "hole_punch": False, "colorize_mode": None,
    "film_type": None, "auto_orient": False, "auto_crop": False,
}


def _named(value: str | None) -> str | None:
    """The trimmed value, or None for a switched-off one."""
    text = (value or "").strip()
    return None if text.lower() in OFF else text


def _film(strips: DataFrame, film_id: str) -> DataFrame:
    catalog = film_ops.film_catalog(strips.sparkSession)
    return film_ops.film_convert(strips.withColumn("film_id", F.lit(film_id)), catalog)


def plan_stages(prefs: dict) -> Iterator[tuple[str, bool, Callable[[DataFrame], DataFrame]]]:
    """Enabled stages in order: (name, reads page statistics, transform).

    A disabled stage yields nothing, so it leaves no node in the plan.
    """
    p = {**DEFAULTS, **prefs}
    if p["crop"] is not None:
        yield "crop", False, lambda s: geometry.crop(s, *p["crop"])
    if p["rotate"] % 360 in (90, 180, 270):
        yield "rotate", False, lambda s: geometry.rotate(s, p["rotate"])
    if p["flip_h"]:
        yield "flip_h", False, geometry.flip_h
    if p["flip_v"]:
        yield "flip_v", False, geometry.flip_v
    if abs(p["deskew_angle"]) >= 0.05:
        yield "deskew", True, lambda s: geometry.deskew_by(s, p["deskew_angle"])
    elif p["auto_deskew"]:
        yield "auto_deskew", True, geometry.auto_deskew
    if p["brightness"] or p["contrast"]:
        yield "brightness_contrast", False, lambda s: tone.brightness_contrast(s, p["brightness"], p["contrast"])
    if p["desaturate"]:
        yield "desaturate", False, tone.desaturate
    if (p["levels_black"], p["levels_white"]) != (0, 255) or abs(p["levels_gamma"] - 1.0) >= 1e-9:
        yield "levels", False, lambda s: tone.levels(s, p["levels_black"], p["levels_white"], p["levels_gamma"])
    if p["white_balance"]:
        yield "white_balance", True, tone.white_balance
    if abs(p["saturation"]) >= 1e-9:
        yield "saturation", False, lambda s: tone.saturation(s, p["saturation"])
    if abs(p["hue"]) >= 1e-9:
        yield "hue_shift", False, lambda s: tone.hue_shift(s, p["hue"])
    if p["curves"] is not None and len(p["curves"]) >= 2:
        yield "curves", False, lambda s: tone.curves(s, p["curves"])
    if p["auto_levels"]:
        yield "auto_levels", True, tone.auto_levels
    if p["invert"]:
        yield "invert", False, tone.invert
    if p["sharpen_amount"] > 0:
        yield "sharpen", False, lambda s: filters.sharpen(s, p["sharpen_amount"])
    if _named(p["infrared_clean"]):
        yield "dust_clean", False, lambda s: filters.dust_clean(s, p["infrared_clean"])
    if p["descreen"]:
        yield "descreen", False, lambda s: filters.descreen(s, p["descreen_dpi"])
    if _named(p["grain_reduction"]):
        yield "grain_reduction", False, lambda s: filters.grain_reduction(s, p["grain_reduction"])
    if p["restore_colors"]:
        yield "restore_colors", False, tone.restore_colors
    if p["restore_fading"]:
        yield "restore_fading", True, tone.restore_fading
    if p["flatten"]:
        yield "flatten", False, tone.flatten_paper
    if p["hole_punch"]:
        yield "hole_punch", False, filters.hole_punch
    if _named(p["colorize_mode"]):
        yield "colorize", False, lambda s: tone.colorize(s, p["colorize_mode"])
    if _named(p["film_type"]):
        yield "film_convert", False, lambda s: _film(s, _named(p["film_type"]))
    if p["auto_orient"]:
        yield "orientation_apply", True, geometry.orientation_apply
    if p["auto_crop"]:
        yield "auto_crop", True, geometry.auto_crop


#: Stages that move samples between lines or tasks, so that reading their outcome twice is dear.
MOVING = {"rotate", "deskew", "auto_deskew", "sharpen", "dust_clean", "descreen", "grain_reduction", "orientation_apply", "auto_crop"}


#: Stages that change the samples of each pixel alone and keep other columns: tables can wait beside them.
COLOUR = {"desaturate", "saturation", "hue_shift"}


def table_step(name: str, prefs: dict) -> tables.Step | None:
    """The stage as a map of single values, or None if it is none."""
    p = {**DEFAULTS, **prefs}
    made = {
        "brightness_contrast": lambda: tone.brightness_contrast_table(p["brightness"], p["contrast"]),
        "levels": lambda: tone.levels_table(p["levels_black"], p["levels_white"], p["levels_gamma"]) or list(range(256)),
        "white_balance": lambda: tables.white_balance,
        "curves": lambda: tone.curve_table(p["curves"]),
        "auto_levels": lambda: tables.auto_levels(),
        "invert": lambda: [255 - v for v in range(256)],
        "restore_fading": lambda: tables.restore_fading,
        "flatten": tone.flatten_table,
    }
    return made[name]() if name in made else None


def process_pages(strips: DataFrame, prefs: dict) -> DataFrame:
    """Apply the enabled stages; pages the crop does not fit are in ``plan_rejects``.

    Neighbouring stages that map single values become one table per page: its statistics
    follow from the counts at the chain's start, and only the tables are written.  They wait for those
    of later chains, as long as only pixels are changed between them, and meet the lines in one join.  The samples
    themselves are written (deflated, reliable checkpoint in the shared folder) only where a stage that
    moved them is followed by one that reads its input twice.
    """
    unknown = set(prefs) - set(DEFAULTS)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    chain: list[tables.Step] = []
    waiting: list[Map] = []
    moved = False

    def settled(twice: bool) -> None:
        nonlocal moved, strips
        if twice and moved:
            moved = False
            strips = lines_of(cut_lineage(blocks(strips, PAGE_BAND)), band=PAGE_BAND)

    def end_chain() -> None:
        nonlocal chain
        steps, chain = chain, []
        if any(map(callable, steps)):
            settled(True)
            waiting.append((cut_lineage(tables.page_tables(_mapped(strips, waiting), steps)), lambda s: tables.checked(s, steps)))
        elif steps:
            waiting.append((None, lambda s: tables.apply_chain(s, steps)))

    def freed() -> None:
        """What only the tables of several chains were made from is not kept beside what follows."""
        if sum(table is not None for table, _ in waiting) > 1:
            release(strips.sparkSession)

    for name, reads_twice, transform in plan_stages(prefs):
        step = table_step(name, prefs)
        if step is not None:
            chain.append(step)
            continue
        end_chain()
        if name in COLOUR:
            waiting.append((None, transform))
            continue
        freed()
        strips, waiting = _mapped(strips, waiting), []
        settled(reads_twice)
        strips = transform(strips)
        moved |= name in MOVING
    end_chain()
    freed()
    strips = _mapped(strips, waiting)
    return strips if strips.columns == STRIP_COLUMNS else strips.select(STRIP_COLUMNS)


#: Page tables, if the map has some, and what follows them.
Map = tuple[DataFrame | None, Callable[[DataFrame], DataFrame]]


def _mapped(strips: DataFrame, maps: list[Map]) -> DataFrame:
    """All maps in order; the tables of every one of them come to the lines in one join."""
    given = [table for table, _ in maps if table is not None]
    if len(given) == 1 and maps[0][0] is not None:
        strips = tables.apply_page_tables(strips, given[0])
        for _, change in maps:
            strips = change(strips)
        return strips
    if given:
        strips = tables.with_page_tables(strips, given)
    n = 0
    for table, change in maps:
        if table is not None:
            strips, n = tables.apply_tables(strips, f"_tables_{n}"), n + 1
        strips = change(strips)
    return strips


def plan_rejects(strips: DataFrame, prefs: dict) -> DataFrame:
    """page_id, reason of the pages that the plan cannot take, because its crop does not fit them.

    These pages and those of ``process_pages`` together are the input.
    """
    rectangle = {**DEFAULTS, **prefs}["crop"]
    if rectangle is None:
        return strips.where("false").select("page_id", F.lit("").alias("reason"))
    return geometry.crop_rejected(strips, *rectangle)


def process_by_plan(strips: DataFrame, plans: DataFrame, group: int = 64) -> tuple[DataFrame, DataFrame]:
    """Per-page plans: ``plans`` has page_id and ``prefs`` (JSON text).  Returns strips and rejects (page_id, reason).

    Every page of the input is in one of the two; a page without a plan passes unchanged.
    Pages are grouped by distinct plan, so each plan compiles once.  Only the
    distinct plan texts reach the driver.  Each plan is a branch of the query,
    so after every ``group`` of them what is done is written and read again.
    """
    texts = [r["prefs"] for r in plans.select("prefs").distinct().collect()]
    tagged = join_page_stats(strips, plans.select("page_id", "prefs"), "left")
    out = tagged.where("prefs is null").select(STRIP_COLUMNS)
    rejects = plan_rejects(tagged.where("false"), {})
    for n, text in enumerate(sorted(t for t in texts if t is not None), 1):
        part = tagged.where(F.col("prefs") == text).select(STRIP_COLUMNS)
        plan = json.loads(text)
        out = out.unionByName(process_pages(part, plan))
        if plan.get("crop") is not None:
            rejects = rejects.unionByName(plan_rejects(part, plan))
        if n % group == 0:
            out, rejects = cut_lineage(out), cut_lineage(rejects)
    return out, rejects


def page_kernel(
    strips: DataFrame,
    prefs: dict,
    profiles: DataFrame | None = None,
    profile_id: int = 0,
    extra_white_balance: bool = False,
    recognize: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame | None, DataFrame]:
    """Plan, optional extra white balance, optional profile, optional text.

    ``profiles`` has profile_id, matrix, gamma; ``profile_id`` names the one to use.
    Returns the final strips, the text table (page_id, text, confidence) and the
    rejects (page_id, reason): a page of the input is in the strips or the rejects.
    """
    out = process_pages(strips, prefs)
    if extra_white_balance:
        out = tables.apply_chain(out, [tables.white_balance])
    if profiles is not None:
        out = profile.apply_profile(out.withColumn("profile_id", F.lit(profile_id)), profiles)
    texts = recognize(out) if recognize else None
    return out, texts, plan_rejects(strips, prefs)


def page_transform(strips: DataFrame, hook: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """User hook: any DataFrame function that keeps the strip columns."""
    out = strips.transform(hook)
    missing = [c for c in STRIP_COLUMNS if c not in out.columns]
    if missing:
        raise ValueError(f"page transform dropped columns: {missing}")
    return out.select(STRIP_COLUMNS)
