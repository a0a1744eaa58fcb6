"""Job events reduced to reports, progress and output reconciliation.

``events``: job_id, seq, kind, phase, path, output, error and, where jobs end
regularly, ``paths`` (array) and ``reason``; kind is one of
progress | published | raw | publishing | finish | cancel | fail.

* ``published`` adds a file of the kind ``output``; a page is one side.
* ``raw`` adds a file of the kind ``raw``, which is no side.
* ``finish`` adds its ``paths`` (of the kind ``output``, else page) in their order and
  sets the sides to their number; without ``paths`` it leaves the sides as they are.
  ``reason`` says why the pages ended.
* A path is one file; its first event decides its kind.
* ``seq`` orders the events of a job; pages count as sides if they follow the last finish that set them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scale import ORDER_BLOCK, prefix_scan

PHASES = {
    "open": "Acquiring", "acquire": "Acquiring", "batch": "Acquiring",
    "pipeline": "Processing", "save": "Publishing", "done": "Publishing",
}
TERMINALS = {"finish": "Completed", "cancel": "Cancelled", "fail": "Failed"}


def phase_after(kind: Column, phase: Column) -> Column:
    """Phase an event moves the job to; null keeps the current one."""
    named = F.lit(None).cast("string")
    for name, target in PHASES.items():
        named = F.when(phase == name, target).otherwise(named)
    return F.when(kind == "progress", named).when(kind == "publishing", "Publishing").when(kind.isin(*TERMINALS), "Finished")


def terminal_of(kind: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, target in TERMINALS.items():
        out = F.when(kind == name, target).otherwise(out)
    return out


def with_end_columns(events: DataFrame) -> DataFrame:
    """Events that never carry ``paths`` or ``reason`` get them as nulls."""
    for name, kind in (("paths", "array<string>"), ("reason", "string")):
        if name not in events.columns:
            events = events.withColumn(name, F.lit(None).cast(kind))
    return events


def file_rows(events: DataFrame) -> DataFrame:
    """One row per file that an event adds, and one for an event without files.

    ``head`` marks the first row of each event; ``assigned`` is the number of
    sides that a finish sets, ``page`` whether the row is a published page.
    """
    events = with_end_columns(events)
    kind = F.col("kind")
    one = F.array(F.struct(F.lit(0).alias("ordinal"), F.col("path").alias("path"), F.when(kind == "raw", "raw").otherwise(F.col("output")).alias("output")))
    of_finish = F.transform("paths", lambda p, i: F.struct(i.alias("ordinal"), p.alias("path"), F.coalesce("output", F.lit("page")).alias("output")))
    files = F.when(kind.isin("published", "raw"), one).when(kind == "finish", of_finish)
    rows = events.select(
        "job_id",
        "seq",
        phase_after(kind, F.col("phase")).alias("moved"),
        terminal_of(kind).alias("ended"),
        F.when(kind == "fail", F.col("error")).alias("error"),
        F.when(kind == "finish", F.col("reason")).alias("reason"),
        F.when(kind == "finish", F.size("paths")).alias("assigned"),
        ((kind == "published") & F.coalesce(F.col("output") == "page", F.lit(False))).alias("page"),
        F.explode_outer(files).alias("file"),
    )
    return rows.select(
        "job_id",
        "seq",
        (F.coalesce("file.ordinal", F.lit(0)) == 0).alias("head"),
        "moved",
        "ended",
        "error",
        "reason",
        # size() of a null array is null or -1 by the session's settings.
        F.when(F.col("assigned") >= 0, F.col("assigned").cast("bigint")).alias("assigned"),
        "page",
        F.coalesce("file.ordinal", F.lit(0)).alias("ordinal"),
        F.col("file.path").alias("path"),
        F.col("file.output").alias("output"),
    )


def sides_complete(events: DataFrame) -> DataFrame:
    """job_id, sides_complete: the last assignment of a job and the pages after it.

    Both are taken per block of ``seq`` first.  A block of one job is at most
    ORDER_BLOCK places wide, so the only rows that are joined, those of the block that
    holds the last assignment, never make a hot key; all other blocks count as one number.
    """
    events = with_end_columns(events)
    page = (F.col("kind") == "published") & (F.col("output") == "page")
    told = F.when((F.col("kind") == "finish") & F.col("paths").isNotNull(), F.size("paths").cast("bigint"))
    rows = events.select("job_id", "seq", F.floor(F.col("seq") / ORDER_BLOCK).alias("block"), told.alias("assigned"), page.alias("page"))
    blocks = rows.groupBy("job_id", "block").agg(
        F.count_if("page").alias("pages"),
        F.max(F.when(F.col("assigned").isNotNull(), F.struct("seq", "assigned", F.col("block").alias("at")))).alias("last"),
    )
    lasts = blocks.groupBy("job_id").agg(F.max("last").alias("last"))
    set_ = lasts.where("last is not null").select("job_id", F.col("last.at").alias("block"), F.col("last.seq").alias("from_seq"))
    before = lasts.select("job_id", F.coalesce("last.assigned", F.lit(0)).alias("n"))
    whole = blocks.select("job_id", "block", "pages").join(lasts, "job_id").where("last is null or block > last.at").select("job_id", F.col("pages").alias("n"))
    inside = rows.where("page").join(set_, ["job_id", "block"]).where("seq > from_seq").groupBy("job_id", "block").agg(F.count("*").alias("n"))
    return before.unionByName(whole).unionByName(inside.select("job_id", "n")).groupBy("job_id").agg(F.sum("n").alias("sides_complete"))


def merge_reports(parts: DataFrame) -> DataFrame:
    """Pieces of one job (moved, ended, files, events; the paths of two pieces differ) to its report."""
    merged = parts.groupBy("job_id").agg(
        F.max("moved").alias("moved"),
        F.max("ended").alias("ended"),
        F.sum("files").alias("published_files"),
        F.sum("events").alias("events"),
    )
    return merged.select(
        "job_id",
        F.coalesce("moved.phase", F.lit("Preparing")).alias("phase"),
        F.col("ended.terminal").alias("terminal"),
        F.col("ended.error").alias("error"),
        F.col("ended.reason").alias("end_reason"),
        "published_files",
        "events",
    )


REPORT = ("job_id", "phase", "terminal", "error", "end_reason", "sides_complete", "published_files", "events")


def job_report(events: DataFrame) -> DataFrame:
    """One report per job; every step is a combinable aggregate."""
    rows = file_rows(events)
    # Paths first: one row per job and path, combined before the shuffle.
    parts = rows.groupBy("job_id", "path").agg(
        F.max(F.when(F.col("moved").isNotNull(), F.struct("seq", F.col("moved").alias("phase")))).alias("moved"),
        F.max(F.when(F.col("ended").isNotNull(), F.struct("seq", F.col("ended").alias("terminal"), "error", "reason"))).alias("ended"),
        F.count_if("head").alias("events"),
        F.when(F.col("path").isNotNull(), 1).otherwise(0).alias("files"),
    )
    return merge_reports(parts).join(sides_complete(events), "job_id").select(*REPORT)


def published_files(events: DataFrame) -> DataFrame:
    """First publication of every path in order: job_id, position, seq, path, output."""
    first = (
        file_rows(events)
        .where("output is not null or path is not null")
        .groupBy("job_id", "path")
        .agg(F.min(F.struct("seq", "ordinal", "output")).alias("first"))
        .select("job_id", "path", F.col("first.seq").alias("seq"), F.col("first.ordinal").alias("ordinal"), F.col("first.output").alias("output"))
    )
    return prefix_scan(first, ["job_id"], "seq", ("ordinal", "path"), out="position").select("job_id", "position", "seq", "path", "output")


def job_progress(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Fraction and message reported before each page.  ``totals``: job_id, total."""
    from ..functions.scale import salted_join

    joined = salted_join(pages, totals, ["job_id"], F.col("page_no"))
    return joined.select(
        "job_id",
        "page_no",
        F.lit("batch").alias("phase"),
        ((F.col("page_no") - 1) / F.col("total")).alias("percent"),
        F.concat(F.lit("page "), F.col("page_no").cast("string"), F.lit("/"), F.col("total").cast("string")).alias("message"),
    )


def output_reconcile(requested: DataFrame, published: DataFrame) -> DataFrame:
    """missing | unexpected | published per job and path (full outer join)."""
    asked = requested.select("job_id", "path").distinct().withColumn("_asked", F.lit(True))
    made = published.select("job_id", "path").distinct().withColumn("_made", F.lit(True))
    status = F.when(F.col("_made").isNull(), "missing").when(F.col("_asked").isNull(), "unexpected").otherwise("published")
    return asked.join(made, ["job_id", "path"], "full_outer").select("job_id", "path", status.alias("status"))


def _extension(path: Column) -> Column:
    """What follows the last dot of the last part of a path, lower-cased; null without one or where it begins the name."""
    found = F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))
    return F.when(found != "", found)


def _named(path: Column, extension: str) -> Column:
    """The path itself, or with an extension where it has none."""
    return F.when(_extension(path).isNull(), F.concat(path, F.lit("." + extension))).otherwise(path)


#: Container formats of the three places a multipage document can be asked for in.
CONTAINERS = {"multipage_out": ["pdf", "tif", "tiff"], "multipage_tiff": ["tif", "tiff"], "multipage_pdf": ["pdf"]}
IMAGES = ["bmp", "gif", "jpeg", "jpg", "jxl", "pdf", "png", "tif", "tiff", "webp"]


def _page_folder() -> Column:
    return F.regexp_replace("out_dir", "/+$", "")


def _page_digits() -> Column:
    return F.greatest(F.lit(3), F.length(F.col("pages").cast("string")))


def _page_extension() -> Column:
    return F.regexp_replace("format", r"^\.+", "")


def _page_number() -> Column:
    return F.greatest(F.col("pages").cast("int"), F.lit(1))


def requested_outputs(requests: DataFrame) -> DataFrame:
    """job_id, kind, path, place, error: every file that a job request asks for.

    ``requests``: job_id, out (single scan) or out_dir, pages and format (batch),
    raw_out, multipage_out, multipage_tiff, multipage_pdf, contact_sheet.  ``kind``
    is image | raw | page | document | contact_sheet.  A document without extension becomes
    a tif, a contact sheet a bmp; ``error`` names a destination whose extension is
    missing or not allowed there.  Null columns ask for nothing; pages are bounded by a batch's limit.
    """
    out, single = F.col("out"), F.col("out").isNotNull()
    batch = F.col("out_dir").isNotNull()
    digits, extension = _page_digits(), _page_extension()

    def asked(place: str, kind: Column | str, path: Column, allowed: list[str], there: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        bad = _extension(path)
        error = F.when(bad.isNull(), F.lit("no extension")).when(~bad.isin(allowed), F.concat(F.lit("extension not allowed: "), bad))
        return F.when(there, F.struct(kind.alias("kind"), path.alias("path"), F.lit(place).alias("place"), error.alias("error")))

    def page(n: Column) -> Column:
        name = F.concat(F.lit("page_"), F.lpad(n.cast("string"), digits, F.lit("0")), F.lit("."), extension)
        return F.struct(F.lit("page").alias("kind"), F.concat_ws("/", _page_folder(), name).alias("path"), F.lit("page").alias("place"), F.lit(None).cast("string").alias("error"))

    named = [
        asked("out", F.when(_extension(out) == "pdf", "document").otherwise("image"), out, IMAGES, single),
        asked("raw_out", "raw", F.col("raw_out"), IMAGES, F.col("raw_out").isNotNull()),
        *(
            asked(place, "document", _named(F.col(place), "tif") if place == "multipage_out" else F.col(place), allowed, batch & F.col(place).isNotNull())
            for place, allowed in CONTAINERS.items()
        ),
        asked("contact_sheet", "contact_sheet", _named(F.col("contact_sheet"), "bmp"), IMAGES, batch & F.col("contact_sheet").isNotNull()),
    ]
    pages = F.when(batch & (F.col("pages") > 0), F.transform(F.sequence(F.lit(1), _page_number()), page))
    rows = F.concat(F.array_compact(F.array(*named)), F.coalesce(pages, F.array().cast("array<struct<kind:string,path:string,place:string,error:string>>")))
    return requests.select("job_id", F.explode(rows).alias("o")).select("job_id", "o.kind", "o.path", "o.place", "o.error")


#: Places in the order in which they are listed; sets of them are sums of powers of two.
PLACES = sorted(["out", "raw_out", *CONTAINERS, "contact_sheet", "page"])
#: Pages of a series that are compared with present files at a time.
SERIES_BLOCK = 64
_SERIES = ["stem", "digits", "extension"]


def _in_series() -> Column:
    """A batch whose pages have one name but for their number: every one of them is another file."""
    return F.coalesce(F.col("out_dir").isNotNull() & (F.col("pages") > 0) & ~F.contains(_page_extension(), F.lit("/")), F.lit(False))


def page_series(requests: DataFrame) -> DataFrame:
    """job_id, stem, digits, extension, pages: the numbered pages of each batch as one row.

    Page n is the file ``stem``, n in ``digits`` digits, a dot and ``extension``, resolved as ``normal_path``
    does; the last part of such a path is never a dot part, so what is before the number resolves by itself.
    """
    from .manifest import normal_path

    stem = normal_path(F.concat_ws("/", _page_folder(), F.lit("page_")))
    return requests.where(_in_series()).select("job_id", stem.alias("stem"), _page_digits().alias("digits"), _page_extension().alias("extension"), _page_number().alias("pages"))


def _series_of(paths: DataFrame) -> DataFrame:
    """Paths (``target``) that name a page of a series, with its parts and the number ``n``."""
    part = [F.regexp_extract("target", r"(?s)\A((?:.*/)?page_)([0-9]{3,})\.([^/]*)\z", k) for k in (1, 2, 3)]
    found = paths.withColumns({"stem": part[0], "_n": part[1], "extension": part[2]}).where("_n <> ''")
    return found.withColumns({"digits": F.length("_n"), "n": F.expr("try_cast(_n AS BIGINT)")}).drop("_n").where("n > 0")


def _page_target() -> Column:
    return F.concat("stem", F.lpad(F.col("n").cast("string"), F.col("digits"), F.lit("0")), F.lit("."), "extension")


def _claims(rows: DataFrame) -> DataFrame:
    """job_id, path, places of (job_id, target, place) rows: where the claims on each path come from."""
    bit = F.element_at(F.create_map(*[F.lit(v) for k, p in enumerate(PLACES) for v in (p, 1 << k)]), F.col("place"))
    found = rows.select("job_id", "target", bit.alias("_bit")).groupBy("job_id", "target").agg(F.bit_or("_bit").alias("_bits"))
    named = [F.when(F.col("_bits").bitwiseAND(1 << k) > 0, F.lit(p)) for k, p in enumerate(PLACES)]
    return found.select("job_id", F.col("target").alias("path"), F.concat_ws(",", *named).alias("places"))


def destination_problems(requests: DataFrame, present: DataFrame | None = None) -> DataFrame:
    """job_id, path, places, problem: destinations that a batch must refuse before it starts.

    A bad extension, two destinations of a job that resolve to one path, and, with
    ``present`` (path) and without a true ``overwrite`` in the request, a file that exists.
    One row per path and problem, however many claim it.

    The pages of a batch are one row (``page_series``), however many they are: only those that
    something else claims, or that exist, become rows of their own.  Pages of a format that names a
    folder, or of none, are listed singly, with all other files.
    """
    from .manifest import normal_path

    apart = requests.withColumn("pages", F.when(~_in_series(), F.col("pages")))
    asked = requested_outputs(apart).withColumn("target", normal_path(F.col("path")))
    series = page_series(requests)
    refused = asked.where("error is not null").select("job_id", F.col("target").alias("path"), F.col("place").alias("places"), F.col("error").alias("problem"))
    # Batches of a job with the same names: the longest, and the next one, whose pages are all claimed twice.
    falling = Window.partitionBy("job_id", *_SERIES).orderBy(F.desc("pages"))
    lengths = series.select("*", F.row_number().over(falling).alias("_at"), F.lead("pages").over(falling).alias("_again")).where("_at = 1")
    twice = lengths.where("_again > 0").withColumn("n", F.explode(F.sequence(F.lit(1), F.col("_again"))))
    twice = twice.select("job_id", _page_target().alias("target"), F.lit("page").alias("place"), F.lit(2).alias("claims"))
    single = asked.select("job_id", "target", "place", F.lit(1).alias("claims"))
    meet = _series_of(single.select("job_id", "target")).alias("a").join(
        lengths.alias("b"), [F.col("a.job_id").eqNullSafe(F.col("b.job_id")), *[F.col(f"a.{c}") == F.col(f"b.{c}") for c in _SERIES], F.col("a.n") <= F.col("b.pages")]
    )
    meet = meet.select("a.job_id", "a.target", F.lit("page").alias("place"), F.lit(1).alias("claims"))
    # Hardly any path is claimed twice, so rows are sorted by path, which spills, before the few that are go to a hash table.
    every = single.unionByName(twice).unionByName(meet).withColumn("_all", F.sum("claims").over(Window.partitionBy("job_id", "target")))
    shared = _claims(every.where("_all > 1")).select("job_id", "path", "places", F.lit("claimed more than once").alias("problem"))
    out = refused.unionByName(shared)
    if present is None:
        return out
    overwrite = F.coalesce("overwrite", F.lit(False)) if "overwrite" in requests.columns else F.lit(False)
    there = present.select(normal_path(F.col("path")).alias("target")).distinct().hint("merge")
    block = (F.col("n") - 1 - (F.col("n") - 1) % SERIES_BLOCK) / SERIES_BLOCK
    numbered = _series_of(there).withColumn("_block", block.cast("int")).hint("merge")
    blocks = series.withColumn("_block", F.explode(F.sequence(F.lit(0), ((F.col("pages") - 1) / SERIES_BLOCK).cast("int"))))
    pages = blocks.join(numbered, [*_SERIES, "_block"]).where("n <= pages").select("job_id", "target", F.lit("page").alias("place"))
    found = pages.unionByName(single.join(there, "target", "left_semi").select("job_id", "target", "place"))
    kept = found.join(requests.where(~overwrite).select("job_id").hint("merge"), "job_id", "left_semi")
    return out.unionByName(_claims(kept).select("job_id", "path", "places", F.lit("exists").alias("problem")))
