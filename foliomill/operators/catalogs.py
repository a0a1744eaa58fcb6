"""Device makers, device lists, resolutions, paper and scan extents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import PAPER_MM, PREFERRED_BACKENDS, manufacturers
from ..functions.columns import clamp, int_div, literal_structs
from ..functions.scale import salted_join

HIDDEN_TEXT = r"[\p{Cc}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}\x{FEFF}]"
MAX_NAME_CHARS = 128


# --- makers ---------------------------------------------------------------


def vid_of(query: Column) -> Column:
    """First standalone four-hex token, with an optional 0x or vid_ prefix."""
    tokens = F.transform(
        F.split(F.lower(query), r"[\s:&,;/]"), lambda t: F.regexp_replace(t, r"^(0x|vid_)", "")
    )
    return F.coalesce(F.get(F.filter(tokens, lambda t: t.rlike("^[0-9a-f]{4}$")), F.lit(0)), F.lit(""))


def token_pattern(token: str) -> str:
    """Regular expression for one name token.

    A token with punctuation must start a word, a short token must be a whole
    word, a longer one may sit anywhere.
    """
    if not token.isalnum():
        return r"(?<![\p{L}\p{N}])" + "".join(c if c.isalnum() else "\\" + c for c in token)
    if len(token) > 3:
        return token
    return r"(?<![\p{L}\p{N}])" + token + r"(?![\p{L}\p{N}])"


def _entries(catalog: list[dict] | None) -> list[dict]:
    return manufacturers() if catalog is None else catalog


def resolve_columns(query: Column, catalog: list[dict] | None = None) -> Column:
    """Struct(id, name, status, matched_by, message) for a query string.

    The catalog is a fixed short list, so it is folded into the expression:
    VID first, then the first entry in catalog order with a matching token.
    No join and no shuffle.
    """
    entries = _entries(catalog)
    trimmed = F.regexp_replace(query, r"(?U)^\s+|\s+$", "")
    lowered, vid = F.lower(trimmed), vid_of(trimmed)

    def hit(entry: dict, by: str, message: Column) -> Column:
        return F.struct(
            F.lit(entry["id"]).alias("id"),
            F.lit(entry["name"]).alias("name"),
            F.lit("ok").alias("status"),
            F.lit(by).alias("matched_by"),
            message.alias("message"),
        )

    def unknown(message: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(
            none.alias("id"), none.alias("name"), F.lit("unknown").alias("status"), none.alias("matched_by"), F.lit(message).alias("message")
        )

    chain = F.when(trimmed == "", unknown("empty query"))
    for entry in entries:
        chain = chain.when(vid.isin(entry["vids"]), hit(entry, "vid", F.concat(F.lit("vid "), vid)))
    for entry in entries:
        pattern = "|".join(token_pattern(t.lower()) for t in entry["tokens"])
        chain = chain.when(lowered.rlike(pattern), hit(entry, "name_token", F.lit(f"token of {entry['name']}")))
    return chain.otherwise(unknown("no match"))


def manufacturer_resolve(devices: DataFrame, column: str = "name", catalog: list[dict] | None = None) -> DataFrame:
    found = devices.withColumn("_m", resolve_columns(F.col(column), catalog))
    return found.select(
        *devices.columns,
        F.col("_m.id").alias("manufacturer_id"),
        F.col("_m.name").alias("manufacturer_name"),
        F.col("_m.status").alias("status"),
        F.col("_m.matched_by").alias("matched_by"),
        F.col("_m.message").alias("message"),
    )


def manufacturer_catalog(spark: SparkSession, catalog: list[dict] | None = None) -> DataFrame:
    schema = "ordinal int, id string, name string, vids array<string>, tokens array<string>, media array<string>, adf boolean, ir boolean, notes string"
    rows = spark.createDataFrame([tuple(e[k] for k in ("ordinal", "id", "name", "vids", "tokens", "media", "adf", "ir", "notes")) for e in _entries(catalog)], schema)
    return rows.withColumn("backends", F.array(*[F.lit(b) for b in PREFERRED_BACKENDS]))


def manufacturer_summary(devices: DataFrame, column: str = "name") -> DataFrame:
    """Every catalog maker with its flags and the devices resolved to it."""
    counts = (
        manufacturer_resolve(devices, column)
        .groupBy(F.col("manufacturer_id").alias("id"))
        .agg(F.count(F.lit(1)).alias("devices"), F.count_if(F.col("matched_by") == "vid").alias("by_vid"))
    )
    catalog = manufacturer_catalog(devices.sparkSession)
    return catalog.join(counts, "id", "left").select(
        "id",
        "name",
        F.array_join("vids", ",").alias("vids"),
        "adf",
        "ir",
        F.coalesce("devices", F.lit(0)).alias("devices"),
        F.coalesce("by_vid", F.lit(0)).alias("by_vid"),
    )


# --- device lists ---------------------------------------------------------


def device_list(lines: DataFrame, column: str, id_prefix: str, display_prefix: str, kind: str) -> DataFrame:
    """``id|name`` lines to device rows; a line without a bar is both."""
    line = F.regexp_replace(F.col(column), r"(?U)^\s+|\s+$", "")
    parts = F.split(line, r"\|", 2)
    strip = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    ident = strip(parts[0])
    name = F.when(F.size(parts) > 1, strip(F.get(parts, F.lit(1)))).otherwise(line)
    keep = [c for c in lines.columns if c != column]
    return lines.where((line != "") & (ident != "")).select(
        *keep,
        F.concat(F.lit(f"{id_prefix}:"), ident).alias("id"),
        F.concat(F.lit(f"{display_prefix}: "), name).alias("name"),
        F.lit(kind).alias("kind"),
    )


def device_normalize(devices: DataFrame) -> DataFrame:
    """Hidden characters out, at most 128 characters, maker attached."""
    clean = devices.withColumn("name", F.left(F.regexp_replace("name", HIDDEN_TEXT, ""), F.lit(MAX_NAME_CHARS)))
    return manufacturer_resolve(clean).select(*devices.columns, "manufacturer_id", "manufacturer_name")


def device_inventory(sources: list[DataFrame], cap: int) -> DataFrame:
    """Union of device sources, first of each id kept, first ``cap`` overall.

    ``sources``: id, name, kind, position (their own order).  Duplicates fold in
    a map-side combined aggregate; the cap is a top-k over the source order.
    """
    merged = None
    for ordinal, source in enumerate(sources):
        part = source.select("id", F.struct(F.lit(ordinal).alias("source"), "position", "name", "kind").alias("rank"))
        merged = part if merged is None else merged.unionByName(part)
    first = merged.groupBy("id").agg(F.min("rank").alias("rank"))
    return (
        first.orderBy("rank.source", "rank.position", "id")
        .limit(max(1, cap))
        .select("id", F.col("rank.name").alias("name"), F.col("rank.kind").alias("kind"), F.col("rank.source").alias("source"))
    )


# --- resolutions ----------------------------------------------------------


def snap(wanted: Column, low: Column, high: Column, step: Column) -> Column:
    """Nearest value on low + n*step inside low..high."""
    pace = F.greatest(step, F.lit(1)).cast("bigint")
    offset = clamp(wanted, low, high).cast("bigint") - low
    near = low + int_div(offset + int_div(pace, 2), pace) * pace
    return F.when(near > high, near - pace).otherwise(near)


def resolution_pick(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """Nearest advertised pair per request.

    ``requests``: request_id, device, dpi_x, dpi_y.  ``capabilities``: device,
    ordinal, kind (discrete | range), x, y, min_x, max_x, step_x, min_y, max_y,
    step_y.  The short list of a device is folded into one row, so the request
    side is joined once and never grouped; discrete pairs win ties, then order.
    """
    entry = F.struct(
        F.when(F.col("kind") == "discrete", 0).otherwise(1).alias("rank"),
        "ordinal", "x", "y", "min_x", "max_x", "step_x", "min_y", "max_y", "step_y",
    )
    lists = capabilities.groupBy("device").agg(F.sort_array(F.collect_list(entry)).alias("_caps"))
    wx, wy = F.col("dpi_x").cast("bigint"), F.col("dpi_y").cast("bigint")

    def candidate(c: Column, i: Column) -> Column:
        x = F.when(c["rank"] == 0, c["x"]).otherwise(snap(wx, c["min_x"], c["max_x"], c["step_x"]))
        y = F.when(c["rank"] == 0, c["y"]).otherwise(snap(wy, c["min_y"], c["max_y"], c["step_y"]))
        return F.struct((F.abs(x - wx) + F.abs(y - wy)).alias("far"), i.alias("i"), x.alias("x"), y.alias("y"))

    joined = salted_join(requests, lists, ["device"], F.col("request_id"), "left")
    best = F.array_min(F.transform("_caps", candidate))
    return joined.select(
        *requests.columns,
        F.coalesce(best["x"], wx).alias("pick_x"),
        F.coalesce(best["y"], wy).alias("pick_y"),
    )


def resolution_closest(requested: Column, values: Column, low: Column, high: Column) -> Column:
    """Nearest listed value (smaller on ties), else clamp to the range."""
    near = F.array_min(F.transform(values, lambda v: F.struct(F.abs(v - requested).alias("far"), v.alias("v"))))["v"]
    return F.coalesce(
        near, F.when(low.isNotNull() & high.isNotNull(), F.least(F.greatest(requested, low), high)), requested
    )


# --- paper and extent -----------------------------------------------------


def paper_sizes(spark: SparkSession) -> DataFrame:
    rows = [(name, *(size or (None, None))) for name, size in PAPER_MM.items()]
    return spark.createDataFrame(rows, "paper string, width_mm double, height_mm double")


def _paper_mm(paper: Column, axis: int) -> Column:
    """Millimetres of a named size; the six fixed sizes are a literal CASE."""
    name, chain = F.lower(F.trim(paper)), F.lit(None).cast("double")
    for key, size in PAPER_MM.items():
        if size:
            chain = F.when(name == key, F.lit(size[axis])).otherwise(chain)
    return chain


def paper_pixels(paper: Column, dpi: Column, axis: int) -> Column:
    """Pixels of one paper axis (0 width, 1 height); null for auto or unknown."""
    size = _paper_mm(paper, axis)
    # greatest() skips nulls, so the absent size is kept apart.
    return F.when(size.isNotNull(), F.greatest(F.round(size / 25.4 * dpi), F.lit(1.0)).cast("bigint"))


def rescaled(pixels: Column, default_dpi: Column, dpi: Column) -> Column:
    """A stored pixel length at another resolution, half up."""
    keep = (pixels == 0) | (default_dpi == 0) | (dpi == default_dpi)
    scaled = F.call_function(
        "div", pixels.cast("bigint") * dpi + int_div(default_dpi, 2), F.nullif(default_dpi, F.lit(0)).cast("bigint")
    )
    return F.when(keep, pixels.cast("bigint")).when(scaled > 4_294_967_295, pixels.cast("bigint")).otherwise(scaled)


def scan_extent(requests: DataFrame) -> DataFrame:
    """Per axis: explicit pixels, explicit paper, configured paper, configured
    pixels.  Explicit ``auto`` paper skips the configured paper."""
    dpi = F.col("dpi")

    def axis(n: int, asked: str, stored: str) -> Column:
        explicit = paper_pixels(F.col("paper"), dpi, n)
        configured = paper_pixels(F.col("config_paper"), dpi, n)
        by_paper = F.when(F.col("paper").isNotNull(), explicit).otherwise(configured)
        return F.coalesce(F.col(asked).cast("bigint"), by_paper, rescaled(F.col(stored), F.col("default_dpi"), dpi))

    return requests.withColumn("extent_width", axis(0, "width", "default_width")).withColumn(
        "extent_height", axis(1, "height", "default_height")
    )


def configured_crop(requests: DataFrame, crop: str = "crop") -> DataFrame:
    """Rescale a stored crop struct (x, y, w, h) to the request resolution."""
    c = F.col(crop)

    def scaled(part: str) -> Column:
        value = rescaled(c[part], F.col("default_dpi"), F.col("dpi"))
        return F.when(c[part] < 0, c[part].cast("bigint")).otherwise(value).alias(part)

    return requests.withColumn("crop_scaled", F.when(c.isNotNull(), F.struct(*[scaled(p) for p in ("x", "y", "w", "h")])))
