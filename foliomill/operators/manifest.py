"""Batches, documents and page manifests.

``pages``  job_id, page_no, width, height, path, ...   one row per published page
``jobs``   job_id plus request columns                  one row per job
A single job may hold most of the pages: orders and running totals inside a
job go through ``prefix_scan``, job attributes reach pages through
``salted_join``, and everything else is a two-sided aggregate.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IMAGE_FORMATS
from ..functions.columns import clamp, int_div, to_int
from ..functions.lines import BATCH_BYTES, bound_batches, flat_lines, map_batches, portions, whole_groups
from ..functions.scale import prefix_scan, salted_join
from .raster import MAX_AXIS, MAX_PAGE_BYTES

# Fixed limits.
MAX_JOB_PAGES = 1_000
CACHE_HEADER_BYTES = 25
CACHE_LIMIT = 512 * 1024 * 1024
ARTIFACT_OVERHEAD = 1024 * 1024
CLASSIC_TIFF_LIMIT = 4_294_967_295 // 16 * 15


def number_pages(rows: DataFrame, order: str, ties: tuple[str, ...] = (), key: str = "job_id") -> DataFrame:
    """page_no = 1, 2, ... per job in arrival order."""
    return prefix_scan(rows, [key], order, ties, out="page_no")


def page_name(page: Column, total: Column, extension: Column) -> Column:
    """``page_001.ext``: as many digits as the total needs, at least three."""
    text = page.cast("string")
    digits = F.greatest(F.length(total.cast("string")), F.lit(3), F.length(text))
    return F.concat(F.lit("page_"), F.lpad(text, digits, F.lit("0")), F.lit("."), extension)


def page_names(pages: DataFrame, totals: DataFrame, extension: str = "png") -> DataFrame:
    """Attach ``file_name``; ``totals``: job_id, total."""
    joined = salted_join(pages, totals, ["job_id"], F.col("page_no"))
    return joined.withColumn("file_name", page_name(F.col("page_no"), F.col("total"), F.lit(extension)))


def job_totals(pages: DataFrame) -> DataFrame:
    return pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("total"))


def page_extension(fmt: Column) -> Column:
    """Lower case, one leading dot removed, jpeg spelled jpg; null when a page
    cannot be saved in the format (a container is never a page format)."""
    bare = F.regexp_replace(F.lower(fmt), r"^\.", "")
    allowed = bare.isin([f for f in IMAGE_FORMATS if f != "pdf"])
    return F.when(allowed, F.when(bare == "jpeg", "jpg").otherwise(bare))


def batch_outputs(jobs: DataFrame) -> DataFrame:
    """One row per planned output: job_id, kind (page | multipage |
    contact_sheet), target, error.

    Needs out_dir, output_name, configured_format, want_multipage,
    multipage_format, want_contact_sheet.
    """
    pdf = F.lower("configured_format") == "pdf"
    fmt = F.when(pdf, "png").otherwise(F.col("configured_format"))
    extension = page_extension(fmt)
    stem = F.concat(F.col("out_dir"), F.lit("/"), F.col("output_name"))
    container = F.when(pdf, "pdf").otherwise(F.col("multipage_format"))
    rows = F.array(
        F.struct(F.lit("page").alias("kind"), extension.alias("target")),
        F.when(
            F.col("want_multipage") | pdf,
            F.struct(F.lit("multipage").alias("kind"), F.concat(stem, F.lit("_multipage."), container).alias("target")),
        ),
        F.when(
            F.col("want_contact_sheet"),
            F.struct(F.lit("contact_sheet").alias("kind"), F.concat(stem, F.lit("_contact.bmp")).alias("target")),
        ),
    )
    planned = jobs.select("job_id", fmt.alias("_fmt"), F.explode(F.filter(rows, lambda r: r.isNotNull())).alias("o"))
    return planned.select(
        "job_id",
        F.col("o.kind").alias("kind"),
        F.col("o.target").alias("target"),
        F.when(
            F.col("o.target").isNull(),
            F.concat(F.lit("unsupported batch format '"), F.regexp_replace(F.lower("_fmt"), r"^\.", ""), F.lit("'")),
        ).alias("error"),
    )


def batch_complete(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Compare what was published with what was asked and reported.

    ``jobs``: job_id, requested, reported, end_reason, duplex.
    """
    published = pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("published"))
    joined = jobs.join(published, "job_id", "left").withColumn("published", F.coalesce("published", F.lit(0)))
    reported, limit = F.col("reported"), F.col("end_reason") == "limit_reached"
    text = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    status = (
        F.when(
            reported != F.col("published"),
            text("reported ", reported.cast("string"), ", published ", F.col("published").cast("string")),
        )
        .when(
            limit & (reported != F.col("requested")),
            text("stopped at ", reported.cast("string"), " of ", F.col("requested").cast("string"), " requested"),
        )
        .when(~limit & (reported == 0), F.lit("no pages"))
        .when(
            ~limit & F.col("duplex") & (reported % 2 != 0),
            text("odd duplex count (", reported.cast("string"), " sides)"),
        )
        .otherwise("complete")
    )
    return joined.select("job_id", "requested", "reported", "published", status.alias("status"))


def end_reason(emitted: Column, limit: Column) -> Column:
    return F.when(emitted == limit, "limit_reached").otherwise("feeder_exhausted")


def page_limit_error(requested: Column) -> Column:
    return F.when(requested <= 0, "limit not positive").when(
        requested > MAX_JOB_PAGES,
        F.concat(F.lit("page limit "), requested.cast("string"), F.lit(": over 1000")),
    )


def duplex_error(duplex: Column, mode: Column, requested: Column) -> Column:
    return F.when(duplex & (mode != "document"), "duplex without document source").when(
        duplex & (requested % 2 != 0), "duplex with odd pages"
    )


def page_limit(pages: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages within the limit of their job, and one error row per job that
    delivered more.  ``jobs``: job_id, requested."""
    joined = salted_join(pages, jobs.select("job_id", "requested"), ["job_id"], F.col("page_no"))
    kept = joined.where(F.col("page_no") <= F.col("requested"))
    counts = job_totals(pages).join(jobs.select("job_id", "requested"), "job_id")
    over = counts.where(F.col("total") > F.col("requested")).select(
        "job_id",
        F.concat(
            F.lit("emitted "), F.col("total").cast("string"), F.lit(", limit "), F.col("requested").cast("string")
        ).alias("error"),
    )
    return kept, over


def duplex_pairs(pages: DataFrame) -> DataFrame:
    """Sides 2k-1 and 2k form sheet k; at most two rows meet in a group."""
    sheet = to_int(int_div(F.col("page_no") - 1, 2)) + 1
    front = F.col("page_no") % 2 == 1
    return pages.groupBy("job_id", sheet.alias("sheet")).agg(
        F.max(F.when(front, F.col("path"))).alias("front"),
        F.max(F.when(~front, F.col("path"))).alias("back"),
        (F.count(F.lit(1)) == 2).alias("complete"),
    )


def feeder_exhausted(text: Column, phrases: tuple[str, ...]) -> Column:
    """Any phrase inside the lower-cased text; the fixed list is a literal."""
    lowered = F.lower(text)
    found = F.lit(False)
    for phrase in phrases:
        found = found | lowered.contains(phrase)
    return found


def document_order(pages: DataFrame) -> DataFrame:
    """Long ordered page list: job_id, position, path, is_first, is_last.

    The list stays in rows, so a document of any length is never one array.
    """
    ordered = prefix_scan(pages, ["job_id"], "page_no", ("path",), out="position")
    joined = salted_join(ordered, job_totals(pages), ["job_id"], F.col("page_no"))
    return joined.select(
        "job_id",
        "position",
        "page_no",
        "path",
        (F.col("position") == 1).alias("is_first"),
        (F.col("position") == F.col("total")).alias("is_last"),
    )


def document_bytes(pages: DataFrame) -> DataFrame:
    """Uncompressed size per document and the container it needs."""
    size = F.col("width").cast("bigint") * F.col("height") * 3
    return pages.groupBy("job_id").agg(F.sum(size).alias("bytes")).withColumn(
        "container", F.when(F.col("bytes") > CLASSIC_TIFF_LIMIT, "bigtiff").otherwise("tiff")
    )


def contact_sheet(
    pages: DataFrame, across: int, thumb_width: int, thumb_height: int | None = None, margin: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Thumbnail placements per page and sheet sizes per job.

    ``pages``: job_id, page_no (1-based position), width, height.
    """
    cols, cell_w = max(1, across), max(8, thumb_width)
    cell_h = max(8, thumb_height if thumb_height is not None else max(8, cell_w * 3 // 4))
    sw, sh = (F.greatest(F.col(c), F.lit(1)).cast("bigint") for c in ("width", "height"))
    wide = sw * cell_h >= sh * cell_w
    tw = F.when(wide, F.lit(cell_w).cast("bigint")).otherwise(clamp(int_div(sw * cell_h + int_div(sh, 2), sh), 1, cell_w))
    th = F.when(wide, clamp(int_div(sh * cell_w + int_div(sw, 2), sw), 1, cell_h)).otherwise(F.lit(cell_h).cast("bigint"))
    index = F.col("page_no").cast("bigint") - 1
    placed = pages.select(
        "job_id",
        "page_no",
        tw.alias("thumb_width"),
        th.alias("thumb_height"),
        (F.lit(margin) + (index % cols) * (cell_w + margin) + int_div(F.lit(cell_w).cast("bigint") - tw, 2)).alias("x"),
        (F.lit(margin) + int_div(index, cols) * (cell_h + margin) + int_div(F.lit(cell_h).cast("bigint") - th, 2)).alias("y"),
    )
    rows = int_div(F.col("total") + (cols - 1), cols)
    width = F.lit(cols * cell_w + (cols + 1) * margin).cast("bigint")
    height = rows * cell_h + (rows + 1) * margin
    sheets = job_totals(pages).select("job_id", rows.alias("sheet_rows"), width.alias("sheet_width"), height.alias("sheet_height"))
    bad = (F.col("sheet_width") > MAX_AXIS) | (F.col("sheet_height") > MAX_AXIS) | (
        F.col("sheet_width") * F.col("sheet_height") * 3 > MAX_PAGE_BYTES
    )
    return placed, sheets.withColumn("error", F.when(bad, "contact sheet exceeds the page limits"))


def thumbnails(strips: DataFrame, cell_width: int, cell_height: int) -> DataFrame:
    """Area-weighted thumbnails that fit a cell: page_id, width, height, y, x, c, v.

    Lines are reduced across and added to the one or few target lines they overlap, with integer overlap
    weights, a batch at a time.  A batch leaves one deflated row of sums per page and block of target lines.
    """
    kind = {c: strips.schema[c].dataType.simpleString() for c in THUMBNAIL_KEYS}

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width, height, bpp, y = (batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("width", "height", "bpp", "y"))
            page = batch["page_id"].dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            values, size = flat_lines(batch["row"])
            if (size != width * bpp).any():
                raise ValueError("a line does not have width times channels samples")
            at = np.cumsum(size) - size
            tw, th = _thumbnail_size(width, height, cell_width, cell_height)
            shape = (width * 8 + bpp) * (cell_width + 1) + tw
            for one in np.unique(shape):
                mine = np.flatnonzero(shape == one)
                w, b, wide = int(width[mine[0]]), int(bpp[mine[0]]), int(tw[mine[0]])
                fed = int((th[mine] // height[mine]).max()) + 2
                step = max(1, 4 * BATCH_BYTES // (8 * fed * (max(w, wide) * b + 1)))
                for n in range(0, len(mine), step):
                    some = mine[n : n + step]
                    lines = values[at[some, None] + np.arange(w * b)].reshape(-1, w, b)
                    yield _target_sums(batch, some, page[some], height[some], th[some], y[some], _across(lines, wide).reshape(len(some), -1))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, start in whole_groups(batches, (*THUMBNAIL_KEYS, "block")):
            for part, begin in portions(table, start, table["many"].to_numpy().astype(np.int64) * 8):
                yield _cells(part, begin, cell_width, cell_height)

    kinds = ", ".join(f"{c} {k}" for c, k in kind.items())
    sums = map_batches(strips, partial, f"{kinds}, block int, many int, sums binary", [*THUMBNAIL_KEYS, "y", "row"])
    parts = bound_batches(sums.repartition(*THUMBNAIL_KEYS, "block")).sortWithinPartitions(*THUMBNAIL_KEYS, "block")
    return map_batches(parts, whole, f"page_id {kind['page_id']}, width int, height int, y int, x int, c int, v int")


#: Sums of a block of target lines, at most, if it has more than one.
CELLS = 4096
THUMBNAIL_KEYS = ["page_id", "width", "height", "bpp"]


def _thumbnail_size(sw: np.ndarray, sh: np.ndarray, cell_width: int, cell_height: int) -> tuple[np.ndarray, np.ndarray]:
    """Width and height of the largest thumbnail that fits the cell."""
    wide = sw * cell_height >= sh * cell_width
    tw = np.where(wide, cell_width, np.clip((sw * cell_height + sh // 2) // sh, 1, cell_width))
    th = np.where(wide, np.clip((sh * cell_width + sw // 2) // sw, 1, cell_height), cell_height)
    return tw, th


def _across(lines: np.ndarray, tw: int) -> np.ndarray:
    """Weighted sums of (line, x, channel) samples over the target columns, as differences of one running sum."""
    w = lines.shape[1]
    total = np.zeros((len(lines), w + 1, lines.shape[2]), np.int64)
    np.cumsum(lines, axis=1, out=total[:, 1:])
    at, part = np.divmod(np.arange(tw + 1) * w, tw)
    return np.diff(total[:, at] * tw + lines[:, np.minimum(at, w - 1)].astype(np.int64) * part[:, None], axis=1)


def _target_sums(batch: pa.RecordBatch, rows: np.ndarray, page: np.ndarray, height: np.ndarray, th: np.ndarray, y: np.ndarray, across: np.ndarray) -> pa.RecordBatch:
    """One deflated row per page and block of target lines: for each target line how many lines it has, and its sums."""
    per = across.shape[1] + 1
    block_lines = max(1, CELLS // per)
    _, first, code = np.unique(page * (int(height.max()) + 1) + height, return_index=True, return_inverse=True)
    # A line feeds the target lines it overlaps, by the length they share on a common scale.
    begin = y * th // height
    many = np.minimum(((y + 1) * th + height - 1) // height, th) - begin
    of = np.repeat(np.arange(len(y)), many)
    target = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many)
    share = np.minimum((y[of] + 1) * th[of], (target + 1) * height[of]) - np.maximum(y[of] * th[of], target * height[of])
    place = code[of] * int(th.max()) + target
    order = np.argsort(place, kind="stable")
    of, target, share, place = of[order], target[order], share[order], place[order]
    begin = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    sums = np.empty((len(begin), per), np.int64)
    sums[:, 0] = np.diff(np.append(begin, len(place)))
    np.add.reduceat(across[of] * share[:, None], begin, axis=0, out=sums[:, 1:])
    own, target = code[of[begin]], target[begin]
    block = target // block_lines
    start = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (block[1:] != block[:-1])))
    lines = np.minimum(block_lines, th[first][own[start]] - block[start] * block_lines)
    data = []
    for s, e, n in zip(start.tolist(), [*start[1:].tolist(), len(own)], lines.tolist()):
        found = sums[s:e]
        if e - s < n:
            found = np.zeros((n, per), np.int64)
            found[target[s:e] % block_lines] = sums[s:e]
        data.append(zlib.compress((found if found.max() >> 31 else found.astype(np.int32)).tobytes(), 1))
    kept = batch.select(THUMBNAIL_KEYS).take(pa.array(rows[first][own[start]]))
    more = [pa.array(block[start], pa.int32()), pa.array(lines * per, pa.int32()), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays([*kept.columns, *more], names=[*THUMBNAIL_KEYS, "block", "many", "sums"])


def _cells(table: pa.Table, start: np.ndarray, cell_width: int, cell_height: int) -> pa.RecordBatch:
    """The samples of thumbnails from the sums of whole groups, which begin at ``start``."""
    width, height, bpp, block, size = (table[c].to_numpy().astype(np.int64) for c in ("width", "height", "bpp", "block", "many"))
    parts = []
    for one, n in zip(table["sums"].to_pylist(), size.tolist()):
        data = zlib.decompress(one)
        parts.append(np.frombuffer(data, np.int64 if len(data) == n * 8 else np.int32).astype(np.int64))
    many = np.diff(np.append(start, len(size)))
    if (many > 1).any():
        parts = [sum(parts[s + 1 : s + n], start=parts[s]) for s, n in zip(start.tolist(), many.tolist())]
    sums, size = np.concatenate(parts), size[start]
    width, height, bpp, block = (v[start] for v in (width, height, bpp, block))
    tw, th = _thumbnail_size(width, height, cell_width, cell_height)
    per = tw * bpp + 1
    of = np.repeat(np.arange(len(start)), size)
    at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
    line, k = at // per[of], at % per[of] - 1
    # A target line that no line has fed is no line.
    fed = sums[np.repeat(np.cumsum(size) - size, size) + line * per[of]] > 0
    some = np.flatnonzero((k >= 0) & fed)
    of, line, k, total = of[some], line[some], k[some], sums[some]
    area = (width * height)[of]
    y = line + (block * np.maximum(1, CELLS // per))[of]
    ids = table["page_id"].combine_chunks().take(pa.array(start[of]))
    found = [tw[of], th[of], y, k // bpp[of], k % bpp[of], (total * 2 + area) // (area * 2)]
    return pa.RecordBatch.from_arrays([ids, *[pa.array(v.astype(np.int32)) for v in found]], names=["page_id", "width", "height", "y", "x", "c", "v"])


def normal_path(path: Column) -> Column:
    """Drop ``.`` and empty parts, resolve ``..`` against the part before it."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(
        parts,
        F.array().cast("array<string>"),
        lambda acc, p: F.when(
            (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")) != ".."),
            F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
        ).otherwise(F.concat(acc, F.array(p))),
    )
    root = F.when(path.startswith("/"), "/").otherwise("")
    return F.concat(root, F.array_join(kept, "/"))


def output_conflicts(outputs: DataFrame) -> DataFrame:
    """Destinations of a job that resolve to the same path.

    ``outputs``: job_id, label, path, page_no (null for containers).  One row
    per conflicting path with counts and the first page hit; pairs are never
    listed, so a path claimed a million times is still one row.
    """
    keyed = outputs.withColumn("target", normal_path(F.col("path")))
    return (
        keyed.groupBy("job_id", "target")
        .agg(
            F.count(F.lit(1)).alias("claims"),
            F.min("page_no").alias("first_page"),
            F.min(F.when(F.col("page_no").isNull(), F.col("label"))).alias("first_container"),
            F.count_if(F.col("page_no").isNull()).alias("containers"),
        )
        # Two generated pages never alias each other; a container must be involved.
        .where((F.col("claims") > 1) & (F.col("containers") > 0))
    )


def existing_outputs(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    """Planned outputs already present (semi join on the resolved path)."""
    present = manifest.select(normal_path(F.col("path")).alias("target"))
    return planned.withColumn("target", normal_path(F.col("path"))).join(present, "target", "left_semi")


def missing_outputs(planned: DataFrame, manifest: DataFrame) -> DataFrame:
    present = manifest.select(normal_path(F.col("path")).alias("target"))
    return planned.withColumn("target", normal_path(F.col("path"))).join(present, "target", "left_anti")


def content_dedup(pages: DataFrame, key: str = "page_id", content: str = "content") -> DataFrame:
    """One row per distinct content: sha256, first key, copies.

    The hash is taken before the shuffle, so page bytes never move, and the
    aggregate combines on the map side: a popular copy costs one row per task.
    """
    hashed = pages.select(key, F.sha2(F.col(content), 256).alias("sha256"))
    return hashed.groupBy("sha256").agg(F.min(key).alias(f"first_{key}"), F.count(F.lit(1)).alias("copies"))


def changed_sources(before: DataFrame, after: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Paths whose content differs between two listings."""
    old = before.select(path, F.sha2(F.col(content), 256).alias("old_sha256"))
    new = after.select(path, F.sha2(F.col(content), 256).alias("new_sha256"))
    return old.join(new, path).where("old_sha256 <> new_sha256")


def cache_admission(loads: DataFrame, limit: int = CACHE_LIMIT) -> DataFrame:
    """job_id, path, load_no, bytes, used_after, admitted.

    The first load of a path may be stored while the running total fits.  The
    total only grows, so the first miss ends admission for all later paths.
    """
    first = loads.groupBy("job_id", "path").agg(
        F.min("load_no").alias("load_no"),
        F.min_by("pixel_bytes", "load_no").alias("pixel_bytes"),
    )
    cost = F.col("pixel_bytes").cast("bigint") + CACHE_HEADER_BYTES
    ran = prefix_scan(first.withColumn("bytes", cost), ["job_id"], "load_no", ("path",), F.col("bytes"), "used_after")
    return ran.select("job_id", "path", "load_no", "bytes", "used_after", (F.col("used_after") <= limit).alias("admitted"))


def artifact_quota(jobs: DataFrame) -> DataFrame:
    """Attach max_files and max_bytes.  ``jobs``: requested, width, height, bpp."""
    whole = F.lit(MAX_PAGE_BYTES).cast("bigint")
    image = F.when((F.col("width") == 0) | (F.col("height") == 0), whole).otherwise(
        F.col("width").cast("bigint") * F.col("height") * F.col("bpp")
    )
    return jobs.withColumn("max_files", F.col("requested").cast("bigint")).withColumn(
        "max_bytes", F.least((image + ARTIFACT_OVERHEAD) * F.col("requested"), whole + ARTIFACT_OVERHEAD)
    )


def artifact_violations(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """Jobs whose files exceed the quota.  ``files``: job_id, bytes."""
    used = files.groupBy("job_id").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))
    return (
        artifact_quota(jobs)
        .join(used, "job_id")
        .where((F.col("files") > F.col("max_files")) | (F.col("bytes") > F.col("max_bytes")))
        .select("job_id", "files", "bytes", "max_files", "max_bytes")
    )


def saved_before_failure(jobs: DataFrame, pages: DataFrame) -> DataFrame:
    """Failure message plus the pages already published.

    ``jobs``: job_id, error (null = no failure), out_dir.
    """
    saved = pages.groupBy("job_id").agg(F.count(F.lit(1)).alias("saved"))
    failed = jobs.where("error is not null").join(saved, "job_id", "left")
    note = F.concat(
        F.col("error"), F.lit("; "), F.col("saved").cast("string"), F.lit(" saved in "), F.col("out_dir")
    )
    return failed.select(
        "job_id",
        F.coalesce("saved", F.lit(0)).alias("saved"),
        F.when(F.coalesce("saved", F.lit(0)) > 0, note).otherwise(F.col("error")).alias("message"),
    )
