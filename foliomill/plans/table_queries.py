"""Registered queries over manifests, catalogs, settings and job events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import (
    CATALOG_LANGUAGES, FEEDER_EMPTY_PHRASES, IMAGE_FORMATS, KEY_ALIASES, KEY_SYMBOLS, MULTIPAGE_FORMATS, OCR_ENGINES,
    PAPER_MM, REDACTED_KEYS, film_profiles, manufacturers,
)
from ..functions.scale import spread_small_input
from ..operators import catalogs, i18n, jobs, manifest, raster, settings
from ..operators.filters import TIER_ALIASES, TIER_OFF
from ..operators.profile import read_profiles
from ..operators.tone import TINT_NAMES
from ..sources import capabilities, files
from .fixtures import page_strips, px_sql, table

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


def _quoted(values) -> str:
    return ", ".join("'" + str(v).replace("'", "''") + "'" for v in values)


# --- shared manifests ------------------------------------------------------

_PATH = "concat('out/', l_orderkey, '/p', l_partkey, '_', l_linenumber, '_', l_suppkey, '.png')"


def pages_of_jobs(spark, sf):
    """Page manifest from line items: a job is an order."""
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS job_id",
        "l_partkey * 10 + l_linenumber AS arrival",
        "l_suppkey",
        "CAST(l_partkey % 2480 + 1 AS INT) AS width",
        "CAST(l_suppkey * 53 % 3508 + 1 AS INT) AS height",
        f"{_PATH} AS path",
        "CAST(l_quantity AS INT) AS quantity",
    )
    return manifest.number_pages(rows, "arrival", ("l_suppkey",))


_MAN = f"""man AS (SELECT l_orderkey AS job_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_linenumber, l_suppkey) AS page_no,
  CAST(l_partkey % 2480 + 1 AS INT) AS width, CAST(l_suppkey * 53 % 3508 + 1 AS INT) AS height,
  {_PATH} AS path, CAST(l_quantity AS INT) AS quantity FROM lineitem)"""

_add(
    "page_names",
    lambda spark, sf: (lambda p: manifest.page_names(p, manifest.job_totals(p)).select("job_id", "page_no", "file_name"))(
        pages_of_jobs(spark, sf)
    ),
    f"""WITH {_MAN} SELECT job_id, page_no, 'page_' || lpad(CAST(page_no AS VARCHAR),
  CAST(greatest(3, length(CAST(count(*) OVER (PARTITION BY job_id) AS VARCHAR))) AS INT), '0') || '.png' AS file_name FROM man""",
)

_REQ = {
    "job_id": "o_orderkey",
    "out_dir": "concat('out/', o_custkey % 50)",
    "output_name": "concat('scan_', o_orderkey)",
    "configured_format": "CASE o_orderkey % 7 WHEN 0 THEN 'png' WHEN 1 THEN 'PDF' WHEN 2 THEN '.JPEG' WHEN 3 THEN 'tiff' WHEN 4 THEN 'xyz' WHEN 5 THEN 'jpg' ELSE '.pdf' END",
    "want_multipage": "o_orderkey % 3 = 0",
    "multipage_format": "CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'tiff' END",
    "want_contact_sheet": "o_custkey % 4 = 1",
    "requested": "CAST(o_orderkey % 8 + 1 AS INT)",
    "reported": "CAST(o_orderkey % 7 AS INT)",
    "end_reason": "CASE WHEN o_orderkey % 5 < 2 THEN 'limit_reached' ELSE 'feeder_exhausted' END",
    "duplex": "o_custkey % 2 = 0",
    "mode": "CASE WHEN o_custkey % 3 = 0 THEN 'reflective' ELSE 'document' END",
    "width": "CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0 ELSE o_orderkey % 3000 END AS INT)",
    "height": "CAST(o_custkey % 4000 AS INT)",
    "bpp": "CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE 3 END",
    "error": "CASE WHEN o_orderstatus = 'F' THEN concat('device error ', o_orderpriority) END",
}


def jobs_of(spark, sf, *names):
    names = ("job_id", *names)
    return table(spark, sf, "orders").selectExpr(*[f"{_REQ[n]} AS {n}" for n in names])


def _req(*names) -> str:
    names = ("job_id", *names)
    return "req AS (SELECT " + ", ".join(f"{_REQ[n]} AS {n}" for n in names) + " FROM orders)"


_OUT_COLS = ("out_dir", "output_name", "configured_format", "want_multipage", "multipage_format", "want_contact_sheet")
_add(
    "batch_outputs",
    lambda spark, sf: manifest.batch_outputs(jobs_of(spark, sf, *_OUT_COLS)),
    f"""WITH {_req(*_OUT_COLS)},
f AS (SELECT *, lower(configured_format) = 'pdf' AS pdf, CASE WHEN lower(configured_format) = 'pdf' THEN 'png' ELSE configured_format END AS fmt FROM req),
b AS (SELECT *, CASE WHEN starts_with(lower(fmt), '.') THEN substr(lower(fmt), 2) ELSE lower(fmt) END AS bare FROM f),
o AS (SELECT job_id, 'page' AS kind, CASE WHEN bare IN ({_quoted(f for f in IMAGE_FORMATS if f != 'pdf')}) THEN CASE bare WHEN 'jpeg' THEN 'jpg' ELSE bare END END AS target, bare FROM b
 UNION ALL SELECT job_id, 'multipage', out_dir || '/' || output_name || '_multipage.' || CASE WHEN pdf THEN 'pdf' ELSE multipage_format END, bare FROM b WHERE want_multipage OR pdf
 UNION ALL SELECT job_id, 'contact_sheet', out_dir || '/' || output_name || '_contact.bmp', bare FROM b WHERE want_contact_sheet)
SELECT job_id, kind, target, CASE WHEN target IS NULL THEN 'unsupported batch format ''' || bare || '''' END AS error FROM o""",
)
_add(
    "batch_complete",
    lambda spark, sf: manifest.batch_complete(
        jobs_of(spark, sf, "requested", "reported", "end_reason", "duplex"), pages_of_jobs(spark, sf)
    ),
    f"""WITH {_req("requested", "reported", "end_reason", "duplex")}, n AS (SELECT l_orderkey AS job_id, count(*) AS published FROM lineitem GROUP BY 1),
j AS (SELECT req.*, coalesce(published, 0) AS published FROM req LEFT JOIN n USING (job_id))
SELECT job_id, requested, reported, published, CASE
  WHEN reported <> published THEN format('reported {{}}, published {{}}', reported, published)
  WHEN end_reason = 'limit_reached' AND reported <> requested THEN format('stopped at {{}} of {{}} requested', reported, requested)
  WHEN end_reason = 'feeder_exhausted' AND reported = 0 THEN 'no pages'
  WHEN end_reason = 'feeder_exhausted' AND duplex AND reported % 2 = 1 THEN format('odd duplex count ({{}} sides)', reported)
  ELSE 'complete' END AS status FROM j""",
)
_add(
    "duplex_pairs",
    lambda spark, sf: manifest.duplex_pairs(pages_of_jobs(spark, sf)),
    f"""WITH {_MAN} SELECT job_id, CAST((page_no - 1) // 2 + 1 AS INT) AS sheet, max(path) FILTER (WHERE page_no % 2 = 1) AS front,
  max(path) FILTER (WHERE page_no % 2 = 0) AS back, count(*) = 2 AS complete FROM man GROUP BY 1, 2""",
)
_add(
    "duplex_rules",
    lambda spark, sf: jobs_of(spark, sf, "duplex", "mode", "requested").withColumn(
        "error", manifest.duplex_error(F.col("duplex"), F.col("mode"), F.col("requested"))
    ),
    f"""WITH {_req("duplex", "mode", "requested")} SELECT *, CASE WHEN duplex AND mode <> 'document' THEN 'duplex without document source'
  WHEN duplex AND requested % 2 <> 0 THEN 'duplex with odd pages' END AS error FROM req""",
)
_add(
    "page_limit",
    lambda spark, sf: manifest.page_limit(pages_of_jobs(spark, sf), jobs_of(spark, sf, "requested"))[0].select(
        "job_id", "page_no", "path", "requested"
    ),
    f"""WITH {_MAN}, {_req("requested")} SELECT job_id, page_no, path, requested FROM man JOIN req USING (job_id) WHERE page_no <= requested""",
)
_add(
    "page_limit_exceeded",
    lambda spark, sf: manifest.page_limit(pages_of_jobs(spark, sf), jobs_of(spark, sf, "requested"))[1],
    f"""WITH {_MAN}, {_req("requested")}, t AS (SELECT job_id, count(*) AS total FROM man GROUP BY 1)
SELECT job_id, format('emitted {{}}, limit {{}}', total, requested) AS error FROM t JOIN req USING (job_id) WHERE total > requested""",
)
_add(
    "page_limit_rules",
    lambda spark, sf: table(spark, sf, "orders")
    .selectExpr("o_orderkey AS job_id", "CAST(o_custkey * 7 - 3 AS INT) AS requested")
    .withColumn("error", manifest.page_limit_error(F.col("requested"))),
    """SELECT *, CASE WHEN requested <= 0 THEN 'limit not positive'
  WHEN requested > 1000 THEN 'page limit ' || requested || ': over 1000' END AS error
FROM (SELECT o_orderkey AS job_id, CAST(o_custkey * 7 - 3 AS INT) AS requested FROM orders)""",
)
_SAID = "CASE turn % 5 WHEN 0 THEN concat(text, ' Out of Documents.') WHEN 1 THEN concat('PAPER EMPTY ', text) WHEN 2 THEN concat(text, ' no  paper') ELSE text END"
_add(
    "feeder_status",
    lambda spark, sf: table(spark, sf, "conversations")
    .selectExpr("conv_id", "turn", f"{_SAID} AS said")
    .select("conv_id", "turn", manifest.feeder_exhausted(F.col("said"), FEEDER_EMPTY_PHRASES).alias("exhausted")),
    f"""WITH s AS (SELECT conv_id, turn, lower({_SAID}) AS said FROM conversations)
SELECT conv_id, turn, {" OR ".join(f"contains(said, '{p}')" for p in FEEDER_EMPTY_PHRASES)} AS exhausted FROM s""",
)
_add(
    "document_order",
    lambda spark, sf: manifest.document_order(pages_of_jobs(spark, sf)),
    f"""WITH {_MAN} SELECT job_id, row_number() OVER w AS position, page_no, path, row_number() OVER w = 1 AS is_first,
  row_number() OVER w = count(*) OVER (PARTITION BY job_id) AS is_last FROM man WINDOW w AS (PARTITION BY job_id ORDER BY page_no)""",
)
_add(
    "document_bytes",
    lambda spark, sf: manifest.document_bytes(
        pages_of_jobs(spark, sf).withColumn("width", F.col("width") * 20).withColumn("height", F.col("height") * 20)
    ),
    f"""WITH {_MAN}, s AS (SELECT job_id, CAST(sum(CAST(width * 20 AS BIGINT) * (height * 20) * 3) AS BIGINT) AS bytes FROM man GROUP BY 1)
SELECT job_id, bytes, CASE WHEN bytes > 4294967295 // 16 * 15 THEN 'bigtiff' ELSE 'tiff' END AS container FROM s""",
)
_FIT = """fit AS (SELECT *, CASE WHEN CAST(width AS BIGINT) * 72 >= CAST(height AS BIGINT) * 96 THEN 96 ELSE least(greatest((CAST(width AS BIGINT) * 72 + height // 2) // height, 1), 96) END AS tw,
  CASE WHEN CAST(width AS BIGINT) * 72 >= CAST(height AS BIGINT) * 96 THEN least(greatest((CAST(height AS BIGINT) * 96 + width // 2) // width, 1), 72) ELSE 72 END AS th FROM man)"""
_add(
    "contact_sheet",
    lambda spark, sf: manifest.contact_sheet(pages_of_jobs(spark, sf), 3, 96)[0],
    f"""WITH {_MAN}, {_FIT} SELECT job_id, page_no, CAST(tw AS BIGINT) AS thumb_width, CAST(th AS BIGINT) AS thumb_height,
  CAST(8 + ((page_no - 1) % 3) * 104 + (96 - tw) // 2 AS BIGINT) AS x, CAST(8 + ((page_no - 1) // 3) * 80 + (72 - th) // 2 AS BIGINT) AS y FROM fit""",
)
_add(
    "contact_sheet_size",
    lambda spark, sf: manifest.contact_sheet(pages_of_jobs(spark, sf), 2, 16_000, 21_000, 100)[1],
    f"""WITH {_MAN}, r AS (SELECT job_id, (count(*) + 1) // 2 AS n FROM man GROUP BY 1),
s AS (SELECT job_id, CAST(n AS BIGINT) AS sheet_rows, CAST(32300 AS BIGINT) AS sheet_width, CAST(n * 21000 + (n + 1) * 100 AS BIGINT) AS sheet_height FROM r)
SELECT *, CASE WHEN sheet_height > 65535 OR sheet_width * sheet_height * 3 > 536870912 THEN 'contact sheet exceeds the page limits' END AS error FROM s""",
)


def _thumbnails(spark, sf):
    cells = manifest.thumbnails(page_strips(spark, sf), 12, 9)
    at = (F.col("y") * F.col("width") + F.col("x")) * 3 + F.col("c") + 1
    return cells.groupBy("page_id", "width", "height").agg(
        F.count(F.lit(1)).alias("samples"), F.sum("v").alias("sum_v"), F.sum(F.col("v") * at).cast("bigint").alias("sum_at")
    )


_add(
    "thumbnails",
    _thumbnails,
    px_sql() + """,
dims AS (SELECT DISTINCT page_id, width AS sw, height AS sh FROM px),
fit AS (SELECT page_id, sw, sh, CASE WHEN sw * 9 >= sh * 12 THEN 12 ELSE least(greatest((sw * 9 + sh // 2) // sh, 1), 12) END AS tw,
  CASE WHEN sw * 9 >= sh * 12 THEN least(greatest((sh * 12 + sw // 2) // sw, 1), 9) ELSE 9 END AS th FROM dims),
wx AS (SELECT page_id, tx, sx, least((sx + 1) * tw, (tx + 1) * sw) - greatest(sx * tw, tx * sw) AS wx FROM fit, range(tw) a(tx), range(sw) b(sx)
  WHERE least((sx + 1) * tw, (tx + 1) * sw) > greatest(sx * tw, tx * sw)),
wy AS (SELECT page_id, ty, sy, least((sy + 1) * th, (ty + 1) * sh) - greatest(sy * th, ty * sh) AS wy FROM fit, range(th) a(ty), range(sh) b(sy)
  WHERE least((sy + 1) * th, (ty + 1) * sh) > greatest(sy * th, ty * sh)),
cells AS (SELECT px.page_id, ty, tx, c, sum(CAST(wx AS HUGEINT) * wy * v) AS s FROM px JOIN wx ON wx.page_id = px.page_id AND sx = x
  JOIN wy ON wy.page_id = px.page_id AND sy = y GROUP BY 1, 2, 3, 4),
vals AS (SELECT page_id, tw, th, ty, tx, c, (2 * s + sw * sh) // (2 * sw * sh) AS v FROM cells JOIN fit USING (page_id))
SELECT page_id, CAST(tw AS INT) AS width, CAST(th AS INT) AS height, count(*) AS samples, CAST(sum(v) AS BIGINT) AS sum_v,
  CAST(sum(v * ((ty * tw + tx) * 3 + c + 1)) AS BIGINT) AS sum_at FROM vals GROUP BY 1, 2, 3""",
)

# Two containers per order; some name a page of their own order in another spelling.
_DEST = f"""CASE WHEN l_linenumber % 3 = 0 THEN concat('./out//', l_orderkey, '/x/../p', l_partkey, '_', l_linenumber, '_', l_suppkey, '.png')
  ELSE concat('out/', l_orderkey, '/doc_', l_linenumber % 2, '.pdf') END"""


def _conflicts(spark, sf):
    pages = pages_of_jobs(spark, sf).select("job_id", F.lit("page").alias("label"), "path", "page_no")
    boxes = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey AS job_id", "concat('container ', l_linenumber)  AS label", f"{_DEST} AS path", "CAST(NULL AS BIGINT) AS page_no"
    )
    return manifest.output_conflicts(pages.unionByName(boxes))


_add(
    "output_conflicts",
    _conflicts,
    f"""WITH {_MAN}, o AS (SELECT job_id, 'page' AS label, path, page_no FROM man
  UNION ALL SELECT l_orderkey, 'container ' || l_linenumber, {_DEST}, NULL FROM lineitem),
n AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(path, '^\\./', ''), '//', '/'), '/x/\\.\\./', '/') AS target FROM o)
SELECT job_id, target, count(*) AS claims, min(page_no) AS first_page, min(label) FILTER (WHERE page_no IS NULL) AS first_container,
  count(*) FILTER (WHERE page_no IS NULL) AS containers FROM n GROUP BY 1, 2 HAVING count(*) > 1 AND count(*) FILTER (WHERE page_no IS NULL) > 0""",
)


def _planned(spark, sf):
    pages = pages_of_jobs(spark, sf)
    return pages.select("job_id", "page_no", "path"), pages.where("quantity > 25").select("path")


_add(
    "existing_outputs",
    lambda spark, sf: manifest.existing_outputs(*_planned(spark, sf)).select("job_id", "page_no", "target"),
    f"WITH {_MAN} SELECT job_id, page_no, path AS target FROM man WHERE path IN (SELECT path FROM man WHERE quantity > 25)",
)
_add(
    "missing_outputs",
    lambda spark, sf: manifest.missing_outputs(*_planned(spark, sf)).select("job_id", "page_no", "target"),
    f"WITH {_MAN} SELECT job_id, page_no, path AS target FROM man WHERE path NOT IN (SELECT path FROM man WHERE quantity > 25)",
)
_add(
    "content_dedup",
    lambda spark, sf: manifest.content_dedup(
        spread_small_input(table(spark, sf, "documents").select("doc_id", "text")).select(
            F.col("doc_id").alias("page_id"), F.encode("text", "UTF-8").alias("content")
        )
    ),
    "SELECT sha256(text) AS sha256, min(doc_id) AS first_page_id, count(*) AS copies FROM documents GROUP BY 1",
)


def _changed(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("concat(source, '/', doc_id) AS path", "text", "lang")
    before = docs.select("path", F.encode("text", "UTF-8").alias("content"))
    after = docs.select(
        "path", F.encode(F.when(F.col("lang") == "fr", F.concat("text", F.lit(" *"))).otherwise(F.col("text")), "UTF-8").alias("content")
    )
    return manifest.changed_sources(before, after)


_add(
    "changed_sources",
    _changed,
    "SELECT source || '/' || doc_id AS path, sha256(text) AS old_sha256, sha256(text || ' *') AS new_sha256 FROM documents WHERE lang = 'fr'",
)
_add(
    "cache_admission",
    lambda spark, sf: manifest.cache_admission(
        table(spark, sf, "lineitem").selectExpr(
            "l_suppkey % 10 AS job_id", "concat('p', l_partkey) AS path", "l_orderkey * 10 + l_linenumber AS load_no",
            "(l_partkey % 400 + 1) * 300 AS pixel_bytes",
        ),
        20_000_000,
    ),
    """WITH loads AS (SELECT l_suppkey % 10 AS job_id, 'p' || l_partkey AS path, l_orderkey * 10 + l_linenumber AS load_no, (l_partkey % 400 + 1) * 300 + 25 AS bytes FROM lineitem),
f AS (SELECT job_id, path, min(load_no) AS load_no, CAST(min(bytes) AS BIGINT) AS bytes FROM loads GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY job_id ORDER BY load_no, path ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used_after FROM f)
SELECT job_id, path, load_no, bytes, used_after, used_after <= 20000000 AS admitted FROM r""",
)
_add(
    "artifact_quota",
    lambda spark, sf: manifest.artifact_violations(
        jobs_of(spark, sf, "requested", "width", "height", "bpp"),
        table(spark, sf, "lineitem").selectExpr("l_orderkey AS job_id", "CAST(l_quantity * 1000000 AS BIGINT) AS bytes"),
    ),
    f"""WITH {_req("requested", "width", "height", "bpp")},
q AS (SELECT job_id, CAST(requested AS BIGINT) AS max_files, least((CASE WHEN width = 0 OR height = 0 THEN 536870912 ELSE CAST(width AS BIGINT) * height * bpp END + 1048576) * requested, 537919488) AS max_bytes FROM req),
u AS (SELECT l_orderkey AS job_id, count(*) AS files, CAST(sum(CAST(l_quantity * 1000000 AS BIGINT)) AS BIGINT) AS bytes FROM lineitem GROUP BY 1)
SELECT job_id, files, bytes, max_files, CAST(max_bytes AS BIGINT) AS max_bytes FROM q JOIN u USING (job_id) WHERE files > max_files OR bytes > max_bytes""",
)
_add(
    "saved_before_failure",
    lambda spark, sf: manifest.saved_before_failure(jobs_of(spark, sf, "error", "out_dir"), pages_of_jobs(spark, sf)),
    f"""WITH {_req("error", "out_dir")}, n AS (SELECT l_orderkey AS job_id, count(*) AS saved FROM lineitem GROUP BY 1)
SELECT job_id, coalesce(saved, 0) AS saved, CASE WHEN saved > 0 THEN error || '; ' || saved || ' saved in ' || out_dir ELSE error END AS message
FROM req LEFT JOIN n USING (job_id) WHERE error IS NOT NULL""",
)

# --- files and devices -----------------------------------------------------

_MAGIC = ("89504E470D0A1A0A", "FFD8FFE0", "49492A00", "4D4D002A", "474946383961", "424D", "255044462D312E37", "FF0A", "524946460000000057454250", "0000000C4A584C200D0A870A", "52494646", "")
_add(
    "page_sniff",
    lambda spark, sf: files.page_sniff(
        table(spark, sf, "pages").select(
            "page_id",
            F.concat(
                F.unhex(F.element_at(F.array(*[F.lit(m) for m in _MAGIC]), (F.col("page_id") % len(_MAGIC) + 1).cast("int"))),
                F.encode("html", "UTF-8"),
            ).alias("content"),
        )
    ).select("page_id", "container"),
    f"""WITH h AS (SELECT page_id, [{_quoted(_MAGIC)}][page_id % {len(_MAGIC)} + 1] || hex(encode(html)) AS hx FROM pages)
SELECT page_id, CASE WHEN hx LIKE '52494646%' AND substr(hx, 17, 8) = '57454250' THEN 'webp' WHEN hx LIKE '0000000C4A584C200D0A870A%' THEN 'jxl'
  WHEN hx LIKE '89504E470D0A1A0A%' THEN 'png' WHEN hx LIKE 'FFD8%' THEN 'jpeg' WHEN hx LIKE '4949%' OR hx LIKE '4D4D%' THEN 'tiff'
  WHEN hx LIKE '474946383761%' OR hx LIKE '474946383961%' THEN 'gif' WHEN hx LIKE '424D%' THEN 'bmp' WHEN hx LIKE '255044462D%' THEN 'pdf'
  WHEN hx LIKE 'FF0A%' THEN 'jxl' END AS container FROM h""",
)
_FILE = """CASE l_partkey % 8 WHEN 0 THEN concat('in/', l_orderkey, '/page_', l_suppkey, '.png.part') WHEN 1 THEN concat('in/', l_orderkey, '/page_.png')
  WHEN 2 THEN concat('in/', l_orderkey, '/Page_', l_suppkey, '.png') WHEN 3 THEN concat('in/', l_orderkey, '/page_', l_suppkey, 'a.png')
  WHEN 4 THEN concat('in/', l_orderkey, '/page_99999999999', l_suppkey, '.png') ELSE concat('in/', l_orderkey, '/page_', lpad(CAST(l_suppkey AS STRING), 4, '0'), '.png') END"""
_add(
    "page_files",
    lambda spark, sf: files.page_files(
        table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", f"{_FILE} AS path")
    ),
    f"""WITH f AS (SELECT l_orderkey, l_linenumber, {_FILE} AS path FROM lineitem),
n AS (SELECT *, CAST(regexp_extract(path, '/page_([0-9]+)\\.png$', 1) AS VARCHAR) AS d FROM f)
SELECT l_orderkey, l_linenumber, path, CAST(d AS BIGINT) AS number FROM n WHERE d <> '' AND TRY_CAST(d AS BIGINT) <= 4294967295""",
)
_PROFILE = """concat('{"format":"', CASE WHEN p_size % 9 = 0 THEN 'other' ELSE 'scanner-profile' END, '","version":', CASE WHEN p_size % 10 = 0 THEN '2' ELSE '1' END,
  ',"kind":"', CASE WHEN p_size % 11 = 0 THEN 'printer' ELSE 'scanner_it8' END, '","matrix":[[1.1,0,0],[0,', CASE WHEN p_size % 12 = 0 THEN '"x"' WHEN p_size % 13 = 0 THEN '16.5' ELSE '0.9' END,
  CASE WHEN p_size % 7 = 0 THEN '' ELSE ',0' END, '],[0,0,1]],"gamma":[', CASE WHEN p_size % 5 = 0 THEN '1.0' WHEN p_size % 8 = 0 THEN '0.01,1,1' ELSE '1.0,1.8,2.2' END, ']}')"""
_add(
    "profile_source",
    lambda spark, sf: read_profiles(
        table(spark, sf, "part").selectExpr("p_partkey", f"{_PROFILE} AS profile_json")
    ).select("p_partkey", "error"),
    """SELECT p_partkey, CASE WHEN p_size % 9 = 0 THEN 'unsupported format' WHEN p_size % 10 = 0 THEN 'unsupported version' WHEN p_size % 11 = 0 THEN 'unsupported kind'
  WHEN p_size % 7 = 0 THEN 'matrix must be 3x3' WHEN p_size % 12 = 0 OR p_size % 13 = 0 THEN 'matrix entry not a number within 16'
  WHEN p_size % 5 = 0 THEN 'gamma must contain three values' WHEN p_size % 8 = 0 THEN 'gamma entry not within 0.05..8' END AS error FROM part""",
)
_LINES = "replace(replace(text, ', ', '|'), '. ', ' | ')"


def _device_lines(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", F.posexplode(F.split(F.expr(_LINES), "\n")).alias("line_no", "line")
    )


_add(
    "device_list_source",
    lambda spark, sf: catalogs.device_list(_device_lines(spark, sf), "line", "sane", "SANE", "sane"),
    f"""WITH l AS (SELECT conv_id, turn, unnest(string_split({_LINES}, chr(10))) AS line, generate_subscripts(string_split({_LINES}, chr(10)), 1) - 1 AS line_no FROM conversations),
t AS (SELECT conv_id, turn, line_no, trim(line) AS line FROM l),
p AS (SELECT *, strpos(line, '|') AS bar FROM t WHERE line <> ''),
s AS (SELECT *, CASE WHEN bar > 0 THEN trim(substr(line, 1, bar - 1)) ELSE line END AS i, CASE WHEN bar > 0 THEN trim(substr(line, bar + 1)) ELSE line END AS n FROM p)
SELECT conv_id, turn, CAST(line_no AS INT) AS line_no, 'sane:' || i AS id, 'SANE: ' || n AS name, 'sane' AS kind FROM s WHERE i <> ''""",
)
_DEVICE = """CASE c_custkey % 14 WHEN 0 THEN concat('EPSON Perfection ', c_custkey) WHEN 1 THEN concat('usb:04a9 ', c_name) WHEN 2 THEN 'VID_04C5&PID_0122'
  WHEN 3 THEN concat('fi-', c_custkey, ' ADF') WHEN 4 THEN concat('wifi-', c_custkey) WHEN 5 THEN 'hp ScanJet' WHEN 6 THEN concat('xhp ', c_mktsegment)
  WHEN 7 THEN '   ' WHEN 8 THEN concat('MFC/DCP-', c_custkey) WHEN 9 THEN '0x04b0, Coolscan' WHEN 10 THEN concat('my (HP) at ', c_nationkey)
  WHEN 11 THEN 'kodak 04b8x alaris' WHEN 12 THEN concat('Xpress ', c_name, ' canon') ELSE concat(c_name, ' ', c_mktsegment) END"""


def _rx(token: str) -> str:
    if not token.isalnum():
        return "(^|[^\\p{L}\\p{N}])" + token
    return token if len(token) > 3 else "(^|[^\\p{L}\\p{N}])" + token + "($|[^\\p{L}\\p{N}])"


_MAKERS = manufacturers()
_MAKER_SQL = """makers AS (SELECT * FROM (VALUES {}) t(ord, id, maker, vid, rx, adf, ir))""".format(
    ", ".join(
        "({}, '{}', '{}', '{}', '{}', {}, {})".format(
            m["ordinal"], m["id"], m["name"], m["vids"][0], "|".join(_rx(t) for t in m["tokens"]), str(m["adf"]).lower(), str(m["ir"]).lower()
        )
        for m in _MAKERS
    )
)
_RESOLVED = _MAKER_SQL + """,
q AS (SELECT *, lower(trim(name)) AS q FROM dev),
v AS (SELECT *, list_filter(list_transform(regexp_split_to_array(q, '[\\s:&,;/]'), lambda t: regexp_replace(t, '^(0x|vid_)', '')), lambda t: regexp_full_match(t, '[0-9a-f]{4}'))[1] AS vid FROM q),
byvid AS (SELECT v.c_custkey, m.ord FROM v JOIN makers m ON v.vid = m.vid),
byname AS (SELECT v.c_custkey, min(m.ord) AS ord FROM v JOIN makers m ON regexp_matches(v.q, m.rx) GROUP BY 1),
res AS (SELECT v.c_custkey, v.name, v.q, v.vid, coalesce(a.ord, b.ord) AS ord, CASE WHEN v.q = '' THEN NULL WHEN a.ord IS NOT NULL THEN 'vid' WHEN b.ord IS NOT NULL THEN 'name_token' END AS matched_by
  FROM v LEFT JOIN byvid a USING (c_custkey) LEFT JOIN byname b USING (c_custkey))"""


def _devices(spark, sf):
    return table(spark, sf, "customer").selectExpr("c_custkey", f"{_DEVICE} AS name")


_add(
    "manufacturer_resolve",
    lambda spark, sf: catalogs.manufacturer_resolve(_devices(spark, sf)),
    f"""WITH dev AS (SELECT c_custkey, {_DEVICE} AS name FROM customer), {_RESOLVED}
SELECT r.c_custkey, r.name, m.id AS manufacturer_id, m.maker AS manufacturer_name, CASE WHEN matched_by IS NULL THEN 'unknown' ELSE 'ok' END AS status, matched_by,
  CASE WHEN q = '' THEN 'empty query' WHEN matched_by = 'vid' THEN 'vid ' || r.vid WHEN matched_by = 'name_token' THEN 'token of ' || m.maker
  ELSE 'no match' END AS message FROM res r LEFT JOIN makers m ON r.ord = m.ord""",
)
_add(
    "manufacturer_summary",
    lambda spark, sf: catalogs.manufacturer_summary(_devices(spark, sf)),
    f"""WITH dev AS (SELECT c_custkey, {_DEVICE} AS name FROM customer), {_RESOLVED}
SELECT m.id, m.maker AS name, m.vid AS vids, m.adf, m.ir, count(r.c_custkey) AS devices, count(*) FILTER (WHERE r.matched_by = 'vid') AS by_vid
FROM makers m LEFT JOIN res r ON r.ord = m.ord GROUP BY ALL""",
)
_HIDDEN = "concat(c_name, chr(8203), ' Canon', chr(8238), c_mktsegment, chr(7), repeat(concat(' ', c_name), CAST(c_custkey % 12 AS INT)), chr(65279))"
_HIDDEN_SPARK = _HIDDEN
for _code in (8203, 8238, 7, 65279):
    # chr() of Spark is limited to one byte; the characters come from their UTF-16 code.
    _HIDDEN_SPARK = _HIDDEN_SPARK.replace(f"chr({_code})", f"decode(unhex('{_code:04X}'), 'UTF-16BE')")
_add(
    "device_normalize",
    lambda spark, sf: catalogs.device_normalize(
        table(spark, sf, "customer").selectExpr("c_custkey", f"{_HIDDEN_SPARK} AS name", "'escl' AS kind")
    ),
    f"""SELECT c_custkey, left(regexp_replace({_HIDDEN}, '[\\x{{7}}\\x{{200B}}\\x{{202E}}\\x{{FEFF}}]', '', 'g'), 128) AS name, 'escl' AS kind, 'canon' AS manufacturer_id, 'Canon' AS manufacturer_name FROM customer""",
)


def _inventory(spark, sf):
    hosts = table(spark, sf, "customer").selectExpr(
        "concat('host', c_custkey % 700) AS id", "c_custkey AS position", "c_name AS name", "'env' AS kind"
    )
    found = table(spark, sf, "orders").selectExpr(
        "concat('host', o_orderkey % 900) AS id", "o_orderkey AS position", "concat('mdns ', o_orderkey) AS name", "'mdns' AS kind"
    )
    return catalogs.device_inventory([hosts, found], 800)


_add(
    "device_inventory",
    _inventory,
    """WITH u AS (SELECT 'host' || c_custkey % 700 AS id, 0 AS source, c_custkey AS position, c_name AS name, 'env' AS kind FROM customer
  UNION ALL SELECT 'host' || o_orderkey % 900, 1, o_orderkey, 'mdns ' || o_orderkey, 'mdns' FROM orders),
f AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY source, position) AS rn FROM u)
SELECT id, name, kind, CAST(source AS INT) AS source FROM f WHERE rn = 1 ORDER BY source, position, id LIMIT 800""",
)

# --- capability documents and resolutions ----------------------------------

_XML = """concat('<?xml version="1.0"?><s:Caps xmlns:s="http://example.org/s" xmlns:p="http://example.org/p"><p:Make>', p_name, '</p:Make>',
 '<s:Platen><s:In><s:ColorMode>RGB24</s:ColorMode><s:ColorMode>', CASE WHEN p_size % 2 = 0 THEN 'rgb24' ELSE 'Grayscale8' END, '</s:ColorMode><p:DocumentFormat>image/jpeg</p:DocumentFormat>',
 '<s:DiscreteResolution><s:XResolution>', p_size * 10, '</s:XResolution><s:YResolution>', CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size * 20 END, '</s:YResolution></s:DiscreteResolution>',
 '<s:DiscreteResolution><s:XResolution>600</s:XResolution></s:DiscreteResolution>',
 '<s:DiscreteResolution><s:XResolution>600</s:XResolution><s:YResolution>600</s:YResolution></s:DiscreteResolution></s:In></s:Platen>',
 '<s:Adf><s:AdfSimplexInputCaps><s:ColorMode>BlackAndWhite1</s:ColorMode></s:AdfSimplexInputCaps><s:AdfDuplexInputCaps><p:DocumentFormatExt>image/png</p:DocumentFormatExt>',
 '<s:ResolutionRange><s:XResolutionRange><s:Min>', p_size + 50, '</s:Min><s:Max>', p_size * 30, '</s:Max>', CASE WHEN p_size % 3 = 0 THEN '' ELSE '<s:Step>25</s:Step>' END, '</s:XResolutionRange>',
 '<s:YResolutionRange><s:Min>75</s:Min><s:Max>1200</s:Max><s:Step>', p_size % 4, '</s:Step></s:YResolutionRange></s:ResolutionRange></s:AdfDuplexInputCaps></s:Adf></s:Caps>')"""


def _documents(spark, sf):
    return spread_small_input(table(spark, sf, "part")).selectExpr("p_partkey AS device", f"{_XML} AS xml")


_add(
    "capability_values",
    lambda spark, sf: capabilities.capability_values(_documents(spark, sf)).select("device", "source", "kind", "value"),
    """SELECT p_partkey AS device, source, kind, value FROM part, (VALUES ('platen', 'color_mode', 'RGB24', false), ('platen', 'color_mode', 'Grayscale8', true),
  ('platen', 'format', 'image/jpeg', false), ('adf_simplex', 'color_mode', 'BlackAndWhite1', false), ('adf_duplex', 'format', 'image/png', false)) t(source, kind, value, odd)
WHERE NOT odd OR p_size % 2 = 1""",
)
_add(
    "capability_rows",
    lambda spark, sf: capabilities.capability_resolutions(_documents(spark, sf)).drop("ordinal"),
    """SELECT p_partkey AS device, 'platen' AS source, 'discrete' AS kind, CAST(p_size * 10 AS BIGINT) AS x, CAST(p_size * 20 AS BIGINT) AS y, NULL::BIGINT AS min_x, NULL::BIGINT AS max_x,
  NULL::BIGINT AS step_x, NULL::BIGINT AS min_y, NULL::BIGINT AS max_y, NULL::BIGINT AS step_y FROM part WHERE p_size > 0 AND p_size % 5 <> 0
UNION ALL SELECT p_partkey, 'platen', 'discrete', 600, 600, NULL, NULL, NULL, NULL, NULL, NULL FROM part
UNION ALL SELECT p_partkey, 'adf_duplex', 'range', NULL, NULL, p_size + 50, p_size * 30, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 25 END, 75, 1200, greatest(p_size % 4, 1) FROM part WHERE p_size + 50 <= p_size * 30""",
)


# One document in seven is cut off; sizes and an input source that no path names.
_SOURCE_XML = """concat('<s:Caps xmlns:s="http://example.org/s"><s:MakeAndModel> ', p_brand, ' </s:MakeAndModel><s:Platen><s:MaxWidth>', p_size * 100, '</s:MaxWidth><s:MaxHeight>',
 CASE WHEN p_size % 4 = 0 THEN 'tall' ELSE CAST(p_size * 140 AS VARCHAR(20)) END, '</s:MaxHeight></s:Platen>', CASE WHEN p_size % 3 = 0 THEN '<s:InputSource>Feeder</s:InputSource>' ELSE '' END,
 '<s:FilmUnit><s:MaxScanWidth>36</s:MaxScanWidth></s:FilmUnit>', CASE WHEN p_partkey % 7 = 0 THEN '<s:Open>' ELSE '' END, '</s:Caps>')"""


def _sources(spark, sf):
    documents = spread_small_input(table(spark, sf, "part")).selectExpr("p_partkey AS device", f"{_SOURCE_XML} AS xml")
    return capabilities.capability_sources(documents).withColumn("error", F.col("error").isNotNull())


_add(
    "capability_sources",
    _sources,
    """SELECT p_partkey AS device, source, trim(p_brand) AS make_and_model, CAST(CASE source WHEN 'platen' THEN p_size * 100 WHEN 'film' THEN 36 END AS BIGINT) AS max_width,
  CAST(CASE WHEN source = 'platen' AND p_size % 4 <> 0 THEN p_size * 140 END AS BIGINT) AS max_height, false AS error
FROM part, (VALUES ('platen'), ('film'), ('default'), ('adf_simplex')) t(source) WHERE p_partkey % 7 <> 0 AND (source <> 'adf_simplex' OR p_size % 3 = 0)
UNION ALL SELECT p_partkey, NULL, NULL, NULL, NULL, true FROM part WHERE p_partkey % 7 = 0""",
)


def _pick(spark, sf):
    requests = table(spark, sf, "lineitem").selectExpr(
        "concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey, '-', CAST(l_quantity AS INT)) AS request_id", "l_partkey AS device",
        "CAST(l_quantity * 13 AS INT) AS dpi_x", "CAST(l_quantity * 17 AS INT) AS dpi_y",
    )
    # Every sixth part stands under a key that nobody asks for, which leaves gaps.
    parts = table(spark, sf, "part").withColumn("p_partkey", F.expr("CASE WHEN p_size % 6 = 0 THEN -p_partkey ELSE p_partkey END"))
    none = "CAST(NULL AS BIGINT)"
    spans = "CAST(p_size + 50 AS BIGINT) AS min_x, CAST(p_size * 30 AS BIGINT) AS max_x, CAST(25 AS BIGINT) AS step_x, CAST(75 AS BIGINT) AS min_y, CAST(700 AS BIGINT) AS max_y, CAST(50 AS BIGINT) AS step_y"
    empty = ", ".join(f"{none} AS {b}_{a}" for a in "xy" for b in ("min", "max", "step"))
    caps = parts.selectExpr("p_partkey AS device", "0 AS ordinal", "'discrete' AS kind", "CAST(p_size * 10 AS BIGINT) AS x", "CAST(p_size * 10 AS BIGINT) AS y", *empty.split(", "))
    caps = caps.unionByName(
        parts.selectExpr("p_partkey AS device", "1 AS ordinal", "'discrete' AS kind", "CAST(300 AS BIGINT) AS x", "CAST(600 AS BIGINT) AS y", *empty.split(", "))
    ).unionByName(
        parts.where("p_size + 50 <= p_size * 30").selectExpr("p_partkey AS device", "0 AS ordinal", "'range' AS kind", f"{none} AS x", f"{none} AS y", *spans.split(", "))
    )
    return catalogs.resolution_pick(requests, caps)


_add(
    "resolution_pick",
    _pick,
    """WITH rq AS (SELECT concat(l_orderkey, '-', l_linenumber, '-', l_suppkey, '-', l_partkey, '-', CAST(l_quantity AS INT)) AS request_id, l_partkey AS device, CAST(l_quantity * 13 AS INT) AS dpi_x, CAST(l_quantity * 17 AS INT) AS dpi_y FROM lineitem),
p AS (SELECT * REPLACE (CASE WHEN p_size % 6 = 0 THEN -p_partkey ELSE p_partkey END AS p_partkey) FROM part),
sx AS (SELECT rq.*, p_size, p_size + 50 AS lo, p_size * 30 AS hi, p_size + 50 + ((least(greatest(dpi_x, p_size + 50), p_size * 30) - p_size - 50) + 12) // 25 * 25 AS nx,
   75 + ((least(greatest(dpi_y, 75), 700) - 75) + 25) // 50 * 50 AS ny FROM rq JOIN p ON device = p_partkey),
c AS (SELECT request_id, 0 AS o, p_size * 10 AS x, p_size * 10 AS y, dpi_x, dpi_y FROM sx UNION ALL SELECT request_id, 1, 300, 600, dpi_x, dpi_y FROM sx
  UNION ALL SELECT request_id, 2, CASE WHEN nx > hi THEN nx - 25 ELSE nx END, CASE WHEN ny > 700 THEN ny - 50 ELSE ny END, dpi_x, dpi_y FROM sx WHERE lo <= hi),
r AS (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY abs(x - dpi_x) + abs(y - dpi_y), o) AS rn FROM c)
SELECT rq.*, CAST(coalesce(x, rq.dpi_x) AS BIGINT) AS pick_x, CAST(coalesce(y, rq.dpi_y) AS BIGINT) AS pick_y FROM rq LEFT JOIN (SELECT request_id, x, y FROM r WHERE rn = 1) r USING (request_id)""",
)


def _closest(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey", "CAST(l_quantity * 30 AS INT) AS requested",
        "CASE l_linenumber % 3 WHEN 0 THEN array(75, 150, 300, 600, 1200) ELSE CAST(array() AS ARRAY<INT>) END AS vals",
        "CASE WHEN l_linenumber % 3 = 1 THEN 100 END AS lo", "CASE WHEN l_linenumber % 3 = 1 THEN 900 END AS hi",
    )
    return rows.select(
        "l_orderkey", "l_linenumber", "l_suppkey", "requested",
        catalogs.resolution_closest(F.col("requested"), F.col("vals"), F.col("lo"), F.col("hi")).alias("closest"),
    )


_add(
    "resolution_closest",
    _closest,
    """WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, CAST(l_quantity * 30 AS INT) AS requested FROM lineitem)
SELECT *, CAST(CASE l_linenumber % 3 WHEN 0 THEN CASE WHEN requested <= 112 THEN 75 WHEN requested <= 225 THEN 150 WHEN requested <= 450 THEN 300 WHEN requested <= 900 THEN 600 ELSE 1200 END
  WHEN 1 THEN least(greatest(requested, 100), 900) ELSE requested END AS INT) AS closest FROM r""",
)

_PAPER_SQL = "paper AS (SELECT * FROM (VALUES {}) t(name, mw, mh))".format(
    ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE)" for k, v in PAPER_MM.items() if v)
)
_EXT = {
    "job_id": "o_orderkey",
    "dpi": "CAST(75 + o_orderkey % 10 * 75 AS INT)",
    "default_dpi": "CAST(CASE WHEN o_custkey % 9 = 0 THEN 0 ELSE 150 END AS INT)",
    "paper": "CASE o_orderkey % 6 WHEN 0 THEN 'a4' WHEN 1 THEN 'Letter' WHEN 2 THEN 'auto' END",
    "config_paper": "CASE o_custkey % 5 WHEN 0 THEN 'auto' WHEN 1 THEN 'legal' WHEN 2 THEN 'bogus' WHEN 3 THEN ' A6 ' ELSE 'a5' END",
    "width": "CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey % 2000 END AS INT)",
    "height": "CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_custkey % 3000 END AS INT)",
    "default_width": "CAST(o_custkey % 700 AS INT)",
    "default_height": "CAST(o_custkey % 900 AS INT)",
}
_EXT_SQL = "e AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EXT.items()) + " FROM orders)"
_add(
    "paper_pixels",
    lambda spark, sf: table(spark, sf, "orders")
    .selectExpr(*[f"{_EXT[k]} AS {k}" for k in ("job_id", "dpi", "config_paper")])
    .select(
        "job_id", "dpi", "config_paper",
        catalogs.paper_pixels(F.col("config_paper"), F.col("dpi"), 0).alias("px_width"),
        catalogs.paper_pixels(F.col("config_paper"), F.col("dpi"), 1).alias("px_height"),
    ),
    f"""WITH {_EXT_SQL}, {_PAPER_SQL} SELECT job_id, dpi, config_paper, CAST(CASE WHEN mw IS NOT NULL THEN greatest(round(mw / 25.4::DOUBLE * dpi), 1) END AS BIGINT) AS px_width,
  CAST(CASE WHEN mh IS NOT NULL THEN greatest(round(mh / 25.4::DOUBLE * dpi), 1) END AS BIGINT) AS px_height FROM e LEFT JOIN paper ON lower(trim(config_paper)) = name""",
)


def _extent_axis_sql(asked: str, stored: str, mm: str) -> str:
    return f"""CAST(CASE WHEN {asked} IS NOT NULL THEN {asked} WHEN paper IS NOT NULL AND a.name IS NOT NULL THEN greatest(round(a.{mm} / 25.4::DOUBLE * dpi), 1)
  WHEN paper IS NULL AND b.name IS NOT NULL THEN greatest(round(b.{mm} / 25.4::DOUBLE * dpi), 1)
  WHEN {stored} = 0 OR default_dpi = 0 OR default_dpi = dpi THEN {stored} ELSE (CAST({stored} AS BIGINT) * dpi + default_dpi // 2) // default_dpi END AS BIGINT)"""


_add(
    "scan_extent",
    lambda spark, sf: catalogs.scan_extent(table(spark, sf, "orders").selectExpr(*[f"{v} AS {k}" for k, v in _EXT.items()])).select(
        "job_id", "extent_width", "extent_height"
    ),
    f"""WITH {_EXT_SQL}, {_PAPER_SQL.replace('paper AS', 'sizes AS')} SELECT job_id, {_extent_axis_sql('width', 'default_width', 'mw')} AS extent_width,
  {_extent_axis_sql('height', 'default_height', 'mh')} AS extent_height
FROM e LEFT JOIN sizes a ON lower(trim(paper)) = a.name LEFT JOIN sizes b ON lower(trim(config_paper)) = b.name""",
)
_add(
    "configured_crop",
    lambda spark, sf: catalogs.configured_crop(
        table(spark, sf, "orders")
        .selectExpr(*[f"{_EXT[k]} AS {k}" for k in ("job_id", "dpi", "default_dpi", "default_width", "default_height")])
        .withColumn("crop", F.expr("struct(default_width - 20 AS x, 7 AS y, default_width AS w, default_height AS h)"))
    ).select("job_id", *[F.col(f"crop_scaled.{p}").alias(f"crop_{p}") for p in ("x", "y", "w", "h")]),
    f"""WITH {_EXT_SQL}, c AS (SELECT *, default_width - 20 AS x, 7 AS y FROM e),
s AS (SELECT *, default_dpi = 0 OR dpi = default_dpi AS same FROM c)
SELECT job_id, """ + ", ".join(
        f"CAST(CASE WHEN {c} <= 0 OR same THEN {c} ELSE (CAST({c} AS BIGINT) * dpi + default_dpi // 2) // default_dpi END AS BIGINT) AS crop_{p}"
        for p, c in (("x", "x"), ("y", "y"), ("w", "default_width"), ("h", "default_height"))
    ) + " FROM s",
)

# --- settings --------------------------------------------------------------

_VALUES = {
    "brightness": "CAST(o_orderkey % 260 - 130 AS INT)",
    "levels_black": "CAST(o_custkey % 300 - 20 AS INT)",
    "levels_white": "CAST(o_orderkey % 290 AS INT)",
    "levels_gamma": "CAST(o_orderkey % 5 AS INT)",
    "hue": "CAST(o_custkey % 400 - 200 AS INT)",
    "sharpen_amount": "CAST(o_orderkey % 8 - 1 AS INT)",
    "rotate": "CAST(o_orderkey % 7 * 45 AS INT)",
    "default_width": "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 320 ELSE o_custkey % 3 * 100 END AS INT)",
    "default_height": "CAST(CASE WHEN o_orderkey % 3 = 0 THEN 240 ELSE o_orderkey % 2 * 200 END AS INT)",
    "batch_pages": "CAST(o_custkey % 1100 AS INT)",
    "default_dpi": "CAST(o_custkey % 500 AS INT)",
    "descreen_dpi": "CAST(o_orderkey % 1300 AS INT)",
}
_WORDS = {
    "infrared_clean": "CASE o_orderkey % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'off' WHEN 2 THEN 'hevy' ELSE 'light' END",
    "film_type": "CASE o_custkey % 4 WHEN 0 THEN 'fuji_c200' WHEN 1 THEN 'none' WHEN 2 THEN 'agfa_unknown' ELSE 'kodachrome_25' END",
    "colorize_mode": "CASE o_custkey % 3 WHEN 0 THEN 'Warm' WHEN 1 THEN 'red' ELSE 'false' END",
    "paper_size": "CASE o_custkey % 3 WHEN 0 THEN 'A4' WHEN 1 THEN 'b5' ELSE 'auto' END",
    "output_format": "CASE o_orderkey % 4 WHEN 0 THEN 'PNG' WHEN 1 THEN 'svg' ELSE 'pdf' END",
    "output_name": "CASE o_orderkey % 4 WHEN 0 THEN 'con.txt' WHEN 1 THEN 'a/b' WHEN 2 THEN concat('scan ', o_orderkey) ELSE 'trail.' END",
    "ocr_engine": "CASE o_custkey % 3 WHEN 0 THEN 'ocrs' WHEN 1 THEN 'Tesseract' ELSE 'magic' END",
    "ocr_language": "CASE o_orderkey % 2 WHEN 0 THEN 'eng' ELSE 'deu' END",
}
# A field is left out of the record for some orders, so defaults show.
_CONFIG = (
    "concat('{"
    + ",".join(f'"{k}":\', {v}, \'' for k, v in _VALUES.items())
    + "', CASE WHEN o_orderkey % 2 = 0 THEN ',\"config_version\":1' ELSE '' END, CASE WHEN o_orderkey % 3 = 1 THEN concat('"
    + "".join(f',"{k}":"\', {v}, \'"' for k, v in _WORDS.items())
    + "') ELSE '' END, ',\"unknown\":[1],\"crop\":[', o_custkey % 3 - 1, ',0,5,', o_orderkey % 4, '],\"curves\":[[0,', o_orderkey % 300, '],[', o_custkey % 2 * 9, ',255]]}')"
)
_WIDE = "w AS (SELECT o_orderkey, o_custkey, o_orderkey % 3 = 1 AS words, o_orderkey % 2 = 0 AS versioned, " + ", ".join(
    f"{v} AS {k}" for k, v in {**_VALUES, **_WORDS}.items()
) + " FROM orders)"


def _settings(spark, sf):
    rows = table(spark, sf, "orders").selectExpr("o_orderkey", "o_custkey", f"{_CONFIG} AS config")
    return settings.settings_load(rows)


_OVERRIDES = {
    "brightness": "CASE WHEN o_custkey % 4 = 0 THEN 33 END",
    "rotate": "CASE WHEN o_custkey % 5 = 0 THEN -90 END",
    "infrared_clean": "CASE o_custkey % 6 WHEN 0 THEN ' ' WHEN 1 THEN 'OFF' WHEN 2 THEN ' medium ' END",
    "film_type": "CASE o_custkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'fuji_c200' END",
}


def _resolved(spark, sf):
    rows = _settings(spark, sf)
    for name, text in _OVERRIDES.items():
        rows = rows.withColumn(f"g_{name}", F.expr(text))
    done = settings.settings_resolve(rows, {name: f"g_{name}" for name in _OVERRIDES})
    shown = ("rotate", "brightness", "contrast", "levels_black", "levels_gamma", "infrared_clean", "film_type", "default_width", "default_height", "paper_size", "ocr_language", "config_version")
    return done.select("o_orderkey", *[F.col(f"s.{n}").alias(n) for n in shown], "error")


_add(
    "settings_resolve",
    _resolved,
    f"""WITH {_WIDE}, g AS (SELECT w.*, {", ".join(f"{v} AS g_{k}" for k, v in _OVERRIDES.items())} FROM w),
k AS (SELECT *, coalesce(g_rotate, rotate) % 360 AS turn0, NOT versioned AND default_width = 320 AND default_height = 240 AS legacy, CASE WHEN words THEN infrared_clean END AS ic, CASE WHEN words THEN film_type END AS ft FROM g),
t AS (SELECT *, (turn0 + 360) % 360 AS turn FROM k)
SELECT o_orderkey, CAST(CASE WHEN turn IN (90, 180, 270) THEN turn ELSE 0 END AS INT) AS rotate, CAST(coalesce(g_brightness, brightness) AS INT) AS brightness, CAST(0 AS INT) AS contrast, levels_black,
  CAST(levels_gamma AS DOUBLE) AS levels_gamma, CASE WHEN trim(coalesce(g_infrared_clean, '')) = '' THEN ic WHEN lower(trim(g_infrared_clean)) IN ('off', 'none', 'false') THEN NULL ELSE trim(g_infrared_clean) END AS infrared_clean,
  CASE WHEN g_film_type IS NULL THEN ft WHEN g_film_type = 'none' THEN NULL ELSE g_film_type END AS film_type,
  CAST(CASE WHEN legacy THEN 0 ELSE default_width END AS INT) AS default_width, CAST(CASE WHEN legacy THEN 0 ELSE default_height END AS INT) AS default_height,
  CASE WHEN words THEN paper_size ELSE 'auto' END AS paper_size, CASE WHEN words THEN ocr_language ELSE 'eng' END AS ocr_language, CAST(1 AS INT) AS config_version, CAST(NULL AS VARCHAR) AS error FROM t""",
)
_TIER_WORDS = _quoted([*TIER_ALIASES, *TIER_OFF])
_RULES_SQL = {
    "output_name": "words AND o_orderkey % 4 <> 2",
    "output_format": f"words AND lower(output_format) NOT IN ({_quoted(IMAGE_FORMATS)})",
    "ocr_engine": f"words AND lower(ocr_engine) NOT IN ({_quoted(OCR_ENGINES)})",
    "ocr_language": "words AND ocr_engine = 'ocrs' AND ocr_language <> 'eng'",
    "dpi": "default_dpi < 50",
    "both extents or neither": "(dw = 0) <> (dh = 0)",
    "paper_size": f"words AND lower(paper_size) NOT IN ({_quoted(PAPER_MM)})",
    "batch_pages": "batch_pages NOT BETWEEN 1 AND 1000",
    "hue": "hue NOT BETWEEN -180 AND 180",
    "curves": "o_orderkey % 300 > 255 OR o_custkey % 2 = 0",
    "rotate": "rotate % 90 <> 0",
    "levels_gamma": "levels_gamma <= 0",
    "film_type": f"words AND lower(film_type) NOT IN ('off', 'none', 'false', '') AND film_type NOT IN ({_quoted(f['film_id'] for f in film_profiles())})",
    "brightness": "brightness NOT BETWEEN -100 AND 100",
    "levels range": "levels_black NOT BETWEEN 0 AND 255 OR levels_white NOT BETWEEN 0 AND 255",
    "levels order": "levels_black >= levels_white",
    "sharpen_amount": "sharpen_amount NOT BETWEEN 0 AND 5",
    "descreen_dpi": "descreen_dpi NOT BETWEEN 25 AND 1200",
    "infrared_clean": f"words AND lower(infrared_clean) NOT IN ({_TIER_WORDS})",
    "colorize_mode": f"words AND lower(colorize_mode) NOT IN ('off', 'none', 'false', '', {_quoted(TINT_NAMES)})",
    "crop": "o_custkey % 3 - 1 < 0 OR o_orderkey % 4 < 1",
}
_add(
    "settings_validate",
    lambda spark, sf: settings.settings_validate(_settings(spark, sf), "o_orderkey"),
    f"""WITH {_WIDE}, k AS (SELECT *, NOT versioned AND default_width = 320 AND default_height = 240 AS legacy FROM w),
d AS (SELECT *, CASE WHEN legacy THEN 0 ELSE default_width END AS dw, CASE WHEN legacy THEN 0 ELSE default_height END AS dh FROM k)
""" + "\nUNION ALL ".join(f"SELECT o_orderkey, '{rule}' AS rule FROM d WHERE {test}" for rule, test in _RULES_SQL.items()),
)
_TIER = "CASE l_partkey % 12 WHEN 0 THEN ' Off ' WHEN 1 THEN 'L' WHEN 2 THEN 'low' WHEN 3 THEN 'TRUE' WHEN 4 THEN 'yes' WHEN 5 THEN '1' WHEN 6 THEN 'strong' WHEN 7 THEN '0' WHEN 8 THEN 'hevy' WHEN 9 THEN '' WHEN 10 THEN 'heavy' END"
_add(
    "tier_normalize",
    lambda spark, sf: table(spark, sf, "lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_suppkey", f"{_TIER} AS asked")
    .withColumn("_t", settings.tier_column(F.col("asked")))
    .select("l_orderkey", "l_linenumber", "l_suppkey", "asked", "_t.tier", "_t.error"),
    f"""WITH a AS (SELECT l_orderkey, l_linenumber, l_suppkey, {_TIER} AS asked FROM lineitem),
m AS (SELECT * FROM (VALUES {", ".join(f"('{k}', '{v}')" for k, v in TIER_ALIASES.items())}) t(alias, tier))
SELECT l_orderkey, l_linenumber, l_suppkey, asked, tier, CASE WHEN tier IS NULL AND lower(trim(asked)) NOT IN ({_quoted(TIER_OFF)}) THEN 'unknown tier' END AS error
FROM a LEFT JOIN m ON lower(trim(asked)) = alias""",
)
_CURVE = """CASE l_linenumber WHEN 1 THEN concat('0:', l_suppkey % 256, ', 128:200 ,255:', l_partkey % 256) WHEN 2 THEN concat('10:20,', l_suppkey % 20, ':30')
  WHEN 3 THEN concat('5', l_suppkey % 9) WHEN 4 THEN concat('0:0,7:', l_partkey) WHEN 5 THEN concat('1:2,x', l_suppkey, ':3') WHEN 6 THEN ' ' ELSE concat('+3:', l_suppkey % 200) END"""
_add(
    "curve_parse",
    lambda spark, sf: spread_small_input(table(spark, sf, "lineitem"))
    .selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_CURVE} AS curve")
    .withColumn("_p", settings.curve_parse(F.col("curve")))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", settings.curve_format(F.col("_p.points")).alias("points"), F.col("_p.error").alias("error")),
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 CASE l_linenumber WHEN 1 THEN concat('0:', l_suppkey % 256, ',128:200,255:', l_partkey % 256) WHEN 2 THEN CASE WHEN l_suppkey % 20 > 10 THEN concat('10:20,', l_suppkey % 20, ':30') ELSE '' END
   WHEN 4 THEN CASE WHEN l_partkey <= 255 THEN concat('0:0,7:', l_partkey) ELSE '' END ELSE '' END AS points,
 CASE l_linenumber WHEN 2 THEN CASE WHEN l_suppkey % 20 <= 10 THEN 'curve: x not rising' END WHEN 3 THEN 'curve point 1: not x:y'
   WHEN 4 THEN CASE WHEN l_partkey > 255 THEN 'curve point 2: outside 0-255' END WHEN 5 THEN 'curve point 2: bad x'
   WHEN 7 THEN 'curve: too few points' END AS error FROM lineitem""",
)
_NAME = """CASE c_custkey % 12 WHEN 0 THEN 'CON' WHEN 1 THEN concat('lpt', c_custkey % 10, '.pdf') WHEN 2 THEN '..' WHEN 3 THEN concat(c_name, ' ') WHEN 4 THEN concat(c_name, ':', c_mktsegment)
  WHEN 5 THEN repeat(c_name, CAST(c_custkey % 9 AS INT)) WHEN 6 THEN 'com10' WHEN 7 THEN concat('a', chr(7), 'b') WHEN 8 THEN concat(c_name, '.') WHEN 9 THEN 'nul.tar.gz' ELSE c_name END"""
_add(
    "output_name_check",
    lambda spark, sf: table(spark, sf, "customer")
    .selectExpr("c_custkey", f"{_NAME} AS name")
    .select("c_custkey", settings.output_name_error(F.col("name")).alias("error")),
    f"""WITH n AS (SELECT c_custkey, {_NAME} AS name FROM customer)
SELECT c_custkey, CASE WHEN name = '' OR strlen(name) > 128 THEN 'length' WHEN name IN ('.', '..') THEN 'not a file name' WHEN right(name, 1) IN ('.', ' ') THEN 'ends with a dot or space'
  WHEN regexp_matches(name, '[\\x00-\\x1f\\x7f/\\\\:*?"<>|]') THEN 'reserved character'
  WHEN regexp_full_match(upper(split_part(name, '.', 1)), 'CON|PRN|AUX|NUL|(COM|LPT)[1-9]') THEN 'reserved device name' END AS error FROM n""",
)
_LANG = "CASE o_custkey % 6 WHEN 0 THEN 'eng' WHEN 1 THEN '  ' WHEN 2 THEN concat('de', chr(9), 'u') WHEN 3 THEN repeat('eng+', CAST(o_orderkey % 30 AS INT)) WHEN 4 THEN 'deu' ELSE ' eng ' END"
_ENGINE = "CASE o_orderkey % 3 WHEN 0 THEN 'ocrs' WHEN 1 THEN 'OCRS' ELSE 'tesseract' END"
_add(
    "ocr_language_check",
    lambda spark, sf: table(spark, sf, "orders")
    .selectExpr("o_orderkey", f"{_LANG} AS language", f"{_ENGINE} AS engine")
    .select("o_orderkey", settings.ocr_language_error(F.col("language"), F.col("engine")).alias("error")),
    f"""WITH l AS (SELECT o_orderkey, {_LANG} AS language, {_ENGINE} AS engine FROM orders)
SELECT o_orderkey, CASE WHEN trim(language) = '' OR strlen(trim(language)) > 64 THEN 'length' WHEN regexp_matches(trim(language), '[\\x00-\\x1f\\x7f]') THEN 'control characters'
  WHEN lower(engine) = 'ocrs' AND language <> 'eng' THEN 'engine supports only eng' END AS error FROM l""",
)
_JSON = """concat('{"user":', user_id, ',"', CASE event_id % 5 WHEN 0 THEN 'License' WHEN 1 THEN 'serial_number' WHEN 2 THEN 'DRM' WHEN 3 THEN 'serials' ELSE 'note' END, '":"', event_type, '","props":', props, '}')"""
_add(
    "redact_keys",
    lambda spark, sf: table(spark, sf, "events").selectExpr("event_id", f"{_JSON} AS body").select(
        "event_id", settings.redact_keys(F.col("body")).alias("body")
    ),
    """SELECT event_id, concat('{"user":', user_id, CASE event_id % 5 WHEN 3 THEN concat(',"serials":"', event_type, '"') WHEN 4 THEN concat(',"note":"', event_type, '"') ELSE '' END,
  ',"props":', replace(props, ': ', ':'), '}') AS body FROM events""",
)
_DEEP = """concat(repeat('{"a":', 8), '{"serial":"', event_type, '","k":', user_id, '}', repeat('}', 8))"""
_add(
    "redact_deep",
    lambda spark, sf: table(spark, sf, "events").selectExpr("event_id", f"{_DEEP} AS body").select(
        "event_id", settings.redact_keys(F.col("body")).alias("body")
    ),
    """SELECT event_id, concat(repeat('{"a":', 8), '{"k":', user_id, '}', repeat('}', 8)) AS body FROM events""",
)

# --- job events ------------------------------------------------------------

_EVENT = {
    "job_id": "user_id",
    "seq": "event_id",
    "kind": "CASE WHEN event_type = 'error' THEN CASE event_id % 9 WHEN 0 THEN 'fail' WHEN 1 THEN 'cancel' WHEN 2 THEN 'finish' WHEN 3 THEN 'publishing' WHEN 4 THEN 'finish' ELSE 'progress' END WHEN event_type = 'click' AND event_id % 11 = 0 THEN 'raw' WHEN event_type IN ('purchase', 'click') THEN 'published' ELSE 'progress' END",
    "phase": "CASE event_id % 7 WHEN 0 THEN 'open' WHEN 1 THEN 'acquire' WHEN 2 THEN 'pipeline' WHEN 3 THEN 'save' WHEN 4 THEN 'idle' WHEN 5 THEN 'done' ELSE 'batch' END",
    "path": "concat('out/', CAST(floor(value) AS BIGINT))",
    "output": "CASE WHEN event_type = 'purchase' THEN 'page' WHEN event_type = 'click' THEN 'document' WHEN event_id % 5 = 0 THEN 'image' END",
    "error": "CASE WHEN event_type = 'error' AND event_id % 9 = 0 THEN concat('E', event_id) END",
    "paths": "split(CASE event_id % 4 WHEN 1 THEN 'out/5' WHEN 2 THEN concat('out/', event_id % 50, ',out/', event_id % 70, ',out/3') WHEN 3 THEN 'out/9,new/9' END, ',')",
    "reason": "CASE event_id % 2 WHEN 0 THEN 'limit_reached' ELSE 'feeder_exhausted' END",
}
_EV = "ev AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _EVENT.items()) + " FROM events)"
_FILES = """files AS (
  SELECT job_id, seq, 0 AS ordinal, path, CASE kind WHEN 'raw' THEN 'raw' ELSE output END AS output FROM ev WHERE kind IN ('published', 'raw')
  UNION ALL SELECT job_id, seq, i - 1, paths[i], coalesce(output, 'page') FROM (SELECT *, unnest(generate_series(1, len(paths))) AS i FROM ev WHERE kind = 'finish' AND paths IS NOT NULL))"""


def event_rows(df):
    return df.selectExpr(*[f"{v} AS {k}" for k, v in _EVENT.items()])


REPORT_SQL = f"""WITH {_EV}, {_FILES},
m AS (SELECT *, CASE WHEN kind = 'progress' THEN CASE WHEN phase IN ('open', 'acquire', 'batch') THEN 'Acquiring' WHEN phase = 'pipeline' THEN 'Processing' WHEN phase IN ('save', 'done') THEN 'Publishing' END
   WHEN kind = 'publishing' THEN 'Publishing' WHEN kind IN ('finish', 'cancel', 'fail') THEN 'Finished' END AS moved,
   CASE kind WHEN 'finish' THEN 'Completed' WHEN 'cancel' THEN 'Cancelled' WHEN 'fail' THEN 'Failed' END AS ended FROM ev),
t AS (SELECT job_id, ended AS terminal, CASE kind WHEN 'fail' THEN error END AS error, CASE kind WHEN 'finish' THEN reason END AS end_reason FROM m WHERE ended IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1),
p AS (SELECT job_id, moved AS phase FROM m WHERE moved IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1),
a AS (SELECT job_id, seq, len(paths) AS n FROM ev WHERE kind = 'finish' AND paths IS NOT NULL QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1),
s AS (SELECT ev.job_id, coalesce(any_value(a.n), 0) + count(*) FILTER (WHERE kind = 'published' AND output = 'page' AND (a.seq IS NULL OR ev.seq > a.seq)) AS sides_complete, count(*) AS events FROM ev LEFT JOIN a ON ev.job_id = a.job_id GROUP BY 1),
f AS (SELECT job_id, count(DISTINCT path) AS published_files FROM files GROUP BY 1)
SELECT s.job_id, coalesce(p.phase, 'Preparing') AS phase, t.terminal, t.error, t.end_reason, sides_complete, coalesce(published_files, 0) AS published_files, events
FROM s LEFT JOIN p USING (job_id) LEFT JOIN t USING (job_id) LEFT JOIN f USING (job_id)"""
_add("job_report", lambda spark, sf: jobs.job_report(event_rows(table(spark, sf, "events"))), REPORT_SQL)
_add(
    "published_files",
    lambda spark, sf: jobs.published_files(event_rows(table(spark, sf, "events"))),
    f"""WITH {_EV}, {_FILES}, f AS (SELECT job_id, path, min(struct_pack(s := seq, o := ordinal, k := output)) AS x FROM files GROUP BY 1, 2)
SELECT job_id, row_number() OVER (PARTITION BY job_id ORDER BY x.s, x.o, path) AS position, x.s AS seq, path, x.k AS output FROM f""",
)

# Job requests from orders: formats and destinations with and without extension, some shared.
_REQUEST = {
    "job_id": "o_orderkey",
    "out": "CASE WHEN o_orderkey % 5 = 0 THEN concat('scan/', o_custkey, CASE o_orderkey % 4 WHEN 0 THEN '.PDF' WHEN 1 THEN '.png' WHEN 2 THEN '.doc' ELSE '' END) END",
    "raw_out": "CASE WHEN o_orderkey % 15 = 0 THEN concat('scan/', o_custkey, '.png') END",
    "out_dir": "CASE WHEN o_orderkey % 5 <> 0 THEN concat('batch/', o_custkey, CASE WHEN o_orderkey % 2 = 0 THEN '/' ELSE '' END) END",
    "pages": "CAST(o_orderkey % 23 AS INT)",
    "format": "CASE o_orderkey % 3 WHEN 0 THEN 'png' WHEN 1 THEN '.tif' ELSE 'jpg' END",
    "multipage_out": "CASE o_orderkey % 6 WHEN 0 THEN concat('batch/', o_custkey, '/all') WHEN 1 THEN 'all.tiff' WHEN 2 THEN 'all.jpg' END",
    "multipage_tiff": "CASE o_orderkey % 7 WHEN 1 THEN 'all.tiff' WHEN 2 THEN './x/../all.tiff' WHEN 3 THEN 'all.pdf' WHEN 4 THEN 'a.b/all' END",
    "multipage_pdf": "CASE o_orderkey % 8 WHEN 3 THEN 'all.pdf' WHEN 4 THEN '.pdf' END",
    "contact_sheet": "CASE o_orderkey % 9 WHEN 1 THEN 'sheet' WHEN 2 THEN concat('batch/', o_custkey, '/page_001.png') WHEN 3 THEN 'sheet.txt' END",
    "overwrite": "o_orderkey % 2 = 0",
}
_RQ = "rq AS (SELECT " + ", ".join(f"{v} AS {k}" for k, v in _REQUEST.items()) + " FROM orders)"
_SUFFIX = r"nullif(lower(regexp_extract({0}, '[^/]\.([^./]*)$', 1)), '')"
_IMAGES = ", ".join(f"'{x}'" for x in jobs.IMAGES)


def _asked(place: str, kind: str, path: str, allowed: str, where: str) -> str:
    ext = _SUFFIX.format("p")
    return f"""SELECT job_id, {kind} AS kind, p AS path, '{place}' AS place, CASE WHEN {ext} IS NULL THEN 'no extension' WHEN {ext} NOT IN ({allowed}) THEN concat('extension not allowed: ', {ext}) END AS error
  FROM (SELECT *, {path} AS p FROM rq WHERE {where})"""


def _or(place: str, extension: str) -> str:
    return f"CASE WHEN {_SUFFIX.format(place)} IS NULL THEN {place} || '.{extension}' ELSE {place} END"


_ASKED = " UNION ALL ".join(
    [
        _asked("out", "CASE WHEN " + _SUFFIX.format("p") + " = 'pdf' THEN 'document' ELSE 'image' END", "out", _IMAGES, "out IS NOT NULL"),
        _asked("raw_out", "'raw'", "raw_out", _IMAGES, "raw_out IS NOT NULL"),
        _asked("multipage_out", "'document'", _or("multipage_out", "tif"), "'pdf', 'tif', 'tiff'", "out_dir IS NOT NULL AND multipage_out IS NOT NULL"),
        _asked("multipage_tiff", "'document'", "multipage_tiff", "'tif', 'tiff'", "out_dir IS NOT NULL AND multipage_tiff IS NOT NULL"),
        _asked("multipage_pdf", "'document'", "multipage_pdf", "'pdf'", "out_dir IS NOT NULL AND multipage_pdf IS NOT NULL"),
        _asked("contact_sheet", "'contact_sheet'", _or("contact_sheet", "bmp"), _IMAGES, "out_dir IS NOT NULL AND contact_sheet IS NOT NULL"),
        """SELECT job_id, 'page', concat(rtrim(out_dir, '/'), '/page_', lpad(CAST(n AS VARCHAR), CAST(greatest(3, len(CAST(pages AS VARCHAR))) AS INTEGER), '0'), '.', ltrim(format, '.')), 'page', NULL
  FROM (SELECT *, unnest(range(1, pages + 1)) AS n FROM rq WHERE out_dir IS NOT NULL)""",
    ]
)
_add("requested_outputs", lambda spark, sf: jobs.requested_outputs(request_rows(table(spark, sf, "orders"))), f"WITH {_RQ} {_ASKED}")


def request_rows(df):
    return df.selectExpr(*[f"{v} AS {k}" for k, v in _REQUEST.items()])


def _problems(spark, sf):
    requests = request_rows(table(spark, sf, "orders"))
    present = table(spark, sf, "customer").selectExpr("concat('batch//', c_custkey, '/./page_002.tif') AS path")
    return jobs.destination_problems(requests, present)


# The fixture's paths have no dot parts but the one written out here.
_add(
    "destination_problems",
    _problems,
    f"""WITH {_RQ}, asked AS ({_ASKED}), t AS (SELECT job_id, replace(path, './x/../', '') AS path, place, error FROM asked),
shared AS (SELECT job_id, path, array_to_string(list_sort(list_distinct(list(place))), ',') AS places FROM t GROUP BY 1, 2 HAVING count(*) > 1),
there AS (SELECT DISTINCT t.job_id, t.path, place FROM t JOIN rq ON rq.job_id = t.job_id AND NOT overwrite JOIN (SELECT DISTINCT concat('batch/', c_custkey, '/page_002.tif') AS path FROM customer) c ON c.path = t.path)
SELECT job_id, path, place AS places, error AS problem FROM t WHERE error IS NOT NULL
UNION ALL SELECT job_id, path, places, 'claimed more than once' FROM shared
UNION ALL SELECT job_id, path, array_to_string(list_sort(list_distinct(list(place))), ','), 'exists' FROM there GROUP BY 1, 2""",
)
_add(
    "job_progress",
    lambda spark, sf: (lambda p: jobs.job_progress(p, manifest.job_totals(p)).withColumn("percent", F.round("percent", 9)))(pages_of_jobs(spark, sf)),
    f"""WITH {_MAN}, t AS (SELECT *, count(*) OVER (PARTITION BY job_id) AS n FROM man)
SELECT job_id, page_no, 'batch' AS phase, round((page_no - 1) / CAST(n AS DOUBLE), 9) AS percent, concat('page ', page_no, '/', n) AS message FROM t""",
)


def _reconcile(spark, sf):
    pages = pages_of_jobs(spark, sf)
    requested = pages.where("quantity < 40").select("job_id", "path")
    return jobs.output_reconcile(requested, pages.where("quantity > 10").select("job_id", "path"))


_add(
    "output_reconcile",
    _reconcile,
    f"""WITH {_MAN}, asked AS (SELECT DISTINCT job_id, path FROM man WHERE quantity < 40), made AS (SELECT DISTINCT job_id, path FROM man WHERE quantity > 10)
SELECT job_id, path, CASE WHEN made.p IS NULL THEN 'missing' WHEN asked.p IS NULL THEN 'unexpected' ELSE 'published' END AS status
FROM (SELECT *, path AS p FROM asked) asked FULL JOIN (SELECT *, path AS p FROM made) made USING (job_id, path)""",
)

# --- translations ----------------------------------------------------------

_TAG = """CASE l_partkey % 16 WHEN 0 THEN 'pt_BR' WHEN 1 THEN ' zh-Hant-TW ' WHEN 2 THEN 'zh-Hans-HK' WHEN 3 THEN 'nb-NO' WHEN 4 THEN 'xx' WHEN 5 THEN '' WHEN 6 THEN 'DE_at' WHEN 7 THEN 'zh_MO'
  WHEN 8 THEN 'pt' WHEN 9 THEN 'nn' WHEN 10 THEN '-' WHEN 11 THEN 'fr' WHEN 12 THEN 'es' WHEN 13 THEN 'en-GB' WHEN 14 THEN 'zh' ELSE 'fr-CA' END"""
_NORM = f"""CASE l_partkey % 16 WHEN 0 THEN 'pb' WHEN 1 THEN 'tw' WHEN 2 THEN 'zh' WHEN 3 THEN 'no' WHEN 6 THEN 'de' WHEN 7 THEN 'tw' WHEN 8 THEN 'pt' WHEN 9 THEN 'no' WHEN 11 THEN 'fr' WHEN 12 THEN 'es' WHEN 14 THEN 'zh' WHEN 15 THEN 'fr' ELSE 'en' END"""
_add(
    "lang_normalize",
    lambda spark, sf: table(spark, sf, "lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_TAG} AS tag")
    .withColumn("lang", i18n.lang_normalize(F.col("tag"))),
    f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_TAG} AS tag, {_NORM} AS lang FROM lineitem",
)
# Some English texts stand under spare keys, which leaves gaps.
_KEY = "CASE WHEN lang = 'en' AND doc_id % 150 >= 120 THEN concat('spare.', doc_id % 7) ELSE CASE doc_id % 40 WHEN 0 THEN 'open' WHEN 1 THEN 'scan' WHEN 2 THEN 'menu.image' ELSE concat('key.', doc_id % 150) END END"


def _translations(spark, sf):
    docs = table(spark, sf, "documents").selectExpr("lang", f"{_KEY} AS key", "doc_id", "text")
    return docs.groupBy("lang", "key").agg(F.min_by("text", "doc_id").alias("text"))


_TR = f"""tr AS (SELECT lang, {_KEY} AS key, arg_min(text, doc_id) AS text FROM documents GROUP BY 1, 2)"""
_ASKED = "CASE l_suppkey % 9 WHEN 0 THEN 'button.open' WHEN 1 THEN 'button.scan_plus' WHEN 2 THEN 'menu.view' WHEN 3 THEN 'button.zoom_out' ELSE concat('key.', l_partkey % 160) END"


def _translate(spark, sf):
    asked = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", f"{_TAG} AS language", f"{_ASKED} AS key",
        "array(struct('version' AS name, CAST(l_linenumber AS STRING) AS value), struct('the' AS name, '!' AS value)) AS arguments",
    )
    words = _translations(spark, sf).withColumn("text", F.concat("text", F.lit(" {version}")))
    done = i18n.translate_resolve(asked, words, "l_orderkey", "arguments")
    return done.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "key", F.md5("text").alias("text_md5"))


_add(
    "translate_resolve",
    _translate,
    f"""WITH {_TR}, a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {_NORM} AS lang, {_ASKED} AS key FROM lineitem),
c AS (SELECT *, CASE key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KEY_ALIASES.items())} WHEN 'button.scan_plus' THEN 'scan' ELSE key END AS ck FROM a),
t AS (SELECT c.*, coalesce(x.text || ' {{version}}', e.text || ' {{version}}', ck) AS base FROM c LEFT JOIN tr x ON x.lang = c.lang AND x.key = ck LEFT JOIN tr e ON e.lang = 'en' AND e.key = ck),
s AS (SELECT *, CASE key {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in KEY_SYMBOLS.items())} WHEN 'button.scan_plus' THEN base || ' +1' ELSE base END AS txt FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, key, md5(replace(replace(txt, '{{version}}', CAST(l_linenumber AS VARCHAR)), '{{the}}', '!')) AS text_md5 FROM s""",
)
_add(
    "catalog_gaps",
    lambda spark, sf: i18n.catalog_gaps(_translations(spark, sf)),
    f"""WITH {_TR}, en AS (SELECT key FROM tr WHERE lang = 'en'), l AS (SELECT lang, count(*) AS keys, count(*) FILTER (WHERE key NOT IN (SELECT key FROM en)) AS extra FROM tr GROUP BY 1)
SELECT lang, keys, extra, (SELECT count(*) FROM en) - (keys - extra) AS missing FROM l""",
)
