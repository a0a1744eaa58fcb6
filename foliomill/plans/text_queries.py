"""Registered queries over text layers, model input, plans and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..constants import NO_TEXT, glyphs
from ..functions.scale import fresh_shared_path, spread_small_input
from ..operators import raster, scoring, textlayer
from ..sources.files import page_write, read_strips
from ..streaming import jobs_stream, page_stream
from . import page_plan
from .fixtures import LUMA_SQL, SHAPES, byte_sql, checksum_sql, page_strips, px_sql, rgb_sql, table, unrgb_sql
from .table_queries import REPORT_SQL, event_rows

QUERIES: dict = {}
SQL: dict = {}


def _add(name, build, sql=None):
    QUERIES[name] = build
    if sql is not None:
        SQL[name] = sql


# --- components, glyphs, lines ---------------------------------------------

_add(
    "ink_components",
    lambda spark, sf: textlayer.ink_components(page_strips(spark, sf, "Gray8")),
    px_sql("Gray8").replace("WITH raw", "WITH RECURSIVE raw") + """,
b AS (SELECT page_id, width, height, y, x, v < 128 AS ink, coalesce(lag(v < 128) OVER (PARTITION BY page_id, y ORDER BY x), false) AS before FROM px),
s AS (SELECT *, sum(CASE WHEN ink AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY y, x) AS run FROM b),
runs AS (SELECT page_id, width, height, run, y, min(x) AS x0, max(x) + 1 AS x1 FROM s WHERE ink GROUP BY ALL),
touch AS (SELECT a.page_id, a.run AS p, c.run AS q FROM runs a JOIN runs c ON c.page_id = a.page_id AND c.y = a.y + 1 AND c.x0 < a.x1 AND a.x0 < c.x1),
edges AS (SELECT page_id, p, q FROM touch UNION ALL SELECT page_id, q, p FROM touch),
cc(page_id, run, label) USING KEY (page_id, run) AS (
  SELECT page_id, run, run AS label FROM runs
  UNION
  SELECT r.page_id, r.run, min(cc.label) AS label FROM cc JOIN edges e ON e.page_id = cc.page_id AND e.p = cc.run
    JOIN recurring.cc r ON r.page_id = e.page_id AND r.run = e.q WHERE cc.label < r.label GROUP BY r.page_id, r.run),
box AS (SELECT r.page_id, label, width, height, min(x0) AS x0, min(y) AS y0, max(x1) AS x1, max(y) + 1 AS y1 FROM runs r JOIN cc USING (page_id, run) GROUP BY ALL)
SELECT page_id, x0, y0, x1, y1 FROM box WHERE y1 - y0 BETWEEN 3 AND greatest(height // 2, 3) AND x1 - x0 BETWEEN 1 AND greatest(width * 2 // 5, 1)""",
)
_add(
    "ink_runs",
    lambda spark, sf: textlayer.ink_runs(page_strips(spark, sf, "Gray8"))
    .groupBy("page_id")
    .agg(F.count(F.lit(1)).alias("runs"), F.sum(F.col("x1") - F.col("x0")).alias("ink"), F.sum(F.col("x0") * F.col("y")).cast("bigint").alias("sum_xy")),
    px_sql("Gray8") + """,
b AS (SELECT page_id, y, x, v < 128 AS ink, lag(v < 128) OVER (PARTITION BY page_id, y ORDER BY x) AS before FROM px)
SELECT page_id, count(*) FILTER (WHERE ink AND NOT coalesce(before, false)) AS runs, count(*) FILTER (WHERE ink) AS ink,
  CAST(sum(x * y) FILTER (WHERE ink AND NOT coalesce(before, false)) AS BIGINT) AS sum_xy FROM b GROUP BY page_id HAVING count(*) FILTER (WHERE ink) > 0""",
)

# A grid of glyph-sized boxes over every gray page, slightly out of line.
_GRID = {
    "x0": "CAST(k % 9 * 7 + k % 2 AS INT)",
    "y0": "CAST(k div 9 * 8 + (k * 5 + page_id) % 4 AS INT)",
    "x1": "CAST(k % 9 * 7 + k % 2 + 3 + (page_id + k) % 4 AS INT)",
    "y1": "CAST(least(k div 9 * 8 + (k * 5 + page_id) % 4 + 5 + (page_id * 3 + k) % 5, height) AS INT)",
}


def page_boxes(strips):
    pages = strips.where("y = 0").select("page_id", "height")
    grid = pages.selectExpr("page_id", "height", "explode(sequence(0, (height div 8 + 1) * 9 - 1)) AS k")
    return grid.selectExpr("page_id", *[f"{v} AS {n}" for n, v in _GRID.items()]).where("y0 + 3 <= y1")


_BOXES = """
pg AS (SELECT DISTINCT page_id, height FROM px),
bx AS (SELECT page_id, {} FROM pg, range((height // 8 + 1) * 9) t(k)),
boxes AS (SELECT * FROM bx WHERE y0 + 3 <= y1)""".format(", ".join(f"{v.replace(' div ', ' // ')} AS {n}" for n, v in _GRID.items()))
_TEMPLATES = "tpl AS (SELECT * FROM (VALUES {}) t(n, ch, cells))".format(
    ", ".join("({}, '{}', '{}')".format(n, ch.replace("'", "''"), cells) for n, (ch, cells) in enumerate(glyphs()))
)
_GLYPHS = _TEMPLATES + """,
cellpx AS (SELECT b.*, dy, dx, v < 128 AS ink FROM boxes b, range(12) r(dy), range(8) c(dx) JOIN px ON px.page_id = b.page_id AND px.y = b.y0 + dy AND px.x = b.x0 + dx
  WHERE dy < y1 - y0 AND dx < x1 - x0),
cell AS (SELECT page_id, x0, y0, x1, y1, z * 5 + a AS i, count(*) AS area, count(*) FILTER (WHERE ink) AS n FROM cellpx, range(7) zz(z), range(5) aa(a)
  WHERE dy >= z * (y1 - y0) // 7 AND dy < greatest((z + 1) * (y1 - y0) // 7, z * (y1 - y0) // 7 + 1)
    AND dx >= a * (x1 - x0) // 5 AND dx < greatest((a + 1) * (x1 - x0) // 5, a * (x1 - x0) // 5 + 1) GROUP BY ALL),
seen AS (SELECT page_id, x0, y0, x1, y1, string_agg(CASE WHEN 2 * n > area THEN '#' ELSE ' ' END, '' ORDER BY i) AS cells FROM cell GROUP BY ALL),
scored AS (SELECT page_id, x0, y0, x1, y1, ch, n, 35 - hamming(seen.cells, tpl.cells) AS same FROM seen, tpl),
best AS (SELECT page_id, x0, y0, x1, y1, ch, same, same / 35.0::DOUBLE AS score FROM scored QUALIFY row_number() OVER (PARTITION BY page_id, x0, y0, x1, y1 ORDER BY same DESC, n DESC) = 1)"""


def _glyphs(spark, sf):
    strips = page_strips(spark, sf, "Gray8")
    return textlayer.glyph_match(strips, page_boxes(strips))


_add(
    "glyph_match",
    lambda spark, sf: _glyphs(spark, sf).drop("same").withColumn("score", F.round("score", 6)),
    px_sql("Gray8") + "," + _BOXES + "," + _GLYPHS + "\nSELECT page_id, x0, y0, x1, y1, ch, round(score, 6) AS score FROM best",
)
_LINES = """
ob AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY y0, x0, y1, x1) AS k FROM boxes),
fold AS (
  SELECT page_id, k, x0, y0, x1, y1, y0 AS top, y1 AS bottom, 0 AS line FROM ob WHERE k = 1
  UNION ALL
  SELECT b.page_id, b.k, b.x0, b.y0, b.x1, b.y1,
    CASE WHEN (b.y0 + b.y1) // 2 >= top AND (b.y0 + b.y1) // 2 < bottom THEN least(top, b.y0) ELSE b.y0 END,
    CASE WHEN (b.y0 + b.y1) // 2 >= top AND (b.y0 + b.y1) // 2 < bottom THEN greatest(bottom, b.y1) ELSE b.y1 END,
    CASE WHEN (b.y0 + b.y1) // 2 >= top AND (b.y0 + b.y1) // 2 < bottom THEN line ELSE line + 1 END
  FROM fold f JOIN ob b ON b.page_id = f.page_id AND b.k = f.k + 1)"""
_add(
    "reading_lines",
    lambda spark, sf: textlayer.reading_lines(page_boxes(page_strips(spark, sf, "Gray8"))),
    px_sql("Gray8").replace("WITH raw", "WITH RECURSIVE raw") + "," + _BOXES + "," + _LINES + "\nSELECT page_id, x0, y0, x1, y1, CAST(line AS INT) AS line FROM fold",
)


def _recognize(spark, sf):
    """Glyphs in reading order to page text, for every page."""
    strips = page_strips(spark, sf, "Gray8")
    found = textlayer.glyph_match(strips, page_boxes(strips))
    texts = textlayer.line_text(textlayer.reading_lines(found))
    done = textlayer.recognized_pages(strips.where("y = 0"), texts)
    return done.select("page_id", "text", F.round("confidence", 9).alias("confidence"))


_PAGE_TEXT = """
lt AS (SELECT page_id, line, string_agg(CASE WHEN greatest(x0 - px1, 0) * 2 > px1 - px0 THEN ' ' ELSE '' END || ch, '' ORDER BY rn) AS body, sum(same) AS s, count(*) AS n
  FROM (SELECT *, lag(x1) OVER w AS px1, lag(x0) OVER w AS px0, row_number() OVER w AS rn FROM gl WINDOW w AS (PARTITION BY page_id, line ORDER BY x0, y0, y1, x1)) GROUP BY 1, 2),
pt AS (SELECT page_id, string_agg(body, chr(10) ORDER BY line) AS text, CAST(sum(s) AS DOUBLE) / (sum(n) * CELLS) AS confidence, CAST(sum(n) AS BIGINT) AS glyphs FROM lt GROUP BY 1)"""
_add(
    "page_text",
    _recognize,
    px_sql("Gray8").replace("WITH raw", "WITH RECURSIVE raw") + "," + _BOXES + "," + _GLYPHS + "," + _LINES
    + ",\ngl AS (SELECT fold.*, best.ch, best.same FROM fold JOIN best USING (page_id, x0, y0, x1, y1))," + _PAGE_TEXT.replace("CELLS", "35")
    + f"\nSELECT pg.page_id, coalesce(text, '{NO_TEXT}') AS text, round(coalesce(confidence, 0), 9) AS confidence FROM pg LEFT JOIN pt USING (page_id)",
)
# Words as glyph rows: eight to a line, gaps from word lengths.
_WORD = {
    "line": "CAST(k div 8 AS INT)",
    "x0": "CAST(k % 8 * 40 + n * 3 % 17 AS INT)",
    "x1": "CAST(k % 8 * 40 + n * 3 % 17 + 20 + n % 15 AS INT)",
    "y0": "CAST(k div 8 * 20 AS INT)",
    "y1": "CAST(k div 8 * 20 + 9 AS INT)",
    "ch": "substr(word, 1, 1)",
    "same": "CAST(n % 11 AS INT)",
}


def _words(spark, sf):
    docs = spread_small_input(table(spark, sf, "documents").select("doc_id", "text"))
    return docs.selectExpr("doc_id AS page_id", "posexplode(filter(split(text, '[ \\n]+'), w -> w <> '')) AS (k, word)").withColumn(
        "n", F.length("word")
    )


_WORDS = """wd AS (SELECT page_id, CAST(k AS INT) AS k, word, length(word) AS n FROM (SELECT page_id, unnest(ws) AS word, unnest(range(len(ws))) AS k
  FROM (SELECT doc_id AS page_id, list_filter(regexp_split_to_array(text, '[ \\n]+'), lambda w: w <> '') AS ws FROM documents)))"""
_add(
    "line_text",
    lambda spark, sf: textlayer.line_text(_words(spark, sf).selectExpr("page_id", *[f"{v} AS {c}" for c, v in _WORD.items()]), cells=10).select(
        "page_id", "text", F.round("confidence", 9).alias("confidence"), "glyphs"
    ),
    f"""WITH {_WORDS}, gl AS (SELECT page_id, {", ".join(f"{v.replace(' div ', ' // ')} AS {c}" for c, v in _WORD.items())} FROM wd),{_PAGE_TEXT.replace("CELLS", "10")}
SELECT page_id, text, round(confidence, 9) AS confidence, glyphs FROM pt""",
)

# --- OCR tables ------------------------------------------------------------

_OCR = {
    "level": "CASE WHEN k % 7 = 6 THEN 4 ELSE 5 END",
    "conf": "CAST(k % 103 - 2 AS DOUBLE)",
    "text": "CASE WHEN k % 13 = 5 THEN ' ' ELSE word END",
}
_add(
    "ocr_confidence",
    lambda spark, sf: textlayer.ocr_confidence(
        _words(spark, sf).selectExpr("page_id", *[f"{v} AS {c}" for c, v in _OCR.items()]),
        table(spark, sf, "documents").selectExpr("doc_id AS page_id"),
    ).withColumn("confidence", F.round("confidence", 9)),
    f"""WITH {_WORDS}, o AS (SELECT page_id, {", ".join(f"{v} AS {c}" for c, v in _OCR.items())} FROM wd),
m AS (SELECT page_id, avg(conf) AS mean, count(*) AS words FROM o WHERE level = 5 AND conf >= 0 AND trim(text) <> '' GROUP BY 1)
SELECT doc_id AS page_id, round(least(coalesce(mean / 100.0::DOUBLE, 0.0), 1.0), 9) AS confidence, coalesce(words, 0) AS words FROM documents LEFT JOIN m ON m.page_id = doc_id""",
)
_TSV_LINE = "concat_ws('\\t', l_linenumber % 3 + 3, 1, 1, 1, 1, l_partkey, 0, 0, 9, 9, CASE WHEN l_partkey % 9 = 0 THEN 'n/a' ELSE CAST(l_partkey % 120 - 10 AS STRING) END, CASE WHEN l_suppkey % 5 = 0 THEN ' ' ELSE 'w' END)"


def _tsv(spark, sf):
    """TSV text per supplier batch, then its words."""
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS page_id", f"{_TSV_LINE} AS line")
    text = lines.groupBy("page_id").agg(F.concat_ws("\n", F.lit("header"), F.sort_array(F.collect_list("line"))).alias("tsv"))
    return textlayer.ocr_confidence(textlayer.ocr_words(text), text).withColumn("confidence", F.round("confidence", 9))


_add(
    "ocr_words",
    _tsv,
    """WITH o AS (SELECT l_orderkey AS page_id, l_linenumber % 3 + 3 AS level, CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_partkey % 120 - 10 AS DOUBLE) END AS conf, l_suppkey % 5 <> 0 AS seen FROM lineitem),
m AS (SELECT page_id, avg(conf) AS mean, count(*) AS words FROM o WHERE level = 5 AND conf >= 0 AND seen GROUP BY 1)
SELECT page_id, round(least(coalesce(mean / 100.0::DOUBLE, 0.0), 1.0), 9) AS confidence, coalesce(words, 0) AS words FROM (SELECT DISTINCT page_id FROM o) LEFT JOIN m USING (page_id)""",
)
_RAW = "CASE doc_id % 4 WHEN 0 THEN concat('  ', text, chr(10)) WHEN 1 THEN concat(' ', chr(9), chr(10)) ELSE text END"
_add(
    "ocr_text_normalize",
    lambda spark, sf: table(spark, sf, "documents")
    .selectExpr("doc_id", f"{_RAW} AS raw")
    .select("doc_id", textlayer.direct_text(F.col("raw")).alias("direct"))
    .select("doc_id", F.md5("direct").alias("direct_md5"), F.octet_length(textlayer.layer_text(F.col("direct"))).alias("layer_bytes")),
    f"""WITH r AS (SELECT doc_id, trim({_RAW}, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))) AS t FROM documents)
SELECT doc_id, md5(CASE WHEN t = '' THEN '{NO_TEXT}' ELSE t END) AS direct_md5, CAST(strlen(t) AS INT) AS layer_bytes FROM r""",
)


def ocr_pages(spark, sf):
    return spread_small_input(table(spark, sf, "documents").select("doc_id", "text")).selectExpr(
        "doc_id div 8 AS job_id", "doc_id % 8 + 1 AS page_no", "text"
    )


_OP = "op AS (SELECT doc_id // 8 AS job_id, doc_id % 8 + 1 AS page_no, text FROM documents)"
_BUDGET = f"""WITH {_OP}, r AS (SELECT job_id, page_no, CAST(strlen(text) AS BIGINT) AS bytes, CAST(sum(strlen(text)) OVER (PARTITION BY job_id ORDER BY page_no) AS BIGINT) AS total FROM op),
b AS (SELECT *, CASE WHEN bytes > 20000 THEN 'page text exceeds the limit' WHEN total > 40000 THEN 'document text exceeds the limit' END AS reason FROM r)"""
_add("text_budget", lambda spark, sf: textlayer.text_budget(ocr_pages(spark, sf), 20_000, 40_000), _BUDGET + " SELECT * FROM b")
_add(
    "text_budget_rejections",
    lambda spark, sf: textlayer.budget_rejections(ocr_pages(spark, sf), 20_000, 40_000),
    _BUDGET + " SELECT job_id, min(page_no) AS page_no, arg_min(reason, page_no) AS reason FROM b WHERE reason IS NOT NULL GROUP BY 1",
)
_CODES = f"""WITH {_OP}, ch AS (SELECT DISTINCT job_id, unnest(string_split(text, '')) AS ch FROM op),
codes AS (SELECT job_id, ch, CAST(row_number() OVER (PARTITION BY job_id ORDER BY unicode(ch)) AS INT) AS code FROM ch)"""
_add("char_codes", lambda spark, sf: textlayer.char_codes(ocr_pages(spark, sf)), _CODES + " SELECT job_id, ch, code FROM codes")


def _encoded(spark, sf):
    pages = ocr_pages(spark, sf)
    done = textlayer.encode_text(pages, textlayer.char_codes(pages))
    return done.select("job_id", "page_no", F.octet_length("encoded").alias("bytes"), F.md5("encoded").alias("encoded_md5"))


_add(
    "encode_text",
    _encoded,
    _CODES + """, pos AS (SELECT job_id, page_no, unnest(string_split(text, '')) AS ch, generate_subscripts(string_split(text, ''), 1) AS nth FROM op)
SELECT job_id, page_no, CAST(2 * count(*) AS INT) AS bytes, md5(unhex(string_agg(printf('%04X', code), '' ORDER BY nth))) AS encoded_md5 FROM pos JOIN codes USING (job_id, ch) GROUP BY 1, 2""",
)



def _wide_codes(spark, sf):
    """Codes of every third job moved up, so that some do not fit two bytes."""
    codes = textlayer.char_codes(ocr_pages(spark, sf))
    return codes.withColumn("code", F.when(F.col("job_id") % 3 == 0, F.col("code") + 65_500).otherwise(F.col("code")))


_add(
    "encode_text_rejects",
    lambda spark, sf: textlayer.encode_text_rejects(_wide_codes(spark, sf)),
    _CODES + """ SELECT job_id, CAST(max(code) + 65500 AS BIGINT) AS codes, 'codes beyond two bytes' AS reason FROM codes WHERE job_id % 3 = 0 GROUP BY 1 HAVING max(code) > 35""",
)
_add(
    "encode_text_kept",
    lambda spark, sf: textlayer.encode_text(ocr_pages(spark, sf), _wide_codes(spark, sf)).groupBy("job_id").agg(F.count("*").alias("pages")),
    _CODES + """ SELECT job_id, count(*) AS pages FROM op WHERE job_id NOT IN (SELECT job_id FROM codes WHERE job_id % 3 = 0 GROUP BY 1 HAVING max(code) > 35) GROUP BY 1""",
)

# --- model input -----------------------------------------------------------


def _tensor(spark, sf):
    made = scoring.tensor_prepare(page_strips(spark, sf), 6, 8, channels=3, layout="nhwc", scale=False)
    weighted = F.aggregate(
        F.transform("tensor", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda acc, v: acc + v
    )
    return made.select("page_id", F.array_join(F.transform("shape", lambda n: n.cast("string")), ",").alias("shape"), F.size("tensor").alias("size"), weighted.alias("weighted"))


_RESAMPLE = """
dims AS (SELECT DISTINCT page_id, width AS w, height AS h FROM px),
rs AS (SELECT p.page_id, ty, tx, p.c, p.v FROM dims d, range({h}) a(ty), range({w}) b(tx) JOIN px p ON p.page_id = d.page_id AND p.y = ty * d.h // {h} AND p.x = tx * d.w // {w})"""
_add(
    "tensor_prepare",
    _tensor,
    px_sql() + "," + _RESAMPLE.format(h=6, w=8) + """
SELECT page_id, '1,6,8,3' AS shape, CAST(count(*) AS INT) AS size, CAST(sum(v * ((ty * 8 + tx) * 3 + c + 1)) AS DOUBLE) AS weighted FROM rs GROUP BY 1""",
)


def _tensor_gray(spark, sf):
    made = scoring.tensor_prepare(page_strips(spark, sf), 5, 7, channels=1, layout="nchw", scale=True, batch=2)
    weighted = F.aggregate(F.transform("tensor", lambda v, i: v.cast("double") * (i + 1)), F.lit(0.0), lambda acc, v: acc + v)
    return made.select("page_id", F.size("tensor").alias("size"), F.round(weighted, 3).alias("weighted"))


_add(
    "tensor_prepare_gray",
    _tensor_gray,
    px_sql() + "," + _RESAMPLE.format(h=5, w=7) + """,
gray AS (SELECT page_id, ty, tx, CAST(0.299 AS FLOAT) * (CAST(max(v) FILTER (WHERE c = 0) AS FLOAT) / CAST(255 AS FLOAT)) + CAST(0.587 AS FLOAT) * (CAST(max(v) FILTER (WHERE c = 1) AS FLOAT) / CAST(255 AS FLOAT))
  + CAST(0.114 AS FLOAT) * (CAST(max(v) FILTER (WHERE c = 2) AS FLOAT) / CAST(255 AS FLOAT)) AS g FROM rs GROUP BY 1, 2, 3)
SELECT page_id, CAST(2 * count(*) AS INT) AS size, round(sum(CAST(g AS DOUBLE) * (ty * 7 + tx + 1)) + sum(CAST(g AS DOUBLE) * (35 + ty * 7 + tx + 1)), 3) AS weighted FROM gray GROUP BY 1""",
)
_SIDES = "CAST(l_partkey * 37 % 9000 AS INT) AS height, CAST(l_suppkey * 173 % 8000 AS INT) AS width"
_add(
    "tensor_size",
    lambda spark, sf: table(spark, sf, "lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *_SIDES.split(", "))
    .withColumn("_t", scoring.tensor_size(F.col("height"), F.col("width")))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("_t.h").alias("h"), F.col("_t.w").alias("w")),
    f"""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, greatest(CAST(l_partkey * 37 % 9000 AS BIGINT), 1) AS h, greatest(CAST(l_suppkey * 173 % 8000 AS BIGINT), 1) AS w FROM lineitem),
k AS (SELECT *, 3 * h * w > 16777216 AS big, sqrt(CAST(16777216 AS DOUBLE) / CAST(3 * h * w AS DOUBLE)) AS f FROM s)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN big THEN greatest(CAST(floor(h * f) AS BIGINT), 1) ELSE h END AS h, CASE WHEN big THEN greatest(CAST(floor(w * f) AS BIGINT), 1) ELSE w END AS w FROM k""",
)
_add(
    "tensor_limits",
    lambda spark, sf: table(spark, sf, "lineitem")
    .selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "CAST(l_quantity AS INT) AS batch", "l_linenumber AS channels", *_SIDES.split(", "))
    .withColumn("error", scoring.tensor_limits(F.col("batch"), F.col("channels"), F.col("height"), F.col("width")))
    .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "error"),
    f"""WITH s AS (SELECT *, CAST(l_quantity AS INT) AS batch, {_SIDES} FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber NOT IN (1, 3) THEN 'channels not 1 or 3: ' || l_linenumber
  WHEN batch > 16 THEN 'batch over 16: ' || batch
  WHEN CAST(height AS BIGINT) * width * batch * l_linenumber > 16777216 OR CAST(height AS BIGINT) * width * 3 > 16777216 THEN 'too many elements' END AS error FROM s""",
)
_add(
    "tensor_summary",
    lambda spark, sf: scoring.tensor_summary(table(spark, sf, "embeddings"), "embedding").select(
        "vec_id", "size", "min", "max", F.round("mean", 9).alias("mean"), F.size("sample").alias("sampled"), F.element_at("sample", -1).alias("last_sample")
    ),
    """SELECT vec_id, CAST(len(embedding) AS INT) AS size, CAST(list_min(embedding) AS DOUBLE) AS min, CAST(list_max(embedding) AS DOUBLE) AS max,
  round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) / len(embedding), 9) AS mean, CAST(least(len(embedding), 64) AS INT) AS sampled,
  CAST(embedding[least(len(embedding), 64)] AS DOUBLE) AS last_sample FROM embeddings""",
)


def mean_model():
    """A user model for the check: mean of each page tensor."""
    import numpy as np

    def predict(batch):
        flat = batch.reshape(len(batch), -1).astype("float64")
        return np.stack([flat.mean(axis=1), flat.max(axis=1)], axis=1).astype("float32")

    return predict


def _scored(spark, sf):
    tensors = scoring.tensor_prepare(page_strips(spark, sf), 8, 8, scale=False)
    done = scoring.score_pages(tensors, mean_model, shape=[1, 3, 8, 8])
    return done.select("page_id", F.round(F.col("output")[0].cast("double"), 2).alias("mean"), F.col("output")[1].cast("double").alias("top"))


_add(
    "score_pages",
    _scored,
    px_sql() + "," + _RESAMPLE.format(h=8, w=8) + "\nSELECT page_id, round(CAST(CAST(avg(v) AS FLOAT) AS DOUBLE), 2) AS mean, CAST(max(v) AS DOUBLE) AS top FROM rs GROUP BY 1",
)



def _scored_batch(spark, sf):
    """The same page twice in a batch axis: the model sees both copies."""
    tensors = scoring.tensor_prepare(page_strips(spark, sf), 8, 8, scale=False, batch=2)
    done = scoring.score_pages(tensors, mean_model, shape=[2, 3, 8, 8])
    return done.select("page_id", F.size("tensor").alias("size"), F.col("output")[1].cast("double").alias("top"))


_add(
    "score_pages_batch",
    _scored_batch,
    px_sql() + "," + _RESAMPLE.format(h=8, w=8) + "\nSELECT page_id, CAST(2 * count(*) AS INT) AS size, CAST(max(v) AS DOUBLE) AS top FROM rs GROUP BY 1",
)

# --- plans and sinks -------------------------------------------------------

_add(
    "page_plan_rejects",
    lambda spark, sf: page_plan.plan_rejects(page_strips(spark, sf), dict(crop=(3, 2, 20, 40), invert=True)),
    px_sql() + "\nSELECT DISTINCT page_id, 'crop region out of bounds' AS reason FROM px WHERE height < 42",
)
_add(
    "page_plan_cropped",
    lambda spark, sf: page_plan.process_pages(page_strips(spark, sf), dict(crop=(3, 2, 20, 40), invert=True))
    .groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.aggregate("row", F.lit(0).cast("bigint"), lambda a, v: a + v)).alias("total")),
    px_sql() + "\nSELECT page_id, CAST(40 AS BIGINT) AS lines, CAST(sum(255 - v) AS BIGINT) AS total FROM px WHERE height >= 42 AND x >= 3 AND x < 23 AND y >= 2 AND y < 42 GROUP BY 1",
)
PLAN = dict(
    rotate=90, flip_h=True, brightness=10, contrast=15, levels_black=12, levels_white=240, levels_gamma=1.2, white_balance=True,
    saturation=-30.0, auto_levels=True, invert=True, sharpen_amount=0.8, flatten=True,
)


def _plan_steps() -> str:
    """The same plan as chained SQL relations p0..p9."""
    keep = "page_id, width, height, y, x, c"
    steps = [
        "p1 AS (SELECT page_id, height AS width, width AS height, x AS y, y AS x, c, v FROM px)",  # 90 degrees, then mirrored
        f"p2 AS (SELECT {keep}, CAST(least(greatest(round((v - 128.0::DOUBLE) * 1.15::DOUBLE + 128.0::DOUBLE) + 26, 0), 255) AS INT) AS v FROM p1)",
        f"p3 AS (SELECT {keep}, {byte_sql('pow(least(greatest((v - 12) / 228.0::DOUBLE, 0.0::DOUBLE), 1.0::DOUBLE), 1.0::DOUBLE / 1.2::DOUBLE) * 255.0::DOUBLE')} AS v FROM p2)",
        "ms AS (SELECT page_id, " + ", ".join(f"CAST(sum(v) FILTER (WHERE c = {c}) AS DOUBLE) / (width * height) AS m{c}" for c in range(3)) + " FROM p3 GROUP BY page_id, width, height)",
        "gn AS (SELECT page_id, [m0, m1, m2] AS ms, (m0 + m1 + m2) / 3.0::DOUBLE AS m FROM ms)",
        f"p4 AS (SELECT {', '.join('p3.' + k for k in keep.split(', '))}, CASE WHEN list_min(ms) < 1e-6 THEN v ELSE {byte_sql('v * (m / ms[c + 1])')} END AS v FROM p3 JOIN gn USING (page_id))",
        rgb_sql("p4", "q4").strip(),
        unrgb_sql("q4", *[byte_sql(f"{LUMA_SQL} + ({n} - {LUMA_SQL}) * 0.7::DOUBLE") for n in "rgb"], name="p5").strip(),
        "h5 AS (SELECT page_id, v, count(*) AS n FROM p5 GROUP BY 1, 2)",
        "c5 AS (SELECT page_id, v, sum(n) OVER (PARTITION BY page_id ORDER BY v) AS up, sum(n) OVER (PARTITION BY page_id ORDER BY v DESC) AS dn, sum(n) OVER (PARTITION BY page_id) * 0.005::DOUBLE AS clip FROM h5)",
        "e5 AS (SELECT page_id, min(v) FILTER (WHERE up > clip) AS bk, max(v) FILTER (WHERE dn > clip) AS wh FROM c5 GROUP BY 1)",
        f"p6 AS (SELECT {', '.join('p5.' + k for k in keep.split(', '))}, 255 - CASE WHEN wh <= bk THEN v ELSE {byte_sql('least(greatest((v - bk) / CAST(wh - bk AS DOUBLE), 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE')} END AS v FROM p5 JOIN e5 USING (page_id))",
        """n6 AS (SELECT *, coalesce(lag(v) OVER h, v) AS l, coalesce(lead(v) OVER h, v) AS r, coalesce(lag(v) OVER d, v) AS u, coalesce(lead(v) OVER d, v) AS dn FROM p6
  WINDOW h AS (PARTITION BY page_id, y, c ORDER BY x), d AS (PARTITION BY page_id, x, c ORDER BY y))""",
        f"p7 AS (SELECT {keep}, CASE WHEN width < 3 OR height < 3 THEN v ELSE {byte_sql('v * 1.8::DOUBLE - 0.2::DOUBLE * (l + r + u + dn)')} END AS v FROM n6)",
        f"out AS (SELECT {keep}, {byte_sql('(v / 255.0::DOUBLE + (1.0::DOUBLE - v / 255.0::DOUBLE) * 0.12::DOUBLE * (v / 255.0::DOUBLE)) * 255.0::DOUBLE')} AS v FROM p7)",
    ]
    return ",\n".join(steps)


_add(
    "page_plan",
    lambda spark, sf: raster.page_checksum(page_plan.process_pages(page_strips(spark, sf), PLAN)),
    px_sql() + ",\n" + _plan_steps() + checksum_sql(3),
)


def _by_plan(spark, sf):
    strips = page_strips(spark, sf)
    plans = strips.where("y = 0").selectExpr(
        "page_id",
        """CASE page_id % 3 WHEN 0 THEN '{"invert": true}' WHEN 1 THEN '{"flip_v": true, "desaturate": true}' END AS prefs""",
    )
    pages, _ = page_plan.process_by_plan(strips, plans)
    return raster.page_checksum(pages)


_add(
    "page_plan_per_page",
    _by_plan,
    px_sql() + "," + rgb_sql() + f""",
lum AS (SELECT page_id, y, x, {LUMA_SQL} AS l FROM rgb),
out AS (SELECT px.page_id, width, height, CASE WHEN px.page_id % 3 = 1 THEN height - 1 - px.y ELSE px.y END AS y, px.x, c,
  CASE px.page_id % 3 WHEN 0 THEN 255 - v WHEN 1 THEN l ELSE v END AS v FROM px JOIN lum ON lum.page_id = px.page_id AND lum.y = px.y AND lum.x = px.x)"""
    + checksum_sql(3),
)


def _by_crop(spark, sf):
    """Every page of the input with how it left: processed (its size) or rejected (why)."""
    strips = page_strips(spark, sf)
    plans = strips.where("y = 0").selectExpr(
        "page_id",
        """CASE page_id % 4 WHEN 0 THEN '{"crop": [3, 2, 20, 40]}' WHEN 1 THEN '{"crop": [0, 0, 9, 9], "invert": true}' WHEN 2 THEN '{"crop": [-1, 0, 4, 4]}' END AS prefs""",
    )
    pages, rejects = page_plan.process_by_plan(strips, plans)
    done = pages.groupBy("page_id").agg(F.first("width").alias("width"), F.count("*").alias("lines"), F.lit(None).cast("string").alias("reason"))
    return done.unionByName(rejects.select("page_id", F.lit(None).cast("int").alias("width"), F.lit(None).cast("bigint").alias("lines"), "reason"))


_add(
    "page_plan_by_crop",
    _by_crop,
    px_sql() + """,
sz AS (SELECT page_id, any_value(width) AS w, any_value(height) AS h FROM px GROUP BY 1),
rs AS (SELECT *, CASE WHEN page_id % 4 = 2 THEN 'invalid crop region' WHEN page_id % 4 = 0 AND (w < 23 OR h < 42) OR page_id % 4 = 1 AND (w < 9 OR h < 9) THEN 'crop region out of bounds' END AS reason FROM sz)
SELECT page_id, CAST(CASE WHEN reason IS NULL THEN CASE page_id % 4 WHEN 0 THEN 20 WHEN 1 THEN 9 ELSE w END END AS INT) AS width,
  CAST(CASE WHEN reason IS NULL THEN CASE page_id % 4 WHEN 0 THEN 40 WHEN 1 THEN 9 ELSE h END END AS BIGINT) AS lines, reason FROM rs""",
)
_KERNEL_PLAN = dict(invert=True, flip_v=True)
_KERNEL_MATRIX = [[1.0, 0.1, 0.0], [0.0, 0.9, 0.05], [0.02, 0.0, 1.0]]


def _kernel(spark, sf):
    """Plan, profile, published and read back."""
    profiles = spark.createDataFrame([(0, _KERNEL_MATRIX, [1.0, 1.0, 1.0])], "profile_id int, matrix array<array<double>>, gamma array<double>")
    pages, _, _ = page_plan.page_kernel(page_strips(spark, sf), _KERNEL_PLAN, profiles)
    target = fresh_shared_path(spark, "pages")
    page_write(pages, target)
    return raster.page_checksum(read_strips(spark, target))


def _kernel_sample(row: list[float]) -> str:
    mix = " + ".join(f"{m}::DOUBLE * ((255 - {n}) / 255.0::DOUBLE)" for m, n in zip(row, "rgb"))
    return byte_sql(f"least(greatest({mix}, 0.0::DOUBLE), 1.0::DOUBLE) * 255.0::DOUBLE")


_add(
    "page_kernel",
    _kernel,
    px_sql() + "," + rgb_sql("px", "rgb0") + ",\nrgb AS (SELECT page_id, width, height, height - 1 - y AS y, x, r, g, b FROM rgb0),"
    + unrgb_sql("rgb", *[_kernel_sample(row) for row in _KERNEL_MATRIX]) + checksum_sql(3),
)


def _written(spark, sf):
    target = fresh_shared_path(spark, "pages")
    page_write(page_strips(spark, sf, "Rgba8"), target)
    return raster.page_checksum(read_strips(spark, target))


_add("page_write", _written, px_sql("Rgba8") + checksum_sql(4, "px"))

# --- streams ---------------------------------------------------------------


def _stream(spark, sf, name):
    """The files of a table as a stream; a table is one file or a folder of files.

    The path is written as a pattern because a plain one must be a folder.
    """
    return spark.readStream.schema(table(spark, sf, name).schema).parquet(f"{sf}/{name}.parque[t]")


_add(
    "job_report_stream",
    lambda spark, sf: jobs_stream.drain_job_reports(spark, event_rows(_stream(spark, sf, "events"))),
    REPORT_SQL,
)


def _triggers(spark, folder, schema):
    """What all triggers wrote; without rows there was none, so an empty one is added."""
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/trigger=-1")
    return spark.read.schema(schema).parquet(folder).drop("trigger")


def _page_arrivals(spark, sf):
    """Pages taken from the stream in order, each exactly once."""
    root = fresh_shared_path(spark, "page-arrivals")
    pages = _stream(spark, sf, "pages").selectExpr("page_id AS number", "url AS path", "encode(html, 'UTF-8') AS content")

    def keep(batch, batch_id):
        kept = batch.select("number", "path", F.sha2("content", 256).alias("sha256"))
        kept.write.mode("overwrite").parquet(f"{root}/pages/trigger={batch_id}")

    page_stream.run_page_stream(pages, keep, f"{root}/checkpoint").awaitTermination()
    return _triggers(spark, f"{root}/pages", "number bigint, path string, sha256 string")


_add("page_stream", _page_arrivals, "SELECT page_id AS number, url AS path, sha256(html) AS sha256 FROM pages")


def _page_stats(spark, sf):
    width, _ = SHAPES["Gray8"]
    docs = _stream(spark, sf, "documents").select(F.col("doc_id").alias("page_id"), F.encode("text", "UTF-8").alias("_raw"))
    height = F.ceil(F.octet_length("_raw") / F.lit(float(width))).cast("int")
    pages = docs.where(F.octet_length("_raw") > 0).select(
        "page_id", F.lit(width).alias("width"), height.alias("height"), F.lit("Gray8").alias("fmt"),
        F.rpad("_raw", height * width, F.lit(b"\xff")).alias("content"),
    )
    root = fresh_shared_path(spark, "page-stats")
    page_stream.write_page_stats(pages, f"{root}/stats", f"{root}/checkpoint").awaitTermination()
    stats = _triggers(spark, f"{root}/stats", "page_id bigint, mean_0 double, mean_1 double, mean_2 double, levels bigint, samples bigint")
    return stats.select("page_id", F.round("mean_0", 9).alias("mean"), "levels", "samples")


_add(
    "page_stream_stats",
    _page_stats,
    px_sql("Gray8", spread=False) + "\nSELECT page_id, round(CAST(sum(v) AS DOUBLE) / count(*), 9) AS mean, count(DISTINCT v) AS levels, count(*) AS samples FROM px GROUP BY page_id",
)
