"""The registered queries of the document operators, with SQL where SQL can express them."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    association_urls,
    bradley_terry,
    ecoc_langid,
    fm_toxicity,
    hilbert_packing,
    minhash_dedup,
    patience_licenses,
    periodic_runs,
    ppm_scoring,
    strassen_negatives,
    token_index,
    winnowing,
    wu_manber,
)
from .association_urls import ALLOW, BLOCK, Stated
from .common import held_out, table
from .learning import CUT

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op1_ppm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm_scoring.scored(table(spark, sf_dir, "documents"), held_out("doc_id", 7, 2))


def _judged(scores: DataFrame, out: Column) -> DataFrame:
    return scores.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 3, 1)
    model = fm_toxicity.learn(docs, table(spark, sf_dir, "labels"), ~out)
    return _judged(fm_toxicity.scored(docs, model), out)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = bradley_terry.learn(docs, table(spark, sf_dir, "labels"), ~out)
    return _judged(bradley_terry.scored(docs, model), out)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out("doc_id", 4, 2)
    model = ecoc_langid.learn(docs, ~out)
    return ecoc_langid.predicted(docs, model).select("doc_id", out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = patience_licenses.scan(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.array_join(F.array_sort(F.array_distinct(F.col("finds.license"))), ",").alias("licenses"),
        F.size("finds").cast("bigint").alias("n_finds"),
        F.coalesce(F.array_max(F.col("finds.coverage")), F.lit(0.0)).alias("coverage"),
        F.coalesce(F.array_min(F.col("finds.first")), F.lit(-1)).cast("bigint").alias("first_word"),
        F.coalesce(F.array_max(F.col("finds.end")), F.lit(-1)).cast("bigint").alias("end_word"),
        F.coalesce(F.array_min(F.col("finds.density")), F.lit(0.0)).alias("density"),
    )


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_packing.packed(table(spark, sf_dir, "documents"), tokenizer_path(), end=0)


def op8_token_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = token_index.write_shards(table(spark, sf_dir, "documents"), tokenizer_path(), end=2)
    return token_index.read_documents(shards)


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.classes(table(spark, sf_dir, "documents"), shingle=4)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = winnowing.edited_documents(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        winnowing.digest(F.col("kept")).alias("fingerprint"),
        winnowing.digest(F.col("edited_kept")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = wu_manber.occurrences(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("label", F.col("label").cast("bigint"))
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return strassen_negatives.mine(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


def _repeating(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """Where (a) and with which period (p) a tenth of the documents repeat their words."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return None if h % 10 else (a, 1 + (n - a) // (3 + g % 8))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.scan(table(spark, sf_dir, "documents"), _repeating)
    first = F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("shorter"), r["start"].alias("start"), r["period"].alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    found = found.withColumn("longest", first)
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("longest.start").alias("start"),
        (-F.col("longest.shorter")).alias("length"),
        F.col("longest.period").alias("period"),
        F.expr("-1000 * longest.shorter div longest.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )


URL_RULES = [
    Stated(BLOCK, "net", "/"),
    Stated(ALLOW, "example.net", "/en/"),
    Stated(BLOCK, "example.com", "/de/"),
    Stated(ALLOW, "org", "/fr/"),
]


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return association_urls.judged(table(spark, sf_dir, "pages"), URL_RULES)


OP10_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS m FROM b WHERE len(w) > 0)
),
dg AS (
  SELECT doc_id, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: struct_pack(i := i, g := array_to_string(w[i:i + m - 1], ' ')))) AS x
  FROM d, (SELECT DISTINCT m FROM bw) WHERE len(w) >= m
),
hit AS (SELECT doc_id, x.i AS i, bw.m AS m, item_id FROM dg JOIN bw ON dg.m = bw.m AND dg.x.g = bw.g),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hit) GROUP BY doc_id),
listed AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit WHERE item_id IS NOT NULL) GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(c.n, 0) AS n_hit, coalesce(l.n, 0) AS n_items,
       sha256(coalesce(l.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN listed l USING (doc_id)
"""

OP11_SQL = """
WITH u AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM u a, u b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
),
p AS (SELECT anchor_id, other_id AS positive_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) QUALIFY row_number() OVER w <= 5
"""

OP13_SQL = rf"""
WITH r(place, verdict, h, p) AS (VALUES {", ".join(f"({i}, '{x.verdict}', '{x.host}', '{x.path}')" for i, x in enumerate(URL_RULES))}),
a AS (SELECT page_id, row_number() OVER () AS row, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (
  SELECT page_id, row, rest, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^?#]*\?([^#]*)', 1) AS query
  FROM a
),
c AS (SELECT *, string_split(host, '.') AS l, string_split(path, '/') AS g FROM b),
t AS (
  SELECT page_id, row, host, path, list_sort(list_filter([
    CASE WHEN host <> '' THEN 'host=' || host END,
    CASE WHEN len(l) > 1 THEN 'top=' || l[-1] END,
    CASE WHEN len(l) > 2 THEN 'site=' || array_to_string(l[-2:], '.') END,
    CASE WHEN len(l) > 2 THEN 'sub=' || l[1] END,
    CASE WHEN len(g) > 2 THEN 'dir=' || g[2] END,
    CASE WHEN len(g) > 1 THEN 'leaf=' || regexp_replace(g[-1], '[0-9]+', '0', 'g') END,
    CASE WHEN query <> '' THEN 'query=' || array_to_string(list_sort(list_distinct(list_transform(string_split(query, '&'), lambda x: regexp_extract(x, '^[^=]*', 0)))), '&') END,
    CASE WHEN instr(rest, '#') > 0 THEN 'fragment=yes' END], lambda x: x IS NOT NULL)) AS tokens
  FROM c
),
stated AS (
  SELECT row, h || p AS rule, verdict FROM t JOIN r ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY length(h || p) DESC, length(h) DESC, place) = 1
),
e AS (SELECT row, verdict, unnest(tokens) AS x FROM t JOIN stated USING (row)),
sets AS (
  SELECT verdict, [x] AS s FROM e
  UNION ALL SELECT a.verdict, [a.x, b.x] FROM e a JOIN e b ON a.row = b.row AND a.x < b.x
  UNION ALL SELECT a.verdict, [a.x, b.x, c.x] FROM e a JOIN e b ON a.row = b.row AND a.x < b.x JOIN e c ON b.row = c.row AND b.x < c.x
),
f AS (SELECT s, verdict, count(*) AS n, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY s) AS confidence FROM sets GROUP BY s, verdict),
sure AS (
  SELECT * FROM f WHERE n >= ceil(CAST({association_urls.SUPPORT} AS DOUBLE) * (SELECT count(*) FROM stated)) AND confidence >= CAST({association_urls.CONFIDENCE} AS DOUBLE)
),
mined AS (
  SELECT * FROM sure m
  WHERE NOT EXISTS (SELECT 1 FROM sure o WHERE o.verdict = m.verdict AND len(o.s) < len(m.s) AND list_has_all(m.s, o.s) AND o.confidence >= m.confidence)
),
fit AS (
  SELECT row, array_to_string(s, ' ') AS mined, verdict, confidence FROM t JOIN mined ON list_has_all(tokens, s)
  QUALIFY row_number() OVER (PARTITION BY row ORDER BY confidence DESC, n DESC, len(s), s, verdict) = 1
)
SELECT page_id, host, path, rule, coalesce(stated.verdict, fit.verdict, '{ALLOW}') AS verdict, mined, confidence
FROM t LEFT JOIN stated USING (row) LEFT JOIN fit USING (row)
"""

QUERIES = {
    "op3_license_scan": op3_license_scan,
    "op1_ppm_score": op1_ppm_score,
    "op4_packing": op4_packing,
    "op8_token_index": op8_token_index,
    "op2_toxicity": op2_toxicity,
    "op5_quality": op5_quality,
    "op7_language": op7_language,
    "op6_near_duplicates": op6_near_duplicates,
    "op9_fingerprints": op9_fingerprints,
    "op10_decontaminate": op10_decontaminate,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_url_rules": op13_url_rules,
}

SQL = {
    "op11_hard_negatives": OP11_SQL,
    "op13_url_rules": OP13_SQL,
    "op10_decontaminate": OP10_SQL,
}
