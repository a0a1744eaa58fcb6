from __future__ import annotations

import itertools
import random

from check import compare
from pyspark.sql import functions as F

from foliomill.llm import association_urls as urls
from foliomill.llm.association_urls import ALLOW, BLOCK, Mined, Stated
from foliomill.llm.queries import QUERIES, SQL, URL_RULES

SCHEMA = "page_id long, url string, host string, place int, tokens string, label string, verdict string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, "h", 1, "t", "l", "v") for i, u in rows], SCHEMA).repartition(3)


def test_query_matches_sql(spark, con, sf_dir):
    ok, note = compare(spark, con, "op13_url_rules", QUERIES["op13_url_rules"], SQL["op13_url_rules"], sf_dir)
    assert ok, note


ODD = [
    (1, None, "", "", None),
    (2, "", "", "", None),
    (3, "no scheme.net/en/", "", "", None),
    (4, "http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
    (5, "http://example.net/EN/x", "example.net", "/EN/x", "net/"),
    (6, "http://example.net", "example.net", "", None),
    (7, "http://example.net/", "example.net", "/", "net/"),
    (8, "http://notexample.net/en/", "notexample.net", "/en/", "net/"),
    (9, "http://x.org/fr/?a=1&b=2&a=3", "x.org", "/fr/", "org/fr/"),
    (10, "http://org/fr/", "org", "/fr/", "org/fr/"),
    (11, "http://x.example.com/de", "x.example.com", "/de", None),
    (12, "x://://y.net/", ":", "//y.net/", None),
    (13, "http://a.net:80/en/", "a.net:80", "/en/", None),
    (14, "http://#a.net/", "", "", None),
    (15, "http://a.net\n/x", "a.net\n", "/x", None),
    (16, "http://É.net/ñ", "É.net", "/ñ", "net/"),
    (17, "http://x.net?/en/", "x.net", "", None),
    (18, "http://" + "a." * 5000 + "net/" + "b/" * 5000, "a." * 5000 + "net", "/" + "b/" * 5000, "net/"),
    (None, "http://q.net/", "q.net", "/", "net/"),
    (4, "http://A.Example.NET/en/x?y#z", "a.example.net", "/en/x", "example.net/en/"),
]


def test_odd_urls(spark):
    got = urls.judged(pages(spark, [x[:2] for x in ODD]), URL_RULES)
    told = sorted((str(r.page_id), r.host, r.path, str(r.rule)) for r in got.collect())
    assert told == sorted((str(i), h, p, str(rule)) for i, _, h, p, rule in ODD)
    verdict = {x.text: x.verdict for x in URL_RULES}
    assert all(r.verdict == verdict[r.rule] for r in got.collect() if r.rule)
    assert {r.verdict for r in got.collect()} <= {ALLOW, BLOCK}


def test_empty_tables_and_no_rules(spark):
    assert urls.judged(pages(spark, []), URL_RULES).collect() == []
    got = urls.judged(pages(spark, [(1, "http://a.net/"), (2, None)]), []).collect()
    assert [(r.verdict, r.rule, r.mined) for r in got] == [(ALLOW, None, None)] * 2


def plain_rules(examples, support, confidence, most):
    """All rules by counting every combination."""
    found = {}
    for tokens, label in examples:
        for n in range(1, most + 1):
            for part in itertools.combinations(sorted(tokens), n):
                both = found.setdefault(part, {})
                both[label] = both.get(label, 0) + 1
    rules = [
        Mined(part, label, n / sum(both.values()), n)
        for part, both in found.items()
        for label, n in both.items()
        if n >= support * len(examples) and n / sum(both.values()) >= confidence
    ]
    return {
        (x.tokens, x.verdict, x.confidence, x.support)
        for x in rules
        if not any(set(y.tokens) < set(x.tokens) and y.verdict == x.verdict and y.confidence >= x.confidence for y in rules)
    }


def test_mined_rules_match_plain_counting(spark):
    """A pair of tokens that decides only together is found."""
    rng = random.Random(3)
    examples = []
    for _ in range(400):
        tokens = [f"site={rng.randrange(4)}", f"dir={rng.randrange(3)}", f"leaf={rng.randrange(3)}", f"query={rng.randrange(2)}"]
        bad = ("site=1" in tokens and "dir=2" in tokens) or "leaf=0" in tokens and rng.random() < 0.9
        examples.append((tokens, BLOCK if bad else ALLOW))
    df = spark.createDataFrame([*examples, (["site=9"], None)], "tokens array<string>, label string").repartition(4)
    got = urls.learn(df, 0.02, 0.8, 3)
    assert {(x.tokens, x.verdict, x.confidence, x.support) for x in got} == plain_rules(examples, 0.02, 0.8, 3)
    assert any(set(x.tokens) == {"dir=2", "site=1"} and x.verdict == BLOCK for x in got)
    index = urls.Index(got)
    for tokens, _ in examples[:100]:
        able = [x for x in got if set(x.tokens) <= set(tokens)]
        assert index.match(frozenset(tokens)) == min(able, key=lambda x: x.order, default=None)


def test_mined_verdict_on_held_out_urls(spark):
    """URLs of which no stated rule tells anything follow what their tokens meant elsewhere."""
    stated = [Stated(BLOCK, "bad.net", "/"), Stated(ALLOW, "good.org", "/")]
    rows = [(i, f"http://{'m' if i % 3 else 'www'}.bad.net/casino/{i}.html?ref=x") for i in range(60)]
    rows += [(100 + i, f"http://www.good.org/news/{i}.html") for i in range(60)]
    rows += [(1000, "http://other.example.com/casino/5.html?ref=y"), (1001, "https://fresh.example.com/news/7.html"), (1002, "ftp://nothing.known")]
    got = {r.page_id: r for r in urls.judged(pages(spark, rows), stated).collect()}
    assert (got[1000].verdict, got[1001].verdict, got[1002].verdict) == (BLOCK, ALLOW, ALLOW)
    assert "dir=casino" in got[1000].mined and got[1002].mined is None
    assert got[0].rule == "bad.net/" and got[100].rule == "good.org/"


def test_held_out_examples(spark, sf_dir):
    """Rules mined from four fifths of the decided URLs foretell the others."""
    parts = spark.read.parquet(f"{sf_dir.replace('0.001', '0.01')}/pages.parquet").select(
        "page_id", urls.host("url").alias("host"), urls.path("url").alias("path"), urls.tokens("url").alias("tokens")
    )
    verdicts = F.array(*(F.lit(x.verdict) for x in URL_RULES))
    told = parts.withColumn("label", F.get(verdicts, urls.stated(URL_RULES))).where("label is not null")
    out = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 2
    index = urls.Index(urls.learn(told.where(~out)))
    rest = told.where(out).collect()
    hit = [x and x.verdict for x in (index.match(frozenset(r.tokens)) for r in rest)]
    assert sum(a == r.label for a, r in zip(hit, rest)) >= 0.9 * len(rest)
