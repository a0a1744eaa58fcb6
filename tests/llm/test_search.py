from __future__ import annotations

import duckdb
import pytest
from brute import frame, nothing, odd, plain_words
from check import compare, duck

from foliomill.llm import patience_licenses as licenses
from foliomill.llm import wu_manber
from foliomill.llm.queries import QUERIES, SQL


def brute_hits(text, items, window):
    w = plain_words(text)
    hit, found = set(), set()
    for item, body in items:
        b = plain_words(body)
        m = min(window, len(b))
        for j in range(len(b) - m + 1 if m else 0):
            for i in range(len(w) - m + 1):
                if w[i : i + m] == b[j : j + m]:
                    hit.update(range(i, i + m))
                    found.add(str(item))
    return len(w), len(hit), sorted(found)


def test_query_matches_sql(spark, con, sf_dir):
    ok, note = compare(spark, con, "op10_decontaminate", QUERIES["op10_decontaminate"], SQL["op10_decontaminate"], sf_dir)
    assert ok, note


ITEMS = [(1, "a b c d e f"), (2, "a b c d e f"), (10, "Two"), (3, None), (4, ""), (5, "b c D-e f g h"), (6, "e\nf g ñ"), (None, "q r s t u"), (7, "a a a a a a a")]


@pytest.mark.parametrize("part_bytes", [1 << 20, 20])
def test_small_windows(spark, part_bytes):
    rows = [(1, "x a b c d e f g h", "en"), (2, "a b c d e", "en"), (3, "A, B; c! D e f two", "en"), (4, "a " * 40, "en"), (5, "e f g Ñ e f g ñ q r s t u", "en"), (6, None, "en"), (7, "", "en")]
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in wu_manber.occurrences(frame(spark, rows), items, 5, part_bytes).collect()}
    for d, text, _ in rows:
        n, hit, found = brute_hits(text, ITEMS, 5)
        assert got[d] == (n, hit, [x for x in found if x != "None"]), d
    kept = {r.doc_id for r in wu_manber.clean_documents(frame(spark, rows), items, 5, part_bytes).collect()}
    assert kept == {d for d, text, _ in rows if not brute_hits(text, ITEMS, 5)[1]}


def test_spans_merge(spark):
    items = spark.createDataFrame([(1, "a b c"), (2, "c d e")], "item_id long, text string")
    got = wu_manber.occurrences(frame(spark, [(1, "z a b c d e z a b c", "en")]), items, 3).first()
    assert [(s.first, s.end) for s in got.spans] == [(1, 6), (7, 10)]


def test_odd_rows_and_empty_tables(spark):
    items = spark.createDataFrame([(1, "one two")], "item_id long, text string")
    got = wu_manber.occurrences(odd(spark), items).collect()
    assert sorted(r.doc_id for r in got if r.n_hit) == [5, 5, 6]
    assert wu_manber.occurrences(nothing(spark), items).collect() == []
    none = items.where("item_id = 9")
    assert all(r.n_hit == 0 and r["items"] == [] for r in wu_manber.occurrences(odd(spark), none).collect())
    assert wu_manber.clean_documents(odd(spark), none).count() == odd(spark).count()
    assert wu_manber.clean_documents(odd(spark), items).columns == odd(spark).columns


def brute_finds(text, name, template, coverage):
    """The scan without its counts: every window that starts with a template word is aligned."""
    w, b = plain_words(text), plain_words(template)
    n, i, out = len(b), 0, []
    need = -(-round(coverage * n * 1000) // 1000)
    while i < len(w):
        if w[i] not in b:
            i += 1
            continue
        stretch = w[i : i + n + n // 4 + 8]
        pairs = licenses.align(stretch, b)
        if len(pairs) >= need:
            out.append((name, i + pairs[0][0], i + pairs[-1][0] + 1, round(len(pairs) / n, 9)))
            i += pairs[-1][0] + 1
        elif sum(x in b for x in stretch) >= need and len(set(stretch) & set(b)) >= len(set(b)) - (n - need):
            i += max(1, n // 8)
        else:
            i += 1
    return out


def test_alignment():
    assert licenses.align(list("abcxdef"), list("abcdef")) == [(0, 0), (1, 1), (2, 2), (4, 3), (5, 4), (6, 5)]
    assert licenses.align([], [1]) == []
    text, template = list("qazbzc"), list("azbyzcq")
    pairs = licenses.align(text, template)
    assert all(text[i] == template[j] for i, j in pairs) and pairs == sorted(pairs) and len({j for _, j in pairs}) == len(pairs)
    assert licenses._rising([5, 1, 2, 9, 3]) == [1, 2, 4]


def test_licenses_found(spark):
    mit = licenses.TEMPLATES["MIT"]
    words = mit.split()
    rows = [
        (1, "start " + mit + " end", "en"),
        (2, "Released under the MIT License. Text. RELEASED under the MIT license!", "en"),
        (3, " ".join(words[:30] + ["added"] + words[32:]), "en"),
        (4, "the of and to in this software", "en"),
        (5, None, "en"),
        (6, " ".join(words[: len(words) // 2]), "en"),
    ]
    got = {r.doc_id: [(f.license, f.first, f.end, round(f.coverage, 9)) for f in r.finds] for r in licenses.scan(frame(spark, rows)).collect()}
    assert got[1][0] == ("MIT", 1, 1 + len(plain_words(mit)), 1.0)
    assert [f[0] for f in got[2]] == ["MIT-line", "MIT-line"]
    assert [f[0] for f in got[3]] == ["MIT"] and got[4] == got[5] == got[6] == []
    for d, text, _ in rows:
        want = [f for name, t in licenses.TEMPLATES.items() for f in brute_finds(text, name, t, licenses.COVERAGE)]
        assert got[d] == sorted(want, key=lambda f: (f[1], f[0]))


def test_license_query_finds_the_lines(spark, sf_dir):
    rows = QUERIES["op3_license_scan"](spark, sf_dir).collect()
    want = {d: ("licen" in (t or "").lower()) for d, t in duckdb.sql(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()}
    assert {r.doc_id: r.n_finds > 0 for r in rows} == want


def test_licenses_odd_rows(spark):
    assert licenses.scan(odd(spark)).where("size(finds) > 0").count() == 0
    assert licenses.scan(nothing(spark)).collect() == []
    assert licenses.scan(odd(spark), {"empty": ""}).where("size(finds) > 0").count() == 0


__all__ = ["duck"]
