from __future__ import annotations

import hashlib

import xxhash
from brute import ODD, nothing, odd
from pyspark.sql import functions as F

from foliomill.llm import winnowing
from foliomill.llm.queries import QUERIES


def hash64(text):
    value = xxhash.xxh64(text.encode(), seed=42).intdigest()
    return value - 2**64 if value >= 2**63 else value


def brute(text, k=winnowing.K, w=winnowing.W):
    if not text:
        return []
    if len(text) < k:
        return [(0, hash64(text) % 2**64 >> 32)]
    hashes = [hash64(text[i : i + k]) >> 12 for i in range(len(text) - k + 1)]
    out = []
    for i in range(max(1, len(hashes) - w + 1)):
        window = hashes[i : i + w]
        j = i + max(x for x, h in enumerate(window) if h == min(window))
        if not out or out[-1][0] != j:
            out.append((j, (hashes[j] << 12) % 2**64 >> 32))
    return out


def likeness(a, b):
    a, b = {h for _, h in a}, {h for _, h in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def split(kept):
    return [(v >> 32, v % 2**32) for v in kept]


def test_documents_and_their_edits(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts, reverse=True)
    kept = {d: brute(t) for d, t in texts.items()}
    query = {r.doc_id: r for r in QUERIES["op9_fingerprints"](spark, sf_dir).collect()}
    for rows in (7, 2000):
        full = {r.doc_id: r for r in winnowing.edited_documents(docs, rows=rows).collect()}
        assert len(full) == len(query) == len(texts)
        for i, d in enumerate(order):
            after = order[(i + 1) % len(order)]
            cut = len(texts[d]) // 3
            edited = texts[d][: len(texts[d]) - cut] + texts[after][:cut]
            r = full[d]
            assert r.edited == edited and r.n_chars == len(texts[d])
            assert split(r.kept) == kept[d] and split(r.edited_kept) == brute(edited)
            assert abs(r.near_edited - likeness(kept[d], brute(edited))) < 1e-12
            assert abs(r.near_next - likeness(kept[d], kept[after])) < 1e-12
            assert query[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
            assert (query[d].near_edited, query[d].near_next) == (r.near_edited, r.near_next)
    by_text = {}
    for d, t in texts.items():
        by_text.setdefault(t, set()).add(query[d].fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_shared_passages_are_found(spark):
    shared = "a passage of 27 characters!"[: winnowing.K + winnowing.W - 1]
    assert len(shared) == winnowing.K + winnowing.W - 1
    rows = [(f"{'x1y2' * 700}{shared}{'q' * 900}",), (f"{'ab ' * 40}{shared} tail",)]
    a, b = [split(r[0]) for r in spark.createDataFrame(rows, "t string").select(winnowing.fingerprints(F.col("t"))).collect()]
    assert {h for _, h in a} & {h for _, h in b}
    assert all(split(r[0]) == brute(t[0]) for t, r in zip(rows, spark.createDataFrame(rows, "t string").select(winnowing.fingerprints(F.col("t"))).collect(), strict=True))


def test_rightmost_of_equal_hashes(spark):
    got = split(spark.createDataFrame([("z" * 60,)], "t string").select(winnowing.fingerprints(F.col("t"))).first()[0])
    assert [p for p, _ in got] == list(range(winnowing.W - 1, 60 - winnowing.K + 1))


def test_odd_rows(spark):
    got = {}
    rows = winnowing.edited_documents(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    assert got[2][0].kept == [] == got[3][0].kept and got[2][0].near_edited == 1.0
    assert split(got[8][0].kept) == brute("z" * 70_000)
    assert got[-13][0].near_next == 1.0  # the row without doc_id follows, with the same text
    assert [split(r.kept) for r in got[5]] == [brute("One two")] * 2
    order = sorted([d for d in got if d is not None], reverse=True)
    assert all(r.edited for d in order if d in (1, 7, 10) for r in got[d])
    assert winnowing.edited_documents(nothing(spark)).collect() == []


def test_one_document_follows_itself(spark):
    r = winnowing.edited_documents(spark.createDataFrame([(5, "abcdefghi" * 9)], "doc_id long, text string")).first()
    assert r.near_next == 1.0 and r.edited == r.text[:54] + r.text[:27]
