from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest
from brute import ODD, frame, nothing, odd, space_words

from foliomill.llm import minhash_dedup as dedup
from foliomill.llm.components import components
from foliomill.llm.queries import QUERIES


def shingle_set(text, size):
    w = space_words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def brute(rows, size):
    """doc_id -> (set size, least reachable doc_id), by comparing all sets that share a shingle."""
    sets, where = {d: shingle_set(t, size) for d, t in rows}, defaultdict(set)
    top = {d: d for d in sets}
    for d, s in sets.items():
        for x in s:
            where[x].add(d)

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for d, s in sets.items():
        for e in {e for x in s for e in where[x] if e > d}:
            both = len(s & sets[e])
            if 100 * both >= 80 * (len(s) + len(sets[e]) - both):
                a, b = find(d), find(e)
                top[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def test_query_equals_comparing_all_sets(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = brute(docs, 4)
    got = QUERIES["op6_near_duplicates"](spark, sf_dir).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == sorted((d, n, c, c == d) for d, (n, c) in want.items())


def test_many_heavily_edited_copies(spark):
    """A family whose members are alike only in part: every link and no other."""
    random = np.random.default_rng(1)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(120):
        w = list(base)
        for j in random.choice(150, int(random.integers(0, 9)), replace=False):
            w[j] = f"v{random.integers(40)}"
        rows.append((i, " ".join(w), "en"))
    want = brute([(d, t) for d, t, _ in rows], 4)
    got = {r.doc_id: r.component_id for r in dedup.classes(frame(spark, rows), 4).collect()}
    assert got == {d: c for d, (_, c) in want.items()}


def test_leaders_when_a_bucket_is_large(spark, monkeypatch):
    monkeypatch.setattr(dedup, "PARTNERS", 0)
    test_many_heavily_edited_copies(spark)


def moved_whole(plan):
    """Scans of sets in a plan that are shuffled before they meet a join."""
    lines, out = plan.split("\n"), []
    for i, line in enumerate(lines):
        if "Scan" not in line or "set#" not in line:
            continue
        depth = len(line) - len(line.lstrip(" :+-*()0123456789"))
        for above in reversed(lines[:i]):
            at = len(above) - len(above.lstrip(" :+-*()0123456789"))
            if at < depth:
                depth = at
                if "Join" in above:
                    break
                if "Exchange" in above:
                    out.append(line)
    return out


def test_sets_stay_in_place(spark, monkeypatch):
    """The table of sets is read beside the rows that need them, not shuffled whole, however many these are."""
    plans, write = [], dedup.write_table

    def noted(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, name)

    monkeypatch.setattr(dedup, "write_table", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        test_many_heavily_edited_copies(spark)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sum("set#" in plan for plan in plans) >= 2
    assert [x for plan in plans for x in moved_whole(plan)] == []


def test_odd_rows(spark):
    got = {}
    rows = dedup.classes(odd(spark)).collect()
    assert len(rows) == len(ODD)
    for r in rows:
        got.setdefault(r.doc_id, set()).add((r.n_shingles, r.component_id, r.kept))
    assert [got[d] for d in (2, 3, 4)] == [{(0, d, True)} for d in (2, 3, 4)]
    assert got[5] == {(1, 5, True)} and got[6] == {(1, 5, False)}
    assert got[-13] == {(116, -13, True)} and got[1] == {(116, -13, False)}
    assert {x[1:] for x in got[None]} == {(None, True)}
    assert {c for _, c, _ in got[9]} == {-13}


def test_one_of_each_keeps_columns(spark):
    docs = odd(spark)
    kept = dedup.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert 1 not in ids and 6 not in ids and ids.count(5) == 2 and {-13, 2, 3, 4, 7, 8, 12} <= set(ids)


def test_one_doc_id_with_several_texts(spark):
    """Its texts link it with all their groups; none of its texts is lost that is like no other."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(5, a, "en"), (5, b, "en"), (3, b, "en"), (9, a + " end", "en"), (7, c, "en"), (7, None, "en"), (8, c, "en"), (8, c, "en")]
    got = {}
    for r in dedup.classes(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, set()).add(r.component_id)
    assert got == {5: {3}, 3: {3}, 9: {3}, 7: {7}, 8: {7}}
    kept = sorted((r.doc_id, r.text or "") for r in dedup.one_of_each(frame(spark, rows)).collect())
    # One text of each group stays: b of 3, a of 9 (before the several texts of 5), c of 8; and the empty text.
    assert kept == [(3, b), (7, ""), (8, c), (8, c), (9, a + " end")]


def test_empty_table(spark):
    assert dedup.classes(nothing(spark)).collect() == []
    assert dedup.one_of_each(nothing(spark)).collect() == []


def test_sketch_fills_and_estimates():
    random = np.random.default_rng(0)
    size = dedup.BANDS * dedup.ROWS
    values = [random.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 3, 40, 1000)]
    values.append(np.concatenate([values[3][:900], random.integers(0, 2**63, 100, dtype=np.uint64)]))
    first = np.concatenate([[0], np.cumsum([len(v) for v in values])])
    made = dedup.sketches(np.concatenate(values), first, size)
    assert not (made == dedup._EMPTY).any()
    assert abs((made[3] == made[4]).mean() - 900 / 1100) < 0.12


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4), (7, 7), (9, 3)], [(i, i + 1) for i in range(60)], []])
def test_components(spark, links):
    df = spark.createDataFrame([*links, (None, 1)], "u long, v long")
    top = {x: x for link in links for x in link}
    for _ in links:
        for u, v in links:
            top[u] = top[v] = min(top[u], top[v])
    got = {r.node: r.component for r in components(df).collect()}
    assert got == {n: c for n, c in top.items() if any(n in x and x[0] != x[1] for x in links)}
