from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from brute import frame, nothing, odd

from foliomill.llm import periodic_runs as periodic
from foliomill.llm.queries import QUERIES
from foliomill.llm.textbytes import mix


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute_runs(w):
    """(start, length, period) by comparing all words q apart, for every q."""
    found = {}
    for q in range(1, len(w) // 4 + 1):
        k = 0
        while k < len(w) - q:
            j = k
            while j < len(w) - q and w[j] == w[j + q]:
                j += 1
            if j - k + q >= max(6, 4 * q):
                found.setdefault((k, j - k + q), q)
            k = max(j, k + 1)
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda x: (x[0], x[2]))


def brute_collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def random_words(rng, most):
    n = rng.randrange(most)
    w = [f"w{rng.randrange(rng.choice([1, 2, 3, 50]))}" for _ in range(n)]
    if n > 12 and rng.random() < 0.7:
        a = rng.randrange(n)
        p = 1 + rng.randrange(1 + (n - a) // 3)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


def test_difference_cover():
    for i in range(periodic.COVER_STEP):
        for j in range(periodic.COVER_STEP):
            d = periodic._DISTANCE[i, j]
            assert periodic._SAMPLED[(i + d) % periodic.COVER_STEP] and periodic._SAMPLED[(j + d) % periodic.COVER_STEP]


@pytest.mark.parametrize("period", [1, 2, 63, 64, 65, 200, 1500])
def test_extensions(period):
    """Every extension against plain comparison, in arrays that repeat for longer than many blocks."""
    rng = np.random.default_rng(period)
    z = np.concatenate([rng.integers(0, 3, 50), np.tile(rng.integers(0, 3, period), 1 + 3000 // period), rng.integers(0, 3, 70), [9]])
    i, j = rng.integers(0, len(z) - 1, 400), rng.integers(0, len(z) - 1, 400)
    j[:200] = np.minimum(i[:200] + period, len(z) - 1)
    keep = i != j
    i, j = i[keep], j[keep]
    plain = [next(k for k in range(len(z)) if max(a, b) + k >= len(z) or z[a + k] != z[b + k]) for a, b in zip(i.tolist(), j.tolist())]
    assert periodic.CoverExtensions(z).extend(i, j).tolist() == plain


def test_runs_of_many_texts():
    rng = random.Random(11)
    for _ in range(60):
        texts = [random_words(rng, 400) for _ in range(rng.randrange(1, 6))]
        first = np.concatenate([[0], np.cumsum([len(w) for w in texts])])
        number = np.array([int(x[1:]) for w in texts for x in w], np.uint64)
        got = periodic.find_runs(mix(number + np.uint64(5)), first)
        assert [tuple(r) for r in got.tolist()] == [(k, *r) for k, w in enumerate(texts) for r in brute_runs(w)]


def test_texts(spark):
    rng = random.Random(12)
    rows = [(i, rng.choice([" ", "\n", " \t "]).join(random_words(rng, 300)) + rng.choice(["", " ", "\n"]), "en") for i in range(80)]
    rows += [(100, "Ä ä " * 6, "de"), (101, "a A a A a A", "en"), (102, "x" * 70_000 + " y" * 6, "en"), (103, "a b a b a b a", "en")]
    got = {r.doc_id: r for r in periodic.scan(frame(spark, rows).repartition(3)).collect()}
    for i, text, _ in rows:
        runs = brute_runs(split(text))
        assert [tuple(r) for r in got[i].runs] == runs, i
        assert got[i].n_words == len(split(text)) and got[i].collapsed == brute_collapsed(split(text), runs)
    assert got[103].runs == [] and got[100].runs[0].period == 2


def test_odd_and_empty_tables(spark):
    got = periodic.scan(odd(spark)).collect()
    assert len(got) == odd(spark).count()
    for r in got:
        assert r.n_words >= len(split(r.collapsed))
    assert [r.collapsed for r in got if r.doc_id in (2, 3, 4)] == ["", "", ""]
    assert all(r.runs for r in got if r.doc_id == 10)
    assert periodic.scan(nothing(spark)).collect() == []


def test_long_repeating_text(spark):
    began = time.time()
    values = mix(np.arange(120_000, dtype=np.uint64) % np.uint64(3))
    assert periodic.find_runs(values, np.array([0, 120_000])).tolist() == [[0, 0, 120_000, 3]]
    assert time.time() - began < 30


def test_query(spark, sf_dir):
    got = {r.doc_id: r for r in QUERIES["op12_periodic_runs"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    repeating = 0
    for d, text in docs:
        w = split(text)
        h = zlib.crc32(str(d).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        runs = brute_runs(w)
        repeating += len(runs) > 0
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[d]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best), d
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute_collapsed(w, runs).encode()).hexdigest()
    assert repeating
