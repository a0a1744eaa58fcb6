from __future__ import annotations

import math
import random

import numpy as np
import pytest
from check import compare
from pyspark.sql import functions as F

from foliomill.llm import strassen_negatives as hard
from foliomill.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<float>, label int, row_no long, a int, b int, place int, score double"
MOST = 1 << 62


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, g, 7, 8, 9, 10, 0.5) for i, v, g in rows], SCHEMA).repartition(3)


def brute(rows, positives=5, negatives=5):
    def able(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v)

    used = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if i is not None and g is not None and able(v)]
    out = []
    for k, (i, v, g) in enumerate(used):
        if i % 100:
            continue
        told = [(-sum(x * y for x, y in zip(v, w)), j, h) for n, (j, w, h) in enumerate(used) if n != k]
        for p, j, _ in sorted(x for x in told if x[2] == g)[:positives]:
            fit = sorted(x for x in told if x[2] != g and 80 * -p <= 100 * -x[0] <= 100 * -p)
            out += [(i, j, r + 1, x[1], -p, -x[0]) for r, x in enumerate(fit[:negatives])]
    return sorted(out)


def found(spark, rows, **kind):
    got = hard.mine(vectors(spark, rows), F.col("vec_id") % 100 == 0, **kind)
    return sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


@pytest.mark.parametrize("shape", [(1, 1, 1), (3, 5, 7), (70, 65, 130), (129, 33, 77), (64, 0, 9)])
def test_strassen_is_exact(shape):
    m, k, n = shape
    rng = np.random.default_rng(3)
    for most in (300, MOST):
        a, b = rng.integers(-most, most, (m, k)), rng.integers(-most, most, (k, n))
        assert (hard.strassen(a, b, 4) == a @ b).all()  # both wrap at 64 bits


def test_best_keeps_the_first_of_all_offers():
    rng = np.random.default_rng(5)
    best, offered = hard.Best(2, 5), []
    for _ in range(40):
        score, ids = rng.integers(-4, 4, 100), rng.integers(0, 10_000, 100)
        best.offer(1, score, ids)
        offered += zip((-score).tolist(), ids.tolist())
    owner, score, ids = best.rows()
    assert owner.tolist() == [1] * 5
    assert list(zip((-score).tolist(), ids.tolist())) == sorted(offered)[:5]


def test_query_matches_sql(spark, con, sf_dir):
    ok, note = compare(spark, con, "op11_hard_negatives", QUERIES["op11_hard_negatives"], SQL["op11_hard_negatives"], sf_dir)
    assert ok, note


@pytest.mark.parametrize("block_bytes", [1 << 24, 400])
def test_blocks_and_hot_vectors(spark, block_bytes):
    """Equal whatever the blocks; one vector and one label hold a third of the rows, scores tie."""
    rng = random.Random(4)
    rows = []
    for i in range(330):
        v = [0.5, 0.25, 0.125] if i % 3 == 0 else [rng.choice([-1.0, 0.0, 0.3, 0.31, 0.5]) for _ in range(3)]
        rows.append((i * 5, v, 1 if i % 3 == 1 else rng.randrange(4)))
    got = found(spark, rows, block_bytes=block_bytes)
    assert got == brute(rows) and got


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [1.0, 0.5], 1), (0, [1.0, 0.5], 1), (0, [0.9, 0.5], 2), (100, [0.0, 0.0], 1), (200, [-1.0, -1.0], 2), (None, [1.0, 1.0], 1),
        (300, None, 1), (400, [1.0, None], 1), (500, [nan, 1.0], 2), (600, [inf, 1.0], 2), (700, [1.0, 1.0], None), (800, [], 1),
        (900, [0.75], 2), (5, [1.0, 0.25, 2.0], 1), (6, [1.0, 0.25, 2.0], 2), (7, [0.95, 0.4], 3), (8, [0.95, 0.4], 3), (-100, [0.8, 0.8], 3),
    ]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
    assert found(spark, [(None, None, None)]) == []
