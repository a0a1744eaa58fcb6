from __future__ import annotations

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import ODD, frame, low, nothing, odd, space_words
from pyspark.sql import functions as F

from foliomill.llm import ppm_scoring as ppm
from foliomill.llm.common import held_out


def brute(texts, out, picked):
    """row -> (tokens, known, training tokens, base score, score) with dictionaries of counts."""
    tokens = {d: [*space_words(t), None] for d, t in texts.items()}
    count = Counter(w for d in texts if not out[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    streams = {d: b"\xfe" * ppm.ORDER + low(t).encode() + b"\xff" for d, t in texts.items()}
    seen = [defaultdict(Counter) for _ in range(ppm.ORDER + 1)]
    symbols = 0
    for d, s in streams.items():
        if not out[d]:
            for i in range(ppm.ORDER, len(s)):
                symbols += 1
                for o in range(ppm.ORDER + 1):
                    seen[o][s[i - o : i]][s[i]] += 1
    kept = [{x for x, c in seen[o].items() if not o or sum(c.values()) >= ppm.CONTEXT_SHARE * symbols} for o in range(ppm.ORDER + 1)]

    def cost(s, i):
        ruled_out, total = set(), 0.0
        o = next((o for o in range(ppm.ORDER, -1, -1) if s[i - o : i] in kept[o]), -1)
        for order in range(o, -1, -1):
            cell = seen[order][s[i - order : i]]
            rest = {q: c for q, c in cell.items() if q not in ruled_out}
            whole = sum(rest.values())
            if s[i] in rest:
                return total + math.log10((rest[s[i]] - 0.5) / whole)
            if whole:
                total += math.log10(0.5 * len(rest) / whole)
            ruled_out |= set(cell)
        return total + math.log10(1 / (255 - len(ruled_out)))

    made = {}
    for d in picked:
        w = tokens[d]
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        score = sum(cost(streams[d], i) for i in range(ppm.ORDER, len(streams[d])))
        made[d] = (len(w), sum(count[x] > 0 for x in w), n, base, score)
    return made


@pytest.mark.parametrize("word_share", [ppm.WORD_SHARE, 1e-3, 2.0])
def test_query_equals_brute_force(spark, sf_dir, monkeypatch, word_share):
    """Also with most words, and with all words, joined instead of broadcast."""
    monkeypatch.setattr(ppm, "WORD_SHARE", word_share)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = {d: zlib.crc32(str(d).encode()) % 7 == 2 for d in texts}
    picked = sorted(texts, key=lambda d: len(texts[d] or ""))[::8]
    want = brute(texts, out, picked)
    got = {r.doc_id: r for r in ppm.scored(docs, held_out("doc_id", 7, 2)).collect()}
    assert len(got) == len(texts) and all(got[d].held_out == out[d] for d in texts)
    for d, (tokens, known, n, base, score) in want.items():
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (tokens, known, n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(score, rel=1e-5)


def test_probabilities_sum_to_one():
    """All next symbols of any context: their probabilities add up to one."""
    random = np.random.default_rng(0)
    text = bytes(random.choice(list(b"abracad "), 4000).tolist()).decode()
    batch = __import__("pyarrow").RecordBatch.from_pydict({"text": [text, "bar", None]})
    made = ppm._counted(batch)
    kind, key, n = (made[c].to_numpy() for c in ("kind", "key", "n"))
    cells = []
    for o in range(ppm.ORDER + 1):
        k, c = ppm._summed([key[kind == 0] & ((1 << 8 * (o + 1)) - 1)], [n[kind == 0]])
        cells.append((k, c))
    trie = ppm.Trie.build(cells)
    seen = (trie.column < trie.cost.shape[1] - 1).sum()
    total = (10.0 ** trie.cost[:, :-1].astype(float)).sum(axis=1) + (255 - seen) * 10.0 ** trie.cost[:, -1].astype(float)
    assert np.allclose(total, 1, atol=1e-5)


def test_odd_rows(spark):
    rows = ppm.scored(odd(spark), held_out("doc_id", 7, 2)).collect()
    assert len(rows) == len(ODD)
    assert all(r.n_tokens == 1 and r.score < 0 for r in rows if r.doc_id in (2, 3))
    assert len({(r.base_score, r.score) for r in rows if r.doc_id == 5}) == 1
    assert all(r.held_out is False for r in rows if r.doc_id is None)


def test_nothing_to_learn_from(spark):
    rows = ppm.scored(frame(spark, [(1, "ab", "en"), (2, None, "en")]), F.lit(True)).collect()
    got = {r.doc_id: r for r in rows}
    assert got[1].score == pytest.approx(3 * math.log10(1 / 255), rel=1e-5) and got[1].base_score == 0 and got[1].n_known == 0
    assert ppm.scored(nothing(spark), F.lit(False)).collect() == []


@pytest.mark.parametrize("shares", [(ppm.TRIE_SHARE, ppm.GRAM_SHARE), (1e-3, 1e-4), (2.0, 2.0)])
def test_every_context_counts_at_any_size(spark, monkeypatch, shares):
    """A context seen twice among many symbols predicts, from the trie, from broadcast n-grams or joined."""
    monkeypatch.setattr(ppm, "TRIE_SHARE", shares[0])
    monkeypatch.setattr(ppm, "GRAM_SHARE", shares[1])
    random = np.random.default_rng(1)
    texts = {i: bytes(random.choice(list(b"abcde fgh"), 20_000).tolist()).decode() for i in range(20)}
    texts |= {20: "qzxjv qzxjv", 21: "qzxjvk", 22: "Qzxjv", 23: None, 24: "éñ!"}
    out = {d: d >= 21 for d in texts}
    rows = [(d, t, "en") for d, t in texts.items()]
    got = {r.doc_id: r for r in ppm.scored(frame(spark, rows), F.col("doc_id") >= 21).collect()}
    want = brute(texts, out, [3, 20, 21, 22, 23, 24])
    for d, (*_, score) in want.items():
        assert got[d].score == pytest.approx(score, rel=1e-5), d
