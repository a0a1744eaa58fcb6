from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from brute import ODD, frame, nothing, odd
from pyspark.sql import functions as F

from foliomill.llm import bradley_terry, ecoc_langid, fm_toxicity
from foliomill.llm.queries import QUERIES


def area(score, y):
    """Share of pairs of a 1 and a 0 in the right order."""
    score, y = np.array(score), np.array(y)
    less = (score[y == 1][:, None] > score[y == 0][None, :]).mean()
    return less + 0.5 * (score[y == 1][:, None] == score[y == 0][None, :]).mean()


@pytest.fixture(scope="module")
def sf(sf_dir):
    return sf_dir.replace("sf0.001", "sf0.01")  # enough labels to learn from


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality", "quality", 0.9), ("op2_toxicity", "toxic", 0.85)])
def test_held_out_labels(spark, sf, name, label, least):
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = QUERIES[name](spark, sf).collect()
    assert len(rows) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    unseen = [r for r in rows if r.held_out and r.doc_id in labels]
    assert area([r.score for r in unseen], [labels[r.doc_id] for r in unseen]) > least
    assert np.mean([r.predicted == labels[r.doc_id] for r in unseen]) > 0.9


def test_held_out_languages(spark, sf):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, sf).collect()
    assert len(rows) == len(lang) and all(0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_labels_of_the_held_out_fold_change_nothing(spark, sf, tmp_path):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = bradley_terry.learn(docs, labels, ~out), bradley_terry.learn(docs, turned, ~out)
    assert np.array_equal(a.weight, b.weight) and a.cut == b.cut


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int, source string")


@pytest.mark.parametrize("module", [bradley_terry, fm_toxicity])
def test_odd_rows(spark, module):
    labels = labels_of(spark, [(i, i % 2, (i + 1) % 2, "s") for i in range(12)] + [(5, 1, 0, "s"), (5, 0, 1, "s"), (None, 1, 1, "s"), (7, None, None, "s"), (99, 1, 1, "s")])
    for given in (labels, labels.where("quality = 1"), labels.where("doc_id < 0")):
        model = module.learn(odd(spark), given, F.lit(True))
        rows = module.scored(odd(spark), model).collect()
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
        same = {r.score for r in rows if r.doc_id in (2, 3)}
        assert len(same) == 1
        assert module.scored(nothing(spark), model).collect() == []
        assert module.learn(nothing(spark), given, F.lit(True)).constant is not None
    keep = module.good_documents if module is bradley_terry else module.harmless_documents
    assert keep(odd(spark), model).columns == odd(spark).columns


def test_machine_learns_a_pair(spark):
    """A word that is only harmful beside another one: no sum of single weights can tell."""
    random = np.random.default_rng(2)
    first, slot, y = [0], [], []
    for _ in range(2000):
        a, b = random.integers(2, size=2)
        slot += [*([0] if a else []), *([1] if b else []), 2]
        first.append(len(slot))
        y.append(float(a != b))
    model = fm_toxicity.fit(np.array(first), np.array(slot), np.array(y), np.arange(3))
    text = np.repeat(np.arange(4), [1, 2, 2, 3])
    logit = model.logit(text, np.array([2, 0, 2, 1, 2, 0, 1, 2]), 4)
    assert min(logit[1], logit[2]) > max(logit[0], logit[3])


def test_fm_formula():
    random = np.random.default_rng(4)
    model = fm_toxicity.Machine(np.arange(6), 0.3, random.standard_normal(6), random.standard_normal((6, 3)))
    picked = [0, 2, 5]
    want = 0.3 + model.weight[picked].sum() + sum(model.factor[a] @ model.factor[b] for i, a in enumerate(picked) for b in picked[i + 1 :])
    assert model.logit(np.zeros(3, int), np.array(picked), 1)[0] == pytest.approx(want)


@pytest.mark.parametrize("languages", [230, 320])
def test_every_language_is_learned(spark, languages):
    """More languages than a short list holds, one of them with most of the rows; all come out again."""
    pick = np.random.default_rng(5)
    own = {k: ["".join(chr(97 + int(c)) for c in pick.integers(0, 26, 7)) for _ in range(6)] for k in range(languages)}
    rows = [(i, " ".join(pick.choice(own[k], 12)), f"l{k:03d}") for i, k in enumerate([k for k in range(languages) for _ in range(4)] + [7] * 500)]
    docs = frame(spark, rows)
    model = ecoc_langid.learn(docs, F.lit(True), rows=2000)
    assert len(model.languages) == languages
    got = ecoc_langid.predicted(docs, model).select("doc_id", "lang_pred").collect()
    lang = {i: g for i, _, g in rows}
    assert np.mean([lang[r.doc_id] == r.lang_pred for r in got]) > 0.97
    assert len({r.lang_pred for r in got}) >= 0.97 * languages


def test_languages_odd_rows(spark):
    model = ecoc_langid.learn(odd(spark), F.lit(True))
    got = {}
    for r in ecoc_langid.predicted(odd(spark), model).collect():
        got.setdefault(r.doc_id, set()).add((r.lang_pred, r.score))
    assert {x for d in (2, 3, 4, 12) for x in got[d]} == {("und", 0.0)}
    assert all(p in {"en", "es", "fr", "xx"} for d in (1, 7, 8, 10) for p, _ in got[d])
    assert ecoc_langid.predicted(nothing(spark), model).collect() == []
    none = ecoc_langid.learn(nothing(spark), F.lit(True))
    assert {(r.lang_pred, r.score) for r in ecoc_langid.predicted(odd(spark), none).collect()} == {("und", 0.0)}
    one = ecoc_langid.learn(frame(spark, [(1, "abc", "en")]), F.lit(True))
    assert {r.lang_pred for r in ecoc_langid.predicted(odd(spark), one).collect()} == {"en", "und"}


@pytest.mark.parametrize("n", [2, 3, 4, 5, 9, 40])
def test_codewords_are_far_apart(n):
    code = ecoc_langid.codewords(n)
    apart = (code.shape[1] - code @ code.T) / 2 + 99 * np.eye(n)
    assert apart.min() >= (1 if n < 4 else 4)


def test_features_do_not_depend_on_the_batch():
    texts = [t for _, t, _ in ODD]
    for make in (bradley_terry.features, ecoc_langid.features):
        whole = make(pa.array(texts))
        assert np.allclose(whole, np.concatenate([make(pa.array([t], pa.string())) for t in texts]))


def test_quality_learns_from_every_label(spark):
    """Few texts in a block; a feature that only some blocks know counts, and the cut is the quantile of all."""
    rows = [(i, ("Good words, well put together. " if i % 3 else "xx xx xx 11 ## ") * (1 + i % 5), "en") for i in range(300)]
    docs, labels = frame(spark, rows), labels_of(spark, [(i, int(i % 3 > 0), 0, "s") for i in range(300)])
    model = bradley_terry.learn(docs, labels, F.lit(True), block=20)
    x = bradley_terry.features(pa.array([t for _, t, _ in rows]))
    assert np.allclose(model.mean, x.mean(axis=0, dtype=np.float64), atol=1e-6)
    assert model.cut == pytest.approx(np.quantile(model.raw(x), 100 / 300))
    got = {r.doc_id: r.score for r in bradley_terry.scored(docs, model).collect()}
    assert all((got[i] >= 0.7) == (i % 3 > 0) for i in range(300))
    other = bradley_terry.learn(docs.repartition(7), labels, F.lit(True), block=20)
    assert np.array_equal(model.weight, other.weight) and model.cut == other.cut
