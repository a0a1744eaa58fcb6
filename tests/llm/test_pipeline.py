from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from brute import nothing, odd
from pyspark.sql import functions as F
from test_dedup import brute as brute_classes
from test_search import brute_hits
from test_tokens import check_packing

import corpus_pipeline as pipeline
from foliomill.llm import bradley_terry, fm_toxicity
from foliomill.llm.common import table, write_table
from foliomill.llm.queries import tokenizer_path


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in pipeline.STAGES:
        made = write_table(stage(spark, docs, sf_dir), name)
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_return_documents(stages):
    for name, docs, made in stages[:-1]:
        assert made.columns == docs.columns, name
        assert set(collected(made)) <= set(collected(docs)) and 0 < made.count() < docs.count(), name


def test_each_decision_takes_effect(spark, sf_dir, stages):
    labels = table(spark, sf_dir, "labels")
    kept = {name: {r.doc_id for r in made.collect()} for name, _, made in stages[:-1]}
    for name, docs, _ in stages[:4]:
        rows = docs.select("doc_id", "text").collect()
        texts = pa.array([r.text for r in rows], pa.string())
        if name == "quality":
            keep = bradley_terry.learn(docs, labels, F.lit(True)).score(texts) >= 0.7
        elif name == "toxicity":
            keep = fm_toxicity.learn(docs, labels, F.lit(True)).score(texts) < 0.7
        elif name == "near_duplicates":
            top = brute_classes([(r.doc_id, r.text) for r in rows], 5)
            keep = np.array([top[r.doc_id][1] == r.doc_id for r in rows])
        else:
            items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
            grams = {tuple(w[i : i + 10]) for _, t in items for w in [t.split()] for i in range(len(w))}
            assert grams
            some = rows[::9]
            assert all((brute_hits(r.text, items[:5], 10)[1] == 0) or r.doc_id not in kept[name] for r in some)
            continue
        assert kept[name] == {r.doc_id for r, k in zip(rows, keep, strict=True) if k}, name


def test_packed_rows_are_the_last_stage(spark, sf_dir, stages):
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    texts = {r.doc_id: r.text for r in stages[-1][1].collect()}
    check_packing(stages[-1][2].collect(), {d: [*made.encode(t or "", add_special_tokens=False).ids, 0] for d, t in texts.items()})
    assert collected(pipeline.run(spark, sf_dir).select("doc_id", "start", "length", "ids_crc32")) == collected(stages[-1][2].select("doc_id", "start", "length", "ids_crc32"))


@pytest.mark.parametrize("stage", [f for _, f in pipeline.STAGES], ids=[n for n, _ in pipeline.STAGES])
def test_odd_and_empty_documents(spark, sf_dir, stage):
    for docs in (odd(spark), nothing(spark)):
        made = stage(spark, docs, sf_dir)
        assert made.count() >= 0
        if stage is not pipeline.packing:
            assert made.columns == docs.columns
