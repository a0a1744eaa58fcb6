from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from brute import ODD, frame, nothing, odd

from foliomill.llm import hilbert_packing, token_index, tokens
from foliomill.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(tokenizer_path())
    made.encode_special_tokens = True
    return lambda text: made.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@pytest.mark.parametrize("piece", [1 << 20, 97])
def test_units_give_the_ids_of_whole_texts(plain, monkeypatch, piece):
    monkeypatch.setattr(tokens, "PIECE", piece)
    pick = random.Random(3)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", "'", "don't", "\t", " ", " ", "中", "9", "42", ".", "!!", "\r\n", "　", "ß", "😀", "\x1f", "\x85", "'ll ", "_", "-", "<|endoftext|>", "x́"]
    made = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 120))) for _ in range(1500)] + [None, "", "y" * 3000 + " z"]
    ids, offsets = tokens.Encoder(tokenizer_path()).encode(pa.array(made))
    for i, text in enumerate(made):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == plain(text), text


def test_store_is_bounded(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_UNITS", 10)
    encoder = tokens.Encoder(tokenizer_path())
    for k in range(5):
        made = [f"word{k} other{k} {k}" for k in range(k * 3, k * 3 + 3)]
        ids, _ = encoder.encode(pa.array(made))
        assert ids.tolist() == [x for t in made for x in plain(t)]


def test_index_query_is_an_exact_round_trip(spark, sf_dir, texts, plain):
    got = {r.doc_id: r for r in QUERIES["op8_token_index"](spark, sf_dir).collect()}
    start = 0
    for d in sorted(texts):
        ids = [*plain(texts[d]), 2]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    assert len(got) == len(texts)


def test_keyed_reads(spark, plain):
    shards = token_index.write_shards(odd(spark), tokenizer_path(), 2, shard_bytes=4000).collect()
    assert len(shards) > 1 and [s.start for s in shards] == [sum(x.ids for x in shards if x.part < s.part) for s in shards]
    found = defaultdict(list)
    opened = [token_index.Shard(s.path) for s in shards]
    for d in {d for d, _, _ in ODD if d is not None}:
        for shard in opened:
            found[d] += [x.tolist() for x in shard.get(d)]
    for d in found:
        assert found[d] == [[*plain(t), 2] for t in sorted(t or "" for i, t, _ in ODD if i == d)]
    assert all(shard.get(k) == [] for shard in opened for k in (77, -1, 10**12))
    rows = token_index.read_documents(token_index.write_shards(odd(spark), tokenizer_path(), 2)).collect()
    assert len(rows) == len(ODD) and next(r for r in rows if r.doc_id is None).start == 0


def test_empty_table(spark):
    assert token_index.read_documents(token_index.write_shards(nothing(spark), tokenizer_path(), 2)).collect() == []
    assert hilbert_packing.packed(nothing(spark), tokenizer_path(), 0).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 63, 5000])
def test_perfect_hash(n):
    keys = np.random.default_rng(n).choice(2**62, n, replace=False).astype(np.int64)
    slots = token_index.PerfectHash.build(keys).slots(keys)
    assert sorted(slots.tolist()) == list(range(n))


def check_packing(rows, ids_of):
    """Every id in one piece, sequences without gaps and of a length that needs no padding."""
    by_doc, by_sequence, padding = defaultdict(list), defaultdict(list), 0
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for d, ids in ids_of.items():
        at = 0
        for r in sorted(by_doc[d], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids) and r.ids_crc32 == crc(ids[at : at + r.length])
            at += r.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024
        padding += 0 if at & (at - 1) == 0 else 1024 - at
    assert set(by_doc) == set(ids_of) and padding == 0


def test_packing_query(spark, sf_dir, texts, plain):
    check_packing(QUERIES["op4_packing"](spark, sf_dir).collect(), {d: [*plain(t), 0] for d, t in texts.items()})


def test_packing_odd_rows(spark, plain):
    rows = [r for r in hilbert_packing.packed(odd(spark), tokenizer_path(), 0).collect() if r.doc_id != 5]
    check = {d: [*plain(t), 0] for d, t, _ in ODD if d != 5}
    assert {r.doc_id for r in rows} == set(check)
    assert sum(r.length for r in rows) == sum(map(len, check.values()))


def test_hilbert_curve_is_a_path_through_all_cells():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 4, indexing="ij"), axis=-1).reshape(-1, 4)
    keys = hilbert_packing.hilbert_keys(grid, 3)
    assert sorted(keys.tolist()) == list(range(4096))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("piece", [1 << 20, 97])
def test_added_tokens_as_the_library_reads_them(monkeypatch, piece):
    """Against the library's own call, also with the token next to letters, at ends, cut between texts, and in a row."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokens, "PIECE", piece)
    monkeypatch.setattr(tokens.Encoder, "_made", {})
    whole = Tokenizer.from_file(tokenizer_path())
    pick = random.Random(4)
    parts = ["a", "B", "é", " ", "  ", "\n", "'s", ".", "<|endoftext|>", "<|endof", "text|>", "<", "|>", "中", "9"]
    made = ["".join(pick.choice(parts) for _ in range(pick.randint(0, 80))) for _ in range(1500)]
    made += ["a <|endoftext|> b", "x<|endof", "text|>y", None, "<|endoftext|>" * 40]
    ids, offsets = tokens.Encoder.of(tokenizer_path()).encode(pa.array(made))
    for i, text in enumerate(made):
        assert ids[offsets[i] : offsets[i + 1]].tolist() == whole.encode(text or "", add_special_tokens=False).ids, text
    assert ids[offsets[1500] : offsets[1501]].tolist() == [64, 220, 50256, 275]


def test_index_rows_of_a_text_with_an_added_token(spark):
    rows = [(1, "a <|endoftext|> b", "en"), (2, "c", "en")]
    got = {r.doc_id: r for r in token_index.read_documents(token_index.write_shards(frame(spark, rows), tokenizer_path(), 2)).collect()}
    assert (got[1].n_tokens, got[1].ids_crc32, got[2].start) == (5, crc([64, 220, 50256, 275, 2]), 5)
