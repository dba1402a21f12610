"""BPE and token files against the tokenizers library."""

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest
import tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import bpe, token_files
from docledger.llm.shared import new_path
from tests.llm.helpers import empty, hostile


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(bpe.vocabulary_path())


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aeistIL'd ÉßΣ½1<|endoftext|>\n", max_size=60))
def test_encoding_is_the_library_s(text):
    theirs = tokenizers.Tokenizer.from_file(bpe.vocabulary_path()) if not _LIBRARY else _LIBRARY[0]
    _LIBRARY[:] = [theirs]
    text = text.encode("utf-8", "ignore").decode()
    assert bpe.encoder(bpe.vocabulary_path()).encode(text) == theirs.encode(text, add_special_tokens=False).ids
    assert token_files._coder(bpe.vocabulary_path()).encode(text) == theirs.encode(text, add_special_tokens=False).ids


_LIBRARY = []


def test_a_full_memo_changes_nothing(monkeypatch, library):
    coder = bpe.Encoder(bpe.vocabulary_path())
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    for text in ["one two three four", "five six one", "<|endoftext|> one"] * 2:
        assert coder.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_the_memo_of_a_worker_stays_small_within_a_batch(monkeypatch, library):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 500)
    monkeypatch.setattr(bpe, "SLICE", 1_000)
    monkeypatch.setattr(bpe, "_ENCODERS", {})
    texts = [f"w{chr(97 + i % 26)}x{chr(97 + i // 26 % 26)}q{chr(97 + i // 676)} é" for i in range(3_000)] + [None, "", "one long row " * 200]
    coder = bpe.encoder(bpe.vocabulary_path())
    got = coder.encode_slices(pa.array(texts, pa.string())).to_pylist()
    assert got == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert len(coder.memo) < 1_000
    assert coder.encode_slices(pa.array([], pa.string())).to_pylist() == []


def test_op1_on_all_documents(spark, data, library):
    rows = {r["doc_id"]: r for r in bpe.op1_bpe(spark, data).collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = library.encode(d["text"] or "", add_special_tokens=False).ids
        r = rows[d["doc_id"]]
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_bpe_bears_anything(spark, library):
    docs = hostile(spark)
    rows = bpe.decode(bpe.encode(docs, bpe.vocabulary_path()), bpe.vocabulary_path()).collect()
    assert len(rows) == docs.count()
    for r in rows:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
    assert bpe.round_trip(empty(spark), bpe.vocabulary_path()).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10_000), min_size=1, max_size=60), st.integers(6, 12))
def test_code_lengths_are_shortest_within_the_limit(counts, most):
    counts = np.array(counts)
    lengths = token_files.code_lengths(counts, most)
    used = counts > 0
    assert (lengths[~used] == 0).all() and (lengths[used] > 0).all() and lengths.max() <= most
    assert sum(2.0 ** -int(x) for x in lengths[used]) <= 1
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in lengths[used]) == 1
        # Without a limit that binds, as short as plain Huffman merging.
        heap, total = sorted(counts[used].tolist()), 0
        while len(heap) > 1:
            a, b = heap.pop(0), heap.pop(0)
            total += a + b
            heap = sorted([*heap, a + b])
        got = int((lengths * counts).sum())
        assert got >= total
        if token_files.code_lengths(counts, 30).max() <= most:
            assert got == total


def test_blocks_decode_side_by_side():
    rng = np.random.default_rng(1)
    ids = rng.zipf(1.3, 5_000) % 300
    lengths = token_files.code_lengths(np.bincount(ids, minlength=300))
    at = np.array([0, 0, 1, 257, 257 + 256, 2_000, 5_000, 5_000])
    data, starts, bit = token_files.pack(ids, at, lengths, token_files.canonical(lengths))
    sizes = np.diff(at)
    checks = np.concatenate([bit[a:b][:: token_files.CHECK] for a, b in zip(at[:-1], at[1:])])
    assert (token_files.Decoder(lengths).block(data.tobytes(), checks, sizes) == ids).all()
    assert (starts[1:] >= starts[:-1]).all()


def test_op7_on_all_documents(spark, data, library):
    rows = {r["doc_id"]: r for r in token_files.op7_token_files(spark, data).collect()}
    start = 0
    for d in sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda d: d["doc_id"]):
        ids = [*library.encode(d["text"] or "", add_special_tokens=False).ids, 1]
        r = rows.pop(d["doc_id"])
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert not rows


def test_token_files_bear_anything(spark, library):
    path = new_path(spark, "files")
    token_files.write(hostile(spark), path, bpe.vocabulary_path())
    rows = sorted(token_files.read(spark, path).collect(), key=lambda r: r["start"])
    given = hostile(spark).collect()
    assert sorted(map(str, (r["ids"] for r in rows))) == sorted(str([*library.encode(g["text"] or "", add_special_tokens=False).ids, 1]) for g in given)
    assert [r["doc_id"] for r in rows] == sorted((g["doc_id"] for g in given), key=lambda x: (x is not None, x or 0))
    assert [r["start"] for r in rows] == np.cumsum([0, *(len(r["ids"]) for r in rows)])[:-1].tolist()
    path = new_path(spark, "files")
    token_files.write(empty(spark), path, bpe.vocabulary_path())
    assert token_files.read(spark, path).collect() == []
