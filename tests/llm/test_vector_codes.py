"""Codes of vectors against plain integers, and exact products of limbs against Python's numbers."""

import hashlib
import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code int, error string"


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 6), st.integers(1, 5), st.integers(1, 9), st.sampled_from([3, 5, 40, 300, 1 << 26, 1 << 29]), st.integers(0, 10**6))
def test_products_of_limbs_are_exact(n, m, d, most, seed):
    rng = np.random.default_rng(seed)
    x, y = rng.integers(-most, most, (2, n, d)), rng.integers(-most, most, (2, d, m))
    want = [[[sum(int(x[p, i, k]) * int(y[p, k, j]) for k in range(d)) for j in range(m)] for i in range(n)] for p in range(2)]
    for bits in (None, 4, 11):
        assert vector_codes.products(x, y, bits).tolist() == want


def test_limbs_are_narrow_and_sum_up():
    x = np.array([-(1 << 30), -1, 0, 1, (1 << 30) + 5])
    for bits in (3, 12, 25):
        parts = vector_codes.limbs(x, bits)
        assert all(np.abs(p).max() <= 1 << bits for p in parts)
        assert sum(p.astype(np.int64) << (bits * k) for k, p in enumerate(parts)).tolist() == x.tolist()
    # At the widest, sums of products stay below 2^53.
    for d in (1, 4, 100, 4096):
        bits = (vector_codes.EXACT_BITS - max(d - 1, 0).bit_length()) // 2
        assert d * (1 << bits) ** 2 <= 1 << 53


def _plain(rows, parts=16, entries=64, rounds=2):
    """{position of a row: (code, error)} and the digest of the codebooks, by plain loops over integers."""
    fine = [i for i, r in enumerate(rows) if r[1] and all(x is not None and math.isfinite(x) and abs(x) < vector_codes.LIMIT / 256 for x in r[1])]
    fine.sort(key=lambda i: (rows[i][0] is None, rows[i][0] or 0, rows[i][1]))
    if not fine:
        return {}, None
    size = len(rows[fine[0]][1])
    d = -(-size // parts)
    vectors = {}
    for i in (i for i in fine if len(rows[i][1]) == size):
        whole = [math.floor(x * 256) for x in rows[i][1]] + [0] * (d * parts - size)
        vectors[i] = [whole[p * d : p * d + d] for p in range(parts)]
    books = [[vectors[i][p] for i in list(vectors)[:entries]] for p in range(parts)]

    def best(part, book):
        far = [sum((a - b) ** 2 for a, b in zip(part, entry, strict=True)) for entry in book]
        return far.index(min(far)), min(far)

    for _ in range(rounds):
        for p in range(parts):
            met = {}
            for v in vectors.values():
                met.setdefault(best(v[p], books[p])[0], []).append(v[p])
            books[p] = [[sum(c) // len(met[k]) for c in zip(*met[k], strict=True)] if k in met else e for k, e in enumerate(books[p])]
    digest = hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()
    found = {i: [best(v[p], books[p]) for p in range(parts)] for i, v in vectors.items()}
    return {i: ("".join(f"{k:02x}" for k, _ in f), sum(far for _, far in f)) for i, f in found.items()}, digest


def _check(spark, rows):
    table = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "vec_id long, embedding array<float>, label int, n int, error string")
    books = vector_codes.learn(table)
    got = {r["n"]: (r["code"], r["error"]) for r in vector_codes.encode(table, books).collect()}
    exact = [(v, None if e is None else [None if x is None else float(np.float32(x)) for x in e], label) for v, e, label in rows]
    want, digest = _plain(exact)
    assert got == want
    assert digest is None or books.digest() == digest
    return table, books


def test_codes_of_any_vectors(spark):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(18)], rng.choice([1, 2, None])) for i in range(150, 0, -1)]
    rows += [(None, [0.5] * 18, 1), (None, [0.25] * 18, None), (7, [0.1] * 18, 3), (7, [0.1] * 18, 3)]
    rows += [(0, None, 1), (-1, [], 1), (-2, [None] * 18, 1), (-3, [float("nan")] * 18, 1), (-4, [float("inf")] * 18, 1), (-5, [3e38] * 18, 1), (200, [1.0], 1)]
    table, books = _check(spark, rows)
    near = vector_codes.decode(vector_codes.encode(table, books), books).where("vec_id = 150").first()
    parts = np.array(near["approximate"]).reshape(-1) * 256
    own = np.floor(np.array(near["embedding"]) * 256)
    assert len(parts) == 18 and int(((own - parts) ** 2).sum()) == near["error"]


@pytest.mark.parametrize("most", [1e-3, 100.0, 200_000.0])
def test_codes_of_few_small_and_large_numbers(spark, most):
    rng = random.Random(3)
    _check(spark, [(i, [rng.uniform(-most, most) for _ in range(32)], 0) for i in range(90)])
    _check(spark, [(i, [rng.uniform(-most, most) for _ in range(16)], 0) for i in range(5)])


def test_empty_tables_and_one_vector_many_times(spark):
    _check(spark, [(1, [0.5] * 16, 1)] * 300)
    nothing = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    books = vector_codes.learn(nothing)
    assert vector_codes.encode(nothing, books).collect() == []
    assert vector_codes.encode(spark.createDataFrame([(1, None, 1)], nothing.schema), vector_codes.learn(nothing)).collect() == []


def test_op11_sums_the_errors_of_labels(spark, data):
    rows = vector_codes.op11_vector_codes(spark, data).collect()
    label = {r["vec_id"]: r["label"] for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()}
    sums = {}
    for r in rows:
        sums[label[r["vec_id"]]] = sums.get(label[r["vec_id"]], 0) + r["error"]
    assert len(rows) == len(label) and all(r["label_error"] == sums[label[r["vec_id"]]] for r in rows)
