"""Near copies against exact similarity of five-word shingles, and components by plain search."""

import random

import numpy as np
import pyarrow as pa
import pytest

from docledger.llm import minhash, simhash
from tests.llm.helpers import empty, hostile, lower
from tests.llm.test_texts import _union

SCHEMA = "doc_id long, text string"


def _sets(text):
    parts = lower(text).encode().split()
    return {b" ".join(parts[i : i + 5]) for i in range(max(1, len(parts) - 4))} if parts else set()


def _roots(docs, least):
    """The smallest id that each of {id: text} reaches over pairs of ``least`` similarity."""
    sets = {d: _sets(t) for d, t in docs.items()}
    near = [(a, b) for a in sets for b in sets if a < b and sets[a] and least[1] * len(sets[a] & sets[b]) >= least[0] * len(sets[a] | sets[b])]
    return _union(near, sorted(sets))


def _edited(rng, words, deletions, insertions):
    own = list(words)
    for at in rng.sample(range(len(own)), deletions):
        own[at] = None
    for at in rng.sample(range(len(own)), insertions):
        own[at] = f"x{rng.randrange(5000)}"
    return " ".join(w for w in own if w is not None)


def _families(rng, families, members, edits):
    """Texts of families with up to ``edits`` edits; deletions of few places, so that members share some of them."""
    docs = {}
    for base in range(families):
        words = [f"w{rng.randrange(5000)}" for _ in range(150)]
        docs[1000 * base] = " ".join(words)
        for k in range(1, members):
            n = rng.randrange(edits + 1)
            docs[1000 * base + k] = _edited(rng, words, n, rng.randrange(2))
    return docs


def test_edited_copies_go_and_less_alike_texts_stay(spark):
    rng = random.Random(3)
    docs = {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(300)]
        docs[100 * base] = " ".join(words)
        for k in range(1, 13):
            docs[100 * base + k] = _edited(rng, words, 0, k)
    root = _roots(docs, (4, 5))
    want = sorted({d for d in docs if root[d] == d})
    assert 12 < len(want) < len(docs) - 60
    assert sorted(r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()) == want


def test_keep_one_is_the_exact_search(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    root = _roots(docs, (4, 5))
    kept = simhash.keep_one(spark.read.parquet(f"{data}/documents.parquet")).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(d for d in docs if root[d] == d)


def test_groups_are_the_components_of_the_exact_links(spark):
    docs = _families(random.Random(11), 4, 60, 5)
    docs |= {9000: "three words only", 9001: "Three  WORDS only", 9002: "", 9003: None, 9004: " \n "}
    root = _roots(docs, (85, 100))
    assert 20 < len({d for d in docs if root[d] == d}) < len(docs) - 40
    rows = {r["doc_id"]: r for r in minhash.groups(spark.createDataFrame(list(docs.items()), SCHEMA)).collect()}
    assert {d: r["component_id"] for d, r in rows.items()} == root
    assert {d: r["n_shingles"] for d, r in rows.items()} == {d: len(_sets(t)) for d, t in docs.items()}
    assert all(r["kept"] == (r["component_id"] == d) for d, r in rows.items())


@pytest.mark.parametrize("least", [(85, 100), (4, 5)])
def test_members_of_one_bucket_that_miss_the_leader_are_found(spark, monkeypatch, least):
    # All in one bucket: the first alike to none, a chain, and families around texts that are not the leader.
    monkeypatch.setattr(minhash, "bands", lambda low, near: np.zeros((len(low), near.bands), np.uint64))
    words = [f"w{i}" for i in range(600)]
    docs = {k: " ".join(words[14 * k : 14 * k + 300]) for k in range(8)} | {50: " ".join(f"v{i}" for i in range(300))}
    docs |= {d + 10_000: t for d, t in _families(random.Random(5), 2, 40, 6).items()}
    near = minhash.Near(least, 4, 60)
    rows = minhash.groups(spark.createDataFrame(list(docs.items()), SCHEMA), near).collect()
    root = _roots(docs, least)
    assert {r["doc_id"]: r["component_id"] for r in rows} == root
    assert len(set(root.values())) > 10


def test_pairs_that_no_join_may_emit_by_the_square(spark):
    # A large family whose members share edits but are mostly not linked: few pairs are held against each other.
    docs = _families(random.Random(2), 1, 400, 6)
    sketched = minhash.sketches(spark.createDataFrame(list(docs.items()), SCHEMA), minhash.COPIES)
    sets = spark.createDataFrame(list(docs.items()), SCHEMA).join(sketched.select("doc_id", "set"), "doc_id").dropDuplicates(["set"])
    sets = sets.select("set", minhash._packed("text").alias("shingles"))
    lead = sketched.where("doc_id = 0").first()["set"]
    members = sketched.where("doc_id <> 0").select("set").distinct().selectExpr(f"{lead}L as lead", "set as a", "set as of")
    assert minhash._between(members, sets, minhash.COPIES).count() < 400 * 20


def test_differences_and_bands_are_not_broadcast(spark, data, monkeypatch):
    # Their files and sizes tell less than a tenth of what they hold.
    plans = {}
    written = minhash.written

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return written(df, name)

    monkeypatch.setattr(minhash, "written", noted)
    minhash.groups(spark.read.parquet(f"{data}/documents.parquet"))
    assert "SortMergeJoin [band" in plans["minhash-held"] and "SortMergeJoin [lead" in plans["minhash-between"]


def test_sketches_of_a_batch_are_those_of_each_text():
    texts = ["One two three four five six", None, "", "a b", "word " * 3000 + "x" * 700_000 + " end", " \x0b one\x1ctwo é "]
    whole = list(minhash.shingle_sets(pa.array(texts, pa.string())))
    alone = [next(minhash.shingle_sets(pa.array([t], pa.string()))) for t in texts]
    assert [w.tolist() for w in whole] == [a.tolist() for a in alone]
    assert [len(w) for w in whole] == [len(_sets(t)) for t in texts]
    times, plus = minhash.COPIES.hashes()
    low = minhash.minima(whole[4], times, plus)
    x = (whole[4] >> np.uint64(32)).astype(np.uint32)
    assert low.tolist() == [int((x * a + b).min()) for a, b in zip(times, plus, strict=True)]


def test_minhash_bears_anything(spark):
    rows = minhash.groups(hostile(spark)).collect()
    assert len(rows) == hostile(spark).count()
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    assert {r["component_id"] for r in by[7]} == {6} and not by[7][0]["kept"]
    assert [r["kept"] for r in by[None]] == [True] and by[None][0]["component_id"] is None
    assert all(r["n_shingles"] == 0 and r["component_id"] == d for d in (3, 4, 8) for r in by[d])
    assert minhash.groups(empty(spark)).collect() == []
    rows = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f")], SCHEMA)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.groups(rows).collect()} == {(None, 5, False), (5, 5, True)}
