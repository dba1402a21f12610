"""The stages of the corpus pipeline on the small tables and on rows of every kind."""

import corpus_pipeline
from docledger.llm import bpe, decontaminate, minhash, simhash
from tests.llm.helpers import empty, hostile, words
from tests.llm.test_minhash import _roots
from tests.llm.test_texts import _plain_hits


def test_stages_keep_the_columns(spark, data):
    docs = hostile(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, data)
        assert kept.columns == docs.columns, name
        assert stage(spark, empty(spark), data).collect() == [], name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


def test_run_is_the_stages_by_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:2]:
        docs = spark.createDataFrame(stage(spark, docs, data).collect(), docs.schema)
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    root = _roots(kept, (4, 5))
    kept = {d: t for d, t in kept.items() if root[d] == d}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()]
    hits = {d: _plain_hits(t, items) for d, t in kept.items() if any(" ".join(words(t)).find(" ".join(words(i)[:13])) >= 0 or True for _, i in items[:1])}
    kept = {d for d in kept if not (hits[d][1] and 20 * hits[d][1] >= hits[d][0])}
    rows = corpus_pipeline.run(spark, data).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(kept)
    assert rows[0].asDict().keys() == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}
    assert len(kept) > 100


def test_planted_rows_go_and_clean_ones_stay(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    text = docs.where("lang = 'en' and n_chars > 2000").first()["text"]
    passage = spark.read.parquet(f"{data}/benchmark.parquet").first()["text"]
    planted = spark.createDataFrame([(90_001, text, "en", "p", 1), (90_002, text + " again", "en", "p", 1), (90_003, passage, "en", "p", 1)], docs.schema)
    ids = {r["doc_id"] for r in simhash.keep_one(docs.unionByName(planted)).select("doc_id").collect()}
    assert not ids & {90_001, 90_002}
    ids = {r["doc_id"] for r in decontaminate.clean_rows(docs.unionByName(planted), spark.read.parquet(f"{data}/benchmark.parquet")).collect()}
    assert 90_003 not in ids and 90_001 in ids
    assert bpe.round_trip(planted, bpe.vocabulary_path()).count() == 3


def test_near_copies_are_proposed_by_fingerprints(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    text = docs.where("length(text) > 6000").first()["text"]
    planted = spark.createDataFrame([(90_001, text + " again"), (90_002, text.replace(".", ". \n"))], docs.schema)
    marked = minhash.sketches(simhash.fingerprints(docs.unionByName(planted)), minhash.ALIKE).drop("bands", "signature").cache()
    of = {r["doc_id"]: r for r in marked.collect()}
    pairs = {frozenset((r["a"], r["b"])) for r in simhash.proposed(marked).collect()}
    # All pairs of different fingerprints within the radius meet, through the smallest set of each; equal ones too.
    lead: dict[int, int] = {}
    for r in of.values():
        if r["size"]:
            lead[r["fp"]] = min(r["set"], lead.get(r["fp"], r["set"]))
    fps = sorted(lead)
    want = {frozenset((lead[a], lead[b])) for i, a in enumerate(fps) for b in fps[i + 1 :] if ((a ^ b) & (1 << 64) - 1).bit_count() <= simhash.RADIUS}
    want |= {frozenset((lead[r["fp"]], r["set"])) for r in of.values() if r["size"] and r["set"] != lead[r["fp"]]}
    assert pairs == want and any(of[90_001]["set"] in p for p in pairs)
