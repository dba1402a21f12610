"""Language, quality and toxicity: against plain counting, on held-out rows, and on hostile ones."""

import numpy as np
import pyarrow as pa
import pytest

from docledger.llm import langid, quality, toxicity
from tests.llm.helpers import empty, fold, hostile

LARGER = "/root/testdata/sf0.1"


def _labels(spark, folder, name):
    return {r["doc_id"]: r[name] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}


def test_trigrams_of_a_batch_are_those_of_each_text():
    texts = ["Héllo, you", None, "", "x", "a1b"]
    grams, at = langid.trigrams(texts)
    for i, text in enumerate(texts):
        padded = "".join(c if c.isalpha() else "\0" for c in f" {(text or '').lower()} ")
        own = [(ord(padded[j - 1]) << 42) | (ord(padded[j]) << 21) | ord(padded[j + 1]) for j in range(1, len(padded) - 1) if padded[j] != "\0"]
        assert grams[at[i] : at[i + 1]].tolist() == own


def test_filters_know_what_plain_sets_know(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model = langid.train(docs)
    rows = docs.collect()
    counts = {}
    for lang in sorted({r["lang"] for r in rows}):
        grams = langid.trigrams([r["text"] for r in rows if r["lang"] == lang])[0]
        found, n = np.unique(grams, return_counts=True)
        counts[lang] = dict(zip(found.tolist(), (n / len(grams)).tolist()))
    assert model.langs == sorted(counts)
    most = {}
    for own in counts.values():
        for g, rate in own.items():
            most[g] = max(most.get(g, 0), rate)
    sets = [{g for g, rate in counts[x].items() if rate >= langid.LEAST_RATE and rate >= langid.LEAST_SHARE * most[g]} for x in model.langs]
    false = total = 0
    for r in rows[:60]:
        grams = langid.trigrams([r["text"]])[0]
        bits = np.unpackbits(model.languages_of(grams), axis=1, bitorder="little")
        for g, b in zip(grams.tolist(), bits.tolist()):
            for own, bit in zip(sets, b):
                assert bit or g not in own  # never a false negative
                false += bit and g not in own
                total += 1
        names, _ = model.predict([r["text"]])
        exact = [sum(g in own for g in grams.tolist()) for own in sets]
        assert exact[model.langs.index(names[0])] >= max(exact) - 1
    assert false / total < 0.01


def test_op2_held_out(spark, data):
    rows = langid.op2_language(spark, LARGER).collect()
    true = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    assert len(rows) == len(true)
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == true[r["doc_id"]] for r in held]) > 0.99


def test_language_bears_anything(spark):
    docs = hostile(spark)
    model = langid.train(docs)
    rows = {(r["doc_id"], r["text"]): r for r in langid.identify(docs, model).collect()}
    assert rows[3, None]["lang_pred"] == rows[4, ""]["lang_pred"] == rows[8, " \n\t "]["lang_pred"] == "und"
    assert rows[1, "Hello it's A TEST 123"]["lang_pred"] == "en"
    assert langid.identify(docs, langid.train(empty(spark))).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty(spark), model).collect() == []
    kept = langid.known_languages(docs, model)
    assert kept.columns == docs.columns and kept.where("lang_pred <> 'q'").count() == 0 and kept.count() == docs.count() - 3


def test_languages_beyond_a_block_are_learned_as_well(spark, monkeypatch):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text", "lang")
    whole = langid.train(docs)
    want = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, whole).collect()}
    monkeypatch.setattr(langid, "BLOCK", 2)
    parts = langid.train(docs)
    assert len(whole.langs) > 2 and [x for f in (parts, *parts.further) for x in f.langs] == whole.langs
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in langid.identify(docs, parts).collect()} == want


def test_statistics_of_a_text():
    texts = ["One two two.\nOne two two.\nABC!! xyz", None, "", "é"]
    got = [dict(zip(quality.STATISTICS, row)) for row in quality.statistics(pa.array(texts, pa.string()))]
    one, n = got[0], len(texts[0])
    assert one["log_words"] == pytest.approx(np.log1p(8)) and one["log_lines"] == pytest.approx(np.log1p(3))
    assert one["different_lines"] == pytest.approx(2 / 3) and one["newline"] == pytest.approx(2 / n)
    assert one["different_words"] == pytest.approx(5 / 8) and one["most_word"] == pytest.approx(2 / 8)
    assert one["upper"] == pytest.approx(5 / n) and one["all_capitals"] == pytest.approx(1 / 8) and one["exclaim"] == pytest.approx(2 / n)
    assert set(got[1].values()) == set(got[2].values()) == {0.0}
    alone = quality.statistics(pa.array(["ab", *texts, "cd ef"], pa.string()))[1:5]
    assert np.allclose(alone, quality.statistics(pa.array(texts, pa.string())))


def test_pooling_is_the_isotonic_fit():
    at, rate = quality.pooled(np.arange(4.0), np.array([1, 3, 1, 4.0]), np.array([4, 4, 4, 4.0]))
    assert rate.tolist() == [0.25, 0.5, 1.0] and at.tolist() == [0.0, 1.5, 3.0]


def test_op3_held_out(spark):
    rows, true = quality.op3_quality(spark, LARGER).collect(), _labels(spark, LARGER, "quality")
    assert all(r["held_out"] == (fold(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in true]
    assert np.mean([r["predicted"] == true[r["doc_id"]] for r in held]) > 0.98


def test_quality_bears_anything(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(12), 6]] + [(None, 1), (5, None)], "doc_id long, quality int")
    assert quality.classify(docs, labels).where("score between 0 and 1").count() == docs.count()
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}
    assert quality.classify(empty(spark), labels).collect() == []
    assert quality.good_rows(docs, labels.limit(0)).columns == docs.columns
    assert quality.good_rows(docs, labels.limit(0)).count() == docs.count()


def test_op10_held_out(spark):
    rows, true = toxicity.op10_toxicity(spark, LARGER).collect(), _labels(spark, LARGER, "toxic")
    assert all(r["held_out"] == (fold(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    held = [r for r in rows if r["held_out"] and r["doc_id"] in true]
    assert np.mean([r["predicted"] for r in held if true[r["doc_id"]] == 1]) > 0.85
    assert np.mean([r["predicted"] for r in held if true[r["doc_id"]] == 0]) < 0.02


def test_updates_follow_the_formula():
    state = toxicity.State(np.zeros(3), np.zeros(3))
    z, n = [0.0] * 3, [0.0] * 3
    rng = np.random.default_rng(3)
    for _ in range(200):
        label = float(rng.integers(2))
        has = [bool(label) or rng.random() < 0.1, rng.random() < 0.5, True]
        w = [0.0 if abs(a) <= toxicity.L1 else (np.sign(a) * toxicity.L1 - a) / ((toxicity.BETA + b**0.5) / toxicity.ALPHA + toxicity.L2) for a, b in zip(z, n)]
        g = 1 / (1 + np.exp(-sum(x for x, h in zip(w, has) if h))) - label
        for i in range(3):
            if has[i]:
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / toxicity.ALPHA * w[i]
                n[i] += g * g
        state.learn(np.array([i for i in range(2) if has[i]], int), label)
    assert np.allclose(state.z, z) and np.allclose(state.n, n)
    assert state.weights()[0] > 0


def test_rounds_are_plain_ftrl_in_shards_that_are_averaged(spark):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = {" ".join(rng.choice(words, 12)): float(rng.integers(2)) for _ in range(60)}
    rows = spark.createDataFrame(list(texts.items()), "text string, toxic double")
    dealt = rows.selectExpr("text", "toxic", f"pmod(xxhash64(text), {toxicity.SHARDS}) AS shard", "xxhash64(text, 7) AS o").collect()
    z, n = {}, {}  # the mixed state by slot; the constant is -1

    def weight(a, b):
        return 0.0 if abs(a) <= toxicity.L1 else (np.sign(a) * toxicity.L1 - a) / ((toxicity.BETA + b**0.5) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.ROUNDS):
        moved = []
        for shard in range(toxicity.SHARDS):
            own_z, own_n, met = dict(z), dict(n), set()
            for r in sorted((r for r in dealt if r["shard"] == shard), key=lambda r: r["o"]):
                slots = [*next(toxicity.by_text(pa.array([r["text"]]))).tolist(), -1]
                w = {s: weight(own_z.get(s, 0.0), own_n.get(s, 0.0)) for s in slots}
                g = 1 / (1 + np.exp(-sum(w.values()))) - r["toxic"]
                for s in slots:
                    a, b = own_z.get(s, 0.0), own_n.get(s, 0.0)
                    own_z[s], own_n[s] = a + g - ((b + g * g) ** 0.5 - b**0.5) / toxicity.ALPHA * w[s], b + g * g
                    met.add(s)
            moved.append((own_z, own_n, met))
        for s in set().union(*(m for _, _, m in moved)):
            those = [(a[s], b[s]) for a, b, m in moved if s in m]
            z[s], n[s] = np.mean([a for a, _ in those]), np.mean([b for _, b in those])
    model = toxicity.train(rows)
    want = {s: weight(z[s], n[s]) for s in z if s >= 0 and weight(z[s], n[s])}
    assert model.slots.tolist() == sorted(want) and len(want) > 5
    assert np.allclose(model.weights, [want[s] for s in sorted(want)], atol=1e-4)
    assert model.constant == pytest.approx(weight(z[-1], n[-1]), abs=1e-4)


def test_toxicity_bears_anything(spark):
    docs = hostile(spark)
    labels = spark.createDataFrame([(i, i % 2) for i in [*range(12), 6]] + [(None, 1), (5, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.learn(docs, labels)).where("score between 0 and 1").count() == docs.count()
    assert {r["score"] for r in toxicity.score(docs, toxicity.learn(docs, labels.limit(0))).collect()} == {0.5}
    assert toxicity.score(empty(spark), toxicity.learn(empty(spark), labels)).collect() == []


def test_toxicity_keeps_rare_slots_beside_many_frequent_ones(spark):
    rng = np.random.default_rng(1)
    clean = [" ".join(f"c{x}" for x in rng.integers(0, 1 << 40, 8_000)) for _ in range(14)]
    toxic = "zyxo wvut srqp"
    rows = spark.createDataFrame([(t, 0) for t in clean for _ in range(6)] + [(toxic, 1)] * 5, "text string, toxic int")
    scores = toxicity.train(rows).score(pa.array([toxic, clean[0]]))
    assert scores[0] > 0.5 > scores[1]
