"""SimHash groups, licences, decontamination, fingerprints and chat against brute force."""

import hashlib
import itertools
import random

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import chat, components, decontaminate, fingerprints, licenses, simhash
from tests.llm.helpers import empty, hostile, lower, words


def _union(edges, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return {n: find(n) for n in nodes}


def _plain_simhash(text):
    parts = lower(text).encode().split()
    if not parts:
        return 0
    shingles = [b" ".join(parts[i : i + 3]) for i in range(max(1, len(parts) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_links_are_all_pairs_within_the_radius(spark):
    rng = random.Random(5)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for _ in range(12):
        seed = rng.getrandbits(64)
        for _ in range(25):
            fps.add(seed ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    fps |= {1 << b for b in range(64)}  # a dense ball: pairs at distance two, and one from zero
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    got = [(r["a"], r["b"]) for r in simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long")).collect()]
    want = {(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3}
    assert len(got) == len(set(got)) and set(got) == want


def test_variants_of_few_fingerprints_are_not_broadcast(spark):
    # Two thousand fingerprints are small; their variants are two hundred times as many, which Spark's sizes do not tell.
    plan = simhash.links(spark.range(2000).withColumnRenamed("id", "fp"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(70)] + [(1000, i) for i in range(1001, 1100)] + [(2000, 2000), (2001, 2002), (2002, 2001)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "u long, v long"), "t").collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == _union([e for e in edges if e[0] != e[1]], nodes)
    assert components.components(spark.createDataFrame([], "u long, v long"), "t").collect() == []


def test_op4_on_all_documents(spark, data):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    fps = {d: _plain_simhash(t) for d, t in docs.items()}
    root = _union([(a, b) for a in docs for b in docs if a < b and (fps[a] ^ fps[b]).bit_count() <= 3], sorted(docs))
    rows = simhash.op4_simhash(spark, data).collect()
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows} == {(d, f"{fps[d]:016x}", root[d]) for d in docs}
    assert len(rows) == len(docs)


def test_simhash_bears_anything(spark):
    docs = hostile(spark)
    rows = simhash.groups(docs).collect()
    assert len(rows) == docs.count()
    assert {r["component_id"] for r in rows if r["fp"] == 0} == {3}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    got = sorted((r["doc_id"] or 0, r["text"]) for r in kept.select("doc_id", "text").collect() if r["text"])
    assert [d for d, _ in got] == [0, 1, 5, 6, 6, 9, 10]  # texts 3, 4 and 8 have no words: the first of them is null
    assert simhash.groups(empty(spark)).collect() == simhash.keep_one(empty(spark)).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("cc by general public license all rights reserved x".split()), max_size=30))
def test_base_phrases_are_all_found(text):
    known = licenses.automaton()
    base, _ = known.scan([w.encode() for w in text])
    want = sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(text)) if text[i : i + len(phrase.split())] == phrase.split())
    assert sorted((at, known.labels[p]) for at, p in base) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=8), min_size=1, max_size=4))
def test_matches_are_the_longest_runs(text, templates):
    known = licenses.Automaton([(f"t{i}", " ".join(t)) for i, t in enumerate(templates)], [])
    found = {}
    known._read(0, [known.number.get(w.encode(), 0) for w in text], [], found)
    runs = [max((n for n in range(1, i + 1) if any(text[i - n : i] == t[k : k + n] for t in templates for k in range(len(t)))), default=0) for i in range(1, len(text) + 1)]
    ends = [i for i in range(len(text)) if runs[i] >= licenses.LEAST_MATCH and (i + 1 == len(text) or runs[i + 1] <= runs[i])]
    want = {(i + 1, t, k + runs[i]) for i in ends for t, words_ in enumerate(templates) for k in range(len(words_)) if words_[k : k + runs[i]] == text[i + 1 - runs[i] : i + 1]}
    assert {(stop, t, end) for t, rows in found.items() for stop, end, _ in rows} == want


def test_spans_cover_templates_with_gaps(spark):
    notice = licenses.TEMPLATES[0][1].split()
    text = " ".join(["word"] * 5 + notice[:4] + ["inserted"] + notice[4:] + ["after"])
    spans = licenses.automaton().scan(words_bytes(text))[1]
    assert [(s.start, s.stop, s.label) for s in spans] == [(5, 5 + len(notice) + 1, "apache")]
    assert licenses.automaton().scan(words_bytes("the software is a good program for you and the license"))[1] == []


def words_bytes(text):
    return [w.encode() for w in words(text)]


def test_op5_base_columns_on_all_documents(spark, data):
    rows = {r["doc_id"]: r for r in licenses.op5_licenses(spark, data).collect()}
    for d in spark.read.parquet(f"{data}/documents.parquet").collect():
        own = words(d["text"])
        places = sorted((i, label) for label, phrase in licenses.PHRASES for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split())
        r = rows.pop(d["doc_id"])
        assert (r["n_words"], r["n_base"]) == (len(own), len(places))
        assert (r["first_word"], r["last_word"]) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
        assert {x for x in r["base_labels"].split(",") if x} <= set(r["labels"].split(","))
    assert not rows


def test_licenses_bear_anything(spark):
    docs = hostile(spark)
    assert licenses.scan(docs).where("n_base = 0").count() == docs.count()
    assert licenses.scan(empty(spark)).collect() == []


def _plain_hits(text, items):
    own, hit, names = words(text), set(), set()
    for name, item in items:
        w = words(item)
        k = min(13, len(w))
        for s in range(len(w) - k + 1 if w else 0):
            for i in range(len(own) - k + 1):
                if own[i : i + k] == w[s : s + k]:
                    hit.update(range(i, i + k))
                    names.add(str(name))
    return len(own), len(hit), sorted(names)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=60), st.lists(st.lists(st.sampled_from("abcd"), max_size=18), max_size=5))
def test_search_finds_every_window(text, items):
    items = [(str(i), " ".join(t)) for i, t in enumerate(items)]
    own = [w.encode() for w in text]
    spans, names = decontaminate.Benchmark(items).scan(own)
    assert (len(own), sum(b - a for a, b in spans), names) == _plain_hits(" ".join(text), items)


def test_blocks_of_the_benchmark_find_the_same(spark, data, monkeypatch):
    docs, benchmark = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/benchmark.parquet")
    whole = {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.search(docs, benchmark).collect()}
    monkeypatch.setattr(decontaminate, "BLOCK_CHARS", 3_000)
    assert {(r["doc_id"], r["n_hit"], tuple(r["items"])) for r in decontaminate.search(docs, benchmark).collect()} == whole
    assert any(x[1] for x in whole)


def test_decontamination_bears_anything(spark):
    docs = hostile(spark)
    items = spark.createDataFrame([(1, "same TEXT here"), (1, "brown fox the"), (2, None), (3, ""), (None, "monde"), (4, "..."), (5, "fox the quick brown " * 9)], "item_id long, text string")
    rows = decontaminate.search(docs, items).collect()
    given = [("" if i["item_id"] is None else i["item_id"], i["text"]) for i in items.collect()]
    for r in rows:
        if r["doc_id"] != 5:
            n, hit, names = _plain_hits(r["text"], given)
            assert (r["n_words"], r["n_hit"], r["items"], r["contaminated"]) == (n, hit, names, hit > 0 and 20 * hit >= n)
        else:
            assert r["items"] == ["1", "5"] and r["contaminated"]
    assert decontaminate.search(docs, items.limit(0)).where("contaminated or n_hit > 0").count() == 0
    kept = decontaminate.clean_rows(docs, items)
    assert kept.columns == docs.columns and kept.count() == len([r for r in rows if not r["contaminated"]])
    assert decontaminate.clean_rows(empty(spark), items).collect() == []


def test_equal_substrings_share_interior_names():
    rng = random.Random(2)
    shared = "".join(rng.choices("abcdefgh  ", k=4_000))
    for lead in ("", "x", "lorem ipsum ", "z" * 77):
        a = next(fingerprints.parse([shared]))[0]
        b = next(fingerprints.parse([lead + shared + "tail"]))[0]
        for (x, _), (y, _) in zip(a, b):
            inside = set(x[6:-6].tolist())
            assert len(inside & set(y.tolist())) >= 0.97 * len(inside)
    one, other = fingerprints.fingerprints([shared, shared[:3_500] + "".join(rng.choices("abcdefgh  ", k=500))])
    assert fingerprints.likeness(one, one) == 1 and 0.5 < fingerprints.likeness(one, other) < 1
    assert fingerprints.fingerprints([shared, "q", shared]) == [one, fingerprints.fingerprints(["q"])[0], one]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab \n", max_size=40), max_size=6))
def test_a_fingerprint_does_not_depend_on_its_batch(texts):
    assert fingerprints.fingerprints(texts) == [fingerprints.fingerprints([t])[0] for t in texts]


def _mixed(x):
    return int(fingerprints.mix(np.array([x % (1 << 64)], np.uint64))[0])


def _toss(own, before):
    differing = own ^ before
    lowest = (differing & -differing).bit_length() - 1
    return 2 * lowest + (own >> lowest & 1)


def _plain_level(symbols):
    """One level of phrases, symbol by symbol."""
    runs = []
    for s, group in itertools.groupby(symbols):
        n = len(list(group))
        runs.append(s if n == 1 else _mixed(s + n * 0xC2B2AE3D27D4EB4F))
    labels = [_toss(x, runs[i - 1] if i else x ^ 1) for i, x in enumerate(runs)]
    for _ in range(2):
        labels = [_toss(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    heads = [i for i in range(len(runs)) if i == 0 or (i + 1 < len(runs) and labels[i - 1] < labels[i] > labels[i + 1])]
    names = []
    for a, b in zip(heads, [*heads[1:], len(runs)], strict=True):
        names.append(_mixed(sum(_mixed(x) * pow(0x9E3779B97F4A7C15, k, 1 << 64) for k, x in enumerate(runs[a:b])) + 2))
    return names


def _plain_fingerprint(text):
    symbols, sketches, root, level = [ord(c) for c in text], [], 0, 0
    while level < 3 or len(symbols) > 1:
        symbols, level = _plain_level(symbols) if symbols else [], level + 1
        root = symbols[0] if len(symbols) == 1 and not root else root
        if level in (2, 3):
            sketches.append("".join(f"{x:08x}" for x in sorted({x >> 32 for x in symbols})[:32]))
    return "-".join([f"{root:016x}", *sketches])


def test_fingerprints_are_those_of_a_plain_parser():
    rng = random.Random(4)
    texts = ["", "a", "ab", "aaaa", "aab", "abcabcabc", "🙂é中" * 9, *("".join(rng.choices("abc de", k=k)) for k in range(1, 300, 13)), "".join(rng.choices("abcdefgh ", k=4_000))]
    assert fingerprints.fingerprints(texts) == [_plain_fingerprint(t) for t in texts]


def test_one_other_sentence_gives_another_fingerprint():
    rng = random.Random(6)
    for n in (50, 5_000, 300_000):
        words = [f"w{rng.randrange(3_000)}" for _ in range(n)]
        other = [*words[: n // 2], *(f"v{i}" for i in range(10)), *words[n // 2 + 10 :]]
        one, two = fingerprints.fingerprints([" ".join(words), " ".join(other)])
        assert one != two and (0.5 if n > 50 else 0.1) < fingerprints.likeness(one, two) < 1


def _plain_pairs(rows):
    out = []
    for i, (doc, text) in enumerate(rows):
        following = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edit = text[: len(text) - half] + following[:half]
        own, changed, nxt = fingerprints.fingerprints([text, edit, following])
        out.append((doc, len(text), hashlib.sha256(edit.encode()).hexdigest(), own, changed, fingerprints.likeness(own, changed), fingerprints.likeness(own, nxt)))
    return out


def test_op8_on_all_documents(spark, data, monkeypatch):
    monkeypatch.setattr("docledger.llm.ordered.ROWS", 16)
    docs = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{data}/documents.parquet").collect())
    assert sorted(map(tuple, fingerprints.op8_fingerprints(spark, data).collect())) == _plain_pairs(docs)


def test_fingerprints_bear_anything(spark):
    docs = hostile(spark)
    rows = fingerprints.with_next(docs).collect()
    assert len(rows) == docs.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    assert fingerprints.with_next(empty(spark)).collect() == []
    alone = fingerprints.with_next(docs.where("doc_id = 1")).collect()
    assert [tuple(r) for r in alone] == _plain_pairs([(1, "Hello it's A TEST 123")])


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "[X]<"]), st.text(alphabet="ab\\[]</>({sINST ", max_size=30)), max_size=8))
def test_formatting_reads_back(turns):
    formatted, mask = chat.format_turns(turns)
    assert chat.read_turns(formatted) == turns
    assert chat.loss_text(formatted, mask) == "".join(t for r, t in turns if r == "assistant")


def test_the_best_branch_of_each_tree(spark):
    schema = "tree long, node string, parent string, score double, role string, text string, turns int, up string"
    rows = [(1, "a", None, 1.0, "user", "q"), (1, "b", "a", 0.0, "assistant", "bad"), (1, "c", "a", 5.0, "assistant", "good"), (1, "d", "c", 3.0, "user", "more"), (1, "e", "c", 3.0, "user", "tie")]
    rows += [(2, "x", "gone", None, "user", None), (3, "m", "n", 1.0, "user", "loop"), (3, "n", "m", 1.0, "user", "loop"), (None, "z", None, 0.0, None, "z")]
    messages = spark.createDataFrame([(*r, 1, "u") for r in rows], schema)
    got = {(r["tree"], r["rank"]): [t["text"] for t in r["turns"]] for r in chat.best_paths(messages, top=2).collect()}
    assert got == {(1, 1): ["q", "good", "more"], (1, 2): ["q", "good", "tie"], (2, 1): [None], (None, 1): ["z"]}
    assert chat.best_paths(messages.limit(0)).collect() == []
    done = chat.formatted(chat.best_paths(messages)).collect()
    assert len(done) == 3 and all(r["formatted"].startswith(chat.BEGIN) for r in done)


def test_op9_is_its_sql(spark, data):
    import duckdb

    con = duckdb.connect()
    con.register("conversations", pq.read_table(f"{data}/conversations.parquet"))
    want = con.sql(chat.OP9_SQL)
    rows = chat.op9_chat(spark, data).select(*want.columns).collect()
    assert sorted(map(tuple, rows)) == sorted(want.fetchall())
    assert any(r["conv_id"] == -7 and r["loss_chars"] == 21 for r in rows)


@pytest.mark.parametrize("turns", [[(0, 2, "user", "b"), (0, 1, "system", None), (0, 2, "assistant", "a"), (None, None, None, "c"), (0, 2, "user", "b")]])
def test_chains_bear_ties_and_nulls(spark, turns):
    rows = chat.best_paths(chat.chains(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))).collect()
    assert {r["tree"]: [(t["role"], t["text"]) for t in r["turns"]] for r in rows} == {0: [("system", None), ("assistant", "a"), ("user", "b"), ("user", "b")], None: [(None, "c")]}
