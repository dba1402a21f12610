"""Tables of routes against a plain search, and against the tree of types."""

import random

from docledger.operators import classify as cl, routes as rt

FEATURES = ["kind", "lang", "tables"]
SCHEMA = "kind STRING, lang STRING, tables STRING, extractor STRING, params MAP<STRING,STRING>, rules MAP<STRING,STRING>, min_confidence DOUBLE, version BIGINT"
DOCS = "doc_id BIGINT, kind STRING, lang STRING, tables BOOLEAN, type_confidence DOUBLE, extractor STRING"


def _plain(doc, table):
    """The most specific match by a walk over all routes."""
    values = [doc[1], doc[2], None if doc[3] is None else str(doc[3]).lower()]
    best = None
    for r in table:
        if all(p is None or p == v for p, v in zip(r[:3], values, strict=True)):
            fixed = [p is not None for p in r[:3]]
            rank = (sum(fixed), sum(1 << i for i, f in enumerate(fixed) if f), r[7])
            if best is None or rank > best[0] or (rank == best[0] and r[3] < best[1][3]):
                best = (rank, r)
    if best is None or (best[1][6] is not None and doc[4] is not None and doc[4] < best[1][6]):
        return "default", {}
    return best[1][3], best[1][5] or {}


def _table(rng, n):
    some = lambda options: rng.choice([None, *options])
    kinds, langs = [f"k{i}" for i in range(12)], [f"l{i}" for i in range(14)]
    return [(some(kinds), some(langs), some(["true", "false"]), f"x{rng.randrange(500)}", None, some([{"total": f"r{i}"}]), some([0.5]), rng.randrange(3)) for i in range(n)]


def _documents(rng, n):
    return [(i, rng.choice([None, "", *(f"k{j}" for j in range(13))]), rng.choice([None, *(f"l{j}" for j in range(15))]), rng.choice([None, True, False]), rng.choice([None, 0.2, 0.9]), "old") for i in range(n)]


def test_the_most_specific_of_a_thousand_routes_decides(spark):
    rng = random.Random(5)
    # Routes of one pattern, version and extractor may differ in their rules: here they are the same route.
    table = list({(*r[:4], r[7]): r for r in _table(rng, 1_200)}.values())
    docs = _documents(rng, 600)
    got = rt.routed(spark.createDataFrame(docs, DOCS), spark.createDataFrame(table, SCHEMA), FEATURES, "type_confidence")
    assert got.columns == ["doc_id", "kind", "lang", "tables", "type_confidence", "extractor", "params", "rules"]
    found = {r.doc_id: (r.extractor, r.rules) for r in got.collect()}
    assert len(found) == 600 and found == {d[0]: _plain(d, table) for d in docs}
    assert len({e for e, _ in found.values()}) > 50


def test_without_routes_or_documents(spark):
    docs = spark.createDataFrame(_documents(random.Random(1), 4), DOCS)
    none = spark.createDataFrame([], SCHEMA)
    assert {(r.extractor, len(r.params)) for r in rt.routed(docs, none, FEATURES).collect()} == {("default", 0)}
    assert rt.routed(docs.limit(0), none, FEATURES).count() == 0


def test_changes_take_the_place_of_the_same_pattern(spark):
    old = spark.createDataFrame([("a", None, None, "one", None, None, None, 9), ("b", None, None, "two", None, None, None, 0)], SCHEMA)
    new = spark.createDataFrame([("a", None, None, "three", None, None, None, 0), ("a", "x", None, "four", None, None, None, 0)], SCHEMA)
    got = rt.upserted(old, new, FEATURES)
    assert sorted((r.kind, r.lang or "", r.extractor) for r in got.collect()) == [("a", "", "three"), ("a", "x", "four"), ("b", "", "two")]


def test_a_tree_is_a_table_of_routes(spark):
    tree = cl.update_tree(cl.default_tree(), ["receipt", "language", "fr"], cl.RouteNode("french", {"p": "1"}))
    tree = cl.update_tree(tree, ["order", "has_line_items", "true"], cl.RouteNode("rows"))
    rows = [(i, t, lang, tab, li, c) for i, (t, lang, tab, li, c) in enumerate((t, lang, tab, li, c) for t in ("adobe_json", "invoice", "receipt", "order", "unknown", None) for lang in ("en", "fr", "xx", None) for tab in (True, False, None) for li in (True, None) for c in (0.3, 0.9))]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, doc_type STRING, language STRING, has_tables BOOLEAN, has_line_items BOOLEAN, type_confidence DOUBLE")
    want = {r.doc_id: (r.extractor, r.params) for r in cl.route_tree(docs, tree).collect()}
    got = {r.doc_id: (r.extractor, r.params) for r in rt.routed(docs, rt.tree_routes(spark, tree), rt.TREE_FEATURES, "type_confidence").collect()}
    assert got == want and {e for e, _ in want.values()} == {"adobe_json", "default", "french", "rows"}


def test_rules_of_a_route_find_fields(spark):
    docs = spark.createDataFrame([(1, "receipt", "Total: 5.00"), (2, "note", "Total: 6.00")], "doc_id BIGINT, kind STRING, text STRING")
    table = spark.createDataFrame([("receipt", "slips", {"total": r"Total: ([0-9.]+)"})], "kind STRING, extractor STRING, rules MAP<STRING,STRING>")
    got = {r.doc_id: r.fields for r in cl.routed_fields(rt.routed(docs, table, ["kind"])).collect()}
    assert got == {1: {"total": "5.00"}, 2: {}}


def test_frequent_keys_meet_their_routes_by_a_broadcast(spark, monkeypatch):
    rng = random.Random(8)
    table = list({(*r[:4], r[7]): r for r in _table(rng, 900)}.values())
    docs = _documents(rng, 900)
    monkeypatch.setattr(rt, "FREQUENT", 5)
    for most in (4, 10_000):
        monkeypatch.setattr(rt, "MOST_FREQUENT", most)
        got = rt.routed(spark.createDataFrame(docs, DOCS), spark.createDataFrame(table, SCHEMA), FEATURES, "type_confidence")
        assert {r.doc_id: (r.extractor, r.rules) for r in got.collect()} == {d[0]: _plain(d, table) for d in docs}
    # Only keys asked for more than five times are taken out, and spread.
    asked = spark.createDataFrame([(str(i), 1, "a") for i in range(40)] + [("x", 1, "b")], "_pattern STRING, _mask INT, _k0 STRING")
    keys = spark.createDataFrame([(1, "a", "ra"), (1, "b", "rb")], "_mask INT, _k0 STRING, _route STRING")
    found = rt._matched(asked, keys, ["_mask", "_k0"])
    assert sorted(map(tuple, found.collect())) == sorted([(str(i), 1, "ra") for i in range(40)] + [("x", 1, "rb")])
