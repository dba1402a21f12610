"""Repair of conversations against all edit strings, a plain dynamic program, and rows that any operator has to bear."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docledger.llm import repair

SCHEMA = "conv_id long, turn long, role string, text string"
GOOD = re.compile(r"(s?(ua)+)?")


def _marked(rows):
    """(role, text, fault) of (turn, role, text) rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        fault = "b" if not bare else "d" if (role, text) in seen else "n" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def _cheapest(marked):
    """(cost, edits, repaired rows) by a dynamic program over plain strings."""
    best = {0: (0, "", [])}  # by state: 0 nothing, 1 system, 2 user, 3 assistant
    steps = {("s", 0): 1, ("u", 0): 2, ("u", 1): 2, ("u", 3): 2, ("a", 2): 3}

    def inserted(states):
        for _ in range(4):
            for state, (cost, edits, rows) in list(states.items()):
                for role in ("user", "assistant"):
                    to = steps.get((role[0], state))
                    if to is not None and (cost + 3, edits + "I") < states.get(to, (10**9, ""))[:2]:
                        states[to] = (cost + 3, edits + "I", [*rows, f"{role}:"])
        return states

    best = inserted(best)
    for role, text, fault in marked:
        after = {}

        def put(to, entry):
            if to is not None and entry[:2] < after.get(to, (10**9, ""))[:2]:
                after[to] = entry

        for state, (cost, edits, rows) in best.items():
            put(state, (cost + 4, edits + "D", rows))
            if fault in "nt":
                more = 3 * (fault == "t")
                put(steps.get((role[:1], state)), (cost + more, edits + "K", [*rows, f"{role}:{text}"]))
                for new in ("user", "assistant"):
                    put(steps.get((new[0], state)), (cost + 3 + more, edits + "R", [*rows, f"{new}:{text}"]))
        best = inserted(after)
    return min((best[k] for k in (0, 3) if k in best), key=lambda e: e[:2])


def _report(rows):
    """The report of one conversation's rows (turn, role, text), in any order."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
    marked = _marked(rows)
    cost, edits, lines = _cheapest(marked)
    turns = [r[0] for r in rows if r[0] is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    counts = [sum(m[2] == f for m in marked) for f in "bdt"]
    return (gaps, *counts, illegal, cost, edits), hashlib.sha256("\n".join(lines).encode()).hexdigest()


def _damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        kept = out.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if kind:
            text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
            kept += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def _check(spark, rows, **options):
    got = {r["conv_id"]: (tuple(r[1:8]), r["repaired_sha256"]) for r in repair.summaries(spark.createDataFrame(rows, SCHEMA), **options).collect()}
    assert got == {conv: _report(own) for conv, own in _damaged(rows).items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suao"), st.sampled_from("nbdt")), max_size=5))
def test_the_cheapest_edits_of_all(rows):
    """Every edit string of a few rows: the least by cost, then by order."""
    best = None
    steps = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
    for edits in _strings(rows):
        state, cost, at, fine = 0, 0, 0, True
        for e in edits:
            role = "a" if state == 2 else "u"
            if e == "I":
                cost, state = cost + 3, steps[role][state]
                continue
            initial, fault = rows[at]
            at += 1
            if e == "D":
                cost += 4
            elif fault in "bd":
                fine = False
                break
            else:
                role = initial if e == "K" else role
                if state not in steps.get(role, {}):
                    fine = False
                    break
                cost, state = cost + 3 * (e == "R") + 3 * (fault == "t"), steps[role][state]
        if fine and state in (0, 3) and (best is None or (cost, edits) < best):
            best = cost, edits
    piece = "".join(chr(repair.SYMBOLS + 4 * repair.INITIALS.index(i) + repair.FAULTS.index(f)) for i, f in rows).encode()
    matrix = repair.Grammar().solve([piece])[0] if piece else repair.INSERTIONS
    row = repair.times([repair.INSERTIONS[0]], matrix)[0]
    cost, audit = min((row[k] for k in repair.ENDS if row[k]), key=lambda e: (e[0], str(e[1])))
    assert (cost, str(audit)) == best


def _strings(rows):
    for edits in itertools.product("KRD", repeat=len(rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            yield "".join("I" * g + e for g, e in zip(gaps, [*edits, ""], strict=True))


def test_ropes_are_strings():
    rng = random.Random(1)
    ropes = [(repair.Rope.of(t), t) for t in ("", "D", "K", "DK" * 20, "I")]
    for _ in range(300):
        (a, x), (b, y) = rng.choice(ropes), rng.choice(ropes)
        if len(x) + len(y) < 5_000:
            ropes.append((a + b, x + y))
    for a, x in ropes[::7]:
        assert str(a) == x and a.size == len(x)
        for b, y in ropes[::11]:
            assert (a < b) == (x < y)


def test_rules_replace_every_pair_that_occurs_twice():
    rng = random.Random(2)
    pieces = [bytes(rng.choices(b"AEI", k=rng.randrange(1, 60))) for _ in range(30)] + [b"A" * 33, b"AAA"]
    grammar = repair.Grammar()
    left = grammar.compress(pieces)
    names = {v: k for k, v in grammar.names.items()}

    def text(name):
        return bytes([name]) if name < 256 else b"".join(map(text, names[name]))

    assert [b"".join(map(text, own)) for own in left] == pieces
    assert len(grammar.names) > 20
    pairs = [p for own in left for i, p in enumerate(itertools.pairwise(own)) if i == 0 or own[i - 1 : i + 1] != list(p)]
    assert len(pairs) == len(set(pairs))


def test_conversations_of_any_kind(spark):
    rng = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "u", "sys"]
    texts = ["Yes.", "no", "", " \n", None, "What?", "a. ", "a.\x1c", "é!", "x" * 3_000 + "."]
    rows = []
    for conv in range(120):
        rows += [(conv, rng.choice([t, t, t, None, 3]), rng.choice(roles[: rng.choice([3, 8])]), rng.choice(texts)) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi."), (None, None, None, None), (-5, 9, "user", "same")] + [(700, k, "user", "same text.") for k in range(30)]
    rows += [(800, 5, "user", "repeated.")] * 40
    _check(spark, rows)


@pytest.mark.parametrize("piece", [1, 7])
def test_pieces_of_one_conversation_make_it_whole(spark, piece):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant", "user", "system"]), rng.choice(["Fine.", f"so {t}", f"Good {t}.", ""])) for t in range(400)] + [(2, 1, "user", "One.")]
    _check(spark, rows, piece=piece)


def test_repaired_rows_are_a_conversation(spark, data):
    rows = repair.damaged(spark.read.parquet(f"{data}/conversations.parquet"))
    found = repair.reports(rows)
    out = {}
    for r in repair.repaired(rows, found).collect():
        out.setdefault(r["conv_id"], []).append((r["place"], r["role"]))
    assert len(out) > 10
    for own in out.values():
        own.sort()
        assert [p for p, _ in own] == list(range(len(own))) and GOOD.fullmatch("".join(role[0] for _, role in own))


def test_empty_tables_and_names_in_use(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert repair.summaries(nothing).collect() == []
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", "x", 3, 4)], SCHEMA + ", digest string, fault int, symbol int")
    assert len(repair.summaries(wide).collect()) == 1
