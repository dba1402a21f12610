"""Repair of conversations: the cheapest edits that turn rows into turns of a system, a user and an assistant role.

A repaired conversation is empty, or a system row if there is one, then pairs of a user and an assistant row. Rows may be
kept (free, by their role's initial), get another role (3) or be deleted (4, which blank and repeated ones must be); empty
rows may be inserted anywhere (3); a truncated row that stays costs 3 more. Of the cheapest repairs the one whose edits,
written as initials, come first in ASCII order is taken.

1. Each row becomes one symbol: its role's initial and its first fault. Rows are dealt to ranges of (conversation, turn), so
   even one conversation of most rows is spread; each range gives pieces of at most ``PIECE`` symbols.
2. Equal pieces are solved once, wherever they come from. Re-Pair names the most frequent pair of neighbours until no
   pair occurs twice. A symbol, and a rule, has one min-plus matrix: for every state before and after, the least cost and the
   edits that have it as a rope, so a rule costs two references, whatever its length. Rules are evaluated bottom-up.
3. The pieces of a conversation are multiplied in order into one vector, which gives the cost and the edits.
4. Rows are read once more in order, next to the edits of their conversation, and come out repaired.

Edits determine the roles: inserted and renamed rows have the role that the state before them asks for. Two different edit
strings of the same rows are never prefixes of each other at equal cost, so the least of a product is the product of leasts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.shared import prepare, sha256_hex, written

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
SENTENCE_ENDS = ".!?"
# Symbols of a piece, and symbols whose rules are sought at once.
PIECE = 4096
TOGETHER = 1 << 18
# Text of a rope that is kept as it is.
FLAT = 48

# States by the last row of what is repaired so far: nothing, system, user, assistant. The first and the last may end it.
STATES = 4
ENDS = (0, 3)
# The state after a row whose role has this initial.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
# A symbol is the place of its initial in INITIALS and of its fault in FAULTS, as one letter from SYMBOLS on.
INITIALS, FAULTS = "suao", "nbdt"
SYMBOLS = 65
_MODULUS, _BASE = (1 << 61) - 1, 0x1F3D5B79A2C4E68


@dataclass(frozen=True, slots=True)
class Rope:
    """A string as a tree of strings: joining two takes constant time, and equal parts are told by their hashes."""

    size: int
    hash: int
    text: str | None
    left: Rope | None = None
    right: Rope | None = None

    @staticmethod
    def of(text: str) -> Rope:
        value = 0
        for c in text:
            value = (value * _BASE + ord(c)) % _MODULUS
        return Rope(len(text), value, text)

    def __add__(self, other: Rope) -> Rope:
        if not self.size or not other.size:
            return self if self.size else other
        value = (self.hash * pow(_BASE, other.size, _MODULUS) + other.hash) % _MODULUS
        size = self.size + other.size
        if size <= FLAT:
            return Rope(size, value, self.text + other.text)
        return Rope(size, value, None, self, other)

    def __lt__(self, other: Rope) -> bool:
        if self.size == other.size and self.hash == other.hash:
            return False
        mine, theirs = [self], [other]
        while mine and theirs:
            a, b = mine.pop(), theirs.pop()
            if a.size == b.size and a.hash == b.hash:
                continue
            if a.text is not None and b.text is not None:
                n = min(a.size, b.size)
                if a.text[:n] != b.text[:n]:
                    return a.text < b.text
                for rest, x in ((mine, a), (theirs, b)):
                    if x.size > n:
                        rest.append(Rope.of(x.text[n:]))
            else:
                # Open the longer one; a flat one waits.
                for rest, x, y in ((mine, a, b), (theirs, b, a)):
                    if x.text is None and (y.text is not None or x.size >= y.size):
                        rest += [x.right, x.left]
                    else:
                        rest.append(x)
        return bool(theirs)

    def __str__(self) -> str:
        out, left = [], [self]
        while left:
            x = left.pop()
            if x.text is not None:
                out.append(x.text)
            else:
                left += [x.right, x.left]
        return "".join(out)


Entry = tuple[int, Rope]
Matrix = list[list[Entry | None]]


def _better(a: Entry | None, b: Entry) -> bool:
    """Whether ``b`` is cheaper than ``a``, or as cheap and first in order."""
    return a is None or b[0] < a[0] or (b[0] == a[0] and b[1] < a[1])


def times(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product: for each pair of states the best way through any state between."""
    out: Matrix = [[None] * STATES for _ in a]
    for i, row in enumerate(a):
        for k, first in enumerate(row):
            if first is None:
                continue
            for j, second in enumerate(b[k]):
                if second is None:
                    continue
                cost = first[0] + second[0]
                known = out[i][j]
                if known is None or cost <= known[0]:
                    entry = (cost, first[1] + second[1])
                    if _better(known, entry):
                        out[i][j] = entry
    return out


def _insertions() -> Matrix:
    """Any number of inserted rows: the fewest from each state to each."""
    empty, one = (0, Rope.of("")), (INSERT_COST, Rope.of(INSERT))
    step: Matrix = [[empty if i == j else None for j in range(STATES)] for i in range(STATES)]
    for role in "ua":
        for i, j in STEPS[role].items():
            step[i][j] = one
    return times(step, times(step, step))


INSERTIONS = _insertions()


def symbol_matrix(symbol: int) -> Matrix:
    """One row, then any insertions."""
    initial, fault = INITIALS[(symbol - SYMBOLS) // len(FAULTS)], FAULTS[(symbol - SYMBOLS) % len(FAULTS)]
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    for i in range(STATES):
        out[i][i] = (DELETE_COST, Rope.of(DELETE))
    if fault in "nt":
        more = TRUNCATED_COST if fault == "t" else 0
        ways = [(c, RENAME_COST, REROLE) for c in "ua"] + [(initial, 0, KEEP)]
        for role, cost, edit in ways:
            for i, j in STEPS.get(role, {}).items():
                entry = (cost + more, Rope.of(edit))
                if _better(out[i][j], entry):
                    out[i][j] = entry
    return times(out, INSERTIONS)


class Grammar:
    """Rules by their pair of names, each with its matrix; names below 256 are symbols. Rules stay from call to call."""

    def __init__(self) -> None:
        self.names: dict[tuple[int, int], int] = {}
        self.matrices: dict[int, Matrix] = {}

    def matrix(self, name: int) -> Matrix:
        if name not in self.matrices:
            self.matrices[name] = symbol_matrix(name)
        return self.matrices[name]

    def rule(self, left: int, right: int) -> int:
        """The name of a pair; its matrix is the product of both, which are there already."""
        name = self.names.get((left, right))
        if name is None:
            name = self.names[left, right] = 256 + len(self.names)
            self.matrices[name] = times(self.matrix(left), self.matrix(right))
        return name

    def compress(self, pieces: list[bytes]) -> list[list[int]]:
        """Re-Pair over all pieces: the names that are left of each when no pair of neighbours occurs twice."""
        # Pieces one after another, each closed by a border of its own that pairs with nothing.
        flat = np.concatenate([np.append(np.frombuffer(p, np.uint8).astype(np.int64), -1) for p in pieces]) if pieces else np.zeros(0, np.int64)
        while len(flat) > 1:
            inside = np.flatnonzero((flat[:-1] >= 0) & (flat[1:] >= 0))
            if not len(inside):
                break
            pairs, n = np.unique((flat[inside] << 32) | flat[inside + 1], return_counts=True)
            best = int(n.argmax())
            if n[best] < 2:
                break
            left, right = int(pairs[best]) >> 32, int(pairs[best]) & 0xFFFFFFFF
            at = np.flatnonzero((flat[:-1] == left) & (flat[1:] == right))
            if left == right:  # of overlapping pairs every other one, from the left
                begins = np.concatenate(([True], np.diff(at) > 1))
                at = at[(np.arange(len(at)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
            flat[at] = self.rule(left, right)
            flat = np.delete(flat, at + 1)
        borders = np.flatnonzero(flat < 0)
        return [x.tolist() for x in (flat[a:b] for a, b in zip(np.concatenate(([0], borders[:-1] + 1)), borders, strict=True))] if pieces else []

    def solve(self, pieces: list[bytes]) -> list[Matrix]:
        """The matrix of each piece (of one symbol or more)."""
        out = []
        for names in self.compress(pieces):
            done = self.matrix(names[0])
            for name in names[1:]:
                done = times(done, self.matrix(name))
            out.append(done)
        return out


def symbol(initial: Column, fault: Column) -> Column:
    """The letter of a row."""
    letters = [[chr(SYMBOLS + i * len(FAULTS) + k) for k in range(len(FAULTS))] for i in range(len(INITIALS))]
    of_fault = [F.coalesce(*(F.when(fault == FAULTS[k], letters[i][k]) for k in range(len(FAULTS)))) for i in range(len(INITIALS))]
    known = [F.when(initial == INITIALS[i], of_fault[i]) for i in range(len(INITIALS) - 1)]
    return F.coalesce(*known, of_fault[-1])


def _rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, digest, copies) with null roles and texts as one space; ``copies`` is 1 if not given."""
    role, text = (F.coalesce(c, F.lit(" ")) for c in ("role", "text"))
    copies = F.col("copies").cast("long") if "copies" in conversations.columns else F.lit(1).cast("long")
    return conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), sha256_hex(text).alias("digest"), copies.alias("copies"))


def _symbols(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, symbol, later) of all different rows, ``n`` times each.

    ``symbol`` is that of the first of them, ``later`` that of the others.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(*SENTENCE_ENDS), "n").otherwise("t")
    narrow = _rows(conversations).select("conv_id", "turn", "role", "digest", "copies", fault.alias("fault"))
    rows = written(narrow.groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.sum("copies").alias("n")), "repair-rows")
    order = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    first = rows.where("fault <> 'b'").groupBy("conv_id", "role", "digest").agg(F.min(order).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    first = first.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("t"))
    met = rows.join(first, rows.conv_id.eqNullSafe(F.col("c")) & (rows.role == F.col("r")) & (rows.digest == F.col("d")), "left")
    seen = F.col("r").isNotNull() & (F.col("fault") != "b") & ~F.col("turn").eqNullSafe(F.col("t"))
    initial = F.substring("role", 1, 1)
    own = symbol(initial, F.when(seen, "d").otherwise(F.col("fault")))
    later = symbol(initial, F.when(F.col("fault") == "b", "b").otherwise("d"))
    return met.select("conv_id", "turn", "role", "digest", "n", own.alias("symbol"), later.alias("later"))


_PIECE = "conv_id long, seg long, symbols string, turns long, first long, last long"


def _pieces(most: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that makes pieces of the conversations in one range of sorted rows.

    A piece has at most ``most`` symbols, and the number of its different turns, the first and the last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seg = TaskContext.get().partitionId() << 32
        done: list[tuple] = []
        conv, begun, letters, turns, first, last = None, False, bytearray(), 0, None, None

        def close() -> None:
            nonlocal seg, letters, turns, first, last
            if letters:
                done.append((conv, seg, letters.decode(), turns, first, last))
                seg += 1
            letters, turns, first, last = bytearray(), 0, None, None

        def out() -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            columns = zip(*done, strict=True) if done else ([] for _ in types)
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PIECE.split(", ")])
            done.clear()
            return batch

        for batch in batches:
            for of, turn, n, own, later in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "n", "symbol", "later")), strict=True):
                if not begun or of != conv:
                    close()
                    conv, begun = of, True
                letter = own
                while n > 0:
                    if len(letters) == most:
                        close()
                    if turn is not None and turn != last:
                        turns, first, last = turns + 1, turn if first is None else first, turn
                    many = 1 if letter is own else min(n, most - len(letters))
                    letters += (letter * many).encode()
                    n -= many
                    letter = later
                if len(done) >= 500:
                    yield out()
        close()
        yield out()

    return run


_SOLVED = "symbols string, costs array<long>, edits array<string>"


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The costs and edits between all states of each different piece; null where there is no way."""
    grammar = Grammar()
    for batch in batches:
        texts = batch.column("symbols").to_pylist()
        at = 0
        while at < len(texts):
            end, size = at + 1, len(texts[at])
            while end < len(texts) and size + len(texts[end]) <= TOGETHER:
                size += len(texts[end])
                end += 1
            if len(grammar.names) > TOGETHER:
                grammar = Grammar()
            flat = [[e for row in m for e in row] for m in grammar.solve([t.encode() for t in texts[at:end]])]
            costs = pa.array([[e and e[0] for e in m] for m in flat], pa.list_(pa.int64()))
            edits = pa.array([[e and str(e[1]) for e in m] for m in flat], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(texts[at:end]), costs, edits], ["symbols", "costs", "edits"])
            at = end


_REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One report for each conversation from its pieces in order."""
    legal = {"su", "ua", "au"}
    done: list[tuple] = []
    state: dict | None = None

    def close() -> None:
        if state is not None:
            cost, audit = min((state["row"][0][k] for k in ENDS if state["row"][0][k] is not None), key=lambda e: (e[0], str(e[1])))
            gaps = state["last"] - state["first"] + 1 - state["turns"] if state["turns"] else 0
            done.append((state["conv"], gaps, *(state[f] for f in "bdt"), state["illegal"], cost, str(audit)))

    def out() -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.string()]
        columns = zip(*done, strict=True) if done else ([] for _ in types)
        batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _REPORT.split(", ")])
        done.clear()
        return batch

    for batch in batches:
        names = ("conv_id", "symbols", "turns", "first", "last", "costs", "edits")
        for conv, letters, turns, first, last, costs, edits in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
            if state is None or conv != state["conv"]:
                close()
                state = {"conv": conv, "row": [INSERTIONS[0]], "before": None, "turns": 0, "first": None, "last": None, "illegal": 0, "b": 0, "d": 0, "t": 0}
            matrix = [[None if costs[i * STATES + j] is None else (costs[i * STATES + j], Rope.of(edits[i * STATES + j])) for j in range(STATES)] for i in range(STATES)]
            state["row"] = times(state["row"], matrix)
            places = np.frombuffer(letters.encode(), np.uint8) - SYMBOLS
            for k, fault in enumerate(FAULTS[1:], 1):
                state[fault] += int((places % len(FAULTS) == k).sum())
            roles = [INITIALS[k] for k in (places // len(FAULTS)).tolist()]
            before = [] if state["before"] is None else [state["before"]]
            pairs = zip([*before, *roles[:-1]], roles if before else roles[1:], strict=True)
            state["illegal"] += sum(a + b not in legal for a, b in pairs)
            state["before"] = roles[-1]
            if turns:
                state["turns"] += turns - (state["last"] == first)
                state["first"] = first if state["first"] is None else state["first"]
                state["last"] = last
            if len(done) >= 1000:
                yield out()
    close()
    yield out()


def reports(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of (conv_id, turn, role, text[, copies]), null included: its faults, the cost and the edits of its repair.

    Rows are taken by turn, null ones first; rows of one turn by role, then by a digest of the text; ``copies`` (1) says how
    often a row stands there. Null roles and texts are one space. Other columns are not read. ``piece`` bounds the symbols of a
    piece.
    """
    prepare(conversations.sparkSession)
    rows = _symbols(conversations)
    ranged = rows.repartitionByRange("conv_id", "turn", "role", "digest").sortWithinPartitions("conv_id", "turn", "role", "digest")
    pieces = written(ranged.select("conv_id", "turn", "n", "symbol", "later").mapInArrow(_pieces(piece), _PIECE), "repair-pieces")
    solved = pieces.select("symbols").distinct().mapInArrow(_solve, _SOLVED)
    dealt = pieces.join(solved, "symbols").repartition("conv_id").sortWithinPartitions("conv_id", "seg")
    return dealt.select("conv_id", "symbols", "turns", "first", "last", "costs", "edits").mapInArrow(_fold, _REPORT)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repaired rows from sorted ones: the edits of a conversation come before its rows."""
    out: list[tuple] = []
    size = 0
    conv, audit, at, state, place = None, "", 0, 0, 0

    def put(role: str, text: str) -> None:
        nonlocal state, place, size
        out.append((conv, place, role, text))
        size += len(text) + 40
        state = STEPS[role[:1]][state]
        place += 1

    def asked() -> str:
        return "assistant" if state == 2 else "user"

    def insert() -> None:
        nonlocal at
        while at < len(audit) and audit[at] == INSERT:
            put(asked(), "")
            at += 1

    def batch_of() -> pa.RecordBatch:
        nonlocal size
        types = [pa.int64(), pa.int64(), pa.string(), pa.string()]
        columns = zip(*out, strict=True) if out else ([] for _ in types)
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", "place", "role", "text"])
        out.clear()
        size = 0
        return done

    for batch in batches:
        for of, edits, role, text, copies in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "audit", "role", "text", "copies")), strict=True):
            if edits is not None:
                insert()
                conv, audit, at, state, place = of, edits, 0, 0, 0
                continue
            for _ in range(copies):
                insert()
                edit = audit[at]
                at += 1
                if edit == KEEP:
                    put(role, text)
                elif edit == REROLE:
                    put(asked(), text)
                if size > 4 << 20:
                    yield batch_of()
    insert()
    yield batch_of()


def repaired(conversations: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text) of the repaired conversations; ``found`` are their ``reports``.

    Every text is moved once, and comes out in order: rows of a conversation are in one partition, by ascending place. Rows
    stream through a task, so a conversation is never held as a whole.
    """
    none = F.lit(None)
    rows = _rows(conversations).withColumn("audit", none.cast("string"))
    heads = found.select("conv_id", none.cast("long").alias("turn"), none.cast("string").alias("role"), none.cast("string").alias("text"), none.cast("string").alias("digest"), F.lit(0).cast("long").alias("copies"), "audit")
    both = rows.unionByName(heads).withColumn("is_row", F.col("audit").isNull())
    dealt = both.repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "digest")
    return dealt.select("conv_id", "audit", "role", "text", "copies").mapInArrow(_walk, "conv_id long, place long, role string, text string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, repaired_sha256) of ordered rows: the digest of role:text, joined by line feeds."""
    conv, digest, done = None, None, []
    for batch in batches:
        for of, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if digest is not None:
                    done.append((conv, digest.hexdigest()))
                conv, digest = of, hashlib.sha256()
            digest.update(("\n" * (place > 0) + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["conv_id", "repaired_sha256"])
        done = []
    last = [] if digest is None else [(conv, digest.hexdigest())]
    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in last], pa.int64()), pa.array([d for _, d in last], pa.string())], ["conv_id", "repaired_sha256"])


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) with faults by the checksum of conv_id and turn: one row in five has one.

    Nulls are one space, in the checksum as well. Dropped rows are missing, repeated ones have two copies.
    """
    blank = F.lit(" ")
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), blank) for c in ("conv_id", "turn")))
    kind = F.crc32(key) % 20
    role, text = (F.coalesce(c, blank) for c in ("role", "text"))
    changed = F.when(kind == 1, "").when(kind == 2, F.translate(text, SENTENCE_ENDS, "")).otherwise(text)
    rows = conversations.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"), changed.alias("text"), F.when(kind == 3, 2).otherwise(1).alias("copies"), kind.alias("kind"))
    return rows.where("kind <> 0").drop("kind")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, damaged and repaired: faults, cost, edits and the digest of what is repaired."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    return summaries(given)


def summaries(given: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each conv_id of ``given``: the report of its damaged rows, and the digest of the repaired ones."""
    rows = damaged(given)
    found = written(reports(rows, piece), "repair-reports")
    digests = repaired(rows, found).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    out = given.select("conv_id").distinct()
    for i, table in enumerate((found, digests)):
        out = out.join(table.withColumnRenamed("conv_id", f"c{i}"), F.col("conv_id").eqNullSafe(F.col(f"c{i}")), "left").drop(f"c{i}")
    nothing = hashlib.sha256().hexdigest()
    return out.select("conv_id", *(F.coalesce(c, F.lit(0)).alias(c) for c in counts), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by one fold over the rows of each conversation: for every state the least (cost, edits, repaired rows)."""
    far = "{'c': 1000000000, 'a': '', 't': ''}"
    states = [f"s.e{k}" for k in range(STATES)]

    def add(entry: str, cost: int | str, edits: str, lines: str) -> str:
        return f"{{'c': {entry}.c + {cost}, 'a': {entry}.a || '{edits}', 't': {entry}.t || {lines}}}"

    def closed(entries: list[str]) -> list[str]:
        user, answer = "chr(10) || 'user:'", "chr(10) || 'assistant:'"
        second = [entries[2], *(add(entries[k], INSERT_COST, "I", user) for k in (0, 1, 3))]
        third = [entries[3], add(entries[2], INSERT_COST, "I", answer), *(add(entries[k], 2 * INSERT_COST, "II", f"{user} || {answer}") for k in (0, 1))]
        return [entries[0], entries[1], f"list_min([{', '.join(second)}])", f"list_min([{', '.join(third)}])"]

    def packed(entries: list[str]) -> str:
        return "{" + ", ".join(f"'e{k}': {e}" for k, e in enumerate(entries)) + "}"

    def stay(entry: str, role: str) -> list[str]:
        kept, new = ("K", "chr(10) || r.role || ':' || r.text"), ("R", f"chr(10) || '{role}:' || r.text")
        more = f"CASE r.fault WHEN 't' THEN {TRUNCATED_COST} ELSE 0 END"
        out = [f"CASE WHEN r.fault IN ('n', 't') AND r.initial = '{role[0]}' THEN {add(entry, f'({more})', *kept)} ELSE {far} END"]
        if role != "system":
            out.append(f"CASE WHEN r.fault IN ('n', 't') THEN {add(entry, f'({RENAME_COST} + {more})', *new)} ELSE {far} END")
        return out

    ways = [[add(e, DELETE_COST, "D", "''")] for e in states]
    for role in ("system", "user", "assistant"):
        for i, j in STEPS[role[0]].items():
            ways[j] += stay(states[i], role)
    row = packed([f"list_min([{', '.join(w)}])" for w in ways])
    begun = packed(["{'c': 0, 'a': '', 't': ''}", far, far, far])
    step = f"list_transform([{row}], lambda s: {packed(closed(states))})[1]"
    start = f"list_transform([{begun}], lambda s: {packed(closed(states))})[1]"
    blanks = " || ".join(f"chr({ord(c)})" for c in BLANKS)
    return f"""
WITH crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, CAST(i AS BIGINT))) AS t
), given AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
        list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS key
    FROM conversations
), kinds AS (
    SELECT given.*, xor(list_reduce(key, lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1]), 4294967295), 4294967295) % 20 AS kind FROM given, crc
), damaged AS (
    SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text, unnest(range(CASE kind WHEN 3 THEN 2 ELSE 1 END)) AS copy
    FROM kinds WHERE kind <> 0
), marked AS (
    SELECT *, left(role, 1) AS initial, rtrim(text, {blanks}) AS bare, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
        left(lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy), 1) AS before,
        lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) IS NOT NULL AS follows
    FROM damaged
), faults AS (
    SELECT *, CASE WHEN bare = '' THEN 'b' WHEN seen > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'n' ELSE 't' END AS fault FROM marked
), folded AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
        count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
        count(*) FILTER (follows AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
        list_reduce(list({{'role': role, 'text': text, 'initial': initial, 'fault': fault}} ORDER BY turn NULLS FIRST, role, sha256(text), copy), lambda s, r: {step}, {start}) AS s
    FROM faults GROUP BY conv_id
), best AS (
    SELECT folded.*, list_min([s.e0, s.e3]) AS e FROM folded
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
    coalesce(illegal, 0) AS illegal, CAST(coalesce(e.c, 0) AS BIGINT) AS cost, coalesce(e.a, '') AS audit, sha256(coalesce(substr(e.t, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best ON c.conv_id IS NOT DISTINCT FROM best.conv_id
"""


OP12_SQL = _sql()
