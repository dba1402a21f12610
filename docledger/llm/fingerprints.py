"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points. Runs of one symbol become one symbol; deterministic coin tossing gives every symbol a
label that depends on a few symbols to its left (twice the lowest bit in which it differs from its neighbour, plus
that bit), repeated until labels are below eight. A phrase begins where labels peak, and its name is a hash of its
symbols. Names are the symbols of the next level. Where phrases begin depends on nearby symbols alone, so equal substrings
are cut alike inside, wherever they stand, and share their interior names.

Levels are built until one phrase is left, the root, whose name stands for the whole text. The fingerprint holds the root's
name and, for each of ``SKETCHED`` levels, the ``KEPT`` smallest different names: two texts are as alike as the names of
their smallest ones are shared, the root being one more, averaged over the levels. So only equal texts have likeness 1. By
sampling, the error of a level's likeness J has a standard deviation of the square root of J (1 - J) / ``KEPT``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docledger.llm.ordered import range_of
from docledger.llm.shared import mix, powers, prepare

# Levels are numbered from 1, the phrases of code points; the last sketched level's phrases have some 30 characters.
SKETCHED = (2, 3)
KEPT = 32
# Characters parsed at once.
CHUNK = 1 << 19
_DIGITS = 8


def _next_labels() -> np.ndarray:
    """Coin tossing between two labels below 128: twice the lowest differing bit, plus that bit of the right one."""
    right, left = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differing = right ^ left
    lowest = np.where(differing > 0, np.log2(np.maximum(differing & -differing, 1)), 0).astype(np.int64)
    return (2 * lowest + (right >> lowest & 1)).astype(np.uint8)


_TOSS = _next_labels()


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels below eight, different for different neighbours in a row. ``first`` marks the first symbol of each row."""
    before = np.concatenate((symbols[:1], symbols[:-1]))
    differing = symbols ^ before
    differing[first] = np.uint64(1)
    lowest = np.log2((differing & (~differing + np.uint64(1))).astype(np.float64), where=differing != 0, out=np.zeros(len(symbols))).astype(np.uint64)
    labels = (lowest * np.uint64(2) + ((symbols >> lowest) & np.uint64(1))).astype(np.uint8)
    for _ in range(2):
        before = np.concatenate((labels[:1], labels[:-1]))
        before[first] = labels[first] ^ 1
        labels = _TOSS[labels, before]
    return labels


def _level(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One level: names of the phrases of all rows (offsets n + 1), and their offsets."""
    if not len(symbols):
        return symbols, at
    # Runs of one symbol become one symbol, named by the symbol and the length.
    start = np.concatenate(([True], symbols[1:] != symbols[:-1]))
    begins = at[:-1][at[:-1] < at[1:]]
    start[begins] = True
    head = np.flatnonzero(start)
    length = np.diff(np.append(head, len(symbols)))
    runs = np.where(length > 1, mix(symbols[head] + length.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)), symbols[head])
    rank = np.cumsum(start) - 1
    at = np.append(rank, len(runs))[at]
    first = np.zeros(len(runs), bool)
    begins = at[:-1][at[:-1] < at[1:]]
    first[begins] = True
    labels = _toss(runs, first)
    peak = first.copy()
    if len(runs) > 2:
        peak[1:-1] |= (labels[1:-1] > labels[:-2]) & (labels[1:-1] > labels[2:]) & ~first[2:]
    head = np.flatnonzero(peak)
    phrase = np.cumsum(peak) - 1
    place = np.arange(len(runs)) - head[phrase]
    names = mix(np.add.reduceat(mix(runs) * powers(int(place.max()) + 1, 0x9E3779B97F4A7C15)[place], head) + np.uint64(len(SKETCHED)))
    return names, np.append(phrase, len(names))[at]


def _smallest(names: np.ndarray, at: np.ndarray) -> list[list[int]]:
    """The ``KEPT`` smallest different names of each row, cut to 32 bits, ascending."""
    n = len(at) - 1
    row = np.repeat(np.arange(n, dtype=np.uint64), np.diff(at))
    key = np.unique((row << np.uint64(32)) | (names >> np.uint64(32)))
    bound = np.searchsorted(key, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    values = (key & np.uint64(0xFFFFFFFF)).tolist()
    return [values[a : min(b, a + KEPT)] for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True)]


def parse(texts: list[str]) -> Iterator[tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]]:
    """(names, offsets) of each level from 1 to the last one sketched, and the roots' names, for chunks of texts in order.

    The root of a text without characters is 0.
    """
    for a, b in _chunks(texts):
        symbols = np.frombuffer("".join(texts[a:b]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        at = np.concatenate(([0], np.cumsum([len(t) for t in texts[a:b]])))
        levels, roots = [], np.zeros(b - a, np.uint64)
        own = np.arange(b - a)  # rows that have no root yet
        while len(levels) < max(SKETCHED) or len(own):
            symbols, at = _level(symbols, at)
            sizes = np.diff(at)
            if len(levels) < max(SKETCHED):
                levels.append((symbols, at))
            done = (sizes == 1) & (roots[own] == 0)
            roots[own[done]] = symbols[at[:-1][done]]
            # Rows of one phrase stay until the last sketched level is there.
            if len(levels) == max(SKETCHED):
                more = sizes > 1
                symbols = symbols[np.repeat(more, sizes)]
                own, at = own[more], np.concatenate(([0], np.cumsum(sizes[more])))
        yield levels, roots


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if size and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if start < len(texts):
        yield start, len(texts)


def fingerprints(texts: list[str]) -> list[str]:
    """The fingerprint of each text: its root and its sketches in hexadecimal, joined by dashes. That of the empty text has no sketches."""
    out: list[str] = []
    for levels, roots in parse(texts):
        sketches = [_smallest(*levels[k - 1]) for k in SKETCHED]
        own = zip(map("{:016x}".format, roots.tolist()), *sketches, strict=True)
        out += ["-".join([root, *("".join(map("{:08x}".format, s)) for s in rest)]) for root, *rest in own]
    return out


def likeness(one: str, other: str) -> float:
    """How alike two fingerprints are, from 0 to 1: the share of common names among the smallest of both and the roots, over all levels."""
    if one == other:
        return 1.0
    total = 0.0
    (root, *mine), (beside, *theirs) = one.split("-"), other.split("-")
    for a, b in zip(mine, theirs, strict=True):
        x, y = ({s[i : i + _DIGITS] for i in range(0, len(s), _DIGITS)} for s in (a, b))
        smallest = sorted(x | y)[:KEPT]
        total += (sum(v in x and v in y for v in smallest) + (root == beside)) / (len(smallest) + 1)
    return total / len(SKETCHED)


_PAIRED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the beginning of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _pair_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one task, sorted by range and id: each is paired with the next one of its range."""
    held: tuple[int, int | None, str, str] | None = None  # range, id, text, fingerprint of a row whose next is not seen yet
    for batch in batches:
        parts, heads, ids = (batch.column(c).to_pylist() for c in ("part", "is_head", "doc_id"))
        texts = [t or "" for t in batch.column("text").to_pylist()]
        prints = fingerprints(texts)
        pairs: list[tuple[int | None, str, str, str, str]] = []
        for part, head, doc, text, own in zip(parts, heads, ids, texts, prints, strict=True):
            if held is not None and held[0] == part:
                pairs.append((held[1], held[2], held[3], text, own))
                held = None
            if not head:  # the first row of the following range only serves as the next of the last one here
                held = part, doc, text, own
        edits = [_edited(text, following) for _, text, _, following, _ in pairs]
        columns: list[list] = [[] for _ in range(7)]
        for (doc, text, own, _, following), edit, changed in zip(pairs, edits, fingerprints(edits), strict=True):
            digest = hashlib.sha256(edit.encode("utf-8", "surrogatepass")).hexdigest()
            for column, value in zip(columns, (doc, len(text), digest, own, changed, likeness(own, changed), likeness(own, following)), strict=True):
                column.append(value)
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in _PAIRED.split(", ")])


def with_next(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edit, and how near both and the next document's are.

    Documents are in ascending order of doc_id (null ids first, equal ids by a hash of the text), the first follows the
    last; a single document follows itself. Null texts are empty. Texts are dealt to ranges of ids once; the first row of
    each range is also sent to the range before, so no task needs another one's rows.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("order"), range_of(docs).alias("part"))
    # One row for each range: where its first documents also go. There is a fixed most of ranges.
    firsts = rows.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("has"), "doc_id")).alias("first")).orderBy("part").collect()
    parts = [r["part"] for r in firsts]
    before = [parts[i - 1] for i in range(len(parts))]
    table = spark.createDataFrame([(p, r["first"]["doc_id"], b) for p, r, b in zip(parts, firsts, before, strict=True)], "part int, first long, before int")
    heads = rows.join(F.broadcast(table), "part").where(F.col("doc_id").eqNullSafe(F.col("first"))).select("doc_id", "text", "order", F.col("before").alias("part"))
    both = rows.withColumn("is_head", F.lit(False)).unionByName(heads.withColumn("is_head", F.lit(True)))
    dealt = both.repartition("part").sortWithinPartitions("part", "is_head", F.asc_nulls_first("doc_id"), "order")
    return dealt.select("part", "is_head", "doc_id", "text").mapInArrow(_pair_rows, _PAIRED)


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edit, and their likeness."""
    return with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
