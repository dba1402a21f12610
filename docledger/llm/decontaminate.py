"""Benchmark decontamination by multi-pattern search over words, with block shift tables.

Test strings are the windows of ``WINDOW`` consecutive words of the benchmark's items (an item of fewer words is one window).
Windows of equal length share a searcher. It looks at the last two words of the position under test: the shift table says
how far the position can move without missing any window; where it says zero, the bucket of that pair of words holds the
windows that end with it, and they are compared word by word. A word that no window holds moves the position by a whole
window.

The benchmark is read in blocks of at most ``BLOCK_CHARS`` characters (an item counts as one piece), so what a worker holds
is bounded; every block is searched in every document, and the documents' texts are never shuffled.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.shared import prepare, sha256_hex

WINDOW = 13
# A document is contaminated if at least one word in this many is hit.
ONE_IN = 20
BLOCK_CHARS = 16 << 20
# Entries of a shift table.
TABLE = 1 << 16

_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")
_FOUND = "struct<n_words: long, spans: array<struct<start: long, stop: long>>, items: array<string>>"


def words_of(text: str | None) -> list[bytes]:
    """Words of a text: A to Z lower-cased, then runs of digits, letters a to z and characters beyond ASCII."""
    return _WORD.findall((text or "").encode("utf-8", "surrogatepass").lower())


@dataclass
class _Searcher:
    """Shift table and buckets of the windows of one length."""

    length: int
    shift: bytearray = field(default_factory=bytearray)
    buckets: dict[int, list[tuple[list[bytes], list[int]]]] = field(default_factory=dict)

    def build(self, windows: dict[tuple[bytes, ...], set[int]], number: dict[bytes, int]) -> None:
        size = min(2, self.length)
        self.shift = bytearray([self.length - size + 1]) * TABLE
        for window, items in windows.items():
            ids = [number[w] for w in window]
            for end in range(size - 1, self.length):
                at = self.block(ids[end - 1] if size == 2 else 0, ids[end])
                self.shift[at] = min(self.shift[at], self.length - 1 - end)
            self.buckets.setdefault(self.block(ids[-2] if size == 2 else 0, ids[-1]), []).append((list(window), sorted(items)))

    @staticmethod
    def block(before: int, last: int) -> int:
        """The table entry of two neighbouring words, given by their numbers."""
        return (before * 40503 + last * 2654435761) % 4294967291 % TABLE

    def search(self, words: list[bytes], numbers: list[int | None]) -> Iterator[tuple[int, list[int]]]:
        """(first word, items) of every occurrence, in order."""
        length, shift, block, pairs = self.length, self.shift, self.block, self.length > 1
        at, n = length - 1, len(words)
        while at < n:
            last = numbers[at]
            if last is None:
                at += length
                continue
            before = numbers[at - 1] if pairs else 0
            if before is None:
                at += length - 1
                continue
            key = block(before, last)
            if move := shift[key]:
                at += move
                continue
            start = at - length + 1
            for window, items in self.buckets.get(key, ()):
                if words[start : at + 1] == window:
                    yield start, items
                    break  # windows are different, so no other one stands here
            at += 1


class Benchmark:
    """Searchers over the windows of some items, for each length of window."""

    def __init__(self, items: list[tuple[str, str | None]]) -> None:
        self.names = [name for name, _ in items]
        self.number: dict[bytes, int] = {}
        by_length: dict[int, dict[tuple[bytes, ...], set[int]]] = {}
        for i, (_, text) in enumerate(items):
            words = words_of(text)
            for w in words:
                self.number.setdefault(w, len(self.number) + 1)
            length = min(WINDOW, len(words))
            for at in range(len(words) - length + 1 if words else 0):
                by_length.setdefault(length, {}).setdefault(tuple(words[at : at + length]), set()).add(i)
        self.searchers = []
        for length, windows in sorted(by_length.items()):
            self.searchers.append(_Searcher(length))
            self.searchers[-1].build(windows, self.number)

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], list[str]]:
        """(spans of hit words, names of the items found), both sorted; spans neither touch nor overlap."""
        numbers = list(map(self.number.get, words))
        hits: list[tuple[int, int]] = []
        found: set[int] = set()
        for searcher in self.searchers:
            for start, items in searcher.search(words, numbers):
                hits.append((start, start + searcher.length))
                found.update(items)
        return merged(hits), sorted({self.names[i] for i in found})


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans made one, in order."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = out[-1][0], max(stop, out[-1][1])
        else:
            out.append((start, stop))
    return out


def _blocks(benchmark: DataFrame) -> list[list[tuple[str, str | None]]]:
    """(item id as text, text) of all items with words, in blocks of bounded size; one block if there is none."""
    items = benchmark.where("text is not null").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = -(-chars // BLOCK_CHARS) or 1
    block = F.pmod(F.xxhash64("item", "text"), F.lit(n))
    return [[(r["item"], r["text"]) for r in items.where(block == i).orderBy("item", "text").collect()] for i in range(n)]


_KNOWN: dict[str, Benchmark] = {}


def _known(key: str, sent: Broadcast) -> Benchmark:
    """The searchers of a block, built once by each Python worker; only the last block is kept."""
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Benchmark(sent.value)
    return _KNOWN[key]


def _scanner(sent: Broadcast, key: str) -> Callable[..., Column]:
    """The function that scans texts for one block of the benchmark."""

    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = _known(key, sent)
        for batch in batches:
            rows = []
            for text in batch.to_pylist():
                words = words_of(text)
                spans, names = known.scan(words)
                rows.append({"n_words": len(words), "spans": [{"start": a, "stop": b} for a, b in spans], "items": names})
            yield pa.array(rows, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), ("items", pa.list_(pa.string()))]))

    return arrow_udf(scanned, _FOUND)


def search(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Add n_words, spans, items, n_hit and contaminated to ``docs``; columns of these names are replaced.

    ``spans`` are the hit words as [start, stop) ranges counted from 0, ``items`` the ids, as text, of the items that occur.
    A null or empty text has no words and no hits. Items without words hit nothing; items with equal ids count once; a
    null id is the empty text. An empty benchmark hits nothing.
    """
    spark = prepare(docs.sparkSession)
    found: Column | None = None
    for items in _blocks(benchmark):
        sent = spark.sparkContext.broadcast(items)

        name = f"__found{0 if found is None else 1}"
        docs = docs.withColumn(name, _scanner(sent, uuid.uuid4().hex)("text"))
        if found is None:
            found = F.col(name)
        else:
            docs = docs.withColumn("__found0", arrow_udf(_joined, _FOUND)("__found0", "__found1")).drop("__found1")
    docs = docs.withColumns({k: F.col(f"__found0.{k}") for k in ("n_words", "spans", "items")}).drop("__found0")
    docs = docs.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["stop"] - x["start"]))
    return docs.withColumn("contaminated", (F.col("n_hit") > 0) & (F.lit(ONE_IN) * F.col("n_hit") >= F.col("n_words")))


def _joined(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """What two blocks of the benchmark have found, as one."""
    for left, right in batches:
        rows = []
        for a, b in zip(left.to_pylist(), right.to_pylist(), strict=True):
            spans = merged([(s["start"], s["stop"]) for s in a["spans"] + b["spans"]])
            rows.append({"n_words": a["n_words"], "spans": [{"start": s, "stop": e} for s, e in spans], "items": sorted({*a["items"], *b["items"]})})
        yield pa.array(rows, left.type)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows that are not contaminated. Columns stay."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "text")
    return search(packed, benchmark).where(~F.col("contaminated")).select("__row.*")


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each document that stand in a window of the benchmark."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha256_hex(F.array_join(F.array_sort("items"), ",")).alias("items_sha256"), "contaminated"
    )


OP6_SQL = """
WITH d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
    FROM documents
), b AS (
    SELECT item_id, w, least(13, len(w)) AS k FROM (
        SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
        FROM benchmark
    ) WHERE len(w) > 0
), windows AS (
    SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS words FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)
), places AS (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM windows) AS lengths WHERE len(w) >= k)
), hits AS (
    SELECT doc_id, item_id, k, i FROM places JOIN windows USING (k, words)
), words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), items AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
