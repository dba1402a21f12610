"""Byte-pair encoding and decoding with the vocabulary of a public tokenizer file.

A piece of text becomes a doubly linked list of symbols. A priority queue holds the rank of every adjacent pair that the
merge list knows; the lowest rank is merged first, leftmost among equals. A merge changes the neighbours' pairs, so queue
entries can go stale: an entry is skipped when its left symbol is gone or when the pair it saw is no longer there.
Decoding puts the vocabulary strings of the ids together.

The rank table is a file of a few megabytes with a fixed size, read once by each Python worker. Pieces repeat, so each
worker keeps the ids of the pieces it has met, up to a limit; beyond that the memo starts anew. That bounds memory and never
changes a result.

Texts of plain characters are cut a batch at a time, by classes of bytes. A piece of up to ``SHORT`` bytes is two numbers,
which are looked up in a table of the pieces met last; what is not there goes to the memo, each different piece once a batch.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from docledger.llm.shared import LOWER, prepare, sha256_hex, utf8

# Pieces an encoder remembers before it forgets all of them, and those that each worker of ``encode`` does; a piece takes some 200
# bytes. Workers share an executor's memory with a JVM that other stages have filled.
MAX_PIECES = 900_000
KEPT_PIECES = 300_000
# Bytes of text that ``encode`` takes at once: arrays beside a text take some twenty times its size.
SLICE = 1 << 19

# Stands between vocabulary strings; byte-level vocabularies have no control characters.
_BETWEEN = "\x01"

# Bits of a symbol in a pair of symbols, and of a place in a queue entry.
SHIFT, PLACE = 24, 40
PLACES = (1 << PLACE) - 1

# Bytes of a piece that has numbers of its own, places of the table of such pieces, and bytes that are cut at once.
SHORT = 15
TABLE_BITS = 20
WINDOW = 1 << 21

# Fixed values of the tokenizer file: contractions that are pieces of their own.
CONTRACTIONS = ["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"]

# Texts of these characters alone are unchanged by NFC and have the same letters, digits and blanks in every Unicode
# version: ASCII without the four separators 1C-1F, and the Latin letters of U+00C0 to U+017F that lower-case to one.
_PLAIN_LETTERS = "".join(c for c in map(chr, range(0xDF, 0x180)) if c.islower())
_CAPITALS = "".join(c for c in map(chr, range(0xC0, 0x180)) if c.isupper() and c.lower() in _PLAIN_LETTERS)

# Classes of the bytes of plain texts in lower case; bytes beyond ASCII belong to letters.
_BLANK, _LETTER, _DIGIT, _OTHER = range(4)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[list(b" \t\n\r\x0b\x0c")], _CLASS[0x61:0x7B], _CLASS[0x80:], _CLASS[0x30:0x3A] = _BLANK, _LETTER, _LETTER, _DIGIT
# The two bytes of a letter of U+00C0 to U+017F in lower case, by its first byte and the low bits of its second; 0 if it is not plain.
_LEADS = range(0xC3, 0xC6)
_LATIN = np.zeros((len(_LEADS), 64), np.uint16)
for _c in _PLAIN_LETTERS + _CAPITALS:
    _first, _second = _c.encode()
    _LATIN[_first - _LEADS[0], _second & 63] = int.from_bytes(_c.lower().encode(), "big")
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def _byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable in Latin-1, else the next code point from 256 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b if b in own else next(spare)) for b in range(256)]


@dataclass
class Encoder:
    """Rank table, vocabulary and the memo of one tokenizer file."""

    path: str
    limit: int | None = None
    ids: dict[str, int] = field(default_factory=dict)
    ranks: dict[int, int] = field(default_factory=dict)
    merged: list[int] = field(default_factory=list)
    strings: list[str] = field(default_factory=list)
    special: dict[str, int] = field(default_factory=dict)
    suffix: str = ""
    memo: dict[str, int] = field(default_factory=dict)

    def __post_init__(self) -> None:
        with open(self.path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids = model["vocab"]
        self.suffix = model["end_of_word_suffix"] or ""
        for rank, (left, right) in enumerate(model["merges"]):
            self.ranks[self.ids[left] << SHIFT | self.ids[right]] = rank
            self.merged.append(self.ids[left + right])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = [""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for text, at in [*self.ids.items(), *self.special.items()]:
            self.strings[at] = text
        self._library = tokenizers.Tokenizer.from_file(self.path)
        self._byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        self._bytes = [self.ids[c] for c in _byte_symbols()]
        self._last = [self.ids[c + self.suffix] for c in _byte_symbols()]
        self._splitter = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self._marks = [text.encode() for text in self.special]
        self._forget()

    def _forget(self) -> None:
        self.memo.clear()
        self._flat = array("i")
        self._ends = array("q", [0])
        self._arrays: tuple[np.ndarray, np.ndarray] | None = None
        # Numbers of the pieces met last, and their places; no piece has length 0.
        self._known = np.zeros((1 << TABLE_BITS, 2), np.uint64)
        self._place = np.zeros(1 << TABLE_BITS, np.int32)
        for text, at in self.special.items():  # never produced by the piece patterns
            self._put("\0" + text, [at])

    def _put(self, key: str, ids: Iterable[int]) -> int:
        self._flat.extend(ids)
        self._ends.append(len(self._flat))
        self.memo[key] = at = len(self._ends) - 2
        return at

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the lowest-ranked pair is merged until no adjacent pair has a rank."""
        raw = piece.encode()
        symbol = [self._bytes[b] for b in raw]
        symbol[-1] = self._last[raw[-1]]
        n = len(symbol)
        if n == 1:
            return symbol
        rank_of, merged_of = self.ranks.get, self.merged
        # An entry is rank and place in one number, so that entries compare by rank, then from left to right.
        queue = []
        for at in range(n - 1):
            if (rank := rank_of(symbol[at] << SHIFT | symbol[at + 1])) is not None:
                queue.append(rank << PLACE | at)
        heapq.heapify(queue)
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        while queue:
            entry = heapq.heappop(queue)
            rank, at = entry >> PLACE, entry & PLACES
            nxt = after[at]
            # Stale: the left symbol was swallowed, or the pair at this place is another one now.
            if nxt < 0 or (left := symbol[at]) < 0 or rank_of(left << SHIFT | symbol[nxt]) != rank:
                continue
            symbol[at] = merged = merged_of[rank]
            symbol[nxt] = -1
            after[at] = far = after[nxt]
            if far >= 0:
                before[far] = at
                if (rank := rank_of(merged << SHIFT | symbol[far])) is not None:
                    heapq.heappush(queue, rank << PLACE | at)
            if (back := before[at]) >= 0 and (rank := rank_of(symbol[back] << SHIFT | merged)) is not None:
                heapq.heappush(queue, rank << PLACE | back)
        return [s for s in symbol if s >= 0]

    def pieces(self, text: str) -> list[str]:
        """The text normalised (NFC, lower case) and cut into pieces; special tokens come out with a leading NUL."""
        if self._splitter is not None and any(map(text.__contains__, self.special)):
            out: list[str] = []
            for i, part in enumerate(self._splitter.split(text)):
                out += ["\0" + part] if i % 2 else self._cut(part)
            return out
        return self._cut(text)

    def _cut(self, text: str) -> list[str]:
        # What is a letter, a number or a blank depends on the version of Unicode: the library's own tables decide.
        cut = self._library.pre_tokenizer.pre_tokenize_str(self._library.normalizer.normalize_str(text))
        return [bytes(map(self._byte_of.__getitem__, piece)).decode() for piece, _ in cut]

    def places(self, pieces: list[str]) -> list[int]:
        """Memo places of the pieces, encoding those not met before."""
        memo = self.memo
        out = list(map(memo.get, pieces))
        if None in out:
            for i, at in enumerate(out):
                if at is None:
                    piece = pieces[i]
                    at = memo.get(piece)
                    out[i] = self._put(piece, self.merge(piece)) if at is None else at
            self._arrays = None
        return out

    def _short(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Memo places of the pieces [start, end) of a window; ``low`` has 16 more bytes than its pieces need."""
        length = ends - starts
        words = np.ndarray((len(low) - 8,), "<u8", low, 0, (1,))
        keys = np.empty((len(starts), 2), np.uint64)
        keys[:, 0] = words[starts] & _MASKS[np.minimum(length, 8)]
        keys[:, 1] = (words[starts + 8] & _MASKS[np.clip(length - 8, 0, 7)]) | (length.astype(np.uint64) << np.uint64(56))
        slot = ((keys[:, 0] * np.uint64(0x9E3779B97F4A7C15)) ^ (keys[:, 1] * np.uint64(0xC2B2AE3D27D4EB4F))) >> np.uint64(64 - TABLE_BITS)
        slot = slot.astype(np.int64)
        places = self._place[slot].astype(np.int64)
        missed = np.flatnonzero((self._known[slot] != keys).any(axis=1) | (length > SHORT))
        if len(missed):
            raw, found = low.tobytes(), {}
            at = []
            for a, b in zip(starts[missed].tolist(), ends[missed].tolist(), strict=True):
                piece = raw[a:b]
                place = found.get(piece)
                if place is None:
                    text = piece.decode()
                    place = self.memo.get(text)
                    found[piece] = place = self._put(text, self.merge(text)) if place is None else place
                at.append(place)
            places[missed] = at
            self._arrays = None
            kept = missed[length[missed] <= SHORT]
            # One piece for each place of the table: the last one met.
            one = np.unique(slot[kept][::-1], return_index=True)[1]
            kept = kept[::-1][one]
            self._known[slot[kept]], self._place[slot[kept]] = keys[kept], places[kept]
        return places

    def _plain(self, raw: np.ndarray, rows: np.ndarray, slow: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(memo places of the pieces of all plain rows, number of pieces of each row); bytes of ``slow`` rows have none."""
        places, firsts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(raw):
            end = min(at + WINDOW, len(raw))
            while end < len(raw) and _CLASS[raw[end]] != _BLANK:
                inside = _CLASS[raw[end : end + 4096]] != _BLANK
                end += len(inside) if inside.all() else int(np.argmin(inside))
            low = np.zeros(end - at + 16, np.uint8)
            low[:-16] = LOWER[raw[at:end]]
            lead = np.flatnonzero((low >= _LEADS[0]) & (low <= _LEADS[-1]))
            pair = _LATIN[low[lead] - _LEADS[0], low[lead + 1] & 63]
            low[lead], low[lead + 1] = pair >> 8, pair & 255
            kind = _CLASS[low[:-16]]
            for k in slow[(rows[slow] < end) & (rows[slow + 1] > at)].tolist():
                kind[max(rows[k] - at, 0) : rows[k + 1] - at] = _BLANK
            border = np.zeros(end - at + 1, bool)
            border[rows[(rows >= at) & (rows <= end)] - at] = True
            border[0] = True
            cut = border[:-1] | (kind == _DIGIT)
            cut[1:] |= kind[1:] != kind[:-1]
            starts = np.flatnonzero(cut)
            ends = np.append(starts[1:], end - at)
            real = kind[starts] != _BLANK
            starts, ends = starts[real], ends[real]
            starts, ends = self._contracted(low, starts, ends, border)
            places.append(self._short(low, starts, ends))
            firsts.append(starts + at)
            at = end
        return np.concatenate(places), np.diff(np.searchsorted(np.concatenate(firsts), rows))

    @staticmethod
    def _contracted(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, border: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pieces with contractions: a lone apostrophe takes the first letters of the word after it, if they are one."""
        lone = np.flatnonzero((low[starts[:-1]] == 0x27) & (ends[:-1] - starts[:-1] == 1) & (starts[1:] == ends[:-1])) if len(starts) > 1 else starts[:0]
        lone = lone[~border[ends[lone]]]
        if not len(lone):
            return starts, ends
        took = np.zeros(len(lone), np.int64)
        letters = ends[lone + 1] - starts[lone + 1]
        for text in CONTRACTIONS:
            own = text[1:].encode()
            same = letters >= len(own)
            for k, c in enumerate(own):
                same &= low[starts[lone] + 1 + k] == c
            took[same & (took == 0)] = len(own)
        starts, ends = starts.copy(), ends.copy()
        ends[lone] += took
        starts[lone + 1] += took
        left = starts < ends
        return starts[left], ends[left]

    def _slow_rows(self, raw: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows with characters that are not plain, or with a special token."""
        high = np.flatnonzero(raw >= 0x80)
        byte = raw[high]
        lead = (byte >= _LEADS[0]) & (byte <= _LEADS[-1])
        latin = np.zeros(len(high), bool)
        latin[lead] = _LATIN[byte[lead] - _LEADS[0], raw[high[lead] + 1] & 63] > 0
        before = raw[high - 1]
        latin |= (byte < 0xC0) & (before >= _LEADS[0]) & (before <= _LEADS[-1])
        odd = [high[~latin], np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
        text = raw.tobytes()
        for mark in self._marks:
            at = text.find(mark)
            while at >= 0:
                odd.append(np.array([at]))
                at = text.find(mark, at + 1)
        return np.unique(np.searchsorted(rows, np.concatenate(odd), side="right") - 1)

    def encode_batch(self, texts: list[str | None] | pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets n + 1)."""
        most = MAX_PIECES if self.limit is None else min(self.limit, MAX_PIECES)
        if len(self.memo) > most or len(self._flat) > 8 * most:
            self._forget()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        raw, rows = utf8(texts)
        slow = self._slow_rows(raw, rows)
        at, many = self._plain(raw, rows, slow)
        if len(slow):
            found = {int(k): self.places(self.pieces(texts[int(k)].as_py())) for k in slow}
            bounds = np.concatenate(([0], np.cumsum(many)))
            at = np.concatenate([np.asarray(found[k], np.int64) if k in found else at[bounds[k] : bounds[k + 1]] for k in range(len(texts))])
            many[slow] = [len(found[int(k)]) for k in slow]
        flat, bounds = self.tables()
        lengths = bounds[at + 1] - bounds[at]
        stops = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.arange(stops[-1]) + np.repeat(bounds[at] - stops[:-1], lengths)]
        return ids, stops[np.concatenate(([0], np.cumsum(many)))]

    def encode_slices(self, texts: pa.Array) -> pa.ListArray:
        """Ids of every text, of rows of ``SLICE`` bytes together, or of a longer row, at a time."""
        _, rows = utf8(texts)
        ids, lengths = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(rows, rows[at] + SLICE, side="right")) - 1)
            found, offsets = self.encode_batch(texts.slice(at, end - at))
            ids.append(found)
            lengths.append(np.diff(offsets))
            at = end
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(lengths))))
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate(ids), pa.int32()))

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """All remembered ids and the bounds of each place, as arrays."""
        if self._arrays is None:
            self._arrays = np.array(self._flat, np.int32), np.array(self._ends, np.int64)
        return self._arrays

    def encode(self, text: str | None) -> list[int]:
        """Ids of one text."""
        return self.encode_batch([text])[0].tolist()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file; one for each file and Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path, KEPT_PIECES)
    return _ENCODERS[path]


def encode(docs: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of every whole text. A null or empty text has no ids. ``out`` is replaced if present."""

    @arrow_udf(ArrayType(IntegerType(), False))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = encoder(path)
        for batch in batches:
            yield coder.encode_slices(batch)

    prepare(docs.sparkSession)
    return docs.withColumn(out, ids_of(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the vocabulary strings of every list of ids, joined by one space as a tokenizer without decoder does.

    Null or no ids give the empty text; an id outside the vocabulary is left out. ``out`` is replaced if present. The
    vocabulary is a constant of the plan: its size is that of the tokenizer file, whatever the input.
    """
    strings = F.split(F.lit(_BETWEEN.join(encoder(path).strings)), _BETWEEN)
    texts = F.transform(F.coalesce(F.col(ids), F.array().cast("array<int>")), lambda i: F.get(strings, i))
    return docs.withColumn(out, F.array_join(texts, " "))


def vocabulary_path() -> str:
    """The word-level vocabulary of the public tokenizers."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every document: encoded, then decoded from the ids.

    One row for each row of ``docs``, repeated ids included; null and empty texts have no tokens. Columns of ``docs``
    other than doc_id and text are not read.
    """
    coded = decode(encode(docs.select("doc_id", "text"), path).drop("text"), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        sha256_hex(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_sha256"),
        sha256_hex(F.col("decoded")).alias("decoded_sha256"),
    )


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, encoded and decoded with the word vocabulary."""
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
