"""Language identification by bit-sliced Bloom filters of character trigrams.

One filter answers for all languages at once: slot ``p`` holds one bit for each language, and the conjunction of an n-gram's
``HASHES`` slots is the set of languages that contain it. A text's n-grams are looked up, the bits are counted for each
language, each count is corrected for that filter's rate of false positives, and the largest corrected count decides.

Training counts the trigrams of every labelled text inside its task first; only (language, trigram, count) rows are
shuffled. The filter has ``SLOTS`` slots whatever the corpus, so what reaches the driver and the executors is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.shared import held_out, mix, prepare, written

SLOTS = 1 << 20
HASHES = 4
# Languages of one filter, which bounds what is broadcast at once; further languages, in order of name, have further filters.
BLOCK = 1024
# A language contains a trigram that it uses at least this often, and at least at this share of the rate of the language
# that uses it most: else a large corpus puts every trigram into every language.
LEAST_RATE = 2e-7
LEAST_SHARE = 0.05
UNKNOWN = "und"
# A text of which no language knows this share of trigrams is in none of the learned languages.
LEAST_SCORE = 0.4

# Characters handled at once, and counted rows held by a task.
CHUNK = 1 << 20
HELD = 1 << 20

_PREDICTION = "struct<lang_pred: string, score: double>"
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


_IS_LETTER: list[np.ndarray] = []


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(packed trigrams of all texts, offsets n + 1): one for each letter, with its neighbours; 0 stands for a border."""
    if not _IS_LETTER:
        _IS_LETTER.append(_letters())
    low = [(t or "").lower() for t in texts]
    symbols = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    is_letter = _IS_LETTER[0][symbols]
    symbols = np.where(is_letter, symbols, 0)
    rows = np.cumsum([1, *(len(t) + 1 for t in low)])
    before, at, after = symbols[:-2], symbols[1:-1], symbols[2:]
    kept = is_letter[1:-1]
    grams = (before[kept] << 42) | (at[kept] << 21) | after[kept]
    ends = np.concatenate(([0], np.cumsum(kept)))
    return grams, ends[np.minimum(rows - 1, len(kept))]


def chunks(texts: list[str | None], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``limit`` characters; a longer text stands alone."""
    start = size = 0
    for i, text in enumerate(texts):
        n = len(text or "") + 1
        if size and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)


def _summed(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of equal (language, trigram) rows added up."""
    langs, grams, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((grams, langs))
    langs, grams, counts = langs[order], grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], (langs[1:] != langs[:-1]) | (grams[1:] != grams[:-1]))))
    return langs[first], grams[first], np.add.reduceat(counts, first)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of one task's texts, added up before they leave the task."""
    names: dict[str, int] = {}
    parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    held = 0

    def rows() -> pa.RecordBatch:
        langs, grams, counts = _summed(parts)
        names_array = pa.array(list(names), pa.string())
        return pa.RecordBatch.from_arrays([names_array.take(pa.array(langs)), pa.array(grams), pa.array(counts)], ["lang", "gram", "n"])

    for batch in batches:
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        codes = np.array([names.setdefault(x, len(names)) for x in langs], np.int64)
        for a, b in chunks(texts):
            grams, ends = trigrams(texts[a:b])
            row_codes = np.repeat(codes[a:b], np.diff(ends))
            for code in np.unique(codes[a:b]):
                found, counts = np.unique(grams[row_codes == code], return_counts=True)
                parts.append((np.full(len(found), code), found, counts.astype(np.int64)))
                held += len(found)
            if held > HELD:
                parts = [_summed(parts)]
                held = len(parts[0][0])
                if held > HELD:  # mostly different trigrams: let the shuffle add them up
                    yield rows()
                    parts, held = [], 0
    if held:
        yield rows()


@dataclass
class Filters:
    """The filter of a block of languages: ``masks`` has one row for each slot, bit-packed over ``langs``."""

    langs: list[str]
    masks: np.ndarray
    further: tuple[Filters, ...] = ()

    def __post_init__(self) -> None:
        bits = np.unpackbits(self.masks, axis=1, bitorder="little")[:, : len(self.langs)]
        self.false_rate = bits.mean(axis=0, dtype=np.float64) ** HASHES if self.langs else np.zeros(0)

    def languages_of(self, grams: np.ndarray) -> np.ndarray:
        """For each trigram the packed set of languages whose filter contains it."""
        key = mix(grams)
        found: np.ndarray | None = None
        for odd in _ODD[:HASHES]:
            part = self.masks[(key * np.uint64(odd)) >> np.uint64(64 - SLOTS.bit_length() + 1)]
            found = part if found is None else found & part
        return found

    def counts(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(corrected number of known trigrams by text and language, number of trigrams by text)."""
        grams, ends = trigrams(texts)
        found = self.languages_of(grams)
        rows = np.repeat(np.arange(len(texts)), np.diff(ends))
        n = np.diff(ends).astype(np.float64)
        hits = np.zeros((len(texts), len(self.langs)))
        for byte in range(self.masks.shape[1]):
            # How often each of the 256 sets of eight languages occurs in a text, then their popcounts.
            sets = np.bincount(rows * 256 + found[:, byte], minlength=len(texts) * 256).reshape(-1, 256)
            bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
            first = byte * 8
            hits[:, first : first + 8] = (sets @ bits)[:, : len(self.langs) - first]
        fixed = (hits - n[:, None] * self.false_rate) / np.maximum(1 - self.false_rate, 1e-9)
        return np.clip(fixed, 0, n[:, None]), n

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """(language, share of the trigrams that it knows) of each text; the first by name among equal counts."""
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        fixed, n = self.counts(texts)
        best = fixed.argmax(axis=1)
        score = np.where(n > 0, fixed[np.arange(len(texts)), best] / np.maximum(n, 1), 0.0)
        return [self.langs[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score


def train(docs: DataFrame) -> Filters:
    """Filters learned from ``text`` and ``lang`` of every row that has both.

    Repeated rows count as often as they occur. Without such rows the model has no language and answers ``und``.
    """
    spark = prepare(docs.sparkSession)
    rows = docs.where("lang is not null and text is not null").select("lang", "text")
    counts = written(rows.mapInArrow(_count_task, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "trigram-counts")
    # One row for each language.
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    per_gram = counts.join(totals, "lang").withColumn("rate", F.col("n") / F.col("total"))
    sets = (
        per_gram.groupBy("gram")
        .agg(F.collect_list(F.struct("lang", "rate")).alias("used"), F.max("rate").alias("most"))  # at most one entry a language
        .select("gram", F.filter("used", lambda u: (u["rate"] >= LEAST_RATE) & (u["rate"] >= LEAST_SHARE * F.col("most")))["lang"].alias("langs"))
    )

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = mix(batch.column("gram").to_numpy())
            for odd in _ODD[:HASHES]:
                at = (key * np.uint64(odd)) >> np.uint64(64 - SLOTS.bit_length() + 1)
                yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), batch.column("langs")], ["slot", "langs"])

    def block(sets: DataFrame) -> Filters:
        # At most SLOTS rows, each with at most BLOCK names.
        filled = sets.mapInArrow(slots, "slot long, langs array<string>").groupBy("slot").agg(F.array_distinct(F.flatten(F.collect_set("langs"))).alias("langs"))
        by_set = filled.groupBy(F.array_sort("langs").alias("langs")).agg(F.collect_list("slot").alias("slots")).toArrow()
        langs = sorted({x for row in by_set.column("langs").to_pylist() for x in row})
        masks = np.zeros((SLOTS, max(1, -(-len(langs) // 8))), np.uint8)
        for names, at in zip(by_set.column("langs").to_pylist(), by_set.column("slots"), strict=True):
            for name in names:
                i = langs.index(name)
                masks[at.values.to_numpy(), i // 8] |= np.uint8(1 << i % 8)
        return Filters(langs, masks)

    names = [r["lang"] for r in totals.select("lang").orderBy("lang").collect()]
    if len(names) <= BLOCK:
        return block(sets)
    sets = written(sets, "trigram-languages")
    blocks = []
    for i in range(0, len(names), BLOCK):
        first, last = names[i], names[min(i + BLOCK, len(names)) - 1]
        blocks.append(block(sets.select("gram", F.filter("langs", lambda x: x.between(first, last)).alias("langs")).where(F.size("langs") > 0)))
    return replace(blocks[0], further=tuple(blocks[1:]))


def identify(docs: DataFrame, model: Filters) -> DataFrame:
    """Add ``lang_pred`` and ``score`` from the whole ``text`` alone; both are replaced if present.

    A text that is null, empty or without a letter is ``und`` with score 0. The first by name of the languages that know most
    of a text decides. Blocks of languages are asked one after another, over a table that the block before has written.
    """
    found = _asked(docs, replace(model, further=()))
    for block in model.further:
        before = written(found, "languages").withColumnsRenamed({"lang_pred": "__lang", "score": "__score"})
        better = F.col("score") > F.col("__score")
        later = _asked(before, block).withColumns({"lang_pred": F.when(better, F.col("lang_pred")).otherwise(F.col("__lang")), "score": F.greatest("score", "__score")})
        found = later.select(*found.columns)
    return found


def _asked(docs: DataFrame, model: Filters) -> DataFrame:
    """The answers of one block of languages."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    @arrow_udf(_PREDICTION)
    def predicted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        filters = sent.value
        for batch in batches:
            texts, langs, scores = batch.to_pylist(), [], []
            for a, b in chunks(texts):
                names, score = filters.predict(texts[a:b])
                langs += names
                scores.append(score)
            yield pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], ["lang_pred", "score"])

    return docs.withColumn("__found", predicted("text")).withColumns({"lang_pred": F.col("__found.lang_pred"), "score": F.col("__found.score")}).drop("__found")


def known_languages(docs: DataFrame, model: Filters) -> DataFrame:
    """The rows whose text is in one of the learned languages: not ``und``, and enough of it known. Columns stay."""
    kept = docs.withColumn("__row", F.struct(*docs.columns))
    found = identify(kept.select("__row", "text"), model).where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.select("__row.*")


def training_rows(docs: DataFrame) -> DataFrame:
    """The rows a model may learn from."""
    return docs.where(~held_out(F.col("doc_id"), 3, 1))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from two of three folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), train(training_rows(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "lang_pred", "score")
