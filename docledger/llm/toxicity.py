"""Toxicity by logistic regression, learned with FTRL-proximal over hashed word n-grams and skip-grams.

Features of a text are slots of a table of ``SLOTS``: its words, the stems they begin with, pairs of neighbours and pairs with
one word between, each counted once. Every coordinate has its own learning rate, and the L1 term keeps a coordinate at
exactly zero until the evidence exceeds it, so the weights are few and are sent to the executors as two short arrays.

Labels are learned from a bounded sample of labelled rows (``MAX_LABELLED``, chosen by a hash of the id). The sample is
dealt to ``SHARDS`` tasks; each runs the updates over its rows, and the states are mixed coordinate by coordinate over
those shards that met the coordinate, which is repeated for ``ROUNDS``. The table of slots is the feature space: nothing is
chosen or dropped beforehand, a rare slot has no weight because of the L1 term. States are mixed by Spark in ranges of
coordinates, so the driver holds two numbers for each of ``SLOTS``, whatever the input. All rows are scored, over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import ArrayType, IntegerType

from docledger.llm.shared import hashed_words, held_out, labelled_sample, mix, prepare, segment_hashes, written

# Most labelled rows that a model learns from.
MAX_LABELLED = 24_000
SLOT_BITS = 20
SLOTS = 1 << SLOT_BITS
SHARDS = 8
ROUNDS = 4
# Coordinates of one range, as a power of two.
RANGE_BITS = 16
# Learning rate, its offset, and the weights of the two penalties.
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.0, 0.1
# Bytes that a stem keeps of a word.
STEMS = (4, 6)
THRESHOLD = 0.3


def slots(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every n-gram and skip-gram of a batch of texts, repeats included."""
    low, starts, ends, words, at = hashed_words(texts)
    row = np.repeat(np.arange(len(texts)), np.diff(at))
    found, rows = [words], [row]
    for i, size in enumerate(STEMS):
        longer = ends - starts > size
        found.append(mix(segment_hashes(low, starts[longer], starts[longer] + size) + np.uint64(i + 1)))
        rows.append(row[longer])
    for gap, odd in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        inside = row[gap:] == row[:-gap] if len(row) > gap else np.zeros(0, bool)
        found.append(mix(words[:-gap][inside] * np.uint64(odd) + words[gap:][inside]) if len(inside) else np.zeros(0, np.uint64))
        rows.append(row[gap:][inside] if len(inside) else np.zeros(0, np.int64))
    return np.concatenate(rows), (np.concatenate(found) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def by_text(texts: pa.Array) -> Iterator[np.ndarray]:
    """The different slots of each text."""
    row, slot = slots(texts)
    key = np.unique((row << SLOT_BITS) | slot)
    at = np.searchsorted(key, np.arange(len(texts) + 1) << SLOT_BITS)
    key &= SLOTS - 1
    for a, b in zip(at[:-1], at[1:], strict=True):
        yield key[a:b]


@dataclass
class State:
    """The sums of FTRL-proximal by coordinate, the last of which is the constant."""

    z: np.ndarray
    n: np.ndarray

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        """Weights in closed form: zero where the L1 term outweighs the gradients."""
        z = self.z[at]
        return np.where(np.abs(z) > L1, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2), 0.0)

    def learn(self, coordinates: np.ndarray, label: float) -> None:
        """One text: predict, then move each of its coordinates, and the constant, at its own rate."""
        at = np.append(coordinates, len(self.z) - 1)
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


@dataclass
class Model:
    """Sparse weights by slot, and the constant."""

    slots: np.ndarray
    weights: np.ndarray
    constant: float

    def __post_init__(self) -> None:
        self._table: np.ndarray | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "_table": None}

    def score(self, texts: pa.Array) -> np.ndarray:
        """Probability of label 1 for each text of a batch."""
        if self._table is None:
            self._table = np.zeros(SLOTS, np.float32)
            self._table[self.slots] = self.weights
        row, slot = slots(texts)
        hit = self._table[slot] != 0
        key = np.unique((row[hit] << SLOT_BITS) | slot[hit])
        sums = np.bincount(key >> SLOT_BITS, self._table[key & (SLOTS - 1)], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(sums + self.constant, -35, 35)))


@arrow_udf(ArrayType(IntegerType(), False))
def _coordinates(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The different slots of each text."""
    for batch in batches:
        found = list(by_text(batch))
        bounds = np.concatenate(([0], np.cumsum([len(f) for f in found]))).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(found).astype(np.int32) if found else np.zeros(0, np.int32)))


_MOVES = "part int, z binary, n binary, met binary"


def _moves(part: int, z: np.ndarray, n: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    values = (z.astype(np.float32), n.astype(np.float32), met.astype(np.uint8))
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([v.tobytes()], pa.binary()) for v in values)], ["part", "z", "n", "met"])


def _shards(sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that runs the updates over the rows of each shard, from the state that was sent."""

    def moved(state: State, begun: State) -> Iterator[pa.RecordBatch]:
        for part, at in enumerate(range(0, len(state.z), 1 << RANGE_BITS)):
            own = slice(at, at + (1 << RANGE_BITS))
            met = state.n[own] != begun.n[own]
            if met.any():
                yield _moves(part, state.z[own] * met, state.n[own] * met, met)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, own, shard = State(sent.value.z.astype(np.float64), sent.value.n.astype(np.float64)), None, None
        for batch in batches:
            lists, labels, shards = (batch.column(c) for c in ("at", "label", "shard"))
            values, bounds = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))))
            for i, (label, of) in enumerate(zip(labels.to_pylist(), shards.to_pylist(), strict=True)):
                if of != shard:
                    if own is not None:
                        yield from moved(own, begun)
                    own, shard = State(begun.z.copy(), begun.n.copy()), of
                own.learn(values[bounds[i] : bounds[i + 1]], label)
        if own is not None:
            yield from moved(own, begun)

    return run


def _mixed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the moves of all shards, by range of coordinates."""
    total: dict[int, tuple[np.ndarray, ...]] = {}
    for batch in batches:
        for part, *row in zip(*(batch.column(c).to_pylist() for c in ("part", "z", "n", "met")), strict=True):
            own = tuple(np.frombuffer(v, t).astype(np.float64) for v, t in zip(row, (np.float32, np.float32, np.uint8), strict=True))
            total[part] = tuple(a + b for a, b in zip(total[part], own, strict=True)) if part in total else own
    for part, own in total.items():
        yield _moves(part, *own)


def train(rows: DataFrame, label: str = "toxic") -> Model:
    """A model of ``label`` (0 or 1) from rows of (text, label); call it with a bounded number of rows.

    Null texts have no features and count as texts. Without rows every score is 0.5; a constant label is learned as such.
    """
    spark = rows.sparkSession
    # Dealt by content and written once: every round reads the same rows of a shard in the same order, without a shuffle.
    key = F.xxhash64("text")
    texts = rows.select(F.coalesce("text", F.lit("")).alias("text"), F.col(label).cast("double").alias("label"))
    dealt = texts.select(_coordinates("text").alias("at"), "label", F.pmod(key, F.lit(SHARDS)).cast("int").alias("shard"), F.xxhash64("text", F.lit(7)).alias("order"))
    dealt = written(dealt.repartition(SHARDS, "shard").sortWithinPartitions("shard", "order", "label").drop("order"), "toxicity-sample")
    state = State(np.zeros(SLOTS + 1), np.zeros(SLOTS + 1))
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(State(state.z.astype(np.float32), state.n.astype(np.float32)))
        moves = dealt.mapInArrow(_shards(sent), _MOVES).repartition("part").mapInArrow(_mixed, _MOVES)
        # One row for each range of coordinates.
        for row in moves.toArrow().to_pylist():
            z, n, met = (np.frombuffer(row[c], t).astype(np.float64) for c, t in (("z", np.float32), ("n", np.float32), ("met", np.uint8)))
            at = np.flatnonzero(met)
            own = at + (row["part"] << RANGE_BITS)
            state.z[own], state.n[own] = z[at] / met[at], n[at] / met[at]
        sent.destroy()
    weights = state.weights()
    kept = np.flatnonzero(weights[:-1])
    return Model(kept, weights[:-1][kept].astype(np.float32), float(weights[-1]))


def score(docs: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add ``out``: the probability that each whole ``text`` is toxic; a null or empty text gets the constant's. Replaced if present."""
    sent = prepare(docs.sparkSession).sparkContext.broadcast(model)

    @arrow_udf("double")
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(sent.value.score(batch))

    return docs.withColumn(out, scores("text"))


def learn(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """A model from (doc_id, text) and (doc_id, toxic) of the training folds, by at most ``max_rows`` labelled rows."""
    prepare(docs.sparkSession)
    sample = labelled_sample(labels.where(~held_out(F.col("doc_id"), 4, 2)), "toxic", max_rows)
    return train(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from three of four folds."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = score(docs, learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
