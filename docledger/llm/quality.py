"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

Statistics of a text (lengths, shares of character classes, repetition of words and lines) are standardised and mapped to
``FEATURES`` random cosines, which approximate a Gaussian kernel. Each task adds its rows' outer products up; the sums of
a fixed number of tasks give the normal equations, whose solution is the weights. Scores of the training rows, counted in
``BINS`` bins, are made monotone by pooling adjacent violators, which turns a score into a rate of label 1.

Labels are learned from a bounded sample of labelled rows (``MAX_LABELLED``, chosen by a hash of the id); statistics are
computed for all rows, over whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.shared import LOWER, byte_table, held_out, labelled_sample, mix, prepare, runs, segment_hashes, utf8, written

# Most labelled rows that a model learns from.
MAX_LABELLED = 60_000
FEATURES = 256
# Width of the kernel in units of standardised statistics, and weight of the ridge for each row.
WIDTH = 4.0
RIDGE = 1e-5
BINS = 512
# Tasks that add up the normal equations; each sends one matrix to the driver.
SUMS = 8

_BLANK = byte_table([(0x09, 0x0D), (0x20, 0x20)])
_CLASSES = {
    "lower": byte_table([(0x61, 0x7A)]),
    "upper": byte_table([(0x41, 0x5A)]),
    "digit": byte_table([(0x30, 0x39)]),
    "beyond_ascii": byte_table([(0x80, 0xFF)]),
    "blank": _BLANK,
    "newline": byte_table([(0x0A, 0x0A)]),
    "stop": byte_table([(0x21, 0x21), (0x2C, 0x2C), (0x2E, 0x2E), (0x3A, 0x3B), (0x3F, 0x3F)]),
    "exclaim": byte_table([(0x21, 0x21)]),
    "bar": byte_table([(0x7C, 0x7C)]),
    "symbol": byte_table([(0x23, 0x2B), (0x2F, 0x2F), (0x3C, 0x3E), (0x40, 0x40), (0x5B, 0x60), (0x7B, 0x7E)]),
}
STATISTICS = [
    "log_bytes", "log_words", "log_lines", *_CLASSES, "word_mean", "word_deviation", "word_log_max", "short_words", "long_words",
    "different_words", "same_as_next", "different_pairs", "different_lines", "line_log_mean", "ends_odd", "most_word", "all_capitals",
]


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between consecutive bounds (n + 1); empty ranges are 0."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[bounds[1:]] - total[bounds[:-1]]


def _different(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(number of different values, count of the most frequent one) in each of ``n`` rows."""
    if not len(hashes):
        return np.zeros(n), np.zeros(n)
    key = np.sort((rows.astype(np.uint64) << np.uint64(44)) | (hashes >> np.uint64(20)))
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    of = (key[first] >> np.uint64(44)).astype(np.int64)
    most = np.zeros(n)
    np.maximum.at(most, of, np.diff(np.append(first, len(key))))
    return np.bincount(of, minlength=n).astype(float), most


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text of a batch; zeros for a null or empty one."""
    raw, at = utf8(texts)
    n = len(texts)
    size = np.diff(at).astype(float)
    per_byte = np.maximum(size, 1)
    out = {name: _sums(table[raw], at) / per_byte for name, table in _CLASSES.items()}
    starts, ends = runs(~_BLANK[raw], at)
    words_at = np.searchsorted(starts, at)
    words = np.diff(words_at).astype(float)
    per_word = np.maximum(words, 1)
    length = (ends - starts).astype(float)
    row = np.repeat(np.arange(n), np.diff(words_at))
    hashes = segment_hashes(LOWER[raw], starts, ends)
    out |= {"log_bytes": np.log1p(size), "log_words": np.log1p(words)}
    out["word_mean"] = _sums(length, words_at) / per_word
    out["word_deviation"] = np.sqrt(np.maximum(_sums(length**2, words_at) / per_word - out["word_mean"] ** 2, 0))
    longest = np.zeros(n)
    np.maximum.at(longest, row, length)
    out["word_log_max"] = np.log1p(longest)
    out["short_words"] = _sums(length <= 3, words_at) / per_word
    out["long_words"] = _sums(length >= 14, words_at) / per_word
    different, most = _different(hashes, row, n)
    out["different_words"], out["most_word"] = different / per_word, most / per_word
    inside = row[1:] == row[:-1]
    out["same_as_next"] = np.bincount(row[1:][inside & (hashes[1:] == hashes[:-1])], minlength=n) / per_word
    pairs = mix(hashes[:-1] * np.uint64(31) + hashes[1:])[inside]
    out["different_pairs"] = _different(pairs, row[1:][inside], n)[0] / np.maximum(words - 1, 1)
    last = LOWER[raw][ends - 1] if len(ends) else np.zeros(0, np.uint8)
    out["ends_odd"] = _sums(_CLASSES["symbol"][last] | _CLASSES["exclaim"][last], words_at) / per_word
    first = raw[starts] if len(starts) else np.zeros(0, np.uint8)
    second = raw[np.minimum(starts + 1, len(raw) - 1)] if len(starts) else np.zeros(0, np.uint8)
    capitals = _CLASSES["upper"]
    out["all_capitals"] = _sums(capitals[first] & capitals[second] & (length > 1), words_at) / per_word
    line_starts, line_ends = runs(raw != 0x0A, at)
    lines_at = np.searchsorted(line_starts, at)
    lines = np.diff(lines_at).astype(float)
    line_row = np.repeat(np.arange(n), np.diff(lines_at))
    out["log_lines"] = np.log1p(lines)
    out["different_lines"] = _different(segment_hashes(raw, line_starts, line_ends), line_row, n)[0] / np.maximum(lines, 1)
    out["line_log_mean"] = np.log1p(size / np.maximum(lines, 1))
    return np.where(size[:, None] > 0, np.stack([out[k] for k in STATISTICS], axis=1), 0.0)


def _statistics_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        values = statistics(batch)
        offsets = pa.array(np.arange(len(values) + 1) * len(STATISTICS), pa.int32())
        yield pa.ListArray.from_arrays(offsets, pa.array(values.ravel().astype(np.float32)))


def with_statistics(docs: DataFrame, out: str = "stats") -> DataFrame:
    """Add ``out``: the statistics of the whole ``text``. It is replaced if present."""
    prepare(docs.sparkSession)
    return docs.withColumn(out, arrow_udf(_statistics_of, "array<float>")("text"))


@dataclass
class Model:
    """Standardisation, random cosines, ridge weights and the calibration steps."""

    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    knots: np.ndarray
    levels: np.ndarray

    def cosines(self, stats: np.ndarray) -> np.ndarray:
        """The random Fourier features of rows of statistics, and a constant."""
        z = np.clip((stats - self.mean) / self.scale, -8, 8)
        return np.concatenate([np.cos(z @ self.omega + self.phase) * np.sqrt(2 / len(self.phase)), np.ones((len(z), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        """Ridge scores before calibration."""
        return self.cosines(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated scores, straight between the steps."""
        return np.clip(np.interp(self.raw(stats), self.knots, self.levels), 0, 1)


def pooled(at: np.ndarray, ones: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling adjacent violators: (mean place, rate) of each block of the ordered bins."""
    blocks: list[list[float]] = []
    for x, y, w in zip(at, ones, rows, strict=True):
        blocks.append([x * w, y, w])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def _matrix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    stats = batch.column("stats").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)
    return stats, batch.column("label").to_numpy(zero_copy_only=False).astype(np.float64)


def fit(rows: DataFrame, label: str = "quality") -> Model:
    """A model of ``label`` (0 or 1) learned from rows of (``stats``, ``label``).

    Without rows every score is 0.5; with rows of one label only, every score is that label.
    """
    rng = np.random.default_rng(20240229)
    k = len(STATISTICS)
    rows = rows.select("stats", F.col(label).cast("double").alias("label"))
    flat = [F.col("stats")[i].cast("double") for i in range(k)]
    moments = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate"), *(f(x).alias(f"{name}{i}") for i, x in enumerate(flat) for name, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    omega, phase = rng.normal(0, 1 / WIDTH, (k, FEATURES)), rng.uniform(0, 2 * np.pi, FEATURES)
    if not moments["n"] or moments["rate"] in (0.0, 1.0):
        level = float(moments["rate"]) if moments["n"] else 0.5
        return Model(np.zeros(k), np.ones(k), omega, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([level]))
    mean = np.array([moments[f"m{i}"] for i in range(k)])
    scale = np.array([moments[f"s{i}"] for i in range(k)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), omega, phase, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))

    def normal_equations(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FEATURES + 2, FEATURES + 2))
        for batch in batches:
            stats, label = _matrix(batch)
            z = np.concatenate([model.cosines(stats), label[:, None]], axis=1)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["total"])

    parts = rows.coalesce(SUMS).mapInArrow(normal_equations, "total binary").collect()  # SUMS matrices of a fixed size
    total = sum(np.frombuffer(p["total"]).reshape(FEATURES + 2, FEATURES + 2) for p in parts)
    model.weights = np.linalg.solve(total[:-1, :-1] + RIDGE * moments["n"] * np.eye(FEATURES + 1), total[:-1, -1])

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats, label = _matrix(batch)
            at = np.clip(np.floor((model.raw(stats) + 1) * (BINS / 3)), 0, BINS - 1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(label)], ["bin", "label"])

    bins = rows.mapInArrow(binned, "bin long, label double").groupBy("bin").agg(F.sum("label").alias("ones"), F.count("*").alias("rows")).orderBy("bin").collect()
    # Half a row of either label in each bin keeps scores off 0 and 1.
    model.knots, model.levels = pooled(
        np.array([(b["bin"] + 0.5) * 3 / BINS - 1 for b in bins]), np.array([b["ones"] + 0.01 for b in bins]), np.array([b["rows"] + 0.02 for b in bins])
    )
    return model


def scored(rows: DataFrame, model: Model, out: str = "score") -> DataFrame:
    """Add ``out``: the calibrated score of each row's ``stats``."""
    sent = rows.sparkSession.sparkContext.broadcast(model)

    @arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            stats = batch.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(STATISTICS)).astype(np.float64)
            yield pa.array(sent.value.score(stats))

    return rows.withColumn(out, score("stats"))


def training_rows(doc_id: Column) -> Column:
    """True for rows that a model may learn from."""
    return ~held_out(doc_id, 3, 1)


def learn(stats: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> Model:
    """A model from (doc_id, stats) and (doc_id, quality) of the training folds, by at most ``max_rows`` labelled rows."""
    sample = labelled_sample(labels.where(training_rows(F.col("doc_id"))), "quality", max_rows)
    return fit(written(stats.join(F.broadcast(sample), "doc_id").select("stats", "quality"), "quality-sample"))


def classify(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; empty and null texts are scored as well."""
    stats = written(with_statistics(docs.select("doc_id", "text")).drop("text"), "quality-statistics")
    found = scored(stats, learn(stats, labels, max_rows))
    return found.select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def good_rows(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_LABELLED) -> DataFrame:
    """The rows of ``docs`` whose score is at least one half. Columns stay; statistics are computed twice, texts never move."""
    packed = docs.select(F.struct(*docs.columns).alias("__row"), "doc_id", "text")
    sample = labelled_sample(labels.where(training_rows(F.col("doc_id"))), "quality", max_rows)
    labelled = with_statistics(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")).select("stats", "quality")
    model = fit(written(labelled, "quality-sample"))
    return scored(with_statistics(packed), model).where("score >= 0.5").select("__row.*")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from two of three folds."""
    return classify(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
