"""What the operators of this package share: folders, splits, Arrow settings and flat word arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows and bytes of one Arrow batch. Small batches keep Python workers small when texts are long.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
}

_LOCAL: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Bound the Arrow batches of a session, so that a task's memory does not follow the length of texts."""
    for key, value in ARROW_CONF.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it.

    A session without one may only run in local mode, where driver and executors are one process; it then gets a
    temporary folder. Elsewhere a missing setting is an error: executors would write where nobody else can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = tempfile.mkdtemp(prefix="spark-docledger-")
    return _LOCAL[app]


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, lineage cut, safe against lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """True for rows whose ``crc32`` of the id as text falls in ``fold``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % folds == fold


def sha256_hex(text: Column) -> Column:
    """Lowercase hex SHA-256 of a string's UTF-8 bytes."""
    return F.sha2(text.cast("binary"), 256)


def labelled_sample(labels: DataFrame, label: str, max_rows: int) -> DataFrame:
    """(doc_id, ``label``) of at most ``max_rows`` labelled rows, chosen by a hash of the id.

    Each id gets one label: the larger of its repeated rows. Rows without id or label are left out. At most ``max_rows``
    rows are proven by the limit, so the result may be broadcast.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).alias(label))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array and its row offsets (n + 1), without a copy; a null row is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type):
        width = np.int64
    else:
        width = np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, width)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_table(ranges: Sequence[tuple[int, int]]) -> np.ndarray:
    """A table of 256 booleans: True for bytes inside the inclusive ``ranges``."""
    table = np.zeros(256, bool)
    for low, high in ranges:
        table[low : high + 1] = True
    return table


# Bytes of a word: digits, letters a to z and every byte of a character beyond ASCII.
WORD_BYTES = byte_table([(0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF)])
# A to Z to a to z; all other bytes stay.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit (two multiply-and-shift rounds)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= _MIX
    x ^= x >> np.uint64(29)
    return x


def powers(n: int, base: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def runs(flags: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of True that do not cross a row border (offsets n + 1)."""
    if not len(flags):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = flags.copy()
    first[1:] &= ~flags[:-1]
    inner = borders[:-1][borders[:-1] < len(flags)]
    first[inner] = flags[inner]
    last = flags.copy()
    last[:-1] &= ~flags[1:]
    ends = borders[1:][borders[1:] > 0] - 1
    last[ends] = flags[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def segment_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int = 0x100000001B3) -> np.ndarray:
    """A 64-bit polynomial hash of every segment [start, end) of ``values``; segments are ordered and disjoint."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    total = int(lengths.sum())
    # Values inside segments, one after another, with their position inside the segment.
    heads = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    shift = np.repeat(starts - heads, lengths)
    at = np.arange(total) + shift
    weight = powers(int(lengths.max()), base)[np.arange(total) - np.repeat(heads, lengths)]
    sums = np.add.reduceat((values[at].astype(np.uint64) + np.uint64(1)) * weight, heads)
    return mix(sums + lengths.astype(np.uint64) * _MIX)


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of a batch of texts as hashes: (bytes, word starts, word ends, word hashes, word offsets of the rows).

    A to Z are lower-cased; a word is a run of digits, letters a to z and characters beyond ASCII.
    """
    raw, rows = utf8(texts)
    low = LOWER[raw]
    starts, ends = runs(WORD_BYTES[low], rows)
    return low, starts, ends, segment_hashes(low, starts, ends), np.searchsorted(starts, rows)
