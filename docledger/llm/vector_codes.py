"""Codes of vectors: every part of a vector is replaced by the number of the nearest entry of that part's codebook.

Components become integers (``SCALE`` times the value, rounded down), so that all that follows is exact and does not depend
on how rows are dealt to tasks. Codebooks begin as the parts of the vectors with the smallest ids; in each round every part
is assigned to its nearest entry, and entries move to the floor of the mean of their parts.

Nearest entries come out of matrix products: |x - c|^2 = |x|^2 - 2xc + |c|^2. Integers are split into limbs so narrow that a
sum of products of two limbs stays below 2^53, where float64 is exact; the products of limbs are put together in int64, and
the first least distance is taken. Vectors of small numbers have one limb.

A round sends the codebooks, whose size does not depend on the number of vectors, to all tasks, and adds up one row for each
part and entry of every task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.shared import prepare, written

SCALE = 256
PARTS, ENTRIES, ROUNDS = 16, 64, 2
# Components beyond this magnitude, in units of 1 / SCALE, have no distances in 64 bits.
LIMIT = 1 << 26
EXACT_BITS = 53


@dataclass(frozen=True)
class Codebooks:
    """Entries by part, entry and position, and how many components a vector has."""

    entries: np.ndarray
    size: int

    def digest(self) -> str:
        """SHA-256 of all numbers in order of part, entry and position, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()


def limbs(x: np.ndarray, bits: int) -> list[np.ndarray]:
    """Numbers as float64 limbs of ``bits`` bits, lowest first: all but the last are not negative. As many as are needed."""
    out, rest = [], x
    while len(rest) and (rest.min() < -(1 << bits) or rest.max() >= 1 << bits):
        out.append((rest & ((1 << bits) - 1)).astype(np.float64))
        rest = rest >> bits
    return [*out, rest.astype(np.float64)]


def products(x: np.ndarray, y: np.ndarray, bits: int | None = None) -> np.ndarray:
    """The exact matrix product of stacks of integer matrices (parts, n, d) and (parts, d, m), by float64 products of limbs."""
    if bits is None:
        bits = (EXACT_BITS - max(int(x.shape[-1]) - 1, 0).bit_length()) // 2
    total = np.zeros((*x.shape[:-1], y.shape[-1]), np.int64)
    for i, a in enumerate(limbs(x, bits)):
        for j, b in enumerate(limbs(y, bits)):
            total += np.matmul(a, b).astype(np.int64) << (bits * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first nearest entry, squared distance) of every part of vectors (parts, n, d)."""
    far = (entries * entries).sum(axis=2)[:, None, :] - 2 * products(x, entries.transpose(0, 2, 1))
    best = far.argmin(axis=2)
    return best, np.take_along_axis(far, best[:, :, None], axis=2)[:, :, 0] + (x * x).sum(axis=2)


def _kept(vector: str, size: int | None = None) -> Column:
    """True for vectors that have components, all of them finite and within the limit, and ``size`` of them if given."""
    bound = LIMIT / SCALE
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < bound, F.lit(False)))
    right = F.size(vector) > 0 if size is None else F.size(vector) == size
    return F.coalesce(F.col(vector).isNotNull() & right & fine, F.lit(False))


def _parts(vectors: pa.Array, size: int, parts: int) -> np.ndarray:
    """Integer components of vectors as (parts, n, d); zeros fill up the last part."""
    values = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), size)
    whole = np.floor(values * SCALE).astype(np.int64)
    whole = np.pad(whole, ((0, 0), (0, -size % parts)))
    return np.ascontiguousarray(whole.reshape(len(vectors), parts, -1).transpose(1, 0, 2))


def _sums(books: Codebooks) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that adds up the parts of each entry in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, many, d = books.entries.shape
        sums, counts = np.zeros((parts * many, d), np.int64), np.zeros(parts * many, np.int64)
        for batch in batches:
            x = _parts(batch.column(0), books.size, parts)
            at = (nearest(x, books.entries)[0] + (np.arange(parts) * many)[:, None]).ravel()
            np.add.at(sums, at, x.reshape(-1, d))
            counts += np.bincount(at, minlength=parts * many)
        used = np.flatnonzero(counts)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(used) + 1, dtype=np.int32) * d), pa.array(sums[used].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used]), lists], ["entry", "n", "sums"])

    return run


def learn(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks of (vec_id, embedding).

    Vectors are left out if they are null, empty, hold a null or non-finite component, or one of ``LIMIT / SCALE`` or more,
    or if they have another length than the kept vector of the smallest id. Null ids come after all others, vectors of equal
    ids in order of their components. If fewer vectors than ``entries`` are kept, codebooks are as short. A length that
    ``parts`` does not divide is filled up with zeros. A table without kept vectors gives empty codebooks.
    """
    prepare(vectors.sparkSession)
    order = (F.asc_nulls_last("vec_id"), "embedding")
    kept = vectors.select("vec_id", "embedding").where(_kept("embedding"))
    first = kept.orderBy(*order).limit(1).collect()
    if not first:
        return Codebooks(np.zeros((parts, 0, 0), np.int64), 0)
    size = len(first[0]["embedding"])
    kept = kept.where(_kept("embedding", size))
    begun = kept.orderBy(*order).limit(entries).collect()
    book = _parts(pa.array([r["embedding"] for r in begun], pa.list_(pa.float64())), size, parts)
    for _ in range(rounds):
        moved = kept.select("embedding").mapInArrow(_sums(Codebooks(book, size)), "entry long, n long, sums array<long>")
        d = book.shape[2]
        # One row for each part and entry.
        total = moved.groupBy("entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[k]).alias(f"s{k}") for k in range(d))).toArrow()
        at, n = total.column("entry").to_numpy(), total.column("n").to_numpy()
        flat = book.reshape(-1, d).copy()
        flat[at] = np.column_stack([total.column(f"s{k}").to_numpy() for k in range(d)]) // n[:, None]
        book = flat.reshape(book.shape)
    return Codebooks(book, size)


def encode(vectors: DataFrame, books: Codebooks) -> DataFrame:
    """The kept rows of ``vectors`` with ``code`` (two hexadecimal digits for each part) and ``error`` (squared distance) added.

    Which rows are kept is said in ``learn``. Columns of these names are replaced.
    """

    @arrow_udf("struct<code: string, error: long>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            best, far = nearest(_parts(batch, books.size, len(books.entries)), books.entries)
            codes = [row.tobytes().hex() for row in best.T.astype(np.uint8)]
            yield pa.StructArray.from_arrays([pa.array(codes, pa.string()), pa.array(far.sum(axis=0))], ["code", "error"])

    if books.entries.shape[1] > 256:
        raise ValueError("two hexadecimal digits name at most 256 entries")
    prepare(vectors.sparkSession)
    kept = vectors.where(_kept("embedding", books.size) if books.size else F.lit(False))
    coded = kept.withColumn("__code", of("embedding"))
    return coded.withColumns({"code": F.col("__code.code"), "error": F.col("__code.error")}).drop("__code")


def decode(codes: DataFrame, books: Codebooks, out: str = "approximate") -> DataFrame:
    """Add ``out``: the vector that each ``code`` stands for, in the units of the embeddings. A null code gives null."""

    @arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [None if c is None else (books.entries[np.arange(len(books.entries)), list(bytes.fromhex(c))].ravel()[: books.size] / SCALE).tolist() for c in batch.to_pylist()]
            yield pa.array(rows, pa.list_(pa.float64()))

    return codes.withColumn(out, of("code"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings as codes, with their errors, those of their labels, and the digest of the codebooks."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")
    books = learn(vectors)
    coded = written(encode(vectors, books).select("vec_id", "label", "code", "error"), "vector-codes")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    done = coded.join(sums, F.col("label").eqNullSafe(F.col("__label")))
    return done.select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


_NEAREST = """
    SELECT rid, part, min({{'far': far, 'entry': entry}}) AS best FROM (
        SELECT x.rid, x.part, c.entry, sum((x.v - c.v) * (x.v - c.v)) AS far
        FROM components x JOIN {book} c ON x.part = c.part AND x.pos = c.pos GROUP BY ALL
    ) GROUP BY ALL
"""
_MOVED = """
    SELECT b.part, b.entry, b.pos, coalesce(m.v, b.v) AS v FROM {book} b LEFT JOIN (
        SELECT part, entry, pos, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS v FROM (
            SELECT x.part, a.best.entry AS entry, x.pos, CAST(sum(x.v) AS BIGINT) AS s, count(*) AS n
            FROM components x JOIN {assigned} a ON x.rid = a.rid AND x.part = a.part GROUP BY ALL)
    ) m ON b.part = m.part AND b.entry = m.entry AND b.pos = m.pos
"""
OP11_SQL = f"""
WITH kept AS (
    SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id, embedding) AS rid FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), components AS (
    SELECT rid, (i - 1) // (len(embedding) // 16) AS part, (i - 1) % (len(embedding) // 16) AS pos, CAST(floor(256 * CAST(embedding[i] AS DOUBLE)) AS BIGINT) AS v
    FROM kept, unnest(range(1, len(embedding) + 1)) AS t(i)
), book0 AS (SELECT part, rid - 1 AS entry, pos, v FROM components WHERE rid <= 64),
near0 AS ({_NEAREST.format(book="book0")}), book1 AS ({_MOVED.format(book="book0", assigned="near0")}),
near1 AS ({_NEAREST.format(book="book1")}), book2 AS ({_MOVED.format(book="book1", assigned="near1")}),
near2 AS ({_NEAREST.format(book="book2")}),
coded AS (
    SELECT rid, string_agg(format('{{:02x}}', best.entry), '' ORDER BY part) AS code, CAST(sum(best.far) AS BIGINT) AS error FROM near2 GROUP BY rid
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM book2) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""
