"""Near copies by MinHash: texts whose sets of five-word shingles have a Jaccard similarity of a threshold or more.

1. Every set of shingles gets the minima of many universal hashes (multiply and add on 32 bits). ``depth`` minima make one
   band, and sets that agree in a band share its bucket. Two sets of similarity J miss each other in every band with
   probability (1 - J^depth)^bands: 3 in a million at the threshold of ``COPIES``, 5 in a million at that of ``ALIKE``,
   far less above. Equal sets are one row before anything is emitted.
2. All members of a bucket are held against one leader, the set with the most copies. Signatures (one byte of each minimum)
   go first: pairs whose share of equal bytes is more than six deviations below the threshold are dropped. The rest is
   verified on the full sets, and verified links make components by alternating large-star and small-star.
3. Members that are still in different components after that may be linked to each other. Against their leader p, each set x
   has a difference D(x) of the shingles that only one of both has. If x and y are linked, D(x) and D(y) have at least
   (|D(x)| + |D(y)| - c(|x| + |y|)) / 2 shingles in common, where c = (1 - J) / (1 + J) at the threshold; if that is not
   positive, both are linked to p. So it is enough to compare the first few of each difference in an order that all share
   (prefix filter): those that p lacks come first, as edits are rare and what p has is common. Groups of one component are
   left out. What meets has to pass two bounds inside the join: the places of the common shingle, and parities (each shingle
   flips one of ``PARITIES`` bits, so two sets differ in at least as many shingles as their bits do). The rest is verified on
   the full sets. No pair that shares a bucket and could join two components is left
   out, and a group of near copies costs as many comparisons as it has members, not their square.

Sets are named by 64 bits of a hash, as are shingles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from docledger.llm.components import components
from docledger.llm.shared import LOWER, byte_table, mix, prepare, runs, segment_hashes, utf8, written

SHINGLE = 5
SEED = 7
# Bytes whose words are hashed at once, and shingles whose minima are taken at once.
CHUNK = 1 << 19
BLOCK = 128
# Bits of the parities of a set, in words of 64.
PARITIES = 512
_WORDS = [f"parity{k}" for k in range(PARITIES // 64)]

_BLANKS = [(0x09, 0x0D), (0x20, 0x20)]
_TOKEN = ~byte_table(_BLANKS)


@dataclass(frozen=True)
class Near:
    """A threshold of similarity, as a fraction, and the bands that find what reaches it."""

    least: tuple[int, int]
    bands: int
    depth: int

    def same(self, both: int, a: int, b: int) -> bool:
        """Whether sets of ``a`` and ``b`` shingles with ``both`` in common are near copies."""
        return both * self.least[1] >= (a + b - both) * self.least[0]

    def hashes(self) -> tuple[np.ndarray, np.ndarray]:
        """Odd factors and addends of the universal hashes."""
        drawn = np.random.default_rng(SEED).integers(0, 1 << 32, (2, self.bands * self.depth), np.uint32)
        return drawn[0] | np.uint32(1), drawn[1]

    def least_equal(self) -> int:
        """Bytes of two signatures that are equal at least, if the sets are near copies: six deviations below the mean."""
        n, j = self.bands * self.depth, self.least[0] / self.least[1]
        p = j + (1 - j) / 256
        return int(n * p - 6 * (n * p * (1 - p)) ** 0.5)


# The operator's own threshold, and that of near copies in general.
COPIES = Near((85, 100), bands=40, depth=8)
ALIKE = Near((4, 5), bands=40, depth=6)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the words of a batch of texts, word offsets of the rows). A to Z are lower-cased; ASCII blanks part words."""
    raw, rows = utf8(texts)
    found, starts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    at = 0
    while at < len(raw):
        end = min(at + CHUNK, len(raw))
        while end < len(raw) and _TOKEN[raw[end]]:
            inside = _TOKEN[raw[end : end + 4096]]
            end += len(inside) if inside.all() else int(np.argmin(inside))
        low = LOWER[raw[at:end]]
        borders = np.concatenate(([0], rows[(rows > at) & (rows < end)] - at, [end - at]))
        begin, stop = runs(_TOKEN[low], borders)
        found.append(segment_hashes(low, begin, stop))
        starts.append(begin + at)
        at = end
    return np.concatenate(found), np.searchsorted(np.concatenate(starts), rows)


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The different shingles of each text as sorted hashes: all words as one shingle if there are fewer; none without words."""
    words, at = word_hashes(texts)
    weights = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64)) | np.uint64(1)
    whole = max(len(words) - SHINGLE + 1, 0)
    sums = np.zeros(whole, np.uint64)
    for k in range(SHINGLE if whole else 0):
        sums += words[k : k + whole] * weights[k]
    sums = mix(sums)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= SHINGLE:
            yield np.unique(sums[a : b - SHINGLE + 1])
        elif b > a:
            yield mix((words[a:b] * weights[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a))
        else:
            yield sums[:0]


def minima(found: np.ndarray, times: np.ndarray, plus: np.ndarray) -> np.ndarray:
    """The least value of every universal hash over a set of shingles."""
    low = np.full(len(times), np.iinfo(np.uint32).max, np.uint32)
    x = (found >> np.uint64(32)).astype(np.uint32)
    room = np.empty((min(BLOCK, max(len(x), 1)), len(times)), np.uint32)
    for at in range(0, len(x), BLOCK):
        part = room[: len(x[at : at + BLOCK])]
        np.multiply(x[at : at + BLOCK, None], times, out=part)
        np.add(part, plus, out=part)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def bands(low: np.ndarray, near: Near) -> np.ndarray:
    """One hash for each band of minima (rows of them)."""
    rows = mix(low.astype(np.uint64) + (np.arange(low.shape[1], dtype=np.uint64) << np.uint64(32))).reshape(len(low), near.bands, near.depth)
    return mix(rows.sum(axis=2, dtype=np.uint64))


def sketches(docs: DataFrame, near: Near) -> DataFrame:
    """Replace ``text`` by ``set`` (equal for equal sets of shingles), ``size``, ``bands`` and ``signature``."""

    @arrow_udf("struct<set: long, size: long, bands: array<long>, signature: binary>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        times, plus = near.hashes()
        for batch in batches:
            names, sizes, low = [], [], np.zeros((len(batch), len(times)), np.uint32)
            for i, own in enumerate(shingle_sets(batch)):
                names.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
                sizes.append(len(own))
                low[i] = minima(own, times, plus)
            places = pa.array(np.arange(len(batch) + 1, dtype=np.int32) * near.bands)
            lists = pa.ListArray.from_arrays(places, pa.array(bands(low, near).ravel().view(np.int64)))
            signs = pa.array([row.tobytes() for row in low.astype(np.uint8)], pa.binary())
            yield pa.StructArray.from_arrays([pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), lists, signs], ["set", "size", "bands", "signature"])

    prepare(docs.sparkSession)
    return docs.withColumn("__s", of("text")).drop("text").select("*", "__s.*").drop("__s")


@arrow_udf(BinaryType())
def _packed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([own.tobytes() for own in shingle_sets(batch)], pa.binary())


def _views(batch: pa.Array) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in batch.to_pylist()]


def _with(pairs: DataFrame, table: DataFrame, columns: list[str], *values: str) -> DataFrame:
    """``pairs`` with the ``values`` of each of their ``columns``, which name sets."""
    for column in columns:
        pairs = pairs.join(table.select(F.col("set").alias(column), *(F.col(v).alias(f"{v}_{column}") for v in values)), column)
    return pairs


def _promising(pairs: DataFrame, signs: DataFrame, near: Near) -> DataFrame:
    """The (a, b) of ``pairs`` whose sizes and signatures allow near copies."""
    least = near.least_equal()

    @arrow_udf("boolean")
    def close(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            both = (np.frombuffer(b"".join(x.to_pylist()), np.uint8).reshape(len(x), -1) for x in (left, right))
            yield pa.array(np.equal(*both).sum(axis=1) >= least)

    met = _with(pairs, signs, ["a", "b"], "size", "signature")
    fits = F.least("size_a", "size_b") * near.least[1] >= F.greatest("size_a", "size_b") * near.least[0]
    return met.where(fits).where(close("signature_a", "signature_b")).select("a", "b")


def _verified(pairs: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The (a, b) of ``pairs`` that are near copies by their full ``sets``."""

    @arrow_udf("boolean")
    def same(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array([near.same(len(np.intersect1d(a, b, assume_unique=True)), len(a), len(b)) for a, b in zip(_views(left), _views(right), strict=True)], pa.bool_())

    return written(_with(pairs, sets, ["a", "b"], "shingles").where(same("shingles_a", "shingles_b")).select("a", "b"), "minhash-links")


_SPREAD = ", ".join(f"{c} long" for c in ["lead", "element", "a", "of", "size", "differs", "place", *_WORDS])


def _differences(near: Near) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function that turns (lead, a, of, both sets) into the first elements of each difference, with their places."""
    num, den = near.least

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leads, members, of = (batch.column(c).to_numpy() for c in ("lead", "a", "of"))
            columns: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(7 + len(_WORDS))]
            for i, (x, p) in enumerate(zip(_views(batch.column("shingles_a")), _views(batch.column("shingles_lead")), strict=True)):
                own = np.concatenate((np.setdiff1d(x, p, assume_unique=True), np.setdiff1d(p, x, assume_unique=True)))
                # A partner may differ by len(x) * (1 - J) / J elements at most; with the larger difference, by half of that.
                most = len(x) * (den - num) // num
                first = own[: most + 1].view(np.int64)
                n = len(first)
                odd = np.bincount((x % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
                values = (leads[i], first, members[i], of[i], len(x), len(own), np.arange(n), *np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                for column, value in zip(columns, values, strict=True):
                    column.append(value if isinstance(value, np.ndarray) else np.full(n, value, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [c.split()[0] for c in _SPREAD.split(", ")])

    return spread


def _between(members: DataFrame, sets: DataFrame, near: Near) -> DataFrame:
    """The pairs (a, b) of members of one leader that are in different components and can be near copies.

    ``members`` is (lead, a, of): each set held against a leader, with its component.
    """
    num, den = near.least
    mixed = members.groupBy("lead").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("lead")
    rows = _with(members.join(mixed, "lead"), sets, ["a", "lead"], "shingles")
    spread = written(rows.mapInArrow(_differences(near), _SPREAD), "minhash-differences")
    apart = spread.groupBy("lead", "element").agg(F.min("of").alias("low"), F.max("of").alias("high")).where("low <> high").select("lead", "element")
    # Repeated values make these rows a tenth of their size on disk, by which Spark would choose to send them to the driver.
    spread = spread.hint("merge").join(apart, ["lead", "element"])
    l, r = spread.where(F.col("place") <= F.floor(F.col("size") * (den - num) / (2 * num)) + 1).alias("l"), spread.alias("r")
    sizes = F.col("l.size") + F.col("r.size")
    differ = F.col("l.differs") + F.col("r.differs")
    parity = reduce(add, (F.bit_count(F.col(f"l.{w}").bitwiseXOR(F.col(f"r.{w}"))) for w in _WORDS))
    left = F.least(F.col("l.differs") - F.col("l.place"), F.col("r.differs") - F.col("r.place"))
    met = l.join(
        r,
        (F.col("l.lead") == F.col("r.lead"))
        & (F.col("l.element") == F.col("r.element"))
        & (F.col("l.of") != F.col("r.of"))
        & (F.col("l.differs") <= F.col("r.differs"))
        & (2 * (den + num) * left >= (den + num) * differ - (den - num) * sizes)
        & ((den + num) * parity <= (den - num) * sizes),
    )
    return met.select(F.least("l.a", "r.a").alias("a"), F.greatest("l.a", "r.a").alias("b")).distinct()


def roots(sketched: DataFrame, texts: DataFrame, near: Near, more: DataFrame | None = None) -> DataFrame:
    """(node, root) of every ``set`` that has a near copy in ``sketched``; ``texts`` is (set, text), one row for each set.

    Sets without shingles have no near copies. ``more`` has pairs (a, b) of sets that another search proposes: they are
    verified on the full sets like any other.
    """
    grouped = sketched.where("size > 0").groupBy("set").agg(F.count("*").alias("copies"), *(F.first(c).alias(c) for c in ("size", "bands", "signature")))
    one = written(grouped, "minhash-sets")
    spread = one.select("set", "copies", F.explode("bands").alias("band"))
    leaders = spread.groupBy("band").agg(F.count("*").alias("n"), F.min(F.struct(-F.col("copies"), "set")).alias("first")).where("n > 1")
    # Spark sizes the exploded bands as if there were one of each set: merged, they are never sent to the driver.
    held = spread.hint("merge").join(leaders.select("band", F.col("first.set").alias("b")), "band").where("set <> b")
    held = written(held.select(F.col("set").alias("a"), "b").distinct(), "minhash-held")
    close = _promising(held, one, near)
    close = written(close if more is None else close.unionByName(more).distinct(), "minhash-close")
    # Full sets are needed of close pairs, and of leaders with several members.
    several = held.groupBy("b").count().where("count > 1").select("b")
    wanted = close.unionByName(held.join(several, "b").select("a", "b"))
    wanted = wanted.select(F.col("a").alias("set")).unionByName(wanted.select(F.col("b").alias("set"))).distinct()
    sets = written(texts.join(wanted, "set").select("set", _packed("text").alias("shingles")), "minhash-shingles")
    links = _verified(close, sets, near)
    named = components(_edges(links), "minhash")
    members = held.join(several, "b").join(named.select(F.col("node").alias("a"), "root"), "a", "left")
    members = written(members.select(F.col("b").alias("lead"), "a", F.coalesce("root", "a").alias("of")), "minhash-members")
    found = _promising(written(_between(members, sets, near), "minhash-between"), one, near)
    return components(_edges(links.unionByName(_verified(found, sets, near))), "minhash")


def _edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("a").alias("u"), F.col("b").alias("v"))


def grouped(docs: DataFrame, near: Near, key: str, proposed: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the columns of ``docs`` with set and size in place of text, (set, root) of every set that has a near copy).

    ``key`` is a column that tells rows of different texts apart; one row of each set gives its text. ``proposed`` makes pairs
    (a, b) of sets to verify besides those of the bands, from the rows with set and size.
    """
    marked = written(sketches(docs, near), "minhash-rows")
    chosen = marked.groupBy("set").agg(F.min(key).alias(key))
    texts = docs.select(key, "text").join(chosen, key).select("set", "text").dropDuplicates(["set"])
    more = None if proposed is None else proposed(marked.drop("bands", "signature"))
    return marked.drop("bands", "signature"), roots(marked, texts, near, more).withColumnRenamed("node", "set")


def groups(docs: DataFrame, near: Near = COPIES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of (doc_id, text).

    ``component_id`` is the smallest doc_id that the row reaches by links, itself included; a row without doc_id is linked
    like any other and gets the group's id, which is null if no row of the group has one. ``kept`` says that the row's doc_id
    is its component_id, null being equal to null. Null texts and texts without words have no shingles and are linked with
    nothing. Rows of equal id and text are all kept or all not. Other columns are not read.
    """
    keyed = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("key"))
    marked, found = grouped(keyed, near, "key")
    named = marked.groupBy("set").agg(F.min("doc_id").alias("least")).join(found, "set", "left").withColumn("group", F.coalesce("root", "set"))
    named = written(named.select("set", "group", "least"), "minhash-named")
    least = named.groupBy("group").agg(F.min("least").alias("least"))
    # One row for each set, so the rows of a hot set are spread by the join's own splitting.
    table = named.select("set", "group").join(least, "group").select("set", "least")
    component = F.when(F.col("size") > 0, F.col("least")).otherwise(F.col("doc_id"))
    done = marked.join(table, "set").select("doc_id", F.col("size").alias("n_shingles"), component.alias("component_id"))
    return done.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near copies among all documents: their groups, and whether each row is the one to keep."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


# Links are found by counting the shingles that two documents share; components by spreading the smallest id.
OP13_SQL = r"""
WITH RECURSIVE split AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), shingles AS (
    SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(words) - 4, 1) + 1), lambda i: array_to_string(words[i:i + 4], ' '))) AS shingle
    FROM split WHERE len(words) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id
), shared AS (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS n
    FROM shingles l JOIN shingles r ON l.shingle = r.shingle AND l.doc_id <> r.doc_id GROUP BY ALL
), links AS (
    SELECT a, b FROM shared JOIN sizes l ON l.doc_id = a JOIN sizes r ON r.doc_id = b
    WHERE 100 * shared.n >= 85 * (l.n + r.n - shared.n)
), reached AS (
    SELECT a AS doc_id, b AS other FROM links
    UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
), least AS (
    SELECT doc_id, min(other) AS other FROM reached GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, other) AS component_id, d.doc_id = least(d.doc_id, other) AS kept
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN least USING (doc_id)
"""
