"""Near copies by SimHash: fingerprints within ``RADIUS`` differing bits belong to one group.

Meet in the middle: two fingerprints at a distance of at most three meet in a variant of both that is within half of it.
Half of three is one flipped bit and a half step, which is taken by erasing one of ``BLOCKS`` blocks of bits: if the
fingerprints differ, one of the differing bits lies in some block; with that block erased at most two differing bits are
left, so flipping none or one bit of each makes the rest equal. Every distinct fingerprint emits, for each erased block,
the rest and the rest with one bit flipped. Variants are shuffled; those of two or more fingerprints are joined with
themselves and verified on all 64 bits.

Equal fingerprints are one row before anything is emitted, so groups of copies cost nothing here. Pairs that collide by
chance die in the join's condition; each true pair comes out of several variants, and one of them, fixed by the pair
itself, is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm import minhash
from docledger.llm.components import components
from docledger.llm.shared import prepare, written

SHINGLE = 3
SEED = 42
RADIUS = 3
BITS = 64
BLOCKS = 4
WIDTH = BITS // BLOCKS


def simhash(text: str | None) -> int:
    """The fingerprint of one text as an unsigned number; 0 for a text without words or a null one."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words))) + np.arange(len(words))
        starts = np.concatenate(([0], ends[:-1] + 1))
        cut = [joined[a:b] for a, b in zip(starts[: -SHINGLE + 1].tolist(), ends[SHINGLE - 1 :].tolist(), strict=True)]
        hashes = [xxhash.xxh64_intdigest(x, SEED) for x in cut]
    ones = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    # Sums by blocks of rows, in whole numbers small enough to add quickly.
    count = np.zeros(BITS, np.int64)
    for at in range(0, len(ones), 1 << 16):
        count += ones[at : at + (1 << 16)].sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, out: str = "fp") -> DataFrame:
    """Add ``out``: the fingerprint of the whole ``text`` as a signed 64-bit number. It is replaced if present.

    Lower case is of A to Z only, words are split at ASCII blanks, shingles of three words count as often as they occur;
    a shorter text is one shingle. A bit is 1 if more than half of the shingles' hashes have it.
    """

    @arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array(np.array([simhash(t) for t in batch.to_pylist()], np.uint64).view(np.int64))

    prepare(docs.sparkSession)
    return docs.withColumn(out, of("text"))


def _variants(fps: DataFrame) -> DataFrame:
    """(block, rest, fp): for every fingerprint and erased block, the other bits with none or one of them flipped."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flips = np.concatenate(([0], np.uint64(1) << np.arange(BITS, dtype=np.uint64))).astype(np.uint64)
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            for block in range(BLOCKS):
                erased = np.uint64(((1 << WIDTH) - 1) << (block * WIDTH))
                own = flips[(flips & erased) == 0]
                rest = ((fp & ~erased)[:, None] ^ own[None, :]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rest), block, np.int8)), pa.array(rest.view(np.int64)), pa.array(np.repeat(fp, len(own)).view(np.int64))], ["block", "rest", "fp"]
                )

    return fps.mapInArrow(spread, "block byte, rest long, fp long")


def _meeting(a: Column, b: Column) -> tuple[Column, Column]:
    """The one (block, rest) in which the verified pair is reported.

    The block is the first that leaves at most two differing bits outside it. The rest is that of ``a``, with the lowest
    differing bit outside the block flipped, if any.
    """
    diff = a.bitwiseXOR(b)

    def outside(block: int) -> Column:
        return diff.bitwiseAND(F.lit(_signed(~(((1 << WIDTH) - 1) << (block * WIDTH)))))

    block = F.coalesce(*(F.when(F.bit_count(outside(k)) <= RADIUS - 1, F.lit(k)) for k in range(BLOCKS)))
    masks = F.array(*(F.lit(_signed(~(((1 << WIDTH) - 1) << (k * WIDTH)))) for k in range(BLOCKS)))
    mask = F.get(masks, block)
    left = diff.bitwiseAND(mask)
    # The lowest set bit is x & -x; the one value whose negative overflows is its own lowest bit.
    top = F.lit(-(1 << (BITS - 1)))
    lowest = F.when(left == top, left).otherwise(left.bitwiseAND(F.try_subtract(F.lit(0), left)))
    return block, a.bitwiseAND(mask).bitwiseXOR(lowest)


def _signed(bits: int) -> int:
    bits &= (1 << BITS) - 1
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def links(fps: DataFrame) -> DataFrame:
    """(a, b): all pairs of different fingerprints in ``fps`` (distinct ``fp``) with at most ``RADIUS`` differing bits, a < b."""
    spread = _variants(fps)
    block, rest = _meeting(F.col("l.fp"), F.col("r.fp"))
    # Spark sizes the variants as if there were one of each fingerprint: merged, they are never sent to the driver.
    left, right = spread.hint("merge").alias("l"), spread.alias("r")
    met = left.join(
        right,
        (F.col("l.block") == F.col("r.block"))
        & (F.col("l.rest") == F.col("r.rest"))
        & (F.col("l.fp") < F.col("r.fp"))
        & (F.bit_count(F.col("l.fp").bitwiseXOR(F.col("r.fp"))) <= RADIUS)
        & (F.col("l.block") == block)
        & (F.col("l.rest") == rest),
    )
    return met.select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"))


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, group_fp, component_id) of every row of (doc_id, text).

    ``group_fp`` names the group: the smallest fingerprint that the row reaches by links. ``component_id`` is the
    group's smallest doc_id. Texts without words share fingerprint zero and are one group. A row without doc_id is linked
    like any other and gets the group's id, which is null only if no row of the group has one.
    """
    marked = written(fingerprints(docs.select("doc_id", "text")).drop("text"), "simhash-fingerprints")
    distinct = marked.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = components(links(distinct).select(F.col("a").alias("u"), F.col("b").alias("v")), "simhash")
    named = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group_fp", F.coalesce("root", "fp"))
    named = named.select("fp", "group_fp", "least")
    # One row for each fingerprint, so a hot fingerprint's rows are spread by the join's own splitting.
    ids = named.groupBy("group_fp").agg(F.min("least").alias("component_id"))
    table = written(named.join(ids, "group_fp").select("fp", "group_fp", "component_id"), "simhash-groups")
    return marked.join(table, "fp")


def proposed(marked: DataFrame) -> DataFrame:
    """(a, b): pairs of sets of shingles whose fingerprints are equal or linked, from rows of (set, size, fp).

    Of the sets of one fingerprint each is paired with the smallest, and the smallest ones stand for linked fingerprints.
    """
    sets = marked.where("size > 0").select("set", "fp").distinct()
    leads = written(sets.groupBy("fp").agg(F.min("set").alias("lead")), "simhash-leads")
    ends = [leads.select(F.col("fp").alias(end), F.col("lead").alias(f"set_{end}")) for end in ("a", "b")]
    linked = links(leads.select("fp")).join(ends[0], "a").join(ends[1], "b").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    own = sets.join(leads, "fp").select(F.col("lead").alias("a"), F.col("set").alias("b"))
    return written(linked.unionByName(own).where("a <> b").distinct(), "simhash-proposed")


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of near copies: that with the smallest doc_id. Columns stay.

    Near copies share four fifths of their five-word shingles. Fingerprints that meet in the middle propose pairs, as in
    ``groups``, and the bands of ``minhash`` propose what lies beyond that radius; every pair is verified on the full sets of
    shingles, and the links of both make the groups. Of rows with equal ids a hash of the text decides; rows without id come after those with one; of rows with
    equal id and text one stays.
    """
    keyed = docs.withColumn("__key", F.xxhash64("doc_id", "text"))
    # A pass of its own: a task that also made sketches would hold two Python workers at once.
    printed = written(fingerprints(keyed.select("__key", "text")).select("__key", "fp"), "simhash-printed").dropDuplicates(["__key"])
    marked, found = minhash.grouped(keyed.select("doc_id", "text", "__key"), minhash.ALIKE, "__key", lambda rows: proposed(rows.join(printed, "__key")))
    best = (
        marked.groupBy("set")
        .agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "__key")).alias("first"))
        .join(found, "set", "left")
        .groupBy(F.coalesce("root", "set").alias("group"))
        .agg(F.min("first").alias("first"))
        .select(F.col("first.doc_id").alias("__id"), F.col("first.__key").alias("__first"))
    )
    best = written(best, "minhash-kept")
    kept = keyed.join(best, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__first")), "left_semi")
    return kept.dropDuplicates(["doc_id", "__key"]).drop("__key")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and group of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
