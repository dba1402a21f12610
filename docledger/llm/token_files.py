"""Token files: ids under a canonical, length-limited Huffman code, in blocks that decode on their own.

Three passes, none of which sees the corpus in one place:

1. texts are encoded once, and their ids are kept as 16- or 32-bit numbers in the shared folder;
2. ids are counted everywhere; the counts (one row for each id of the vocabulary) give code lengths of at most
   ``MOST_BITS`` by package-merge, and the lengths alone fix the canonical code;
3. each document's ids become bits, which are dealt to ranges of doc_id and written as blocks in that order.

A file is a Parquet table of blocks (range, documents, ids before the block in its range, payload, checkpoints) beside the table
of code lengths. A document starts at a byte; within it the bit offset is noted every ``CHECK`` ids. Decoding looks up
``MOST_BITS`` bits at a time in a table of (id, length); all checkpoints of a block are decoded side by side.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from docledger.llm.bpe import Encoder, encoder, vocabulary_path
from docledger.llm.ordered import range_of
from docledger.llm.shared import new_path, prepare

MOST_BITS = 20
CHECK = 256
# Rows of a range of doc_id, and ids of a block (a longer document is a block of its own).
RANGE_ROWS = 2048
BLOCK_IDS = 1 << 20
END_ID = 1

_BLOCK = "part int, start long, doc_ids array<long>, sizes array<int>, payload binary, checkpoints array<long>"


class LibraryEncoder(Encoder):
    """Encodes the pieces that it has not met before with the model of the tokenizers library."""

    def __post_init__(self) -> None:
        super().__post_init__()
        self._model = self._library.model
        self._symbols = [self.strings[i] for i in self._bytes]

    def merge(self, piece: str) -> list[int]:
        return [t.id for t in self._model.tokenize("".join([self._symbols[b] for b in piece.encode()]))]


_CODERS: dict[str, LibraryEncoder] = {}


def _coder(path: str) -> LibraryEncoder:
    if path not in _CODERS:
        _CODERS[path] = LibraryEncoder(path)
    return _CODERS[path]


def _forget_pieces() -> None:
    """Free what this worker remembers of encoding: the steps that follow are done by the same workers and need the room."""
    _CODERS.clear()


def code_lengths(counts: np.ndarray, most: int = MOST_BITS) -> np.ndarray:
    """Length of each symbol's code (0 where the count is 0): the shortest total of all codes of at most ``most`` bits.

    Package-merge: in each of ``most`` rounds the symbols are merged with pairs of the round before; the cheapest 2n - 2
    entries of the last round, unfolded, say how many bits each symbol gets.
    """
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.int64)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << most:
        raise ValueError(f"{len(used)} symbols do not fit codes of {most} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    rounds: list[np.ndarray] = []
    pairs = np.zeros(0)
    for _ in range(most):
        values = np.concatenate((leaves, pairs))
        sort = np.argsort(values, kind="stable")
        rounds.append(sort < len(leaves))
        values = values[sort]
        pairs = values[: len(values) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take = 2 * len(leaves) - 2
    for is_leaf in reversed(rounds):
        chosen = int(is_leaf[:take].sum())
        lengths[order[:chosen]] += 1
        take = 2 * (take - chosen)
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: by ascending length, then id, each code is the one before plus one, shifted to its length."""
    codes = np.zeros(len(lengths), np.uint64)
    code, before = 0, 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    for symbol in order[lengths[order] > 0].tolist():
        code <<= int(lengths[symbol]) - before
        before = int(lengths[symbol])
        codes[symbol] = code
        code += 1
    return codes


def pack(ids: np.ndarray, at: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, byte offsets of the documents, bit offset of each id): the codes of documents ``at`` (n + 1), each from a byte on."""
    size = lengths[ids]
    ends = np.concatenate(([0], np.cumsum(size)))
    bits = ends[at[1:]] - ends[at[:-1]]
    starts = np.concatenate(([0], np.cumsum((bits + 7) // 8)))
    bit = ends[:-1] + np.repeat(starts[:-1] * 8 - ends[at[:-1]], np.diff(at))
    out = np.zeros(int(starts[-1]) + 8, np.uint8)
    # A code of at most MOST_BITS bits lies in four bytes from its first one on.
    first, shift = bit >> 3, (32 - size - (bit & 7)).astype(np.uint64)
    word = (codes[ids] << shift).astype(np.uint64)
    for k in range(4):
        part = (word >> np.uint64(24 - 8 * k)) & np.uint64(255)
        # Codes do not overlap, so adding is the same as setting bits.
        out[: len(out)] += np.bincount(first + k, part, minlength=len(out)).astype(np.uint8)[: len(out)]
    return out[:-8], starts, bit


class Decoder:
    """The look-up table of a canonical code."""

    def __init__(self, lengths: np.ndarray) -> None:
        codes = canonical(lengths)
        self.symbol, self.size = np.zeros(1 << MOST_BITS, np.int32), np.ones(1 << MOST_BITS, np.uint8)
        for symbol in np.flatnonzero(lengths).tolist():
            free = MOST_BITS - int(lengths[symbol])
            a = int(codes[symbol]) << free
            self.symbol[a : a + (1 << free)], self.size[a : a + (1 << free)] = symbol, lengths[symbol]

    def block(self, payload: bytes, checkpoints: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """All ids of a block: every checkpoint decodes its ids in step with the others."""
        data = np.concatenate((np.frombuffer(payload, np.uint8), np.zeros(8, np.uint8))).astype(np.uint32)
        lanes_of = -(-sizes // CHECK)
        left = np.full(int(lanes_of.sum()), CHECK, np.int64)
        some = lanes_of > 0
        left[np.cumsum(lanes_of)[some] - 1] = (sizes[some] - 1) % CHECK + 1
        goal = np.concatenate(([0], np.cumsum(left)[:-1]))
        out = np.zeros(int(left.sum()), np.int32)
        order = np.argsort(-left, kind="stable")  # lanes that end early are cut off the end
        bit, goal, left = checkpoints[order].copy(), goal[order], left[order]
        alive = len(order)
        for step in range(int(left[0]) if alive else 0):
            if left[alive - 1] <= step:
                alive = int(np.searchsorted(-left, -step, side="left"))
            at = bit[:alive]
            byte = at >> 3
            word = (data[byte] << 24) | (data[byte + 1] << 16) | (data[byte + 2] << 8) | data[byte + 3]
            key = (word >> (32 - MOST_BITS - (at & 7)).astype(np.uint32)) & np.uint32((1 << MOST_BITS) - 1)
            out[goal[:alive] + step] = self.symbol[key]
            bit[:alive] += self.size[key]
        return out


def encoded(docs: DataFrame, path: str, vocabulary: str, end_id: int) -> None:
    """Write (doc_id, order, ids as little-endian numbers) of every document to ``path``; ``end_id`` closes each."""

    @arrow_udf("binary")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = _coder(vocabulary)
        width = "<u2" if len(coder.strings) <= 1 << 16 else "<u4"
        for batch in batches:
            ids, at = coder.encode_batch(batch)
            ids = np.insert(ids, at[1:], end_id).astype(width)
            at = (at + np.arange(len(at))) * ids.itemsize
            yield pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(ids)])

    rows = docs.select("doc_id", F.xxhash64("text").alias("order"), ids_of("text").alias("ids"))
    rows.write.option("compression", "zstd").parquet(path)


def _numbers(batch: pa.Array, width: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of a batch of binary values, offsets n + 1)."""
    offsets = np.frombuffer(batch.buffers()[1], np.int32)[batch.offset : batch.offset + len(batch) + 1].astype(np.int64)
    item = np.dtype(width).itemsize
    data = batch.buffers()[2]
    if data is None:
        return np.zeros(0, np.int64), np.zeros(len(batch) + 1, np.int64)
    return np.frombuffer(data, width, offset=0, count=int(offsets[-1]) // item)[offsets[0] // item :].astype(np.int64), (offsets - offsets[0]) // item


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID) -> None:
    """Write the token files of all rows of (doc_id, text) to the folder ``path``: ``blocks`` and ``codes``.

    Documents are in ascending order of doc_id, null ids first, rows of equal ids by a hash of the text. A null or empty
    text is its end id alone. An empty table gives files without blocks.
    """
    spark = prepare(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    kept = f"{path}/ids"
    encoded(docs, kept, vocabulary, end_id)
    size = len(encoder(vocabulary).strings)
    width = "<u2" if size <= 1 << 16 else "<u4"
    rows = spark.read.parquet(kept)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_pieces()
        total = np.zeros(size, np.int64)
        for batch in batches:
            total += np.bincount(_numbers(batch.column("ids"), width)[0], minlength=size)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    # One row for each id of the vocabulary.
    counts = rows.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    total = np.zeros(size, np.int64)
    total[counts.column("id").to_numpy()] = counts.column("n").to_numpy()
    lengths = code_lengths(total)
    spark.createDataFrame(pa.table({"id": np.arange(size), "bits": lengths})).coalesce(1).write.parquet(f"{path}/codes")
    sent = spark.sparkContext.broadcast((lengths, canonical(lengths)))

    @arrow_udf("struct<n: int, bits: binary, checks: array<int>>")
    def coded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        _forget_pieces()
        lengths, codes = sent.value
        for batch in batches:
            ids, at = _numbers(batch, width)
            data, starts, bit = pack(ids, at, lengths, codes)
            of = np.repeat(np.arange(len(batch)), np.diff(at))
            noted = (np.arange(len(ids)) - at[of]) % CHECK == 0
            checks = (bit - starts[of] * 8)[noted].astype(np.int32)
            many = np.concatenate(([0], np.cumsum(-(-np.diff(at) // CHECK)))).astype(np.int32)
            bits = pa.Array.from_buffers(pa.binary(), len(batch), [None, pa.py_buffer(starts.astype(np.int32)), pa.py_buffer(data)])
            yield pa.StructArray.from_arrays([pa.array(np.diff(at).astype(np.int32)), bits, pa.ListArray.from_arrays(pa.array(many), pa.array(checks))], ["n", "bits", "checks"])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_pieces()
        part, start, held = None, 0, 0
        docs: list[tuple[int | None, int, bytes, np.ndarray]] = []

        def block() -> pa.RecordBatch:
            first = np.concatenate(([0], np.cumsum([len(d[2]) for d in docs]))).astype(np.int64) * 8
            checks = np.concatenate([d[3] + f for d, f in zip(docs, first[:-1], strict=True)])
            row = [[part], [start], [[d[0] for d in docs]], [[d[1] for d in docs]], [b"".join(d[2] for d in docs)], [checks]]
            types = [pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["part", "start", "doc_ids", "sizes", "payload", "checkpoints"])

        for batch in batches:
            columns = [batch.column(c) for c in ("part", "doc_id", "n", "bits", "checks")]
            for i in range(batch.num_rows):
                p, doc, n = (columns[k][i].as_py() for k in range(3))
                if docs and (p != part or held + n > BLOCK_IDS):
                    yield block()
                    start, held, docs = (start + held if p == part else 0), 0, []
                part = p
                docs.append((doc, n, columns[3][i].as_py(), columns[4][i].values.to_numpy().astype(np.int64)))
                held += n
        if docs:
            yield block()

    done = rows.select("doc_id", "order", range_of(rows, rows=RANGE_ROWS).alias("part"), coded("ids").alias("c")).select("part", "doc_id", "order", "c.*")
    dealt = done.repartition("part").sortWithinPartitions("part", F.asc_nulls_first("doc_id"), "order").drop("order")
    dealt.mapInArrow(blocks, _BLOCK).write.option("compression", "none").parquet(f"{path}/blocks")


_DECODERS: dict[str, Decoder] = {}


def _decoder(path: str, sent: Broadcast) -> Decoder:
    if path not in _DECODERS:
        _DECODERS.clear()
        _DECODERS[path] = Decoder(sent.value)
    return _DECODERS[path]


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of every document in the token files at ``path``; ``start`` counts the ids of all before it."""
    table = spark.read.parquet(f"{path}/codes").toArrow()  # one row for each id of the vocabulary
    lengths = np.zeros(table.num_rows, np.int64)
    lengths[table.column("id").to_numpy()] = table.column("bits").to_numpy()
    sent = prepare(spark).sparkContext.broadcast(lengths)
    rows = spark.read.parquet(f"{path}/blocks")
    # One row for each range, and there is a fixed most of ranges.
    sizes = rows.groupBy("part").agg(F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda s, x: s + x)).alias("n"))
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))
    based = rows.join(F.broadcast(before), "part")

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _forget_pieces()
        decoder = _decoder(path, sent)
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                sizes = columns["sizes"][i].values.to_numpy().astype(np.int64)
                ids = decoder.block(columns["payload"][i].as_py(), columns["checkpoints"][i].values.to_numpy(), sizes)
                at = np.concatenate(([0], np.cumsum(sizes)))
                start = at[:-1] + columns["start"][i].as_py() + columns["base"][i].as_py()
                for a in range(0, len(sizes), 500):
                    own = at[a : a + 501]
                    lists = pa.ListArray.from_arrays(pa.array((own - own[0]).astype(np.int32)), pa.array(ids[own[0] : own[-1]]))
                    yield pa.RecordBatch.from_arrays([columns["doc_ids"][i].values[a : a + 500], pa.array(start[a : a + 500]), lists], ["doc_id", "start", "ids"])

    return based.mapInArrow(documents, "doc_id long, start long, ids array<int>")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents written as token files and read back: place, size and checksum of each."""
    path = new_path(spark, "token-files")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, vocabulary_path())

    @arrow_udf("long")
    def checksum(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            ids = batch.flatten().to_numpy(zero_copy_only=False).astype("<u4")
            at = np.concatenate(([0], np.cumsum(batch.value_lengths().to_numpy(zero_copy_only=False))))
            yield pa.array([zlib.crc32(ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.int64())

    return read(spark, path).select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), checksum("ids").alias("ids_crc32"))
