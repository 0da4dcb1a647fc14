"""Token-id files: a concatenated id array with Elias-Fano coded document boundaries.

Documents are range-partitioned by doc_id (a shard is a range), tokenised inside the shard, and written as blocks of about a
million ids. A block holds the ids in 16 or 32 bits and its documents' end offsets e_1 <= ... <= e_n <= u in Elias-Fano code:
l = floor(log2(u / n)) low bits of each offset, packed; the high parts in unary in a bit vector of n + (u >> l) + 1 bits. That
takes about 2 + log2(u / n) bits a document. select1 over the bit vector finds the i-th offset by a popcount directory and
one byte, so any document's ids are found without a table of 64-bit offsets.

The blocks are rows of a Parquet table (columns: shard, block, n_docs, n_ids, width, doc_ids, ids, low, high, directory, low_bits),
so any file system Spark knows can hold them. The ids before a block follow from the blocks' own counts: sums within a shard run
where the shard is written, and sums over shards run over one row a shard.

Defined results: null text is empty (only the end id); empty tables give an empty file; repeated doc_ids are documents of their
own, in the order of their texts; null doc_ids come first; a single very long document makes a block of its own.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import tokens
from corpusloom.llm.common import shuffle_parts, stored

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
BLOCK_IDS = 1 << 20
_POPCOUNT = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Bytes of the unary bit vector for each entry of the popcount directory.
_STRIDE = 64


def elias_fano(ends: np.ndarray, universe: int) -> tuple[int, bytes, bytes, bytes]:
    """(low_bits, low, high, directory) of a non-decreasing array of end offsets up to universe."""
    n = len(ends)
    low_bits = max(0, (universe // n).bit_length() - 1) if n else 0
    ends = ends.astype(np.uint64)
    bits = (ends[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
    low = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    high = np.zeros(n + (universe >> low_bits) + 1, np.uint8)
    high[(ends >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)] = 1
    packed = np.packbits(high, bitorder="little")
    counts = np.add.reduceat(_POPCOUNT[packed], np.arange(0, len(packed), _STRIDE), dtype=np.int64)
    directory = np.concatenate([[0], np.cumsum(counts)[:-1]]).astype("<u4")
    return low_bits, low, packed.tobytes(), directory.tobytes()


class Boundaries:
    """Reads the Elias-Fano code of a block."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes, directory: bytes):
        self.n, self.low_bits = n, low_bits
        self.low = np.frombuffer(low, np.uint8)
        self.high = np.frombuffer(high, np.uint8)
        self.directory = np.frombuffer(directory, "<u4")

    def end(self, i: int) -> int:
        """The end offset of document i (0-based): select1 of i in the high bits, then the low bits."""
        at = int(np.searchsorted(self.directory, i, side="right")) - 1
        left = i - int(self.directory[at])
        part = self.high[at * _STRIDE : (at + 1) * _STRIDE]
        seen = np.cumsum(_POPCOUNT[part])
        byte = int(np.searchsorted(seen, left, side="right"))
        left -= int(seen[byte - 1]) if byte else 0
        ones = np.flatnonzero(np.unpackbits(part[byte : byte + 1], bitorder="little"))
        position = (at * _STRIDE + byte) * 8 + int(ones[left])
        first = i * self.low_bits
        bits = np.unpackbits(self.low[first // 8 : (first + self.low_bits + 7) // 8], bitorder="little")[first % 8 :][: self.low_bits]
        return ((position - i) << self.low_bits) | int((bits.astype(np.int64) << np.arange(self.low_bits)).sum())

    def span(self, i: int) -> tuple[int, int]:
        return (self.end(i - 1) if i else 0), self.end(i)

    def ends(self) -> np.ndarray:
        """All end offsets at once."""
        high = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n] - np.arange(self.n)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.int64)
        return (high.astype(np.int64) << self.low_bits) | (bits << np.arange(self.low_bits)).sum(axis=1)


BLOCKS = "shard int, block int, before long, n_docs int, n_ids long, width int, doc_ids array<bigint>, ids binary, low_bits int, low binary, high binary, directory binary"


def _blocks(path: str, end_id: int, block_ids: int):
    def run(batches):
        from pyspark import TaskContext

        shard, enc = TaskContext.get().partitionId(), tokens.encoder(path)
        end = np.array([end_id], enc.dtype).tobytes()
        number, before, held, docs, sizes = 0, 0, [], [], []

        def flush():
            nonlocal number, before, held, docs, sizes
            n_ids = sum(sizes)
            low_bits, low, high, directory = elias_fano(np.cumsum(np.array(sizes, np.int64)), n_ids)
            row = [shard, number, before, len(docs), n_ids, enc.dtype.itemsize, docs, b"".join(held), low_bits, low, high, directory]
            number, before, held, docs, sizes = number + 1, before + n_ids, [], [], []
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _TYPES)], names=_NAMES)

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for first, last in tokens.text_runs(texts):
                for doc, raw in zip(ids[first:last], enc.encode(texts[first:last])):
                    held.append(raw + end)
                    docs.append(doc)
                    sizes.append(len(held[-1]) // enc.dtype.itemsize)
                if sum(sizes) >= block_ids:
                    yield flush()
        if docs:
            yield flush()

    return run


_NAMES = [c.split()[0] for c in BLOCKS.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]


def write_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = END_ID, block_ids: int = BLOCK_IDS, partitions: int | None = None) -> DataFrame:
    """The blocks of all documents in ascending doc_id order, as a stored table."""
    path = vocabulary or tokens.public_path(VOCABULARY)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ranged = rows.repartitionByRange(partitions or shuffle_parts(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return stored(ranged.mapInArrow(_blocks(path, end_id, block_ids), BLOCKS), "token-blocks")


def _documents(batches):
    for batch in batches:
        cols = dict(zip(batch.schema.names, batch.columns))
        for r in range(batch.num_rows):
            get = {k: v[r] for k, v in cols.items()}
            n = get["n_docs"].as_py()
            marks = Boundaries(n, get["low_bits"].as_py(), get["low"].as_py(), get["high"].as_py(), get["directory"].as_py())
            ids = np.frombuffer(get["ids"].as_buffer(), f"<u{get['width'].as_py()}")
            ends = marks.ends()
            starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
            crcs = np.fromiter((zlib.crc32(ids[a:b].astype("<u4").data) for a, b in zip(starts, ends)), np.int64, n)
            before = get["before"].as_py() + get["shards_before"].as_py()
            yield pa.RecordBatch.from_arrays([get["doc_ids"].values, pa.array(before + starts), pa.array(ends - starts), pa.array(crcs)], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_documents(blocks: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document of the blocks."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    shards = shards.select("shard", F.coalesce(F.sum("n").over(order), F.lit(0)).cast("long").alias("shards_before"))
    joined = blocks.join(F.broadcast(shards), "shard")  # one row of 16 bytes for each partition of the writing job
    return joined.mapInArrow(_documents, "doc_id long, start long, n_tokens long, ids_crc32 long")
