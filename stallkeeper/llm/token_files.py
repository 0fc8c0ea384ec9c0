"""Token files: concatenated ids with Elias-Fano encoded document boundaries.

A file is a set of blocks in ascending doc_id order. A block holds the ids of a run of documents as one array of 16- or
32-bit little-endian integers, the ends of its documents and the documents' ids as Elias-Fano sequences: of each of n values
below u the lower log2(u / n) bits are stored as they are, the upper ones as the gaps between set bits of one bit string, about
2 + log2(u / n) bits a value instead of 64. `select` finds the i-th value from a count of set bits per 64-bit word.
Blocks are rows of a Parquet table, so writing is committed whole and any store that Spark reaches will do.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from stallkeeper.llm import words as W
from stallkeeper.llm.encode import encoder

#: Ids in a block at least, but for the last of a task.
BLOCK_IDS = 1 << 18


class EliasFano:
    """A non-decreasing sequence of n non-negative integers below `universe`, in near-minimal space."""

    def __init__(self, n: int, universe: int, low: bytes, high: bytes):
        self.n, self.low, self.high = n, low, high
        self.bits = max(0, (universe // n).bit_length() - 1) if n else 0
        self._ones: np.ndarray | None = None

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.int64)
        out = cls(len(values), universe, b"", b"")
        if len(values):
            below = (values[:, None] >> np.arange(out.bits)) & 1
            out.low = np.packbits(below.astype(np.uint8).ravel(), bitorder="little").tobytes()
            high = np.zeros((int(values[-1]) >> out.bits) + len(values), np.uint8)
            high[(values >> out.bits) + np.arange(len(values))] = 1
            out.high = np.packbits(high, bitorder="little").tobytes()
        return out

    def _lower(self, i: np.ndarray) -> np.ndarray:
        if not self.bits:
            return np.zeros(len(i), np.int64)
        low = np.frombuffer(self.low, np.uint8)
        at = i[:, None] * self.bits + np.arange(self.bits)
        return (((low[at >> 3] >> (at & 7)) & 1).astype(np.int64) << np.arange(self.bits)).sum(axis=1)

    def decode(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8), bitorder="little"))
        i = np.arange(self.n)
        return ((ones - i) << self.bits) + self._lower(i)

    def select(self, i: int) -> int:
        """The i-th value, without decoding the others."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        if self._ones is None:
            padded = np.frombuffer(self.high + bytes(-len(self.high) % 8), "<u8")
            self._ones = np.concatenate([[0], np.cumsum(np.bitwise_count(padded), dtype=np.int64)])
        word = int(np.searchsorted(self._ones, i, "right")) - 1
        bits = int.from_bytes(self.high[8 * word : 8 * word + 8], "little")
        for _ in range(i - int(self._ones[word])):
            bits &= bits - 1
        place = 64 * word + (bits & -bits).bit_length() - 1
        return ((place - i) << self.bits) + int(self._lower(np.array([i]))[0])

    def size(self) -> int:
        return len(self.low) + len(self.high)


_BLOCK = [
    ("part", pa.int32()), ("block", pa.int64()), ("width", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_null", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()),
    ("ids_low", pa.binary()), ("ids_high", pa.binary()), ("ends_low", pa.binary()), ("ends_high", pa.binary()), ("ids", pa.binary()),
]
SCHEMA = "part int, block long, width int, n_docs long, n_ids long, n_null long, first_id long, last_id long, ids_low binary, ids_high binary, ends_low binary, ends_high binary, ids binary"


def make_block(part: int, number: int, width: int, doc_ids: list[int | None], ids: list[bytes]) -> pa.RecordBatch:
    """One block of documents in ascending order, those without an id first."""
    known = np.array([d for d in doc_ids if d is not None], np.int64)
    ends = np.cumsum([len(x) // width for x in ids], dtype=np.int64)
    first, last = (int(known[0]), int(known[-1])) if len(known) else (0, 0)
    keys, stops = EliasFano.encode(known - first, last - first + 1), EliasFano.encode(ends, int(ends[-1]) + 1)
    row = (part, number, width, len(ids), int(ends[-1]), len(ids) - len(known), first, last, keys.low, keys.high, stops.low, stops.high, b"".join(ids))
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, (_, t) in zip(row, _BLOCK, strict=True)], [n for n, _ in _BLOCK])


def read_block(row: dict) -> tuple[list[int | None], EliasFano, bytes]:
    """(doc ids, ends, ids) of a block."""
    known = row["n_docs"] - row["n_null"]
    keys = EliasFano(known, row["last_id"] - row["first_id"] + 1, row["ids_low"], row["ids_high"]).decode() + row["first_id"]
    return [None] * row["n_null"] + keys.tolist(), EliasFano(row["n_docs"], row["n_ids"] + 1, row["ends_low"], row["ends_high"]), row["ids"]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int, spaced: bool = True, width: int = 2) -> None:
    """Encodes `docs` (doc_id, text, ...) and writes a token file at `path`, in ascending doc_id order.

    Null and empty texts are the end id alone; rows without a doc_id come first; repeated rows are written each, rows of one
    doc_id in the order of a hash of their texts. Ids that `width` bytes cannot hold raise an error. The one shuffle deals
    the texts by ranges of doc_id (and text hash, so a repeated id spreads). A task keeps one block in memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, spaced, width).encode
        end = np.array([end_id], f"<u{width}").tobytes()
        part, number, keys, held, size = 0, 0, [], [], 0
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            part = batch.column(1)[0].as_py() if batch.num_rows else part
            for lo, hi, data, offsets in W.slices(batch.column(2)):
                raw = data.tobytes()
                found = [x + end for x in encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)])]
                keys, held, size = keys + doc_ids[lo:hi], held + found, size + sum(map(len, found)) // width
                if size >= BLOCK_IDS:
                    yield make_block(part, number, width, keys, held)
                    number, keys, held, size = number + 1, [], [], 0
        if held:
            yield make_block(part, number, width, keys, held)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("digest", F.xxhash64("text"))
    dealt = rows.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")
    dealt.select("doc_id", F.spark_partition_id().alias("part"), "text").mapInArrow(run, SCHEMA).write.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, width, ids): the documents of a token file; start counts the ids of all documents before.

    Starts come from the blocks' sizes: sums by task, one row each, then within each task, then within each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in chain.from_iterable(batch.slice(k, 1).to_pylist() for k in range(batch.num_rows)):
                doc_ids, ends, ids = read_block(row)
                stops = np.array([ends.select(i) for i in range(ends.n)], np.int64)
                starts = np.concatenate([[0], stops[:-1]])
                width = row["width"]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc_ids, pa.int64()), pa.array(starts + row["before"]), pa.array(stops - starts), pa.array([width] * len(doc_ids), pa.int32()), pa.array([ids[width * a : width * b] for a, b in zip(starts, stops, strict=True)], pa.binary())],
                    ["doc_id", "start", "n_tokens", "width", "ids"],
                )

    blocks = spark.read.schema(SCHEMA).parquet(path)
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    before_part = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before_block = F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sizes.select("part", "block", before_block.alias("inside")).join(parts.select("part", before_part.alias("before")), "part").select("part", "block", (F.col("before") + F.col("inside")).alias("before"))
    return blocks.join(placed, ["part", "block"]).mapInArrow(run, "doc_id long, start long, n_tokens long, width int, ids binary")


def ids_crc32(documents: DataFrame) -> DataFrame:
    """`documents` of read_tokens with `ids_crc32`: unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            width = batch.column(3).to_pylist()
            crc = [zlib.crc32(np.frombuffer(x.as_py(), f"<u{w}").astype("<u4").tobytes()) for x, w in zip(batch.column(4), width, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return documents.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
