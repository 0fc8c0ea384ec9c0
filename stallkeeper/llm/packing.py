"""Packing by power-of-two decomposition: documents are cut into pieces of binary lengths, each a sequence of its own.

A document of n tokens gives n // LONGEST pieces of the longest length and one for each bit of the rest, longest first. So
no sequence holds tokens of two documents and none needs padding; training draws batches from one length bucket at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallkeeper.llm import words as W
from stallkeeper.llm.encode import encoder

LONGEST = 4096


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths of the pieces of a document of n tokens; they sum to n."""
    rest = n % longest
    return [longest] * (n // longest) + [1 << b for b in range(longest.bit_length() - 1, -1, -1) if rest >> b & 1]


SCHEMA = "doc_id long, start long, length long, bucket int, ids binary, doc_tokens long"


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST) -> DataFrame:
    """(doc_id, start, length, bucket, ids, doc_tokens, sequence_id, offset): one row for each piece of each document.

    `tokenizer` is the path of a vocabulary file that every executor has; `longest` a power of two. `ids` are 32-bit
    little-endian token ids, `bucket` the binary logarithm of the length, `sequence_id` the number of the sequence (a piece
    fills its sequence, so offset is 0): unique, and the same on every run over the same files. Null and empty texts are the
    end id alone; a null doc_id is kept as it is; repeated rows are packed each. Nothing is shuffled: a task cuts its own
    documents. `write_buckets` lays the sequences out by length.
    """
    if longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, False, 4).encode
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for lo, hi, data, offsets in W.slices(batch.column(1)):
                raw, out = data.tobytes(), []
                for doc_id, tokens in zip(ids[lo:hi], encode([raw[a:b].decode() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]), strict=True):
                    tokens += end
                    start, n = 0, len(tokens) // 4
                    for length in lengths(n, longest):
                        out.append((doc_id, start, length, length.bit_length() - 1, tokens[4 * start : 4 * (start + length)], n))
                        start += length
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "start", "length", "bucket", "ids", "doc_tokens"])

    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
    return pieces.withColumn("sequence_id", F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(pieces: DataFrame, path: str) -> None:
    """Writes the sequences below `path`, one folder for each length bucket."""
    pieces.write.partitionBy("bucket").parquet(path)
