"""Token-id files: Parquet list columns, written and read back selectively."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices
from .tokens import Encoder

FILE_SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
ENCODINGS = ("dictionary", "delta")


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    encoding: str = "dictionary",
    row_group_bytes: int = 16 << 20,
    page_bytes: int = 256 << 10,
) -> None:
    """Encode ``text`` and write one row a document, in ascending ``doc_id`` order over
    the files and inside each.

    The rows are dealt by ranges of ``doc_id`` (and a hash of the text, so that rows with
    one id can be split), encoded after that, and streamed into the files: no task holds
    more than a batch. ``dictionary`` stores ids as 16-bit dictionary indexes, ``delta``
    as DELTA_BINARY_PACKED. Small pages carry a page index (minimum, maximum and first
    row of each), and row groups are bounded, so that a reader that wants one document
    or only the counts reads little.

    A null text is empty and has the end id alone; null ids come first; rows with equal
    ids are ordered by a hash of their texts; other columns are ignored.
    """
    if encoding not in ENCODINGS:
        raise ValueError(f"encoding must be one of {ENCODINGS}")
    tie = F.xxhash64("text")
    dealt = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    schema = pa.schema(
        [("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("tokens", pa.list_(pa.int32()))]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in slices(batches, "text"):
            codes = Encoder.shared(tokenizer_path).encode(batch.column(1).to_pylist(), end_id)
            counts = np.array([len(c) // 4 for c in codes], dtype=np.int64)
            ends = np.cumsum(counts)
            values = np.frombuffer(b"".join(codes), dtype="<i4")
            lists = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), values)
            starts = before + ends - counts
            before += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(codes), part, np.int32)), pa.array(starts), pa.array(counts), lists], schema=schema
            )

    (
        dealt.mapInArrow(encode, FILE_SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", str(encoding == "dictionary").lower())
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(page_bytes))
        .option("compression", "zstd")
        .parquet(path)
    )


def read_tokens(spark, path: str) -> DataFrame:
    """The documents of such files with ``start``, the number of ids before each in the
    whole set. Reads only the counts for that, not the ids. The table of parts is broadcast:
    it has two numbers for each task that wrote files, whatever the files hold."""
    files = spark.read.schema(FILE_SCHEMA).parquet(path)
    totals = files.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("before"))
    return files.join(F.broadcast(offsets), "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "tokens")


def token_digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens (counted anew) and the CRC-32 of the ids of each row."""
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            offsets = lists.offsets.to_numpy()
            raw = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")).cast("B")
            crcs = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], schema=schema
            )

    return tokens.select("doc_id", "start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
