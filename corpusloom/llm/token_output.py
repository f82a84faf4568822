"""Operator 1: token ids as Parquet list columns, in document order.

Documents are range-partitioned and sorted by id, encoded partition by partition and
written as Parquet whose layout is set here: the id lists without a dictionary and in
format v2 (delta encoding of integers), the metadata with dictionaries, small row
groups and pages with page indexes, so that readers can take metadata columns alone or
the ids of a few documents.  File order is document order, row order within a file too.

Cases: a null text is an empty one and has the end id alone; a null id comes first;
rows that repeat an id stay apart, ordered by their texts; an empty table gives no
rows; further columns are not carried.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import Encoder
from .shared import scratch

STORED = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("part_start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
    ]
)
#: Row groups of 16 MB and pages of at most 2,000 rows, with page indexes (the writer's default).
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#ids.list.element": "false",
    "compression": "zstd",
}
#: Rows that are encoded and given on at once, at most: pieces that they share are encoded once.
OUT_ROWS = 1280

_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so that its cache outlives a task."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = -(-batch.num_rows // max(1, -(-batch.num_rows // OUT_ROWS)))  # parts of equal size
            for at in range(0, batch.num_rows, max(1, rows)):
                piece = batch.slice(at, rows)
                ids, offsets = encoder(path).encode(piece.column("text"), end_id)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"),
                        pa.array(np.full(piece.num_rows, part, np.int32)),
                        pa.array(start + offsets[:-1]),
                        pa.array(np.diff(offsets)),
                        pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
                    ],
                    names=[f.name for f in STORED],
                )
                start += int(offsets[-1])

    return run


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, layout: dict | None = None) -> None:
    """Writes ``doc_id, part, part_start, n_tokens, ids`` in ascending order of doc_id."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text")
    ordered.mapInArrow(_encode(tokenizer, end_id), STORED).write.options(**(LAYOUT if layout is None else layout)).parquet(path)


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, part, part_start, n_tokens``: the scan leaves the ids alone."""
    return spark.read.schema(STORED).parquet(path).drop("ids")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(STORED).parquet(path)


def part_starts(spark: SparkSession, path: str) -> DataFrame:
    """``part, base``: ids in the files before it; one row for each file written."""
    totals = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    return totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))


def crc32_of(ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each row's ids as little-endian unsigned 32-bit integers."""
    view = memoryview(np.ascontiguousarray(ids, dtype="<u4")).cast("B")
    return np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(offsets[:-1], offsets[1:])), np.int64, len(offsets) - 1)


def _digests(batches):
    for batch in batches:
        ids = batch.column("ids")
        offsets = np.asarray(ids.offsets, dtype=np.int64)
        crc = crc32_of(np.asarray(ids.values), offsets)
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("doc_id", "part", "part_start")] + [pa.array(np.diff(offsets)), pa.array(crc)], names=["doc_id", "part", "part_start", "n_tokens", "ids_crc32"])


def digests(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every stored document, from the files alone."""
    rows = read_ids(spark, path).mapInArrow(_digests, "doc_id long, part int, part_start long, n_tokens long, ids_crc32 long")
    # one row for each file: as many as tasks that wrote
    joined = rows.join(F.broadcast(part_starts(spark, path)), "part")
    return joined.select("doc_id", (F.col("base") + F.col("part_start")).alias("start"), "n_tokens", "ids_crc32")


def token_ids(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Encodes, writes to the shared folder, reads back."""
    path = scratch(docs.sparkSession, "token-ids")
    write_ids(docs, path, tokenizer, end_id)
    return digests(docs.sparkSession, path)
