"""Token ids as Parquet lists: files in ascending id order that can be read in part.

Ids are dictionary-encoded (a vocabulary fits a dictionary page), the other columns delta-encoded with
version 2 pages. Row groups and pages have set sizes, and page indexes let a reader skip pages by id.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, small_batches
from .tokens import encoded
from .words import pieces

_SCHEMA = "doc_id long, part int, part_start long, n_tokens long, ids array<int>"


def _list_array(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(ids.view(np.int32)))


def write_tokens(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, row_group_bytes: int = 32 << 20, page_bytes: int = 256 << 10) -> None:
    """Writes (doc_id, part, part_start, n_tokens, ids) for each row of docs, in ascending order of id, under path.

    part numbers the files' ranges of ids, part_start the ids before a document in its part. Each
    document ends with end_id, which n_tokens counts. Null texts are empty. Null ids come last; rows
    that repeat an id follow each other in the order of their texts' hashes, and may lie in several
    parts. Other columns are not written, whatever their names. No documents: no rows.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        part, at = TaskContext.get().partitionId(), 0
        for b in pieces(batches, most=1 << 20):
            ids, counts = encoded(b.column("text"), tokenizer, end_id)
            start = at + np.cumsum(counts) - counts
            at += int(counts.sum())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.full(len(b), part, np.int32)), pa.array(start), pa.array(counts), _list_array(ids, counts)], ["doc_id", "part", "part_start", "n_tokens", "ids"])

    slim = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.xxhash64("text").asc()]
    ranged = slim.repartitionByRange(n_tasks(docs.sparkSession), *order).sortWithinPartitions(*order)
    options = {"parquet.writer.version": "PARQUET_2_0", "parquet.block.size": row_group_bytes, "parquet.page.size": page_bytes, "parquet.enable.dictionary": "true", "parquet.enable.dictionary#doc_id": "false", "parquet.enable.dictionary#part_start": "false", "parquet.enable.dictionary#n_tokens": "false", "compression": "zstd"}
    ranged.mapInArrow(run, _SCHEMA).write.options(**{k: str(v) for k, v in options.items()}).parquet(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens): start counts the ids of all documents before. Reads no ids."""
    return _with_start(spark.read.schema(_SCHEMA).parquet(path), spark, path).select("doc_id", "start", "n_tokens")


def _with_start(files: DataFrame, spark: SparkSession, path: str) -> DataFrame:
    parts = spark.read.schema(_SCHEMA).parquet(path).groupBy("part").agg(F.sum("n_tokens").alias("n"))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_offset"))
    # A row for each file: without the hint the ids may be shuffled before Spark sees how few rows there are.
    return files.join(F.broadcast(parts), "part").withColumn("start", F.col("part_offset") + F.col("part_start"))


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of the documents with low <= doc_id <= high; pages of other ids are skipped."""
    files = spark.read.schema(_SCHEMA).parquet(path)
    files = files.where(F.col("doc_id") >= low) if low is not None else files
    files = files.where(F.col("doc_id") <= high) if high is not None else files
    return _with_start(files, spark, path).select("doc_id", "start", "n_tokens", "ids")


def checksums(tokens: DataFrame) -> DataFrame:
    """tokens with, for ids, ids_crc32: the checksum of the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in tokens.columns if c != "ids"]

    def run(batches):
        for b in batches:
            lists = b.column("ids")
            ends, raw = lists.offsets.to_numpy(), memoryview(np.ascontiguousarray(lists.flatten().to_numpy().astype("<u4", copy=False))).cast("B")
            ends = 4 * (ends - ends[0])
            crc = [zlib.crc32(raw[x:y]) for x, y in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(crc, pa.int64())], [*keep, "ids_crc32"])

    schema = tokens.select(*keep).schema.add("ids_crc32", "long")
    return tokens.mapInArrow(run, schema)
