"""Tables that are looked things up in: sorted by a key with bloom filters, and with the three-letter pieces of each file's texts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters of a piece of text.
PIECE = 3


def write_lookup(df: DataFrame, path: str, by: Sequence[str], blooms: Sequence[str] = (), texts: Sequence[str] = (), files: int | None = None, group_bytes: int = 8 << 20) -> None:
    """Writes df under path/rows in files by ranges of `by`, sorted, in row groups of about group_bytes, and the pieces of its texts under path/pieces.

    A lookup by `by` reads row groups whose bounds hold the value, one by a column of `blooms` those
    whose filter may; a search reads files that have all pieces of the word.
    """
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    writer = df.repartitionByRange(n, *by).sortWithinPartitions(*by).write.option("parquet.block.size", group_bytes)
    for c in blooms:
        writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true")
    writer.mode("overwrite").parquet(f"{path}/rows")
    if texts:
        rows = df.sparkSession.read.parquet(f"{path}/rows").select(F.col("_metadata.file_name").alias("file"), F.explode(F.array(*[F.coalesce(F.lower(F.col(c).cast("string")), F.lit("")) for c in texts])).alias("text"))
        pieces = rows.mapInArrow(_pieces, "file string, piece string").distinct()
        pieces.repartitionByRange(n, "piece").sortWithinPartitions("piece").write.mode("overwrite").parquet(f"{path}/pieces")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different runs of PIECE characters of a batch's texts, with their file, in time and memory that grow with the characters alone."""
    for batch in batches:
        at = 0
        while at < len(batch):
            # As many texts as have a million characters or so together; one at least.
            ends = np.cumsum(pc.binary_length(batch.column("text").slice(at)).to_numpy(zero_copy_only=False))
            n = max(1, int(np.searchsorted(ends, 1 << 20, "right")))
            files, texts = batch.column("file").slice(at, n), batch.column("text").slice(at, n).to_pylist()
            at += n
            coded = files.dictionary_encode()
            sizes = np.array([len(t) for t in texts])
            chars = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.uint64)
            if len(chars) < PIECE:
                continue
            text = np.repeat(np.arange(n), sizes)
            # A character has 21 bits, so a piece is one number; pieces that reach into the next text are none.
            code = (chars[:-2] << np.uint64(42)) | (chars[1:-1] << np.uint64(21)) | chars[2:]
            inside, file = text[:-2] == text[2:], coded.indices.to_numpy(zero_copy_only=False)[text[:-2]]
            for i, name in enumerate(coded.dictionary.to_pylist()):
                own = np.unique(code[inside & (file == i)])
                three = np.stack([own >> np.uint64(42), (own >> np.uint64(21)) & np.uint64((1 << 21) - 1), own & np.uint64((1 << 21) - 1)], axis=1).astype("<u4")
                flat = three.tobytes().decode("utf-32-le")
                yield pa.RecordBatch.from_pydict({"file": [name] * len(own), "piece": [flat[j : j + PIECE] for j in range(0, len(flat), PIECE)]}, pa.schema([("file", pa.string()), ("piece", pa.string())]))


def found(spark: SparkSession, path: str, column: str, values: Sequence) -> DataFrame:
    """The rows with one of the values."""
    return spark.read.parquet(f"{path}/rows").where(F.col(column).isin(list(values)))


def files_with(spark: SparkSession, path: str, word: str) -> list[str] | None:
    """The files in which the word may be: those that have all its pieces, every one of which is looked up; None for a word shorter than a piece."""
    low = word.lower()
    wanted = sorted({low[i : i + PIECE] for i in range(len(low) - PIECE + 1)})
    if not wanted:
        return None
    pieces = spark.read.parquet(f"{path}/pieces").where(F.col("piece").isin(wanted))
    return sorted(r.file for r in pieces.groupBy("file").agg(F.count("*").alias("n")).where(F.col("n") == len(wanted)).select("file").collect())  # names of files


def containing(spark: SparkSession, path: str, word: str, texts: Sequence[str]) -> DataFrame:
    """The rows with the word in one of these columns, case ignored; other files than files_with are not opened."""
    names, rows = files_with(spark, path, word), spark.read.parquet(f"{path}/rows")
    if names is not None:
        rows = rows.where(F.col("_metadata.file_name").isin(names))
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c).cast("string")), F.lit(word.lower())), F.lit(False))
    return rows.where(hit)
