"""Packing of documents into training sequences by minimum bin slack.

Each document is cut into full sequences and one rest. How many rests there are of each length (fewer
than `capacity` numbers, whatever the corpus) is all that the plan needs: for each window the longest
rest is set, a subset-sum bitset over the lengths left gives the sum closest to the capacity, and
backtracking gives how many of each length make it. That pattern is used as often as the counts
allow. Pieces then find sequence and offset from their rank among pieces of their length.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import free, picked, place
from .scratch import small_batches, stored
from .tokens import encoded
from .words import pieces, ranges

CAPACITY = 1024


def token_pieces(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]) of the pieces of each row of docs, full ones first.

    Null texts are empty: their only id is end_id. Null and repeated ids are kept as they are; each row
    is a document. Other columns play no part.
    """

    def run(batches):
        for b in pieces(batches, most=1 << 20):
            all_ids, counts = encoded(b.column("text"), tokenizer, end_id)
            n = -(-counts // capacity)
            doc = np.repeat(np.arange(len(counts)), n)
            start = capacity * ranges(np.zeros(len(n), np.int64), n)
            length = np.minimum(capacity, counts[doc] - start)
            at = (np.cumsum(counts) - counts)[doc] + start
            raw = memoryview(all_ids.astype("<u4", copy=False)).cast("B")
            crc = [zlib.crc32(raw[4 * x : 4 * (x + y)]) for x, y in zip(at.tolist(), length.tolist(), strict=True)]
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(counts[doc])]
            if ids:
                cols.append(pa.ListArray.from_arrays(pa.array(np.r_[at, at[-1] + length[-1]].astype(np.int32)), pa.array(all_ids.view(np.int32))))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * ids])

    small_batches(docs.sparkSession)
    slim = picked(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return slim.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * ids)


def closest_multiset(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length, at most counts[length], sum closest to room without passing it."""
    sums, within, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted(counts, reverse=True):
        left, many = min(counts[length], room // length), 1
        while left > 0:  # 1, 2, 4 ... and the rest: any number up to left
            many = min(many, left)
            steps.append((length, many, sums))
            sums |= (sums << (length * many)) & within
            left -= many
            many *= 2
        if sums >> room & 1:
            break
    at, out = sums.bit_length() - 1, {}
    for length, many, before in reversed(steps):
        if not before >> at & 1:
            out[length] = out.get(length, 0) + many
            at -= length * many
    return out


def plan(counts: dict[int, int], capacity: int) -> list[tuple[dict[int, int], int]]:
    """(pattern, times): pattern says how many pieces of each length fill one sequence."""
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        longest = max(counts)
        rest = {k: v - (k == longest) for k, v in counts.items() if v - (k == longest) and k <= capacity - longest}
        pattern = closest_multiset(rest, capacity - longest)
        pattern[longest] = pattern.get(longest, 0) + 1
        times = min(counts[k] // v for k, v in pattern.items())
        out.append((pattern, times))
        for k, v in pattern.items():
            counts[k] -= v * times
            if not counts[k]:
                del counts[k]
    return out


def pack(parts: DataFrame, *, length_col: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """parts, any table with a length from 1 to capacity in each row, with sequence_id and offset as its last columns.

    Every row comes back once, with its columns as they are (the new ones' names have a number after them
    where parts has one like it, in upper or lower case); sequence_id counts from 0, offsets in a
    sequence are gapless from 0. Which of the pieces of equal length goes where is not defined. A
    null or other length raises an error; no rows give no rows.
    """

    def ranked(batches):
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in batches:
            n = b.column("length").to_numpy()
            order = np.argsort(n, kind="stable")
            values, first, many = np.unique(n[order], return_index=True, return_counts=True)
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n)) - np.repeat(first, many) + np.repeat(seen[values], many)
            seen[values] += many
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("length"), pa.array(np.full(len(n), task, np.int32)), pa.array(rank)], ["row", "length", "task", "rank"])

    names = [f"_{i}" for i in range(len(parts.columns))]
    wide = parts.toDF(*names).select(F.struct(*names).alias("row"), F.col(f"_{place(parts, length_col)}").cast("long").alias("length"))
    wide = wide.withColumn("length", F.when(F.col("length").between(1, capacity), F.col("length")).otherwise(F.raise_error(F.lit(f"a length is not from 1 to {capacity}"))))
    kept = stored(wide.mapInArrow(ranked, T.StructType([*wide.schema.fields, *T.StructType.fromDDL("task int, rank long").fields])))
    tallies = kept.groupBy("task", "length").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    tallies = tallies.select("task", "length", "n", F.coalesce(before, F.lit(0)).alias("before"))
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most

    entries, sequence = [], 0
    used = dict.fromkeys(counts, 0)
    for pattern, times in plan(counts, capacity):
        offset = 0
        for length, many in pattern.items():
            entries.append((length, used[length], many, sequence, offset))
            used[length] += many * times
            offset += length * many
        sequence += times
    entries.sort()
    table = parts.sparkSession.sparkContext.broadcast(np.array(entries, np.int64).reshape(-1, 5))

    def placed(batches):
        length, first, many, sequence, offset = table.value.T
        reach = int(first.max(initial=0)) + 1
        for b in batches:
            n, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            # By length, then the last entry that begins at or before the rank.
            i = np.searchsorted(length * reach + first, n * reach + np.minimum(rank, reach - 1), "right") - 1
            turn = rank - first[i]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(sequence[i] + turn // many[i]), pa.array(offset[i] + turn % many[i] * n)], ["row", "sequence_id", "offset"])

    joined = kept.join(tallies.select("task", "length", "before"), ["task", "length"]).select("row", "length", "rank", "before")
    out = joined.mapInArrow(placed, T.StructType([wide.schema["row"], *T.StructType.fromDDL("sequence_id long, offset long").fields]))
    own = [F.col("row").getField(x).alias(c) for x, c in zip(names, parts.columns, strict=True)]
    return out.select(*own, *[F.col(x).alias(free(parts, x)) for x in ("sequence_id", "offset")])
