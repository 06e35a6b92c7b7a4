"""Phrases of words that stand together, level by level with hashed buckets (PCY, DHP) and Apriori pruning.

Level k counts phrases of k words exactly and, in the same pass over the texts, counts phrases of k + 1
words by bucket of their hash. What may be frequent at the next level must lie in a bucket with enough
occurrences, and both its parts of k words must be frequent. Both tests are bitmaps of a set size,
broadcast to the tasks; a bit that is set for another phrase only lets a phrase through to the exact
counting, which compares the words themselves.

A task sends what its occurrences add to 2**16 buckets as one row: the low halves of their numbers, or
a count for each bucket where that is shorter. Rows of counts are summed up one after another, so
neither grows with the number of tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, small_batches, stored
from .spread import looked_up
from .words import Words, byte_hashes, pair, pieces

#: Bytes of text that are counted together before they are sent on.
RUN_BYTES = 1 << 22
#: Occurrences that are put in buckets together.
MOST_HELD = 1 << 21
SEGMENT = 1 << 16

_b = np.arange(256)
#: Characters that end a piece of text: `[.,;:!?\x0A-\x0D]`.
ENDS_PIECE = np.isin(_b, np.frombuffer(b".,;:!?\n\x0b\x0c\r", np.uint8))
#: Words `[^\x20\x09]+` of pieces.
PIECE_WORDS = ~(ENDS_PIECE | (_b == 0x20) | (_b == 0x09))
_SCHEMA = pa.schema([("kind", pa.int32()), ("grp", pa.string()), ("phrase", pa.string()), ("n", pa.int64()), ("segment", pa.int32()), ("counted", pa.bool_()), ("data", pa.binary())])
_DDL = "kind int, grp string, phrase string, n long, segment int, counted boolean, data binary"
PHRASE, TOTAL, BUCKETS = 0, 1, 2


class Bitmap:
    """One bit for each of 2**bits buckets; a phrase's bucket is the top of its hash."""

    def __init__(self, bits: int, data: np.ndarray):
        self.bits, self.data = bits, data

    def has(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.data[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


class _Run:
    """The words of some texts: their numbers, hashes with their group's, and the piece each lies in."""

    def __init__(self, batch: pa.RecordBatch):
        words = Words(batch.column("text"), PIECE_WORDS, lower=True)
        coded, groups = words.coded(), batch.column("grp").dictionary_encode()
        self.dictionary, self.groups = coded.dictionary, groups.dictionary
        self.number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(batch)), words.counts)
        self.group = groups.indices.to_numpy(zero_copy_only=False).astype(np.int64)[doc]
        self.piece = np.cumsum(ENDS_PIECE[words.data])[words.starts] + doc
        self.hash = pair(_hashes(self.groups)[self.group], _hashes(self.dictionary)[self.number])

    def grams(self, k: int, before: np.ndarray | None) -> np.ndarray:
        """Hash of each k consecutive words, of whatever pieces, from those of k - 1."""
        return self.hash if before is None else pair(before[:-1], self.hash[k - 1 :])

    def inside(self, k: int) -> np.ndarray:
        """Which k consecutive words lie in one piece."""
        last = max(len(self.piece) - k + 1, 0)
        return self.piece[:last] == self.piece[k - 1 : k - 1 + last]

    def counted(self, at: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
        """The phrases of k words at these places and how often each is there, by group."""
        if not len(at):
            return
        key = self.group[at]
        for j in range(k):
            # Renumbered at each step, so that the product stays in 64 bits.
            key = np.unique(key, return_inverse=True)[1] * len(self.dictionary) + self.number[at + j]
        _, first, n = np.unique(key, return_index=True, return_counts=True)
        first = at[first]
        parts = [self.dictionary.take(pa.array(self.number[first + j])).cast(pa.large_string()) for j in range(k)]
        text = parts[0] if k == 1 else pc.binary_join_element_wise(*parts, pa.scalar(" ", pa.large_string()))
        yield _rows(PHRASE, grp=self.groups.take(pa.array(self.group[first])), phrase=text.cast(pa.string()), n=pa.array(n))


def _hashes(values: pa.Array) -> np.ndarray:
    """Hashes of different strings or binaries."""
    raw = values.cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2], np.uint8) if raw.buffers()[2] is not None else np.empty(0, np.uint8)
    return byte_hashes(data, ends[:-1], ends[1:])


def _rows(kind: int, **columns: pa.Array) -> pa.RecordBatch:
    n = len(next(iter(columns.values())))
    own = {"kind": pa.array(np.full(n, kind, np.int32)), **columns}
    return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(n, f.type) for f in _SCHEMA], schema=_SCHEMA)


class _Buckets:
    """Bucket numbers of occurrences, sent on as one row for each 2**16 buckets. No bucket counts beyond `least`."""

    def __init__(self, bits: int, least: int):
        self.bits, self.least, self.held, self.n = bits, least, [], 0

    def add(self, h: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append((h >> np.uint64(64 - self.bits)).astype(np.uint32))
        self.n += len(h)
        if self.n >= MOST_HELD:
            yield from self.sent()

    def sent(self) -> Iterator[pa.RecordBatch]:
        at, n = np.unique(np.concatenate(self.held or [np.empty(0, np.uint32)]), return_counts=True)
        self.held, self.n = [], 0
        if not len(at):
            return
        n, segment = np.minimum(n, self.least), (at >> np.uint32(16)).astype(np.int32)
        ends = np.flatnonzero(np.diff(segment, append=-1)) + 1
        segments, counted, data, begin = [], [], [], 0
        width = np.uint8 if self.least <= 255 else np.uint32
        for end in ends.tolist():
            low, own = (at[begin:end] & np.uint32(0xFFFF)).astype(np.uint16), n[begin:end]
            full = 2 * int(own.sum()) > SEGMENT * np.dtype(width).itemsize
            if full:
                counts = np.zeros(SEGMENT, width)
                counts[low] = own
            segments.append(segment[begin])
            counted.append(full)
            data.append(counts.tobytes() if full else np.repeat(low, own).tobytes())
            begin = end
        for i in range(0, len(segments), 256):
            part = slice(i, i + 256)
            yield _rows(BUCKETS, segment=pa.array(segments[part]), counted=pa.array(counted[part]), data=pa.array(data[part], pa.binary()))


def _level(k: int, last: bool, least: int, bits: int, buckets, frequent):
    """The pass of level k over texts: exact counts of its phrases, and buckets of the next level's unless it is the last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        following = _Buckets(bits, least)
        for batch in pieces(batches, most=RUN_BYTES):
            words = _Run(batch)
            if not len(words.number):
                continue
            gram = parts = None
            for j in range(1, k + 1):
                parts, gram = gram, words.grams(j, gram)
            alive = words.inside(k)
            if k == 1:
                group, n = np.unique(words.group, return_counts=True)
                yield _rows(TOTAL, grp=words.groups.take(pa.array(group)), n=pa.array(n))
            else:
                often = frequent.value.has(parts)
                alive = alive & often[:-1] & often[1:] & buckets.value.has(gram)
            yield from words.counted(np.flatnonzero(alive), k)
            if not last and len(gram) > 1:
                both = alive[:-1] & alive[1:] & words.inside(k + 1)
                yield from following.add(words.grams(k + 1, gram)[both])
        yield from following.sent()

    return run


def _marks(bits: int):
    """Buckets of whole phrases: the bits of those that are frequent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = _Buckets(bits, 1)
        for batch in pieces(batches, text="phrase", most=RUN_BYTES):
            if not len(batch):
                continue
            words = _Run(batch.rename_columns(["grp", "text"]))
            k, gram = len(words.number) // len(batch), None
            for j in range(1, k + 1):
                gram = words.grams(j, gram)
            yield from marked.add(gram[:: k])
        yield from marked.sent()

    return run


def _summed(least: int):
    """Rows of buckets, ordered by segment: for each segment, a bit for every bucket with at least so many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(SEGMENT, np.int64)

        def bits() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"segment": pa.array([at], pa.int32()), "bits": pa.array([np.packbits(total >= least, bitorder="little").tobytes()], pa.binary())})

        for batch in batches:
            for segment, counted, data in zip(*[batch.column(c).to_pylist() for c in ("segment", "counted", "data")], strict=True):
                if segment != at:
                    if at is not None:
                        yield bits()
                    at, total[:] = segment, 0
                if counted:
                    total += np.frombuffer(data, np.uint8 if len(data) == SEGMENT else np.uint32)
                else:
                    total += np.bincount(np.frombuffer(data, np.uint16), minlength=SEGMENT)
        if at is not None:
            yield bits()

    return run


def _bitmap(spark: SparkSession, rows: DataFrame, bits: int, least: int):
    """A broadcast bitmap of the buckets with at least so many: 2**bits / 8 bytes, whatever the input."""
    rows = rows.select("segment", "counted", "data").repartition(min(n_tasks(spark), max(1, 1 << bits >> 16)), "segment").sortWithinPartitions("segment")
    data = np.zeros(max(1 << bits, SEGMENT) // 8, np.uint8)
    for r in rows.mapInArrow(_summed(least), "segment int, bits binary").toLocalIterator():
        data[r.segment * (SEGMENT // 8) : (r.segment + 1) * (SEGMENT // 8)] = np.frombuffer(r.bits, np.uint8)
    return spark.sparkContext.broadcast(Bitmap(bits, data))


def frequent_phrases(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 3, least: int = 10, most_bits: int = 28) -> tuple[DataFrame, DataFrame]:
    """(grp, phrase, k, n): phrases of 1 to `longest` words with at least `least` occurrences; and (grp, n): all words.

    Texts lose the case of A-Z, are cut into pieces at `[.,;:!?\\x0A-\\x0D]`, and those into words
    `[^\\x20\\x09]+`; phrases lie within a piece. A null group is `und`, a null text empty. There are about
    two buckets for each word of the input, 2**most_bits (32 MB a bitmap) at most: past that the buckets
    fill, let more phrases through to the exact counting, and the frequent parts prune alone.
    """
    if longest < 1 or least < 1 or not 3 <= most_bits <= 32:
        raise ValueError("longest and least begin at 1, most_bits lies in 3 to 32")
    spark = docs.sparkSession
    small_batches(spark)
    rows = picked(docs, grp=group_col, text=text_col).select(F.coalesce(F.col("grp").cast("string"), F.lit("und")).alias("grp"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(most_bits, max(16, int(size / 3).bit_length()))
    found, totals, buckets, frequent = [], None, None, None
    for k in range(1, longest + 1):
        passed = stored(rows.mapInArrow(_level(k, k == longest, least, bits, buckets, frequent), _DDL))
        if k == 1:
            totals = stored(passed.where(F.col("kind") == TOTAL).groupBy("grp").agg(F.sum("n").alias("n")))
        counts = passed.where(F.col("kind") == PHRASE).groupBy("grp", "phrase").agg(F.sum("n").alias("n"))
        found.append(stored(counts.where(F.col("n") >= least).select("grp", "phrase", F.lit(k).alias("k"), "n")))
        if k < longest:
            buckets = _bitmap(spark, passed.where(F.col("kind") == BUCKETS), bits, least)
            frequent = _bitmap(spark, found[-1].select("grp", "phrase").mapInArrow(_marks(bits), _DDL), bits, 1)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out, totals


def collocations(docs: DataFrame, text_col: str = "text", group_col: str = "lang", longest: int = 3, least: int = 10, covered: int = 50, most: int = 2000, most_bits: int = 28) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each group's first `most` phrases of 2 to `longest` words.

    a: occurrences; n: all words of the group. Of the cuts of a phrase in two parts, found l and r times,
    the one of the lowest score floor(1000000 a a / (l r)) counts, of equal ones the earliest. A phrase
    goes if a longer frequent one holds it and has `covered` percent of its occurrences or more. Order:
    score, then a, both falling, then the phrase's bytes.

    Null groups are `und`, null and empty texts add nothing, repeated rows count as often as they are
    there, whatever their id. No documents give no rows. A text of any length is one task's.
    """
    frequent, totals = frequent_phrases(docs, text_col, group_col, longest, least, most_bits)
    phrases = frequent.where("k > 1")
    cuts = phrases.select("*", F.explode(F.expr("sequence(1, k - 1)")).alias("cut"))
    cuts = stored(cuts.select("*", F.expr("substring_index(phrase, ' ', cut)").alias("first"), F.expr("substring_index(phrase, ' ', cut - k)").alias("rest")))
    known = frequent.select("grp", F.col("phrase").alias("first"), F.col("n").alias("m"))
    cuts = stored(looked_up(cuts, known, ["grp", "first"]).withColumn("l", F.col("found.m")).drop("found"))
    cuts = looked_up(cuts, known.withColumnRenamed("first", "rest"), ["grp", "rest"]).withColumn("r", F.col("found.m"))
    wide = "cast({} as decimal(19, 0))".format
    score = F.expr(f"1000000 * {wide('n')} * {wide('n')} div ({wide('l')} * {wide('r')})")
    best = cuts.groupBy("grp", "phrase", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))
    inner = F.expr("flatten(transform(sequence(2, k - 1), m -> transform(sequence(1, k - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))")
    within = phrases.where("k > 2").select("grp", F.explode(inner).alias("phrase"), "n").groupBy("grp", "phrase").agg(F.max("n").alias("longer"))
    left = best.join(within, ["grp", "phrase"], "left").where(F.expr(f"longer is null or 100 * longer < {covered} * n"))
    order = [F.desc("best.score"), F.desc("n"), F.asc("phrase")]
    some = left.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "deal").orderBy(*order))).where(F.col("rank") <= most)
    top = some.withColumn("rank", F.row_number().over(Window.partitionBy("grp").orderBy(*order)).cast("long")).where(F.col("rank") <= most)
    top = top.select("grp", "rank", "phrase", F.col("n").alias("a"), "best.l", "best.r", "best.score")
    return top.join(totals, "grp").select(F.col("grp").alias("lang"), "rank", "phrase", "a", "l", "r", "n", "score")
