"""Stupid-backoff language-model scores of documents, with the counts of the whole corpus.

Documents are dealt to blocks by hash. A block explodes its texts into n-grams and sends each distinct
one, with its count, to the n-gram's hash bucket, packed into one row for each block and bucket. A
bucket adds up the count table of its hashes, joins it to the blocks' n-grams and sends each block the
corpus counts in the order asked. A block joins those to its n-grams again and sums each document's
score. No table is broadcast. A frequent n-gram is one entry for each block: where a bucket has more
than FAN blocks, they are added up in groups of FAN first, so a task meets FAN entries of an n-gram, or
one for each group.

N-grams travel packed, not as rows of their own: a third as many rows of n-grams as there are words, at
the 14 bytes or so of a shuffled row, would be several times the input in each of three shuffles.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import packed, unpacked
from .scratch import n_tasks, small_batches, stored
from .words import Words, pieces, ranges, windows

#: Bytes of text in a block, about.
BLOCK = 3 << 20
#: Blocks of which one task adds up the counts.
FAN = 4096


def _ngrams(texts: pa.Array, order: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
    """For n = 1 .. order: distinct hashes in order, which of them each n-gram is, and the n-grams' first words."""
    w = Words(texts, lower=True)
    h, out = w.hashes(), []
    for n in range(1, order + 1):
        at = ranges(w.offsets[:-1], np.maximum(w.counts - n + 1, 0))
        keys, which = np.unique(windows(h, n)[at], return_inverse=True)
        out.append((keys, which, at))
    return w, out


def _text(table: pa.Table) -> pa.Array:
    x = table.column("text").combine_chunks()
    return x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks)


def _buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that sorted hashes fall into (a bucket is a range of hashes), and where each one's begin, and the end."""
    found, first = np.unique((keys >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32), return_index=True)
    return found.astype(np.int64), np.r_[first, len(keys)]


def _packed(x: np.ndarray) -> bytes:
    """Non-negative integers, their lowest bytes first, then their second ones and so on: the higher ones are mostly zeros, which shuffles compress."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def scored(docs: DataFrame, *, text_col: str = "text", order: int = 2, backoff: float = 0.4, least: int = 2, text: bool = True) -> DataFrame:
    """docs with struct `lm`: n_words, log_score (sum over words of the natural log), mean_log_score.

    Words are runs of bytes other than ASCII white space, lower-cased (A-Z). A word's score is
    c(context, word) / c(context) for the longest context, of up to order - 1 words of its document,
    with which it occurs `least` times or more in all of docs, times `backoff` for each context word
    given up; with no context it is c(word) / words of all documents.

    Null, empty or wordless texts have n_words 0, log_score 0 and mean_log_score null. All rows and
    columns come back as they are, whatever their names, and the struct after them; if a column is named
    lm, in upper or lower case, the struct's name has a number after it. text=False leaves the text out.
    """
    spark = docs.sparkSession
    small_batches(spark)
    wide, back = packed(docs, text_col), ["row", *["text"] * text]

    def sizes(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([len(w.data)]), pa.array([len(w.starts)])], ["bytes", "words"])

    size, every = wide.select("text").mapInArrow(sizes, "bytes long, words long").agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.sum("words"), F.lit(0))).first()
    blocks = max(n_tasks(spark), size // BLOCK)
    wide = wide.withColumn("block", F.pmod(F.xxhash64("text", "row"), F.lit(blocks)).cast("int"))

    def explode(key, table):
        out = []
        for n, (keys, which, _) in enumerate(_ngrams(_text(table), order)[1], 1):
            counts, (found, cut) = np.bincount(which, minlength=len(keys)), _buckets(keys, blocks)
            for i, b in enumerate(found.tolist()):
                own = slice(cut[i], cut[i + 1])
                out.append((n, b, _packed(np.diff(keys[own], prepend=np.uint64(0))), _packed(counts[own])))
        n, b, keys, counts = zip(*out, strict=True) if out else [()] * 4
        return pa.table({"block": pa.array([key[0].as_py()] * len(n), pa.int32()), "n": pa.array(n, pa.int32()), "bucket": pa.array(b, pa.int32()), "keys": pa.array(keys, pa.binary()), "counts": pa.array(counts, pa.binary())})

    def added(table: pa.Table) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
        """Each row's keys, the distinct keys with their sums, and which of them each key is."""
        keys = [np.cumsum(_unpacked(x), dtype=np.uint64) for x in table.column("keys").to_pylist()]
        counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()])
        distinct, which = np.unique(np.concatenate(keys), return_inverse=True)
        return keys, distinct, np.bincount(which, counts).astype(np.int64), which

    def count(table: pa.Table) -> pa.Table:
        keys, _, sums, which = added(table)
        cut = np.cumsum([len(x) for x in keys])[:-1]
        return pa.table({**{c: table.column(c) for c in ("block", "n", "bucket")}, "totals": pa.array([_packed(x) for x in np.split(sums[which], cut)], pa.binary())})

    def merge(table: pa.Table) -> pa.Table:
        """The sums of a group of blocks, as if it were one block named by the group."""
        _, distinct, sums, _ = added(table)
        own = {c: table.column(c)[:1] for c in ("group", "n", "bucket")}
        return pa.table({"block": own.pop("group"), **own, "keys": pa.array([_packed(np.diff(distinct, prepend=np.uint64(0)))], pa.binary()), "counts": pa.array([_packed(sums)], pa.binary())})

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        keys, totals = (_unpacked(known.column(c)[0].as_py()) for c in ("keys", "totals"))
        keys = np.cumsum(keys, dtype=np.uint64)
        found = [_packed(totals[np.searchsorted(keys, np.cumsum(_unpacked(x), dtype=np.uint64))]) for x in asked.column("keys").to_pylist()]
        return pa.table({**{c: asked.column(c) for c in ("block", "n", "bucket")}, "totals": pa.array(found, pa.binary())})

    def score(texts, totals):
        if not len(texts):
            return pa.table({**{c: texts.column(c) for c in back}, "lm": pa.array([], kind)})
        words, grams = _ngrams(_text(texts), order)
        totals = totals.sort_by([("n", "ascending"), ("bucket", "ascending")]).select(["n", "totals"]).to_pylist()
        c = [np.concatenate([_unpacked(x["totals"]) for x in totals if x["n"] == n] or [np.empty(0, np.uint64)]).astype(np.int64)[grams[n - 1][1]] for n in range(1, order + 1)]
        value = np.log(c[0] / max(every, 1))
        # A word's longest context, by its place in its document; each shorter one found costs log(backoff).
        place = np.arange(len(value)) - np.repeat(words.offsets[:-1], words.counts)
        given_up = np.minimum(place, order - 1)
        for n in range(2, order + 1):
            at, context = grams[n - 1][2], np.zeros(len(value), np.int64)
            context[grams[n - 2][2]] = c[n - 2]
            seen = c[n - 1] >= least
            last = at[seen] + n - 1
            value[last] = np.log(c[n - 1][seen] / context[at[seen]])
            given_up[last] = np.minimum(place[last], order - 1) - (n - 1)
        each = np.add.reduceat(np.r_[value + given_up * np.log(backoff), 0], words.offsets[:-1])
        each = np.where(words.counts > 0, each, 0.0)
        mean = pa.array(each / np.maximum(words.counts, 1), mask=words.counts == 0)
        return pa.table({**{c: texts.column(c) for c in back}, "lm": pa.StructArray.from_arrays([pa.array(words.counts.astype(np.int64)), pa.array(each), mean], ["n_words", "log_score", "mean_log_score"])})

    kind = pa.struct([("n_words", pa.int64()), ("log_score", pa.float64()), ("mean_log_score", pa.float64())])
    # Both groupings have the same columns, so that one shuffle of the texts serves both.
    dealt = wide.select("block", "row", "text")
    sent = dealt.groupBy("block").applyInArrow(explode, "block int, n int, bucket int, keys binary, counts binary")
    counted, answered = "block int, n int, bucket int, keys binary, counts binary", "block int, n int, bucket int, totals binary"
    if blocks <= FAN:
        answers = sent.groupBy("n", "bucket").applyInArrow(count, answered)
    else:
        grouped = stored(sent.withColumn("group", F.pmod("block", F.lit(-(-blocks // FAN)))))
        merged = stored(grouped.groupBy("group", "n", "bucket").applyInArrow(merge, counted))
        known = merged.join(merged.groupBy("n", "bucket").applyInArrow(count, answered), ["block", "n", "bucket"]).withColumnRenamed("block", "group")
        each = ["group", "n", "bucket"]
        answers = grouped.groupBy(*each).cogroup(known.groupBy(*each)).applyInArrow(answer, answered)
    schema = T.StructType([*wide.select(*back).schema.fields, *T.StructType.fromDDL("lm struct<n_words: bigint, log_score: double, mean_log_score: double>").fields])
    out = dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, schema)
    return unpacked(out, docs, text_col, "lm", text=text)
