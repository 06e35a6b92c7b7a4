"""Words of documents that occur in benchmark items, by a prefix-filtered set join.

A benchmark window (`window` words of an item, or a shorter item as a whole) occurs in a document only
if all its shingles do, so its rarest shingle is the whole prefix that a join needs. Shingles are word
pairs (the word itself in a one-word item); how rare they are is counted over all documents. Windows
of an item with the same rarest shingle make one run of words. Documents send the places of prefix
shingles with the words around them; the join on the shingle then checks length and position bounds,
and the words themselves, to the left and right of the shingle.

Two bitmaps of fixed size (2 MB each, whatever the benchmark's size) spare documents most shingles
that no item has. Everything else is joined, not broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rows import keyed, picked, unpacked
from .scratch import n_tasks, small_batches, stored
from .words import ALNUM_WORDS, Words, mix, pieces, ranges, windows

_SLOTS, _CHUNK = 1 << 24, 1 << 13
#: Parts that the places of one prefix token are dealt to.
DEALS = 16


def _tokens(w: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words as tokens, of pairs, and the pairs that lie in one text."""
    h = w.hashes()
    inside = ranges(w.offsets[:-1], np.maximum(w.counts - 1, 0))
    return mix(h, 77), windows(h, 2), inside


def bitmap(hashes: DataFrame) -> np.ndarray:
    """The slots of a column h of hashes: 2**24 bits, brought together in 2048 pieces at most."""

    def chunk(table: pa.Table) -> pa.Table:
        bits = np.zeros(_CHUNK, bool)
        bits[table.column("slot").to_numpy() % _CHUNK] = True
        return pa.table({"i": table.column("i")[:1], "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})

    slots = hashes.select(F.pmod("h", F.lit(_SLOTS)).alias("slot")).distinct().withColumn("i", F.expr(f"slot div {_CHUNK}"))
    out = np.zeros(_SLOTS // 8, np.uint8)
    for r in slots.groupBy("i").applyInArrow(chunk, "i long, bits binary").collect():
        out[r["i"] * _CHUNK // 8 : (r["i"] + 1) * _CHUNK // 8] = np.frombuffer(r["bits"], np.uint8)
    return out


def _passes(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    slot = (h & np.uint64(_SLOTS - 1)).astype(np.int64)
    return (bits[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 > 0


def _item_words(batches):
    for b in pieces(batches):
        w = Words(b.column("text"), ALNUM_WORDS, lower=True)
        single, pair, _ = _tokens(w)
        words, tokens = [], []
        for x, y in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist(), strict=True):
            words.append([w.text(i).decode() for i in range(x, y)])
            tokens.append((pair[x : y - 1] if y - x > 1 else single[x:y]).view(np.int64).tolist())
        yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(words, pa.list_(pa.string())), pa.array(tokens, pa.list_(pa.int64()))], ["item", "words", "tokens"])


def _runs(window: int):
    """Of items with their tokens' counts: each prefix token with the run of words that its windows cover."""

    def run(batches):
        for b in batches:
            out = []
            for r in b.to_pylist():
                words, size = r["words"], min(window, len(r["words"]))
                counts = [x["n"] for x in sorted(r["counts"], key=lambda x: x["at"])]
                tokens = [x["h"] for x in sorted(r["counts"], key=lambda x: x["at"])]
                order = list(zip(counts, tokens, strict=True))
                many = max(size - 1, 1)
                rarest = [min(range(i, i + many), key=lambda j: (order[j], j)) for i in range(len(words) - size + 1)]
                low_high: dict[int, list[int]] = {}
                for i, at in enumerate(rarest):
                    low_high.setdefault(at, [i, i])[1] = i
                for at, (low, high) in low_high.items():
                    if counts[at]:
                        out.append({"h": tokens[at], "item": r["item"], "run": words[low : high + size], "back": at - low, "size": size})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("h", pa.int64()), ("item", pa.int64()), ("run", pa.list_(pa.string())), ("back", pa.int32()), ("size", pa.int32())]))

    return run


def _counts(bits):
    def run(batches):
        for b in pieces(batches):
            single, pair, inside = _tokens(Words(b.column("text"), ALNUM_WORDS, lower=True))
            pair = pair[inside]
            h = np.concatenate([x[_passes(bits.value, x)] for x in (single, pair)])
            h, n = np.unique(h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], ["h", "n"])

    return run


def _places(bits, window: int):
    """A row for each document (its number of words), and one for each place of a prefix token, with the words around it."""
    names = ["id", "sub", "n_words", "h", "at", "near", "back"]

    def run(batches):
        for b in pieces(batches):
            w = Words(b.column("text"), ALNUM_WORDS, lower=True)
            single, pair, inside = _tokens(w)
            none = [pa.nulls(len(b), t) for t in (pa.int64(), pa.int32(), pa.string(), pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sub"), pa.array(w.counts), *none], names)
            one, two = np.flatnonzero(_passes(bits.value, single)), inside[_passes(bits.value, pair[inside])]
            at = np.concatenate([one, two])
            if not len(at):
                continue
            h = np.concatenate([single[one], pair[two]])
            doc = np.searchsorted(w.offsets, at, "right") - 1
            low, high = np.maximum(at - window + 2, w.offsets[doc]), np.minimum(at + window, w.offsets[doc + 1])
            near = [" ".join(w.text(i).decode() for i in range(x, y)) for x, y in zip(low.tolist(), high.tolist(), strict=True)]
            cols = [b.column("id").take(pa.array(doc)), b.column("sub").take(pa.array(doc)), pa.nulls(len(at), pa.int64()), pa.array(h.view(np.int64)), pa.array((at - w.offsets[doc]).astype(np.int32)), pa.array(near, pa.string()), pa.array((at - low).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def _verify(batches):
    """Length and position bounds, then the words: a hit is the stretch around the token where document and run agree."""
    for b in batches:
        keep, start, size = [], [], []
        cols = [b.column(x).to_pylist() for x in ("near", "back", "run", "run_back", "size", "at")]
        for i, (near, back, run, run_back, least, at) in enumerate(zip(*cols, strict=True)):
            near = near.split(" ")
            left, right = min(back, run_back), min(len(near) - back, len(run) - run_back)
            if left + right < least:
                continue
            r = next((j for j in range(right) if near[back + j] != run[run_back + j]), right)
            k = next((j for j in range(left) if near[back - j - 1] != run[run_back - j - 1]), left)
            if k + r >= least:
                keep.append(i)
                start.append(at - k)
                size.append(k + r)
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(x).take(at) for x in ("id", "sub", "item")), pa.array(start, pa.int32()), pa.array(size, pa.int32())], ["id", "sub", "item", "s", "n"])


def _merged(batches):
    """Spans, in order of start, with those that overlap or touch made one."""
    for b in batches:
        lists = b.column("spans")
        flat, ends = lists.flatten(), lists.offsets.to_numpy()
        s, n = (flat.field(x).to_numpy().astype(np.int64) for x in ("s", "n"))
        row = np.repeat(np.arange(len(b)), np.diff(ends))
        # How far the spans up to here reach; rows are kept apart by more than any text's words.
        gap = int((s + n).max(initial=0)) + 2
        reach = np.maximum.accumulate(s + n + row * gap)
        first = np.flatnonzero(np.r_[True, s[1:] + row[1:] * gap > reach[:-1]][: len(s)])
        last = np.r_[first[1:] - 1, len(s) - 1][: len(first)]
        size = reach[last] - row[first] * gap - s[first]
        found = pa.StructArray.from_arrays([pa.array(s[first].astype(np.int32)), pa.array(size.astype(np.int32))], ["s", "n"])
        at = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(b)))].astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("id"), b.column("sub"), pa.ListArray.from_arrays(pa.array(at), found)], ["id", "sub", "spans"])


def contaminated(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, text: bool = True) -> DataFrame:
    """docs with struct `leak`: n_words, n_hit, spans (hit word ranges, merged), items (ids, sorted as strings).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, after lower-casing A-Z.
    A word is hit if it lies in any occurrence of any item's window.

    Null texts and items without words have no words and no windows. An item without id hits words but
    is not listed; items that repeat an id are one item with both texts' windows. Rows of docs that
    repeat an id are judged each by its own text. All columns of docs come back unchanged, whatever their
    names, and the struct after them; if one is named leak, in upper or lower case, the struct's name has a
    number after it. text=False leaves the text out. No items or no documents: nothing is hit.
    """
    small_batches(docs.sparkSession)
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    texts = rows.select("id", "sub", "text")
    named = picked(benchmark, item_id=item_col, text=item_text_col)
    named = named.select(F.col("item_id").cast("string"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("item", F.xxhash64("text"))
    items = stored(named.dropDuplicates(["item"]).select("item", "text").mapInArrow(_item_words, "item long, words array<string>, tokens array<long>").where("size(words) > 0"))
    tokens = items.select("item", F.posexplode("tokens").alias("at", "h"))
    bits = spark.sparkContext.broadcast(bitmap(tokens))
    counts = texts.select("text").mapInArrow(_counts(bits), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    counted = tokens.join(counts, "h", "left").groupBy("item").agg(F.collect_list(F.struct("at", "h", F.coalesce("n", F.lit(0)).alias("n"))).alias("counts"))
    spread = items.select("item", "words").join(counted, "item").repartition(n_tasks(spark), "item")
    runs = stored(spread.mapInArrow(_runs(window), "h long, item long, run array<string>, back int, size int"))

    prefix = spark.sparkContext.broadcast(bitmap(runs.select("h")))
    places = stored(texts.mapInArrow(_places(prefix, window), "id long, sub long, n_words long, h long, at int, near string, back int"))
    # A prefix token may be a common word or pair: its places are dealt to DEALS parts, and the benchmark's runs copied to each.
    dealt = places.where("h is not null").withColumn("deal", F.pmod(F.xxhash64("id", "sub", "at"), F.lit(DEALS)).cast("int"))
    copied = runs.withColumnRenamed("back", "run_back").withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(DEALS - 1))))
    joined = dealt.join(copied, ["h", "deal"])
    joined = joined.select("id", "sub", "at", "near", "back", "item", "run", "run_back", "size")
    hits = stored(joined.mapInArrow(_verify, "id long, sub long, item long, s int, n int"))

    spans = hits.groupBy("id", "sub").agg(F.array_sort(F.collect_set(F.struct("s", "n"))).alias("spans"))
    listed = hits.select("id", "sub", "item").distinct().join(named.select("item", "item_id"), "item").groupBy("id", "sub").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    spans = spans.mapInArrow(_merged, "id long, sub long, spans array<struct<s: int, n: int>>")
    found = places.where("h is null").select("id", "sub", "n_words").distinct().join(spans, ["id", "sub"], "left").join(listed, ["id", "sub"], "left")
    leak = F.struct(
        "n_words",
        F.expr("coalesce(aggregate(spans, 0L, (t, x) -> t + x.n), 0L)").alias("n_hit"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<s: int, n: int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    ).alias("leak")
    found = found.select("id", "sub", leak)
    return unpacked(rows.join(found, ["id", "sub"]), docs, text_col, "leak", text=text)
