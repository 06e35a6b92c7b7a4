"""Removal of passages that occur earlier in the corpus, by suffix automata of reference shards.

A window is `min_words` consecutive words. A winnowing rule names an anchor in each window: its
smallest word-gram hash. Equal windows have equal anchors, so a passage that repeats shows as anchors
that repeat, and only stretches of text around those (about a fortieth to a third of a corpus) go on.
Consecutive windows with one anchor make a segment, and equal segments collapse to the earliest.
What is left differs in part: segments go to reference shards by their anchor; a shard's task builds
one suffix automaton, streams the segments through it in document order for matching statistics,
and adds each to it after that. A match of min_words or more ends a window that starts earlier.
(Shards of all the corpus, each broadcast to all documents, would cost the square of the input; a
shard here meets just the documents that can match in it.)
An anchor with very many different segments (a passage in thousands of different surroundings) would
make a shard without bound; it is split further, by the whole window, with the earliest found by a
pre-aggregated minimum.

Automata run over the words themselves. Equal segments, and equal windows of a hot anchor, are known by
128 bits: two hashes, each from words' hashes with a seed of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rows import keyed, unpacked
from .scratch import n_tasks, small_batches, stored
from .spread import looked_up
from .words import Words, pieces, ranges, sliding_least, span_hashes, windows

GRAM = 6
#: Segments in a reference shard, about; different segments of one anchor beyond which it is split by window.
SHARD, HOT = 1000, 200
_SEGMENT = "a long, c long, id long, sub long, p int, s int, n int"


class SuffixAutomaton:
    """Of several sequences of integers. add() after match() keeps what match() finds earlier."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def match(self, words: list[int]) -> list[int]:
        """Matching statistics: for each end, the length of the longest match that ends there."""
        state, n, out = 0, 0, []
        for w in words:
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            to = self.next[state].get(w)
            if to is None:
                n = 0
            else:
                state, n = to, n + 1
            out.append(n)
        return out

    def _clone(self, state: int, to: int, w: int) -> int:
        new = len(self.next)
        self.next.append(self.next[to].copy())
        self.link.append(self.link[to])
        self.length.append(self.length[state] + 1)
        self.link[to] = new
        while state >= 0 and self.next[state].get(w) == to:
            self.next[state][w] = new
            state = self.link[state]
        return new

    def add(self, words: list[int]) -> None:
        last = 0
        for w in words:
            to = self.next[last].get(w)
            if to is not None:
                last = to if self.length[to] == self.length[last] + 1 else self._clone(last, to, w)
                continue
            new, state = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            while state >= 0 and w not in self.next[state]:
                self.next[state][w] = new
                state = self.link[state]
            if state >= 0:
                to = self.next[state][w]
                self.link[new] = to if self.length[to] == self.length[state] + 1 else self._clone(state, to, w)
            last = new


def segments(texts: DataFrame, min_words: int) -> DataFrame:
    """(a, c, id, sub, p, s, n): anchor and content hashes, anchor's place, first window's start, number of windows."""
    gram = min(GRAM, min_words)

    def run(batches):
        for b in pieces(batches):
            w = Words(b.column("text"))
            h = w.hashes()
            if len(h) < min_words:
                continue
            least, at = sliding_least(windows(h, gram), min_words - gram + 1)
            count = np.maximum(w.counts - min_words + 1, 0)
            start = ranges(w.offsets[:-1], count)
            if not len(start):
                continue
            doc = np.repeat(np.arange(len(count)), count)
            place = at[start]
            first = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (doc[1:] != doc[:-1])])
            n = np.diff(np.r_[first, len(start)])
            s, p, d = start[first], place[first], doc[first]
            content = span_hashes(w.hashes(1), s, s + n + min_words - 1) + (p - s).astype(np.uint64)
            ids, subs = (b.column(x).to_numpy()[d] for x in ("id", "sub"))
            own = w.offsets[d]
            cols = [least[s].view(np.int64), content.view(np.int64), ids, subs, (p - own).astype(np.int32), (s - own).astype(np.int32), n.astype(np.int32)]
            for i in range(0, len(s), 65536):
                yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 65536]) for x in cols], ["a", "c", "id", "sub", "p", "s", "n"])

    return texts.mapInArrow(run, _SEGMENT)


def _words_of(min_words: int):
    """For documents with the segments to fetch: a segment's words, or its windows' hashes where its anchor is hot."""
    names = ["a", "w", "id", "sub", "p", "s", "words"]

    def run(batches):
        for b in pieces(batches):
            text = Words(b.column("text"))
            lists = b.column("segs")
            flat, ends = lists.flatten(), lists.offsets.to_numpy()
            d = np.repeat(np.arange(len(b)), np.diff(ends))
            a, p, s, n, hot = (flat.field(x).to_numpy(zero_copy_only=False) for x in ("a", "p", "s", "n", "hot"))
            at = text.offsets[d] + s
            ids, subs = (b.column(x).to_numpy()[d] for x in ("id", "sub"))
            cool = np.flatnonzero(~hot)
            got = [text.data[x:y].tobytes() for x, y in zip(text.starts[at[cool]].tolist(), text.ends[at[cool] + n[cool] + min_words - 2].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(a[cool]), pa.nulls(len(cool), pa.int64()), pa.array(ids[cool]), pa.array(subs[cool]), pa.array(p[cool]), pa.array(s[cool]), pa.array(got, pa.binary())], names)
            hot = np.flatnonzero(hot)
            if len(hot):
                every = windows(text.hashes(1), min_words).view(np.int64)
                j = np.repeat(hot, n[hot])
                start = ranges(at[hot], n[hot])
                yield pa.RecordBatch.from_arrays([pa.array(a[j]), pa.array(every[start]), pa.array(ids[j]), pa.array(subs[j]), pa.array(p[j]), pa.array((start - text.offsets[d[j]]).astype(np.int32)), pa.nulls(len(j), pa.binary())], names)

    return run


def _shard_spans(min_words: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("sub", "ascending"), ("p", "ascending")])
        automaton, found = SuffixAutomaton(), []
        words = Words(pa.array(table.column("words").to_pylist(), pa.large_binary()))
        number, at = words.numbers().tolist(), words.offsets.tolist()
        for i, s in enumerate(table.column("s").to_pylist()):
            sequence = number[at[i] : at[i + 1]]
            long = np.flatnonzero(np.array(automaton.match(sequence)) >= min_words)
            if len(long):
                cut = np.flatnonzero(np.diff(long) > 1) + 1
                found += [(i, s + int(x[0]) - min_words + 1, len(x) + min_words - 1) for x in np.split(long, cut)]
            if len(long) < len(sequence) - min_words + 1:
                automaton.add(sequence)
        i = pa.array([i for i, _, _ in found], pa.int64())
        return pa.table({"id": table.column("id").take(i), "sub": table.column("sub").take(i), "s": pa.array([s for _, s, _ in found], pa.int32()), "n": pa.array([n for _, _, n in found], pa.int32())})

    return run


def repeated_spans(texts: DataFrame, min_words: int) -> DataFrame:
    """(id, sub, s, n): spans of n words from word s whose windows all start earlier too. texts: (id, sub, text)."""
    all_segments = segments(texts, min_words)
    again = stored(all_segments.groupBy("a").agg(F.count("*").alias("n")).where("n > 1"))
    some = looked_up(all_segments, again, ["a"], counts=again).where("found is not null").select(*all_segments.columns)
    some = stored(some)
    place = F.struct("id", "sub", "p")
    first = stored(some.groupBy("a", "c").agg(F.min(place).alias("f"), F.min_by("s", place).alias("s"), F.first("n").alias("n"), F.count("*").alias("copies")))
    copied = first.where("copies > 1")
    copies = looked_up(some, copied.select("a", "c", "f"), ["a", "c"], counts=copied.select("a", "c", F.col("copies").alias("n")))
    copies = copies.where(F.struct("id", "sub", "p") != F.col("found.f")).select("id", "sub", "s", (F.col("n") + min_words - 1).alias("n"))

    several = first.groupBy("a").agg(F.count("*").alias("k")).where("k > 1").select("a", (F.col("k") > HOT).alias("hot"))
    fetch = first.join(several, "a").select("a", "f.*", "s", "n", "hot").groupBy("id", "sub").agg(F.collect_list(F.struct("a", "p", "s", "n", "hot")).alias("segs"))
    fetched = stored(texts.join(fetch, ["id", "sub"]).select("id", "sub", "text", "segs").mapInArrow(_words_of(min_words), "a long, w long, id long, sub long, p int, s int, words binary"))

    cool = fetched.where("w is null")
    shards = max(n_tasks(texts.sparkSession), cool.count() // SHARD)
    shared = cool.withColumn("shard", F.pmod(F.xxhash64("a"), F.lit(shards))).groupBy("shard").applyInArrow(_shard_spans(min_words), "id long, sub long, s int, n int")
    hot = fetched.where("w is not null")
    earliest = stored(hot.groupBy("a", "w").agg(F.min(place).alias("f"), F.count("*").alias("n")).where("n > 1"))
    late = looked_up(hot.drop("words"), earliest.select("a", "w", "f"), ["a", "w"], counts=earliest.select("a", "w", "n"))
    late = late.where(F.struct("id", "sub", "p") != F.col("found.f")).select("id", "sub", "s", F.lit(min_words).alias("n"))
    return copies.union(shared).union(late)


def _schema(more: str, *fields: T.StructField) -> T.StructType:
    return T.StructType([*fields, *T.StructType.fromDDL(more).fields])


def _without(text: bytes, words: Words, spans: list[dict[str, int]], first: int, at: int) -> bytes:
    """text without the bytes of each span, from its first word to its last; spans are in order and apart.

    first: the text's first word among words; at: where the text begins in their data.
    """
    kept, end = [], 0
    for x in spans:
        kept.append(text[end : words.starts[first + x["s"]] - at])
        end = words.ends[first + x["s"] + x["n"] - 1] - at
    return b"".join([*kept, text[end:]])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = 20, layout: bool = False) -> DataFrame:
    """docs with each text cut to the words that no earlier-starting equal window covers, joined by one space.

    With layout, the original bytes stay instead, but for those from the first to the last word of each
    removed span: a text without spans comes back as it is, and one of which no word is left becomes "".

    Words are runs of bytes other than ASCII white space. A window (min_words consecutive words of one
    document) counts as earlier in a document of smaller id or at an earlier start in the same one.
    The last column is a struct `removal`: n_words, n_removed, spans (word ranges taken out, merged, in order).

    Null texts have no words and become "". Null ids order last. Rows that repeat an id order by their
    text's hash; rows that repeat id and text are one document and keep the same words. All columns of
    docs come back, the others unchanged, whatever their names; if one is named removal, in upper or
    lower case, the struct's name has a number after it.
    """
    small_batches(docs.sparkSession)
    rows = keyed(docs, id_col, text_col)
    texts = rows.select("id", "sub", "text")
    # Rows that repeat id and text (only repeated ids have a sub) are one document.
    texts = texts.where("sub = 0").union(texts.where("sub != 0").dropDuplicates(["id", "sub"]))
    spans = repeated_spans(texts, min_words)
    spans = spans.groupBy("id", "sub").agg(F.collect_set(F.struct("s", "n")).alias("spans"))
    ready = rows.join(spans, ["id", "sub"], "left").select("row", "text", "spans")
    kept = "text string, removal struct<n_words: bigint, n_removed: bigint, spans: array<struct<s: int, n: int>>>"
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("s", pa.int32()), ("n", pa.int32())])))])

    def run(batches):
        for b in pieces(batches):
            words, texts, report = Words(b.column("text")), [], []
            for i, (text, spans) in enumerate(zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("spans").to_pylist(), strict=True)):
                text, count, gone = text or b"", int(words.counts[i]), 0
                if spans:
                    drop = np.zeros(count + 1, np.int64)
                    np.add.at(drop, [x["s"] for x in spans], 1)
                    np.add.at(drop, [x["s"] + x["n"] for x in spans], -1)
                    out = np.cumsum(drop)[:-1] > 0
                    edge, gone = np.flatnonzero(np.diff(np.r_[False, out, False])), int(out.sum())
                    spans = [{"s": int(x), "n": int(y - x)} for x, y in zip(edge[::2], edge[1::2], strict=True)]
                    if gone == count:
                        text = b""
                    elif layout:
                        text = _without(text, words, spans, words.offsets[i], words.doc_starts[i])
                    else:
                        text = b" ".join(x for x, no in zip(text.split(), out.tolist(), strict=True) if not no)
                elif not layout:
                    text = b" ".join(text.split())
                texts.append(text)
                report.append({"n_words": count, "n_removed": gone, "spans": spans or []})
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(report, kind)], ["row", "text", "removal"])

    out = ready.mapInArrow(run, _schema(kept, ready.schema["row"]))
    return unpacked(out, docs, text_col, "removal")
