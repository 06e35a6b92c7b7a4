"""Rules from tables: many terms found in texts in one pass, by automata (Aho-Corasick) in Arrow batches.

A rules table is read in shards of a set size, and each shard is one automaton, so a task's memory has a
bound however many rules there are; shards follow one another in the same pass over the texts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import stored

#: Characters of the terms of one automaton.
SHARD_CHARS = 4_000_000
#: Places of a shard's matrix of terms by rules, at most (64 MB).
DENSE = 1 << 23
HITS = "array<struct<place: bigint, rule: string, term: string, n: bigint>>"
_HITS = pa.list_(pa.struct([("place", pa.int64()), ("rule", pa.string()), ("term", pa.string()), ("n", pa.int64())]))
_ITEM = np.dtype([("end", np.int32), ("term", np.int32)])


@dataclass
class Terms:
    """Broadcast shards of a rules table: each a name and, by term, its (place, rule) pairs."""

    shards: list


def load_terms(rules: DataFrame, *, rule_col: str, term_col: str, order_col: str | None = None, fold: bool = True, shard_chars: int = SHARD_CHARS) -> Terms:
    """The rules table as shards. place: order_col, or 0; hits come by place, rule and term.

    Null and empty terms, and rows without a rule, are left out; a row that is repeated counts once. fold:
    terms lose their case, and texts should have lost theirs.
    """
    term = F.lower(term_col) if fold else F.col(term_col)
    place = F.col(order_col).cast("long") if order_col else F.lit(0).cast("long")
    rows = rules.select(place.alias("place"), F.col(rule_col).cast("string").alias("rule"), term.cast("string").alias("term")).where("rule is not null and term != ''")
    rows = stored(rows.groupBy("rule", "term").agg(F.min("place").alias("place")))
    chars = rows.agg(F.sum(F.length("term") + F.length("rule"))).first()[0] or 0
    n, shards = max(1, -(-chars // shard_chars)), []
    for i in range(n):
        known: dict[str, list[tuple[int, str]]] = {}
        for r in rows.where(F.pmod(F.xxhash64("term"), F.lit(n)) == i).toLocalIterator():  # a shard's share
            known.setdefault(r.term, []).append((r.place, r.rule))
        shards.append(rules.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, known)))
    return Terms(shards)


class _Built:
    """A shard's automaton, and its terms and their rules as arrays: term i has the rules at[i] to at[i + 1] of rule."""

    def __init__(self, known: dict[str, list[tuple[int, str]]]):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, term in enumerate(known):
            self.automaton.add_word(term, i)
        if known:
            self.automaton.make_automaton()
        self.terms, self.lengths = pa.array(list(known), pa.string()), np.array([len(t) for t in known], np.int64)
        # Rules are numbered in their order: by place and name.
        self.rules = sorted({r for rules in known.values() for r in rules})
        number = {r: i for i, r in enumerate(self.rules)}
        self.matrix: np.ndarray | None = None
        self.n_rules = np.array([len(rules) for rules in known.values()], np.int64)
        self.at = np.cumsum(self.n_rules) - self.n_rules
        self.rule = np.array([number[r] for rules in known.values() for r in sorted(rules)], np.int64)

    def counts(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, term, n) by number, for each term in each text, ordered by both; occurrences of one term don't overlap, those of several may."""
        each = [np.fromiter(self.automaton.iter(t), _ITEM) if t and len(self.lengths) else np.empty(0, _ITEM) for t in texts]
        all_, n = np.concatenate([*each, np.empty(0, _ITEM)]), len(self.lengths)
        key, end = np.repeat(np.arange(len(each)), [len(x) for x in each]) * n + all_["term"], all_["end"].astype(np.int64)
        order = np.argsort(key, kind="stable")  # a term's occurrences stay in the text's order
        key, end = key[order], end[order]
        first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]][: len(key)])
        sizes = np.diff(np.r_[first, len(key)])
        key = key[first]
        text, term = np.divmod(key, max(n, 1))
        # Where none of a term's occurrences overlaps the one before, all count; else they are gone through.
        near = np.r_[False, np.diff(end)] < np.repeat(self.lengths[term], sizes)
        near[first] = False
        for i in np.unique(np.searchsorted(first, np.flatnonzero(near), "right") - 1).tolist():
            length, last, count = int(self.lengths[term[i]]), None, 0
            for e in end[first[i] : first[i] + sizes[i]].tolist():
                if last is None or e - last >= length:
                    last, count = e, count + 1
            sizes[i] = count
        return text, term, sizes

    def ruled(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among these terms, rule) by number, for each rule of each of these terms."""
        n = self.n_rules[term]
        which = np.repeat(np.arange(len(term)), n)
        return which, self.rule[np.arange(len(which)) + np.repeat(self.at[term] - (np.cumsum(n) - n), n)]

    def by_rule(self, text: np.ndarray, term: np.ndarray, n: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, rule, terms, times) by number, for each rule with a term in one of `size` texts, from what counts gave.

        Where most terms have many rules, a product of matrices adds them up at less cost than a row for each term's rule.
        """
        wide = max(len(self.rules), 1)
        if len(self.lengths) * wide <= DENSE:
            if self.matrix is None:
                self.matrix = np.zeros((len(self.lengths), wide))
                self.matrix[np.repeat(np.arange(len(self.lengths)), self.n_rules), self.rule] = 1.0
            own, column = np.unique(term, return_inverse=True)
            counted = np.zeros((2 * size, len(own)))
            counted[text, column], counted[size + text, column] = 1.0, n
            sums = (counted @ self.matrix[own]).astype(np.int64)
            at, rule = np.nonzero(sums[:size])
            return at, rule, sums[at, rule], sums[size + at, rule]
        which, rule = self.ruled(term)
        key, place = np.unique(text[which] * wide + rule, return_inverse=True)
        return *np.divmod(key, wide), np.bincount(place, minlength=len(key)).astype(np.int64), np.bincount(place, n[which], len(key)).astype(np.int64)


_BUILT: dict[str, _Built] = {}


def _automaton(shard) -> _Built:
    """A shard's automaton, built once in each worker."""
    name, known = shard
    if name not in _BUILT:
        while len(_BUILT) > 3:
            _BUILT.pop(next(iter(_BUILT)))
        _BUILT[name] = _Built(known)
    return _BUILT[name]


def _cut(batch: pa.RecordBatch, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most 256 rows and about `most` bytes of _text; one row at least."""
    at = 0
    while at < len(batch):
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("_text").slice(at, 256)), 0).to_numpy(zero_copy_only=False))
        n = max(1, int(np.searchsorted(ends, most, "right")))
        yield batch.slice(at, n)
        at += n


def with_hits(docs: DataFrame, terms: Terms, text: Column, name: str = "hits") -> DataFrame:
    """docs with the terms found in text: (place, rule, term, n), ordered by place, rule and term; none for a null text."""
    out, columns = docs.withColumn("_text", text.cast("string")), docs.columns
    for i, shard in enumerate(terms.shards):

        def run(batches: Iterator[pa.RecordBatch], shard=shard, i=i) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shard.value)
            for batch in batches:
                for part in _cut(batch):
                    row, term, n = automaton.counts(part.column("_text").to_pylist())
                    which, rule = automaton.ruled(term)
                    places, names = pa.array([p for p, _ in automaton.rules], pa.int64()), pa.array([r for _, r in automaton.rules], pa.string())
                    flat = pa.StructArray.from_arrays([places.take(pa.array(rule)), names.take(pa.array(rule)), automaton.terms.take(pa.array(term[which])), pa.array(n[which])], fields=list(_HITS.value_type))
                    ends = np.r_[0, np.cumsum(np.bincount(row[which], minlength=len(part)))].astype(np.int32)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends), flat).cast(_HITS)], [*batch.schema.names, f"_hits_{i}"])

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, *T.StructType.fromDDL(f"_hits_{i} {HITS}").fields]))
    every = F.array_sort(F.concat(*[F.col(f"_hits_{i}") for i in range(len(terms.shards))]))
    return out.select(*[F.col(f"`{c}`") for c in columns], every.alias(name))


def first_rule(hits: Column, default: str) -> Column:
    """The rule that comes first among those with a term in the text."""
    return F.coalesce(F.try_element_at(hits, F.lit(1)).getField("rule"), F.lit(default))


def term_counts(docs: DataFrame, terms: Terms, text: Column) -> DataFrame:
    """(term, n_documents, n_times) of the terms in any text. A task adds up its own texts' counts before they are shuffled."""
    out = None
    for shard in terms.shards:

        def run(batches: Iterator[pa.RecordBatch], shard=shard) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shard.value)
            size = len(automaton.lengths)
            documents, times = np.zeros(size, np.int64), np.zeros(size, np.int64)
            for batch in batches:
                for part in _cut(batch):
                    _, term, n = automaton.counts(part.column("_text").to_pylist())
                    np.add.at(documents, term, 1)
                    np.add.at(times, term, n)
            some = np.flatnonzero(documents)
            yield pa.RecordBatch.from_arrays([automaton.terms.take(pa.array(some)), pa.array(documents[some]), pa.array(times[some])], ["term", "n_documents", "n_times"])

        own = docs.select(text.cast("string").alias("_text")).mapInArrow(run, "term string, n_documents long, n_times long")
        out = own if out is None else out.unionByName(own)
    return out.groupBy("term").agg(F.sum("n_documents").alias("n_documents"), F.sum("n_times").alias("n_times"))


_RULED = pa.list_(pa.struct([("rule", pa.string()), ("place", pa.int64()), ("terms", pa.int64()), ("times", pa.int64())]))


def _ruled(row: np.ndarray, rule: np.ndarray, names: pa.Array, place: np.ndarray, terms: np.ndarray, times: np.ndarray, n: int) -> pa.Array:
    """For each of n rows (rule, place, terms, times) of each of its rules: sums, the least place, in order of place and name. rule: numbers in names, which are sorted."""
    size = max(len(names), 1)
    key, which = np.unique(row * size + rule, return_inverse=True)
    least = np.full(len(key), np.iinfo(np.int64).max)
    np.minimum.at(least, which, place)
    sums = [np.bincount(which, x, len(key)).astype(np.int64) for x in (terms, times)]
    text, rule = np.divmod(key, size)
    order = np.lexsort((rule, least, text))
    flat = pa.StructArray.from_arrays([names.take(pa.array(rule[order])), *[pa.array(x[order]) for x in (least, *sums)]], fields=list(_RULED.value_type))
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(text, minlength=n))].astype(np.int32)), flat).cast(_RULED)


def with_rule_counts(docs: DataFrame, terms: Terms, text: Column, name: str = "rules") -> DataFrame:
    """docs with (rule, place, terms, times) for each rule with a term in text, in the rules' order: sums as with_rules has them, without a row for each hit."""
    out, columns = docs.withColumn("_text", text.cast("string")), docs.columns
    kind = "array<struct<rule: string, place: bigint, terms: bigint, times: bigint>>"
    for i, shard in enumerate(terms.shards):

        def run(batches: Iterator[pa.RecordBatch], shard=shard, i=i) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shard.value)
            names = sorted({r for _, r in automaton.rules})
            number = {r: k for k, r in enumerate(names)}
            named, place = np.array([number[r] for _, r in automaton.rules], np.int64), np.array([p for p, _ in automaton.rules], np.int64)
            names = pa.array(names, pa.string())
            for batch in batches:
                for part in _cut(batch):
                    row, rule, different, times = automaton.by_rule(*automaton.counts(part.column("_text").to_pylist()), len(part))
                    sums = _ruled(row, named[rule], names, place[rule], different, times, len(part))
                    yield pa.RecordBatch.from_arrays([*part.columns, sums], [*batch.schema.names, f"_rules_{i}"])

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, *T.StructType.fromDDL(f"_rules_{i} {kind}").fields]))
    if len(terms.shards) == 1:
        return out.select(*[F.col(f"`{c}`") for c in columns], F.col("_rules_0").alias(name))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:  # a rule's terms may lie in several shards
        for batch in batches:
            lists = batch.columns[-1]
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            coded = flat.field("rule").dictionary_encode()
            order = np.argsort(np.array(coded.dictionary.to_pylist(), object), kind="stable")
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            of = [flat.field(c).to_numpy(zero_copy_only=False) for c in ("place", "terms", "times")]
            sums = _ruled(np.repeat(np.arange(len(batch)), sizes), rank[coded.indices.to_numpy(zero_copy_only=False)], coded.dictionary.take(pa.array(order)).cast(pa.string()), *of, len(batch))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], sums], batch.schema.names)

    every = F.concat(*[F.col(f"_rules_{i}") for i in range(len(terms.shards))])
    out = out.select(*[F.col(f"`{c}`") for c in columns], every.alias(name))
    return out.mapInArrow(merge, out.schema)


def with_rules(found: DataFrame, hits: str = "hits", name: str = "rules") -> DataFrame:
    """found with (rule, terms, times) for each rule with hits, in the rules' order: its different terms, and all their occurrences."""
    kind = pa.list_(pa.struct([("rule", pa.string()), ("terms", pa.int64()), ("times", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(hits)
            flat, sizes = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False)
            rules, row = flat.field("rule").dictionary_encode(), np.repeat(np.arange(len(batch)), sizes)
            key = row * max(len(rules.dictionary), 1) + rules.indices.to_numpy(zero_copy_only=False)
            _, first, which = np.unique(key, return_index=True, return_inverse=True)
            order = np.argsort(first)  # of each row, its rules as they come
            terms, times = np.bincount(which, minlength=len(first)), np.bincount(which, flat.field("n").to_numpy(zero_copy_only=False), len(first))
            values = pa.StructArray.from_arrays([rules.take(pa.array(first[order])).cast(pa.string()), pa.array(terms[order]), pa.array(times[order].astype(np.int64))], ["rule", "terms", "times"])
            ends = np.r_[0, np.cumsum(np.bincount(row[first], minlength=len(batch)))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(ends), values).cast(kind)], [*batch.schema.names, name])

    return found.mapInArrow(run, T.StructType([*found.schema.fields, *T.StructType.fromDDL(f"{name} array<struct<rule: string, terms: bigint, times: bigint>>").fields]))


def best_rule(rules: Column, default: str, by: str = "terms") -> Column:
    """Of with_rules' column: the rule with the most different terms (by="terms") or occurrences (by="times"), the first among equals."""
    # One pass: a filter by the largest number would look for that number again at each rule.
    best = F.array_max(F.transform(rules, lambda x, i: F.struct(x[by].alias("n"), (-i).alias("i"), x["rule"].alias("rule"))))
    return F.coalesce(best.getField("rule"), F.lit(default))


def expanded(queries: DataFrame, rules: DataFrame, *, key: str, text_col: str, rule_col: str, term_col: str, most: int = 32) -> DataFrame:
    """(key, matched_rules, expanded_terms): of each rule with a term in the text, all its terms that don't stand in it.

    A term matches without regard to case and white space. Terms in the rules' and terms' order, once
    each, at most so many: the limit is the feature. keys are unique. The rules' terms join the matched
    rules by name, so a rule's list is not broadcast.
    """
    compact = lambda c: F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+", "")
    bare = rules.select(F.col(rule_col).cast("string").alias("rule"), F.col(term_col).cast("string").alias("term")).where("rule is not null and term is not null").distinct()
    terms = load_terms(bare.withColumn("bare", compact(F.col("term"))), rule_col="rule", term_col="bare")
    asked = stored(with_hits(queries.select(F.col(key).alias("key"), F.coalesce(text_col, F.lit("")).alias("text")), terms, compact(F.col("text"))))
    matched = asked.select("key", "text", F.explode(F.array_distinct(F.transform("hits", lambda h: h["rule"]))).alias("rule"))
    new = matched.join(bare, "rule").where(~F.contains("text", F.col("term"))).groupBy("key", "term").agg(F.min("rule").alias("rule"))
    lists = new.groupBy("key").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule", "term"))), lambda x: x["term"]).alias("terms"))
    out = asked.select("key", F.array_distinct(F.transform("hits", lambda h: h["rule"])).alias("matched_rules")).join(lists, "key", "left")
    none = F.array().cast("array<string>")
    return out.select(F.col("key").alias(key), "matched_rules", F.slice(F.coalesce("terms", none), 1, most).alias("expanded_terms"))
