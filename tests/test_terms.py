import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidemark.operators import terms as m


def rules(spark, rows):
    return spark.createDataFrame(rows, "place int, rule string, term string")


RULES = [(2, "b", "Price"), (1, "a", "aa"), (1, "a", "ice"), (3, "c", "价格"), (3, "c", None), (3, "c", ""), (4, None, "x"), (2, "b", "price"), (5, "d", "ice")]
TEXTS = [(1, "price ice PRICE"), (2, "aaaaa"), (3, None), (4, ""), (5, "价格price"), (6, "nothing"), (6, "nothing"), (7, "z" * 200_000 + "aa")]


@pytest.mark.parametrize("chars", [1, 10, 4_000_000])
def test_hits_in_one_pass_whatever_the_shards(spark, chars):
    terms = m.load_terms(rules(spark, RULES), rule_col="rule", term_col="term", order_col="place", shard_chars=chars)
    assert (len(terms.shards) > 1) == (chars < 100)
    docs = spark.createDataFrame([(*r, 0) for r in TEXTS], "id long, text string, Hits int")
    found = m.with_rules(m.with_hits(docs, terms, F.lower("text"), "found"), "found", "sums")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan
    got = {r.id: r for r in found.collect()}
    assert [tuple(h) for h in got[1].found] == [(1, "a", "ice", 3), (2, "b", "price", 2), (5, "d", "ice", 3)]
    assert [tuple(h) for h in got[2].found] == [(1, "a", "aa", 2)] and [tuple(h) for h in got[7].found] == [(1, "a", "aa", 1)]
    assert got[3].found == got[4].found == got[6].found == [] and found.count() == len(TEXTS)
    assert [tuple(x) for x in got[1].sums] == [("a", 1, 3), ("b", 1, 2), ("d", 1, 3)] and got[6].sums == []
    first, terms_, times = found.select("id", m.first_rule(F.col("found"), "none"), m.best_rule(F.col("sums"), "none"), m.best_rule(F.col("sums"), "none", by="times")), {}, {}
    assert {r[0]: tuple(r)[1:] for r in first.collect()} == {1: ("a", "a", "a"), 2: ("a", "a", "a"), 3: ("none",) * 3, 4: ("none",) * 3, 5: ("a", "a", "a"), 6: ("none",) * 3, 7: ("a", "a", "a")}


def test_no_rules_and_no_texts(spark):
    none = m.load_terms(rules(spark, []), rule_col="rule", term_col="term")
    docs = spark.createDataFrame(TEXTS, "id long, text string")
    assert all(r.hits == [] for r in m.with_hits(docs, none, F.col("text")).collect())
    some = m.load_terms(rules(spark, RULES), rule_col="rule", term_col="term")
    assert m.with_rules(m.with_hits(docs.limit(0), some, F.col("text"))).collect() == []


def test_ten_thousand_terms(spark):
    """More terms than a plan could hold as expressions."""
    many = spark.range(10_000).selectExpr("id as place", "concat('rule', id % 7) as rule", "concat('t', id, 'e') as term")
    docs = spark.createDataFrame([(1, "t12e t9999e t12e t10000e"), (2, "t5")], "id long, text string")
    terms = m.load_terms(many, rule_col="rule", term_col="term", order_col="place")
    got = {r.id: [(h.term, h.n) for h in r.hits] for r in m.with_hits(docs, terms, F.col("text")).collect()}
    assert got == {1: [("t12e", 2), ("t9999e", 1)], 2: []}


def test_expanded_questions(spark):
    table = spark.createDataFrame([("RT", "real time"), ("RT", "spot"), ("DA", "day ahead"), ("RT", None), (None, "price")], "rule string, term string")
    asked = spark.createDataFrame([(1, "Real  Time price"), (2, None), (3, "day ahead and spot"), (4, "none")], "id long, q string")
    got = {r.id: (list(r.matched_rules), list(r.expanded_terms)) for r in m.expanded(asked, table, key="id", text_col="q", rule_col="rule", term_col="term").collect()}
    assert got == {1: (["RT"], ["real time", "spot"]), 2: ([], []), 3: (["DA", "RT"], ["real time"]), 4: ([], [])}
    assert [list(r.expanded_terms) for r in m.expanded(asked, table, key="id", text_col="q", rule_col="rule", term_col="term", most=1).where("id = 1").collect()] == [["real time"]]


@pytest.mark.parametrize("chars", [1, 10, 4_000_000])
def test_counts_without_single_hits(spark, chars):
    """Terms that overlap themselves, a rule of two places, rules in several shards: as with_hits and with_rules give it."""
    more = [*RULES, (0, "b", "aba"), (9, "a", "rice"), (4, "e", "ababa"), (2, "e", "nothing")]
    terms = m.load_terms(rules(spark, more), rule_col="rule", term_col="term", order_col="place", shard_chars=chars)
    docs = spark.createDataFrame([*TEXTS, (8, "abababa aaaa abaaba ababa"), (9, "rice"), (9, "nothing rice aba")], "id long, text string")
    hits = m.with_hits(docs, terms, F.lower("text"))
    want = Counter((r.id, tuple(map(tuple, r.rules))) for r in m.with_rules(hits).collect())
    sums = m.with_rule_counts(docs, terms, F.lower("text"))
    assert Counter((r.id, tuple((x.rule, x.terms, x.times) for x in r.rules)) for r in sums.collect()) == want
    assert ("e", 1, 2) in next(k[1] for k in want if k[0] == 8)  # ababa twice, not four times
    each, want = m.term_counts(docs, terms, F.lower("text")), {}
    for _, text in docs.collect():
        for term in {t.lower() for _, rule, t in more if rule and t}:
            if text and (n := text.lower().count(term)):
                want[term] = [a + b for a, b in zip(want.get(term, [0, 0]), [1, n], strict=True)]
    assert {r.term: [r.n_documents, r.n_times] for r in each.collect()} == want


def test_sums_by_rule_are_the_same_by_matrix_and_by_rows(monkeypatch):
    built = m._Built({"aa": [(1, "a"), (2, "b")], "ab": [(2, "b")], "c": [(3, "c")]})
    counted = built.counts(["aaaa ab", "", "c aab", None])
    dense = [x.tolist() for x in built.by_rule(*counted, 4)]
    monkeypatch.setattr(m, "DENSE", 0)
    assert dense == [x.tolist() for x in built.by_rule(*counted, 4)] == [[0, 0, 2, 2, 2], [0, 1, 0, 1, 2], [1, 2, 1, 2, 1], [2, 3, 1, 2, 1]]


def test_best_of_many_rules_takes_linear_time(spark):
    """20,000 rules at one text: comparing each with a maximum that is found again takes 400 million steps."""
    rows = spark.range(4).select("id", F.transform(F.sequence(F.lit(1), F.lit(20_000)), lambda i: F.struct(i.cast("string").alias("rule"), (i % 7).alias("terms"), (i % 5 + 0 * F.col("id")).alias("times"))).alias("r"))
    began = time.perf_counter()
    got = rows.select(m.best_rule(F.col("r"), "none").alias("a"), m.best_rule(F.col("r"), "none", by="times").alias("b")).collect()
    assert {tuple(x) for x in got} == {("6", "4")} and time.perf_counter() - began < 10
