"""Intervals by nodes, tables that upserts write to, and differences of copies."""

import datetime as dt
import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.operators import intervals, keys
from tidemark.sources import buckets
from tidemark.sources.differences import differences

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def test_days_meet_the_intervals_that_hold_them_and_no_others(spark):
    rng = random.Random(7)
    rules = [(i, rng.choice("aab"), *(rng.choice([None, D(rng.randint(0, 90))]) for _ in range(2))) for i in range(120)]
    rules += [(500, "a", D(5), D(5)), (501, "a", D(9), D(8)), (502, None, None, None), (503, "c", dt.date(1, 1, 1), dt.date(9999, 12, 31))]
    days = [(i, rng.choice("abcd"), D(rng.randint(-5, 95))) for i in range(200)] + [(900, "a", None), (901, None, D(1)), (902, "c", dt.date(1, 1, 1)), (903, "c", dt.date(9999, 12, 31))]
    r = spark.createDataFrame(rules, "rule int, k string, starts date, ends date")
    d = spark.createDataFrame(days, "id int, k string, day date")
    want = sorted((i, rule) for i, k, day in days for rule, of, s, e in rules if day and k and k == of and (s is None or s <= day) and (e is None or e >= day))
    met = intervals.hits(d, r, ["k"], "day", "starts", "ends")
    assert sorted(map(tuple, met.select("id", "rule").collect())) == want
    sums = intervals.summed_hits(d, r, ["k"], "day", "starts", "ends", {"n": (F.lit(1), "sum"), "least": (F.col("rule"), "min"), "most": (F.col("rule"), "max")})
    by = {}
    for i, rule in want:
        by.setdefault(i, []).append(rule)
    assert {x.id: (x.n, x.least, x.most) for x in sums.collect()} == {i: (len(by[i]), min(by[i]), max(by[i])) if i in by else (None,) * 3 for i, *_ in days}
    most = r.select(F.size(intervals.covering("starts", "ends")).alias("n")).agg(F.max("n")).first()[0]
    assert most <= 2 * intervals.LEVELS
    assert intervals.hits(d.limit(0), r, ["k"], "day", "starts", "ends").count() == 0


def files(path):
    return {str(f.relative_to(path)): f.stat().st_mtime_ns for f in Path(path, "rows").rglob("*.parquet")}


def test_an_upsert_rewrites_the_buckets_it_touches(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = spark.range(5000).selectExpr("id", "id * 2 as x", "'old' as origin")
    held = buckets.BucketTable(spark, path, ["id"], buckets=32).create(rows)
    before = files(path)
    some = held.read([3, 4]).where("id % 7 < 3").limit(50).select("id", F.lit(-1).cast("long").alias("x"), F.lit("new").alias("origin"))
    some = spark.createDataFrame(some.collect(), "id long, x long, origin string")
    touched = held.upsert(some, "w1", lambda old, new: keys.upserted(old, new, ["id"]))
    after = files(path)
    assert set(touched) <= {3, 4} and touched
    names = {f"bucket={b}/" for b in touched}
    same = {f for f in before if not any(n in f for n in names)}
    assert all(after[f] == before[f] for f in same) and all(f in same for f in set(before) & set(after))
    got = {r.id: (r.x, r.origin) for r in held.read().collect()}
    assert got == {i: (i * 2, "old") for i in range(5000)} | {r.id: (-1, "new") for r in some.collect()}
    assert held.upsert(some.withColumn("x", F.lit(9).cast("long")), "w1", lambda old, new: keys.upserted(old, new, ["id"])) == [] and files(path) == after


@pytest.mark.parametrize("lost", ["_write", "_swap", "log"])
def test_a_write_that_failed_half_way_is_done_once(spark, tmp_path, monkeypatch, lost):
    """Adding to a sum, which is right only if it happens once, wherever the first run stops."""
    path = str(tmp_path / "t")
    held = buckets.BucketTable(spark, path, ["k"], buckets=4).create(spark.createDataFrame([(1, 10), (2, 20), (None, 5)], "k int, x int"))
    news = spark.createDataFrame([(1, 1), (3, 3), (None, 1)], "k int, x int")
    merge = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("x").cast("int").alias("x"))

    class Lost(Exception):
        pass

    def fail(*_):
        raise Lost

    with monkeypatch.context() as m, pytest.raises(Lost):
        if lost == "log":
            swap = buckets.BucketTable._swap
            m.setattr(buckets.BucketTable, "_swap", lambda *a: (swap(*a), fail()))
        else:
            m.setattr(buckets.BucketTable, lost, fail)
        held.upsert(news, "w", merge)
    for _ in range(2):
        buckets.BucketTable(spark, path, ["k"], buckets=4).upsert(news, "w", merge)
    assert sorted(map(tuple, held.read().select("k", "x").collect()), key=str) == sorted([(1, 11), (2, 20), (3, 3), (None, 6)], key=str)
    held.upsert(spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "k int, x int"), "gone", lambda old, new: old.join(new, "k", "left_anti"))
    assert [tuple(r)[:2] for r in held.read().collect()] == [(None, 6)]
    held.upsert(news.limit(0), "none", merge)
    assert held.read().count() == 1


def test_changed_lost_and_added_rows_are_found(spark):
    rows = spark.range(20_000).selectExpr("id", "if(id % 3 = 0, null, id % 100) as x", "concat('t', id) as t", "id as only_here")
    copy = rows.drop("only_here").where("id not in (5, 6)").withColumn("x", F.expr("if(id = 77, null, if(id = 99, 1, x))"))
    copy = copy.unionByName(copy.where("id = 10")).unionByName(copy.where("id = 11").withColumn("id", F.lit(-4).cast("long")))
    got, compared = differences(rows, copy, ["id"])
    assert sorted(map(tuple, got.collect())) == [(-4, "added", 0, 1), (5, "lost", 1, 0), (6, "lost", 1, 0), (10, "changed", 1, 2), (77, "changed", 1, 1), (99, "changed", 1, 1)]
    print(f"rows of both copies that each level compared: {compared}")
    assert compared[0] == 40_000 and compared[1] < 40_000 / 20 and compared[2] < 40
    same, compared = differences(rows, rows, ["id"])
    assert same.collect() == [] and compared[1:] == [0, 0]
    bag = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, x string")
    assert differences(bag, bag.orderBy("x"), ["id"])[0].collect() == []
    assert [tuple(r) for r in differences(bag, bag.where("id = 1"), ["id"])[0].collect()] == [(None, "lost", 1, 0)]
    assert sorted(map(str, differences(bag.limit(0), bag, ["id"])[0].collect())) == sorted(map(str, differences(bag.limit(0), bag, ["id"])[0].collect()))
