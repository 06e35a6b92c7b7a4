import datetime as dt

from pyspark.sql import functions as F

from tidemark.llm.url_filter import MOST_PARTS, filtered, host_of, intervals, keys_of


def test_intervals(spark):
    d = lambda n: dt.date(2024, 1, n)
    rows = [("a", "x.org", d(1), "add"), ("a", "x.org", d(3), "add"), ("a", "x.org", d(5), "remove"), ("a", "x.org", d(9), "add"), ("b", "x.org", d(2), "add"), ("b", "x.org", d(2), "remove"), ("a", None, d(1), "add"), ("a", "y", None, "add"), ("a", "z", d(1), "touch"), ("c", "x.org", d(4), "remove")]
    got = sorted(tuple(r) for r in intervals(spark.createDataFrame(rows, "list string, entry string, date date, action string")).collect())
    assert got == [("a", "x.org", d(1), d(5)), ("a", "x.org", d(9), None)]


def test_keys(spark):
    urls = ["http://User:pw@A.b.Example.com:80/x/y?q#f", "https://h.org", "nonsense", None, "ftp://one/"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(keys_of(F.col("u"))).collect()]
    assert got == [["a.b.example.com", "b.example.com", "example.com", "a.b.example.com/x", "a.b.example.com/x/y"], ["h.org"], [], [], ["one"]]


def test_captures_see_the_entries_of_their_time(spark):
    d = lambda n: dt.date(2024, 1, n)
    entries = spark.createDataFrame([("spam", "example.com", d(2), "add"), ("spam", "example.com", d(4), "remove"), ("porn", "a.example.com/x", d(3), "add")], "list string, entry string, date date, action string")
    rows = [(1, "http://a.example.com/x/1", d(1)), (2, "http://a.example.com/x/1", d(2)), (3, "http://a.example.com/x", d(3)), (4, "http://a.example.com/xy", d(4)), (5, "http://notexample.com", d(3)), (6, None, d(3)), (7, "http://example.com", None), (None, "http://example.com", d(2)), (2, "http://a.example.com/x/1", d(2))]
    captures = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, fetched date, blocked int")
    got = sorted(((r.page_id, r.blocked, list(r.lists)) for r in filtered(captures, entries, id_col="page_id").collect()), key=str)
    assert got == sorted([(1, False, []), (2, True, ["spam"]), (3, True, ["porn", "spam"]), (4, False, []), (5, False, []), (6, False, []), (7, False, []), (None, True, ["spam"]), (2, True, ["spam"])], key=str)
    assert filtered(captures, entries.limit(0), id_col="page_id").where("blocked").count() == 0
    assert filtered(captures.limit(0), entries, id_col="page_id").count() == 0


def test_hosts_lose_their_case_and_paths_keep_it(spark):
    entries = spark.createDataFrame([("a", "B.org/Up/", dt.date(2024, 1, 1), "add"), ("h", "C.ORG", dt.date(2024, 1, 1), "add")], "list string, entry string, date date, action string")
    urls = ["http://b.ORG/Up/x", "http://b.org/up/x", "http://c.org/Any"]
    captures = spark.createDataFrame([(i, u, dt.date(2024, 2, 1)) for i, u in enumerate(urls)], "id long, url string, fetched date")
    assert {r.id: r.blocked for r in filtered(captures, entries, id_col="id").collect()} == {0: True, 1: False, 2: True}


def test_no_python_in_the_plan(spark):
    entries = spark.createDataFrame([("a", "b.org", dt.date(2024, 1, 1), "add")], "list string, entry string, date date, action string")
    captures = spark.range(3).selectExpr("id", "concat('http://b.org/', id) url", "date'2024-02-01' fetched")
    plan = filtered(captures, entries, id_col="id")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_hosts_with_brackets_and_several_at_signs(spark):
    urls = ["http://[2001:DB8::1]/a", "http://u:p@[::1]:80/x", "http://a@b@evil.com/x", "http://h.org/p@q", "http://h.org?x@y", "http://@/", "http://[::1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in urls], "u string").select(host_of(F.col("u"))).collect()]
    assert got[:6] == ["[2001:db8::1]", "[::1]", "evil.com", "h.org", "h.org", None]
    entries = spark.createDataFrame([("l", e, dt.date(2024, 1, 1), "add") for e in ("evil.com", "[2001:db8::1]", "[::1]/x")], "list string, entry string, date date, action string")
    captures = spark.createDataFrame([(i, u, dt.date(2024, 2, 1)) for i, u in enumerate(urls)], "id long, url string, fetched date")
    assert {r.id for r in filtered(captures, entries, id_col="id").collect() if r.blocked} == {0, 1, 2}


def test_very_long_urls_and_entries(spark):
    """A megabyte of path or host has no more keys than any other; entries longer than a key are compared whole."""
    deep, wide = "http://h.org/" + "a/" * 500_000, "http://" + "b." * 500_000 + "org/x"
    sizes = spark.createDataFrame([(deep,), (wide,)], "u string").select(F.size(keys_of(F.col("u"))), F.length(F.array_join(keys_of(F.col("u")), ""))).collect()
    assert all(n <= 2 * MOST_PARTS and size <= 2 * MOST_PARTS * len(wide) for n, size in sizes)
    entries = ["h.org/" + "a/" * 40 + "a", "h.org/" + "a/" * 40 + "b", "b." * 40 + "org", "c." * 40 + "org", "h.org/" + "a/" * 31 + "a"]
    entries = spark.createDataFrame([(str(i), e, dt.date(2024, 1, 1), "add") for i, e in enumerate(entries)], "list string, entry string, date date, action string")
    captures = spark.createDataFrame([(i, u, dt.date(2024, 2, 1)) for i, u in enumerate([deep, wide, "http://h.org/" + "a/" * 40])], "id long, url string, fetched date")
    assert {r.id: list(r.lists) for r in filtered(captures, entries, id_col="id").collect()} == {0: ["0", "4"], 1: ["2"], 2: ["4"]}
