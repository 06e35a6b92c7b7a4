"""Queries on the state of tables: profiles, coverage, freshness, catalog pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import quality as q
from ..sources import lookup
from ..sources.scratch import scratch_dir
from .registry import query, table

_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


@query(
    "column_profile",
    " UNION ALL ".join(f"SELECT '{c}' AS column_name, '{t}' AS data_type, count(*) AS n_rows, count(*) - count({c}) AS n_null, round((count(*) - count({c})) / count(*) * 100, 6) AS null_percent, count(DISTINCT {c}) AS n_distinct FROM orders" for c, t in _ORDERS.items()),
)
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.column_profile(table(spark, sf_dir, "orders"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(
    "describe_exact",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS n, sum({c}::DECIMAL(18,2))::DOUBLE / count({c}) AS mean, round(stddev_samp({c}), 6) AS std, min({c}) AS least, round(quantile_cont({c}, 0.25), 6) AS p25, round(quantile_cont({c}, 0.5), 6) AS p50, round(quantile_cont({c}, 0.75), 6) AS p75, max({c}) AS most FROM lineitem"
        for c in _NUMBERS
    ),
)
def describe_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.described(table(spark, sf_dir, "lineitem"), _NUMBERS).withColumns({x: F.round(x, 6) for x in ("std", "p25", "p50", "p75")})


@query(
    "coverage_summary",
    """SELECT 'events' AS table_name, count(*) AS n_rows, 6 AS n_columns, count(*) - (SELECT count(*) FROM (SELECT DISTINCT * FROM events)) AS n_duplicate_rows,
  (count(*) * 6 - count(event_id) - count(ts) - count(user_id) - count(event_type) - count(value) - count(props))::BIGINT AS n_missing, min(ts) AS least_ts, max(ts) AS most_ts FROM events
UNION ALL SELECT 'lines', count(*), 3, count(*) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_shipdate FROM lineitem)), (count(*) * 3 - count(l_orderkey) - count(l_linenumber) - count(l_shipdate))::BIGINT, min(l_shipdate), max(l_shipdate) FROM lineitem""",
)
def coverage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.coverage(table(spark, sf_dir, "events"), "events", "ts").unionByName(q.coverage(table(spark, sf_dir, "lineitem"), "lines", "l_shipdate", ["l_orderkey", "l_linenumber", "l_shipdate"]))


_SOURCES = {"events": ("ts", "value", "event_id"), "orders": ("o_orderdate", "o_totalprice", "o_orderkey"), "lineitem": ("l_shipdate", "l_extendedprice", "l_orderkey, l_linenumber")}


@query("freshness", " UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows, min({t}) AS least_ts, max({t}) AS most_ts, count(*) FILTER ({t} IS NULL) + count(*) FILTER ({v} IS NULL) AS n_missing FROM {n}" for n, (t, v, _) in _SOURCES.items()))
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [q.freshness(table(spark, sf_dir, n), n, t, v) for n, (t, v, _) in _SOURCES.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "quality_report",
    "WITH r AS ("
    + " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS n_rows, min({t}) AS least_ts, max({t}) AS most_ts, count(*) FILTER ({t} IS NULL) + count(*) FILTER ({v} IS NULL) AS n_missing, count(*) - (SELECT count(*) FROM (SELECT DISTINCT {k} FROM {n})) AS n_again FROM {n}"
        for n, (t, v, k) in _SOURCES.items()
    )
    + """) SELECT table_name, n_rows, least_ts, most_ts, n_missing, round(n_missing / n_rows * 100, 4) AS missing_rate, round(n_again / n_rows * 100, 4) AS duplicate_rate, CASE WHEN most_ts IS NULL THEN 60 ELSE 100 END AS freshness_score,
  100 - least(round(n_missing / n_rows * 100, 4), 100) AS pass_rate, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_missing > 0 THEN 'incomplete' ELSE 'ok' END AS status FROM r""",
)
def quality_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.quality_report({n: (table(spark, sf_dir, n), t, v, k.split(", ")) for n, (t, v, k) in _SOURCES.items()})


@query("value_counts", "SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY p_type ORDER BY n DESC, p_brand))::INT AS place FROM (SELECT p_type, p_brand, count(*) AS n FROM part GROUP BY 1, 2)) WHERE place <= 5")
def value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q.top_counts(table(spark, sf_dir, "part"), ["p_type"], "p_brand")


@query(
    "keyword_page",
    """SELECT c_custkey, c_name, c_mktsegment, (SELECT count(*) FROM customer WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%') AS n_total FROM customer WHERE c_name ILIKE '%7%' OR c_mktsegment ILIKE '%7%' ORDER BY c_custkey LIMIT 20 OFFSET 40""",
)
def keyword_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return q.page(customers, ["c_name", "c_mktsegment"], "7", "c_custkey", 20, 2)


_TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "region", "supplier")


@query("metadata_tables", "SELECT table_name, count(*)::INT AS n_columns, string_agg(column_name, ', ' ORDER BY column_index) AS first_columns FROM duckdb_columns() WHERE table_name IN ('" + "', '".join(_TABLES) + "') GROUP BY 1")
def metadata_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = q.catalog_columns({n: table(spark, sf_dir, n) for n in _TABLES})
    return spark.createDataFrame(rows, "table_name string, n_columns int, first_columns string")


@query("master_completeness", "SELECT o_orderstatus, year(o_orderdate)::INT AS year, count(*) AS n, count(o_totalprice) AS n_price, count(DISTINCT o_custkey) AS n_customers, min(o_orderdate) AS first_day, max(o_orderdate) AS last_day FROM orders WHERE o_orderdate <= (SELECT least(max(o_orderdate), (SELECT max(l_shipdate) FROM lineitem)) FROM orders) GROUP BY 1, 2")
def master_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    end = orders.agg(F.max("o_orderdate").alias("a")).join(lines.agg(F.max("l_shipdate").alias("b")), F.lit(True)).select(F.least("a", "b").alias("end"))
    kept = orders.join(F.broadcast(end), F.col("o_orderdate") <= F.col("end"))
    return kept.groupBy("o_orderstatus", F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n"), F.count("o_totalprice").alias("n_price"), F.count_distinct("o_custkey").alias("n_customers"), F.min("o_orderdate").alias("first_day"), F.max("o_orderdate").alias("last_day"))


@query("word_lookup", "SELECT doc_id, lang, source FROM documents WHERE contains(lower(coalesce(text, '')), 'license') OR contains(lower(source), 'license')")
def word_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    lookup.write_lookup(table(spark, sf_dir, "documents"), path, ["doc_id"], texts=["text", "source"], files=16)
    return lookup.containing(spark, path, "License", ["text", "source"]).select("doc_id", "lang", "source")


@query("key_lookup", "SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey IN (7, 200, 777) OR l_partkey IN (5, 17)")
def key_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    lookup.write_lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), path, ["l_orderkey", "l_linenumber"], blooms=["l_partkey"])
    by_order, by_part = lookup.found(spark, path, "l_orderkey", [7, 200, 777]), lookup.found(spark, path, "l_partkey", [5, 17])
    return by_order.unionByName(by_part.where("l_orderkey not in (7, 200, 777)"))
