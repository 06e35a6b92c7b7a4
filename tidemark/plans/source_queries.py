"""Queries that write a table by a sink and read it by a source: what comes back must be the table."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import reindexed
from ..operators import baselines, documents
from ..sources import readers, sinks
from ..sources.ooxml import read_sheets, write_sheets
from ..sources.scratch import scratch_dir
from .registry import query, table


@query("csv_scan", "SELECT * FROM customer")
def csv_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, customer = scratch_dir(spark), table(spark, sf_dir, "customer")
    sinks.write_files(customer, path, "csv")
    return readers.read_csv(spark, path, ", ".join(f"{n} {t}" for n, t in customer.dtypes))


_LINES = "CASE WHEN lang = 'de' THEN concat('no json ', doc_id) WHEN lang = 'fr' THEN '{\"doc_id\": 1}' ELSE to_json(struct(doc_id, text, lang)) END AS value"


@query(
    "jsonl_reject_scan",
    """SELECT 'good' AS kind, lang AS detail, count(*) AS n FROM documents WHERE lang NOT IN ('de', 'fr') AND coalesce(text, '') <> '' AND trim(text) <> '' GROUP BY 2
UNION ALL SELECT 'not json', '', count(*) FROM documents WHERE lang = 'de' HAVING count(*) > 0 UNION ALL SELECT 'missing fields', 'text', count(*) FROM documents WHERE lang = 'fr' OR (lang <> 'de' AND coalesce(text, '') = '') HAVING count(*) > 0
UNION ALL SELECT 'empty text', '', count(*) FROM documents WHERE lang NOT IN ('de', 'fr') AND text <> '' AND trim(text) = '' HAVING count(*) > 0""",
)
def jsonl_reject_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    table(spark, sf_dir, "documents").selectExpr(_LINES).write.text(path)
    good, rejects = readers.read_jsonl(spark, path, "doc_id long, text string, lang string", ["doc_id", "text"])
    both = good.select(F.lit("good").alias("kind"), F.col("lang").alias("detail")).union(rejects.select("reason", "detail"))
    return both.groupBy("kind", "detail").agg(F.count("*").alias("n"))


@query("column_array_scan", "SELECT o_orderdate AS datetime, o_totalprice AS price, o_custkey::DOUBLE AS customer FROM orders UNION ALL SELECT o_orderdate + INTERVAL 1 HOUR, o_totalprice, NULL FROM orders")
def column_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as a feed's JSON with arrays of two hours, the second of which lacks a customer."""
    text = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), F.date_format(F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss")
    hourly = F.struct(F.array(*text).alias("time"), F.array("o_totalprice", "o_totalprice").alias("p"), F.array("o_custkey").alias("c"))
    feed = table(spark, sf_dir, "orders").select(F.to_json(F.struct(hourly.alias("hourly"))).alias("body"))
    return readers.read_column_arrays(feed, "body", {"price": "p", "customer": "c"}, "time")


def _drop(spark: SparkSession, *names: str) -> None:
    if getattr(spark.sparkContext, "_jsc", None) is not None:
        for name in names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")


def _saved(spark: SparkSession, df: DataFrame) -> str:
    """The name of a new table that holds df; it is dropped as the driver ends, as the query's result still reads it."""
    name = f"t_{uuid.uuid4().hex[:12]}"
    sinks.write_table(df, name, "overwrite")
    atexit.register(_drop, spark, name)
    return name


@query("guarded_table_scan", "SELECT * FROM supplier ORDER BY s_suppkey DESC NULLS LAST LIMIT 25")
def guarded_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.read_table(spark, _saved(spark, table(spark, sf_dir, "supplier")), "s_suppkey", 25)


@query("bound_sql_scan", "SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS most FROM supplier WHERE s_acctbal > 100 GROUP BY 1")
def bound_sql_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _saved(spark, table(spark, sf_dir, "supplier"))
    return readers.read_sql(spark, f"SELECT s_nationkey, count(*) AS n, round(max(s_acctbal), 2) AS most FROM {name} WHERE s_acctbal > :least GROUP BY 1", least=100)


@query("full_table_scan", "SELECT * FROM part")
def full_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.table(_saved(spark, table(spark, sf_dir, "part")))


@query("first_source_with_rows", "SELECT * FROM region")
def first_source_with_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    region = table(spark, sf_dir, "region")
    return readers.first_not_empty(region.where("r_regionkey < 0"), region)


@query("text_file_scan", "SELECT concat('n', n_nationkey) AS title, n_name AS text FROM nation")
def text_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text file for each nation, in a folder of its own, listed and decoded again."""
    path = scratch_dir(spark)
    rows = table(spark, sf_dir, "nation").select(F.encode("n_name", "UTF-8").alias("value"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("title"))
    rows.select("title", F.decode("value", "UTF-8").alias("value")).write.partitionBy("title").text(path)
    found = readers.read_texts(spark, path, ["txt"])
    return found.select(F.regexp_extract("path", "title=([^/]+)/", 1).alias("title"), F.rtrim("text", F.lit("\n")).alias("text"))


@query("import_registry", "SELECT 'r1' AS run_id, 'nation' AS table_name, count(*) AS n_rows FROM nation UNION ALL SELECT 'r1', 'region', count(*) FROM region")
def import_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefix = f"run_{uuid.uuid4().hex[:8]}_"
    out = sinks.import_run({n: table(spark, sf_dir, n) for n in ("nation", "region")}, "r1", "full", "2026-01-01 00:00:00", prefix)
    atexit.register(_drop, spark, f"{prefix}nation", f"{prefix}region")
    return out.withColumn("table_name", F.replace("table_name", F.lit(prefix), F.lit("")))


@query("copied_table_check", "SELECT count(*) AS n_source, count(*) AS n_target, true AS same FROM orders")
def copied_table_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, orders = scratch_dir(spark), table(spark, sf_dir, "orders")
    sinks.write_files(orders, path)
    return sinks.copy_check(orders, spark.read.parquet(path))


@query("growing_table", "SELECT n_nationkey AS key, n_name AS name, NULL::INT AS region FROM nation UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def growing_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, nation = scratch_dir(spark), table(spark, sf_dir, "nation")
    named = nation.select(F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
    sinks.append_growing(named.drop("region"), path)
    sinks.append_growing(named, path)
    return sinks.read_growing(spark, path).select("key", "name", "region")


@query("rerun_partition", "SELECT o_orderstatus, count(*) AS n, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE round(max(o_totalprice), 2) END::DOUBLE AS most FROM orders GROUP BY 1")
def rerun_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One status is written again, twice, with other prices: its rows alone are replaced."""
    path, orders = scratch_dir(spark), table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    again = orders.where("o_orderstatus = 'F'").withColumn("o_totalprice", F.lit(0.0))
    for rows in (orders, again, again):
        sinks.write_partition(rows, path, "o_orderstatus")
    return spark.read.parquet(path).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.max("o_totalprice"), 2).alias("most"))


@query("natural_or_made_key", "SELECT CASE WHEN count(DISTINCT o_custkey) = count(*) THEN 'o_custkey' ELSE 'o_orderkey' END AS key, count(*) AS n, count(DISTINCT o_orderkey) AS different FROM orders")
def natural_or_made_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = sinks.with_key(table(spark, sf_dir, "orders"), [["o_custkey"], ["o_orderkey"]])
    return rows.agg(F.lit(",".join(key)).alias("key"), F.count("*").alias("n"), F.countDistinct(*key).alias("different"))


@query("flat_rows", "SELECT c_custkey, concat('[', c_nationkey, ',', c_custkey, ']') AS pair, concat('{\"name\":\"', c_name, '\"}') AS named FROM customer")
def flat_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer")
    return sinks.flat(customer.select("c_custkey", F.array("c_nationkey", "c_custkey").alias("pair"), F.struct(F.col("c_name").alias("name")).alias("named")))


@query("target_columns", "SELECT c_name, c_custkey FROM customer")
def target_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.matching(table(spark, sf_dir, "customer"), ["c_name", "c_fax", "c_custkey"])


@query("raw_rows_by_alias", "SELECT o_orderdate AS datetime, o_totalprice AS value, NULL::DOUBLE AS load, 'orders.csv' AS source_file FROM orders")
def raw_rows_by_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = readers.raw_rows(table(spark, sf_dir, "orders"), "orders.csv", {"datetime": ["datetime", "o_orderdate"], "value": ["price", "o_totalprice"], "load": ["load"]})
    return out.select("datetime", "value", F.col("load").cast("double").alias("load"), "source_file")


@query("typed_columns", "SELECT event_id, json_extract(props, '$.k')::INT AS k, date_trunc('second', ts) AS created_at FROM events")
def typed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "events").select("event_id", F.col("props").alias("props_json"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"))
    return readers.typed_by_name(text).select("event_id", F.expr("variant_get(props_json, '$.k', 'int')").alias("k"), "created_at")


@query("reindexed_columns", "SELECT c_acctbal, 0.0::DOUBLE AS c_debt, c_custkey::DOUBLE AS c_custkey FROM customer")
def reindexed_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reindexed(table(spark, sf_dir, "customer"), ["c_acctbal", "c_debt", "c_custkey"])


@query("markdown_rows", "SELECT concat('| ', n_nationkey, ' | ', n_name, ' | ', n_regionkey, ' |') AS line FROM nation")
def markdown_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.markdown_table(table(spark, sf_dir, "nation"), ["n_nationkey", "n_name", "n_regionkey"])


@query("leak_columns", "SELECT * FROM (VALUES ('key', 0), ('rt_price', 1), ('rt_price_lag_1', 0)) AS v(column_name, is_banned)")
def leak_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return baselines.leak_report(orders.select(F.col("o_orderkey").alias("key"), F.col("o_totalprice").alias("rt_price"), F.lag("o_totalprice").over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("rt_price_lag_1")))


@query("sheet_round_trip", "SELECT * FROM orders")
def sheet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, path = table(spark, sf_dir, "orders"), scratch_dir(spark)
    write_sheets(orders.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "o_orderkey"), path)
    return read_sheets(spark, path, orders.schema)
