"""Queries on plain tables: joins, latest rows, unions, upserts, sorts, quantiles and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as c
from ..operators import keys as k
from ..operators import numbering
from ..operators.intervals import summed_hits
from ..operators.quantiles import quantiles
from ..operators.risk import ranked
from ..sources.buckets import BucketTable
from ..sources.differences import differences
from ..sources.scratch import scratch_dir
from .registry import ORACLES, query, table

at = lambda x: F.lit(x).cast("timestamp_ntz")


@query(
    "master_join",
    """WITH l AS (SELECT l_orderkey, count(*) AS n_lines, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS lines_total FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_orderdate, o_totalprice, c_name, n_name, r_name, n_lines, lines_total, round(o_totalprice - lines_total, 2) AS spread, o_orderpriority IN ('1-URGENT', '2-HIGH') AS is_urgent
FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN l ON o_orderkey = l_orderkey WHERE lines_total IS NOT NULL AND c_name IS NOT NULL""",
)
def master_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation, region, lineitem = (table(spark, sf_dir, n) for n in ("orders", "customer", "nation", "region", "lineitem"))
    lines = lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum(c.money("l_extendedprice")).cast("double").alias("lines_total"))
    joined = orders.join(customer, F.expr("o_custkey = c_custkey"), "left").join(nation, F.expr("c_nationkey = n_nationkey"), "left").join(region, F.expr("n_regionkey = r_regionkey"), "left").join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    joined = joined.dropna(subset=["lines_total", "c_name"])
    return joined.select("o_orderkey", "o_orderdate", "o_totalprice", "c_name", "n_name", "r_name", "n_lines", "lines_total", F.round(F.col("o_totalprice") - F.col("lines_total"), 2).alias("spread"), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").alias("is_urgent"))


@query("latest_per_key", "SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey", "o_totalprice")).alias("x"))
    return latest.select("o_custkey", "x.o_orderkey", "x.o_orderdate", "x.o_totalprice")


@query("distinct_on_latest", "SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey, o_orderpriority FROM orders ORDER BY o_custkey, o_orderstatus, o_orderdate DESC, o_orderkey")
def distinct_on_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.best_per_key(table(spark, sf_dir, "orders"), ["o_custkey", "o_orderstatus"], F.desc("o_orderdate"), F.asc("o_orderkey")).select("o_custkey", "o_orderstatus", "o_orderkey", "o_orderpriority")


@query("semi_keys", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").select("doc_id", "lang")


@query("anti_keys", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang")


@query("intersection_size", "SELECT count(*) AS n_common FROM (SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels))")
def intersection_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id").distinct().join(table(spark, sf_dir, "labels"), "doc_id", "left_semi").agg(F.count("*").alias("n_common"))


@query(
    "gap_fill_coalesce",
    """SELECT d.doc_id, coalesce(CASE WHEN d.doc_id % 3 <> 0 THEN d.n_chars END, l.quality)::BIGINT AS value, d.doc_id % 3 = 0 AND l.quality IS NOT NULL AS was_filled FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def gap_fill_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.series import filled_from

    docs = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 3 != 0, F.col("n_chars")).alias("value"))
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"))
    return filled_from(docs, labels, "doc_id", ["value"])


@query("quantile_thresholds", "SELECT round(quantile_cont(o_totalprice, 0.1), 6) AS p10, round(quantile_cont(o_totalprice, 0.25), 6) AS p25, round(quantile_cont(o_totalprice, 0.75), 6) AS p75, round(quantile_cont(o_totalprice, 0.9), 6) AS p90 FROM orders")
def quantile_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = {"p10": 0.1, "p25": 0.25, "p75": 0.75, "p90": 0.9}
    return quantiles(table(spark, sf_dir, "orders"), [], "o_totalprice", points).select(*[F.round(p, 6).alias(p) for p in points])


@query("group_quantiles", "SELECT o_orderpriority, round(quantile_cont(o_totalprice, 0.1), 6) AS lower, round(quantile_cont(o_totalprice, 0.9), 6) AS upper FROM orders GROUP BY 1")
def group_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = quantiles(table(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice", {"lower": 0.1, "upper": 0.9})
    return q.select("o_orderpriority", F.round("lower", 6).alias("lower"), F.round("upper", 6).alias("upper"))


@query("rank_desc_min", "SELECT p_partkey, CASE WHEN p_retailprice IS NOT NULL THEN rank() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC NULLS LAST) END::INT AS price_rank FROM part")
def rank_desc_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("p_brand").orderBy(F.desc_nulls_last("p_retailprice"))
    return table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_retailprice").isNotNull(), F.rank().over(w)).alias("price_rank"))


@query("rank_over_all", "SELECT l_orderkey, l_linenumber, l_extendedprice, rank() OVER (ORDER BY l_extendedprice DESC NULLS LAST) AS price_rank FROM lineitem")
def rank_over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.ranked_all(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), "l_extendedprice", "price_rank")


@query("number_over_all", "SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS number FROM events")
def number_over_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbering.numbered(table(spark, sf_dir, "events").select("ts", "event_id"), ["ts", "event_id"]).select("event_id", "number")


@query("far_page", "SELECT l_orderkey, l_linenumber, number FROM (SELECT *, row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber) AS number FROM lineitem) WHERE number BETWEEN 4991 AND 5000")
def far_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    numbering.write_paged(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate"), ["l_shipdate", "l_orderkey", "l_linenumber"], path)
    return numbering.page(spark.read.parquet(path), 500, 10).drop("l_shipdate")


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return k.repeated_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "union_max_merge",
    """SELECT id, max(price) AS price, max(day) AS day, max(clicks) AS clicks FROM (SELECT o_custkey AS id, o_totalprice AS price, o_orderdate AS day, NULL::BIGINT AS clicks FROM orders
 UNION ALL SELECT user_id, NULL, max(ts), count(*) FROM events GROUP BY user_id) GROUP BY id""",
)
def union_max_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias("price"), F.col("o_orderdate").alias("day"))
    events = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("day"), F.count("*").alias("clicks"))
    return k.max_merge([orders, events], ["id"])


@query("upsert_rewrite", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN o_totalprice * 2 ELSE o_totalprice END AS price, CASE WHEN o_orderkey % 5 = 0 THEN 'new' ELSE 'old' END AS origin FROM orders UNION ALL SELECT -1 - o_orderkey, o_totalprice, 'new' FROM orders WHERE o_orderkey % 100 = 0")
def upsert_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    changed = orders.where("o_orderkey % 5 = 0").withColumn("price", F.col("price") * 2)
    added = orders.where("o_orderkey % 100 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    return k.upserted(orders.withColumn("origin", F.lit("old")), changed.unionByName(added).withColumn("origin", F.lit("new")), ["o_orderkey"])


@query(
    "upsert_fill",
    """WITH o AS (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' WHEN c_custkey % 4 = 1 THEN NULL ELSE c_name END AS name FROM customer WHERE c_custkey % 10 <> 0), n AS (SELECT c_custkey, c_mktsegment AS name FROM customer WHERE c_custkey % 3 <> 1)
SELECT c_custkey, coalesce(CASE WHEN o.name <> '' THEN o.name END, n.name) AS name FROM o FULL JOIN n USING (c_custkey)""",
)
def upsert_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = customer.where("c_custkey % 10 <> 0").select("c_custkey", F.when(key % 4 == 0, "").when(key % 4 != 1, F.col("c_name")).alias("name"))
    return k.upserted_filling(old, customer.where("c_custkey % 3 <> 1").select("c_custkey", F.col("c_mktsegment").alias("name")), ["c_custkey"], ["name"])


@query("update_from_join", "SELECT o_orderkey, coalesce(l.price, o_totalprice) AS o_totalprice FROM orders LEFT JOIN (SELECT l_orderkey, max(l_extendedprice) AS price FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) l ON o_orderkey = l_orderkey")
def update_from_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    news = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("price"))
    return k.updated(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), news, ["o_orderkey"], {"o_totalprice": "price"})


@query("single_active", "SELECT s_suppkey, CASE WHEN s_suppkey = (SELECT arg_max(s_suppkey, {'a': s_acctbal, 'k': -s_suppkey}) FROM supplier) THEN 1 ELSE 0 END AS is_active FROM supplier")
def single_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    best = supplier.agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("best"))
    return k.single_active(supplier.join(F.broadcast(best), F.lit(True), "left"), "s_suppkey", F.col("best")).select("s_suppkey", "is_active")


_RULES = """rules AS (SELECT s_suppkey AS rule_id, s_nationkey AS nation, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '1996-01-01' + ((s_suppkey % 40) * 30)::INT END AS starts,
  CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE DATE '1997-01-01' + ((s_suppkey % 50) * 40)::INT END AS ends FROM supplier)"""


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("rule_id"), F.col("s_nationkey").alias("nation"),
        F.expr("case when s_suppkey % 4 <> 0 then date_add(date'1996-01-01', cast((s_suppkey % 40) * 30 as int)) end").alias("starts"),
        F.expr("case when s_suppkey % 5 <> 0 then date_add(date'1997-01-01', cast((s_suppkey % 50) * 40 as int)) end").alias("ends"),
    )


@query(
    "interval_validity_lookup",
    f"""WITH {_RULES}, d AS (SELECT DISTINCT c_nationkey AS nation, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT d.nation, day, count(rule_id) AS n_rules, min(rule_id) AS rule_id FROM d LEFT JOIN rules r ON d.nation = r.nation AND (starts IS NULL OR starts <= day) AND (ends IS NULL OR ends >= day) GROUP BY 1, 2""",
)
def interval_validity_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Days are made distinct first, so rules meet (nation, day) pairs and never orders.
    days = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select(F.col("c_nationkey").alias("of"), F.to_date("o_orderdate").alias("day")).distinct()
    on = F.expr("of = nation and (starts is null or starts <= day) and (ends is null or ends >= day)")
    return days.join(_rules(spark, sf_dir), on, "left").groupBy(F.col("of").alias("nation"), "day").agg(F.count("rule_id").alias("n_rules"), F.min("rule_id").alias("rule_id"))


@query(
    "soft_filter_lookup",
    f"""WITH {_RULES}, m AS (SELECT n_nationkey, rule_id, coalesce(nation = n_nationkey, false) AS same, coalesce((starts IS NULL OR starts <= DATE '1999-06-01') AND (ends IS NULL OR ends >= DATE '1999-06-01'), false) AS valid
 FROM nation JOIN rules ON nation % 5 = n_regionkey)
SELECT n_nationkey, rule_id, same, valid FROM (SELECT *, row_number() OVER (PARTITION BY n_nationkey ORDER BY same DESC, valid DESC, rule_id) AS n FROM m) WHERE n = 1""",
)
def soft_filter_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = F.expr("(starts is null or starts <= date'1999-06-01') and (ends is null or ends >= date'1999-06-01')")
    met = table(spark, sf_dir, "nation").join(_rules(spark, sf_dir), F.expr("nation % 5 = n_regionkey"))
    met = met.withColumns({"same": F.coalesce(F.expr("nation = n_nationkey"), F.lit(False)), "valid": F.coalesce(valid, F.lit(False))})
    return k.soft_match(met, ["n_nationkey"], [F.col("same"), F.col("valid")], F.col("rule_id")).select("n_nationkey", "rule_id", "same", "valid")


@query("listagg_ordered", "SELECT conv_id, string_agg(role, ', ' ORDER BY turn) AS roles, array_to_string(list_sort(list_distinct(list(role))), ',') AS distinct_roles, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256 FROM conversations GROUP BY 1")
def listagg_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    # A conversation's turns are put in order by hash first, so that its text alone, not others', is in memory.
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    got = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(turns.alias("t"))
    return got.select("conv_id", F.array_join("t.role", ", ").alias("roles"), F.array_join(F.array_sort(F.array_distinct("t.role")), ",").alias("distinct_roles"), F.sha2(F.array_join("t.text", "\n"), 256).alias("text_sha256"))


@query("json_extract", "SELECT event_id, (props::JSON->>'k')::BIGINT AS k, props::JSON->>'missing' AS missing, json_type(props) = 'OBJECT' AS is_object FROM events")
def json_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.try_parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.try_variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.missing", "string").alias("missing"), F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False)).alias("is_object"))


@query("json_overlay", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN (props::JSON->>'k')::DOUBLE ELSE value END AS value, json_array_length('[1, 2, ' || event_id || ']')::INT AS n_items, '{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}' AS as_json FROM events")
def json_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("event_id") % 2 != 0, F.col("value"))
    items = F.json_array_length(F.concat(F.lit("[1, 2, "), F.col("event_id").cast("string"), F.lit("]")))
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(own, F.try_variant_get(F.try_parse_json("props"), "$.k", "double")).alias("value"), items.alias("n_items"), F.to_json(F.struct("event_id", "event_type")).alias("as_json"))


@query("standardize_rename", "SELECT o_orderkey AS id, o_orderdate AS datetime, coalesce(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END, 0) AS price, 0.0::DOUBLE AS temperature, 'orders' AS source, 1 AS version FROM orders")
def standardize_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("price", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_totalprice")))
    named = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("datetime"), F.coalesce(c.number("price"), F.lit(0.0)).alias("price"))
    return named.withColumns({"temperature": F.lit(0.0), "source": F.lit("orders"), "version": F.lit(1)})


@query(
    "lenient_casts",
    """SELECT c_custkey, try_cast(c_name AS DOUBLE) AS not_a_number, try_cast(replace(trim(' 1,' || lpad((c_custkey % 1000)::VARCHAR, 3, '0') || '.5 '), ',', '') AS DOUBLE) AS with_commas,
  CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE TIMESTAMP '2024-01-01' + to_hours((c_custkey % 500)::INT) END AS moment, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_acctbal END AS finite, strftime(TIMESTAMP '2024-01-01' + to_hours((c_custkey % 500)::INT), '%Y-%m-%d %H:%M') AS shown FROM customer""",
)
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.expr("date_format(timestamp_ntz'2024-01-01' + make_dt_interval(0, cast(c_custkey % 500 as int)), 'yyyy-MM-dd HH:mm')")
    commas = F.concat(F.lit(" 1,"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit(".5 "))
    odd = F.when(F.col("c_custkey") % 8 == 0, F.lit(float("inf"))).when(F.col("c_custkey") % 4 == 0, F.lit(float("nan"))).otherwise(F.col("c_acctbal"))
    df = table(spark, sf_dir, "customer").withColumns({"shown": shown, "commas": commas, "odd": odd})
    when = F.when(F.col("c_custkey") % 3 == 0, "bad-date").otherwise(F.col("shown"))
    return df.select("c_custkey", c.number("c_name").alias("not_a_number"), c.number_with_commas("commas").alias("with_commas"), c.moment(when, "yyyy-MM-dd HH:mm").alias("moment"), c.finite("odd").alias("finite"), "shown")


@query(
    "fold_long_then_split",
    """WITH l AS (SELECT 'order' AS kind, o_orderkey AS id, o_orderdate AS day, o_totalprice AS order_price, NULL::DOUBLE AS line_price FROM orders UNION ALL SELECT 'line', l_orderkey, l_shipdate, NULL, l_extendedprice FROM lineitem)
SELECT kind, year(day)::INT AS year, count(*) AS n, count(order_price) AS n_order, count(line_price) AS n_line, sum(coalesce(order_price, line_price)::DECIMAL(18,2))::DOUBLE AS total FROM l GROUP BY 1, 2""",
)
def fold_long_then_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.lit("order").alias("kind"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("day"), F.col("o_totalprice").alias("order_price"))
    lines = table(spark, sf_dir, "lineitem").select(F.lit("line").alias("kind"), F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("day"), F.col("l_extendedprice").alias("line_price"))
    both = orders.unionByName(lines, allowMissingColumns=True)
    return both.groupBy("kind", F.year("day").alias("year")).agg(F.count("*").alias("n"), F.count("order_price").alias("n_order"), F.count("line_price").alias("n_line"), F.sum(c.money(F.coalesce("order_price", "line_price"))).cast("double").alias("total"))


@query(
    "latest_row_left_join",
    """WITH o AS (SELECT o_custkey, o_orderkey, o_orderdate, o_orderkey = (SELECT max(o_orderkey) FROM orders) AS is_last_run FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1)
SELECT c_custkey, o_orderkey, o_orderdate, coalesce(is_last_run, false) AS is_last_run FROM customer LEFT JOIN o ON c_custkey = o_custkey""",
)
def latest_row_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    last = orders.agg(F.max("o_orderkey").alias("last"))
    latest = orders.groupBy("o_custkey").agg(F.max(F.struct("o_orderdate", "o_orderkey")).alias("x")).select("o_custkey", "x.o_orderkey", "x.o_orderdate")
    out = table(spark, sf_dir, "customer").join(latest, F.expr("c_custkey = o_custkey"), "left").join(F.broadcast(last), F.lit(True))
    return out.select("c_custkey", "o_orderkey", "o_orderdate", F.coalesce(F.expr("o_orderkey = last"), F.lit(False)).alias("is_last_run"))


@query(
    "run_catalog_overview",
    """WITH r AS (SELECT source AS run_id, max(doc_id) AS last_doc, count(*) AS n_docs, NULL::BIGINT AS n_labels FROM documents GROUP BY 1 UNION ALL SELECT source, NULL, NULL, count(*) FROM documents JOIN labels USING (doc_id) GROUP BY 1),
m AS (SELECT run_id, max(last_doc) AS last_doc, max(n_docs) AS n_docs, max(n_labels) AS n_labels FROM r GROUP BY 1)
SELECT m.run_id, n_docs, coalesce(n_labels, 0) AS n_labels, last_doc, lang, n_chars FROM m LEFT JOIN documents ON doc_id = last_doc""",
)
def run_catalog_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    by_run = docs.groupBy(F.col("source").alias("run_id")).agg(F.max("doc_id").alias("last_doc"), F.count("*").alias("n_docs"))
    labelled = docs.join(table(spark, sf_dir, "labels"), "doc_id").groupBy(F.col("source").alias("run_id")).agg(F.count("*").alias("n_labels"))
    runs = k.max_merge([by_run, labelled], ["run_id"])
    out = runs.join(docs.select("doc_id", "lang", "n_chars"), F.expr("doc_id = last_doc"), "left")
    return out.select("run_id", "n_docs", F.coalesce("n_labels", F.lit(0)).alias("n_labels"), "last_doc", "lang", "n_chars")


@query("parent_child_counts", "SELECT o_orderkey, count(l_orderkey) AS n_lines, count(l_orderkey) FILTER (l_returnflag = 'R') AS n_returned FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def parent_child_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.count(F.when(F.col("l_returnflag") == "R", 1)).alias("n_returned"))
    return table(spark, sf_dir, "orders").select("o_orderkey").join(lines, F.expr("o_orderkey = l_orderkey"), "left").select("o_orderkey", F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("n_returned", F.lit(0)).alias("n_returned"))


@query(
    "group_topk_counts",
    """WITH g AS (SELECT o_orderpriority, o_custkey, count(*) AS n, max(o_totalprice) AS top FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY 1, 2)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey))::INT AS place FROM g) WHERE place <= 5""",
)
def group_topk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("top"))
    return ranked(counts, ["o_orderpriority"], 5, F.desc("n"), F.asc("o_custkey"))


@query("category_pass_rate", "SELECT lang, count(*) AS n, sum(quality)::BIGINT AS n_passed, round(sum(quality) / count(*) * 100, 6) AS pass_percent FROM documents JOIN labels USING (doc_id) GROUP BY 1")
def category_pass_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id")
    return joined.groupBy("lang").agg(F.count("*").alias("n"), F.sum("quality").alias("n_passed"), F.round(F.sum("quality") / F.count("*") * 100, 6).alias("pass_percent"))


@query("ordinal_numbering", "SELECT conv_id, turn, role, (row_number() OVER (PARTITION BY conv_id ORDER BY turn))::INT AS source_row, (row_number() OVER (PARTITION BY conv_id, role ORDER BY length(text) DESC, turn))::INT AS length_rank FROM conversations")
def ordinal_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_length = Window.partitionBy("conv_id", "role").orderBy(F.desc(F.length("text")), F.asc("turn"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).alias("source_row"), F.row_number().over(by_length).alias("length_rank"))


@query("coalesced_sort_tail", "SELECT event_id, coalesce(CASE WHEN event_id % 2 = 0 THEN ts END, TIMESTAMP '2024-01-15' + to_seconds(event_id % 1000)) AS sort_ts FROM events ORDER BY sort_ts DESC, event_id DESC LIMIT 200")
def coalesced_sort_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce(F.when(F.col("event_id") % 2 == 0, F.col("ts")), F.expr("timestamp_ntz'2024-01-15' + make_dt_interval(0, 0, 0, event_id % 1000)"))
    return table(spark, sf_dir, "events").select("event_id", key.alias("sort_ts")).orderBy(F.desc("sort_ts"), F.desc("event_id")).limit(200)


@query("distinct_rows", "SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber, l_tax FROM lineitem")
def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", "l_tax").distinct()


@query("or_predicate_topk", "SELECT DISTINCT l_orderkey, l_linenumber, l_extendedprice, l_discount, l_quantity FROM lineitem WHERE l_discount >= 0.09 OR l_quantity >= 49 ORDER BY l_discount DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_quantity LIMIT 6")
def or_predicate_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "lineitem").where("l_discount >= 0.09 or l_quantity >= 49").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_discount", "l_quantity").distinct()
    return hits.orderBy(F.desc("l_discount"), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_quantity").limit(6)


@query("multi_key_sort", "SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM lineitem ORDER BY nullif(l_returnflag, 'N') DESC NULLS LAST, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def multi_key_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    flag = F.nullif(F.col("l_returnflag"), F.lit("N"))
    return table(spark, sf_dir, "lineitem").orderBy(flag.desc_nulls_last(), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey").limit(100).select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


@query("hour_floor_join", "SELECT a.event_id AS left_id, b.n, b.top FROM events a JOIN (SELECT date_trunc('hour', ts) AS h, event_type, count(*) AS n, max(event_id) AS top FROM events WHERE event_id % 2 = 1 GROUP BY 1, 2) b ON date_trunc('hour', a.ts) = b.h AND a.event_type = b.event_type WHERE a.event_id % 2 = 0")
def hour_floor_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    right = events.where("event_id % 2 = 1").groupBy(c.hour_of("ts").alias("h"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"), F.max("event_id").alias("top"))
    left = events.where("event_id % 2 = 0").select(F.col("event_id").alias("left_id"), c.hour_of("ts").alias("hour_ts"), "event_type")
    return left.join(right, F.expr("hour_ts = h and event_type = kind")).select("left_id", "n", "top")


@query(
    "score_math",
    """SELECT o_orderkey, round(CASE WHEN l.n <> 0 THEN (o_totalprice - l.total) / l.total * 100 END, 6) AS change, round(greatest(0.05, least(0.95, 1 - o_totalprice / 10000 / 100)), 9) AS confidence, round_even(o_totalprice / 1000, 1) AS even
FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS total FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey""",
)
def score_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.risk import confidence

    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(c.money("l_extendedprice")).cast("double").alias("total"))
    out = table(spark, sf_dir, "orders").join(lines, F.expr("o_orderkey = l_orderkey"), "left")
    return out.select("o_orderkey", F.round(c.percent_change("o_totalprice", "total"), 6).alias("change"), F.round(confidence(F.col("o_totalprice") / 10000), 9).alias("confidence"), F.bround(F.col("o_totalprice") / 1000, 1).alias("even"))


@query("aliased_columns", "SELECT o_orderkey AS id, coalesce(o_totalprice, 0) AS price, o_orderdate AS at FROM orders")
def aliased_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    price, when = c.present(orders, ["price", "da_price"], "totalprice"), c.present(orders, ["datetime"], "date")
    return orders.select(F.col("o_orderkey").alias("id"), F.coalesce(c.first_of(orders, ["missing", price]), F.lit(0.0)).alias("price"), F.col(when).alias("at"))


@query("json_safe", """SELECT '{"event_id":' || event_id || ',"value":' || CASE WHEN event_id % 4 = 0 THEN 'null' ELSE (event_id % 4)::DOUBLE::VARCHAR END || ',"day":"' || strftime(ts, '%Y-%m-%d') || '"}' AS json FROM events""")
def json_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources.sinks import json_rows

    value = F.when(F.col("event_id") % 8 == 0, F.lit(float("nan"))).when(F.col("event_id") % 4 == 0, F.lit(float("inf"))).otherwise((F.col("event_id") % 4).cast("double"))
    return json_rows(table(spark, sf_dir, "events").select("event_id", value.alias("value"), F.to_date("ts").alias("day")))


@query("given_filters", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'")
def given_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime as dt

    from ..functions.predicates import between_days, where_given

    orders = between_days(table(spark, sf_dir, "orders"), "o_orderdate", dt.date(1996, 1, 1), dt.date(1996, 12, 31))
    wanted = {"status": ("F", F.col("o_orderstatus") == "F"), "customer": (None, F.col("o_custkey") == 1), "priority": ("", F.col("o_orderpriority") == "")}
    return where_given(orders, wanted).select("o_orderkey", "o_orderstatus")


_CROWDED = _RULES.replace("s_nationkey AS nation", "CASE WHEN s_suppkey % 3 = 0 THEN 7 ELSE s_nationkey END AS nation")


@query(
    "interval_nodes_lookup",
    f"""WITH {_CROWDED}, d AS (SELECT c_nationkey AS nation, o_orderkey, o_orderdate::DATE AS day FROM orders JOIN customer ON o_custkey = c_custkey)
SELECT o_orderkey, count(rule_id) AS n_rules, min(rule_id) AS rule_id FROM d LEFT JOIN rules r ON d.nation = r.nation AND (starts IS NULL OR starts <= day) AND (ends IS NULL OR ends >= day) GROUP BY o_orderkey""",
)
def interval_nodes_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = _rules(spark, sf_dir).withColumn("nation", F.when(F.col("rule_id") % 3 == 0, 7).otherwise(F.col("nation")))
    days = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.expr("o_custkey = c_custkey")).select("o_orderkey", F.col("c_nationkey").alias("nation"), F.to_date("o_orderdate").alias("day"))
    out = summed_hits(days, rules, ["nation"], "day", "starts", "ends", {"n_rules": (F.lit(1).cast("long"), "sum"), "rule_id": (F.col("rule_id"), "min")})
    return out.select("o_orderkey", F.coalesce("n_rules", F.lit(0)).alias("n_rules"), "rule_id")


@query("bucket_upsert", ORACLES["upsert_rewrite"])
def bucket_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"))
    held = BucketTable(spark, scratch_dir(spark), ["o_orderkey"]).create(orders.withColumn("origin", F.lit("old")))
    changed = orders.where("o_orderkey % 5 = 0").withColumn("price", F.col("price") * 2)
    added = orders.where("o_orderkey % 100 = 0").withColumn("o_orderkey", -1 - F.col("o_orderkey"))
    for _ in range(2):  # the second run finds its write noted
        held.upsert(changed.unionByName(added).withColumn("origin", F.lit("new")), "first", lambda old, new: k.upserted(old, new, ["o_orderkey"]))
    return held.read().drop("bucket")


@query("bucket_fill", ORACLES["upsert_fill"])
def bucket_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    old = customer.where("c_custkey % 10 <> 0").select("c_custkey", F.when(key % 4 == 0, "").when(key % 4 != 1, F.col("c_name")).alias("name"))
    held = BucketTable(spark, scratch_dir(spark), ["c_custkey"]).create(old)
    news = customer.where("c_custkey % 3 <> 1").select("c_custkey", F.col("c_mktsegment").alias("name"))
    held.upsert(news, "fill", lambda old, new: k.upserted_filling(old, new, ["c_custkey"], ["name"]))
    return held.read().select("c_custkey", F.when(F.col("name") != "", F.col("name")).alias("name"))


@query("bucket_update", ORACLES["update_from_join"])
def bucket_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = BucketTable(spark, scratch_dir(spark), ["o_orderkey"]).create(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"))
    news = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_extendedprice").alias("price"))
    held.upsert(news, "actuals", lambda old, new: k.updated(old, new, ["o_orderkey"], {"o_totalprice": "price"}))
    return held.read().drop("bucket")


@query("bucket_single_active", ORACLES["single_active"])
def bucket_single_active(spark: SparkSession, sf_dir: str) -> DataFrame:
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    held = BucketTable(spark, scratch_dir(spark), ["s_suppkey"]).create(supplier.select("s_suppkey", (F.col("s_suppkey") == 1).cast("int").alias("is_active")))
    best = supplier.agg(F.max_by("s_suppkey", F.struct("s_acctbal", -F.col("s_suppkey"))).alias("s_suppkey")).select("s_suppkey", F.lit(1).alias("is_active"))
    before = held.read().where("is_active = 1").select("s_suppkey", F.lit(0).alias("is_active"))
    changes = before.join(best, "s_suppkey", "left_anti").unionByName(best)
    held.upsert(changes, "switch", lambda old, new: k.upserted(old, new, ["s_suppkey"]))
    return held.read().drop("bucket")


@query(
    "copy_differences",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 1009 = 5 THEN 'lost' ELSE 'changed' END AS kind, 1::BIGINT AS n_source, CASE WHEN o_orderkey % 1009 = 5 THEN 0 ELSE 1 END::BIGINT AS n_target FROM orders WHERE o_orderkey % 1009 = 5 OR o_orderkey % 997 = 3
UNION ALL SELECT -1 - o_orderkey, 'added', 0, 1 FROM orders WHERE o_orderkey % 1013 = 7 AND o_orderkey % 1009 <> 5""",
)
def copy_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    copy = orders.where("o_orderkey % 1009 != 5").withColumn("o_totalprice", F.expr("if(o_orderkey % 997 = 3, o_totalprice + 0.01, o_totalprice)"))
    copy = copy.unionByName(copy.where("o_orderkey % 1013 = 7").withColumn("o_orderkey", -1 - F.col("o_orderkey")))
    return differences(orders, copy, ["o_orderkey"])[0]
