"""One query per operator: it applies the operator to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ann import nearest
from .chat import repaired
from .collocations import collocations
from .decontaminate import contaminated
from .lm_score import scored
from .minhash_dedup import near_duplicates
from .packing import pack, token_pieces
from .prefix_trie import numbered, prefix_trie, spliced
from .quality import judged, train
from .scratch import shared_dir
from .substring_dedup import remove_repeats
from .token_files import checksums, read_tokens, write_tokens
from .url_filter import filtered, host_of
from .warc_zip import read_index, read_records, write_archives

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_SPACE = r"'[^\x20\x09-\x0D]+'"


@query(
    "op1_minhash_dedup",
    rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACE}) AS ws FROM documents),
g AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) = 1 THEN [ws[1]]
        ELSE list_distinct([ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))]) END AS gs FROM w),
s AS (SELECT doc_id, len(gs) AS n, unnest(gs) AS gram FROM g),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) AS na, any_value(b.n) AS nb, count(*) AS k
      FROM s a JOIN s b ON a.gram = b.gram AND a.doc_id < b.doc_id
       AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * k >= 80 * (na + nb - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, reach) AS (SELECT a, b FROM e UNION SELECT r.id, e.b FROM r JOIN e ON r.reach = e.a),
c AS (SELECT id, min(reach) AS least FROM r GROUP BY id)
SELECT doc_id, len(gs)::BIGINT AS n_shingles, least(doc_id, coalesce(c.least, doc_id)) AS component_id,
       doc_id = least(doc_id, coalesce(c.least, doc_id)) AS kept
FROM g LEFT JOIN c ON c.id = g.doc_id""",
)
def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=2, threshold=0.8)


@query(
    "op5_substring_dedup",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_SPACE}) AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 19], ' ') AS gram FROM w, unnest(range(1, len(ws) - 18)) AS t(i)),
late AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY gram ORDER BY doc_id, i) AS n FROM g) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS i FROM late, range(0, 20) AS r(j)),
each AS (SELECT doc_id, i, ws[i] AS word, gone.i IS NOT NULL AS out
         FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w) LEFT JOIN gone USING (doc_id, i)),
kept AS (SELECT doc_id, count(*) FILTER (out) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT out) AS text FROM each GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)""",
)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), min_words=20)
    return out.select("doc_id", "removal.n_words", "removal.n_removed", F.sha2("text", 256).alias("kept_sha256"))


_ALNUM = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"


@query(
    "op4_decontaminate",
    rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_ALNUM}) AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS gram
       FROM b, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS t(i) WHERE len(ws) > 0),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS gram
       FROM d, (SELECT DISTINCT n FROM bw) AS k, unnest(range(1, len(ws) - n + 2)) AS t(i)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, gram)),
words AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM hit, range(0, 10) AS r(j) WHERE j < n GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS list
          FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(list, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)""",
)
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"), window=10, text=False)
    items = F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256")
    return out.select("doc_id", "leak.n_words", "leak.n_hit", F.size("leak.items").cast("long").alias("n_items"), items, (F.col("leak.n_hit") > 0).alias("contaminated"))


@query("op6_token_ids")
def op6_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path, tokenizer())
    return checksums(read_tokens(spark, path))


@query("op9_packing")
def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(token_pieces(table(spark, sf_dir, "documents"), tokenizer(), capacity=1024), capacity=1024)


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return judged(docs, train(docs, table(spark, sf_dir, "labels")), text=False).select("doc_id", "rules.*")


@query(
    "op2_lm_score",
    rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), {_SPACE}) AS ws FROM documents),
t AS (SELECT doc_id, i, ws[i] AS b, CASE WHEN i > 1 THEN ws[i - 1] END AS a FROM w, unnest(range(1, len(ws) + 1)) AS r(i)),
c1 AS (SELECT b AS word, count(*) AS n FROM t GROUP BY 1),
c2 AS (SELECT a, b, count(*) AS n FROM t WHERE a IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 2),
s AS (SELECT t.doc_id, CASE WHEN t.a IS NULL THEN ln(u.n / (SELECT count(*) FROM t)::DOUBLE)
        WHEN c2.n IS NOT NULL THEN ln(c2.n / v.n::DOUBLE) ELSE ln(u.n / (SELECT count(*) FROM t)::DOUBLE) + ln(0.4::DOUBLE) END AS x
      FROM t JOIN c1 u ON u.word = t.b LEFT JOIN c1 v ON v.word = t.a LEFT JOIN c2 ON c2.a = t.a AND c2.b = t.b),
d AS (SELECT doc_id, count(*) AS n, sum(x) AS x FROM s GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_words, round(coalesce(x, 0), 5) AS log_score, round(x / n, 7) AS mean_log_score
FROM w LEFT JOIN d USING (doc_id)""",
)
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scored(table(spark, sf_dir, "documents").select("doc_id", "text"), order=2, backoff=0.4, least=2, text=False)
    return out.select("doc_id", "lm.n_words", F.round("lm.log_score", 5).alias("log_score"), F.round("lm.mean_log_score", 7).alias("mean_log_score"))


#: Dated lists by rule: of each host, whether and when it is listed follows from its length.
_LISTS = """
SELECT 'hosts' AS list, host AS entry, DATE '2024-01-01' + CAST(length(host) % 9 * 20 AS INT) AS date, 'add' AS action FROM hosts WHERE length(host) % 3 = 0
UNION ALL SELECT 'hosts', host, DATE '2024-03-01' + CAST(length(host) % 9 * 20 AS INT), 'remove' FROM hosts WHERE length(host) % 3 = 0
UNION ALL SELECT 'hosts', host, DATE '2024-10-01', 'add' FROM hosts WHERE length(host) % 6 = 0
UNION ALL SELECT 'sections', concat(host, '/en'), DATE '2024-02-10', 'add' FROM hosts WHERE length(host) % 4 = 1
UNION ALL SELECT 'sections', concat(host, '/de'), DATE '2024-05-10', 'add' FROM hosts WHERE length(host) % 4 = 2
UNION ALL SELECT 'domains', 'example.org', DATE '2024-06-01', 'add' UNION ALL SELECT 'domains', 'example.org', DATE '2024-06-20', 'remove'
UNION ALL SELECT 'spam', 'spam-farm.example.org', DATE '2024-01-01', 'add' UNION ALL SELECT 'spam', 'www.cheap-pills.example.com', DATE '2024-01-15', 'add'
"""
_SQL_HOST = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)"
_SQL_PATH = r"regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1)"


@query(
    "op3_url_filter",
    rf"""
WITH c AS (SELECT page_id, lower({_SQL_HOST}) AS host, {_SQL_PATH} AS path, DATE '2024-01-01' + CAST(page_id % 366 AS INT) AS t FROM pages),
hosts AS (SELECT DISTINCT host FROM c WHERE host <> ''),
e AS ({_LISTS}),
x AS (SELECT *, lead(date) OVER (PARTITION BY list, entry ORDER BY date) AS until FROM e),
hit AS (SELECT DISTINCT page_id, list, entry FROM c JOIN x ON t >= x.date AND (until IS NULL OR t < until) AND action = 'add'
        AND (host = entry OR ends_with(host, '.' || entry)
             OR (contains(entry, '/') AND (host || rtrim(path, '/') = entry OR starts_with(host || path, entry || '/'))))),
h AS (SELECT page_id, string_agg(DISTINCT list, ',' ORDER BY list) AS lists, string_agg(DISTINCT entry, ',' ORDER BY entry) AS entries FROM hit GROUP BY page_id)
SELECT page_id, h.page_id IS NOT NULL AS blocked, coalesce(lists, '') AS lists, coalesce(entries, '') AS entries FROM c LEFT JOIN h USING (page_id)""",
)
def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    entries = spark.sql(_LISTS.replace("FROM hosts", "FROM {hosts}"), hosts=hosts)
    captures = pages.withColumn("fetched", F.expr("DATE '2024-01-01' + CAST(page_id % 366 AS INT)"))
    out = filtered(captures, entries, id_col="page_id")
    return out.select("page_id", "blocked", F.array_join("lists", ",").alias("lists"), F.array_join("entries", ",").alias("entries"))


@query("op7_warc_zip")
def op7_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_archives(table(spark, sf_dir, "pages"), shared_dir(spark), least_bytes=0)
    return read_records(read_index(archives), payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op8_chat_roles")
def op8_chat_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(table(spark, sf_dir, "conversations"))


@query(
    "op11_collocations",
    rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, row_number() OVER () AS p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
o AS (SELECT lang, p, unnest(ws) AS x, generate_subscripts(ws, 1) AS i FROM w),
s AS (SELECT lang, x, lead(x) OVER v AS y, lead(x, 2) OVER v AS z FROM o WINDOW v AS (PARTITION BY p ORDER BY i)),
g AS (SELECT lang, 1 AS k, x AS phrase FROM s UNION ALL SELECT lang, 2, x || ' ' || y FROM s WHERE y IS NOT NULL
      UNION ALL SELECT lang, 3, x || ' ' || y || ' ' || z FROM s WHERE z IS NOT NULL),
t AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f AS MATERIALIZED (SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, count(*) AS n FROM g GROUP BY lang, k, phrase HAVING count(*) >= 10),
c AS (SELECT lang, k, phrase, n, cut, array_to_string(ws[1:cut], ' ') AS first, array_to_string(ws[cut + 1:k], ' ') AS rest FROM f, range(1, 3) AS q(cut) WHERE cut < k),
best AS (SELECT c.lang, c.k, c.phrase, c.n AS a, x.n AS l, y.n AS r, (1000000::HUGEINT * c.n * c.n // (x.n::HUGEINT * y.n::HUGEINT))::BIGINT AS score
         FROM c JOIN f x ON x.lang = c.lang AND x.phrase = c.first JOIN f y ON y.lang = c.lang AND y.phrase = c.rest
         QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, cut) = 1),
held AS (SELECT lang, array_to_string(ws[i:i + 1], ' ') AS phrase, max(n) AS longer FROM f, range(1, 3) AS q(i) WHERE k = 3 GROUP BY 1, 2),
kept AS (SELECT b.* FROM best b LEFT JOIN held h ON h.lang = b.lang AND h.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT kept.lang, row_number() OVER (PARTITION BY kept.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, t.n, score
FROM kept JOIN t USING (lang) QUALIFY rank <= 2000""",
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"), longest=3, least=10, covered=50, most=2000)


#: CRC-32 of a string of ASCII characters: each is mixed in, then eight shifts (-1 in the list) follow.
_CRC32 = """xor(4294967295, list_reduce(flatten(list_transform(string_split({0}, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
  lambda x, e: CASE WHEN e >= 0 THEN xor(x, e) ELSE xor(x >> 1, (x & 1) * 3988292384) END, 4294967295::BIGINT))"""


@query(
    "op12_prefix_trie",
    rf"""
WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i,
             {{'r': coalesce(role, ''), 't': coalesce(text, '')}} AS x FROM conversations WHERE conv_id IS NOT NULL),
l AS (SELECT conv_id AS c, list(x ORDER BY i) AS xs FROM t GROUP BY conv_id),
h AS (SELECT c, xs, {_CRC32.format("c::VARCHAR")} % 9 AS h FROM l),
b AS (SELECT h.c, list_concat(coalesce(p.xs[1:h.h], []), h.xs[h.h + 1:]) AS xs FROM h LEFT JOIN l p ON p.c = h.c - h.c % 5),
n AS (SELECT c, d, sha256(to_json(xs[1:d])::VARCHAR) AS id, CASE WHEN d > 0 THEN sha256(to_json(xs[1:d - 1])::VARCHAR) END AS up, len(xs) AS total,
             CASE WHEN d > 0 THEN strlen(xs[d].t) ELSE 0 END AS size FROM b, unnest(range(0, len(xs) + 1)) AS r(d)),
g AS (SELECT d, id, any_value(up) AS up, min(c) AS c, count(*) AS n, (count(*) - 1) * any_value(size) AS saved,
             sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (total = d), '')) AS ends FROM n GROUP BY d, id),
k AS (SELECT up AS id, d - 1 AS d, count(*) AS kids FROM g WHERE d > 0 GROUP BY 1, 2),
e AS (SELECT g.*, coalesce(kids, 0) AS kids FROM g LEFT JOIN k USING (id, d)),
a AS (SELECT DISTINCT y.id AS low, y.d AS low_d, x.id, x.d FROM n y JOIN n x ON x.c = y.c AND x.d <= y.d),
s AS (SELECT a.id, a.d, sum(e.saved) AS saved, count(*) FILTER (e.kids = 0) AS leaves FROM a JOIN e ON e.id = a.low AND e.d = a.low_d GROUP BY 1, 2)
SELECT e.c AS conv_id, e.d AS depth, p.c AS parent_conv_id, e.n AS n_convs, e.kids AS n_children, s.leaves AS n_leaves, s.saved::BIGINT AS saved_tokens, e.ends AS ends_sha256
FROM e JOIN s ON s.id = e.id AND s.d = e.d LEFT JOIN e p ON p.id = e.up AND p.d = e.d - 1""",
)
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(numbered(table(spark, sf_dir, "conversations")), every=5, most=9))


@query("op13_nearest")
def op13_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), "id % 100 = 0", k=10)
