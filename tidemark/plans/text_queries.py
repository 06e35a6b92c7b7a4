"""Queries on documents and pages: predicates, tokens, cleaning, chunks, classes, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as t
from ..functions.secrets import masked_rows
from ..operators import documents as d
from ..operators.retrieval import with_hash_embedding
from ..operators.numbering import ranked_within
from ..operators.terms import best_rule, expanded, first_rule, load_terms, term_counts, with_rule_counts
from ..sources.html import html_text
from .registry import query, table

_TOKENS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[一-龥A-Za-z0-9]{2,}'))"


@query("text_predicates", "SELECT p_partkey, p_name, contains(p_name, 'ring') AS has_ring, starts_with(p_name, 'small') AS is_small, regexp_matches(p_name, '(bolt|gear)') AS is_metal FROM part WHERE lower(replace(p_brand, ' ', '')) IN ('brand#1', 'brand#2', 'brand#3') OR p_type = 'ECONOMY'")
def text_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, name = table(spark, sf_dir, "part"), F.col("p_name")
    part = part.where(F.lower(F.replace("p_brand", F.lit(" "), F.lit(""))).isin("brand#1", "brand#2", "brand#3") | (F.col("p_type") == "ECONOMY"))
    return part.select("p_partkey", "p_name", name.contains("ring").alias("has_ring"), name.startswith("small").alias("is_small"), name.rlike("(bolt|gear)").alias("is_metal"))


_RULES = {"english": [" the ", " and "], "german": [" der ", " und "], "french": [" le ", " et "], "spanish": [" el ", " y "]}


def _any(column: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


@query("first_rule_class", "SELECT doc_id, CASE " + " ".join(f"WHEN {_any('text', w)} THEN '{n}'" for n, w in _RULES.items()) + " ELSE 'other' END AS class FROM documents")
def first_rule_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.first_rule(F.col("text"), _RULES, "other").alias("class"))


@query("sensitive_query_flag", "SELECT item_id, " + _any("lower(text)", ["password", "token", "secret", " the "]) + " AS is_sensitive FROM benchmark")
def sensitive_query_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", t.contains_any(F.lower("text"), ["password", "token", "secret", " the "]).alias("is_sensitive"))


@query(
    "tokens_ngrams",
    r"""WITH x AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(lower(coalesce(text, '')), '[一-龥A-Za-z0-9]{2,}') AS t, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS s FROM documents)
SELECT doc_id, len(list_distinct(t))::INT AS n_tokens, t[1] AS first_token, ((length(text) - length(replace(text, 'on', ''))) / 2)::BIGINT AS n_on, length(text)::INT AS n_code_points, len(regexp_split_to_array(text, '\n\s*\n'))::INT AS n_parts, length(s)::INT AS n_bare FROM x""",
)
def tokens_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    text, found = F.coalesce("text", F.lit("")), t.tokens(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("n_tokens"), F.get(found, F.lit(0)).alias("first_token"), t.times(text, F.lit("on")).alias("n_on"), F.length(text).alias("n_code_points"), F.size(F.split(text, r"\n\s*\n")).alias("n_parts"), F.length(t.without_space(F.lower(text))).alias("n_bare"))


@query(
    "name_ngrams",
    """WITH x AS (SELECT p_partkey, replace(lower(p_name), ' ', '') AS s FROM part) SELECT p_partkey, CASE WHEN length(s) < 3 THEN 0 ELSE len(list_distinct([s[i:i + 1] FOR i IN range(1, length(s))])) END::INT AS n_two, len(list_distinct([s[i:i + 2] FOR i IN range(1, length(s) - 1)]))::INT AS n_three FROM x""",
)
def name_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf_dir, "part").select("p_partkey", F.size(t.ngrams(name, 2)).alias("n_two"), F.size(t.ngrams(name, 3)).alias("n_three"))


@query("regex_captures", r"SELECT page_id, regexp_extract(url, '^https?://([^/:?#]+)', 1) AS host, regexp_extract(url, '/([a-z]{2})/', 1) AS lang, nullif(regexp_extract(url, '/(\d+)', 1), '')::BIGINT AS number, rtrim(regexp_extract(url, '^https?://([^/:?#]+)', 1), 'comnetrg') AS trimmed FROM pages")
def regex_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    host, number = F.regexp_extract("url", "^https?://([^/:?#]+)", 1), F.regexp_extract("url", r"/(\d+)", 1)
    trimmed = F.rtrim(host, F.lit("comnetrg"))
    return table(spark, sf_dir, "pages").select("page_id", host.alias("host"), F.regexp_extract("url", "/([a-z]{2})/", 1).alias("lang"), F.nullif(number, F.lit("")).cast("long").alias("number"), trimmed.alias("trimmed"))


@query("hash_ids", "SELECT doc_id, sha1(text) AS sha1, sha256(text) AS sha256, md5(text) AS md5, 'kp_' || (doc_id || '_' || lang) AS short_id FROM documents")
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat_ws(" ?", F.col("doc_id").cast("string"), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", F.sha1("text").alias("sha1"), F.sha2("text", 256).alias("sha256"), F.md5("text").alias("md5"), t.short_id(key, "kp_").alias("short_id"))


@query("doc_exact_dedup", "SELECT min(doc_id) AS doc_id FROM documents WHERE text IS NOT NULL GROUP BY sha256(text) UNION ALL SELECT doc_id FROM documents WHERE text IS NULL")
def doc_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.exact_dedup(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id")


@query(
    "doc_line_cleanup",
    r"""WITH x AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '[ \t]+', ' ', 'g'), chr(10)) AS raw FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, len(raw) AS n_lines, i, trim(raw[i]) AS line FROM x, unnest(range(1, len(raw) + 1)) AS r(i)),
c AS (SELECT doc_id, line, count(*) AS n FROM l GROUP BY 1, 2),
k AS (SELECT l.doc_id, i, line FROM l JOIN c USING (doc_id, line) WHERE NOT regexp_full_match(line, '[-—]*\s*\d+\s*[-—]*') AND NOT (length(line) BETWEEN 1 AND 40 AND n >= 5 AND n > n_lines * 0.03::DOUBLE)),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k GROUP BY 1)
SELECT x.doc_id, sha256(trim(regexp_replace(regexp_replace(coalesce(t.text, ''), '\n{3,}', chr(10) || chr(10), 'g'), '[□■�]{2,}', '', 'g'), ' ' || chr(10))) AS clean_sha256 FROM x LEFT JOIN t USING (doc_id)""",
)
def doc_line_cleanup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = d.cleaned(table(spark, sf_dir, "documents").where("text is not null"), d.cleaned_pages)
    return cleaned.select("doc_id", F.sha2("text", 256).alias("clean_sha256"))


_RUNS = r"regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[\x{FEFF}\x{200B}\x00-\x08\x0b\x0c\x0e-\x1f]', '', 'g'), '\r\n|[\r\x{85}\x{2028}\x{2029}]', chr(10), 'g'), '[ \t]+', ' ', 'g')"
_BARE = r"regexp_replace(regexp_replace(raw[i], '^[\s\p{Z}]+', ''), '[\s\p{Z}]+$', '')"


@query(
    "line_cleanup_b",
    rf"""WITH x AS (SELECT doc_id, string_split(regexp_replace({_RUNS}, '\n[ \t]+', chr(10), 'g'), chr(10)) AS raw FROM documents),
l AS (SELECT doc_id, i, regexp_replace(raw[i], '[\s\p{{Z}}]+$', '') AS line, {_BARE} AS bare FROM x, unnest(range(1, len(raw) + 1)) AS r(i)),
c AS (SELECT *, count(*) OVER (PARTITION BY doc_id, bare) AS n FROM l),
k AS (SELECT *, lag(bare, 1, '') OVER (PARTITION BY doc_id ORDER BY i) AS before FROM c WHERE NOT (length(bare) BETWEEN 1 AND 40 AND n >= 4 AND NOT regexp_matches(bare, '\d'))),
t AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS text FROM k WHERE bare <> before GROUP BY 1),
z AS (SELECT x.doc_id, regexp_replace(regexp_replace(coalesce(t.text, ''), '^[\s\p{{Z}}]+', ''), '[\s\p{{Z}}]+$', '') AS text FROM x LEFT JOIN t USING (doc_id))
SELECT doc_id, length(text)::BIGINT AS n_chars, sha256(text) AS clean_sha256 FROM z""",
)
def line_cleanup_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned, text = d.cleaned(table(spark, sf_dir, "documents"), d.cleaned_runs), F.coalesce("text", F.lit(""))
    return cleaned.select("doc_id", F.length(text).cast("long").alias("n_chars"), F.sha2(text, 256).alias("clean_sha256"))


@query("doc_chunks")
def doc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.chunked(table(spark, sf_dir, "documents"), d.paragraph_chunks, clean=d.cleaned_pages).select("doc_id", "chunk_index", "n_chars", F.sha2("text", 256).alias("sha256"))


@query("index_build")
def index_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = with_hash_embedding(d.chunked(table(spark, sf_dir, "documents"), d.index_chunks), "text")
    key = F.concat_ws("_", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string"))
    return chunks.select(t.short_id(key, "kp_").alias("chunk_id"), "doc_id", "chunk_index", "n_chars", F.sha2("text", 256).alias("checksum"), F.array_join(t.tokens(F.col("text")), " ").alias("keywords"), "embedding")


@query(
    "policy_rows_text",
    r"""SELECT o_orderkey, o_orderdate AS published, concat_ws(chr(10), nullif(o_orderstatus, ''), nullif(o_orderpriority, ''), o_custkey::VARCHAR) AS content, sha256(concat_ws(chr(10), nullif(o_orderstatus, ''), nullif(o_orderpriority, ''), o_custkey::VARCHAR)) AS checksum,
  rank() OVER (PARTITION BY o_orderstatus ORDER BY o_orderdate DESC NULLS LAST, o_orderkey)::INT AS newest FROM orders""",
)
def policy_rows_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = d.row_text(["o_orderstatus", "o_orderpriority", "o_custkey"])
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", "o_orderpriority", "o_custkey")
    ranked = ranked_within(orders, ["o_orderstatus"], [F.desc_nulls_last("o_orderdate"), "o_orderkey"], "newest")
    return ranked.select("o_orderkey", F.col("o_orderdate").alias("published"), content.alias("content"), F.sha2(content, 256).alias("checksum"), F.col("newest").cast("int").alias("newest"))


@query("table_aware_chunks")
def table_aware_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.chunked(table(spark, sf_dir, "documents"), d.section_chunks).select("doc_id", "chunk_index", "n_chars", F.sha2("text", 256).alias("sha256"))


@query(
    "chunk_validation",
    """SELECT conv_id, turn, 'empty' AS violation FROM conversations WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT conv_id, turn, 'too short' FROM conversations WHERE length(coalesce(text, '')) < 50
UNION ALL SELECT conv_id, turn, 'too long' FROM conversations WHERE length(coalesce(text, '')) > 2500 UNION ALL SELECT conv_id, turn, 'repeated id' FROM conversations GROUP BY 1, 2 HAVING count(*) > 1""",
)
def chunk_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.chunk_violations(table(spark, sf_dir, "conversations"), ["conv_id", "turn"])


_CLASSES = {"en": ["the", "and", "of"], "de": ["der", "die", "und"], "fr": ["le", "la", "et"], "es": ["el", "los", "que"]}


def _hits(words: list[str]) -> str:
    return "(" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in words) + ")"


@query(
    "keyword_classify",
    f"""WITH s AS (SELECT doc_id, {", ".join(f"{_hits(w)} AS {n}" for n, w in _CLASSES.items())}, [w FOR w IN ['than', 'tion', 'eau', 'der', 'ung'] IF contains(lower(coalesce(text, '')), w)] AS k FROM documents)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'other' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS class, array_to_string(k[:3], ',') AS keywords FROM s""",
)
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", d.classified(F.col("text"), _CLASSES).alias("class"), F.array_join(d.keywords(F.col("text"), ["than", "tion", "eau", "der", "ung"], 3), ",").alias("keywords"))


def _counts(words: list[str]) -> str:
    times = lambda x, w: f"(length({x}) - length(replace({x}, '{w}', ''))) / {len(w)}"
    return "(" + " + ".join(f"{times('t', w)} + 3 * {times('s', w)}" for w in words) + ")::BIGINT"


@query(
    "frequency_classify",
    f"""WITH x AS (SELECT doc_id, lower(coalesce(text, '')) AS t, lower(coalesce(source, '')) AS s FROM documents), c AS (SELECT doc_id, {", ".join(f"{_counts(w)} AS {n}" for n, w in _CLASSES.items())} FROM x)
SELECT doc_id, CASE WHEN greatest(en, de, fr, es) = 0 THEN 'other' WHEN en = greatest(en, de, fr, es) THEN 'en' WHEN de = greatest(en, de, fr, es) THEN 'de' WHEN fr = greatest(en, de, fr, es) THEN 'fr' ELSE 'es' END AS class FROM c""",
)
def frequency_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", d.classified_by_count(F.col("text"), F.col("source"), _CLASSES).alias("class"))


@query(
    "title_guess",
    r"""WITH x AS (SELECT doc_id, [z FOR z IN [trim(y, '# ') FOR y IN string_split(coalesce(text, ''), chr(10))] IF length(z) BETWEEN 5 AND 80][1] AS first FROM documents)
SELECT doc_id, CASE WHEN contains(first, 'the') OR contains(first, 'la') THEN first ELSE 'doc' || doc_id END AS title, 'txt' AS file_type FROM x""",
)
def title_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf_dir, "documents").select("doc_id", d.title(F.col("text"), name, ["the", "la"]).alias("title"), d.file_type(name).alias("file_type"))


@query("type_sniff", "SELECT page_id, CASE WHEN starts_with(html, '<!DOCT') THEN 'html' ELSE 'unknown' END AS file_type FROM pages")
def type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", d.file_type(F.lit("page"), F.col("html").cast("binary")).alias("file_type"))


@query("html_to_text")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "title", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("sha256"))


@query(
    "redact_secrets",
    r"""SELECT doc_id, sha256(regexp_replace(regexp_replace(regexp_replace(text, '(sk-)[A-Za-z0-9_-]{8,}([A-Za-z0-9_-]{4})', '\1******\2', 'g'), '(Bearer)\s+[A-Za-z0-9._~+/=-]{8,}', '\1 ******', 'gi'), '(postgresql(?:\+\w+)?://[^:\s/@]+:)[^@\s]+(@)', '\1******\2', 'gi')) AS masked_sha256 FROM documents""",
)
def redact_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(t.masked(F.col("text")), 256).alias("masked_sha256"))


@query("resume_anti_join", "SELECT conv_id, turn FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = c.conv_id)")
def resume_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("conv_id"))
    return table(spark, sf_dir, "conversations").join(done, "conv_id", "left_anti").select("conv_id", "turn")


_TABLE_TERMS = """r AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[一-龥A-Za-z0-9]{2,}')) AS term FROM benchmark),
w AS (SELECT DISTINCT unnest(string_split(lower(p_name), ' ')) AS term FROM part)"""
_LOW = "lower(coalesce(text, ''))"


def _item_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, term): each benchmark item as a rule with its tokens as terms."""
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(t.tokens(F.col("text"))).alias("term"))


@query(
    "term_table_counts",
    f"""WITH {_TABLE_TERMS}, a AS (SELECT term FROM w WHERE term <> '' UNION SELECT term FROM r),
d AS (SELECT {_LOW} AS t FROM documents), h AS (SELECT term, (length(t) - length(replace(t, term, ''))) // length(term) AS n FROM d, a WHERE contains(t, term))
SELECT term, count(*) AS n_documents, sum(n)::BIGINT AS n_times FROM h GROUP BY term""",
)
def term_table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("term"))
    rules = words.union(_item_rules(spark, sf_dir).select("term")).withColumn("rule", F.lit("any"))
    terms = load_terms(rules, rule_col="rule", term_col="term")
    return term_counts(table(spark, sf_dir, "documents"), terms, F.lower("text"))


@query(
    "term_table_rules",
    f"""WITH {_TABLE_TERMS}, h AS (SELECT doc_id, item_id, count(*) AS terms, sum((length(t) - length(replace(t, term, ''))) // length(term))::BIGINT AS times
  FROM (SELECT doc_id, {_LOW} AS t FROM documents), r WHERE contains(t, term) GROUP BY ALL),
b AS (SELECT doc_id, min(item_id) AS first, arg_min(item_id, (-terms, item_id)) AS most_terms, arg_min(item_id, (-times, item_id)) AS most_times FROM h GROUP BY doc_id)
SELECT doc_id, coalesce(first::VARCHAR, 'none') AS first_rule, coalesce(most_terms::VARCHAR, 'none') AS most_terms, coalesce(most_times::VARCHAR, 'none') AS most_times FROM documents LEFT JOIN b USING (doc_id)""",
)
def term_table_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    terms = load_terms(_item_rules(spark, sf_dir), rule_col="item_id", term_col="term", order_col="item_id")
    found, rules = with_rule_counts(table(spark, sf_dir, "documents").select("doc_id", "text"), terms, F.lower("text")), F.col("rules")
    return found.select("doc_id", first_rule(rules, "none").alias("first_rule"), best_rule(rules, "none").alias("most_terms"), best_rule(rules, "none", by="times").alias("most_times"))


@query(
    "term_table_rewrite",
    r"""WITH p AS (SELECT DISTINCT p_brand AS rule, unnest(string_split(lower(p_name) || ' ' || lower(p_type), ' ')) AS term FROM part),
q AS (SELECT item_id, coalesce(text, '') AS t, regexp_replace(lower(coalesce(text, '')), '\s+', '', 'g') AS s FROM benchmark),
m AS (SELECT DISTINCT item_id, t, rule FROM q, p WHERE term <> '' AND contains(s, term)),
n AS (SELECT item_id, term, min(rule) AS rule FROM m JOIN p USING (rule) WHERE NOT contains(t, term) GROUP BY ALL),
e AS (SELECT item_id, string_agg(term, ',' ORDER BY rule, term) AS terms FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY rule, term) AS i FROM n) WHERE i <= 32 GROUP BY item_id),
l AS (SELECT item_id, string_agg(rule, ',' ORDER BY rule) AS rules FROM m GROUP BY item_id)
SELECT item_id, coalesce(rules, '') AS matched_rules, coalesce(terms, '') AS expanded_terms FROM q LEFT JOIN l USING (item_id) LEFT JOIN e USING (item_id)""",
)
def term_table_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.split(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type")), " ")
    rules = table(spark, sf_dir, "part").select("p_brand", F.explode(words).alias("term")).where("term != ''")
    out = expanded(table(spark, sf_dir, "benchmark"), rules, key="item_id", text_col="text", rule_col="p_brand", term_col="term")
    return out.select("item_id", F.array_join("matched_rules", ",").alias("matched_rules"), F.array_join("expanded_terms", ",").alias("expanded_terms"))


_MASKED = r"""regexp_replace(regexp_replace(regexp_replace({0}, '(sk-)[A-Za-z0-9_-]{{8,}}([A-Za-z0-9_-]{{4}})', '\1******\2', 'g'), '(Bearer)\s+[A-Za-z0-9._~+/=-]{{8,}}', '\1 ******', 'gi'), '(postgresql(?:\+\w+)?://[^:\s/@]+:)[^@\s]+(@)', '\1******\2', 'gi')"""


@query(
    "nested_secrets",
    f"""WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') || ' Bearer abcdefgh' || conv_id || ' postgresql://me:pw' || turn || '@host/db' AS text FROM conversations)
SELECT conv_id, sha256(string_agg({_MASKED.format("text")}, chr(10) ORDER BY turn)) AS texts_sha256, count(*) AS n, 'Basic ******' AS header, 'postgresql://me:******@host/db' AS url, '******' AS token, sum(turn)::BIGINT AS turns FROM t GROUP BY conv_id""",
)
def nested_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn").cast("string")
    text = F.concat(F.coalesce("text", F.lit("")), F.lit(" Bearer abcdefgh"), F.col("conv_id").cast("string"), F.lit(" postgresql://me:pw"), turn, F.lit("@host/db"))
    head = F.create_map(F.lit("Authorization"), F.concat(F.lit("Basic "), turn), F.lit("database_url"), F.concat(F.lit("postgresql://me:"), turn, F.lit("@host/db")), F.lit("x_token"), turn)
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.struct(F.struct(text.alias("body"), F.col("turn").alias("at")).alias("message"), head.alias("head")).alias("payload"))
    rows = masked_rows(turns)
    held = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "payload.message.body"))).alias("t"), F.count("*").alias("n"), F.first("payload.head").alias("h"), F.sum("payload.message.at").alias("turns"))
    body = F.array_join(F.transform("t", lambda x: x["body"]), "\n")
    return held.select("conv_id", F.sha2(body, 256).alias("texts_sha256"), "n", F.col("h")["Authorization"].alias("header"), F.col("h")["database_url"].alias("url"), F.col("h")["x_token"].alias("token"), "turns")
