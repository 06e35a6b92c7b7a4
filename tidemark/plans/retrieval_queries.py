"""Queries that search documents and vectors. Questions are fixed texts or rows of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import masked_fields, tokens
from ..functions.vectors import cosine, normalized
from ..operators import retrieval as r
from ..operators import text_index, vector_index
from ..operators.documents import paragraphs
from ..sources.scratch import scratch_dir, stored
from .registry import ORACLES, query, table

_ASK = "the reation and hethe"
_WORDS = ["the", "reation", "and", "hethe"]
_OWN = "regexp_extract_all(lower(coalesce(text, '')), '[一-龥A-Za-z0-9]{2,}')"


def _times(word: str) -> str:
    return f"((length(lower(coalesce(text, ''))) - length(replace(lower(coalesce(text, '')), '{word}', ''))) / {len(word)})"


_SCORE = f"""(len(list_intersect(list_distinct({_OWN}), {_WORDS})) + {" + ".join(_times(w) for w in _WORDS)})::DOUBLE"""
_KEYWORD = f"""kw AS (SELECT * FROM (SELECT doc_id, {_SCORE} AS keyword_score FROM documents ORDER BY keyword_score DESC, doc_id LIMIT 50) WHERE keyword_score > 0)"""
_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
#: All rows of both sides merged for each query vector, and each query's first rows.
_HYBRID = f"""kw AS (SELECT * FROM (SELECT doc_id, {_SCORE} AS keyword_score FROM documents) WHERE keyword_score > 0),
vec AS (SELECT *, max(vector_score) OVER (PARTITION BY query_id) AS top FROM (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, round({_COS}, 6) AS vector_score FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0) WHERE vector_score > 0),
kq AS (SELECT vec_id AS query_id, doc_id, keyword_score / (SELECT max(keyword_score) FROM kw) AS keyword_score FROM embeddings, kw WHERE vec_id % 50 = 0),
hy AS (SELECT coalesce(kq.query_id, vec.query_id) AS query_id, coalesce(kq.doc_id, vec.doc_id) AS doc_id, coalesce(keyword_score, 0) AS keyword_score, coalesce(vector_score / top, 0) AS vector_score,
  concat_ws(',', CASE WHEN kq.doc_id IS NOT NULL THEN 'keyword' END, CASE WHEN vec.doc_id IS NOT NULL THEN 'vector' END) AS kinds FROM kq FULL JOIN vec ON kq.query_id = vec.query_id AND kq.doc_id = vec.doc_id),
h AS (SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY hybrid_score DESC, doc_id))::INT AS place FROM (SELECT *, round(keyword_score * 0.45::DOUBLE + vector_score * 0.55::DOUBLE, 6) AS hybrid_score FROM hy)) WHERE place <= {{most}})"""


def _keyword(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.keyword_search(table(spark, sf_dir, "documents").select("doc_id", "text"), _ASK, id_col="doc_id", text_col="text", most=50)


def _hybrid(spark: SparkSession, sf_dir: str, most: int) -> DataFrame:
    """(query_id, doc_id, keyword_score, vector_score, kinds, hybrid_score, place): the first `most` of all rows, for each query vector."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    words = r.keyword_search(table(spark, sf_dir, "documents").select("doc_id", "text"), _ASK, id_col="doc_id", text_col="text", most=None)
    found = r.hybrid_search(words, rows, rows.where("doc_id % 50 = 0"), id_col="doc_id", vector_col="embedding", most=most)
    return found.withColumnRenamed("id", "doc_id")


@query("keyword_search", f"WITH {_KEYWORD} SELECT * FROM kw")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _keyword(spark, sf_dir)


@query("vector_topk", f"SELECT query_id, id, least(score, 1.0) AS score, place FROM (SELECT a.vec_id AS query_id, b.vec_id AS id, round({_COS}, 6) AS score, (row_number() OVER (PARTITION BY a.vec_id ORDER BY round({_COS}, 6) DESC, b.vec_id))::INT AS place FROM embeddings a, embeddings b WHERE a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND {_COS} > 0) WHERE place <= 10 AND score > 0")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return r.vector_search(rows, rows.where("vec_id % 50 = 0"), id_col="vec_id", vector_col="embedding")


@query("hybrid_merge", f"WITH {_HYBRID.replace("{most}", "50")} SELECT query_id, doc_id, round(keyword_score, 8) AS keyword_score, round(vector_score, 8) AS vector_score, kinds, hybrid_score FROM h")
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 50).drop("place").withColumns({c: F.round(c, 8) for c in ("keyword_score", "vector_score")})


@query("hybrid_topk", f"WITH {_HYBRID.replace("{most}", "10")} SELECT query_id, doc_id, round(keyword_score, 8) AS keyword_score, round(vector_score, 8) AS vector_score, kinds, hybrid_score, place FROM h")
def hybrid_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hybrid(spark, sf_dir, 10).withColumns({c: F.round(c, 8) for c in ("keyword_score", "vector_score")})


_TEXT = "coalesce(text, '')"
_TOP = _HYBRID.replace("{most}", "20")
_RERANK = f"""rr AS (SELECT h.query_id, h.doc_id, hybrid_score, round(least(1.0::DOUBLE, len(list_intersect(list_distinct(regexp_extract_all(lower(source || ' ' || {_TEXT}), '[一-龥A-Za-z0-9]{{2,}}')), {_WORDS})) / 4.0::DOUBLE * 0.7::DOUBLE
  + CASE WHEN contains({_TEXT}, '{_ASK}') THEN 0.18::DOUBLE ELSE 0.0 END + CASE WHEN {" OR ".join(f"contains(lower(source), '{w}')" for w in _WORDS)} THEN 0.12::DOUBLE ELSE 0.0 END), 6) AS rerank_score
FROM h JOIN documents d ON h.doc_id = d.doc_id)"""


def _found(spark: SparkSession, sf_dir: str, *columns: Column | str) -> DataFrame:
    """Each query's first 20 hits with columns of the documents they name, made once for a document, however many queries find it."""
    # Stored, so that Spark knows how few they are before it shuffles texts for the join.
    hits = stored(_hybrid(spark, sf_dir, 20))
    docs = table(spark, sf_dir, "documents").join(hits.select("doc_id").distinct(), "doc_id", "left_semi")
    return hits.join(docs.select("doc_id", *columns), "doc_id")


@query("heuristic_rerank", f"WITH {_TOP}, {_RERANK} SELECT query_id, doc_id, hybrid_score, rerank_score, round(hybrid_score::DECIMAL(12,6) * 0.55::DECIMAL(3,2) + rerank_score::DECIMAL(12,6) * 0.45::DECIMAL(3,2), 6)::DOUBLE AS final_score FROM rr")
def heuristic_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, r.heuristic_score(spark, _ASK, text_col="text", title_col="source").alias("rerank_score"))
    return found.select("query_id", "doc_id", "hybrid_score", "rerank_score", r.heuristic_final().alias("final_score"))


#: The share of the tokens of question and document that both have stands for a model's raw score.
_RAW = f"len(list_intersect(list_distinct({_OWN}), {_WORDS}))::DOUBLE / len(list_distinct(list_concat({_OWN}, {_WORDS})))"


@query("minmax_rerank", f"WITH {_TOP}, x AS (SELECT query_id, kinds, h.doc_id, hybrid_score, {_RAW} AS raw FROM h JOIN documents d ON h.doc_id = d.doc_id), e AS (SELECT query_id, kinds, min(raw) AS lo, max(raw) AS hi FROM x GROUP BY 1, 2), s AS (SELECT query_id, doc_id, hybrid_score, round(CASE WHEN hi > lo THEN (raw - lo) / (hi - lo) ELSE 1 / (1 + exp(-raw)) END, 6) AS rerank_score FROM x JOIN e USING (query_id, kinds)) SELECT query_id, doc_id, rerank_score, round(hybrid_score::DECIMAL(12,6) * 0.35::DECIMAL(3,2) + rerank_score::DECIMAL(12,6) * 0.65::DECIMAL(3,2), 6)::DOUBLE AS final_score FROM s")
def minmax_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, own = F.array(*map(F.lit, _WORDS)), tokens(F.col("text"))
    raw = F.size(F.array_intersect(own, asked)) / F.size(F.array_union(own, asked))
    found = stored(_found(spark, sf_dir, raw.alias("raw")).select("query_id", "kinds", "doc_id", "hybrid_score", "raw"))
    return r.model_rerank(found, ["query_id", "kinds"], "raw").select("query_id", "doc_id", "rerank_score", "final_score")


_ALIASES = {"src1": ["the", "onth"], "reation": ["eau", "tion"]}
_CATEGORIES = [(["hethe", "and"], ["fr", "de"])]


@query(
    "domain_boost",
    f"""WITH {_TOP}, x AS (SELECT h.query_id, h.doc_id, hybrid_score, lower(source) AS title, lower(coalesce(text, '') || ' ' || lang) AS body, lang = 'es' AS demoted FROM h JOIN documents d ON h.doc_id = d.doc_id),
b AS (SELECT *, (CASE WHEN contains(title, 'src1') THEN 0.14::DOUBLE WHEN contains(body, 'src1') OR contains(body, 'the') OR contains(body, 'onth') THEN 0.05::DOUBLE ELSE 0.0 END)
  + (CASE WHEN contains(title, 'reation') THEN 0.14::DOUBLE WHEN contains(body, 'reation') OR contains(body, 'eau') OR contains(body, 'tion') THEN 0.05::DOUBLE ELSE 0.0 END) + (CASE WHEN contains(body, 'fr') OR contains(body, 'de') THEN 0.06::DOUBLE ELSE 0.0 END) AS raw FROM x),
c AS (SELECT query_id, doc_id, hybrid_score, round(least(CASE WHEN demoted THEN least(raw, 0.02::DOUBLE) ELSE raw END, 0.18::DOUBLE), 6) AS boost, CASE WHEN demoted THEN 0.28::DOUBLE ELSE 0.0::DOUBLE END AS penalty FROM b)
SELECT query_id, doc_id, boost, penalty, round(greatest(0.0, hybrid_score + boost - penalty), 6) AS boosted_score FROM c""",
)
def domain_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.concat_ws(" ", F.coalesce("text", F.lit("")), "lang")
    out = r.boosted(_found(spark, sf_dir, "text", "source", "lang"), F.lit(_ASK), F.col("source"), body, _ALIASES, _CATEGORIES, F.col("lang") == "es")
    return out.select("query_id", "doc_id", "boost", "penalty", "boosted_score")


_SYNONYMS = {"the": ["that", "this"], "on th": ["upon"], "zebra": ["horse"]}


@query(
    "synonym_rewrite",
    """WITH x AS (SELECT item_id, coalesce(text, '') AS t, regexp_replace(lower(coalesce(text, '')), '\\s+', '', 'g') AS s FROM benchmark),
m AS (SELECT item_id, t, contains(s, 'the') OR contains(s, 'that') OR contains(s, 'this') AS a, contains(s, 'onth') OR contains(s, 'upon') AS b, contains(s, 'zebra') OR contains(s, 'horse') AS c FROM x)
SELECT item_id, concat_ws(',', CASE WHEN a THEN 'the' END, CASE WHEN b THEN 'on th' END, CASE WHEN c THEN 'zebra' END) AS matched_rules,
  array_to_string([w FOR w IN (CASE WHEN a THEN ['the', 'that', 'this'] ELSE [] END) || (CASE WHEN b THEN ['on th', 'upon'] ELSE [] END) || (CASE WHEN c THEN ['zebra', 'horse'] ELSE [] END) IF NOT contains(t, w)], ',') AS expanded_terms FROM m""",
)
def synonym_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = r.rewritten(table(spark, sf_dir, "benchmark"), _SYNONYMS)
    return out.select("item_id", F.array_join("matched_rules", ",").alias("matched_rules"), F.array_join("expanded_terms", ",").alias("expanded_terms"))


@query("token_hit_search", "SELECT doc_id, (" + " + ".join(f"contains(lower(coalesce(text, '')), '{w}')::INT" for w in ("hethe", "reation", "nter", "zzz")) + ") AS n_hits FROM documents ORDER BY n_hits DESC, doc_id LIMIT 30")
def token_hit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", r.token_hits(F.col("text"), ["hethe", "reation", "nter", "zzz"]).alias("n_hits")).orderBy(F.desc("n_hits"), "doc_id").limit(30)


@query(
    "paragraph_search",
    f"""WITH p AS (SELECT DISTINCT doc_id, trim(part, ' ' || chr(9) || chr(13) || chr(10)) AS content FROM (SELECT doc_id, unnest(regexp_split_to_array(coalesce(text, ''), '\\n\\s*\\n')) AS part FROM documents)),
s AS (SELECT doc_id, content, len(list_intersect(list_distinct(regexp_extract_all(lower(content), '[一-龥A-Za-z0-9]{{2,}}')), {_WORDS}))::INT AS score FROM p WHERE content <> '')
SELECT doc_id, sha256(content) AS content_sha256, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id, content LIMIT 10""",
)
def paragraph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = r.paragraph_search(table(spark, sf_dir, "documents").select("doc_id", "text"), _ASK, paragraphs(F.col("text")), id_col="doc_id", most=10)
    return found.select("doc_id", F.sha2("content", 256).alias("content_sha256"), "score")


@query(
    "vector_cosine",
    "SELECT a.vec_id, round(greatest(0.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS similarity, round(sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])), 6) AS length, 1.0::DOUBLE AS unit FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id // 2",
)
def vector_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..functions.vectors import norm

    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    other = rows.select(F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    both = rows.withColumn("half", F.floor(F.col("vec_id") / 2)).join(other, F.expr("half = other"))
    return both.select("vec_id", F.round(cosine(F.col("embedding"), F.col("e2")), 6).alias("similarity"), F.round(norm(F.col("embedding")), 6).alias("length"), F.round(norm(normalized(F.col("embedding"))), 6).alias("unit"))


@query("hash_embedding")
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.hash_embedded(table(spark, sf_dir, "documents"), "doc_id", "text")


_META = """m AS (SELECT vec_id, CASE WHEN vec_id % 11 = 0 THEN [] WHEN vec_id % 13 = 0 THEN NULL ELSE embedding END AS e, CASE WHEN label = 0 THEN 'bge' ELSE 'local_hash' END AS provider, CASE WHEN vec_id % 3 = 0 THEN NULL ELSE 'hash-256' END AS model FROM embeddings)"""


def _with_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, key = table(spark, sf_dir, "embeddings"), F.col("vec_id")
    e = F.when(key % 11 == 0, F.array().cast("array<float>")).when(key % 13 != 0, F.col("embedding"))
    return rows.select("vec_id", e.alias("e"), F.when(F.col("label") == 0, "bge").otherwise("local_hash").alias("provider"), F.when(key % 3 != 0, "hash-256").alias("model"))


@query("stale_embeddings", f"WITH {_META} SELECT vec_id FROM m WHERE coalesce(len(e), 0) = 0 OR provider IS DISTINCT FROM 'local_hash' OR model IS DISTINCT FROM 'hash-256'")
def stale_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stale = r.stale(F.col("e"), F.col("provider"), F.col("model"), F.lit("v1"), ("local_hash", "hash-256", "v1"))
    return _with_meta(spark, sf_dir).where(stale).select("vec_id")


@query("embedding_validation", f"WITH {_META} SELECT vec_id, CASE WHEN provider <> 'local_hash' THEN 'provider' WHEN model IS DISTINCT FROM 'hash-256' THEN 'model' WHEN coalesce(len(e), 0) <> 64 THEN 'dimension' ELSE 'ok' END AS reason FROM m")
def embedding_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.coalesce(F.size("e"), F.lit(0))
    reason = F.when(F.col("provider") != "local_hash", "provider").when(~F.col("model").eqNullSafe(F.lit("hash-256")), "model").when(size != 64, "dimension").otherwise("ok")
    return _with_meta(spark, sf_dir).select("vec_id", reason.alias("reason"))


@query("masked_fields", "SELECT event_id, '******' AS token, props AS other FROM events")
def masked_fields_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = masked_fields(F.create_map(F.lit("api_token"), F.col("event_type"), F.lit("other"), F.col("props")))
    return table(spark, sf_dir, "events").select("event_id", fields.alias("f")).select("event_id", F.col("f")["api_token"].alias("token"), F.col("f")["other"].alias("other"))


@query(
    "post_rerank",
    f"""WITH {_TOP}, x AS (SELECT h.query_id, h.doc_id, hybrid_score, source = 'src1' AS core, lang = 'es' AS demoted FROM h JOIN documents d ON h.doc_id = d.doc_id)
SELECT query_id, doc_id, round(greatest(0.0, hybrid_score + CASE WHEN core AND NOT demoted THEN 0.08::DOUBLE ELSE 0.0 END - CASE WHEN demoted THEN 0.28::DOUBLE ELSE 0.0 END), 6) AS final_score FROM x""",
)
def post_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _found(spark, sf_dir, "source", "lang").withColumnRenamed("hybrid_score", "final_score")
    found = found.withColumn("penalty", F.when(F.col("lang") == "es", 0.28).otherwise(0.0))
    return r.adjusted(found, F.col("source") == "src1", F.col("lang") == "es").select("query_id", "doc_id", "final_score")


@query("embedding_refresh")
def embedding_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.array(F.lit(0.5)).alias("embedding"), F.when(F.col("doc_id") % 2 == 0, "local_hash").alias("provider"))
    stale = r.stale(F.col("embedding"), F.col("provider"), F.lit("m"), F.lit("v1"), ("local_hash", "m", "v1"))
    return r.refreshed(docs, stale, id_col="doc_id", text_col="text", vector_col="embedding", size=64).select("doc_id", "embedding")


_BOOSTS = [("src1", ["the", "onth"]), ("reation", ["eau", "tion"])]


def _tier(name: str, more: list[str]) -> str:
    hit = " OR ".join(f"contains(body, '{w}')" for w in (name, *more))
    return f"(CASE WHEN contains(title, '{name}') THEN 0.14::DOUBLE WHEN core AND ({hit}) THEN 0.10::DOUBLE WHEN {hit} THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END)"


@query(
    "domain_boost_tiers",
    f"""WITH x AS (SELECT doc_id, (doc_id % 101)::DOUBLE / 101 AS s, lower(source) AS title, lower(coalesce(text, '') || ' ' || lang) AS body, lang = 'en' AS core, lang = 'fr' AS imported, lang = 'es' AS demoted, lang = 'de' AS allowed FROM documents),
b AS (SELECT *, {" + ".join(_tier(*x) for x in _BOOSTS)} AS raw FROM x),
c AS (SELECT doc_id, s, round(least(CASE WHEN demoted THEN least(raw, 0.02::DOUBLE) ELSE raw + CASE WHEN allowed THEN 0.05::DOUBLE ELSE 0.0::DOUBLE END END, 0.18::DOUBLE), 6) AS boost,
  round(least(CASE WHEN imported THEN 0.06::DOUBLE ELSE 0.0::DOUBLE END + CASE WHEN demoted THEN 0.28::DOUBLE ELSE 0.0::DOUBLE END, CASE WHEN demoted THEN 0.45::DOUBLE ELSE 0.15::DOUBLE END), 6) AS penalty FROM b)
SELECT doc_id, boost, penalty, round(greatest(0.0::DOUBLE, s + boost - penalty), 6) AS boosted_score FROM c""",
)
def domain_boost_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").withColumn("hybrid_score", (F.col("doc_id") % 101).cast("double") / 101)
    body, lang = F.concat_ws(" ", F.coalesce("text", F.lit("")), "lang"), F.col("lang")
    out = r.boosted(found, F.lit(_ASK + " reation src1"), F.col("source"), body, dict(_BOOSTS), [], lang == "es", core=lang == "en", imported=lang == "fr", allowed=lang == "de")
    return out.select("doc_id", "boost", "penalty", "boosted_score")


_QUESTION = "Hethe reation?"


def _count_sql(parts: str, whole: str, bonus: int) -> str:
    """parts: SQL of a list of strings."""
    counted = "list_sum([(length(t) - length(replace(t, p, ''))) // length(p) FOR p IN parts])"
    return f"WITH x AS (SELECT doc_id, coalesce(text, '') AS t, {parts} AS parts FROM documents), s AS (SELECT doc_id, ({counted} + CASE WHEN contains(t, '{whole}') THEN {bonus} ELSE 0 END)::BIGINT AS score FROM x) SELECT doc_id, score FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 20"


@query("file_fallback_search", _count_sql("list_distinct(list_concat(['hethereation'], [substr('hethereation', i, 2) FOR i IN range(1, 12)]))", _QUESTION, 1))
def file_fallback_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.count_search(table(spark, sf_dir, "documents"), r.question_parts(F.lit(_QUESTION)), _QUESTION, id_col="doc_id", text_col="text")


@query("business_file_search", _count_sql("['hethe', 'reation']", "hethe reation", 0))
def business_file_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.count_search(table(spark, sf_dir, "documents"), F.array(F.lit("hethe"), F.lit("reation")), "hethe reation", id_col="doc_id", text_col="text", bonus=0)


@query(
    "index_search",
    f"""WITH t AS (SELECT doc_id, unnest({_OWN}) AS term FROM documents), d AS (SELECT doc_id, term, count(*) AS n FROM t GROUP BY ALL),
a AS (SELECT item_id, unnest(list_distinct({_OWN})) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(n + 1)::BIGINT AS score FROM a JOIN d USING (term) GROUP BY ALL)
SELECT * FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INT AS place FROM s) WHERE place <= 10""",
)
def index_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    text_index.write_index(table(spark, sf_dir, "documents"), path, id_col="doc_id", text_col="text")
    found = text_index.Search(spark, path, table(spark, sf_dir, "benchmark"), question_col="item_id", text_col="text", most=10).hits()
    return found.select(F.col("question").alias("item_id"), F.col("id").alias("doc_id"), "score", "place")


def _cells(spark: SparkSession, sf_dir: str) -> tuple[vector_index.Cells, str]:
    rows, path = table(spark, sf_dir, "embeddings"), scratch_dir(spark)
    cells = vector_index.fit_cells(rows, id_col="vec_id", vector_col="embedding")
    vector_index.write_cells(cells, rows, path, id_col="vec_id", vector_col="embedding")
    return cells, path


@query("cell_topk")
def cell_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, path = _cells(spark, sf_dir)
    return vector_index.search_cells(cells, path, table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0"), id_col="vec_id", vector_col="embedding")


@query("all_cells_topk", ORACLES["vector_topk"])
def all_cells_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells, path = _cells(spark, sf_dir)
    asked = table(spark, sf_dir, "embeddings").where("vec_id % 50 = 0")
    return vector_index.search_cells(cells, path, asked, id_col="vec_id", vector_col="embedding", probes=len(cells.centroids))
