"""From raw documents to packed training sequences: the stages, in order, and the whole run.

Each stage takes (spark, docs, sf_dir), works on all of docs and returns the columns of documents, but
for the last, which returns the packed pieces. Whatever docs' other columns are called, in upper or
lower case, they stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.decontaminate import contaminated
from tidemark.llm.minhash_dedup import near_duplicates
from tidemark.llm.packing import pack, token_pieces
from tidemark.llm.quality import judged, train
from tidemark.llm.queries import table, tokenizer
from tidemark.llm.rows import packed, place, unpacked
from tidemark.llm.scratch import stored
from tidemark.llm.substring_dedup import remove_repeats


def without_report(out: DataFrame, condition: str | None = None) -> DataFrame:
    """out without its last column, a struct; with a condition on the struct's fields, only the rows that meet it."""
    by_place, n = out.toDF(*[f"_{i}" for i in range(len(out.columns))]), len(out.columns) - 1
    if condition:
        by_place = by_place.where(f"_{n}.{condition}")
    return by_place.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(out.columns[:n])])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the classifier keep. Null and empty texts fail the rules and go."""
    model = train(docs, table(spark, sf_dir, "labels"))
    return without_report(judged(docs, model), "kept")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (5-word shingles, similarity 0.8): the one of smallest id.

    Rows that repeat an id, or have none, stay or go together.
    """
    kept = near_duplicates(docs, shingle=5, threshold=0.8).where("kept").select("doc_id").distinct()
    rows = packed(docs, "text").withColumn("id", F.col("row").getField(f"_{place(docs, 'doc_id')}"))
    return unpacked(rows.join(kept, F.expr("id <=> doc_id"), "left_semi"), docs, "text")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without passages of 20 words or more that start earlier in docs.

    What stays of a text keeps its line breaks and spaces. A document of which nothing is left stays,
    with an empty text. n_chars, where docs has it, follows the text.
    """
    out = without_report(remove_repeats(docs, min_words=20, layout=True))
    if "n_chars" not in out.columns:
        return out
    by_place, at = out.toDF(*[f"_{i}" for i in range(len(out.columns))]), place(out, "n_chars")
    length = F.length(f"_{place(out, 'text')}").cast(out.schema[at].dataType)
    return by_place.select(*[(length if i == at else F.col(f"_{i}")).alias(c) for i, c in enumerate(out.columns)])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any 10-word window of a benchmark item."""
    return without_report(contaminated(docs, table(spark, sf_dir, "benchmark"), window=10), "n_hit = 0")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces in sequences of at most 1024 tokens."""
    return pack(token_pieces(docs, tokenizer(), capacity=1024), capacity=1024)


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: SQL can't express the trained classifier or the packing; tests hold the run against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each written as Parquet and reread as the next one's docs."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
