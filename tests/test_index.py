"""The inverted index of texts, the cells of vectors, and numbers, ranks and pages over whole tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidemark.operators import numbering, text_index, vector_index
from tidemark.plans.registry import QUERIES, load

load()
SF = "/root/testdata/sf0.01"


def found_by_hand(docs, questions, most):
    counts = {i: Counter(re.findall("[一-龥A-Za-z0-9]{2,}", (t or "").lower())) for i, t in docs}
    out = []
    for q, text in questions:
        asked = set(re.findall("[一-龥A-Za-z0-9]{2,}", (text or "").lower()))
        hits = sorted((-sum(c[w] + 1 for w in asked if c[w]), i) for i, c in counts.items() if asked & c.keys())
        out += [(q, i, -s, place) for place, (s, i) in enumerate(hits[:most], 1)]
    return sorted(out)


def test_questions_are_answered_exactly_and_blocks_are_skipped(spark, tmp_path):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(60)] + ["价格", "Case", "x"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(int(1.02**i)))) for i in range(350)]
    docs += [(1000, None), (1001, ""), (1002, "."), (1003, "w1 " * 3), (1004, "w1 " * 3), (1005, "only here")]
    questions = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 6)))) for i in range(30)] + [(90, None), (91, "unknown"), (92, "here"), (93, "w1 W1 w1")]
    text_index.write_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path / "index"), id_col="id", text_col="body", per_range=8)
    search = text_index.Search(spark, str(tmp_path / "index"), spark.createDataFrame(questions, "q long, t string"), question_col="q", text_col="t", most=7)
    assert sorted(map(tuple, search.hits().collect())) == found_by_hand(docs, questions, 7)
    every, read = (f.agg(F.sum("blocks")).first()[0] for f in (search.bounds, search.chosen))
    print(f"blocks of the questions' terms: {every}, read: {read}")
    assert read < every / 2


def test_folders_that_no_question_needs_are_not_scanned(spark, tmp_path):
    docs = [(i, "common " * (400 - i) + ("rare" if i < 20 else "")) for i in range(400)]
    text_index.write_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path / "index"), id_col="id", text_col="body", per_range=10)
    search = text_index.Search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "common")], "q long, t string"), question_col="q", text_col="t", most=5)
    assert [r.id for r in search.hits().orderBy("place").collect()] == [0, 1, 2, 3, 4]
    parts = {r.part for r in search.chosen.collect()}
    assert len(parts) <= 3 < search.bounds.select("part").distinct().count()
    file = next((tmp_path / "index" / "postings").glob("part=0/*.parquet"))
    columns = pq.ParquetFile(file).metadata.row_group(0)
    encodings = {columns.column(i).path_in_schema.split(".")[0]: columns.column(i).encodings for i in range(columns.num_columns)}
    assert "DELTA_BINARY_PACKED" in encodings["places"] and "DELTA_BINARY_PACKED" in encodings["n"]


def test_an_index_is_written_without_rows_of_words(spark, tmp_path):
    """A part is one task's, which has its texts' terms as rows of documents; bounds need no places."""
    docs = [(i, " ".join(f"w{j % 50}" for j in range(i))) for i in range(1, 300)]
    text_index.write_index(spark.createDataFrame(docs, "id long, body string"), str(tmp_path / "index"), id_col="id", text_col="body", per_range=100)
    files = sorted((tmp_path / "index" / "postings").glob("part=*/*.parquet"))
    assert [f.parent.name for f in files] == ["part=0", "part=1", "part=2"]
    for row in pq.read_table(files[0], partitioning=None).to_pylist():
        assert row["top"] == max(row["n"]) and row["places"] == sorted(row["places"])
    search = text_index.Search(spark, str(tmp_path / "index"), spark.createDataFrame([(1, "w3")], "q long, t string"), question_col="q", text_col="t", most=3)
    assert [(r.id, r.score, r.place) for r in search.hits().orderBy("place").collect()] == [(254, 7, 1), (255, 7, 2), (256, 7, 3)]  # equal scores: the smaller ids, not the longer texts


def test_words_by_bytes():
    import pyarrow as pa

    rng = random.Random(1)
    for _ in range(200):
        texts = ["".join(rng.choice("aZ09 .\n一龥丁龦㐀䷿éß😀鿿\x00_豈") for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 9))]
        text, words = text_index._words(pa.array(["zz", *texts], pa.string()).slice(1))
        assert list(zip(text.tolist(), words.to_pylist(), strict=True)) == [(i, x) for i, t in enumerate(texts) for x in re.findall("[一-龥A-Za-z0-9]{2,}", t)]


def test_questions_are_scored_in_turn(monkeypatch):
    import pyarrow as pa

    blocks = pa.table({"range": [0, 0, 0], "term": ["a", "b", "c"], "places": [[7, 8, 9], [8], [9]], "n": pa.array([[1, 1, 1], [5], [5]], pa.list_(pa.int32()))})
    asked = pa.table({"question": ["x", "y", "z", "none"], "floor": [0, 3, 100, 0], "terms": [["a"], ["a", "b", "new"], ["a"], ["new"]]})
    for at_once in (1, 10, 1 << 21):
        monkeypatch.setattr(text_index, "_AT_ONCE", at_once)
        got = text_index._best(1)(blocks, asked).to_pylist()
        assert [tuple(r.values()) for r in got] == [("x", 7, 2), ("x", 8, 2), ("x", 9, 2), ("y", 8, 8)]


def test_no_documents_and_no_questions(spark, tmp_path):
    none = spark.createDataFrame([], "id long, body string")
    for name, docs, asked in (("a", none, [(1, "w")]), ("b", spark.createDataFrame([(1, "ww")], "id long, body string"), [])):
        text_index.write_index(docs, str(tmp_path / name), id_col="id", text_col="body")
        search = text_index.Search(spark, str(tmp_path / name), spark.createDataFrame(asked, "q long, t string"), question_col="q", text_col="t")
        assert search.hits().collect() == []


def test_cells_find_what_the_exact_search_finds(spark):
    """Recall at 10 for all vec_id % 50 = 0 against the exact search."""
    got, want = ({(r.query_id, r.id) for r in QUERIES[n](spark, SF).collect()} for n in ("cell_topk", "vector_topk"))
    print(f"recall at 10: {len(got & want) / len(want):.3f}")
    assert len(got & want) >= 0.9 * len(want)


def test_new_rows_join_the_cells_without_fitting(spark, tmp_path):
    rng = np.random.default_rng(5)
    old = rng.normal(size=(8, 12))[rng.integers(0, 8, 300)] * 4 + rng.normal(size=(300, 12))
    odd = [(900, None), (901, []), (902, [0.0] * 12), (903, [1.0]), (904, [float("nan")] * 12), (905, [None] * 12), (None, old[0].tolist())]
    schema = "id long, v array<double>"
    rows = spark.createDataFrame([*((i, x.tolist()) for i, x in enumerate(old)), *odd], schema)
    cells = vector_index.fit_cells(rows, id_col="id", vector_col="v", cells=8)
    cells.save(spark, str(tmp_path / "model"))
    cells = vector_index.Cells.load(spark, str(tmp_path / "model"))
    vector_index.write_cells(cells, rows, str(tmp_path / "cells"), id_col="id", vector_col="v")
    new = spark.createDataFrame([(1000, (old[7] * 2).tolist()), (1001, (old[7] + 0.001).tolist())], schema)
    vector_index.write_cells(cells, new, str(tmp_path / "cells"), id_col="id", vector_col="v")
    assert cells.probes < 8 and len(list((tmp_path / "cells").glob("cell=*"))) <= 8
    asked = rows.where("id = 7")
    assert [r.id for r in vector_index.search_cells(cells, str(tmp_path / "cells"), asked, id_col="id", vector_col="v", most=2).orderBy("place").collect()] == [1000, 1001]
    small, whole = (vector_index.search_cells(cells, str(tmp_path / "cells"), rows.where("id % 50 = 0"), id_col="id", vector_col="v", probes=8, block=n) for n in (16, 4096))
    key = lambda r: (r.query_id, r.place, r.id, round(r.score, 6))
    assert sorted(map(key, small.collect())) == sorted(map(key, whole.collect()))
    with pytest.raises(ValueError):
        vector_index.fit_cells(rows.where("id > 899 and id < 903"), id_col="id", vector_col="v")


@pytest.mark.parametrize("descending", [True, False])
def test_ranks_over_slices(spark, descending):
    """A value with two thirds of the rows, nulls, and values that begin and end slices."""
    rng = random.Random(6)
    values = [rng.choice([5, 5, 5, 5, None, *range(12)]) for _ in range(500)] + [99, -1]
    df = spark.createDataFrame(list(enumerate(values)), "id int, x int")
    order = lambda v: (v is None, -v if descending and v is not None else v or 0)
    first = {}
    for i, v in enumerate(sorted(values, key=order), 1):
        first.setdefault(v, i)
    for slices in (1, 3, 20):
        got = numbering.ranked_all(df, "x", descending=descending, slices=slices).collect()
        assert len(got) == len(values) and all(r["rank"] == first[r.x] for r in got)
        assert numbering.sliced(df.withColumn("h", F.xxhash64("id", "x")), ["x", "h"], slices).select("_slice").distinct().count() <= slices
    one = spark.createDataFrame([(i, 7) for i in range(40)], "id int, x int")
    assert {r["rank"] for r in numbering.ranked_all(one, "x", slices=8).collect()} == {1}
    assert numbering.ranked_all(one.limit(0), "x").collect() == []


def test_numbers_and_pages(spark, tmp_path):
    df = spark.createDataFrame([(i, (i * 7919) % 5003) for i in range(5003)], "id int, x int")
    got = {r.id: r.number for r in numbering.numbered(df, ["x"], slices=7).collect()}
    assert got == {i: (i * 7919) % 5003 + 1 for i in range(5003)}
    numbering.write_paged(df, ["x"], str(tmp_path / "paged"), group_bytes=4096)
    paged = spark.read.parquet(str(tmp_path / "paged"))
    page = numbering.page(paged, 100, 20)
    assert [r.x for r in page.orderBy("number").collect()] == list(range(1980, 2000))
    groups = [g for f in (tmp_path / "paged").glob("*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(i) for i in range(pq.ParquetFile(f).metadata.num_row_groups)]]
    bounds = [(s.min, s.max, g.num_rows) for g in groups for i in range(g.num_columns) if g.column(i).path_in_schema == "number" for s in [g.column(i).statistics]]
    read = sum(n for low, high, n in bounds if low <= 2000 and high >= 1981)
    print(f"rows of the groups that page 100 reads: {read} of {sum(n for *_, n in bounds)}")
    assert read < 5003 / 3 and "PushedFilters: [IsNotNull(number), GreaterThanOrEqual(number,1981)" in page._jdf.queryExecution().toString()


def test_windows_over_one_endless_series(spark):
    """Lags and sums over blocks of 50 rows are those of one window over all, and no block has many more rows than another."""
    from pyspark.sql import Window

    df = spark.createDataFrame([(i, i // 120, (i * 37) % 101) for i in range(777)], "t int, k int, x int")
    rows = numbering.haloed(df, ["k", "t"], before=30, size=50)
    by = Window.partitionBy("_block", "k").orderBy("_number")
    whole = Window.partitionBy("k").orderBy("t")
    figures = lambda w: [F.lag("x", 7).over(w).alias("l"), F.sum("x").over(w.rowsBetween(-30, -1)).alias("s"), F.count("x").over(w.rowsBetween(-30, -1)).alias("n")]
    got = sorted(rows.select("t", "_copy", *figures(by)).where("not _copy").drop("_copy").collect())
    assert got == sorted(df.select("t", *figures(whole)).collect())
    sizes = sorted(r["count"] for r in rows.groupBy("_block").count().collect())
    assert sizes[-1] <= 80 and sizes[-1] < 2 * sizes[len(sizes) // 2]
    with pytest.raises(ValueError):
        numbering.haloed(df, ["t"], before=60, size=50)


def test_ranks_within_keys_by_slices(spark):
    from pyspark.sql import Window

    from tidemark.operators.numbering import ranked_within

    rows = spark.range(3000).selectExpr("id % 700 as id", "case when id % 10 < 8 then 'a' when id % 10 = 8 then 'b' end as k", "nullif(id % 97, 5) as v")
    order = [F.desc_nulls_last("v"), F.col("id")]
    got = ranked_within(rows, ["k"], order, slices=7)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, rows.withColumn("rank", F.rank().over(Window.partitionBy("k").orderBy(*order))).collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "rank(" in plan and "[_slice#" in plan.split("rank(", 1)[1]
    assert ranked_within(rows.limit(0), ["k"], order).collect() == []
