import time

import pyarrow.parquet as pq

from tidemark.sources import lookup


def scanned(df):
    """Files and rows that the plan's scan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    plan = plan.executedPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
    leaf = plan.collectLeaves().head()
    metrics = leaf.metrics()
    return metrics.apply("numFiles").value(), metrics.apply("numOutputRows").value()


def test_lookups_skip_row_groups_and_files(spark, tmp_path):
    rows = spark.range(40_000).selectExpr("id", "id * 7919 % 40009 as other", "if(id % 10000 = 3, concat('a NeedLe in ', id), concat('hay ', id)) as text", "cast(null as string) as note")
    path = str(tmp_path / "t")
    lookup.write_lookup(rows, path, ["id"], blooms=["other"], texts=["text", "note"], files=8, group_bytes=16_384)
    by_key = lookup.found(spark, path, "id", [12_345, 99_999_999])
    assert [r.id for r in by_key.collect()] == [12_345]
    files, read = scanned(by_key)
    print(f"rows of the row groups read for one key: {read} of 40000")
    assert read < 8_000
    by_other = lookup.found(spark, path, "other", [7919])
    assert [r.id for r in by_other.collect()] == [1]
    groups = sum(pq.ParquetFile(f).metadata.num_row_groups for f in (tmp_path / "t" / "rows").glob("*.parquet"))
    _, read = scanned(by_other)
    print(f"rows of the row groups read for one filtered value: {read} of 40000 in {groups} groups")
    assert read < 40_000 / 2
    needles = lookup.containing(spark, path, "needle", ["text", "note"])
    assert sorted(r.id for r in needles.collect()) == [3, 10_003, 20_003, 30_003]
    assert len(lookup.files_with(spark, path, "needle")) <= 4 and scanned(needles)[0] <= 4
    assert lookup.containing(spark, path, "nowhere", ["text"]).collect() == []
    assert lookup.containing(spark, path, "ed", ["text", "note"]).count() == 4 and lookup.files_with(spark, path, "ed") is None


def test_no_rows(spark, tmp_path):
    lookup.write_lookup(spark.range(0).selectExpr("id", "cast(id as string) t"), str(tmp_path / "t"), ["id"], texts=["t"])
    assert lookup.containing(spark, str(tmp_path / "t"), "word", ["t"]).collect() == [] == lookup.found(spark, str(tmp_path / "t"), "id", [1]).collect()


def test_pieces_of_a_long_text_take_linear_time(spark, tmp_path):
    """A substring by its place reads the text from its start, so the pieces of 400,000 characters once took their square."""
    rows = spark.createDataFrame([(1, "äb😀 " + "xyz€" * 100_000 + "end"), (2, "di"), (3, None), (4, "nd hay")], "id long, text string")
    path, began = str(tmp_path / "t"), time.perf_counter()
    lookup.write_lookup(rows, path, ["id"], texts=["text"], files=2)
    assert time.perf_counter() - began < 20
    pieces = {r.piece for r in spark.read.parquet(f"{path}/pieces").collect()}
    assert pieces == {"äb😀", "b😀 ", "😀 x", " xy", "xyz", "yz€", "z€x", "€xy", "z€e", "€en", "end", "nd ", "d h", " ha", "hay"}
    assert [r.id for r in lookup.containing(spark, path, "z€eN", ["text"]).collect()] == [1]
    assert lookup.containing(spark, path, "endi", ["text"]).collect() == []
