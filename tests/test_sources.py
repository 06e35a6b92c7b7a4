import datetime as dt
import http.server
import json
import threading
import urllib.parse

import pytest
from pyspark.sql import functions as F

from tidemark.operators import baselines, keys
from tidemark.sources import readers, rest, sinks
from tidemark.streaming.hourly import first_of_each, hourly_stream


def test_csv_with_byte_order_mark(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿id,name\n1,é\n".encode())
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).select("id", "name").collect()] == [("1", "é")]


def test_jsonl_rejects(spark, tmp_path):
    lines = ['{"chunk_id": "a", "text": "t", "n": 1}', "not json", '{"chunk_id": "", "text": "t"}', '{"chunk_id": "b", "text": "  "}', "", "[1]", '{"text": "t"}']
    (tmp_path / "x.jsonl").write_text("\n".join(lines))
    good, bad = readers.read_jsonl(spark, str(tmp_path / "x.jsonl"), "chunk_id string, text string, n int", ["chunk_id", "text"])
    assert [tuple(r) for r in good.collect()] == [("a", "t", 1)]
    assert sorted((r["reason"], r["detail"]) for r in bad.collect()) == [("empty text", ""), ("missing fields", "chunk_id"), ("missing fields", "chunk_id"), ("not json", ""), ("not json", "")]


def test_texts_of_any_encoding_in_nested_folders(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.md").write_bytes("电价".encode("gb18030"))
    (tmp_path / "two.md").write_bytes("﻿utf".encode())
    (tmp_path / ".hidden.md").write_text("no")
    (tmp_path / "z.bin").write_bytes(b"\x00")
    assert {r["title"]: r["text"] for r in readers.read_texts(spark, str(tmp_path)).collect()} == {"one": "电价", "two": "utf"}


def test_column_arrays(spark):
    df = spark.createDataFrame([('{"hourly": {"time": ["2026-01-01T00:00", "bad"], "t2m": [1.5, null], "wind": [3]}}',), ("{",)], "j string")
    got = readers.read_column_arrays(df, "j", {"temperature": "t2m", "wind_speed": "wind"}, "time").collect()
    assert [tuple(r) for r in got] == [(dt.datetime(2026, 1, 1), 1.5, 3.0), (None, None, None)]


def test_guarded_tables_and_bound_sql(spark):
    spark.range(30).write.mode("overwrite").saveAsTable("guarded")
    assert [r["id"] for r in readers.read_table(spark, "guarded", "id", 2).collect()] == [29, 28]
    with pytest.raises(ValueError):
        readers.read_table(spark, "guarded; drop table guarded")
    with pytest.raises(ValueError):
        readers.read_table(spark, "guarded", "nope")
    assert readers.read_sql(spark, "select :x + 1 as y", x=2).first()["y"] == 3


def test_missing_spreadsheet_is_empty(spark, tmp_path):
    assert readers.read_excel(spark, str(tmp_path / "none.xlsx"), "a int").count() == 0


def test_fallback_and_raw_rows(spark):
    empty, full = spark.range(0), spark.range(2)
    assert readers.first_not_empty(empty, full).count() == 2
    df = spark.createDataFrame([("2026-01-01 00:00:00", "1,234.5", "x")], "time string, price string, node string")
    row = readers.raw_rows(df, "f.csv", {"datetime": ["datetime", "time"], "value": ["da_price", "price"], "load": ["load"]}).first()
    assert (row["datetime"], row["value"], row["load"], row["source_file"]) == (dt.datetime(2026, 1, 1), 1234.5, None, "f.csv")
    assert json.loads(row["raw_json"])["node"] == "x"


def test_typed_by_name(spark):
    df = spark.createDataFrame([('{"a": 1}', "2026-01-01", "bad")], "meta_json string, created_at string, metric_date string")
    got = readers.typed_by_name(df).select(F.expr("variant_get(meta_json, '$.a', 'int')"), "created_at", "metric_date").first()
    assert tuple(got) == (1, dt.datetime(2026, 1, 1), None)


def test_months():
    assert list(rest.months(dt.date(2026, 1, 30), dt.date(2026, 3, 1))) == [(dt.date(2026, 1, 30), dt.date(2026, 1, 31)), (dt.date(2026, 2, 1), dt.date(2026, 2, 28)), (dt.date(2026, 3, 1), dt.date(2026, 3, 1))]
    assert rest.add_months(dt.date(2026, 1, 31), 1) == dt.date(2026, 2, 28) and rest.add_months(dt.date(2026, 1, 31), -2) == dt.date(2025, 11, 30)


def test_paged_feed(spark):
    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            q = dict(urllib.parse.parse_qsl(urllib.parse.urlparse(self.path).query))
            page = int(q.get("page", 0))
            body = {"items": [{"datetime": q["from"], "value": page}, {"datetime": "same", "value": None}], "links": []}
            if page == 0:
                body["links"] = [{"rel": "next", "href": f"http://127.0.0.1:{port}/f?page=1&from={q['from']}"}]
            out = json.dumps(body).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(out)

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    port = server.server_port
    threading.Thread(target=server.serve_forever, daemon=True).start()
    got = rest.read_feed(spark, f"http://127.0.0.1:{port}/f", "datetime string, value string", "2026-01-05", "2026-02-02").collect()
    server.shutdown()
    assert sorted(map(tuple, got), key=str) == sorted([("2026-01-05", "0"), ("2026-01-05", "1"), ("2026-02-01", "0"), ("2026-02-01", "1"), ("same", None)], key=str)


def test_partition_rewrites_are_idempotent(spark, tmp_path):
    path = str(tmp_path / "runs")
    a = spark.createDataFrame([("r1", 1), ("r2", 2)], "run_id string, v int")
    for df in (a, spark.createDataFrame([("r2", 9)], a.schema), spark.createDataFrame([("r2", 9)], a.schema)):
        sinks.write_partition(df, path, "run_id")
    assert sorted((r["run_id"], r["v"]) for r in spark.read.parquet(path).collect()) == [("r1", 1), ("r2", 9)]


def test_growing_schema_flat_files_and_copies(spark, tmp_path):
    path = str(tmp_path / "grow")
    sinks.append_growing(spark.createDataFrame([(1,)], "a int"), path)
    sinks.append_growing(spark.createDataFrame([(2, "x")], "a int, b string"), path)
    df = sinks.read_growing(spark, path)
    assert sorted(map(tuple, df.collect())) == [(1, None), (2, "x")]
    assert tuple(sinks.copy_check(df, df).first()) == (2, 2, True) and not sinks.copy_check(df, df.limit(1)).first()["same"]
    assert not sinks.copy_check(df, df.withColumn("b", F.lit("y"))).first()["same"]
    nested = df.select("a", F.array("a").alias("list"))
    sinks.write_files(nested, str(tmp_path / "csv"), "csv")
    assert sorted(r["list"] for r in readers.read_csv(spark, str(tmp_path / "csv")).collect()) == ["[1]", "[2]"]
    assert sinks.matching(df, ["b", "zzz"]).columns == ["b"]


def test_keys_and_runs(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (2, None, "b")], "x int, y int, z string")
    assert sinks.key_of(df, [["z"], ["x", "y"], ["nope"]]) is None
    assert sinks.key_of(df.dropna(), [["z"], ["x", "y"]]) == ["x", "y"]
    keyed, key = sinks.with_key(df.union(df), [["x"]])
    assert key == ["row_id"] and keyed.select("row_id").distinct().count() == 6
    registry = sinks.import_run({"one": df}, "r1", "full", "2026-01-01 00:00:00", "imported_")
    assert [tuple(r) for r in registry.collect()] == [("r1", "imported_one", 3)]
    assert sinks.create_views({"v": (["imported_one"], "select * from imported_one"), "w": (["missing"], "select 1")}, spark) == ["v"]
    assert not keys.is_key(df, ["x"])


def test_streams(spark, tmp_path):
    rows = [(1, "a", dt.datetime(2026, 1, 1, 0, 10), 1.0), (2, "a", dt.datetime(2026, 1, 1, 0, 50), 3.0), (2, "a", dt.datetime(2026, 1, 1, 0, 50), 9.0), (3, "a", dt.datetime(2026, 2, 1), 5.0)]
    df = spark.createDataFrame(rows, "id int, kind string, ts timestamp_ntz, value double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("hours", hourly_stream(stream, "kind", "ts", "value")), ("firsts", first_of_each(stream, ["id"], "ts"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert [(r["hour_ts"], r["load"]) for r in spark.table("hours").collect()] == [(dt.datetime(2026, 1, 1), 3)]
    assert sorted(r["id"] for r in spark.table("firsts").collect()) == [1, 2, 3]


def test_baseline_artifacts(spark, tmp_path):
    df = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + 1) for i in range(40)], "x double, y double, price double")
    assert baselines.feature_list(df.withColumn("da_price", F.lit(1.0)).withColumn("da_price_lag_1", F.lit(1.0))) == ["x", "y", "price", "da_price_lag_1"]
    assert {r["column_name"]: r["is_banned"] for r in baselines.leak_report(df.withColumn("actual_load", F.lit(1.0))).collect()}["actual_load"] == 1
    for kind in ("linear", "boosted", "forest"):
        model = baselines.fit(df, ["x", "y"], "price", kind)
        assert baselines.importances(model, ["x", "y"], spark).first()["feature"] == "x"
    model = baselines.fit(df, ["x", "y"], "price")
    baselines.save(model, str(tmp_path / "m"), spark, "v1", ["x", "y"], {"rmse": 0.0})
    again, manifest = baselines.load(str(tmp_path / "m"), spark)
    assert manifest["version"] == "v1" and abs(baselines.predicted(again, df.limit(1), ["x", "y"]).first()["predicted"] - 1) < 1e-6


def test_models_are_tried_in_turn(spark, monkeypatch):
    df = spark.createDataFrame([(float(i), 2.0 * i) for i in range(30)], "x double, price double")
    assert baselines.fit_chain(df, ["x"], "price")[1:] == ("boosted", {})
    real = baselines.fit

    def fit(train, features, label, kind):
        if kind == "boosted":
            raise ValueError("no such library\nmore")
        return real(train, features, label, kind)

    monkeypatch.setattr(baselines, "fit", fit)
    assert baselines.fit_chain(df, ["x"], "price")[1:] == ("forest", {"boosted": "no such library"})
    with pytest.raises(ValueError, match="no model"):
        baselines.fit_chain(df.limit(0), ["x"], "price", ("boosted", "forest"))
