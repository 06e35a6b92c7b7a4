import json

import pytest
from pyspark.sql import functions as F

from tidemark.functions import secrets as s

CASES = [
    ("api_key", "sk-12345678abcd", "******"), ("Authorization", "Bearer abc.def", "Bearer ******"), ("authorization", "lonely", "******"), ("authorization", "", ""),
    ("database_url", "postgresql://me:pa:ss@host/db?x=1", "postgresql://me:******@host/db?x=1"), ("database_url", "mysql://:pw@h", "mysql://******@h"), ("db_password", "postgres://u@h/d", "postgres://u:******@h/d"),
    ("database_url", "no url", "no url"), ("note", "key sk-12345678abcd and bearer abcdefghij, postgresql://u:p@h", "key sk-******abcd and bearer ******, postgresql://u:******@h"), ("note", "", ""), ("my_TOKEN_x", "", "******"),
]


def test_masks_of_structs_lists_and_maps(spark):
    for name, text, want in CASES:
        rows = spark.range(1).select(F.struct(F.lit(text).alias(name), F.lit(3).alias("n")).alias("a"), F.create_map(F.lit(name), F.array(F.lit(text), F.lit(None))).alias("m"), F.array(F.struct(F.struct(F.lit(text).alias(name)).alias("deep"))).alias("l"))
        out = s.masked_rows(rows).first()
        assert out.a[name] == want and out.a.n == 3 and out.m[name] == [want, None] and out.l[0].deep[name] == want
        assert s.masked_json({"x": [{name: text}], "n": 1}) == {"x": [{name: want}], "n": 1}


def test_all_below_a_secret_name_is_secret(spark):
    rows = spark.sql("select named_struct('a', 'x', 'b', 5, 'c', array(named_struct('d', 'y'))) secret_box, map('k', named_struct('password', 7, 'v', 7)) plain, cast(null as struct<token: string>) none, 1 `Token`, 2 `token2`, 'x' other")
    assert s.masked_rows(rows).dtypes == rows.dtypes
    out = s.masked_rows(rows).first()
    assert out.secret_box.asDict(True) == {"a": "******", "b": None, "c": [{"d": "******"}]}
    assert out.plain["k"].asDict() == {"password": None, "v": 7} and out.none is None and out.Token is None and out.token2 is None and out.other == "x"


@pytest.mark.parametrize("value", [{"a": [1, 2.50, {"pwd": "x", "n": None}], "secret": {"deep": [1, True, None, "t"]}}, ["sk-12345678abcd", 12345678901234567890], "Bearer abcdefghij", 3, None, {}, []])
def test_variants(spark, value):
    rows = spark.createDataFrame([(1, json.dumps(value)), (2, None)], "id int, t string").select("id", F.parse_json("t").alias("v"), F.lit("z").alias("t"))
    got = {r.id: r.j for r in s.masked_rows(rows).select("id", F.to_json("v").alias("j")).collect()}
    assert got[2] is None and json.loads(got[1]) == s.masked_json(value)
    if isinstance(value, dict) and value:
        assert json.loads(got[1]) == {"a": [1, 2.5, {"pwd": "******", "n": None}], "secret": {"deep": ["******", "******", None, "******"]}}


def test_no_rows(spark):
    assert s.masked_rows(spark.sql("select parse_json('1') v, array('x') l").limit(0)).collect() == []
