"""The registered queries as they are: against their SQL, or against plain Python where SQL can't say them."""

import base64
import hashlib
import math
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import chat
from tidemark.llm.quality import judged, train
from tidemark.llm.queries import ORACLES, QUERIES, table, tokenizer

from .test_pipeline import check_packed
from .test_quality import COLUMNS, base

SF = "/root/testdata/sf0.001"


def canon(v):
    return "nan" if isinstance(v, float) and math.isnan(v) else repr(v + 0.0) if isinstance(v, float) else repr(v)


def rows(found):
    names = sorted(found.column_names)
    return names, sorted(tuple(map(canon, r)) for r in zip(*[found.column(n).to_pylist() for n in names], strict=True))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    assert rows(QUERIES[name](spark, SF).toArrow()) == rows(con.sql(ORACLES[name]).to_arrow_table())


@pytest.fixture(scope="module")
def ids(spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return {r.doc_id: np.array([*t.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4") for r in table(spark, SF, "documents").collect()}


def test_op6_token_ids(spark, ids):
    at, want = 0, []
    for i in sorted(ids):
        want.append((i, at, len(ids[i]), zlib.crc32(ids[i].tobytes())))
        at += len(ids[i])
    assert sorted(map(tuple, QUERIES["op6_token_ids"](spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_op7_warc_zip(spark):
    pages = {r.page_id: (r.html or "").encode() for r in table(spark, SF, "pages").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    want = [(i, len(x), base64.b32encode(hashlib.sha1(x).digest()).decode(), *(("response", None) if first[x] == i else ("revisit", first[x]))) for i, x in sorted(pages.items())]
    got = QUERIES["op7_warc_zip"](spark, SF).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, got)) == want


def test_op8_chat_roles(spark):
    by_conv, want = {}, []
    for r in table(spark, SF, "conversations").orderBy("conv_id", "turn", "role", F.xxhash64("text")).collect():
        by_conv.setdefault(r.conv_id, []).append(r.asDict())
    for turns in by_conv.values():
        want += chat._render(turns, chat.solve([x["role"] for x in turns], chat.START, None), True, True, 0)
    assert sorted((str(r.asDict()) for r in QUERIES["op8_chat_roles"](spark, SF).collect())) == sorted(map(str, want))


def test_op9_packing(spark, ids):
    check_packed(QUERIES["op9_packing"](spark, SF).collect(), ids, more=2)


def test_op10_quality_rules(spark):
    texts = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    got = QUERIES["op10_quality_rules"](spark, SF).collect()
    assert {r.doc_id for r in got} == set(texts)
    for r in got:
        x = base(texts[r.doc_id])
        assert [r[c] for c in COLUMNS] == x and r.base_failed == (x[0] < 10 or 100 * x[4] > 20 * x[0]) and not (r.base_failed and r.kept)


def test_held_out_labels(spark):
    """Trained on half of the labelled rows of sf0.01, the heads tell the other half's quality and toxicity."""
    sf = "/root/testdata/sf0.01"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    half = F.xxhash64("doc_id", F.lit(3)) % 2 == 0
    model = train(docs, labels.where(half))
    out = judged(docs, model).join(labels.where(~half), "doc_id").select("quality", "toxic", "rules.p_good", "rules.p_toxic").collect()
    good = sum((r.p_good >= 0.5) == (r.quality == 1) for r in out) / len(out)
    toxic = sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in out) / len(out)
    print(f"held out: {len(out)} rows, quality {good:.3f}, toxic {toxic:.3f}")
    assert len(out) > 100 and good >= 0.9 and toxic >= 0.95
