"""The whole run against plain Python, stage by stage, on small tables with planted cases."""

import random
import zlib

import corpus_pipeline
import numpy as np
import pytest

from tidemark.llm.quality import judged, train
from tidemark.llm.queries import tokenizer

from . import test_decontaminate, test_minhash_dedup, test_substring_dedup

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(500)]
    pick = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, item = pick(60), pick(25)
    texts = [pick(rng.randint(30, 250)) for _ in range(80)]
    texts += [pick(40) + " " + passage + " " + pick(40) for _ in range(6)]
    texts += [pick(30) + "\n" + item + "\n" + pick(30) for _ in range(4)]
    texts += [texts[i] for i in range(5)] + [texts[i].replace(texts[i].split()[20], "other", 1) for i in range(5, 12)]
    texts += ["", None, "short text", "again " * 60, pick(3000)]
    docs = [(i * 3 + 1, t, "en", f"src{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    bad = [(1000 + i, " ".join(w + "###" for w in pick(50).split()), "en", "bad", 300) for i in range(20)]
    toxic = [(2000 + i, pick(30) + " dreadful horrid " + pick(30), "en", "toxic", 300) for i in range(20)]
    docs += bad + toxic
    rng.shuffle(docs)
    labels = [(d[0], int(d[3] != "bad"), int(d[3] == "toxic")) for d in docs if d[1] and len(d[1]) > 100]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(docs, DOCUMENTS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, pick(30)), (3, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, docs, item, passage


def rows(df):
    return sorted((r.doc_id, r.text) for r in df.select("doc_id", "text").collect())


def test_stages(spark, tables):
    from tokenizers import Tokenizer

    path, docs, item, passage = tables
    kept = spark.read.parquet(f"{path}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality rules", "MinHash near-dedup", "substring dedup", "benchmark decontamination", "packing"]

    out = stages["quality rules"](spark, kept, path)
    assert out.columns == kept.columns
    model = train(kept, spark.read.parquet(f"{path}/labels.parquet"))
    verdict = {r.doc_id for r in judged(kept, model).where("rules.kept").collect()}
    assert rows(out) == sorted((i, t) for i, t, *_ in docs if i in verdict)
    clean = {i for i, t, _, s, _ in docs if s.startswith("src") and t and len(t.split()) >= 10 and not t.startswith("again")}
    assert clean == verdict

    left, kept = rows(out), out
    out = stages["MinHash near-dedup"](spark, kept, path)
    assert out.columns == kept.columns
    stay = {r[0] for r in test_minhash_dedup.brute(left, 5) if r[3]}
    assert rows(out) == [(i, t) for i, t in left if i in stay] and len(stay) <= len(left) - 12

    left, kept = rows(out), out
    out = stages["substring dedup"](spark, kept, path)
    assert out.columns == kept.columns
    assert [(i, t.split()) for i, t in rows(out)] == sorted((r[0], r[3].split()) for r in test_substring_dedup.brute(left))
    assert sum(passage in t for _, t in rows(out)) == 1
    assert all(r.n_chars == len(r.text) for r in out.collect())

    left, kept = rows(out), out
    out = stages["benchmark decontamination"](spark, kept, path)
    assert out.columns == kept.columns
    leaks = {r[0] for r in test_decontaminate.brute(left, [(1, item)]) if r[2]}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    leaks |= {r[0] for r in test_decontaminate.brute(left, items) if r[2]}
    assert leaks and rows(out) == [(i, t) for i, t in left if i not in leaks]

    left = rows(out)
    tok = Tokenizer.from_file(tokenizer())
    ids = {i: np.array([*tok.encode(t, add_special_tokens=False).ids, 0], "<u4") for i, t in left}
    check_packed(stages["packing"](spark, out, path).collect(), ids)
    check_packed(corpus_pipeline.run(spark, path).collect(), ids)
    assert corpus_pipeline.ORACLE_SQL is None


def check_packed(pieces, ids, more=1):
    found, fill = {}, {}
    for p in pieces:
        x = ids[p.doc_id]
        assert p.doc_tokens == len(x) and 1 <= p.length <= 1024
        assert p.ids_crc32 == zlib.crc32(x[p.start : p.start + p.length].tobytes())
        found.setdefault(p.doc_id, []).append((p.start, p.length))
        fill.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert {i: len(x) for i, x in ids.items()} == {i: sum(n for _, n in x) for i, x in found.items()}
    for x in [*found.values(), *fill.values()]:
        at = 0
        for start, n in sorted(x):
            assert start == at
            at += n
        assert x in found.values() or at <= 1024
    total = sum(map(len, ids.values()))
    assert sorted(fill) == list(range(len(fill))) and len(fill) <= -(-total // 1024) + more


def test_empty_tables_and_clashing_names(spark, tables, tmp_path):
    path, docs, _, _ = tables
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("stage", range(4))
def test_no_column_is_lost_whatever_its_name(spark, tables, stage):
    path, docs, _, _ = tables
    names = ["rules", "Removal", "LEAK", "leak1", "kept_id", "row", "id", "sub", "Text", "h", "key"]
    rows = [(i, t, n, *[f"{c}{i}" for c in names]) for i, t, _, _, n in docs if i < 2000]
    some = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, " + ", ".join(f"{c} string" for c in names))
    out = corpus_pipeline.STAGES[stage][1](spark, some, path)
    assert out.columns == some.columns
    got = out.collect()
    assert got and all(list(r[3:]) == [f"{c}{r[0]}" for c in names] for r in got)


def test_packing_with_any_names(spark, tables):
    path, docs, _, _ = tables
    some = spark.createDataFrame([(i, t, 1, 2, 3) for i, t, *_ in docs[:20]], "doc_id long, text string, length int, Offset int, TEXT int")
    assert corpus_pipeline.packing(spark, some, path).agg({"doc_id": "count"}).first()[0] >= 20
