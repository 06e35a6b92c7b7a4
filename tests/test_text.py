import random
import re
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as t
from tidemark.operators import documents as d
from tidemark.plans.registry import QUERIES, load
from tidemark.sources.html import page_text

load()
SF = "/root/testdata/sf0.001"


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).cast("string").alias(k) for k, v in values.items()]).select(column).first()[0]


def test_whitespace_tokens_and_counts(spark):
    assert one(spark, t.without_space(F.col("x")), x="a　b \n c") == "abc"
    assert one(spark, t.tokens(F.col("x")), x="Ab ab c 电价 x1 ab") == ["ab", "电价", "x1"]
    assert one(spark, t.tokens(F.col("x")), x=None) == []
    assert one(spark, t.ngrams(F.col("x"), 2), x="a bab") == ["ab", "ba"]
    assert one(spark, t.times(F.col("x"), F.lit("aa")), x="aaaaa") == 2


def test_masks(spark):
    text = "key sk-ABCDEFGH12345678 and Bearer abcdefgh.ijk, postgresql+psycopg://me:pw@host/db, sk-short"
    assert one(spark, t.masked(F.col("x")), x=text) == "key sk-******5678 and Bearer ******, postgresql+psycopg://me:******@host/db, sk-short"
    got = spark.range(1).select(t.masked_fields(F.create_map(F.lit("DB_PASSWORD"), F.lit("x"), F.lit("note"), F.lit("Bearer abcdefghij")))).first()[0]
    assert got == {"DB_PASSWORD": "******", "note": "Bearer ******"}


def test_short_ids(spark):
    assert one(spark, t.short_id(F.col("x"), "kp_"), x="__a b/c__") == "kp_a_b_c"
    assert len(one(spark, t.short_id(F.col("x"), "kp_"), x="x" * 200)) == 19
    assert len(one(spark, t.short_id(F.col("x"), "kp_"), x="???")) == 19


def one_text(clean, text):
    return clean(pa.array([text])).to_pylist()[0]


def greedy_chunks(text, size=1000, overlap=180):
    """The rule of paragraph_chunks, a part at a time."""
    parts = [s.strip() for p in re.split(r"\n\s*\n", text) for s in (re.split(r"(?<=[。！？；;])", p.strip()) if len(p.strip()) > 1.5 * size else [p])]
    chunks, now = [], ""
    for p in filter(None, parts):
        if now and len(now) + 2 + len(p) + 2 > size:
            chunks.append(now)
            end = now[-overlap:]
            at = max((i for i, c in enumerate(end) if c in "。\n；;"), default=0)
            end = (end[at + 1 :] if at > 20 else end).strip()
            now = f"{end}\n\n{p}" if end else p
        else:
            now = f"{now}\n\n{p}" if now else p
    chunks += [now] if now else []
    out = []
    for c in chunks:
        if out and len(c) < 300 and len(out[-1]) + len(c) <= size + overlap:
            out[-1] = f"{out[-1]}\n\n{c}"
        else:
            out.append(c)
    return [c for c in out if len(c) >= 80]


def test_chunks_follow_their_rule():
    rng = random.Random(2)
    for _ in range(200):
        text = "\n\n".join("".join(rng.choice("ab ；。;\n") * rng.randint(1, 60) for _ in range(rng.randint(1, 90))) for _ in range(rng.randint(1, 12)))
        assert d.paragraph_chunks(text) == greedy_chunks(text)


def test_sections_are_cut_at_the_best_places():
    long = "intro words " * 20 + "\n## head\n" + "alpha beta, gamma: delta. " * 120
    chunks = d.section_chunks(long)
    assert chunks[1].startswith("## head") and all(len(c) <= 1500 for c in chunks) and all(c.endswith(":") for c in chunks[1:-1])
    assert all(b[:60] in a[-180:] or b[:60].strip() in a for a, b in zip(chunks[1:], chunks[2:], strict=False))
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(60))
    mixed = d.section_chunks("before it " * 10 + "\n" + table + "\nafter it")
    assert mixed[0].startswith("before") and mixed[-1] == "after it" and all(x.startswith("| a | b |\n|---|---|\n") for x in mixed[1:-1]) and len(mixed) > 3
    assert "".join(d.section_chunks("y" * 4000, overlap=0)) == "y" * 4000


@pytest.mark.parametrize("mark", ["\n# ", "\n###### ", "\n第十二条", "\n第千万项", "\n第3款", "。", "！", "？", "!", "?", "；", ";", "：", ":", "\n", "，", ",", " "])
def test_each_mark_is_a_place_to_cut(mark):
    """A mark in the chunk's last half is where it ends; marks of a worse kind after it don't count."""
    kinds = [["\n#", "\n第"], list("。！？!?；;"), list("：:"), ["\n"], list("，,"), [" "]]
    kind = next(i for i, k in enumerate(kinds) if mark.startswith(tuple(k)))
    worse = [k[0] for k in kinds[kind + 1 :]]
    text = "x" * 80 + mark + "x" * 10 + "".join(w + "x" for w in worse)
    text += "x" * 200
    places = d._cut_places(text)
    ends = [int(min(last[-1], 100)) for first, last in places if len(first) and first[-1] <= 100]
    assert ends[0] == 80 + len(mark)
    if kind:
        assert d.section_chunks(text, hard=100, overlap=0)[0] == text[: 80 + len(mark)].strip()


def test_marks_that_are_no_places():
    text = "x" * 80 + ".、-" + "x" * 300
    assert d.section_chunks(text, hard=100, overlap=0)[0] == text[:100]
    early = "x" * 40 + "。" + "x" * 300
    assert len(d.section_chunks(early, hard=100, overlap=0)[0]) == 100
    spread = "x" * 95 + "。" + " " * 30 + "y" * 200
    assert d.section_chunks(spread, hard=100, overlap=0)[0] == "x" * 95 + "。"


def test_cleaning():
    head = "\n".join(f"Header\nline {'x' * 50} {i}\n- {i} -" for i in range(6))
    got = one_text(d.cleaned_pages, head + "\n\n\n\nend  of\ttext\x01")
    assert "Header" not in got and "- 3 -" not in got and got.endswith("\n\nend of text") and got.count("line") == 6
    assert one_text(d.cleaned_pages, "") == "" and d.cleaned_pages(pa.array([None, "a"])).to_pylist() == [None, "a"]
    assert one_text(d.cleaned_runs, "\n\na\na\nb\nsame\nx\nsame\ny\nsame\r\nz\nsame\n\n\n9\n\n9\n\n9\n\n9") == "a\nb\nx\ny\nz\n\n9\n\n9\n\n9\n\n9"
    assert d.cleaned_runs(pa.array([None, "", "x \n x"])).to_pylist() == [None, "", "x"]
    assert d.cleaned_pages(pa.array([], pa.string())).to_pylist() == d.cleaned_runs(pa.array([], pa.string())).to_pylist() == []


def test_chunks_hold_all_text():
    text = "\n\n".join(f"paragraph {i} " + "word " * (20 * (i % 7)) for i in range(40)) + "\n\n" + "句子。" * 900
    words = Counter(re.findall(r"\w+", text))
    for cut in (d.index_chunks, d.section_chunks):
        assert Counter(re.findall(r"\w+", " ".join(cut(text)))).keys() >= {w for w in words if len(w) < 50}
    assert all(len(c) <= 1.4 * 900 for c in d.index_chunks(text))
    assert "".join("".join(d.index_chunks(text)).split()) == "".join(text.split())
    chunks = d.paragraph_chunks(text)
    assert all(80 <= len(c) <= 1000 + 180 + 500 for c in chunks)
    table = "| a | b |\n|---|---|\n" + "\n".join(f"| {i} | {'x' * 40} |" for i in range(80))
    parts = d.section_chunks(table)
    assert len(parts) > 1 and all(p.startswith("| a | b |\n|---|---|\n") for p in parts)


def test_exact_dedup_and_violations(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "a"), (3, None), (4, None), (5, "b")], "doc_id long, text string")
    assert sorted(r["doc_id"] for r in d.exact_dedup(docs).collect()) == [1, 3, 4, 5]
    chunks = spark.createDataFrame([("a", "x" * 60), ("a", "x" * 60), ("b", " "), ("c", "y" * 3000)], "id string, text string")
    got = Counter((r["id"], r["violation"]) for r in d.chunk_violations(chunks, ["id"]).collect())
    assert got == {("a", "repeated id"): 1, ("b", "empty"): 1, ("b", "too short"): 1, ("c", "too long"): 1}


def test_classes_titles_and_types(spark):
    rules = {"law": ["rule", "act"], "trade": ["price", "market"]}
    assert one(spark, d.classified(F.col("x"), rules), x="A Rule of the market act") == "law"
    assert one(spark, d.classified(F.col("x"), rules), x="rule price") == "law"
    assert one(spark, d.classified(F.col("x"), rules), x=None) == "other"
    assert one(spark, d.title(F.col("x"), F.lit("a.pdf"), ["rules"]), x="\n# the rules of it\nmore") == "the rules of it"
    assert one(spark, d.title(F.col("x"), F.lit("a.pdf"), ["rules"]), x="nothing here") == "a"
    assert one(spark, d.file_type(F.lit("page"), F.col("x").cast("binary")), x="%PDF-1.7") == "pdf"


def test_html():
    title, text = page_text("<html><head><title>A  b</title><style>x{}</style></head><body><nav>menu</nav><p>one &amp; two</p><script>bad()</script><div>three<br>four</div><footer>f</footer></body>")
    assert (title, text) == ("A b", "one & two\nthree\nfour")
    assert page_text("") == ("", "")


def test_queries_without_sql_against_plain_python(spark):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = Counter(r["doc_id"] for r in QUERIES["doc_chunks"](spark, SF).collect())
    assert got == Counter({k: n for k, v in docs.items() if (n := len(greedy_chunks(one_text(d.cleaned_pages, v))))})
    index = QUERIES["index_build"](spark, SF).collect()
    assert len({r["chunk_id"] for r in index}) == len(index) == sum(len(d.index_chunks(v)) for v in docs.values())


def test_index_keeps_every_token_of_a_chunk(spark, tmp_path):
    from tidemark.operators.retrieval import hash_vector
    from tidemark.plans.registry import QUERIES, load

    load()
    words = [f"w{i:03d}" for i in range(150)]
    spark.createDataFrame([(1, " ".join(words)), (2, "..."), (3, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {x.doc_id: x for x in QUERIES["index_build"](spark, str(tmp_path)).collect()}
    assert sorted(got) == [1, 2] and got[1].keywords.split() == words and got[2].keywords == ""
    assert list(got[1].embedding) == hash_vector(words, 256) and list(got[2].embedding) == []


def test_an_index_gets_a_document_s_new_chunks(spark):
    old = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (None, 0, "n")], "doc_id long, chunk_index int, text string")
    new = spark.createDataFrame([(1, 0, "A"), (3, 0, "d")], old.schema)
    assert sorted(map(str, map(tuple, d.replaced_chunks(old, new).collect()))) == sorted(map(str, [(None, 0, "n"), (1, 0, "A"), (2, 0, "c"), (3, 0, "d")]))


@pytest.mark.parametrize("kind", ["cleaned", "chunked"])
def test_texts_are_handled_in_runs_of_bytes(spark, kind):
    """40 MB of texts are one batch of Spark's; copies of all of it at once would grow a worker's memory."""
    docs = spark.range(0, 2000, numPartitions=1).selectExpr("id as doc_id", "repeat('many words ', 1900) as text")

    def clean(texts):
        assert texts.nbytes < 3 << 20, "too many bytes at once"
        return texts

    if kind == "cleaned":
        assert d.cleaned(docs, clean).where("length(text) = 20900").count() == 2000
    else:
        assert [len(b) for b in d._runs([pa.record_batch({"text": ["x" * 10, None, "y" * 30, "", "z"]})], most=20)] == [2, 1, 2]
        assert d.chunked(docs, lambda text: [text[:5]]).count() == 2000


def test_cleaning_and_cutting_share_a_worker_with_small_batches(spark):
    docs = QUERIES["doc_chunks"](spark, SF)
    assert docs._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") not in ("67108864", "67108864b", "64m", "64MB")
    texts = spark.createDataFrame([(1, "a\r\nb" * 30), (2, None), (3, "x" * 90)], "doc_id long, text string")
    once = d.chunked(texts, d.paragraph_chunks, clean=d.cleaned_pages).collect()
    assert once == d.chunked(d.cleaned(texts, d.cleaned_pages), d.paragraph_chunks).collect() and [x.doc_id for x in once] == [3]  # the first text is repeated short lines, which cleaning drops
