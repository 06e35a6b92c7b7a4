import random
import re

from tidemark.llm.quality import judged, train

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def base(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = t.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines))
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    again = {j for i, g in enumerate(grams) if grams.count(g) > 1 for j in range(i, i + 5)}
    return [len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)]


def labelled(spark, seed, n):
    rng = random.Random(seed)
    words = [rng.choice(["da", "lo", "mi", "ter", "von"]) * rng.randint(1, 2) + rng.choice("xyzw") for _ in range(80)]
    docs, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(12, 200))]
        kind = i % 4
        if kind == 1:
            w = [x + "***" for x in w]
        if kind == 2:
            w[rng.randrange(len(w))] = rng.choice(["Dreadful", "horrid", "horrid,"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(kind != 1), int(kind == 2)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_base_columns_against_plain_python(spark, corpus):
    rows = [*corpus, (1, "a\nb\na\n\n\na \na"), (2, "x | y <b> 100% #1 &"), (3, "a b c d e f a b c d e"), (4, "é　ü\nß"), (5, "a a a a a a a a a a")]
    docs = spark.createDataFrame([(i, t, "r") for i, t in rows], "doc_id long, text string, Rules string")
    docs_, labels = labelled(spark, 1, 40)
    out = judged(docs, train(docs_, labels))
    assert out.columns == ["doc_id", "text", "Rules", "rules1"]
    for r in out.collect():
        x = base(r.text)
        assert r.Rules == "r" and [r.rules1[c] for c in COLUMNS] == x
        assert r.rules1.base_failed == (x[0] < 10 or 100 * x[4] > 20 * x[0])
        assert not (r.rules1.base_failed and r.rules1.kept)
    assert out.count() == len(rows)


def test_held_out_accuracy(spark):
    docs, labels = labelled(spark, 2, 600)
    model = train(docs, labels)
    fresh, truth = labelled(spark, 2, 900)
    rows = judged(fresh, model).join(truth, "doc_id").where("doc_id >= 600").collect()
    right = sum(((r.rules.p_good >= 0.5) == (r.quality == 1)) + ((r.rules.p_toxic >= 0.5) == (r.toxic == 1)) for r in rows)
    assert right >= 0.97 * 2 * len(rows)


def test_without_labels_or_documents(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    none = spark.createDataFrame([(None, 1, 0), (1, None, 1), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    assert judged(docs, train(docs, none)).count() == len(corpus)
    assert judged(docs.limit(0), train(docs, none), text=False).columns == ["doc_id", "rules"]
