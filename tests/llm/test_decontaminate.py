import re

from tidemark.llm.decontaminate import contaminated

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(AZ))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            grams.setdefault(tuple(w[i : i + n]), set()).add(None if item is None else str(item))
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in {len(g) for g in grams}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in grams:
                    hit.update(range(i, i + n))
                    found |= grams[tuple(w[i : i + n])]
        out.append((doc, len(w), len(hit), sorted(found - {None}), sorted(hit)))
    return sorted(out, key=str)


def found(df):
    out = [(r.doc_id, r[-1].n_words, r[-1].n_hit, list(r[-1]["items"]), [j for x in r[-1].spans for j in range(x.s, x.s + x.n)]) for r in df.collect()]
    return sorted(out, key=str)


def test_against_brute_force(spark, corpus):
    rows = corpus[:40]
    items = [(i, " ".join((t or "").split()[3:30])) for i, (_, t) in enumerate(rows) if t and len(t) < 2000]
    items += [(200, "one"), (201, "x, Y"), (202, ""), (203, None), (204, items[0][1]), (10, items[5][1]), (None, rows[3][1]), (300, "never seen these words " * 5), (301, "É é")]
    docs = spark.createDataFrame([(i, t, "l") for i, t in corpus] + [(None, items[0][1], "m")], "doc_id long, text string, leak string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = contaminated(docs, bench)
    assert out.columns == ["doc_id", "text", "leak", "leak1"] and {r.leak for r in out.collect()} == {"l", "m"}
    assert found(out) == brute([*corpus, (None, items[0][1])], items)
    assert found(contaminated(docs, bench, window=4)) == brute([*corpus, (None, items[0][1])], items, 4)


def test_repeats_and_empty_tables(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda"
    docs = spark.createDataFrame([(1, text), (1, "other"), (1, text)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, text.upper())], "item_id long, text string")
    assert sorted(r.leak.n_hit for r in contaminated(docs, bench).collect()) == [0, 11, 11]
    assert [r.leak.n_hit for r in contaminated(docs, bench.limit(0)).collect()] == [0, 0, 0]
    assert contaminated(docs.limit(0), bench).count() == 0
