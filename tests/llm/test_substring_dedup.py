import random

from tidemark.llm import substring_dedup as s


def brute(rows, n=20):
    """rows in document order -> (doc_id, n_words, n_removed, text)."""
    seen, out = set(), []
    for doc, text in rows:
        w = (text or "").encode().split()
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            g = tuple(w[i : i + n])
            if g in seen:
                gone[i : i + n] = [True] * n
            seen.add(g)
        out.append((doc, len(w), sum(gone), b" ".join(x for x, y in zip(w, gone, strict=True) if not y).decode()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r[-1].n_words, r[-1].n_removed, r.text) for r in df.collect()), key=str)


def test_against_brute_force(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(s.remove_repeats(docs)) == brute(sorted(corpus))
    assert found(s.remove_repeats(docs, min_words=3)) == brute(sorted(corpus), 3)


def test_hot_passages_split_by_window(spark, corpus, monkeypatch):
    monkeypatch.setattr(s, "HOT", 2)
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(s.remove_repeats(docs)) == brute(sorted(corpus))


def test_spans_match_the_text(spark, corpus):
    texts = dict(corpus)
    for r in s.remove_repeats(spark.createDataFrame(corpus, "doc_id long, text string")).collect():
        w = (texts[r.doc_id] or "").encode().split()
        drop = {j for x in r.removal.spans for j in range(x.s, x.s + x.n)}
        assert b" ".join(x for j, x in enumerate(w) if j not in drop).decode() == r.text


def test_null_and_repeated_ids(spark, corpus):
    long = " ".join(f"w{i}" for i in range(40))
    rows = [(5, long), (None, long + " tail"), (9, "head " + long), (5, long), (None, None)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, removal int")
    out = s.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "id", "removal", "removal1"] and {r.removal for r in out.collect()} == {1}
    assert found(out) == sorted([(5, 40, 0, long), (5, 40, 0, long), (9, 41, 40, "head"), (None, 41, 40, "tail"), (None, 0, 0, "")], key=str)
    assert s.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_automaton_gives_matching_statistics():
    rng = random.Random(1)
    for _ in range(30):
        a, known = s.SuffixAutomaton(), []
        for _ in range(4):
            x = [rng.randint(0, 2) for _ in range(rng.randint(1, 25))]
            subs = {tuple(k[i:j]) for k in known for i in range(len(k)) for j in range(i + 1, len(k) + 1)}
            want = [max([n for n in range(1, e + 1) if tuple(x[e - n : e]) in subs], default=0) for e in range(1, len(x) + 1)]
            assert a.match(x) == want
            a.add(x)
            known.append(x)


def test_layout_stays(spark):
    long = "\n".join(f"w{i}" for i in range(30))
    rows = [(1, f"# head\n\n* a\n\t* b  c\r\n\n{long}\n"), (2, f"  x\ty \n\n{long.replace(chr(10), '  ')}\n\n z  é\n"), (3, f"\n{long}\n"), (4, "\t\n "), (5, None), (6, f"{long}\n\nmid  dle\n{long} ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in s.remove_repeats(docs, layout=True).collect()}
    assert got == {1: rows[0][1], 2: "  x\ty \n\n\n\n z  é\n", 3: "", 4: "\t\n ", 5: "", 6: "\n\nmid  dle\n "}


def test_the_pipeline_keeps_layout(spark, tmp_path):
    import corpus_pipeline

    text = "# head\n\n* a\n\t* b  c\n"
    docs = spark.createDataFrame([(1, text, 0)], "doc_id long, text string, n_chars long")
    assert [tuple(r) for r in corpus_pipeline.substring_dedup(spark, docs, str(tmp_path)).collect()] == [(1, text, len(text))]


def test_letters_in_a_pattern_are_not_a_repeat(spark):
    """Words of a well-known sequence and its complement, which linear hashes can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rest = " ".join(f"w{i}" for i in range(19))
    docs = spark.createDataFrame([(1, f"{a} {rest}"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} {rest}")], "doc_id long, text string")
    assert {r.removal.n_removed for r in s.remove_repeats(docs).collect()} == {0}


def test_columns_that_differ_by_case(spark):
    long = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(1, long, "x", 5, 6), (2, long, "y", 7, 8)], "doc_id long, text string, Text string, REMOVAL int, Id int")
    out = s.remove_repeats(docs)
    assert out.columns == ["doc_id", "text", "Text", "REMOVAL", "Id", "removal1"]
    assert [r[:5] for r in sorted(map(tuple, out.collect()))] == [(1, long, "x", 5, 6), (2, "", "y", 7, 8)]
