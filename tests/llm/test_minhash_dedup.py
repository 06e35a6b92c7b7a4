import random

import pytest

from tidemark.llm import minhash_dedup as m
from tidemark.llm.components import connected_components


def shingles(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    part = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b) and part[i] != part[j]:
                old, new = part[i], part[j]
                part = [new if x == old else x for x in part]
    out = []
    for i, (doc, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if part[j] == part[i] and rows[j][0] is not None]
        least = (min(ids) if ids else None) if sets[i] else doc
        out.append((doc, len(sets[i]), least, least is None or doc == least))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_against_brute_force(spark, corpus, k):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    assert found(m.near_duplicates(docs, shingle=k)) == brute(corpus, k)


def test_null_ids_repeats_and_clashing_columns(spark, corpus):
    rows = corpus[:20] + [(None, corpus[0][1]), (None, "alone is the text"), (None, None), corpus[0], (corpus[1][0], "same id other text")]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id long, text string, n_shingles int, key string")
    assert found(m.near_duplicates(docs, shingle=2)) == brute(rows, 2)


def test_no_documents(spark):
    assert m.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_beyond_a_task_are_chunked(spark, monkeypatch):
    """A chain of near copies, each near its neighbours alone, is still one component when chunks hold four."""
    monkeypatch.setattr(m, "SKETCH_LIMIT", 4)
    monkeypatch.setattr(m, "SET_LIMIT", 4)
    base = [f"w{i}" for i in range(120)]
    rows = [(i, " ".join(base[:i] + [f"v{j}" for j in range(i)] + base[i * 2 :])) for i in range(16)]
    rows += [(100 + i, " ".join(f"u{i}x{j}" for j in range(40))) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(m.near_duplicates(docs, shingle=2)) == brute(rows, 2)


def test_components_of_chains_stars_and_noise(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 120)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 120)}, 200: 200, 201: 200}


def test_letters_in_a_pattern_are_not_a_link(spark):
    """Words of a well-known sequence and its complement, which linear hashes can't tell apart."""
    a = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    rows = [(1, f"{a} z"), (2, f"{a.translate(str.maketrans('ab', 'ba'))} z")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, TEXT int, Doc_ID int")
    assert found(m.near_duplicates(docs, shingle=2)) == brute(rows, 2)


def test_hot_keys_are_looked_up(spark, monkeypatch):
    from tidemark.llm import spread

    left = spark.createDataFrame([(i, 1 if i < 60 else i) for i in range(100)] + [(200, 7777)] * 30, "i long, k long")
    right = spark.createDataFrame([(k, f"v{k}") for k in range(90)], "k long, v string")
    want = sorted((r.i, r.k, f"v{r.k}" if r.k < 90 else None) for r in left.collect())
    for parts in (1, 3, 1000):
        monkeypatch.setattr(spread, "PARTS", parts)
        got = spread.looked_up(left, right, ["k"]).collect()
        assert sorted((r.i, r.k, r.found and r.found.v) for r in got) == want


def test_recall_of_links_at_the_threshold(spark):
    """Pairs at a similarity of just 0.8 and a little over, each a component of its own."""
    rng, rows = random.Random(8), []
    for i in range(400):
        words = [f"w{rng.randrange(10**9)}" for _ in range(91)]
        changed = words.copy()
        for j in range(10 if i % 2 else 8):  # a change in the middle of 5-word shingles costs one at the end
            changed[-1 - j] = f"x{rng.randrange(10**9)}"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(changed))]
    got = m.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=2)
    ratio = [len(shingles(a[1], 2) & shingles(b[1], 2)) / len(shingles(a[1], 2) | shingles(b[1], 2)) for a, b in zip(rows[::2], rows[1::2], strict=True)]
    assert min(ratio) >= 0.8 and max(ratio) < 0.84
    assert got.where("kept").count() == 400
