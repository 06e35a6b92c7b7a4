import random
import re
from collections import Counter

import pytest

from tidemark.llm import collocations as c

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, longest=3, least=10, covered=50, most=2000):
    counts, out = {}, []
    for lang, text in rows:
        f = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            words = re.findall("[^\x20\x09]+", piece)
            f.update(tuple(words[i : i + k]) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        n, found = sum(a for p, a in f.items() if len(p) == 1), []
        for p, a in often.items():
            score, _, l, r = min((1000000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            if not any(100 * m >= covered * a and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1)) for q, m in often.items() if len(q) > len(p)):
                found.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(found)[:most], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n, -score))
    return sorted(out)


def texts():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeéß漢") for _ in range(rng.randint(1, 4))) for _ in range(25)] + ["\x00", "A", "x-y", " "]
    line = [rng.choice(words) for _ in range(12)]
    rows = []
    for i in range(150):
        some = [rng.choice(words) + rng.choice(["", "", "", ".", ",", "!?", "\n", "\x0b"]) for _ in range(rng.randint(0, 60))]
        rows.append((rng.choice(["en", "en", "de", None, "und"]), rng.choice([" ", "\t", "  "]).join(some + line * (i % 3 == 0))))
    return rows + [("en", None), ("fr", ""), ("en", rows[0][1]), ("en", rows[0][1]), ("xx", "lone"), ("de", "a " * 5000), ("de", "z" * 100_000), (None, "…".join(words))]


def got(spark, rows, **k):
    docs = spark.createDataFrame([(i, lang, text, 1) for i, (lang, text) in enumerate(rows)], "doc_id long, lang string, text string, GRP int")
    return sorted(map(tuple, c.collocations(docs, **k).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


@pytest.mark.parametrize("k", [{}, {"longest": 4, "least": 3, "covered": 80, "most": 40}, {"longest": 2, "least": 300}])
def test_same_as_brute_force(spark, k):
    assert got(spark, texts(), **k) == brute(texts(), **k)


def test_full_buckets_and_small_runs_change_nothing(spark, monkeypatch):
    """Eight buckets let everything through; then exact counts decide alone."""
    monkeypatch.setattr(c, "RUN_BYTES", 2000)
    assert got(spark, texts(), most_bits=16) == brute(texts())
    assert got(spark, texts()[:40], most_bits=3, least=4) == brute(texts()[:40], least=4)


def test_no_documents(spark):
    assert got(spark, []) == []
    assert got(spark, [("en", ""), (None, None)]) == []


def test_counts_beyond_a_byte(spark):
    """Buckets are added up over tasks, as lists and as counts."""
    rows = [("en", "p q r. s")] * 700
    assert got(spark, rows, least=300) == brute(rows, least=300)
    assert got(spark, rows, least=701) == []


def test_products_past_64_bits(spark):
    frame = spark.createDataFrame([(3_000_000_000, 4_000_000_001, 4_000_000_007)], "n long, l long, r long")
    wide = "cast({} as decimal(19, 0))".format
    a, l, r = frame.first()
    assert frame.selectExpr(f"1000000 * {wide('n')} * {wide('n')} div ({wide('l')} * {wide('r')})").first()[0] == 1000000 * a * a // (l * r)
