import math
from collections import Counter

import pytest

from tidemark.llm.lm_score import scored


def brute(rows, order, least=2, backoff=0.4):
    docs = [[x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in (t or "").split()] for _, t in rows]
    c = [Counter(tuple(d[i : i + n]) for d in docs for i in range(len(d) - n + 1)) for n in range(order + 1)]
    total = sum(c[1].values())
    out = []
    for (doc, _), d in zip(rows, docs, strict=True):
        s = 0.0
        for i in range(len(d)):
            most = min(i, order - 1)
            for k in range(most, 0, -1):
                g = tuple(d[i - k : i + 1])
                if c[k + 1][g] >= least:
                    s += math.log(c[k + 1][g] / c[k][g[:-1]]) + (most - k) * math.log(backoff)
                    break
            else:
                s += math.log(c[1][(d[i],)] / total) + most * math.log(backoff)
        out.append((doc, len(d), s))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, corpus, order):
    rows = [(i, t) for i, t in corpus if not t or "z" * 99 not in t]
    docs = spark.createDataFrame([(i, t, 0) for i, t in rows], "doc_id long, text string, lm int")
    got = sorted(((r.doc_id, r[-1].n_words, r[-1].log_score) for r in scored(docs, order=order).collect()), key=str)
    want = brute(rows, order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(math.isclose(g[2], w[2], rel_tol=1e-9, abs_tol=1e-9) for g, w in zip(got, want, strict=True))


def test_empty_table_and_null_means(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, " ")], "doc_id long, text string")
    assert [(r.lm.n_words, r.lm.log_score, r.lm.mean_log_score) for r in scored(docs).collect()] == [(0, 0.0, None)] * 3
    assert scored(docs.limit(0)).count() == 0


def test_blocks_in_groups_give_the_same_scores(spark, corpus, monkeypatch):
    from tidemark.llm import lm_score

    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    want = sorted(map(str, scored(docs, order=3).select("doc_id", "lm").collect()))
    monkeypatch.setattr(lm_score, "FAN", 3)
    assert sorted(map(str, scored(docs, order=3).select("doc_id", "lm").collect())) == want
