import hashlib
import random
import zlib

import pytest

from tidemark.llm import prefix_trie as p


def rem(c, m):
    return c - m * int(c / m)


def ordered(rows):
    by = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [x[2:] for x in sorted(t)] for c, t in by.items()}


def rebuilt(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = convs.get(c - rem(c, 5), [])[:h] + own[h:]
    return out


def brute(convs):
    nodes, out = {}, {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for node in sorted(nodes, key=len, reverse=True):
        kids = [k for k in nodes if len(k) == len(node) + 1 and k[: len(node)] == node]
        saved = (len(nodes[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(out[k][6] for k in kids)
        ends = ",".join(str(c) for c in sorted(c for c in nodes[node] if len(convs[c]) == len(node)))
        leaves = sum(out[k][5] for k in kids) or 1
        out[node] = (min(nodes[node]), len(node), min(nodes[node[:-1]]) if node else None, len(nodes[node]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    return sorted(out.values(), key=str)


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, CONV int")


def taken(nodes):
    return sorted(map(tuple, nodes.select(*COLUMNS).collect()), key=str)


def conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(-7, 60), 1000, 1001, 10**12]:
        for t in range(rng.choice([0, 1, 2, 3, 5, 9, 14])):
            rows.append((c, rng.choice([t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["héllo", "b", "", None, "c" * 40])))
    rows += [(2000 + i, t, "user", f"same {t}") for i in range(8) for t in range(12)]
    rows += [(3000 + 5 * i, t, "user", f"comb {t}") for i in range(6) for t in range(i + 3)]
    rows += [(None, 1, "user", "no conversation"), (4, 0, "user", "twice"), (4, 0, "user", "twice")]
    rng.shuffle(rows)
    return rows


def test_spliced_conversations(spark):
    rows = conversations()
    nodes = p.prefix_trie(p.spliced(p.numbered(frame(spark, rows))))
    assert taken(nodes) == brute(rebuilt(ordered(rows)))


@pytest.mark.parametrize("block", [10, 1])
def test_long_chains_and_few_rounds(spark, monkeypatch, block):
    """Equal conversations and beginnings of each other make one chain, whatever their length."""
    monkeypatch.setattr(p, "BLOCK", block)
    rows = [(c, t, "user", f"turn {t}") for c, n in ((7, 40), (8, 40), (9, 25), (3, 1)) for t in range(n)]
    rows += [(20, t, "user", f"turn {t}" if t < 30 else f"other {t}") for t in range(45)] + [(21, 0, "bot", "")]
    assert taken(p.prefix_trie(p.whole(p.numbered(frame(spark, rows))))) == brute(ordered(rows))


def test_turns_are_numbered_across_ranges(spark):
    """One conversation lies in every range."""
    rows = [(5, t, "user", str(t)) for t in range(400)] + [(1, 0, "a", "b"), (9, None, None, None), (9, 3, "a", "")]
    got = p.numbered(frame(spark, rows)).select("conv", "n", "size").collect()
    assert sorted(map(tuple, got)) == sorted([(5, t + 1, len(str(t))) for t in range(400)] + [(1, 1, 1), (9, 1, 0), (9, 2, 0)])


def test_none_and_turnless(spark):
    assert p.prefix_trie(p.spliced(p.numbered(frame(spark, [])))).collect() == []
    c = next(c for c in range(1, 99) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 2)
    rows = [(c, 0, "user", "x"), (c, 1, "user", "y")]
    assert taken(p.prefix_trie(p.spliced(p.numbered(frame(spark, rows))))) == brute({c: []})


def test_many_ends_of_one_node(spark, monkeypatch):
    monkeypatch.setattr(p, "MOST_CHARS", 20)
    rows = [(c, 0, "user", "x") for c in range(300)] + [(c, 1, "user", "y") for c in range(100)]
    assert taken(p.prefix_trie(p.whole(p.numbered(frame(spark, rows))))) == brute(ordered(rows))
