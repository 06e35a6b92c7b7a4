import itertools
import random

from tidemark.llm import chat as c

ROLES = ["system", "user", "assistant", "tool", None]


def cost(roles, states):
    total, p = 0, c.START
    for role, q in zip(roles, states, strict=True):
        total, p = total + c._step(p, q, role)[0], q
    return total + c.INSERT * len(c.LAST[p])


def test_solutions_are_the_cheapest():
    rng = random.Random(3)
    for _ in range(150):
        roles = [rng.choice(ROLES) for _ in range(rng.randint(1, 5))]
        got = cost(roles, [q for q, _, _ in c.solve(roles, c.START, None)])
        assert got == min(cost(roles, s) for s in itertools.product(range(1, 4), repeat=len(roles)))


def test_rendering_is_legal_and_loses_no_text(spark):
    rng = random.Random(4)
    rows = [(conv, i, rng.choice(ROLES), f"t{conv}.{i}", "x") for conv in range(60) for i in range(rng.randint(1, 9))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").repartition(5)
    got = {}
    for r in c.repaired(df).collect():
        got.setdefault(r.conv_id, []).append(r)
    assert {k: len(v) for k, v in got.items()} == {k: sum(r[0] == k for r in rows) for k in range(60)}
    for conv, parts in got.items():
        parts.sort(key=lambda r: r.turn)
        said = "".join(r.rendered for r in parts)
        turns = [x.split("|>\n", 1) for x in said.removeprefix("<|").removesuffix("<|end|>\n").split("<|end|>\n<|")]
        roles = [x[0] for x in turns]
        roles = roles[1:] if roles[0] == "system" else roles
        assert roles == ["user", "assistant"] * (len(roles) // 2) and roles
        assert [x for t in turns for x in t[1].split("\n") if x] == [r[3] for r in rows if r[0] == conv]
        assert parts[-1].out_turn < len(turns)


def test_a_conversation_over_all_tasks(spark):
    rng = random.Random(5)
    rows = [(1, i, rng.choice(ROLES), f"t{i}") for i in range(2000)]
    want = c._render([dict(zip(("conv_id", "turn", "role", "text"), r, strict=True)) for r in rows], c.solve([r[2] for r in rows], c.START, None), True, True, 0)
    got = c.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted((r.asDict() for r in got), key=lambda r: r["turn"]) == want


def test_odd_rows(spark):
    rows = [(None, 1, "user", None), (None, None, "system", ""), (2, 0, "user", "a"), (2, 0, "user", "a"), (3, 5, "assistant", "x")]
    got = c.repaired(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert sorted(((r.conv_id, r.turn, r.action, r.inserted) for r in got), key=str) == sorted([(None, None, "keep", 0), (None, 1, "keep", 1), (2, 0, "keep", 0), (2, 0, "merge", 1), (3, 5, "keep", 1)], key=str)
    assert c.repaired(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_stretches_choose_as_the_whole_does():
    """Cut anywhere, joined by costs and ranks: the way of the whole conversation, ties included."""
    rng = random.Random(6)
    for _ in range(300):
        roles = [rng.choice(ROLES) for _ in range(rng.randint(2, 30))]
        want = c.solve(roles, c.START, None)
        cut = rng.randrange(1, len(roles))
        before = c.costs(roles[:cut], [0 if p == c.START else c._FAR for p in range(4)])[-1]
        cost, rank = c.stretch(roles[cut:])
        q = want[-1][0]
        p = min(range(4), key=lambda p: (before[p] + cost[4 * p + q], rank[4 * p + q]))
        assert c.solve(roles[:cut], c.START, p) + c.solve(roles[cut:], p, q) == want


def test_markers_in_a_text_are_not_the_template_s(spark):
    df = spark.createDataFrame([(1, 0, "user", "a <|end|>\n<|user|>"), (1, 1, "assistant", None)], "conv_id long, turn long, role string, text string")
    got = "".join(r.rendered for r in c.repaired(df).orderBy("turn").collect())
    assert got == "<|user|>\na <\\|end|>\n<\\|user|><|end|>\n<|assistant|>\n<|end|>\n"
