"""Repair of conversations' roles at minimum cost, and their rendering.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending
with the assistant. Each turn may open a turn of its own role, be relabelled, or be merged into the turn
before, and empty turns may be inserted; dynamic programming over the automaton's states finds the
cheapest way. Rows are sorted by conversation and turn over all tasks. A conversation that lies in one
task is repaired there; of one that crosses tasks, each stretch is reduced to its matrix of costs from
state to state (costs add up along matrices), the stretches are joined by those, and each is then
repaired from its known first to its known last state. So no conversation is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .rows import picked
from .scratch import n_tasks, small_batches, stored
from .words import pieces

#: Costs of merging a turn into the one before, inserting an empty turn, giving a turn another role.
MERGE, INSERT, RELABEL = 2, 3, 6
ROLES = ("system", "user", "assistant")
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
_FAR = 1 << 40


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each pair of states, the turns inserted between them on the shortest way on which the last turn is real."""
    out = {}
    for start in range(4):
        reach = [(x, ()) for x in _NEXT[start]]
        for state, between in reach:
            if (start, state) not in out:
                out[start, state] = between
                reach += [(x, (*between, state)) for x in _NEXT[state]]
    return out


PATHS = _paths()


def _step(p: int, q: int, role: str | None) -> tuple[int, str, tuple[int, ...]]:
    """Cheapest way for a turn of this role to take state p to q: (cost, action, inserted before it)."""
    change = RELABEL * (q == START or ROLES[q - 1] != role)
    ways = []
    if (p, q) in PATHS:
        ways.append((INSERT * len(PATHS[p, q]) + change, "relabel" if change else "keep", PATHS[p, q]))
    if p == q != START:
        ways.append((MERGE + change, "merge", ()))
    return min(ways, key=lambda x: x[0], default=(_FAR, "", ()))


_STEPS = {role: [[_step(p, q, role) for q in range(4)] for p in range(4)] for role in (*ROLES, None)}
#: Turns inserted after the last one so that the assistant has the last word.
LAST = {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}


def _steps(role: str | None) -> list:
    return _STEPS[role if role in ROLES else None]


def costs(roles: list, before: list[int]) -> list[list[int]]:
    """After each turn, the least cost of each state; before: of each state at first."""
    out = [before]
    for role in roles:
        s, have = _steps(role), out[-1]
        out.append([min(have[p] + s[p][q][0] for p in range(4)) for q in range(4)])
    return out


def solve(roles: list, first: int, last: int | None) -> list[tuple[int, str, tuple[int, ...]]]:
    """(state, action, inserted before) of each turn on a cheapest way from state first to last, or to any legal end.

    Of equally cheap ways the one whose last state, then the one before and so on, has the lowest number.
    """
    have = costs(roles, [0 if p == first else _FAR for p in range(4)])
    q = last if last is not None else min(range(4), key=lambda p: (have[-1][p] + INSERT * len(LAST[p]), p))
    return list(_back(roles, have, q))[::-1]


def _back(roles: list, have: list[list[int]], q: int) -> Iterator[tuple[int, str, tuple[int, ...]]]:
    """The steps that lead to state q, the last one first."""
    for i in range(len(roles) - 1, -1, -1):
        s = _steps(roles[i])
        p = min(range(4), key=lambda p: (have[i][p] + s[p][q][0], p))
        yield (q, *s[p][q][1:])
        q = p


def stretch(roles: list) -> tuple[list[int], list[int]]:
    """Of a stretch of turns, for each first and last state: the cost, and how its way ranks among those of the other first states.

    The rank is that of equally cheap ways, by their states from the last one back.
    """
    have = [costs(roles, [0 if q == p else _FAR for q in range(4)]) for p in range(4)]
    ways = [[[x[0] for x in _back(roles, have[p], q)] for q in range(4)] for p in range(4)]
    rank = [sorted(range(4), key=lambda p: (ways[p][q], p)) for q in range(4)]
    return [x for p in range(4) for x in have[p][-1]], [rank[q].index(p) for p in range(4) for q in range(4)]


def _render(turns: list[dict], ways: list, fresh: bool, ends: bool, opened: int) -> list[dict]:
    """Rows of a stretch. fresh: it begins its conversation; ends: it ends it; opened: turns opened before it."""
    out = []
    for i, (turn, (state, action, between)) in enumerate(zip(turns, ways, strict=True)):
        text, said = (turn["text"] or "").replace("<|", "<\\|"), ""
        for x in between:
            said += ("<|end|>\n" if opened else "") + f"<|{ROLES[x - 1]}|>\n"
            opened += 1
        if action == "merge":
            said += "\n" + text
        else:
            said += ("<|end|>\n" if opened else "") + f"<|{ROLES[state - 1]}|>\n{text}"
            opened += 1
        after = LAST[state] if ends and i == len(turns) - 1 else ()
        at = opened - 1
        for x in after:
            said += f"<|end|>\n<|{ROLES[x - 1]}|>\n"
            opened += 1
        said += "<|end|>\n" if ends and i == len(turns) - 1 else ""
        out.append({"conv_id": turn["conv_id"], "turn": turn["turn"], "role": turn["role"], "new_role": ROLES[state - 1], "action": action, "inserted": len(between) + len(after), "out_turn": at, "rendered": said})
    return out


_ROW = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("new_role", pa.string()), ("action", pa.string()), ("inserted", pa.int32()), ("out_turn", pa.int64()), ("rendered", pa.string())])
_OPEN = pa.schema([("conv_id", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("part", pa.int32()), ("seq", pa.int64())])
_OUT = "conv_id long, turn long, role string, new_role string, action string, inserted int, out_turn long, rendered string"
_TURN = "conv_id long, turn long, role string, text string, part int, seq long"


def repaired(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, new_role, action, inserted, out_turn, rendered) for each row of turns.

    action: keep, relabel, or merge (into the turn before, maybe relabelled). inserted counts the empty
    turns put before the row's turn, and after it for a conversation's last row. out_turn numbers the
    conversation's turns after repair. rendered: the row's part of the conversation's rendering; the
    parts of a conversation in order of turn make it whole, so even an endless one never is one value.

    A "<|" in a text is rendered as "<\\|", so that all markers are the template's own.

    Order is turn (null first), role, the text's hash. Unknown and null roles are relabelled; null texts are empty.
    Rows that repeat conv_id and turn are turns one after another. Rows with a null conv_id are one
    conversation. No rows give no rows; other columns play no part.
    """
    spark = turns.sparkSession
    small_batches(spark)
    t = picked(turns, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    t = t.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    order = ["conv_id", "turn", "role", F.xxhash64("text")]
    ranged = t.repartitionByRange(n_tasks(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        """Rows of conversations that neither begin nor end the task, repaired; the first and the last as they are."""
        part, seq, first, own = TaskContext.get().partitionId(), 0, True, []

        def open_rows(rows):
            nonlocal seq
            for r in rows:
                yield {**r, "part": part, "seq": seq}
                seq += 1

        def batch(done, open_):
            struct = pa.array(open_, pa.struct(list(_OPEN))) if open_ else pa.nulls(len(done), pa.struct(list(_OPEN)))
            whole = pa.array(done, pa.struct(list(_ROW))) if done else pa.nulls(len(open_), pa.struct(list(_ROW)))
            return pa.RecordBatch.from_arrays([whole, struct], ["done", "open"])

        for b in pieces(batches):
            for r in b.to_pylist():
                if own and r["conv_id"] != own[0]["conv_id"]:
                    if first:
                        yield batch([], list(open_rows(own)))
                    else:
                        yield batch(_render(own, solve([x["role"] for x in own], START, None), True, True, 0), [])
                    first, own = False, []
                own.append(r)
        if own:
            yield batch([], list(open_rows(own)))

    split = stored(ranged.mapInArrow(run, f"done struct<{_ddl(_OUT)}>, open struct<{_ddl(_TURN)}>"))
    whole = split.where("done is not null").select("done.*")
    open_ = split.where("open is not null").select("open.*")

    def matrix(key, table):
        roles = table.sort_by("seq").column("role").to_pylist()
        cost, rank = stretch(roles)
        return pa.table({"conv_id": pa.array([key[0].as_py()], pa.int64()), "part": pa.array([key[1].as_py()], pa.int32()), "costs": pa.array([cost], pa.list_(pa.int64())), "ranks": pa.array([rank], pa.list_(pa.int64()))})

    def join(table):
        table = table.sort_by("part")
        steps, ranks = ([[[x[4 * p + q] for q in range(4)] for p in range(4)] for x in table.column(c).to_pylist()] for c in ("costs", "ranks"))
        have = [[0 if p == START else _FAR for p in range(4)]]
        for m in steps:
            have.append([min(have[-1][p] + m[p][q] for p in range(4)) for q in range(4)])
        q = min(range(4), key=lambda p: (have[-1][p] + INSERT * len(LAST[p]), p))
        states = [q]
        for m, rank, before in zip(steps[::-1], ranks[::-1], have[-2::-1], strict=True):
            q = min(range(4), key=lambda p: (before[p] + m[p][q], rank[p][q]))
            states.append(q)
        states = states[::-1]
        k = len(steps)
        return pa.table({"conv_id": table.column("conv_id"), "part": table.column("part"), "first": pa.array(states[:-1], pa.int32()), "last": pa.array(states[1:], pa.int32()), "at": pa.array(range(k), pa.int32()), "of": pa.array([k] * k, pa.int32())})

    stretches = open_.select("conv_id", "part", "seq", "role").groupBy("conv_id", "part").applyInArrow(matrix, "conv_id long, part int, costs array<long>, ranks array<long>")
    ends = stored(stretches.groupBy("conv_id").applyInArrow(join, "conv_id long, part int, first int, last int, at int, of int"))

    def opened(key, rows, end):
        ways = solve(rows.sort_by("seq").column("role").to_pylist(), end["first"][0].as_py(), end["last"][0].as_py())
        return end.append_column("opens", pa.array([sum(len(b) + (a != "merge") for _, a, b in ways)], pa.int64()))

    both = open_.select("conv_id", "part", "seq", "role").groupBy("conv_id", "part").cogroup(ends.groupBy("conv_id", "part"))
    counts = both.applyInArrow(opened, "conv_id long, part int, first int, last int, at int, of int, opens long")
    earlier = Window.partitionBy("conv_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as tasks, at most
    ends = counts.withColumn("before", F.coalesce(F.sum("opens").over(earlier), F.lit(0)))

    def finish(key, rows, end):
        end = end.to_pylist()[0]
        rows = rows.sort_by("seq").to_pylist()
        ways = solve([r["role"] for r in rows], end["first"], end["last"])
        return pa.Table.from_pylist(_render(rows, ways, end["at"] == 0, end["at"] == end["of"] - 1, end["before"]), _ROW)

    rest = open_.groupBy("conv_id", "part").cogroup(ends.groupBy("conv_id", "part")).applyInArrow(finish, _OUT)
    return whole.union(rest)


def _ddl(fields: str) -> str:
    return ", ".join(x.strip().replace(" ", ": ", 1) for x in fields.split(","))
