"""Chat formatting by minimum-cost role repair (operator 9).

A legal conversation is an optional system turn, then user and assistant in turn, ending with assistant. A dynamic
programme over that automaton reads the turns in order and chooses for each the cheapest of: keep, relabel, merge into
the turn before (with or without a relabel), and empty turns inserted before it or at the end. The repaired sequence is
rendered; concatenating ``rendered`` by ``seq`` gives the conversation.

Turns are dealt by range over (conv_id, turn), so one conversation may lie in many partitions. Each partition reduces its first and its last
conversation to a matrix of (cost, turns) from state to state; these matrices, two for each partition, are composed
in order, which fixes the state at every cut, and the partitions then choose their steps alone.

Cases: rows are read by turn, then role and text, so ties and repeated rows have one order; a null turn comes first; null and unknown roles cost a
relabel; null texts are empty; rows with a null conv_id are one conversation; an empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.llm.common import n_partitions, settle

ROLES = ("system", "user", "assistant")
#: States: before any turn, and after a turn of each role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
MERGE, RELABEL, INSERT = 2, 5, 3
NEVER = (1 << 40, 0)


def inserts() -> dict[tuple[int, int], tuple[int, ...]]:
    """The fewest empty turns that lead from state to state."""
    best = {(s, s): () for s in range(4)}
    for _ in range(3):
        for (a, b), path in list(best.items()):
            for c in NEXT[b]:
                if (a, c) not in best or len(best[a, c]) > len(path) + 1:
                    best[a, c] = (*path, c)
    return best


PATHS = inserts()


def steps(role: str | None) -> list[tuple[int, int, int, int, tuple[int, ...], str]]:
    """(from, to, cost, turns, roles inserted before, action) for a turn of this role."""
    out = []
    for (a, b), path in PATHS.items():
        for c in NEXT[b]:
            other = role != ROLES[c - 1]
            out.append((a, c, INSERT * len(path) + RELABEL * other, len(path) + 1, path, "relabel" if other else "keep"))
    for s in (SYSTEM, USER, ASSISTANT):
        other = role != ROLES[s - 1]
        out.append((s, s, MERGE + RELABEL * other, 0, (), "merge_relabel" if other else "merge"))
    return out


STEPS = {r: steps(r) for r in (*ROLES, None)}


def known(role: str | None) -> str | None:
    return role if role in ROLES else None


def advance(values: list[tuple[int, int]], role: str | None) -> tuple[list[tuple[int, int]], list[tuple | None]]:
    """(cost, turns) by state after one more turn, and the step taken to each state."""
    new: list[tuple[int, int]] = [NEVER] * 4
    taken: list[tuple | None] = [None] * 4
    for step in STEPS[known(role)]:
        a, b, cost, turns = step[:4]
        if values[a] != NEVER and (v := (values[a][0] + cost, values[a][1] + turns)) < new[b]:
            new[b], taken[b] = v, step
    return new, taken


def matrix(roles: list[str | None]) -> list[list[tuple[int, int]]]:
    """(cost, turns) of a run of turns, from each state to each."""
    rows = [[(0, 0) if a == b else NEVER for b in range(4)] for a in range(4)]
    for role in roles:
        rows = [advance(r, role)[0] for r in rows]
    return rows


def last_state(values: list[tuple[int, int]]) -> int:
    """The state from which the end is cheapest."""
    return min((s for s in range(4) if values[s] != NEVER and (s, ASSISTANT) in PATHS), key=lambda s: (values[s][0] + INSERT * len(PATHS[s, ASSISTANT]), values[s][1], s))


def best_path(roles: list[str | None], entry: int, exit_state: int | None) -> tuple[list[tuple], int]:
    """The cheapest steps from entry to exit_state, or to the state that is best to end in, and that state."""
    values = [(0, 0) if s == entry else NEVER for s in range(4)]
    trail = []
    for role in roles:
        values, taken = advance(values, role)
        trail.append(taken)
    at = state = last_state(values) if exit_state is None else exit_state
    path = []
    for taken in reversed(trail):
        path.append(taken[at])
        at = taken[at][0]
    return path[::-1], state


def header(role: int, first: bool) -> str:
    return f"{'' if first else '<|end|>\n'}<|{ROLES[role - 1]}|>\n"


SCHEMA = pa.schema([("conv_id", pa.int64()), ("seq", pa.int64()), ("turn", pa.int64()), ("role", pa.string()), ("repaired_role", pa.string()), ("action", pa.string()), ("out_turn", pa.int64()), ("rendered", pa.string())])


def render(conv_id, rows: list[tuple], entry: int, exit_state: int | None, out_turn: int, seq: int) -> Iterator[tuple]:
    """Output rows of a run of turns (turn, role, text); exit_state None: it ends the conversation. out_turn, seq: how many turns and rows came before."""
    path, state = best_path([r[1] for r in rows], entry, exit_state)
    for (turn, role, text), (_, to, _, _, path_in, action) in zip(rows, path, strict=True):
        for k, x in enumerate(path_in):
            yield conv_id, seq * 4 + k, None, None, ROLES[x - 1], "insert", out_turn, header(x, out_turn == 0)
            out_turn += 1
        if action.startswith("merge"):
            yield conv_id, seq * 4 + 3, turn, role, ROLES[to - 1], action, out_turn - 1, "\n\n" + (text or "")
        else:
            yield conv_id, seq * 4 + 3, turn, role, ROLES[to - 1], action, out_turn, header(to, out_turn == 0) + (text or "")
            out_turn += 1
        seq += 1
    if exit_state is None:
        for k, x in enumerate(PATHS[state, ASSISTANT]):
            yield conv_id, seq * 4 + k, None, None, ROLES[x - 1], "insert", out_turn, header(x, out_turn == 0)
            out_turn += 1
        yield conv_id, seq * 4 + 3, None, None, None, "end", out_turn - 1, "<|end|>\n"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, rows) of consecutive equal conv_id; at most one conversation's part in this partition is held."""
    now, held = None, []
    for batch in batches:
        for conv, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and conv != now:
                yield now, held
                held = []
            now = conv
            held.append(tuple(row))
    if held:
        yield now, held


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, seq, turn, role, repaired_role, action, out_turn, rendered."""
    order = ("conv_id", "turn", "role", "_digest")  # texts themselves don't go into the bounds of ranges, which the driver holds
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"), F.md5(F.col("text").cast("string")).alias("_digest"))
    rows = settle(rows.repartitionByRange(n_partitions(conversations), *order).sortWithinPartitions(*order).drop("_digest"))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, first, last, n = TaskContext.get().partitionId(), None, None, 0
        for conv, run in _runs(batches):
            if n == 0:
                first = conv, run
            last = conv, run
            n += 1
        out = [] if not n else [(part, 0, *first)] if n == 1 else [(part, 0, *first), (part, 1, *last)]
        flat = [[v for r in matrix([x[0] for x in run]) for p in r for v in p] for _, _, _, run in out]
        yield pa.RecordBatch.from_pydict({"part": pa.array([o[0] for o in out], pa.int64()), "place": pa.array([o[1] for o in out], pa.int64()), "alone": pa.array([n == 1 for _ in out], pa.bool_()), "conv_id": pa.array([o[2] for o in out], pa.int64()), "n": pa.array([len(o[3]) for o in out], pa.int64()), "m": pa.array(flat, pa.list_(pa.int64()))})

    found = rows.select("conv_id", "role").mapInArrow(edges, "part long, place long, alone boolean, conv_id long, n long, m array<long>").collect()  # two for each partition at most
    cuts = compose(sorted(found, key=lambda r: (r["part"], r["place"])))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, out = TaskContext.get().partitionId(), []
        runs = enumerate(_runs(batches))
        held = next(runs, None)
        while held is not None:
            (k, (conv, run)), held = held, next(runs, None)
            cut = cuts.get((part, 0)) if k == 0 else cuts.get((part, 1)) if held is None else None
            out += render(conv, run, *(cut or (START, None, 0, 0)))
            if len(out) >= 5000:
                yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in out], SCHEMA)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(SCHEMA.names, r, strict=True)) for r in out], SCHEMA)

    return rows.mapInArrow(write, "conv_id long, seq long, turn long, role string, repaired_role string, action string, out_turn long, rendered string")


def compose(found: list) -> dict[tuple[int, int], tuple[int, int | None, int, int]]:
    """By (partition, place) of a part of a conversation: entry, exit (None: its end), turns and rows before."""
    cuts, k = {}, 0
    while k < len(found):
        # Parts of one conversation follow each other: the last of a partition, then those that are alone, then the first of one.
        group = [found[k]]
        while k + len(group) < len(found):
            a, b = group[-1], found[k + len(group)]
            if b["conv_id"] != a["conv_id"] or b["place"] != 0 or a["place"] == 0 and not a["alone"]:
                break
            group.append(b)
        k += len(group)
        mats = [[[(r["m"][8 * a + 2 * b], r["m"][8 * a + 2 * b + 1]) for b in range(4)] for a in range(4)] for r in group]
        values, back = [(0, 0) if s == START else NEVER for s in range(4)], []
        for m in mats:
            new, came = [NEVER] * 4, [0] * 4
            for a in range(4):
                for b in range(4):
                    if values[a] != NEVER and m[a][b][0] < NEVER[0] and (v := (values[a][0] + m[a][b][0], values[a][1] + m[a][b][1])) < new[b]:
                        new[b], came[b] = v, a
            values = new
            back.append(came)
        states = [last_state(values)]
        for came in reversed(back):
            states.append(came[states[-1]])
        states.reverse()
        turns = rows = 0
        for i, r in enumerate(group):
            cuts[r["part"], r["place"]] = (states[i], None if i == len(group) - 1 else states[i + 1], turns, rows)
            turns, rows = turns + mats[i][states[i]][states[i + 1]][1], rows + r["n"]
    return cuts
