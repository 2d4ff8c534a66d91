"""Chat formatting: the cheapest repair of a conversation's roles, then its rendered text.

A legal conversation is at most one system turn, then user and assistant turns in alternation, a user turn first and an
assistant turn last. A turn is kept, relabelled, or merged into the turn before it (also after a relabel), and empty turns
can be inserted before it or at the end. The cheapest sequence is the shortest path through the automaton of legal turns;
of equally cheap ones the one wins that has the smaller state where, from the end, they first differ.

The automaton has few states, so a stretch of turns is a small matrix of costs between states, and stretches combine like
one. Conversations are laid out by ranges of (conversation, turn), whatever their length: one task never needs a whole
conversation. Only the first and last stretch of each partition can belong to a conversation that goes on elsewhere; those
matrices, two per partition, meet on the driver, which fixes the states at the seams. Then each partition traces its own
stretches.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfspark.llm.common import prepare, table
from shelfspark.session import cut_lineage

ROLES = ("system", "user", "assistant")
# Names that other collections use for the three roles.
ALIASES = {"developer": "system", "human": "user", "prompter": "user", "ai": "assistant", "bot": "assistant", "gpt": "assistant", "model": "assistant"}

#: A known role is changed only where merging a turn and adding an empty one would not do.
MERGE, UNKNOWN, INSERT, RELABEL = 1, 2, 4, 6
FAR = 1 << 60

#: States: nothing yet, or the role of the last turn.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Which turn may follow which state.
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def role_state(role: str | None) -> int | None:
    """The state of a role's turn; None for a null or unknown role. White space and case don't matter."""
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return 1 + ROLES.index(name) if name in ROLES else None


def _paths() -> dict[tuple[int, int], tuple[int, ...]]:
    """For each pair of states, the empty turns to insert so that the second may follow the first: the fewest."""
    out = {}
    for a in range(4):
        level = [(a, ())]
        while level:
            after = []
            for s, path in level:
                for t in NEXT[s]:
                    if (a, t) not in out:
                        out[a, t] = path
                        after.append((t, (*path, t)))
            level = after
    return out


PATHS = _paths()


def steps(state: int | None) -> list[tuple[int, int, int, str]]:
    """(from, to, cost, action) for one turn of the given role; inserted turns are those of PATHS."""
    out = []
    for a in range(4):
        for b in (SYSTEM, USER, ASSISTANT):
            label = 0 if state == b else UNKNOWN if state is None else RELABEL
            if a == b:
                out.append((a, b, MERGE + label, "merge"))
            if (a, b) in PATHS:
                out.append((a, b, label + INSERT * len(PATHS[a, b]), "keep" if state == b else "relabel"))
    # the cheapest move between two states; a merge before others
    best: dict[tuple[int, int], tuple[int, int, int, str]] = {}
    for x in out:
        if (x[0], x[1]) not in best or x[2] < best[x[0], x[1]][2]:
            best[x[0], x[1]] = x
    return list(best.values())


MOVES = {s: steps(s) for s in (None, SYSTEM, USER, ASSISTANT)}
#: What the end costs: an answer is inserted where none stands last.
END = {START: 0, SYSTEM: 2 * INSERT, USER: INSERT, ASSISTANT: 0}


def _advance(costs: list[int], role: int | None) -> tuple[list[int], list[int]]:
    """Costs after one more turn, and for each state the state before."""
    after, back = [FAR] * 4, [-1] * 4
    for a, b, cost, _ in MOVES[role]:
        if costs[a] < FAR and costs[a] + cost < after[b]:
            after[b], back[b] = costs[a] + cost, a
    return after, back


def summary(roles: list[int | None]) -> tuple[list[list[int]], list[list[int]]]:
    """(costs, ranks) of a stretch: the least cost from each state to each state, and for each last state the order of
    the first states by their paths, compared from the end; that is what ties between first states go by."""
    costs = [[0 if s == a else FAR for s in range(4)] for a in range(4)]
    ranks = [[list(range(4))[a] for a in range(4)] for _ in range(4)]
    for role in roles:
        moved = [_advance(row, role) for row in costs]
        costs = [m[0] for m in moved]
        fresh = []
        for b in range(4):
            keys = [(back[b], ranks[back[b]][a]) if back[b] >= 0 else (9, a) for a, (_, back) in enumerate(moved)]
            order = sorted(range(4), key=keys.__getitem__)
            fresh.append([order.index(a) for a in range(4)])
        ranks = fresh
    return costs, ranks


def trace(roles: list[int | None], entry: int = START, leave: int | None = None) -> list[int]:
    """The states after each turn on the cheapest path from `entry` to `leave`, or to the cheapest end."""
    costs, backs = [0 if s == entry else FAR for s in range(4)], []
    for role in roles:
        costs, back = _advance(costs, role)
        backs.append(back)
    at = leave if leave is not None else min(range(4), key=lambda s: costs[s] + END[s])
    path = []
    for back in reversed(backs):
        path.append(at)
        at = back[at]
    return path[::-1]


def seams(stretches: list[tuple[list[list[int]], list[list[int]]]]) -> list[tuple[int, int]]:
    """(entry, leave) of each stretch of one conversation, from their summaries."""
    totals = [[0, FAR, FAR, FAR]]
    for costs, _ in stretches:
        totals.append([min(min(t + row[b] for t, row in zip(totals[-1], costs)), FAR) for b in range(4)])
    at = min(range(4), key=lambda s: totals[-1][s] + END[s])
    out = []
    for before, (costs, ranks) in zip(totals[-2::-1], stretches[::-1]):
        least = min(before[a] + costs[a][at] for a in range(4))
        entry = min((a for a in range(4) if before[a] + costs[a][at] == least), key=ranks[at].__getitem__)
        out.append((entry, at))
        at = entry
    return out[::-1]


def _opened(state: int, text: str) -> str:
    return f"<|im_start|>{ROLES[state - 1]}\n{text}"


CLOSED = "<|im_end|>\n"


def rendered(roles: list[int | None], texts: list[str | None], entry: int, leave: int | None, ends: bool) -> list[tuple[str, str, int, int, str]]:
    """(role, action, inserted, cost, piece) of each turn; the pieces of a conversation, in order, are its text.

    A piece closes the message before it, unless it is merged into it. inserted counts the empty turns in the piece.
    """
    out, before = [], entry
    path = trace(roles, entry, leave)
    for i, (role, state, text) in enumerate(zip(roles, path, texts)):
        _, _, cost, action = next(m for m in MOVES[role] if m[:2] == (before, state))
        if action == "merge":
            inserted, piece = 0, "\n\n" + (text or "")
        else:
            extra = PATHS[before, state]
            inserted = len(extra)
            piece = CLOSED * (before != START) + "".join(_opened(s, "") + CLOSED for s in extra) + _opened(state, text or "")
        if ends and i == len(path) - 1:
            missing = END[state] // INSERT
            extra = (USER, ASSISTANT)[2 - missing :]
            inserted, cost = inserted + missing, cost + END[state]
            piece += CLOSED + "".join(_opened(s, "") + CLOSED for s in extra)
        out.append((ROLES[state - 1], action, inserted, cost, piece))
        before = state
    return out


def _edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Summaries of a partition's first and last stretch, two rows at most."""
    part, ends, at, roles = TaskContext.get().partitionId(), [], None, []
    for batch in batches:
        for conv, role in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if roles and conv != at:
                if not ends:
                    ends.append((at, roles))
                roles = []
            at = conv
            roles.append(role_state(role))
    if roles:
        ends.append((at, roles))
        found = [(conv, *summary(own)) for conv, own in ends]
        columns = [pa.array([part] * len(found), pa.int32()), pa.array(range(len(found)), pa.int32()), pa.array([f[0] for f in found], pa.int64())]
        columns += [pa.array([[x for row in f[i] for x in row] for f in found], pa.list_(pa.int64())) for i in (1, 2)]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "edge", "conv_id", "costs", "ranks"])


def _fixed(edges: list) -> dict[tuple[int, object], tuple[int, int, bool]]:
    """(entry, leave, whether it ends there) for (partition, conversation) of the stretches that go on across partitions."""
    chains: list[list] = []
    for e in edges:
        goes_on = chains and e.edge == 0 and chains[-1][-1].conv_id == e.conv_id
        if goes_on:
            chains[-1].append(e)
        else:
            chains.append([e])
    out = {}
    square = lambda flat: [flat[i : i + 4] for i in range(0, 16, 4)]
    for chain in chains:
        if len(chain) > 1:
            states = seams([(square(e.costs), square(e.ranks)) for e in chain])
            out |= {(e.part, e.conv_id): (*s, e is chain[-1]) for e, s in zip(chain, states)}
    return out


_TURN = "conv_id long, turn long, role string, action string, inserted int, cost int, rendered string"


def _renderer(fixed: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, rows = TaskContext.get().partitionId(), None, []

        def done() -> pa.RecordBatch:
            entry, leave, ends = fixed.get((part, at), (START, None, True))
            made = rendered([role_state(r[2]) for r in rows], [r[3] for r in rows], entry, leave, ends)
            columns = list(zip(*((r[0], r[1], *m) for r, m in zip(rows, made))))
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]
            names = [c.split()[0] for c in _TURN.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if rows and row[0] != at:
                    yield done()
                    rows = []
                at = row[0]
                rows.append(row)
        if rows:
            yield done()

    return run


def repaired(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, action, inserted, cost, rendered) for every turn of (conv_id, turn, role, text).

    Turns are in order of turn, then role, then a hash of the text, nulls first. Rows without conv_id form one conversation. Null texts
    are empty; null and unknown roles must be relabelled, at a lower cost than a known one. Repeated rows are turns of
    their own. The rendered pieces of a conversation, in this order, are the repaired conversation.
    """
    spark = prepare(turns.sparkSession)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text")
    rows = rows.withColumn("tie", F.monotonically_increasing_id())
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text"), F.col("tie")]
    laid = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    laid = cut_lineage(laid.select("conv_id", "turn", "role", "text"))
    edges = laid.mapInArrow(_edges, "part int, edge int, conv_id long, costs array<long>, ranks array<long>").collect()
    fixed = spark.sparkContext.broadcast(_fixed(sorted(edges, key=lambda e: (e.part, e.edge))))
    return laid.mapInArrow(lambda batches: _renderer(fixed.value)(batches), _TURN)


def op6_chat_formatting(spark, sf_dir):
    return repaired(table(spark, sf_dir, "conversations"))
