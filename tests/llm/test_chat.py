import itertools
import random

from shelfspark.llm import chat as op
from tests.llm.conftest import rows

TURNS = "conv_id long, turn long, role string, text string, part int, edge int"


def plain_cost(roles, depth):
    """Least cost over all legal role sequences of up to `depth` messages, turns assigned in order, each message one block."""
    best = None
    for n in range(depth + 1):
        for lead in ((), ("system",)):
            body = [("user", "assistant")[i % 2] for i in range(n)]
            if n % 2 or (lead and not n):
                continue
            messages = [*lead, *body]
            if not messages and roles:
                continue
            # each turn goes to a message, in order; a message's first turn is no merge; messages without turns are inserted
            for at in itertools.combinations_with_replacement(range(len(messages)), len(roles)):
                cost = op.INSERT * (len(messages) - len(set(at)))
                for i, (m, role) in enumerate(zip(at, roles)):
                    state = op.role_state(role)
                    wanted = op.role_state(messages[m])
                    cost += 0 if state == wanted else op.UNKNOWN if state is None else op.RELABEL
                    cost += op.MERGE if i and at[i - 1] == m else 0
                best = cost if best is None or cost < best else best
    return best


def least_cost(states):
    costs, _ = op.summary(states)
    return min(c + op.END[s] for s, c in enumerate(costs[op.START]))


def test_cost_is_the_least_of_all():
    r = random.Random(1)
    for n in range(0, 5):
        for _ in range(25):
            roles = [r.choice(["system", "user", "assistant", "human", "tool", None]) for _ in range(n)]
            states = [op.role_state(x) for x in roles]
            path = op.trace(states)
            got = sum(next(m[2] for m in op.MOVES[s] if m[:2] == (a, b)) for s, a, b in zip(states, [op.START, *path], path)) + op.END[path[-1] if path else op.START]
            assert got == plain_cost(roles, 8), roles


def test_stretches_meet_as_the_whole():
    r = random.Random(2)
    for _ in range(200):
        states = [r.choice([None, 1, 2, 3]) for _ in range(r.randint(1, 14))]
        cuts = sorted({0, len(states), *(r.randrange(len(states) + 1) for _ in range(3))})
        parts = [states[a:b] for a, b in zip(cuts, cuts[1:])]
        joined = []
        for part, (entry, leave) in zip(parts, op.seams([op.summary(p) for p in parts])):
            joined += op.trace(part, entry, leave)
        assert joined == op.trace(states)


def messages(text):
    out = []
    for block in text.split(op.CLOSED)[:-1]:
        head, _, body = block.partition("\n")
        out.append((head.removeprefix("<|im_start|>"), body))
    assert text.endswith(op.CLOSED)
    return out


def legal(roles):
    roles = roles[1:] if roles[:1] == ["system"] else roles
    return bool(roles) and roles == ["user", "assistant"] * (len(roles) // 2)


def table(spark, data):
    return spark.createDataFrame([(*d, 1, 2) for d in data], TURNS)


def by_conversation(df):
    out = {}
    order = lambda r: (r.turn is not None, r.turn or 0)
    for r in sorted(df.collect(), key=order):
        out.setdefault(r.conv_id, []).append(r)
    return out


def test_repaired_conversations_are_legal(spark):
    r = random.Random(5)
    data = [(c, t, r.choice(["system", "user", "assistant", " User ", "bot", "tool", None]), f"text {c}.{t}" if r.random() < 0.9 else None) for c in range(60) for t in range(r.randint(1, 9))]
    got = by_conversation(op.repaired(table(spark, data)))
    assert sum(map(len, got.values())) == len(data)
    for c, turns in got.items():
        own = messages("".join(t.rendered for t in turns))
        assert legal([role for role, _ in own])
        kept = [x for x in (d[3] for d in data if d[0] == c) if x]
        assert [x for _, body in own for x in body.split("\n\n") if x] == kept
        assert sum(t.cost for t in turns) == least_cost([op.role_state(d[2]) for d in data if d[0] == c])


def test_a_conversation_over_many_partitions(spark):
    r = random.Random(6)
    data = [(5, t, r.choice(["user", "assistant", "x"]), f"{t}") for t in range(3000)] + [(c, 0, "user", "hi") for c in (1, 2, 8, 9)]
    spread = op.repaired(table(spark, data).repartition(8))
    turns = by_conversation(spread)[5]
    roles = [op.role_state(d[2]) for d in data if d[0] == 5]
    assert [op.role_state(t.role) for t in turns] == op.trace(roles)
    assert legal([m for m, _ in messages("".join(t.rendered for t in turns))])
    assert sum(t.cost for t in turns) == least_cost(roles)
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        alone = op.repaired(table(spark, data))
        assert rows(alone) == rows(spread)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_nulls_repeats_and_empty_tables(spark):
    data = [(None, 0, "user", "a"), (None, None, "system", "b"), (1, 0, "user", "same"), (1, 0, "user", "same"), (2, 0, "assistant", None)]
    got = by_conversation(op.repaired(table(spark, data)))
    assert [t.rendered for t in got[None]] == ["<|im_start|>system\nb", "<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"]
    assert [t.action for t in got[1]] == ["keep", "merge"]
    assert legal([m for m, _ in messages("".join(t.rendered for t in got[2]))])
    assert op.repaired(table(spark, [])).collect() == []


def test_a_very_long_turn(spark):
    text = "long " * 400_000
    got = by_conversation(op.repaired(table(spark, [(1, 0, "user", text), (1, 1, "user", "more"), (1, 2, "assistant", "ok")])))
    assert messages("".join(t.rendered for t in got[1])) == [("user", f"{text}\n\nmore"), ("assistant", "ok")]
