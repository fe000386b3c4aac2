"""Chat formatting: minimum-cost role repair over a legal-turn automaton.

Legal conversations: one optional system turn, then user and assistant turns
in turn, ending with the assistant.  A dynamic program over the automaton's
states (start, system, user, assistant) chooses for every turn to keep or
relabel its role, to open a turn or merge into the one before, and where to
insert empty turns, at the least total cost; ties go to the first option in
the fixed order of ``_options``.

Turns of a conversation go in order (turn, role, text), nulls first.  Each
turn yields one row with its *piece* of the rendered text; a conversation's
pieces in the order of ``pos`` form its rendering, so no conversation, however
long, is gathered into one row.  Conversations of more than ``block`` turns are
worked on in blocks: a block's effect is a 4 x 4 matrix of least costs between
states, matrices are combined in order, and each block is then repaired
between the states so found.  The result is the same as in one pass.

Nulls and edge cases: a null conv_id is a conversation of its own; a null or
unknown role must be relabelled; a null text is empty; repeated rows are turns
like any other; extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pairwright.llm.common import staged as stage
from pairwright.operators.rank import global_row_number

START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
#: Names met in chat data for the three roles (fixed values).
ALIASES = {"system": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "gpt": ASSISTANT,
           "bot": ASSISTANT, "model": ASSISTANT}
RELABEL, UNKNOWN, MERGE, INSERT = 3.0, 1.0, 1.0, 2.0
BLOCK = 4096
INF = float("inf")
_NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}


def role_of(name: str | None) -> int:
    return ALIASES.get((name or "").strip().lower(), START)


@cache
def _inserts(state: int, role: int) -> tuple[int, ...] | None:
    """Roles of the fewest empty turns that make a turn of ``role`` legal after ``state``."""
    paths = [(state, ())]
    for at, path in paths:
        if role in _NEXT[at]:
            return path
        if len(path) < 3:
            paths += [(r, (*path, r)) for r in _NEXT[at] if r != SYSTEM]
    return None


@cache
def _options(own: int) -> tuple:
    """(state before, state after, cost, merged, inserted roles) of a turn with role ``own``."""
    out = []
    for role in (SYSTEM, USER, ASSISTANT):
        cost = 0.0 if role == own else UNKNOWN if own == START else RELABEL
        for state in range(4):
            path = _inserts(state, role)
            if path is not None:
                out.append((state, role, cost + INSERT * len(path), False, path))
            if state == role:
                out.append((state, role, cost + MERGE, True, ()))
    return tuple(sorted(out, key=lambda o: (o[1] != own, o[3], len(o[4]), o[1], o[0])))


def closing(state: int) -> tuple[int, ...]:
    """Roles of the empty turns that end a conversation legally after ``state``."""
    return {START: (), SYSTEM: (USER, ASSISTANT), USER: (ASSISTANT,), ASSISTANT: ()}[state]


def matrix(roles: list[int]) -> list[list[float]]:
    """Least cost from every state before the turns to every state after them."""
    out = [[0.0 if a == b else INF for b in range(4)] for a in range(4)]
    for own in roles:
        out = [_step(row, own)[0] for row in out]
    return out


def _step(costs: list[float], own: int) -> tuple[list[float], list]:
    new, how = [INF] * 4, [None] * 4
    for o in _options(own):
        c = costs[o[0]] + o[2]
        if c < new[o[1]]:
            new[o[1]], how[o[1]] = c, o
    return new, how


def repair(roles: list[int], entry: int = START, leave: int | None = None) -> tuple[list, float]:
    """The chosen option of each turn and the cost; ``leave``: the state to end in, else the cheapest legal end."""
    costs, trail = [0.0 if s == entry else INF for s in range(4)], []
    for own in roles:
        costs, how = _step(costs, own)
        trail.append(how)
    if leave is None:
        leave = min(range(4), key=lambda s: (costs[s] + INSERT * len(closing(s)), s))
        total = costs[leave] + INSERT * len(closing(leave))
    else:
        total = costs[leave]
    out, state = [], leave
    for how in reversed(trail):
        out.append(how[state])
        state = how[state][0]
    return out[::-1], total


def _open(role: int) -> str:
    return f"<|{NAMES[role]}|>\n"


def render(options: list, turns: list[str], last: bool) -> list[str]:
    """A piece for each turn; ``last``: the conversation ends here."""
    out = []
    for (state, role, _, merged, path), text in zip(options, turns, strict=True):
        if merged:
            out.append("\n\n" + text)
        else:
            empty = "".join(_open(r) + "<|end|>\n" for r in path)
            out.append(("<|end|>\n" if state != START else "") + empty + _open(role) + text)
    if last and out:
        out[-1] += "<|end|>\n" + "".join(_open(r) + "<|end|>\n" for r in closing(options[-1][1]))
    return out


_OUT = ["conv_id", "no_conv", "pos", "turn", "no_turn", "role", "out_role", "action", "inserted", "piece", "cost"]
_SCHEMA = ("conv_id long, no_conv boolean, pos long, turn long, no_turn boolean, role string, out_role string, action string, inserted string, "
           "piece string, cost double")


def _groups(batches, keys=("no_conv", "conv_id", "part")):
    """Whole groups from sorted batches (a group holds ``BLOCK`` rows at most)."""
    rest = None
    for b in batches:
        b = b if rest is None else pd.concat([rest, b], ignore_index=True)
        key = b[list(keys)].to_numpy(dtype="int64")  # no nulls here: ids keep all their bits
        cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist()] if len(b) else []
        for a, z in zip(cuts, cuts[1:], strict=False):
            yield b.iloc[a:z]
        rest = b.iloc[cuts[-1]:] if cuts else None
    if rest is not None and len(rest):
        yield rest


def _repaired(batches):
    rows = []
    for g in _groups(batches):
        entry, leave = int(g["entry"].iloc[0]), int(g["leave"].iloc[0])
        options, cost = repair([role_of(r) for r in g["role"]], entry, None if leave < 0 else leave)
        parts = render(options, list(g["text"]), leave < 0 or bool(g["last"].iloc[0]))
        first = True
        for r, o, piece in zip(g.itertuples(index=False), options, parts, strict=True):
            action = ("merge" if o[3] else "keep") if o[1] == role_of(r.role) else ("relabel+merge" if o[3] else "relabel")
            rows.append((r.conv_id, r.no_conv, r.pos, r.turn, r.no_turn, r.role, NAMES[o[1]], action, ",".join(NAMES[i] for i in o[4]), piece, cost if first else 0.0))
            first = False
        if len(rows) >= 5000:
            yield _frame(rows)
            rows = []
    if rows:
        yield _frame(rows)


def _frame(rows) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_OUT)


def _matrices(batches):
    rows = [(g["conv_id"].iloc[0], g["no_conv"].iloc[0], g["part"].iloc[0], [x for r in matrix([role_of(r) for r in g["role"]]) for x in r]) for g in _groups(batches)]
    yield pd.DataFrame(rows, columns=["conv_id", "no_conv", "part", "m"])


def _states(g: pd.DataFrame) -> pd.DataFrame:
    """Entry and exit state of every block of one long conversation, from the blocks' matrices."""
    g = g.sort_values("part")
    costs, trail = [0.0, INF, INF, INF], []
    for m in g["m"]:
        new = [min(range(4), key=lambda a, b=b: (costs[a] + m[4 * a + b], a)) for b in range(4)]
        costs = [costs[a] + m[4 * a + b] for b, a in enumerate(new)]
        trail.append(new)
    state = min(range(4), key=lambda s: (costs[s] + INSERT * len(closing(s)), s))
    out = []
    for new in reversed(trail):
        out.append((new[state], state))
        state = new[state]
    out = out[::-1]
    return pd.DataFrame({"conv_id": g["conv_id"], "no_conv": g["no_conv"], "part": g["part"], "entry": [x[0] for x in out], "leave": [x[1] for x in out],
                         "last": [i == len(out) - 1 for i in range(len(out))]})


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, pos, turn, role, out_role, action, inserted, piece, cost (on a block's first row)."""
    zero = F.lit(0).cast("long")  # a long with a flag for null: beside a null, pandas would make doubles of ids
    t = turns.select(F.coalesce(F.col("conv_id").cast("long"), zero).alias("conv_id"), F.col("conv_id").cast("long").isNull().alias("no_conv"),
                     F.coalesce(F.col("turn").cast("long"), zero).alias("turn"), F.col("turn").cast("long").isNull().alias("no_turn"),
                     F.col("role").cast("string").alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    key = ["conv_id", "no_conv"]
    within = [F.col("no_turn").desc(), F.col("turn"), F.col("role"), F.col("text")]  # a null turn comes first
    sizes = t.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    long = stage(sizes.filter(F.col("n") > block).select(*key), "chat-long")
    flags = {"entry": F.lit(START), "leave": F.lit(-1), "last": F.lit(True)}
    w = Window.partitionBy(*key).orderBy(*within)
    short = t.join(long, key, "left_anti").withColumns({"pos": (F.row_number().over(w) - 1).cast("long"), "part": F.lit(0).cast("long"), **flags})
    out = short.sortWithinPartitions(*key, "pos").mapInPandas(_repaired, _SCHEMA)

    def named(df):
        return df.select(F.when(~F.col("no_conv"), F.col("conv_id")).alias("conv_id"), "pos", F.when(~F.col("no_turn"), F.col("turn")).alias("turn"),
                         *(c for c in _OUT if c not in ("conv_id", "no_conv", "pos", "turn", "no_turn")))

    if long.first() is None:
        return named(out)
    big = global_row_number(t.join(long, key, "left_semi").withColumns({"tie": F.xxhash64("text", F.monotonically_increasing_id()), "first": ~F.col("no_turn")}),
                            [*key, "first", "turn", "role", "text", "tie"], "rn").drop("tie", "first")
    big = stage(big, "chat-turns")
    firsts = big.groupBy(*key).agg(F.min("rn").alias("first"))
    big = big.join(firsts, key).withColumn("pos", F.col("rn") - F.col("first")) \
        .withColumn("part", F.floor(F.col("pos") / block)).select(*key, "turn", "no_turn", "role", "text", "pos", "part")
    n = max(1, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df):
        return df.repartition(n, *key, "part").sortWithinPartitions(*key, "part", "pos")

    found = dealt(big).mapInPandas(_matrices, "conv_id long, no_conv boolean, part long, m array<double>")
    states = stage(found.groupBy(*key).applyInPandas(_states, "conv_id long, no_conv boolean, part long, entry int, leave int, last boolean"), "chat-states")
    return named(out.unionByName(dealt(big.join(states, [*key, "part"])).mapInPandas(_repaired, _SCHEMA)))
