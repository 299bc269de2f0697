"""Repair of conversation structure: the cheapest edits, by dynamic programming over runs.

A repaired conversation has the role initials `(s?(ua)+)?`. Keeping a turn costs 0, giving it
another role 2, deleting it 3, inserting an empty turn 2; blank and repeated turns must go, and
every truncated turn that stays costs 1. Each turn is one of nine symbols (role by fault). Equal
neighbours are collapsed into runs; the min-plus transition of a symbol is raised to binary powers
once a worker, and a run of any length is crossed by a few of them, from the last run to the first.
Then the choices are unrolled from the front, in ASCII order among equally cheap ones.

Spark deals conversations to tasks. Two passes keep memory small: the first sees roles and faults
(a byte a turn) and gives each conversation its audit; in the second the turns follow their audit
in sorted order and are edited as they stream by. So a conversation of any size costs a task its
audit and one batch of rows, but it is one task's work: its digest can only be taken in order.

Turns go by number (nulls first), then by role and digest of the text. Nulls in role or text are
one space; rows without `conv_id` form one conversation. Other columns are left out, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, SYSTEM, USER, DONE = range(4)
#: The state after a user or assistant turn that is allowed in a state; its role.
NEXT, NEXT_ROLE = (USER, USER, DONE, USER), ("user", "user", "assistant", "user")
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 60
#: Cost of ending in each state, with what must still be inserted.
ENDING = (0, 4, 2, 0)
#: Runs up to this length are unrolled turn by turn; longer ones are halved first.
STEP = 64

DROP, EMPTY, UNSTOPPED, TWICE, AS_USER = range(5)
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
TURN = "conv_id long, position long, edit string, role string, text string"


def _product(a, b):
    return tuple(tuple(min(a[p][k] + b[k][q] for k in range(4)) for q in range(4)) for p in range(4))


def _apply(matrix, after):
    return tuple(min(row[q] + after[q] for q in range(4)) for row in matrix)


def kept_state(state: int, role: str) -> int | None:
    """Where keeping a turn with this initial leads, if it may stand there."""
    if role == "s":
        return SYSTEM if state == START else None
    if role == "u":
        return USER if state != USER else None
    return DONE if role == "a" and state == USER else None


@lru_cache(maxsize=None)
def power(symbol: str, level: int):
    """The transition of 2**level turns of one symbol: insertions first, then the turn itself."""
    if level:
        half = power(symbol, level - 1)
        return _product(half, half)
    inserted = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        q, cost = p, 0
        while cost < inserted[p][q]:
            inserted[p][q] = cost
            q, cost = NEXT[q], cost + INSERT
    taken = [[FAR] * 4 for _ in range(4)]
    for p in range(4):
        taken[p][p] = DELETE
        if symbol != "X":
            late = TRUNCATED * symbol.isupper()
            taken[p][NEXT[p]] = min(taken[p][NEXT[p]], REROLE + late)
            q = kept_state(p, symbol.lower())
            if q is not None:
                taken[p][q] = min(taken[p][q], KEEP + late)
    return _product(inserted, taken)


def crossed(symbol: str, length: int, after):
    """Costs before a run of `length` equal symbols, from those behind it."""
    level = 0
    while length:
        if length & 1:
            after = _apply(power(symbol, level), after)
        length >>= 1
        level += 1
    return after


def _unroll(symbol: str, length: int, after, state: int, out: list[str]) -> int:
    """Append the edits of a run to `out`; returns the state behind it."""
    if length > STEP:
        half = length // 2
        state = _unroll(symbol, length - half, crossed(symbol, half, after), state, out)
        return _unroll(symbol, half, after, state, out)
    costs = [after]
    for _ in range(length):
        costs.append(_apply(power(symbol, 0), costs[-1]))
    for here, then in zip(costs[:0:-1], costs[-2::-1]):
        late = TRUNCATED * symbol.isupper()
        while True:
            cost = here[state]
            if DELETE + then[state] == cost:
                out.append("D")
                break
            if INSERT + here[NEXT[state]] == cost:
                out.append("I")
                state = NEXT[state]
                continue
            q = kept_state(state, symbol.lower()) if symbol != "X" else None
            if q is not None and KEEP + late + then[q] == cost:
                out.append("K")
                state = q
            else:
                out.append("R")
                state = NEXT[state]
            break
    return state


def plan(symbols: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation, given as a string of symbols.

    Symbols are s, u, a, o (any other role), in upper case for truncated turns, and X for turns
    that must go.
    """
    runs = [(symbol, sum(1 for _ in same)) for symbol, same in groupby(symbols)]
    behind = [ENDING]
    for symbol, length in reversed(runs):
        behind.append(crossed(symbol, length, behind[-1]))
    state, out = START, []
    for (symbol, length), after in zip(runs, behind[-2::-1]):
        state = _unroll(symbol, length, after, state, out)
    out.append("I" * (ENDING[state] // INSERT))
    return behind[-1][START], "".join(out)


class Editor:
    """Follows one conversation's audit while its turns pass by."""

    def __init__(self, conversation, audit: str):
        self.conversation, self.audit, self.at, self.state = conversation, audit, 0, START

    def _step(self, role, text):
        edit, at = self.audit[self.at], self.at
        self.at += 1
        if edit == "K":
            self.state = kept_state(self.state, role[:1])
        elif edit != "D":
            role, self.state = NEXT_ROLE[self.state], NEXT[self.state]
        return self.conversation, at, edit, role, text

    def inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            yield self._step(None, "")

    def turn(self, role: str, text: str):
        yield from self.inserted()
        yield self._step(role, text)


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, copy, role, text, dropped): the turns with planted faults, by a checksum of their place.

    Of twenty parts one each is dropped, emptied, robbed of its stops, repeated, or given to the user.
    """
    space = lambda c: F.coalesce(c.cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(space(F.col("conv_id")), F.lit(":"), space(F.col("turn"))).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space(F.col("role")).alias("role"), space(F.col("text")).alias("text"), fault.alias("fault"))
    f = F.col("fault")
    copies = F.explode(F.when(f == TWICE, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy")
    text = F.when(f == EMPTY, "").when(f == UNSTOPPED, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", copies, F.when(f == AS_USER, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (f == DROP).alias("dropped"))


def _place() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest"), F.col("copy")]


def repair_plans(turns: DataFrame) -> DataFrame:
    """One row a conversation, those that lost every turn included: faults, cost and audit.

    `turns` has conv_id, turn, copy, role, text and `dropped` (rows that only name a conversation).
    """
    body = F.regexp_replace("text", r"[\x20\x09-\x0D]+\z", "")
    blank, whole = body == "", body.rlike(r"[.!?]\z")
    light = turns.select("conv_id", "turn", "copy", "role", F.sha2("text", 256).alias("digest"), "dropped", blank.alias("blank"), (~whole).alias("truncated")).repartition("conv_id")
    nth = F.row_number().over(Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first(), "copy"))
    light = light.withColumn("repeat", nth > 1).sortWithinPartitions(F.col("conv_id"), *_place())
    return light.select("conv_id", "turn", "role", "dropped", "blank", "repeat", "truncated").mapInArrow(_plans, PLAN)


class _Sums:
    def __init__(self, conversation):
        self.conversation, self.symbols, self.before = conversation, [], None
        self.first = self.last = None
        self.numbers = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn, role, blank, repeat, truncated):
        initial = role[:1]
        if turn is not None and turn != self.last:
            self.first, self.last, self.numbers = turn if self.first is None else self.first, turn, self.numbers + 1
        if self.before is not None:
            self.illegal += self.before + initial not in ("su", "ua", "au")
        self.before = initial
        known = initial if initial and initial in "sua" else "o"
        if blank or repeat:
            self.blank, self.duplicate = self.blank + blank, self.duplicate + (not blank)
            known = "X"
        elif truncated:
            self.truncated += 1
            known = known.upper()
        self.symbols.append(known)

    def row(self):
        cost, audit = plan("".join(self.symbols))
        gaps = self.last - self.first + 1 - self.numbers if self.numbers else 0
        return self.conversation, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _plans(batches):
    own = None
    for batch in batches:
        found = []
        for conversation, turn, role, dropped, *faults in zip(*(c.to_pylist() for c in batch.columns)):
            if own is None or own.conversation != conversation:
                if own is not None:
                    found.append(own.row())
                own = _Sums(conversation)
            if not dropped:
                own.add(turn, role, *faults)
        yield _batch(found, PLAN)
    if own is not None:
        yield _batch([own.row()], PLAN)


KINDS = {"long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.strip().split(" ") for f in schema.split(",")]
    columns = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(list(c), KINDS[kind]) for c, (_, kind) in zip(columns, fields)], names=[name for name, _ in fields])


def _with_plans(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Each conversation's plan, then its turns in order, in one task."""
    names = plans.columns[1:]
    first = plans.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit(-1).alias("copy"), F.lit("").alias("role"), F.lit("").alias("text"), *names)
    rest = turns.filter("NOT dropped").select("conv_id", "turn", "copy", "role", "text", *[F.lit(None).cast(plans.schema[n].dataType).alias(n) for n in names])
    both = first.unionByName(rest).repartition("conv_id").withColumn("digest", F.sha2("text", 256))
    return both.sortWithinPartitions(F.col("conv_id"), F.col("audit").isNull(), *_place()).select("conv_id", "role", "text", *names)


def _walk(batches):
    """("plan", its row), then ("edit", one) for every edit; ("batch", None) behind each batch of rows."""
    editor = None
    for batch in batches:
        for conversation, role, text, *own in zip(*(c.to_pylist() for c in batch.columns)):
            if own[-1] is not None:
                for step in editor.inserted() if editor else ():
                    yield "edit", step
                editor = Editor(conversation, own[-1])
                yield "plan", (conversation, *own)
            else:
                for step in editor.turn(role, text):
                    yield "edit", step
        yield "batch", None
    for step in editor.inserted() if editor else ():
        yield "edit", step
    yield "batch", None


def _turns(batches):
    found = []
    for kind, value in _walk(batches):
        if kind == "batch":
            yield _batch(found, TURN)
            found = []
        elif kind == "edit":
            found.append(value)


REPORT = PLAN + ", repaired_sha256 string, n_repaired long"


def _reports(batches):
    found, own = [], None
    for kind, value in _walk(batches):
        if kind == "plan":
            if own is not None:
                found.append((*own, digest.hexdigest(), count))
            own, digest, count = value, hashlib.sha256(), 0
        elif kind == "edit" and value[2] != "D":
            digest.update(("\n" * (count > 0) + f"{value[3]}:{value[4]}").encode())
            count += 1
        elif kind == "batch":
            yield _batch(found, REPORT)
            found = []
    if own is not None:
        yield _batch([(*own, digest.hexdigest(), count)], REPORT)


def repaired_turns(turns: DataFrame, plans: DataFrame) -> DataFrame:
    """Every edit of every conversation: its position, initial (K, R, D, I), role and text."""
    return _with_plans(turns, plans).mapInArrow(_turns, TURN)


def repair_report(conversations: DataFrame) -> DataFrame:
    """The damaged conversations' faults, cheapest repair and the digest of what it leaves of them."""
    turns = damage(conversations)
    return _with_plans(turns, repair_plans(turns)).mapInArrow(_reports, REPORT)
