"""Repair of damaged conversations: the cheapest edits that give the roles (s?(ua)+)?, by one integer DP on a DAG.

The rows of a conversation are the layers of a DAG; its nodes are (rows consumed, state of the role pattern, whether the
last output was inserted). Each way from a node to the end is one integer: the high digits are its cost, the low ones
its audit letters as digits of fixed width, the first letter highest and zeros behind the last. Putting a letter in
front adds its cost and shifts the letters by one place. The smallest integer therefore is the cheapest way and, among
equally cheap ones, the one whose audit is least in ASCII order: a plain minimum decides everything.

Letters: K keep (0), R give the role user or assistant (3), D delete (4; the only choice for blank and repeated rows),
I insert an empty user or assistant row (3). A truncated row that stays costs 3 more. The pattern fixes the role of
every inserted and changed row, so an audit stands for one repaired conversation. Two inserted rows next to each other
are never cheapest (without them the pattern still holds, or deleting a lone system row is cheaper), so the DAG lets
at most one insertion stand before a row.

Long conversations: the DP runs over pieces of ``PIECE`` rows, from the last to the first. A piece needs only the costs
of the rest from each state: letters fix states, so two ways that differ do so within the piece, at a letter. Rows reach
the tasks by conversation, are sorted there (Spark spills) and streamed, so no conversation is held in memory; only its
audit is, which is one value of the result. One conversation is read by one task, as the digest of its joined text runs
through all of it in order.

Edge cases. Nulls: a null conv_id is a conversation of its own; null role, text, and null id or turn inside the hashed key
count as one space. Rows that all were dropped, or an empty table: zeros, empty audit, digest of the empty string, or no
rows. Rows of one turn are ordered by role and text; equal rows are repeats. Roles other than system, user and assistant
go by their first letter; an empty role has none and fits nowhere. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

#: Rows of a conversation that one run of the DP takes.
PIECE = 64
RELABEL, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Letters as digits, in ASCII order; zero is the padding.
DIGIT = {"D": 1, "I": 2, "K": 3, "R": 4}
_LETTER = {d: c for c, d in DIGIT.items()}
_WIDTH = 3
#: States of the pattern: nothing yet, after s, after u, after a. The conversation may end in the first and the last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_SPACE = r"[\x20\x09-\x0D]"
_ORDER = ("turn", "role", "text", "copy")


def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copy, dropped): each row as its hash damages it; dropped rows stay, marked, without content."""
    conv, turn = F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint")

    def said(v: Column) -> Column:
        return F.coalesce(v.cast("string"), F.lit(" "))

    kind = (F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).cast("int")
    text, role = said(F.col("text")), said(F.col("role"))
    gone = kind == 0
    seen = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    return rows.select(
        conv.alias("conv_id"),
        F.when(~gone, turn).alias("turn"),
        F.when(~gone, F.when(kind == 4, "user").otherwise(role)).alias("role"),
        F.when(~gone, seen).alias("text"),
        gone.alias("dropped"),
        F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    )


def _initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def faults(rows: DataFrame) -> DataFrame:
    """Adds ``fault``: the first of blank, duplicate and truncated that a row has (none: empty text), and ``at``, its place.

    Rows are dealt by conversation once; both windows and all later sorts work inside those partitions.
    """
    dealt = rows.repartition("conv_id")
    again = Window.partitionBy("conv_id", "dropped", "role", "text").orderBy(F.col("turn").asc_nulls_first(), "copy")
    order = Window.partitionBy("conv_id").orderBy("dropped", F.col("turn").asc_nulls_first(), *_ORDER[1:])
    last = F.regexp_extract("text", rf"(?s)([^\x20\x09-\x0D]){_SPACE}*\z", 1)
    fault = (
        F.when(F.col("dropped"), "")
        .when(last == "", "blank")
        .when(F.col("_again") > 1, "duplicate")
        .when(~last.isin(".", "!", "?"), "truncated")
        .otherwise("")
    )
    counted = dealt.withColumn("_again", F.row_number().over(again)).withColumn("fault", fault).drop("_again")
    return counted.withColumn("at", F.row_number().over(order))


def symbol(role: str, fault: str) -> str:
    """What the DP needs of a row: its role's letter (x: none that fits), a capital where truncated, - where it must go."""
    if fault in ("blank", "duplicate"):
        return "-"
    letter = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return letter.upper() if fault == "truncated" else letter


@lru_cache(maxsize=1 << 16)
def solve(symbols: str, rest: tuple[int | None, int | None, int | None, int | None], tail: bool) -> tuple[tuple[int | None, str], ...]:
    """(cost, audit of these rows) of the best way from each state before ``symbols``.

    ``rest``: cost of what follows from each state (None: no way). ``tail``: whether a row may be inserted behind the last.
    """
    places = 2 * len(symbols) + 1
    low = _WIDTH * places
    mask = (1 << low) - 1

    def put(letter: str, cost: int, way: int | None) -> int | None:
        if way is None:
            return None
        return ((way >> low) + cost << low) | DIGIT[letter] << low - _WIDTH | (way & mask) >> _WIDTH

    def least(ways: Iterable[int | None]) -> int | None:
        return min((w for w in ways if w is not None), default=None)

    def inserted(before: list[int | None], after: list[int | None]) -> list[int | None]:
        """``before`` with one insertion allowed, which leads to ``after``."""
        out = []
        for state in range(4):
            moves = [put("I", INSERT, after[to]) for letter, to in _NEXT[state].items() if letter != "s"]
            out.append(least([before[state], *moves]))
        return out

    plain = [None if c is None else c << low for c in rest]
    ways = inserted(plain, plain) if tail else plain
    for s in reversed(symbols):
        row = []
        for state in range(4):
            moves = [put("D", DELETE, ways[state])]
            if s != "-":
                letter, more = s.lower(), TRUNCATED if s.isupper() else 0
                for wanted, to in _NEXT[state].items():
                    if wanted == letter:
                        moves.append(put("K", more, ways[to]))
                    elif wanted != "s":
                        moves.append(put("R", RELABEL + more, ways[to]))
            row.append(least(moves))
        ways = inserted(row, row)

    def read(way: int | None) -> tuple[int | None, str]:
        if way is None:
            return None, ""
        digits = ((way >> _WIDTH * p) & 7 for p in range(places - 1, -1, -1))
        return way >> low, "".join(_LETTER[d] for d in digits if d)

    return tuple(map(read, ways))


#: Costs of the end of a conversation from each state.
END = (0, None, None, 0)


def _planned(batches):
    """Rows of each conversation from the last to the first; adds the audits of a piece to its first row."""
    conv, rest, symbols, any_ = None, END, [], False
    for b in batches:
        plans = []
        for c, role, fault, dropped, at in zip(*[b.column(x).to_pylist() for x in ("conv_id", "role", "fault", "dropped", "at")]):
            if c != conv or not any_:
                conv, rest, symbols, any_ = c, END, [], True
            plan = None
            if not dropped:
                symbols.append(symbol(role, fault))
                if (at - 1) % PIECE == 0:
                    least = min((r for r in rest if r is not None), default=0)
                    found = solve("".join(reversed(symbols)), tuple(None if r is None else r - least for r in rest), rest == END)
                    plan = [a for _, a in found] + [found[START][0] + least if at == 1 else 0]
                    rest = tuple(None if cost is None else cost + least for cost, _ in found)
                    symbols = []
            plans.append(plan)
        audits = pa.array([None if p is None else p[:4] for p in plans], pa.list_(pa.string()))
        costs = pa.array([None if p is None else p[4] for p in plans], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns, audits, costs], [*b.schema.names, "plan", "cost"])


class _Repair:
    """One conversation, row by row from the first to the last."""

    def __init__(self, conv):
        self.conv, self.state, self.audit, self.digest, self.any = conv, START, [], hashlib.sha256(), False
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.letter, self.plan, self.i = None, "", 0

    def put(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.any else "") + f"{role}:{text}").encode())
        self.any = True
        self.state = _NEXT[self.state][role[:1]]

    def made(self) -> str:
        return "assistant" if self.state == USER else "user"

    def insertions(self) -> None:
        while self.i < len(self.plan) and self.plan[self.i] == "I":
            self.put(self.made(), "")
            self.i += 1

    def row(self, turn, role, text, fault, plan, cost) -> None:
        if plan is not None:
            self.plan, self.i = plan[self.state], 0
            self.audit.append(self.plan)
            self.cost += cost
        if turn is not None:
            self.turns += turn != self.turn
            self.turn, self.low, self.high = turn, turn if self.low is None else self.low, turn
        letter = role[:1]
        self.illegal += self.letter is not None and self.letter + letter not in ("su", "ua", "au")
        self.letter = letter
        if fault:
            setattr(self, fault, getattr(self, fault) + 1)
        self.insertions()
        edit = self.plan[self.i]
        self.i += 1
        if edit != "D":
            self.put(role if edit == "K" else self.made(), text)
        self.insertions()

    def result(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return (self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.digest.hexdigest())


_RESULT = (("conv_id", pa.int64()), ("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string()))


def _repaired(batches):
    now, done = None, []

    def flush():
        nonlocal done
        out, done = done, []
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, (_, t) in enumerate(_RESULT)], [c for c, _ in _RESULT])

    for b in batches:
        for c, turn, role, text, fault, dropped, plan, cost in zip(*[b.column(x).to_pylist() for x in ("conv_id", "turn", "role", "text", "fault", "dropped", "plan", "cost")]):
            if now is None or c != now.conv:
                if now is not None:
                    done.append(now.result())
                now = _Repair(c)
            if not dropped:
                now.row(turn, role, text, fault, plan, cost)
        if done:
            yield flush()
    if now is not None:
        done.append(now.result())
        yield flush()


def planned(rows: DataFrame) -> DataFrame:
    """``faults`` rows with the audits of each piece of a conversation, one for each state before it, at its first row."""
    back = rows.sortWithinPartitions("conv_id", F.col("at").desc())
    schema = "conv_id bigint, turn bigint, role string, text string, dropped boolean, copy int, fault string, at int"
    return back.select("conv_id", "turn", "role", "text", "dropped", "copy", "fault", "at").mapInArrow(_planned, f"{schema}, plan array<string>, cost bigint")


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation: its gaps, faults, the cheapest edits with their cost, and the digest of what they leave."""
    plans = planned(faults(damaged(rows))).sortWithinPartitions("conv_id", "at")
    schema = ", ".join(f"{c} {'string' if t == pa.string() else 'bigint'}" for c, t in _RESULT)
    return plans.select("conv_id", "turn", "role", "text", "fault", "dropped", "plan", "cost").mapInArrow(_repaired, schema)
