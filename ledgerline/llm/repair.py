"""Conversations brought back into turn by the cheapest edits.

A repaired conversation is empty, or alternates between user and assistant, ends with the
assistant and may open with a system row. Its rows are kept, given another role or deleted,
and rows without text are inserted. Which edits are cheapest is a dynamic program over four
states (nothing yet; after a system, user or assistant row). Rows come to a task by
conversation and in order of turn, and the program goes along them as Arrow batches arrive:
carried from batch to batch are the states' costs, how the edits so far compare with each
other and a running digest of each state's text. Costs lie within a few units of the least
one (dearer states can never win again and are dropped), so there are few different
situations; each is worked out once per task, and a row costs a look-up.

What a row did is a two-byte number. These back pointers are followed from the end of a
conversation to its start, which gives its edits. They are packed in blocks, and those of
giant conversations go to a scratch file of the task, which nothing else reads: a task that
is lost begins anew. So a task's memory does not grow with a conversation but for the one
character per row of the result. A conversation is still one task's work from row to row, as
the digest of its text can only be computed so.
"""

from __future__ import annotations

import hashlib
import tempfile
import zlib
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS = " \t\n\x0b\x0c\r"
ENDS = ".!?"
# Pointers of a block, and bytes of packed blocks that stay in memory.
BLOCK_ROWS = 1 << 18
SPILL_BYTES = 8_000_000

# Role initials by number; others are OTHER.
INITIALS, OTHER = "sua", 3
START, SYSTEM, USER, ASSISTANT = range(4)
# The state after a row with the initial, from the states where it may stand.
NEXT = {(START, 0): SYSTEM, (START, 1): USER, (SYSTEM, 1): USER, (ASSISTANT, 1): USER, (USER, 2): ASSISTANT}
ROLE = {USER: "user", ASSISTANT: "assistant"}
ACCEPTED = (START, ASSISTANT)
# From any state any other is reached, or made up for, by edits of 7 at most: a state that
# costs more than the cheapest by this cannot be on a cheapest way.
HOPELESS = 10


class Row(NamedTuple):
    """What the program needs of a row: its initial, whether it must go, whether it is cut off."""

    initial: int
    gone: bool
    truncated: bool


class Way(NamedTuple):
    """From ``state`` with ``inserts`` rows inserted and the row then kept, reroled or deleted."""

    state: int
    inserts: int
    edit: str


#: Per state (cost over the least, rank of its edits) or None.
Situation = tuple[tuple[int, int] | None, ...]
OPENING: Situation = ((0, 0), None, None, None)


def _inserted(state: int) -> Iterator[tuple[int, int]]:
    """(rows inserted, state then): none, one or two. There is one way to insert."""
    yield 0, state
    for n in (1, 2):
        state = ASSISTANT if state == USER else USER
        yield n, state


def _after(state: int, row: Row) -> Iterator[tuple[str, int, int]]:
    """(edit, state then, cost) of what may be done with the row."""
    yield "D", state, DELETE
    if row.gone:
        return
    extra = TRUNCATED if row.truncated else 0
    if (kept := NEXT.get((state, row.initial))) is not None:
        yield "K", kept, extra
    for initial in (1, 2):
        if (state, initial) in NEXT:
            yield "R", NEXT[state, initial], REROLE + extra


def advance(situation: Situation, row: Row) -> tuple[Situation, int, tuple[Way | None, ...]]:
    """The situation after a row, by how much the least cost grew, and each state's way.

    Of two ways of equal cost the one with the lesser edits wins. Up to a row's own edit no
    state's edits are the beginning of another's: they hold one letter per row besides
    inserts, and end with one. So what compares them does not change later.
    """
    best: list[tuple | None] = [None] * 4
    for state, known in enumerate(situation):
        if known is None:
            continue
        cost, rank = known
        for inserts, then in _inserted(state):
            for edit, to, more in _after(then, row):
                new = (cost + INSERT * inserts + more, (rank, "I" * inserts + edit), Way(state, inserts, edit))
                if best[to] is None or new[:2] < best[to][:2]:
                    best[to] = new
    least = min(b[0] for b in best if b)
    alive = {s: b for s, b in enumerate(best) if b and b[0] <= least + HOPELESS}
    order = sorted(alive, key=lambda s: alive[s][1])
    after = tuple((alive[s][0] - least, order.index(s)) if s in alive else None for s in range(4))
    return after, least, tuple(alive[s][2] if s in alive else None for s in range(4))


class Program:
    """The situations met so far and what a row makes of them, numbered."""

    def __init__(self):
        self.known: dict[tuple[Situation, Row], tuple] = {}
        self.ways: list[tuple[Way | None, ...]] = []

    def step(self, situation: Situation, row: Row) -> tuple[Situation, int, tuple, int]:
        found = self.known.get((situation, row))
        if found is None:
            found = (*advance(situation, row), len(self.ways))
            self.ways.append(found[2])
            self.known[situation, row] = found
        return found


class Pointers:
    """Numbers written one after the other and read backwards."""

    def __init__(self):
        self.open, self.sizes, self.packed = array("H"), [], None

    def append(self, number: int) -> None:
        self.open.append(number)
        if len(self.open) == BLOCK_ROWS:
            block = zlib.compress(self.open.tobytes(), 1)
            self.packed = self.packed or tempfile.SpooledTemporaryFile(max_size=SPILL_BYTES)
            self.packed.write(block)
            self.sizes.append(len(block))
            self.open = array("H")

    def backwards(self) -> Iterator[array]:
        """The blocks from the last to the first, each in order."""
        yield self.open
        end = sum(self.sizes)
        for size in reversed(self.sizes):
            end -= size
            self.packed.seek(end)
            yield array("H", zlib.decompress(self.packed.read(size)))
        if self.packed is not None:
            self.packed.close()


class Conversation:
    """A conversation as far as it has been read."""

    def __init__(self, program: Program):
        self.program, self.situation, self.cost = program, OPENING, 0
        self.pointers, self.texts = Pointers(), [hashlib.sha256(), None, None, None]
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.before: tuple | None = None

    def add(self, turn: int | None, role: str, text: str, initial: int, fault: int) -> None:
        """``fault``: 0 none, 1 blank, 2 seen at an earlier turn, 3 cut off."""
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn, self.turns = turn, self.turns + 1
        this = (turn, role, text, initial)
        if self.before is not None:
            if fault != 1 and self.before == this:
                fault = 2
            if (self.before[3], initial) not in ((0, 1), (1, 2), (2, 1)):
                self.illegal += 1
        self.before = this
        self.blank += fault == 1
        self.duplicate += fault == 2
        self.truncated += fault == 3
        row = Row(initial, fault in (1, 2), fault == 3)
        self.situation, more, ways, number = self.program.step(self.situation, row)
        self.cost += more
        self.pointers.append(number)
        old, self.texts = self.texts, [None] * 4
        for state, way in enumerate(ways):
            if way is None:
                continue
            if way.edit == "D" and not way.inserts:
                self.texts[state] = old[way.state] if state == way.state else old[way.state].copy()
                continue
            told, lines = old[way.state].copy(), []
            for _, then in list(_inserted(way.state))[1 : way.inserts + 1]:
                lines.append(f"{ROLE[then]}:")
            if way.edit != "D":
                lines.append(f"{role if way.edit == 'K' else ROLE[state]}:{text}")
            told.update(("\n" * (way.state != START) + "\n".join(lines)).encode())
            self.texts[state] = told

    def result(self) -> tuple:
        """gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
        ends = []
        for state, known in enumerate(self.situation):
            if known is not None:
                for inserts, then in _inserted(state):
                    if then in ACCEPTED:
                        ends.append((known[0] + INSERT * inserts, known[1], "I" * inserts, state))
        over, _, inserted, state = min(ends)
        told = self.texts[state]
        lines = [f"{ROLE[then]}:" for _, then in list(_inserted(state))[1 : len(inserted) + 1]]
        if lines:
            told.update(("\n" * (state != START) + "\n".join(lines)).encode())
        parts = [inserted]
        for block in self.pointers.backwards():
            letters = []
            for number in reversed(block):
                way = self.program.ways[number][state]
                letters.append(way.edit + "I" * way.inserts)
                state = way.state
            parts.append("".join(letters)[::-1])
        gaps = 0 if self.last_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        return (
            gaps, self.blank, self.duplicate, self.truncated, self.illegal,
            self.cost + over, "".join(reversed(parts)), told.hexdigest(),
        )


SCHEMA = (
    "conv string, gaps long, blank long, duplicate long, truncated long, illegal long, "
    "cost long, audit string, repaired_sha256 string"
)


def _stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [field.split()[0] for field in SCHEMA.split(", ")]
    program, now, key = Program(), None, None
    for batch in batches:
        done = []
        columns = [batch[c].tolist() for c in ("conv", "turn", "timed", "role", "text", "initial", "fault", "absent")]
        for conv, turn, timed, role, text, initial, fault, absent in zip(*columns):
            if now is None or conv != key:
                if now is not None:
                    done.append((key, *now.result()))
                now, key = Conversation(program), conv
            if not absent:
                now.add(turn if timed else None, role, text, initial, fault)
        yield pd.DataFrame(done, columns=names)
    if now is not None:
        yield pd.DataFrame([(key, *now.result())], columns=names)


def _fault(text: Column, seen: Column) -> Column:
    bare = F.rtrim(text, F.lit(BLANKS))
    cut_off = ~F.substring(bare, -1, 1).isin(*ENDS)
    return F.when(F.translate(text, BLANKS, "") == "", 1).when(seen, 2).when(cut_off, 3).otherwise(0)


def repair(conversations: DataFrame, absent: str | None = None) -> DataFrame:
    """A row per conv_id of ``conversations`` (conv_id, turn, role, text), a null one included.

    gaps: turns missing between the smallest and the largest. blank, duplicate, truncated:
    rows by their first fault, that is without a visible character, with role and text of
    an earlier row, with a last visible character other than ENDS. illegal: neighbouring
    rows whose role initials are not su, ua or au. cost and audit: the cheapest edits
    (Keep 0, Rerole, Delete, Insert; a truncated row that stays costs TRUNCATED more; blank
    and duplicate rows must go) by their initials in order, of equally cheap ones the least
    in ASCII. repaired_sha256: of the repaired rows as ``role:text``, joined by line feeds.

    Rows follow turn, nulls first, at one turn role and text; a null role or text counts as
    one space. Where the column ``absent`` is true a row only names its conversation; one
    with no other rows has zeros, no edits and the digest of an empty text. Rows that are
    quite equal count as often as they occur, all but the first as duplicates. An empty
    table gives no rows; other columns are ignored.

    Which texts a conversation repeats at a later turn is found by a grouped minimum, so that
    no task remembers a conversation's texts; Spark joins the few repeated ones back and
    splits that join where they are many.
    """
    kind = conversations.schema["conv_id"].dataType
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("text", "role"))
    away = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    rows = conversations.select(
        F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"),
        role.alias("role"), text.alias("text"), away.alias("absent"),
    )
    said = [F.coalesce("conv", F.lit("")), F.col("conv").isNull(), F.col("role"), F.col("text")]
    rows = rows.withColumns({"a": F.xxhash64(F.lit(1), *said), "b": F.xxhash64(F.lit(2), *said)})
    again = (
        rows.where(~F.col("absent"))
        .groupBy("a", "b")
        .agg(
            F.min("turn").alias("first"),
            F.max("turn").alias("last"),
            (F.count("*") > F.count("turn")).alias("untimed"),
        )
        .where(F.col("last").isNotNull() & (F.col("untimed") | (F.col("first") < F.col("last"))))
        .drop("last")
    )
    marked = rows.join(materialize(again), ["a", "b"], "left")
    seen = F.coalesce(F.col("untimed") | (F.col("turn") > F.col("first")), F.lit(False)) & F.col("turn").isNotNull()
    initial = F.instr(F.lit(INITIALS), F.substring("role", 1, 1)) - 1
    initial = F.when((F.col("role") == "") | (initial < 0), OTHER).otherwise(initial)
    ready = marked.select(
        "conv", F.coalesce("turn", F.lit(0)).alias("turn"), F.col("turn").isNotNull().alias("timed"),
        "role", "text", initial.alias("initial"), _fault(F.col("text"), seen).alias("fault"), "absent",
    )
    ordered = ready.repartition("conv").sortWithinPartitions("conv", "timed", "turn", "role", "text")
    repaired = ordered.mapInPandas(_stream, SCHEMA)
    return repaired.withColumn("conv", F.col("conv").cast(kind)).withColumnRenamed("conv", "conv_id")
