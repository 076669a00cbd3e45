"""Ordered keyed fold: a state threaded through a key's rows in event order.

Used where a row's effect depends on what earlier rows were granted, so that no
window sum expresses it. Ordinary keys are folded in one group each. A hot key is cut
into blocks which are folded side by side: the state a block starts from is first
guessed from the blocks before it and then corrected until every block is known to
have started from its true state, so the result is exact whatever the guesses were.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterable, Sequence
from operator import index
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.operators.blocks import BLOCK, ROWS_PER_BLOCK, Split, split_hot
from ledgerline.session import materialize

# Workers get this module's code with each task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Rows that a reservation decides at once.
STRETCH = 1 << 14
# State bounds of a piece that reaches without limit.
LOWEST, HIGHEST = -(2**62), 2**62


class Piece(NamedTuple):
    """Start states low..high on which a block changes the state by ``shift``."""

    low: int
    high: int
    shift: int


class Fold(Protocol):
    """An integer state folded over the rows of a key."""

    start: int
    columns: Sequence[str]
    result: T.DataType

    def run(self, state: int, *columns: pa.ChunkedArray) -> tuple[Sequence, Piece]:
        """Each row's result, and the piece around ``state`` with the same results."""

    def probes(self, *columns: pa.ChunkedArray) -> Iterable[int]:
        """Start states worth trying when the true one is not known yet."""


class StockReservation:
    """Reserve ``quantity`` where it still fits into ``stock``, else refuse the row.

    The state is the quantity reserved so far; a refused row reserves nothing, and a
    negative quantity gives stock back. A row is granted iff
    stock - reserved - quantity >= 0, so its headroom is stock - quantity. With
    ``positive_only`` a row whose quantity is not positive is refused.
    """

    start = 0
    columns = ("stock", "quantity")
    result = T.BooleanType()

    def __init__(self, positive_only: bool = False):
        self.positive_only = positive_only

    def _headroom(self, stock, quantity):
        stock, quantity = (np.asarray(c).astype(np.int64) for c in (stock, quantity))
        headroom = stock - quantity
        if self.positive_only:
            headroom[quantity <= 0] = LOWEST
        return headroom, stock, quantity

    def run(self, state, stock, quantity):
        headroom, _, quantity = self._headroom(stock, quantity)
        granted = self._granted(state, headroom, quantity)
        taken = np.where(granted, quantity, 0)
        before = state + np.cumsum(taken) - taken
        # The same rows are granted as long as no row changes sides.
        up = headroom[granted] - before[granted]
        down = before[~granted] - headroom[~granted] - 1
        high = state + int(up.min()) if up.size else HIGHEST
        low = state - int(down.min()) if down.size else LOWEST
        return granted, Piece(low, high, int(taken.sum()))

    @staticmethod
    def _granted(state, headroom, quantity):
        """Which rows fit, found for all rows of a stretch at once.

        A row surely fits if it does with everything undecided before it that takes stock
        granted, and surely not if it does not with everything that gives some back. Each
        row decided narrows that for those after it. The first undecided row is always
        decided; where rounds decide few rows the rest is gone through one by one.
        """
        granted = np.zeros(len(headroom), dtype=bool)
        for at in range(0, len(headroom), STRETCH):
            room, wanted = headroom[at : at + STRETCH], quantity[at : at + STRETCH]
            here = granted[at : at + STRETCH]
            open_rows, before = np.arange(len(room)), np.full(len(room), state, np.int64)
            while len(open_rows):
                r, q = room[open_rows], wanted[open_rows]
                more, less = np.maximum(q, 0), np.minimum(q, 0)
                fits = r >= before + np.cumsum(more) - more
                open_next = ~fits & (r >= before + np.cumsum(less) - less)
                here[open_rows[fits]] = True
                taken = np.where(fits, q, 0)
                before = (before + np.cumsum(taken) - taken)[open_next]
                decided, open_rows = len(open_rows), open_rows[open_next]
                if len(open_rows) * 8 > decided * 7:
                    one_by_one(open_rows, before, room, wanted, here)
                    break
            state += int(wanted[here].sum())
        return granted

    def probes(self, stock, quantity):
        headroom, stock, quantity = self._headroom(stock, quantity)
        everything_fits = int((headroom - np.cumsum(quantity) + quantity).min())
        nothing_fits = int(headroom.max()) + 1
        sold_out = min(max(int(stock[0]), everything_fits), nothing_fits)
        middle = (everything_fits + nothing_fits) // 2
        return (everything_fits, nothing_fits, sold_out, middle)


def one_by_one(open_rows, before, room, wanted, granted) -> None:
    """Decide the undecided rows in order; ``before`` is the state that decided rows lead to."""
    extra = 0
    values = (open_rows, before, room[open_rows], wanted[open_rows])
    for i, state, r, q in zip(*(v.tolist() for v in values)):
        if state + extra <= r:
            granted[i] = True
            extra += q


class RowFold:
    """A fold given as ``step(state, *values) -> (state, result)`` for one row.

    Values are of any type, null is None; the state is an integer. A step says nothing
    about other start states, so a hot key's blocks can only be told apart from the states
    they were tried with: where states do not run together soon, that takes a round per
    block. A ``Fold`` that knows its pieces needs few, and ``custom.transform`` goes along a
    key in one task, with states of any type.
    """

    def __init__(
        self,
        columns: Sequence[str],
        step: Callable[..., tuple[int, object]],
        result: T.DataType,
        start: int = 0,
        guesses: Sequence[int] = (),
    ):
        self.columns, self.step, self.result = columns, step, result
        # Other states than integers are an error.
        self.start = index(start)
        self.guesses = (self.start, *map(index, guesses))

    def run(self, state, *columns):
        first, results = state, []
        for values in zip(*(c.to_pylist() for c in columns)):
            state, result = self.step(state, *values)
            state = index(state)
            results.append(result)
        return results, Piece(first, first, state - first)

    def probes(self, *columns):
        return self.guesses


def ordered_fold(
    rows: DataFrame | Split,
    keys: Sequence[str],
    order: Sequence[str],
    fold: Fold,
    column: str,
    rows_per_block: int = ROWS_PER_BLOCK,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``column``: the fold's result for each row, per key in ``order``.

    Rows without a key are left out, ``StockReservation`` takes no nulls. ``rows`` may be
    split already, by an ordered operator before this one; its parts must be readable
    again. ``starts`` has the columns keys and ``start``: the state of keys that do not
    begin at ``fold.start``.
    """
    keys, order = list(keys), list(order)
    if isinstance(rows, DataFrame):
        present = " and ".join(f"`{k}` is not null" for k in keys)
        rows = split_hot(rows.where(present), keys, order, rows_per_block)
        if rows.hot is not None:
            rows = rows._replace(hot=materialize(rows.hot))
    columns = rows.cold.columns
    schema = T.StructType([*rows.cold.schema.fields, T.StructField(column, fold.result)])
    result_type = to_arrow_type(fold.result)

    def apply(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        state = table.column("start")[0].as_py()
        results, _ = fold.run(state, *_columns(table, fold.columns))
        return table.select(columns).append_column(column, pa.array(results, result_type))

    start = F.lit(fold.start).cast("bigint")
    if starts is None:
        cold = rows.cold.withColumn("start", start)
    else:
        cold = rows.cold.join(starts.select(*keys, "start"), keys, "left").withColumn(
            "start", F.coalesce("start", start)
        )
    folded = cold.groupBy(*keys).applyInArrow(apply, schema)
    if rows.hot is None:
        return folded
    group = [*keys, BLOCK]
    solved = _solve(rows.hot, keys, order, fold, starts)
    blocks = rows.hot.join(solved, group).groupBy(*group).applyInArrow(apply, schema)
    return folded.unionByName(blocks)


def _columns(table: pa.Table, columns: Sequence[str]) -> list[pa.ChunkedArray]:
    return [table.column(c) for c in columns]


def _solve(
    hot: DataFrame,
    keys: list[str],
    order: list[str],
    fold: Fold,
    starts: DataFrame | None,
) -> DataFrame:
    """The true start state of every block, as rows (keys, block, start).

    Blocks report their pieces, and a task per key follows these from block to block: a
    few small rows per block. The driver learns only whether blocks are still open.
    """
    group = [*keys, BLOCK]
    hot = hot.select(*dict.fromkeys([*group, *order, *fold.columns]))
    fields = [hot.schema[c] for c in group]
    start_schema = T.StructType(
        [*fields, T.StructField("start", T.LongType()), T.StructField("open", T.BooleanType())]
    )
    piece_schema = T.StructType(
        [*fields] + [T.StructField(name, T.LongType()) for name in Piece._fields]
    )

    def pieces(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        columns = _columns(table, fold.columns)
        if "start" in table.column_names:
            states = {table.column("start")[0].as_py()}
        else:
            states = {int(state) for state in fold.probes(*columns)}
        found = [fold.run(state, *columns)[1] for state in sorted(states)]
        same = table.select(group).slice(0, 1)
        return pa.concat_tables([same] * len(found)).append_column(
            "low", pa.array([p.low for p in found], pa.int64())
        ).append_column("high", pa.array([p.high for p in found], pa.int64())).append_column(
            "shift", pa.array([p.shift for p in found], pa.int64())
        )

    def walk(table: pa.Table) -> pa.Table:
        blocks: dict[int, list[Piece]] = {}
        for block, *piece in zip(*(table.column(c).to_pylist() for c in (BLOCK, *Piece._fields))):
            blocks.setdefault(block, []).append(Piece(*piece))
        state = table.column("begin")[0].as_py()
        begins, still_open = [], []
        for block in sorted(blocks):
            begins.append(state)
            piece = _covering(blocks[block], state)
            still_open.append(piece is None)
            if piece is None:
                # Go on from the nearest known piece: a guess, checked next round.
                piece = min(blocks[block], key=lambda p: max(p.low - state, state - p.high))
                state = min(max(state, piece.low), piece.high)
            state += piece.shift
        same = table.select(keys).slice(0, 1)
        return pa.concat_tables([same] * len(begins)).append_column(
            BLOCK, pa.array(sorted(blocks), table.schema.field(BLOCK).type)
        ).append_column("start", pa.array(begins, pa.int64())).append_column(
            "open", pa.array(still_open, pa.bool_())
        )

    def learned(rows: DataFrame) -> DataFrame:
        return materialize(rows.groupBy(*group).applyInArrow(pieces, piece_schema))

    begin = F.lit(fold.start).cast("bigint")
    known = learned(hot)
    while True:
        placed = known
        if starts is not None:
            placed = known.join(starts.select(*keys, F.col("start").alias("begin")), keys, "left")
            placed = placed.withColumn("begin", F.coalesce("begin", begin))
        else:
            placed = known.withColumn("begin", begin)
        walked = materialize(placed.groupBy(*keys).applyInArrow(walk, start_schema))
        if walked.where("open").isEmpty():
            return walked.drop("open")
        # The first open block of each key has its true state, so each round settles it.
        known = known.unionByName(learned(hot.join(walked.where("open").drop("open"), group)))


def _covering(pieces: list[Piece], state: int) -> Piece | None:
    return next((p for p in pieces if p.low <= state <= p.high), None)
