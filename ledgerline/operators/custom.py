"""Operators that run a user's functions: transformers with state, reducers, session aggregates.

Rows come to a task by key and in order, and the functions go along them as Arrow batches
arrive, so that no key's rows are held at once. States and records are values of any Spark
type: structs are dicts, null is None.

A transformer's step says nothing about states other than the one it is given, so a key is
one task's work from row to row. Reducers and session aggregates have a merge, and there a
hot key is spread: each part of it becomes one record, or one per session, before records
of different parts meet.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Mapping, Sequence
from datetime import timedelta
from itertools import repeat
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ledgerline.operators.blocks import BLOCK, ROWS_PER_BLOCK, split_hot
from ledgerline.operators.times import micros, unix_micros
from ledgerline.session import materialize

# Workers get this module's code with each task and need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# What a transformer adds besides its result.
STATE, LAST = "state", "last"
_START, _STARTED = "start_state", "has_start_state"


class Transformer(NamedTuple):
    """``step(state, *values of columns) -> (state, result)``, from the state ``start``."""

    columns: Sequence[str]
    step: Callable[..., tuple[Any, Any]]
    start: Any
    state: T.DataType
    result: T.DataType


class SessionAggregate(NamedTuple):
    """``add(state, *values of columns)`` from ``start``, and ``merge(earlier, later)`` of two states."""

    columns: Sequence[str]
    start: Any
    add: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    state: T.DataType


def _values(batch: pa.RecordBatch, columns: Sequence[str]) -> Iterator[tuple]:
    if not columns:
        return repeat((), batch.num_rows)
    return zip(*[batch[c].to_pylist() for c in columns])


def _present(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.where(" and ".join(f"`{c}` is not null" for c in columns))


def transform(
    rows: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    transformer: Transformer,
    column: str,
    starts: DataFrame | None = None,
) -> DataFrame:
    """Add ``column``, the step's result for each row, per key in ``order``.

    A key's last row also has its state after it, as ``state``, and true as ``last``. Rows
    without a key are left out. ``starts`` (keys, state) is where keys begin that do not
    begin at ``start``: what an earlier run left.
    """
    keys, order = list(keys), list(order)
    kept = rows.columns
    rows = _present(rows, keys)
    if starts is None:
        none = F.lit(None).cast(transformer.state)
        rows = rows.withColumns({_START: none, _STARTED: F.lit(False)})
    else:
        known = starts.select(*keys, F.col(STATE).alias(_START), F.lit(True).alias(_STARTED))
        rows = rows.join(known, keys, "left").withColumn(_STARTED, F.coalesce(_STARTED, F.lit(False)))
    types = to_arrow_type(transformer.result), to_arrow_type(transformer.state)

    def told(part: pa.RecordBatch, results: list, states: list, ends: list) -> pa.RecordBatch:
        arrays = [*(part[c] for c in kept), pa.array(results, types[0])]
        shown = [s if end else None for s, end in zip(states, ends)]
        arrays += [pa.array(shown, types[1]), pa.array(ends, pa.bool_())]
        return pa.RecordBatch.from_arrays(arrays, [*kept, column, STATE, LAST])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, held = None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            results, states, ends = [], [], []
            begins = zip(batch[_START].to_pylist(), batch[_STARTED].to_pylist())
            for name, values, (begin, begun) in zip(_values(batch, keys), _values(batch, transformer.columns), begins):
                if name != key:
                    if ends:
                        ends[-1] = True
                    elif held is not None:
                        held[3][0] = True
                    key, state = name, begin if begun else transformer.start
                state, result = transformer.step(state, *values)
                results.append(result)
                states.append(state)
                ends.append(False)
            if held is not None:
                yield told(*held)
            # Whether the last row is its key's last one only the next batch tells.
            n = batch.num_rows - 1
            yield told(batch.slice(0, n), results[:n], states[:n], ends[:n])
            held = batch.slice(n), results[n:], states[n:], ends[n:]
        if held is not None:
            held[3][0] = True
            yield told(*held)

    schema = T.StructType(
        [
            *rows.select(*kept).schema.fields,
            T.StructField(column, transformer.result),
            T.StructField(STATE, transformer.state),
            T.StructField(LAST, T.BooleanType()),
        ]
    )
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def reduce_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    record: Mapping[str, Column],
    merge: Callable[[dict, dict], dict],
) -> DataFrame:
    """(keys, the columns of ``record``): each key's records merged in ``order``.

    ``record`` makes a row a record, and ``merge(earlier, later)`` two records one; it is
    associative, but need not commute. Rows are dealt by ranges of (keys, order), which cut
    through hot keys, and each task merges its stretch of a key before anything is shuffled
    by key: then at most one record per key and task. Rows without a key are left out.
    """
    keys, order, names = list(keys), list(order), list(record)
    places = [f"place_{i}" for i in range(len(order))]
    rows = _present(df, keys).select(
        *keys, *[F.col(o).alias(p) for o, p in zip(order, places)],
        *[value.alias(name) for name, value in record.items()],
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, record, first = None, None, None
        for batch in batches:
            done = []
            fields = zip(_values(batch, keys), _values(batch, places), _values(batch, names))
            for name, place, values in fields:
                new = dict(zip(names, values))
                if name == key:
                    record = merge(record, new)
                    continue
                if key is not None:
                    done.append((*key, *first, *(record[n] for n in names)))
                key, first, record = name, place, new
            yield out(done)
        if key is not None:
            yield out([(*key, *first, *(record[n] for n in names))])

    schema = rows.schema
    types = [to_arrow_type(f.dataType) for f in schema.fields]

    def out(done: list[tuple]) -> pa.RecordBatch:
        columns = zip(*done) if done else repeat((), len(types))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], schema.names)

    along = [*keys, *places]
    parts = rows.repartitionByRange(*along).sortWithinPartitions(*along).mapInArrow(run, schema)
    merged = parts.repartition(*keys).sortWithinPartitions(*along).mapInArrow(run, schema)
    return merged.select(*keys, *names)


def session_fold(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    gap: timedelta,
    aggregate: SessionAggregate,
    name: str,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """A row per key and session: first_ts, last_ts and the user's aggregate as ``name``.

    Rows are added in order of (ts, seq); a row more than ``gap`` after the one before it
    opens a session. Hot keys are cut into blocks: each gives its sessions' states, and
    only its first and last session, that neighbouring blocks may reach into, are merged
    along the key. Rows without a key or event time belong to no session.
    """
    keys, width = list(keys), micros(gap)
    rows = _present(df, [*keys, ts]).select(
        *keys, unix_micros(ts).alias("at"), F.col(seq).alias("seq"),
        *[F.col(c).alias(f"value_{i}") for i, c in enumerate(aggregate.columns)],
    )
    values = [f"value_{i}" for i in range(len(aggregate.columns))]
    state_type = to_arrow_type(aggregate.state)
    times = [T.StructField(c, T.LongType()) for c in ("first_at", "last_at")]
    extra = [T.StructField(name, aggregate.state), T.StructField("edge", T.BooleanType())]

    def schema(group: list[str]) -> T.StructType:
        fields = [T.StructField(BLOCK, T.LongType()) if c == BLOCK else rows.schema[c] for c in group]
        return T.StructType([*fields, *times, *extra])

    def walk(group: list[str], pieces, begin_with, join):
        """Goes along pieces (from, to, piece) of groups: a session's first, and each after it."""
        names = [*group, "first_at", "last_at", name, "edge"]
        types = [*(to_arrow_type(schema(group)[c].dataType) for c in group), pa.int64(), pa.int64(), state_type, pa.bool_()]

        def out(done: list[list]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*[(*d[0], *d[1:]) for d in done])] if done else [[]] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = None  # [group, first, last, state, whether a group's first or last session]
            for batch in batches:
                done = []
                for key, (begin, end, piece) in zip(_values(batch, group), pieces(batch)):
                    if now is not None and now[0] == key and begin - now[2] <= width:
                        now[2], now[3] = max(now[2], end), join(now[3], piece)
                        continue
                    same = now is not None and now[0] == key
                    if now is not None:
                        now[4] = now[4] or not same
                        done.append(now)
                    now = [key, begin, end, begin_with(piece), not same]
                yield out(done)
            if now is not None:
                now[4] = True
                yield out([now])

        return run

    def rows_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        at = batch["at"].to_pylist()
        return zip(at, at, _values(batch, values))

    def add(state: Any, piece: tuple) -> Any:
        return aggregate.add(state, *piece)

    def opened(piece: tuple) -> Any:
        return aggregate.add(aggregate.start, *piece)

    def sessions(part: DataFrame, group: list[str]) -> DataFrame:
        ordered = part.repartition(*group).sortWithinPartitions(*group, "at", "seq")
        return ordered.mapInArrow(walk(group, rows_of, opened, add), schema(group))

    def parts_of(batch: pa.RecordBatch) -> Iterator[tuple]:
        return zip(batch["first_at"].to_pylist(), batch["last_at"].to_pylist(), batch[name].to_pylist())

    def told(part: DataFrame) -> DataFrame:
        bounds = [F.timestamp_micros(f"{c}_at").alias(f"{c}_ts") for c in ("first", "last")]
        return part.select(*keys, *bounds, name)

    cold, hot = split_hot(rows, keys, ["at", "seq"], rows_per_block)
    result = told(sessions(cold, keys))
    if hot is None:
        return result
    blocks = materialize(sessions(hot.select(*rows.columns, BLOCK), [*keys, BLOCK]))
    edges = blocks.where("edge").repartition(*keys).sortWithinPartitions(*keys, BLOCK, "first_at")
    merged = edges.select(*keys, "first_at", "last_at", name).mapInArrow(walk(keys, parts_of, lambda piece: piece, aggregate.merge), schema(keys))
    return result.unionByName(told(blocks.where("not edge"))).unionByName(told(merged))
