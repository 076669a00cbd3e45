"""Stretches of text that repeat with a period: runs of words, found by Baier grouping.

The first phase of Baier's suffix sorter puts the positions of a sequence into groups, from
the highest symbol down: a finished group hands its context to the nearest position on the
left that is not finished, which moves to a new group right above its old one. A position's
context is, when its group is finished, the longest Lyndon word that begins there. Done under
the symbols' order and under its reverse, this gives both Lyndon arrays and no suffix array
is needed. Every run has a Lyndon root in one of the two arrays, again at each full period;
such roots are extended to both sides as far as words one period apart are equal (the longest
common extension), which gives the run.

A run of at least LEAST words and EXPONENT periods holds each of its four-word grams at least
twice. So the sequences are first cut to the stretches in which every gram comes again in the
same stretch: whatever is cut away lies in no run, and nearly all of an ordinary text is.

A row needs nothing but itself, so there is no shuffle; a task holds the words of some ten
megabytes of text, or of one longer text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.units import slices

LEAST = 6
EXPONENT = 4
GRAM = 4
# Cutting passes at most. What they leave is searched anyway.
PASSES = 12
# Odd 64-bit multipliers that mix the words of a gram.
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)

Run = tuple[int, int, int]
#: Gives a row's words from its doc_id and the words of its text.
Words = Callable[[int | None, list[bytes]], list[bytes]]


def lyndon(symbols: np.ndarray) -> np.ndarray:
    """The length of the longest Lyndon word that begins at each position."""
    n = len(symbols)
    values, numbers = np.unique(symbols, return_inverse=True)
    by_symbol = np.argsort(numbers, kind="stable")
    members = [m.tolist() for m in np.split(by_symbol, np.cumsum(np.bincount(numbers))[:-1])] if n else []
    group, size = numbers.tolist(), [1] * len(values)
    below, above = list(range(-1, len(values) - 1)), [*range(1, len(values)), -1]
    left, done, length = list(range(-1, n - 1)), [False] * n, [0] * n
    g = len(values) - 1
    while g >= 0:
        here, context = [i for i in members[g] if group[i] == g], size[g]
        members[g] = ()
        for i in here:
            done[i] = True
            length[i] = context
        hits: dict[int, int] = {}
        for i in here:
            p = left[i]
            while p >= 0 and done[p]:
                p = left[p]
            left[i] = p
            if p >= 0:
                hits[p] = hits.get(p, 0) + 1
        moves: dict[int, dict[int, list[int]]] = {}
        for p, times in hits.items():
            moves.setdefault(group[p], {}).setdefault(times, []).append(p)
        for old, by_times in moves.items():
            at = old
            for times in sorted(by_times):
                new = len(size)
                size.append(size[old] + times * context)
                members.append(by_times[times])
                upper = above[at]
                below.append(at)
                above.append(upper)
                above[at] = new
                if upper >= 0:
                    below[upper] = new
                for p in by_times[times]:
                    group[p] = new
                at = new
        g = below[g]
    return np.array(length, np.int64)


def _equal_from(a: np.ndarray, b: np.ndarray) -> int:
    """How many elements are equal from the front on; looks at few more than that."""
    n, at, step = min(len(a), len(b)), 0, 16
    a, b = a[:n], b[:n]
    while at < n:
        differ = np.flatnonzero(a[at : at + step] != b[at : at + step])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def runs(symbols: np.ndarray, least: int = LEAST, exponent: int = EXPONENT) -> list[Run]:
    """(start, length, period) of all runs of ``least`` symbols and ``exponent`` periods (3 at least).

    In order of start and period.
    """
    n, found = len(symbols), {}
    for array in (lyndon(symbols), lyndon(-symbols)):
        # At ``exponent`` periods a Lyndon root stands at least exponent - 1 times in a row.
        at = np.flatnonzero(array * exponent <= n)
        for times in range(1, exponent - 1):
            at = at[at + times * array[at] < n]
            at = at[array[at + times * array[at]] == array[at]]
        reach: dict[int, int] = {}
        for i, p in zip(at.tolist(), array[at].tolist()):
            if i + 2 * p <= reach.get(p, 0):
                continue  # a root of the run of this period found last
            end = i + p + _equal_from(symbols[i:], symbols[i + p :])
            start = i - _equal_from(symbols[:i][::-1], symbols[: i + p][::-1])
            reach[p] = end
            if end - start >= max(least, exponent * p):
                found[start, p] = end - start
    return [(start, found[start, p], p) for start, p in sorted(found)]


def stretches(words: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """(first, end) of the parts of the sequences, one after another in ``words``, that may hold runs."""
    part = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(max(0, len(words) - GRAM + 1))
    at = at[part[at] == part[at + GRAM - 1]]
    part, codes = part[at], words.astype(np.uint64) + np.uint64(1)
    for _ in range(PASSES):
        mixed = part.astype(np.uint64)
        for k in range(GRAM):
            mixed = (mixed ^ (mixed >> np.uint64(29))) * MIX[k] + codes[at + k] * MIX[k - 1]
        _, which, times = np.unique(mixed, return_inverse=True, return_counts=True)
        kept = at[times[which] > 1]
        opens = np.diff(kept, prepend=-2) != 1
        part = np.cumsum(opens) - 1
        # Three grams in a row are the least: six equal words.
        long = np.bincount(part, minlength=1)[part] > LEAST - GRAM if len(kept) else np.zeros(0, bool)
        before, at, part = len(at), kept[long], part[long]
        if len(at) == before:
            break
    edges = np.flatnonzero(np.diff(at, prepend=-2) != 1)
    for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(at)]):
        yield int(at[i]), int(at[j - 1]) + GRAM


def _stronger(a: Run, b: Run) -> bool:
    """Whether ``a`` has more periods than ``b``."""
    return a[1] * b[2] > b[1] * a[2]


def _search(words_of: Words | None):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, size in slices(batch["text"]):
                part = batch.slice(first, size)
                texts = part["text"].cast(pa.binary()).to_pylist()
                ids = part["doc_id"].to_pylist()
                # Splits at the space and the control characters 9 to 13.
                lists = [(t or b"").split() for t in texts]
                if words_of is not None:
                    lists = [words_of(i, w) for i, w in zip(ids, lists)]
                sizes = np.array([len(w) for w in lists], np.int64)
                numbers = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(lists)))}
                flat = np.fromiter(map(numbers.__getitem__, chain.from_iterable(lists)), np.int64, int(sizes.sum()))
                ends = np.cumsum(sizes)
                found: dict[int, list[Run]] = {}
                for begin, end in stretches(flat, sizes):
                    doc = int(np.searchsorted(ends, begin, "right"))
                    shift = begin - int(ends[doc] - sizes[doc])
                    for start, length, period in runs(flat[begin:end]):
                        found.setdefault(doc, []).append((start + shift, length, period))
                out, best = [], []
                for doc, words in enumerate(lists):
                    of = sorted(found.get(doc, ()), key=lambda r: (r[0], r[2]))
                    strongest = None
                    if of:
                        keep = np.ones(len(words), bool)
                        for run in of:
                            start, length, period = run
                            keep[start + period : start + length] = False
                            if strongest is None or _stronger(run, strongest):
                                strongest = run
                        words = [words[i] for i in np.flatnonzero(keep).tolist()]
                    out.append(([dict(zip(("start", "length", "period"), r)) for r in of], b" ".join(words)))
                    best.append(strongest and dict(zip(("start", "length", "period"), strongest)))
                yield pa.RecordBatch.from_arrays(
                    [
                        part["doc_id"],
                        pa.array([r for r, _ in out], pa.list_(RUN_TYPE)),
                        pa.array(best, RUN_TYPE),
                        pa.array([c for _, c in out], pa.binary()).cast(pa.string()),
                    ],
                    ["doc_id", "runs", "strongest", "collapsed"],
                )

    return search


RUN_TYPE = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
RUN = "struct<start: long, length: long, period: long>"


def find_runs(docs: DataFrame, words_of: Words | None = None) -> DataFrame:
    """(doc_id, runs, strongest, collapsed) for every row of ``docs`` (doc_id, text).

    Words are what lies between spaces and the control characters 9 to 13, numbered from 0.
    A run is a stretch with its smallest period that no neighbouring word extends, of at
    least LEAST words and EXPONENT periods. ``runs`` has (start, length, period) of all,
    by start, then period; ``strongest`` is the one with the most periods, of equal ones the
    first in that order, null if there is none; ``collapsed`` is the words, joined by a
    space, without those that any run holds after its first period. ``words_of`` may
    change a row's words first. A null or empty text has no words and no runs, and is
    collapsed to an empty text; repeated rows come out repeatedly, a null doc_id stays
    null, an empty table gives no rows and other columns of ``docs`` are left out.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    schema = f"doc_id long, runs array<{RUN}>, strongest {RUN}, collapsed string"
    return rows.mapInArrow(_search(words_of), schema)
