"""Near-duplicate vectors by pivots and the cells around them; exact.

Pivots are vectors of the table itself: a bounded sample, the rows with the smallest
hashes of their values, of which those are taken that are far from all taken before. So a
large family of near vectors has one pivot, not pivots in proportion. Each vector lives in
the list of its nearest pivot (per label). It is also sent to the list of every other pivot
whose cell may hold a near vector: between two cells lies the plane halfway between their
pivots, and a vector farther from it than near vectors can be apart has none beyond. In
crowded regions that rules out nearly all other cells; vectors scattered in many dimensions
are compared with all others of their label, whose number then counts squared. No pair is
left out. Pairs are compared in double precision. Equal vectors are one.

A cell of more than BLOCK vectors is cut into blocks, and every pair of blocks, of one cell
or of two, is a task of its own. Of a pair of blocks come counts per vector and a spanning
set of links, not pairs.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.components import components
from ledgerline.session import materialize

COSINE = 0.93
NEAREST = 8
MIN_SHARED = 2
# Pivots: PIVOTS_PER_ROOT per square root of the vectors, at most MAX_PIVOTS (2 MB of 64
# doubles). Of a label as many are used as its vectors fill blocks.
PIVOTS_PER_ROOT = 4
MIN_PIVOTS = 32
MAX_PIVOTS = 4096
# The cosine of two pivots is at most this.
PIVOTS_COSINE = 0.7
BLOCK = 4096
# Rows of a block that are compared at once.
STRIP = 512


def _unit(values: list | None) -> np.ndarray | None:
    """The vector with length 1, or None if it can link with nothing."""
    if not values or None in values:
        return None
    v = np.asarray(values, np.float64)
    if not np.isfinite(v).all():
        return None
    top = np.abs(v).max()
    if top == 0:
        return None
    v = v / top  # so that squares neither overflow nor vanish
    return v / np.sqrt(v @ v)


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        units = [_unit(v) for v in batch["embedding"].to_pylist()]
        units = [u if label is not None else None for u, label in zip(units, batch["label"].to_pylist(), strict=True)]
        raw = [None if u is None else (u + 0.0).astype("<f8").tobytes() for u in units]
        names = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in raw]
        dims = [None if u is None else len(u) for u in units]
        yield pa.RecordBatch.from_arrays(
            [batch["vec_id"], batch["label"], pa.array(dims, pa.int32()), pa.array(names, pa.binary()), pa.array(raw, pa.binary())],
            ["vec_id", "label", "dims", "name", "unit"],
        )


def _matrix(raw: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)


def _far_apart(sample: np.ndarray) -> np.ndarray:
    """Rows of the sample, in order, that are far from all taken before."""
    taken = np.empty_like(sample)
    n = 0
    for unit in sample:
        if n == 0 or (taken[:n] @ unit).max() <= PIVOTS_COSINE:
            taken[n] = unit
            n += 1
    return taken[:n]


def _cells(pivots, cosine: float, block: int):
    """With each vector its cell, and all cells that may hold a near vector."""
    # Between vectors at the least cosine; a little more than rounding can take away.
    apart = np.sqrt(max(0.0, 2 - 2 * cosine)) + 1e-6

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        between = {d: np.sqrt(np.maximum(2 - 2 * refs @ refs.T, 1e-12)) for d, refs in pivots.value.items()}
        for batch in batches:
            # As many pivots as the vectors of this label and length fill blocks.
            dims, needed = batch["dims"].to_numpy(), -(-batch["n"].to_numpy() // block)
            for d, n in {*zip(dims.tolist(), needed.tolist(), strict=True)}:
                at = np.flatnonzero((dims == d) & (needed == n))
                part = batch.take(pa.array(at))
                refs = pivots.value.get(d, np.eye(1, d))[:n]
                cosines = _matrix(part["unit"].to_pylist()) @ refs.T
                home = cosines.argmax(axis=1)
                beyond = cosines.max(axis=1, keepdims=True) - cosines
                may = beyond <= apart * between[d][home, : len(refs)] if len(refs) > 1 else beyond <= 0
                may[np.arange(len(at)), home] = True
                others = [np.flatnonzero(x).astype(np.int32) for x in may]
                yield pa.RecordBatch.from_arrays(
                    [part[c] for c in ("label", "dims", "rep", "copies", "unit")]
                    + [pa.array(home.astype(np.int32)), pa.array(others, pa.list_(pa.int32()))],
                    ["label", "dims", "rep", "copies", "unit", "home", "others"],
                )

    return cells


def _compare(cosine: float):
    """Counts and spanning links of one pair of blocks."""

    def compare(key: tuple, table: pa.Table) -> pa.Table:
        a, b, i, j = (k.as_py() for k in key[2:])
        side = table["side"].to_numpy()
        rep, copies = table["rep"].to_numpy(), table["copies"].to_numpy()
        units = _matrix(table["unit"].to_pylist())
        whole = a == b and i == j
        left = np.arange(len(rep)) if whole else np.flatnonzero(side == 0)
        right = left if whole else np.flatnonzero(side == 1)
        strips = [slice(k, k + STRIP) for k in range(0, len(left), STRIP)]
        near = np.empty((len(left), len(right)), bool)
        for s in strips:
            near[s] = units[left[s]] @ units[right].T >= cosine
        if whole:
            np.fill_diagonal(near, False)
        # Only rows with a link go on.
        rows, columns = near.any(axis=1), near.any(axis=0)
        left, right, near = left[rows], right[columns], near[np.ix_(rows, columns)]
        strips = [slice(k, k + STRIP) for k in range(0, len(left), STRIP)]
        counts = np.zeros(len(rep), np.int64)
        for s in strips:
            counts[left[s]] += near[s] @ copies[right]
            if not whole:
                counts[right] += near[s].T @ copies[left[s]]
        # The smallest vector each can reach inside these blocks.
        reach, big = rep.copy(), np.iinfo(np.int64).max
        while True:
            new = reach.copy()
            for s in strips:
                to = np.where(near[s], reach[right][None, :], big).min(axis=1, initial=big)
                back = np.where(near[s], reach[left[s]][:, None], big).min(axis=0, initial=big)
                np.minimum.at(new, left[s], to)
                np.minimum.at(new, right, back)
            if (new == reach).all():
                break
            reach = new
        at = np.flatnonzero(counts)
        return pa.table({"rep": rep[at], "links": counts[at], "root": reach[at]})

    return compare


def near_vectors(
    vectors: DataFrame,
    cosine: float = COSINE,
    nearest: int = NEAREST,
    min_shared: int = MIN_SHARED,
    pivots: int | None = None,
    block: int = BLOCK,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors``.

    ``vectors`` has an integer vec_id, embedding (numbers) and label. Vectors link if
    their labels and lengths are equal and the cosine is at least ``cosine``. A null
    label, a null, empty or zero vector, or one with null or non-finite components links
    with nothing. ``nearest`` and ``min_shared`` once told which pairs to pass over; none is
    now, and they change nothing. At most ``pivots`` vectors are pivots. Rows that repeat a vec_id are vectors of their own which count as links
    of each other if equal; a row without vec_id counts as a link but has no component.
    """
    spark = vectors.sparkSession
    described = materialize(
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
        .mapInArrow(_units, "vec_id long, label string, dims int, name binary, unit binary")
    )
    usable = described.where("name is not null")
    distinct = materialize(
        usable.groupBy("label", "name").agg(
            F.min("vec_id").alias("rep"),
            F.count("*").alias("copies"),
            F.first("dims").alias("dims"),
            F.first("unit").alias("unit"),
        ).where("rep is not null")
    )
    if pivots is None:
        pivots = math.ceil(PIVOTS_PER_ROOT * math.sqrt(distinct.count()))
        pivots = min(MAX_PIVOTS, max(MIN_PIVOTS, pivots))
    sample = distinct.select("dims", "name", "unit").orderBy(F.xxhash64("name"), "name").limit(pivots)
    sampled: dict[int, list[bytes]] = {}
    for row in sample.collect():
        sampled.setdefault(row.dims, []).append(bytes(row.unit))
    references = {dims: _far_apart(_matrix(raw)) for dims, raw in sampled.items()}
    of = ["label", "dims"]
    cells = materialize(
        distinct.join(distinct.groupBy(of).agg(F.count("*").alias("n")), of).mapInArrow(
            _cells(spark.sparkContext.broadcast(references), cosine, block),
            "label string, dims int, rep long, copies long, unit binary, home int, others array<int>",
        )
    )
    sizes = cells.groupBy(*of, "home").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).where("blocks > 1")
    theirs = sizes.select(*of, F.col("home").alias("other"), F.col("blocks").alias("their_blocks"))
    # A row in block ``own`` of its cell goes to the pairs with every block of the other;
    # within a cell to (0, own) .. (own, own) .. (own, last).
    first = F.when(F.col("home") == F.col("other"), F.col("own") <= F.col("block")).otherwise(F.col("home") < F.col("other"))
    pairs = (
        cells.withColumn("other", F.explode("others"))
        .join(sizes, [*of, "home"], "left")
        .join(theirs, [*of, "other"], "left")
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.coalesce("blocks", F.lit(1))).cast("int"))
        .withColumn("block", F.explode(F.sequence(F.lit(0), F.coalesce("their_blocks", F.lit(1)) - 1)))
        .select(
            *of,
            F.least("home", "other").alias("a"),
            F.greatest("home", "other").alias("b"),
            F.when(first, F.col("own")).otherwise(F.col("block")).alias("i"),
            F.when(first, F.col("block")).otherwise(F.col("own")).alias("j"),
            F.when(first, F.lit(0)).otherwise(F.lit(1)).alias("side"),
            "rep", "copies", "unit",
        )
    )
    found = materialize(
        pairs.groupBy(*of, "a", "b", "i", "j").applyInArrow(_compare(cosine), "rep long, links long, root long")
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    named = (
        distinct.join(links, "rep", "left")
        .join(groups, F.col("rep") == F.col("node"), "left")
        .select(
            "label",
            "name",
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"),
            F.coalesce("component", "rep").alias("component"),
        )
    )
    return (
        described.join(named, ["label", "name"], "left")
        .select(
            "vec_id",
            F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
            F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"),
        )
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )
