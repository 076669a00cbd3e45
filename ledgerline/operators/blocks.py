"""Splitting hot keys into ordered blocks of bounded size.

Ordered operators (running session totals, as-of lookups, the stock fold) need all
rows of a key in event order, so a plain plan gives a key to one task. That is fine
for ordinary keys but not for one that holds a third of all rows. Such keys are cut
into consecutive blocks: each block is worked on alone, one small summary row per
block is carried along the key, and the carry completes the block's rows. Small blocks
share tasks: how many tasks there are goes by the rows, not by the blocks.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.session import materialize

# A key with about this many rows or more is hot; a block has about this many rows.
ROWS_PER_BLOCK = 2_000_000
# Rows a key of that size has in the sample that finds hot keys.
SAMPLED_PER_BLOCK = 2_000
# Hot keys that are broadcast, at most; more of them are joined by shuffle.
BROADCAST_KEYS = 100_000
BLOCK = "block"


class Split(NamedTuple):
    """``cold``: rows of ordinary keys. ``hot``: rows of hot keys with their block."""

    cold: DataFrame
    hot: DataFrame | None


def hot_keys(df: DataFrame, keys: Sequence[str], rows_per_block: float) -> DataFrame | None:
    """Keys of about ``rows_per_block`` rows or more with their ``rows``, or None.

    Rows are counted in a sample, since a count of all rows would shuffle nearly every
    key to find the few that matter. Where exactly the line falls changes only how
    the work is cut, never the result. The list is written as a table: there are at most
    (rows of df / rows_per_block) such keys. None are looked for if ``rows_per_block`` is
    infinite.
    """
    if math.isinf(rows_per_block):
        return None
    share = min(1.0, SAMPLED_PER_BLOCK / rows_per_block)
    rows = df.where(" and ".join(f"`{k}` is not null" for k in keys)).select(*keys)
    if share < 1:
        rows = rows.sample(share, seed=1)
    counts = (
        rows.groupBy(*keys)
        .agg((F.count(F.lit(1)) / share).cast("bigint").alias("rows"))
        .where(F.col("rows") > 0.9 * rows_per_block)
    )
    found = materialize(counts)
    return None if found.isEmpty() else found


def listed_keys(hot: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The keys of ``hot_keys`` for a join, broadcast up to BROADCAST_KEYS of them."""
    few = hot.count() <= BROADCAST_KEYS
    return F.broadcast(hot.select(*keys)) if few else hot.select(*keys)


def split_hot(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> Split:
    """Separate ordinary from hot keys and cut the latter into blocks along ``order``.

    The cut is Spark's range partitioning on (keys, order): it samples the rows, so
    blocks come out even whatever the distribution, and ``order`` being unique per key
    lets it cut anywhere. Where that many blocks would be more partitions than the rows
    need, each partition is put in order and cut after every ``rows_per_block`` rows.
    ``hot`` must be materialized (see ``session.materialize``) before it is read twice,
    since another run may cut elsewhere.
    """
    keys, order = list(keys), list(order)
    hot = hot_keys(df, keys, rows_per_block)
    if hot is None:
        return Split(df, None)
    rows = hot.agg(F.sum("rows")).first()[0]
    listed = listed_keys(hot, keys)
    blocks = max(2, math.ceil(rows / rows_per_block))
    shuffled = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = min(blocks, max(shuffled, math.ceil(rows / ROWS_PER_BLOCK)))
    blocked = df.join(listed, keys, "left_semi").repartitionByRange(tasks, *keys, *order)
    block = F.spark_partition_id().cast("bigint")
    if tasks < blocks:
        # The id has the partition above, and its rows counted in the lower 33 bits.
        id = F.monotonically_increasing_id()
        part, row = F.shiftright(id, 33), id.bitwiseAND(F.lit(2**33 - 1))
        place = F.floor(row / F.lit(rows_per_block)).cast("bigint")
        block = F.shiftleft(part, 33) + place
        blocked = blocked.sortWithinPartitions(*keys, *order)
    return Split(df.join(listed, keys, "left_anti"), blocked.withColumn(BLOCK, block))
