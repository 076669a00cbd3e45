"""As-of join: each fact meets the version of a changelog table current at its time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerline.operators.blocks import BLOCK, ROWS_PER_BLOCK, Split, split_hot
from ledgerline.session import materialize


def asof_join(
    facts: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    values: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add to each fact the ``values`` of the last change with change.ts <= fact.ts.

    An inner join: facts without a key, without an earlier change or whose last change
    is a delete (its values are null) are dropped. Changes of one instant follow
    ``seq``, and come before the facts of that instant. Both sides are read as one
    ordered sequence, so neither has to fit in memory.
    """
    parts = asof_parts(facts, changes, keys, ts, seq, values, rows_per_block)
    return parts.cold if parts.hot is None else parts.cold.unionByName(parts.hot.drop(BLOCK))


def asof_parts(
    facts: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    ts: str,
    seq: str,
    values: Sequence[str],
    rows_per_block: int = ROWS_PER_BLOCK,
) -> Split:
    """``asof_join`` with ordinary and hot keys apart, for another ordered operator.

    The parts are already placed by key, or by key and block, and can be read again.
    """
    keys, values = list(keys), list(values)
    fact_columns = [c for c in facts.columns if c not in values]
    change = changes.select(*keys, ts, seq, F.struct(*values).alias("change"))
    both = (
        facts.select(*fact_columns)
        .withColumn("kind", F.lit(1))
        .unionByName(change.withColumn("kind", F.lit(0)), allowMissingColumns=True)
        .where(" and ".join(f"`{k}` is not null" for k in keys))
    )
    # kind puts the changes of an instant before its facts.
    order = [ts, "kind", seq]
    cold, hot = split_hot(both, keys, order, rows_per_block)
    present = F.col("kind") == 1
    for value in values:
        present = present & F.col(f"change.{value}").isNotNull()
    cold = _local_asof(cold, keys, order).where(present)
    if hot is not None:
        hot = _blocked_asof(hot, keys, order).where(present)
        hot = hot.select(*fact_columns, "change.*", BLOCK)
    return Split(cold.select(*fact_columns, "change.*"), hot)


def _local_asof(df: DataFrame, group: list[str], order: list[str]) -> DataFrame:
    so_far = (
        W.partitionBy(*group)
        .orderBy(*order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return df.withColumn("change", F.last("change", ignorenulls=True).over(so_far))


def _blocked_asof(hot: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    local = materialize(_local_asof(hot, [*keys, BLOCK], order))
    before = (
        W.partitionBy(*keys)
        .orderBy(BLOCK)
        .rowsBetween(W.unboundedPreceding, -1)
    )
    carry = materialize(
        local.groupBy(*keys, BLOCK)
        .agg(F.max_by("change", F.struct(*order)).alias("tail"))
        .withColumn("carried", F.last("tail", ignorenulls=True).over(before))
        .drop("tail")
    )
    return (
        local.join(carry, [*keys, BLOCK])
        .withColumn("change", F.coalesce("change", "carried"))
        .drop("carried")
    )
