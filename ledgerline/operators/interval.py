"""Interval join: equal key, event times at most a tolerance apart."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerline.operators.times import micros, unix_micros


def interval_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_ts: str,
    right_ts: str,
    tolerance: timedelta,
    shift: timedelta = timedelta(0),
    tiled: bool = True,
) -> DataFrame:
    """All pairs with equal ``keys`` and |left_ts - right_ts| <= tolerance (inclusive).

    With ``shift`` the left time is taken that much earlier than ``left_ts`` says.
    The key columns appear once; the other columns must have distinct names. The join
    is on (key, time tile): a right row is listed in each tile its interval touches
    (one or two), a left row lies in one tile, so each pair meets exactly once. A hot
    key thus spreads over its tiles, and rows far apart in time are never paired. Two
    streams need watermarks on both times, which bound the rows Spark remembers.

    ``tiled=False`` is for keys with few rows each, such as ids: the join is then on the key
    alone and shares its partitioning with what else is done by key.
    """
    keys = list(keys)
    near = F.col(right_ts).between(
        F.col(left_ts) - F.lit(shift + tolerance), F.col(left_ts) + F.lit(tolerance - shift)
    )
    if not tiled:
        return left.join(right, keys).where(near)
    # Twelve tolerances wide, a second at least: about one right row in six touches a second tile.
    width = max(12 * micros(tolerance), 1_000_000)

    def tile(ts: Column) -> Column:
        return F.floor(ts / F.lit(width))

    at = unix_micros(right_ts)
    touched = F.sequence(tile(at - micros(tolerance)), tile(at + micros(tolerance)))
    tiled_left = left.withColumn("tile", tile(unix_micros(left_ts) - micros(shift)))
    tiled_right = right.withColumn("tile", F.explode(touched))
    return tiled_left.join(tiled_right, keys + ["tile"]).where(near).drop("tile")
