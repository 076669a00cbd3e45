"""Small helpers for event times and durations."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def micros(duration: timedelta) -> int:
    return duration // timedelta(microseconds=1)


def interval_text(duration: timedelta) -> str:
    return f"{micros(duration)} microseconds"


def unix_micros(column: str) -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))
