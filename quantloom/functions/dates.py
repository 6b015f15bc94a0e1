"""Date column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def rebalance_key(date: Column, frequency: str) -> Column:
    """Changes with the day, the month or the ISO week of ``date``."""
    if frequency == "DAILY":
        return F.date_format(date, "yyyy-MM-dd")
    if frequency == "MONTHLY":
        return F.date_format(date, "yyyy-MM")
    if frequency == "WEEKLY":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), date).cast("string"), F.lit("-"), F.weekofyear(date).cast("string"))
    raise ValueError(f"unknown frequency {frequency}")


def is_weekday(date: Column) -> Column:
    return F.weekday(date) < 5


def holding_days(start: Column, end: Column) -> Column:
    return F.greatest(F.datediff(end, start), F.lit(0))


def years_between(start: Column, end: Column) -> Column:
    return F.greatest(F.datediff(end, start), F.lit(1)) / 365.25


def parse_time(text: Column, *formats: str) -> Column:
    """The first of the formats that fits."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def from_millis(ms: Column) -> Column:
    return F.timestamp_millis(ms.cast("long"))
