"""Time expressions over TIMESTAMP_NTZ columns and an explicit ``as_of``."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F


def ntz(moment: datetime | str) -> Column:
    """A foldable TIMESTAMP_NTZ literal, so that comparisons reach the file scan."""
    text = moment if isinstance(moment, str) else moment.isoformat(sep=" ")
    return F.lit(text).cast("timestamp_ntz")


def midnight(moment: datetime) -> datetime:
    return moment.replace(hour=0, minute=0, second=0, microsecond=0)


def days_before(moment: datetime, days: int) -> datetime:
    """Midnight of the day that lies ``days`` before ``moment``."""
    return midnight(moment - timedelta(days=days))


def within_year(column: Column, year: int) -> Column:
    """Half-open range instead of ``year(column) = year``: ranges are pushed to the scan."""
    return (column >= ntz(datetime(year, 1, 1))) & (column < ntz(datetime(year + 1, 1, 1)))


def on_day(column: Column, day: datetime) -> Column:
    start = midnight(day)
    return (column >= ntz(start)) & (column < ntz(start + timedelta(days=1)))


def micros(moment: Column) -> Column:
    """Microseconds since 1970, taking the zone-less time as UTC."""
    return F.timestamp_diff("MICROSECOND", ntz("1970-01-01 00:00:00"), moment)


def countdown(start: Column, as_of: datetime) -> Column:
    """``3d 4h 5m`` until ``start``; the day part is left out when zero."""
    seconds = F.timestamp_diff("SECOND", ntz(as_of), start)
    days = F.floor(seconds / 86400)
    hours = F.floor(F.pmod(seconds, F.lit(86400)) / 3600)
    minutes = F.floor(F.pmod(seconds, F.lit(3600)) / 60)
    text = F.concat(
        F.when(days > 0, F.concat(days.cast("string"), F.lit("d "))).otherwise(F.lit("")),
        hours.cast("string"), F.lit("h "), minutes.cast("string"), F.lit("m"),
    )
    return F.when(start < ntz(as_of), F.lit("Event Started")).otherwise(text)
