"""Timestamps out of log text. A value that cannot be read gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def syslog_time(month: Column, day: Column, clock: Column, as_of: Column) -> Column:
    """Month, day and clock without a year.

    The year is that of ``as_of``; a result more than a day in its future
    belongs to the year before.
    """
    text = F.concat_ws(" ", F.year(as_of).cast("string"), month, day, clock)
    this_year = F.try_to_timestamp(text, F.lit("yyyy MMM d HH:mm:ss"))
    text_before = F.concat_ws(" ", (F.year(as_of) - 1).cast("string"), month, day, clock)
    year_before = F.try_to_timestamp(text_before, F.lit("yyyy MMM d HH:mm:ss"))
    future = this_year > as_of + F.expr("INTERVAL 24 HOURS")
    return F.when(future | this_year.isNull(), year_before).otherwise(this_year)


def audit_time(line: Column) -> Column:
    """``audit(seconds.millis:serial)`` to a timestamp."""
    seconds = F.regexp_extract(line, r"audit\((\d+)", 1)
    millis = F.rpad(F.left(F.regexp_extract(line, r"audit\(\d+\.(\d+)", 1), F.lit(3)), 3, "0")
    total = seconds.try_cast("long") * 1000 + F.coalesce(millis.try_cast("long"), F.lit(0))
    return F.timestamp_millis(total)


def epoch_time(value: Column) -> Column:
    """Digits are microseconds, milliseconds or seconds by size; other text is ISO."""
    text = F.trim(value)
    number = F.when(text.rlike(r"^\d+$"), text.try_cast("long"))
    return (
        F.when(number > 100_000_000_000_000, F.timestamp_millis(F.floor(number / 1000)))
        .when(number > 1_000_000_000_000, F.timestamp_millis(number))
        .when(number.isNotNull(), F.timestamp_seconds(number))
        .otherwise(F.try_to_timestamp(text))
    )
