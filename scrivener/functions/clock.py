"""Column functions over instants and days. "Now" is always an argument; days are those of the
session's time zone for TIMESTAMP and as written for TIMESTAMP_NTZ."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_instant(value: str) -> Column:
    """A fixed instant without a zone."""
    return F.lit(value).cast("timestamp_ntz")


def seconds_between(now: Column, then: Column) -> Column:
    """Whole seconds from `then` to `now`, floored (negative in the future)."""
    return F.floor(F.timestamp_diff("MICROSECOND", then, now) / 1_000_000).cast("long")


def relative_time(then: Column, now: Column) -> Column:
    """"just now", "N min ago", "N hour(s) ago", "N day(s) ago", then "Jan 5"."""
    s = seconds_between(now, then)
    minutes, hours, days = F.floor(s / 60), F.floor(s / 3600), F.floor(s / 86400)

    def ago(n: Column, unit: str) -> Column:
        return F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(s < 60, "just now")
        .when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" min ago")))
        .when(hours < 24, ago(hours, "hour"))
        .when(days < 7, ago(days, "day"))
        .otherwise(F.date_format(then, "MMM d"))
    )


def greeting(at: Column) -> Column:
    return F.when(F.hour(at) < 12, "Good morning").when(F.hour(at) < 18, "Good afternoon").otherwise("Good evening")


def long_date(day: Column) -> Column:
    """"Monday, January 5"."""
    return F.date_format(day, "EEEE, MMMM d")


def day_label(day: Column, today: Column) -> Column:
    """"Today — January 5", "Yesterday — January 4", else the long date."""
    short = F.date_format(day, "MMMM d")
    return (
        F.when(day == today, F.concat(F.lit("Today — "), short))
        .when(day == F.date_sub(today, 1), F.concat(F.lit("Yesterday — "), short))
        .otherwise(long_date(day))
    )


def half_up(x: Column) -> Column:
    """Nearest whole number, halves towards positive infinity."""
    return F.floor(x + 0.5).cast("long")


def safe_instant(text: Column) -> Column:
    """Instant of an RFC 3339 string, null where it is none."""
    return F.try_to_timestamp(text)


def eased(target: Column, progress: Column) -> Column:
    """Where a count up to `target` stands at `progress` (0 to 1), slowing down cubically."""
    return half_up(target * (1 - F.pow(1 - F.least(progress, F.lit(1.0)), F.lit(3))))
