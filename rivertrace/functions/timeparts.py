"""Clock arithmetic on timestamps and hour sets. Never uses the session's zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def minutes_since(ts: Column, epoch: Column) -> Column:
    return (F.unix_micros(ts) - F.unix_micros(epoch)) / 60_000_000


def hour_of(minutes: Column) -> Column:
    return (minutes / 60.0) % 24


def day_of(minutes: Column) -> Column:
    return F.floor(minutes / 1440)


def day_of_year(minutes: Column) -> Column:
    return (day_of(minutes) + 1) % 365


def weekday_of(minutes: Column, first_weekday: int = 3) -> Column:
    """0..6 with 5 and 6 the weekend; ``first_weekday`` is the weekday number of day 0."""
    return (day_of(minutes) + first_weekday) % 7


def in_hours(hour: Column, start: Column, end: Column) -> Column:
    """Hour within [start, end); the range crosses midnight when start > end."""
    return F.when(start <= end, (hour >= start) & (hour < end)).otherwise((hour >= start) | (hour < end))


def hour_set(start: Column, end: Column) -> Column:
    """The whole hours of [start, end) as an array."""
    hours = F.sequence(F.lit(0), F.lit(23))
    return F.filter(hours, lambda h: in_hours(h, start.cast("int"), end.cast("int")))


def set_overlap(left: Column, right: Column) -> Column:
    """Shared members over all members, 0 for two empty sets."""
    shared = F.size(F.array_intersect(left, right))
    return shared / F.greatest(F.size(F.array_union(left, right)), F.lit(1))


def even_grid(start: float, stop: float, points: int) -> Column:
    """``points`` evenly spaced values from start to stop, both included."""
    step = (stop - start) / (points - 1) if points > 1 else 0.0
    return F.transform(F.sequence(F.lit(0), F.lit(points - 1)), lambda i: F.lit(start) + i * F.lit(step))


def format_utc(ts: Column) -> Column:
    """``YYYY-MM-DD HH:MM UTC``, or ``-`` when missing. The session runs in UTC."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC")), F.lit("-"))


def percent(share: Column) -> Column:
    return F.concat(F.bround(share * 100).cast("int").cast("string"), F.lit("%"))


def rounded(value: Column, digits: int) -> Column:
    """Half up on the scaled double, for values from 0 on. ``round`` goes by the printed decimal, which leaves 0.1 * 1.015 (0.10149999999999999)
    below the tie at three digits; scaled by 1000 it is 101.5."""
    return F.floor(value * 10.0**digits + 0.5) / 10.0**digits


def rounded_even(value: Column, digits: int) -> Column:
    """Half to even on the scaled double."""
    return F.rint(value * 10.0**digits) / 10.0**digits
