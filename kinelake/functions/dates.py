"""Date and time functions; stamps are ISO-8601 in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_minutes(stamp: Column, now: Column) -> Column:
    """Minutes from an ISO stamp to now; null if the stamp can't be read."""
    t = F.try_to_timestamp(stamp)
    return (F.unix_micros(now) - F.unix_micros(t)) / F.lit(60_000_000.0)


def shift(date: Column, days: int) -> Column:
    """An ISO date moved by days, as text."""
    return F.date_format(F.date_add(date.cast("date"), days), "yyyy-MM-dd")


def frame_seconds(frame: Column, fps: Column) -> Column:
    """Seconds of a frame in two decimals; fps counts as 1 at least."""
    return F.bround(frame / F.greatest(fps, F.lit(1.0)), 2)


def stamp(t: Column) -> Column:
    return F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def sortable_id(t: Column, seed: Column) -> Column:
    return F.concat(F.date_format(t, "yyyyMMdd'T'HHmmss"), F.lit("-"), F.left(F.sha2(seed, 256), F.lit(6)))


def monday(date: Column) -> Column:
    return F.date_trunc("week", date.cast("timestamp")).cast("date")
