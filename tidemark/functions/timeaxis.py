"""Time: kinds of stored instants, buckets, shifted periods, and bounds that leave a stored column bare.

The session's time zone is taken to be UTC. An instant is a TIMESTAMP_NTZ that holds UTC.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.exprs import col
from tidemark.specs import Expr

UNITS = ("day", "week", "month", "quarter", "year")
GRAINS = ("day", "week", "month", "hour", "day_of_week", "hour_of_day")
EPOCHS = {"unix_s": 1, "unix_ms": 1_000, "unix_us": 1_000_000}


def check_kind(kind: str) -> str:
    if kind not in ("utc", "reporting", "instant", *EPOCHS) and "/" not in kind:
        raise ValueError(f"unknown kind of time: {kind}")
    return kind


def instant(column: Expr, kind: str = "utc") -> Column:
    """A stored column as an instant; `reporting` wall clock stays as it is."""
    c, kind = col(column), check_kind(kind)
    if kind in EPOCHS:
        make = {"unix_s": F.timestamp_seconds, "unix_ms": F.timestamp_millis, "unix_us": F.timestamp_micros}[kind]
        return make(c).cast("timestamp_ntz")
    if "/" in kind:
        return F.convert_timezone(F.lit(kind), F.lit("UTC"), c.cast("timestamp_ntz"))
    return c.cast("timestamp_ntz")


def civil(t: Column, zone: str = "UTC", kind: str = "utc") -> Column:
    """Wall clock of an instant in a zone."""
    return t if kind == "reporting" or zone == "UTC" else F.convert_timezone(F.lit("UTC"), F.lit(zone), t)


def period_start(d: Column, unit: str, week_start: str = "monday", shift: int = 0) -> Column:
    """First day of the period of a date, `shift` periods on."""
    if unit == "day":
        return F.date_add(d, shift)
    if unit == "week":
        first = F.date_sub(d, F.dayofweek(d) - 1) if week_start == "sunday" else F.trunc(d, "WEEK")
        return F.date_add(first, 7 * shift)
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.add_months(F.trunc(d, unit.upper()), months * shift)


def bucket(t: Column, grain: str, zone: str = "UTC", week_start: str = "monday", kind: str = "utc") -> Column:
    """The bucket of an instant: a date, an hour, 0 to 6 for the day of the week (Monday 0) or 0 to 23 for the hour of the day."""
    local = civil(t, zone, kind)
    if grain == "hour":
        return F.date_trunc("HOUR", local).cast("timestamp_ntz")
    if grain == "hour_of_day":
        return F.hour(local)
    if grain == "day_of_week":
        return F.weekday(local)
    if grain not in GRAINS:
        raise ValueError(f"unknown grain: {grain}")
    return period_start(local.cast("date"), grain, week_start)


def days_between(start: Column, end: Column) -> Column:
    """Midnights passed from start to end, as in calendars."""
    return F.datediff(end.cast("date"), start.cast("date"))


def midnight(day: Column, zone: str = "UTC", kind: str = "utc") -> Column:
    """The instant at which a day begins in a zone; wall clock for `reporting`."""
    wall = day.cast("timestamp_ntz")
    return wall if kind == "reporting" or zone == "UTC" else F.convert_timezone(F.lit(zone), F.lit("UTC"), wall)


def stored(bound: Column, kind: str = "utc") -> Column:
    """An instant in the form of a stored column, so that comparisons leave the column bare and reach the files."""
    if check_kind(kind) in EPOCHS:
        unix = {"unix_s": F.unix_seconds, "unix_ms": F.unix_millis, "unix_us": F.unix_micros}[kind]
        return unix(bound.cast("timestamp"))
    if kind == "instant":
        return bound.cast("timestamp")
    return F.convert_timezone(F.lit("UTC"), F.lit(kind), bound) if "/" in kind else bound


def between(column: Expr, start: Column | None, end: Column | None, kind: str = "utc") -> Column:
    """start <= column < end on the bare column; None is open."""
    c, out = col(column), F.lit(True)
    if start is not None:
        out = out & (c >= stored(start, kind))
    return out if end is None else out & (c < stored(end, kind))


def epoch_unit(magnitude: float | None) -> str:
    """The unit of epochs with this median; seconds if there is none."""
    m = abs(magnitude or 0)
    return "unix_us" if m >= 1e14 else "unix_ms" if m >= 1e11 else "unix_s"


def literal_now(now: datetime | None) -> Column:
    return F.lit(now).cast("timestamp_ntz") if now is not None else F.current_timestamp().cast("timestamp_ntz")


def literal_day(day: date | str) -> Column:
    """A date; yyyy-mm is its first day."""
    if isinstance(day, str):
        day = date.fromisoformat(day if len(day) > 7 else f"{day}-01")
    return F.lit(day)
