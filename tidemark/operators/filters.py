"""Typed filters as Columns: which operations a column's type allows, and how they combine.

As in SQL, every negated operation but is_not_null also drops nulls.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, json_value
from tidemark.functions.timeaxis import civil, literal_day, midnight, period_start, stored
from tidemark.sources.catalog import family

#: The operations of each family.
NULLS = ("is_null", "is_not_null")
TEXT = ("is", "is_not", "is_any_of", "is_none_of", "contains", "not_contains", "starts_with", "not_starts_with", "ends_with", "not_ends_with", "is_empty", "is_not_empty", *NULLS)
NUMBER = ("is", "is_not", "gt", "gte", "lt", "lte", "between", "is_any_of", "is_none_of", *NULLS)
INSTANT = ("is", "is_not", "before", "on_or_before", "after", "on_or_after", "between", *NULLS)
NAME = ("is", "is_not", "is_any_of", "is_none_of", *NULLS)
ALLOWED = {"string": TEXT, "boolean": ("is_true", "is_false", *NULLS), "numeric": NUMBER, "date": INSTANT, "time": INSTANT, "timestamp": INSTANT, "weekday": NAME, "month_name": NAME, "hour": NUMBER, "other": NULLS}
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")
#: Parts of an instant that can be compared: numbers with their range, names, starts of periods.
PARTS = {"hour": (0, 23), "day_of_month": (1, 31), "day_of_year": (1, 366), "week": (1, 53), "year": (1, 9999)}
STARTS = ("start_of_hour", "start_of_day", "start_of_week", "start_of_month", "start_of_quarter")


def shown_number(x: float, decimal: str = ".", digits: int = 2) -> str:
    """x with groups of three and the decimal mark of the reader, as number() reads it."""
    text = f"{x:,.{digits}f}" if x != int(x) else f"{int(x):,}"
    return text if decimal == "." else text.translate(str.maketrans(",.", ".,"))


def shown_hour(h: int, style: str = "24") -> str:
    """An hour of the day, as hour() reads it: 0 is 00:00 or 12am."""
    if not 0 <= h <= 23:
        raise ValueError("an hour is a number from 0 to 23")
    return f"{h:02d}:00" if style == "24" else f"{h % 12 or 12}{'am' if h < 12 else 'pm'}"


@dataclass(frozen=True)
class Filter:
    """column op value; value is a text, a list of texts, or two for between. join tells how it adds to the filters before."""

    column: str
    op: str
    value: Any = None
    part: str | None = None
    json_path: str | None = None
    match_case: bool | None = None
    join: str = "and"
    zone: str = "UTC"
    kind: str = "utc"
    week_start: str = "monday"
    decimal_mark: str = "."


def number(text: Any, mark: str = ".") -> str:
    """A number as people write it, as a plain literal: with a comma as the mark, dots and spaces group, else commas do."""
    s = str(text).strip().replace(" ", "").replace(" ", "").replace(" ", "").replace("'", "")
    s = s.replace(".", "").replace(",", ".") if mark == "," else s.replace(",", "")
    float(s)
    return s


def hour(text: Any) -> int:
    """Hour of the day from 15, 15:00, 3pm or 3:00 pm."""
    s = str(text).strip().lower().replace(" ", "")
    half = s[-2:] if s[-2:] in ("am", "pm") else ""
    h = int((s[:-2] if half else s).split(":")[0])
    if half:
        if not 1 <= h <= 12:
            raise ValueError(f"not an hour: {text}")
        h = h % 12 + (12 if half == "pm" else 0)
    if not 0 <= h <= 23:
        raise ValueError(f"not an hour: {text}")
    return h


def named(text: Any, names: tuple[str, ...]) -> str:
    """The one name that begins with text, in any case."""
    found = [n for n in names if n.lower() == str(text).strip().lower()] or [n for n in names if str(text).strip() and n.lower().startswith(str(text).strip().lower())]
    if len(found) != 1:
        raise ValueError(f"{text!r} is none of {', '.join(names)}")
    return found[0]


def _values(f: Filter) -> list:
    values = f.value if isinstance(f.value, list | tuple) else [f.value]
    values = [v for v in values if v is not None and str(v) != ""]
    if not values or f.op == "between" and len(values) != 2:
        raise ValueError(f"{f.op} needs {'two values' if f.op == 'between' else 'a value'}")
    return list(values)


def _any(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def _text(c: Column, f: Filter) -> Column:
    if f.op == "is_empty":
        return c == ""
    if f.op == "is_not_empty":
        return c != ""
    values = [str(v) for v in _values(f)]
    search = f.op.removeprefix("not_") in ("contains", "starts_with", "ends_with")
    # Equality minds case unless told otherwise; searches don't.
    if not (f.match_case if f.match_case is not None else not search):
        c, values = F.lower(c), [v.lower() for v in values]
    if search:
        test = {"contains": c.contains, "starts_with": c.startswith, "ends_with": c.endswith}[f.op.removeprefix("not_")]
        found = _any([test(v) for v in values])
        return ~found if f.op.startswith("not_") else found
    return {"is": lambda: c == values[0], "is_not": lambda: c != values[0], "is_any_of": lambda: c.isin(values), "is_none_of": lambda: ~c.isin(values)}[f.op]()


def _compare(c: Column, op: str, values: list) -> Column:
    if op == "between":
        return (c >= values[0]) & (c <= values[1])
    if op in ("is_any_of", "is_none_of"):
        return c.isin(values) if op == "is_any_of" else ~c.isin(values)
    v = values[0]
    return {"is": lambda: c == v, "is_not": lambda: c != v, "gt": lambda: c > v, "after": lambda: c > v, "gte": lambda: c >= v, "on_or_after": lambda: c >= v, "lt": lambda: c < v, "before": lambda: c < v, "lte": lambda: c <= v, "on_or_before": lambda: c <= v}[op]()


def _numeric(c: Column, kind: str, f: Filter) -> Column:
    values = [number(v, f.decimal_mark) for v in _values(f)]
    if kind in ("tinyint", "smallint", "int", "bigint") and any(float(v) != int(float(v)) for v in values):
        raise ValueError("this column holds whole numbers")
    to = kind if kind.startswith(("decimal", "double", "float")) else "bigint"
    return _compare(c, f.op, [F.lit(v).cast("double" if to == "float" else to) for v in values])


def _timestamp(c: Column, f: Filter) -> Column:
    """Days stand for all their instants; texts with a clock for themselves. The column stays bare."""

    def edges(v: Any) -> tuple[Column, Column | None]:
        if isinstance(v, datetime) or ":" in str(v):
            wall = F.lit(v if isinstance(v, datetime) else datetime.fromisoformat(str(v))).cast("timestamp_ntz")
            at = wall if f.kind == "reporting" or f.zone == "UTC" else F.convert_timezone(F.lit(f.zone), F.lit("UTC"), wall)
            return stored(at, f.kind), None
        day = literal_day(v)
        return tuple(stored(midnight(d, f.zone, f.kind), f.kind) for d in (day, F.date_add(day, 1)))

    spans = [edges(v) for v in _values(f)]
    lo, hi = spans[0]
    inside = lambda a, b: (c == a) if b is None else (c >= a) & (c < b)
    if f.op == "between":
        last, end = spans[1]
        return (c >= lo) & ((c <= last) if end is None else (c < end))
    return {
        "is": lambda: inside(lo, hi),
        "is_not": lambda: (c != lo) if hi is None else (c < lo) | (c >= hi),
        "before": lambda: c < lo,
        "on_or_before": lambda: (c <= lo) if hi is None else (c < hi),
        "after": lambda: (c > lo) if hi is None else (c >= hi),
        "on_or_after": lambda: c >= lo,
    }[f.op]()


def _part(c: Column, f: Filter) -> tuple[Column, str, list]:
    """Column, family and values of a part of an instant."""
    t = civil(c.cast("timestamp_ntz"), f.zone, f.kind)
    values = [] if f.op in NULLS else _values(f)
    if f.part == "weekday":
        return F.date_format(t, "EEEE"), "weekday", [named(v, WEEKDAYS) for v in values]
    if f.part == "month":
        return F.date_format(t, "MMMM"), "month_name", [named(v, MONTHS) for v in values]
    if f.part in PARTS:
        lo, hi = PARTS[f.part]
        values = [hour(v) if f.part == "hour" else int(number(v, f.decimal_mark)) for v in values]
        if any(not lo <= v <= hi for v in values):
            raise ValueError(f"{f.part} is between {lo} and {hi}")
        return {"hour": F.hour, "day_of_month": F.dayofmonth, "day_of_year": F.dayofyear, "week": F.weekofyear, "year": F.year}[f.part](t), "hour", values
    if f.part in STARTS:
        unit = f.part.removeprefix("start_of_")
        if unit == "hour":
            cut = lambda x: F.date_trunc("HOUR", x).cast("timestamp_ntz")
        else:
            cut = lambda x: period_start(x.cast("date"), unit, f.week_start)
        both = [F.lit(v if isinstance(v, datetime) else datetime.fromisoformat(str(v) if len(str(v)) > 7 else f"{v}-01")).cast("timestamp_ntz") for v in values]
        return cut(t), "timestamp", [cut(v) for v in both]
    raise ValueError(f"unknown part: {f.part}")


def predicate(df: DataFrame, f: Filter) -> Column:
    """The Column of one filter on df; raises where the column's type doesn't allow the operation."""
    c, kind = col(f.column), df.select(col(f.column)).schema[0].dataType
    own, values = family(kind), None
    if f.json_path is not None:
        c, own = json_value(f.column, f.json_path), "string"
        if f.op in ("gt", "gte", "lt", "lte", "between"):
            c, own = c.try_cast("double"), "numeric"
    if f.part is not None:
        if own not in ("date", "timestamp"):
            raise ValueError(f"{f.column} has no parts of time")
        c, own, values = _part(c, f)
    if f.op not in ALLOWED[own]:
        raise ValueError(f"{f.op} is not for {own} columns")
    if f.op in NULLS:
        return c.isNull() if f.op == "is_null" else c.isNotNull()
    if values is not None:
        return _compare(c, f.op, values)
    if own == "boolean":
        return F.coalesce(c if f.op == "is_true" else ~c, F.lit(False))
    if own == "string":
        return _text(c, f)
    if own == "numeric":
        return _numeric(c, kind.simpleString() if f.json_path is None else "double", f)
    if own == "timestamp":
        return _timestamp(c, f)
    if own == "date":
        return _compare(c, f.op, [literal_day(v) for v in _values(f)])
    return _compare(c, f.op, [F.lit(v if isinstance(v, time) else time.fromisoformat(str(v))) for v in _values(f)])


def combine(df: DataFrame, filters: list[Filter]) -> Column:
    """All filters, each joined to what stands before it, from the left."""
    out = F.lit(True)
    for i, f in enumerate(filters):
        p = predicate(df, f)
        out = p if i == 0 else (out | p) if f.join == "or" else (out & p)
    return out


def day_range(start: date, days: int) -> list[str]:
    """The days from start on, as filter values."""
    return [(start + timedelta(days=i)).isoformat() for i in range(days)]
