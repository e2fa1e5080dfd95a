"""A chart's form (a dict) as a DataFrame: range, grain, filters, series, breakdowns.

Keys: table, entity, event_time, time_kind, timezone, week_start; measure, on, of; grain; range_mode (last, this, previous, custom),
range_unit, range_n, include_current, custom_kind, custom_from, custom_to, start_date, end_date; event_column, events, filters;
series (each with event or any_of, filters, measure, of, label); breakdowns (each with expr, label, value_at, if_missing, fill_from),
breakdown_by_series, top_n, include_other; window_days; exact; row_limit; sql_filter.
"""

from __future__ import annotations

import dataclasses
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, json_value, quoted
from tidemark.functions.timeaxis import between, bucket, instant
from tidemark.operators.events import events, series, shared_labels
from tidemark.operators.filters import Filter, combine
from tidemark.operators.valueindex import ValueIndex
from tidemark.plans.runner import ROW_LIMIT, most_recent
from tidemark.plans.windows import CYCLIC, current_bucket, grain_of, window
from tidemark.sources.relations import relation
from tidemark.specs import EVENT_MEASURES, PROPERTY_MEASURES, Breakdown, EventsSpec

MAX_SERIES, MAX_BREAKDOWNS = 8, 3
VALUE_AT = ("event", "range_start", "range_end", "first_record", "latest_record")
CHARTED, SERIES = "charted", "series"
SEPARATOR, MISSING = " · ", "(null)"


def _filters(df: DataFrame, entries: list, form: dict) -> Column | None:
    if not entries:
        return None
    shared = {"zone": form.get("timezone") or "UTC", "kind": form.get("time_kind") or "utc", "week_start": form.get("week_start") or "monday"}
    return combine(df, [f if isinstance(f, Filter) else Filter(**(shared | f)) for f in entries])


def _names(unit: dict) -> list[str]:
    return [m["event"] for m in unit.get("any_of") or [] if m.get("event")] or ([unit["event"]] if unit.get("event") else [])


def _event_is(form: dict, names: list[str]) -> Column | None:
    if not names:
        return None
    if not form.get("event_column"):
        raise ValueError("events need event_column")
    c = quoted(form["event_column"])
    return c == names[0] if len(names) == 1 else c.isin(names)


def _both(*tests: Column | None) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out if t is None else out & t
    return out


def _unit_predicate(df: DataFrame, form: dict, unit: dict | None) -> Column:
    """Which rows a series counts: its event and its filters; any of several events, each with filters of its own."""
    if unit is None:
        return _both(_event_is(form, form.get("events") or []), _filters(df, form.get("filters") or [], form))
    if unit.get("any_of"):
        members = [_both(_event_is(form, _names({"event": m.get("event")})), _filters(df, m.get("filters") or [], form)) for m in unit["any_of"]]
        some = members[0]
        for m in members[1:]:
            some = some | m
        return _both(some, _filters(df, unit.get("filters") or [], form))
    return _both(_event_is(form, _names(unit)), _filters(df, unit.get("filters") or [], form))


def _measure(form: dict, unit: dict | None) -> tuple[str, str, Any]:
    own = unit if unit and unit.get("measure") else form
    name = str(own.get("measure") or "uniques").lower()
    on = str(own.get("on") or form.get("on") or "").lower()
    if name == "property_average" or on == "property" and name == "average":
        on, name = "property", "average"
    elif name in EVENT_MEASURES:
        on = "events"
    elif name in PROPERTY_MEASURES:
        on = "property"
    else:
        raise ValueError(f"unknown measure: {name}")
    of = own.get("of") if on == "property" else None
    if on == "property" and of is None:
        raise ValueError("property measures need of")
    return on, name, json_value(of["column"], of["json_path"]).try_cast("double") if isinstance(of, dict) else of


def _fill_names(form: dict, unit: dict | None, slot: dict) -> list[str] | None:
    """The events that may record values; None if fill_from is no choice of events."""
    source = slot.get("fill_from")
    if isinstance(source, dict):
        return [source["event"]]
    if not isinstance(source, str) or source not in (CHARTED, SERIES):
        return None
    units = [unit] if source == SERIES and unit else form.get("series") or []
    return list(dict.fromkeys(n for u in units for n in _names(u))) or form.get("events") or []


def _fill_from(form: dict, unit: dict | None, slot: dict) -> Any:
    names = _fill_names(form, unit, slot)
    return slot.get("fill_from") if names is None else _event_is(form, names)


def _slots(form: dict, unit: dict | None) -> list[dict]:
    return ((unit or {}).get("breakdowns") if form.get("breakdown_by_series") else form.get("breakdowns")) or []


def history_columns(form: dict) -> list[str]:
    """The expressions of a form whose breakdowns read history: those that an index would serve."""
    slots = [s for u in form.get("series") or [None] for s in _slots(form, u)]
    return list(dict.fromkeys(s["expr"] for s in slots if isinstance(s["expr"], str) and not s.get("json_path") and ((s.get("value_at") or "event") != "event" or s.get("if_missing") == "fill")))


def _attached(index: ValueIndex | None, b: Any, form: dict, unit: dict | None, slot: dict) -> Any:
    if index is None or not isinstance(b, Breakdown) or b.values is not None or slot.get("json_path"):
        return b
    return index.attach(b, _fill_names(form, unit, slot) or None)


def _breakdown(form: dict, unit: dict | None, slot: dict, ends: tuple[Column, Column | None]) -> Any:
    """Value at, if missing and fill from, as a Breakdown."""
    expr = json_value(slot["expr"], slot["json_path"]) if slot.get("json_path") else slot["expr"]
    at, missing = slot.get("value_at") or "event", slot.get("if_missing") or "null"
    if at not in VALUE_AT or missing not in ("null", "fill"):
        raise ValueError(f"value_at is one of {VALUE_AT}; if_missing null or fill")
    if at == "event" and missing == "null":
        return expr
    fill, index = _fill_from(form, unit, slot), {k: slot[k] for k in ("values", "complete_until") if slot.get(k) is not None}
    if at == "event":
        return Breakdown(expr, at="carried", fill_from=fill, own_value_first=fill is not None, **index)
    if at == "first_record":
        return Breakdown(expr, at="first", fill_from=fill, **index)
    bound = {}
    if at == "range_start":
        bound = {"until": ends[0]}  # the first instant belongs to the range
    elif at == "range_end" and ends[1] is not None:
        bound = {"before": ends[1]}  # the end does not
    return Breakdown(expr, at="last", fill_from=fill, backfill=bool(bound) and missing == "fill", **bound, **index)


def spec_of(spark: SparkSession, form: dict, unit: dict | None = None, now: datetime | None = None, index: ValueIndex | None = None) -> EventsSpec:
    """The specification of one series of a form; breakdowns that read history take what an index has."""
    if not form.get("entity"):
        raise ValueError("entity is required")
    df = relation(spark, form["table"])
    kind, zone = form.get("time_kind") or "utc", form.get("timezone") or "UTC"
    ends = window(form, now)
    where = _both(between(form["event_time"], *ends, kind), _unit_predicate(df, form, unit), col(form["sql_filter"]) if form.get("sql_filter") else None)
    on, measure, of = _measure(form, unit)
    slots = _slots(form, unit)
    if len(slots) > MAX_BREAKDOWNS:
        raise ValueError(f"at most {MAX_BREAKDOWNS} breakdowns")
    t = instant(form["event_time"], kind)
    return EventsSpec(
        source=df, entity=form["entity"], event_time=t, measure=measure, on=on, of=of,
        bucket=bucket(t, grain_of(form), zone, form.get("week_start") or "monday", "reporting" if kind == "reporting" else "utc"),
        where=where, exact=form.get("exact") in (True, "true", "on", "1", 1),
        breakdowns=tuple(_attached(index, _breakdown(form, unit, s, ends), form, unit, s) for s in slots), breakdown_labels=tuple(s.get("label") or f"breakdown_{i}" for i, s in enumerate(slots)) or None,
        top_n=int(form.get("top_n") or 8), include_other=bool(form.get("include_other", True)), event_time_column=form["event_time"],
        window_days=int(form.get("window_days") or 1) if measure == "active" else 1,
    )


def _rank_spec(form: dict, spec: EventsSpec) -> EventsSpec:
    """A shared axis is ranked by the chart's measure, whatever a series measures itself."""
    on, measure, of = _measure(form, None)
    on, measure, of = (on, measure, of) if measure == "sum" else ("events", "total", None)
    return dataclasses.replace(spec, on=on, measure=measure, of=of, window_days=1)


def _label(unit: dict) -> str:
    return unit.get("label") or ", ".join(_names(unit)) or "all"


def _alike(form: dict, units: list[dict]) -> bool:
    """Whether series differ in the rows that they count only, and a shared pick ranks by what they measure (or by rows)."""
    same = len({repr((_measure(form, u)[:2], u.get("of") if u.get("measure") else form.get("of"))) for u in units}) == 1
    sums = [_measure(form, u)[:2] == ("property", "sum") for u in (None, units[0])]
    own = any(s.get("fill_from") == SERIES for s in form.get("breakdowns") or [])
    if sums[0] and any(u.get("measure") for u in units):
        return False
    return same and sums[0] == sums[1] and not own and not form.get("breakdown_by_series") and len({_label(u) for u in units}) == len(units)


def _overlay(spark: SparkSession, form: dict, units: list[dict], now: datetime | None, index: ValueIndex | None = None) -> DataFrame:
    if len(units) > MAX_SERIES:
        raise ValueError(f"at most {MAX_SERIES} series")
    if _alike(form, units):  # one scan for all: each row is counted by the series whose predicate it meets
        df = relation(spark, form["table"])
        tests = [F.coalesce(_unit_predicate(df, form, u), F.lit(False)) for u in units]
        some = tests[0]
        for t in tests[1:]:
            some = some | t
        spec = spec_of(spark, form, units[0], now, index)
        spec = dataclasses.replace(spec, where=_both(between(form["event_time"], *window(form, now), form.get("time_kind") or "utc"), some, col(form["sql_filter"]) if form.get("sql_filter") else None))
        members = F.array_compact(F.array(*(F.when(t, F.lit(_label(u))) for t, u in zip(tests, units, strict=True))))
        out = series(spark, spec, members)
        return out.withColumn("value", F.col("value").cast("double")) if spec.measure in ("average", "sum", "median", "distinct") else out
    specs = [spec_of(spark, form, u, now, index) for u in units]
    same = all(s.labels == specs[0].labels for s in specs)
    top = shared_labels(spark, [_rank_spec(form, s) for s in specs]) if specs[0].breakdowns and not form.get("breakdown_by_series") else None
    out = None
    for unit, spec in zip(units, specs, strict=True):
        name = F.lit(_label(unit))
        arm = events(spark, spec, top)
        if spec.breakdowns and not same:
            parts = [x for lab in spec.labels for x in (F.lit(SEPARATOR), F.coalesce(quoted(lab).cast("string"), F.lit(MISSING)))]
            arm = arm.withColumn("series", F.concat(name, *parts)).drop(*spec.labels)
        else:
            arm = arm.withColumn("series", name)
        arm = arm.withColumn("value", F.col("value").cast("double")) if len({s.measure for s in specs} & {"average", "sum", "median", "distinct"}) else arm
        out = arm if out is None else out.unionByName(arm)
    return out


def fill_cycle(df: DataFrame, grain: str, labels: list[str], week_start: str = "monday") -> DataFrame:
    """All 7 weekdays or 24 hours for each series and group, 0 where there is nothing, in the order of the week."""
    n = 7 if grain == "day_of_week" else 24
    if labels:
        groups = df.select(*(quoted(x) for x in labels)).distinct()
        slots = groups.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("__tm_slot"))
    else:
        slots = df.sparkSession.range(n).select(F.col("id").cast("int").alias("__tm_slot"))
    own = df.select(F.col("bucket").alias("__tm_b"), *(quoted(x).alias(f"__tm_{x}") for x in labels), "value")
    same = F.col("__tm_slot") == F.col("__tm_b")
    for x in labels:
        same = same & quoted(x).eqNullSafe(quoted(f"__tm_{x}"))
    zero = F.lit(0).cast(df.schema["value"].dataType)
    out = slots.join(own, same, "left").select(F.col("__tm_slot").alias("bucket"), *(quoted(x) for x in labels), F.coalesce("value", zero).alias("value"))
    first = F.pmod(F.col("bucket") + 1, F.lit(7)) if n == 7 and week_start == "sunday" else F.col("bucket")
    return out.orderBy(first, *(quoted(x) for x in labels))


def report(spark: SparkSession, form: dict[str, Any], now: datetime | None = None, index: ValueIndex | None = None, upkeep: bool = False) -> DataFrame:
    """bucket, [series,] [breakdowns,] value, incomplete: the chart of a form.

    index: recorded values that breakdowns read instead of the history; with upkeep, its columns that the form needs are built
    or refreshed first, where that is worth it.
    """
    units = form.get("series") or []
    if index is not None and upkeep:
        index.apply(index.plan(history_columns(form)))
    df = _overlay(spark, form, units, now, index) if len(units) > 1 else events(spark, spec_of(spark, form, units[0] if units else None, now, index))
    labels = [c for c in df.columns if c not in ("bucket", "value")]
    grain, limit = grain_of(form), int(form.get("row_limit") or ROW_LIMIT)
    if grain in CYCLIC:
        some = df.orderBy("bucket", *(quoted(x) for x in labels)).limit(limit)  # the same rows each time it is read
        return fill_cycle(some, grain, labels, form.get("week_start") or "monday").withColumn("incomplete", F.lit(False))
    return most_recent(df, "bucket", limit, tuple(labels)).withColumn("incomplete", F.coalesce(F.col("bucket") == current_bucket(form, now), F.lit(False)))
