"""The engine's queries over the test tables, by name, and SQL, written another way, that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import grid, json_value
from tidemark.operators.events import events, shared_labels
from tidemark.operators.filters import Filter, combine
from tidemark.operators.funnel import funnel
from tidemark.operators.retention import retention
from tidemark.operators.valueindex import Mapping, ValueIndex, anti_append, bookmarks, index_rows
from tidemark.plans.report import report
from tidemark.sources import catalog
from tidemark.sources.relations import relation, work_folder
from tidemark.specs import Breakdown, EventsSpec, FunnelSpec, RetentionSpec, Values

Query = Callable[[SparkSession, str], DataFrame]

#: A sparse column and a coarse instant, as SQL that both engines read.
SPARSE = "CASE WHEN event_type IN ('signup', 'purchase') THEN event_type END"
MAYBE = "CASE WHEN event_type <> 'click' THEN event_type END"
RARE = "CASE WHEN event_type = 'purchase' AND user_id % 2 = 0 THEN event_type END"
NOW = datetime(2024, 1, 31, 12)
#: A range within the events, for charts of values at its ends.
MID = {"range_mode": "custom", "start_date": "2024-01-10", "end_date": "2024-01-20"}


def _table(name: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf: relation(spark, f"{sf}/{name}.parquet")


def _events(**spec) -> Query:
    base = {"entity": "user_id", "event_time": "ts", "exact": True}
    return lambda spark, sf: events(spark, EventsSpec(source=f"{sf}/events.parquet", **(base | spec)))


def _rounded(q: Query, *names: str) -> Query:
    return lambda spark, sf: q(spark, sf).withColumns({n: F.round(n, 4) for n in names})


def _bd(*breakdowns, **spec) -> Query:
    return _events(**({"measure": "total", "breakdowns": tuple(breakdowns)} | spec))


def _index(spark: SparkSession, sf: str, late: bool) -> DataFrame:
    rows = relation(spark, f"{sf}/events.parquet").select(F.col("user_id").alias("entity"), F.col("ts").alias("at"), F.expr(SPARSE).alias("value"))
    rows = rows.where("value IS NOT NULL")
    return rows.where("at <= TIMESTAMP_NTZ '2024-01-20 00:00:00'") if late else rows


def _values(late: bool, **b) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        stop = {"complete_until": "TIMESTAMP_NTZ '2024-01-20 00:00:00'"} if late else {}
        return _bd(Breakdown(SPARSE, values=Values(_index(spark, sf, late)), **stop, **b), event_time_column="ts")(spark, sf)

    return run


def _retention(spark: SparkSession, sf: str, table: str, **spec) -> DataFrame:
    return retention(spark, RetentionSpec(source=f"{sf}/{table}.parquet", **spec))


def _funnel(**spec) -> Query:
    base = {"entity": "user_id", "event_time": "ts", "steps": ("event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'")}
    return lambda spark, sf: funnel(spark, FunnelSpec(source=f"{sf}/events.parquet", **(base | spec)))


def _filter(*filters: Filter) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = relation(spark, f"{sf}/events.parquet")
        return df.where(combine(df, list(filters))).select("event_id", "event_type", "value")

    return run


def _report(**form) -> Query:
    base = {"entity": "user_id", "event_time": "ts", "measure": "total", "grain": "day", "range_mode": "last", "range_unit": "day", "range_n": 40, "exact": True, "event_column": "event_type"}
    return lambda spark, sf: report(spark, {"table": f"{sf}/events.parquet"} | base | form, now=NOW)


def _value_at(at: str, missing: str = "null", expr: str = SPARSE, **slot) -> Query:
    return _report(**MID, breakdowns=[{"expr": expr, "value_at": at, "if_missing": missing, **slot}])


def _written_index(spark: SparkSession, sf: str) -> ValueIndex:
    path = f"{sf}/events.parquet"
    return ValueIndex(spark, work_folder(spark, "index"), relation(spark, path), Mapping(path, "user_id", "ts", "event_type"), NOW)


def _index_report(spark: SparkSession, sf: str) -> DataFrame:
    form = {"table": f"{sf}/events.parquet", "entity": "user_id", "event_time": "ts", "measure": "total", "grain": "day", "exact": True, "event_column": "event_type", **MID}
    form["breakdowns"] = [{"expr": RARE, "value_at": "event", "if_missing": "fill"}]
    return report(spark, form, NOW, _written_index(spark, sf), upkeep=True)


def _index_repair(spark: SparkSession, sf: str) -> DataFrame:
    """An index that has lost an event's rows and takes them anew."""
    index = _written_index(spark, sf)
    index.apply(index.plan([RARE]))
    index.forget_names(["purchase"], fresh=True)
    return index.read().select(F.lit("rare").alias("column_key"), "entity", "at", "value", "event_name")


def _typed(*filters: Filter) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        df = relation(spark, f"{sf}/events.parquet").withColumn("d", F.col("ts").cast("date"))
        return df.where(combine(df, list(filters))).select("event_id", "d")

    return run


def _census(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.census(relation(spark, f"{sf}/events.parquet"), "event_type", "ts")


def _names(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.event_names(relation(spark, f"{sf}/events.parquet"), "event_type", "ts", F.lit(datetime(2024, 1, 5)))


def _density(spark: SparkSession, sf: str) -> DataFrame:
    return catalog.density(relation(spark, f"{sf}/events.parquet"), SPARSE, "ts", NOW)


def _index_build(spark: SparkSession, sf: str) -> DataFrame:
    return index_rows(relation(spark, f"{sf}/events.parquet"), {"kind": SPARSE}, "user_id", "ts", "event_type")


def _index_refresh(spark: SparkSession, sf: str) -> DataFrame:
    whole = _index_build(spark, sf)
    old = whole.where("at < TIMESTAMP_NTZ '2024-01-15 00:00:00'")
    return old.unionByName(anti_append(old, whole, bookmarks(old), lookback_days=3))


def _row_fuse(spark: SparkSession, sf: str) -> DataFrame:
    from tidemark.plans.runner import most_recent

    return most_recent(_events(measure="total")(spark, sf), "bucket", 7)


def _shared(spark: SparkSession, sf: str) -> DataFrame:
    spec = {"entity": "user_id", "event_time": "ts", "measure": "total", "breakdowns": ("user_id % 7",), "top_n": 3, "exact": True}
    return shared_labels(spark, [EventsSpec(source=f"{sf}/events.parquet", where=f"event_type = '{t}'", **spec) for t in ("view", "click")])


def _json(spark: SparkSession, sf: str) -> DataFrame:
    return _bd(json_value("props", "k"), top_n=4)(spark, sf)


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(grid(12).alias("n"))


def queries() -> dict[str, Query]:
    local = lambda unit: f"CAST({unit} AS TIMESTAMP_NTZ)"
    return {
        "events_total_day": _events(measure="total"),
        "events_total_hour": _events(measure="total", bucket=local("date_trunc('HOUR', event_ts)")),
        "events_total_week_mon": _report(grain="week", range_unit="week", range_n=8),
        "events_total_week_sun": _report(grain="week", range_unit="week", range_n=8, week_start="sunday"),
        "events_total_month": _report(grain="month", range_unit="month", range_n=3, include_current=True),
        "events_total_dow": _report(grain="day_of_week"),
        "events_total_hod": _report(grain="hour_of_day"),
        "events_uniques_day": _events(measure="uniques"),
        "events_average_day": _events(measure="average"),
        "events_sum_day": _rounded(_events(on="property", measure="sum", of="value"), "value"),
        "events_propavg_day": _rounded(_events(on="property", measure="average", of="value"), "value"),
        "events_median_day": _rounded(_events(on="property", measure="median", of="value"), "value"),
        "events_distinct_day": _rounded(_events(on="property", measure="distinct", of=MAYBE), "value"),
        "events_uniques_approx": _events(measure="uniques", exact=False),
        "events_null_entity": _events(measure="average", entity="CASE WHEN user_id % 3 > 0 THEN user_id END"),
        "active_1": _events(measure="active"),
        "active_7": _events(measure="active", window_days=7),
        "active_28": _events(measure="active", window_days=28),
        "active_bounds": _events(measure="active", window_days=7, report_from="DATE '2024-01-10'", report_until="DATE '2024-01-20'"),
        "active_by_type": _events(measure="active", window_days=3, breakdowns=("event_type",), top_n=3),
        "active_by_first": _events(measure="active", window_days=3, breakdowns=(Breakdown(SPARSE, at="first"),)),
        "bd_rows_top2_other": _bd("event_type", top_n=2),
        "bd_rows_top2_drop": _bd("event_type", top_n=2, include_other=False),
        "bd_pair_top3": _bd("event_type", "user_id % 3", top_n=3),
        "bd_null_axis": _bd(MAYBE, "CASE WHEN user_id % 2 = 0 THEN user_id % 5 END", top_n=4),
        "bd_sum_rank": _rounded(_bd("user_id % 10", on="property", measure="sum", of="value", top_n=4), "value"),
        "bd_uniques": _bd("event_type", measure="uniques", top_n=3),
        "bd_first": _bd(Breakdown(SPARSE, at="first"), where="event_type = 'view'"),
        "bd_last": _bd(Breakdown(SPARSE, at="last"), where="event_type = 'view'"),
        "bd_last_until": _bd(Breakdown("event_type", at="last", until="TIMESTAMP_NTZ '2024-01-05 00:00:00'")),
        "bd_last_before_backfill": _bd(Breakdown("event_type", at="last", before="TIMESTAMP_NTZ '2024-01-02 00:00:00'", backfill=True)),
        "bd_first_window": _bd(Breakdown("event_type", at="first", since="TIMESTAMP_NTZ '2024-01-10 00:00:00'", until="TIMESTAMP_NTZ '2024-01-12 00:00:00'")),
        "bd_carried": _bd(Breakdown(SPARSE, at="carried"), where="event_type = 'view'", event_time=local("date_trunc('DAY', ts)")),
        "bd_carried_fill": _bd(Breakdown("event_type", at="carried", fill_from="event_type IN ('purchase', 'signup')")),
        "bd_carried_own": _bd(Breakdown(MAYBE, at="carried", fill_from="event_type = 'purchase'", own_value_first=True)),
        "bd_mixed": _bd("user_id % 2", Breakdown(SPARSE, at="carried"), Breakdown("event_type", at="last"), top_n=5),
        "values_table_tail": _values(True, at="carried"),
        "values_table_complete": _values(False, at="last"),
        "ret_orders_30d": lambda spark, sf: _retention(spark, sf, "orders", entity="o_custkey", entity_time="o_orderdate", event_time="o_orderdate", period_days=30, n_periods=6, retained="true", cohort_bucket="CAST(date_trunc('YEAR', cohort_ts) AS TIMESTAMP_NTZ)"),
        "ret_orders_35d_window5": lambda spark, sf: _retention(spark, sf, "orders", entity="o_custkey", entity_time="o_orderdate", event_time="o_orderdate", period_days=35, n_periods=6, retained="within_period_offset <= 5 AND o_orderstatus <> 'P'", cohort_bucket="CAST(date_trunc('YEAR', cohort_ts) AS TIMESTAMP_NTZ)"),
        "ret_lineitem_supplier": lambda spark, sf: _retention(spark, sf, "lineitem", entity="l_suppkey", entity_time="l_shipdate", event_time="l_shipdate", period_days=7, n_periods=4, retained="l_quantity > 25"),
        "ret_events_7d": lambda spark, sf: _retention(spark, sf, "events", entity="user_id", entity_time="ts", event_time="ts", period_days=7, n_periods=3, retained="event_type = 'purchase'"),
        "funnel_3step_unbounded": _funnel(),
        "funnel_within_1d": _funnel(within_days=1),
        "funnel_same_row_two_steps": _funnel(steps=("event_type IN ('view', 'click')", "event_type = 'click'", "value > 50"), step_labels=("seen", "clicked", "paid")),
        "overlay_shared_pick": _report(series=[{"event": "view"}, {"event": "click"}], breakdowns=[{"expr": "user_id % 7"}], top_n=3),
        "overlay_per_series": _report(series=[{"event": "view"}, {"event": "click", "measure": "uniques"}]),
        "overlay_any_of": _report(series=[{"label": "seen", "any_of": [{"event": "view"}, {"event": "click", "filters": [{"column": "value", "op": "gt", "value": "50"}]}]}, {"event": "click"}], breakdowns=[{"expr": "user_id % 7"}], top_n=2),
        "value_at_first": _value_at("first_record"),
        "value_at_latest": _value_at("latest_record"),
        "value_at_start": _value_at("range_start", expr="event_type"),
        "value_at_start_fill": _value_at("range_start", "fill", RARE),
        "value_at_end": _value_at("range_end"),
        "value_at_event_fill": _value_at("event", "fill"),
        "value_fill_from": _value_at("event", "fill", "event_type", fill_from={"event": "purchase"}),
        "cyclic_fill": _report(grain="hour_of_day", series=[{"event": "signup", "filters": [{"column": "value", "op": "gt", "value": "99"}]}]),
        "shared_pick": _shared,
        "filter_string_ops": _filter(Filter("event_type", "contains", ["IC", "ur"]), Filter("event_type", "not_ends_with", ["K"])),
        "filter_numeric_ops": _filter(Filter("value", "between", ["10", "20.5"]), Filter("event_id", "gte", "100")),
        "filter_timestamp_day": _filter(Filter("ts", "between", ["2024-01-05", "2024-01-07"]), Filter("ts", "is_not", "2024-01-06")),
        "filter_parts": _filter(Filter("ts", "is_any_of", ["mon", "Sunday"], part="weekday"), Filter("ts", "lt", "12", part="hour")),
        "filter_mixed_fold": _filter(Filter("event_type", "is", "view"), Filter("value", "gt", "95", join="or"), Filter("user_id", "lte", "40")),
        "filter_date": _typed(Filter("d", "between", ["2024-01-05", "2024-01-09"]), Filter("d", "is_not", "2024-01-06")),
        "filter_date_ends": _typed(Filter("d", "on_or_before", "2024-01-02"), Filter("d", "after", "2024-01-28", join="or")),
        "json_breakdown": _json,
        "bd_sketch_top2": _bd("event_type", top_n=2, exact=False),
        "census_names": lambda spark, sf: catalog.census_by_name(_census(spark, sf)),
        "index_report": _index_report,
        "index_repair": _index_repair,
        "census_month": _census,
        "catalog_names": _names,
        "density_probe": _density,
        "index_build": _index_build,
        "index_refresh_antijoin": _index_refresh,
        "grid": _grid,
        "row_fuse": _row_fuse,
    }


def _group(bucket: str, value: str, where: str = "true", source: str = "events") -> str:
    return f"SELECT {bucket} AS bucket, {value} AS value FROM {source} WHERE {where} GROUP BY 1"


def _folded(labels: list[str], rows: str, n: int, rank: str = "count(*)", value: str = "count(*)", other: bool = True) -> str:
    """rows: SQL with the columns bucket, l0, l1, ..., e, x. The pick is a ROW_NUMBER and the hit a correlated EXISTS."""
    ls = [f"l{i}" for i in range(len(labels))]
    order = ", ".join(f"{x} ASC NULLS LAST" for x in ls)
    same = " AND ".join(f"t.{x} IS NOT DISTINCT FROM r.{x}" for x in ls)
    out = ", ".join((f"CASE WHEN hit OR {x} IS NULL THEN CAST({x} AS VARCHAR) ELSE '(other)' END" if other else x) + f" AS {lab}" for x, lab in zip(ls, labels, strict=True))
    keep = "" if other else "WHERE hit OR (" + " AND ".join(f"{x} IS NULL" for x in ls) + ")"
    return f"""WITH r AS ({rows}), t AS (SELECT * FROM (SELECT {", ".join(ls)}, row_number() OVER (ORDER BY {rank} DESC NULLS LAST, {order}) AS k FROM r GROUP BY {", ".join(ls)}) WHERE k <= {n}),
h AS (SELECT *, EXISTS (SELECT 1 FROM t WHERE {same}) AS hit FROM r)
SELECT bucket, {", ".join(labels)}, {value} AS value FROM (SELECT bucket, e, x, {out} FROM h {keep}) GROUP BY ALL"""


def _attributed(pick: str, where: str = "true", n: int = 8) -> str:
    """One label by a correlated sub-query on the history h(e, t, v)."""
    rows = f"SELECT date_trunc('day', m.ts) AS bucket, ({pick}) AS l0, m.user_id AS e, m.value AS x FROM events m WHERE {where}"
    return _folded(["breakdown_0"], rows, n)


def _pick(value: str, order: str, cond: str = "true", time: str = "ts") -> str:
    return f"SELECT {value} FROM events h WHERE h.user_id = m.user_id AND {value} IS NOT NULL AND {cond} ORDER BY h.{time} {order}, {value} DESC LIMIT 1"


def _active(w: int, labels: str = "", rows: str = "SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS e FROM events", where: str = "true") -> str:
    dims = f", {labels}" if labels else ""
    return f"SELECT bucket{dims}, count(DISTINCT e) AS value FROM (SELECT CAST(d + CAST(k AS INTEGER) AS DATE) AS bucket, e{dims} FROM ({rows}), range({w}) AS g(k)) WHERE {where} GROUP BY ALL"


def _carried_sql(value: str, cond: str, where: str, time: str, own: bool = False) -> str:
    """The last value by LAST_VALUE over a union of values (first at an instant) and counted rows."""
    seen = "last_value(v IGNORE NULLS) OVER (PARTITION BY e ORDER BY t, k, v NULLS FIRST ROWS UNBOUNDED PRECEDING)"
    rows = f"""SELECT date_trunc('day', t) AS bucket, {"coalesce(own, seen)" if own else "seen"} AS l0, e, x FROM (SELECT *, {seen} AS seen FROM (
    SELECT user_id AS e, {time} AS t, 0 AS k, {value} AS v, NULL AS own, NULL AS x FROM events WHERE {cond} AND {value} IS NOT NULL
    UNION ALL SELECT user_id, {time}, 1, NULL, {value}, value FROM events WHERE {where})) WHERE k = 1"""
    return _folded(["breakdown_0"], rows, 8)


def _retention_sql(table: str, e: str, t: str, days: int, n: int, kept: str, cohort: str) -> str:
    return f"""WITH c AS (SELECT {e} AS e, min({t}) AS s FROM {table} GROUP BY 1),
o AS (SELECT c.e, date_diff('day', CAST(s AS DATE), CAST(b.{t} AS DATE)) AS offset_days, b.* FROM {table} b JOIN c ON c.e = b.{e}),
p AS (SELECT DISTINCT e, offset_days // {days} AS k FROM (SELECT *, offset_days % {days} AS within_period_offset FROM o) WHERE offset_days // {days} BETWEEN 0 AND {n} AND ({kept})),
g AS (SELECT date_trunc('{cohort}', s) AS cohort, e, CAST(k AS INTEGER) AS period_index FROM c, range({n + 1}) AS r(k))
SELECT CAST(cohort AS TIMESTAMP) AS cohort, period_index, count(DISTINCT g.e) AS cohort_size, count(DISTINCT p.e) AS retained_entities, round(100.0 * count(DISTINCT p.e) / count(DISTINCT g.e), 2) AS retention_pct
FROM g LEFT JOIN p ON p.e = g.e AND p.k = period_index GROUP BY ALL"""


def _funnel_sql(steps: list[str], labels: list[str], within: int | None) -> str:
    ctes = [f"s0 AS (SELECT user_id AS e, min(ts) AS t, min(ts) AS f FROM events WHERE {steps[0]} GROUP BY 1)"]
    bound = f" AND date_diff('day', CAST(f AS DATE), CAST(b.ts AS DATE)) <= {within}" if within is not None else ""
    ctes += [f"s{i} AS (SELECT p.e, min(b.ts) AS t, min(f) AS f FROM s{i - 1} p JOIN events b ON b.user_id = p.e AND b.ts >= p.t WHERE ({s}){bound} GROUP BY 1)" for i, s in enumerate(steps) if i]
    arms = " UNION ALL ".join(f"SELECT {i} AS step_index, '{x}' AS step_label, (SELECT count(*) FROM s{i}) AS entities" for i, x in enumerate(labels))
    return f"WITH {', '.join(ctes)} SELECT *, round(100.0 * entities / (SELECT count(*) FROM s0), 2) AS pct_of_first FROM ({arms})"


def oracle_sql() -> dict[str, str]:
    day = "date_trunc('day', ts)"
    window = "ts >= TIMESTAMP '2023-12-22'"
    rows = lambda *ls, where="true", x="value": f"SELECT {day} AS bucket, {', '.join(f'{v} AS l{i}' for i, v in enumerate(ls))}, user_id AS e, {x} AS x FROM events WHERE {where}"
    b0 = ["breakdown_0"]
    three = ["event_type = 'view'", "event_type = 'click'", "event_type = 'purchase'"]
    index = "SELECT 'kind' AS column_key, user_id AS entity, ts AS at, event_type AS value, event_type AS event_name FROM events WHERE event_type IN ('signup', 'purchase')"
    lc = "lower(event_type)"
    mid = "ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-21'"
    dated = lambda sql: f"SELECT CAST(bucket AS DATE) AS bucket, breakdown_0, value, false AS incomplete FROM ({sql})"
    at = lambda pick: dated(_attributed(pick, mid.replace("ts ", "m.ts ")))
    sparse = "h.event_type IN ('signup', 'purchase')"
    rare = "h.event_type = 'purchase' AND h.user_id % 2 = 0"
    return {
        "events_total_day": _group(day, "count(*)"),
        "events_total_hour": _group("date_trunc('hour', ts)", "count(*)"),
        "events_total_week_mon": "SELECT CAST(date_trunc('week', ts) AS DATE) AS bucket, count(*) AS value, false AS incomplete FROM events WHERE ts >= TIMESTAMP '2023-12-04' AND ts < TIMESTAMP '2024-01-29' GROUP BY 1",
        "events_total_week_sun": "SELECT CAST(ts AS DATE) - CAST(dayofweek(ts) AS INTEGER) AS bucket, count(*) AS value, false AS incomplete FROM events WHERE ts >= TIMESTAMP '2023-12-03' AND ts < TIMESTAMP '2024-01-28' GROUP BY 1",
        "events_total_month": "SELECT CAST(date_trunc('month', ts) AS DATE) AS bucket, count(*) AS value, bool_or(date_trunc('month', ts) = TIMESTAMP '2024-01-01') AS incomplete FROM events WHERE ts >= TIMESTAMP '2023-11-01' GROUP BY 1",
        "events_total_dow": f"SELECT CAST(k AS INTEGER) AS bucket, count(ts) AS value, false AS incomplete FROM range(7) AS r(k) LEFT JOIN events ON isodow(ts) - 1 = k AND {window} GROUP BY 1",
        "events_total_hod": f"SELECT CAST(k AS INTEGER) AS bucket, count(ts) AS value, false AS incomplete FROM range(24) AS r(k) LEFT JOIN events ON hour(ts) = k AND {window} GROUP BY 1",
        "events_uniques_day": _group(day, "count(DISTINCT user_id)"),
        "events_average_day": _group(day, "CAST(count(*) AS DOUBLE) / count(DISTINCT user_id)"),
        "events_sum_day": _group(day, "round(sum(value), 4)"),
        "events_propavg_day": _group(day, "round(avg(value), 4)"),
        "events_median_day": _group(day, "round(quantile_cont(value, 0.5), 4)"),
        "events_distinct_day": f"SELECT bucket, round(avg(n), 4) AS value FROM (SELECT {day} AS bucket, user_id, count(DISTINCT {MAYBE}) AS n FROM events GROUP BY ALL) GROUP BY 1",
        "events_null_entity": _group(day, "CAST(count(*) AS DOUBLE) / count(DISTINCT CASE WHEN user_id % 3 > 0 THEN user_id END)"),
        "active_1": _active(1),
        "active_7": _active(7),
        "active_28": _active(28),
        "active_bounds": _active(7, where="bucket >= DATE '2024-01-10' AND bucket < DATE '2024-01-20'"),
        "active_by_type": _active(3, "breakdown_0", f"""SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS e, CASE WHEN event_type IN
            (SELECT event_type FROM events GROUP BY 1 ORDER BY count(*) DESC, event_type LIMIT 3) THEN event_type ELSE '(other)' END AS breakdown_0 FROM events"""),
        "active_by_first": _active(3, "breakdown_0", f"SELECT DISTINCT CAST(ts AS DATE) AS d, user_id AS e, ({_pick('event_type', 'ASC', chr(39).join(['h.event_type IN (', 'signup', ', ', 'purchase', ')']))}) AS breakdown_0 FROM events m"),
        "bd_rows_top2_other": _folded(b0, rows("event_type"), 2),
        "bd_rows_top2_drop": _folded(b0, rows("event_type"), 2, other=False),
        "bd_pair_top3": _folded([*b0, "breakdown_1"], rows("event_type", "user_id % 3"), 3),
        "bd_null_axis": _folded([*b0, "breakdown_1"], rows(MAYBE, "CASE WHEN user_id % 2 = 0 THEN user_id % 5 END"), 4),
        "bd_sum_rank": _folded(b0, rows("user_id % 10"), 4, "sum(x)", "round(sum(x), 4)"),
        "bd_uniques": _folded(b0, rows("event_type"), 3, value="count(DISTINCT e)"),
        "bd_first": _attributed(_pick("event_type", "ASC", "h.event_type IN ('signup', 'purchase')"), "m.event_type = 'view'"),
        "bd_last": _attributed(_pick("event_type", "DESC", "h.event_type IN ('signup', 'purchase')"), "m.event_type = 'view'"),
        "bd_last_until": _attributed(_pick("event_type", "DESC", "h.ts <= TIMESTAMP '2024-01-05'")),
        "bd_last_before_backfill": _attributed(f"SELECT coalesce(({_pick('event_type', 'DESC', 'h.ts < TIMESTAMP ' + repr('2024-01-02'))}), ({_pick('event_type', 'ASC')}))"),
        "bd_first_window": _attributed(_pick("event_type", "ASC", "h.ts >= TIMESTAMP '2024-01-10' AND h.ts <= TIMESTAMP '2024-01-12'")),
        "bd_carried": _carried_sql(SPARSE, "true", "event_type = 'view'", day),
        "bd_carried_fill": _carried_sql("event_type", "event_type IN ('purchase', 'signup')", "true", "ts"),
        "bd_carried_own": _carried_sql(MAYBE, "event_type = 'purchase'", "true", "ts", own=True),
        "bd_mixed": _folded([*b0, "breakdown_1", "breakdown_2"], f"""SELECT date_trunc('day', m.ts) AS bucket, m.user_id % 2 AS l0, ({_pick('event_type', 'DESC', "h.event_type IN ('signup', 'purchase') AND h.ts <= m.ts")}) AS l1,
            ({_pick('event_type', 'DESC')}) AS l2, m.user_id AS e, m.value AS x FROM events m""", 5),
        "values_table_tail": _carried_sql(SPARSE, "true", "true", "ts"),
        "values_table_complete": _attributed(_pick("event_type", "DESC", "h.event_type IN ('signup', 'purchase')")),
        "ret_orders_30d": _retention_sql("orders", "o_custkey", "o_orderdate", 30, 6, "true", "year"),
        "ret_orders_35d_window5": _retention_sql("orders", "o_custkey", "o_orderdate", 35, 6, "within_period_offset <= 5 AND o_orderstatus <> 'P'", "year"),
        "ret_lineitem_supplier": _retention_sql("lineitem", "l_suppkey", "l_shipdate", 7, 4, "l_quantity > 25", "month"),
        "ret_events_7d": _retention_sql("events", "user_id", "ts", 7, 3, "event_type = 'purchase'", "month"),
        "funnel_3step_unbounded": _funnel_sql(three, ["step_0", "step_1", "step_2"], None),
        "funnel_within_1d": _funnel_sql(three, ["step_0", "step_1", "step_2"], 1),
        "funnel_same_row_two_steps": _funnel_sql(["event_type IN ('view', 'click')", "event_type = 'click'", "value > 50"], ["seen", "clicked", "paid"], None),
        "overlay_shared_pick": f"""WITH r AS (SELECT CAST(ts AS DATE) AS bucket, event_type AS series, user_id % 7 AS l FROM events WHERE event_type IN ('view', 'click') AND {window}),
            t AS (SELECT l FROM r GROUP BY 1 ORDER BY count(*) DESC, l LIMIT 3)
            SELECT bucket, series, CASE WHEN l IN (SELECT l FROM t) THEN CAST(l AS VARCHAR) ELSE '(other)' END AS breakdown_0, count(*) AS value, bucket = DATE '2024-01-31' AS incomplete FROM r GROUP BY ALL""",
        "overlay_per_series": f"""SELECT CAST(ts AS DATE) AS bucket, event_type AS series, CASE WHEN min(event_type) = 'view' THEN count(*) ELSE count(DISTINCT user_id) END AS value, bool_or(CAST(ts AS DATE) = DATE '2024-01-31') AS incomplete
            FROM events WHERE event_type IN ('view', 'click') AND {window} GROUP BY ALL""",
        "overlay_any_of": f"""WITH r AS (SELECT CAST(ts AS DATE) AS bucket, 'seen' AS series, user_id % 7 AS l FROM events WHERE (event_type = 'view' OR event_type = 'click' AND value > 50) AND {window}
            UNION ALL SELECT CAST(ts AS DATE), 'click', user_id % 7 FROM events WHERE event_type = 'click' AND {window}), t AS (SELECT l FROM r GROUP BY 1 ORDER BY count(*) DESC, l LIMIT 2)
            SELECT bucket, series, CASE WHEN l IN (SELECT l FROM t) THEN CAST(l AS VARCHAR) ELSE '(other)' END AS breakdown_0, count(*) AS value, bucket = DATE '2024-01-31' AS incomplete FROM r GROUP BY ALL""",
        "value_at_first": at(_pick("event_type", "ASC", sparse)),
        "value_at_latest": at(_pick("event_type", "DESC", sparse)),
        "value_at_start": at(_pick("event_type", "DESC", "h.ts <= TIMESTAMP '2024-01-10'")),
        "value_at_start_fill": at(f"SELECT coalesce(({_pick('event_type', 'DESC', rare + ' AND h.ts <= TIMESTAMP ' + repr('2024-01-10'))}), ({_pick('event_type', 'ASC', rare)}))"),
        "value_at_end": at(_pick("event_type", "DESC", sparse + " AND h.ts < TIMESTAMP '2024-01-21'")),
        "value_at_event_fill": dated(_carried_sql(SPARSE, "true", mid, "ts")),
        "value_fill_from": dated(_carried_sql("event_type", "event_type = 'purchase'", mid, "ts", own=True)),
        "cyclic_fill": f"SELECT CAST(k AS INTEGER) AS bucket, count(ts) AS value, false AS incomplete FROM range(24) AS r(k) LEFT JOIN events ON hour(ts) = k AND event_type = 'signup' AND value > 99 AND {window} GROUP BY 1",
        "shared_pick": "SELECT user_id % 7 AS breakdown_0 FROM events WHERE event_type IN ('view', 'click') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3",
        "filter_string_ops": f"SELECT event_id, event_type, value FROM events WHERE ({lc} LIKE '%ic%' OR {lc} LIKE '%ur%') AND NOT ({lc} LIKE '%k')",
        "filter_numeric_ops": "SELECT event_id, event_type, value FROM events WHERE value >= 10 AND value <= 20.5 AND event_id >= 100",
        "filter_timestamp_day": "SELECT event_id, event_type, value FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-07')",
        "filter_parts": "SELECT event_id, event_type, value FROM events WHERE dayname(ts) IN ('Monday', 'Sunday') AND hour(ts) < 12",
        "filter_mixed_fold": "SELECT event_id, event_type, value FROM events WHERE (event_type = 'view' OR value > 95) AND user_id <= 40",
        "filter_date": "SELECT event_id, CAST(ts AS DATE) AS d FROM events WHERE CAST(ts AS DATE) IN (DATE '2024-01-05', DATE '2024-01-07', DATE '2024-01-08', DATE '2024-01-09')",
        "filter_date_ends": "SELECT event_id, CAST(ts AS DATE) AS d FROM events WHERE ts < TIMESTAMP '2024-01-03' OR ts >= TIMESTAMP '2024-01-29'",
        "bd_sketch_top2": _folded(b0, rows("event_type"), 2),
        "census_names": "SELECT event_type AS value, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1",
        "index_report": dated(_carried_sql(RARE, "true", mid, "ts")),
        "index_repair": "SELECT 'rare' AS column_key, user_id AS entity, ts AS at, event_type AS value, event_type AS event_name FROM events WHERE event_type = 'purchase' AND user_id % 2 = 0",
        "json_breakdown": _folded(b0, rows("json_extract_string(props, '$.k')"), 4),
        "census_month": "SELECT event_type AS value, CAST(date_trunc('month', ts) AS DATE) AS month, count(*) AS rows, min(ts) AS first_at, max(ts) AS last_at FROM events GROUP BY 1, 2",
        "catalog_names": "SELECT DISTINCT event_type AS value FROM events WHERE ts >= TIMESTAMP '2024-01-05'",
        "density_probe": "SELECT count(*) AS rows, count(*) FILTER (event_type IN ('signup', 'purchase')) AS with_value FROM events WHERE ts >= TIMESTAMP '2024-01-01 12:00:00'",
        "index_build": index,
        "index_refresh_antijoin": index,
        "grid": "SELECT CAST(n AS INTEGER) AS n FROM range(13) AS r(n)",
        "row_fuse": f"SELECT * FROM ({_group(day, 'count(*)')}) ORDER BY bucket DESC LIMIT 7",
    }
