"""Rules on small tables, with results counted by hand."""

import datetime as dt
import random

import pytest

from tidemark.operators.events import events
from tidemark.operators.funnel import funnel
from tidemark.operators.retention import retention
from tidemark.specs import Breakdown, EventsSpec, FunnelSpec, RetentionSpec, Values


def day(n, h=0):
    return dt.datetime(2026, 1, 1) + dt.timedelta(days=n - 1, hours=h)


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def values(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def plans(spark):
    rows = [("S1", day(1), "bronze"), ("S1", day(3), None), ("S1", day(5), "silver"), ("S1", day(5), "gold"), ("S1", day(7), None), ("S2", day(2), None), (None, day(2), "gold"), ("S3", None, "gold"), ("S3", day(4), None)]
    return frame(spark, rows, "e string, t timestamp_ntz, v string")


def labels(spark, df, b, **spec):
    out = events(spark, EventsSpec(df, "e", "t", "total", breakdowns=(b,), exact=True, **spec))
    return sorted(((str(r[0])[:10], r[1], r[2]) for r in out.collect()), key=str)


def test_ties_and_bounds(spark, plans):
    where = "v IS NULL AND t IS NOT NULL"
    at = lambda **b: {k[0]: k[1] for k in labels(spark, plans, Breakdown("v", **b), where=where)}
    assert at(at="last")["2026-01-07"] == "silver"  # the greatest of two at one instant
    assert at(at="first")["2026-01-07"] == "bronze"
    assert at(at="last", until="TIMESTAMP_NTZ '2026-01-05 00:00:00'")["2026-01-03"] == "silver"
    assert at(at="last", before="TIMESTAMP_NTZ '2026-01-05 00:00:00'")["2026-01-03"] == "bronze"
    assert at(at="last", before="TIMESTAMP_NTZ '2026-01-01 00:00:00'")["2026-01-03"] is None
    assert at(at="last", before="TIMESTAMP_NTZ '2026-01-01 00:00:00'", backfill=True)["2026-01-03"] == "bronze"
    assert at(at="carried")["2026-01-03"] == "bronze"
    assert at(at="carried")["2026-01-07"] == "silver"
    assert at(at="last")["2026-01-04"] is None  # a value without an instant is not recorded


def test_slices_add_up(spark, plans):
    for mode in ("rows", "first", "last", "carried"):
        assert sum(r[2] for r in labels(spark, plans, Breakdown("v", at=mode))) == plans.count()


def test_index_equals_history(spark):
    random.seed(7)
    rows = [(random.choice(["a", "b", "c", None]), day(random.randint(1, 12), random.randint(0, 2)), random.choice(["x", "y", "z", None])) for _ in range(300)]
    df = frame(spark, rows, "e string, t timestamp_ntz, v string")
    recorded = df.selectExpr("e AS entity", "t AS at", "v AS value").where("value IS NOT NULL AND entity IS NOT NULL")
    old = recorded.where("at <= TIMESTAMP_NTZ '2026-01-06 00:00:00'")
    stop = "TIMESTAMP_NTZ '2026-01-06 00:00:00'"
    for b in ({"at": "first"}, {"at": "last"}, {"at": "carried"}, {"at": "last", "until": stop}, {"at": "last", "before": "TIMESTAMP_NTZ '2026-01-03 00:00:00'", "backfill": True}, {"at": "carried", "own_value_first": True}):
        live = labels(spark, df, Breakdown("v", **b))
        assert labels(spark, df, Breakdown("v", values=Values(recorded), **b)) == live
        assert labels(spark, df, Breakdown("v", values=Values(old), complete_until=stop, **b), event_time_column="t") == live


def test_null_axis_is_not_folded(spark):
    rows = [("a", day(1), c, b) for c, b, n in (("US", "Chrome", 5), ("US", "Firefox", 4), (None, "Chrome", 3), ("DE", None, 2), (None, None, 1), ("FR", "Opera", 1)) for _ in range(n)]
    df = frame(spark, rows, "e string, t timestamp_ntz, c string, b string")
    spec = {"source": df, "entity": "e", "event_time": "t", "measure": "total", "breakdowns": ("c", "b"), "top_n": 3, "exact": True}
    got = {(r[1], r[2]): r[3] for r in events(spark, EventsSpec(**spec)).collect()}
    assert got == {("US", "Chrome"): 5, ("US", "Firefox"): 4, (None, "Chrome"): 3, ("(other)", None): 2, (None, None): 1, ("(other)", "(other)"): 1}
    got = {(r[1], r[2]): r[3] for r in events(spark, EventsSpec(**spec, include_other=False)).collect()}
    assert got == {("US", "Chrome"): 5, ("US", "Firefox"): 4, (None, "Chrome"): 3, (None, None): 1}


def test_active_equals_brute_force(spark):
    random.seed(3)
    rows = [(random.choice("abcdef") if random.random() > 0.1 else None, day(random.choice([*range(1, 9), *range(20, 26)]))) for _ in range(60)]
    df = frame(spark, rows, "e string, t timestamp_ntz")
    for w in (1, 2, 3, 7, 30):
        got = {r[0]: r[1] for r in events(spark, EventsSpec(df, "e", "t", "active", window_days=w)).collect()}
        want = {}
        for d in range(1, 60):
            n = len({e for e, t in rows if e and 0 <= (day(d) - t).days < w})
            if n:
                want[day(d).date()] = n
        assert got == want


def test_null_entity(spark):
    df = frame(spark, [("a", day(1)), ("a", day(1)), (None, day(1))], "e string, t timestamp_ntz")
    value = lambda m: events(spark, EventsSpec(df, "e", "t", m, exact=True)).collect()[0]["value"]
    assert (value("total"), value("uniques"), value("average")) == (3, 1, 3.0)


def test_property_distinct_counts_entities_without_values(spark):
    df = frame(spark, [("a", day(1), "x"), ("a", day(1), "y"), ("b", day(1), None)], "e string, t timestamp_ntz, v string")
    assert events(spark, EventsSpec(df, "e", "t", "distinct", on="property", of="v", exact=True)).collect()[0]["value"] == 1.0


def test_funnel_order_ties_and_window(spark):
    rows = [("a", day(1), "s"), ("a", day(1), "p"), ("b", day(2), "p"), ("b", day(3), "s"), ("c", day(1, 23), "s"), ("c", day(2, 1), "p"), (None, day(1), "s"), (None, day(2), "p")]
    df = frame(spark, rows, "e string, t timestamp_ntz, n string")
    count = lambda **k: [r["entities"] for r in funnel(spark, FunnelSpec(df, "e", "t", ("n = 's'", "n = 'p'"), **k)).collect()]
    assert count() == [4, 2]
    assert count(within_days=0) == [4, 1]  # midnight lies between, though it is two hours


def test_retention_matrix(spark):
    pay = [("s1", 5, "ok"), ("s1", 40, "ok"), ("s1", 76, "late"), ("s2", 6, "ok"), ("s3", 7, "ok"), ("s3", 44, "ok")]
    df = frame(spark, [(e, day(d), s) for e, d, s in pay], "e string, t timestamp_ntz, s string")
    out = retention(spark, RetentionSpec(df, "e", "t", "t", 35, 2, "within_period_offset <= 5 AND s = 'ok'")).collect()
    assert [(r["period_index"], r["cohort_size"], r["retained_entities"], r["retention_pct"]) for r in out] == [(0, 3, 3, 100.0), (1, 3, 2, 66.67), (2, 3, 0, 0.0)]
    with pytest.raises(ValueError):
        retention(spark, RetentionSpec(df.withColumnRenamed("s", "period_index"), "e", "t", "t", 35, 2, "true"))


def test_retention_of_nobody(spark):
    df = frame(spark, [(None, day(1))], "e string, t timestamp_ntz")
    assert [(r["cohort_size"], r["retention_pct"]) for r in retention(spark, RetentionSpec(df, "e", "t", "t", 7, 1, "true")).collect()] == [(0, None), (0, None)]


def test_empty_table(spark):
    df = frame(spark, [], "e string, t timestamp_ntz, v string")
    assert events(spark, EventsSpec(df, "e", "t", "total", breakdowns=(Breakdown("v", at="carried"),))).count() == 0
    assert [r["entities"] for r in funnel(spark, FunnelSpec(df, "e", "t", ("true", "true"))).collect()] == [0, 0]
