"""Filters, windows, reports, the value index, sources and streams."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.functions.exprs import json_value
from tidemark.functions.timeaxis import bucket, epoch_unit, instant
from tidemark.operators.filters import Filter, combine, hour, named, number, predicate
from tidemark.operators.valueindex import Mapping, ValueIndex, column_key, with_fallback
from tidemark.plans.report import report
from tidemark.plans.runner import CapExceeded, estimate, missing_relation, run
from tidemark.plans.windows import normalized, window
from tidemark.sources import catalog, relations
from tidemark.specs import Breakdown

NOW = dt.datetime(2026, 3, 18, 15, 30)


@pytest.fixture(scope="module")
def rows(spark):
    data = [(1, "View", 10, dt.datetime(2026, 3, 1, 10), True, '{"a":{"b":"x"},"n":3}'), (2, "click", 20, dt.datetime(2026, 3, 2, 0), False, "{}"), (3, "", None, dt.datetime(2026, 3, 2, 23, 59), None, None), (4, None, 30, None, True, '{"a":[1]}')]
    return spark.createDataFrame(data, "id int, name string, n int, t timestamp_ntz, ok boolean, j string")


def ids(df, *filters):
    return [r["id"] for r in df.where(combine(df, list(filters))).orderBy("id").collect()]


@pytest.mark.parametrize(
    ("f", "want"),
    [
        (Filter("name", "is", "view"), []), (Filter("name", "is", "view", match_case=False), [1]), (Filter("name", "contains", ["VI", "ck"]), [1, 2]), (Filter("name", "not_contains", ["VI"]), [2, 3]),
        (Filter("name", "is_empty"), [3]), (Filter("name", "is_not_empty"), [1, 2]), (Filter("name", "is_null"), [4]), (Filter("name", "is_none_of", ["click"]), [1, 3]), (Filter("n", "between", ["10", "20"]), [1, 2]),
        (Filter("n", "is_not", "10"), [2, 4]), (Filter("ok", "is_false"), [2]), (Filter("t", "is", "2026-03-02"), [2, 3]), (Filter("t", "after", "2026-03-01"), [2, 3]), (Filter("t", "on_or_before", "2026-03-01"), [1]),
        (Filter("t", "before", "2026-03-02 00:00:00"), [1]), (Filter("t", "is", "2026-03-01", part="start_of_month"), [1, 2, 3]), (Filter("t", "is", "10am", part="hour"), [1]), (Filter("t", "is", "sun", part="weekday"), [1]),
        (Filter("j", "is", "x", json_path="a.b"), [1]), (Filter("j", "gt", "2", json_path="n"), [1]), (Filter("j", "is_not_null", json_path="a"), []),
    ],
)
def test_filters(rows, f, want):
    assert ids(rows, f) == want


def test_filters_fold_from_the_left(rows):
    assert ids(rows, Filter("n", "is", "10"), Filter("n", "is", "30", join="or"), Filter("ok", "is_true")) == [1, 4]


@pytest.mark.parametrize("f", [Filter("n", "contains", ["1"]), Filter("name", "gt", "1"), Filter("n", "is", "1.5"), Filter("n", "is", None), Filter("t", "is", "x", part="century"), Filter("t", "gt", "25", part="hour")])
def test_filters_refuse(rows, f):
    with pytest.raises(ValueError):
        predicate(rows, f)


def test_texts():
    assert (number("1,234.5"), number("1.234,5", ","), hour("12am"), hour("3:30 pm"), named("tu", ("Monday", "Tuesday"))) == ("1234.5", "1234.5", 0, 15, "Tuesday")
    for bad in (lambda: hour("24"), lambda: named("t", ("Tuesday", "Thursday")), lambda: number("x")):
        with pytest.raises(ValueError):
            bad()


def test_time(spark):
    df = spark.createDataFrame([(dt.datetime(2026, 3, 29, 0, 30), 1774744200)], "t timestamp_ntz, s long")
    r = df.select(instant("s", "unix_s").alias("u"), bucket(instant("t"), "hour", "Europe/Berlin").alias("h"), bucket(instant("t"), "week", "UTC", "sunday").alias("w"), bucket(instant("t"), "day_of_week").alias("d"), instant("t", "Europe/Berlin").alias("z")).first()
    assert (r["u"], r["h"], r["w"], r["d"], r["z"]) == (dt.datetime(2026, 3, 29, 0, 30), dt.datetime(2026, 3, 29, 1), dt.date(2026, 3, 29), 6, dt.datetime(2026, 3, 28, 23, 30))
    assert [epoch_unit(x) for x in (None, 1.7e9, 1.7e12, 1.7e15)] == ["unix_s", "unix_s", "unix_ms", "unix_us"]
    with pytest.raises(ValueError):
        instant("t", "mars")


@pytest.mark.parametrize(
    ("form", "start", "end"),
    [
        ({"range_mode": "last", "range_unit": "day", "range_n": 7}, "2026-03-11 00:00", None), ({"range_mode": "last", "range_unit": "week", "range_n": 2, "grain": "week"}, "2026-03-02 00:00", "2026-03-16 00:00"),
        ({"range_mode": "last", "range_unit": "month", "range_n": 2, "grain": "month", "include_current": True}, "2026-02-01 00:00", None), ({"range_mode": "this", "range_unit": "month"}, "2026-03-01 00:00", None),
        ({"range_mode": "previous", "range_unit": "quarter"}, "2025-10-01 00:00", "2026-01-01 00:00"), ({"range_mode": "custom", "start_date": "2026-01-05", "end_date": "2026-01-20", "grain": "month"}, "2026-01-01 00:00", "2026-02-01 00:00"),
        ({"range_mode": "custom", "custom_kind": "relative", "range_unit": "day", "custom_from": 3, "custom_to": 1}, "2026-03-15 00:00", "2026-03-18 00:00"), ({"range_mode": "last", "range_unit": "hour", "range_n": 5, "grain": "hour"}, "2026-03-18 10:30", None),
        ({"range_mode": "this", "range_unit": "day", "timezone": "Asia/Tokyo"}, "2026-03-18 15:00", None),
    ],
)
def test_windows(spark, form, start, end):
    a, b = window(form, NOW)
    r = spark.range(1).select(a.alias("a"), (F.lit(None) if b is None else b).alias("b")).first()
    assert (str(r["a"])[:16], str(r["b"])[:16] if r["b"] else None) == (start, end)


def test_a_window_is_not_finer_than_the_grain():
    assert normalized({"grain": "month", "range_mode": "this", "range_unit": "day"}) == ("this", "month", 1)
    assert normalized({"grain": "week", "range_mode": "last", "range_unit": "day", "range_n": 3}) == ("last", "week", 8)


def test_report_limits_and_gaps(spark, rows):
    form = {"table": rows, "entity": "id", "event_time": "t", "measure": "total", "range_mode": "last", "range_unit": "day", "range_n": 60, "exact": True}
    out = report(spark, form | {"grain": "day_of_week", "week_start": "sunday"}, NOW).collect()
    assert [r["bucket"] for r in out] == [6, 0, 1, 2, 3, 4, 5] and [r["value"] for r in out] == [1, 2, 0, 0, 0, 0, 0]
    assert [str(r["bucket"]) for r in report(spark, form | {"row_limit": 1}, NOW).collect()] == ["2026-03-02"]
    with pytest.raises(ValueError):
        report(spark, form | {"series": [{"event": str(i)} for i in range(9)], "event_column": "name"}, NOW)


def test_value_index_lives(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    data = [("a", day(1), "e1", "x"), ("a", day(5), "e1", None), ("b", day(2), None, "y"), ("b", day(9), "", "z"), *[("c", day(10), "e2", None)] * 20]
    schema = "u string, t timestamp_ntz, e string, plan string"
    source = spark.createDataFrame(data, schema)
    mapping = Mapping("s", "u", "t", "e")
    now = dt.datetime(2026, 1, 12)
    index = ValueIndex(spark, str(tmp_path), source, mapping, now)
    assert index.plan(["plan"], probe=False) == {"plan": "live"}
    index.apply(index.plan(["plan"]))
    assert index.read().count() == 3 and index.plan(["plan"]) == {"plan": "attach"}
    # later: new rows, late ones among them
    more = spark.createDataFrame([*data, ("c", day(8), "e1", "w"), ("d", day(11), "e3", "v")], schema)
    index = ValueIndex(spark, str(tmp_path), more, mapping, now + dt.timedelta(days=8))
    plan = index.plan(["plan"])
    assert plan == {"plan": "refresh"}
    index.apply(plan)
    assert index.read().count() == 5
    index.apply({"plan": "refresh"})
    assert index.read().count() == 5  # nothing twice
    b = index.attach(Breakdown("plan", at="last"))
    assert b.values is not None and b.complete_until is not None
    from tidemark.operators.events import events
    from tidemark.specs import EventsSpec

    both = [sorted(map(str, events(spark, EventsSpec(more, "u", "t", "total", breakdowns=(x,), exact=True, event_time_column="t")).collect())) for x in (b, Breakdown("plan", at="last"))]
    assert both[0] == both[1]
    # rows that vanish from the index are noticed
    index.entries["plan"].counts['"e1"'] = 99
    index.apply({"plan": "refresh"})
    assert index.read().count() == 5
    late = ValueIndex(spark, str(tmp_path), more, mapping, now + dt.timedelta(days=200))
    assert late.sweep(["plan"]) == [] and late.sweep([]) == ["plan"] and not late.exists("plan")
    assert ValueIndex(spark, str(tmp_path), more, Mapping("s", "u", "t", "other"), now).entries == {}
    assert column_key("a + b").startswith("x") and column_key("a") == "a"


def test_an_index_leaves_narrowed_breakdowns_alone_unless_names_say_how(spark, tmp_path):
    from tidemark.operators.events import events
    from tidemark.specs import EventsSpec

    day = lambda n: dt.datetime(2026, 1, n)
    source = spark.createDataFrame([("a", day(1), "e1", "x"), ("a", day(2), "e2", "y"), ("a", day(3), "e3", None), *[("c", day(4), "e3", None)] * 20], "u string, t timestamp_ntz, e string, plan string")
    index = ValueIndex(spark, str(tmp_path), source, Mapping("s", "u", "t", "e"), dt.datetime(2026, 1, 12))
    index.apply({"plan": "build"} | index.plan(["plan"]))
    b = Breakdown("plan", at="carried", fill_from="e = 'e1'")
    assert index.attach(b) is b
    run = lambda x: sorted(map(str, events(spark, EventsSpec(source, "u", "t", "total", breakdowns=(x,), exact=True, event_time_column="t")).collect()))
    assert run(index.attach(b, ["e1"])) == run(b)


def test_an_index_of_many_names_counts_them_together(spark, tmp_path, monkeypatch):
    from tidemark.operators import valueindex

    monkeypatch.setattr(valueindex, "MAX_NAMES", 1)
    monkeypatch.setattr(valueindex, "MAX_BROADCAST", 0)
    day = lambda n: dt.datetime(2026, 1, n)
    data = [("a", day(1), "e1", "x"), ("b", day(2), "e2", "y"), *[("c", day(4), "e3", None)] * 20]
    schema = "u string, t timestamp_ntz, e string, plan string"
    index = ValueIndex(spark, str(tmp_path), spark.createDataFrame(data, schema), Mapping("s", "u", "t", "e"), dt.datetime(2026, 1, 12))
    index.apply(index.plan(["plan"]))
    assert index.entries["plan"].counts == {"*": 2}
    index.source = spark.createDataFrame([*data, ("d", day(2), "e2", "z")], schema)
    index.apply({"plan": "refresh"})
    assert index.read().count() == 3 and index.entries["plan"].counts == {"*": 3}


def test_no_entity_is_no_one(spark):
    from tidemark.operators.funnel import funnel
    from tidemark.operators.retention import retention
    from tidemark.specs import FunnelSpec, RetentionSpec

    day = lambda n: dt.datetime(2026, 1, n)
    source = spark.createDataFrame([("a", day(1), "x"), ("a", day(9), "y"), (None, day(1), "x"), (None, day(9), "y"), ("b", day(2), "x")], "u string, t timestamp_ntz, e string")
    out = retention(spark, RetentionSpec(source, "u", "t", "t", 7, 1, "true")).collect()
    assert [(r["period_index"], r["cohort_size"], r["retained_entities"]) for r in out] == [(0, 2, 2), (1, 2, 1)]
    only = retention(spark, RetentionSpec(source.where("u IS NULL"), "u", "t", "t", 7, 1, "true")).collect()
    assert [(r["period_index"], r["cohort_size"], r["retained_entities"], r["retention_pct"]) for r in only] == [(0, 0, 0, None), (1, 0, 0, None)]
    steps = funnel(spark, FunnelSpec(source, "u", "t", ("e = 'x'", "e = 'y'"))).collect()
    assert [r["entities"] for r in steps] == [3, 1]


def test_an_index_repairs_names_and_is_recovered(spark, tmp_path):
    day = lambda n: dt.datetime(2026, 1, n)
    data = [("a", day(1), "e1", "x"), ("b", day(2), "e2", "y"), ("d", day(3), None, "z"), *[("c", day(4), "e3", None)] * 20]
    schema = "u string, t timestamp_ntz, e string, plan string"
    source, mapping, now = spark.createDataFrame(data, schema), Mapping("s", "u", "t", "e"), dt.datetime(2026, 1, 12)
    index = ValueIndex(spark, str(tmp_path), source, mapping, now)
    index.apply(index.plan(["plan"]))
    before = catalog.census_by_name(catalog.census(source, "e", "t"))
    index.source = spark.createDataFrame([r for r in data if r[2] != "e1"] + [("q", day(1), "e2", "w")], schema)
    names = index.repair_names(catalog.census_by_name(catalog.census(index.source, "e", "t")), before)
    assert sorted(names) == ["e1", "e2"] and sorted(r["value"] for r in index.read().collect()) == ["w", "y", "z"]
    index.forget_names([None])
    assert sorted(r["value"] for r in index.read().collect()) == ["w", "y"]
    index.entries = {}
    index._save()
    assert index.reconcile(["other", "plan"]) == ["plan"] and index.plan(["plan"], probe=False) == {"plan": "attach"}
    index.entries["lost"] = type(index.entries["plan"])("lost", complete_until="2026-01-01")
    assert index.reconcile(["plan"]) == [] and set(index.entries) == {"plan"}
    other = ValueIndex(spark, str(tmp_path), source, Mapping("s", "u", "t", "x"), now)
    assert other.reconcile(["plan"]) == [] and not other.exists("plan")  # written under another mapping
    index.forget_names(["e1", "e2"])
    assert index.plan(["plan"], probe=False) != {"plan": "attach"}


def test_census_is_kept(spark, tmp_path):
    at = lambda m, d: dt.datetime(2026, m, d)
    data = [("a", at(1, 5)), ("a", at(2, 5)), ("b", at(2, 6))]
    cache, now = catalog.CensusCache(spark, str(tmp_path / "census")), dt.datetime(2026, 2, 10)
    read = lambda rows, now, key="s": sorted((r["value"], r["month"].month, r["rows"]) for r in cache.get(spark.createDataFrame(rows, "e string, t timestamp_ntz"), key, "e", "t", now).collect())
    assert read(data, now) == [("a", 1, 1), ("a", 2, 1), ("b", 2, 1)]
    more = [*data, ("b", at(2, 20)), ("b", at(1, 1))]
    assert read(more, now + dt.timedelta(hours=1)) == read(data, now)  # fresh enough
    assert read(more, now + dt.timedelta(days=20)) == [("a", 1, 1), ("a", 2, 1), ("b", 2, 2)]  # months long past aren't counted again
    assert read(more, now + dt.timedelta(days=20), "t") == [("a", 1, 1), ("a", 2, 1), ("b", 1, 1), ("b", 2, 2)]


def test_layouts_are_judged(spark, tmp_path):
    rows = spark.range(4000).select((F.col("id") % 4).alias("k"), F.expr("TIMESTAMP_NTZ '2026-01-01' + make_interval(0, 0, 0, 0, id)").alias("t"), F.concat(F.lit("e"), (F.col("id") % 3).cast("string")).alias("e"))
    rows.repartition(4).write.parquet(str(tmp_path / "flat"))
    relations.replace(rows, "laid_out", day_of="t", cluster_by=("e",))
    flat = {x["check"]: x["ok"] for x in catalog.diagnose(spark.read.parquet(str(tmp_path / "flat")), "t", "e", least=0)}
    laid = {x["check"]: x["ok"] for x in catalog.diagnose(spark.table("laid_out"), "t", "e", least=0)}
    assert not flat["partitions"] and not flat["time"] and laid["partitions"] and laid["time"] and not laid["events"]
    assert catalog.layout(spark, "laid_out")["partition"] == ["event_day"]
    assert catalog.bytes_touched(spark.table("laid_out"), "t < TIMESTAMP_NTZ '2026-01-02'") < catalog.bytes_touched(spark.table("laid_out"))
    relations.replace(rows, "sorted_only", cluster_by=("e",))
    assert spark.table("sorted_only").count() == 4000


def test_access_and_problems(spark, tmp_path):
    from tidemark.plans.runner import problem

    spark.range(3).write.parquet(str(tmp_path / "x"))
    assert catalog.access(spark, str(tmp_path / "x"), str(tmp_path / "out")) == {"read": True, "write": True, "problem": None}
    assert catalog.access(spark, str(tmp_path / "none")) == {"read": False, "write": None, "problem": "missing_relation"}
    kinds = []
    for sql in ("SELECT no_such FROM range(1)", "SELEC 1", "SELECT no_such(1)", "SELECT * FROM no_such", "SELECT 1 + ARRAY(1)"):
        with pytest.raises(Exception) as e:
            spark.sql(sql).collect()
        kinds.append(problem(e.value))
    assert kinds == ["missing_column", "syntax", "unknown_function", "missing_relation", "wrong_type"]
    assert [problem(x) for x in (CapExceeded(2, 1), TimeoutError(), PermissionError("Permission denied"), ValueError("x"))] == ["too_large", "timeout", "no_permission", "other"]


def test_preferences(spark, tmp_path):
    from tidemark.operators.filters import shown_hour, shown_number
    from tidemark.plans.preferences import Preferences

    own = Preferences(spark, str(tmp_path / "settings.json"))
    assert own.all()["timezone"] == "UTC" and own.set(week_start="sunday", top_n=5)["top_n"] == 5
    assert own.form({"top_n": 3})["top_n"] == 3 and own.form({})["week_start"] == "sunday"
    for bad in ({"week_start": "friday"}, {"nothing": 1}, {"top_n": "5"}, {"exact": 1}):
        with pytest.raises(ValueError):
            own.set(**bad)
    (tmp_path / "old.json").write_text('{"grain": "century", "old": 1, "exact": true}')
    own = Preferences(spark, str(tmp_path / "old.json"))
    assert own.all()["grain"] == "day" and own.all()["exact"] is True
    assert [hour(shown_hour(h, s)) for h in (0, 9, 12, 23) for s in ("12", "24")] == [0, 0, 9, 9, 12, 12, 23, 23]
    assert [float(number(shown_number(x, d), d)) for x in (1234567, 1234.5) for d in (".", ",")] == [1234567, 1234567, 1234.5, 1234.5]


def test_time_of_day_filters(spark):
    spark.conf.set("spark.sql.timeType.enabled", "true")
    df = spark.sql("SELECT id, make_time(CAST(id AS INT), 30, CAST(0 AS DECIMAL(16, 6))) AS h FROM range(24)")
    assert ids(df, Filter("h", "before", "02:00")) == [0, 1] and ids(df, Filter("h", "between", ["22:00", "23:45"])) == [22, 23]


def test_density_gate(spark, tmp_path):
    source = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), "e", "x")], "u string, t timestamp_ntz, e string, plan string")
    index = ValueIndex(spark, str(tmp_path), source, Mapping("s", "u", "t", "e"), dt.datetime(2026, 1, 2))
    assert index.plan(["plan"]) == {"plan": "live"} and index.entries["plan"].density == 1.0


def test_runner(spark, rows):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert 0 < estimate(events.select("user_id")) < estimate(events) and estimate(rows) is None
    with pytest.raises(CapExceeded):
        run(events, cap_bytes=1)
    assert len(run(rows, limit=2).rows) == 2
    with pytest.raises(Exception) as e:
        spark.table("no_such_table").count()
    assert missing_relation(e.value)
    assert with_fallback(lambda: spark.table("no_such_table").count(), lambda: 7) == 7


def test_sources(spark, rows, tmp_path):
    assert catalog.epoch_kind(spark.createDataFrame([(1_700_000_000_000,)], "x long"), "x") == "unix_ms"
    assert [c["family"] for c in catalog.columns(rows)] == ["numeric", "string", "numeric", "timestamp", "boolean", "string"]
    rows.write.orc(str(tmp_path / "r.orc"))
    assert relations.relation(spark, str(tmp_path / "r.orc")).count() == 4
    relations.replace(rows, "made", comment="it's")
    assert relations.fingerprint(spark, "made") == "it's" and relations.fingerprint(spark, "none_such") is None
    relations.append(rows, "made")
    assert relations.relation(spark, "made").count() == 8 and "made" in catalog.tables(spark)
    assert rows.select(json_value("j", "a").alias("x")).where("x IS NOT NULL").count() == 0


def test_stream_keeps_an_index(spark, tmp_path):
    from tidemark.streaming.upkeep import index_stream, totals

    (tmp_path / "in").mkdir()
    df = spark.createDataFrame([("a", dt.datetime(2026, 1, 1), "e", "x"), ("a", dt.datetime(2026, 1, 1), "e", "x"), ("b", dt.datetime(2026, 1, 1), "e", None)], "u string, t timestamp_ntz, e string, plan string")
    df.write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = index_stream(stream, {"plan": "plan"}, "u", "t", "e", str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 1
    q = totals(stream, "t").writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("totals").first()["total"] == 3
