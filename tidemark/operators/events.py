"""Time series of events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, quoted, refuse
from tidemark.operators.attribution import METRIC, attribute
from tidemark.operators.fold import fold, top_labels
from tidemark.operators.measures import BUCKET, ENTITY, OF, TIME, active, aggregate
from tidemark.sources.relations import relation
from tidemark.specs import EventsSpec


def prepared(spark: SparkSession, spec: EventsSpec, extra: dict[str, Column] | None = None) -> tuple[DataFrame, list[str]]:
    """Counted rows with entity, bucket, property, labels and extra columns of the caller's; and the labels' names."""
    # event_ts is the instant's public name, unless the source has a column of that name, which then stays what it is.
    df = refuse(relation(spark, spec.source), ())
    own = "event_ts" in {c.lower() for c in df.columns}
    history = df.withColumns({TIME: col(spec.event_time), ENTITY: col(spec.entity)})
    if not own:
        history = history.withColumn("event_ts", F.col(TIME))
    where = F.lit(True) if spec.where is None else col(spec.where)
    slices = {f"__tm_slice_{i}": b for i, b in enumerate(spec.slices)}
    if any(b.at != "rows" for b in slices.values()):
        rows = attribute(history.withColumn(METRIC, F.coalesce(where, F.lit(False))), slices, spec.event_time_column)
    else:
        rows = (history if spec.where is None else history.where(where)).withColumns({k: col(b.expr) for k, b in slices.items()})
    default = F.date_trunc("DAY", F.col(TIME)).cast("timestamp_ntz")
    rows = rows.select(F.col(ENTITY), (default if spec.bucket is None else col(spec.bucket)).alias(BUCKET), *([] if spec.of is None else [col(spec.of).alias(OF)]), *(F.col(k).alias(x) for k, x in zip(slices, spec.labels, strict=True)), *(c.alias(k) for k, c in (extra or {}).items()))
    return rows, list(spec.labels)


def series(spark: SparkSession, spec: EventsSpec, members: Column, name: str = "series") -> DataFrame:
    """Several series of one measure from one scan: bucket, a column for each breakdown, the series, value.

    members: for each row the array of series that count it. The pick of labels is shared by all series, a row counting
    for each of its own.
    """
    rows, labels = prepared(spark, spec, {name: members})
    rows = rows.withColumn(name, F.explode(name))
    if labels:
        rows = fold(rows, top_labels(rows, labels, spec.top_n, spec.exact, _rank(spec)), labels, spec.top_n, spec.include_other)
    return measured(rows, spec, [*labels, name])


def measured(rows: DataFrame, spec: EventsSpec, labels: list[str]) -> DataFrame:
    if spec.measure == "active":
        return active(rows, spec.window_days, labels, spec.report_from, spec.report_until)
    return aggregate(rows, spec.measure, spec.on, spec.exact, labels)


def _rank(spec: EventsSpec):
    return F.sum(OF) if spec.on == "property" and spec.measure == "sum" else None


def shared_labels(spark: SparkSession, specs: list[EventsSpec]) -> DataFrame:
    """One pick of label tuples over the rows of all specs, ranked as the first one ranks."""
    first = specs[0]
    if not first.breakdowns or any((len(s.breakdowns), s.top_n, s.exact) != (len(first.breakdowns), first.top_n, first.exact) for s in specs):
        raise ValueError("shared labels need specs with as many breakdowns, the same top_n and exact")
    rows = None
    for s in specs:
        own, labels = prepared(spark, s)
        own = own.select(*([F.col(OF)] if _rank(first) is not None else []), *(quoted(x).alias(y) for x, y in zip(labels, first.labels, strict=True)))
        rows = own if rows is None else rows.unionByName(own)
    return top_labels(rows, list(first.labels), first.top_n, first.exact, _rank(first))


def events(spark: SparkSession, spec: EventsSpec, top: DataFrame | None = None) -> DataFrame:
    """bucket, a column for each breakdown, value. top: label tuples to keep instead of the spec's own pick."""
    rows, labels = prepared(spark, spec)
    if labels:
        picked = top_labels(rows, labels, spec.top_n, spec.exact, _rank(spec)) if top is None else top
        rows = fold(rows, picked, labels, spec.top_n, spec.include_other)
    return measured(rows, spec, labels).orderBy("bucket", *(quoted(x) for x in labels))
