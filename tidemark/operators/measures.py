"""Measures of a bucket: totals, distinct entities, and aggregates of a property."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, quoted, ratio
from tidemark.specs import Expr

ENTITY, TIME, BUCKET, OF = "__tm_entity", "__tm_time", "__tm_bucket", "__tm_of"


def distinct_count(c: Column, exact: bool) -> Column:
    return F.count_distinct(c) if exact else F.approx_count_distinct(c)


def aggregate(rows: DataFrame, measure: str, on: str, exact: bool, labels: list[str]) -> DataFrame:
    """bucket, labels, value of prepared rows (ENTITY, BUCKET, OF and the labels)."""
    keys = [F.col(BUCKET).alias("bucket"), *(quoted(x) for x in labels)]
    if on == "property" and measure == "distinct":
        # A row for each entity first: its share of a bucket is counted where its rows are, and then averaged.
        per = rows.where(F.col(ENTITY).isNotNull()).groupBy(*keys, F.col(ENTITY)).agg(distinct_count(F.col(OF), exact).alias("n"))
        return per.groupBy("bucket", *(quoted(x) for x in labels)).agg(F.avg("n").alias("value"))
    if on == "property":
        value = {"sum": F.sum, "average": F.avg, "median": F.median if exact else lambda c: F.percentile_approx(c, 0.5)}[measure](F.col(OF))
    else:
        entities = distinct_count(F.col(ENTITY), exact)
        value = {"total": F.count("*"), "uniques": entities, "average": ratio(F.count("*"), entities)}[measure]
    return rows.groupBy(*keys).agg(value.alias("value"))


def active(rows: DataFrame, window_days: int, labels: list[str], report_from: Expr | None = None, report_until: Expr | None = None) -> DataFrame:
    """bucket (a date), labels, value: distinct entities with a row in the last window_days days; days without any are absent.

    A day of activity opens an interval of window_days days, cut off where the entity's next one begins. Beginnings and ends
    are summed by day, so each entity and day is shuffled once and not once for each day of the window.
    """
    dims = [quoted(x) for x in labels]
    days = rows.where(F.col(ENTITY).isNotNull() & F.col(BUCKET).isNotNull()).select(F.col(BUCKET).cast("date").alias("day"), ENTITY, *dims).distinct()
    next_day = F.lead("day").over(W.partitionBy(ENTITY, *dims).orderBy("day"))
    spans = days.withColumn("end", F.least(F.date_add("day", window_days), F.coalesce(next_day, F.date_add("day", window_days))))
    steps = spans.select(*dims, F.explode(F.array(F.struct(F.col("day"), F.lit(1).alias("step")), F.struct(F.col("end").alias("day"), F.lit(-1).alias("step")))).alias("x"))
    steps = steps.groupBy(*dims, F.col("x.day").alias("day")).agg(F.sum("x.step").alias("step"))
    # A row for each day and label from here on.
    order = W.partitionBy(*dims).orderBy("day")
    levels = steps.withColumn("value", F.sum("step").over(order.rowsBetween(W.unboundedPreceding, 0))).withColumn("until", F.lead("day").over(order))
    out = levels.where("value > 0").select(F.explode(F.sequence("day", F.date_sub("until", 1))).alias("bucket"), *dims, "value")
    if report_from is not None:
        out = out.where(F.col("bucket") >= col(report_from))
    return out if report_until is None else out.where(F.col("bucket") < col(report_until))
