"""Retention matrices over periods of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, grid, ratio, refuse
from tidemark.functions.timeaxis import days_between
from tidemark.sources.relations import filtered, relation
from tidemark.specs import RetentionSpec

DERIVED = ("cohort_ts", "offset_days", "period_index", "within_period_offset")


def retention(spark: SparkSession, spec: RetentionSpec) -> DataFrame:
    """cohort, period_index, cohort_size, retained_entities, retention_pct, for periods 0 to n_periods.

    An entity's first instant, its periods and its row of the grid all come from rows of that entity, so one shuffle by
    entity serves the window and the aggregation; there is no join.
    """
    rows = refuse(filtered(relation(spark, spec.source), spec.where), DERIVED)
    # Named before the window: Spark then knows that both steps are partitioned alike.
    rows = rows.withColumns({"__tm_entity": col(spec.entity), "__tm_start": col(spec.entity_time), "__tm_time": col(spec.event_time)})
    # Rows without an entity are no one's: their cohort is a minimum that tasks combine, and they aren't shuffled as one key.
    nobody = rows.where("__tm_entity IS NULL").agg(F.min("__tm_start").alias("cohort_ts"), F.count("*").alias("n")).where("n > 0")
    rows = rows.where("__tm_entity IS NOT NULL").withColumn("cohort_ts", F.min("__tm_start").over(W.partitionBy("__tm_entity")))
    rows = rows.withColumn("offset_days", days_between(F.col("cohort_ts"), F.col("__tm_time")))
    rows = rows.withColumn("period_index", F.floor(F.col("offset_days") / spec.period_days).cast("int"))
    rows = rows.withColumn("within_period_offset", F.col("offset_days") - F.col("period_index") * spec.period_days)
    kept = F.col("period_index").between(0, spec.n_periods) & col(spec.retained)
    periods = rows.groupBy("__tm_entity").agg(F.min("cohort_ts").alias("cohort_ts"), F.collect_set(F.when(kept, F.col("period_index"))).alias("__tm_periods"))
    periods = periods.unionByName(nobody.select(F.lit(None).cast(rows.schema["__tm_entity"].dataType).alias("__tm_entity"), "cohort_ts", F.array().cast("array<int>").alias("__tm_periods")))
    cells = periods.select(col(spec.cohort_bucket).alias("cohort"), "__tm_entity", "__tm_periods", grid(spec.n_periods).alias("period_index"))
    # A null entity has a row of the grid but is no one.
    there = F.col("__tm_entity").isNotNull()
    out = cells.groupBy("cohort", "period_index").agg(F.count_if(there).alias("cohort_size"), F.count_if(there & F.array_contains("__tm_periods", F.col("period_index"))).alias("retained_entities"))
    pct = F.round(ratio(F.lit(100.0) * F.col("retained_entities"), F.col("cohort_size")), 2)
    return out.withColumn("retention_pct", pct).orderBy("cohort", "period_index")
