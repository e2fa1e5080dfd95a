"""Ordered funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, ratio
from tidemark.functions.timeaxis import days_between
from tidemark.sources.relations import filtered, relation
from tidemark.specs import FunnelSpec


def funnel(spark: SparkSession, spec: FunnelSpec) -> DataFrame:
    """step_index, step_label, entities, pct_of_first.

    Each step's instant is a minimum over the entity's rows, given the step before: windows over one partitioning, which the
    final aggregation shares. Only rows of some step are shuffled, and no entity's rows are gathered into one value.
    """
    n = len(spec.steps)
    rows = filtered(relation(spark, spec.source), spec.where)
    rows = rows.select(col(spec.entity).alias("e"), col(spec.event_time).alias("t"), *(F.coalesce(col(s), F.lit(False)).alias(f"s{i}") for i, s in enumerate(spec.steps)))
    some = F.lit(False)
    for i in range(n):
        some = some | F.col(f"s{i}")
    rows = rows.where(some)
    # Rows without an entity count as one that gets no further than the first step; they aren't shuffled as one key.
    nobody = rows.where("e IS NULL").agg(F.max("s0").alias("in0"))
    rows, entity = rows.where("e IS NOT NULL"), W.partitionBy("e")
    # A first step without an instant is counted, but nothing can follow it.
    rows = rows.withColumns({"in0": F.max("s0").over(entity), "r0": F.min(F.when(F.col("s0"), F.col("t"))).over(entity)})
    for i in range(1, n):
        ok = F.col(f"s{i}") & (F.col("t") >= F.col(f"r{i - 1}"))
        if spec.within_days is not None:
            ok = ok & (days_between(F.col("r0"), F.col("t")) <= spec.within_days)
        rows = rows.withColumn(f"r{i}", F.min(F.when(ok, F.col("t"))).over(entity))
    reached = rows.groupBy("e").agg(F.max("in0").alias("in0"), *(F.max(F.col(f"r{i}").isNotNull()).alias(f"in{i}") for i in range(1, n)))
    reached = reached.drop("e").unionByName(nobody.select("in0", *(F.lit(False).alias(f"in{i}") for i in range(1, n))))
    counts = reached.agg(*(F.count_if(f"in{i}").alias(f"n{i}") for i in range(n)))
    steps = F.array(*(F.struct(F.lit(i).alias("step_index"), F.lit(x).alias("step_label"), F.col(f"n{i}").alias("entities"), F.round(ratio(F.lit(100.0) * F.col(f"n{i}"), F.col("n0")), 2).alias("pct_of_first")) for i, x in enumerate(spec.labels)))
    return counts.select(F.inline(steps)).orderBy("step_index")
