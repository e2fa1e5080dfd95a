"""Values that entities had: at the row, first, last, as of a bound, or carried to each row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.exprs import col, quoted
from tidemark.operators.measures import ENTITY, TIME
from tidemark.sources.relations import relation
from tidemark.specs import Breakdown, Expr

METRIC = "__tm_metric"


def _order(t: Column) -> Column:
    """An instant, date or number as a number, so that "earliest" can be written as a greatest."""
    return F.unix_micros(t.cast("timestamp_ntz").cast("timestamp"))


def _recorded(b: Breakdown, value: Column, time: Column) -> Column:
    ok = value.isNotNull() & time.isNotNull()
    return ok if b.fill_from is None else ok & F.coalesce(col(b.fill_from), F.lit(False))


def _picks(b: Breakdown, ok: Column, value: Column, time: Column) -> list[tuple[str, Column]]:
    """Aggregates of one entity's rows: the value asked for, and its first ever if that may stand in."""
    inside = ok
    for bound, test in ((b.since, lambda x: time >= x), (b.until, lambda x: time <= x), (b.before, lambda x: time < x)):
        if bound is not None:
            inside = inside & test(col(bound))
    sign = -1 if b.at == "first" else 1
    out = [("pick", F.max(F.when(inside, F.struct((_order(time) * sign).alias("o"), value.alias("v")))))]
    if b.backfill:
        out.append(("ever", F.max(F.when(ok, F.struct((-_order(time)).alias("o"), value.alias("v"))))))
    return out


def _stream(spark: SparkSession, history: DataFrame, b: Breakdown, time_column: Expr | None) -> DataFrame:
    """entity, t, v, ok: the recorded values of a breakdown that brings its own, and the history rows after them."""
    v = b.values
    own = relation(spark, v.source).select(quoted(v.entity).alias("e"), quoted(v.at).alias("t"), quoted(v.value).alias("v"))
    own = own.withColumn("ok", F.col("v").isNotNull() & F.col("t").isNotNull())
    if b.complete_until is None:
        return own
    stored = col(time_column) if time_column is not None else F.col(TIME)
    late = history.where(stored > col(b.complete_until))
    late = late.select(F.col(ENTITY).alias("e"), F.col(TIME).alias("t"), col(b.expr).alias("v"), _recorded(b, col(b.expr), F.col(TIME)).alias("ok"))
    return own.unionByName(late)


def _anchored(spark: SparkSession, rows: DataFrame, history: DataFrame, slices: dict[str, Breakdown], time_column: Expr | None) -> DataFrame:
    """rows with a column for each first or last breakdown.

    All that read the history share one aggregation by entity, with maxima that combine in each task; nothing is sorted.
    """
    live = {k: b for k, b in slices.items() if b.values is None}
    tables = []
    if live:
        aggs = [agg.alias(f"{k}:{name}") for k, b in live.items() for name, agg in _picks(b, _recorded(b, col(b.expr), F.col(TIME)), col(b.expr), F.col(TIME))]
        tables.append((live, history.where(F.col(ENTITY).isNotNull()).groupBy(F.col(ENTITY).alias("__tm_e")).agg(*aggs)))
    for k, b in slices.items():
        if b.values is not None:
            stream = _stream(spark, history, b, time_column).where(F.col("e").isNotNull())
            aggs = [agg.alias(f"{k}:{name}") for name, agg in _picks(b, F.col("ok"), F.col("v"), F.col("t"))]
            tables.append(({k: b}, stream.groupBy(F.col("e").alias("__tm_e")).agg(*aggs)))
    for own, table in tables:
        rows = rows.join(table, rows[ENTITY] == table["__tm_e"], "left").drop("__tm_e")
        for k, b in own.items():
            value = quoted(f"{k}:pick").getField("v")
            if b.backfill:
                value = F.coalesce(value, quoted(f"{k}:ever").getField("v"))
            rows = rows.withColumn(k, value).drop(f"{k}:pick", f"{k}:ever")
    return rows


def _carried(spark: SparkSession, history: DataFrame, slices: dict[str, Breakdown], time_column: Expr | None) -> DataFrame:
    """The metric rows of history with a column for each carried breakdown.

    Counted rows are rows of the history, so one running maximum of (instant, value) over it answers for all columns: one shuffle
    and one sort. Rows without an entity have no history and skip the window; they would be one huge partition.
    """
    names = history.columns
    work, values, own = history, {}, {}
    for i, (k, b) in enumerate(slices.items()):
        v, ok = f"__tm_v{i}", _recorded(b, col(b.expr), F.col(TIME))
        if b.values is not None:
            stored = col(time_column) if time_column is not None else F.col(TIME)
            ok = ok & F.coalesce(stored > col(b.complete_until), F.lit(False)) if b.complete_until is not None else F.lit(False)
        work = work.withColumn(v, F.when(ok, F.struct(F.col(TIME).alias("t"), col(b.expr).alias("v"))))
        values[k], own[k] = v, col(b.expr)
    # Rows that are neither counted nor record anything need not be shuffled.
    some = F.col(METRIC)
    for v in values.values():
        some = some | F.col(v).isNotNull()
    kept = work.where(F.col(ENTITY).isNotNull() & some)
    for k, b in slices.items():
        if b.values is not None:
            r = b.values
            rows = relation(spark, r.source).where(quoted(r.entity).isNotNull() & quoted(r.at).isNotNull() & quoted(r.value).isNotNull())
            time = quoted(r.at).cast(history.schema[TIME].dataType)
            rows = rows.select(quoted(r.entity).alias(ENTITY), time.alias(TIME), F.lit(False).alias(METRIC), F.struct(time.alias("t"), quoted(r.value).alias("v")).alias(values[k]))
            kept = kept.unionByName(rows, allowMissingColumns=True)
    upto = W.partitionBy(ENTITY).orderBy(TIME).rangeBetween(W.unboundedPreceding, W.currentRow)
    found = kept.withColumns({v: F.max(v).over(upto) for v in values.values()}).where(METRIC)
    found = found.withColumns({k: F.when(F.col(TIME).isNotNull(), F.col(v).getField("v")) for k, v in values.items()})
    nobody = work.where(F.col(ENTITY).isNull() & F.col(METRIC)).withColumns({k: F.lit(None) for k in values})
    out = found.drop(*values.values()).unionByName(nobody.drop(*values.values()))
    for k, b in slices.items():
        if b.own_value_first:
            out = out.withColumn(k, F.coalesce(own[k], F.col(k)))
    return out.select(*(quoted(c) for c in names), *slices)


def attribute(history: DataFrame, slices: dict[str, Breakdown], time_column: Expr | None = None) -> DataFrame:
    """The metric rows of history (those where METRIC holds) with a column for each breakdown, named by its key.

    history: all rows of the source, with ENTITY, TIME and METRIC. Rows are neither lost nor added.
    """
    spark = history.sparkSession
    of = lambda *modes: {k: b for k, b in slices.items() if b.at in modes}
    carried, anchored, plain = of("carried"), of("first", "last"), of("rows")
    rows = _carried(spark, history, carried, time_column) if carried else history.where(METRIC)
    rows = rows.withColumns({k: col(b.expr) for k, b in plain.items()})
    return _anchored(spark, rows, history, anchored, time_column) if anchored else rows
