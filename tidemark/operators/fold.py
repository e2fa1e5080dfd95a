"""The greatest label tuples, and folding all others into "(other)"."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.exprs import null_safe, quoted

OTHER = "(other)"
#: Picks of up to so many tuples are broadcast.
MAX_BROADCAST = 10_000


def top_labels(rows: DataFrame, labels: list[str], n: int, exact: bool = True, rank: Column | None = None) -> DataFrame:
    """The n label tuples with the most rows (or the greatest rank), ties in order of the labels, nulls last.

    Without exact a single column is ranked by a sketch, which leaves null out.
    """
    if not exact and len(labels) == 1 and rank is None:
        name = "`" + labels[0].replace("`", "``") + "`"
        items = rows.where(quoted(labels[0]).isNotNull()).agg(F.expr(f"approx_top_k({name}, {n}, {max(10_000, 10 * n)})").alias("x"))
        return items.select(F.explode("x").alias("x")).select(F.col("x.item").alias(labels[0]))
    ranked = rows.groupBy(*(quoted(x) for x in labels)).agg((F.count("*") if rank is None else rank).alias("__tm_rank"))
    return ranked.orderBy(F.col("__tm_rank").desc_nulls_last(), *(quoted(x).asc_nulls_last() for x in labels)).limit(n).drop("__tm_rank")


def fold(rows: DataFrame, top: DataFrame, labels: list[str], n: int, include_other: bool = True) -> DataFrame:
    """rows with labels outside `top` folded into text "(other)", or dropped; a null label is never folded, and rows whose labels
    are all null always stay."""
    picked = top.select(*(quoted(x).alias(f"__tm_top_{i}") for i, x in enumerate(labels)), F.lit(True).alias("__tm_hit"))
    if n <= MAX_BROADCAST:
        picked = F.broadcast(picked)
    out = rows.join(picked, null_safe([quoted(x) for x in labels], [F.col(f"__tm_top_{i}") for i in range(len(labels))]), "left")
    hit = F.col("__tm_hit").isNotNull()
    if include_other:
        out = out.withColumns({x: F.when(hit | quoted(x).isNull(), quoted(x).cast("string")).otherwise(F.lit(OTHER)) for x in labels})
    else:
        empty = F.lit(True)
        for x in labels:
            empty = empty & quoted(x).isNull()
        out = out.where(hit | empty)
    return out.drop("__tm_hit", *(f"__tm_top_{i}" for i in range(len(labels))))
