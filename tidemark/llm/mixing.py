"""Mixing sources to target weights, with DataFrame functions only.

Words are summed for each source (partial sums in each task, so a source with a third of all rows costs no more than
another), repetition rates follow from the targets, and each document is emitted floor(rate) times plus one further
time if a hash of its id falls below the fraction. The document itself is never shuffled: the rates, one row a source,
go to the documents (see MAX_BROADCAST_SOURCES).

Defined cases: null texts have size 0; the null source is a source of its own and the last one; rows that share a
doc_id share their draw; a null doc_id draws like the text "null"; sources of size 0 have target 0 and rate 0; an empty
table gives an empty mix. Other columns pass through; the operator's own column names may be chosen.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, private_name

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, BUDGET, MOST = (5, 2, 1), 1.5, 2.0
#: A rate takes about 40 bytes; with more sources than this the rates are joined by shuffle instead of broadcast.
MAX_BROADCAST_SOURCES = 50_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST) -> DataFrame:
    """A row for each source: source, source_size, target, rate.

    Sources weigh `weights` in turn, by code point, null last, and share `budget` times all words. No target exceeds
    `most` times its source; what is cut off is shared again by weight. That ends at target = min(most * size, k *
    weight), where k is found among the sources sorted by size over weight: once those up to some place are cut, the rest
    share what is left, and the first k that fits all later ones is the one.
    """
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(n_words(F.col(text))).alias("source_size"))
    # One row a source from here on; these windows over all of them hold that many rows, whatever the corpus.
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place % len(weights)).cast("int") + 1)
    all_rows = W.orderBy("cut_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    before = W.orderBy("cut_at", F.col("source").asc_nulls_last()).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy("cut_at", F.col("source").asc_nulls_last()).rowsBetween(0, W.unboundedFollowing)
    out = sizes.withColumn("weight", weight).withColumn("cut_at", most * F.col("source_size") / F.col("weight"))
    out = out.withColumn("k", (budget * F.sum("source_size").over(all_rows) - most * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("weight").over(onward))
    k = F.first(F.when(F.col("k") <= F.col("cut_at"), F.col("k")), ignorenulls=True).over(all_rows)
    out = out.withColumn("target", F.least(most * F.col("source_size"), F.coalesce(k, F.col("cut_at")) * F.col("weight")))
    return out.select("source", "source_size", "target", F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0)).alias("rate"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) that doc_id and seed decide: 32 bits of an MD5 sum, which any SQL engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))), 1, 8), 16, 10).cast("double") / 2.0**32


def with_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: Sequence[float] = WEIGHTS, budget: float = BUDGET, most: float = MOST, seed: int = 0, copies: str = "n_copies", max_broadcast: int = MAX_BROADCAST_SOURCES) -> DataFrame:
    """docs with its source's size and target, and how often the mix takes each document (0, 1, ...)."""
    targets = checkpointed(source_targets(docs, text, source, weights, budget, most))
    names = {c: private_name(docs, f"mix_{c}") for c in targets.columns}
    targets = targets.withColumnsRenamed(names)
    if targets.count() <= max_broadcast:
        targets = F.broadcast(targets)
    rate = F.col(names["rate"])
    out = docs.join(targets, docs[source].eqNullSafe(F.col(names["source"])), "left").drop(names["source"])
    taken = F.floor(rate) + (draw(F.col(doc_id), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(copies, taken.cast("int")).drop(names["rate"]).withColumnsRenamed({names["source_size"]: private_name(docs, "source_size"), names["target"]: private_name(docs, "target")})


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, in the columns of docs."""
    copies = private_name(docs, "n_copies")
    out = with_copies(docs, copies=copies, **how)
    return out.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1), F.col(copies)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    from tidemark.llm.common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = with_copies(docs).withColumn("size", n_words(F.col("text")))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("n_copies")).cast("long").alias("taken"))


OP8_SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1] AS DOUBLE) AS weight FROM s),
c AS (SELECT *, 2.0 * source_size / weight AS cut_at FROM w),
k AS (SELECT arg_min(k, cut_at) AS k FROM (
  SELECT a.cut_at, (1.5 * (SELECT sum(source_size) FROM c) - 2.0 * coalesce(sum(b.source_size) FILTER (b.cut_at < a.cut_at), 0))
    / sum(b.weight) FILTER (b.cut_at >= a.cut_at) AS k FROM c a, c b GROUP BY a.cut_at) WHERE k <= cut_at),
t AS (SELECT source, source_size, CAST(least(2.0 * source_size, coalesce(k, cut_at) * weight) AS DOUBLE) AS target FROM c, k),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
  CAST('0x' || substr(md5('0:' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) / 4294967296.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
