"""Connected components of a graph of any size, with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed

#: Labels (about 50 bytes each in memory) go to the edges by broadcast up to so many, else by shuffle.
MAX_BROADCAST = 500_000


def components(edges: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """id, component (the smallest id reachable) of every id in edges(a, b).

    Each round every node's neighbours offer their labels, it takes the least of these and its own, and labels are followed
    one step further (label of the label), so a chain shrinks to half or less; rounds end when nothing changes. Offers are
    minima, combined in each task before they are shuffled; joins on a hub's id are left to skew handling. Each round is
    checkpointed, so a lost executor costs one round at most.
    """
    edges = edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    both = checkpointed(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = checkpointed(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("label")))
    small = labels.count() <= max_broadcast
    sent = lambda df: F.broadcast(df) if small else df
    while True:
        offers = both.join(sent(labels.select(F.col("id").alias("b"), "label")), "b").select(F.col("a").alias("id"), "label", F.lit(None).cast("long").alias("own"))
        each = offers.unionByName(labels.select("id", "label", F.col("label").alias("own")))
        taken = checkpointed(each.groupBy("id").agg(F.max("own").alias("old"), F.min("label").alias("new")))
        further = taken.select(F.col("id").alias("new"), F.col("new").alias("next"))
        jumped = checkpointed(taken.join(sent(further), "new").select("id", "old", F.least("new", "next").alias("label")))
        labels = jumped.select("id", "label")
        if jumped.where("old <> label").isEmpty():
            return labels.select("id", F.col("label").alias("component"))
