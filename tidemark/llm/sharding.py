"""Cutting a corpus into shards of nearly equal bytes, with DataFrame functions only.

Documents with equal texts are one atomic group and lie in the order of a hash of their text. The law is `bytes`: a
minimax contiguous partition of the ordered groups. The smallest feasible capacity is found by binary search, checked
greedily. Shards are cut at it, or, where one large group sets it, those without a large group at the smallest capacity
that a second search finds for them.

The driver never holds all groups. It starts with sums over BINS ranges of hashes; if each range can be cut anywhere,
the search gives a capacity that no partition can beat, and if none can be cut, one that is feasible. Where the two
differ, the ranges that a cut may fall into, under any capacity between them, are summed again by finer ranges, down to
single groups if need be. What comes out is the optimum over groups, from a bounded number of sums at a time.

Slots are prefix sums of row counts over cells plus a place in the cell. A cell is a range of hashes in a shard; a range
with many rows (a group of copies may hold a third of all) is split into as many cells as it needs by a hash of doc_id.
Only ids, sizes and hashes are ever shuffled, and the text is read once.

Defined cases: a null text is an empty one, of size 8; rows that share a doc_id are rows like others; a null doc_id sorts
first; with fewer groups than shards some shards are empty, as are all of them for an empty table. Other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table

SHARDS, OVERHEAD, BIN_BITS = 24, 8, 16
#: Sums that a refinement brings to the driver at most.
SUMS = 1 << 17
#: Ranges with more than this fraction of all rows are split into cells (for slots only; groups stay in one shard).
CELL_ROWS = 1 / 1024


def greedy(ends: list[int], capacity: int, shards: int, fluid: list[bool] | None = None, most: int = 0, follow: bool = False) -> list[int] | None:
    """Where shards filled from the left up to capacity end, as sums of bytes, or None if there are more than `shards`.

    ends: the running sums of the sizes, in order; where fluid, an item may be cut anywhere, else only at its end. An item
    above capacity, up to most, is a shard of its own, with follow filled up to most.
    """
    cuts, at = [], 0
    while at < (ends[-1] if ends else 0):
        i = bisect_right(ends, at + capacity)
        to = ends[i - 1] if i else 0
        if i < len(ends) and fluid and fluid[i]:
            to = at + capacity
        if to <= at and ends[i] - at <= most:
            to = ends[bisect_right(ends, at + most) - 1] if follow else ends[i]
        if to <= at or len(cuts) == shards:
            return None
        cuts.append(to)
        at = to
    return cuts


def smallest(ends: list[int], shards: int, low: int, high: int, fluid: list[bool] | None = None, **how) -> int:
    """The smallest capacity in [low, high] under which `shards` will do; high is known to be feasible."""
    while low < high:
        mid = (low + high) // 2
        if greedy(ends, mid, shards, fluid, **how) is None:
            low = mid + 1
        else:
            high = mid
    return high


def even_cuts(ends: list[int], shards: int, capacity: int) -> list[int]:
    """Where shards end, none above capacity, which is the smallest possible.

    Where a large item sets the capacity, plain filling would leave shards empty; so all that hold no large
    item share the rest under a capacity of their own, as small as the search finds.
    """
    found = []
    for follow in (False, True):
        least = smallest(ends, shards, -(-ends[-1] // shards), capacity, most=capacity, follow=follow)
        found.append((least, follow))
    least, follow = min(found)
    cuts = greedy(ends, least, shards, most=capacity, follow=follow)
    while len(cuts) < shards:  # shards that are left over halve the largest that can be cut
        runs = [(b - a, a, b) for a, b in zip([0, *cuts], cuts, strict=False) if ends[bisect_right(ends, a)] < b]
        if not runs:
            break
        _, a, b = max(runs)
        i = bisect_right(ends, (a + b) // 2)
        cuts = sorted([*cuts, ends[i - 1] if i and ends[i - 1] > a else ends[i]])
    return cuts


def minimax_cuts(sizes: list[int], shards: int) -> list[int]:
    """First item of each shard, ascending, at most `shards` of them; the largest shard is as small as can be."""
    ends = list(accumulate(sizes))
    if not ends:
        return []
    capacity = smallest(ends, shards, max(sizes), ends[-1])
    return [0, *(bisect_right(ends, c) for c in even_cuts(ends, shards, capacity)[:-1])]


def _doubtful(ends: list[int], shards: int, low: int, high: int) -> set[int]:
    """Items that a cut may fall into under some capacity in [low, high]."""
    out, at = set(), 0
    for j in range(1, shards):
        i = bisect_right(ends, at + low)
        at = max(at, ends[i - 1] if i else 0)  # no cut j lies before this, nor behind j * high
        out.update(range(bisect_right(ends, at), min(len(ends), bisect_right(ends, j * high) + 1)))
    return out


def shard_starts(groups: DataFrame, shards: int, sums: int = SUMS, bin_bits: int = BIN_BITS) -> list[int]:
    """The least hash of each shard but the first, for groups(group, size): a minimax contiguous partition by hash."""

    def ranges(df: DataFrame, bits: int) -> dict[int, tuple[int, int]]:
        rows = df.groupBy(F.shiftright("group", 64 - bits).alias("range")).agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
        return {r["range"] << (64 - bits): (r["size"], r["n"], 64 - bits) for r in rows}

    items, most = ranges(groups, bin_bits), groups.agg(F.max("size")).first()[0] or 1
    while True:
        starts = sorted(items)
        ends = list(accumulate(items[s][0] for s in starts))
        if not ends:
            return []
        least = max(most, -(-ends[-1] // shards))
        one = max(items[s][0] for s in starts)
        high = smallest(ends, shards, max(least, one), ends[-1])
        low = smallest(ends, shards, least, high, [items[s][1] > 1 for s in starts])
        open_ = [starts[i] for i in sorted(_doubtful(ends, shards, low, high)) if items[starts[i]][1] > 1] if low < high else []
        if not open_:
            return [starts[bisect_right(ends, c)] for c in even_cuts(ends, shards, high)[:-1]]
        coarse = max(items[s][2] for s in open_)
        now = [s for s in open_ if items[s][2] == coarse]  # the widest first, so that all are of one width
        finer = max(1, min(coarse, (sums // len(now)).bit_length() - 1))
        spot = F.shiftright("group", coarse)
        wanted = groups.sparkSession.createDataFrame([(s >> coarse,) for s in now], "range long")
        inside = groups.join(F.broadcast(wanted), spot == wanted["range"], "left_semi")  # at most `sums` ranges
        parts = ranges(inside, 64 - coarse + finer)
        for s in now:
            del items[s]
        items |= parts


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), (F.octet_length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), F.xxhash64(body).alias("group"))
    rows = checkpointed(rows)
    groups = checkpointed(rows.groupBy("group").agg(F.sum("size").alias("size")))
    shard = sum((F.when(F.col("group") >= F.lit(c), 1).otherwise(0) for c in shard_starts(groups, shards)), F.lit(0))
    rows = rows.withColumn("shard", shard.cast("int")).withColumn("range", F.shiftright("group", 64 - BIN_BITS).cast("int"))

    # Two rows of counts a range at most, and 1 / CELL_ROWS more for those that are split.
    per = rows.groupBy("range").agg(F.count("*").alias("n"))
    total = per.agg(F.sum("n")).first()[0] or 0
    large = max(64, int(total * CELL_ROWS))
    split = {r["range"]: -(-r["n"] // large) for r in per.where(F.col("n") > large).collect()}
    cells = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in split.items() for x in kv]), F.col("range")), F.lit(1)) if split else F.lit(1)
    rows = rows.withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit(1)), cells).cast("int"))
    first = F.sum("n").over(W.partitionBy("shard").orderBy("range", "cell")) - F.col("n")
    counts = rows.groupBy("shard", "range", "cell").agg(F.count("*").alias("n")).withColumn("first", first)
    counts = F.broadcast(counts.select("shard", "range", "cell", "first"))

    place = F.row_number().over(W.partitionBy("shard", "range", "cell").orderBy("group", "doc_id", "size", "text_crc32")) - 1
    out = rows.withColumn("place", place).join(counts, ["shard", "range", "cell"])
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("place")).cast("long").alias("slot"))


def op7_sharding(spark, sf_dir: str) -> DataFrame:
    out = assign(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
