"""Benchmark decontamination with DataFrame functions only.

Items are cut into windows of n consecutive normalised words (shorter items are one window). The windows, keyed by a
hash of their words, are broadcast; the hashes of every window of every document are looked up there, and a hit counts if
the words themselves are equal. The text never crosses the network: a document's words stay beside its hashes inside one
code-generated stage until the rare hit needs them, and only ids, counts and hits are shuffled.

The broadcast is bounded: about `max_windows` windows of MAX_BYTES bytes, words and item ids, go at once; a larger
benchmark is split by window hash into as many blocks as that takes, and the corpus, written once with a number for each
row, is scanned once for each block.

Defined cases: null and wordless texts have no words and no hits; wordless items have no windows; rows of `benchmark` that
share an item_id are one item; a null item_id is the item named by the empty string; every row of the documents is
judged by itself, also if doc_ids repeat or are null; empty tables on either side give no hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import ascii_lower, checkpointed, private_name, table

#: What lies between words, after A-Z are in lower case.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
N, MAX_WINDOWS, MAX_BYTES = 10, 200_000, 500
#: Ids of rejected documents (about 100 bytes each in memory) go to the documents by broadcast up to so many, else by shuffle.
MAX_BROADCAST_IDS = 500_000


def words(text: Column) -> Column:
    """The normalised words of a text, in order; an empty array for null."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), GAP), ""), F.array().cast("array<string>"))


def windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", n: int = N) -> DataFrame:
    """len, words, items: a row for each distinct window, with the sorted ids of the items that hold it."""
    items = benchmark.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("item"), words(F.col(text)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    each = items.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(n)))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items")).select(F.size("words").alias("len"), "words", "items")


def hits(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = N, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """docs' columns but the text, with n_words, spans (array of struct<pos, len>: the hit windows, 0-based, sorted) and
    items (sorted ids of items with a window in the text)."""
    grams = checkpointed(windows(benchmark, item_id, item_text, n).withColumn("hash", F.xxhash64("words")))
    weight = F.octet_length(F.array_join("words", " ")) + F.octet_length(F.array_join("items", " "))
    stats = grams.agg(F.count("*").alias("n"), F.sum(weight).alias("bytes"), F.sort_array(F.collect_set("len"), asc=False).alias("lens")).first()  # n lengths at most
    lens, blocks = stats["lens"] or [n], max(1, -(-stats["n"] // max_windows), -(-(stats["bytes"] or 0) // (MAX_BYTES * max_windows)))

    keep = [c for c in docs.columns if c != text]
    uid, w, m, h, kind, pos, hash_, hashes, span, its, g_hash, g_words, g_items = (private_name(docs, c) for c in ("uid", "w", "m", "h", "kind", "pos", "hash", "hashes", "span", "its", "g_hash", "g_words", "g_items"))
    base = docs.withColumn(uid, F.monotonically_increasing_id())
    if blocks > 1:  # numbers that stay the same from block to block, whatever is computed again
        base = checkpointed(base)
    base = base.withColumn(w, words(F.col(text))).withColumn(m, F.size(w))

    def of_length(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.col(m) - k + 1)
        return F.when(F.col(m) >= k, F.transform(starts, lambda i: F.xxhash64(F.slice(F.col(w), i, F.lit(k))))).otherwise(F.array().cast("array<bigint>"))

    own = [F.col(f"`{c}`") for c in (w, m, uid, *keep)]
    base = base.select(*own, F.array(*[of_length(k) for k in lens]).alias(h))
    found = []
    for block in range(blocks):
        part = grams if blocks == 1 else grams.where(F.pmod(F.col("hash"), F.lit(blocks)) == block)
        g = F.broadcast(part.select(F.col("hash").alias(g_hash), F.col("words").alias(g_words), F.col("items").alias(g_items)))
        one = base.select(*own, F.posexplode_outer(h).alias(kind, hashes))
        one = one.select(*own, F.col(kind), F.posexplode_outer(hashes).alias(pos, hash_))
        length = F.element_at(F.array(*[F.lit(k) for k in lens]), F.col(kind) + 1)
        at = F.slice(F.col(w), F.col(pos) + 1, length)
        # Both comparisons instead of one for equality, which would become a second join key and be built at every position.
        same = (F.col(hash_) == F.col(g_hash)) & (at <= F.col(g_words)) & (at >= F.col(g_words))
        one = one.join(g, same, "left").where(F.col(g_hash).isNotNull() | ((F.col(kind) == 0) & (F.coalesce(F.col(pos), F.lit(0)) == 0)))
        place = F.when(F.col(g_hash).isNotNull(), F.struct(F.col(pos).alias("pos"), length.alias("len")))
        found.append(one.select(*[F.col(f"`{c}`") for c in (uid, m, *keep)], place.alias(span), F.col(g_items).alias(its)))
    all_found = found[0]
    for more in found[1:]:
        all_found = all_found.unionByName(more)
    firsts = [F.first(F.col(f"`{c}`")).alias(c) for c in keep]
    out = all_found.groupBy(uid).agg(*firsts, F.first(m).alias(private_name(docs, "n_words")), F.sort_array(F.collect_set(span)).alias(private_name(docs, "spans")), F.sort_array(F.array_distinct(F.flatten(F.collect_set(its)))).alias(private_name(docs, "items")))
    return out.drop(uid)


def covered(spans: Column) -> Column:
    """How many words the sorted spans cover together."""
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct((a["n"] + F.greatest(x["pos"] + x["len"] - F.greatest(a["end"], x["pos"]), F.lit(0))).alias("n"), F.greatest(a["end"], x["pos"] + x["len"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", drop_above: float = 0.0, **how) -> DataFrame:
    """docs without the rows whose share of hit words exceeds drop_above, in their own columns.

    Hits come back as a list of rejected documents, which a left anti join takes out; a row whose id is null is kept or
    dropped like the others, as ids are compared null-safely and by the hash of the text.
    """
    key, body = private_name(docs, "doc_key"), private_name(docs, "body_hash")
    bad_id, bad_hash = private_name(docs, "bad_id"), private_name(docs, "bad_hash")
    keyed = docs.select(F.col(doc_id).alias(bad_id), F.xxhash64(text).alias(bad_hash), F.col(text).alias("bad_text"))
    bad = hits(keyed, benchmark, text="bad_text", **how)
    bad = bad.where(covered(F.col("spans")) > drop_above * F.col("n_words")).select(bad_id, bad_hash).distinct()
    out = docs.withColumns({key: F.col(doc_id), body: F.xxhash64(text)})
    bad = checkpointed(bad)
    if bad.count() <= MAX_BROADCAST_IDS:
        bad = F.broadcast(bad)
    out = out.join(bad, F.col(key).eqNullSafe(F.col(bad_id)) & (F.col(body) == F.col(bad_hash)), "left_anti")
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = hits(docs, table(spark, sf_dir, "benchmark")).withColumn("n_hit", covered(F.col("spans")))
    return out.select("doc_id", F.col("n_words").cast("long").alias("n_words"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


OP1_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS gram, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS i FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM g),
h AS (SELECT p.doc_id, p.i, p.n, g.item_id FROM (SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS gram
  FROM (SELECT doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, n WHERE len(w) >= n)) p JOIN g ON p.gram = g.gram AND p.n = g.n),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS j FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c ON d.doc_id = c.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""
