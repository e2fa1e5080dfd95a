"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are turned into integers. Queries are taken in chunks of at most `chunk` (their integers, 64 MB or so, are broadcast;
a larger set takes more passes over the vectors, each with its results written to the shared folder and its broadcast
given up before the next, so that the driver holds one chunk at a time). The vectors with the greatest lengths, at most `seed` of them,
give every query a first lower bound of its k-th score. Then each task takes its vectors in blocks, sorts a block by length,
longest first, and cuts it into buckets. In a bucket with longest vector b, a query q with k-th score s so far
needs a cosine of at least t = s / (|q| |b|): above 1 nothing in the bucket can matter (length pruning); for t near 1 the
coordinates where q is largest are tested against the interval that such a cosine leaves (coordinate pruning); else the whole
bucket is a candidate. Products of the candidates are computed exactly. Each task gives k rows a query at most, and
the best k of these are kept.

Defined cases: vectors that are null, empty, or hold a null or non-finite component, and rows without an id, take no part;
shorter vectors count as padded with zeros; every row is a candidate for all queries but itself, also where rows share an id or
are equal; so is every row that is asked for a query, with ranks of its own; scores beyond 64 bits are held at its ends. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table

K, SCALE, EVERY = 5, 256.0, 50
CHUNK, SEED, BLOCK, BUCKET = 65_536, 4_096, 16_384, 512
#: Cosines from here on are tested by coordinate, on so many coordinates.
STEEP, COORDINATES = 0.7, 3
#: Sums of products below this are exact in 64-bit floats.
EXACT = float(1 << 53)


def matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """Rows of floats holding integers, padded to width."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    sizes = np.asarray(vectors.value_lengths().fill_null(0))
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def exact_products(q: np.ndarray, x: np.ndarray, bound: float) -> np.ndarray:
    """Inner products of rows as int64, also where floats would round."""
    if bound < EXACT:
        return (q @ x.T).astype(np.int64)
    big = np.vectorize(int, otypes=[object])
    product = big(q) @ big(x).T if q.size and x.size else np.zeros((len(q), len(x)), object)
    return np.clip(product, -(2**63), 2**63 - 1).astype(np.int64)


class Best:
    """The k best (score, id) of each query, ties to the smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.id = np.full((n, k), -(2**63), np.int64), np.full((n, k), 2**63 - 1, np.int64)
        self.full = np.zeros((n, k), bool)

    def floor(self) -> np.ndarray:
        """k-th score so far, minus infinity where there are fewer."""
        return np.where(self.full[:, -1], self.score[:, -1].astype(float), -np.inf)

    def add(self, q: np.ndarray, score: np.ndarray, ids: np.ndarray, ok: np.ndarray) -> None:
        """Candidates with ids (columns) for the queries q (rows); ok tells which count."""
        k = self.score.shape[1]
        if score.shape[1] > 4 * k:  # only a few of many columns can matter: those above the k-th greatest, ties included
            masked = np.where(ok, score, -(2**63))
            cut = np.partition(masked, -k, axis=1)[:, -k]
            some = (masked >= cut[:, None]).any(axis=0)
            score, ids, ok = score[:, some], ids[some], ok[:, some]
        s = np.concatenate([self.score[q], np.where(ok, score, -(2**63))], axis=1)
        i = np.concatenate([self.id[q], np.where(ok, ids[None, :], 2**63 - 1)], axis=1)
        f = np.concatenate([self.full[q], ok], axis=1)
        order = np.lexsort((i, ~s, ~f), axis=1)[:, :k]
        self.score[q], self.id[q], self.full[q] = (np.take_along_axis(x, order, axis=1) for x in (s, i, f))


def search_block(queries: np.ndarray, floors: np.ndarray, x: np.ndarray, ids: np.ndarray, best: Best) -> None:
    """Looks for better candidates among the rows of x. floors: lower bounds of the queries' k-th scores."""
    lengths, q_len = np.sqrt((x * x).sum(axis=1)), np.sqrt((queries * queries).sum(axis=1))
    order = np.argsort(-lengths, kind="stable")
    x, ids, lengths = x[order], ids[order], lengths[order]
    lead = np.argsort(-abs(queries), axis=1)[:, :COORDINATES]
    for lo in range(0, len(x), BUCKET):
        b, b_ids, b_len = x[lo : lo + BUCKET], ids[lo : lo + BUCKET], lengths[lo : lo + BUCKET]
        floor = np.maximum(floors, best.floor())
        reach = q_len * b_len[0]
        bound = float(q_len.max(initial=0) * b_len[0])
        live = np.flatnonzero(reach * (1 + 1e-9) + 1e-6 >= floor)
        if not len(live):
            break
        t = np.where(reach[live] > 0, floor[live] / np.maximum(reach[live], 1e-300), -np.inf)
        steep = live[t >= STEEP]
        for q in steep:
            # With unit vectors u (query) and v: u.v >= c implies v_f within u_f c +- sqrt((1 - u_f^2)(1 - c^2)).
            need = np.minimum(floor[q] / np.maximum(q_len[q] * b_len, 1e-300), 1.0)
            keep = floor[q] <= q_len[q] * b_len * (1 + 1e-9) + 1e-6
            for f in lead[q]:
                u, v = queries[q, f] / q_len[q], b[:, f] / np.maximum(b_len, 1e-300)
                slack = np.sqrt(np.maximum((1 - u * u) * (1 - need * need), 0)) + 1e-7
                keep &= abs(v - u * need) <= slack + np.maximum(0, abs(u) * (1 - need)) * (np.sign(v - u * need) == np.sign(u))
            if keep.any():
                score = exact_products(queries[q : q + 1], b[keep], bound)
                best.add(np.array([q]), score, b_ids[keep], np.ones(score.shape, bool))
        flat = live[t < STEEP]
        if len(flat):
            score = exact_products(queries[flat], b, bound)
            best.add(flat, score, b_ids, np.ones(score.shape, bool))


def whole(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: float = SCALE) -> DataFrame:
    """id, x of the vectors that take part; x: array<double> of floor(scale * component)."""
    finite = F.forall(F.col(vector), lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    rows = vectors.where(F.col(vec_id).isNotNull() & F.col(vector).isNotNull()).where((F.size(vector) > 0) & finite)
    return rows.select(F.col(vec_id).cast("long").alias("id"), F.transform(F.col(vector), lambda v: _floor(v.cast("double") * scale)).alias("x"))


def _floor(v):
    """floor() as a double; beyond 2^53 doubles are whole anyway, and floor() would leave the range of longs."""
    return F.when(F.abs(v) < EXACT, F.floor(v).cast("double")).otherwise(v)


def search(vectors: DataFrame, queries, k: int = K, chunk: int = CHUNK, seed: int = SEED, **columns) -> DataFrame:
    """query_id, rank, vec_id, score: for each row of vectors with queries(id), a Column, the k rows with the greatest products."""
    spark = vectors.sparkSession
    rows = whole(vectors, **columns)
    width = rows.agg(F.max(F.size("x"))).first()[0] or 1
    longest = rows.withColumn("length", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)).orderBy(F.desc("length"), "id").select("id", "x").limit(seed).toArrow()
    seeds, seed_ids = matrix(longest["x"], width), longest["id"].to_numpy()
    asked = rows.where(queries(F.col("id")))
    n = asked.count()
    chunks = max(1, -(-n // chunk))
    found = []
    for c in range(chunks):
        some = (asked if chunks == 1 else asked.where(F.pmod(F.xxhash64("id", "x"), F.lit(chunks)) == c)).orderBy("id").toArrow()
        if not some.num_rows:
            continue
        q, q_ids = matrix(some["x"], width), some["id"].to_numpy()
        own = np.concatenate([np.diag(exact_products(q[i : i + 256], q[i : i + 256], float((q[i : i + 256] ** 2).sum(axis=1).max()))) for i in range(0, len(q), 256)])
        # A query's own row is found like others, so one more is looked for, and then it is taken out.
        first = Best(len(q), k + 1)
        for lo in range(0, len(q), 4096):
            part = Best(len(q[lo : lo + 4096]), k + 1)
            search_block(q[lo : lo + 4096], np.full(len(part.full), -np.inf), seeds, seed_ids, part)
            first.score[lo : lo + 4096], first.full[lo : lo + 4096] = part.score, part.full
        shared = spark.sparkContext.broadcast((q, q_ids, own, first.floor()))
        best = _ranked(rows.mapInArrow(_searcher(shared, width, k + 1), "slot long, query long, id long, score long, own boolean"), k)
        if chunks > 1:
            best = checkpointed(best)
            shared.destroy()
        found.append(best)
    if not found:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _ranked(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query of a chunk; of the k + 1 rows found its own is left out."""
    each = W.partitionBy("slot")
    out = found.withColumn("place", F.row_number().over(each.orderBy(F.desc("score"), "id", F.desc("own")))).where(F.col("place") <= k + 1)
    out = out.withColumn("self", F.min(F.when(F.col("own"), F.col("place"))).over(each)).where(~F.col("place").eqNullSafe(F.col("self")))
    rank = F.col("place") - F.when(F.col("place") > F.col("self"), 1).otherwise(0)
    out = out.withColumn("rank", rank).where(F.col("rank") <= k)
    return out.select(F.col("query").alias("query_id"), "rank", F.col("id").alias("vec_id"), "score")


def _searcher(shared, width: int, k: int):
    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids, same, floors = shared.value
        best, held = Best(len(q), k), []

        def work() -> None:
            x, ids = (np.concatenate(v) for v in zip(*held, strict=True))
            for lo in range(0, len(q), 1024):
                part = slice(lo, lo + 1024)
                own = Best(0, k)
                own.score, own.id, own.full = best.score[part], best.id[part], best.full[part]  # views: what is added there is in best
                search_block(q[part], floors[part], x, ids, own)

        for batch in batches:
            for lo in range(0, len(batch), BLOCK):
                piece = batch.slice(lo, BLOCK)
                held.append((matrix(piece.column(1), width), piece.column(0).to_numpy()))
                if sum(len(v[1]) for v in held) >= BLOCK:
                    work()
                    held.clear()
        if held:
            work()
        spot = np.nonzero(best.full & (best.score >= np.where(np.isfinite(floors), floors, -(2.0**63))[:, None]))
        at, ids, score = spot[0], best.id[spot], best.score[spot]
        own = (ids == q_ids[at]) & (score == same[at])
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(q_ids[at], pa.int64()), pa.array(ids), pa.array(score), pa.array(own)], names=["slot", "query", "id", "score", "own"])

    return each


def op5_topk(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), lambda i: i % EVERY == 0)


OP5_SQL = """
WITH v AS (SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.own <> c.own WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""
