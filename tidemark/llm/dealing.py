"""Moving entries and texts between tasks as a few packed rows instead of one row each.

A row is (part, kind, blob). There are as many parts as shuffle partitions, and `keys` gives each part a number that Spark's
hash sends to a partition of its own, so that parts are dealt evenly.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import shuffle_partitions

ROW = "part int, kind int, blob binary"
#: The kind of rows that hold texts; it sorts after all others of a part.
TEXTS = 9
#: Bytes of text that are gathered before they are sent on, in a task.
GATHER = 24_000_000


def release() -> None:
    """Gives the system back what a Python worker has freed; workers live on between tasks, beside each other."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def part_keys(spark: SparkSession) -> np.ndarray:
    """For each of n partitions an int that Spark's hash partitioning puts there; n rows reach the driver."""
    n = shuffle_partitions(spark)
    ids = spark.range(0, 64 * n + 64).select(F.col("id").cast("int").alias("id"))
    rows = ids.groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("p")).agg(F.min("id").alias("id")).orderBy("p").toArrow()
    return rows["id"].to_numpy()


def deal(df: DataFrame, keys: np.ndarray) -> DataFrame:
    """df(part, kind, blob) by part, the rows of a part one after the other, texts last."""
    return df.repartition(len(keys), "part").sortWithinPartitions("part", "kind")


def _table(doc: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    view = np.ascontiguousarray(np.stack([doc, row], axis=1)).view([("d", np.int64), ("r", np.int64)]).ravel()
    ids, index = np.unique(view, return_inverse=True)
    return ids["d"], ids["r"], index


def pack(doc: np.ndarray, row: np.ndarray, **columns: np.ndarray) -> bytes:
    """Columns of entries of documents as bytes: a table of documents, an index into it, and the columns, compressed."""
    ids, rows, index = _table(doc, row)
    index = index.astype(np.uint16 if len(ids) < 65536 else np.uint32)
    fields = [np.diff(ids, prepend=0), rows, np.diff(index, prepend=index.dtype.type(0)), *columns.values()]
    head = ",".join(["d", "r", "i", *columns]) + ";" + ",".join(f"{x.dtype.str}:{len(x)}" for x in fields)
    raw = b"".join(np.ascontiguousarray(x).tobytes() for x in fields)
    return f"{len(raw)};{head}\n".encode() + pa.compress(raw, "zstd", asbytes=True)


def unpack(blobs: list[bytes]) -> dict[str, np.ndarray]:
    """The columns of all blobs, with doc and row."""
    out: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        head, _, body = blob.partition(b"\n")
        size, names, kinds = head.decode().split(";")
        raw, at, x = pa.decompress(body, int(size), "zstd", asbytes=True), 0, {}
        for name, kind in zip(names.split(","), kinds.split(","), strict=True):
            dtype, _, n = kind.partition(":")
            x[name] = np.frombuffer(raw, dtype, int(n), at)
            at += x[name].nbytes
        index = np.cumsum(x["i"], dtype=np.int64) % (1 << 8 * x.pop("i").itemsize)
        x |= {"doc": np.cumsum(x.pop("d"))[index], "row": x.pop("r")[index]}
        for k, v in x.items():
            out.setdefault(k, []).append(v)
    return {k: np.concatenate(v) for k, v in out.items()}


def groups(part: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(part, indices of its entries, in order) of every part that has any."""
    order = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
    return [(int(part[order[a]]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True)]


def rows_of(part: list[int], kind: int, blobs: list[bytes], keys: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys[np.array(part, np.int64)], pa.int32()), pa.array([kind] * len(part), pa.int32()), pa.array(blobs, pa.binary())], names=["part", "kind", "blob"])


def dealt(part: np.ndarray, kind: int, keys: np.ndarray, doc: np.ndarray, row: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """The entries of each part as one row."""
    by = groups(part)
    return rows_of([p for p, _ in by], kind, [pack(doc[r], row[r], **{k: v[r] for k, v in columns.items()}) for _, r in by], keys)


def home(doc: np.ndarray, row: np.ndarray, parts: int) -> np.ndarray:
    """The part where a document's text goes."""
    return np.mod((doc ^ row) ^ ((doc ^ row) >> 17), parts)


def pack_texts(doc: np.ndarray, row: np.ndarray, texts: list[bytes]) -> bytes:
    body = b"".join(texts)
    sizes = np.array([len(t) for t in texts], np.int64)
    head = np.array([len(texts), len(body)], np.int64).tobytes() + np.asarray(doc, np.int64).tobytes() + np.asarray(row, np.int64).tobytes() + sizes.tobytes()
    return head + pa.Codec("zstd", compression_level=3).compress(body, asbytes=True)


def unpack_texts(blob: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(doc, row, text) of each document in a blob."""
    n, size = (int(x) for x in np.frombuffer(blob, np.int64, 2))
    doc, row, sizes = (np.frombuffer(blob, np.int64, n, 16 + k * 8 * n).tolist() for k in range(3))
    body, at = pa.decompress(blob[16 + 24 * n :], size, "zstd", asbytes=True), 0
    for d, r, s in zip(doc, row, sizes, strict=True):
        yield d, r, body[at : at + s]
        at += s


def send_texts(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc, row, text) rows as texts dealt to their homes; null texts are empty."""
    docs, rows, texts, held = [], [], [], 0

    def flush() -> pa.RecordBatch:
        doc, row = np.array(docs, np.int64), np.array(rows, np.int64)
        by = groups(home(doc, row, len(keys)))
        return rows_of([p for p, _ in by], TEXTS, [pack_texts(doc[r], row[r], [texts[i] for i in r]) for _, r in by], keys)

    release()
    for batch in batches:
        for d, r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
            docs.append(d)
            rows.append(r)
            texts.append(t.as_py() or b"")
            held += len(texts[-1])
            if held >= GATHER:
                yield flush()
                docs, rows, texts, held = [], [], [], 0
    if docs:
        yield flush()
    release()


def by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list[bytes]], Iterator[bytes]]]:
    """For each part: its key, its blobs by kind, and its blobs of texts one at a time (to be read before the next part)."""
    rows = ((p, k, b) for batch in batches for p, k, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True))
    ahead = [next(rows, None)]
    while ahead[0] is not None:
        now, blobs = ahead[0][0], {}
        while ahead[0] is not None and ahead[0][0] == now and ahead[0][1] != TEXTS:
            blobs.setdefault(ahead[0][1], []).append(ahead[0][2].as_py())
            ahead[0] = next(rows, None)

        def texts(now=now) -> Iterator[bytes]:
            while ahead[0] is not None and ahead[0][0] == now:
                blob = ahead[0][2].as_py()
                ahead[0] = next(rows, None)
                yield blob

        left = texts()
        yield now, blobs, left
        for _ in left:
            pass
        blobs.clear()
        release()
