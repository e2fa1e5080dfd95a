"""Exact substring deduplication: bytes that lie in a repeated run of `length` bytes go, the first copy stays.

A byte goes if a run of `length` (100) bytes over it also starts earlier, in a document with a smaller id or earlier in the
same one. The suffixes of a whole corpus can't be sorted in one place, so runs are dealt out in such a way that equal ones meet;
there their suffixes are sorted and their longest previous factors found.

1. Every run's anchor is its 32-byte piece with the least hash (the leftmost of equals), so equal runs have equal
   anchors at equal places. The runs with one anchor make up a zone of up to 168 bytes; anchors are about one in 35.
   Zones equal to one that an earlier document of the same task has are covered, and all others are sent, as two hashes
   each, to where zones with equal anchors meet. There all but the first of equal zones (64-bit hash) are covered.
2. Where an anchor has different zones, copies begin or end. From the first of each of these (and from no others) the
   text itself is sent, in up to four slices by the anchor's place in the run, keyed by a hash of what all runs of a slice
   have in common (at least 83 bytes), so that a common short line brings nothing together. Where slices meet, their
   positions whose next `length` bytes come again (by hash) are sorted by these bytes, as in a suffix array; the previous and
   next positions of smaller documents in that order give each one's longest previous factor, and where it reaches
   `length` bytes, these are covered.
3. Covered stretches are dealt out by document, and meet the text.

No step has a group that grows with the copies of a text: each task sends one zone, or slice, of a kind.

Defined cases: null texts are empty ones; texts shorter than `length` lose nothing; rows that share a doc_id are not earlier
than one another (rows alike in text too get the same result each); a null doc_id comes before all others; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, table
from tidemark.llm.dealing import ROW, by_part, deal, dealt, groups, home, pack, part_keys, rows_of, send_texts, unpack, unpack_texts
from tidemark.llm.textarrays import Hasher, U, blocks, mix

LENGTH, PIECE, SLICES = 100, 32, 4
FLUSH = 1_500_000
NULL_ID = -(2**63)
#: Hashed positions within a block; the rest of 64 bits is for the hash that is compared.
PLACE_BITS = 30


def zones(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[Hasher, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """hasher; and for each zone: row, anchor, first and last start of a run (in the block), hash of the anchor."""
    hasher = Hasher(data)
    none = np.zeros(0, np.int64)
    if len(data) < length:
        return hasher, none, none, none, none, np.zeros(0, U)
    w = length - PIECE + 1
    n = len(data) - PIECE + 1
    h = hasher.pieces(PIECE)
    key = np.full(-(-n // w) * w, ~U(0), U)
    key[:n] = ((h >> U(PLACE_BITS)) << U(PLACE_BITS)) | np.arange(n, dtype=U)
    grid = key.reshape(-1, w)
    left = np.minimum.accumulate(grid, axis=1).ravel()
    right = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - length + 1
    least = np.minimum(right[:count], left[w - 1 : w - 1 + count])
    anchor = (least & U((1 << PLACE_BITS) - 1)).astype(np.int64)
    rows = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[:count]
    whole = np.arange(count) + length <= offsets[rows + 1]
    change = np.ones(count, bool)
    change[1:] = (anchor[1:] != anchor[:-1]) | (rows[1:] != rows[:-1]) | (whole[1:] != whole[:-1])
    first = np.flatnonzero(change)
    last = np.append(first[1:], count) - 1
    ok = whole[first]
    first, last = first[ok], last[ok]
    a = anchor[first]
    return hasher, rows[first], a, first, last, h[a]


def earlier(same: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which members of runs of equals (same: True where an element equals the one before; each run is sorted by doc, row,
    at) have an earlier one: another document's with a smaller id, or their own."""
    if not len(doc):
        return np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))
    own = np.ones(len(doc), bool)
    own[1:] = ~same[1:] | (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])
    first = np.maximum.accumulate(np.where(own, np.arange(len(doc)), 0))
    return (doc > doc[start]) | (at > at[first])


#: Kinds of rows: zones that are still to be compared, stretches that are covered, anchors whose zones' text is wanted.
ZONE, COVERED, WANTED = 0, 1, 2


def _covered(doc, row, lo, hi, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Stretches of bytes by document, those that touch joined."""
    if len(doc):
        order = np.lexsort((lo, row, doc))
        doc, row, lo, hi = doc[order], row[order], lo[order], hi[order]
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (row[1:] != row[:-1]) | (lo[1:] > hi[:-1])
        at = np.flatnonzero(fresh)
        hi = np.maximum.reduceat(hi, at)
        yield dealt(home(doc[at], row[at], len(keys)), COVERED, keys, doc[at], row[at], lo=lo[at].astype(np.uint32), hi=hi.astype(np.uint32))


def _anchors(batches: Iterator[pa.RecordBatch], length: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def flush() -> Iterator[pa.RecordBatch]:
        doc, row, h, z, a, back, more = (np.concatenate(x) for x in zip(*held, strict=True))
        order = np.lexsort((a, row, doc, z, h))
        doc, row, h, z, a, back, more = (x[order] for x in (doc, row, h, z, a, back, more))
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (z[1:] == z[:-1])
        late = earlier(same, doc, row, a)
        lo = a - back
        yield from _covered(doc[late], row[late], lo[late], (lo + more + length)[late], keys)
        doc, row, h, z, a, back, more = (x[~late] for x in (doc, row, h, z, a, back, more))
        part = ((h >> U(32)) % U(len(keys))).astype(np.int64)
        yield dealt(part, ZONE, keys, doc, row, h=(h & U(0xFFFFFFFF)).astype(np.uint32), z=z, a=a.astype(np.uint32), back=back.astype(np.uint8), more=more.astype(np.uint8))

    n = 0
    for batch in batches:
        docs, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        for at, data, offsets in blocks(batch.column(2)):
            hasher, row, a, first, last, h = zones(data, offsets, length)
            begin = offsets[row]
            z = mix(hasher.of(first, last + length) ^ mix(((a - first) * 256 + last - first).astype(U)))
            held.append((docs[at + row], hashes[at + row], h, z, a - begin, a - first, last - first))
            n += len(a)
            if n >= FLUSH:
                yield from flush()
                held, n = [], 0
    if n:
        yield from flush()


def _again(part: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
    """What is covered already, and is at home here, as one row."""
    if blobs:
        x = unpack(blobs)
        blob = pack(x["doc"], x["row"], lo=x["lo"], hi=x["hi"])
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([COVERED], pa.int32()), pa.array([blob], pa.binary())], names=["part", "kind", "blob"])


def _compare_zones(batches: Iterator[pa.RecordBatch], length: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, blobs, _ in by_part(batches):
        yield from _again(part, blobs.get(COVERED, []))
        if ZONE not in blobs:
            continue
        x = unpack(blobs[ZONE])
        order = np.lexsort((x["a"], x["row"], x["doc"], x["z"], x["h"]))
        x = {k: v[order] for k, v in x.items()}
        alike = np.zeros(len(order), bool)
        alike[1:] = x["h"][1:] == x["h"][:-1]
        same = alike.copy()
        same[1:] &= x["z"][1:] == x["z"][:-1]
        late = earlier(same, x["doc"], x["row"], x["a"])
        lo = x["a"].astype(np.int64) - x["back"]
        yield from _covered(x["doc"][late], x["row"][late], lo[late], (lo + x["more"] + length)[late], keys)
        group = np.cumsum(~alike) - 1
        different = np.bincount(group, ~same) > 1
        want = different[group] & ~late
        if want.any():
            doc, row = x["doc"][want], x["row"][want]
            yield dealt(home(doc, row, len(keys)), WANTED, keys, doc, row, a=x["a"][want], back=x["back"][want], more=x["more"][want])


def _sorted(x: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    order = np.lexsort((x["row"], x["doc"]))
    x = {k: v[order] for k, v in x.items()}
    fresh = np.ones(len(order), bool)
    fresh[1:] = (x["doc"][1:] != x["doc"][:-1]) | (x["row"][1:] != x["row"][:-1])
    at = np.flatnonzero(fresh)
    where = {(d, r): (lo, hi) for d, r, lo, hi in zip(x["doc"][at].tolist(), x["row"][at].tolist(), at.tolist(), [*at[1:].tolist(), len(order)], strict=True)}
    return x | {"where": where}


def _slices(batches: Iterator[pa.RecordBatch], length: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The wanted zones' text, in slices by the anchor's place in the run."""
    step = -(-(length - PIECE + 1) // SLICES)
    for _, blobs, texts in by_part(batches):
        if WANTED not in blobs:
            continue
        entries = _sorted(unpack(blobs[WANTED]))
        out, bodies = [], []
        for doc, row, text in (x for blob in texts for x in unpack_texts(blob)):
            if (doc, row) not in entries["where"]:
                continue
            lo, hi = entries["where"][doc, row]
            data = np.frombuffer(text, np.uint8)
            hasher = Hasher(data)
            a, back, more = (entries[k][lo:hi].astype(np.int64) for k in ("a", "back", "more"))
            for s in range(SLICES):
                # Runs that start between s * step and s * step + step - 1 bytes before the anchor.
                first = np.maximum(a - back, a - (s * step + step - 1))
                last = np.minimum(a - back + more, a - s * step)
                ok = first <= last
                # All of them have this in common:
                c0, c1 = a - s * step, a - (s * step + step - 1) + length
                ok &= (c0 >= 0) & (c1 <= len(data))
                if ok.any():
                    f, l, c0, c1 = first[ok], last[ok], c0[ok], c1[ok]
                    key = mix(hasher.of(c0, c1) ^ U(s + 1))
                    whole = mix(hasher.of(f, l + length) ^ mix(((c0 - f) * 256 + l - f).astype(U)))
                    out.append((np.full(len(f), doc), np.full(len(f), row), key, whole, f, l - f))
                    bodies += [data[x:y].tobytes() for x, y in zip(f, l + length, strict=True)]
        if out:
            doc, row, key, whole, first, more = (np.concatenate(x) for x in zip(*out, strict=True))
            # Of slices that are equal from end to end the first is sent, the others are covered.
            order = np.lexsort((first, row, doc, whole, key))
            same = np.zeros(len(order), bool)
            same[1:] = (key[order][1:] == key[order][:-1]) & (whole[order][1:] == whole[order][:-1])
            late = earlier(same, doc[order], row[order], first[order])
            gone, kept = order[late], np.sort(order[~late])
            yield from _covered(doc[gone], row[gone], first[gone], first[gone] + more[gone] + length, keys)
            part = (key[kept] % U(len(keys))).astype(np.int64)
            packed = []
            for _, r in (by := groups(part)):
                some = kept[r]
                # pack() keeps the order of entries, so bodies can follow in it.
                blob = pack(doc[some], row[some], first=first[some].astype(np.uint32), more=more[some].astype(np.uint8))
                text = pa.compress(b"".join(bodies[i] for i in some), "zstd", asbytes=True)
                packed.append(np.array([len(blob), int((more[some] + length).sum())], np.int64).tobytes() + blob + text)
            yield rows_of([p for p, _ in by], ZONE, packed, keys)


def smaller_before(rank: np.ndarray, common: np.ndarray) -> np.ndarray:
    """For each place the length that it has in common with the nearest place before that has a smaller rank, 0 if there is none.

    common: what each place has in common with the one before it. Places point to the one before, and where that has no
    smaller rank, to where it points itself: nothing in between is smaller, so pointers double their reach.
    """
    to, least = np.arange(len(rank)) - 1, common.copy()
    live = np.flatnonzero((to >= 0) & (least > 0))
    while len(live := live[(to[live] >= 0) & (least[live] > 0)]):
        live = live[rank[to[live]] >= rank[live]]
        over = to[live]
        least[live], to[live] = np.minimum(least[live], least[over]), to[over]
    return np.where(to >= 0, least, 0)


def longest_previous(windows: np.ndarray, doc: np.ndarray, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Longest previous factor of each position: how many bytes from there on, up to a window's, also start earlier, in a
    document with a smaller id or before in the same text.

    Positions are sorted by what follows them, ties by document and place. In that order the longest match with an earlier
    document is at the previous or the next position with a smaller one.
    """
    n = len(windows)
    if not n:
        return np.zeros(0, np.int64)
    text = np.ascontiguousarray(windows).view(f"S{windows.shape[1]}").ravel()
    order = np.lexsort((at, row, doc, text))
    sorted_, doc, row, at = windows[order], doc[order], row[order], at[order]
    odd = sorted_[1:] != sorted_[:-1]
    common = np.zeros(n + 1, np.int64)
    common[1:n] = np.where(odd.any(axis=1), odd.argmax(axis=1), windows.shape[1])
    best = np.maximum(smaller_before(doc, common[:n]), smaller_before(doc[::-1], common[1:][::-1])[::-1])
    own = np.zeros(n, bool)  # the same text's positions lie side by side where all that follows is equal
    own[1:] = (doc[1:] == doc[:-1]) & (row[1:] == row[:-1]) & (at[1:] > at[:-1])
    best = np.maximum(best, np.where(own, common[:n], 0))
    out = np.empty(n, np.int64)
    out[order] = best
    return out


def _compare_slices(batches: Iterator[pa.RecordBatch], length: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, blobs, _ in by_part(batches):
        yield from _again(part, blobs.get(COVERED, []))
        if ZONE not in blobs:
            continue
        metas, texts = [], []
        for blob in blobs[ZONE]:
            head, size = (int(v) for v in np.frombuffer(blob, np.int64, 2))
            metas.append(blob[16 : 16 + head])
            texts.append(pa.decompress(blob[16 + head :], size, "zstd", asbytes=True))
        x = unpack(metas)
        data = np.frombuffer(b"".join(texts), np.uint8)
        n = x["more"].astype(np.int64) + 1
        begin = np.concatenate([[0], np.cumsum(n + length - 1)[:-1]])
        owner = np.repeat(np.arange(len(n)), n)
        place = np.arange(n.sum()) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        pos = begin[owner] + place
        hasher = Hasher(data)
        # A run that is alone needs no sorting.
        h = hasher.of(pos, pos + length)
        order = np.argsort(h, kind="stable")
        dup = np.zeros(len(h), bool)
        again = h[order][1:] == h[order][:-1]
        dup[order[1:][again]] = True
        dup[order[:-1][again]] = True
        pos, owner, place = pos[dup], owner[dup], place[dup]
        if not len(pos):
            continue
        doc, row, at = x["doc"][owner], x["row"][owner], x["first"][owner].astype(np.int64) + place
        windows = np.lib.stride_tricks.sliding_window_view(data, length)[pos]
        late = longest_previous(windows, doc, row, at) >= length
        yield from _covered(doc[late], row[late], at[late], at[late] + length, keys)


def _apply(batches: Iterator[pa.RecordBatch], digest: bool) -> Iterator[pa.RecordBatch]:
    """doc, n_bytes, n_removed, n_spans, kept (the remaining bytes, or their SHA-256) of each document."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"]
    for _, blobs, texts in by_part(batches):
        entries = _sorted(unpack(blobs[COVERED])) if COVERED in blobs else {"where": {}}
        for blob in texts:
            rows = []
            for doc, row, text in unpack_texts(blob):
                n, spans, kept = len(text), 0, text
                if (doc, row) in entries["where"]:
                    lo, hi = entries["where"][doc, row]
                    marks = np.zeros(n + 1, np.int64)
                    np.add.at(marks, entries["lo"][lo:hi].astype(np.int64), 1)
                    np.add.at(marks, entries["hi"][lo:hi].astype(np.int64), -1)
                    gone = np.cumsum(marks)[:n] > 0
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((None if doc == NULL_ID else doc, n, n - len(kept), spans, hashlib.sha256(kept).hexdigest() if digest else kept))
            kinds = [pa.int64()] * 4 + [pa.string() if digest else pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, digest: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: for each row of docs what goes and what remains, as bytes (a cut may fall
    inside a character); with digest, kept_sha256 in place of kept."""
    if not PIECE < length <= PIECE + 224:
        raise ValueError(f"length must be between {PIECE + 1} and {PIECE + 224}")
    keys = part_keys(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(NULL_ID)).alias("doc"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    bodies = rows.mapInArrow(lambda it: send_texts(it, keys), ROW)

    found = deal(rows.mapInArrow(lambda it: _anchors(it, length, keys), ROW), keys).mapInArrow(lambda it: _compare_zones(it, length, keys), ROW)
    found = checkpointed(found)
    more = deal(found.where(F.col("kind") == WANTED).unionByName(bodies), keys).mapInArrow(lambda it: _slices(it, length, keys), ROW)
    more = checkpointed(deal(more, keys).mapInArrow(lambda it: _compare_slices(it, length, keys), ROW))
    covered = found.where(F.col("kind") == COVERED).unionByName(more)
    return deal(covered.unionByName(bodies), keys).mapInArrow(lambda it: _apply(it, digest), "doc_id long, n_bytes long, n_removed long, n_spans long, " + ("kept_sha256 string" if digest else "kept binary"))


def op2_substrings(spark, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"), digest=True)


OP2_SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS MATERIALIZED (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 200)) AS k FROM (SELECT doc_id, h, unnest(generate_series(0, length(h) // 2 - 100)) AS i FROM d WHERE length(h) >= 200)),
f AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w) WHERE r > 1),
c AS (SELECT DISTINCT doc_id, i + j AS b FROM f, generate_series(0, 99) AS t(j)),
s AS (SELECT doc_id, count(*) AS n_removed, count(*) FILTER (b - p > 1 OR p IS NULL) AS n_spans FROM (SELECT doc_id, b, lag(b) OVER (PARTITION BY doc_id ORDER BY b) AS p FROM c) GROUP BY doc_id),
k AS (SELECT d.doc_id, string_agg(substr(d.h, 2 * x.b + 1, 2), '' ORDER BY x.b) AS kept FROM (SELECT doc_id, unnest(generate_series(0, length(h) // 2 - 1)) AS b FROM d WHERE doc_id IN (SELECT doc_id FROM f)) x
  JOIN d ON d.doc_id = x.doc_id LEFT JOIN c ON c.doc_id = x.doc_id AND c.b = x.b WHERE c.b IS NULL GROUP BY d.doc_id)
SELECT d.doc_id, length(h) // 2 AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(CASE WHEN s.doc_id IS NULL THEN h ELSE coalesce(kept, '') END)) AS kept_sha256
FROM d LEFT JOIN s USING (doc_id) LEFT JOIN k USING (doc_id)
"""
