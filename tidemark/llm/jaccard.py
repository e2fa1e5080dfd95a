"""N-gram Jaccard join by partitioning the universe, exact.

Two sets r, s with |r & s| >= t |r | s| differ in at most (1-t)/(1+t) (|r|+|s|) elements. Sizes are cut into bands; for the
band of the smaller set that bound is a number k. Tokens are hashed into m segments, some more than k + 1, and a set's
signature of a segment is a hash of what it has there: k differences leave at least m - k segments equal. Costs decide
which segments a set is indexed by: of the filled ones, the k + 1 whose signatures the fewest sets have, by an exact count.
One order of rarity holds for all, so the rarest segment that two similar sets share is among the indexed ones of
both (all others that they share stand above it, and no more than those are left out). A set with fewer than k + 1 segments
filled is indexed by all of these and by their one-deletion neighbourhoods: what a segment has, and that without any one of
its tokens. Where two such sets share no segment, one filled segment of the first differs in one token only, as k
differences don't reach for two in each; its neighbourhoods meet. Sets too small even for that are indexed by their tokens too.

Counts take one exchange: signatures meet once, those of one set only end there, and the few others go back to their sets,
which leave out their most frequent ones and send the rest on. Nothing of the size of the corpus is broadcast.

Sets that are equal are found by their hash and are never paired. Members of a signature, as lists, are made distinct.
Each document is first compared with one other, by their texts; that joins most copies. After that, pairs of short lists
and members of long ones are only compared if they are not in one component yet (others can't change anything), and only
if their sketches, a bound from below on how many tokens differ, allow for it. So no link between components is lost, and
no large group is paired out. A list of more than BLOCK members is compared in blocks: its most frequent component by chunks
with the others, and the others with each other, so that no task holds more than two blocks.

Defined cases: null, empty and blank texts have no set and no links; rows that share a doc_id are one node, linked if any
of their texts is; rows with a null doc_id have no component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import checkpointed, private_name, table
from tidemark.llm.components import components
from tidemark.llm.dealing import ROW, TEXTS, by_part, deal, dealt, groups, home, pack_texts, part_keys, release, rows_of, send_texts, unpack, unpack_texts
from tidemark.llm.textarrays import ODD, U, mix, shingle_sets

WIDTH, PERCENT = 5, 80
SLACK, BAND = 0.5, 1.5
#: Lists of up to SMALL sets give all pairs; signatures kept before they are sent on.
SMALL, FLUSH = 8, 1_500_000
#: Partners of one document that are compared in one task.
HUB = 64
#: Partners from other components that each document is compared with before all others are.
NEAREST = 3
#: Members of each component that a list brings to that comparison; members of a list that one task compares with as many.
FEW, BLOCK = 8, 4_096
#: Ids (about 50 bytes each in memory) go to the documents by broadcast up to so many, else by shuffle.
MAX_BROADCAST_IDS = 500_000
#: Kinds of rows that tasks send each other.
ENTRIES, SPARES, ROWS = 0, 1, 2


class Bands:
    """Size bands with their k and m, for a threshold in percent."""

    def __init__(self, percent: int):
        self.percent, self.low, self.k, self.m = percent, [1], [], []

    def _grow(self, n: int) -> None:
        while self.low[-1] <= n:
            lo = self.low[-1]
            hi = max(lo + 1, int(lo * BAND))
            larger = (hi - 1) * 100 // self.percent
            k = (hi - 1 + larger) * (100 - self.percent) // (100 + self.percent)
            self.k.append(k)
            self.m.append(k + 1 + (int(np.ceil(SLACK * (k + 1))) if k else 0))
            self.low.append(hi)

    def of(self, n: int) -> list[int]:
        """The bands of a smaller set that one of size n can be similar to, its own included."""
        self._grow(n)
        least = -(-n * self.percent // 100)
        return [b for b in range(np.searchsorted(self.low, least, "right") - 1, np.searchsorted(self.low, n, "right"))]


def signatures(tokens: np.ndarray, bands: Bands) -> Iterator[tuple[np.ndarray, int]]:
    """(signatures, how many of them may be left out), for each band that a set takes part in."""
    for b in bands.of(len(tokens)):
        k, m = bands.k[b], bands.m[b]
        x = mix(tokens + ODD[9])
        seg = ((x >> U(33)) % U(m)).astype(np.int64)
        low = np.bincount(seg, (x & U(0xFFFFFFFF)).astype(float), m).astype(U)
        high = np.bincount(seg, (x >> U(32)).astype(float), m).astype(U)
        sums, filled = low + (high << U(32)), np.bincount(seg, minlength=m)
        salt = mix(np.arange(m, dtype=U) + U((b << 32) + 1))
        sig = mix(sums ^ salt)[filled > 0]
        if len(sig) > k:
            yield sig, len(sig) - k - 1
            continue
        near = mix(salt)  # of neighbourhoods
        own = [sig, mix(sums ^ near)[filled > 0], mix((sums[seg] - x) ^ near[seg])[filled[seg] > 1]]
        if np.minimum(filled, 2).sum() <= k:
            own.append(mix(tokens ^ mix(np.array([b], U) + U(77 << 40))))
        yield np.unique(np.concatenate(own)), 0


def sketch(tokens: np.ndarray) -> bytes:
    """A bit for each of 2n buckets or more (a power of two): whether it holds an odd number of tokens.

    Each token in which two sets differ changes one bit, so sets differ in at least as many tokens as their sketches in
    bits; the longer of two sketches is folded to the length of the other.
    """
    if not len(tokens):
        return b""
    size = max(64, 1 << int(2 * len(tokens) - 1).bit_length())
    return np.packbits((np.bincount((tokens & U(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool), bitorder="little").tobytes()


def _folded(bits: np.ndarray, size: int) -> np.ndarray:
    return np.bitwise_xor.reduce(bits.reshape(*bits.shape[:-1], -1, size), axis=-2) if bits.shape[-1] > size else bits


FAR = 1 << 40


def distances(x: bytes, n: int, others: list[bytes], sizes: np.ndarray, percent: int) -> np.ndarray:
    """In how many bits the sketches of others differ from that of x; FAR for those that can't be similar to x, as their
    sizes (0 where unknown) don't fit or the sketches differ in more bits than similar sets may."""
    fits = (np.minimum(sizes, n) * 100 >= np.maximum(sizes, n) * percent) | (sizes == 0) | (n == 0)
    out = np.where(fits, 0, FAR)
    own = np.frombuffer(x, np.uint64)
    if not len(own):  # no sketches: sizes decide alone
        return out
    lengths = np.array([len(o) for o in others])
    for length in np.unique(lengths[fits]):
        some = np.flatnonzero(fits & (lengths == length))
        them = np.frombuffer(b"".join([others[i] for i in some]), np.uint64).reshape(len(some), -1)
        words = min(len(own), length // 8)
        bits = np.bitwise_count(_folded(them, words) ^ _folded(own, words)).sum(axis=1, dtype=np.int64)
        out[some] = np.where(bits * (100 + percent) <= (sizes[some] + n) * (100 - percent), bits, FAR)
    return out


def _blob(**columns: np.ndarray) -> bytes:
    """Columns of numbers as bytes: names, kinds and lengths in a line, then all of them in one compressed piece."""
    raw = b"".join(np.ascontiguousarray(v).tobytes() for v in columns.values())
    head = ";".join([str(len(raw)), *(f"{k}:{v.dtype.str}:{len(v)}" for k, v in columns.items())])
    return f"{head}\n".encode() + pa.compress(raw, "zstd", asbytes=True)


def _columns(blobs: list[bytes]) -> dict[str, np.ndarray]:
    out: dict[str, list[np.ndarray]] = {}
    for blob in blobs:
        head, _, body = blob.partition(b"\n")
        size, *kinds = head.decode().split(";")
        raw, at = pa.decompress(body, int(size), "zstd", asbytes=True), 0
        for kind in kinds:
            name, dtype, n = kind.split(":")
            out.setdefault(name, []).append(np.frombuffer(raw, dtype, int(n), at))
            at += out[name][-1].nbytes
    return {k: np.concatenate(v) for k, v in out.items()}


def _stream(batch: pa.RecordBatch) -> bytes:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return out.getvalue().to_pybytes()


def _entries_of(part: np.ndarray, keys: np.ndarray, doc: np.ndarray, **columns: np.ndarray) -> pa.RecordBatch:
    """Entries dealt into parts, a row for each; ids as steps from one to the next."""
    by = groups(part)
    return rows_of([p for p, _ in by], ENTRIES, [_blob(doc=np.diff(doc[r], prepend=np.int64(0)), **{k: v[r] for k, v in columns.items()}) for _, r in by], keys)


def _received(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts = [_columns([b]) for b in blobs]
    for x in parts:
        x["doc"] = np.cumsum(x["doc"])
    return {k: np.concatenate([x[k] for x in parts]) for k in parts[0]}


def _part_of(sig: np.ndarray, keys: np.ndarray) -> np.ndarray:
    return ((sig >> U(40)) % U(len(keys))).astype(np.int64)


def _index(batches: Iterator[pa.RecordBatch], percent: int, width: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (id, n, h1, h2, sketch) of all texts, and, dealt into parts, the signatures of sets with how many may be left out.

    Of equal sets in a task the first stands for all. Of a signature 40 bits are sent beside its part (texts decide in the end).
    """
    bands, seen = Bands(percent), set()
    sigs, docs, slots, spares, sizes, held = [], [], [], [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        sig, sent = np.concatenate(sigs), [len(s) for s in sigs]
        doc, slot = np.array(docs, np.int64), np.array(slots, np.uint8)
        part, cut = _part_of(sig, keys), sig & U((1 << 40) - 1)
        yield _entries_of(part, keys, np.repeat(doc, sent), slot=np.repeat(slot, sent), low=cut.astype(np.uint32), high=(cut >> U(32)).astype(np.uint8))
        own = home(doc, np.zeros(len(doc), np.int64), len(keys))
        spare, n = np.array(spares, np.int32), np.array(sizes, np.int32)
        by = groups(own)
        yield rows_of([p for p, _ in by], SPARES, [_blob(doc=doc[r], slot=slot[r], spare=spare[r], n=n[r]) for _, r in by], keys)

    for batch in batches:
        n, h1, h2, sketches = [], [], [], []
        for doc, tokens in zip(batch.column(0).to_pylist(), shingle_sets(batch.column(1), width), strict=True):
            n.append(len(tokens))
            h1.append(mix(tokens).sum(dtype=U))
            h2.append(mix(tokens ^ ODD[15]).sum(dtype=U))
            sketches.append(sketch(tokens))
            if doc is None or not len(tokens) or (key := (len(tokens), int(h1[-1]), int(h2[-1]))) in seen:
                continue
            seen.add(key)
            for slot, (sig, spare) in enumerate(signatures(tokens, bands)):
                sigs.append(sig)
                docs.append(doc)
                slots.append(slot)
                spares.append(spare)
                sizes.append(len(tokens))
                held += len(sig)
            if held >= FLUSH:
                yield from flush()
                sigs, docs, slots, spares, sizes, held = [], [], [], [], [], 0
                release()
        if len(batch):
            sums = [pa.array(np.array(h, U).view(np.int64)) for h in (h1, h2)]
            own = pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *sums, pa.array(sketches, pa.binary())], names=["id", "n", "h1", "h2", "sketch"])
            yield rows_of([int(h1[0] % U(len(keys)))], ROWS, [_stream(own)], keys)
    if held:
        yield from flush()
    del sigs, docs, slots, spares, sizes, seen
    release()


def _meet(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Signatures of two sets or more, with how many have them, to where their sets are at home; all else as it came."""
    for key, blobs, _ in by_part(batches):
        part = int(np.flatnonzero(keys == key)[0])
        for kind in (SPARES, ROWS):
            if kind in blobs:
                yield rows_of([part] * len(blobs[kind]), kind, blobs[kind], keys)
        if ENTRIES not in blobs:
            continue
        x = _received(blobs.pop(ENTRIES))
        sig, doc, slot = x["low"].astype(U) | (x["high"].astype(U) << U(32)), x["doc"], x["slot"]
        del x
        order = np.argsort(sig, kind="stable")
        sig = sig[order]
        some = np.zeros(len(sig), bool)
        some[1:] = sig[1:] == sig[:-1]
        some[:-1] |= some[1:]  # of one set only: most
        sig, doc, slot = sig[some], doc[order[some]], slot[order[some]]
        order = np.lexsort((slot, doc, sig))
        sig, doc, slot = sig[order], doc[order], slot[order]
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])
        sig, doc, slot = sig[fresh], doc[fresh], slot[fresh]
        size = np.diff(np.append(np.flatnonzero(np.diff(sig, prepend=~sig[:1])), len(sig)))
        count = np.repeat(size, size)
        r = np.flatnonzero(count > 1)
        if len(r):
            r = r[np.argsort(doc[r], kind="stable")]
            yield _entries_of(home(doc[r], np.zeros(len(r), np.int64), len(keys)), keys, doc[r], slot=slot[r], sig=sig[r] | (U(part) << U(40)), count=count[r].astype(np.int32))


def _choose(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The signatures that sets are indexed by, without the most frequent ones that each may leave out."""
    for _, blobs, _ in by_part(batches):
        if ENTRIES not in blobs:
            continue
        x, y = _received(blobs[ENTRIES]), _columns(blobs[SPARES])
        # An id with several texts leaves out nothing, and its size isn't known.
        order = np.lexsort((y["slot"], y["doc"]))
        owner, place, spare, n = y["doc"][order], y["slot"][order], y["spare"][order], y["n"][order].astype(np.int64)
        again = np.zeros(len(owner), bool)
        again[1:] = (owner[1:] == owner[:-1]) & (place[1:] <= place[:-1]) | (owner[1:] == owner[:-1]) & (n[1:] != n[:-1])
        again = np.isin(owner, owner[1:][again[1:]]) if again.any() else again
        spare, n = np.where(again, 0, spare), np.where(again, 0, n)
        order = np.lexsort((x["sig"], x["count"], x["slot"], x["doc"]))
        doc, slot, sig = (x[k][order] for k in ("doc", "slot", "sig"))
        fresh = np.ones(len(doc), bool)
        fresh[1:] = (doc[1:] != doc[:-1]) | (slot[1:] != slot[:-1])
        start = np.flatnonzero(fresh)
        size = np.diff(np.append(start, len(doc)))
        rank = np.arange(len(doc)) - np.repeat(start, size)
        at = np.searchsorted(owner, doc[start])  # the first of each id, from where its slots follow in order
        at = np.where(again[at], at, at + slot[start])
        keep = rank < np.repeat(size - spare[at], size)
        if keep.any():
            sizes = np.repeat(n[at], size)[keep]
            yield _entries_of(((sig[keep] >> U(40)) % U(len(keys))).astype(np.int64), keys, doc[keep], sig=sig[keep], n=sizes.astype(np.int32))


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """a, b, members: a hash, and the ids and sizes, of the sets of each signature that several have; each list once in a part."""
    for _, blobs, _ in by_part(batches):
        x = _received(blobs[ENTRIES])
        order = np.lexsort((x["doc"], x["sig"]))
        sig, doc, n = (x[k][order] for k in ("sig", "doc", "n"))
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (doc[1:] != doc[:-1])
        sig, doc, n = sig[fresh], doc[fresh], n[fresh]
        start = np.flatnonzero(np.diff(sig, prepend=~sig[:1]))
        size = np.diff(np.append(start, len(sig)))
        h = mix(doc.view(U) + ODD[3])
        one, two = (np.add.reduceat(v, start).view(np.int64) for v in (h, mix(h)))
        some = np.flatnonzero(size > 1)
        some = some[np.unique(np.stack([one[some], two[some]]), axis=1, return_index=True)[1]] if len(some) else some
        for lo in range(0, len(some), 10_000):
            g = some[lo : lo + 10_000]
            lists = [doc[s : s + k].tobytes() + n[s : s + k].astype(np.int32).tobytes() for s, k in zip(start[g].tolist(), size[g].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(one[g]), pa.array(two[g]), pa.array(lists, pa.binary())], names=["a", "b", "members"])


def _pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b: all pairs, by size, of lists (members) of few."""
    for batch in batches:
        left, right = [], []
        for blob in batch.column(0):
            raw = blob.as_py()
            g = len(raw) // 12
            ids, n = np.frombuffer(raw, np.int64, g), np.frombuffer(raw, np.int32, g, 8 * g).astype(np.int64)
            i, j = np.triu_indices(g, 1)
            fits = (np.minimum(n[i], n[j]) * 100 >= np.maximum(n[i], n[j]) * percent) | (n[i] == 0) | (n[j] == 0)
            left.append(ids[i[fits]])
            right.append(ids[j[fits]])
        if left:
            low, high = np.concatenate(left), np.concatenate(right)
            if len(low):
                low, high = np.unique(np.stack([low, high]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], names=["a", "b"])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for blob in batch.column(0):
            yield from pa.ipc.open_stream(blob.as_py()).read_all().to_batches()


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """The rows of each value of the first columns, which come one after the other."""
    held, now = [], None
    for batch in batches:
        if not len(batch):
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(keys)])
        edges = [0, *(np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1).tolist(), len(batch)]
        for lo, hi in zip(edges, edges[1:], strict=False):
            if held and tuple(k[:, lo]) != now:
                yield pa.Table.from_batches(held)
                held = []
            now = tuple(k[:, lo])
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield pa.Table.from_batches(held)


def _across(batches: Iterator[pa.RecordBatch], percent: int, nearest: bool) -> Iterator[pa.RecordBatch]:
    """a, b, d: plausible pairs whose labels differ, from the rows (a, b, x, y, label, id, n, sketch) of each list or of two
    blocks of one, sent on some thousands at a time; with nearest, for each a only the b whose sketch is nearest."""
    names = ["a", "b", "d"]
    for run in _runs(batches, 4):
        if len(run) > 1:
            run = run.sort_by([("n", "ascending"), ("id", "ascending")])
            n, label, ids = (run[k].to_numpy().astype(np.int64) for k in ("n", "label", "id"))
            bits = run["sketch"].to_pylist()
            upto = np.where(n > 0, np.searchsorted(n, n * 100 // percent, "right"), len(n))
            best, partner = np.full(len(n), FAR), np.zeros(len(n), np.int64)
            out, held = [], 0
            for i in range(len(n)):
                other = i + 1 + np.flatnonzero(label[i + 1 : upto[i]] != label[i])
                if not len(other):
                    continue
                d = distances(bits[i], int(n[i]), [bits[j] for j in other], n[other], percent)
                other, d = other[d < FAR], d[d < FAR]
                if nearest and len(other):
                    nearer = other[d < best[other]]
                    best[nearer], partner[nearer] = d[d < best[other]], i
                    if d.min() < best[i]:
                        best[i], partner[i] = d.min(), other[d.argmin()]
                elif len(other):
                    out.append((np.minimum(ids[i], ids[other]), np.maximum(ids[i], ids[other]), d))
                    held += len(other)
                    if held > 100_000:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)
                        out, held = [], 0
            some = np.flatnonzero(best < FAR)
            if len(some):
                out.append((ids[some], ids[partner[some]], best[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], names=names)


def _sift(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """a, b, d: the plausible ones of pairs (a, b, n_a, n_b, sketch_a, sketch_b)."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in (2, 3, 4, 5)]
        d = np.array([distances(x, n, [y], np.array([m]), percent)[0] for n, m, x, y in zip(*cols, strict=True)], np.int64)
        out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(d)], names=["a", "b", "d"])
        yield out.filter(pa.array(d < FAR))


ASK, PAIR = 0, 1


def _entries(batches: Iterator[pa.RecordBatch], kind: int, keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, part) as entries: pairs at that part, or asks of a document (a = b) at its home."""
    for batch in batches:
        if len(batch):
            a, b, part = (batch.column(i).to_numpy().astype(np.int64) for i in range(3))
            if kind == PAIR:
                yield dealt(part, PAIR, keys, a, b, n=np.zeros(len(a), np.uint8))
            else:
                yield dealt(home(a, np.zeros(len(a), np.int64), len(keys)), ASK, keys, a, np.zeros(len(a), np.int64), to=part.astype(np.int32))


def _send(batches: Iterator[pa.RecordBatch], keys: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Texts from their homes to the parts that ask for them."""
    for _, blobs, texts in by_part(batches):
        if ASK not in blobs:
            continue
        x = unpack(blobs[ASK])
        order = np.argsort(x["doc"], kind="stable")
        ids, to = x["doc"][order], x["to"][order]
        out: dict[int, list] = {}
        for doc, _, text in (x for blob in texts for x in unpack_texts(blob)):
            lo, hi = np.searchsorted(ids, doc), np.searchsorted(ids, doc, "right")
            for part in to[lo:hi].tolist():
                out.setdefault(part, []).append((doc, text))
        parts = sorted(out)
        yield rows_of(parts, TEXTS, [pack_texts(np.array([d for d, _ in out[p]]), np.zeros(len(out[p]), np.int64), [t for _, t in out[p]]) for p in parts], keys)


def _verify(batches: Iterator[pa.RecordBatch], percent: int, width: int) -> Iterator[pa.RecordBatch]:
    """The pairs a, b whose texts are similar."""
    for _, blobs, texts in by_part(batches):
        sets: dict[int, list[np.ndarray]] = {}
        for blob in texts:
            found = list(unpack_texts(blob))
            for (doc, _, _), tokens in zip(found, shingle_sets(pa.array([t for _, _, t in found], pa.binary()), width), strict=True):
                sets.setdefault(doc, []).append(tokens)
        if PAIR not in blobs:
            continue
        x = unpack(blobs[PAIR])
        a, b = x["doc"], x["row"]
        alike = [any(_similar(s, t, percent) for s in sets.get(i, ()) for t in sets.get(j, ())) for i, j in zip(a.tolist(), b.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(a[alike]), pa.array(b[alike])], names=["a", "b"])


def _similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    if not len(s) or not len(t) or min(len(s), len(t)) * 100 < max(len(s), len(t)) * percent:
        return False
    both = np.concatenate([s, t])
    both.sort(kind="stable")  # two sorted runs: one merge
    common = int((both[1:] == both[:-1]).sum())
    return common * (100 + percent) >= percent * (len(s) + len(t))


def _links(pairs: DataFrame, texts: DataFrame, percent: int, width: int, keys: np.ndarray) -> DataFrame:
    """pairs(a, b), a < b, whose texts are similar.

    Each document's text goes home, and from there once to each part that holds pairs with it. The pairs of one a
    meet in one part for every HUB of them, so a document with many partners is compared in many tasks.
    """
    n = len(keys)
    hubs = pairs.groupBy("a").agg(F.count("*").alias("degree")).where(F.col("degree") > HUB)
    spread = F.coalesce(F.ceil(F.col("degree") / HUB), F.lit(1))
    pairs = pairs.join(hubs, "a", "left").select("a", "b", F.pmod(F.xxhash64("a", F.pmod(F.xxhash64("b"), spread)), F.lit(n)).cast("int").alias("part"))
    pairs = checkpointed(pairs)
    asks = pairs.select("a", "part").unionByName(pairs.select(F.col("b").alias("a"), "part")).distinct().select("a", F.col("a").alias("b"), "part")
    wanted = checkpointed(asks.select(F.col("a").alias("id")).distinct())
    if wanted.count() <= MAX_BROADCAST_IDS:
        texts = texts.join(F.broadcast(wanted), "id", "left_semi")
    bodies = texts.select("id", F.lit(0).cast("long").alias("row"), "text").mapInArrow(lambda it: send_texts(it, keys), ROW)
    sent = deal(asks.mapInArrow(lambda it: _entries(it, ASK, keys), ROW).unionByName(bodies), keys).mapInArrow(lambda it: _send(it, keys), ROW)
    both = pairs.mapInArrow(lambda it: _entries(it, PAIR, keys), ROW).unionByName(sent)
    return deal(both, keys).mapInArrow(lambda it: _verify(it, percent, width), "a long, b long")


def join(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """id, n_shingles, component: a row for each row of docs."""
    spark = docs.sparkSession
    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    known = texts.where("id IS NOT NULL AND text IS NOT NULL")
    keys = part_keys(spark)
    index = texts.mapInArrow(lambda it: _index(it, percent, width, keys), ROW)
    met = checkpointed(deal(index, keys).mapInArrow(lambda it: _meet(it, keys), ROW))
    rows = checkpointed(met.where(F.col("kind") == ROWS).select("blob").mapInArrow(_rows, "id long, n long, h1 long, h2 long, sketch binary"))
    chosen = deal(met.where(F.col("kind") != ROWS), keys).mapInArrow(lambda it: _choose(it, keys), ROW)
    lists = deal(chosen, keys).mapInArrow(_lists, "a long, b long, members binary")
    lists = checkpointed(lists.groupBy("a", "b").agg(F.first("members").alias("members")))
    few = F.length("members") <= 12 * SMALL

    # Equal sets are one class, named by its least id; only classes are paired from here on.
    classes = rows.where("n > 0 AND id IS NOT NULL").groupBy("h1", "h2", "n").agg(F.min("id").alias("class"), F.count("*").alias("copies")).where("copies > 1")
    same = checkpointed(rows.join(classes, ["h1", "h2", "n"]).where("id <> class").groupBy("id").agg(F.min("class").alias("class")))

    def of_classes(pairs: DataFrame) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(same.select(F.col("id").alias(side), F.col("class").alias(f"class_{side}")), side, "left").withColumn(side, F.coalesce(f"class_{side}", side)).drop(f"class_{side}")
        return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    sketches = rows.where("n > 0 AND id IS NOT NULL").dropDuplicates(["id"]).select("id", "n", "sketch") if _unique(rows) else None

    def sifted(pairs: DataFrame) -> DataFrame:
        if sketches is None:  # an id with several texts has no one sketch
            return pairs.withColumn("d", F.lit(0).cast("long"))
        for side in ("a", "b"):
            pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
        return pairs.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lambda it: _sift(it, percent), "a long, b long, d long")

    # First each document is compared with one partner: of those that lead a list it is in, or that it is paired with, the one in
    # most lists, which is nearest to the middle of its copies. That joins most of what will be joined.
    short = lists.where(few).select("members").mapInArrow(lambda it: _pairs(it, percent), "a long, b long").distinct()
    short = checkpointed(of_classes(short))
    members = checkpointed(_members(lists.where(~few)))
    weight = checkpointed(members.groupBy("id").agg(F.count("*").alias("lists")))
    heads = members.join(weight, "id").groupBy("a", "b").agg(F.max(F.struct("lists", (-F.col("id")).alias("head"))).alias("x"))
    led = members.join(heads, ["a", "b"]).select("id", F.col("x.lists").alias("lists"), (-F.col("x.head")).alias("head"))
    led = led.unionByName(short.select(F.col("b").alias("id"), F.lit(0).cast("long").alias("lists"), F.col("a").alias("head")))
    led = led.where("id <> head").groupBy("id").agg(F.max(F.struct("lists", (-F.col("head")).alias("head"))).alias("x"))
    tested = checkpointed(sifted(of_classes(led.select(F.col("id").alias("a"), (-F.col("x.head")).alias("b")))).select("a", "b"))
    copies = same.select(F.col("id").alias("a"), F.col("class").alias("b"))
    links = checkpointed(_links(tested, known, percent, width, keys).unionByName(copies))
    labels = checkpointed(components(links))
    few_labels = labels.count() <= MAX_BROADCAST_IDS

    # Then pairs and lists that are not in one component yet: first each document with the nearest few of other components,
    # which joins nearly all that will be joined; at last all that are apart still, and plausible.
    def labelled(df: DataFrame, side: str, label: str) -> DataFrame:
        own = labels.select(F.col("id").alias(side), F.col("component").alias(label))
        return df.join(F.broadcast(own) if few_labels else own, side, "left").withColumn(label, F.coalesce(label, side))

    marked = rows.where("n > 0").groupBy("id").agg(F.first("sketch").alias("sketch")).withColumn("sketch", F.col("sketch") if sketches is not None else F.lit(b""))
    for nearest in (True, False):
        more = sifted(labelled(labelled(short, "a", "label_a"), "b", "label_b").where("label_a <> label_b").select("a", "b"))
        named = checkpointed(labelled(members, "id", "label"))
        mixed = named.groupBy("a", "b").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most").select("a", "b")
        own = named.join(mixed, ["a", "b"], "left_semi")
        if nearest:  # a few of each component will do to find near ones; the last round has them all
            own = own.withColumn("k", F.row_number().over(W.partitionBy("a", "b", "label").orderBy(F.xxhash64("id"), "id"))).where(F.col("k") <= FEW).drop("k")
        across = _blocks(own).join(marked, "id").select("a", "b", "x", "y", "label", "id", "n", "sketch")
        across = across.repartition("a", "b", "x", "y").sortWithinPartitions("a", "b", "x", "y")
        more = more.unionByName(across.mapInArrow(lambda it, nearest=nearest: _across(it, percent, nearest), "a long, b long, d long"))
        if nearest:
            both = more.unionByName(more.select(F.col("b").alias("a"), F.col("a").alias("b"), "d")).groupBy("a", "b").agg(F.min("d").alias("d"))
            more = both.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy("d", "b"))).where(F.col("k") <= NEAREST)
        more = checkpointed(of_classes(more.select("a", "b")).join(tested, ["a", "b"], "left_anti"))
        if more.isEmpty():
            continue
            tested = tested.unionByName(more)
        links = checkpointed(links.unionByName(_links(more, known, percent, width, keys)))
        labels = checkpointed(components(links))
        few_labels = labels.count() <= MAX_BROADCAST_IDS
    out = rows.join(labels, "id", "left")
    return out.select("id", F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component"))


def _unique(rows: DataFrame) -> bool:
    return rows.where("id IS NOT NULL").groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _members(lists: DataFrame) -> DataFrame:
    """a, b, id, n: a row for each document of each list."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, blob in enumerate(batch.column(2)):
                raw = blob.as_py()
                g = len(raw) // 12
                a, b = (pa.array(np.repeat(batch.column(k)[i].as_py(), g), pa.int64()) for k in (0, 1))
                yield pa.RecordBatch.from_arrays([a, b, pa.array(np.frombuffer(raw, np.int64, g)), pa.array(np.frombuffer(raw, np.int32, g, 8 * g), pa.int64())], names=["a", "b", "id", "n"])

    return lists.select("a", "b", "members").mapInArrow(each, "a long, b long, id long, n long")


def _blocks(own: DataFrame) -> DataFrame:
    """own(a, b, id, n, label) with x, y: which comparisons of its list a member takes part in.

    Lists of up to BLOCK members are compared in one. In others the members of the most frequent label are cut into
    chunks y and the rest into blocks x; each chunk meets each block, and each block each other one (as y below 0).
    """
    each = own.groupBy("a", "b", "label").agg(F.count("*").alias("c"))
    long = each.groupBy("a", "b").agg(F.sum("c").alias("total"), F.max(F.struct("c", "label")).alias("top")).where(F.col("total") > BLOCK)
    parts = lambda c: F.greatest(F.ceil(c / BLOCK), F.lit(1)).cast("int")
    long = long.select("a", "b", F.col("top.label").alias("main"), parts(F.col("top.c")).alias("chunks"), parts(F.col("total") - F.col("top.c")).alias("blocks"))
    out = own.join(long, ["a", "b"], "left")
    spot = lambda n: F.pmod(F.xxhash64("id", F.lit(7)), n).cast("int")
    cell = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    block = spot(F.col("blocks"))
    of_rest = F.concat(F.transform(upto(F.col("chunks")), lambda y: cell(block, y)), F.transform(upto(F.col("blocks")), lambda j: cell(F.least(block, j), -1 - F.greatest(block, j))))
    of_main = F.transform(upto(F.col("blocks")), lambda x: cell(x, spot(F.col("chunks"))))
    cells = F.when(F.col("main").isNull(), F.array(cell(F.lit(0), F.lit(0)))).when(F.col("label") == F.col("main"), of_main).otherwise(of_rest)
    return out.withColumn("cell", F.explode(cells)).select("a", "b", "cell.x", "cell.y", "label", "id", "n")


def first_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One row of each group of rows that are linked over any number of links: that with the least id, null ids last.

    Rows with one id are rows each, and one of them is left if id and text are the same. Rows without a set have no links.
    """
    if not docs.groupBy(F.col(doc_id).cast("long").alias("id")).agg(F.count("*").alias("n")).where("id IS NULL OR n > 1").isEmpty():
        return _first_rows(docs, doc_id, text, **how)
    name = private_name(docs, "later_id")
    later = checkpointed(join(docs, doc_id, text, **how).where("id > component").select(F.col("id").alias(name)).distinct())
    if later.count() <= MAX_BROADCAST_IDS:
        later = F.broadcast(later)
    return docs.join(later, docs[doc_id] == later[name], "left_anti")


def _first_rows(docs: DataFrame, doc_id: str, text: str, **how) -> DataFrame:
    """first_of_each() where ids are null or come again: rows are told apart by a 64-bit hash of id and text."""
    key = private_name(docs, "row_key")
    number, blank = F.col(doc_id).cast("long"), ~F.coalesce(F.col(text).cast("string").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    rows = docs.withColumn(key, F.xxhash64(number, F.col(text).cast("string")))
    again = checkpointed(rows.where(number.isNotNull() | ~blank).groupBy(F.col(key).alias("again")).agg(F.count("*").alias("n")).where("n > 1").select("again"))
    if not again.isEmpty():
        same = rows[key] == again["again"]
        rows = rows.join(again, same, "left_anti").unionByName(rows.join(again, same, "left_semi").dropDuplicates([key]))
    nodes = rows.where(~blank).select(F.col(key).alias("id"), number.alias("number"))
    labels = join(rows.where(~blank), key, text, **how).join(nodes, "id")
    first = F.struct(F.col("number").isNull().alias("none"), "number", "id")
    labels = checkpointed(labels.select("id", "component", first.alias("first")))
    kept = labels.groupBy("component").agg(F.min("first").alias("x")).select("component", F.col("x.id").alias("kept"))
    later = checkpointed(labels.join(kept, "component").where("id <> kept").select(F.col("id").alias("later")))
    return rows.join(later, rows[key] == later["later"], "left_anti").drop(key)


def op9_jaccard(spark, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM d WHERE len(w) > 0)),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id) p
  JOIN n AS na ON na.doc_id = a JOIN n AS nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
r AS (SELECT a AS id, a AS root FROM l UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.root, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN (SELECT id, min(root) AS root FROM r GROUP BY id) m ON m.id = d.doc_id
"""
