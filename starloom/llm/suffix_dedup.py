"""Passages that repeat across documents, by bucket-pointer refinement of text positions.

A window is a run of LENGTH bytes. Two windows are equal only if they hold the same anchor at the same place: the GRAM-byte run
with the least hash in them. Anchors deal the windows into initial buckets that can be sorted apart from each other. Inside a
bucket every position gets the rank of its first 25 bytes as bucket pointer; buckets are then refined by sorting on the pointers of a
later offset (25, then 50 bytes on), each round reusing the pointers that the round before it has set. Windows that are alone in a
bucket drop out.

First each shard of a task refines its own texts, so that of what it holds many times one is left to compare with other shards.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import _BASE, _BYTE, BROADCAST_KEYS, WordHasher, blocks, byte_slices, mix, partitions, staged

#: Bytes of a passage; bytes of an anchor.
LENGTH, GRAM = 100, 32
#: Bytes of text in a shard, and at most in each bucket's share of all text; bytes of one piece of a long text that is searched for anchors.
SHARD_BYTES, BUCKET_BYTES, PIECE = 4 << 20, 16 << 20, 4 << 20
#: Occurrences of one anchor that are compared in one task; windows of commoner anchors are dealt out by their own hashes.
HOT = 20_000
#: Bytes of contexts that are refined at once.
CHUNK = 4 << 20

_PLACE = np.uint64((1 << 24) - 1)
_ENTRY = np.dtype([("a", "<i4"), ("l", "u1"), ("r", "u1"), ("hot", "u1")])
_RUN = np.dtype([("s1", "<i4"), ("s2", "<i4")])
_KEY = np.dtype([("d1", "<i8"), ("d2", "<i4")])
_DOC = np.dtype([("nul", "u1"), ("id", "<i8"), ("d1", "<i8"), ("d2", "<i4")])


def spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of n[0] numbers, then those of start[1] and so on."""
    ends = np.cumsum(n)
    return np.repeat(start - ends + n, n) + np.arange(int(ends[-1]) if len(ends) else 0)


def _grams(data: np.ndarray, at: np.ndarray, n: int, hasher: WordHasher) -> np.ndarray:
    """Hashes of n bytes at some places."""
    hasher._grow(n + 1)
    out = np.empty(len(at), dtype=np.uint64)
    for i in range(0, len(at), 20_000):
        out[i : i + 20_000] = (_BYTE[data[at[i : i + 20_000, None] + np.arange(n)]] * hasher.power[:n]).sum(axis=1)
    return mix(out + np.uint64(n))


def anchors(texts: list[bytes], hasher: WordHasher):
    """(text, place, first window, last window, hash) of every anchor of some texts, places in their text."""
    pieces = [(k, at, t[at : at + PIECE + LENGTH - 1]) for k, t in enumerate(texts) for at in range(0, max(1, len(t) - LENGTH + 1), PIECE)]
    out = []
    for i, j in blocks([p[2] for p in pieces], 1 << 20):
        data = np.frombuffer(b"".join(p[2] for p in pieces[i:j]), dtype=np.uint8)
        if len(data) < LENGTH:
            continue
        ends = np.cumsum([len(p[2]) for p in pieces[i:j]])
        hasher._grow(len(data) + 1)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * hasher.power[: len(data)], out=total[1:])
        h = mix((total[GRAM:] - total[:-GRAM]) * hasher.back[: len(data) - GRAM + 1] + np.uint64(GRAM))
        least = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)  # of equal hashes the first
        width, want = 1, LENGTH - GRAM + 1
        while 2 * width <= want:
            least, width = np.minimum(least[:-width], least[width:]), 2 * width
        if width < want:
            least = np.minimum(least[: len(least) - (want - width)], least[want - width :])
        inside = np.zeros(len(data) + 1, dtype=np.int8)
        starts = ends - [len(p[2]) for p in pieces[i:j]]
        some = ends - starts >= LENGTH
        inside[starts[some]] += 1
        np.subtract.at(inside, ends[some] - LENGTH + 1, 1)
        s = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(least)])
        if not len(s):
            continue
        a = (least[s] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], a[1:] != a[:-1])))
        last = np.append(first[1:], len(a)) - 1
        who = np.searchsorted(ends, s[first], side="right")
        base = np.array([p[1] for p in pieces[i:j]])[who] - starts[who]
        out.append((np.array([p[0] for p in pieces[i:j]])[who], a[first] + base, s[first] + base, s[last] + base, h[a[first]]))
    if not out:
        return [np.zeros(0, np.int64)] * 4 + [np.zeros(0, np.uint64)]
    return [np.concatenate(x) for x in zip(*out)]


def _pointers(key: np.ndarray, at: np.ndarray, pointer: np.ndarray) -> np.ndarray:
    """Sets the bucket pointers of places by sorting their keys; whether each shares its bucket."""
    order = np.argsort(key)
    k = key[order]
    new = np.ones(len(k), dtype=bool)
    new[1:] = k[1:] != k[:-1]
    number = np.cumsum(new, dtype=np.int32) - 1
    pointer[at[order]] = number
    shared = np.empty(len(k), dtype=bool)
    shared[order] = (np.diff(np.append(np.flatnonzero(new), len(k))) > 1)[number]
    return shared


def refine(data: np.ndarray, starts: np.ndarray, hasher: WordHasher, length: int = LENGTH) -> np.ndarray:
    """The bucket of each window of data at starts (which may repeat): equal windows are in one bucket. Windows that were alone
    in a bucket before the last round have a negative one."""
    q = -(-length // 4)
    far = length - 2 * q
    bucket = -1 - np.arange(len(starts))
    if not len(starts):
        return bucket
    pointer, mask = np.zeros(len(data) + 1, dtype=np.int32), np.zeros(len(data) + 1, dtype=bool)

    def places(*offsets: int) -> np.ndarray:
        mask[:] = False
        for k in offsets:
            mask[starts[live] + k] = True
        return np.flatnonzero(mask)

    def alone(at: np.ndarray, shared: np.ndarray, *offsets: int) -> np.ndarray:
        mask[at] = shared
        out = np.ones(len(live), dtype=bool)
        for k in offsets:
            out &= mask[starts[live] + k]
        return live[out]

    live = np.arange(len(starts))
    at = places(0, q, far, far + q)
    live = alone(at, _pointers(_windows(data, at, q, hasher), at, pointer), 0, q, far, far + q)
    at = places(0, far)
    live = alone(at, _pointers((pointer[at].astype(np.uint64) << np.uint64(32)) | pointer[at + q].astype(np.uint64), at, pointer), 0, far)
    at = places(0)
    _pointers((pointer[at].astype(np.uint64) << np.uint64(32)) | pointer[at + far].astype(np.uint64), at, pointer)
    bucket[live] = pointer[starts[live]]
    return bucket


def _windows(data: np.ndarray, at: np.ndarray, n: int, hasher: WordHasher) -> np.ndarray:
    """Hashes of n bytes at sorted places, from sums over blocks of data."""
    out, block = np.empty(len(at), dtype=np.uint64), 1 << 20
    hasher._grow(block + n + 1)
    edge = np.searchsorted(at, np.arange(0, len(data) + block, block))
    for k, (lo, hi) in enumerate(zip(edge, edge[1:])):
        if lo == hi:
            continue
        part = data[k * block : (k + 1) * block + n]
        total = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[part] * hasher.power[: len(part)], out=total[1:])
        i = at[lo:hi] - k * block
        out[lo:hi] = mix((total[i + n] - total[i]) * hasher.back[i] + np.uint64(n))
    return out


def _same(data: np.ndarray, begin: np.ndarray, size: np.ndarray, left: np.ndarray, hasher: WordHasher) -> np.ndarray:
    """Numbers that are equal for contexts with the same bytes and the same place of the anchor."""
    hasher._grow(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * hasher.power[: len(data)], out=total[1:])
    h = mix(mix((total[begin + size] - total[begin]) * hasher.back[begin] + size.astype(np.uint64)) + left.astype(np.uint64))
    return (h >> np.uint64(1)).view(np.int64)


def repeated(bucket: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Whether a window's bucket has one that comes earlier; windows of one place (a row twice) are no repeats of each other."""
    out = np.zeros(len(bucket), dtype=bool)
    some = np.flatnonzero(bucket >= 0)
    by = some[np.argsort(bucket[some])]
    b, o = bucket[by], order[by]
    if len(b):
        first = np.flatnonzero(np.concatenate(([True], b[1:] != b[:-1])))
        out[by] = o != np.repeat(np.minimum.reduceat(o, first), np.diff(np.append(first, len(b))))
    return out


def _runs(who: np.ndarray, starts: np.ndarray):
    """(who, first, last) of maximal runs of neighbouring starts of one document."""
    by = np.lexsort((starts, who))
    w, s = who[by], starts[by]
    new = np.ones(len(w), dtype=bool)
    new[1:] = (w[1:] != w[:-1]) | (s[1:] > s[:-1] + 1)
    first = np.flatnonzero(new)
    return w[first], s[first], s[np.append(first[1:], len(w)) - 1] if len(w) else s


def _ranks(docs: np.ndarray):
    """The rank of each document (null ids last), and the distinct ones in order."""
    by = np.lexsort((docs["d2"], docs["d1"], docs["id"], docs["nul"]))
    d = docs[by]
    new = np.ones(len(d), dtype=bool)
    new[1:] = d[1:] != d[:-1]
    rank = np.empty(len(d), dtype=np.int64)
    rank[by] = np.cumsum(new) - 1
    return rank, d[new]


def _documents(batch) -> np.ndarray:
    ids = batch.column("doc_id")
    docs = np.zeros(batch.num_rows, dtype=_DOC)
    docs["nul"], docs["id"] = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(zero_copy_only=False)
    docs["d1"], docs["d2"] = batch.column("d1").to_numpy(), batch.column("d2").to_numpy()
    return docs


def _texts(batch) -> list[bytes]:
    return [t.encode() for t in batch.column("text").to_pylist()]


def _packed(bucket: np.ndarray, docs: np.ndarray, who: np.ndarray, *columns: np.ndarray):
    """(bucket, payload) of rows dealt into buckets: the documents of each, and the columns."""
    by = np.argsort(bucket, kind="stable")
    edge = np.flatnonzero(np.diff(bucket[by], prepend=-1)).tolist()
    for lo, hi in zip(edge, [*edge[1:], len(by)]):
        some = by[lo:hi]
        named, of = np.unique(who[some], return_inverse=True)
        yield int(bucket[some[0]]), b"".join(x.tobytes() for x in (np.array([len(named), hi - lo], np.uint32), docs[named], of.astype(np.uint32), *(c[some] for c in columns)))


def _unpacked(blobs: list[bytes], kind: np.dtype, *columns: np.dtype, tail: bool = False):
    """The documents, their number for each row, and the columns of payloads, with all that follows them if tail is set."""
    docs, who, out, tails, n = [], [], [[] for _ in columns], [], 0
    for b in blobs:
        n_docs, rows = np.frombuffer(b, np.uint32, 2).tolist()
        at = 8
        docs.append(np.frombuffer(b, kind, n_docs, at))
        at += n_docs * kind.itemsize
        who.append(np.frombuffer(b, np.uint32, rows, at).astype(np.int64) + n)
        at += 4 * rows
        for c, dtype in zip(out, columns):
            c.append(np.frombuffer(b, dtype, rows, at))
            at += rows * np.dtype(dtype).itemsize
        tails.append(np.frombuffer(b, np.uint8, len(b) - at, at) if tail else None)
        n += n_docs
    return np.concatenate(docs), np.concatenate(who), [np.concatenate(c) for c in out], np.concatenate(tails) if tail else None


_DEALT = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary())])
_ENTRIES, _RUNS, _WINDOWS = 0, 1, 2


def _dealt(kind: int, rows):
    rows = list(rows)
    for i in range(0, len(rows), 256):
        some = rows[i : i + 256]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in some], pa.int32()), pa.array([kind] * len(some), pa.int32()), pa.array([r[1] for r in some], pa.binary())], schema=_DEALT)


def _bucket(h: np.ndarray, n: int) -> np.ndarray:
    """The bucket of each hash, mixed once more: those of anchors are small, as each is the least of many."""
    return (((mix(h + _BASE) >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _find(n_buckets: int):
    """Anchors of each shard's texts, after the shard has refined those that it has several times."""

    def run(batches):
        hasher = WordHasher()
        for part in byte_slices(batches, "text", SHARD_BYTES):
            docs, texts = _documents(part), _texts(part)
            who, a, s1, s2, h = anchors(texts, hasher)
            if not len(a):
                continue
            key = docs[["d1", "d2"]].astype(_KEY)
            _, same, times = np.unique(h, return_inverse=True, return_counts=True)
            twice = np.flatnonzero(times[same] > 1)
            if len(twice):
                data, base = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
                n = s2[twice] - s1[twice] + 1
                entry, starts, rank = np.repeat(twice, n), spread(s1[twice], n), _ranks(docs)[0]
                gone = repeated(refine(data, starts + base[who[entry]], hasher), (rank[who[entry]] << 32) | starts)
                w, f, l = _runs(who[entry[gone]], starts[gone])
                yield from _dealt(_RUNS, _packed(key["d1"][w] % n_buckets, key, w, f.astype(np.int32), l.astype(np.int32)))
                left, at = entry[~gone], starts[~gone]  # entries are sorted, and so are their starts
                first = np.flatnonzero(np.diff(left, prepend=-1))
                keep = np.ones(len(a), dtype=bool)
                keep[twice] = False
                keep[left[first]] = True
                s1[left[first]], s2[left[first]] = at[first], at[np.append(first[1:], len(left)) - 1] if len(first) else at
                who, a, s1, s2, h = who[keep], a[keep], s1[keep], s2[keep], h[keep]
            entries = np.zeros(len(a), dtype=_ENTRY)
            entries["a"], entries["l"], entries["r"] = a, a - s1, a - s2
            yield from _dealt(_ENTRIES, _packed(_bucket(h, n_buckets), key, who, h, entries))

    return run


def _by_document(keys: np.ndarray, who: np.ndarray, values: np.ndarray):
    """Distinct keys that have values, and an arrow array of each one's values as bytes."""
    by = np.argsort(who, kind="stable")
    w, v = who[by], values[by]
    edge = np.flatnonzero(np.diff(w, prepend=-1))
    ends = np.append(edge, len(w)).astype(np.int32) * values.dtype.itemsize
    return keys[w[edge]], pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(v.tobytes())])


_LISTS = pa.schema([("d1", pa.int64()), ("d2", pa.int32()), ("entries", pa.binary()), ("runs", pa.binary())])


def _listed(keys: np.ndarray, who: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row for each document with its entries or its runs."""
    k, lists = _by_document(keys, who, values)
    none = pa.nulls(len(k), pa.binary())
    pair = [lists, none] if values.dtype == _ENTRY else [none, lists]
    return pa.Table.from_arrays([pa.array(np.ascontiguousarray(k["d1"])), pa.array(np.ascontiguousarray(k["d2"])), *pair], schema=_LISTS)


def _kinds(blobs) -> dict[int, list[bytes]]:
    held: dict[int, list[bytes]] = {}
    for k, p in zip(blobs.column("kind").to_pylist(), blobs.column("payload").to_pylist()):
        held.setdefault(k, []).append(p)
    return held


def _passed(blobs: list[bytes]) -> pa.Table:
    keys, who, (s1, s2), _ = _unpacked(blobs, _KEY, np.dtype("<i4"), np.dtype("<i4"))
    runs = np.empty(len(s1), dtype=_RUN)
    runs["s1"], runs["s2"] = s1, s2
    return _listed(keys, who, runs)


def _common(blobs):
    """The entries of a bucket whose anchor occurs again, by document; those of very common ones are marked."""
    out, held = [_LISTS.empty_table()], _kinds(blobs)
    if _RUNS in held:
        out.append(_passed(held[_RUNS]))
    if _ENTRIES in held:
        keys, who, (h, entries), _ = _unpacked(held[_ENTRIES], _KEY, np.dtype("<u8"), _ENTRY)
        _, same, times = np.unique(h, return_inverse=True, return_counts=True)
        times = times[same]
        entries["hot"] = times > HOT
        out.append(_listed(keys, who[times > 1], entries[times > 1]))
    return pa.concat_tables(out)


def _contexts(n_buckets: int):
    """What is around the listed anchors of each document, dealt by anchor; windows of hot anchors, dealt by their hashes."""

    def run(batches):
        hasher = WordHasher()
        for part in byte_slices(batches, "text", SHARD_BYTES):
            docs, texts = _documents(part), _texts(part)
            key = docs[["d1", "d2"]].astype(_KEY)
            done = [np.frombuffer(b"".join(x), dtype=_RUN) for x in part.column("runs").to_pylist()]
            runs, of = np.concatenate(done), np.repeat(np.arange(len(docs)), [len(x) for x in done])
            if len(runs):
                yield from _dealt(_RUNS, _packed(key["d1"][of] % n_buckets, key, of, np.ascontiguousarray(runs["s1"]), np.ascontiguousarray(runs["s2"])))
            listed = [np.frombuffer(b"".join(x), dtype=_ENTRY) for x in part.column("entries").to_pylist()]
            e, who = np.concatenate(listed), np.repeat(np.arange(len(docs)), [len(x) for x in listed])
            if not len(e):
                continue
            data, base = np.frombuffer(b"".join(texts), dtype=np.uint8), np.cumsum([0, *map(len, texts)])
            hot = e["hot"] > 0
            cool, of = e[~hot], who[~hot]
            if len(cool):
                yield from _dealt(_ENTRIES, _with_contexts(_bucket(_grams(data, cool["a"] + base[of], GRAM, hasher), n_buckets), docs, of, cool, data, base))
            if hot.any():
                e, who = e[hot], who[hot]
                n = e["l"].astype(np.int64) - e["r"] + 1
                starts, of = spread(e["a"].astype(np.int64) - e["l"], n), np.repeat(who, n)
                half = [_grams(data, starts + base[of] + k, LENGTH // 2, hasher) for k in (0, LENGTH - LENGTH // 2)]
                yield from _dealt(_WINDOWS, _packed(_bucket(mix(half[0] + half[1] * np.uint64(3)), n_buckets), docs, of, starts.astype(np.int32), *half))

    return run


def _with_contexts(bucket, docs, who, e, data, base):
    order = np.argsort(bucket, kind="stable")
    bucket, who, e = bucket[order], who[order], e[order]
    size, start = e["l"].astype(np.int64) - e["r"] + LENGTH, e["a"] - e["l"].astype(np.int64) + base[who]
    edge = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
    packed = _packed(bucket, docs, who, e)
    for lo, hi in zip(edge, [*edge[1:], len(bucket)]):
        number, head = next(packed)
        yield number, head + data[spread(start[lo:hi], size[lo:hi])].tobytes()


def _refined(blobs):
    """Runs of windows that occur earlier, by document."""
    out, held, hasher = [_LISTS.empty_table()], _kinds(blobs), WordHasher()

    def found(docs, who, starts):
        w, f, l = _runs(who, starts)
        runs = np.empty(len(w), dtype=_RUN)
        runs["s1"], runs["s2"] = f, l
        out.append(_listed(docs, w, runs))

    if _RUNS in held:
        out.append(_passed(held[_RUNS]))
    if _WINDOWS in held:
        docs, who, (starts, one, two), _ = _unpacked(held[_WINDOWS], _DOC, np.dtype("<i4"), np.dtype("<u8"), np.dtype("<u8"))
        rank, docs = _ranks(docs)
        who = rank[who]
        by = np.lexsort((two, one))
        bucket = np.empty(len(by), dtype=np.int64)
        bucket[by] = np.cumsum(np.concatenate(([True], (one[by[1:]] != one[by[:-1]]) | (two[by[1:]] != two[by[:-1]]))))
        gone = repeated(bucket, (who << 32) | starts)
        found(docs, who[gone], starts[gone].astype(np.int64))
    if _ENTRIES in held:
        docs, who, (e,), data = _unpacked(held[_ENTRIES], _DOC, _ENTRY, tail=True)
        rank, docs = _ranks(docs)
        who = rank[who]
        size = e["l"].astype(np.int64) - e["r"] + LENGTH
        at = np.cumsum(size) - size
        h = _grams(data, at + e["l"], GRAM, hasher)
        order = np.argsort(h, kind="stable")
        edge = np.flatnonzero(np.concatenate(([True], h[order[1:]] != h[order[:-1]])))
        until = np.cumsum(size[order])
        lo = 0
        while lo < len(order):  # whole buckets, about CHUNK bytes of them at once
            reach = np.searchsorted(until, (until[lo - 1] if lo else 0) + CHUNK)
            k = np.searchsorted(edge, max(reach, lo + 1))
            hi = int(edge[k]) if k < len(edge) else len(order)
            some = order[lo:hi]
            first, run = e["a"][some].astype(np.int64) - e["l"][some], e["l"][some].astype(np.int64) - e["r"][some]
            text, begin = data[spread(at[some], size[some])], np.cumsum(size[some]) - size[some]
            copies = repeated(_same(text, begin, size[some], e["l"][some], hasher), (who[some] << 32) | first)
            runs = np.empty(int(copies.sum()), dtype=_RUN)  # contexts that are equal as a whole: the earliest stands for them
            runs["s1"], runs["s2"] = first[copies], (first + run)[copies]
            out.append(_listed(docs, who[some[copies]], runs))
            group = np.searchsorted(edge, np.arange(lo, hi), side="right")
            left = np.bincount(group[~copies], minlength=int(group[-1]) + 1)[group] > 1
            rest = np.flatnonzero(~copies & left)
            n = run[rest] + 1
            offset = spread(np.zeros(len(rest), np.int64), n)
            starts, of = np.repeat(first[rest], n) + offset, np.repeat(who[some[rest]], n)
            gone = repeated(refine(text, np.repeat(begin[rest], n) + offset, hasher), (of << 32) | starts)
            found(docs, of[gone], starts[gone])
            lo = hi
    return pa.concat_tables(out)


_CUT = pa.schema([("doc_id", pa.int64()), ("d1", pa.int64()), ("d2", pa.int32()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def spans_of(runs: np.ndarray) -> list[tuple[int, int]]:
    """The bytes that runs of windows cover, as maximal spans."""
    runs = np.sort(runs, order=["s1", "s2"])
    spans: list[tuple[int, int]] = []
    for a, b in zip(runs["s1"].tolist(), runs["s2"].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b + LENGTH))
        else:
            spans.append((a, b + LENGTH))
    return spans


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(x[1] for x in spans)], [*(x[0] for x in spans), len(text)]))


def _cut(batches):
    for part in byte_slices(batches, "text", SHARD_BYTES):
        sizes, removed, n_spans, shas = [], [], [], []
        for text, runs in zip(_texts(part), part.column("runs").to_pylist()):
            spans = spans_of(np.frombuffer(b"".join(runs), dtype=_RUN)) if runs else []
            sizes.append(len(text))
            removed.append(sum(b - a for a, b in spans))
            n_spans.append(len(spans))
            shas.append(hashlib.sha256(without(text, spans) if spans else text).hexdigest())
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("d1"), part.column("d2"), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(shas, pa.string())], schema=_CUT)


def _spans(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, d1, d2, text) of documents with a window, and the runs (d1, d2, runs) of windows that occur earlier."""
    rows = docs.select("doc_id", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text").alias("d1"), F.hash("text").alias("d2"), "text")
    n = max(partitions(docs.sparkSession), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES))
    dealt, lists = "bucket int, kind int, payload binary", "d1 long, d2 int, entries binary, runs binary"
    named = rows.mapInArrow(_find(n), dealt).repartition(n, "bucket").groupBy("bucket").applyInArrow(_common, lists)
    named = named.groupBy("d1", "d2").agg(F.collect_list("entries").alias("entries"), F.collect_list("runs").alias("runs"))
    around = rows.join(named, ["d1", "d2"]).select("doc_id", "d1", "d2", "text", "entries", "runs")
    runs = around.mapInArrow(_contexts(n), dealt).repartition(n, "bucket").groupBy("bucket").applyInArrow(_refined, lists)
    return rows, runs.groupBy("d1", "d2").agg(F.collect_list("runs").alias("runs"))


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: its id, n_bytes, n_removed, n_spans, kept_sha256, after the removal of each byte that a
    passage of LENGTH bytes covers which starts earlier too: in a document with a smaller id, or before in the same one.

    Null texts are empty. Null ids come last; different texts of one id are ordered by their hashes; of rows equal in id and text one is the
    first, and the others are repeats of it. Texts shorter than a passage stay whole. Overlaps of a passage with itself count.
    Other columns are not read. An empty table gives no rows.

    The texts are shuffled once, for both joins with what was found; anchors (about one for 35 bytes) travel as packed numbers, and
    only those that occur again come with the bytes around them. Anchors that over HOT places share in different
    surroundings are not compared in one task: their windows are dealt out by two hashes of half a window each. Exact up to
    such 64-bit hashes for the initial buckets, which texts of all tables that fit on disks hardly exhaust.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"))
    long = F.octet_length("text") >= LENGTH
    rows, runs = _spans(docs.where(long))
    cut = rows.join(runs, ["d1", "d2"], "left").select("doc_id", "d1", "d2", "text", "runs").mapInArrow(_cut, "doc_id long, d1 long, d2 int, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    cut = staged(cut.withColumn("row", F.monotonically_increasing_id()), "cut")

    twice = cut.groupBy(F.col("d1").alias("e1"), F.col("d2").alias("e2")).agg(F.count("*").alias("n"), F.min("row").alias("first")).where("n > 1").drop("n")
    twice = F.broadcast(twice) if twice.count() <= BROADCAST_KEYS else twice
    again = F.col("first").isNotNull() & (F.col("row") != F.col("first"))
    whole = cut.join(twice, (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")), "left")
    whole = whole.select(
        "doc_id", "n_bytes", F.when(again, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(again, F.lit(1).cast("long")).otherwise(F.col("n_spans")).alias("n_spans"), F.when(again, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
    )
    none = F.lit(0).cast("long")
    short = docs.where(~long).select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), none.alias("n_removed"), none.alias("n_spans"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))
    return whole.unionByName(short).select(F.col("doc_id").alias(id_col), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def repeats_sql(documents: str = "documents") -> str:
    """repeats of documents with distinct ids, as DuckDB SQL: every window of every text, byte by byte in hex."""
    n = 2 * LENGTH
    return f"""
WITH d AS (SELECT doc_id, lower(hex(encode(COALESCE(text, '')))) AS x FROM {documents}),
w AS (SELECT doc_id, i, substr(x, 2 * i + 1, {n}) AS win FROM (SELECT doc_id, x, unnest(range(0, len(x) // 2 - {LENGTH - 1})) AS i FROM d WHERE len(x) >= {n})),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
runs AS (SELECT doc_id, i, i > COALESCE(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1 - {LENGTH}) + {LENGTH} AS new FROM again),
spans AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT doc_id, i, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM runs) GROUP BY doc_id, g),
gaps AS (SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS a, a AS b, b AS ended FROM spans),
cut AS (SELECT doc_id, count(*) AS n_spans, sum(ended - b)::BIGINT AS n_removed, max(ended) AS last, string_agg(substr(x, 2 * a + 1, 2 * (b - a)), '' ORDER BY a) AS head FROM gaps JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, COALESCE(n_removed, 0)::BIGINT AS n_removed, COALESCE(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(CASE WHEN n_spans IS NULL THEN x ELSE head || substr(x, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN cut USING (doc_id)"""
