"""Exact Jaccard similarity join of documents on word shingles: a size-aware heavy-light join.

Small (light) sets enumerate subsets of the fixed size that a partner must share; large (heavy) sets
are found by scanning inverted lists. The boundary is the size up to which enumeration costs less.

How it runs:

1. Every text is hashed to its shingle set. The set's own hash names the class of documents with equal
   sets, so copies travel on as one class.
2. Fingerprints are dealt to buckets by hash, each with the place of its class in a block of about 1,000,000 fingerprints. A
   bucket returns to the blocks those that two classes or more hold, with the number of blocks' classes that hold them, one
   order for all. The rest cannot be shared. What travels for a fingerprint is 4 bytes and less than one for its class,
   in whatever number of buckets.
3. For each class the rarest fingerprints form the prefix that a partner has to meet; only shared ones
   become postings of the inverted lists. Light classes post subsets instead.
4. Round one compares each member of a list with the list's leader only. Round two compares what is
   still in different components. Size and position bounds cut pairs, and every pair left is
   verified on whole sets, so components are exact while a group of m near copies costs about m pairs.

A bucket has about BUCKET_SHINGLES entries and a block 1,000,000 (or one text's) whatever the input's size, but for a shingle that
a large share of all documents has: each class with it is an entry of about 5 bytes of one bucket. What a step wrote is removed
when the next ones have read it.
"""

from __future__ import annotations

import zlib
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import WordHasher, blocks, dropped, mix, partitions, semi_join, shingles, sliced, small_batches, staged
from starloom.llm.components import components

#: Shingles that one bucket holds at about, and a text's characters for one shingle.
BUCKET_SHINGLES, CHARS_PER_SHINGLE = 1_600_000, 6
#: Cost of scanning an inverted list, in subsets enumerated; sizes over MOST_LIGHT are never light.
SCAN_COST, MOST_LIGHT = 8, 16


def required(a, b, pct: int):
    """Smallest overlap of sets of sizes a and b whose Jaccard similarity is pct % or more."""
    return -(-(pct * (a + b)) // (100 + pct))


def subset_sizes(n: int, pct: int) -> list[int]:
    """Overlaps that partners of any possible size need from a set of n."""
    return sorted({t for m in range(-(-pct * n // 100), 100 * n // pct + 1) if (t := required(n, m, pct)) <= min(n, m)})


def light_boundary(sizes: dict[int, int], pct: int) -> int:
    """The size up to which enumerating subsets costs less than scanning lists, given counts of sizes."""
    best, at, cost = 0, 0, 0
    for n in range(1, MOST_LIGHT + 1):
        cost += sizes.get(n, 0) * (sum(comb(n, t) for t in subset_sizes(n, pct)) - SCAN_COST * (n - required(n, -(-pct * n // 100), pct) + 1))
        if cost < best:
            best, at = cost, n
    return max(at, 1)


def text_sets(texts: list[bytes], width: int, hasher: WordHasher):
    """The sorted shingle set of each text."""
    for i, j in blocks(texts, 250_000):  # numbers of 8 bytes for each byte of them
        words, counts = hasher(texts[i:j])
        at = 0
        for c in counts:
            yield np.unique(shingles(words[at : at + c], width))
            at += c


def _key(s: np.ndarray) -> int:
    """64 bits that stand for a whole set."""
    if not len(s):
        return 0
    i = np.arange(1, len(s) + 1, dtype=np.uint64)
    return int(mix(np.array([np.bitwise_xor.reduce(mix(s + i)) + np.uint64(len(s)) * np.uint64(zlib.crc32(s.tobytes()) | 1)], dtype=np.uint64))[0]) or 1


def _encoded(fp: np.ndarray, *columns: np.ndarray) -> bytes:
    """Fingerprints as they are, and columns of small numbers, compressed byte by byte of the numbers."""
    planes = b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return np.uint32(len(fp)).tobytes() + fp.tobytes() + zlib.compress(planes, 1)


def _decoded(payload) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints, and a row for each column of numbers."""
    k = int(np.frombuffer(payload, np.uint32, 1)[0])
    planes = np.frombuffer(zlib.decompress(memoryview(payload)[4 + 4 * k :]), np.uint8).reshape(-1, 4, k)
    return np.frombuffer(payload, np.uint32, k, 4), np.ascontiguousarray(planes.transpose(0, 2, 1)).view("<u4")[..., 0]


_CLASS = np.dtype([("key", "<u8"), ("n", "<u4")])
_ENTRY = np.dtype([("key", "<u8"), ("n", "<u4"), ("fp", "<u4"), ("bucket", "<u4"), ("df", "<u4")])


class _Outbox:
    """Collects the sets of many documents as a block of classes, then yields the block's list of classes and a packed row for
    each bucket. A fingerprint's class is its place in the list, so that what a row takes hardly grows with the number of buckets."""

    def __init__(self, buckets: int, block: int) -> None:
        self.buckets, self.block, self.keys, self.sets, self.size = buckets, block, [], [], 0

    def add(self, s: np.ndarray) -> None:
        self.keys.append(_key(s))
        self.sets.append(s)
        self.size += len(s) + 20

    def rows(self):
        if not self.keys:
            return
        keys, first = np.unique(np.array(self.keys, dtype=np.uint64), return_index=True)
        ns = np.array([len(self.sets[i]) for i in first], dtype=np.uint32)
        listed = np.empty(len(keys), dtype=_CLASS)
        listed["key"], listed["n"] = keys, ns
        yield self.block % self.buckets, self.block, listed.tobytes(), None
        everything = np.concatenate([self.sets[i] for i in first])
        owner = np.repeat(np.arange(len(first), dtype=np.uint32), ns)
        bucket = ((everything >> np.uint64(32)) % np.uint64(self.buckets)).astype(np.uint16 if self.buckets < 65536 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        fp, owner, bucket = (everything & np.uint64(0xFFFFFFFF)).astype(np.uint32)[order], owner[order], bucket[order]
        edges = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        for lo, hi in zip(edges, [*edges[1:], len(bucket)]):
            yield int(bucket[lo]), self.block, None, _encoded(fp[lo:hi], np.diff(owner[lo:hi], prepend=np.uint32(0)))
        self.__init__(self.buckets, self.block + 1)


_PACKED = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("classes", pa.binary()), ("payload", pa.binary())])


def _pack(width: int, buckets: int):
    def run(batches):
        hasher, box = WordHasher(), _Outbox(buckets, TaskContext.get().partitionId() << 32)
        for batch in sliced(batches):
            named = batch.filter(batch.column(0).is_valid())  # rows without an id link with nothing
            for s in text_sets([x or b"" for x in named.column(1).to_pylist()], width, hasher):
                if len(s):
                    box.add(s)
                if box.size > 1_000_000:
                    yield from _batches(box)
        yield from _batches(box)

    return run


def _batches(box: _Outbox):
    rows = list(box.rows())
    for i in range(0, len(rows), 64):
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows[i : i + 64]), _PACKED)], schema=_PACKED)


def _keyed(width: int):
    """Each row's id, class and number of shingles."""

    def run(batches):
        hasher = WordHasher()
        for batch in sliced(batches):
            sets = [(_key(s), len(s)) for s in text_sets([x or b"" for x in batch.column(1).to_pylist()], width, hasher)]
            keys, ns = np.array([k for k, _ in sets], dtype=np.uint64).view(np.int64), np.array([n for _, n in sets], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys), pa.array(ns)], names=["id", "key", "n"])

    return run


def _shared_fingerprints(table: pa.Table) -> pa.Table:
    """A bucket's fingerprints that two classes or more hold, packed by their block. A class that several blocks hold counts in
    each, so those of its copies are among them. The blocks' lists of classes are passed on."""
    bucket, listed = table.column("bucket")[0], table.filter(table.column("classes").is_valid())
    sent = table.filter(table.column("payload").is_valid())
    heads = [_decoded(x.as_buffer()) for x in sent.column("payload")]
    edges = np.cumsum([0] + [len(fp) for fp, _ in heads])
    fp = np.concatenate([fp for fp, _ in heads]) if heads else np.zeros(0, np.uint32)
    order = np.argsort(fp)
    ranked = fp[order]
    runs = np.flatnonzero(np.concatenate(([True], ranked[1:] != ranked[:-1]))) if len(fp) else np.zeros(0, np.int64)
    count = np.diff(np.append(runs, len(fp)))
    df = np.empty(len(fp), np.uint32)
    df[order] = np.repeat(count, count)
    del order, ranked
    blocks_, payloads = listed.column("block").to_pylist(), [None] * listed.num_rows
    for block, (own, steps), lo, hi in zip(sent.column("block").to_pylist(), heads, edges, edges[1:]):
        shared = np.flatnonzero(df[lo:hi] > 1)
        if len(shared):
            blocks_.append(block)
            payloads.append(_encoded(own[shared], np.diff(np.cumsum(steps[0], dtype=np.uint32)[shared], prepend=np.uint32(0)), df[lo:hi][shared]))
    classes = listed.column("classes").to_pylist() + [None] * (len(blocks_) - listed.num_rows)
    return pa.table([pa.array(x, type=f.type) for x, f in zip(([bucket.as_py()] * len(blocks_), blocks_, classes, payloads), _PACKED)], schema=_PACKED)


def _light_postings(gram: np.ndarray, key: np.ndarray, n: np.ndarray, start: np.ndarray, held: np.ndarray, pct: int, boundary: int) -> list[tuple]:
    """The subsets that light classes post, for all classes of one size at once."""
    out = []
    light = n[start] <= boundary
    for size, h in {*zip(n[start[light]].tolist(), held[light].tolist())}:
        lo = start[light & (n[start] == size) & (held == h)]
        for t in subset_sizes(size, pct):
            chosen = np.array(list(combinations(range(h), t)), dtype=np.int64).reshape(-1, t)
            step = max(1, 2_000_000 // max(1, chosen.size))
            for i in range(0, len(lo) if len(chosen) else 0, step):
                at = lo[i : i + step]
                grams = np.sort(gram[at[:, None] + np.arange(h)], axis=1)
                made = mix(np.bitwise_xor.reduce(mix(grams[:, chosen] + np.uint64(t)), axis=2)).ravel()
                k = len(made)
                out.append((made.view(np.int64), np.repeat(key[at].view(np.int64), len(chosen)), np.full(k, size), np.zeros(k, np.int64), np.full(k, t)))
    return out


def _postings(pct: int, boundary: int):
    """What each class of a block posts: its prefix's shared fingerprints, or subsets if it is light."""
    schema = pa.schema([("gram", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("need", pa.int32())])

    def run(table: pa.Table) -> pa.Table:
        listed = np.frombuffer(table.filter(table.column("classes").is_valid()).column("classes")[0].as_buffer(), _CLASS)
        sent = table.filter(table.column("payload").is_valid())
        heads = [_decoded(x.as_buffer()) for x in sent.column("payload")]
        e = np.empty(sum(len(fp) for fp, _ in heads), dtype=_ENTRY)
        at = 0
        for bucket, (fp, (steps, df)) in zip(sent.column("bucket").to_pylist(), heads):
            part = e[at : at + len(fp)]
            own = listed[np.cumsum(steps)]
            part["key"], part["n"], part["fp"], part["bucket"], part["df"] = own["key"], own["n"], fp, bucket, df
            at += len(fp)
        e = e[np.lexsort((e["fp"], e["bucket"], e["df"], e["key"]))]
        gram = mix((e["bucket"].astype(np.uint64) << np.uint64(32)) | e["fp"])
        start = np.flatnonzero(np.concatenate(([True], e["key"][1:] != e["key"][:-1]))) if len(e) else np.zeros(0, np.int64)
        held = np.diff(np.append(start, len(e)))
        n = e["n"].astype(np.int64)
        pos = np.arange(len(e)) - np.repeat(start, held) + n - np.repeat(held, held)  # unshared ones come first
        listed = (pos < n - required(n, -(-pct * n // 100), pct) + 1) & (n * 100 >= pct * (boundary + 1))
        out = [(gram[listed].view(np.int64), e["key"][listed].view(np.int64), n[listed], pos[listed], np.zeros(listed.sum(), np.int64))]
        out += _light_postings(gram, e["key"], n, start, held, pct, boundary)
        columns = [np.concatenate(x) for x in zip(*out)]
        return pa.table([pa.array(x).cast(f.type) for x, f in zip(columns, schema)], schema=schema)

    return run


def _need(a: str, b: str, pct: int):
    return F.floor((pct * (F.col(a) + F.col(b)) + 99 + pct) / F.lit(100 + pct)).cast("int")


def _possible(pct: int, boundary: int):
    """Whether two postings of one gram (columns of a. and b.) can belong to a link."""
    t = _need("a.n", "b.n", pct)
    lists = (F.col("a.need") == 0) & (F.greatest("a.n", "b.n") > boundary) & (F.col("a.n") - F.col("a.pos") >= t) & (F.col("b.n") - F.col("b.pos") >= t)
    return (F.col("a.need") == F.col("b.need")) & (t <= F.least("a.n", "b.n")) & (lists | (F.col("a.need") == t))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, similarity_pct: int = 85) -> DataFrame:
    """One row for each row of docs: id, n_shingles, class_id (smallest id with an equal set),
    component_id (smallest id reachable by links).

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of width
    words, or the whole sequence of a shorter text. Two documents link where
    100 * intersection >= similarity_pct * union. Null, empty and blank texts have empty sets and no
    links: class_id and component_id are their own id. Repeated rows come back as often as they came.
    Rows with a null id come back with null class and component and link nothing. Rows that share an id but not a text
    each have the links of their own text; as a component is named by its smallest id, two may have the same name.
    Other columns of docs are not read. Exactness is up to hashes: sets, shingles and classes are told apart by
    64 bits. Nothing is capped: every possible pair that the bounds leave is verified on the whole sets.
    """
    spark, pct = docs.sparkSession, similarity_pct
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text"))
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(partitions(spark), -(-chars // (CHARS_PER_SHINGLE * BUCKET_SHINGLES)))
    with small_batches(spark):
        rows = staged(docs.mapInArrow(_keyed(width), "id long, key long, n int"), "rows")
    classes = staged(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("class_id")), "classes")  # apart from the joins on key, so that Spark may split a hot class there
    sizes = {r.n: r["count"] for r in rows.where(F.col("n").between(1, MOST_LIGHT)).groupBy("n").count().collect()}  # 16 rows at most
    boundary = light_boundary(sizes, pct)

    # sets are hashed once more here and go straight to their buckets: written as a table first, they would take the disk twice
    sent = "bucket int, block long, classes binary, payload binary"
    shared = docs.mapInArrow(_pack(width, buckets), sent).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(_shared_fingerprints, sent)
    posted = shared.repartition(buckets, "block").groupBy("block").applyInArrow(_postings(pct, boundary), "gram long, key long, n int, pos int, need int")
    with small_batches(spark):
        posted = staged(posted.select("gram", F.col("key").alias("c"), "n", "pos", "need").distinct(), "postings")  # blocks that hold a class post the same

    leaders = posted.groupBy("gram").agg(F.min(F.struct("pos", "c", "n", "need")).alias("l"), F.count("*").alias("m")).where("m > 1").select("gram", "l.*")
    members = staged(posted.join(leaders.select("gram"), "gram", "left_semi").select("c").distinct(), "members")
    sets = _sets(docs, members, classes, width)
    pairs = posted.alias("a").join(leaders.alias("b"), "gram").where((F.col("a.c") != F.col("b.c")) & _possible(pct, boundary))
    pairs = pairs.select(F.least("a.c", "b.c").alias("u"), F.greatest("a.c", "b.c").alias("v")).distinct()
    tested = staged(_verified(pairs, sets, pct), "pairs")
    links = tested.where("linked").select("u", "v")
    first = staged(components(links), "components")

    split = posted.join(leaders.select("gram"), "gram", "left_semi").join(first, posted["c"] == first["node"], "left").select("gram", "c", "n", "pos", "need", F.coalesce("root", "c").alias("root"))
    torn = split.groupBy("gram").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("gram")
    split = staged(split.join(torn, "gram", "left_semi"), "split")
    dropped(posted)
    more = split.alias("a").join(split.alias("b"), "gram").where((F.col("a.c") < F.col("b.c")) & (F.col("a.root") != F.col("b.root")) & _possible(pct, boundary))
    more = more.select(F.col("a.c").alias("u"), F.col("b.c").alias("v")).distinct().join(tested, ["u", "v"], "left_anti")
    more = _verified(more, sets, pct).where("linked").select("u", "v")
    roots = components(first.select(F.col("node").alias("u"), F.col("root").alias("v")).union(more))
    dropped(split, tested, sets)

    # roots are the smallest class hash; the component is named by its smallest id, as are documents that share an id
    rooted = classes.where("class_id is not null").join(roots, classes["key"] == roots["node"], "left").select("key", "class_id", F.coalesce("root", "key").alias("root"))
    named = rooted.groupBy("root").agg(F.min("class_id").alias("component_id"))
    found = rooted.join(named, "root").select("key", "class_id", "component_id")
    out = rows.join(found, "key", "left")
    has = (F.col("n") > 0) & F.col("id").isNotNull()
    return out.select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.when(has, F.col("class_id")).otherwise(F.col("id")).alias("class_id"), F.when(has, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))


def _sets(docs: DataFrame, members: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The whole shingle sets of the classes that meet another in some list, by class. Read from the texts of each
    class's smallest id; of those, texts of other classes that share the id fall out again by their hash."""

    def run(batches):
        hasher = WordHasher()
        for batch in sliced(batches):
            texts = [x or b"" for x in batch.column("text").to_pylist()]
            for i, j in blocks(texts):
                found = list(text_sets(texts[i:j], width, hasher))
                keys = np.array([_key(x) for x in found], dtype=np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([x.view(np.int64) for x in found], type=pa.list_(pa.int64()))], names=["c", "s"])

    named = staged(members.join(classes, F.col("c") == F.col("key")).select("c", F.col("class_id").alias("id")), "named")
    n = named.count()
    chosen = semi_join(docs, named.select("id").distinct(), "id", n)
    with small_batches(docs.sparkSession):
        sets = staged(chosen.select("text").mapInArrow(run, "c long, s array<long>"), "sets")
    return semi_join(sets, members, "c", n).dropDuplicates(["c"])


def _verified(pairs: DataFrame, sets: DataFrame, pct: int) -> DataFrame:
    """pairs(u, v) with linked: whether their whole sets are similar enough."""
    a, b = sets.select(F.col("c").alias("u"), F.col("s").alias("p")), sets.select(F.col("c").alias("v"), F.col("s").alias("q"))
    both = pairs.join(a, "u").join(b, "v").withColumn("i", F.size(F.array_intersect("p", "q")))
    return both.select("u", "v", (100 * F.col("i") >= pct * (F.size("p") + F.size("q") - F.col("i"))).alias("linked"))


def reach_sql(links: str, nodes: str) -> str:
    """A recursive step that gives (id, root) pairs: root is any node that id reaches over links(x, y)."""
    return f"both_ways AS (SELECT x, y FROM {links} UNION SELECT y, x FROM {links}), reach AS (SELECT id, id AS root FROM {nodes} UNION SELECT r.id, b.y FROM reach r JOIN both_ways b ON r.root = b.x)"


def jaccard_sql(documents: str = "documents", width: int = 4, similarity_pct: int = 85) -> str:
    """The join by brute force over shared shingles, as DuckDB SQL."""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH RECURSIVE w AS (SELECT doc_id AS id, COALESCE(regexp_extract_all({lower}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM {documents}),
s AS (SELECT DISTINCT id, sh FROM (SELECT id, unnest(CASE WHEN len(w) >= {width} THEN list_transform(range(1, len(w) - {width - 2}), lambda i: array_to_string(list_slice(w, i, i + {width - 1}), ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w)),
n AS (SELECT w.id, count(s.sh) AS n FROM w LEFT JOIN s USING (id) GROUP BY w.id),
shared AS (SELECT a.id AS x, b.id AS y, count(*) AS i FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN n p ON p.id = x JOIN n q ON q.id = y WHERE 100 * i >= {similarity_pct} * (p.n + q.n - i)),
{reach_sql("links", "n")}
SELECT id AS doc_id, n.n AS n_shingles, min(root) AS component_id FROM n JOIN reach USING (id) GROUP BY ALL"""
