"""Phrases that stand together more often than their parts would: count tries in shards, merged by range of their prefix."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import _BASE, _BYTE, _LOWER, _MULT, BROADCAST_KEYS, WordHasher, blocks, byte_slices, dropped, mix, partitions, staged

#: Words of a phrase at most; occurrences that a candidate has at least; rows of a language in the result.
DEPTH, MIN_COUNT, TOP = 5, 100, 2000
#: Bytes of text in a shard; bytes of text for each range of prefixes that is merged in one task.
SHARD_BYTES, RANGE_BYTES = 16 << 20, 16 << 20
#: Bits of a filter: so many for each key, in these bounds (2**28 bits are 32 MB, whatever the input has).
BITS_A_KEY, FEWEST_BITS, MOST_BITS = 64, 1 << 20, 1 << 28
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_BREAK, _BLANK = 2, 1
_KIND = np.zeros(256, dtype=np.uint8)
_KIND[[0x20, 0x09]] = _BLANK
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = _BREAK
_U32 = np.uint64(32)


def tokens(texts: list[bytes], seed: np.uint64, hasher: WordHasher):
    """ids of the words of some texts (never 0), whether each starts a piece, their places, and the lower-cased bytes."""
    data = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    kind = _KIND[data]
    gap = kind > 0
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if not gap[0]:
        edge = np.concatenate(([0], edge))
    start, end = edge[0::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64), np.zeros(0, bool), start, end, data
    hasher._grow(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * hasher.power[: len(data)], out=total[1:])
    ids = mix(mix((total[end] - total[start]) * hasher.back[start] + (end - start).astype(np.uint64)) + seed)
    ids[ids == 0] = _BASE
    n_breaks = np.cumsum(kind == _BREAK, dtype=np.int32)
    fresh = np.ones(len(start), dtype=bool)
    fresh[1:] = n_breaks[start[1:]] != n_breaks[end[:-1] - 1]
    return ids, fresh, start, end, data


def pair_ids(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _MULT[0] + b * _MULT[1])


def ranges_of(keys: np.ndarray, n: int) -> np.ndarray:
    """The range of each key: n equal parts of the key space."""
    return ((keys >> _U32) * np.uint64(n)) >> _U32


def _by_lang(batches):
    """(language, its texts in blocks, seed) for each shard of the rows."""
    for part in byte_slices(batches, "text", SHARD_BYTES):
        held = defaultdict(list)
        for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist()):
            held[lang].append(text.encode())
        yield [(lang, [texts[i:j] for i, j in blocks(texts, 2_000_000)], np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))) for lang, texts in held.items()]


class Filter:
    """A bitmap of keys: has() is true for all of them and a few others."""

    def __init__(self, bits: bytes) -> None:
        self.bits = np.frombuffer(bits, dtype=np.uint8)
        self.mask = np.uint64(len(bits) * 8 - 1)

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def filter_of(keys: DataFrame):
    """A broadcast bitmap of a column h of keys, of bounded size; built by Spark, a row for each 32,768 bits comes to the driver."""
    spark, n = keys.sparkSession, keys.count()
    bits = FEWEST_BITS
    while bits < min(MOST_BITS, BITS_A_KEY * n):
        bits *= 2
    at = F.col("h").bitwiseAND(F.lit(bits - 1)) + 1
    parts = keys.select(F.bitmap_bucket_number(at).alias("b"), F.bitmap_bit_position(at).alias("p")).groupBy("b").agg(F.bitmap_construct_agg("p").alias("bits"))
    out = bytearray(bits // 8)
    for r in parts.toLocalIterator():
        out[(r.b - 1) * 4096 : r.b * 4096] = r.bits
    return spark.sparkContext.broadcast(bytes(out))


_BLOB = pa.schema([("lang", pa.string()), ("range", pa.int32()), ("payload", pa.binary())])


def _blobs(rows):
    rows = list(rows)
    for i in range(0, len(rows), 256):
        yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows[i : i + 256]), _BLOB)], schema=_BLOB)


def _packed_counts(lang: str, keys: np.ndarray, counts: np.ndarray, n_ranges: int):
    """Sorted keys with their counts, a row for each range that has any."""
    r = ranges_of(keys, n_ranges)
    edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else []
    for lo, hi in zip(edges := list(edge), [*edges[1:], len(r)]):
        yield lang, int(r[lo]), keys[lo:hi].tobytes() + counts[lo:hi].astype(np.uint32).tobytes()


def _singles(n_ranges: int):
    def run(batches):
        hasher = WordHasher()
        for shard in _by_lang(batches):
            for lang, texts, seed in shard:
                found = [tokens(x, seed, hasher)[0] for x in texts]
                yield from _blobs(_packed_counts(lang, *np.unique(np.concatenate(found), return_counts=True), n_ranges))

    return run


def _pairs(n_ranges: int, words):
    def run(batches):
        hasher, known = WordHasher(), Filter(words.value)
        for shard in _by_lang(batches):
            for lang, texts, seed in shard:
                found = [np.zeros(0, np.uint64)]
                for x in texts:
                    ids, fresh, *_ = tokens(x, seed, hasher)
                    has = known.has(ids)
                    at = np.flatnonzero(has[:-1] & has[1:] & ~fresh[1:])
                    found.append(pair_ids(ids[at], ids[at + 1]))
                yield from _blobs(_packed_counts(lang, *np.unique(np.concatenate(found), return_counts=True), n_ranges))

    return run


_SUMS = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("n", pa.int64())])


def _merge_counts(least: int):
    """Keys of a range with their counts over all shards, where these reach least; a row without a key for the sum of all."""

    def run(key, blobs):
        keys, counts = [], []
        for x in blobs.column("payload").to_pylist():
            n = len(x) // 12
            keys.append(np.frombuffer(x, np.uint64, n))
            counts.append(np.frombuffer(x, np.uint32, n, n * 8))
        keys, counts = np.concatenate(keys), np.concatenate(counts).astype(np.int64)
        order = np.argsort(keys, kind="stable")  # merges the sorted runs
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sums = np.add.reduceat(counts, first)
        often = sums >= least
        h = pa.concat_arrays([pa.array(keys[first][often].view(np.int64)), pa.nulls(1, pa.int64())])
        n = pa.array(np.concatenate((sums[often], [counts.sum()])))
        return pa.Table.from_arrays([pa.array([key[0].as_py()] * len(n), pa.string()), h, n], schema=_SUMS)

    return run


def build_trie(rows: np.ndarray, depths: np.ndarray):
    """Levels 2 to DEPTH of the count trie of sorted rows of word ids (n, DEPTH) with so many words each: for each level the parents
    (places in the level above; level 2 has the first words instead), the words and the counts."""
    levels, at = [], np.arange(len(rows))
    node = np.zeros(len(rows), dtype=np.int64)
    for d in range(2, DEPTH + 1):
        at = at[depths[at] >= d]
        above = rows[at, 0] if d == 2 else node[at]
        word = rows[at, d - 1]
        new = np.ones(len(at), dtype=bool)
        new[1:] = (above[1:] != above[:-1]) | (word[1:] != word[:-1])
        node[at] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        levels.append((above[first], word[first], np.diff(np.append(first, len(at))).astype(np.uint32)))
    return levels


def cut_trie(levels, n_ranges: int):
    """(range, serialised part) of a trie whose first level is sorted by range."""
    first, second, _ = levels[0]
    r = ranges_of(pair_ids(first, second), n_ranges)
    edge = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1]))) if len(r) else []
    for lo, hi in zip(edges := list(edge), [*edges[1:], len(r)]):
        out, sizes, a, b = [], [], int(lo), int(hi)
        number = int(r[lo])
        for k, (above, word, count) in enumerate(levels):
            if k:
                base, (a, b) = a, np.searchsorted(above, (a, b))
            out += [above[a:b].tobytes() if not k else (above[a:b] - base).astype(np.uint32).tobytes(), word[a:b].tobytes(), count[a:b].tobytes()]
            sizes.append(b - a)
        yield number, np.array(sizes, dtype=np.uint32).tobytes() + b"".join(out)


def _read_trie(blob: bytes):
    sizes = np.frombuffer(blob, np.uint32, DEPTH - 1)
    at, levels = 4 * (DEPTH - 1), []
    for k, n in enumerate(sizes.tolist()):
        level = []
        for kind in (np.uint64 if not k else np.uint32, np.uint64, np.uint32):
            level.append(np.frombuffer(blob, kind, n, at))
            at += n * np.dtype(kind).itemsize
        levels.append(level)
    return levels


def merge_tries(tries):
    """The sum of tries: levels with 64-bit counts, each sorted by parent and word."""
    merged, places = [], None
    for k in range(DEPTH - 1):
        above = [t[k][0] if not k else p[t[k][0]] for t, p in zip(tries, places or [None] * len(tries))]
        sizes = [len(t[k][1]) for t in tries]
        above, word, count = np.concatenate(above), np.concatenate([t[k][1] for t in tries]), np.concatenate([t[k][2] for t in tries]).astype(np.int64)
        order = np.lexsort((word, above))
        above, word, count = above[order], word[order], count[order]
        new = np.ones(len(word), dtype=bool)
        new[1:] = (above[1:] != above[:-1]) | (word[1:] != word[:-1])
        node = np.empty(len(word), dtype=np.int64)
        node[order] = np.cumsum(new) - 1
        places = np.split(node, np.cumsum(sizes)[:-1])
        first = np.flatnonzero(new)
        merged.append((above[first], word[first], np.add.reduceat(count, first) if len(first) else count))
    return merged


def often_nodes(levels, least: int):
    """(words, count, counts of its beginnings of two words and more) for the nodes of each level that reach least: a walk from the root."""
    words = lefts = None
    for k, (above, word, count) in enumerate(levels):
        if k:
            words, lefts = np.column_stack((words[above], word)), np.column_stack((lefts[above], levels[k - 1][2][above]))
        else:
            words, lefts = np.column_stack((above, word)), np.zeros((len(word), 0), np.int64)
        often = count >= least
        yield words[often], count[often], lefts[often]


def _tries(n_ranges: int, words, pairs):
    """Rows of serialised tries, and of the words in them (range below 0: -1 - range of the id)."""

    def run(batches):
        hasher, known, linked = WordHasher(), Filter(words.value), Filter(pairs.value)
        for shard in _by_lang(batches):
            for lang, texts, seed in shard:
                rows, depths, spelt = [], [], {}
                for x in texts:
                    ids, fresh, start, end, data = tokens(x, seed, hasher)
                    if len(ids) < 2:
                        continue
                    has = known.has(ids)
                    ok = np.zeros(len(ids) + DEPTH, dtype=bool)
                    at = np.flatnonzero(has[:-1] & has[1:] & ~fresh[1:])
                    ok[at[linked.has(pair_ids(ids[at], ids[at + 1]))]] = True
                    depth, run_on = np.ones(len(ids), dtype=np.int8), np.ones(len(ids), dtype=bool)
                    for k in range(DEPTH - 1):
                        run_on &= ok[k : k + len(ids)]
                        depth += run_on
                    at = np.flatnonzero(depth > 1)
                    depth, padded = depth[at], np.concatenate((ids, np.zeros(DEPTH, np.uint64)))
                    rows.append(np.column_stack([np.where(depth > k, padded[at + k], np.uint64(0)) for k in range(DEPTH)]))
                    depths.append(depth)
                    used = np.unique(np.concatenate((at, at + 1)))
                    some, first = np.unique(ids[used], return_index=True)
                    raw = data.tobytes()
                    for h, i in zip(some.tolist(), used[first].tolist()):
                        if h not in spelt:
                            spelt[h] = raw[start[i] : end[i]]
                if not rows:
                    continue
                rows, depths = np.concatenate(rows), np.concatenate(depths)
                order = np.lexsort((*(rows[:, k] for k in range(DEPTH - 1, -1, -1)), ranges_of(pair_ids(rows[:, 0], rows[:, 1]), n_ranges)))
                yield from _blobs((lang, r, blob) for r, blob in cut_trie(build_trie(rows[order], depths[order]), n_ranges))
                by_range = defaultdict(list)
                for h, r in zip(spelt, ranges_of(np.array(list(spelt), dtype=np.uint64), n_ranges).tolist() if spelt else []):
                    by_range[r].append(h)
                yield from _blobs((lang, -1 - r, b"\n".join(b"%d %b" % (h, spelt[h]) for h in hs)) for r, hs in by_range.items())

    return run


_NODES = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.int64())), ("a", pa.int64()), ("lefts", pa.list_(pa.int64())), ("word", pa.string())])


def _merge_tries(least: int):
    def lists(x: np.ndarray):
        return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)), pa.array(np.ascontiguousarray(x).reshape(-1).view(np.int64)))

    def run(key, blobs):
        lang, blobs = key[0].as_py(), blobs.column("payload").to_pylist()
        parts = []
        if key[1].as_py() < 0:
            spelt = dict(line.split(b" ", 1) for b in blobs for line in b.split(b"\n"))
            ids = np.array([int(h) for h in spelt], dtype=np.uint64)
            parts.append([lists(ids.reshape(-1, 1)), pa.nulls(len(ids), pa.int64()), pa.nulls(len(ids), pa.list_(pa.int64())), pa.array([w.decode() for w in spelt.values()], pa.string())])
        else:
            for words, count, lefts in often_nodes(merge_tries([_read_trie(b) for b in blobs]), least):
                parts.append([lists(words), pa.array(count), lists(lefts), pa.nulls(len(count), pa.string())])
        return pa.concat_tables(pa.Table.from_arrays([pa.array([lang] * len(p[1]), pa.string()), *p], schema=_NODES) for p in parts)

    return run


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", min_count: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the phrases of 2 to 5 words of each language whose occurrences (a) most exceed what those of
    their parts (l, r at the cut that explains them best) and all words (n) let expect.

    ASCII capitals are lowered; a phrase lies within a piece between marks and line ends, and occurs at least min_count times. Phrases
    inside longer ones that occur as often are dropped. Null texts are empty, null languages are 'und'; every row counts, repeats
    too; a language without a candidate has no rows. Ties in score and count rank by the phrase's bytes. Other columns are not read.

    No phrase occurs more often than its words and pairs, so a pass counts words, the next one pairs of words that reach min_count,
    and the last one puts only runs of such pairs into the count tries of its shards. What reaches min_count is known to the tasks by
    bitmaps of bounded size; where these are full more phrases are counted, none is missed. Shards send sorted parts of tries by the range of their
    first two words' hash; a range is merged in one task, level by level. A walk down the merged trie gives left parts, a join of
    each phrase's rest with the phrases of a word less (its suffix link) the right ones.
    """
    spark: SparkSession = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"))
    n_ranges = max(partitions(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // RANGE_BYTES))
    blob, sums = "lang string, range int, payload binary", "lang string, h long, n long"

    def counted(task) -> DataFrame:
        return rows.mapInArrow(task, blob).groupBy("lang", "range").applyInArrow(_merge_counts(min_count), sums)

    singles = staged(counted(_singles(n_ranges)), "words")
    words = filter_of(singles.where("h is not null").select("h"))
    often = staged(counted(_pairs(n_ranges, words)).where("h is not null").select("h"), "pairs")
    pairs = filter_of(often)
    dropped(often)
    merged = rows.mapInArrow(_tries(n_ranges, words, pairs), blob).groupBy("lang", "range").applyInArrow(_merge_tries(min_count), "lang string, words array<long>, a long, lefts array<long>, word string")
    merged = staged(merged, "phrases")
    totals = singles.where("h is null").groupBy(F.col("lang").alias("of")).agg(F.sum("n").alias("n"))

    phrases = merged.where("word is null").select("lang", "words", "a", "lefts")
    spelling = merged.where("word is not null").select("lang", F.col("words")[0].alias("id"), "word")
    parts = phrases.select("words", "a").unionByName(singles.where("h is not null").select(F.array("h").alias("words"), F.col("n").alias("a")))
    rest = parts.select(F.col("words").alias("right"), F.col("a").alias("r"))
    heads = singles.where("h is not null").select(F.col("h").alias("head"), F.col("n").alias("of_head"))

    size = F.size("words")
    cuts = phrases.join(heads, F.col("words")[0] == F.col("head")).select("lang", "words", "a", F.posexplode(F.concat(F.array("of_head"), "lefts")).alias("k", "l"))
    cuts = cuts.withColumn("k", F.col("k") + 1).withColumn("right", F.slice("words", F.col("k") + 1, size - F.col("k"))).join(rest, "right")
    totals = F.broadcast(totals) if totals.count() <= BROADCAST_KEYS else totals
    cuts = staged(cuts.join(totals, F.col("lang") == F.col("of")).withColumn("score", F.expr("(1000 * cast(a as decimal(19,0)) * cast(n as decimal(15,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")).select("lang", "words", "a", "k", "l", "r", "right", "n", "score"), "cuts")

    inside = cuts.where((F.col("k") == 1) & (F.col("r") == F.col("a")) & (F.size("right") > 1)).select(F.col("right").alias("gone"))
    inside = inside.unionByName(cuts.where((F.col("k") == size - 1) & (F.col("l") == F.col("a")) & (F.col("k") > 1)).select(F.slice("words", 1, size - 1).alias("gone"))).distinct()
    best = cuts.groupBy("lang", "words", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut")).join(inside, F.col("words") == F.col("gone"), "left_anti")
    best = best.select("lang", "words", "a", "n", "cut.*")

    order = [F.desc("score"), F.desc("a")]
    salt = F.pmod(F.xxhash64("words"), F.lit(partitions(spark)))
    first = best.withColumn("salt", salt).withColumn("place", F.rank().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("place") <= top)
    first = first.withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("place") <= top).drop("salt", "place")
    first = staged(first, "first")
    named = first.select("words", F.posexplode("words").alias("i", "id")).join(spelling.select("id", "word"), "id").groupBy("words").agg(F.array_sort(F.collect_list(F.struct("i", "word"))).alias("spelt"))
    out = first.join(named, "words").withColumn("phrase", F.array_join("spelt.word", " "))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order, "phrase")).cast("long")).where(F.col("rank") <= top)
    dropped(cuts, singles)
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def collocations_sql(documents: str = "documents", min_count: int = MIN_COUNT, top: int = TOP) -> str:
    """collocations as DuckDB SQL: all phrases counted, every cut and every longer phrase tried."""
    return f"""
WITH d AS (SELECT COALESCE(lang, 'und') AS lang, translate(COALESCE(text, ''), '{UPPER}', '{LOWER}') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS ws FROM p),
n AS (SELECT lang, sum(len(ws))::BIGINT AS n FROM w GROUP BY lang),
st AS (SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM w),
g AS (SELECT lang, ws[i : i + k - 1] AS ph, count(*) AS a FROM st, range(1, {DEPTH + 1}) s(k) WHERE i + k - 1 <= len(ws) GROUP BY ALL HAVING count(*) >= {min_count}),
k AS (SELECT lang, ph, a, unnest(range(1, len(ph))) AS k FROM g WHERE len(ph) > 1),
c AS (SELECT k.lang, k.ph, k.a, k.k, l.a AS l, r.a AS r, n.n, (1000::HUGEINT * k.a * n.n) // (l.a::HUGEINT * r.a) AS score FROM k JOIN n USING (lang)
    JOIN g l ON l.lang = k.lang AND l.ph = k.ph[1 : k.k] JOIN g r ON r.lang = k.lang AND r.ph = k.ph[k.k + 1 :]),
b AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY lang, ph ORDER BY score, k) = 1),
sub AS (SELECT lang, a, ph[i : i + m - 1] AS ph FROM g, range(1, {DEPTH}) s(i), range(2, {DEPTH}) z(m) WHERE i + m - 1 <= len(ph) AND m < len(ph)),
gone AS (SELECT DISTINCT s.lang, s.ph FROM sub s JOIN g USING (lang, ph) WHERE 100 * s.a >= 100 * g.a),
o AS (SELECT lang, array_to_string(ph, ' ') AS phrase, a, l, r, n, score::BIGINT AS score FROM b ANTI JOIN gone USING (lang, ph))
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM o
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= {top}"""
