"""Best-fit packing of tokenised documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import base64
import functools
import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import partitions, small_batches, staged

#: Short pieces that one task packs at about; the rest of a part-filled bin costs under half a bin in a hundred.
SHARD_PIECES = 16_384
#: Bins filled less than this are opened again and packed with those of other shards.
REPACK_BELOW = 0.995
#: The special token's text, which the tokenizer file maps to one id wherever it stands.
END_OF_TEXT = "<|endoftext|>"

_PIECES = pa.schema([("id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])


@functools.lru_cache(maxsize=2)
def _encoder(vocabulary: str, pattern: str):
    """Ids of a text as the tokenizers library gives them from this file, by the faster library where both agree.

    The merge ranks are read out of the tokenizer file itself: byte-level symbols back to bytes, ids as ranks.
    """
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}
    ranks = {bytes(symbols[c] for c in token): i for token, i in vocab.items() if token != END_OF_TEXT}
    fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> list[int]:
        if END_OF_TEXT in text:
            return slow.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: whole if it fits, else full pieces after a shorter first one."""
    first = n if n <= capacity else n % capacity
    return ([(0, first)] if first else []) + [(s, capacity) for s in range(first, n, capacity)]


def _pieces(vocabulary: str, pattern: str, capacity: int, end_id: int):
    def run(batches):
        encode = _encoder(vocabulary, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                for k, (s, length) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, k, s, length, zlib.crc32(ids[s : s + length].tobytes())))
            yield pa.RecordBatch.from_arrays([pa.array(x, type=f.type) for x, f in zip(zip(*rows), _PIECES)] if rows else [pa.array([], type=f.type) for f in _PIECES], schema=_PIECES)

    return run


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Packs sizes in the order given; returns each one's bin and its place there.

    Each goes where the sum over residual gaps of the squared number of open bins becomes smallest;
    among equals into the fullest bin. Closed bins (gap 0) do not count.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    count = np.zeros(capacity + 1, dtype=np.int64)
    bins, offsets, made = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), 0
    for i, s in enumerate(sizes.tolist()):
        after = count[: capacity - s]  # bins that have the gap a placement leaves, for gaps s..capacity-1
        before = count[s:capacity]
        change = 2 * after - 2 * before + 2
        if len(change):
            change[0] -= 2 * after[0] + 1  # a gap of 0 closes the bin
            change[before == 0] = np.iinfo(np.int64).max
            g = int(np.argmin(change))
            best = change[g]
        else:
            best = np.iinfo(np.int64).max
        fresh = 2 * count[capacity - s] + 1 if s < capacity else 0
        if best <= fresh and best < np.iinfo(np.int64).max:
            gap = g + s
            b = open_bins[gap].pop()
            count[gap] -= 1
        else:
            gap, b, made = capacity, made, made + 1
        bins[i], offsets[i] = b, capacity - gap
        if gap > s:
            open_bins[gap - s].append(b)
            count[gap - s] += 1
    return bins, offsets


_OUT = "id long, piece int, start long, length long, ids_crc32 long, shard long, bin long, offset long, fill long"


def _pack(capacity: int):
    def run(table: pa.Table) -> pa.Table:
        at = np.lexsort(tuple(table.column(c).to_numpy(zero_copy_only=False) for c in ("ids_crc32", "start", "piece", "id", "length")))[::-1]
        table = table.take(pa.array(at))
        size = table.column("length").to_numpy()
        bins, offsets = sum_of_squares(size, capacity)
        fill = np.bincount(bins, weights=size).astype(np.int64)[bins] if len(bins) else bins
        shard = table.column("shard").to_numpy()
        return table.select(["id", "piece", "start", "length", "ids_crc32"]).append_column("shard", pa.array(shard)).append_column("bin", pa.array(bins)).append_column("offset", pa.array(offsets)).append_column("fill", pa.array(fill))

    return run


def best_fit_packing(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end_id: int = 2) -> DataFrame:
    """One row for each piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document's ids are those of its text (null: empty) and then end_id, so every row has one piece
    at least. Only documents over capacity are cut: full pieces after a shorter first one. Full pieces are sequences of
    their own; the others are dealt to shards by hash and packed there by the sum-of-squares rule, the
    largest first. Bins with room left are opened and packed once more, with those of other shards.
    Repeated rows and null ids are packed like any others. Ties fall by id, so reruns agree.
    The packed ids are not moved: only lengths travel, about 50 bytes for each piece.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    with small_batches(spark):
        pieces = staged(docs.mapInArrow(_pieces(vocabulary, pattern, capacity, end_id), "id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    full = pieces.where(F.col("length") == capacity).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    short = pieces.where(F.col("length") < capacity)

    n = short.count()
    shards = max(1, -(-n // SHARD_PIECES))
    dealt = short.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)))
    packed = staged(dealt.repartition(max(shards, partitions(spark)), "shard").groupBy("shard").applyInArrow(_pack(capacity), _OUT), "packed")
    done = packed.where(F.col("fill") >= int(REPACK_BELOW * capacity))
    again = packed.where(F.col("fill") < int(REPACK_BELOW * capacity))
    groups = max(1, -(-again.count() // SHARD_PIECES))
    again = again.withColumn("shard", shards + F.pmod(F.xxhash64("id", "piece", "ids_crc32", F.lit(1)), F.lit(groups))).drop("bin", "offset", "fill")
    again = again.repartition(max(groups, partitions(spark)), "shard").groupBy("shard").applyInArrow(_pack(capacity), _OUT)
    short = done.union(again).withColumn("sequence_id", F.col("shard") * (1 << 32) + F.col("bin"))

    columns = [F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return short.select(columns).union(full.select(columns))
