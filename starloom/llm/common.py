"""What the corpus operators share: the staging folder, input checks, byte-level hashing."""

from __future__ import annotations

import re
from contextlib import contextmanager

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.sources.files import delete
from starloom.sources.staging import shared_dir, staged

#: A word everywhere in these operators: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of at most this many keys (16 bytes each in a hashed relation) are broadcast; more are shuffled.
BROADCAST_KEYS = 1_000_000
#: Bytes of rows that go to a Python worker at once, at about; without a bound 10,000 rows do, whatever they hold.
ARROW_BYTES, _ARROW_BOUND = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def dropped(*frames: DataFrame) -> None:
    """Removes the files of staged frames that nothing reads any more; files elsewhere than in the shared folder are left alone."""
    bare = lambda path: re.sub(r"^\w+:/+", "/", path)
    for df in frames:
        mine = bare(f"{shared_dir(df.sparkSession)}/starloom/")
        for folder in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            if bare(folder).startswith(mine):
                delete(df.sparkSession, folder)


@contextmanager
def small_batches(spark: SparkSession):
    """While it lasts, what runs sends rows to Python in batches of about ARROW_BYTES, which an executor's JVM and its worker both hold,
    with a next one already read. A bound that the session has is kept; afterwards its settings are as they were."""
    if spark.conf.get(_ARROW_BOUND, None) is not None:
        yield
        return
    spark.conf.set(_ARROW_BOUND, str(ARROW_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_BOUND)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """These names for columns, changed where df has a column of the name, in whatever case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def semi_join(df: DataFrame, keys: DataFrame, on: str, n_keys: int) -> DataFrame:
    """Rows of df whose key is in keys; broadcast only where the counted keys are few."""
    keys = keys.select(on)
    return df.join(F.broadcast(keys) if n_keys <= BROADCAST_KEYS else keys, on, "left_semi")


def crc_mod(doc_id, n: int):
    """crc32 of the id written as text, modulo n; null ids count as the text ''."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n))


# ---- hashing of words in whole blocks of text, without a Python object for each word ----

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, size=256, dtype=np.int64).astype(np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_MULT = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def _inverse(k: int) -> int:
    return pow(k, -1, 1 << 64)


class WordHasher:
    """Hashes every word of a block of texts with prefix sums of a polynomial over its bytes."""

    def __init__(self) -> None:
        self.power = self.back = np.zeros(0, dtype=np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 1 << 16)
            self.power, self.back = _powers(_BASE, n), _powers(np.uint64(_inverse(int(_BASE))), n)

    def __call__(self, texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """64-bit hashes of all words, and the number of words of each text."""
        data = np.frombuffer(b" ".join(texts) + b" ", dtype=np.uint8)
        if lower:
            data = _LOWER[data]
        self._grow(len(data) + 1)
        space = _SPACE[data]
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        if not space[0]:
            edge = np.concatenate(([0], edge))
        start, end = edge[0::2], edge[1::2]
        if not len(start):
            return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
        total = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(_BYTE[data] * self.power[: len(data)], out=total[1:])
        words = mix((total[end] - total[start]) * self.back[start] + (end - start).astype(np.uint64))
        offset = np.cumsum([0] + [len(t) + 1 for t in texts])
        counts = np.diff(np.searchsorted(start, offset))
        return words, counts


def shingles(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of all runs of width words; a shorter text is one run; no words, no runs."""
    n = len(words)
    if n == 0:
        return words
    if n < width:
        h = np.array([n], dtype=np.uint64)
        for i in range(n):
            h = h * _MULT[4] + words[i : i + 1] * _MULT[i % 8]
        return mix(h)
    h = words[: n - width + 1] * _MULT[0]
    for i in range(1, width):
        h = h + words[i : n - width + 1 + i] * _MULT[i % 8]
    return mix(h)


def sliced(batches, rows: int = 512):
    """Record batches in slices of a few rows, so that copies of texts as Python objects never are of a whole batch."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def byte_slices(batches, column: str, limit: int = 16 << 20):
    """Record batches in slices of about limit bytes in a column of texts, or of one row that has more."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + limit, side="right")))
            yield batch.slice(i, j - i)
            i = j


def blocks(texts, limit: int = 1_000_000):
    """Slices (start, stop) of a list of byte strings, each of about limit bytes or one long text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= limit):
            size += len(texts[j])
            j += 1
        yield i, j
        i = j


__all__ = ["shared_dir", "staged"]
