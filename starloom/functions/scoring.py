"""Scalar formulas: priors, specificity, hashes, cosine, time decisions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the ranking formulas.
RRF_K = 60
STAR_CAP, STAR_SPAN, STAR_FULL = 1.25, 0.25, 50_001
FNV_START, FNV_PRIME, WORD32 = 2166136261, 16777619, 0xFFFFFFFF


def star_prior(stars: Column) -> Column:
    """From 1 without stars up to STAR_CAP."""
    return F.when(stars > 0, F.least(F.lit(STAR_CAP), 1 + STAR_SPAN * F.log10(1.0 + stars) / F.log10(F.lit(float(STAR_FULL))))).otherwise(1.0)


def lab_star_prior(stars: Column) -> Column:
    return F.least(F.lit(STAR_CAP), 1 + 0.04 * F.log10(stars + 1.0))


def recency_boost(pushed: Column, now: Column) -> Column:
    days = (F.unix_millis(now) - F.unix_millis(pushed)) / F.lit(86_400_000.0)
    return F.when(days <= 90, 1.10).when(days <= 365, 1.05).otherwise(1.0)


def specificity(df: Column) -> Column:
    """What a name token held by df repositories is worth."""
    return 1 / (1 + F.log2(1.0 + df))


def rrf(rank: Column, weight: Column | float = 1.0) -> Column:
    return weight / (RRF_K + rank)


def bm25(tf: Column, length: Column, mean_length: Column, df: Column, n: Column) -> Column:
    """BM25 of a weighted term frequency, k1 1.2 and b 0.75, with the idf floored just over zero."""
    idf = F.log((n - df + 0.5) / (df + 0.5))
    return F.when(idf <= 0, 1e-6).otherwise(idf) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length))


def fnv1a(text: Column) -> Column:
    """FNV-1a over UTF-16 code units as eight hex digits (equal to bytes for ASCII)."""
    units = F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(?s)...."), F.lit(0))
    step = lambda h, c: (h.bitwiseXOR(F.conv(c, 16, 10).cast("long")) * FNV_PRIME).bitwiseAND(F.lit(WORD32))
    return F.lower(F.lpad(F.hex(F.aggregate(units, F.lit(FNV_START).cast("long"), step)), 8, "0"))


def ip_hash(day: Column, ip: Column) -> Column:
    return F.sha2(F.concat(day, F.char(F.lit(0)), ip), 256)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """Cosine in double; 0 where a norm is 0; an error where lengths differ. Norms that are known need not be summed again."""
    norms = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in length")).cast("double")).when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def wait_seconds(attempt: Column, reset_in: Column, retry_after: Column) -> Column:
    """Seconds to wait out a rate limit: until the reset and five more, else a minute or more, growing; 15 minutes at most."""
    backoff = F.greatest(F.lit(60.0), F.coalesce(retry_after, 60 * F.pow(F.lit(2.0), attempt - 1)))
    return F.least(F.lit(900.0), F.when(reset_in.isNotNull(), reset_in + 5.0).otherwise(backoff))
