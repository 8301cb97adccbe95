"""Columns for people: marks, short numbers and dates, phases, command matching, query strings."""

from __future__ import annotations

import re
import unicodedata
from urllib.parse import urlencode

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from starloom.functions.text import RUN, one_line

#: Points of a command matcher (fixed values).
EXACT, PREFIX, TOKEN, LABEL = 10_000, 2_000, (100, 80, 60, 20), 25


def lab_tokens(text: Column) -> Column:
    """Lower-case tokens that keep joining marks inside, as names of packages have them."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[._/+#@:-]+[\p{L}\p{N}]+)*"), F.lit(0))


def highlighted(text: Column, terms: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """One line with every whole-word match of a term marked."""
    words = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True) if t)
    return F.regexp_replace(one_line(text), rf"(?i)(?<![\p{{L}}\p{{N}}])({words})(?![\p{{L}}\p{{N}}])", f"{before}$1{after}") if words else one_line(text)


def marked_snippet(text: Column, terms: list[str], size: int = 20, before: str = "<mark>", after: str = "</mark>") -> Column:
    """About size words of the text around its first match, with every match of a term marked and an ellipsis where it is cut; the
    text's beginning without a match. Whole words are cut out before they are marked, so no mark is cut."""
    words = F.split(one_line(text), " ")
    asked = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True) if t)
    hit = rf"(?i)(?<![\p{{L}}\p{{N}}])({asked})(?![\p{{L}}\p{{N}}])"
    at = F.array_position(F.transform(words, lambda w: w.rlike(hit)), True) if asked else F.lit(0)
    start = F.greatest(F.least(at - size // 4, F.size(words) - size + 1), F.lit(1)).cast("int")
    piece = F.array_join(F.slice(words, start, size), " ")
    piece = F.regexp_replace(piece, hit, f"{before}$1{after}") if asked else piece
    return F.concat(F.when(start > 1, F.lit("… ")).otherwise(F.lit("")), piece, F.when(start + size <= F.size(words), F.lit(" …")).otherwise(F.lit("")))


def compact(n: Column) -> Column:
    """1234 as 1.2k, 2500000 as 2.5M."""
    short = lambda d, unit: F.concat(F.regexp_replace(F.format_string("%.1f", F.floor(n / d * 10) / 10), r"\.0$", ""), F.lit(unit))
    return F.when(n >= 1_000_000, short(1e6, "M")).when(n >= 1_000, short(1e3, "k")).otherwise(n.cast("string"))


def ago(at: Column, now: Column) -> Column:
    """How long ago, in the largest whole unit; null for no date."""
    s = F.unix_timestamp(now) - F.unix_timestamp(at)
    out = F.when(s < 60, F.lit("just now"))
    for limit, size, unit in ((3600, 60, "m"), (86_400, 3600, "h"), (30 * 86_400, 86_400, "d"), (365 * 86_400, 30 * 86_400, "mo")):
        out = out.when(s < limit, F.concat(F.floor(s / size).cast("string"), F.lit(f"{unit} ago")))
    return F.when(s.isNotNull(), out.otherwise(F.concat(F.floor(s / (365 * 86_400)).cast("string"), F.lit("y ago"))))


def percent(part: Column, whole: Column) -> Column:
    return F.concat(F.round(100 * F.least(F.lit(1.0), F.coalesce(F.try_divide(part, whole), F.lit(0.0)))).cast("int").cast("string"), F.lit("%"))


def phase_progress(phase: Column, done: Column, total: Column) -> Column:
    """A run's progress from 0 to 1: listing is the first fifth, fetching the next half, embedding the rest."""
    part = F.least(F.lit(1.0), F.coalesce(F.try_divide(done, total), F.lit(0.0)))
    return F.when(phase == "listing", 0.2 * part).when(phase == "fetching-readmes", 0.2 + 0.5 * part).when(phase == "embedding", 0.7 + 0.3 * part).when(phase == "ready", 1.0).otherwise(0.0)


def freshness(synced: Column, now: Column) -> Column:
    days = (F.unix_timestamp(now) - F.unix_timestamp(synced)) / 86_400
    return F.when(synced.isNull(), "never").when(days < 1, "fresh").when(days < 7, "aging").otherwise("stale")


def bare(text: str) -> str:
    """A text without the marks on its letters, in whatever script."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@F.pandas_udf(StringType())
def unmarked(text: pd.Series) -> pd.Series:
    """bare() of a column; there is no built-in decomposition."""
    return text.map(bare, na_action="ignore")


def command_score(label: Column, keywords: Column, typed: str) -> Column:
    """Points of a command for what is typed; null unless every typed token matches somewhere."""
    words = [w for w in re.findall(r"\w+", bare(typed.lower()))]
    flat = lambda c: F.trim(unmarked(F.lower(c)))
    name, extra = flat(label), flat(F.array_join(keywords, " "))
    parts = lambda c: F.regexp_extract_all(c, F.lit(RUN), F.lit(0))

    def tier(c: Column, w: str) -> Column:
        p = parts(c)
        return F.when(F.array_contains(p, w), TOKEN[0]).when(F.exists(p, lambda x: x.startswith(w)), TOKEN[1]).when(F.contains(c, F.lit(w)), TOKEN[2]).when(F.contains(F.regexp_replace(c, r"\s", ""), F.lit(w)), TOKEN[3])

    total = F.lit(0)
    for w in words:
        total = total + F.greatest(tier(name, w) + LABEL, tier(extra, w))
    whole = " ".join(words)
    return total + F.when(name == whole, EXACT).when(name.startswith(whole), PREFIX).otherwise(0)


def query_string(params: dict) -> str:
    """Parameters as a query string: lists repeat their key, blanks are left out."""
    pairs = [(k, str(x).lower() if isinstance(x, bool) else x) for k, v in params.items() for x in (v if isinstance(v, (list, tuple)) else [v])]
    return urlencode([(k, v) for k, v in pairs if v is not None and str(v).strip() != ""])
