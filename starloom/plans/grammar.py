"""What a query says with quotes and minus signs, and its plan over an index."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.text import index_words
from starloom.operators.index import SearchIndex
from starloom.operators.legs import among, scored, top
from starloom.sources.staging import staged

#: Characters and words of a query that are read (fixed values).
MOST_CHARS, MOST_WORDS = 512, 64


@dataclass(frozen=True)
class Parsed:
    """Words and phrases that must be there, those that must not, whether a phrase was quoted, and whether the query was cut."""

    must: tuple[str, ...] = ()
    never: tuple[str, ...] = ()
    quoted: bool = False
    truncated: bool = False

    @property
    def strict(self) -> bool:
        """Whether the query asks for just this: then fewer words are no answer."""
        return self.quoted or bool(self.never)


def parse(text: str) -> Parsed:
    """A query as it is typed. A part in quotes is a phrase, a minus before a word or quote takes it out; behind a quote that does not
    end, all is a phrase; signs without words say nothing. Never an error."""
    clean = "".join(" " if unicodedata.category(c) == "Cc" else c for c in unicodedata.normalize("NFC", text or ""))
    cut = clean[:MOST_CHARS]
    must, never, quoted, words, at = [], [], False, 0, 0
    while at < len(cut) and words < MOST_WORDS:
        if cut[at].isspace():
            at += 1
            continue
        minus = cut[at] == "-"
        at += minus
        if cut[at : at + 1] == '"':
            end = cut.find('"', at + 1)
            part, at = (cut[at + 1 :], len(cut)) if end < 0 else (cut[at + 1 : end], end + 1)
            phrase = True
        else:
            end = at
            while end < len(cut) and not cut[end].isspace() and cut[end] != '"':
                end += 1
            part, at, phrase = cut[at:end], end, False
        said = index_words(part)[: MOST_WORDS - words]
        if not said:
            continue
        words += len(said)
        quoted |= phrase
        (never if minus else must).append(" ".join(said))
    return Parsed(tuple(dict.fromkeys(must)), tuple(dict.fromkeys(never)), quoted, len(clean) > len(cut) or bool(cut[at:].strip()))


def boolean_leg(index: SearchIndex, query: Parsed, k: int, candidates: DataFrame | None = None) -> DataFrame:
    """id, score, rank, fallback: documents with all that must be there and nothing that must not, best first. Where none has all of
    it and the query is not strict, those with any of it (fallback 'or'). A query that only takes out leaves the rest at score 0.

    Reads the buckets of the query's words only; what is taken out is an anti-join with the rows of its words. The one count that
    decides on the fallback is part of the plan.
    """
    hits = among(scored(index.matches(list(query.must)), index.stats(), index.dfs(list(query.must))), candidates) if query.must else None
    if hits is None:
        every = index.lengths() if query.never else index.lengths().limit(0)
        hits = among(every.select("id", F.lit(0).cast("long").alias("n_terms"), F.lit(0.0).alias("score")), candidates)
    if query.never:
        hits = hits.join(index.matches(list(query.never)).select("id").distinct(), "id", "left_anti")
    if not query.must or len(query.must) == 1:
        return top(hits.select("id", "score"), k).withColumn("fallback", F.lit(None).cast("string"))
    whole = F.col("n_terms") == len(query.must)
    if query.strict:
        return top(hits.where(whole).select("id", "score"), k).withColumn("fallback", F.lit(None).cast("string"))
    hits = staged(hits, "hits")
    some = hits.where(whole).limit(1).agg((F.count("*") > 0).alias("some"))
    kept = hits.crossJoin(F.broadcast(some)).where(~F.col("some") | whole)  # one row
    return top(kept.select("id", "score"), k).crossJoin(F.broadcast(some)).select("id", "score", "rank", F.when(~F.col("some"), "or").alias("fallback"))


def without_named(candidates: DataFrame, query: Parsed) -> DataFrame:
    """Candidates for search by meaning: those whose name, description or topics have a word that must not be there go. Readmes are
    not looked at."""
    text = F.lower(F.concat_ws(" ", "full_name", "description", F.array_join("topics", " ")))
    words = F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " "), F.lit(" "))
    for part in query.never:
        candidates = candidates.where(~F.contains(words, F.lit(f" {part} ")))
    return candidates


def meant(query: Parsed) -> str:
    """The text that a model embeds: what must be there."""
    return " ".join(query.must)
