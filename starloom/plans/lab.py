"""The lab profile of search: its own weights, fallback, fusion and boosts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.display import marked_snippet
from starloom.operators.filters import lab_predicate
from starloom.operators.fusion import fuse_ranks, lab_boost, union_legs
from starloom.operators.index import LAB_WEIGHTS, SearchIndex
from starloom.operators.legs import DIGITS, among, enough_or_all, scored, top, trigram_leg, vector_leg
from starloom.plans.lexicon import LAB_CONCEPTS
from starloom.plans.query import expand, tokenize


def lab_keyword(index: SearchIndex, repos: DataFrame, words: list[str], k: int, found: DataFrame, expansion: bool = False, concepts: dict = LAB_CONCEPTS) -> DataFrame:
    """All terms, any term only if nothing has all; expansion merged by rank inside the leg; trigrams if still nothing."""
    hits = among(scored(index.matches(words, LAB_WEIGHTS), index.stats()), found)
    leg = top(enough_or_all(hits, len(words), 1).select("id", "score"), k)
    more = expand(words, concepts, None).terms if expansion else []
    if more:
        wide = top(among(scored(index.matches(more, LAB_WEIGHTS), index.stats()), found).select("id", "score"), k)
        merged = fuse_ranks(union_legs({"keyword": leg, "expanded": wide}), {"keyword": 1.0, "expanded": 1.0})
        leg = top(merged.select("id", F.round("rrf", DIGITS).alias("score")), k)
    rescue = among(trigram_leg(index, repos, " ".join(words)), found).select("id", F.lit(0.0).alias("score"))
    none = leg.limit(1).agg((F.count("*") == 0).alias("none"))
    return leg.unionByName(top(rescue.crossJoin(F.broadcast(none)).where("none").select("id", "score"), k))  # one row


def lab_search(index: SearchIndex, repos: DataFrame, q: str, mode: str = "hybrid", limit: int = 10, vectors: DataFrame | None = None, vector: list[float] | None = None, boost: bool = True, pushed: Column | None = None, now: Column | None = None, concepts: dict = LAB_CONCEPTS, **filters) -> DataFrame:
    """position, id, base, score, lex_rank, sem_rank, snippet. mode: keyword, semantic, hybrid or hybrid+expand."""
    found, words = repos.where(lab_predicate(**filters)), tokenize(q)
    legs = {}
    if mode != "semantic":
        legs["keyword"] = lab_keyword(index, repos, list(dict.fromkeys(words)), 50, found, mode == "hybrid+expand", concepts)
    if mode != "keyword" and vectors is not None and vector is not None:
        legs["semantic"] = vector_leg(vectors, vector, 50, found, normalised=True)
    fused = fuse_ranks(union_legs(legs), {"keyword": 1.0, "semantic": 1.0})
    hits = found.join(fused, "id").withColumn("factor", lab_boost(words, F.col("name"), F.col("stars"), F.col("archived"), pushed, now) if boost else F.lit(1.0))
    score = F.round(F.col("rrf") * F.col("factor"), DIGITS)
    order = [F.desc("score"), F.desc("rrf"), F.col("id")]
    best = hits.withColumn("score", score).orderBy(*order).limit(limit).withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long"))
    return best.select("position", "id", F.col("rrf").alias("base"), "score", F.col("rank_keyword").alias("lex_rank"), F.col("rank_semantic").alias("sem_rank"), marked_snippet(F.col("readme"), words).alias("snippet"))


def pooled(runs: dict[str, DataFrame], most: int = 20) -> DataFrame:
    """id, modes, lex, sem: the first most rows of every mode's lab_search in one pool, with what found each (place and mode) and its
    best rank in either leg."""
    out = None
    for mode, df in runs.items():
        part = df.where(F.col("position") <= most).select("id", F.struct(F.lit(mode).alias("mode"), "position").alias("found"), "lex_rank", "sem_rank")
        out = part if out is None else out.unionByName(part)
    modes = F.transform(F.sort_array(F.collect_list("found")), lambda x: F.concat(F.lit("#"), x["position"].cast("string"), F.lit(" "), x["mode"]))
    return out.groupBy("id").agg(modes.alias("modes"), F.min("lex_rank").alias("lex"), F.min("sem_rank").alias("sem"))
