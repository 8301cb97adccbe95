"""A model's second look at the first results: bounded, in batches of like length, and without it where it fails."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.text import token_list

#: Results of a query that a model sees, passages of a result, and characters of a passage (fixed values).
DEPTH, PASSAGES, MOST_CHARS = 30, 2, 2048
#: Texts of one call, seconds that a call may take, calls in flight of one task.
BATCH, SECONDS, FLIGHT = 32, 10.0, 2
DIGITS = 9


@dataclass(frozen=True)
class Scorer:
    """A model of pairs: scores(queries, passages) gives a number for each. prefix stands before a query, as some models are trained."""

    scores: Callable[[list[str], list[str]], list[float]]
    prefix: str = ""


def _overlap(queries: list[str], passages: list[str]) -> list[float]:
    """The share of a query's tokens that the passage has: a stand-in that is the same everywhere."""
    out = []
    for q, p in zip(queries, passages):
        words, held = set(token_list(q)), set(token_list(p))
        out.append(len(words & held) / len(words) if words else 0.0)
    return out


OVERLAP = Scorer(_overlap)


def _answers(scorer: Scorer, queries: list[str], passages: list[str], batch: int, seconds: float, flight: int) -> list[float | None]:
    """The model's scores in calls of texts of like length; None for those of a call that failed, was late, or answered too few or no
    numbers."""
    order = sorted(range(len(passages)), key=lambda k: len(passages[k]))
    out: list[float | None] = [None] * len(passages)
    pool = ThreadPoolExecutor(flight)
    try:
        for i in range(0, len(order), batch * flight):
            calls = [order[j : j + batch] for j in range(i, min(i + batch * flight, len(order)), batch)]
            asked = [(c, pool.submit(scorer.scores, [scorer.prefix + queries[k] for k in c], [passages[k] for k in c])) for c in calls]
            for c, answer in asked:
                try:
                    found = [float(x) for x in answer.result(seconds)]
                except Exception:  # whatever a model raises, the first order stands
                    continue
                if len(found) == len(c) and all(x == x and abs(x) != float("inf") for x in found):
                    for k, x in zip(c, found):
                        out[k] = x
    finally:
        pool.shutdown(wait=False, cancel_futures=True)
    return out


def reranked(hits: DataFrame, passages: DataFrame, queries: DataFrame, scorer: Scorer = OVERLAP, depth: int = DEPTH, batch: int = BATCH, seconds: float = SECONDS, flight: int = FLIGHT, intent: Column | None = None) -> DataFrame:
    """query_id, id, position, rerank, degraded of hits(query_id, id, position) by queries(query_id, query) and
    passages(query_id, id, passage): the first depth of each query in the order of their best passage's score, the rest behind them as
    they were. intent is a column of hits that multiplies the score, for what a query asks for by name.

    A result without a passage scores 0. Where a passage of a query's window has no score, the query keeps its first order and says so
    (degraded). A task holds whole queries, depth times PASSAGES texts of each; ties keep their order.
    """
    rows = hits.select("query_id", "id", "position", (F.lit(1.0) if intent is None else intent).cast("double").alias("intent"))
    window = rows.where(F.col("position") <= depth)
    first = F.row_number().over(Window.partitionBy("query_id", "id").orderBy("passage"))
    texts = window.join(passages.select("query_id", "id", F.substring("passage", 1, MOST_CHARS).alias("passage")), ["query_id", "id"]).where("passage is not null")
    texts = texts.withColumn("n", first).where(F.col("n") <= PASSAGES).join(queries.select("query_id", "query"), "query_id").select("query_id", "id", F.coalesce("query", F.lit("")).alias("query"), "passage")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = _answers(scorer, list(pdf["query"]), list(pdf["passage"]), batch, seconds, flight)
            yield pd.DataFrame({"query_id": pdf["query_id"], "id": pdf["id"], "s": pd.array(found, "Float64").astype(float), "missing": [x is None for x in found]})

    of_query = rows.schema["query_id"].dataType.simpleString()
    scored = texts.repartition("query_id").mapInPandas(run, f"query_id {of_query}, id long, s double, missing boolean")
    best = scored.groupBy("query_id", "id").agg(F.max(F.when(~F.col("missing"), F.col("s"))).alias("s"), F.max("missing").alias("missing"))
    both = rows.join(best, ["query_id", "id"], "left")
    whole = Window.partitionBy("query_id")
    both = both.withColumn("degraded", F.max(F.coalesce("missing", F.lit(False))).over(whole))
    inside = F.col("position") <= depth
    both = both.withColumn("rerank", F.when(inside & ~F.col("degraded"), F.round(F.coalesce("s", F.lit(0.0)) * F.col("intent"), DIGITS)))
    order = Window.partitionBy("query_id").orderBy((~inside).cast("int"), F.desc_nulls_last("rerank"), "position")
    return both.select("query_id", "id", F.row_number().over(order).cast("long").alias("position"), "rerank", "degraded")
