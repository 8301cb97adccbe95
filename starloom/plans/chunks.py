"""Retrieval in two steps: chunks are found, and their repositories ranked by the best of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.markdown import markdown_chunks
from starloom.operators.index import SearchIndex
from starloom.operators.legs import DIGITS, any_leg

#: The share of the second chunk, chunks of a repository that count, damping by the number of its chunks (fixed values).
SECOND, MOST, DAMPING = 0.3, 2, 0.03
#: Chunks of one repository at most: a chunk's id is its repository's, times this, plus its number.
NUMBERS = 1 << 20


def roll_up(hits: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank of hits(query_id, id, score): repositories by their best chunk and a share of the next one, damped by
    counts(id, chunks). Repositories without a count are not damped. Ties rank by id."""
    best = F.row_number().over(Window.partitionBy("query_id", "id").orderBy(F.desc("score")))
    two = hits.select("query_id", "id", "score", best.alias("place")).where(F.col("place") <= MOST)
    worth = two.groupBy("query_id", "id").agg(F.sum(F.when(F.col("place") == 1, F.col("score")).otherwise(SECOND * F.col("score"))).alias("worth"))
    damped = worth.join(counts.select("id", "chunks"), "id", "left").withColumn("score", F.round(F.col("worth") / (1 + DAMPING * F.log(F.coalesce("chunks", F.lit(0)) + 1)), DIGITS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return damped.select("query_id", "id", "score", rank.cast("long").alias("rank")).where(F.col("rank") <= k)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunks in the shape of documents to index; the heading is the description."""
    none = F.lit("")
    return chunks.select((F.col("id") * NUMBERS + F.col("n")).alias("id"), none.alias("full_name"), F.col("heading").alias("description"), F.array().cast("array<string>").alias("topics"), F.col("body").alias("readme"))


def chunk_index(repos: DataFrame, path: str | None = None, **options) -> SearchIndex:
    """An index of the chunks of the repositories' readmes."""
    return SearchIndex.build(chunk_rows(markdown_chunks(repos)), path, **options)


def chunk_search(index: SearchIndex, terms: list[str], k: int, width: int = 50) -> DataFrame:
    """query_id, id, score, rank: the k best repositories by the width best chunks for any of the terms. Every task keeps its best chunks, so
    what is moved does not grow with the hits; chunks are counted for the repositories found only."""
    top = any_leg(index, terms, width).select(F.lit(0).alias("query_id"), F.floor(F.col("id") / NUMBERS).alias("id"), "score")
    few = top.select("id").distinct()  # width at most
    held = index.lengths().select(F.floor(F.col("id") / NUMBERS).alias("id")).join(F.broadcast(few), "id", "left_semi")
    return roll_up(top, held.groupBy("id").agg(F.count("*").alias("chunks")), k)
