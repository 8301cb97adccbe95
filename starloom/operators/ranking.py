"""Explicit orders, pages, newest-first windows, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.text import snippet


def moment(text: str | Column) -> Column:
    """A timestamp of an ISO string; null if it cannot be read."""
    return F.try_to_timestamp(F.col(text) if isinstance(text, str) else text)


def order_by(sort: str) -> list[Column]:
    """Keys of a named order; dates that cannot be read go last."""
    starred = moment("starred_at").desc_nulls_last()
    first = {"stars": [F.desc("stars")], "starred": [], "pushed": [moment("pushed_at").desc_nulls_last()], "relevance": [F.desc("score"), F.desc("stars")]}[sort]
    return [*first, F.col("id")] if sort == "relevance" else [*first, starred, F.col("id")]


def page(hits: DataFrame, sort: str, offset: int = 0, limit: int = 20) -> DataFrame:
    """One page of hits with its positions from offset + 1; a top-k plan, not a full sort."""
    keys = order_by(sort)
    cut = hits.orderBy(*keys).limit(offset + limit)
    return cut.withColumn("position", F.row_number().over(Window.orderBy(*keys)).cast("long")).where(F.col("position") > offset)


def with_snippets(rows: DataFrame, repos: DataFrame, terms: list[str], most: int = 10) -> DataFrame:
    """A page with snippets; readmes are fetched for its first rows only."""
    text = repos.select(F.col("id").alias("text_id"), "readme")
    joined = rows.drop("readme").join(text, (F.col("id") == F.col("text_id")) & (F.col("position") <= most), "left")
    return joined.withColumn("snippet", snippet(F.col("readme"), F.col("description"), terms)).drop("readme", "text_id")


def newest(rows: DataFrame, n: int, at: str = "starred_at", tie: str = "id") -> DataFrame:
    """The n newest rows, null dates last, ties by id."""
    keys = [F.col(at).desc_nulls_last(), F.col(tie)]
    return rows.orderBy(*keys).limit(n).withColumn("place", F.row_number().over(Window.orderBy(*keys)).cast("long"))


def batches(rows: DataFrame, size: int) -> DataFrame:
    """Consecutive batches of size rows by place, from 0."""
    return rows.withColumn("batch", F.floor((F.col("place") - 1) / size))


def rank_by_score(scores: DataFrame, *partition: str) -> DataFrame:
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(*partition).orderBy(F.desc("score"), "id")).cast("long"))
