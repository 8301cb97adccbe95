"""Facets that leave out their own selection, and collections that make themselves, each in one pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days that count as recent, how many languages and topics have a collection, and the stars of a well-known repository (fixed values).
RECENT_DAYS, LANGUAGES, TOPICS, KNOWN = 90, 8, 12, 1000


def facets(repos: DataFrame, selected: dict[str, Column], values: dict[str, Column]) -> DataFrame:
    """facet, value, n: how many repositories each value of a facet would leave. values has a column for each facet (an array for one
    with many values), selected the condition of those that have a selection; a facet is counted under the conditions of all others.

    One pass: a row says once for each facet whether the others let it through, and goes into the groups of its values. Null values
    are none.
    """
    flags = repos.select(*(F.coalesce(c, F.lit(False)).alias(f"is_{k}") for k, c in selected.items()), *(c.alias(f"of_{k}") for k, c in values.items()))
    struct = lambda k: lambda v: F.struct(F.lit(k).alias("facet"), v.cast("string").alias("value"))
    parts = []
    for k in values:
        others = F.lit(True)
        for other in selected:
            if other != k:
                others = others & F.col(f"is_{other}")
        array = F.col(f"of_{k}") if flags.schema[f"of_{k}"].dataType.typeName() == "array" else F.array(f"of_{k}")
        named = F.transform(F.array_distinct(F.array_compact(array)), struct(k))
        parts.append(F.when(others, named).otherwise(F.array().cast("array<struct<facet:string,value:string>>")))
    return flags.select(F.explode(F.concat(*parts)).alias("x")).groupBy("x.facet", "x.value").agg(F.count("*").alias("n"))


def collections(repos: DataFrame, now: Column, languages: int = LANGUAGES, topics: int = TOPICS) -> DataFrame:
    """kind, key, repo_id: the members of recent, language, topic, known and archived collections of repos(id, language, topics, stars,
    archived, starred_at). The languages and topics with most repositories have one, ties by name; case makes no difference.

    A row names its collections once; those that exist are the first few of small counts, so only what is in them is kept. No group
    is a list.
    """
    age = F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("starred_at"))
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.cast("string").alias("key"))
    fixed = F.array(F.when(age <= RECENT_DAYS * 86_400, key("recent", F.lit(""))), F.when(F.col("stars") >= KNOWN, key("known", F.lit(""))), F.when(F.col("archived") & (F.col("stars") >= KNOWN), key("archived", F.lit(""))), F.when(F.col("language") != "", key("language", F.lower("language"))))
    named = F.transform(F.array_distinct(F.transform(F.array_compact("topics"), F.lower)), lambda t: key("topic", t))
    rows = repos.select(F.col("id").alias("repo_id"), F.explode(F.concat(F.array_compact(fixed), F.coalesce(named, F.array().cast("array<struct<kind:string,key:string>>")))).alias("c")).select("repo_id", "c.*")
    place = F.row_number().over(Window.partitionBy("kind").orderBy(F.desc("n"), "key"))
    most = F.when(F.col("kind") == "language", languages).when(F.col("kind") == "topic", topics).otherwise(1)
    first = rows.groupBy("kind", "key").agg(F.count("*").alias("n")).withColumn("place", place).where(F.col("place") <= F.lit(max(languages, topics))).where(F.col("place") <= most)
    return rows.join(F.broadcast(first.select("kind", "key")), ["kind", "key"], "left_semi").select("kind", "key", "repo_id")  # a few dozen rows
