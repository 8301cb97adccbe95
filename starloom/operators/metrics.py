"""Retrieval quality over graded query sets, all queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEPTH = 10


def query_metrics(ranked: DataFrame, grades: DataFrame, queries: DataFrame) -> DataFrame:
    """One row for each query: p5 (grade 1 or more), p5_strict (grade 2), r10 (null without grade 2),
    mrr (null without a hit), ndcg10, success3.

    ranked(query_id, id, rank), grades(query_id, id, grade), queries(query_id).
    """
    graded = grades.groupBy("query_id", "id").agg(F.max("grade").alias("grade"))
    hits = ranked.where(F.col("rank") <= DEPTH).join(graded, ["query_id", "id"], "left").withColumn("grade", F.coalesce("grade", F.lit(0)))
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    got = hits.groupBy("query_id").agg(
        F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") >= 1), 1).otherwise(0)).alias("h5"), F.sum(F.when((F.col("rank") <= 5) & (F.col("grade") == 2), 1).otherwise(0)).alias("s5"),
        F.sum(F.when(F.col("grade") == 2, 1).otherwise(0)).alias("s10"), F.min(F.when(F.col("grade") >= 1, F.col("rank"))).alias("first"),
        F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.max(F.when((F.col("rank") <= 3) & (F.col("grade") >= 1), 1).otherwise(0)).alias("success3"),
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade"), "id"))
    ideal = graded.withColumn("place", place).groupBy("query_id").agg(F.sum(F.when(F.col("place") <= DEPTH, gain(F.col("grade"), F.col("place")))).alias("idcg"), F.sum(F.when(F.col("grade") == 2, 1).otherwise(0)).alias("n2"))
    all_ = queries.select("query_id").join(got, "query_id", "left").join(ideal, "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return all_.select(
        "query_id", (zero("h5") / 5.0).alias("p5"), (zero("s5") / 5.0).alias("p5_strict"), F.when(F.col("n2") > 0, zero("s10") / F.col("n2")).alias("r10"),
        (1.0 / F.col("first")).alias("mrr"), F.when(F.col("idcg") > 0, zero("dcg") / F.col("idcg")).otherwise(0.0).alias("ndcg10"), zero("success3").cast("double").alias("success3"),
    )


def mean_metrics(metrics: DataFrame, by: str | None = None) -> DataFrame:
    """Means over queries, nulls left out; by class if given."""
    means = [F.avg(c).alias(c) for c in ("p5", "p5_strict", "r10", "mrr", "ndcg10", "success3")]
    return metrics.groupBy(by).agg(*means) if by else metrics.agg(*means)


def filter_precision(results: DataFrame, repos: DataFrame, asked: DataFrame) -> DataFrame:
    """query_id, hits, violations, precision of results(query_id, id) under asked(query_id, language): a hit of another language (none
    counts as unknown) violates its filter; queries without a filter have none."""
    known = repos.select("id", F.lower(F.coalesce("language", F.lit("unknown"))).alias("has"))
    rows = results.join(asked, "query_id").join(known, "id", "left")
    off = F.col("language").isNotNull() & (F.coalesce("has", F.lit("unknown")) != F.lower("language"))
    out = rows.groupBy("query_id").agg(F.count("*").alias("hits"), F.sum(off.cast("long")).alias("violations"))
    return out.withColumn("precision", 1 - F.col("violations") / F.col("hits"))


def ablation(runs: dict[str, DataFrame], grades: DataFrame, queries: DataFrame) -> DataFrame:
    """The query metrics of several runs (say with and without boosts) side by side, with a column run."""
    out = None
    for name, ranked in runs.items():
        part = query_metrics(ranked, grades, queries).withColumn("run", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def orphans(grades: DataFrame, repos: DataFrame) -> DataFrame:
    """Graded ids that the corpus does not have."""
    return grades.join(repos.select("id"), "id", "left_anti")


def text_statistics(repos: DataFrame) -> DataFrame:
    """Of readme lengths: n, mean, max, median and the value at index floor(0.9 n) of the sorted lengths."""
    n = F.length("readme").alias("n")
    place = F.row_number().over(Window.orderBy("c_n"))
    counts = repos.where("readme is not null").select(n).groupBy("n").agg(F.count("*").alias("c")).withColumnRenamed("n", "c_n")  # distinct lengths only
    upto = counts.withColumn("upto", F.sum("c").over(Window.orderBy("c_n"))).withColumn("place", place)
    total = upto.agg(F.sum("c").alias("total"))
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("c_n")))
    joined = upto.crossJoin(F.broadcast(total))  # one row
    t = F.col("total")
    return joined.agg(F.max("total").alias("n"), (F.sum(F.col("c_n") * F.col("c")) / F.max("total")).alias("mean"), F.max("c_n").alias("longest"), ((at(F.floor((t - 1) / 2)) + at(F.floor(t / 2))) / 2.0).alias("median"), at(F.floor(t * 0.9)).alias("p90"))
