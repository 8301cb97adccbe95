"""Evaluation that can say no: runs against a stored baseline, by resampling the queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Resamples of the queries, and the share of them that must be worse for a regression.
RESAMPLES, SURE = 200, 0.95
#: Upper ends of Poisson(1), in millionths: how often a resample draws a query.
_POISSON = (367_879, 735_759, 919_699, 981_012, 996_340, 999_406)
DIGITS = 9


def weight(query_id, resample):
    """How often a resample draws a query: Poisson(1) by a hash of both, so any task and any run agrees."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", query_id.cast("string"), resample.cast("string"))), 1, 8), 16, 10).cast("long") % 1_000_000
    return reduce(lambda out, end: out + F.when(u >= end, 1).otherwise(0), _POISSON, F.lit(0))


def gated(metrics: DataFrame, baseline: DataFrame, names: list[str], tolerance: float = 0.0, resamples: int = RESAMPLES, sure: float = SURE) -> DataFrame:
    """metric, queries, base, now, worse, passed of metrics(query_id, names...) and a baseline alike: for each metric the means over the
    queries that both have a number for, the share of resamples in which it falls by more than tolerance, and whether that stays
    under sure. Every query is drawn into both sides of a resample, so what is hard for both does not count.

    Queries times resamples rows are made and summed in every task; without a common query there is nothing to compare and all passes.
    """
    long = lambda df, as_: df.select("query_id", F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(as_)) for n in names))).alias("x")).select("query_id", "x.*")
    both = long(metrics, "now").join(long(baseline, "base"), ["query_id", "metric"]).where("now is not null and base is not null")
    drawn = both.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1)))).withColumn("w", weight(F.col("query_id"), F.col("b")))
    of = drawn.groupBy("metric", "b").agg((F.sum(F.col("w") * (F.col("now") - F.col("base"))) / F.sum("w")).alias("change"))
    worse = of.groupBy("metric").agg(F.avg(F.when(F.round("change", DIGITS) < -tolerance, 1.0).otherwise(0.0)).alias("worse"))
    means = both.groupBy("metric").agg(F.count("*").alias("queries"), F.avg("base").alias("base"), F.avg("now").alias("now"))
    every = metrics.sparkSession.createDataFrame([(n,) for n in names], "metric string")
    out = every.join(means, "metric", "left").join(worse, "metric", "left")
    return out.select("metric", F.coalesce("queries", F.lit(0)).alias("queries"), "base", "now", F.coalesce("worse", F.lit(0.0)).alias("worse"), (F.coalesce("worse", F.lit(0.0)) < sure).alias("passed"))


def latency(timings: DataFrame, limits: dict[str, float]) -> DataFrame:
    """stage, queries, p50, p95, limit, passed of timings(query_id, stage, ms) against the most milliseconds of each stage at p95; stages
    without a limit pass."""
    at = F.percentile("ms", F.array(F.lit(0.5), F.lit(0.95)))
    most = F.create_map(*(F.lit(x) for kv in limits.items() for x in kv)) if limits else F.lit(None).cast("map<string,double>")
    out = timings.groupBy("stage").agg(F.count("*").alias("queries"), at.alias("p")).select("stage", "queries", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.try_element_at(most, F.col("stage")).cast("double").alias("limit"))
    return out.withColumn("passed", F.coalesce(F.col("p95") <= F.col("limit"), F.lit(True)))
