"""Why a result is where it is, and what a search's stages took."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.scoring import star_prior
from starloom.operators.fusion import ARCHIVED


def explained(hits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """hits of a search with explain: JSON of the score, the fused rank, each leg's rank and weight, and every factor."""
    legs = F.struct(*(F.struct(F.col(f"rank_{k}").alias("rank"), F.lit(w).alias("weight")).alias(k) for k, w in weights.items()))
    factors = F.struct(F.col("boost").alias("name"), F.round(star_prior(F.col("stars")), 9).alias("stars"), F.when(F.col("archived"), ARCHIVED).otherwise(1.0).alias("archived"))
    return hits.withColumn("explain", F.to_json(F.struct("score", "rrf", legs.alias("legs"), factors.alias("factors"), "matched_by")))


class Stages:
    """The milliseconds of named stages of one search, as they run."""

    def __init__(self) -> None:
        self.took: dict[str, float] = {}

    @contextmanager
    def timed(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.took[name] = self.took.get(name, 0.0) + 1000 * (time.perf_counter() - began)

    def rows(self, spark: SparkSession, query_id: str) -> DataFrame:
        """query_id, stage, ms, a row for each stage."""
        return spark.createDataFrame([(query_id, k, v) for k, v in self.took.items()], "query_id string, stage string, ms double")
