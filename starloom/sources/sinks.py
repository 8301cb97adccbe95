"""Writing: versioned tables behind a pointer, the index build, results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from starloom.operators.index import SearchIndex
from starloom.operators.metrics import text_statistics
from starloom.sources.blobs import write_vectors


def versions(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema("version long, at timestamp").json(f"{path}/_pointer")
    except AnalysisException:
        return None


def publish(df: DataFrame, path: str, partition_by: str | None = None) -> int:
    """Writes df as the table's next version, then adds a pointer to it. A reader sees the old version or the new
    one, never part of one; a failed write leaves the pointer alone."""
    spark = df.sparkSession
    old = versions(spark, path)
    last = old.agg(F.max("version")).first()[0] if old is not None else None
    version = (last or 0) + 1
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(f"{path}/v{version}")
    spark.range(1).select(F.lit(version).cast("long").alias("version"), F.current_timestamp().alias("at")).coalesce(1).write.mode("append").json(f"{path}/_pointer")
    return version


def current(spark: SparkSession, path: str) -> DataFrame:
    """The published version of a table."""
    found = versions(spark, path)
    if found is None:
        raise FileNotFoundError(path)
    return spark.read.parquet(f"{path}/v{found.agg(F.max('version')).first()[0]}")


def build_index(repos: DataFrame, path: str, buckets: int | None = None, vectors: DataFrame | None = None) -> SearchIndex:
    """The search tables of a corpus: a stemmed index and a plain one beside it, its vectors, and a report on its texts. Returns the
    stemmed index."""
    index = SearchIndex.build(repos, f"{path}/stemmed", buckets)
    SearchIndex.build(repos, f"{path}/plain", buckets, stemmed=False)
    if vectors is not None:
        write_vectors(vectors, f"{path}/vectors")
    write_json(text_statistics(repos), f"{path}/report")
    return index


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
