"""Vector blobs: a 12-byte header ("SW", version 1, 0, count, dimensions; little-endian) and float32 rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

MAGIC, VERSION = b"SW", 1


def encode(rows: np.ndarray) -> bytes:
    rows = np.asarray(rows, dtype="<f4")
    rows = rows if rows.ndim == 2 else rows.reshape(0, 0)
    return MAGIC + bytes([VERSION, 0]) + np.array(rows.shape, dtype="<u4").tobytes() + rows.tobytes()


def decode(blob: bytes) -> np.ndarray:
    if len(blob) < 12:
        raise ValueError("a vector blob has a header of 12 bytes")
    if blob[:2] != MAGIC:
        raise ValueError("not a vector blob")
    if blob[2] != VERSION:
        raise ValueError(f"vector blob of version {blob[2]}")
    count, dims = np.frombuffer(blob, "<u4", 2, 4)
    if len(blob) != 12 + 4 * int(count) * int(dims):
        raise ValueError("the length of a vector blob does not fit its header")
    return np.frombuffer(blob, "<f4", offset=12).reshape(int(count), int(dims))


@F.pandas_udf(ArrayType(ArrayType(FloatType())))
def decoded(blobs: pd.Series) -> pd.Series:
    return blobs.map(lambda b: None if b is None else decode(bytes(b)).tolist())


@F.pandas_udf(BinaryType())
def encoded(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else encode(np.array([np.asarray(x, dtype="<f4") for x in v])))


def read_vectors(blobs: DataFrame) -> DataFrame:
    """id, vector of blobs(blob, ids); a blob whose ids do not fit its count gives nothing (unfit_blobs names it)."""
    both = blobs.select("ids", decoded("blob").alias("v")).where(F.size("ids") == F.size("v"))
    return both.select(F.inline(F.arrays_zip("ids", "v"))).toDF("id", "vector")


def problem(blob: bytes | None, n_ids: int | None) -> str | None:
    """What is wrong with a blob and the number of its ids, from its header and length alone."""
    if blob is None or n_ids is None:
        return "no blob" if blob is None else "no ids"
    try:
        count = len(decode(bytes(blob)))
    except ValueError as e:
        return str(e)
    return None if count == n_ids else f"{count} vectors for {n_ids} ids"


def unfit_blobs(blobs: DataFrame) -> DataFrame:
    """blobs(blob, ids, ...) that cannot be read, or whose ids do not fit, with why (error); the blob itself is left out."""

    @F.pandas_udf("string")
    def why(blob: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([problem(b, None if n_ids is None or n_ids != n_ids else int(n_ids)) for b, n_ids in zip(blob, n)], dtype=object)

    n = F.when(F.col("ids").isNotNull(), F.size("ids"))
    return blobs.withColumn("error", why("blob", n)).where("error is not null").drop("blob")


def in_parts(vectors: DataFrame, part: int = 5000) -> DataFrame:
    """part, ids, blob of vectors(id, vector): blobs of about part vectors each, in the order of ids, so that no task and no blob holds more
    than its own."""
    n = max(1, -(-vectors.count() // part))
    rows = vectors.select("id", "vector").repartitionByRange(n, "id")
    made = rows.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("id", "vector"))).alias("rows"))
    return made.select("part", F.col("rows.id").alias("ids"), encoded(F.col("rows.vector")).alias("blob"))


def write_vectors(vectors: DataFrame, path: str) -> None:
    """The native form: a row for each vector, so a reader prunes and splits."""
    vectors.select("id", "vector").write.mode("overwrite").parquet(path)
