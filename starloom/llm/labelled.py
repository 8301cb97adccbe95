"""Bounded samples of labelled rows, as classifiers take them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import crc_mod


def label_sample(labels: DataFrame, label_col: str, fold_mod: int, held_out: int, max_rows: int, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of at most about max_rows labelled rows outside the held-out fold, chosen by hash.

    Null ids and labels are left out; of rows that repeat an id with different labels the larger label counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("int").alias("label")).where("id is not null and label is not null").where(crc_mod(F.col("id"), fold_mod) != held_out)
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < int(1_000_000 * max_rows / n))
    return rows.groupBy("id").agg(F.max("label").alias("label"))
