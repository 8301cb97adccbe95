"""The corpus pipeline: quality, near duplicates, secrets, mixture, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; run() writes each
stage's rows to the shared folder and reads them again for the next. All but the last keep the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.llm.common import BROADCAST_KEYS, dropped, free_names, staged, table
from starloom.llm.jaccard_join import jaccard_join
from starloom.llm.mixing import mixed_documents
from starloom.llm.packing import best_fit_packing
from starloom.llm.quality import keep_good
from starloom.llm.secret_scan import redact_secrets


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the Bradley-Terry classifier accepts."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id (null last) of each group of near copies (five words, similarity 0.8).

    Rows are told apart by a 64-bit hash of id and text: a null id, or an id that several texts share, is a row like
    others. Of rows that are equal in both, one stays. Texts without words are nobody's copies: all stay.
    """
    key, of, gone_key, twice_key = free_names(docs, "row_key", "first_key", "gone_key", "twice_key")
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").isNull(), "doc_id", "text"))
    found = staged(jaccard_join(keyed, id_col=key, width=5, similarity_pct=80).where("n_shingles > 0").select(key, "component_id"), "groups")
    ids = keyed.select(key, "doc_id").distinct()
    members = staged(found.distinct().join(ids, key), "members")
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", key)).alias("f")).select(F.col("f")[key].alias(of))
    gone = staged(members.join(first, F.col(key) == F.col(of), "left_anti").select(F.col(key).alias(gone_key)), "copies")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_KEYS else gone
    kept = keyed.join(gone, F.col(key) == F.col(gone_key), "left_anti")
    twice = found.groupBy(key).count().where("count > 1").select(F.col(key).alias(twice_key))
    if twice.isEmpty():
        return kept.select(*docs.columns)
    one = kept.join(twice, F.col(key) == F.col(twice_key), "left_semi").dropDuplicates([key])
    return kept.join(twice, F.col(key) == F.col(twice_key), "left_anti").unionByName(one).select(*docs.columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with the secrets that the forest confirms masked."""
    return redact_secrets(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by source in the weights 1, 2, 3, as often as the mix takes them."""
    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences."""
    return best_fit_packing(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mixture", mixture), ("packing", packing)]

#: Trained models decide, so no SQL gives these rows; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        made = stage(spark, docs, sf_dir)
        docs = staged(made, name)
        dropped(made)  # the rows of the stage before and what this one wrote besides
    return STAGES[-1][1](spark, docs, sf_dir)
