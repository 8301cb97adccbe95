"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from starloom.llm.collocations import collocations, collocations_sql
from starloom.llm.common import table
from starloom.llm.html_text import extract_text
from starloom.llm.jaccard_join import jaccard_join, jaccard_sql
from starloom.llm.line_rules import line_rules, line_rules_sql
from starloom.llm.masked_lm import masked_scores
from starloom.llm.mixing import mix_sql, pareto_mix
from starloom.llm.packing import best_fit_packing
from starloom.llm.quality import quality_scores
from starloom.llm.secret_scan import scan_secrets
from starloom.llm.source_audit import audit_sql, source_audit
from starloom.llm.suffix_dedup import repeats, repeats_sql
from starloom.llm.toxicity import toxicity_scores
from starloom.llm.vector_graph import near_vectors, vectors_sql


def op1_quality_bradley_terry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op3_vector_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op4_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"))


def op5_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules(table(spark, sf_dir, "documents"))


def op6_toxicity_boosted_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pareto_mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).drop("class_id")


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def op10_masked_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masked_scores(table(spark, sf_dir, "documents"))


def op11_suffix_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(table(spark, sf_dir, "documents"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_bradley_terry": op1_quality_bradley_terry,
    "op2_html_main_text": op2_html_main_text,
    "op3_vector_graph": op3_vector_graph,
    "op4_secret_forest": op4_secret_forest,
    "op5_line_frequency_rules": op5_line_frequency_rules,
    "op6_toxicity_boosted_trees": op6_toxicity_boosted_trees,
    "op7_pareto_mix": op7_pareto_mix,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_best_fit_packing": op9_best_fit_packing,
    "op10_masked_lm_scores": op10_masked_lm_scores,
    "op11_suffix_buckets": op11_suffix_buckets,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL = {
    "op3_vector_graph": vectors_sql(),
    "op5_line_frequency_rules": line_rules_sql(),
    "op7_pareto_mix": mix_sql(),
    "op8_ngram_jaccard_join": jaccard_sql(),
    "op11_suffix_buckets": repeats_sql(),
    "op12_phrase_collocations": collocations_sql(),
    "op13_source_divergence": audit_sql(),
}
