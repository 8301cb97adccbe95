"""The engine's entities as views over the driver's parquet tables; nothing is copied."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Length of the description that is cut from a document's text.
DESCRIPTION = 120


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents and labels in the shape of repositories."""
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    name = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("id"),
        F.concat_ws("/", "source", name).alias("full_name"),
        F.col("source").alias("owner"),
        name.alias("name"),
        F.substring("text", 1, DESCRIPTION).alias("description"),
        F.array("lang", "source").alias("topics"),
        F.col("lang").alias("language"),
        F.when(F.col("quality") == 1, "MIT").alias("license"),
        F.col("n_chars").alias("stars"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("archived"),
        F.col("text").alias("readme"),
    )


def user_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as star links: the latest event of a user and repository is the link."""
    n = read(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    events = read(spark, sf_dir, "events").crossJoin(F.broadcast(n))  # one row
    links = events.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("login"), (F.col("event_id") % F.col("n")).alias("repo_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("starred_at"), F.floor(F.col("event_id") / 100).alias("star_page"))
    return links.groupBy("login", "repo_id").agg(F.max("starred_at").alias("starred_at"), F.max("star_page").alias("star_page"))


def group_repos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as two named groups."""
    labels = read(spark, sf_dir, "labels")
    return labels.select(F.explode(F.array(F.when(F.col("quality") == 1, F.lit("quality")), F.when(F.col("toxic") == 1, F.lit("toxic")))).alias("slug"), F.col("doc_id").alias("repo_id")).where("slug is not null")


def fetch_status(state) -> object:
    """The status of a stored readme state as planners read it: one that is too big is there too; what is not known is an error."""
    return F.when(state.isin("present", "too_big"), "ok").when(state.isin("missing", "pending"), state).otherwise("error")


#: What an import of lists may have come to (fixed values).
LIST_STATES = ("never", "ok", "empty", "error")


def lists_info(logins: DataFrame, stored: DataFrame) -> DataFrame:
    """login, state, error, checked_at for every login; without a stored row, or with a state that no import writes, the state is never."""
    rows = logins.select("login").join(stored.select("login", "state", "error", "checked_at"), "login", "left")
    return rows.withColumn("state", F.when(F.col("state").isin(*LIST_STATES), F.col("state")).otherwise("never"))


def without_semantic(states: DataFrame, enabled: bool) -> DataFrame:
    """Index states with the counter of embedded documents at 0 where search by meaning is off."""
    return states if enabled else states.withColumn("semantic_docs", F.lit(0).cast(states.schema["semantic_docs"].dataType))


def groups(spark: SparkSession) -> DataFrame:
    return spark.sql("SELECT * FROM VALUES (1L, 'quality', 'Quality', 0), (2L, 'toxic', 'Toxic', 1) AS t(id, slug, name, position)")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"), "label")


#: The same views as DuckDB common table expressions, for the oracles.
CTE = f"""
repos AS (SELECT d.doc_id AS id, concat_ws('/', d.source, 'doc-' || d.doc_id) AS full_name, d.source AS owner, 'doc-' || d.doc_id AS name,
    substring(d.text, 1, {DESCRIPTION}) AS description, [d.lang, d.source] AS topics, d.lang AS language,
    CASE WHEN l.quality = 1 THEN 'MIT' END AS license, d.n_chars AS stars, COALESCE(l.toxic, 0) = 1 AS archived, d.text AS readme
    FROM documents d LEFT JOIN labels l USING (doc_id)),
user_stars AS (SELECT 'u' || user_id AS login, event_id % (SELECT count(*) FROM documents) AS repo_id,
    max(strftime(ts, '%Y-%m-%dT%H:%M:%SZ')) AS starred_at, max(event_id // 100) AS star_page FROM events GROUP BY 1, 2),
group_repos AS (SELECT 'quality' AS slug, doc_id AS repo_id FROM labels WHERE quality = 1 UNION ALL SELECT 'toxic', doc_id FROM labels WHERE toxic = 1),
groups AS (SELECT * FROM (VALUES (1, 'quality', 'Quality', 0), (2, 'toxic', 'Toxic', 1)) t(id, slug, name, position)),
vectors AS (SELECT vec_id AS id, embedding::DOUBLE[] AS vector, label FROM embeddings)"""
