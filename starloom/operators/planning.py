"""What has to be fetched, embedded or admitted next, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scoring import fnv1a
from starloom.operators.ranking import batches, newest

WINDOW, BATCH = 1500, 25
FULL_COOLDOWN, RELIST_COOLDOWN = 6 * 3600, 900
ABANDONED, STUCK, QUEUED = 5 * 60, 20 * 60, 60 * 60


def readme_dirty(status: Column, pushed: Column, checked: Column) -> Column:
    """Never fetched, failed, or pushed since it was checked."""
    return status.isNull() | (status == "error") | F.coalesce(pushed > checked, F.lit(False))


def readme_work(stars: DataFrame, states: DataFrame, vectors: DataFrame | None = None, window: int = WINDOW, size: int = BATCH) -> DataFrame:
    """id, place, batch of the newest repositories that need a fetch, are pending, or have no vector.

    stars(id, pushed_at, starred_at), states(id, status, checked_at), vectors(id).
    """
    recent = newest(stars, window).drop("place")
    joined = recent.join(states, "id", "left")
    need = readme_dirty(F.col("status"), F.col("pushed_at"), F.col("checked_at")) | F.coalesce(F.col("status") == "pending", F.lit(False))
    if vectors is not None:
        joined = joined.join(vectors.select("id", F.lit(1).alias("embedded")), "id", "left")
        need |= F.col("embedded").isNull()
    return batches(newest(joined.where(need), window), size).select("id", "place", "batch")


def readme_action(status: Column, dirty: Column) -> Column:
    return F.when(dirty, "fetch").when(status == "missing", "reuse-missing").otherwise("reuse-present")


def published_hash(status: Column, text: Column) -> Column:
    """A real hash only of readmes known to be there or not."""
    return F.when(status.isin("ok", "missing"), fnv1a(F.coalesce(text, F.lit("")))).otherwise("")


def embed_work(docs: DataFrame, published: DataFrame) -> DataFrame:
    """id, hash of documents whose hash is not the published one."""
    hashed = docs.select("id", fnv1a(F.col("doc")).alias("hash"))
    old = published.select("id", F.col("hash").alias("old"))
    return hashed.join(old, "id", "left").where(~F.col("hash").eqNullSafe(F.col("old"))).select("id", "hash")


def admission(now: Column, running: Column, last_full: Column, last_list: Column, force: Column, full: int = FULL_COOLDOWN, relist: int = RELIST_COOLDOWN) -> Column:
    """Whether a sync may start: struct(allowed, reason, wait_s). All times in seconds; force skips the cooldowns only."""
    left = lambda at, window: F.ceil(F.greatest(F.coalesce(at + window - now, F.lit(0)), F.lit(0))).cast("long")
    answer = lambda ok, why, wait: F.struct(F.lit(ok).alias("allowed"), F.lit(why).alias("reason"), wait.cast("long").alias("wait_s"))
    free = ~F.coalesce(force, F.lit(False))
    return (
        F.when(F.coalesce(running, F.lit(False)), answer(False, "in-progress", F.lit(0)))
        .when(free & (left(last_full, full) > 0), answer(False, "cooldown-full", left(last_full, full)))
        .when(free & (left(last_list, relist) > 0), answer(False, "cooldown-relist", left(last_list, relist)))
        .otherwise(answer(True, "ok", F.lit(0)))
    )


def takeover(phase: Column, age: Column) -> Column:
    """What to do about a run that is under way, by the seconds since it last reported."""
    return F.when(phase == "queued", F.when(age > QUEUED, "take-over").otherwise("attach")).when(age > STUCK, "take-over").when(age > ABANDONED, "probe").otherwise("attach")


def fold_state(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The state of each key: of each column the latest value that is not null, as patches in order would leave it."""
    return events.groupBy(key).agg(*(F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in columns))


def daily_budget(requests: DataFrame, limit: int, key: str = "key", at: str = "ts", tie: str = "id") -> DataFrame:
    """Requests with their number of the key's UTC day, whatever the session's zone, and whether they are within the limit.
    Timestamps without a zone are taken to be UTC."""
    zoned = requests.schema[at].dataType.typeName() == "timestamp"
    day = F.to_date(F.to_utc_timestamp(F.col(at), F.current_timezone()) if zoned else F.col(at))
    used = F.row_number().over(Window.partitionBy(key, day).orderBy(at, tie)).cast("long")
    return requests.withColumn("day", day).withColumn("used", used).withColumn("allowed", F.col("used") <= max(0, int(limit)))


def burst_windows(requests: DataFrame, limit: int, seconds: int = 60, key: str = "key", at: str = "ts") -> DataFrame:
    """Requests of each key and tumbling window, and how many are over the limit."""
    counted = requests.groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"))
