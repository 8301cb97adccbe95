"""Merges of new rows into stored tables: upserts, diffs, replacements, overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.text import README_LIMIT
from starloom.sources.staging import staged


def latest(rows: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """The row of each key with the highest sequence number: a last-writer-wins upsert."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), seq).alias("r")).select(*keys, "r.*")


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep_old: list[str] = (), fill: list[str] = ()) -> DataFrame:
    """old with new's rows over it by key. keep_old columns stay where a row existed; fill columns take the new value unless it is null."""
    o, n = old.alias("o"), new.alias("n")
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    there = F.col("n.__new").isNotNull()
    n = new.withColumn("__new", F.lit(1)).alias("n")

    def value(c: str) -> Column:
        if c in keys or c in fill:
            return F.coalesce(F.col(f"n.{c}") if c in new.columns else F.lit(None), F.col(f"o.{c}"))
        if c not in new.columns:
            return F.col(f"o.{c}")
        if c in keep_old:
            return F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}"))
        return F.when(there, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))

    return o.join(n, on, "full_outer").select(*(value(c).alias(c) for c in old.columns))


def star_diff(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """repo_id and change: added if only fresh has it, removed if only stored has."""
    added = fresh.select("repo_id").join(stored.select("repo_id"), "repo_id", "left_anti").withColumn("change", F.lit("added"))
    return added.unionByName(stored.select("repo_id").join(fresh.select("repo_id"), "repo_id", "left_anti").withColumn("change", F.lit("removed")))


def listed(fresh: DataFrame, stored: DataFrame, unchanged_pages: list[int]) -> DataFrame:
    """Ids listed now: fresh ones, stored ones of pages not modified, and stored ones without a page."""
    kept = stored.where(F.col("star_page").isin(unchanged_pages) | F.col("star_page").isNull()).select("repo_id")
    return fresh.select("repo_id").union(kept).distinct()


def unstar(links: DataFrame, login: str, ids: DataFrame) -> DataFrame:
    """links without those of a login to the given repositories."""
    gone = ids.select(F.lit(login).alias("login"), "repo_id")
    return links.join(gone, ["login", "repo_id"], "left_anti")


def replace_groups(stored: DataFrame, login: str, fresh: DataFrame) -> DataFrame:
    """All memberships of a login replaced by fresh(slug, repo_id), each once."""
    return stored.where(F.col("login") != login).unionByName(fresh.dropDuplicates(["slug", "repo_id"]).withColumn("login", F.lit(login)).select(*stored.columns))


def put_readmes(repos: DataFrame, updates: DataFrame, run: str) -> DataFrame:
    """repos(id, readme, readme_state, readme_run) with texts cut to the limit and pending under this run."""
    u = updates.select("id", F.substring("text", 1, README_LIMIT).alias("text"), F.lit(1).alias("__new"))
    has = F.col("__new").isNotNull()
    return repos.join(u, "id", "left").select("id", F.when(has, F.col("text")).otherwise(F.col("readme")).alias("readme"), F.when(has, "pending").otherwise(F.col("readme_state")).alias("readme_state"), F.when(has, run).otherwise(F.col("readme_run")).alias("readme_run"))


def publish_readmes(repos: DataFrame, ids: DataFrame, run: str) -> DataFrame:
    """Pending rows of this run among ids become present, or missing without a text; others stay."""
    mine = ids.select("id", F.lit(1).alias("__mine"))
    go = F.col("__mine").isNotNull() & (F.col("readme_state") == "pending") & (F.col("readme_run") == run)
    state = F.when(go & F.col("readme").isNotNull(), "present").when(go, "missing").otherwise(F.col("readme_state"))
    return repos.join(mine, "id", "left").select("id", "readme", state.alias("readme_state"), F.when(go, None).otherwise(F.col("readme_run")).alias("readme_run"))


def overlay(old: DataFrame, new: DataFrame, window: DataFrame) -> DataFrame:
    """Vectors of the window's ids, new over old."""
    both = old.select("id", "vector").withColumnRenamed("vector", "o").join(new.select("id", "vector").withColumnRenamed("vector", "n"), "id", "full_outer")
    return both.join(window.select("id"), "id", "left_semi").select("id", F.coalesce("n", "o").alias("vector"))


def same_ids(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: whether two id sets are equal."""
    off = a.select("id").distinct().withColumn("side", F.lit(1)).unionByName(b.select("id").distinct().withColumn("side", F.lit(2)))
    return off.groupBy("id").agg(F.sum("side").alias("s")).agg(F.coalesce(F.bool_and(F.col("s") == 3), F.lit(True)).alias("up_to_date"))


def memberships(groups: DataFrame, group_repos: DataFrame) -> DataFrame:
    """Every group with each of its repositories once, in rows; a null repo_id for a group without any. A group of any size spreads over
    tasks; a page makes a list of the few that it shows."""
    return groups.select("id", "slug", "name", "position").join(group_repos.select("slug", "repo_id").distinct(), "slug", "left")


def groups_of(group_repos: DataFrame) -> DataFrame:
    """Every repository with the slugs of its groups in order."""
    return group_repos.groupBy("repo_id").agg(F.sort_array(F.collect_set("slug")).alias("slugs"))


def budgeted_text(docs: DataFrame, budget: int = 20 * 1024 * 1024, cap: int = README_LIMIT) -> DataFrame:
    """login, id, indexed_chars: documents of a login in id order keep their text while it still fits a running
    budget; one that does not fit is skipped and takes nothing.

    Rows are dealt by ranges of login and id, so a login's documents spread over tasks. In a round each login takes the longest run of
    documents that fits, from sums by range and, only in the range that the budget ends in, a sum row by row. The document after it is
    skipped, with all that are larger than what is left; rounds go on behind it until every login has come to its end.
    """
    size = F.least(F.coalesce(F.length("readme"), F.lit(0)), F.lit(cap)).cast("long")
    dealt = docs.select("login", "id", size.alias("n")).repartitionByRange("login", "id").sortWithinPartitions("login", "id", "n")
    rows = staged(dealt.withColumn("part", F.spark_partition_id()).withColumn("row", F.monotonically_increasing_id()), "dealt")
    state = rows.groupBy("login").agg(F.lit(budget).cast("long").alias("left"), F.lit(-1).cast("long").alias("at"))
    parts_before = Window.partitionBy("login").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    kept = None
    while True:
        state = staged(state, "state")
        ahead = rows.join(state, "login").where("row > at and n <= left")
        sums = ahead.groupBy("login", "part", "left").agg(F.sum("n").alias("s")).withColumn("before", F.coalesce(F.sum("s").over(parts_before), F.lit(0)))
        cut = staged(sums.where("before + s > left").groupBy("login").agg(F.min(F.struct("part", "before")).alias("c")).select(F.col("login").alias("cut_login"), F.col("c.part").alias("cut_part"), F.col("c.before").alias("before")), "cut")
        placed = ahead.join(cut, F.col("login") == F.col("cut_login"), "left")
        whole = placed.where("cut_part is null or part < cut_part").select("row", "n")
        run = F.sum("n").over(Window.partitionBy("login").orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
        inside = staged(placed.where("part = cut_part").withColumn("fits", F.col("before") + run <= F.col("left")).select("login", "row", "n", "left", "before", "fits"), "inside")
        ends = inside.groupBy("login").agg(F.min(F.when(~F.col("fits"), F.col("row"))).alias("at"), F.min(F.col("left") - F.col("before")).alias("left"))
        taken = inside.join(ends.select(F.col("login").alias("end_login"), F.col("at").alias("end")), F.col("login") == F.col("end_login")).where("row < end")
        new = staged(whole.unionByName(taken.select("row", "n")), "kept")
        kept = new if kept is None else kept.unionByName(new)
        if cut.isEmpty():
            break
        used = taken.groupBy(F.col("login").alias("used_login")).agg(F.sum("n").alias("used"))
        state = ends.join(used, F.col("login") == F.col("used_login"), "left").select("login", (F.col("left") - F.coalesce("used", F.lit(0))).alias("left"), "at")
    return rows.join(kept.withColumnRenamed("n", "kept"), "row", "left").select("login", "id", F.coalesce("kept", F.lit(0)).cast("long").alias("indexed_chars"))


def fan_in(parts: list[DataFrame], old: DataFrame, window: DataFrame) -> DataFrame:
    """Vectors of the window's ids from the parts(id, vector) of a run, later parts over earlier ones and all over the old ones."""
    rows = None
    for k, p in enumerate(parts):
        part = p.select("id", F.struct(F.lit(k).alias("k"), "vector").alias("x"))
        rows = part if rows is None else rows.unionByName(part)
    return overlay(old, rows.groupBy("id").agg(F.max_by("x", "x.k").alias("x")).select("id", "x.vector"), window)
