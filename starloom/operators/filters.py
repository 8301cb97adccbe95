"""Hard filters on repositories. Every predicate given must hold; null columns never match."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Short names of languages in the lab profile (fixed values).
ALIASES = {"ts": "typescript", "js": "javascript", "py": "python", "rb": "ruby", "rs": "rust", "golang": "go", "c++": "c++", "cpp": "c++", "cs": "c#", "csharp": "c#", "sh": "shell", "bash": "shell", "kt": "kotlin", "hs": "haskell", "ex": "elixir", "objc": "objective-c", "md": "markdown", "vue": "vue", "tsx": "typescript", "jsx": "javascript"}


@dataclass(frozen=True)
class Filters:
    language: str | None = None
    min_stars: int | None = None
    max_stars: int | None = None
    archived: bool | None = None
    license: str | None = None
    starred_after: str | None = None
    starred_before: str | None = None
    topics: tuple[str, ...] = field(default=())
    groups: tuple[str, ...] = field(default=())
    owner: str | None = None
    has_readme: bool | None = None
    fork: bool | None = None
    pushed_after: str | None = None
    pushed_before: str | None = None
    any_topics: tuple[str, ...] = field(default=())


def predicate(f: Filters) -> Column:
    """The column predicates of a filter, all but groups. Dates compare as strings, both ends included."""
    p = F.lit(True)
    if f.language is not None:
        p &= F.lower("language") == f.language.lower()
    if f.min_stars is not None:
        p &= F.col("stars") >= f.min_stars
    if f.max_stars is not None:
        p &= F.col("stars") <= f.max_stars
    if f.archived is not None:
        p &= F.col("archived") == f.archived
    if f.license is not None:
        p &= F.lower(F.coalesce("license", F.lit(""))) == f.license.lower()
    if f.starred_after is not None:
        p &= F.col("starred_at") >= f.starred_after
    if f.starred_before is not None:
        p &= F.col("starred_at") <= f.starred_before
    for t in f.topics:
        p &= F.array_contains(F.transform("topics", F.lower), t.lower())
    if f.owner is not None:
        p &= F.lower("owner") == f.owner.lower()
    if f.has_readme is not None:
        p &= (F.trim(F.coalesce("readme", F.lit(""))) != "") == f.has_readme
    if f.fork is not None:
        p &= F.coalesce("fork", F.lit(False)) == f.fork
    if f.pushed_after is not None:
        p &= F.col("pushed_at") >= f.pushed_after
    if f.pushed_before is not None:
        p &= F.col("pushed_at") <= f.pushed_before
    if f.any_topics:
        p &= F.arrays_overlap(F.transform("topics", F.lower), F.array(*(F.lit(t.lower()) for t in f.any_topics)))
    return p


def lab_predicate(language: str | None = None, topics: tuple[str, ...] = (), min_stars: int | None = None, max_stars: int | None = None, with_archived: bool = True) -> Column:
    """The lab profile: language aliases, 'unknown' for none, topics as they are written."""
    p = F.lit(True)
    if language is not None:
        name = ALIASES.get(language.lower(), language.lower())
        p &= F.col("language").isNull() if name == "unknown" else F.lower("language") == name
    p = p if min_stars is None else p & (F.col("stars") >= min_stars)
    p = p if max_stars is None else p & (F.col("stars") <= max_stars)
    p = p if with_archived else p & ~F.col("archived")
    for t in topics:
        p &= F.array_contains("topics", t)
    return p


def in_groups(repos: DataFrame, group_repos: DataFrame, slugs: tuple[str, ...]) -> DataFrame:
    """Repositories in any of the groups."""
    members = group_repos.where(F.col("slug").isin(list(slugs))).select(F.col("repo_id").alias("id"))
    return repos.join(members, "id", "left_semi")


def universe(repos: DataFrame, user_stars: DataFrame, login: str) -> DataFrame:
    """What a login has starred, with starred_at and star_page."""
    links = user_stars.where(F.col("login") == login).select(F.col("repo_id").alias("id"), "starred_at", "star_page")
    return repos.join(links, "id")


def candidates(repos: DataFrame, user_stars: DataFrame, login: str, f: Filters, group_repos: DataFrame | None = None) -> DataFrame:
    """The candidate set of a search, filters pushed below everything else."""
    found = universe(repos, user_stars, login).where(predicate(f))
    return in_groups(found, group_repos, f.groups) if f.groups and group_repos is not None else found


def placed(found: DataFrame) -> DataFrame:
    """What a login starred with its place in the order of browse. One login's rows are one list, so one window."""
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.col("starred_at").desc_nulls_last(), F.desc("id"))).cast("long"))


def browse(found: DataFrame) -> DataFrame:
    return found.orderBy(F.col("starred_at").desc_nulls_last(), F.desc("id"))


def counts(repos: DataFrame, user_stars: DataFrame, login: str) -> DataFrame:
    """stars linked, repositories known, and those with a readme, in one pass."""
    links = user_stars.where(F.col("login") == login).select(F.col("repo_id").alias("id"))
    return links.join(repos.select("id", "readme", F.lit(1).alias("known")), "id", "left").agg(F.count("*").alias("stars"), F.count("known").alias("repos"), F.count("readme").alias("readmes"))
