"""Listing payloads as the host's API sends them: schemas, decoding, paging, readme candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.functions.text import slug

REPO = "id bigint, full_name string, name string, owner struct<login:string>, description string, topics array<string>, language string, license struct<spdx_id:string>, stargazers_count bigint, forks_count bigint, archived boolean, html_url string, homepage string, pushed_at string"
STAR_ITEM = f"starred_at string, repo struct<{', '.join(f'{a}:{b}' for a, b in (x.strip().split(' ', 1) for x in ['id bigint', 'full_name string', 'name string', 'owner struct<login:string>', 'description string', 'topics array<string>', 'language string', 'license struct<spdx_id:string>', 'stargazers_count bigint', 'forks_count bigint', 'archived boolean', 'html_url string', 'homepage string', 'pushed_at string']))}>"
USER = "login string, id bigint, name string, avatar_url string, bio string, company string, location string, followers bigint, public_repos bigint, created_at string"
LISTS = "data struct<user:struct<lists:struct<pageInfo:struct<hasNextPage:boolean,endCursor:string>,nodes:array<struct<id:string,name:string,isPrivate:boolean,items:struct<pageInfo:struct<hasNextPage:boolean,endCursor:string>,nodes:array<struct<databaseId:bigint>>>>>>>>, errors array<struct<type:string,message:string>>"
#: Where a readme is looked for, in this order (fixed values).
README_PATHS = ["README.md", "readme.md", "README", "README.rst", "README.txt"]


def _repo(r: str) -> list[Column]:
    c = lambda x: F.col(f"{r}.{x}")
    return [
        c("id").alias("id"), c("full_name").alias("full_name"), c("owner.login").alias("owner"), c("name").alias("name"), c("description").alias("description"),
        F.coalesce(c("topics"), F.array().cast("array<string>")).alias("topics"), c("language").alias("language"), c("license.spdx_id").alias("license"),
        F.coalesce(c("stargazers_count"), F.lit(0)).alias("stars"), F.coalesce(c("forks_count"), F.lit(0)).alias("forks"), F.coalesce(c("archived"), F.lit(False)).alias("archived"),
        c("html_url").alias("html_url"), c("homepage").alias("homepage"), c("pushed_at").alias("pushed_at"),
    ]


def decode_repos(payloads: DataFrame, column: str = "json") -> DataFrame:
    """One repository a payload."""
    return payloads.select(F.from_json(column, REPO).alias("r")).where("r.id is not null").select(*_repo("r"))


def decode_stars(pages: DataFrame, column: str = "json") -> DataFrame:
    """A row for each starred repository of pages(page, json), with starred_at and star_page."""
    items = pages.select("page", F.explode(F.from_json(column, f"array<struct<{STAR_ITEM.replace('starred_at string', 'starred_at:string').replace('repo struct', 'repo:struct')}>>")).alias("i"))
    return items.where("i.repo.id is not null").select(*_repo("i.repo"), F.col("i.starred_at").alias("starred_at"), F.col("page").alias("star_page"))


def decode_users(payloads: DataFrame, column: str = "json") -> DataFrame:
    return payloads.select(F.from_json(column, USER).alias("u")).where("u.login is not null").select("u.*").withColumn("avatar_url", F.coalesce("avatar_url", F.lit("")))


def decode_lists(payloads: DataFrame, column: str = "json") -> DataFrame:
    """id, name, slug, position, repo_ids of public lists; entries that are not repositories are left out."""
    nodes = payloads.select(F.posexplode(F.from_json(column, LISTS)["data"]["user"]["lists"]["nodes"]).alias("position", "n"))
    ids = F.array_distinct(F.array_compact(F.transform("n.items.nodes", lambda x: x["databaseId"])))
    return nodes.where(~F.coalesce(F.col("n.isPrivate"), F.lit(False))).select(F.col("n.id").alias("id"), F.col("n.name").alias("name"), slug(F.col("n.name")).alias("slug"), "position", ids.alias("repo_ids"))


def next_page(link: Column) -> Column:
    """The page number of a Link header's next relation; null if there is none."""
    found = F.regexp_extract(link, r"<[^>]*[?&]page=(\d+)[^>]*>;\s*rel=\"next\"", 1)
    return F.when(found != "", found.cast("int"))


def star_page_url(login: Column, page: Column, size: int = 100, root: str = "https://api.github.com") -> Column:
    return F.concat(F.lit(f"{root}/users/"), login, F.lit(f"/starred?sort=created&direction=asc&per_page={size}&page="), page.cast("string"))


def first_readme(*found: Column) -> Column:
    """The first readme of the candidates in order; blank ones do not count."""
    return F.coalesce(*(F.when(F.trim(x) != "", x) for x in found))


def topics_of(text: Column) -> Column:
    """Topics of a JSON string; anything else is none."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
