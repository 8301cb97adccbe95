"""One account's ingestion as batch jobs: a listing run over a snapshot, a refresh run over what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.scoring import fnv1a
from starloom.functions.text import embedding_text
from starloom.operators import merging as MG
from starloom.operators import planning as PL

LINK = ["login", "repo_id", "starred_at", "star_page"]


def listing_run(login: str, stored_repos: DataFrame, stored_links: DataFrame, listed: DataFrame, unchanged_pages: list[int] = ()) -> dict[str, DataFrame]:
    """New repos and links after a listing, and the diff.

    listed has the decoded repositories of the pages that changed, with starred_at and star_page. Stored pages in
    unchanged_pages count as listed. A repository that is not listed loses its link, not its row.
    """
    mine = stored_links.where(F.col("login") == login)
    now = MG.listed(listed.select(F.col("id").alias("repo_id")), mine, list(unchanged_pages))
    diff = MG.star_diff(mine, now)
    fresh = listed.select(F.lit(login).alias("login"), F.col("id").alias("repo_id"), "starred_at", "star_page")
    links = MG.upsert(stored_links.select(*LINK), fresh, ["login", "repo_id"], fill=["starred_at", "star_page"])
    links = MG.unstar(links, login, diff.where("change = 'removed'").select("repo_id"))
    columns = [c for c in stored_repos.columns if c in listed.columns]
    return {"repos": MG.upsert(stored_repos, listed.select(*columns), ["id"]), "links": links, "diff": diff}


def embed(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], batch: int = 32) -> DataFrame:
    """id, vector of docs(id, doc); texts of like length share a batch, so a model pads little."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            pdf = pdf.iloc[pdf["doc"].str.len().argsort()]
            for i in range(0, len(pdf), batch):
                part = pdf.iloc[i : i + batch]
                rows = model(part["doc"].tolist())
                if len(rows) != len(part):
                    raise ValueError(f"{len(rows)} vectors for {len(part)} texts")
                yield pd.DataFrame({"id": part["id"], "vector": [[float(x) for x in r] for r in rows]})

    return docs.select("id", F.coalesce("doc", F.lit("")).alias("doc")).mapInPandas(run, "id long, vector array<double>")


def refresh_run(repos: DataFrame, links: DataFrame, states: DataFrame, vectors: DataFrame, published: DataFrame, fetched: DataFrame, model: Callable[[list[str]], list[list[float]]], run: str, window: int = PL.WINDOW, parts: list[DataFrame] = ()) -> dict[str, DataFrame]:
    """What to fetch, the repositories with their readmes, the vectors of the window, and the hashes to publish.

    fetched(id, text) are the readmes that a fetcher brought for the plan. Only documents whose hash is not the
    published one are embedded. parts(id, vector) are what earlier steps of the same run have embedded: later ones over earlier, all over
    the stored vectors, and not embedded again. Readmes count as published once their vectors are in the result.
    """
    stars = links.select(F.col("repo_id").alias("id"), "starred_at").join(repos.select("id", "pushed_at"), "id")
    plan = PL.readme_work(stars, states, vectors, window)
    stored = MG.put_readmes(repos.select("id", "readme", "readme_state", "readme_run"), fetched, run)
    full = repos.drop("readme", "readme_state", "readme_run").join(stored, "id")
    text = embedding_text(F.col("full_name"), F.col("description"), F.col("topics"), F.col("language"), F.col("readme"))
    docs = full.join(plan.select("id"), "id", "left_semi").select("id", text.alias("doc"))
    dirty = PL.embed_work(docs, published)
    todo = docs.join(dirty.select("id"), "id", "left_semi")
    for p in parts:
        todo = todo.join(p.select("id"), "id", "left_anti")
    fresh = embed(todo, model)
    recent = PL.newest(stars, window).select("id")
    merged = MG.fan_in([*parts, fresh], vectors, recent)
    hashes = MG.upsert(published, docs.select("id", fnv1a(F.coalesce("doc", F.lit(""))).alias("hash")), ["id"])
    return {"plan": plan, "vectors": merged, "hashes": hashes, "repos": MG.publish_readmes(stored, merged.select("id"), run)}
