"""The search service as one lazy plan, for one request or a set of queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import InitVar, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions.scoring import bm25
from starloom.functions.stemming import stems
from starloom.functions.text import index_tokens
from starloom.operators.filters import Filters, browse, candidates, counts
from starloom.operators.fusion import LEG_WEIGHTS, evidence, fuse, fuse_ranks, union_legs
from starloom.operators.index import WEIGHTS, SearchIndex, frequency
from starloom.operators.legs import DIGITS, text_legs, vector_leg
from starloom.operators.merging import groups_of, memberships
from starloom.operators.ranking import page, with_snippets
from starloom.plans.errors import NotFound
from starloom.plans.lexicon import CONCEPTS
from starloom.plans.query import SearchRequest, classify, expand, normalize, tokenize
from starloom.sources import files, tables
from starloom.sources.staging import staged

#: Rows that a leg keeps for a relevance order and for an explicit one.
LEG, SORTED_LEG = 50, 500
#: Words of all queries of a batch that are broadcast, and sums that one task makes of them.
FEW_ASKED, TASK_PAIRS = 500_000, 4_000_000


#: Search indexes that this session has built, by what they are of.
_BUILT: dict[tuple, SearchIndex] = {}


def index_over(spark: SparkSession, sf_dir: str) -> SearchIndex:
    """The index of the tables in a folder, built on first use in a session and read from then on, until the tables' files change."""
    key = (spark.sparkContext.applicationId, sf_dir, *(files.state(spark, f"{sf_dir}/{t}.parquet") for t in ("documents", "labels")))
    if key not in _BUILT:
        _BUILT[key] = SearchIndex.build(tables.repos(spark, sf_dir))
    return _BUILT[key]


@dataclass
class Engine:
    """Search over tables of repositories, star links, groups and vectors, and the repositories' index: one, or what gives one when it is
    first asked for; it is built then if none is given. Methods return lazy plans; a search first writes the few best of each leg to the
    shared folder."""

    repos: DataFrame
    user_stars: DataFrame
    groups: DataFrame
    group_repos: DataFrame
    vectors: DataFrame | None = None
    weights: dict = field(default_factory=lambda: dict(LEG_WEIGHTS))
    index: InitVar[SearchIndex | Callable[[], SearchIndex] | None] = None
    concepts: dict = field(default_factory=lambda: CONCEPTS)

    def __post_init__(self, index: SearchIndex | Callable[[], SearchIndex] | None) -> None:
        self._index = index or (lambda: SearchIndex.build(self.repos))

    def _opened(self) -> SearchIndex:
        if not isinstance(self._index, SearchIndex):
            self._index = self._index()
        return self._index

    @classmethod
    def over(cls, spark: SparkSession, sf_dir: str, **options) -> Engine:
        return cls(tables.repos(spark, sf_dir), tables.user_stars(spark, sf_dir), tables.groups(spark), tables.group_repos(spark, sf_dir), tables.vectors(spark, sf_dir), index=lambda: index_over(spark, sf_dir), **options)

    def health(self) -> dict:
        """Whether the index can be read, its version and its documents; from its manifest, without a job."""
        m = self.index.manifest
        return {"ok": bool(m["segments"]), "index_version": m["version"], "segments": len(m["segments"]), "documents": sum(s["n"] for s in m["segments"]), "semantic": self.vectors is not None}

    def repo(self, full_name: str) -> dict:
        """show() of one repository as a dictionary; NotFound where there is none."""
        found = self.show(full_name).collect()
        if not found:
            raise NotFound(f"no repository {full_name}", full_name=full_name)
        return found[0].asDict(True)

    def lists(self) -> DataFrame:
        """Every group with its repositories."""
        return memberships(self.groups, self.group_repos)

    def status(self, login: str) -> DataFrame:
        """One row: a login's stars, known repositories, readmes and vectors, and the share of repositories with a vector."""
        found = counts(self.repos, self.user_stars, login)
        return found.crossJoin(F.broadcast(self.coverage(self.candidates(login, Filters()))))  # one row each

    def coverage(self, found: DataFrame) -> DataFrame:
        """One row: how many candidates there are, how many have a vector, and their share (1 at most; 0 of none)."""
        held = found.select("id") if self.vectors is None else found.select("id").join(self.vectors.select("id", F.lit(1).alias("has")), "id", "left")
        has = F.lit(0) if self.vectors is None else F.count("has")
        return held.agg(F.count("*").alias("candidates"), has.cast("long").alias("vectors")).withColumn("coverage", F.least(F.lit(1.0), F.coalesce(F.try_divide("vectors", "candidates"), F.lit(0.0))))

    def candidates(self, login: str, filters: Filters) -> DataFrame:
        return candidates(self.repos, self.user_stars, login, filters, self.group_repos)

    def hits(self, r: SearchRequest, found: DataFrame | None = None) -> tuple[DataFrame, str, bool]:
        """All hits of a request among found (what its login starred and its filters leave, unless given), its mode label, and
        whether the meaning leg was asked for and is missing."""
        found = self.candidates(r.login, r.filters) if found is None else found
        q = normalize(r.q)
        if not q:
            return found.withColumn("score", F.lit(0.0)).withColumn("matched_by", F.array().cast("array<string>")), "keyword", False
        words = tokenize(q)
        meant = r.mode != "keyword"
        usable = meant and self.vectors is not None and r.vector is not None
        label = ("semantic" if r.mode == "semantic" else "hybrid") if usable else "keyword"
        if not words:
            return found.withColumn("score", F.lit(0.0)).withColumn("matched_by", F.array().cast("array<string>")).limit(0), label, meant and not usable
        k = LEG if r.sort == "relevance" else SORTED_LEG
        more = expand(words, self.concepts) if r.mode in ("auto", "hybrid") and classify(q) != "identifier" else None
        terms = more.terms if more and more.concepts else []
        legs = text_legs(self.index, list(dict.fromkeys(words)), terms, k, found)
        if usable:
            legs["semantic"] = vector_leg(self.vectors, list(r.vector), k, found)
        ranked = staged(union_legs(legs), "legs")  # k rows a leg at most: found once, whatever reads the hits
        return fuse(ranked, found, evidence(words, terms), self.weights, few=True), label, meant and not usable

    def search(self, r: SearchRequest) -> DataFrame:
        """One page: position, the repository's columns, score, what it was matched by, its rank in each leg and its boost, its
        groups, and a snippet for the first rows."""
        hits, label, degraded = self.hits(r)
        words = tokenize(normalize(r.q))
        sort = "starred" if not words and r.sort == "relevance" else r.sort
        if "pushed_at" not in hits.columns:
            hits = hits.withColumn("pushed_at", F.lit(None).cast("string"))
        for c in ("rank_keyword", "rank_expanded", "rank_semantic", "boost"):
            hits = hits if c in hits.columns else hits.withColumn(c, F.lit(None).cast("double"))
        rows = page(hits, sort, r.offset, r.limit)
        rows = with_snippets(rows, self.repos, evidence(words, expand(words, self.concepts).terms if words else []))
        mine = groups_of(self.group_repos).withColumnRenamed("repo_id", "id")
        rows = rows.join(mine, "id", "left").withColumn("slugs", F.coalesce("slugs", F.array().cast("array<string>")))
        keep = ["position", "id", "full_name", "owner", "name", "description", "topics", "language", "license", "stars", "archived", "starred_at", "score", "matched_by", "rank_keyword", "rank_expanded", "rank_semantic", "boost", "slugs", "snippet"]
        return rows.select(*keep).withColumn("mode", F.lit(label)).withColumn("degraded", F.lit("keyword-only" if degraded else None)).orderBy("position")

    def total(self, r: SearchRequest) -> DataFrame:
        return self.hits(r)[0].agg(F.count("*").alias("total"))

    def browse(self, login: str, filters: Filters = Filters()) -> DataFrame:
        return browse(self.candidates(login, filters))

    def show(self, full_name: str) -> DataFrame:
        """A repository without a user's context, with the groups that hold it."""
        one = self.repos.where(F.col("full_name") == full_name).limit(1).withColumn("starred_at", F.lit(None).cast("string"))
        return one.join(groups_of(self.group_repos).withColumnRenamed("repo_id", "id"), "id", "left")

    def similar(self, vec_id: int, k: int) -> DataFrame:
        """The k nearest vectors of a stored one, itself left out."""
        source = self.vectors.where(F.col("id") == vec_id).limit(1).collect()
        if not source:
            raise NotFound(f"no vector {vec_id}")
        return vector_leg(self.vectors.where(F.col("id") != vec_id), list(source[0].vector), k)

    def batch_keyword(self, queries: DataFrame, k: int | None = LEG) -> DataFrame:
        """query_id, id, score, rank by BM25 over any term, for a table of queries(query_id, query) at once; k None: all hits.

        The index's rows of the terms that some query asks for are dealt by document, queries meet them there and are summed there: what
        moves is a row for each document and term, not for each document and query. Documents are not read.
        """
        words = index_tokens(F.col("query"))
        asked = staged(queries.select("query_id", F.explode(F.array_distinct(stems(words) if self.index.stemmed else words)).alias("term")), "asked")
        few = asked.count() <= FEW_ASKED
        near = lambda df: F.broadcast(df) if few else df
        known = staged(self.index.all_dfs().join(near(asked.select("term").distinct()), "term", "left_semi"), "known")
        pairs = asked.join(near(known), "term").agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0]
        rows = self.index.terms().select("id", "term", "len", frequency(WEIGHTS).alias("tf")).join(near(known), "term").crossJoin(F.broadcast(self.index.stats()))
        worth = rows.select("id", "term", bm25(F.col("tf"), F.col("len"), F.col("mean_len"), F.col("df"), F.col("n")).alias("s"))
        spark = queries.sparkSession
        tasks = max(-(-pairs // TASK_PAIRS), int(spark.conf.get("spark.sql.shuffle.partitions")))
        scores = worth.repartition(tasks, "id").join(near(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum("s"), DIGITS).alias("score"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")).cast("long")
        return scores.withColumn("rank", rank) if k is None else scores.withColumn("rank", rank).where(F.col("rank") <= k)

    def batch_fused(self, legs: dict[str, DataFrame], k: int = LEG) -> DataFrame:
        """query_id, id, rrf, rank of ranked legs(query_id, id, rank), fused for all queries at once."""
        parts = [df.select(F.struct("query_id", "id").alias("id"), F.lit(name).alias("leg"), "rank") for name, df in legs.items()]
        ranked = parts[0]
        for p in parts[1:]:
            ranked = ranked.unionByName(p)
        fused = fuse_ranks(ranked, self.weights).select("id.query_id", "id.id", "rrf")
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")).cast("long")
        return fused.withColumn("rank", rank).where(F.col("rank") <= k)

#: Read-only; what looks up, browses or compares vectors never builds it.
Engine.index = property(Engine._opened)

__all__ = ["Engine", "NotFound"]
