"""Filters, legs, fusion, orders and the engine on the small fixtures."""

import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from starloom.operators import filters as FL
from starloom.operators import fusion as FU
from starloom.operators import index as IX
from starloom.operators import legs as LG
from starloom.operators import merging as MG
from starloom.operators import ranking as RK
from starloom.plans.engine import Engine, NotFound
from starloom.plans.query import SearchRequest, archived_choice, classify, expand, normalize, parse_request, tokenize

REPO = "id long, full_name string, owner string, name string, description string, topics array<string>, language string, license string, stars long, archived boolean, readme string"


def repo(i, full, description=None, topics=(), language=None, stars=0, archived=False, readme=None, license=None):
    owner, name = full.split("/")
    return (i, full, owner, name, description, list(topics), language, license, stars, archived, readme)


@pytest.fixture(scope="module")
def four(spark):
    rows = [
        repo(1, "a/one", topics=["http", "client"], language="TypeScript", stars=100, license="MIT"),
        repo(2, "b/two", topics=["http"], language="TypeScript", stars=5, license="MIT"),
        repo(3, "c/three", language="Go", stars=1000, license="Apache-2.0", archived=True),
        repo(4, "d/four", topics=["http", "client", "retry"], language="TypeScript", stars=50),
    ]
    stars = [("u", 1, "2026-01-01T00:00:00Z", 1), ("u", 2, "2025-01-01T00:00:00Z", 1), ("u", 3, "2024-01-01T00:00:00Z", 1), ("u", 4, "2026-06-01T00:00:00Z", 1)]
    groups = [("inbox", 1), ("inbox", 2), ("tools", 3)]
    return spark.createDataFrame(rows, REPO), spark.createDataFrame(stars, "login string, repo_id long, starred_at string, star_page int"), spark.createDataFrame(groups, "slug string, repo_id long")


@pytest.mark.parametrize(
    "filters, want",
    [
        (FL.Filters(), [4, 1, 2, 3]), (FL.Filters(topics=("http", "client")), [4, 1]), (FL.Filters(topics=("http", "client", "retry")), [4]), (FL.Filters(min_stars=50, max_stars=1000), [4, 1, 3]),
        (FL.Filters(language="typescript"), [4, 1, 2]), (FL.Filters(archived=True), [3]), (FL.Filters(archived=False), [4, 1, 2]), (FL.Filters(license="mit"), [1, 2]),
        (FL.Filters(starred_after="2026-01-01T00:00:00Z", starred_before="2026-06-01T00:00:00Z"), [4, 1]), (FL.Filters(groups=("inbox",)), [1, 2]), (FL.Filters(groups=("inbox", "tools")), [1, 2, 3]), (FL.Filters(groups=("none",)), []),
    ],
)
def test_filters(four, filters, want):
    repos, stars, groups = four
    assert [r.id for r in FL.browse(FL.candidates(repos, stars, "u", filters, groups)).collect()] == want


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(
        [
            repo(1, "better-auth/better-auth", "The most comprehensive authentication framework", ["auth", "oauth"], readme="Authentication, OAuth and session management."),
            repo(2, "nuxflare/auth", "Tiny auth server", ["auth"], readme="auth for everyone"),
            repo(3, "vector-db/vectordb", "vector database", ["vector"], readme="semantic search over embeddings"),
        ],
        REPO,
    )


def ids(df):
    return {r.id for r in df.collect()}


@pytest.fixture(scope="module")
def index(docs, tmp_path_factory):
    return IX.SearchIndex.build(docs, str(tmp_path_factory.mktemp("index") / "ix"), buckets=4)


def test_text_index(docs, index):
    hits = LG.any_leg(index, ["auth"], 10).collect()
    assert {r.id for r in hits} == {1, 2} and sorted(r["rank"] for r in hits) == [1, 2]
    assert ids(LG.any_leg(index, ["embeddings"], 10)) == ids(LG.any_leg(index, ["embedding"], 10)) == {3}
    assert ids(LG.keyword_leg(index, ["authenticate"], 10)) == {1} and ids(LG.any_leg(index, ["sessions management"], 10)) == {1}
    assert ids(LG.trigram_leg(index, docs, "flar")) == {2} and ids(LG.trigram_leg(index, docs, "auth")) == {1, 2} and ids(LG.trigram_leg(index, docs, "everyone")) == set() and ids(LG.trigram_leg(index, docs, "au")) == set()
    assert LG.any_leg(index, ["auth"], 1).count() == 1 and LG.any_leg(index, ["nothing"], 5).count() == 0


@pytest.mark.parametrize("stemmed", [True, False])
def test_bm25_equals_sqlite(docs, stemmed, tmp_path):
    rows = docs.collect()
    db = sqlite3.connect(":memory:")
    db.execute(f"CREATE VIRTUAL TABLE t USING fts5(full_name, description, topics, readme, tokenize='{'porter ' if stemmed else ''}unicode61')")
    for r in rows:
        db.execute("INSERT INTO t(rowid, full_name, description, topics, readme) VALUES (?,?,?,?,?)", (r.id, r.full_name, r.description, " ".join(r.topics), r.readme))
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 2, stemmed)
    for terms, match in ((["auth"], '"auth"'), (["vectors", "database"], '"vectors" OR "database"'), (["session management"], '"session management"'), (["authentication", "searching"], '"authentication" OR "searching"')):
        want = dict(db.execute("SELECT rowid, -bm25(t, 10.0, 5.0, 4.0, 1.0) FROM t WHERE t MATCH ?", (match,)).fetchall())
        got = {r.id: r.score for r in LG.scored(index.matches(terms), index.stats()).collect()}
        assert got == pytest.approx(want, abs=1e-8)


def test_few_full_matches_fall_back_to_any(docs, index):
    assert ids(LG.keyword_leg(index, ["tiny", "vector"], 10)) == {2, 3}
    assert ids(LG.keyword_leg(index, ["tiny", "auth"], 10)) == {1, 2}
    assert ids(LG.keyword_leg(index, ["tiny", "auth"], 10, docs.where("id = 1"))) == {1}


def test_legs_from_one_read(docs, index):
    rows = lambda df: {(r.id, round(r.score, 9), r["rank"]) for r in df.collect()}
    for words, more in ((["auth"], ["session management", "oauth"]), (["tiny", "auth"], ["vector"]), (["tiny", "vector"], [])):
        legs = LG.text_legs(index, words, more, 10, docs.where("id < 3"))
        assert rows(legs["keyword"]) == rows(LG.keyword_leg(index, words, 10, docs.where("id < 3")))
        assert ("expanded" in legs) == bool(more) and (not more or rows(legs["expanded"]) == rows(LG.any_leg(index, more, 10, docs.where("id < 3"))))


def test_buckets_are_the_tables(index, spark):
    words = ["auth", "naïve", "", "漢字", "x" * 100]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(index._bucket("w").alias("b")).collect()
    assert [r.b for r in got] == [index._buckets([w])[0] for w in words]


def test_searches_read_their_buckets_only(index):
    plan = index.rows(["auth"])._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0] and "term" in plan.split("PushedFilters: [")[1].split("]")[0]


def test_changes_equal_a_new_index(docs, tmp_path, spark):
    """Documents put, changed and taken out one after another, against an index of what is then there."""
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    new = spark.createDataFrame([repo(2, "nuxflare/auth", "A changed server", ["auth"], readme="now with sessions"), repo(9, "x/y", "auth again and again", readme="auth")], REPO)
    index.upsert(new)
    index.delete(spark.createDataFrame([(3,)], "id long"))
    fresh = IX.SearchIndex.build(docs.where("id = 1").unionByName(new), str(tmp_path / "new"), 4)
    for terms in (["auth"], ["session", "server"], ["vector"]):
        assert sorted(map(tuple, LG.scored(index.matches(terms), index.stats()).collect())) == sorted(map(tuple, LG.scored(fresh.matches(terms), fresh.stats()).collect()))
    assert ids(LG.trigram_leg(index, docs.unionByName(new), "again")) == {9} and ids(index.lengths()) == {1, 2, 9}
    index.upsert(docs.where("id = 3"))
    assert ids(LG.any_leg(index, ["vector"], 5)) == {3} and IX.opened(spark, str(tmp_path / "ix"), 4) is not None and IX.opened(spark, str(tmp_path / "none")) is None


def found_by(index, *words):
    return sorted((r.id, round(r.score, 9)) for r in LG.scored(index.matches(list(words)), index.stats(), index.dfs(list(words))).collect())


def test_an_index_says_how_it_was_built(docs, tmp_path, spark):
    path = str(tmp_path / "accounts" / "fts_u_a")
    built = IX.SearchIndex.build(docs, path, 5)
    again = IX.opened(spark, path)
    assert (again.buckets, again.stemmed) == (5, True) and found_by(again, "auth", "vector") == found_by(built, "auth", "vector") != []
    with pytest.raises(ValueError, match="5 buckets"):
        IX.opened(spark, path, 64)
    assert IX.opened(spark, str(tmp_path / "none")) is None
    IX.SearchIndex.build(docs, str(tmp_path / "accounts" / "fts_u_b"), 5)
    assert IX.listed(spark, str(tmp_path / "accounts")) == ["fts_u_a", "fts_u_b"]
    IX.drop(spark, path)
    assert IX.listed(spark, str(tmp_path / "accounts")) == ["fts_u_b"] and IX.opened(spark, path) is None


def test_readers_see_one_version(docs, tmp_path, spark, monkeypatch):
    """A reader that opens the index between the writes of a change, or while its manifest is half written, sees what was there before."""
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    before, seen = found_by(index, "auth"), []
    commit = IX.SearchIndex._commit

    def looked(self, change):
        reader = IX.opened(spark, self.path)
        seen.append((ids(reader.lengths()), found_by(reader, "auth")))
        return commit(self, change)

    monkeypatch.setattr(IX.SearchIndex, "_commit", looked)
    old = IX.opened(spark, index.path)
    index.upsert(spark.createDataFrame([repo(2, "a/b", "auth auth"), repo(7, "c/d", "auth")], REPO))
    assert seen == [({1, 2, 3}, before)] and found_by(old, "auth") == before
    assert ids(index.lengths()) == {1, 2, 3, 7} == ids(IX.opened(spark, index.path).lengths())
    (tmp_path / "ix" / "manifest" / "000000000009.json").write_text('{"version": 9, "buck')
    assert ids(IX.opened(spark, index.path).lengths()) == {1, 2, 3, 7}


def test_two_writers_lose_nothing(docs, tmp_path, spark):
    """Both opened the same version; the slower one goes on from what the faster one made."""
    first = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    second = IX.opened(spark, first.path)
    first.upsert(spark.createDataFrame([repo(8, "a/b", "auth")], REPO))
    second.upsert(spark.createDataFrame([repo(8, "a/b", "vector"), repo(9, "c/d", "auth")], REPO))
    now = IX.opened(spark, first.path)
    assert ids(now.lengths()) == {1, 2, 3, 8, 9} and ids(now.rows(["auth"])) == {1, 2, 9} | (ids(IX.SearchIndex.build(docs).rows(["auth"])) - {8})


def test_many_changes_leave_few_segments(docs, tmp_path, spark):
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    for k in range(11):
        index.upsert(spark.createDataFrame([repo(20 + k % 4, f"o/n{k}", f"auth number{k}")], REPO))
    last = [repo(20 + k % 4, f"o/n{k}", f"auth number{k}") for k in range(7, 11)]
    fresh = IX.SearchIndex.build(docs.unionByName(spark.createDataFrame(last, REPO)), str(tmp_path / "fresh"), 4)
    assert len(index.manifest["segments"]) <= 6
    for words in (("auth",), ("number3", "number9"), ("number10", "vector")):
        assert found_by(index, *words) == found_by(fresh, *words)
    index.merge()
    index.vacuum()
    assert len(index.manifest["segments"]) == 1 and not index.manifest["dead"] and found_by(IX.opened(spark, index.path), "auth") == found_by(fresh, "auth")
    assert {n: len(list((tmp_path / "ix" / n).glob("segment=*"))) for n in ("terms", "df", "trigrams", "dead")} == {"terms": 1, "df": 1, "trigrams": 1, "dead": 0}
    assert index.all_dfs().where("term = 'auth'").first().df == fresh.dfs(["auth"]).first().df


def test_a_common_term_spreads_over_files(tmp_path, spark):
    """One word in every document, and the documents' own rows: both go to as many files as their size asks for."""
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "32k")
    try:
        rng = random.Random(3)
        many = spark.range(20_000).select("id", *(F.lit(x).alias(c) for c, x in (("full_name", "o/n"), ("owner", "o"), ("name", "n"), ("description", "")))).withColumn("topics", F.array().cast("array<string>"))
        word = F.concat(F.lit("common w"), (F.xxhash64("id") % rng.randint(5000, 6000)).cast("string"))
        many = many.withColumn("readme", F.concat_ws(" ", *(word for _ in range(3)))).repartition(16)
        index = IX.SearchIndex.build(many, str(tmp_path / "ix"), 4)
        files = lambda rows: len({r.f for r in rows.select(F.input_file_name().alias("f")).distinct().collect()})
        assert files(index._table("terms").where("term = 'common'")) > 4 and files(index._table("terms").where("bucket = -1")) > 4
        assert index.rows(["common"]).count() == 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")


AUTH = [
    repo(1, "better-auth/better-auth", topics=["authentication", "oauth"], language="TypeScript", stars=30000), repo(2, "logto-io/logto", topics=["authentication"], language="TypeScript", stars=14000),
    repo(3, "nuxflare/auth", topics=["authentication"], language="TypeScript", stars=24), repo(4, "anomalyco/openauth", topics=["oauth"], language="TypeScript", stars=5000), repo(5, "casbin/casbin", topics=["authorization"], language="Go", stars=18000),
]


def leg(spark, *pairs):
    return spark.createDataFrame([(int(i), float(r)) for i, r in pairs], "id long, rank double")


def test_scenario(spark):
    repos = spark.createDataFrame(AUTH, REPO)
    legs = {"keyword": leg(spark, (1, 1), (3, 2), (4, 3), (5, 1)), "expanded": leg(spark, (1, 1), (2, 3), (4, 2)), "semantic": leg(spark, (1, 2), (2, 1), (3, 40), (4, 3))}
    hits = FU.fuse(legs, repos.where("language = 'TypeScript'"), ["auth"], names_of=repos).orderBy(F.desc("score")).collect()
    assert hits[0].id == 1 and 5 not in [h.id for h in hits]
    assert [h.id for h in hits].index(1) < [h.id for h in hits].index(3)
    assert 1 < next(h.boost for h in hits if h.id == 3) < 1.45
    assert next(h.matched_by for h in hits if h.id == 2) == ["expanded", "semantic"] and "name" in next(h.matched_by for h in hits if h.id == 3)


def test_ranks(spark):
    got = {r.id: r.rrf for r in FU.fuse_ranks(FU.union_legs({"keyword": leg(spark, (1, 1), (1, 5), (2, 0), (3, float("inf"))), "expanded": leg(spark, (4, 1))})).collect()}
    assert got == pytest.approx({1: 1 / 61, 4: 0.6 / 61})


def test_penalties_are_windows(spark):
    rows = spark.createDataFrame([(1, "o", "a", 1, 1.0), (2, "o", "b", 1, 0.9), (3, "p", "a", 1, 0.8)], "id long, owner string, name string, stars long, score double")
    assert [r.score for r in FU.duplicate_penalties(rows).orderBy("id").collect()] == pytest.approx([1.0, 0.765, 0.56])
    twins = spark.createDataFrame([(1, "o", "foo-bar", 1, 1.0), (2, "p", "foo_bar", 1, 1.0)], rows.schema)
    assert [r.score for r in FU.duplicate_penalties(twins).orderBy("id").collect()] == pytest.approx([1.0, 0.7])


def test_archived_and_bonus(spark):
    repos = spark.createDataFrame([repo(1, "a/x", archived=True), repo(2, "b/y", "an auth thing", ["auth"])], REPO)
    hits = {r.id: r.score for r in FU.fuse({"keyword": leg(spark, (1, 1), (2, 1))}, repos, ["auth"], penalties=False).collect()}
    assert hits == pytest.approx({1: 0.4 / 61, 2: 1 / 61 + 0.003 + 0.0015})


def test_orders(spark):
    rows = spark.createDataFrame([(1, 10, "2020-01-01T00:00:00Z", "2026-01-01T00:00:00Z"), (2, 5, "2026-06-01T00:00:00Z", "2024-01-01T00:00:00Z"), (3, 900, None, "2021-01-01T00:00:00Z")], "id long, stars long, pushed_at string, starred_at string")
    order = lambda s: [r.id for r in RK.page(rows, s, 0, 10).orderBy("position").collect()]
    assert (order("pushed"), order("stars"), order("starred")) == ([2, 1, 3], [3, 1, 2], [1, 2, 3])
    assert [r.id for r in RK.page(rows, "stars", 1, 1).collect()] == [1]


def test_query_understanding():
    assert [classify(x) for x in ("foo/bar", "useEffect", "bge-m3", "auth", "http client", "durable background jobs", "")] == ["identifier"] * 3 + ["keyword", "keyword", "descriptive", "keyword"]
    assert expand(tokenize("auth")).concepts == ["auth"] and expand(tokenize("author")).concepts == []
    assert expand(tokenize("rate-limit")).concepts == ["rate-limit"] and len(expand(tokenize("auth cache test cli")).terms) == 8
    assert tokenize("useEffect XMLHttpRequest oauth2") == ["use", "effect", "xml", "http", "request", "oauth2"]
    assert normalize(" a\x00 b\n") == "a b" and len(normalize("y" * 999)) == 512


def test_requests():
    r = parse_request("@Me", {"q": " x ", "minStars": "10", "maxStars": "nan", "archived": "0", "topic": "a, b,", "offset": "-4", "limit": "999", "mode": "odd", "sort": "stars"})
    assert (r.login, r.q, r.filters.min_stars, r.filters.max_stars, r.filters.archived, r.filters.topics, r.offset, r.limit, r.mode, r.sort) == ("me", "x", 10, None, False, ("a", "b"), 0, 50, "auto", "stars")
    assert [archived_choice(x) for x in (None, "include", "only", "hide")] == [False, None, True, False]


@pytest.fixture(scope="module")
def engine(docs, spark):
    links = spark.createDataFrame([("u", i, f"2026-01-0{i}T00:00:00Z", 1) for i in (1, 2, 3)], "login string, repo_id long, starred_at string, star_page int")
    groups = spark.createDataFrame([(1, "g", "G", 0)], "id long, slug string, name string, position int")
    members = spark.createDataFrame([("g", 2)], "slug string, repo_id long")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.8, 0.6]), (3, [0.0, 1.0])], "id long, vector array<double>")
    return Engine(docs, links, groups, members, vectors, index=IX.SearchIndex.build(docs, buckets=4))


def test_search(engine):
    rows = engine.search(SearchRequest("u", "auth")).collect()
    assert {r.id for r in rows} == {1, 2} and rows[0].position == 1 and rows[0].mode == "keyword" and rows[0].degraded == "keyword-only"
    assert next(r.slugs for r in rows if r.id == 2) == ["g"] and all(r.snippet for r in rows)
    assert "expanded" in rows[0].matched_by or "keyword" in rows[0].matched_by
    both = engine.search(SearchRequest("u", "auth", vector=(0.0, 1.0))).collect()
    assert all(r.rank_semantic for r in both) and both[0].boost >= 1
    assert {r.id for r in both} == {1, 2, 3} and both[0].mode == "hybrid" and both[0].degraded is None
    assert [r.id for r in engine.search(SearchRequest("u")).collect()] == [3, 2, 1]
    assert engine.search(SearchRequest("u", "!!!")).count() == 0 and engine.search(SearchRequest("nobody", "auth")).count() == 0
    assert engine.total(SearchRequest("u", "auth")).first().total == 2
    assert engine.search(SearchRequest("u", "auth", filters=FL.Filters(groups=("g",)))).count() == 1


def test_status_lists_and_coverage(engine, spark):
    assert engine.lists().select("slug", "repo_id").collect() == [("g", 2)]
    row = engine.status("u").first()
    assert (row.stars, row.repos, row.readmes, row.candidates, row.vectors, row.coverage) == (3, 3, 3, 3, 3, 1.0)
    assert engine.coverage(engine.repos.limit(0)).first().coverage == 0.0
    extra = spark.createDataFrame([(77,)], "id long")
    assert engine.coverage(engine.repos.select("id").unionByName(extra)).first().coverage == 0.75


def test_show_and_similar(engine):
    assert engine.show("nuxflare/auth").first().slugs == ["g"] and engine.show("no/ne").count() == 0
    assert [r.id for r in engine.similar(1, 2).orderBy("rank").collect()] == [2, 3]
    with pytest.raises(NotFound):
        engine.similar(99, 1)


def test_index_is_opened_when_it_is_asked_for(engine):
    """show(), similar() and candidates read no index, so none is built for them."""
    asked = []
    lazy = Engine(engine.repos, engine.user_stars, engine.groups, engine.group_repos, engine.vectors, index=lambda: asked.append(1) or engine.index)
    assert lazy.show("nuxflare/auth").count() == 1 and lazy.similar(1, 2).count() == 2 and lazy.candidates("u", FL.Filters()).count() == 3
    assert not asked
    assert lazy.index is engine.index and lazy.index is engine.index and len(asked) == 1


def test_postings_of_large_batches_come_in_slices(docs):
    """What a task groups at once is of about SLICE_TOKENS tokens, however many rows Arrow sends together."""
    import pyarrow as pa

    words = [f"running{i % 7}" for i in range(IX.SLICE_TOKENS // 3)]
    lists = lambda *x: pa.array(x, pa.list_(pa.string()))
    none = [[]] * 8
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), lists(*none), lists(["runs"], *none[1:]), lists(*none), lists(*[words] * 8)], names=["id", *IX.COLUMNS])
    out = list(IX._grouped(True)([batch]))
    assert len(out) > 2
    got = {(r["id"], r["term"]): r for b in out for r in b.to_pylist()}
    assert len(got) == 8 * 8 + 1 and got[0, "run"]["places"] == [IX.SPAN] and got[5, ""] == {"id": 5, "term": "", "len": len(words), "places": []}
    assert got[7, "running3"]["places"] == [3 * IX.SPAN + i for i in range(3, len(words), 7)] and got[0, "running3"]["len"] == len(words) + 1


def test_nearest_of_many_queries_by_blocks(spark, monkeypatch):
    """The same rows as one query at a time, copies, ties, zeros, nulls and lengths among them, and no row for each pair."""
    rng = random.Random(3)
    some = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(12)]
    odd = [[0.0] * 4, [1.0, None, 0.0, 2.0], [1.0, float("nan"), 0.0, 0.0], [1e200, 0.0, 0.0, 1e200], [1e-200, 0.0, 0.0, 0.0], [1.0, 2.0]]
    rows = [[x + rng.choice([0, 0, 3e-10, 1e-9]) for x in rng.choice(some)] for _ in range(120)] + odd * 2
    v = spark.createDataFrame(list(enumerate(rows)), "id long, vector array<double>")
    queries = v.where("id % 5 = 0 or id > 119").withColumnRenamed("id", "query_id")
    monkeypatch.setattr(LG, "BLOCK_NUMBERS", 200)
    monkeypatch.setattr(LG, "PAIRS", 100)
    found = LG.batch_knn(queries, v, 6)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.query_id, r["rank"], r.id, str(r.score)) for r in found.collect())
    pairs = queries.crossJoin(v.withColumnRenamed("vector", "w")).where("size(vector) = size(w)")
    pairs = pairs.select("query_id", "id", F.round(LG.cosine(F.col("w"), F.col("vector")), LG.DIGITS).alias("score"))
    best = pairs.withColumn("rank", F.row_number().over(LG.Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where("rank <= 6")
    assert got == sorted((r.query_id, r["rank"], r.id, str(r.score)) for r in best.collect())


def test_batches_match_single_queries(engine, spark):
    queries = spark.createDataFrame([(1, "auth server"), (2, "vector database")], "query_id long, query string")
    got = {(r.query_id, r.id): r.score for r in engine.batch_keyword(queries).collect()}
    for q, terms in ((1, ["auth", "server"]), (2, ["vector", "database"])):
        want = {(q, r.id): r.score for r in LG.any_leg(engine.index, terms, 50).collect()}
        assert {k: v for k, v in got.items() if k[0] == q} == pytest.approx(want)
    fused = engine.batch_fused({"keyword": engine.batch_keyword(queries).select("query_id", "id", "rank")}).collect()
    assert {(r.query_id, r.id) for r in fused} == set(got)


def test_batches_are_summed_where_documents_are(engine, spark):
    """No row for a document and a query is dealt out again; the words of all queries travel instead, or shuffle if they are many."""
    queries = spark.createDataFrame([(1, "auth server auth"), (2, "zzz"), (3, None), (4, "")], "query_id long, query string")
    scores = engine.batch_keyword(queries, None)
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("hashpartitioning(")[1:] if x.startswith("query_id") and "id#" in x.split(")")[0].split(",")[1]]
    want = {r.id: r.score for r in LG.any_leg(engine.index, ["auth", "server"], 50).collect()}
    assert {(r.query_id, r.id): r.score for r in scores.collect()} == pytest.approx({(1, i): x for i, x in want.items()})


def test_vectors(spark):
    v = spark.createDataFrame([(2, [1.0, 0.0]), (1, [2.0, 0.0]), (3, [0.0, 1.0])], "id long, vector array<double>")
    assert [r.id for r in LG.vector_leg(v, [1.0, 0.0], 2).orderBy("rank").collect()] == [1, 2]
    assert LG.vector_leg(v, [1.0, 0.0], 0).count() == 0
    assert [r.id for r in MG.overlay(v.where("id < 3"), v.where("id > 1"), v.where("id <> 1")).orderBy("id").collect()] == [2, 3]
