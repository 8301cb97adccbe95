"""Display columns, versioned tables, ingestion runs and the lab profile."""

import pytest
from pyspark.sql import functions as F

from starloom.functions import display as D
from starloom.operators import index as IX
from starloom.operators import merging as MG
from starloom.operators import metrics as ME
from starloom.plans import ingest as IN
from starloom.plans.lab import lab_search, pooled
from starloom.sources import sinks, tables

REPO = "id long, full_name string, name string, description string, topics array<string>, language string, stars long, archived boolean, readme string, readme_state string, readme_run string, pushed_at string"


def repo(i, name, readme=None, stars=0, pushed=None, state=None):
    return (i, f"o/{name}", name, f"about {name}", ["t"], "go", stars, False, readme, state, None, pushed)


def test_display(spark):
    at = lambda s: F.to_timestamp(F.lit(s))
    row = spark.range(1).select(D.lab_tokens(F.lit("bge-m3 C++ a.b")), D.highlighted(F.lit("The cat,  cats"), ["cat"]), D.compact(F.lit(1234)), D.compact(F.lit(2_500_000)), D.compact(F.lit(7)), D.ago(at("2024-01-01"), at("2024-01-03")), D.percent(F.lit(1), F.lit(3)), D.percent(F.lit(1), F.lit(0)), D.phase_progress(F.lit("embedding"), F.lit(1), F.lit(2)), D.freshness(at("2024-01-01"), at("2024-01-05"))).first()
    assert row[:] == (["bge-m3", "c", "a.b"], "The <mark>cat</mark>, cats", "1.2k", "2.5M", "7", "2d ago", "33%", "0%", pytest.approx(0.85), "aging")
    got = spark.createDataFrame([("Open settings", ["prefs"]), ("Settings", []), ("Close", [])], "label string, words array<string>").select("label", D.command_score(F.col("label"), F.col("words"), "settings").alias("s")).collect()
    assert [r.s is None for r in got] == [False, False, True] and got[1].s > got[0].s
    assert D.query_string({"topic": ["a", "b"], "q": " ", "lang": "C++", "archived": False, "x": None}) == "topic=a&topic=b&lang=C%2B%2B&archived=false"


def test_versions(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        sinks.current(spark, path)
    assert sinks.publish(spark.range(3), path) == 1 and sinks.publish(spark.range(5), path) == 2
    assert sinks.current(spark, path).count() == 5


def test_build_index(spark, tmp_path):
    repos = spark.createDataFrame([repo(1, "alpha", "betas beta"), repo(2, "gamma", None)], REPO)
    vectors = spark.createDataFrame([(1, [1.0, 0.5])], "id long, vector array<double>")
    index = sinks.build_index(repos, str(tmp_path / "ix"), 2, vectors)
    assert spark.read.json(str(tmp_path / "ix/report")).first().n == 1
    assert {r.id for r in index.grams(["alp"]).collect()} == {1}
    plain = IX.opened(spark, str(tmp_path / "ix/plain"), 2, stemmed=False)
    assert [[len(r.places) for r in i.rows(i.of(["beta"])).collect()] for i in (index, plain)] == [[2], [1]]
    assert spark.read.parquet(str(tmp_path / "ix/vectors")).count() == 1


def test_listing_run(spark):
    stored = spark.createDataFrame([repo(1, "a"), repo(2, "b"), repo(9, "other")], REPO).select("id", "full_name", "stars")
    links = spark.createDataFrame([("u", 1, "t1", 1), ("u", 2, "t2", 2), ("u", 3, "t3", 3), ("v", 2, "t", 1)], "login string, repo_id long, starred_at string, star_page int")
    listed = spark.createDataFrame([(1, "o/a", 5, None, 1), (4, "o/d", 7, "t4", 1)], "id long, full_name string, stars long, starred_at string, star_page int")
    out = IN.listing_run("u", stored, links, listed, [3])
    assert {tuple(r) for r in out["diff"].collect()} == {(4, "added"), (2, "removed")}
    assert {tuple(r) for r in out["links"].collect()} == {("u", 1, "t1", 1), ("u", 3, "t3", 3), ("u", 4, "t4", 1), ("v", 2, "t", 1)}
    assert {tuple(r) for r in out["repos"].collect()} == {(1, "o/a", 5), (2, "o/b", 0), (4, "o/d", 7), (9, "o/other", 0)}


def test_refresh_run(spark):
    repos = spark.createDataFrame([repo(1, "a", "old", state="present"), repo(2, "b", None), repo(3, "c", "same", state="present")], REPO)
    links = spark.createDataFrame([("u", i, f"t{i}", 1) for i in (1, 2, 3)], "login string, repo_id long, starred_at string, star_page int")
    states = spark.createDataFrame([(1, "error", "d1"), (3, "ok", "d9")], "id long, status string, checked_at string")
    vectors = spark.createDataFrame([(1, [0.0]), (3, [3.0]), (7, [7.0])], "id long, vector array<double>")
    published = spark.createDataFrame([(3, "x")], "id long, hash string")
    fetched = spark.createDataFrame([(1, "new"), (2, "two")], "id long, text string")
    out = IN.refresh_run(repos, links, states, vectors, published, fetched, lambda texts: [[float(len(t))] for t in texts], "r1")
    assert [r.id for r in out["plan"].orderBy("place").collect()] == [2, 1]
    got = {r.id: r.vector for r in out["vectors"].collect()}
    assert set(got) == {1, 2, 3} and got[3] == [3.0] and got[1][0] > 3
    assert {r.id: r.readme_state for r in out["repos"].collect()} == {1: "present", 2: "present", 3: "present"}
    assert {r.id for r in out["hashes"].collect()} == {1, 2, 3}
    with pytest.raises(Exception, match="vectors for"):
        IN.embed(spark.createDataFrame([(1, "x")], "id long, doc string"), lambda texts: []).collect()


def test_lab(spark, tmp_path):
    repos = spark.createDataFrame([repo(1, "vector-db", "a vector store", 10), repo(2, "other", "vector things", 5000), repo(3, "zzz", "nothing")], REPO)
    index = IX.SearchIndex.build(repos, str(tmp_path / "ix"), 2)
    rows = lab_search(index, repos, "vector", "keyword").orderBy("position").collect()
    assert [r.id for r in rows] == [1, 2] and "<mark>vector</mark>" in rows[0].snippet and [r.lex_rank for r in rows] == [1, 2]
    assert [r.id for r in lab_search(index, repos, "ctor", "keyword").collect()] == [1]
    v = spark.createDataFrame([(3, [1.0]), (1, [0.5])], "id long, vector array<double>")
    runs = {m: lab_search(index, repos, "vector", m, vectors=v, vector=[1.0]) for m in ("keyword", "semantic", "hybrid")}
    assert {r.id for r in runs["hybrid"].collect()} == {1, 2, 3}
    pool = {r.id: r for r in pooled(runs).collect()}
    assert set(pool) == {1, 2, 3} and (pool[1].lex, pool[1].sem) == (1, 2) and pool[3].lex is None and len(pool[1].modes) == 3 and pool[2].modes[0].startswith("#")


def test_states_and_counters(spark):
    states = spark.createDataFrame([("present",), ("too_big",), ("missing",), ("pending",), ("odd",), (None,)], "s string")
    assert [r[0] for r in states.select(tables.fetch_status(F.col("s"))).collect()] == ["ok", "ok", "missing", "pending", "error", "error"]
    logins = spark.createDataFrame([("a",), ("b",), ("c",)], "login string")
    stored = spark.createDataFrame([("a", "ok", None, "t"), ("b", "weird", "e", "t")], "login string, state string, error string, checked_at string")
    assert sorted((r.login, r.state, r.checked_at) for r in tables.lists_info(logins, stored).collect()) == [("a", "ok", "t"), ("b", "never", "t"), ("c", "never", None)]
    counted = spark.createDataFrame([("a", 5)], "login string, semantic_docs long")
    assert tables.without_semantic(counted, False).first().semantic_docs == 0 and tables.without_semantic(counted, True).first().semantic_docs == 5


def test_filter_precision_and_ablation(spark):
    repos = spark.createDataFrame([(1, "Go"), (2, None), (3, "Rust")], "id long, language string")
    results = spark.createDataFrame([(1, 1), (1, 2), (1, 3), (2, 2), (3, 3)], "query_id long, id long")
    asked = spark.createDataFrame([(1, "go"), (2, "unknown"), (3, None)], "query_id long, language string")
    got = {r.query_id: (r.hits, r.violations) for r in ME.filter_precision(results, repos, asked).collect()}
    assert got == {1: (3, 2), 2: (1, 0), 3: (1, 0)}
    grades = spark.createDataFrame([(1, 3, 2)], "query_id long, id long, grade int")
    run = lambda order: spark.createDataFrame([(1, i, k + 1) for k, i in enumerate(order)], "query_id long, id long, rank long")
    got = {r.run: r.mrr for r in ME.ablation({"on": run([3, 1]), "off": run([1, 3])}, grades, spark.createDataFrame([(1,)], "query_id long")).collect()}
    assert got == {"on": 1.0, "off": 0.5}


def test_parts_fan_in(spark):
    v = lambda *x: spark.createDataFrame([(i, [float(y)]) for i, y in x], "id long, vector array<double>")
    out = MG.fan_in([v((1, 1), (2, 1)), v((2, 2))], v((2, 0), (3, 0), (4, 0)), v((1, 0), (2, 0), (3, 0)))
    assert {r.id: r.vector[0] for r in out.collect()} == {1: 1.0, 2: 2.0, 3: 0.0}
