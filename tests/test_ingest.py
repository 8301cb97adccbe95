"""Wire decoding, merges, planners, metrics, blobs and streams on small fixtures."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.operators import merging as MG
from starloom.operators import metrics as ME
from starloom.operators import planning as PL
from starloom.sources import blobs, wire
from starloom.streaming import budgets as ST


def test_wire(spark):
    repo = {"id": 1, "full_name": "a/b", "name": "b", "owner": {"login": "a"}, "license": {"spdx_id": "MIT"}, "stargazers_count": 3, "forks_count": 1, "archived": False, "topics": ["x"]}
    one = wire.decode_repos(spark.createDataFrame([(json.dumps(repo),), ("broken",)], "json string")).collect()
    assert len(one) == 1 and (one[0].owner, one[0].license, one[0].stars, one[0].topics) == ("a", "MIT", 3, ["x"])
    stars = wire.decode_stars(spark.createDataFrame([(2, json.dumps([{"starred_at": "2024-01-01T00:00:00Z", "repo": repo}, {"repo": {**repo, "id": 2, "topics": None}}]))], "page int, json string")).orderBy("id").collect()
    assert [(r.id, r.starred_at, r.star_page, r.topics) for r in stars] == [(1, "2024-01-01T00:00:00Z", 2, ["x"]), (2, None, 2, [])]
    node = lambda i, name, private: {"id": i, "name": name, "isPrivate": private, "items": {"pageInfo": {}, "nodes": [{"databaseId": 5}, None, {"databaseId": 5}, {}]}}
    payload = {"data": {"user": {"lists": {"pageInfo": {}, "nodes": [node("L1", "My List", False), node("L2", "No", True)]}}}}
    lists = wire.decode_lists(spark.createDataFrame([(json.dumps(payload),)], "json string")).collect()
    assert [(r.slug, r.repo_ids, r.position) for r in lists] == [("my-list", [5], 0)]
    users = wire.decode_users(spark.createDataFrame([(json.dumps({"login": "u", "id": 1}),)], "json string")).first()
    assert (users.login, users.avatar_url) == ("u", "")


def test_paging(spark):
    link = '<https://api.github.com/u?page=3&per_page=100>; rel="next", <https://api.github.com/u?page=9>; rel="last"'
    row = spark.range(1).select(wire.next_page(F.lit(link)), wire.next_page(F.lit('<x?page=1>; rel="prev"')), wire.star_page_url(F.lit("u"), F.lit(2)), wire.first_readme(F.lit(None).cast("string"), F.lit(" "), F.lit("hi"))).first()
    assert row[0] == 3 and row[1] is None and row[2].endswith("/users/u/starred?sort=created&direction=asc&per_page=100&page=2") and row[3] == "hi"


def test_blobs(spark):
    rows = np.array([[1.5, -2.0], [0.0, 3.25]], dtype="<f4")
    blob = blobs.encode(rows)
    assert np.array_equal(blobs.decode(blob), rows) and blobs.decode(blobs.encode(np.zeros((0, 3)))).shape[0] == 0
    for bad, why in ((b"SW", "header"), (b"XX" + blob[2:], "not a vector"), (blob[:2] + b"\x09" + blob[3:], "version"), (blob[:-1], "length")):
        with pytest.raises(ValueError, match=why):
            blobs.decode(bad)
    df = spark.createDataFrame([(blob, [7, 8]), (blob, [1])], "blob binary, ids array<bigint>")
    assert [(r.id, r.vector) for r in blobs.read_vectors(df).orderBy("id").collect()] == [(7, [1.5, -2.0]), (8, [0.0, 3.25])]
    assert bytes(spark.createDataFrame([([[1.5, -2.0], [0.0, 3.25]],)], "v array<array<float>>").select(blobs.encoded("v")).first()[0]) == blob


def day(n):
    return f"2024-01-{n:02d}T00:00:00Z"


STARS = [(1, day(1), day(1)), (2, day(10), day(2)), (3, day(3), day(3)), (4, day(4), day(4))]


@pytest.mark.parametrize(
    "stars, states, vectors, window, size, want",
    [
        (STARS, [(1, "ok", day(1)), (2, "ok", day(1)), (4, "error", day(4))], None, 1500, 2, [[4, 3], [2]]),
        (STARS, [(1, "ok", day(1)), (2, "missing", day(10)), (3, "unavailable", day(3)), (4, "ok", day(4))], None, 1500, 2, []),
        (STARS, [(i, "ok", day(20)) for i in (1, 2, 3, 4)], [3, 4], 1500, 2, [[2, 1]]),
        (STARS, [], None, 2, 2, [[4, 3]]),
        ([(10, None, None), (11, None, day(1)), (12, None, day(1))], [], None, 1500, 3, [[11, 12, 10]]),
    ],
)
def test_readme_work(spark, stars, states, vectors, window, size, want):
    s = spark.createDataFrame(stars, "id long, pushed_at string, starred_at string")
    t = spark.createDataFrame(states, "id long, status string, checked_at string")
    v = None if vectors is None else spark.createDataFrame([(i,) for i in vectors], "id long")
    got = {}
    for r in PL.readme_work(s, t, v, window, size).orderBy("place").collect():
        got.setdefault(r.batch, []).append(r.id)
    assert list(got.values()) == want


def test_admission(spark):
    rows = [(1000, True, None, None, False), (1000, False, None, 500, False), (1000, False, 900, None, False), (1000, False, 900, 900, True), (1000, None, None, None, None)]
    df = spark.createDataFrame(rows, "now int, running boolean, full int, list int, force boolean")
    got = [tuple(r.a) for r in df.select(PL.admission(*(F.col(c) for c in ("now", "running", "full", "list", "force")), full=21600, relist=900).alias("a")).collect()]
    assert got == [(False, "in-progress", 0), (False, "cooldown-relist", 400), (False, "cooldown-full", 21500), (True, "ok", 0), (True, "ok", 0)]


def test_embedding_work(spark):
    docs = spark.createDataFrame([(1, "hello"), (2, "new"), (3, "other")], "id long, doc string")
    old = spark.createDataFrame([(1, "4f9f2cab"), (2, "")], "id long, hash string")
    assert {r.id for r in PL.embed_work(docs, old).collect()} == {2, 3}


def test_upsert_keeps_and_fills(spark):
    schema = "id long, name string, first string, at string"
    old = spark.createDataFrame([(1, "a", "f1", "t1"), (2, "b", "f2", None)], schema)
    new = spark.createDataFrame([(2, None, "g", None), (3, "c", "g", "t3"), (1, "z", "g", None)], schema)
    got = {tuple(r) for r in MG.upsert(old, new, ["id"], keep_old=["first"], fill=["at"]).collect()}
    assert got == {(1, "z", "f1", "t1"), (2, None, "f2", None), (3, "c", "g", "t3")}


def test_budgeted_text_skips_and_goes_on(spark):
    docs = spark.createDataFrame([("u", 1, "x" * 6), ("u", 2, "x" * 6), ("u", 3, "x" * 4), ("v", 1, None), ("v", 2, "x" * 11)], "login string, id long, readme string")
    assert {(r.login, r.id): r.indexed_chars for r in MG.budgeted_text(docs, 10).collect()} == {("u", 1): 6, ("u", 2): 0, ("u", 3): 4, ("v", 1): 0, ("v", 2): 0}


def test_budgeted_text_against_a_fold(spark):
    rng = np.random.default_rng(4)
    rows = [(f"l{k % 3}", int(i), "x" * int(rng.choice([0, 1, 3, 9, 30, 80])) if i % 17 else None) for k, i in enumerate(rng.permutation(240))]
    for budget, cap in ((200, 50), (1000, 1000)):
        used, want = {}, {}
        for login, i, text in sorted(rows):
            n = min(len(text or ""), cap)
            fits = used.get(login, 0) + n <= budget
            used[login] = used.get(login, 0) + n * fits
            want[login, i] = n * fits
        got = MG.budgeted_text(spark.createDataFrame(rows, "login string, id long, readme string").repartition(5), budget, cap)
        assert {(r.login, r.id): r.indexed_chars for r in got.collect()} == want


def test_put_and_publish(spark):
    schema = "id long, readme string, readme_state string, readme_run string"
    rows = spark.createDataFrame([(1, None, None, None), (2, "old", "present", None)], schema)
    put = MG.put_readmes(rows, spark.createDataFrame([(1, "x" * 70_000)], "id long, text string"), "r1")
    assert len(put.where("id = 1").first().readme) == 65_536
    assert {r.id: r.readme_state for r in MG.publish_readmes(put, rows.select("id"), "r2").collect()} == {1: "pending", 2: "present"}
    assert {r.id: r.readme_state for r in MG.publish_readmes(put, rows.select("id"), "r1").collect()} == {1: "present", 2: "present"}


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (1, 12, 3), (2, 20, 1)], "query_id long, id long, rank long")
    grades = spark.createDataFrame([(1, 11, 2), (1, 12, 1), (1, 99, 2)], "query_id long, id long, grade int")
    queries = spark.createDataFrame([(1,), (2,), (3,)], "query_id long")
    got = {r.query_id: r for r in ME.query_metrics(ranked, grades, queries).collect()}
    ideal = 3 + 3 / np.log2(3) + 1 / 2
    assert (got[1].p5, got[1].p5_strict, got[1].r10, got[1].mrr, got[1].success3) == pytest.approx((0.4, 0.2, 0.5, 0.5, 1.0))
    assert got[1].ndcg10 == pytest.approx((3 / np.log2(3) + 1 / 2) / ideal)
    assert got[2].mrr is None and got[2].r10 is None and got[3].p5 == 0.0
    assert ME.mean_metrics(ME.query_metrics(ranked, grades, queries)).first().mrr == pytest.approx(0.5)


def events(spark, path):
    rows = [(i, "a" if i % 3 else "b", f"2024-01-0{1 + i // 20} 00:00:{i % 20:02d}") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, key string, t string").select("id", "key", F.to_timestamp_ntz("t").alias("ts"))
    df.repartition(2).write.parquet(path)
    return df, spark.readStream.schema(df.schema).parquet(path)


def test_burst_stream_equals_batch(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    q = ST.burst_stream(ST.timed(stream, late="0 seconds"), 3, 10).writeStream.format("memory").queryName("bursts").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    want = {(r.key, r.window_start, r.requests, r.denied) for r in PL.burst_windows(batch.withColumn("ts", F.col("ts").cast("timestamp")), 3, 10).collect()}
    got = {tuple(r) for r in spark.table("bursts").collect()}
    assert got <= want and {w for w in want - got} <= {w for w in want if w[1] == max(x[1] for x in want)}  # the last window stays open


def test_state_stream_equals_batch(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    patch = lambda df: df.select("id", "key", F.when(F.col("id") % 4 == 0, F.col("id")).alias("phase"))
    q = ST.state_stream(patch(stream), "key", "id", ["phase"]).writeStream.format("memory").queryName("folded").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("folded").collect()} == {tuple(r) for r in PL.fold_state(patch(batch), "key", "id", ["phase"]).collect()}


def test_daily_budget(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 23:59:59"), (2, "a", "2024-01-01 01:00:00"), (3, "a", "2024-01-02 00:00:00")], "id long, key string, t string").select("id", "key", F.to_timestamp("t").alias("ts"))
    assert {r.id: r.allowed for r in PL.daily_budget(rows, 1).collect()} == {1: False, 2: True, 3: True}


def test_budget_stream_equals_batch(spark, tmp_path):
    batch, stream = events(spark, str(tmp_path / "in"))
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        q = ST.budget_stream(stream.withColumn("ts", F.col("ts").cast("timestamp")), 5).writeStream.format("memory").queryName("budget").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
        q.awaitTermination()
    finally:
        spark.conf.set(key, old)
    got = {(r.id, r.used, r.allowed) for r in spark.table("budget").collect()}
    assert got == {(r.id, r.used, r.allowed) for r in PL.daily_budget(batch, 5).collect()}


# ---- recorded responses ----


def test_rows_of_recorded_responses():
    from starloom.sources.recorded import row_of

    said = lambda **x: row_of(4, json.dumps(x))
    link = '<https://h/u?per_page=100&page=3>; rel="prev", <https://h/u?per_page=100&page=5>; rel="next"'
    assert said(status=200, headers={"Link": link, "ETag": "e1", "x-ratelimit-remaining": "12"}, body="[]") == (4, 200, "ok", "e1", 5, None, 12, "[]", None)
    assert said(status=200, body="[1]")[2:5] == ("ok", None, None) and said(status=304, headers={"etag": "e"}, body="")[2:4] == ("unchanged", "e")
    assert said(status=404)[2] == "missing" and said(status=403)[2:6] == ("limited", None, None, None) and said(status=429, headers={"retry-after": "30"})[5] == 30 and said(status=429, headers={"retry-after": "-1"})[5] is None
    assert said(status=502)[8] == "HTTP 502" and said(status=200, body="{")[2] == "unreadable" and said(status=200)[2] == "unreadable"
    assert row_of(1, "{")[2] == row_of(1, "[]")[2] == row_of(1, '{"body": "x"}')[2] == row_of(1, '{"status": "x"}')[2] == "unreadable"


def test_recorded_pages_in_batches_and_as_a_stream(spark, tmp_path):
    from starloom.sources import recorded as RD

    path = str(tmp_path / "recording")
    body = lambda p: json.dumps([{"id": p * 10 + k} for k in range(3)])
    rows = [(p, {3: 304, 5: 429}.get(p, 200), {"link": f'<https://h/u?page={p + 1}>; rel="next"', "retry-after": "7"}, body(p)) for p in range(1, 8)]
    table = spark.createDataFrame(rows, "page int, status int, headers map<string,string>, body string")
    RD.record(table.where("page <= 4"), path)
    RD.register(spark)
    read = lambda **o: spark.read.format("recorded").options(path=path, **o).load()
    assert [(r.page, r.state, r.next) for r in read().orderBy("page").collect()] == [(1, "ok", 2), (2, "ok", 3), (3, "unchanged", None), (4, "ok", 5)]
    assert read().rdd.getNumPartitions() == 4

    def batch() -> None:
        stream = spark.readStream.format("recorded").option("path", path).load().writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        stream.awaitTermination()

    batch()
    table.where("page > 4").select("page", F.to_json(F.struct("status", "headers", "body")).alias("value")).repartition("page").write.mode("append").partitionBy("page").text(path)
    batch()
    got = sorted(map(tuple, spark.read.schema(RD.SCHEMA).parquet(str(tmp_path / "out")).collect()))
    assert got == sorted(map(tuple, read().collect())) and len(got) == 7
    capped = {r.page: (r.state, r.error) for r in read(pages=5).collect()}
    assert capped[6] == ("capped", "more than 5 pages") and 7 not in capped
    assert sorted(r.page for r in RD.listing(read()).collect()) == [1, 2, 3, 4, 5] and spark.read.format("recorded").option("path", str(tmp_path / "none")).load().count() == 0
