"""Markdown and its chunks, the query grammar, sets of ids, rules and varied pages."""

import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from starloom.functions import markdown as MD
from starloom.operators import diversity as DV
from starloom.operators import idsets as IS
from starloom.operators import index as IX
from starloom.operators import rules as RU
from starloom.plans import chunks as CH
from starloom.plans import grammar as GR

REPO = "id long, full_name string, owner string, name string, description string, topics array<string>, language string, license string, stars long, archived boolean, readme string"


def repo(i, full, description=None, topics=(), language=None, stars=0, archived=False, readme=None, license=None):
    owner, name = full.split("/")
    return (i, full, owner, name, description, list(topics), language, license, stars, archived, readme)


# ---- markdown ----


@pytest.mark.parametrize(
    "text, want",
    [
        ("", ""), ("plain words", "plain words"), ("# A\n\n\n\n## B ##x", "A\n\nB ##x"), ("#hash #5", "#hash #5"), ("> a\n>b\n  > c", "a\nb\nc"), ("a <!-- one\ntwo --> b <!-- open", "a b <!-- open"),
        ("[![badge](https://x/y.svg)](https://x) after", "after"), ("see [the [nested] text](http://a(b)c) now", "see the [nested] text now"), ("[not a link] (x) ![alt", "[not a link] (x) ![alt"), ("1 < 2 and 3 > 2", "1 < 2 and 3 > 2"), ("a<br>b<img src='x'/>c", "a b c"),
        ("~~~py\n# no heading\n[a](b)\n~~~\n# yes", "# no heading\n[a](b)\n \nyes"), ("```\nopen [a](b)", "open [a](b)"), ("````\n```\ninner\n````\nout", "```\ninner\n \nout"), ("a\r\nb\t\tc", "a\nb c"), ("[two\nlines](x) end", "two\nlines end"),
    ],
)
def test_plain(text, want):
    assert MD.plain(text) == want


def test_plain_of_a_column(spark):
    rows = spark.createDataFrame([(None,), ("# a [b](c)",)], "t string").select(MD.plain_markdown(F.col("t"))).collect()
    assert [r[0] for r in rows] == [None, "a b"]


def made_document(rng, n):
    """Headings, paragraphs, lists and fences, some longer than a chunk."""
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 9)))
    out = []
    for k in range(n):
        kind = rng.random()
        if kind < 0.2:
            out.append("#" * rng.randint(1, 4) + f" Part {k}")
        elif kind < 0.4:
            out.append("```py\n" + "\n".join("  ".join(word() for _ in range(5)) + "\n" * rng.randint(0, 1) for _ in range(rng.randint(1, 60))) + "\n```")
        else:
            out.append("\n".join(" ".join(word() for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 12))))
    return "\n\n".join(out)


@pytest.mark.parametrize("seed", range(6))
def test_chunks_keep_everything_and_split_no_fence(seed):
    text = made_document(random.Random(seed), 30)
    found = MD.chunks(text, 600, 0.15)
    bodies = [b for _, b in found]
    squeezed = lambda x: "".join(x.split())
    whole, at = squeezed(text), 0
    for before, body in itertools.pairwise(["", *bodies]):
        b = squeezed(body)
        repeated = next(n for n in range(len(b), -1, -1) if squeezed(before).endswith(b[:n]) and whole.startswith(b[n:], at))
        assert repeated <= 600 * 0.15 and whole.startswith(b[repeated:], at)
        at += len(b) - repeated
    assert at == len(whole)
    fences = [squeezed("```" + f + "```") for f in text.split("```")[1::2]]
    assert all(any(f in squeezed(b) for b in bodies) for f in fences) and all(b.count("```") % 2 == 0 for b in bodies)
    assert all(len(b) <= 600 or b.startswith("```") for b in bodies)
    headings = [""]
    for h, b in found:
        mine = [x.lstrip("#").strip() for x in b.split("\n") if x.startswith("#")]
        assert h == headings[-1] or h in mine
        headings += mine


def test_chunks_of_odd_documents():
    assert MD.chunks("") == MD.chunks(" \n\n ") == []
    assert MD.chunks("# Only") == [("Only", "# Only")]
    assert MD.chunks("x" * 3000, 1000, 0.15) == [("", "x" * 1000)] * 3
    code = "```\n" + "y" * 3000
    assert MD.chunks(f"a\n\n{code}\n\n", 1000) == [("", "a"), ("", code + "\n\n")]
    assert [h for h, _ in MD.chunks("# A\n\n" + "a " * 400 + "\n\n## B\n\n" + "b " * 400, 900)] == ["A", "B"]


def test_chunk_hashes_tell_what_to_embed(spark):
    rng = random.Random(5)
    text = made_document(rng, 24)
    docs = lambda t: spark.createDataFrame([(1, "o/a", t), (2, "o/b", None), (3, "o/c", "")], "id long, full_name string, readme string")
    old, new = MD.markdown_chunks(docs(text)), MD.markdown_chunks(docs(text + "\n\n# News\n\nsomething new"))
    rows = old.orderBy("n").collect()
    assert {r.id for r in rows} == {1} and [r.n for r in rows] == list(range(len(rows))) and {r.of for r in rows} == {len(rows)}
    seen = old.select(F.sha2(MD.chunk_text(F.lit("o/a"), F.col("heading"), F.col("body")), 256).alias("h"), "hash").collect()
    assert all(r.h == r.hash for r in seen) and rows[0].hash == hashlib.sha256(f"o/a — {rows[0].heading}\n{rows[0].body}".encode()).hexdigest()
    change = {r.change: r["count"] for r in MD.changed_chunks(new, old).groupBy("change").count().collect()}
    assert change["keep"] >= len(rows) - 1 and 1 <= change["embed"] <= 2 and change.get("drop", 0) <= 1


# ---- chunks to repositories ----


def test_repositories_by_their_best_chunks(spark):
    rng = np.random.default_rng(1)
    hits = [(int(q), int(i), float(s)) for q, i, s in zip(rng.integers(0, 5, 300), rng.integers(0, 20, 300), rng.integers(0, 40, 300) / 40)]
    counts = {i: int(i * 3) for i in range(15)}
    got = CH.roll_up(spark.createDataFrame(hits, "query_id int, id long, score double"), spark.createDataFrame([*counts.items()], "id long, chunks long"), 7)
    want = []
    for q in range(5):
        worth = {}
        for i in {h[1] for h in hits if h[0] == q}:
            best = sorted((s for a, b, s in hits if (a, b) == (q, i)), reverse=True)[:2]
            worth[i] = round((best[0] + 0.3 * sum(best[1:])) / (1 + 0.03 * np.log(counts.get(i, 0) + 1)), 9)
        want += [(q, i, worth[i], k) for k, i in enumerate(sorted(worth, key=lambda i: (-worth[i], i))[:7], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_search_of_chunks(spark, tmp_path):
    long = "\n\n".join(f"## Part {k}\n\n" + f"filler{k} words " * 60 + ("sessions and tokens" if k in (2, 5) else "") for k in range(8))
    docs = spark.createDataFrame([repo(1, "o/a", readme=long), repo(2, "o/b", readme="# B\n\nsessions"), repo(3, "o/c", readme="# C\n\nother things"), repo(4, "o/d")], REPO)
    index = CH.chunk_index(docs, str(tmp_path / "ix"), buckets=4)
    got = [(r.id, r["rank"]) for r in CH.chunk_search(index, ["sessions"], 5).orderBy("rank").collect()]
    assert sorted(i for i, _ in got) == [1, 2] and [r for _, r in got] == [1, 2]
    plan = CH.chunk_search(index, ["sessions"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan


# ---- grammar ----


@pytest.mark.parametrize(
    "text, must, never, quoted",
    [
        ("http client", ("http", "client"), (), False), ('"http client" -retry', ("http client",), ("retry",), True), ('a -"b c" d', ("a", "d"), ("b c",), True), ('a "b c', ("a", "b c"), (), True), ('"a "b" c', ("a", "b", "c"), (), True),
        ("-- - \"\" -\"\" '", (), (), False), ("rate-limit -useEffect", ("rate limit",), ("useeffect",), False), ("a a -b -b", ("a",), ("b",), False), ("--x y-", ("y",), ("x",), False), ('x"y z"w', ("x", "y z", "w"), (), True), ("\x00a\x07b\tNaïve", ("a", "b", "naive"), (), False), ("", (), (), False), (None, (), (), False),
        ('-"open phrase', (), ("open phrase",), True),
    ],
)
def test_queries_are_parsed_whatever_they_are(text, must, never, quoted):
    got = GR.parse(text)
    assert (got.must, got.never, got.quoted, got.truncated) == (must, never, quoted, False)


def test_long_queries_are_cut():
    got = GR.parse(" ".join(f"w{k}" for k in range(100)))
    assert len(got.must) == 64 and got.truncated
    assert GR.parse("a" * 600).must == ("a" * 512,) and GR.parse("a" * 600).truncated and not GR.parse("a" * 512).truncated
    for seed in range(200):  # never an error
        rng = random.Random(seed)
        GR.parse("".join(rng.choice('ab -"\' ') for _ in range(rng.randint(0, 40))))


def test_boolean_search(spark, tmp_path):
    docs = spark.createDataFrame([repo(1, "o/a", readme="vector database in rust"), repo(2, "o/b", readme="database of vectors"), repo(3, "o/c", readme="rust client", topics=["vector"]), repo(4, "o/d", "nothing here")], REPO)
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    found = lambda q, among=None: {(r.id, r.fallback) for r in GR.boolean_leg(index, GR.parse(q), 10, among).collect()}
    assert found("vector database") == {(1, None), (2, None)} and found('"vector database"') == {(1, None)} and found("vector -database") == {(3, None)}
    assert found("client database") == {(1, "or"), (2, "or"), (3, "or")} and found('client "in rust"') == set() and found("client database -rust") == set()
    assert found("-rust") == {(2, None), (4, None)} and found("") == set() and found("rust", docs.where("id = 3")) == {(3, None)} and found("vector", docs.where("id = 4")) == set()
    named = lambda q: {r.id for r in GR.without_named(docs, GR.parse(q)).collect()}
    assert named("x -vector") == {1, 2, 4} and named('x -"nothing here"') == {1, 2, 3} and named("x -rust") == {1, 2, 3, 4}
    plan = GR.boolean_leg(index, GR.parse('"in rust" -client'), 10)._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and plan.count("PartitionFilters: [isnotnull(bucket") == plan.count("PartitionFilters: [")


# ---- sets and rules ----


def test_sets_of_ids(spark):
    rng = np.random.default_rng(2)
    ids = [0, 1, 32767, 32768, 32769, 65536, 65537, -1, -32768, -40000, 10**12, *map(int, rng.integers(0, 200_000, 300))]
    held = {n: {i for i in ids if rng.random() < 0.5} for n in ("a", "b", "c")}
    universe = set(ids[:200])
    members = spark.createDataFrame([(n, i) for n, s in held.items() for i in [*s, *list(s)[:5]]] + [("a", None)], "name string, id long")
    a, b, c, none = (IS.IdSet.of(n) for n in ("a", "b", "c", "none"))
    said = {"any": IS.any_of("a", "b", "none"), "all": IS.all_of("a", "b", "c"), "rest": ~(a | b | c), "odd": (a & ~b) | (c & ~(a | none)), "none": none}
    got = {}
    for r in IS.members_of(said, IS.bitmaps(members), spark.createDataFrame([(i,) for i in universe] + [(None,)], "id long")).collect():
        assert r.id not in got.setdefault(r.name, set())
        got[r.name].add(r.id)
    x, y, z = (held[n] & universe for n in ("a", "b", "c"))
    assert {k: got.get(k, set()) for k in said} == {"any": x | y, "all": x & y & z, "rest": universe - x - y - z, "odd": (x - y) | (z - x), "none": set()}


def test_rules(spark):
    stars = ["2024-01-05T00:00:00Z", "2023-01-01T00:00:00Z", None]
    rows = [(*repo(k, f"o/durable-jobs{k % 3}", ["a tui", None, "Background things"][k % 3], [["TUI"], [], ["cli", "tui"]][k % 3], [None, "Rust", "go"][k % 3], 100 * k, k % 4 == 0, license=["MIT", None][k % 2]), stars[k % 3]) for k in range(12)]
    repos = spark.createDataFrame(rows, REPO + ", starred_at string")
    f = lambda *x: {"version": 1, "match": "all", "filters": [dict(zip(("field", "op", "value"), y)) for y in x]}
    rules = {
        "rust": f(("language", "eq", "RUST")), "not-rust": f(("language", "ne", "rust")), "big": f(("stars", "gte", 500), ("stars", "lte", 900)), "tui": f(("topics", "has", "tui")), "some": f(("topics", "in", ["cli", "x"]), ("archived", "eq", False)),
        "since": f(("starred_at", "gte", "2024-01-01")), "words": {"version": 1, "q": "Durable things"}, "text": '{"version": 1, "filters": [{"field": "license", "op": "in", "value": ["mit"]}]}',
        "bad1": f(("forks", "eq", 1)), "bad2": f(("stars", "has", 1)), "bad3": f(("stars", "gte", "many")), "bad4": {"version": 2}, "bad5": "{", "bad6": f(), "bad7": f(("topics", "in", [])), "bad8": f(("starred_at", "gte", "soon")), "bad9": {"version": 1, "q": "x", "sql": "1=1"}, "bad10": f(("archived", "eq", 1)), "bad11": [],
    }
    got, errors = {}, {}
    for r in RU.rule_members(repos, rules).collect():
        (errors.__setitem__(r.slug, r.error) if r.error else got.setdefault(r.slug, set()).add(r.repo_id))
    assert set(errors) == {f"bad{k}" for k in range(1, 12)} and all(errors.values())
    ids = lambda keep: {k for k in range(12) if keep(k)}
    assert got == {
        "rust": ids(lambda k: k % 3 == 1), "not-rust": ids(lambda k: k % 3 != 1), "big": ids(lambda k: 5 <= k <= 9), "tui": ids(lambda k: k % 3 != 1), "some": ids(lambda k: k % 3 == 2 and k % 4), "since": ids(lambda k: k % 3 == 0), "words": ids(lambda k: k % 3 == 2), "text": ids(lambda k: k % 2 == 0),
    }
    assert RU.rule_members(repos, rules)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


# ---- varied pages ----


def slow_page(rows, limit):
    """The rules of a page, written out row by row. rows: (id, owner, root, score, lexical, vector) in order."""
    cos = lambda a, b: 0.0 if a is None or b is None else float(np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)))
    taken, held, shown = [], [], []
    for r in rows:
        if len(shown) == limit:
            break
        near = [cos(r[5], t[5]) for t in taken]
        bad = sum(t[1] == r[1] for t in taken) >= 2 or sum(t[2] == r[2] for t in taken) >= 2 or any(c >= 0.92 for c in near)
        entry = (r[0], max(0.6, 0.9 ** sum(c >= 0.85 for c in near)) * r[3])
        if bad and not (r[4] and sum(x[4] for x in rows) == 1):
            held.append((*entry, True))
        else:
            taken.append(r)
            shown.append((*entry, False))
    shown += held[: limit - len(shown)]
    order = {r[0]: k for k, r in enumerate(rows)}
    return [(i, round(s, 6), x) for i, s, x in sorted(shown, key=lambda x: (-round(x[1], 9), order[x[0]]))]


@pytest.mark.parametrize("seed", range(3))
def test_pages_against_the_rules_written_out(spark, seed):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(12):
        for k in range(int(rng.integers(1, 40))):
            vector = None if rng.random() < 0.1 else [float(x) for x in rng.normal(size=3)]
            rows.append((q, 100 * q + k, f"O{rng.integers(0, 8)}", f"{rng.choice(['better', 'auth', 'zed', 'luna'])}-{rng.choice(['ui', 'fetch', 'js'])}{k}", float(rng.integers(1, 30)), bool(rng.random() < (0.05 if q % 2 else 0.5)), vector))
    hits = spark.createDataFrame(rows, "query_id int, id long, owner string, name string, score double, lexical boolean, vector array<double>")
    got = {}
    for r in DV.diversified(hits, limit=6, window=20).orderBy("query_id", "position").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6), r.suppressed_by is not None))
    for q in range(12):
        mine = sorted((r for r in rows if r[0] == q), key=lambda r: (-r[4], r[1]))[:20]
        assert got[q] == slow_page([(r[1], r[2].lower(), r[3].split("-")[0], r[4], r[5], r[6]) for r in mine], 6)


def test_name_roots(spark):
    names = {"better-auth": "better", "better_auth-ui": "better", "BetterJS": "better", "js": "js", "-x": "x", "authserver": "auth", "ui-kit": "ui", "nextjs": "next"}
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", DV.name_root(F.col("n")).alias("r")).collect()
    assert {r.n: r.r for r in rows} == names


def test_pages_of_odd_hits(spark):
    schema = "query_id string, id long, owner string, name string, score double, lexical boolean, vector array<double>"
    assert DV.diversified(spark.createDataFrame([], schema)).count() == 0
    odd = [(None, k, None, None, 1.0, None, [None, 1.0] if k else [0.0, 0.0]) for k in range(4)]
    got = DV.diversified(spark.createDataFrame(odd, schema), limit=3).orderBy("position").collect()
    assert [(r.id, r.suppressed_by) for r in got] == [(0, None), (1, None), (2, "owner")]


# ---- collections, rerank, gates, explain, blobs ----


def test_collections_and_facets(spark):
    rng = random.Random(4)
    rows = [(*repo(k, f"o/n{k}", language=rng.choice([None, "", "Go", "go", *[f"l{j}" for j in range(12)]]), topics=[rng.choice(["A", "a", *[f"t{j}" for j in range(15)]]) for _ in range(rng.randint(0, 4))], stars=rng.choice([0, 999, 1000, 5000]), archived=rng.random() < 0.3), rng.choice([None, "2024-06-01T00:00:00Z", "2024-03-01T00:00:00Z", "2023-01-01T00:00:00Z"])) for k in range(120)]
    repos = spark.createDataFrame(rows, REPO + ", starred_at string")
    from starloom.operators.collections import collections, facets

    got = {}
    for r in collections(repos, F.to_timestamp(F.lit("2024-06-02 00:00:00"))).collect():
        assert r.repo_id not in got.setdefault((r.kind, r.key), set())
        got[(r.kind, r.key)].add(r.repo_id)
    want = {("recent", ""): {r[0] for r in rows if r[11] and r[11] == "2024-06-01T00:00:00Z"}, ("known", ""): {r[0] for r in rows if r[8] >= 1000}, ("archived", ""): {r[0] for r in rows if r[8] >= 1000 and r[9]}}
    for kind, of, most in (("language", lambda r: {r[6].lower()} if r[6] else set(), 8), ("topic", lambda r: {t.lower() for t in r[5]}, 12)):
        held = {}
        for r in rows:
            for v in of(r):
                held.setdefault(v, set()).add(r[0])
        for v in sorted(held, key=lambda v: (-len(held[v]), v))[:most]:
            want[(kind, v)] = held[v]
    assert got == want
    said = {(r.facet, r.value): r.n for r in facets(repos, {"language": F.col("language") == "go", "archived": ~F.col("archived")}, {"language": F.col("language"), "topic": F.col("topics"), "archived": F.col("archived")}).collect()}
    count = {}
    for r in rows:
        for facet, values in (("language", {r[6]} - {None}), ("topic", set(r[5])), ("archived", {str(r[9]).lower()})):
            if (facet == "language" or r[6] == "go") and (facet == "archived" or not r[9]):
                for v in values:
                    count[(facet, v)] = count.get((facet, v), 0) + 1
    assert said == count


def test_rerank(spark):
    from starloom.plans.rerank import OVERLAP, Scorer, reranked

    hits = spark.createDataFrame([(q, i, p) for q in (1, 2) for p, i in enumerate((10, 11, 12, 13, 14), 1)], "query_id int, id long, position int")
    passages = spark.createDataFrame([(q, i, t) for q in (1, 2) for i, t in ((10, "nothing"), (11, "vector search here"), (11, "z"), (12, "vector"), (14, "vector search"))] + [(1, 12, None)], "query_id int, id long, passage string")
    queries = spark.createDataFrame([(1, "vector search"), (2, None)], "query_id int, query string")
    order = lambda df, q: [(r.id, r.rerank) for r in df.where(f"query_id = {q}").orderBy("position").collect()]
    got = reranked(hits, passages, queries, depth=4)
    assert order(got, 1) == [(11, 1.0), (12, 0.5), (10, 0.0), (13, 0.0), (14, None)] and [i for i, _ in order(got, 2)] == [10, 11, 12, 13, 14]
    assert not got.where("degraded").count()
    named = reranked(hits.withColumn("f", F.when(F.col("id") == 12, 3.0).otherwise(1.0)), passages, queries, depth=4, intent=F.col("f"))
    assert order(named, 1)[0] == (12, 1.5)

    def broken(queries, passages):
        if any("vector" in q for q in queries):
            raise RuntimeError("no model")
        return [1.0] * len(passages)

    def slow(queries, passages):
        import time

        time.sleep(3)
        return [1.0] * len(passages)

    for scorer, seconds in ((Scorer(broken), 10.0), (Scorer(slow), 0.2), (Scorer(lambda q, p: [0.5]), 10.0), (Scorer(lambda q, p: [float("nan")] * len(p)), 10.0)):
        bad = reranked(hits, passages, queries, scorer, seconds=seconds, flight=1)
        assert order(bad, 1) == [(10, None), (11, None), (12, None), (13, None), (14, None)] and bad.where("query_id = 1 and not degraded").count() == 0
    seen = Scorer(lambda q, p: [float(x.startswith("query: ")) for x in q], prefix="query: ")
    assert dict(order(reranked(hits, passages, queries, seen), 1))[10] == 1.0 and OVERLAP.scores(["", "a b"], ["x", "B c"]) == [0.0, 0.5]
    assert reranked(hits.limit(0), passages, queries).count() == 0


def test_gates_tell_regressions_from_noise(spark):
    from starloom.operators.gates import gated, latency

    rng = np.random.default_rng(5)
    base = [(q, float(x), float(x)) for q, x in enumerate(rng.uniform(0.2, 0.9, 60))]
    noise = [(q, a + float(rng.normal(0, 0.05)), b - 0.03 - float(rng.uniform(0, 0.05))) for q, a, b in base] + [(999, 0.0, 0.0)]
    table = lambda x: spark.createDataFrame(x, "query_id long, steady double, fallen double")
    got = {r.metric: r for r in gated(table(noise), table(base), ["steady", "fallen"]).collect()}
    assert got["steady"].passed and not got["fallen"].passed and got["fallen"].worse == 1.0 and got["steady"].queries == 60
    assert all(r.passed for r in gated(table(base), table(base), ["steady", "fallen"]).collect()) and all(r.passed and r.queries == 0 for r in gated(table(base), table([]), ["steady"]).collect())
    assert gated(table(noise), table(base), ["fallen"], tolerance=0.2).first().passed
    times = spark.createDataFrame([(q, s, float(q)) for q in range(1, 101) for s in ("fts", "fuse")], "query_id long, stage string, ms double")
    limits = {r.stage: (round(r.p50, 2), round(r.p95, 2), r.passed) for r in latency(times, {"fts": 60.0}).collect()}
    assert limits == {"fts": (50.5, 95.05, False), "fuse": (50.5, 95.05, True)}


def test_explained_results(spark):
    import json

    from starloom.operators.fusion import fuse_ranks, normalised
    from starloom.plans.explain import Stages, explained

    hits = spark.createDataFrame([(1, 0.5, 0.02, 1.2, 100, True, ["name"], 3, None)], "id long, score double, rrf double, boost double, stars long, archived boolean, matched_by array<string>, rank_keyword long, rank_semantic long")
    said = json.loads(explained(hits, {"keyword": 1.0, "semantic": 1.0}).first().explain)
    assert said["legs"]["keyword"] == {"rank": 3, "weight": 1.0} and "rank" not in said["legs"]["semantic"] and said["factors"]["archived"] == 0.4 and said["factors"]["name"] == 1.2
    stages = Stages()
    with stages.timed("fts"):
        pass
    with stages.timed("fts"):
        pass
    rows = stages.rows(spark, "q").collect()
    assert [(r.query_id, r.stage) for r in rows] == [("q", "fts")] and rows[0].ms >= 0
    ranked = spark.createDataFrame([("keyword", 1, 1), ("semantic", 1, 1), ("semantic", 2, 2)], "leg string, id long, rank long")
    base = {r.id: r.base for r in normalised(fuse_ranks(ranked, {"keyword": 1.0, "semantic": 1.0}), {"keyword": 1.0, "semantic": 1.0}).collect()}
    assert base[1] == pytest.approx(1.0) and base[2] == pytest.approx(61 / 62 / 2)


def test_typing_errors_find_names(spark, tmp_path):
    from starloom.operators.legs import similar_names

    docs = spark.createDataFrame([repo(1, "better-auth/better-auth"), repo(2, "o/lazygit"), repo(3, "o/lazydocker"), repo(4, "x/y", "a lazy git client")], REPO)
    index = IX.SearchIndex.build(docs, str(tmp_path / "ix"), 4)
    found = lambda q, **k: [r.id for r in similar_names(index, q, 5, **k).orderBy("rank").collect()]
    assert found("lazzygit") == [2] and found("betterauht") == [1] and found("zq") == [] and found("lazygit")[0] == 2 and found("lazy", least=0.9) == [2, 3, 4]
    assert found("lazygit", candidates=docs.where("id > 2")) == [4, 3]


def test_blobs_that_do_not_fit_are_named(spark):
    from starloom.sources import blobs as BL

    good = BL.encode(np.eye(3))
    rows = [(1, good, [1, 2, 3]), (2, good, [1, 2]), (3, b"short", [1]), (4, b"XX" + good[2:], [1, 2, 3]), (5, None, [1]), (6, good, None)]
    table = spark.createDataFrame(rows, "n int, blob binary, ids array<long>")
    got = {r.n: r.error for r in BL.unfit_blobs(table).collect()}
    assert set(got) == {2, 3, 4, 5, 6} and got[2] == "3 vectors for 2 ids" and got[6] == "no ids" and BL.read_vectors(table.where("n < 3")).count() == 3
    vectors = spark.createDataFrame([(k, [float(k), 1.0]) for k in range(23)], "id long, vector array<double>")
    parts = BL.in_parts(vectors, 5)
    assert all(len(r.ids) <= 12 for r in parts.collect()) and parts.count() > 2
    assert sorted((r.id, list(r.vector)) for r in BL.read_vectors(parts).collect()) == [(k, [float(k), 1.0]) for k in range(23)]


def test_small_texts(spark):
    from starloom.functions import display as D
    from starloom.functions import text as T

    row = spark.range(1).select(T.all_phrases(F.array(*map(F.lit, "a b c a b".split())), 3).alias("p"), D.command_score(F.lit("Öffne Ἀθῆναι"), F.array(F.lit("naïve")), "αθηναι naive").alias("s"), D.command_score(F.lit("x"), F.array(F.lit("y")), "z").alias("n")).first()
    assert row.p == ["a b", "b c", "c a", "a b c", "b c a", "c a b"] and row.s is not None and row.n is None


# ---- errors and further filters ----


def test_errors_have_status_and_body(spark):
    from starloom.operators import planning as PL
    from starloom.plans import errors as ER

    rows = spark.createDataFrame([(True, None), (False, 90), (False, None)], "running boolean, at long").select(PL.admission(F.lit(100), F.col("running"), F.col("at"), F.lit(None).cast("long"), F.lit(False)).alias("a")).collect()
    said = []
    for r in rows:
        try:
            ER.admitted("u", r.a)
            said.append((200, None))
        except ER.ApiError as e:
            said.append((ER.response(e)[0], ER.response(e)[1]["error"]))
    assert said == [(409, "SyncInProgress"), (429, "SyncCooldown"), (200, None)]
    with pytest.raises(ER.SyncCooldown) as e:
        ER.admitted("u", rows[1].a)
    assert e.value.body()["retry_after"] == PL.FULL_COOLDOWN - 10 and e.value.body()["login"] == "u"
    assert ER.response(ValueError("secret")) == (500, {"error": "InternalError", "message": "InternalError"}) and ER.response(ER.NotFound("no x", x=1)) == (404, {"error": "NotFound", "message": "no x", "x": 1})
    assert issubclass(ER.NotFound, LookupError) and [ER.BadRequest.status, ER.BudgetExceeded.status, ER.IndexNotReady.status, ER.Upstream.status] == [400, 429, 503, 502]
    from starloom.sources.recorded import row_of
    from pyspark.sql import Row

    page = lambda text: Row("page", "status", "state", "etag", "next", "wait_s", "remaining", "json", "error")(*row_of(2, text))
    ER.of_page(page('{"status": 304}'))
    for text, status in (('{"status": 404}', 404), ('{"status": 429, "headers": {"retry-after": "9"}}', 502), ("{", 502)):
        with pytest.raises(ER.ApiError) as e:
            ER.of_page(page(text))
        assert e.value.status == status
    with pytest.raises(ER.BudgetExceeded):
        ER.within_budget("search", Row(used=4, allowed=False))


def test_further_filters(spark):
    from starloom.operators.filters import Filters, predicate

    rows = [(*repo(1, "A/x", topics=["Cli"], readme="r"), True, "2024-01-01"), (*repo(2, "a/y", topics=["tui", "x"], readme=" "), False, "2024-02-01"), (*repo(3, "b/z", readme=None), None, None)]
    table = spark.createDataFrame(rows, REPO + ", fork boolean, pushed_at string")
    left = lambda **k: {r.id for r in table.where(predicate(Filters(**k))).select("id").collect()}
    assert left(owner="A") == {1, 2} and left(has_readme=True) == {1} and left(has_readme=False) == {2, 3} and left(fork=False) == {2, 3} and left(fork=True) == {1}
    assert left(pushed_after="2024-01-15") == {2} and left(pushed_before="2024-01-15") == {1} and left(any_topics=("CLI", "tui")) == {1, 2} and left(any_topics=("none",)) == set()
