"""Components, Jaccard join and vector graph against brute force and on odd rows."""

import itertools
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import jaccard_join as J
from starloom.llm import vector_graph as VG
from starloom.llm.components import components
from starloom.llm.jaccard_join import jaccard_join, light_boundary, required, subset_sizes
from starloom.llm.vector_graph import build_graph, near_vectors, range_search

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def roots_of(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (300, 2))] + [(k, k + 1) for k in range(1000, 1060)] + [(5000, k) for k in range(5001, 5300)]
    want = roots_of({n for e in edges for n in e}, edges)
    got = {r.node: r.root for r in components(spark.createDataFrame([*edges, (None, 1), (7, 7)], "u long, v long")).collect()}
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def shingle_set(text, width):
    w = [x.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")) for x in WORD.findall(text or "")]
    return {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())


def brute(rows, width, pct):
    sets = {i: shingle_set(t, width) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= pct * len(sets[a] | sets[b])]
    roots = roots_of(sets, links)
    return {i: (len(sets[i]), roots[i]) for i in sets}


def mutated(rng, words, n):
    w = list(words)
    for _ in range(n):
        k, how = int(rng.integers(0, len(w))), rng.integers(0, 3)
        if how == 0:
            w[k] = f"e{rng.integers(0, 50)}"
        elif how == 1:
            w.insert(k, f"e{rng.integers(0, 50)}")
        elif len(w) > 1:
            del w[k]
    return w


@pytest.mark.parametrize("width, pct", [(4, 85), (5, 80), (1, 80)])
def test_jaccard_join(spark, width, pct):
    rng = np.random.default_rng(width * 100 + pct)
    rows = []
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 2000, int(rng.choice([1, 3, 5, 8, 12, 20, 60, 200])))]
        for _ in range(int(rng.integers(1, 9))):
            rows.append(" ".join(mutated(rng, base, int(rng.integers(0, 5)))))
    shared = " ".join(f"p{k}" for k in range(60))
    rows += [shared + " " + " ".join(f"w{x}" for x in rng.integers(0, 2000, 50)) for _ in range(60)]
    hot = [f"h{k}" for k in range(90)]
    rows += [" ".join(mutated(rng, hot, int(rng.integers(0, 6)))) for _ in range(150)]
    rows += ["Same TEXT twice", "same text\ttwice", "", None, " \n", "one", "one", "Ünï", "ünï", "x " * 30_000, "X " * 29_000]
    rows = list(enumerate(rows))
    order = rng.permutation(len(rows))
    df = spark.createDataFrame([(rows[k][0], rows[k][1], 1, "k") for k in order], "doc_id long, text string, n int, key string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df, width=width, similarity_pct=pct).collect()}
    assert got == brute(rows, width, pct)


def test_jaccard_join_on_odd_tables(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f"), (None, None)], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in jaccard_join(df).collect())
    assert got == [("3", 3, "3"), ("3", 3, "3"), ("None", 0, "None"), ("None", 3, "None")]
    assert jaccard_join(df.limit(0)).count() == 0


def test_repeated_ids_with_other_texts_keep_their_links(spark):
    """Every row of every text has the smallest id that its own text reaches, whatever ids other texts share."""
    rng = np.random.default_rng(9)
    text = lambda: [f"w{x}" for x in rng.integers(0, 5000, 60)]
    rows = []
    for g in range(30):
        base = text()
        for _ in range(3):
            rows.append((int(rng.integers(0, 25)), " ".join(mutated(rng, base, int(rng.integers(0, 2))))))
    rows += [(None, rows[0][1]), (7, None), (7, "")]
    sets = [shingle_set(t, 4) for _, t in rows]
    named = [k for k, (i, _) in enumerate(rows) if i is not None]
    links = [(a, b) for a, b in itertools.combinations(named, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    roots = roots_of(named, links)
    smallest = {}
    for k in named:
        smallest[roots[k]] = min(smallest.get(roots[k], 10**9), rows[k][0])
    want = sorted(((rows[k][0], len(sets[k]), smallest[roots[k]]) for k in named)) + [(None, len(sets[90]), None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join(df).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_what_travels_for_a_shingle_hardly_grows_with_the_buckets(monkeypatch):
    """The larger the input, the more buckets there are, and the fewer shingles of a class meet in one."""
    monkeypatch.setattr(J, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)), raising=False)
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)) for _ in range(500)]
    batch = pa.RecordBatch.from_pydict({"id": pa.array(range(500), pa.int64()), "text": pa.array([t.encode() for t in texts])})
    few, many = (sum(len(x) for b in J._pack(4, n)([batch]) for x in b.column("payload").to_pylist() if x) / (500 * 397) for n in (20, 2000))
    assert 4 < few < many < 1.3 * few and many < 6


def test_copies_in_many_partitions(spark):
    """Classes that several blocks hold are one, in lists and in what is compared."""
    rng = np.random.default_rng(6)
    base = [[f"w{x}" for x in rng.integers(0, 5000, int(n))] for n in rng.choice([2, 5, 9, 40, 80], 40)]
    rows = list(enumerate(" ".join(mutated(rng, w, int(rng.integers(0, 2)))) for w in base for _ in range(6)))
    rows += [(1000 + i, t) for i, t in rows[::3]]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join(df).collect()} == brute(rows, 4, 85)


def test_bounds():
    for pct in (80, 85):
        for a in range(1, 60):
            for b in range(a, 70):
                t = required(a, b, pct)
                assert 100 * t >= pct * (a + b - t) and 100 * (t - 1) < pct * (a + b - t + 1)
                if t <= a:
                    assert t in subset_sizes(a, pct) and t in subset_sizes(b, pct)
    assert light_boundary({}, 85) >= 1 and light_boundary({n: 100 for n in range(1, 17)}, 85) >= 6


def vectors_of(seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(700, 32))
    near = base[:150] + 0.08 * rng.normal(size=(150, 32))
    ball = rng.normal(size=(1, 32)) + 0.12 * rng.normal(size=(120, 32))
    return np.concatenate([base, near, ball, np.repeat(base[:1], 30, axis=0)]).astype(np.float32)


def units(x):
    return x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)


def test_search_in_a_shard():
    x = units(vectors_of())[:-30]
    found = {(q, v) for qs, vs, cs in range_search(x, build_graph(x), 0.95) for q, v, c in zip(qs.tolist(), vs.tolist(), cs) if c >= 0.95}
    true = x @ x.T >= 0.95
    np.fill_diagonal(true, False)
    assert found <= {tuple(t) for t in np.argwhere(true).tolist()} and len(found) >= 0.98 * true.sum()


def true_links(x, sizes=None):
    """Of each row: the number of others within the limit, and its root."""
    n, got, links = len(x), np.zeros(len(x), int), []
    for i in range(0, n, 500):
        s = x[i : i + 500] @ x.T >= 0.95
        s[np.arange(len(s)), np.arange(i, i + len(s))] = False
        got[i : i + 500] = s.sum(axis=1)
        links += [(i + a, int(b)) for a, row in enumerate(s) for b in np.flatnonzero(row)[:40]]
    return got, roots_of(range(n), links)


def test_shards_that_are_dealt_again(spark, monkeypatch):
    """One cluster of over 6,000 vectors in shards that it does not fit in: links between shards are found over the united lists."""
    monkeypatch.setattr(VG, "MOST", 1_500)
    monkeypatch.setattr(VG, "SHARD", 500)
    rng = np.random.default_rng(3)
    x = np.concatenate([np.pad(rng.normal(size=(6_200, 3)), ((0, 0), (0, 5))), rng.normal(size=(800, 8))])  # all over a sphere, and others
    reps = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    shards = VG.deal(reps.selectExpr("vec_id as c", "embedding as v"), len(x), 3).selectExpr("explode(shards) as s").groupBy("s").count().toPandas()["count"]
    assert shards.max() <= 1_500 and shards.sum() >= len(x)
    out, recall = VG.audited_vectors(reps)
    got = {r.vec_id: r for r in out.collect()}
    want, roots = true_links(units(x))
    found = np.array([got[i].n_links for i in range(len(x))])
    linked = want > 0
    assert (found <= want).all() and (found[linked] / want[linked]).mean() >= 0.9 and recall >= 0.9
    assert np.mean([got[i].component_id == roots[i] for i in range(len(x))]) > 0.98


def test_vectors_of_any_length_link(spark):
    rows = [(1, [1e200, 1e200, 0.0]), (2, [1e200, 1e200, 0.0]), (3, [1e-200, 1e-200, 0.0]), (4, [5e-324, 5e-324, 0.0]), (5, [-1e200, 1.0, 0.0]), (6, [1.7e308, 1.7e308, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(df).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 6: (4, 1), 5: (0, 5)}


def test_ids_that_vectors_share_and_ties(spark):
    a, b, c = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    near = lambda v: [x + 0.01 for x in v]
    df = spark.createDataFrame([(7, a), (7, b), (8, near(a)), (9, near(b)), (2, c), (2, c)], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(2, 1, 2), (2, 1, 2), (7, 1, 7), (7, 1, 7), (8, 1, 7), (9, 1, 7)]


def test_low_recall_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(VG, "audit", lambda *_: 0.5)
    with pytest.raises(RuntimeError, match="recall"):
        near_vectors(spark.createDataFrame([(1, [1.0, 0.0])], "vec_id long, embedding array<double>"))


def test_near_vectors(spark):
    x = vectors_of()
    rows = [(i, v.tolist(), 1, 0.5) for i, v in enumerate(x)] + [(5000, None, 1, 0.1), (5001, [0.0] * 32, 1, 0.1), (5002, [float("nan")] * 32, 1, 0.1), (5003, [None] * 32, 1, 0.1), (5004, [], 1, 0.1), (5005, [1.0] * 3, 1, 0.1), (5006, [1.0] * 3, 1, 0.1), (None, [1.0] * 3, 1, 0.1), (5007, [float("inf")] * 32, 1, 0.1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, m int, cos double")
    got = {r.vec_id: r for r in near_vectors(df).collect()}
    assert len(got) == len(rows)
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    s = u @ u.T >= 0.95
    np.fill_diagonal(s, False)
    roots = roots_of(range(len(x)), np.argwhere(s).tolist())
    found = np.array([got[i].n_links for i in range(len(x))])
    assert (found <= s.sum(1)).all() and found.sum() >= 0.98 * s.sum()
    assert np.mean([got[i].component_id == roots[i] for i in range(len(x))]) > 0.98
    assert all(got[i].kept == (got[i].component_id == i) for i in range(len(x)))
    assert [got[i].n_links for i in (5000, 5001, 5002, 5003, 5004, 5007)] == [0] * 6 and got[5006].component_id == 5005 and got[5005].n_links == 1
    assert near_vectors(df.limit(0)).count() == 0
