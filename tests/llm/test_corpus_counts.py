"""Repeated passages, collocations and the source audit against brute force and on odd rows."""

import hashlib
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from starloom.llm import suffix_dedup as SD
from starloom.llm.collocations import build_trie, collocations, collocations_sql, cut_trie, merge_tries, often_nodes, tokens
from starloom.llm.common import WordHasher
from starloom.llm.source_audit import audit_sql, source_audit
from starloom.llm.suffix_dedup import LENGTH, refine, repeated, repeats, repeats_sql

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def docs_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def passages():
    """Texts that share passages of many lengths, repeat themselves, and odd rows."""
    rng = np.random.default_rng(4)
    text = lambda n: "".join(rng.choice(list("abcdé xyzü "), n))
    common, line = text(150), text(90)
    rows = []
    for k in range(60):
        body = text(int(rng.integers(0, 900)))
        if k % 3 == 0:
            body += common[: int(rng.integers(80, 150))] + text(40)
        if k % 4 == 0:
            body = text(20) + line + body
        if k % 7 == 0:
            body += body[:130]
        rows.append((k, body, "en", "s", 0))
    rows += [(100, rows[3][1], "en", "s", 0), (101, rows[3][1] + text(50), "en", "s", 0), (102, "ab" * 300, "en", "s", 0), (103, "a" * 99, "en", "s", 0), (104, "a" * 100, "en", "s", 0), (105, "a" * 101, "en", "s", 0)]
    rows += [(None, rows[5][1], "en", None, 0), (None, text(300), None, "s", 0), (106, None, "en", "s", 0), (107, "", "en", "s", 0), (108, " ".join(f"w{x}" for x in rng.integers(0, 99, 60_000)), "en", "s", 0)]
    twin = text(250)
    return rows + [(109, twin, "en", "s", 0)] * 3 + [(None, twin, "en", "s", 0)]


def brute_repeats(rows):
    """Every window of every text in order, whole rows that come again last."""
    texts = [(i, (t or "").encode()) for i, t, *_ in rows]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is None, texts[k][0] or 0, k))
    seen, out = set(), []
    for k in order:
        i, x = texts[k]
        gone = np.zeros(len(x), dtype=bool)
        for s in range(len(x) - LENGTH + 1):
            w = x[s : s + LENGTH]
            if w in seen:
                gone[s : s + LENGTH] = True
            seen.add(w)
        left = bytes(np.frombuffer(x, np.uint8)[~gone])
        out.append((i, len(x), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest()))
    return sorted(out, key=str)


def test_repeats_against_all_windows(spark):
    rows = passages()
    got = repeats(docs_of(spark, rows).repartition(5))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = brute_repeats([r for r in rows if r[0] is not None or r[1] != rows[5][1]] + [r for r in rows if r[0] is None and r[1] == rows[5][1]])
    assert sorted((tuple(r) for r in got.collect()), key=str) == want


def test_repeats_of_empty_tables_and_other_columns(spark):
    assert repeats(docs_of(spark, [])).count() == 0
    rows = [(k, t, 1, 2, "x") for k, (_, t, *_) in enumerate(passages()[:20])]
    clash = spark.createDataFrame(rows, "doc_id long, text string, d1 long, runs int, row string")
    assert sorted(map(tuple, repeats(clash).collect())) == sorted(map(tuple, repeats(clash.select("doc_id", "text")).collect()))


def in_one_process(rows, n, hot):
    """The tasks of repeats() one after another, in one process."""
    keys = [(abs(hash((i, t))) % 2**60, k % 7) for k, (i, t, *_) in enumerate(rows)]
    base = {"doc_id": pa.array([r[0] for r in rows], pa.int64()), "d1": pa.array([k[0] for k in keys], pa.int64()), "d2": pa.array([k[1] for k in keys], pa.int32()), "text": pa.array([r[1] for r in rows], pa.string())}
    batch = pa.RecordBatch.from_pydict(base)

    def grouped(batches, task):
        table = pa.Table.from_batches(list(batches), SD._DEALT)
        return pa.concat_tables([task(table.filter(pa.compute.equal(table["bucket"], b))) for b in set(table["bucket"].to_pylist())])

    def lists(table, column):
        held = {}
        for a, b, x in zip(table["d1"].to_pylist(), table["d2"].to_pylist(), table[column].to_pylist()):
            held.setdefault((a, b), []).extend([x] if x else [])
        return [held.get(k, []) for k in keys]

    halves = [batch.slice(0, len(rows) // 2), batch.slice(len(rows) // 2)]
    named = grouped((x for half in halves for x in SD._find(n)(iter([half]))), SD._common)
    assert any(np.frombuffer(x, SD._ENTRY)["hot"].any() for x in named["entries"].to_pylist() if x) == hot
    around = pa.RecordBatch.from_pydict(base | {"entries": pa.array(lists(named, "entries"), pa.list_(pa.binary())), "runs": pa.array(lists(named, "runs"), pa.list_(pa.binary()))})
    runs = grouped(SD._contexts(n)(iter([around])), SD._refined)
    cut = pa.RecordBatch.from_pydict(base | {"runs": pa.array(lists(runs, "runs"), pa.list_(pa.binary()))})
    return [tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for out in SD._cut(iter([cut])) for r in out.to_pylist()]


@pytest.mark.parametrize("limit", [1, 10, 20_000])
def test_windows_of_hot_anchors(monkeypatch, limit):
    """Whatever the limit above which an anchor's windows are dealt out, the result is the same."""
    monkeypatch.setattr(SD, "HOT", limit)
    rows = [r for r in passages()[:67] if r[1] is not None]
    rows = [(k, t, *rest) for k, (_, t, *rest) in enumerate(rows)]
    assert sorted(in_one_process(rows, 3, limit < 20_000), key=str) == brute_repeats(rows)


def test_long_texts_are_searched_in_pieces(monkeypatch):
    monkeypatch.setattr(SD, "PIECE", 500)
    rows = [(k, t, *rest) for k, (_, t, *rest) in enumerate(r for r in passages() if r[1])][:40]
    assert sorted(in_one_process(rows, 2, False), key=str) == brute_repeats(rows)


def test_refined_buckets_are_equal_windows():
    rng = np.random.default_rng(9)
    for length in (9, 16, 33, 100):
        data = rng.integers(0, 2, 3000).astype(np.uint8) if length < 20 else np.tile(rng.integers(0, 9, 130).astype(np.uint8), 20)
        starts = rng.permutation(len(data) - length)[:700]
        bucket = refine(data, starts, WordHasher(), length)
        windows = [data[s : s + length].tobytes() for s in starts]
        assert all(windows.count(w) == 1 for w, x in zip(windows, bucket.tolist()) if x < 0)
        assert len({*zip(bucket.tolist(), windows)}) == len(set(windows)) == len(set(bucket.tolist()))
        first = {}
        for w, s in sorted(zip(windows, starts.tolist()), key=lambda x: x[1]):
            first.setdefault(w, s)
        assert repeated(bucket, starts).tolist() == [s != first[w] for w, s in zip(windows, starts.tolist())]


def talk():
    rng = np.random.default_rng(8)
    words = ["new", "York", "of", "the", "Straße", "hot", "dog", "in", "a"]
    rows = []
    for k in range(120):
        out = []
        for _ in range(int(rng.integers(0, 40))):
            out += ["New", "York", "City"] if rng.random() < 0.2 else ["as", "well", "as"] if rng.random() < 0.2 else [str(rng.choice(words))]
            out[-1] += str(rng.choice(["", "", "", "", ".", ",", "\n", " \t"]))
        rows.append((k, " ".join(out), [None, "en", "de", "und"][k % 4], f"s{k % 3}" if k % 5 else None, 0))
    return rows + [rows[7], rows[7], (None, rows[9][1], "en", "s1", 0), (500, None, "en", "s2", 0), (501, "", "fr", "s9", 0), (502, "hm " * 30_000, "en", "s1", 0), (503, "?! .. 12 34", "xx", "y", 0)]


def brute_phrases(rows, least, top):
    counts, n = {}, Counter()
    for _, text, lang, *_ in rows:
        lang = lang if lang is not None else "und"
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            held.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        often = {p: a for p, a in f.items() if a >= least}
        gone = {p[i : i + k] for p, a in often.items() for k in range(2, len(p)) for i in range(len(p) - k + 1) if 100 * a >= 100 * f[p[i : i + k]]}
        found = []
        for p, a in often.items():
            if len(p) > 1 and p not in gone:
                score, k = min((1000 * a * n[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, ph.decode(), -a, l, r, n[lang], -s) for i, (s, a, ph, l, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("least, top", [(3, 2000), (10, 7)])
def test_collocations(spark, least, top):
    got = collocations(docs_of(spark, talk()).repartition(5), min_count=least, top=top)
    assert sorted(map(tuple, got.collect())) == brute_phrases(talk(), least, top)


def test_collocations_of_empty_tables_and_other_columns(spark):
    assert collocations(docs_of(spark, [])).count() == 0 and collocations(docs_of(spark, [(1, None, None, None, 0), (2, "a b", "en", "s", 0)])).count() == 0
    rows = [(t, lang, 1, "x") for _, t, lang, *_ in talk()]
    clash = spark.createDataFrame(rows, "text string, lang string, score int, words string")
    assert sorted(map(tuple, collocations(clash, min_count=3).collect())) == brute_phrases(talk(), 3, 2000)


def test_tries_add_up():
    """Tries of shards, cut by range, serialised, read and merged, against counts of all runs."""
    from starloom.llm.collocations import _read_trie, pair_ids, ranges_of

    rng = np.random.default_rng(2)
    want, blobs = Counter(), {}
    for _ in range(4):
        seq = rng.integers(1, 5, 400).astype(np.uint64)
        depth = np.minimum(5, len(seq) - np.arange(len(seq))).astype(np.int8)
        padded = np.concatenate((seq, np.zeros(5, np.uint64)))
        rows = np.column_stack([np.where(depth > k, padded[np.arange(len(seq)) + k], np.uint64(0)) for k in range(5)])[:-1]
        want.update(tuple(r[:d].tolist()) for r, most in zip(rows, depth[:-1]) for d in range(2, most + 1))
        order = np.lexsort((*(rows[:, k] for k in range(4, -1, -1)), ranges_of(pair_ids(rows[:, 0], rows[:, 1]), 3)))
        for r, b in cut_trie(build_trie(rows[order], depth[:-1][order]), 3):
            blobs.setdefault(r, []).append(_read_trie(b))
    got = {}
    for parts in blobs.values():
        for words, count, lefts in often_nodes(merge_tries(parts), 1):
            for w, c, left in zip(words.tolist(), count.tolist(), lefts.tolist()):
                assert left == [want[tuple(w[:k])] for k in range(2, len(w))]
                got[tuple(w)] = c
    assert got == want


def test_words_and_pieces():
    ids, fresh, start, end, data = tokens([b"A b,c\td", b"", b" e\xc3\xa4. A"], np.uint64(5), WordHasher())
    assert [data.tobytes()[a:b] for a, b in zip(start, end)] == [b"a", b"b", b"c", b"d", b"e\xc3\xa4", b"a"]
    assert fresh.tolist() == [True, False, True, False, True, True] and ids[0] == ids[5] and len(set(ids.tolist())) == 5


def brute_audit(rows, least, top):
    docs = [((lang or ""), (source or ""), re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOW))) for _, t, lang, source, *_ in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df, per = Counter(), {}
        for at, source, terms in docs:
            if at == lang:
                df.update(set(terms))
                per.setdefault(source, Counter()).update(terms)
        kept = {t for t, n in df.items() if n >= least}
        whole = Counter()
        for c in per.values():
            whole.update({t: n for t, n in c.items() if t in kept})
        p = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        probs, q = {s: p(c) for s, c in per.items()}, p(whole)
        for s, c in per.items():
            pairs = sorted(((-sum(f(probs[s][t], probs[o][t]) for t in kept), o.encode()) for o in per if o != s))
            terms = sorted((-f(probs[s][t], q[t]), t.encode()) for t in kept if c[t] and probs[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k) for part, ranked in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(ranked, 1)]
    return sorted(out)


def test_source_audit(spark):
    assert sorted(map(tuple, source_audit(docs_of(spark, talk()).repartition(5), min_docs=4, top_terms=3).collect())) == brute_audit(talk(), 4, 3)
    assert sorted(map(tuple, source_audit(docs_of(spark, talk())).collect())) == brute_audit(talk(), 10, 10)


def test_source_audit_of_empty_tables_and_other_columns(spark):
    assert source_audit(docs_of(spark, [])).count() == 0
    bare = [(1, None, None, "a", 0), (2, "", None, None, 0), (3, "x", "en", "b", 0)]
    assert sorted(map(tuple, source_audit(docs_of(spark, bare)).collect())) == brute_audit(bare, 10, 10)
    rows = [(t, lang, s, 1, "x") for _, t, lang, s, _ in talk()]
    clash = spark.createDataFrame(rows, "text string, lang string, source string, shard int, term string")
    assert sorted(map(tuple, source_audit(clash).collect())) == brute_audit(talk(), 10, 10)


@pytest.mark.parametrize("sql", [repeats_sql(), collocations_sql(), audit_sql()])
def test_sql_runs_on_empty_tables(sql):
    db = pytest.importorskip("duckdb").connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR)")
    assert db.execute(sql).fetchall() == []
