"""The corpus pipeline on a small table, each stage against what it is meant to do."""

import os

import numpy as np
import pytest

import corpus_pipeline
from starloom.llm import common, jaccard_join as join_module, packing, quality
from starloom.llm.jaccard_join import jaccard_join
from starloom.llm.secret_scan import labelled_findings


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    rng = np.random.default_rng(6)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n))
    rows = []
    for i in range(240):
        body = text(int(rng.integers(20, 200))).capitalize() + "."
        rows.append((i, f"SHOUT!! ### $$$ {body.upper()}!! BUY!! " * 2 if i % 6 == 0 else body, "en", f"s{i % 3}", 0))
    copy = text(120)
    rows += [(300 + k, copy + f" tail{k}", "en", "s1", 0) for k in range(6)]
    rows.append((400, text(60) + ' token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" ' + text(20), "en", "s2", 0))
    rows.append((401, text(50), "en", None, 0))
    where = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(os.path.join(where, "documents.parquet"))
    spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 240)], "doc_id long, quality int, toxic int").write.parquet(os.path.join(where, "labels.parquet"))
    return where


def test_stages(spark, made):
    docs = spark.read.parquet(f"{made}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, made).cache()
        kept[name] = out
        if name != "packing":
            assert out.columns == docs.columns
            docs = out
    ids = lambda n: [r.doc_id for r in kept[n].select("doc_id").collect()]
    good = {i for i in range(240) if i % 6} | {300, 301, 302, 303, 304, 305, 400, 401}
    assert set(ids("quality")) == good and len(ids("quality")) == len(good)
    assert sorted(ids("near_duplicates")) == sorted(good - {301, 302, 303, 304, 305})
    assert jaccard_join(kept["near_duplicates"], width=5, similarity_pct=80).where("doc_id <> component_id").count() == 0
    assert sorted(ids("secrets")) == sorted(ids("near_duplicates")) and kept["secrets"].where("text like '%24be64439e%'").count() == 0
    assert kept["secrets"].where("doc_id = 400").first().text.count("[SECRET]") == 1
    assert set(ids("mixture")) <= set(ids("secrets"))
    pieces = kept["packing"].toPandas()
    assert pieces.length.groupby(pieces.sequence_id).sum().max() <= 1024 and set(pieces.doc_id) == set(ids("mixture"))
    assert (pieces.piece == 0).sum() == len(ids("mixture"))


def test_null_and_repeated_ids_lose_no_clean_rows(spark, made):
    rng = np.random.default_rng(12)
    text = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 3000, n)).capitalize() + "."
    labelled = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{made}/documents.parquet").where("doc_id < 240").collect()]
    bad, clean, other, third, copied = "SHOUT!! ### $$$ !! BUY!! " * 8, text(80), text(90), text(70), text(100)
    rows = [(None, bad, "s0"), (None, clean, "s0"), (None, other, "s1"), (900, bad, "s0"), (900, third, "s1"), (901, copied, "s2"), (902, copied + " tail", "s2"), (902, text(60), "s2"), (None, copied, "s2"), (None, "", "s0"), (None, "", "s0")]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda x: spark.createDataFrame([(i, t, "en", s, 0) for i, t, s in x], schema)
    plain = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    good = [(i, t) for i, t, _ in rows if t != bad and t]
    kept = plain(corpus_pipeline.quality(spark, table(labelled + rows), made))
    assert [x for x in kept if (x[0] is None or x[0] >= 900) and x[1]] == sorted(good, key=str)
    left = plain(corpus_pipeline.near_duplicates(spark, table(rows), made))
    assert left == sorted([(900, bad), *((i, t) for i, t in good if (i, t) not in [(902, copied + " tail"), (None, copied)]), (None, ""), (None, "")], key=str)
    mixed = corpus_pipeline.mixture(spark, table([(None, "a b c", "s"), (None, "d e f", "s"), (7, "g h i", "s"), (7, "j k l", "s"), (8, "m n o", "s"), (8, "m n o", "s")]), made)
    assert plain(mixed) == sorted([(None, "a b c"), (None, "d e f"), (7, "g h i"), (7, "j k l"), (8, "m n o"), (8, "m n o")], key=str)


def test_run(spark, made):
    assert corpus_pipeline.run(spark, made).count() > 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mixture", "packing"]


BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_texts_go_to_python_in_small_batches(spark, made, monkeypatch):
    """Finding 1: what the executors' JVMs and workers hold of the texts at once is bounded in bytes."""
    seen = []

    def staged(df, name):
        if "MapInArrow" in df._jdf.queryExecution().optimizedPlan().toString():
            seen.append((name, spark.conf.get(BOUND, None)))
        return common.staged(df, name)

    for module in (quality, join_module, packing):
        monkeypatch.setattr(module, "staged", staged)
    docs = spark.read.parquet(f"{made}/documents.parquet")
    for name in ("quality", "near_duplicates", "packing"):
        out = dict(corpus_pipeline.STAGES)[name](spark, docs, made)
        assert out.count() > 0 and (name == "packing" or "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString())
    assert {n for n, _ in seen} == {"features", "accepted", "rows", "postings", "sets", "pieces"}
    assert {b for _, b in seen} == {str(common.ARROW_BYTES)} and spark.conf.get(BOUND, None) is None


def test_small_batches(spark):
    def sizes(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "bytes": [b.nbytes]})

    rows = spark.range(0, 40, 1, 1).selectExpr("id", "repeat('x', 1000000) AS text").mapInArrow(sizes, "n long, bytes long")
    with common.small_batches(spark):
        got = rows.collect()
    assert sum(r.n for r in got) == 40 and max(r.bytes for r in got) < 2 * common.ARROW_BYTES
    assert rows.first().n == 40  # as the session has it
    spark.conf.set(BOUND, "2000000")
    try:
        with common.small_batches(spark):
            assert rows.first().n < 4
        assert spark.conf.get(BOUND) == "2000000"
    finally:
        spark.conf.unset(BOUND)


def test_made_findings_start_no_workers(spark):
    """Finding 1: rows of Python go through Python workers, which stay idle on the executors."""
    made = labelled_findings(spark, 50)
    assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString() and made.count() == 50
    assert made.dtypes == [("candidate", "string"), ("before", "string"), ("after", "string"), ("label", "int")] and labelled_findings(spark, 0).count() == 0


def test_run_leaves_only_its_last_rows(spark, made, monkeypatch):
    """Finding 1: stages hand on staged rows; what they wrote is removed when the next one has them."""
    left = []
    monkeypatch.setattr(corpus_pipeline, "dropped", lambda df: (left.extend(df.inputFiles()), common.dropped(df)))
    assert corpus_pipeline.run(spark, made).count() > 0
    paths = [x.replace("file://", "") for x in left if "/starloom/" in x]
    assert any("/accepted-" in x for x in paths) and not any(os.path.exists(x) for x in paths)
