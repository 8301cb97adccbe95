"""How far the sources of each language differ in the terms they use: DuckDB counts and sums in shards, Spark merges."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import byte_slices, dropped, partitions, staged

#: A term: letters of ASCII and anything beyond it.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A term is kept in a language that has it in so many documents; ranks reported of the terms; the scale of probabilities.
MIN_DOCS, TOP_TERMS, SCALE = 10, 10, 1_000_000_000
#: Bytes of text whose terms make up about one shard, bytes that are counted at once, and rows of (term, source) that one block of pair sums takes.
SHARD_BYTES, SLICE_BYTES, BLOCK_ROWS = 16 << 20, 8 << 20, 200_000

_COUNT = f"""
WITH t AS (SELECT doc, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM docs),
d AS (SELECT doc, term, count(*) AS n FROM t GROUP BY doc, term)
SELECT lang, source, term, sum(n)::BIGINT AS n, count(*)::BIGINT AS docs FROM d JOIN docs USING (doc) GROUP BY lang, source, term"""

_KEEP = """
WITH s AS (SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs) AS docs FROM counts GROUP BY lang, source, term)
SELECT lang, source, term, n, row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1 AS one FROM s
QUALIFY sum(docs) OVER (PARTITION BY lang, term) >= {least}"""

_P = f"(1 + ({SCALE}::HUGEINT * (%s + 2)) // (%s + 2 * v))::BIGINT"
_F = "((p - q) * (p - q)) // (p + q)"


def _duck():
    import duckdb

    return duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "700MB", "temp_directory": ""})


def _arrow(relation, schema: pa.Schema) -> pa.Table:
    found = relation.to_arrow_table()
    return found.select(schema.names).cast(schema)


_COUNTED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("one", pa.bool_()), ("shard", pa.int32())])
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])


def _counted(batches):
    """Counts of each term by language and source: a row for each in every slice of a few MB of text."""
    with _duck() as db:
        for part in byte_slices(batches, "text", SLICE_BYTES):
            db.register("docs", pa.Table.from_batches([part]).append_column("doc", pa.array(range(part.num_rows), pa.int32())))
            yield from _arrow(db.sql(_COUNT), _COUNTED).to_batches(max_chunksize=50_000)


def _keep(least: int):
    def run(key, counts):
        with _duck() as db:
            db.register("counts", counts)
            found = db.sql(_KEEP.format(least=least)).to_arrow_table()
        return found.append_column("shard", pa.array([key[0].as_py()] * found.num_rows, pa.int32())).select(_KEPT.names).cast(_KEPT)

    return run


def _sums(top: int):
    """Of one shard's terms: for each two sources of a language the sum of their differences, for each source its foremost terms."""

    def run(key, kept, groups):
        if not kept.num_rows or not groups.num_rows:
            return _FOUND.empty_table()
        with _duck() as db:
            db.register("kept", kept)
            db.register("groups", groups)
            db.execute("CREATE TABLE g AS SELECT *, row_number() OVER (ORDER BY lang, source)::INT AS gid FROM groups")
            db.execute("CREATE TABLE t AS SELECT lang, term, n, row_number() OVER (ORDER BY lang, term)::INT AS tid FROM (SELECT lang, term, sum(n)::BIGINT AS n FROM kept GROUP BY lang, term)")
            db.execute("CREATE TABLE k AS SELECT tid, gid, kept.n FROM kept JOIN t USING (lang, term) JOIN g USING (lang, source)")
            db.execute("CREATE TABLE sums (a INT, b INT, value HUGEINT)")
            n_terms, widest = db.execute("SELECT (SELECT count(*) FROM t), (SELECT max(n) FROM (SELECT count(*) AS n FROM g GROUP BY lang))").fetchall()[0]
            step = max(1, BLOCK_ROWS // widest)
            for at in range(1, n_terms + 1, step):
                db.execute(f"""CREATE OR REPLACE TABLE m AS SELECT t.tid, g.gid, {_P % ("COALESCE(k.n, 0)", "g.total")} AS p
                    FROM t JOIN g USING (lang) LEFT JOIN k USING (tid, gid) WHERE t.tid >= {at} AND t.tid < {at + step}""")
                db.execute(f"INSERT INTO sums SELECT a, b, sum({_F}) FROM (SELECT x.gid AS a, y.gid AS b, x.p AS p, y.p AS q FROM m x JOIN m y ON x.tid = y.tid AND x.gid < y.gid) GROUP BY a, b")
            return _arrow(
                db.sql(f"""
                SELECT 'pair' AS part, x.lang, x.source, y.source AS item, s.value::BIGINT AS value
                    FROM (SELECT a, b, sum(value) AS value FROM sums GROUP BY a, b) s JOIN g x ON x.gid = a JOIN g y ON y.gid = b
                UNION ALL
                SELECT 'term', lang, source, term, {_F} FROM (SELECT g.lang, g.source, t.term, {_P % ("k.n", "g.total")} AS p, {_P % ("t.n", "g.lang_total")} AS q
                    FROM k JOIN t USING (tid) JOIN g USING (gid)) WHERE p > q
                    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY {_F} DESC, term) <= {top}"""),
                _FOUND,
            )

    return run


def source_audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank: for every source of a language how far each other source is from it (part pair),
    and the terms that it uses more than its language does (part term, the first top_terms).

    Nulls in text, language and source count as ''. Every row is a document, repeats too. Terms in at least min_docs documents
    of a language are kept; where none is, its sources are at distance 0. Ties rank by item. Other columns are not read; an
    empty table gives no rows.

    Counts are summed in each slice of a task before they are shuffled by language and term, so the commonest term sends a row for each
    source and slice. Terms are counted in as many shards as a shuffle has partitions at
    least, and summed in fewer, by the bytes of text, as each sum of a shard is a row. A shard's pair sums take its terms in blocks; the number of pairs
    is what the result has.
    """
    nul = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(nul(text_col).alias("text"), nul(lang_col).alias("lang"), nul(source_col).alias("source"))
    sized = staged(rows.groupBy("lang", "source").agg(F.sum(F.octet_length("text")).alias("bytes")), "sources")
    wide = max(1, -(-(sized.agg(F.sum("bytes")).first()[0] or 0) // SHARD_BYTES))  # shards of the sums, each a row for every two sources
    shards = wide * -(-partitions(docs.sparkSession) // wide)  # shards of the counts

    counts = rows.mapInArrow(_counted, "lang string, source string, term string, n long, docs long").withColumn("shard", F.pmod(F.xxhash64("lang", "term"), F.lit(shards)).cast("int"))
    kept = staged(counts.groupBy("shard").applyInArrow(_keep(min_docs), "lang string, source string, term string, n long, one boolean, shard int"), "terms")

    of_source = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.sum(F.col("one").cast("long")).alias("ones"))
    whole = Window.partitionBy("lang")  # a row for each source
    groups = sized.select("lang", "source").join(of_source, ["lang", "source"], "left").select("lang", "source", F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("ones", F.lit(0)).alias("ones"))
    groups = staged(groups.select("lang", "source", "total", F.sum("total").over(whole).cast("long").alias("lang_total"), F.sum("ones").over(whole).cast("long").alias("v")), "groups")

    dealt = groups.where("v > 0").withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    found = kept.withColumn("shard", F.col("shard") % wide).groupBy("shard").cogroup(dealt.groupBy("shard")).applyInArrow(_sums(top_terms), "part string, lang string, source string, item string, value long")
    found = staged(found, "sums")

    apart = found.where("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    bare = groups.where("v = 0").select("lang", "source")
    alike = bare.join(bare.select("lang", F.col("source").alias("item")), "lang").where("source < item").withColumn("value", F.lit(0).cast("long"))
    one_way = apart.unionByName(alike)
    pairs = one_way.select("lang", F.explode(F.array(F.struct("source", "item", "value"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"), "value"))).alias("x")).select("lang", "x.*")
    terms = found.where("part = 'term'").select("lang", "source", "item", "value")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    ranked = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair")).unionByName(terms.withColumn("rank", rank).where(F.col("rank") <= top_terms).withColumn("part", F.lit("term")))
    dropped(kept)  # found is written
    return ranked.select("lang", "source", "part", "item", "value", "rank")


def audit_sql(documents: str = "documents") -> str:
    """source_audit with its defaults, as DuckDB SQL."""
    p = lambda n, total: f"(1 + ({SCALE}::HUGEINT * ({n} + 2)) // ({total} + 2 * v))::BIGINT"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, COALESCE(text, '') AS text, COALESCE(lang, '') AS lang, COALESCE(source, '') AS source FROM {documents}),
t AS (SELECT r, lang, source, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= {MIN_DOCS}),
per AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
langs AS (SELECT lang, count(*) AS v, sum(n)::BIGINT AS lang_total FROM kept GROUP BY lang),
g AS (SELECT x.lang, x.source, COALESCE(s.total, 0)::BIGINT AS total, COALESCE(v, 0) AS v, COALESCE(lang_total, 0) AS lang_total
    FROM (SELECT DISTINCT lang, source FROM d) x LEFT JOIN (SELECT lang, source, sum(n) AS total FROM per GROUP BY lang, source) s USING (lang, source) LEFT JOIN langs USING (lang)),
m AS (SELECT g.lang, g.source, k.term, per.n, {p("COALESCE(per.n, 0)", "total")} AS p, {p("k.n", "lang_total")} AS q
    FROM g JOIN kept k USING (lang) LEFT JOIN per USING (lang, source, term)),
pair AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p))::BIGINT AS value
    FROM m x JOIN m y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
    UNION ALL SELECT x.lang, x.source, y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source WHERE x.v = 0),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM m WHERE n > 0 AND p > q)
SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item)::INT AS rank FROM term
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP_TERMS}"""
