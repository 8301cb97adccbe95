"""Queries over chunks, query grammar, sets, rules, varied pages and graded runs, with the SQL that each is held against."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from starloom.functions import markdown as MD
from starloom.functions import scoring as S
from starloom.operators import collections as CO
from starloom.operators import diversity as DV
from starloom.operators import filters as FL
from starloom.operators import fusion as FU
from starloom.operators import gates as GA
from starloom.operators import idsets as IS
from starloom.operators import legs as LG
from starloom.operators import metrics as ME
from starloom.operators import rules as RU
from starloom.plans import chunks as CH
from starloom.plans import grammar as GR
from starloom.plans import rerank as RR
from starloom.plans.engine import Engine, index_over
from starloom.plans.query import classified, expand, expanded, tokenize
from starloom.registry import ASK, CAMEL, FOUND, INDEX, PRIOR, SPEECH, _first_vector, _hits_sql, _rounded, _search_sql, _top_sql, query
from starloom.sources import recorded as RD
from starloom.sources import tables
from starloom.sources.staging import shared_dir, staged

# ---- varied pages ----

PAGE, WINDOW = 8, 30
_NEAR = "list_filter(taken, lambda t: t.v IS NOT NULL AND w.v IS NOT NULL AND list_cosine_similarity(t.v, w.v) >= {})"
_HELD = f"""(len(list_filter(r.taken, lambda t: t.o = w.owner)) >= 2 OR len(list_filter(r.taken, lambda t: t.r = w.root)) >= 2
    OR len({_NEAR.format(0.92).replace("taken", "r.taken")}) > 0) AND NOT (w.lexical AND w.lone)"""


@query(f"""+hits AS (SELECT r.language || r.id % 5 AS query_id, r.id, r.owner, regexp_replace(lower(array_to_string(string_split(r.description, ' ')[1:2], '-')), '[^a-zà-ÿ-]', '', 'g') AS name,
    round({PRIOR}, 9) AS score, r.id % 11 = 0 AS lexical, v.vector[1:3] AS v FROM repos r LEFT JOIN vectors v USING (id)),
first AS (SELECT *, lower(owner) AS o, regexp_replace(string_split_regex(ltrim(lower(name), '-_.'), '[-_.]+')[1], '^(.{{2,}}?)(?:js|ts|ui|sdk|cli|server|client)$', '\\1') AS root, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS k FROM hits),
w AS (SELECT query_id, k, id, o AS owner, root, score, lexical, v, count(*) FILTER (lexical) OVER (PARTITION BY query_id) = 1 AS lone FROM first WHERE k <= {WINDOW}),
walk AS (SELECT DISTINCT query_id, 0::BIGINT AS k, []::STRUCT(o VARCHAR, r VARCHAR, v DOUBLE[])[] AS taken, NULL::BIGINT AS id, NULL::DOUBLE AS score, 0 AS near, FALSE AS held FROM w
    UNION ALL SELECT w.query_id, w.k, CASE WHEN {_HELD} THEN r.taken ELSE list_append(r.taken, {{'o': w.owner, 'r': w.root, 'v': w.v}}) END, w.id, w.score, len({_NEAR.format(0.85).replace("taken", "r.taken")})::INT, {_HELD}
    FROM walk r JOIN w ON w.query_id = r.query_id AND w.k = r.k + 1 WHERE len(r.taken) < {PAGE}),
shown AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY held, k) AS turn FROM walk WHERE k > 0),
page AS (SELECT *, round(score * greatest(0.6::DOUBLE, power(0.9::DOUBLE, near)), 9) AS final FROM shown WHERE turn <= {PAGE})
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY final DESC, k) AS position, id, round(final, 6) AS score, CASE WHEN held THEN 'held' END AS suppressed FROM page""")
def diversified(spark, d):
    """Pages of many queries at once, with caps for owners and names and near copies held back."""
    words = F.array_join(F.slice(F.split("description", " "), 1, 2), "-")
    hits = tables.repos(spark, d).join(tables.vectors(spark, d).select("id", F.slice("vector", 1, 3).alias("vector")), "id", "left")
    hits = hits.select(F.concat("language", (F.col("id") % 5).cast("string")).alias("query_id"), "id", "owner", F.regexp_replace(F.lower(words), "[^a-zà-ÿ-]", "").alias("name"), F.round(S.star_prior(F.col("stars")), 9).alias("score"), (F.col("id") % 11 == 0).alias("lexical"), "vector")
    page = DV.diversified(hits, PAGE, WINDOW).withColumn("suppressed", F.when(F.col("suppressed_by").isNotNull(), "held"))
    return _rounded(page.select("query_id", "position", "id", "score", "suppressed"), "score")


# ---- chunks ----


@query()
def markdown_chunks(spark, d):
    """The chunks of every document, each second line made a heading."""
    repos = tables.repos(spark, d)
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.regexp_replace("readme", r"(?m)^([^\n]*)\n([^\n]*)$", "$1\n\n## $2"))
    found = MD.markdown_chunks(repos.select("id", "full_name", text.alias("readme")))
    return found.select("id", "n", "of", "heading", F.length("body").alias("length"), "hash")


@query("""+qs AS (SELECT id AS query_id, vector AS qv FROM vectors WHERE id % 50 = 0),
near AS (SELECT query_id, id // 4 AS id, round(list_cosine_similarity(vector, qv), 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, qv), 9) DESC, id) AS rank FROM vectors, qs),
two AS (SELECT *, row_number() OVER (PARTITION BY query_id, id ORDER BY score DESC) AS k FROM near WHERE rank <= 50),
n AS (SELECT id // 4 AS id, count(*) AS chunks FROM vectors GROUP BY 1),
rolled AS (SELECT query_id, id, round(sum(CASE WHEN k = 1 THEN score ELSE 0.3::DOUBLE * score END) / (1 + 0.03::DOUBLE * ln(any_value(chunks) + 1.0::DOUBLE)), 9) AS score FROM two JOIN n USING (id) WHERE k <= 2 GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM rolled)
SELECT query_id, id, round(score, 6) AS score, rank FROM placed WHERE rank <= 10""")
def chunk_rollup(spark, d):
    """Repositories by their two best chunks: four vectors in a row are one repository's."""
    v = tables.vectors(spark, d)
    hits = LG.batch_knn(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 50)
    of = F.floor(F.col("id") / 4)
    counts = v.groupBy(of.alias("id")).agg(F.count("*").alias("chunks"))
    return _rounded(CH.roll_up(hits.select("query_id", of.alias("id"), "score"), counts, 10), "score")


# ---- grammar ----

STRICT, LOOSE = 'the "of the" -than', "idiot doc src3"


@query(f"{INDEX}, {_hits_sql('hits', list(GR.parse(STRICT).must))}, {_top_sql('best', 'hits', 'n_terms = 2 AND id NOT IN (SELECT id FROM toks WHERE term = ' + repr('than') + ')')} SELECT id, round(score, 6) AS score, rank, NULL::VARCHAR AS fallback FROM best")
def boolean_search(spark, d):
    """A word and a phrase that must be there, and a word that must not."""
    return _rounded(GR.boolean_leg(index_over(spark, d), GR.parse(STRICT), 50), "score")


@query(f"""{INDEX}, {_hits_sql('hits', list(GR.parse(LOOSE).must))}, {_top_sql('best', 'hits', 'n_terms = 3 OR NOT EXISTS (SELECT 1 FROM hits WHERE n_terms = 3)')}
SELECT id, round(score, 6) AS score, rank, CASE WHEN NOT EXISTS (SELECT 1 FROM hits WHERE n_terms = 3) THEN 'or' END AS fallback FROM best""")
def boolean_fallback(spark, d):
    return _rounded(GR.boolean_leg(index_over(spark, d), GR.parse(LOOSE), 50), "score")


# ---- sets and rules ----


@query("""+s AS (SELECT event_type AS name, event_id % (SELECT count(*) FROM documents) AS id FROM events UNION SELECT slug, repo_id FROM group_repos),
has AS (SELECT r.id, list(DISTINCT s.name) AS names FROM repos r LEFT JOIN s USING (id) GROUP BY r.id), h AS (SELECT id, lambda_has FROM (SELECT id, list_filter(names, lambda x: x IS NOT NULL) AS lambda_has FROM has))
SELECT 'any' AS name, id FROM h WHERE list_has_any(lambda_has, ['toxic', 'purchase', 'none']) UNION ALL SELECT 'all', id FROM h WHERE list_has_all(lambda_has, ['quality', 'click'])
UNION ALL SELECT 'ungrouped', id FROM h WHERE NOT list_has_any(lambda_has, ['quality', 'toxic']) UNION ALL SELECT 'mixed', id FROM h WHERE list_contains(lambda_has, 'quality') AND NOT (list_contains(lambda_has, 'view') AND NOT list_contains(lambda_has, 'click'))""")
def group_algebra(spark, d):
    """Unions, intersections and complements of groups made of events and labels."""
    repos = tables.repos(spark, d)
    n = tables.read(spark, d, "documents").agg(F.count("*").alias("n"))
    events = tables.read(spark, d, "events").crossJoin(F.broadcast(n)).select(F.col("event_type").alias("name"), (F.col("event_id") % F.col("n")).alias("id"))  # one row
    sets = IS.bitmaps(events.unionByName(tables.group_repos(spark, d).select(F.col("slug").alias("name"), F.col("repo_id").alias("id"))))
    of = IS.IdSet.of
    said = {"any": IS.any_of("toxic", "purchase", "none"), "all": IS.all_of("quality", "click"), "ungrouped": ~IS.any_of("quality", "toxic"), "mixed": of("quality") & ~(of("view") & ~of("click"))}
    return IS.members_of(said, sets, repos.select("id"))


def _rules() -> dict[str, dict]:
    """100 rules over language, topics and stars, and three that are wrong."""
    rule = lambda *f: {"version": 1, "match": "all", "filters": [dict(zip(("field", "op", "value"), x)) for x in f]}
    made = {f"r{k}": rule(("language", "eq", ("EN", "de", "fr", "es")[k % 4]), ("stars", "gte", 40 * k), ("topics", "in", [f"SRC{k % 20}", f"src{(k + 7) % 20}"])) for k in range(99)}
    made["old"] = rule(("archived", "eq", True), ("license", "ne", "mit"))
    return made | {"bad-field": rule(("forks", "gte", 1)), "bad-op": rule(("stars", "has", 1)), "bad-value": rule(("stars", "gte", "many"))}


@query("SELECT 'r' || k AS slug, id AS repo_id, FALSE AS wrong FROM repos, range(99) t(k) WHERE language = ['en', 'de', 'fr', 'es'][k % 4 + 1] AND stars >= 40 * k AND list_has_any(topics, ['src' || k % 20, 'src' || (k + 7) % 20]) UNION ALL SELECT 'old', id, FALSE FROM repos WHERE archived AND COALESCE(license, '') <> 'MIT' UNION ALL SELECT unnest(['bad-field', 'bad-op', 'bad-value']), NULL, TRUE")
def rule_groups(spark, d):
    """A hundred groups by rules in one pass over the repositories; a row says which rule is wrong."""
    return RU.rule_members(tables.repos(spark, d), _rules()).select("slug", "repo_id", F.col("error").isNotNull().alias("wrong"))


# ---- query understanding ----

#: Words of the benchmark as concepts, so that its texts name some.
NAMED = {"english": ("English", ["the", "than that"], ["of", "and"]), "french": ("French", ["le", "de la"], ["les", "et"]), "pairs": ("Pairs", ["of the", "in the"], ["on the"])}
_LEXICON = ", ".join(f"('{k}', {i}, '{' '.join(tokenize(t))}')" for i, (k, v) in enumerate(NAMED.items()) for t in v[1])
#: Queries of all kinds made of the benchmark's texts: a word, two words, a name, or the whole text.
_SAID = "SELECT item_id AS query_id, CASE item_id % 4 WHEN 0 THEN string_split(text, ' ')[1] WHEN 1 THEN array_to_string(string_split(text, ' ')[1:2], '  ') WHEN 2 THEN string_split(text, ' ')[1] || 'X-' || string_split(text, ' ')[2] ELSE text END AS query FROM benchmark"


def _asked(spark, d):
    words, k = F.split("text", " "), F.col("item_id") % 4
    said = F.when(k == 0, words[0]).when(k == 1, F.array_join(F.slice(words, 1, 2), "  ")).when(k == 2, F.concat(words[0], F.lit("X-"), words[1])).otherwise(F.col("text"))
    return tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), said.alias("query"))


@query(f"+asked AS ({_SAID}), c AS (SELECT *, rtrim(substring(trim(regexp_replace(query, '\\s+', ' ', 'g')), 1, 512)) AS q FROM asked) SELECT query_id, CASE WHEN q <> '' AND NOT contains(q, ' ') AND (regexp_matches(q, '[0-9_./@:#-]') OR regexp_matches(q, '\\p{{Ll}}\\p{{Lu}}')) THEN 'identifier' WHEN len({CAMEL('q')}) <= 2 THEN 'keyword' ELSE 'descriptive' END AS kind, len({CAMEL('q')})::INT AS n_tokens FROM c")
def classify_queries(spark, d):
    return classified(_asked(spark, d)).select("query_id", "kind", "n_tokens")


@query(f"""+asked AS ({_SAID}), lex AS (SELECT * FROM (VALUES {_LEXICON}) t(concept, place, trigger)), w AS (SELECT query_id, {CAMEL("rtrim(substring(trim(regexp_replace(query, '\\s+', ' ', 'g')), 1, 512))")} AS w FROM asked),
said AS (SELECT query_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS trigger FROM w),
hit AS (SELECT DISTINCT query_id, place, concept FROM said JOIN lex USING (trigger)) SELECT query_id, list(concept ORDER BY place) AS concepts FROM hit GROUP BY query_id""")
def expand_queries(spark, d):
    return expanded(_asked(spark, d), concepts=NAMED)


# ---- graded runs, with boosts and without ----

MODES = {"keyword": ("keyword",), "semantic": ("semantic",), "hybrid": ("keyword", "expanded", "semantic")}
_METRICS = ("p5", "p5_strict", "r10", "mrr", "ndcg10", "success3")


def _ablation_sql() -> str:
    letter = {"keyword": "k", "expanded": "e", "semantic": "s"}
    runs = []
    for mode, legs in MODES.items():
        body = _search_sql(FOUND, ASK, legs="".join(letter[x] for x in legs)).lstrip("+")
        runs.append(f"""SELECT * FROM (WITH {body} SELECT '{mode}' AS mode, 'on' AS boosts, id, row_number() OVER (ORDER BY score DESC, stars DESC, id) AS rank FROM ranked
            UNION ALL SELECT '{mode}', 'off', id, row_number() OVER (ORDER BY round(rrf, 12) DESC, stars DESC, id) FROM base)""")
    return f"""+runs AS ({" UNION ALL ".join(runs)}), graded AS (SELECT doc_id AS id, quality + CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END AS grade FROM labels),
h AS (SELECT r.mode, r.boosts, r.rank, COALESCE(g.grade, 0) AS grade FROM runs r LEFT JOIN graded g USING (id) WHERE rank <= 10),
got AS (SELECT mode, boosts, count(*) FILTER (rank <= 5 AND grade >= 1) AS h5, count(*) FILTER (rank <= 5 AND grade = 2) AS s5, count(*) FILTER (grade = 2) AS s10, min(rank) FILTER (grade >= 1) AS first,
    sum((power(2, grade) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg, count(*) FILTER (rank <= 3 AND grade >= 1) > 0 AS hit3 FROM h GROUP BY 1, 2),
placed AS (SELECT *, row_number() OVER (ORDER BY grade DESC, id) AS place FROM graded),
ideal AS (SELECT sum((power(2, grade) - 1) / log2(place + 1.0::DOUBLE)) FILTER (place <= 10) AS idcg, count(*) FILTER (grade = 2) AS n2 FROM placed)
SELECT mode, boosts, round(h5 / 5.0::DOUBLE, 9) AS p5, round(s5 / 5.0::DOUBLE, 9) AS p5_strict, round(s10::DOUBLE / n2, 9) AS r10, round(1.0::DOUBLE / first, 9) AS mrr, round(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0 END, 9) AS ndcg10, hit3::INT::DOUBLE AS success3 FROM got, ideal"""


@query(_ablation_sql())
def boost_ablation(spark, d):
    """Each mode's run with its boosts and penalties and without them, graded by the labels."""
    engine = Engine.over(spark, d, concepts=SPEECH)
    found = engine.repos.where(FL.predicate(FL.Filters(language="en", archived=False)))
    words = list(dict.fromkeys(tokenize(ASK)))
    more = expand(words, SPEECH).terms
    legs = LG.text_legs(engine.index, words, more, 50, found) | {"semantic": LG.vector_leg(engine.vectors, _first_vector(engine.vectors), 50, found)}
    legs = staged(FU.union_legs(legs), "legs")  # 150 rows at most, for six runs
    runs = {}
    for mode, names in MODES.items():
        for boosts in ("on", "off"):
            hits = FU.fuse(legs.where(F.col("leg").isin(*names)), found, FU.evidence(words, more), boosts=boosts == "on", few=True)
            place = F.row_number().over(Window.orderBy(F.desc("score"), F.desc("stars"), "id"))
            runs[f"{mode} {boosts}"] = hits.select(F.lit("ask").alias("query_id"), "id", place.cast("long").alias("rank"))
    labels = tables.read(spark, d, "labels")
    grades = labels.select(F.lit("ask").alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("grade"))
    rows = ME.ablation(runs, grades, spark.range(1).select(F.lit("ask").alias("query_id")))
    named = rows.select(F.split_part("run", F.lit(" "), F.lit(1)).alias("mode"), F.split_part("run", F.lit(" "), F.lit(2)).alias("boosts"), *_METRICS)
    return _rounded(named, *_METRICS, digits=9)


# ---- typing errors, facets, collections, a second look, gates ----

TYPED = "srcc3/doc-13"
_GRAMS = sorted({TYPED[i : i + 3] for i in range(len(TYPED) - 2)})
_WHOLE = "lower(concat_ws(chr(10), full_name, description, array_to_string(topics, ' ')))"


@query(f"""+g AS (SELECT id, round(({" + ".join(f"contains({_WHOLE}, '{g}')::INT" for g in _GRAMS)}) / {len(_GRAMS)}.0::DOUBLE, 9) AS score FROM repos)
SELECT id, round(score, 6) AS score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM g WHERE score >= 0.4 ORDER BY rank LIMIT 50""")
def similar_names(spark, d):
    """What a name with a typing error may have meant."""
    return _rounded(LG.similar_names(index_over(spark, d), TYPED, 50), "score")


@query("""+f AS (SELECT id, language = 'en' AS a, NOT archived AS b, stars >= 1000 AS c, language, topics, archived, stars FROM repos)
SELECT 'language' AS facet, language AS value, count(*) AS n FROM f WHERE b AND c GROUP BY 2 UNION ALL SELECT 'archived', archived::VARCHAR, count(*) FROM f WHERE a AND c GROUP BY 2
UNION ALL SELECT 'stars', (stars // 1000)::VARCHAR, count(*) FROM f WHERE a AND b GROUP BY 2 UNION ALL SELECT 'topic', t, count(*) FROM (SELECT id, unnest(list_distinct(topics)) AS t FROM f WHERE a AND b AND c) GROUP BY 2""")
def live_facets(spark, d):
    """Facets under a selection, each without its own."""
    chosen = {"language": F.col("language") == "en", "archived": ~F.col("archived"), "stars": F.col("stars") >= 1000}
    return CO.facets(tables.repos(spark, d), chosen, {"language": F.col("language"), "archived": F.col("archived"), "stars": F.floor(F.col("stars") / 1000), "topic": F.col("topics")})


@query("""+s AS (SELECT repo_id AS id, max(starred_at) AS starred_at FROM user_stars GROUP BY repo_id), r AS (SELECT repos.*, s.starred_at FROM repos LEFT JOIN s USING (id)), t AS (SELECT max(starred_at)::TIMESTAMP AS now FROM s),
c AS (SELECT 'recent' AS kind, '' AS key, id FROM r, t WHERE epoch(now - starred_at::TIMESTAMP) <= 7776000 UNION ALL SELECT 'known', '', id FROM r WHERE stars >= 1000 UNION ALL SELECT 'archived', '', id FROM r WHERE archived AND stars >= 1000
    UNION ALL SELECT 'language', lower(language), id FROM r WHERE language <> '' UNION ALL SELECT DISTINCT 'topic', lower(x), id FROM (SELECT id, unnest(topics) AS x FROM r)),
n AS (SELECT kind, key, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, key) AS place FROM c GROUP BY kind, key)
SELECT kind, key, id AS repo_id FROM c JOIN n USING (kind, key) WHERE place <= CASE kind WHEN 'language' THEN 8 WHEN 'topic' THEN 12 ELSE 1 END""")
def own_collections(spark, d):
    """Collections that make themselves: recent, well-known, archived, the largest languages and topics."""
    stars = tables.user_stars(spark, d).groupBy(F.col("repo_id").alias("id")).agg(F.max("starred_at").alias("starred_at"))
    now = F.to_timestamp(F.lit(stars.agg(F.max("starred_at")).first()[0]))
    return CO.collections(tables.repos(spark, d).join(stars, "id", "left"), now)


@query(f"""+n AS (SELECT count(*) AS n FROM benchmark), asked AS (SELECT item_id AS query_id, list_distinct({CAMEL("text")}) AS q FROM benchmark),
hits AS (SELECT id % n AS query_id, id, row_number() OVER (PARTITION BY id % n ORDER BY stars DESC, id) AS position, description, substring(readme, 1, 2048) AS body FROM repos, n),
s AS (SELECT query_id, id, position, CASE WHEN position <= 30 THEN round(greatest(len(list_intersect(q, {CAMEL("description")})), len(list_intersect(q, {CAMEL("body")}))) / len(q)::DOUBLE, 9) END AS rerank FROM hits JOIN asked USING (query_id))
SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY position > 30, rerank DESC NULLS LAST, position) AS position, round(rerank, 6) AS rerank, FALSE AS degraded FROM s""")
def second_look(spark, d):
    """The first results of many queries in a model's order; the model is a stand-in that counts common words."""
    bench = tables.read(spark, d, "benchmark")
    repos = tables.repos(spark, d).crossJoin(F.broadcast(bench.agg(F.count("*").alias("n"))))  # one row
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("stars"), "id"))
    hits = repos.withColumn("query_id", F.col("id") % F.col("n")).withColumn("position", place)
    passages = hits.select("query_id", "id", F.explode(F.array("description", "readme")).alias("passage"))
    asked = bench.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return _rounded(RR.reranked(hits, passages, asked), "rerank")


_WEIGHT = "+ ".join(f"(u >= {end})::INT " for end in GA._POISSON)


@query(f"""+m AS (SELECT source AS query_id, avg(quality) FILTER ((doc_id // 20) % 2 = 0) AS now_q, avg(quality) FILTER ((doc_id // 20) % 2 = 1) AS base_q, avg(toxic) FILTER ((doc_id // 20) % 2 = 0) AS now_t, avg(toxic) FILTER ((doc_id // 20) % 2 = 1) + 0.5 AS base_t FROM documents JOIN labels USING (doc_id) GROUP BY source),
l AS (SELECT query_id, 'quality' AS metric, now_q AS now, base_q AS base FROM m UNION ALL SELECT query_id, 'toxic', now_t, base_t FROM m), b AS (SELECT * FROM l WHERE now IS NOT NULL AND base IS NOT NULL),
w AS (SELECT metric, b, now, base, {_WEIGHT} AS w FROM (SELECT *, ('0x' || substr(md5(query_id || ':' || b), 1, 8))::BIGINT % 1000000 AS u FROM b, range({GA.RESAMPLES}) t(b))),
c AS (SELECT metric, b, round(sum(w * (now - base)) / sum(w), 9) AS change FROM w GROUP BY metric, b), p AS (SELECT metric, avg(CASE WHEN change < 0 THEN 1.0::DOUBLE ELSE 0 END) AS worse FROM c GROUP BY metric)
SELECT metric, count(*) AS queries, round(avg(base), 6) AS base, round(avg(now), 6) AS now, round(any_value(worse), 6) AS worse, any_value(worse) < 0.95 AS passed FROM b JOIN p USING (metric) GROUP BY metric""")
def metric_gate(spark, d):
    """Means of labels by source against a baseline, half the documents each; one of the baselines is raised."""
    rows = tables.read(spark, d, "documents").join(tables.read(spark, d, "labels"), "doc_id")
    of = lambda k, more: rows.where(F.floor(F.col("doc_id") / 20) % 2 == k).groupBy(F.col("source").alias("query_id")).agg(F.avg("quality").alias("quality"), (F.avg("toxic") + more).alias("toxic"))
    return _rounded(GA.gated(of(0, 0.0), of(1, 0.5), ["quality", "toxic"]), "base", "now", "worse")


# ---- recorded listings ----


@query("""+e AS (SELECT event_id // 100 AS page, event_id % 97 AS id, event_id FROM events WHERE event_id < 1200), p AS (SELECT page, max(page) OVER () AS last, count(*) AS n FROM e GROUP BY page)
SELECT page::INT AS page, CASE page WHEN 3 THEN 'unchanged' WHEN 6 THEN 'limited' WHEN 7 THEN 'missing' WHEN 8 THEN 'failed' WHEN 9 THEN 'capped' ELSE 'ok' END AS state,
    CASE WHEN page NOT IN (3, 6, 7, 8, 9) AND page < last THEN page + 1 END::INT AS next, CASE WHEN page = 6 THEN 30 END::BIGINT AS wait_s, CASE WHEN page NOT IN (3, 6, 7, 8, 9) THEN n ELSE 0 END::BIGINT AS n, page <= 6 AS listed FROM p WHERE page <= 9""")
def recorded_pages(spark, d):
    """Pages laid out from events, read through the data source: good ones, an unchanged one, errors, and the cap."""
    e = tables.read(spark, d, "events").where("event_id < 1200").select(F.floor(F.col("event_id") / 100).cast("int").alias("page"), F.to_json(F.struct((F.col("event_id") % 97).alias("id"))).alias("item"))
    bodies = e.groupBy("page").agg(F.concat(F.lit("["), F.array_join(F.collect_list("item"), ","), F.lit("]")).alias("body"))
    last = bodies.agg(F.max("page").alias("last"))
    code = F.when(F.col("page") == 3, 304).when(F.col("page") == 6, 429).when(F.col("page") == 7, 404).when(F.col("page") == 8, 502).otherwise(200)
    link = F.when(F.col("page") < F.col("last"), F.concat(F.lit('<https://x/y?page='), (F.col("page") + 1).cast("string"), F.lit('>; rel="next"'))).otherwise("")
    path = f"{shared_dir(spark)}/starloom/recorded-{uuid.uuid4().hex}"
    RD.record(bodies.crossJoin(F.broadcast(last)).select("page", code.alias("status"), F.create_map(F.lit("link"), link, F.lit("Retry-After"), F.lit("30")).alias("headers"), "body"), path)  # one row
    RD.register(spark)
    pages = staged(spark.read.format("recorded").option("path", path).option("pages", 8).load(), "pages")
    n = F.coalesce(F.size(F.from_json("json", "array<struct<id:long>>")), F.lit(0)).cast("long")
    kept = RD.listing(pages).select(F.col("page").alias("listed_page"), F.lit(True).alias("listed"))
    rows = pages.join(kept, F.col("page") == F.col("listed_page"), "left")
    return rows.select("page", "state", "next", "wait_s", F.when(F.col("json").isNull(), F.lit(0).cast("long")).otherwise(n).alias("n"), F.coalesce("listed", F.lit(False)).alias("listed"))
