"""Named queries over the driver's tables, with the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.functions import display as D
from starloom.functions import scoring as S
from starloom.functions import text as T
from starloom.functions.stem_sql import stem_ctes
from starloom.functions.stemming import stem
from starloom.functions.text import FOLDED, MARKED, index_words
from starloom.operators import filters as FL
from starloom.operators import fusion as FU
from starloom.operators import index as IX
from starloom.operators import legs as LG
from starloom.operators import merging as MG
from starloom.operators import metrics as ME
from starloom.operators import planning as PL
from starloom.operators import ranking as RK
from starloom.plans.engine import Engine, index_over
from starloom.plans.lab import lab_search as lab_plan
from starloom.plans.lab import pooled
from starloom.plans.query import SearchRequest, expand, tokenize
from starloom.sources import tables, wire

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with DuckDB SQL that may use the views of tables.CTE."""

    def add(f):
        _QUERIES[f.__name__] = f
        if sql is not None:
            _ORACLES[f.__name__] = f"WITH RECURSIVE {tables.CTE}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}"
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


# ---- pieces of SQL that several oracles share ----

TOKENS = lambda x: f"regexp_extract_all(translate(lower({x}), '{MARKED}', '{FOLDED}'), '[\\p{{L}}\\p{{N}}]+')"
CAMEL = lambda x: f"regexp_extract_all(lower(regexp_replace(regexp_replace({x}, '(\\p{{Lu}}+)(\\p{{Lu}}\\p{{Ll}})', '\\1 \\2', 'g'), '([\\p{{Ll}}\\p{{N}}])(\\p{{Lu}})', '\\1 \\2', 'g')), '[\\p{{L}}\\p{{N}}]+')"
PLAIN = lambda x: f"regexp_replace(lower({x}), '[^\\p{{L}}\\p{{N}}]+', '', 'g')"
INDEX = f"""+cols AS (SELECT id, {TOKENS("COALESCE(full_name, '')")} AS c1, {TOKENS("COALESCE(description, '')")} AS c2, {TOKENS("array_to_string(topics, ' ')")} AS c3, {TOKENS("COALESCE(readme, '')")} AS c4 FROM repos),
lens AS (SELECT id, len(c1) + len(c2) + len(c3) + len(c4) AS len FROM cols),
stats AS (SELECT count(*) AS n, avg(len) AS mean_len FROM lens),
raw AS (SELECT id, 1 AS col, unnest(c1) AS word, generate_subscripts(c1, 1) AS pos FROM cols UNION ALL SELECT id, 2, unnest(c2), generate_subscripts(c2, 1) FROM cols
    UNION ALL SELECT id, 3, unnest(c3), generate_subscripts(c3, 1) FROM cols UNION ALL SELECT id, 4, unnest(c4), generate_subscripts(c4, 1) FROM cols),
{stem_ctes("SELECT word FROM raw")},
toks AS (SELECT id, stem AS term, col, pos, CASE col WHEN 1 THEN 10.0::DOUBLE WHEN 2 THEN 5 WHEN 3 THEN 4 ELSE 1 END AS w, CASE col WHEN 1 THEN 8.0::DOUBLE WHEN 2 THEN 3 WHEN 3 THEN 3 ELSE 1 END AS lab_w FROM raw JOIN stems USING (word))"""
WORTH = "CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean_len))"


def _tf_sql(terms: list[str], weight: str = "w") -> str:
    """id, term, tf of terms as they are asked for, phrases among them."""
    parts = []
    for t in terms:
        words = [stem(w) for w in index_words(t)]
        joins = "".join(f" JOIN toks t{k} ON t{k}.id = t0.id AND t{k}.col = t0.col AND t{k}.pos = t0.pos + {k} AND t{k}.term = '{w}'" for k, w in enumerate(words) if k)
        parts.append(f"SELECT t0.id, '{t}' AS term, sum(t0.{weight}) AS tf FROM toks t0{joins} WHERE t0.term = '{words[0]}' GROUP BY t0.id")
    return " UNION ALL ".join(parts)


def _hits_sql(name: str, terms: list[str], weight: str = "w") -> str:
    """CTE name(id, n_terms, score)."""
    return f"{name}_tf AS ({_tf_sql(terms, weight)}), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term), {name} AS (SELECT f.id, count(*) AS n_terms, round(sum({WORTH}), 9) AS score FROM {name}_tf f JOIN {name}_df USING (term) JOIN lens USING (id), stats GROUP BY f.id)"


def _top_sql(name: str, hits: str, where: str = "TRUE", k: int = 50) -> str:
    """CTE name(id, score, rank): the best k of hits."""
    return f"{name} AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) AS rank FROM {hits} WHERE {where} ORDER BY score DESC, id LIMIT {k})"


def _bm25_sql(terms: list[str], where: str = "TRUE", weight: str = "w") -> str:
    return f"""{INDEX}, {_hits_sql("hits", terms, weight)}, {_top_sql("best", "hits", where)} SELECT id, round(score, 6) AS score, rank FROM best"""


def _rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if c in columns else F.col(c) for c in df.columns))


def _starred(spark, d) -> DataFrame:
    links = tables.user_stars(spark, d).withColumnRenamed("repo_id", "id")
    return tables.repos(spark, d).drop("readme").join(links, "id")


STARRED = "starred AS (SELECT r.*, s.login, s.starred_at, s.star_page FROM repos r JOIN user_stars s ON r.id = s.repo_id)"
ANY, BOTH, RARE = ["token", "idiot", "example"], ["than", "hain"], ["idiot", "token"]


# ---- filters, joins, projections ----


@query(f"+{STARRED} SELECT login, id, language FROM starred WHERE lower(language) = 'de'")
def flt_language(spark, d):
    return _starred(spark, d).where(FL.predicate(FL.Filters(language="DE"))).select("login", "id", "language")


@query(f"+{STARRED} SELECT login, id, stars FROM starred WHERE stars BETWEEN 500 AND 1500")
def flt_stars_range(spark, d):
    return _starred(spark, d).where(FL.predicate(FL.Filters(min_stars=500, max_stars=1500))).select("login", "id", "stars")


@query("SELECT id, archived FROM repos WHERE NOT archived")
def flt_archived(spark, d):
    return tables.repos(spark, d).where(FL.predicate(FL.Filters(archived=False))).select("id", "archived")


@query("SELECT id, license FROM repos WHERE lower(COALESCE(license, '')) = 'mit'")
def flt_license_like(spark, d):
    return tables.repos(spark, d).where(FL.predicate(FL.Filters(license="MIT"))).select("id", "license")


@query(f"+{STARRED} SELECT login, id, starred_at FROM starred WHERE starred_at >= '2024-01-05' AND starred_at <= '2024-01-20'")
def flt_date_range(spark, d):
    return _starred(spark, d).where(FL.predicate(FL.Filters(starred_after="2024-01-05", starred_before="2024-01-20"))).select("login", "id", "starred_at")


@query("SELECT id FROM repos WHERE list_has_all(list_transform(topics, lambda x: lower(x)), ['en', 'src0'])")
def flt_topics_all(spark, d):
    return tables.repos(spark, d).where(FL.predicate(FL.Filters(topics=("EN", "src0")))).select("id")


@query("SELECT id FROM repos WHERE EXISTS (SELECT 1 FROM group_repos g WHERE g.repo_id = id AND g.slug IN ('toxic', 'none'))")
def flt_groups_any(spark, d):
    return FL.in_groups(tables.repos(spark, d), tables.group_repos(spark, d), ("toxic", "none")).select("id")


@query("SELECT id, language, stars FROM repos WHERE language = 'fr' AND stars >= 300 AND NOT archived AND list_contains(topics, 'src3')")
def flt_lab_profile(spark, d):
    return tables.repos(spark, d).where(FL.lab_predicate("FR", ("src3",), 300, None, False)).select("id", "language", "stars")


@query("SELECT s.login, r.id, s.starred_at, s.star_page FROM repos r JOIN user_stars s ON r.id = s.repo_id WHERE s.login = 'u7'")
def universe_join(spark, d):
    return FL.universe(tables.repos(spark, d), tables.user_stars(spark, d), "u7").select(F.lit("u7").alias("login"), "id", "starred_at", "star_page")


@query("SELECT id, owner, name, description, NULL::VARCHAR AS starred_at, (SELECT list_sort(list(DISTINCT slug)) FROM group_repos g WHERE g.repo_id = id) AS slugs FROM repos WHERE full_name = (SELECT full_name FROM repos WHERE id = 6)")
def repo_detail(spark, d):
    return Engine.over(spark, d).show("src6/doc-6").select("id", "owner", "name", "description", "starred_at", "slugs")


@query("SELECT DISTINCT g.id::BIGINT AS id, g.slug, g.position, r.repo_id FROM groups g LEFT JOIN group_repos r USING (slug)")
def group_membership(spark, d):
    return MG.memberships(tables.groups(spark), tables.group_repos(spark, d)).select("id", "slug", "position", "repo_id")


@query("SELECT repo_id, list_sort(list(DISTINCT slug)) AS slugs FROM group_repos GROUP BY repo_id")
def groups_per_repo(spark, d):
    return MG.groups_of(tables.group_repos(spark, d))


@query("SELECT count(*) AS stars, count(r.id) AS repos, count(r.readme) AS readmes FROM user_stars s LEFT JOIN repos r ON r.id = s.repo_id WHERE s.login = 'u7'")
def count_stats(spark, d):
    return FL.counts(tables.repos(spark, d), tables.user_stars(spark, d), "u7")


@query("SELECT star_page, count(*) AS links FROM user_stars GROUP BY star_page")
def page_counts(spark, d):
    return tables.user_stars(spark, d).groupBy("star_page").agg(F.count("*").alias("links"))


@query(f"SELECT token, count(*) AS df FROM (SELECT id, unnest(list_distinct({CAMEL('name')})) AS token FROM repos) GROUP BY token")
def name_df(spark, d):
    return FU.name_df(tables.repos(spark, d))


_STORED = "CASE id % 5 WHEN 0 THEN 'present' WHEN 1 THEN 'missing' WHEN 2 THEN 'too_big' WHEN 3 THEN 'pending' END"


@query(f"SELECT status, count(*) AS n FROM (SELECT CASE WHEN s IN ('present', 'too_big') THEN 'ok' WHEN s IN ('missing', 'pending') THEN s ELSE 'error' END AS status FROM (SELECT {_STORED} AS s FROM repos)) GROUP BY status")
def readme_states(spark, d):
    return tables.repos(spark, d).groupBy(tables.fetch_status(F.expr(_STORED)).alias("status")).agg(F.count("*").alias("n"))


@query("SELECT login, CASE WHEN n % 3 = 0 THEN 'never' WHEN n % 3 = 1 THEN 'empty' ELSE 'never' END AS state, CASE WHEN n % 3 > 0 THEN n END AS checked_at FROM (SELECT login, count(*) AS n FROM user_stars GROUP BY login)")
def lists_states(spark, d):
    n = tables.user_stars(spark, d).groupBy("login").agg(F.count("*").alias("n"))
    stored = n.where("n % 3 > 0").select("login", F.when(F.col("n") % 3 == 1, "empty").otherwise("odd").alias("state"), F.lit(None).cast("string").alias("error"), F.col("n").alias("checked_at"))
    return tables.lists_info(n, stored).select("login", "state", "checked_at")


@query("SELECT login, 0::BIGINT AS semantic_docs, count(*) AS stars FROM user_stars GROUP BY login")
def hidden_counters(spark, d):
    states = tables.user_stars(spark, d).groupBy("login").agg(F.count("*").alias("semantic_docs"), F.count("*").alias("stars"))
    return tables.without_semantic(states, False)


@query("SELECT login, 'fts_u_' || regexp_replace(replace(lower(login), '-', '_'), '[^a-z0-9_]', '', 'g') AS name FROM (SELECT DISTINCT 'U-' || login || '.X' AS login FROM user_stars)")
def index_names(spark, d):
    logins = tables.user_stars(spark, d).select(F.concat(F.lit("U-"), "login", F.lit(".X")).alias("login")).distinct()
    return logins.select("login", T.table_name(F.col("login")).alias("name"))


@query("SELECT name, array_to_string(list_transform(string_split(name, '_'), lambda x, i: CASE WHEN i > 1 THEN upper(left(x, 1)) || substring(x, 2) ELSE x END), '') AS camel FROM (SELECT DISTINCT lower(event_type) || '_of_' || user_id % 7 || 'x_y' AS name FROM events)")
def camel_names(spark, d):
    names = tables.read(spark, d, "events").select(F.concat(F.lower("event_type"), F.lit("_of_"), (F.col("user_id") % 7).cast("string"), F.lit("x_y")).alias("name")).distinct()
    return names.select("name", T.camelized(F.col("name")).alias("camel"))


@query("SELECT count(*) AS candidates, count(v.id) AS vectors, least(1.0::DOUBLE, count(v.id)::DOUBLE / count(*)) AS coverage FROM repos r LEFT JOIN vectors v USING (id) WHERE r.language = 'en'")
def semantic_coverage(spark, d):
    engine = Engine.over(spark, d)
    return engine.coverage(engine.repos.where("language = 'en'"))


# ---- text ----


@query(f"SELECT id, len({CAMEL('readme')}) AS n_tokens, len(list_distinct({CAMEL('readme')})) AS n_distinct FROM repos")
def tokenize_stats(spark, d):
    words = tables.repos(spark, d).select("id", T.tokens(F.col("readme")).alias("w"))
    return words.select("id", F.size("w").cast("long").alias("n_tokens"), F.size(F.array_distinct("w")).cast("long").alias("n_distinct"))


@query(f"+ws AS (SELECT id, {CAMEL('description')} AS w FROM repos) SELECT id, list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS phrases FROM ws")
def ngram_phrases(spark, d):
    return tables.repos(spark, d).select("id", F.array_sort(T.phrases(T.tokens(F.col("description")))).alias("phrases"))


@query(f"SELECT id, {PLAIN('full_name')} AS plain, regexp_replace(regexp_replace(lower(full_name), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM repos")
def normalize_name(spark, d):
    return tables.repos(spark, d).select("id", T.plain_name(F.col("full_name")).alias("plain"), T.slug(F.col("full_name")).alias("slug"))


@query("SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<(script|style)\\b.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\\s+', ' ', 'g')) AS text FROM pages")
def strip_markup(spark, d):
    return tables.read(spark, d, "pages").select("page_id", T.strip_tags(F.col("html")).alias("text"))


@query("SELECT event_id, (props->>'k')::BIGINT AS k FROM events")
def json_fields(spark, d):
    return tables.read(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT id, CASE WHEN id % 3 = 0 THEN [] ELSE topics END AS topics FROM repos")
def parse_topics(spark, d):
    text = F.when(F.col("id") % 3 == 0, "not json").otherwise(F.to_json("topics"))
    return tables.repos(spark, d).select("id", wire.topics_of(text).alias("topics"))


@query("SELECT id, CASE WHEN length(trim(regexp_replace(description, '\\s+', ' ', 'g'))) > 40 THEN rtrim(substring(trim(regexp_replace(description, '\\s+', ' ', 'g')), 1, 39)) || '…' ELSE trim(regexp_replace(description, '\\s+', ' ', 'g')) END AS short FROM repos")
def truncated_text(spark, d):
    return tables.repos(spark, d).select("id", T.truncated(T.one_line(F.col("description")), 40).alias("short"))


@query("SELECT id, CASE WHEN stars >= 1000000 THEN regexp_replace(printf('%.1f', floor(stars / 1000000.0::DOUBLE * 10) / 10), '\\.0$', '') || 'M' WHEN stars >= 1000 THEN regexp_replace(printf('%.1f', floor(stars / 1000.0::DOUBLE * 10) / 10), '\\.0$', '') || 'k' ELSE stars::VARCHAR END AS stars FROM repos")
def compact_numbers(spark, d):
    return tables.repos(spark, d).select("id", D.compact(F.col("stars")).alias("stars"))


def _snippet_ctes(rows: str, terms: list[str], name: str = "") -> str:
    """CTEs that end in snip(id, snippet) for rows with id, readme, description."""
    edge, words = "[^\\p{L}\\p{N}]", "|".join(terms)
    hit = f"(?:^|{edge})({words})(?:$|{edge})"
    return f"""{name}t AS (SELECT id, trim(regexp_replace(readme, '\\s+', ' ', 'g')) AS body, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS about FROM {rows}),
{name}f AS (SELECT id, body, about, CASE WHEN COALESCE(regexp_matches(lower(body), '{hit}'), FALSE) THEN body ELSE about END AS x, COALESCE(regexp_matches(lower(body), '{hit}'), FALSE) OR COALESCE(regexp_matches(lower(about), '{hit}'), FALSE) AS hit FROM {name}t),
{name}p AS (SELECT *, CASE WHEN regexp_matches(lower(x), '^({words})(?:$|{edge})') THEN 1 WHEN hit THEN length(regexp_extract(lower(x), '(?s)^(.*?){hit}', 1)) + 2 END AS spot FROM {name}f),
{name}s0 AS (SELECT *, greatest(spot - 60, 1) AS s0 FROM {name}p),
{name}s1 AS (SELECT *, CASE WHEN s0 > 1 AND instr(substring(x, s0, 60), ' ') > 0 THEN s0 + instr(substring(x, s0, 60), ' ') ELSE s0 END AS start FROM {name}s0),
{name}c AS (SELECT *, substring(x, start, 220) AS piece, start + 220 <= length(x) AS more FROM {name}s1),
{name}e AS (SELECT *, CASE WHEN instr(reverse(piece), ' ') > 0 THEN length(piece) - instr(reverse(piece), ' ') ELSE length(piece) END AS last FROM {name}c),
{name}snip AS (SELECT id, CASE WHEN hit THEN CASE WHEN start > 1 THEN '…' ELSE '' END || trim(CASE WHEN more AND last > 0 AND last < length(piece) THEN substring(piece, 1, last) ELSE piece END) || CASE WHEN more THEN '…' ELSE '' END
    WHEN about IS NULL THEN '' WHEN length(about) > 220 THEN rtrim(substring(about, 1, 219)) || '…' ELSE about END AS snippet FROM {name}e)"""


@query(f"+{_snippet_ctes('repos', ANY)} SELECT id, snippet FROM snip")
def snippet_window(spark, d):
    return tables.repos(spark, d).select("id", T.snippet(F.col("readme"), F.col("description"), ANY).alias("snippet"))


@query("SELECT DISTINCT r.id FROM repos r WHERE contains(lower(concat_ws(chr(10), full_name, description, array_to_string(topics, ' '))), 'then')")
def trigram_match(spark, d):
    return LG.trigram_leg(index_over(spark, d), tables.repos(spark, d), "then")


# ---- ranking over the index ----


@query(_bm25_sql(ANY))
def bm25_or(spark, d):
    return _rounded(LG.any_leg(index_over(spark, d), ANY, 50), "score")


@query(_bm25_sql(BOTH, "n_terms = 2"))
def bm25_and(spark, d):
    return _rounded(LG.all_leg(index_over(spark, d), BOTH, 50), "score")


@query(_bm25_sql(RARE, "n_terms = 2 OR (SELECT count(*) FROM hits WHERE n_terms = 2) < 3"))
def bm25_fallback(spark, d):
    return _rounded(LG.keyword_leg(index_over(spark, d), RARE, 50), "score")


@query(_bm25_sql(ANY, "id IN (SELECT id FROM repos WHERE language = 'en' AND NOT archived)"))
def bm25_candidates(spark, d):
    found = tables.repos(spark, d).where(FL.predicate(FL.Filters(language="en", archived=False)))
    return _rounded(LG.any_leg(index_over(spark, d), ANY, 50, found), "score")


@query(f"{INDEX}, {_hits_sql('hits', ANY, 'lab_w')} SELECT id, n_terms, round(score, 6) AS score FROM hits")
def bm25_weighted(spark, d):
    index = index_over(spark, d)
    return _rounded(LG.scored(index.matches(ANY, IX.LAB_WEIGHTS), index.stats()), "score")


@query(_bm25_sql(["of the", "and the in"]))
def bm25_phrase(spark, d):
    return _rounded(LG.any_leg(index_over(spark, d), ["of the", "and the in"], 50), "score")


@query(_bm25_sql(["tokens", "examples", "idiotic"], "n_terms = 3 OR (SELECT count(*) FROM hits WHERE n_terms = 3) < 3"))
def bm25_porter(spark, d):
    return _rounded(LG.keyword_leg(index_over(spark, d), ["tokens", "examples", "idiotic"], 50), "score")


@query(f"{INDEX} SELECT term, count(DISTINCT id) AS df, round(sum(w), 3) AS tf FROM toks GROUP BY term")
def term_statistics(spark, d):
    rows = index_over(spark, d).terms().select("term", IX.frequency(IX.WEIGHTS).alias("tf"))
    return rows.groupBy("term").agg(F.count("*").alias("df"), F.round(F.sum("tf"), 3).alias("tf"))


@query(f"{INDEX} SELECT (SELECT count(*) FROM lens) AS documents, (SELECT round(avg(len), 6) FROM lens) AS mean_len, count(*) AS postings, count(DISTINCT term) AS terms FROM (SELECT DISTINCT id, term FROM toks)")
def index_build(spark, d):
    """Builds the index anew and sums it up."""
    index = IX.SearchIndex.build(tables.repos(spark, d))
    docs = index.stats().select(F.col("n").alias("documents"), F.round("mean_len", 6).alias("mean_len"))
    return docs.crossJoin(F.broadcast(index.terms().agg(F.count("*").alias("postings"), F.count_distinct("term").alias("terms"))))  # one row each


@query(f"""+kept AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'changed idiots ' || name ELSE readme END AS readme, full_name, description, topics FROM repos WHERE id % 7 <> 0), {INDEX[1:].replace("FROM repos)", "FROM kept)", 1)}, {_hits_sql("hits", ANY)}, {_top_sql("best", "hits")} SELECT id, round(score, 6) AS score, rank FROM best""")
def index_upsert(spark, d):
    """An index after some documents were changed and some taken out."""
    repos = tables.repos(spark, d)
    index = IX.SearchIndex.build(repos)
    index.upsert(repos.where("id % 5 = 0").withColumn("readme", F.concat(F.lit("changed idiots "), "name")))
    index.delete(repos.where("id % 7 = 0"))
    return _rounded(LG.any_leg(index, ANY, 50), "score")


BATCH_SQL = f"""{INDEX}, said AS (SELECT item_id AS query_id, unnest({TOKENS("text")}) AS word FROM benchmark), {stem_ctes("SELECT word FROM said").replace("porter", "item_porter").replace("stems AS", "item_stems AS").replace("vocabulary", "item_words")},
asked AS (SELECT DISTINCT query_id, stem AS term FROM said JOIN item_stems USING (word)), tf AS (SELECT id, term, sum(w) AS tf FROM toks WHERE term IN (SELECT term FROM asked) GROUP BY id, term),
dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
worth AS (SELECT term, tf.id, {WORTH} AS s FROM tf JOIN dfs USING (term) JOIN lens USING (id), stats),
scores AS (SELECT query_id, id, sum(s) AS score FROM asked JOIN worth USING (term) GROUP BY 1, 2)
SELECT query_id, count(*) AS hits, round(max(score), 4) AS best FROM scores GROUP BY query_id"""


@query(BATCH_SQL)
def batch_search(spark, d):
    asked = tables.read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    hits = Engine.over(spark, d).batch_keyword(asked, None)
    return hits.groupBy("query_id").agg(F.count("*").alias("hits"), F.round(F.max("score"), 4).alias("best"))


# ---- vectors ----

FIRST = "q AS (SELECT vector AS qv FROM vectors ORDER BY id LIMIT 1)"


def _first_vector(vectors: DataFrame) -> list[float]:
    return list(vectors.orderBy("id").first().vector)


@query(f"+{FIRST} SELECT id, round(list_cosine_similarity(vector, qv), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(vector, qv), 9) DESC, id) AS rank FROM vectors, q ORDER BY 3 LIMIT 20")
def knn_cosine(spark, d):
    v = tables.vectors(spark, d)
    return _rounded(LG.vector_leg(v, _first_vector(v), 20), "score")


@query(f"+{FIRST} SELECT id, round(list_cosine_similarity(vector, qv), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(vector, qv), 9) DESC, id) AS rank FROM vectors, q WHERE label = 3 ORDER BY 3 LIMIT 20")
def knn_filtered(spark, d):
    v = tables.vectors(spark, d)
    return _rounded(LG.vector_leg(v, _first_vector(v), 20, v.where("label = 3")), "score")


@query(f"+{FIRST} SELECT id, round(list_dot_product(vector, qv), 6) AS score, row_number() OVER (ORDER BY round(list_dot_product(vector, qv), 9) DESC, id) AS rank FROM vectors, q ORDER BY 3 LIMIT 20")
def dot_topk(spark, d):
    v = tables.vectors(spark, d)
    return _rounded(LG.vector_leg(v, _first_vector(v), 20, normalised=True), "score")


@query("+qs AS (SELECT id AS query_id, vector AS qv FROM vectors WHERE id % 50 = 0), s AS (SELECT query_id, id, round(list_cosine_similarity(vector, qv), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(vector, qv), 9) DESC, id) AS rank FROM vectors, qs) SELECT * FROM s WHERE rank <= 10")
def knn_batch(spark, d):
    v = tables.vectors(spark, d)
    return _rounded(LG.batch_knn(v.where("id % 50 = 0").withColumnRenamed("id", "query_id"), v, 10), "score")


@query("+q AS (SELECT vector AS qv FROM vectors WHERE id = 10) SELECT id, round(list_cosine_similarity(vector, qv), 6) AS score, row_number() OVER (ORDER BY round(list_cosine_similarity(vector, qv), 9) DESC, id) AS rank FROM vectors, q WHERE id <> 10 ORDER BY 3 LIMIT 15")
def similar_items(spark, d):
    return _rounded(Engine.over(spark, d).similar(10, 15), "score")


# ---- fusion ----

LEGS = """legs AS (SELECT 'keyword' AS leg, id, row_number() OVER (ORDER BY stars DESC, id) AS rank FROM repos WHERE language = 'en' UNION ALL SELECT 'expanded', id, row_number() OVER (ORDER BY id) FROM repos WHERE owner IN ('src1', 'src2', 'src3') UNION ALL
    SELECT 'semantic', id, row_number() OVER (ORDER BY id DESC) FROM repos WHERE NOT archived),
top AS (SELECT * FROM legs WHERE rank <= 200),
best AS (SELECT id, min(rank) FILTER (leg = 'keyword') AS k, min(rank) FILTER (leg = 'expanded') AS e, min(rank) FILTER (leg = 'semantic') AS s FROM top GROUP BY id),
fused AS (SELECT id, COALESCE(1.0::DOUBLE / (60 + k), 0) + COALESCE(0.6::DOUBLE / (60 + e), 0) + COALESCE(1.0::DOUBLE / (60 + s), 0) AS rrf, k, e, s FROM best)"""
PRIOR = "CASE WHEN stars > 0 THEN least(1.25::DOUBLE, 1 + 0.25::DOUBLE * log10(1.0::DOUBLE + stars) / log10(50001::DOUBLE)) ELSE 1.0::DOUBLE END"
#: The registered searches: a concept whose words the collection has, a query that names no document, and its terms.
SPEECH = {"speech": ("Speech", ["token"], ["idiot", "of the", "licensed"])}
ASK, PAGE_ASK, LAB_ASK = "doc src3 token example", "the doc token", "the token"


def _has_run(text: str, term: str) -> str:
    return f"contains(' ' || array_to_string({CAMEL(text)}, ' ') || ' ', ' {term} ')"


def _search_sql(found: str, ask: str, k: int = 50, legs: str = "kes") -> str:
    """CTEs from the index up to ranked(id, ..., boost, score): a search by some legs among the repositories of the query found."""
    leg = {"k": "keyword_leg", "e": "expanded_leg", "s": "semantic_leg"}
    words = list(dict.fromkeys(tokenize(ask)))
    more = expand(words, SPEECH).terms
    terms = FU.evidence(words, more)
    spec = lambda t: f"(1 / (1 + log2(1.0::DOUBLE + COALESCE((SELECT max(df) FROM dfs WHERE token IN ({', '.join(repr(p) for p in t.split())})), 0))))"
    key = lambda t: t.replace(" ", "")
    tier = lambda t: f"CASE WHEN {PLAIN('name')} = '{key(t)}' THEN 0.45::DOUBLE WHEN {'starts_with(' + PLAIN('name') + ', ' + repr(key(t)) + ')' if len(key(t)) > 2 else 'FALSE'} THEN 0.2 WHEN {_has_run('name', t)} THEN 0.1 ELSE 0 END"
    in_topics = " + ".join(f"(len(list_filter(topics, lambda x: {_has_run('x', t)})) > 0)::INT" for t in terms)
    in_about = " + ".join(f"({_has_run(chr(67) + 'OALESCE(description, ' + chr(39) * 2 + ')', t)})::INT" for t in terms)
    return f"""{INDEX}, found AS ({found}), {_hits_sql("kw", words)}, {_hits_sql("ex", more)}, inside AS (SELECT * FROM kw WHERE id IN (SELECT id FROM found)),
{_top_sql("keyword_leg", "inside", f"n_terms = {len(words)} OR (SELECT count(*) FROM inside WHERE n_terms = {len(words)}) < 3", k)}, {_top_sql("expanded_leg", "ex", "id IN (SELECT id FROM found)", k)},
q AS (SELECT vector AS qv FROM vectors ORDER BY id LIMIT 1), near AS (SELECT v.id, round(list_cosine_similarity(vector, qv), 9) AS score FROM vectors v, q WHERE v.id IN (SELECT id FROM found)), {_top_sql("semantic_leg", "near", k=k)},
legs AS ({' UNION ALL '.join(f"SELECT '{x}' AS leg, id, rank FROM {leg[x]}" for x in legs)}),
best AS (SELECT id, min(rank) FILTER (leg = 'k') AS k, min(rank) FILTER (leg = 'e') AS e, min(rank) FILTER (leg = 's') AS s FROM legs GROUP BY id),
base AS (SELECT r.*, COALESCE(1.0::DOUBLE / (60 + k), 0) + COALESCE(0.6::DOUBLE / (60 + e), 0) + COALESCE(1.0::DOUBLE / (60 + s), 0) AS rrf, k, e, s FROM found r JOIN best USING (id)),
dfs AS (SELECT token, count(*) AS df FROM (SELECT id, unnest(list_distinct({CAMEL("name")})) AS token FROM base) GROUP BY token),
boosted AS (SELECT *, least(1.6::DOUBLE, greatest({", ".join(f"1 + ({tier(t)}) * {spec(t)}" for t in terms)})) AS boost, 0.003::DOUBLE * least({in_topics}, 3) + 0.0015::DOUBLE * least({in_about}, 3) AS bonus FROM base),
fused AS (SELECT *, round(rrf * boost * {PRIOR} * CASE WHEN archived THEN 0.4::DOUBLE ELSE 1 END + bonus, 12) AS score0 FROM boosted),
ranked AS (SELECT *, round(score0 * power(0.85::DOUBLE, row_number() OVER (PARTITION BY lower(owner) ORDER BY score0 DESC, stars DESC, id) - 1) * power(0.7::DOUBLE, row_number() OVER (PARTITION BY {PLAIN("name")} ORDER BY score0 DESC, stars DESC, id) - 1), 12) AS score FROM fused),
placed AS (SELECT *, row_number() OVER (ORDER BY score DESC, stars DESC, id) AS position,
    list_filter([CASE WHEN k IS NOT NULL THEN 'keyword' END, CASE WHEN e IS NOT NULL THEN 'expanded' END, CASE WHEN s IS NOT NULL THEN 'semantic' END, CASE WHEN boost > 1 THEN 'name' END], lambda x: x IS NOT NULL) AS matched_by FROM ranked)"""


def _legs(spark, d) -> tuple[DataFrame, dict[str, DataFrame]]:
    repos = tables.repos(spark, d)
    by = lambda rows, score: LG.top(rows.select("id", score.cast("double").alias("score")), 200)
    return repos, {"keyword": by(repos.where("language = 'en'"), F.col("stars")), "expanded": by(repos.where(F.col("owner").isin("src1", "src2", "src3")), -F.col("id")), "semantic": by(repos.where("not archived"), F.col("id"))}


@query(f"+{LEGS} SELECT id, round(rrf, 9) AS rrf, k AS rank_keyword, e AS rank_expanded, s AS rank_semantic FROM fused")
def rrf_fuse(spark, d):
    return _rounded(FU.fuse_ranks(FU.union_legs(_legs(spark, d)[1])), "rrf", digits=9)


@query(f"+{LEGS} SELECT id, round(COALESCE(2.0::DOUBLE / (60 + k), 0) + COALESCE(0.5::DOUBLE / (60 + s), 0), 9) AS rrf FROM best WHERE k IS NOT NULL OR s IS NOT NULL")
def rrf_weighted(spark, d):
    legs = {k: v for k, v in _legs(spark, d)[1].items() if k != "expanded"}
    return _rounded(FU.fuse_ranks(FU.union_legs(legs), {"keyword": 2.0, "semantic": 0.5}).select("id", "rrf"), "rrf", digits=9)


@query(f"SELECT id, round({PRIOR}, 9) AS prior, round(least(1.25::DOUBLE, 1 + 0.04::DOUBLE * log10(stars + 1.0::DOUBLE)), 9) AS lab_prior FROM repos")
def star_prior(spark, d):
    return tables.repos(spark, d).select("id", F.round(S.star_prior(F.col("stars")), 9).alias("prior"), F.round(S.lab_star_prior(F.col("stars")), 9).alias("lab_prior"))


@query(f"+names AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({CAMEL('full_name')})) AS token FROM repos) GROUP BY token) SELECT token, round(1 / (1 + log2(1.0::DOUBLE + df)), 9) AS specificity FROM names")
def term_specificity(spark, d):
    df = FU.name_df(tables.repos(spark, d).withColumn("name", F.col("full_name")))
    return df.select("token", F.round(S.specificity(F.col("df")), 9).alias("specificity"))


@query(f"""+df AS (SELECT token, count(*) AS df FROM (SELECT unnest(list_distinct({CAMEL("owner")})) AS token FROM repos) GROUP BY token),
spec AS (SELECT 1 / (1 + log2(1.0::DOUBLE + COALESCE((SELECT df FROM df WHERE token = 'src1'), 0))) AS s)
SELECT id, round(1 + (CASE WHEN {PLAIN("owner")} = 'src1' THEN 1.45::DOUBLE WHEN starts_with({PLAIN("owner")}, 'src1') THEN 1.2::DOUBLE WHEN list_contains({CAMEL("owner")}, 'src1') THEN 1.1::DOUBLE ELSE 1 END - 1) * s, 9) AS boost FROM repos, spec""")
def name_boost(spark, d):
    repos = tables.repos(spark, d).withColumn("name", F.col("owner"))
    with_spec = FU.with_specificity(repos, ["src1"], repos)
    return with_spec.select("id", F.round(FU.name_boost(["src1"], F.col("name"), F.col("spec")), 9).alias("boost"))


@query(f"""+terms AS (SELECT unnest(['en', 'the', 'of', 'src1']) AS t),
m AS (SELECT r.id, count(*) FILTER (len(list_filter(r.topics, lambda x: list_contains({CAMEL("x")}, t))) > 0) AS a, count(*) FILTER (list_contains({CAMEL("COALESCE(r.description, '')")}, t)) AS b FROM repos r, terms GROUP BY r.id)
SELECT id, round(0.003::DOUBLE * least(a, 3) + 0.0015::DOUBLE * least(b, 3), 9) AS bonus FROM m""")
def overlap_bonus(spark, d):
    return tables.repos(spark, d).select("id", F.round(FU.overlap_bonus(["en", "the", "of", "src1"], F.col("topics"), F.col("description")), 9).alias("bonus"))


FOUND = "SELECT r.*, NULL::VARCHAR AS starred_at FROM repos r WHERE lower(language) = 'en' AND NOT archived"
STARRED_BY = "SELECT r.*, s.starred_at FROM repos r JOIN user_stars s ON r.id = s.repo_id WHERE s.login = 'u7'"


def _searched(spark, d, ask: str = ASK) -> tuple[Engine, SearchRequest]:
    engine = Engine.over(spark, d, concepts=SPEECH)
    return engine, SearchRequest("u7", ask, vector=tuple(_first_vector(engine.vectors)), limit=50)


def _hits(spark, d) -> DataFrame:
    engine, request = _searched(spark, d)
    found = engine.repos.where(FL.predicate(FL.Filters(language="en", archived=False))).withColumn("starred_at", F.lit(None).cast("string"))
    return engine.hits(request, found)[0]


@query(f"{_search_sql(FOUND, ASK)} SELECT id, round(score0, 9) AS base, round(score, 9) AS score, round(boost, 9) AS boost, round(bonus, 9) AS bonus FROM ranked")
def dup_penalty(spark, d):
    """Hits before and after the penalties for owners and names that come again."""
    engine, _ = _searched(spark, d)
    hits = _hits(spark, d).select("id", "score", "boost", F.round(FU.overlap_bonus(FU.evidence(tokenize(ASK), expand(tokenize(ASK), SPEECH).terms), F.col("topics"), F.col("description")), 9).alias("bonus"), "rrf", "stars", "archived")
    base = F.round(F.col("rrf") * F.col("boost") * S.star_prior(F.col("stars")) * F.when(F.col("archived"), FU.ARCHIVED).otherwise(1.0) + F.col("bonus"), 12)
    return _rounded(hits.select("id", base.alias("base"), "score", "boost", "bonus"), "base", "score", "boost", digits=9)


@query(f"{_search_sql(FOUND, ASK)} SELECT id, round(score, 9) AS score, round(boost, 9) AS boost, k AS rank_keyword, e AS rank_expanded, s AS rank_semantic, matched_by, stars, position FROM placed WHERE position <= 50")
def hybrid_search(spark, d):
    """Keyword, concept and vector legs among the collection's English documents, fused with names, stars, topics and penalties."""
    page = RK.page(_hits(spark, d), "relevance", 0, 50)
    return _rounded(page.select("id", "score", "boost", "rank_keyword", "rank_expanded", "rank_semantic", "matched_by", "stars", "position"), "score", "boost", digits=9)


@query(f"""{_search_sql(STARRED_BY, PAGE_ASK)}, {_snippet_ctes("(SELECT * FROM placed WHERE position <= 10)", FU.evidence(tokenize(PAGE_ASK), expand(tokenize(PAGE_ASK), SPEECH).terms))}, about AS (SELECT id, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS text FROM placed),
{_snippet_ctes("(SELECT id, NULL::VARCHAR AS readme, description FROM placed WHERE position > 10)", FU.evidence(tokenize(PAGE_ASK), expand(tokenize(PAGE_ASK), SPEECH).terms), "rest_")}
SELECT position, id, round(score, 9) AS score, starred_at, k AS rank_keyword, e AS rank_expanded, s AS rank_semantic, matched_by, COALESCE((SELECT list_sort(list(DISTINCT slug)) FROM group_repos g WHERE g.repo_id = id), []) AS slugs,
    COALESCE((SELECT snippet FROM snip WHERE snip.id = placed.id), (SELECT snippet FROM rest_snip WHERE rest_snip.id = placed.id)) AS snippet, 'hybrid' AS mode, NULL::VARCHAR AS degraded FROM placed WHERE position <= 50""")
def search_page(spark, d):
    engine, request = _searched(spark, d, PAGE_ASK)
    rows = engine.search(request).select("position", "id", "score", "starred_at", "rank_keyword", "rank_expanded", "rank_semantic", "matched_by", "slugs", "snippet", "mode", "degraded")
    return _rounded(rows, "score", digits=9)


LAB_SPEECH = {"speech": ("Speech", ["token"], ["idiot", "example"])}


@query(f"""{INDEX}, found AS (SELECT * FROM repos WHERE NOT archived), {_hits_sql("kw", ["the", "token"], "lab_w")}, {_hits_sql("ex", ["idiot", "example"], "lab_w")}, inside AS (SELECT * FROM kw WHERE id IN (SELECT id FROM found)),
{_top_sql("leg", "inside", "n_terms = 2 OR NOT EXISTS (SELECT 1 FROM inside WHERE n_terms = 2)")}, {_top_sql("wide", "ex", "id IN (SELECT id FROM found)")},
merged AS (SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (SELECT id, rank FROM leg UNION ALL SELECT id, rank FROM wide) GROUP BY id), {_top_sql("lexical", "merged")},
q AS (SELECT vector AS qv FROM vectors ORDER BY id LIMIT 1), near AS (SELECT v.id, round(list_dot_product(vector, qv), 9) AS score FROM vectors v, q WHERE v.id IN (SELECT id FROM found)), {_top_sql("semantic", "near")},
fused AS (SELECT id, l.rank AS lex_rank, s.rank AS sem_rank, COALESCE(1.0::DOUBLE / (60 + l.rank), 0) + COALESCE(1.0::DOUBLE / (60 + s.rank), 0) AS rrf FROM lexical l FULL JOIN semantic s USING (id)),
scored AS (SELECT f.*, round(rrf * least(1.25::DOUBLE, 1 + 0.04::DOUBLE * log10(stars + 1.0::DOUBLE)), 9) AS score FROM fused f JOIN found USING (id))
SELECT row_number() OVER (ORDER BY score DESC, rrf DESC, id) AS position, id, round(rrf, 9) AS base, score, lex_rank, sem_rank FROM scored ORDER BY position LIMIT 20""")
def lab_search(spark, d):
    v = tables.vectors(spark, d)
    rows = lab_plan(index_over(spark, d), tables.repos(spark, d), LAB_ASK, "hybrid+expand", 20, v, _first_vector(v), concepts=LAB_SPEECH, with_archived=False)
    return _rounded(rows.drop("snippet"), "base", digits=9)


@query()
def lab_pool(spark, d):
    """The pool of all modes' results that a judge of relevance would see."""
    v = tables.vectors(spark, d)
    run = lambda mode: lab_plan(index_over(spark, d), tables.repos(spark, d), LAB_ASK, mode, 20, v, _first_vector(v), concepts=LAB_SPEECH)
    return pooled({mode: run(mode) for mode in ("keyword", "semantic", "hybrid", "hybrid+expand")})


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hybrid search over the collection."""
    return hybrid_search(spark, sf_dir)


# ---- orders and pages ----


@query(f"+{STARRED}, o AS (SELECT id, login, stars, row_number() OVER (ORDER BY stars DESC, starred_at DESC, id, login) AS position FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY login) AS k FROM starred) WHERE k = 1) SELECT id, stars, position FROM o WHERE position > 10 AND position <= 40")
def sort_stars(spark, d):
    one = _starred(spark, d).withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("login"))).where("k = 1")
    return RK.page(one, "stars", 10, 30).select("id", "stars", "position")


@query("+u AS (SELECT r.id, s.starred_at FROM repos r JOIN user_stars s ON r.id = s.repo_id WHERE s.login = 'u7') SELECT id, starred_at, row_number() OVER (ORDER BY starred_at DESC, id) AS position FROM u LIMIT 20")
def sort_starred(spark, d):
    found = FL.universe(tables.repos(spark, d), tables.user_stars(spark, d), "u7")
    return RK.page(found, "starred", 0, 20).select("id", "starred_at", "position")


@query("+u AS (SELECT r.id, s.starred_at, CASE WHEN id % 4 = 0 THEN 'bad date' ELSE strftime(TIMESTAMP '2024-01-01' + to_days((id % 97)::INT), '%Y-%m-%dT%H:%M:%SZ') END AS pushed_at FROM repos r JOIN user_stars s ON r.id = s.repo_id WHERE s.login = 'u7') SELECT id, pushed_at, row_number() OVER (ORDER BY CASE WHEN pushed_at = 'bad date' THEN NULL ELSE pushed_at END DESC NULLS LAST, starred_at DESC, id) AS position FROM u")
def sort_pushed(spark, d):
    found = FL.universe(tables.repos(spark, d), tables.user_stars(spark, d), "u7")
    day = F.date_format(F.timestamp_seconds(F.lit(1704067200) + (F.col("id") % 97) * 86400), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return RK.page(found.withColumn("pushed_at", F.when(F.col("id") % 4 == 0, "bad date").otherwise(day)), "pushed", 0, 2_000_000_000).select("id", "pushed_at", "position")


@query("SELECT r.id, s.starred_at, row_number() OVER (ORDER BY s.starred_at DESC NULLS LAST, r.id DESC) AS place FROM repos r JOIN user_stars s ON r.id = s.repo_id WHERE s.login = 'u7' AND r.language = 'en'")
def browse_page(spark, d):
    return FL.placed(Engine.over(spark, d).candidates("u7", FL.Filters(language="en"))).select("id", "starred_at", "place")


@query("+u AS (SELECT repo_id AS id, max(starred_at) AS starred_at FROM user_stars GROUP BY 1) SELECT id, starred_at, row_number() OVER (ORDER BY starred_at DESC NULLS LAST, id) AS place, (row_number() OVER (ORDER BY starred_at DESC NULLS LAST, id) - 1) // 25 AS batch FROM u ORDER BY place LIMIT 150")
def newest_batches(spark, d):
    newest = tables.user_stars(spark, d).groupBy(F.col("repo_id").alias("id")).agg(F.max("starred_at").alias("starred_at"))
    return RK.batches(RK.newest(newest, 150), 25)


# ---- merges ----

OLD_NEW = """old AS (SELECT id, stars, readme AS body, 'old' AS seen FROM repos WHERE id % 3 <> 0), new AS (SELECT id, stars + 1 AS stars, CASE WHEN id % 5 = 0 THEN NULL ELSE description END AS body, 'new' AS seen FROM repos WHERE id % 2 = 0)"""


def _old_new(spark, d) -> tuple[DataFrame, DataFrame]:
    repos = tables.repos(spark, d)
    old = repos.where("id % 3 <> 0").select("id", "stars", F.col("readme").alias("body"), F.lit("old").alias("seen"))
    return old, repos.where("id % 2 = 0").select("id", (F.col("stars") + 1).alias("stars"), F.when(F.col("id") % 5 != 0, F.col("description")).alias("body"), F.lit("new").alias("seen"))


@query(f"+{OLD_NEW} SELECT id, COALESCE(n.stars, o.stars) AS stars, COALESCE(n.body, o.body) AS body, COALESCE(o.seen, n.seen) AS seen FROM old o FULL JOIN new n USING (id)")
def upsert_repos(spark, d):
    return MG.upsert(*_old_new(spark, d), ["id"], keep_old=["seen"], fill=["body"])


@query("SELECT user_id, max_by(event_type, event_id) AS event_type, max_by(value, event_id) AS value FROM events GROUP BY user_id")
def upsert_latest(spark, d):
    return MG.latest(tables.read(spark, d, "events").select("user_id", "event_id", "event_type", "value"), ["user_id"], "event_id").drop("event_id")


SIDES = "stored AS (SELECT repo_id, star_page FROM user_stars WHERE login = 'u7'), fresh AS (SELECT repo_id FROM user_stars WHERE login = 'u8' UNION SELECT repo_id FROM user_stars WHERE login = 'u7' AND repo_id % 2 = 0)"


def _sides(spark, d) -> tuple[DataFrame, DataFrame]:
    s = tables.user_stars(spark, d)
    return s.where("login = 'u7'").select("repo_id", "star_page"), s.where("login = 'u8' or (login = 'u7' and repo_id % 2 = 0)").select("repo_id").distinct()


@query(f"+{SIDES} SELECT repo_id, 'added' AS change FROM fresh WHERE repo_id NOT IN (SELECT repo_id FROM stored) UNION ALL SELECT repo_id, 'removed' FROM stored WHERE repo_id NOT IN (SELECT repo_id FROM fresh)")
def star_diff(spark, d):
    return MG.star_diff(*_sides(spark, d))


@query(f"+{SIDES} SELECT repo_id FROM fresh UNION SELECT repo_id FROM stored WHERE star_page IN (0, 2, 3) OR star_page IS NULL")
def listing_union(spark, d):
    stored, fresh = _sides(spark, d)
    return MG.listed(fresh, stored, [0, 2, 3])


@query("SELECT login, repo_id, starred_at, star_page FROM user_stars WHERE NOT (login = 'u7' AND repo_id % 2 = 1)")
def unstar(spark, d):
    s = tables.user_stars(spark, d)
    return MG.unstar(s, "u7", s.where("login = 'u7' and repo_id % 2 = 1").select("repo_id"))


@query("SELECT 'u2' AS login, slug, repo_id FROM group_repos WHERE repo_id % 2 = 0 UNION ALL SELECT DISTINCT 'u1', 'fresh', repo_id FROM group_repos WHERE repo_id % 7 = 0")
def replace_groups(spark, d):
    g = tables.group_repos(spark, d)
    stored = g.select(F.when(F.col("repo_id") % 2 == 0, "u2").otherwise("u1").alias("login"), "slug", "repo_id")
    return MG.replace_groups(stored, "u1", g.where("repo_id % 7 = 0").select(F.lit("fresh").alias("slug"), "repo_id"))


@query("SELECT id, CASE WHEN id % 2 = 0 AND id % 3 = 0 THEN CASE WHEN id % 4 = 0 THEN 'missing' ELSE 'present' END ELSE CASE WHEN id % 3 = 0 THEN 'pending' ELSE 'ok' END END AS readme_state FROM repos")
def publish_readmes(spark, d):
    r = tables.repos(spark, d).select("id", F.when(F.col("id") % 4 != 0, F.col("readme")).alias("readme"), F.when(F.col("id") % 3 == 0, "pending").otherwise("ok").alias("readme_state"), F.lit("run1").alias("readme_run"))
    return MG.publish_readmes(r, r.where("id % 2 = 0"), "run1").select("id", "readme_state")


@query("SELECT id, round(list_sum(CASE WHEN id % 2 = 0 THEN list_transform(vector, lambda x: x * 2) ELSE vector END), 6) AS total, len(vector)::INT AS size FROM vectors WHERE id % 5 <> 0 AND (id % 2 = 0 OR id % 3 = 0)")
def vector_overlay(spark, d):
    v = tables.vectors(spark, d).select("id", "vector")
    new = v.where("id % 2 = 0").withColumn("vector", F.transform("vector", lambda x: x * 2))
    out = MG.overlay(v.where("id % 3 = 0"), new, v.where("id % 5 <> 0"))
    return out.select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"), F.size("vector").alias("size"))


@query("SELECT id, round(list_sum(vector) * CASE WHEN id % 3 = 0 THEN 4 WHEN id % 2 = 0 THEN 3 ELSE 1 END, 6) AS total FROM vectors WHERE id % 5 <> 0")
def vector_fan_in(spark, d):
    v = tables.vectors(spark, d).select("id", "vector")
    times = lambda k, n: v.where(f"id % {k} = 0").withColumn("vector", F.transform("vector", lambda x: x * n))
    return MG.fan_in([times(2, 3), times(3, 4)], v, v.where("id % 5 <> 0")).select("id", F.round(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x), 6).alias("total"))


@query("SELECT (SELECT count(*) FROM (SELECT id FROM vectors EXCEPT SELECT id FROM vectors WHERE id % 9 <> 0)) = 0 AS up_to_date")
def vectors_up_to_date(spark, d):
    v = tables.vectors(spark, d)
    return MG.same_ids(v, v.where("id % 9 <> 0"))


# ---- planning ----

STATE = "CASE WHEN id % 7 = 0 THEN NULL WHEN id % 5 = 0 THEN 'error' WHEN id % 3 = 0 THEN 'missing' ELSE 'ok' END"
PLAN = f"""stars AS (SELECT repo_id AS id, max(starred_at) AS starred_at, '2024-01-' || lpad(((repo_id % 28) + 1)::VARCHAR, 2, '0') AS pushed_at FROM user_stars GROUP BY repo_id),
states AS (SELECT id, {STATE} AS status, '2024-01-15' AS checked_at FROM stars WHERE id % 7 <> 0)"""


def _plan(spark, d) -> tuple[DataFrame, DataFrame]:
    s = tables.user_stars(spark, d).groupBy(F.col("repo_id").alias("id")).agg(F.max("starred_at").alias("starred_at"))
    s = s.withColumn("pushed_at", F.concat(F.lit("2024-01-"), F.lpad(((F.col("id") % 28) + 1).cast("string"), 2, "0")))
    return s, s.where("id % 7 <> 0").select("id", F.when(F.col("id") % 5 == 0, "error").when(F.col("id") % 3 == 0, "missing").otherwise("ok").alias("status"), F.lit("2024-01-15").alias("checked_at"))


@query(f"+{PLAN}, recent AS (SELECT * FROM stars ORDER BY starred_at DESC NULLS LAST, id LIMIT 400), need AS (SELECT r.id, r.starred_at FROM recent r LEFT JOIN states s USING (id) WHERE s.status IS NULL OR s.status = 'error' OR r.pushed_at > s.checked_at) SELECT id, row_number() OVER (ORDER BY starred_at DESC NULLS LAST, id) AS place, (row_number() OVER (ORDER BY starred_at DESC NULLS LAST, id) - 1) // 25 AS batch FROM need")
def readme_plan(spark, d):
    return PL.readme_work(*_plan(spark, d), window=400)


_UNITS = "list_prepend(2166136261::BIGINT, flatten(list_transform(regexp_extract_all({x}, '(?s).'), lambda c: CASE WHEN ord(c) > 65535 THEN [55296 + ((ord(c) - 65536) >> 10), 56320 + ((ord(c) - 65536) & 1023)]::BIGINT[] ELSE [ord(c)]::BIGINT[] END)))"
FNV = f"list_reduce({_UNITS}, lambda h, c: (xor(h, c) * 16777619) & 4294967295)"


@query(f"SELECT id, lpad(lower(to_hex({FNV.format(x='t')})), 8, '0') AS hash FROM (SELECT id, readme || ' 😀' || id AS t FROM repos WHERE readme IS NOT NULL)")
def fnv_hash(spark, d):
    return tables.repos(spark, d).where("readme is not null").select("id", S.fnv1a(F.concat("readme", F.lit(" 😀"), F.col("id").cast("string"))).alias("hash"))


@query("SELECT user_id, sha256('2024-01-01' || chr(0) || user_id::VARCHAR) AS hash FROM (SELECT DISTINCT user_id FROM events)")
def ip_hash(spark, d):
    return tables.read(spark, d, "events").select("user_id").distinct().select("user_id", S.ip_hash(F.lit("2024-01-01"), F.col("user_id").cast("string")).alias("hash"))


@query(f"""+one AS (SELECT id, name, trim(regexp_replace(description, '\\s+', ' ', 'g')) AS about, array_to_string(topics, ', ') AS listed, language, trim(regexp_replace(substring(readme, 1, 1500), '\\s+', ' ', 'g')) AS body FROM repos),
doc AS (SELECT id, concat_ws(chr(10), concat_ws(' — ', name, nullif(about, '')), 'Topics: ' || listed, 'Language: ' || language, nullif(body, '')) AS t FROM one)
SELECT id, lpad(lower(to_hex({FNV.format(x='t')})), 8, '0') AS hash FROM doc WHERE id % 4 <> 1""")
def embed_plan(spark, d):
    """What has to be embedded anew, by the hash of the whole document that a model would see."""
    text = T.embedding_text(F.col("name"), F.col("description"), F.col("topics"), F.col("language"), F.col("readme"))
    docs = tables.repos(spark, d).select("id", text.alias("doc"))
    return PL.embed_work(docs, docs.where("id % 4 in (1, 2)").select("id", F.when(F.col("id") % 4 == 1, S.fnv1a(F.col("doc"))).otherwise("").alias("hash")))


@query("+s AS (SELECT user_id, count(*) % 2 = 1 AS running, (max(event_id) % 40000) AS t FROM events GROUP BY user_id), a AS (SELECT user_id, running, user_id % 5 = 0 AS force, greatest(t + 21600 - 40000, 0) AS full_left, greatest(t + 10000 + 900 - 40000, 0) AS list_left FROM s) SELECT user_id, CASE WHEN running THEN 'in-progress' WHEN NOT force AND full_left > 0 THEN 'cooldown-full' WHEN NOT force AND list_left > 0 THEN 'cooldown-relist' ELSE 'ok' END AS reason, CASE WHEN running THEN 0 WHEN NOT force AND full_left > 0 THEN full_left WHEN NOT force AND list_left > 0 THEN list_left ELSE 0 END::BIGINT AS wait_s FROM a")
def can_sync(spark, d):
    s = tables.read(spark, d, "events").groupBy("user_id").agg((F.count("*") % 2 == 1).alias("running"), (F.max("event_id") % 40000).alias("at"))
    a = PL.admission(F.lit(40000), F.col("running"), F.col("at"), F.col("at") + 10000, F.col("user_id") % 5 == 0)
    return s.select("user_id", a.alias("a")).select("user_id", "a.reason", "a.wait_s")


@query("+s AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'queued' ELSE 'listing' END AS phase, event_id % 5000 AS age FROM events) SELECT event_id, CASE WHEN phase = 'queued' THEN CASE WHEN age > 3600 THEN 'take-over' ELSE 'attach' END WHEN age > 1200 THEN 'take-over' WHEN age > 300 THEN 'probe' ELSE 'attach' END AS decision FROM s")
def takeover(spark, d):
    phase = F.when(F.col("event_id") % 3 == 0, "queued").otherwise("listing")
    return tables.read(spark, d, "events").select("event_id", PL.takeover(phase, F.col("event_id") % 5000).alias("decision"))


@query("SELECT event_id, least(900.0::DOUBLE, CASE WHEN event_id % 3 = 0 THEN event_id % 1000 + 5.0::DOUBLE ELSE greatest(60.0::DOUBLE, CASE WHEN event_id % 3 = 1 THEN event_id % 300 ELSE 60 * power(2.0, event_id % 6 - 1) END) END) AS wait FROM events")
def rate_wait(spark, d):
    e = F.col("event_id")
    return tables.read(spark, d, "events").select("event_id", S.wait_seconds(e % 6, F.when(e % 3 == 0, e % 1000), F.when(e % 3 == 1, e % 300)).alias("wait"))


@query("+r AS (SELECT event_id AS id, user_id AS key, ts::DATE AS day, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts, event_id) AS used FROM events) SELECT id, key, day, used, used <= 3 AS allowed FROM r")
def budget_daily(spark, d):
    e = tables.read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("key"), "ts")
    return PL.daily_budget(e, 3).drop("ts")


@query("SELECT event_type AS key, time_bucket(INTERVAL 60 SECOND, ts) AS window_start, count(*) AS requests, greatest(count(*) - 2, 0) AS denied FROM events GROUP BY 1, 2")
def burst_window(spark, d):
    return PL.burst_windows(tables.read(spark, d, "events").select(F.col("event_type").alias("key"), "ts"), 2)


@query("SELECT user_id, max_by(event_type, event_id) FILTER (event_type <> 'view') AS phase, max_by(value, event_id) FILTER (event_type <> 'click') AS done FROM events GROUP BY user_id")
def state_fold(spark, d):
    e = tables.read(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("phase"), F.when(F.col("event_type") != "click", F.col("value")).alias("done"))
    return PL.fold_state(e, "user_id", "event_id", ["phase", "done"])


@query("""+sized AS (SELECT owner AS login, id, least(COALESCE(length(readme), 0), 65536) AS n, row_number() OVER (PARTITION BY owner ORDER BY id) AS k FROM repos),
fold AS (SELECT login, id, k, CASE WHEN n <= 20971520 THEN n ELSE 0 END AS kept, CASE WHEN n <= 20971520 THEN n ELSE 0 END AS used FROM sized WHERE k = 1
    UNION ALL SELECT s.login, s.id, s.k, CASE WHEN f.used + s.n <= 20971520 THEN s.n ELSE 0 END, f.used + CASE WHEN f.used + s.n <= 20971520 THEN s.n ELSE 0 END FROM fold f JOIN sized s ON s.login = f.login AND s.k = f.k + 1)
SELECT login, id, kept::BIGINT AS indexed_chars FROM fold""")
def fts_budget(spark, d):
    return MG.budgeted_text(tables.repos(spark, d).select(F.col("owner").alias("login"), "id", "readme"))


# ---- metrics ----

GRADED = """graded AS (SELECT d.source AS query_id, d.doc_id AS id, l.quality + CASE WHEN l.quality = 1 AND l.toxic = 0 THEN 1 ELSE 0 END AS grade FROM documents d JOIN labels l USING (doc_id)),
run AS (SELECT owner AS query_id, id, row_number() OVER (PARTITION BY owner ORDER BY stars DESC, id) AS rank FROM repos), q AS (SELECT DISTINCT owner AS query_id FROM repos),
h AS (SELECT r.query_id, r.rank, COALESCE(g.grade, 0) AS grade FROM run r LEFT JOIN graded g USING (query_id, id) WHERE rank <= 10),
got AS (SELECT query_id, count(*) FILTER (rank <= 5 AND grade >= 1) AS h5, count(*) FILTER (rank <= 5 AND grade = 2) AS s5, count(*) FILTER (grade = 2) AS s10, min(rank) FILTER (grade >= 1) AS first, sum((power(2, grade) - 1) / log2(rank + 1.0::DOUBLE)) AS dcg, count(*) FILTER (rank <= 3 AND grade >= 1) > 0 AS hit3 FROM h GROUP BY 1),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC, id) AS place FROM graded),
ideal AS (SELECT query_id, sum((power(2, grade) - 1) / log2(place + 1.0::DOUBLE)) FILTER (place <= 10) AS idcg, count(*) FILTER (grade = 2) AS n2 FROM placed GROUP BY 1),
m AS (SELECT q.query_id, COALESCE(h5, 0) / 5.0::DOUBLE AS p5, COALESCE(s5, 0) / 5.0::DOUBLE AS p5_strict, CASE WHEN n2 > 0 THEN COALESCE(s10, 0)::DOUBLE / n2 END AS r10, 1.0::DOUBLE / first AS mrr, CASE WHEN idcg > 0 THEN COALESCE(dcg, 0) / idcg ELSE 0 END AS ndcg10, COALESCE(hit3, FALSE)::INT::DOUBLE AS success3 FROM q LEFT JOIN got USING (query_id) LEFT JOIN ideal USING (query_id))"""
_METRICS = ("p5", "p5_strict", "r10", "mrr", "ndcg10", "success3")


def _run_and_grades(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    repos = tables.repos(spark, d)
    docs, labels = tables.read(spark, d, "documents"), tables.read(spark, d, "labels")
    grades = docs.join(labels, "doc_id").select(F.col("source").alias("query_id"), F.col("doc_id").alias("id"), (F.col("quality") + F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1).otherwise(0)).alias("grade"))
    run = RK.rank_by_score(repos.select(F.col("owner").alias("query_id"), "id", F.col("stars").alias("score")), "query_id")
    return run, grades, repos.select(F.col("owner").alias("query_id")).distinct()


def _metrics(spark, d) -> DataFrame:
    return ME.query_metrics(*_run_and_grades(spark, d))


@query(f"+{GRADED} SELECT query_id, {', '.join(f'round({c}, 9) AS {c}' for c in _METRICS)} FROM m")
def eval_metrics(spark, d):
    return _rounded(_metrics(spark, d), *_METRICS, digits=9)


@query(f"+{GRADED} SELECT length(query_id)::INT AS class, {', '.join(f'round(avg({c}), 8) AS {c}' for c in _METRICS)} FROM m GROUP BY 1")
def eval_by_class(spark, d):
    return _rounded(ME.mean_metrics(_metrics(spark, d).withColumn("class", F.length("query_id")), "class"), *_METRICS, digits=8)


@query("SELECT l.doc_id AS id, l.quality AS grade FROM labels l WHERE l.doc_id % 3 = 0 OR l.doc_id NOT IN (SELECT id FROM repos)")
def orphan_gold(spark, d):
    labels = tables.read(spark, d, "labels").select(F.col("doc_id").alias("id"), F.col("quality").alias("grade"))
    return ME.orphans(labels, tables.repos(spark, d).where("id % 3 <> 0"))


@query("+l AS (SELECT length(readme) AS n FROM repos WHERE readme IS NOT NULL), s AS (SELECT n, row_number() OVER (ORDER BY n) - 1 AS i, count(*) OVER () AS total FROM l) SELECT count(*) AS n, avg(n) AS mean, max(n) AS longest, (max(n) FILTER (i = (total - 1) // 2) + max(n) FILTER (i = total // 2)) / 2.0::DOUBLE AS median, max(n) FILTER (i = floor(total * 0.9::DOUBLE)) AS p90 FROM s")
def text_statistics(spark, d):
    return ME.text_statistics(tables.repos(spark, d))


@query(f"""+run AS (SELECT owner AS query_id, id, row_number() OVER (PARTITION BY owner ORDER BY stars DESC, id) AS rank FROM repos), r AS (SELECT r.query_id, r.id, COALESCE(p.language, 'unknown') AS has, CASE WHEN length(r.query_id) = 4 THEN 'EN' END AS asked FROM run r JOIN repos p USING (id) WHERE rank <= 10)
SELECT query_id, count(*) AS hits, count(*) FILTER (asked IS NOT NULL AND lower(has) <> lower(asked)) AS violations, round(1 - count(*) FILTER (asked IS NOT NULL AND lower(has) <> lower(asked))::DOUBLE / count(*), 9) AS precision FROM r GROUP BY 1""")
def filter_precision(spark, d):
    repos = tables.repos(spark, d)
    run = RK.rank_by_score(repos.select(F.col("owner").alias("query_id"), "id", F.col("stars").alias("score")), "query_id").where("rank <= 10")
    asked = repos.select(F.col("owner").alias("query_id")).distinct().withColumn("language", F.when(F.length("query_id") == 4, "EN"))
    return _rounded(ME.filter_precision(run, repos, asked), "precision", digits=9)


# ---- facets and collections ----


@query("SELECT 'language' AS facet, language AS value, count(*) AS n FROM repos WHERE NOT archived GROUP BY 2 UNION ALL SELECT 'topic', t, count(*) FROM (SELECT unnest(topics) AS t FROM repos WHERE NOT archived) GROUP BY 2 UNION ALL SELECT 'archived', archived::VARCHAR, count(*) FROM repos GROUP BY 2")
def facet_counts(spark, d):
    repos = tables.repos(spark, d)
    live = repos.where("not archived")
    count = lambda df, facet, value: df.groupBy(value.alias("value")).agg(F.count("*").alias("n")).select(F.lit(facet).alias("facet"), "value", "n")
    topics = live.select(F.explode("topics").alias("t"))
    return count(live, "language", F.col("language")).unionByName(count(topics, "topic", F.col("t"))).unionByName(count(repos, "archived", F.col("archived").cast("string")))


@query("SELECT id, stars FROM repos WHERE (stars, -id) < (1500, -100) ORDER BY stars DESC, id LIMIT 25")
def keyset_page(spark, d):
    after = (F.col("stars") < 1500) | ((F.col("stars") == 1500) & (F.col("id") > 100))
    return tables.repos(spark, d).where(after).orderBy(F.desc("stars"), "id").limit(25).select("id", "stars")


from starloom import registry_design  # noqa: E402, F401  registers its queries under the same names
