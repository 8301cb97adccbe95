"""Retrieval legs over a persisted index: each gives (id, score) over all documents, then ranks what a candidate set leaves."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scoring import bm25, cosine, dot, norm
from starloom.operators.index import SearchIndex
from starloom.sources.staging import staged

MIN_AND_HITS = 3
#: Scores are rounded to so many digits before they are ranked, so that ties do not hang on the order of a sum.
DIGITS = 9
#: A unit of the last digit; numbers in the vectors of a block of queries or stored ones, and pairs that are scored at once.
UNIT, BLOCK_NUMBERS, PAIRS = 1e-9, 1_000_000, 4_000_000


def scored(matches: DataFrame, stats: DataFrame, df: DataFrame | None = None) -> DataFrame:
    """id, n_terms, score: BM25 with document frequencies over the whole index, as stored (df) or counted."""
    df = matches.groupBy("term").agg(F.count("*").alias("df")) if df is None else df  # a row for each query term
    full = matches.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row
    worth = bm25(F.col("tf"), F.col("len"), F.col("mean_len"), F.col("df"), F.col("n"))
    return full.groupBy("id").agg(F.count("*").alias("n_terms"), F.round(F.sum(worth), DIGITS).alias("score"))


def top(scores: DataFrame, k: int) -> DataFrame:
    """The k best by score, then id, with their rank from 1."""
    best = scores.orderBy(F.desc("score"), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "id")).cast("long"))


def among(scores: DataFrame, candidates: DataFrame | None) -> DataFrame:
    return scores if candidates is None else scores.join(candidates.select("id"), "id", "left_semi")


def enough_or_all(hits: DataFrame, n: int, least: int) -> DataFrame:
    """The hits with all n terms where there are least of them, else all hits: one plan, the count decides inside it."""
    full = F.col("n_terms") == n
    enough = hits.where(full).limit(least).agg((F.count("*") >= least).alias("enough"))
    return hits.crossJoin(F.broadcast(enough)).where(~F.col("enough") | full).drop("enough")  # one row


def keyword_leg(index: SearchIndex, terms: list[str], k: int, candidates: DataFrame | None = None) -> DataFrame:
    """All terms where enough documents have them, else any."""
    hits = among(scored(index.matches(terms), index.stats(), index.dfs(terms)), candidates)
    return top((enough_or_all(staged(hits, "hits"), len(terms), MIN_AND_HITS) if len(terms) > 1 else hits).select("id", "score"), k)


def text_legs(index: SearchIndex, words: list[str], more: list[str], k: int, candidates: DataFrame | None = None) -> dict[str, DataFrame]:
    """The keyword leg and, with more terms, the expanded leg, from one read of the rows of both and one aggregate."""
    asked_for = list(dict.fromkeys([*words, *more]))
    full = index.matches(asked_for).join(F.broadcast(index.dfs(asked_for)), "term").crossJoin(F.broadcast(index.stats()))  # one row
    worth = bm25(F.col("tf"), F.col("len"), F.col("mean_len"), F.col("df"), F.col("n"))
    asked, added = F.col("term").isin(words), F.col("term").isin(more) if more else F.lit(False)
    total = lambda of: F.round(F.sum(F.when(of, worth)), DIGITS)
    per = full.groupBy("id").agg(F.count(F.when(asked, 1)).alias("n_terms"), total(asked).alias("asked"), total(added).alias("added"))
    per = staged(among(per, candidates), "hits")  # read for both legs and for the count that decides
    hits = per.where("n_terms > 0")
    hits = enough_or_all(hits, len(words), MIN_AND_HITS) if len(words) > 1 else hits
    legs = {"keyword": top(hits.select("id", F.col("asked").alias("score")), k)}
    if more:
        legs["expanded"] = top(per.where("added is not null").select("id", F.col("added").alias("score")), k)
    return legs


def any_leg(index: SearchIndex, terms: list[str], k: int, candidates: DataFrame | None = None) -> DataFrame:
    return top(among(scored(index.matches(terms), index.stats(), index.dfs(terms)), candidates).select("id", "score"), k)


def all_leg(index: SearchIndex, terms: list[str], k: int, candidates: DataFrame | None = None) -> DataFrame:
    return top(among(scored(index.matches(terms), index.stats(), index.dfs(terms)).where(F.col("n_terms") == len(terms)), candidates).select("id", "score"), k)


def trigram_leg(index: SearchIndex, repos: DataFrame, text: str) -> DataFrame:
    """Documents whose name, description or topics hold the text: those with all its trigrams, then exactly."""
    text = text.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    if not grams:
        return repos.select("id").limit(0)
    held = index.grams(grams).groupBy("id").count().where(F.col("count") == len(grams)).select("id")
    whole = F.lower(F.concat_ws("\n", "full_name", "description", F.array_join("topics", " ")))
    return repos.join(held, "id", "left_semi").where(F.contains(whole, F.lit(text))).select("id")


def similar_names(index: SearchIndex, text: str, k: int, least: float = 0.4, candidates: DataFrame | None = None) -> DataFrame:
    """id, score, rank: documents by how many of the text's trigrams their name, description and topics have, as a share of them; those
    under least are no hits. A typing error breaks three trigrams, so long words bear some."""
    text = text.lower()
    grams = sorted({text[i : i + 3] for i in range(len(text) - 2)})
    if not grams:
        return top(index.lengths().select("id", F.lit(0.0).alias("score")).limit(0), 1)
    held = index.grams(grams).groupBy("id").agg(F.count("*").alias("n")).where(F.col("n") >= F.lit(least * len(grams)))
    return top(among(held.select("id", F.round(F.col("n") / len(grams), DIGITS).alias("score")), candidates), k)


def vector_leg(vectors: DataFrame, query: list[float], k: int, candidates: DataFrame | None = None, normalised: bool = False) -> DataFrame:
    """The k nearest vectors; the query is a literal, so the scan needs no join and top-k no shuffle. A column norm of the
    vectors is used where there is one."""
    if k <= 0:
        return top(vectors.select("id", F.lit(0.0).alias("score")).limit(0), 1)
    q = F.array(*(F.lit(float(x)) for x in query))
    own = F.col("norm") if "norm" in vectors.columns else None
    score = dot(F.col("vector"), q) if normalised else cosine(F.col("vector"), q, own, F.lit(sum(float(x) ** 2 for x in query) ** 0.5))
    return top(among(vectors.select("id", F.round(score, DIGITS).alias("score")), candidates), k)


def batch_knn(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """query_id, id, score, rank: the k nearest stored vectors of each of queries(query_id, vector), exactly.

    Both sides are dealt to blocks of a bounded number of numbers, and every block of queries meets every block of vectors in a group of
    its own: all pairs are compared, by products of matrices, and about k rows for each query come out of a group.
    """
    width = F.coalesce(F.max(F.size("vector")), F.lit(0))
    q_size, v_size = (df.agg(F.greatest(width, F.lit(1)) * F.count("*")).first()[0] for df in (queries, vectors))
    across, down = max(1, -(-q_size // BLOCK_NUMBERS)), max(1, -(-v_size // BLOCK_NUMBERS))
    dealt = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    numbers = F.col("vector").cast("array<double>").alias("v")
    q = queries.select("query_id", numbers, norm(F.col("vector")).alias("norm"), dealt("query_id", across).alias("a"), every(down).alias("b"))
    v = vectors.select("id", numbers, norm(F.col("vector")).alias("norm"), every(across).alias("a"), dealt("id", down).alias("b"))
    q, v = (df.repartition(across * down, "a", "b").groupBy("a", "b") for df in (q, v))  # groups are small but much work, so none are joined
    schema = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((queries, "query_id"), (vectors, "id")))
    near = q.cogroup(v).applyInArrow(_nearest(k), f"{schema}, score double").withColumn("score", F.round("score", DIGITS))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return near.withColumn("rank", rank.cast("long")).where(F.col("rank") <= k)


def _by_width(table: pa.Table):
    """Rows of each length of a column v: the length, where they are, their numbers by place, and norms with which of them are null."""
    lists, norms = (table[c].combine_chunks() for c in ("v", "norm"))
    widths = pc.fill_null(pc.list_value_length(lists), -1).to_numpy(zero_copy_only=False)
    for w in np.unique(widths[widths >= 0]):
        rows = np.flatnonzero(widths == w)
        m = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).reshape(len(rows), w)
        yield int(w), (rows, np.ascontiguousarray(m.T), norms.to_numpy(zero_copy_only=False)[rows], norms.is_null().to_numpy(zero_copy_only=False)[rows])


def _plain(n: np.ndarray) -> np.ndarray:
    """Whether norms are of a size that products of matrices are close with."""
    return (n > 1e-100) & (n < 1e100)


def _nearest(k: int):
    """For each query of a group at least its k best vectors: those whose score, as cosine() sums it, is the kth best or less than
    a unit of the last digit below; of equal scores those with the smallest ids."""

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        vectors = vectors.take(pc.sort_indices(vectors["id"]))
        stored, found = dict(_by_width(vectors)), []
        for w, (q_rows, q, q_norm, q_null) in _by_width(queries):
            if w not in stored:
                continue
            v_rows, v, v_norm, v_null = stored[w]
            copies = _copies(v) >= k  # as good as k others with smaller ids
            keep = ~(copies & _plain(v_norm))
            v_rows, v, v_norm, v_null = v_rows[keep], np.ascontiguousarray(v[:, keep]), v_norm[keep], v_null[keep]
            step = max(1, PAIRS // max(1, len(v_rows)))
            for i in range(0, len(q_rows), step):
                at = slice(i, i + step)
                a, b, score, null = _best((q[:, at], q_norm[at], q_null[at]), (v, v_norm, v_null), k)
                found.append((queries["query_id"].take(pa.array(q_rows[at][a])), vectors["id"].take(pa.array(v_rows[b])), pa.chunked_array([pa.array(score, mask=null, from_pandas=False)])))
        empty = (queries["query_id"].slice(0, 0), vectors["id"].slice(0, 0), pa.chunked_array([pa.array([], pa.float64())]))
        return pa.concat_tables([pa.table(dict(zip(("query_id", "id", "score"), x))) for x in [empty, *found]])

    return run


def _copies(v: np.ndarray) -> np.ndarray:
    """How many equal vectors come before each, of numbers by place."""
    if not v.size:
        return np.zeros(v.shape[1], np.int64)
    kind = np.unique(np.ascontiguousarray(v.T).view(np.dtype((np.void, 8 * len(v)))).ravel(), return_inverse=True)[1].ravel()
    order = np.argsort(kind, kind="stable")
    return _places(kind[order])[np.argsort(order)]


def _places(*sorted_keys: np.ndarray) -> np.ndarray:
    """The place of each row in its run of equal keys, from 0."""
    n = len(sorted_keys[0])
    new = np.ones(n, bool)
    if n:
        new[1:] = np.any([x[1:] != x[:-1] for x in sorted_keys], axis=0)
    start = np.flatnonzero(new)
    return np.arange(n) - np.repeat(start, np.diff(np.append(start, n)))


def _best(queries: tuple, vectors: tuple, k: int) -> tuple[np.ndarray, ...]:
    """Places of queries and vectors, scores, and which scores are null, of what may be among the k best."""
    (q, q_norm, q_null), (v, v_norm, v_null) = queries, vectors

    def exact(a: np.ndarray, b: np.ndarray):
        total = np.zeros(len(a))
        for x, y in zip(q, v):
            total += x[a] * y[b]
        both = q_norm[a] * v_norm[b]
        null = q_null[a] | v_null[b]
        score = np.divide(total, both, out=np.zeros(len(a)), where=both != 0)
        return score, null, np.where(null, -np.inf, np.where(np.isnan(score), np.inf, score))  # as Spark orders them

    with np.errstate(all="ignore"):
        plain_q, plain_v = _plain(q_norm), _plain(v_norm)
        near = np.where(plain_q, q / q_norm, 0).T @ np.where(plain_v, v / v_norm, 0)
        for at in (np.ix_(plain_q, ~plain_v), np.ix_(~plain_q, np.ones(len(v_norm), bool))):
            a, b = (x.ravel() for x in np.broadcast_arrays(*at))
            if len(a):
                near[a, b] = exact(a, b)[2]
        n = near.shape[1]
        least = np.partition(near, n - k, axis=1)[:, n - k] if n > k else np.full(len(near), -np.inf)
        a, b = np.nonzero(near >= least[:, None] - 2 * UNIT)
        score, null, key = exact(a, b)
        order = np.lexsort((b, -key, a))
        order = order[_places(a[order], key[order]) < k]
        place = _places(a[order])
        last = np.full(len(near), -np.inf)  # the kth best of each query
        last[a[order][place == k - 1]] = key[order][place == k - 1]
        order = order[key[order] >= last[a[order]] - 1.5 * UNIT]
    return a[order], b[order], score[order], null[order]
