"""Understanding a query on the driver, and the same rules as columns for sets of queries."""

from __future__ import annotations

from dataclasses import dataclass, field

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.functions.text import clean_query, cleaned, phrases, token_list, tokens
from starloom.operators.filters import Filters
from starloom.plans.lexicon import CONCEPTS

MODES, SORTS = ("auto", "keyword", "semantic", "hybrid"), ("relevance", "stars", "starred", "pushed")
MAX_EXPANSION, MAX_OFFSET, MAX_LIMIT, LIMIT = 8, 10_000, 50, 20
#: Signs of a name rather than words: digits and joining marks, camel case, owner/name (fixed values).
SIGNAL, CAMEL, REPO_NAME = r"[0-9_./@:#-]", r"\p{Ll}\p{Lu}", r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$"


normalize, tokenize = cleaned, token_list


def classify(text: str) -> str:
    text = normalize(text)
    if text and " " not in text and (regex.search(SIGNAL, text) or regex.search(CAMEL, text) or regex.match(REPO_NAME, text)):
        return "identifier"
    return "keyword" if len(tokenize(text)) <= 2 else "descriptive"


@dataclass(frozen=True)
class Expansion:
    concepts: list[str]
    terms: list[str]


def expand(words: list[str], concepts: dict = CONCEPTS, most: int | None = MAX_EXPANSION) -> Expansion:
    """Concepts whose trigger is a whole token or two neighbouring ones, in the lexicon's order, and their words."""
    said = {*words, *(" ".join(p) for p in zip(words, words[1:]))}
    hit = [k for k, (_, triggers, _) in concepts.items() if any(" ".join(tokenize(t)) in said for t in triggers)]
    terms = list(dict.fromkeys(t for k in hit for t in concepts[k][2]))
    return Expansion(hit, terms if most is None else terms[:most])


@dataclass(frozen=True)
class SearchRequest:
    login: str
    q: str = ""
    mode: str = "auto"
    sort: str = "relevance"
    filters: Filters = field(default_factory=Filters)
    offset: int = 0
    limit: int = LIMIT
    vector: tuple[float, ...] | None = None


def _number(x: str | None) -> int | None:
    try:
        v = float(x)
        return int(v) if v == v and abs(v) != float("inf") else None
    except (TypeError, ValueError):
        return None


def parse_request(login: str, params: dict[str, str]) -> SearchRequest:
    """A request of text parameters: what cannot be read counts as absent, pages are clamped."""
    get = lambda k: (params.get(k) or "").strip() or None
    many = lambda k: tuple(x.strip() for x in (get(k) or "").split(",") if x.strip())
    flag = {"true": True, "1": True, "false": False, "0": False}.get((get("archived") or "").lower())
    f = Filters(get("lang"), _number(get("minStars")), _number(get("maxStars")), flag, get("license"), get("starredAfter"), get("starredBefore"), many("topic"), many("group"))
    mode, sort = get("mode"), get("sort")
    limit = _number(get("limit"))
    return SearchRequest(login.strip().lstrip("@").lower(), normalize(params.get("q") or ""), mode if mode in MODES else "auto", sort if sort in SORTS else "relevance", f, min(max(_number(get("offset")) or 0, 0), MAX_OFFSET), min(max(LIMIT if limit is None else limit, 1), MAX_LIMIT))


def archived_choice(choice: str | None) -> bool | None:
    """hide, include or only, as an archived filter; hide by default."""
    return {"include": None, "only": True}.get(choice or "hide", False)


# ---- sets of queries ----


def classified(queries: DataFrame, column: str = "query") -> DataFrame:
    """queries with kind and n_tokens."""
    queries, q = queries.withColumn("__cleaned", clean_query(F.col(column))), F.col("__cleaned")
    words = tokens(q)
    name = (q != "") & ~F.contains(q, F.lit(" ")) & (q.rlike(SIGNAL) | q.rlike(CAMEL) | q.rlike(REPO_NAME))
    return queries.withColumn("kind", F.when(name, "identifier").when(F.size(words) <= 2, "keyword").otherwise("descriptive")).withColumn("n_tokens", F.size(words)).drop("__cleaned")


def concept_table(spark, concepts: dict = CONCEPTS) -> DataFrame:
    """concept, place, trigger (as its tokens): the lexicon, a few dozen rows."""
    rows = [(k, i, " ".join(tokenize(t))) for i, (k, (_, triggers, _)) in enumerate(concepts.items()) for t in triggers]
    return spark.createDataFrame(rows, "concept string, place int, trigger string")


def expanded(queries: DataFrame, id_col: str = "query_id", column: str = "query", concepts: dict = CONCEPTS) -> DataFrame:
    """query id and the concepts it names, in the lexicon's order. The lexicon is broadcast: its size is fixed."""
    words = tokens(F.col("cleaned"))
    said = queries.withColumn("cleaned", clean_query(F.col(column))).select(id_col, F.explode(F.array_distinct(F.concat(words, phrases(words)))).alias("trigger"))
    hit = said.join(F.broadcast(concept_table(queries.sparkSession, concepts)), "trigger").select(id_col, "place", "concept").distinct()
    return hit.groupBy(id_col).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "concept"))), lambda x: x["concept"]).alias("concepts"))
