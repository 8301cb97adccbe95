"""Weighted reciprocal-rank fusion with name, star, topic and duplicate evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.functions.scoring import RRF_K, lab_star_prior, recency_boost, rrf, specificity, star_prior
from starloom.functions.text import has_run, plain_name, tokens

#: Fixed values of the score.
LEG_WEIGHTS = {"keyword": 1.0, "expanded": 0.6, "semantic": 1.0}
NAME_TIERS, NAME_CAP = {"exact": 1.45, "prefix": 1.2, "token": 1.1}, 1.6
TOPIC_BONUS, DESCRIPTION_BONUS, MOST_MATCHES = 0.003, 0.0015, 3
ARCHIVED, SAME_OWNER, SAME_NAME = 0.4, 0.85, 0.70
#: Fused scores are rounded to so many digits, so that equal ones are ties whatever the order of their factors.
DIGITS = 12
LAB_TIERS = {"exact": 1.6, "name": 1.45, "prefix": 1.2, "all": 1.1}


def union_legs(legs: dict[str, DataFrame]) -> DataFrame:
    """(leg, id, rank) of all legs; cheaper than joining them outer."""
    parts = [df.select(F.lit(name).alias("leg"), "id", "rank") for name, df in legs.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def fuse_ranks(ranked: DataFrame, weights: dict[str, float] = LEG_WEIGHTS) -> DataFrame:
    """id, rrf and each leg's best rank. Ranks below one and not finite are ignored."""
    valid = ranked.where((F.col("rank") >= 1) & (F.col("rank") < float("inf")))
    best = [F.min(F.when(F.col("leg") == k, F.col("rank"))).alias(f"rank_{k}") for k in weights]
    merged = valid.groupBy("id").agg(*best)
    score = sum((F.coalesce(rrf(F.col(f"rank_{k}"), w), F.lit(0.0)) for k, w in weights.items()), F.lit(0.0))
    return merged.select("id", score.alias("rrf"), *(f"rank_{k}" for k in weights))


def normalised(fused: DataFrame, configured: dict[str, float]) -> DataFrame:
    """fused with base: its score as a share of what the first rank in every configured leg would give, so a leg that found nothing still counts."""
    return fused.withColumn("base", F.col("rrf") / (sum(configured.values()) / (RRF_K + 1)))


def name_df(repos: DataFrame) -> DataFrame:
    """token, df: in how many repositories' names each token is."""
    return repos.select("id", F.explode(F.array_distinct(tokens(F.col("name")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))


def evidence(terms: list[str], expansion: list[str] = ()) -> list[str]:
    """Query and concept terms of two characters or more; the first spelling of each counts."""
    seen: dict[str, str] = {}
    for t in [*terms, *expansion]:
        if len(t) >= 2:
            seen.setdefault(t.lower(), t)
    return list(seen.values())


def with_specificity(repos: DataFrame, terms: list[str], of: DataFrame) -> DataFrame:
    """repos with spec: a map from each evidence term to what it is worth by names in of."""
    parts = sorted({p for t in terms for p in t.lower().split()})
    counted = F.map_from_entries(F.filter(F.collect_list(F.when(F.col("token").isin(parts), F.struct("token", "df"))), lambda x: x.isNotNull()))
    table = name_df(of).where(F.col("token").isin(parts)).agg(counted.alias("dfs"))  # as many entries as the query has words
    worst = lambda t: F.greatest(*(F.coalesce(F.element_at("dfs", p), F.lit(0)) for p in t.lower().split()), F.lit(0))
    spec = F.map_from_arrays(F.array(*map(F.lit, terms)), F.array(*(specificity(worst(t)) for t in terms)))
    return repos.crossJoin(F.broadcast(table.select(spec.alias("spec"))))


def name_boost(terms: list[str], name: Column, spec: Column) -> Column:
    """The best of the terms' boosts: whole name over beginning over token, each by the term's specificity."""
    flat, words = plain_name(name), tokens(name)
    best = F.lit(1.0)
    for t in terms:
        key = "".join(c for c in t.lower() if c.isalnum())
        if len(key) < 2:
            continue
        tier = F.when(flat == key, NAME_TIERS["exact"])
        if len(key) >= 3:
            tier = tier.when(flat.startswith(key), NAME_TIERS["prefix"])
        tier = tier.when(has_run(words, F.array(*map(F.lit, t.lower().split()))), NAME_TIERS["token"]).otherwise(1.0)
        best = F.greatest(best, 1 + (tier - 1) * F.element_at(spec, t))
    return F.least(best, F.lit(NAME_CAP))


def _holds(run: Column):
    return lambda text: has_run(tokens(text), run)


def overlap_bonus(terms: list[str], topics: Column, description: Column) -> Column:
    """Added for topics and for description words that hold a term, three matches each at most."""
    runs = [F.array(*map(F.lit, t.lower().split())) for t in terms]
    about = tokens(F.coalesce(description, F.lit("")))
    hit = lambda x: F.when(x, 1).otherwise(0)
    in_topics = sum((hit(F.exists(topics, _holds(r))) for r in runs), F.lit(0))
    in_about = sum((hit(has_run(about, r)) for r in runs), F.lit(0))
    return TOPIC_BONUS * F.least(in_topics, F.lit(MOST_MATCHES)) + DESCRIPTION_BONUS * F.least(in_about, F.lit(MOST_MATCHES))


def duplicate_penalties(hits: DataFrame) -> DataFrame:
    """score times 0.85 for each better hit of the same owner and 0.70 for each of the same plain name."""
    order = [F.desc("score"), F.desc("stars"), F.col("id")]
    before = lambda key: F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1
    factor = F.pow(F.lit(SAME_OWNER), before(F.lower("owner"))) * F.pow(F.lit(SAME_NAME), before(plain_name(F.col("name"))))
    return hits.withColumn("factor", factor).withColumn("score", F.round(F.col("score") * F.col("factor"), DIGITS)).drop("factor")


def fuse(legs: dict[str, DataFrame] | DataFrame, repos: DataFrame, terms: list[str], weights: dict[str, float] = LEG_WEIGHTS, penalties: bool = True, names_of: DataFrame | None = None, boosts: bool = True, few: bool = False) -> DataFrame:
    """id, score, rrf, boost, matched_by and leg ranks of what the legs found among repos, unordered.

    repos are the candidates; a leg's hit outside them is dropped. Name statistics are over the
    repositories in any leg, or over names_of. legs may be united already (leg, id, rank). Where they hold the few best of
    each leg (few), what they name is broadcast and the candidates are not moved. Without boosts the score is the fused rank alone.
    """
    fused = fuse_ranks(union_legs(legs) if isinstance(legs, dict) else legs, weights)
    found = repos.join(F.broadcast(fused) if few else fused, "id")
    if not boosts:
        by = F.array_compact(F.array(*(F.when(F.col(f"rank_{k}").isNotNull(), F.lit(k)) for k in weights)))
        return found.withColumn("boost", F.lit(1.0)).withColumn("score", F.round("rrf", DIGITS)).withColumn("matched_by", by)
    found = with_specificity(found, terms, found if names_of is None else names_of) if terms else found.withColumn("spec", F.lit(None).cast("map<string,double>"))
    boost = name_boost(terms, F.col("name"), F.col("spec")) if terms else F.lit(1.0)
    bonus = overlap_bonus(terms, F.col("topics"), F.col("description")) if terms else F.lit(0.0)
    hits = found.withColumn("boost", boost).withColumn("score", F.round(F.col("rrf") * F.col("boost") * star_prior(F.col("stars")) * F.when(F.col("archived"), ARCHIVED).otherwise(1.0) + bonus, DIGITS))
    hits = duplicate_penalties(hits) if penalties else hits
    by = F.array_compact(F.array(*(F.when(F.col(f"rank_{k}").isNotNull(), F.lit(k)) for k in weights), F.when(F.col("boost") > 1, F.lit("name"))))
    return hits.withColumn("matched_by", by).drop("spec")


def lab_boost(query_tokens: list[str], name: Column, stars: Column, archived: Column, pushed: Column | None = None, now: Column | None = None) -> Column:
    """The lab profile's product of name tier, star prior, archive penalty and recency."""
    whole = "".join(query_tokens)
    flat, words = plain_name(name), tokens(name)
    each = [F.array_contains(words, t) for t in query_tokens]
    all_of, any_of = F.lit(bool(each)), F.lit(False)
    for x in each:
        all_of, any_of = all_of & x, any_of | (flat == F.lit("")) | x
    tier = F.when(flat == whole, LAB_TIERS["exact"]).when(F.lit(len(query_tokens) == 1) & all_of, LAB_TIERS["name"]).when(flat.startswith(whole), LAB_TIERS["prefix"]).when(all_of, LAB_TIERS["all"]).otherwise(1.0)
    out = tier * lab_star_prior(stars) * F.when(archived, ARCHIVED).otherwise(1.0)
    return out if pushed is None else out * recency_boost(pushed, now)


def lab_fuse(keyword: DataFrame, semantic: DataFrame) -> DataFrame:
    """Two legs of equal weight."""
    return fuse_ranks(union_legs({"keyword": keyword, "semantic": semantic}), {"keyword": 1.0, "semantic": 1.0})


__all__ = ["RRF_K", "fuse", "fuse_ranks", "union_legs"]
