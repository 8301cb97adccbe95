"""Groups that rules define: a rule is checked when it is written, and all rules are matched in one pass over the repositories."""

from __future__ import annotations

import json
import re
from numbers import Real

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.text import token_list, tokens

#: Fields of a rule, with the operators that each takes (fixed values).
FIELDS = {
    "language": ("eq", "ne", "in"), "license": ("eq", "ne", "in"), "topics": ("has", "in"), "stars": ("eq", "ne", "gte", "lte", "in"),
    "starred_at": ("gte", "lte"), "archived": ("eq", "ne"),
}
KEYS, VERSION = {"version", "q", "match", "filters"}, 1
_DAY = re.compile(r"\d{4}-\d\d-\d\d(T.*)?")


def _checked(field: str, op: str, value) -> list:
    """The values of a filter; ValueError says what is wrong with it."""
    if field not in FIELDS:
        raise ValueError(f"unknown field {field!r}")
    if op not in FIELDS[field]:
        raise ValueError(f"{field} does not take {op!r}")
    values = value if op == "in" else [value]
    if not isinstance(values, list) or not values:
        raise ValueError(f"{field} {op} needs {'a list of values' if op == 'in' else 'a value'}")
    kind = {"stars": Real, "archived": bool}.get(field, str)
    if any(not isinstance(v, kind) or (kind is Real and isinstance(v, bool)) for v in values):
        raise ValueError(f"{field} {op} has a value of a wrong kind")
    if field == "starred_at" and not all(_DAY.fullmatch(v) for v in values):
        raise ValueError("starred_at needs a day such as 2024-01-31")
    return values


def _condition(field: str, op: str, values: list) -> Column:
    if field == "topics":
        lowered = F.transform("topics", F.lower)
        return F.coalesce(F.arrays_overlap(lowered, F.array(*(F.lit(v.lower()) for v in values))), F.lit(False))
    column = F.coalesce(F.lower(field), F.lit("")) if field in ("language", "license") else F.col(field)
    values = [v.lower() for v in values] if field in ("language", "license") else values
    made = {"eq": column == values[0], "ne": column != values[0], "gte": column >= values[0], "lte": column <= values[0], "in": column.isin(values)}[op]
    return F.coalesce(made, F.lit(False))


def compiled(rule: dict | str) -> Column:
    """The condition of a rule over columns of repositories; ValueError for one that breaks the format. Nulls match nothing but ne of
    a text. Filters are all needed; values of one filter are alternatives. q needs all its words in name or description."""
    try:
        rule = json.loads(rule) if isinstance(rule, str) else rule
    except ValueError:
        raise ValueError("not JSON") from None
    if not isinstance(rule, dict) or rule.get("version") != VERSION:
        raise ValueError(f"version is not {VERSION}")
    if extra := set(rule) - KEYS:
        raise ValueError(f"unknown key {sorted(extra)[0]!r}")
    if rule.get("match", "all") != "all":
        raise ValueError("match is not 'all'")
    filters, q = rule.get("filters", []), rule.get("q", "")
    if not isinstance(filters, list) or not isinstance(q, str):
        raise ValueError("filters is not a list, or q no text")
    if not filters and not q.strip():
        raise ValueError("a rule needs a filter or q")
    out = F.lit(True)
    for f in filters:
        if not isinstance(f, dict) or set(f) != {"field", "op", "value"}:
            raise ValueError("a filter has field, op and value")
        out = out & _condition(f["field"], f["op"], _checked(f["field"], f["op"], f["value"]))
    words = tokens(F.concat_ws(" ", "full_name", "description"))
    for w in token_list(q):
        out = out & F.array_contains(words, w)
    return out


def rule_members(repos: DataFrame, rules: dict[str, dict | str]) -> DataFrame:
    """slug, repo_id, error: the repositories of each rule, and a row without one for a rule that is wrong. One pass over the repositories
    for all rules; no shuffle."""
    spark: SparkSession = repos.sparkSession
    good, bad = {}, []
    for slug, rule in rules.items():
        try:
            good[slug] = compiled(rule)
        except ValueError as e:
            bad.append((slug, None, str(e)))
    wrong = spark.createDataFrame(bad, "slug string, repo_id long, error string")
    if not good:
        return wrong
    hit = F.array_compact(F.array(*(F.when(c, F.lit(s)) for s, c in good.items())))
    return repos.select(F.explode(hit).alias("slug"), F.col("id").cast("long").alias("repo_id"), F.lit(None).cast("string").alias("error")).unionByName(wrong)
