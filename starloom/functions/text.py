"""Text functions as column expressions: normalising, tokens, names, slugs, snippets, markup."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from starloom.functions.markdown import plain_markdown

#: Fixed limits of queries and snippets, in characters.
QUERY_LIMIT, SNIPPET, SNIPPET_BEFORE, README_LIMIT = 512, 220, 60, 65_536
RUN = r"[\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode composition, which has no built-in function."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def clean_query(text: Column) -> Column:
    """Composed, control characters to spaces, white space collapsed, at most QUERY_LIMIT characters."""
    return F.substring(one_line(F.regexp_replace(nfc(text), r"\p{Cc}", " ")), 1, QUERY_LIMIT)


def cleaned(text: str | None) -> str:
    """clean_query of one text on the driver."""
    return " ".join(regex.sub(r"\p{Cc}", " ", unicodedata.normalize("NFC", text or "")).split())[:QUERY_LIMIT]


#: Where camel case and acronyms are cut, for columns and for texts on the driver.
ACRONYM, HUMP = r"(\p{Lu}+)(\p{Lu}\p{Ll})", r"([\p{Ll}\p{N}])(\p{Lu})"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits, with camel case and acronyms split; repeats stay."""
    apart = F.regexp_replace(F.regexp_replace(text, ACRONYM, "$1 $2"), HUMP, "$1 $2")
    return F.regexp_extract_all(F.lower(apart), F.lit(RUN), F.lit(0))


def token_list(text: str) -> list[str]:
    """tokens of one text on the driver."""
    for cut in (ACRONYM, HUMP):
        text = regex.sub(cut, r"\1 \2", text)
    return regex.findall(RUN, text.lower())


def index_words(text: str) -> list[str]:
    """index_tokens of one text on the driver."""
    return regex.findall(RUN, text.lower().translate(str.maketrans(MARKED, FOLDED)))


def index_tokens(text: Column) -> Column:
    """Tokens as the index holds them: lower-case runs, camel case left whole, diacritics of Latin letters folded."""
    return F.regexp_extract_all(fold(F.lower(text)), F.lit(RUN), F.lit(0))


#: Latin letters with marks and what they fold to (fixed values).
MARKED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿāăąćĉčďēĕėęěĝğġģĥĩīĭįĵķĺļľńņňōŏőŕŗřśŝşšţťũūŭůűųŵŷźżž"
FOLDED = "aaaaaaceeeeiiiinooooouuuuyyaaacccdeeeeegggghiiiijklllnnnooorrrssssttuuuuuuwyzzz"


def fold(text: Column) -> Column:
    return F.translate(text, MARKED, FOLDED)


def phrases(words: Column, size: int = 2) -> Column:
    """Distinct runs of size neighbouring tokens, in order."""
    last = F.size(words) - (size - 1)
    return F.when(last >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(words, i, size), " ")))).otherwise(F.array().cast("array<string>"))


def all_phrases(words: Column, most: int = 2) -> Column:
    """Distinct runs of 2 to most neighbouring tokens, shorter ones first."""
    return F.array_distinct(F.concat(*(phrases(words, k) for k in range(2, most + 1))))


def plain_name(name: Column, compose: bool = False) -> Column:
    """Letters and digits of a name, lower-case. Composing first tells no two names apart that look alike; names of the host are ASCII
    and need none."""
    return F.regexp_replace(F.lower(nfc(name) if compose else name), r"[^\p{L}\p{N}]+", "")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def login_key(login: Column) -> Column:
    """A login as given by hand or as a profile address."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.trim(login), r"^(?:https?://)?(?:www\.)?github\.com/", ""), r"^@|/+$", ""))


def valid_login(login: Column) -> Column:
    return login.rlike(r"^[A-Za-z0-9](?:[A-Za-z0-9]|-(?=[A-Za-z0-9])){0,38}$")


def shorthand(text: Column) -> Column:
    """owner and name of owner/name or an address of a repository, else null."""
    path = F.regexp_replace(F.regexp_replace(F.trim(text), r"^(?:https?://)?(?:www\.)?github\.com/", ""), r"(?:\.git)?/*$", "")
    ok = path.rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
    return F.when(ok, F.struct(F.split_part(path, F.lit("/"), F.lit(1)).alias("owner"), F.split_part(path, F.lit("/"), F.lit(2)).alias("name")))


def truncated(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.rtrim(F.substring(text, 1, n - 1)), F.lit("…"))).otherwise(text)


def first_match(text: Column, terms: list[str]) -> Column:
    """Where the earliest whole-word match of a term of two characters or more begins, from 1; 0 if none does."""
    found = [F.regexp_instr(F.lower(text), F.lit(rf"(?<![\p{{L}}\p{{N}}])\Q{t.lower()}\E(?![\p{{L}}\p{{N}}])")) for t in terms if len(t) >= 2]
    return F.coalesce(F.array_min(F.filter(F.array(*found), lambda x: x > 0)), F.lit(0)) if found else F.lit(0)


def window(text: Column, at: Column) -> Column:
    """At most SNIPPET characters of one line from up to SNIPPET_BEFORE before at, cut at spaces, ellipses where cut."""
    start = F.greatest(at - SNIPPET_BEFORE, F.lit(1))
    space = F.locate(" ", F.substring(text, start, F.lit(SNIPPET_BEFORE)))
    start = F.when((start > 1) & (space > 0), start + space).otherwise(start)
    piece = F.substring(text, start, F.lit(SNIPPET))
    more = start + SNIPPET <= F.length(text)
    last = F.length(piece) - F.locate(" ", F.reverse(piece))
    piece = F.when(more & (last > 0) & (last < F.length(piece)), F.substring(piece, F.lit(1), last)).otherwise(piece)
    return F.concat(F.when(start > 1, "…").otherwise(""), F.trim(piece), F.when(more, "…").otherwise(""))


def snippet(readme: Column, description: Column, terms: list[str]) -> Column:
    """Around the first match in the readme, else in the description, else the description's start, else ''."""
    body, about = one_line(readme), one_line(description)
    in_body, in_about = first_match(body, terms), first_match(about, terms)
    return F.when(in_body > 0, window(body, in_body)).when(in_about > 0, window(about, in_about)).otherwise(F.coalesce(truncated(about, SNIPPET), F.lit("")))


def has_run(haystack: Column, needle: Column) -> Column:
    """Whether the tokens of needle stand next to each other in haystack."""
    around = lambda x: F.concat(F.lit(" "), F.array_join(x, " "), F.lit(" "))
    return (F.size(needle) > 0) & F.contains(around(haystack), around(needle))


def strip_tags(html: Column) -> Column:
    """Text of markup by patterns, scripts and styles left out."""
    return one_line(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</(script|style)>", " "), r"<[^>]*>", " "))


def lab_embedding_text(full_name: Column, description: Column, topics: Column, language: Column, readme: Column, limit: int = 1500) -> Column:
    """The lab profile's document for a model: one line of facts, then the readme without its markup."""
    listed = F.when(F.size(topics) > 0, F.concat(F.lit("topics: "), F.array_join(topics, ", ")))
    facts = F.concat_ws(" — ", full_name, F.when(description != "", description), listed, F.concat(F.lit("lang: "), F.coalesce(language, F.lit("unknown"))))
    body = F.substring(plain_markdown(readme), 1, limit)
    return F.when(F.coalesce(body, F.lit("")) != "", F.concat(facts, F.lit("\n"), body)).otherwise(facts)


def table_name(login: Column) -> Column:
    """The identifier of what is kept for a login."""
    return F.concat(F.lit("fts_u_"), F.regexp_replace(F.translate(F.lower(login), "-", "_"), "[^a-z0-9_]", ""))


def camelized(name: Column) -> Column:
    """some_column_name as someColumnName."""
    parts = F.regexp_extract_all(name, F.lit("(?i)_[a-z0-9]|_|[^_]+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike("^_.$"), F.upper(F.substring(x, 2, 1))).otherwise(x)), "")


def embedding_text(name: Column, description: Column, topics: Column, language: Column, readme: Column, limit: int = 1500) -> Column:
    """What a model would embed of a repository; blank parts are left out."""
    part = lambda x: F.when(one_line(x) != "", one_line(x))
    head = F.concat_ws(" — ", part(name), part(description))
    listed = F.when(F.size(topics) > 0, F.concat(F.lit("Topics: "), F.array_join(topics, ", ")))
    return F.concat_ws("\n", head, listed, F.concat(F.lit("Language: "), part(language)), part(F.substring(readme, 1, limit)))
