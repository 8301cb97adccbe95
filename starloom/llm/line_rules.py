"""Quality rules from the frequency of lines across documents. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import BROADCAST_KEYS, WORD, free_names, staged

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
#: A line is common if more rows of its host than this hold it, and more than this share of them in percent.
MIN_DOCS, HOST_PCT = 5, 1.0


def words_of(text: Column) -> Column:
    """The words of a text; null and blank texts have none."""
    cut = F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", -1)
    return F.filter(cut, lambda w: w != "")


def _repeat_words(frame: DataFrame) -> DataFrame:
    """frame(words, n_words, ...) with n_repeat_words: words inside windows that the text holds twice or more."""
    starts = F.when(F.col("n_words") >= WINDOW, F.sequence(F.lit(1), F.col("n_words").cast("int") - (WINDOW - 1)))
    frame = frame.withColumn("windows", F.transform(starts, lambda i: F.xxhash64(F.slice("words", i, WINDOW))))
    frame = frame.withColumn("repeats", F.coalesce(F.size("windows") > F.size(F.array_distinct("windows")), F.lit(False)) & F.col("windows").isNotNull())
    # only texts with a repeat sort their windows: equal neighbours are repeats, and gaps between their places tell the words covered
    sorted_ = F.when(F.col("repeats"), F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    frame = frame.withColumn("by_hash", sorted_)
    size = F.size("by_hash")
    same = lambda x, k: ((k > 0) & (F.get("by_hash", k - 1)["h"] == x["h"])) | ((k < size - 1) & (F.get("by_hash", k + 1)["h"] == x["h"]))
    frame = frame.withColumn("again", F.array_sort(F.transform(F.filter("by_hash", same), lambda x: x["i"])))
    covered = F.aggregate(F.transform("again", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get("again", k + 1) - p, F.lit(WINDOW)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return frame.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("windows", "repeats", "by_hash", "again", "words")


def _norm(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[\x20\x09-\x0D]+", " "))


def _lines(text: Column) -> Column:
    """The lines of a text that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.ltrim(F.translate(x, SPACES, " ")) != "")


def common_lines(lines: DataFrame, min_docs: int, host_pct: float) -> DataFrame:
    """common_host, common_h of lines(host, lines) in more than min_docs rows of their host and in more than host_pct
    percent of its rows. Both counts cover all rows and are summed before they are shuffled."""
    hosts = staged(lines.groupBy("host").agg(F.count("*").alias("rows")), "hosts").withColumnRenamed("host", "of")
    hosts = F.broadcast(hosts) if hosts.count() <= BROADCAST_KEYS else hosts
    counted = lines.select("host", F.explode(F.array_distinct("lines.h")).alias("h")).groupBy("host", "h").count().where(F.col("count") > min_docs)
    over = counted.join(hosts, F.expr("host <=> of")).where(100 * F.col("count") > host_pct * F.col("rows"))
    return staged(over.select(F.col("host").alias("common_host"), F.col("h").alias("common_h")), "common")


def line_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, host_pct: float = HOST_PCT, max_removed: float = 0.5, min_words: int = 20, max_repeat_pct: int = 30) -> DataFrame:
    """One row for each row of docs: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, removed_lines, removed_words, kept.

    A line is normalised (lower case, white space runs to one space, trimmed) and hashed. Lines in more than
    min_docs rows and more than host_pct percent of the rows of one host (null is a host of its own) are removed; a
    document is depleted when more than max_removed of its words go. kept is false for the base rules' failures and
    for depleted documents.

    Null, empty and blank texts have no words and fail the base rules. Every row counts as a document,
    repeats included; rows with null ids too. Ties with a limit stay (counts have to be over it). Other columns are
    not read. Counting sends one number pair a distinct line and document, summed before the shuffle, so a line that
    a host repeats everywhere is one row a task; only pairs over the limits are joined back.
    """
    text = F.col(text_col)
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text.alias("text"), words_of(text).alias("words"), _lines(text).alias("lines"))
    dense = F.coalesce(F.length(F.translate("text", SPACES, "")), F.lit(0)).cast("long")
    symbols = F.coalesce(F.length("text") - F.length(F.translate("text", SYMBOLS, "")), F.lit(0)).cast("long")
    base = base.select("id", "host", F.size("words").cast("long").alias("n_words"), dense.alias("word_chars"), symbols.alias("n_symbols"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.transform("lines", lambda x: F.struct(F.xxhash64(_norm(x)).alias("h"), F.regexp_count(x, F.lit(WORD)).alias("w"))).alias("lines"), "words")
    base = staged(_repeat_words(base).withColumn("row", F.monotonically_increasing_id()), "lines")

    common = common_lines(base, min_docs, host_pct)
    lines = base.select("row", "host", F.explode("lines").alias("line")).select("row", "host", "line.h", "line.w")
    removed = lines.join(common, F.expr("h = common_h and host <=> common_host"), "left_semi").groupBy("row").agg(F.count("*").alias("removed_lines"), F.sum("w").alias("removed_words"))
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    out = base.drop("lines").join(removed, "row", "left").withColumn("removed_words", F.coalesce("removed_words", F.lit(0)).cast("long")).withColumn("base_failed", failed)
    depleted = F.col("removed_words") > max_removed * F.col("n_words")
    return out.select(F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.coalesce("removed_lines", F.lit(0)).cast("long").alias("removed_lines"), "removed_words", (~F.col("base_failed") & ~depleted).alias("kept"))


def without_common_lines(docs: DataFrame, text_col: str = "text", host_col: str = "source", min_docs: int = MIN_DOCS, host_pct: float = HOST_PCT, max_removed: float = 0.5) -> DataFrame:
    """docs with the common lines of each host taken out of the texts, without the documents that this depletes.

    Texts without a common line (null, empty and blank ones too) come back as they are, columns unchanged. What is taken
    out depends on host and text only, so rows are told apart by a hash of both and ids play no part.
    """
    line_key, gone_key, gone_lines, left_text = free_names(docs, "line_key", "gone_key", "gone_lines", "left_text")
    key = F.xxhash64(F.col(host_col).isNull(), F.col(text_col).isNull(), F.col(host_col), F.col(text_col))
    hashed = F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(_norm(x)).alias("h")))
    lines = staged(docs.select(key.alias("key"), F.col(host_col).alias("host"), hashed.alias("lines")), "lines")
    common = common_lines(lines, min_docs, host_pct)
    each = lines.dropDuplicates(["key"]).select("key", "host", F.explode(F.array_distinct("lines.h")).alias("h"))
    gone = each.join(common, F.expr("h = common_h and host <=> common_host"), "left_semi").groupBy(F.col("key").alias(gone_key)).agg(F.collect_list("h").alias(gone_lines))
    left = F.array_join(F.filter(F.split(text_col, "\n", -1), lambda x: ~F.array_contains(gone_lines, F.xxhash64(_norm(x)))), "\n")
    words = lambda x: F.regexp_count(x, F.lit(WORD))
    out = docs.withColumn(line_key, key).join(staged(gone, "gone"), F.col(line_key) == F.col(gone_key), "left").withColumn(left_text, F.when(F.col(gone_lines).isNull(), F.col(text_col)).otherwise(left))
    kept = out.where(F.col(gone_lines).isNull() | (words(F.col(text_col)) - words(F.col(left_text)) <= max_removed * words(F.col(text_col))))
    return kept.withColumn(text_col, F.col(left_text)).select(*docs.columns)


def line_rules_sql(documents: str = "documents") -> str:
    """line_rules with its defaults over all documents, as DuckDB SQL."""
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, COALESCE(text, '') AS text FROM {documents}),
w AS (SELECT r, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM d),
lines AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line FROM d),
full_lines AS (SELECT r, source, line, trim(regexp_replace(lower(line), '[\\x20\\x09-\\x0D]+', ' ', 'g')) AS norm,
    len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words FROM lines WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY r),
hosts AS (SELECT source, count(*) AS n FROM d GROUP BY source),
held AS (SELECT source, norm, count(DISTINCT r) AS n FROM full_lines GROUP BY source, norm HAVING count(DISTINCT r) > {MIN_DOCS}),
common AS (SELECT held.source, norm FROM held JOIN hosts ON held.source IS NOT DISTINCT FROM hosts.source WHERE 100 * held.n > {HOST_PCT} * hosts.n),
gone AS (SELECT f.r, count(*) AS n, sum(f.words) AS words FROM full_lines f JOIN common c ON f.norm = c.norm AND f.source IS NOT DISTINCT FROM c.source GROUP BY f.r),
win AS (SELECT r, i, array_to_string(list_slice(ws, i, i + 7), ' ') AS x FROM (SELECT r, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
again AS (SELECT r, unnest(list(i)) AS i FROM win GROUP BY r, x HAVING count(*) > 1),
covered AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest(range(i, i + 8)) AS j FROM again) GROUP BY r),
facts AS (SELECT d.doc_id, len(w.ws)::BIGINT AS n_words, length(regexp_replace(d.text, '[\\x20\\x09-\\x0D]', '', 'g'))::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, COALESCE(dup.n, 0)::BIGINT AS n_dup_lines,
    COALESCE(covered.n, 0)::BIGINT AS n_repeat_words, COALESCE(gone.n, 0)::BIGINT AS removed_lines, COALESCE(gone.words, 0)::BIGINT AS removed_words
    FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN covered USING (r) LEFT JOIN gone USING (r))
SELECT *, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed,
    NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND NOT removed_words > 0.5 * n_words AS kept FROM facts"""
