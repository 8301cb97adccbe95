"""Mixing sources to target weights by Pareto order sampling. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starloom.llm.common import BROADCAST_KEYS, WORD, free_names, staged

#: Steps in which the ranking variable of a source is summed before the cut is looked for.
BINS = 16_384
#: The greatest propensity.
MAX_GRADE = 1000


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_of(id_: Column, seed: int) -> Column:
    """A number in (0, 1) that an id and a seed fix, from 52 bits of md5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, cycle: tuple[int, ...], max_copies: int) -> DataFrame:
    """sizes(source, source_size) with target: the total shared by weight, where no target passes
    max_copies times its source's size and what is over is shared again.

    The final targets are min(cap, level * weight) for one level, which a scan over the sources in the
    order of cap / weight finds. One row for each source, so one task holds them.
    """
    turn = Window.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, cycle)), F.pmod(F.row_number().over(turn) - 1, F.lit(len(cycle))).cast("int") + 1))
    capped = weighted.withColumn("cap", max_copies * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    upto, everything = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(upto), F.lit(0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(upto), F.lit(0)))
    scanned = capped.withColumn("level", level)
    fits = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return scanned.select("source", "source_size", F.least(F.col("cap").cast("double"), F.coalesce(fits * F.col("weight"), F.col("cap"))).alias("target"))


def grade_levels(grades: DataFrame, targets: DataFrame, max_copies: int) -> DataFrame:
    """(source, level): a document of grade g is expected min(max_copies, level * g) times, which makes the expected words
    of each source its target. grades(source, g, words) has a row for each source and grade over 0, at most
    MAX_GRADE of a source, so the windows are small. Null where even max_copies of all are under the target."""
    down = Window.partitionBy("source").orderBy(F.desc("g"))
    upto = down.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("source")
    gw = F.col("g") * F.col("words")
    facts = targets.select(F.col("source").alias("fact_source"), "target")
    rows = grades.join(facts, F.expr("source <=> fact_source"))
    rest = F.sum(gw).over(whole) - F.coalesce(F.sum(gw).over(upto), F.lit(0))
    level = (F.col("target") - max_copies * F.coalesce(F.sum("words").over(upto), F.lit(0))) / rest
    fits = rows.withColumn("level", level).where(F.col("level") * F.col("g") <= max_copies)
    return fits.groupBy("source").agg(F.max_by("level", "g").alias("level"))


def pareto_mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", cycle: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, propensity_col: str | None = None, seed: int = 17, extra: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of docs: id, source, size, source_size, target, copies, taken, and the extra columns.

    Documents are drawn with unequal chances. A document's grade is its propensity, a number up to MAX_GRADE that is
    rounded to a whole one (null and under a half: 0, never drawn); without propensity_col it is the length of its size
    in bits, so longer documents are likelier. Its expected copies are its grade times a level of its source, max_copies
    at most, where the level makes the expected words of the source its target. The whole part is taken for
    certain. The fraction left, p, is the chance of one more copy: with u fixed by the id, documents
    of a source are ranked by (u / (1 - u)) / (p / (1 - p)) and taken from the lowest until the
    words taken come nearest to the target. Sample size is thus fixed in words.

    Sources go by code point, null last, and weigh as cycle says. Null and blank texts have size 0 and take 0.
    Equal ranks fall by id, size and a hash of the text, so reruns agree; rows that are equal in all are alike. No rows: none out.
    A source's cut is found from sums over BINS steps of the rank; only the step that holds the cut is
    ranked row by row, so a source with most of the rows still spreads over all tasks.
    """
    size = n_words(F.col(text_col))
    grade = F.length(F.bin(size)) if propensity_col is None else F.round(F.least(F.greatest(F.coalesce(F.col(propensity_col).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(float(MAX_GRADE))))
    base = staged(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), F.xxhash64(text_col).alias("tie"), grade.cast("long").alias("g"), *extra), "sizes")
    grades = staged(base.groupBy("source", "g").agg(F.sum("size").alias("words")), "grades")
    targets = staged(source_targets(grades.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, max_copies), "targets")
    levels = grade_levels(grades.where("g > 0 and words > 0"), targets, max_copies).withColumnRenamed("source", "level_source")
    sources = staged(targets.join(levels, F.expr("source <=> level_source"), "left").drop("level_source"), "sources")
    few = sources.count() <= BROADCAST_KEYS

    def of_source(df: DataFrame, facts: DataFrame, how: str = "inner") -> DataFrame:
        facts = facts.withColumnRenamed("source", "fact_source")
        return df.join(F.broadcast(facts) if few else facts, F.expr("source <=> fact_source"), how).drop("fact_source")

    expected = F.when(F.col("g") > 0, F.least(F.lit(float(max_copies)), F.coalesce(F.col("level") * F.col("g"), F.lit(float(max_copies))))).otherwise(0.0)
    ranked = of_source(base, sources).withColumn("expected", expected).withColumn("certain", F.floor("expected")).withColumn("p", F.col("expected") - F.col("certain"))
    u = random_of(F.col("id"), seed)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = staged(ranked.withColumn("rank", F.when((F.col("p") > 0) & (F.col("size") > 0), odds / (1 + odds))).withColumn("step", F.floor(F.col("rank") * BINS)).select("id", "source", "size", "tie", "source_size", "target", "certain", "rank", "step", *extra), "ranked")

    left = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("certain") * F.col("size"))).alias("wanted"))
    steps = ranked.where("step is not null").groupBy("source", "step").agg(F.sum("size").alias("words"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = of_source(steps.withColumn("before", before), left).where("before <= wanted").groupBy("source").agg(F.max(F.struct("step", "before", "wanted")).alias("c")).select("source", F.col("c.step").alias("cut_step"), (F.col("c.wanted") - F.col("c.before")).alias("wanted"))
    cut = staged(cut, "cuts")

    placed = of_source(ranked, cut, "left")
    sure = placed.where("step is null or cut_step is null or step <> cut_step").withColumn("more", F.when(F.col("step") < F.col("cut_step"), 1).otherwise(0))
    within = Window.partitionBy("source").orderBy("rank", "id", "size", "tie").rowsBetween(Window.unboundedPreceding, 0)
    close = placed.where("step = cut_step").withColumn("more", F.when(F.sum("size").over(within) - F.col("size") / 2 <= F.col("wanted"), 1).otherwise(0))
    copies = F.col("certain") + F.col("more")
    return sure.unionByName(close).select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", F.round("target", 6).alias("target"), copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"), *extra)


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix, each as often as it is taken; columns as docs has them.

    Rows are told apart by a 64-bit hash of id, source and text, so rows with a null id take part, and rows that share an
    id each come as often as they are taken (as they share a random number too, they rank alike). Of rows that are
    equal in all three, one comes as often as all of them are taken.
    """
    nulls = [F.col(c).isNull() for c in (id_col, source_col, text_col)]
    key, row, copies, rows, turn = free_names(docs, "mix_key", "mix_row", "mix_copies", "mix_rows", "mix_turn")
    keyed = docs.withColumn(key, F.xxhash64(*nulls, id_col, source_col, text_col))
    taken = pareto_mix(keyed, id_col=id_col, source_col=source_col, text_col=text_col, extra=(key,), **options)
    taken = staged(taken.groupBy(F.col(key).alias(row)).agg(F.sum("copies").alias(copies), F.count("*").alias(rows)).where(F.col(copies) > 0), "taken")
    times = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))
    drawn = lambda some: some.select(*docs.columns, times.alias(turn)).drop(turn)
    alike = taken.where(F.col(rows) > 1)
    out = drawn(keyed.join(taken.where(F.col(rows) == 1).hint("merge"), F.col(key) == F.col(row)))  # alike at every size
    if alike.isEmpty():
        return out
    return out.unionByName(drawn(keyed.join(alike, F.col(key) == F.col(row)).dropDuplicates([key])))


def mix_sql(documents: str = "documents", seed: int = 17) -> str:
    """The mix of all documents as DuckDB SQL, for weights 1, 2, 3 and three copies at most."""
    return f"""
WITH base AS (SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    length(bin(COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT)) AS g,
    (('0x' || substr(md5('{seed}:' || COALESCE(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u FROM {documents}),
sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM base GROUP BY source),
weighted AS (SELECT *, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sums),
scan AS (SELECT *, 3 * source_size AS cap, 3 * source_size / weight AS ratio FROM weighted),
levels AS (SELECT *, (sum(source_size) OVER () - COALESCE(sum(cap) OVER w, 0)) / (sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0)) AS level
    FROM scan WINDOW w AS (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
chosen AS (SELECT level AS fit FROM levels WHERE level <= ratio ORDER BY ratio, level LIMIT 1),
targets AS (SELECT source, source_size, least(cap::DOUBLE, fit * weight) AS target FROM levels, chosen),
grades AS (SELECT source, g, sum(size)::BIGINT AS words FROM base GROUP BY source, g HAVING sum(size) > 0),
scanned AS (SELECT grades.source, g, target, sum(g * words) OVER (PARTITION BY grades.source) - COALESCE(sum(g * words) OVER up, 0) AS rest, COALESCE(sum(words) OVER up, 0) AS sure
    FROM grades JOIN targets ON grades.source IS NOT DISTINCT FROM targets.source WINDOW up AS (PARTITION BY grades.source ORDER BY g DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lifted AS (SELECT source, g, (target - 3 * sure) / rest AS lift FROM scanned),
fitted AS (SELECT source, max_by(lift, g) AS lift FROM lifted WHERE lift * g <= 3 GROUP BY source),
ranked AS (SELECT b.doc_id, b.source, b.size, b.u, t.source_size, t.target, floor(least(3.0::DOUBLE, COALESCE(lift * g, 3))) AS certain, least(3.0::DOUBLE, COALESCE(lift * g, 3)) AS expected
    FROM base b JOIN targets t ON b.source IS NOT DISTINCT FROM t.source LEFT JOIN fitted f ON b.source IS NOT DISTINCT FROM f.source),
odds AS (SELECT *, expected - certain AS p FROM ranked),
running AS (SELECT *, CASE WHEN p > 0 AND size > 0 THEN (u / (1 - u)) / (p / (1 - p)) END AS rank FROM odds),
cut AS (SELECT *, sum(size) OVER (PARTITION BY source, rank IS NULL ORDER BY rank, doc_id ROWS UNBOUNDED PRECEDING) AS upto,
    target - sum(certain * size) OVER (PARTITION BY source) AS wanted FROM running)
SELECT doc_id, size, source_size, round(target, 6) AS target,
    (size * (certain + CASE WHEN rank IS NOT NULL AND upto - size / 2 <= wanted THEN 1 ELSE 0 END))::BIGINT AS taken FROM cut"""
