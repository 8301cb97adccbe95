"""Secret scans: candidate strings found by pattern, false positives removed by a random forest.
DataFrame and SQL functions only, with the forest of pyspark.ml.
"""

from __future__ import annotations

import random
import string

import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from starloom.llm.common import free_names, staged

#: Names that values are assigned to when they are secret (fixed values).
NAMES = r"(?i:secret|token|passw(?:or)?d|pwd|passphrase|api[_\-]?key|access[_\-]?key|private[_\-]?key|client[_\-]?key|credential|auth(?!or))"
#: Candidates, the first that matches at a place: what is assigned to such a name, the body of a private key, the password of an address,
#: a well-known key format, or 16 or more of the characters that keys are written in with a digit among them.
CANDIDATE = "|".join(
    [
        rf"(?<=[:=][ \t]{{0,2}}[\"'`]?)(?<={NAMES}[A-Za-z0-9_\-]{{0,12}}[\"']?[ \t]{{0,2}}[:=][ \t]{{0,2}}[\"'`]?)(?!(?i:bearer|basic|token)[ \t])[^\s\"'`,;<>(){{}}\[\]]{{4,}}",
        r"(?<=-----)(?<=-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----)[A-Za-z0-9+/=\s]{16,}(?=-----END)",
        r"(?<=:)(?<=://[^\s:/@]{1,64}:)[^\s:/@\"']{3,}(?=@)",
        r"(?<![A-Za-z0-9])(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|npm_|hf_)[A-Za-z0-9_\-]{12,}",
        r"(?<![A-Za-z0-9+/_\-])(?=[A-Za-z+/_\-]*[0-9])[A-Za-z0-9+/_\-]{16,}(?:\.[A-Za-z0-9+/_\-]{8,}){0,2}={0,2}",
    ]
)
#: Prefixes of well-known key formats (fixed values).
KEY_PREFIX = r"^(?:AKIA|ASIA|AIza|ghp_|gho_|ghs_|github_pat_|glpat-|xox[abprs]-|sk_live_|sk_test_|rk_live_|sk-|eyJ|SG\.|npm_|hf_|ya29)"
#: Words before a value that say it is, or is not, a secret (fixed values).
SECRET_WORD = r"(?i)(?:secret|token|passw|pwd|passphrase|api.?key|apikey|access.?key|private.?key|auth|credential|bearer|client.?key|signing|encryption.?key)"
PLAIN_WORD = r"(?i)(?:commit|sha\d*|md5|hash|checksum|digest|etag|uuid|guid|\bid\b|version|revision|isbn|order|invoice|phone|tel|card|serial|build|ref|issue|index|page|mail)"
#: Words whose letters a readable name is made of (fixed values).
DICTIONARY = "the and for with that this from have not are was you your mail example com org net www http https html page file path name user test data index image photo video doc docs src lib bin main home version release build number order item date time year month day january february march april june july august september october november december monday friday report table column value config server client node module package model type class function return public private static string under over into about after before again".split()
#: What stands where a secret would (fixed values).
STAND_IN = r"(?i)^(?:[\$%<{*].*|x{3,}|\*{3,}|\.{3,}|your.*|my.*|enter.*|insert.*|none|null|nil|true|false|yes|no|required|optional|string|text|example|sample|changeme|placeholder|password|passwd|secret|token|user|env\..*|os\..*|process\..*|get.*|read.*|self\..*|config\..*)$"
#: Size of the findings that labelled_findings() makes, and bound of those read from a table of reviewed ones.
LABELLED, MAX_LABELLED = 12_000, 50_000
TREES, DEPTH = 24, 8

FEATURES = ["length", "digits", "upper", "lower", "signs", "is_hex", "changes", "letter_pairs", "longest_letters", "distinct", "dictionary", "slashes", "dashes", "dots", "numeric", "known_prefix", "path_before", "host_before", "secret_before", "plain_before", "assigned", "quoted", "uuid", "unit_after", "in_address", "key_block", "stand_in", "kinds", "lower_word"]


def _features(c: Column, before: Column, after: Column) -> list[Column]:
    """Numbers for a candidate and the 80 characters on either side of it."""
    n = F.length(c).cast("double")
    count = lambda p: F.regexp_count(c, F.lit(p)).cast("double")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    words = F.regexp_replace(c, "(?i)" + "|".join(sorted((w for w in DICTIONARY if len(w) > 2), key=len, reverse=True)), "")
    name = F.regexp_extract(before, r"([A-Za-z0-9_\-.]+)[\"'\s:=>]*$", 1)
    changes = r"[a-z](?=[^a-z])|[A-Z](?=[^A-Z])|[0-9](?=[^0-9])|[^A-Za-z0-9](?=[A-Za-z0-9])"
    pairs = r"(?i)(?=th|he|in|er|an|re|on|at|en|nd|ti|es|or|te|of|ed|is|it|al|ar|st|to|nt|ng|se|ha|as|ou|io|le|ve|co|me|de|hi|ri|ro|ic|ne|ea|ra|ce)."
    return [
        n, count("[0-9]") / n, count("[A-Z]") / n, count("[a-z]") / n, count("[^A-Za-z0-9]") / n, flag(c.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")),
        count(changes) / n, count(pairs) / n, F.array_max(F.transform(F.split(c, "[^A-Za-z]+"), F.length)).cast("double") / n, F.size(F.array_distinct(F.split(c, ""))) / n,
        1 - F.length(words) / n, count("/"), count("-"), count(r"\."), flag(c.rlike(r"^[0-9\-]+$")), flag(c.rlike(KEY_PREFIX)),
        flag(before.rlike(r"[/\\]$")), flag(before.rlike(r"(?:@|://|www\.)[^\s]*$")), flag(name.rlike(SECRET_WORD)), flag(name.rlike(PLAIN_WORD)), flag(before.rlike(r"[:=]\s*[\"']?$")),
        flag(before.rlike("[\"'`]$") & after.rlike("^[\"'`]")), flag(c.rlike(r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$")), flag(after.rlike(r"^\s*(?:px|kb|mb|gb|bytes|usd|eur|%)")),
        flag(before.rlike(r"://[^\s:/@]*:$") & after.startswith("@")), flag(before.rlike(r"PRIVATE KEY-----$")), flag(c.rlike(STAND_IN)),
        sum((flag(c.rlike(p)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")), F.lit(0.0)), flag(c.rlike("^[A-Za-z]?[a-z.]+$")),
    ]


def with_features(findings: DataFrame) -> DataFrame:
    """findings(candidate, before, after) with one column for each of FEATURES, named f_<name>."""
    made = _features(F.col("candidate"), F.coalesce("before", F.lit("")), F.coalesce("after", F.lit("")))
    return findings.select("*", *(x.alias(f"f_{k}") for k, x in zip(FEATURES, made)))


def _finding(rng: random.Random) -> tuple[str, str, str, int]:
    """One labelled finding: candidate, what is before and after it, label."""
    pick, word = rng.choice, lambda: rng.choice(DICTIONARY)
    chars = lambda of, lo, hi: "".join(rng.choices(of, k=rng.randint(lo, hi)))
    letters = string.ascii_letters
    hexes, mixed, plain = (lambda lo, hi, of=of: chars(of, lo, hi) for of in ("0123456789abcdef", letters + string.digits + "+/", letters + string.digits))
    digits = lambda n: chars(string.digits, n, n)
    made = lambda: "".join(pick(x) for x in (["ka", "ro", "mi", "ze", "tu", "pla", "sher", "von"], ["n", "l", "dd", "st", "p", "m"], ["er", "a", "ing", "o", "us", "ix"]))
    sign = lambda: pick("!@#$&%*?_-")
    password = lambda: pick([made().title() + digits(2) + sign(), made() + digits(rng.randint(1, 4)), made().title() + sign() + made() + digits(3), made() + sign() + digits(2) + made().title(), plain(8, 20), (word() + word()).translate(str.maketrans("aeio", "@310")) + digits(2)])
    phrase = lambda: "-".join([word(), pick([word(), made()]), word(), made()])
    prefixed = lambda: pick([pick(["AKIA", "ASIA"]) + chars(string.ascii_uppercase + string.digits, 16, 16), pick(["ghp_", "gho_", "npm_", "hf_"]) + plain(34, 38), pick(["sk_live_", "xoxb-", "glpat-", "AIza", "sk-", "rk_live_"]) + plain(20, 36)])
    jwt = lambda: f"eyJ{plain(16, 40)}.{plain(20, 60)}.{plain(30, 43)}"
    block = lambda: "\n" + "\n".join(mixed(60, 64) for _ in range(rng.randint(2, 12))) + "==\n"
    uuid = lambda: "-".join(hexes(n, n) for n in (8, 4, 4, 4, 12))
    key = pick(["", "", "db_", "my-", "DB_", "app_"]) + pick(["token", "secret", "api_key", "apikey", "password", "access_key", "auth_token", "client_secret", "private_key", "AWS_SECRET_ACCESS_KEY", "passwd", "PASSWORD", "pwd", "credential", "secretKey", "API_KEY"])
    quote = pick(['"', "", "'", "", '"'])
    name_quote = pick(["", "", quote])
    free = f"{word()} {pick([word(), made()])} "
    assign = f"{pick([free, '', '{'])}{name_quote}{key}{name_quote}{pick([' = ', '=', ': ', ':', ' : '])}{quote}"
    thing = free + pick(["commit ", "sha256: ", "md5=", "checksum ", "uuid: ", "hash = ", "etag: ", "revision ", "id=", "digest ", "build ", "ref ", "version=", "order ", ""])
    address = f"{free}{pick(['postgres', 'https', 'mysql', 'amqp', 'ftp', 'redis'])}://{pick([made(), 'admin', 'root', 'user', 'app'])}:"
    said = free + pick(["the password: ", "a secret: ", "one token = ", "auth: "])
    stand_in = lambda: pick(["required", "none", "None", "null", "true", "optional", "string", "changeme", "your_password_here", "xxxxxxxx", "********", "${PASSWORD}", "$TOKEN", "%(secret)s", "os.environ", "process.env.TOKEN", "config.secret", "getpass", "placeholder", "example", "password"])
    label, before, value = pick(
        [
            (1, assign, lambda: hexes(16, 64)), (1, assign, lambda: mixed(20, 60)), (1, assign, lambda: plain(12, 44)), (1, assign, password), (1, assign, password), (1, assign, password), (1, assign, phrase), (1, assign, prefixed), (1, free, prefixed),
            (1, free + "Authorization: Bearer ", jwt), (1, free, jwt), (1, address, password), (1, address, lambda: plain(8, 30)), (1, f"{free}-----BEGIN {pick(['RSA ', 'EC ', '', 'OPENSSH '])}PRIVATE KEY-----", block),
            (0, thing, lambda: hexes(16, 64)), (0, thing, lambda: hexes(40, 40)), (0, thing, lambda: pick([hexes(32, 32), hexes(64, 64)])), (0, thing, uuid), (0, thing, lambda: mixed(20, 44)), (0, free + pick(["card ", "phone ", "order ", "tel: +", ""]), lambda: digits(16)),
            (0, f"{free}{made()}@", lambda: f"{made()}-{word()}{word()}{digits(1)}"), (0, f"{free}https://www.{word()}.com/", lambda: f"{word()}/{digits(4)}/{word()}-{word()}"), (0, free + "/", lambda: f"{word()}/{word()}/{made()}{digits(3)}"), (0, free, lambda: word() + word() + word() + digits(2)),
            (0, free, lambda: f"20{digits(2)}-01-02T03-04-{digits(2)}-{digits(6)}"), (0, assign, stand_in), (0, assign, stand_in), (0, assign, word), (0, assign, made), (0, said, lambda: pick([word(), made()])), (0, address, lambda: pick(["password", "pass", "PASSWORD", "xxx", "secret", "pwd"])),
        ]
    )
    after = "@host" if before == address else "-----END" if before.endswith("-----") else (quote if before == assign else "") + pick([" ", "\n", ", "]) + word()
    return value(), before[-80:], after, label


def labelled_findings(spark: SparkSession, n: int = LABELLED, seed: int = 0) -> DataFrame:
    """n labelled findings (candidate, before, after, label) from a seed, a fixed small table: a stand-in where no reviewed findings
    are at hand. A value in one of the ways that keys, tokens and passwords are written (label 1), or that checksums, ids,
    numbers, names, paths, times and stand-ins for secrets are (label 0), is put in a context that it is met in. Formats are
    public ones; no text of any corpus went into it."""
    rng = random.Random(seed)
    names = ["candidate", "before", "after", "label"]
    rows = [dict(zip(names, _finding(rng))) for _ in range(n)]
    made = pa.Table.from_pylist(rows, pa.schema([*((k, pa.string()) for k in names[:3]), ("label", pa.int32())]))
    return spark.createDataFrame(made)  # from rows of Python it would start workers on the executors


def reviewed(labelled: DataFrame, most: int = MAX_LABELLED) -> DataFrame:
    """candidate, before, after, label of a table of reviewed findings: at most about most of them, chosen by hash."""
    rows = labelled.select("candidate", "before", "after", "label").where("candidate is not null and label is not null")
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64("candidate", "before", "after"), F.lit(1_000_000)) < int(1_000_000 * most / n))


def train_forest(labelled: DataFrame, trees: int = TREES, depth: int = DEPTH, seed: int = 3) -> RandomForestClassificationModel:
    """A forest over labelled(candidate, before, after, label)."""
    assembled = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features", handleInvalid="keep").transform(with_features(labelled))
    rows = assembled.select("features", F.col("label").cast("double").alias("label"))
    return RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt", subsamplingRate=0.8).fit(rows)


def candidates(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """A row for each candidate of each text: the keep columns, start (characters before it), candidate, before, after."""
    text = F.col(text_col)
    found = docs.where(text.rlike(CANDIDATE)).select(*keep, F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)).alias("hits"), F.split(text, CANDIDATE, -1).alias("gaps")).withColumn("row", F.monotonically_increasing_id())
    each = found.select(*keep, "row", F.posexplode(F.arrays_zip("hits", "gaps", F.slice("gaps", 2, F.size("gaps")).alias("nexts"))).alias("k", "x")).where(F.col("x.hits").isNotNull())
    upto = Window.partitionBy("row").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    start = F.sum(F.length("x.gaps") + F.length("x.hits")).over(upto) - F.length("x.hits")
    return each.select(*keep, start.cast("long").alias("start"), F.col("x.hits").alias("candidate"), F.substring("x.gaps", -80, 80).alias("before"), F.substring("x.nexts", 1, 80).alias("after"))


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", extra: tuple[str, ...] = (), threshold: float = 0.5) -> DataFrame:
    """A row for each candidate: id, extra columns, start, length, candidate, score, is_secret.

    Whole texts are searched; null and empty texts have no candidates, repeated rows have theirs again, null
    ids are kept. labelled holds reviewed findings (candidate, before, after, label), of which
    at most about MAX_LABELLED train the forest; without it labelled_findings() stands in. Equal findings have equal scores; a score of
    threshold is a secret. An empty table gives no rows. The forest is trained on those findings
    only, so its cost does not grow with docs; texts with a candidate are the only ones cut up. An extra column with the name of
    one of the result's others is an error.
    """
    if clash := {*map(str.lower, extra)} & {id_col.lower(), "start", "length", "candidate", "score", "is_secret"}:
        raise ValueError(f"extra columns have the names of others: {sorted(clash)}")
    model = train_forest(staged(labelled_findings(docs.sparkSession) if labelled is None else reviewed(labelled), "findings"))
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *extra)
    found = with_features(candidates(rows, ["id", *extra]))
    scored = model.transform(VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features", handleInvalid="keep").transform(found))
    score = F.round(vector_to_array("probability")[1], 6)
    return scored.select(F.col("id").alias(id_col), *extra, "start", F.length("candidate").cast("long").alias("length"), "candidate", score.alias("score"), (score >= threshold).alias("is_secret"))


def redact_secrets(docs: DataFrame, labelled: DataFrame | None = None, text_col: str = "text", mask: str = "[SECRET]", few: int = 100_000) -> DataFrame:
    """docs with every confirmed secret in its text replaced by mask; no row is lost, other columns stay.

    Texts are told apart by their md5, so null ids and repeated rows need no key. A candidate that is confirmed
    at one place of a text is masked wherever it is a candidate. Only the texts with candidates are joined to
    their strings: by broadcast up to few of them, else by shuffle, beside which all other rows stay where they are. Columns
    may have any names.
    """
    key, named_by, body, secrets = free_names(docs, "key", "text_md5", "body", "secrets")
    text, has = F.col(text_col), F.coalesce(F.col(text_col).rlike(CANDIDATE), F.lit(False))
    named = docs.where(has).select(F.md5(text_col).alias(named_by), text.alias(body)).dropDuplicates([named_by])
    found = scan_secrets(named, labelled, id_col=named_by, text_col=body).where("is_secret").groupBy(named_by).agg(F.collect_set("candidate").alias(secrets))
    found = staged(found, "secrets")
    hits, gaps = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0)), F.split(text, CANDIDATE, -1)
    masked = F.zip_with(gaps, hits, lambda g, h: F.concat(g, F.when(F.array_contains(secrets, h), mask).otherwise(F.coalesce(h, F.lit("")))))
    cleaned = F.when(F.col(secrets).isNull(), text).otherwise(F.array_join(masked, ""))

    def clean(rows: DataFrame, secrets: DataFrame) -> DataFrame:
        return rows.join(secrets, F.col(key) == F.col(named_by), "left").withColumn(text_col, cleaned).select(*docs.columns)

    if found.count() <= few:  # a hash costs less than to look for candidates once more
        return clean(docs.withColumn(key, F.md5(text_col)), F.broadcast(found))
    return clean(docs.where(has).withColumn(key, F.md5(text_col)), found).unionByName(docs.where(~has))
