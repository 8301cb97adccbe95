"""The inverted index: stemmed terms with positions, document lengths, frequencies and trigrams, as parquet tables clustered by
bucket that a search reads a few files of.

Rows lie in segments that never change. A manifest, one small file for each version, says which segments are live, what is dead in
them, and how the index was built. A change writes its files first and then the next manifest, which only one writer can: a reader
has the version that it opened, whole, until vacuum() removes it. Segments of one size are merged as they become many.
"""

from __future__ import annotations

import json
import uuid
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.functions.stemming import stem
from starloom.functions.text import index_tokens, index_words
from starloom.sources import files
from starloom.sources.staging import shared_dir

#: Index columns and their weights in BM25 (fixed values).
WEIGHTS = {"full_name": 10.0, "description": 5.0, "topics": 4.0, "readme": 1.0}
LAB_WEIGHTS = {"full_name": 8.0, "description": 3.0, "topics": 3.0, "readme": 1.0}
COLUMNS = tuple(WEIGHTS)
#: A position is that of the token in its column plus this much for each column before it.
SPAN = 1 << 28
#: Dead rows that are broadcast; the bucket of the rows for whole documents.
FEW_DEAD, WHOLE = 1_000_000, -1
#: Bytes of text for each bucket, within bounds; segments of a size class (each FAN times the one below) that are merged.
BUCKET_BYTES, FEWEST, MOST, FAN = 16 << 20, 8, 4096, 4
#: Tokens that a task groups at once, and words whose stems it remembers.
SLICE_TOKENS, MOST_KNOWN = 1 << 18, 200_000

#: Columns of the index's tables, so that opening them reads no footers.
_SCHEMAS = {
    "terms": "id long, term string, len long, places array<long>, bucket int, segment string", "trigrams": "id long, gram string, bucket int, segment string",
    "df": "term string, df long, bucket int, segment string", "dead": "id long, segment string",
}


def columns(repos: DataFrame) -> DataFrame:
    """id and the token arrays of each index column."""
    text = {"topics": F.array_join("topics", " ")}
    return repos.select("id", *(index_tokens(F.coalesce(text.get(c, F.col(c)), F.lit(""))).alias(c) for c in COLUMNS))


def _token_slices(batches):
    """Record batches in runs of rows of about SLICE_TOKENS tokens, or of one row that has more."""
    for batch in batches:
        ends = np.cumsum(sum(_lengths(batch.column(c)) for c in COLUMNS))
        i = 0
        while i < batch.num_rows:
            j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + SLICE_TOKENS, side="right")))
            yield batch.slice(i, j - i)
            i = j


def _lengths(lists: pa.Array) -> np.ndarray:
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def _grouped(stemmed: bool):
    """A row for each document and term with the term's places, and one for the document itself (an empty term, its length). What a task
    holds is of one slice: tokens stay in Arrow, only distinct words become Python strings."""

    def run(batches):
        known: dict[str, str] = {}
        for batch in _token_slices(batches):
            counts = [_lengths(batch.column(c)) for c in COLUMNS]
            lens, rows = sum(counts), np.arange(batch.num_rows)
            row = np.concatenate([np.repeat(rows, n) for n in counts])
            place = np.concatenate([k * SPAN + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for k, n in enumerate(counts)])
            words = pa.concat_arrays([batch.column(c).flatten() for c in COLUMNS]).dictionary_encode()
            code, terms = words.indices.to_numpy(), words.dictionary.to_pylist()
            if stemmed:
                for i, w in enumerate(terms):
                    s = known.get(w)
                    if s is None:
                        s = known[w] = stem(w)
                    terms[i] = s
                if len(known) > MOST_KNOWN:
                    known.clear()
            terms = pa.array(terms, pa.string()).dictionary_encode()
            code = terms.indices.to_numpy()[code]
            order = np.lexsort((code, row))  # stable, so places stay in order
            row, code = row[order], code[order]
            first = np.flatnonzero(np.concatenate(([True], (row[1:] != row[:-1]) | (code[1:] != code[:-1])))) if len(row) else np.zeros(0, np.int64)
            owner = np.concatenate([row[first], rows])
            starts = np.concatenate([first, np.full(len(rows) + 1, len(row))]).astype(np.int32)
            named = pa.concat_arrays([terms.dictionary.take(pa.array(code[first])), pa.array([""] * len(rows), pa.string())])
            places = pa.ListArray.from_arrays(pa.array(starts), pa.array(place[order]))
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owner)).cast(pa.int64()), named, pa.array(lens[owner]), places], names=["id", "term", "len", "places"])

    return run


def postings(repos: DataFrame, stemmed: bool = True) -> DataFrame:
    """id, term, len (tokens of all columns of the document), places: a row for each term of a document, no shuffle."""
    return columns(repos).mapInArrow(_grouped(stemmed), "id long, term string, len long, places array<long>")


def frequency(weights: dict[str, float], places: Column | str = "places") -> Column:
    """Weighted frequency of a term from its places."""
    in_column = lambda k: F.size(F.filter(places, lambda p: (p >= k * SPAN) & (p < (k + 1) * SPAN)))
    return sum((w * in_column(COLUMNS.index(c)) for c, w in weights.items()), F.lit(0.0))


def frequencies(repos: DataFrame, weights: dict[str, float] = WEIGHTS, stemmed: bool = True) -> DataFrame:
    """id, term, tf (weighted), len of a corpus that is not indexed."""
    return postings(repos, stemmed).where("term <> ''").select("id", "term", "len", frequency(weights).alias("tf"))


def trigrams(repos: DataFrame) -> DataFrame:
    """id, gram: distinct three-character runs of name, description and topics, lower-case."""
    text = F.lower(F.concat_ws("\n", "full_name", "description", F.array_join("topics", " ")))
    grams = F.transform(F.sequence(F.lit(1), F.length("t") - 2), lambda i: F.substring("t", i, F.lit(3)))
    return repos.select("id", text.alias("t")).where(F.length("t") >= 3).select("id", F.explode(F.array_distinct(grams)).alias("gram"))


def _applies(dead: dict, segment: dict) -> bool:
    """Whether a list of dead ids is about a segment: it holds rows from before, and was not merged since."""
    return segment["seq"] <= dead["upto"] and segment["read"] < dead["born"]


@dataclass
class SearchIndex:
    """A persisted index under path, as one version of its manifest has it. Reads are lazy plans over the files of the buckets that
    their terms are in; they see that version, and the changes made through this object."""

    spark: SparkSession
    path: str
    manifest: dict
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @classmethod
    def build(cls, repos: DataFrame, path: str | None = None, buckets: int | None = None, stemmed: bool = True) -> SearchIndex:
        """The index of a corpus, in place of any under this path; by default a new one in the shared folder, with buckets by the bytes of
        its readmes."""
        spark = repos.sparkSession
        if buckets is None:
            size = repos.agg(F.sum(F.octet_length("readme"))).first()[0] or 0
            buckets = min(MOST, max(FEWEST, -(-size // BUCKET_BYTES)))
        path = path or f"{shared_dir(spark)}/starloom/index-{uuid.uuid4().hex}"
        index = cls(spark, path, {"version": _last(spark, path), "buckets": buckets, "stemmed": stemmed, "segments": [], "dead": []})
        segment = index._segment(postings(repos, stemmed), trigrams(repos))
        index._commit(lambda now: now | {"buckets": buckets, "stemmed": stemmed, "segments": [segment | {"seq": 0, "read": now["version"]}], "dead": []})
        return index

    @property
    def buckets(self) -> int:
        return self.manifest["buckets"]

    @property
    def stemmed(self) -> bool:
        return self.manifest["stemmed"]

    def _commit(self, change) -> bool:
        """Makes the next version of the manifest with change(the present one), anew for as long as another writer is faster; False
        where change has nothing to make of it."""
        now = self.manifest
        while True:
            new = change(now)
            if new is None:
                return False
            new = new | {"version": now["version"] + 1}
            new["dead"] = [d for d in new["dead"] if any(_applies(d, s) for s in new["segments"])]
            if files.create(self.spark, _manifest(self.path, new["version"]), json.dumps(new)):
                self.manifest, self.tables = new, {}
                return True
            now = _read_manifest(self.spark, self.path) or now

    def _bucket(self, column: str) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(self.buckets)).cast("int")

    def _segment(self, terms: DataFrame, grams: DataFrame) -> dict:
        """Writes rows of terms and trigrams as a segment that no manifest has yet. Spark splits and joins what it shuffles by its size, so a
        common term, and the rows of whole documents, spread over as many tasks and files as they need."""
        name = uuid.uuid4().hex

        def put(rows: DataFrame, key: str, table: str) -> None:
            rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", key, *(["id"] if "id" in rows.columns else [])).write.partitionBy("bucket").parquet(f"{self.path}/{table}/segment={name}")

        put(terms.withColumn("bucket", F.when(F.col("term") == "", WHOLE).otherwise(self._bucket("term"))), "term", "terms")
        put(grams.withColumn("bucket", self._bucket("gram")), "gram", "trigrams")
        mine = self._read("terms", [name])
        put(mine.where(F.col("bucket") != WHOLE).groupBy("bucket", "term").agg(F.count("*").alias("df")), "term", "df")
        n, total = mine.where(F.col("bucket") == WHOLE).agg(F.count("*"), F.coalesce(F.sum("len"), F.lit(0))).first()
        return {"name": name, "n": n, "total": total}

    def _read(self, table: str, segments: list[str]) -> DataFrame:
        where = [f"{self.path}/{table}/segment={s}" for s in segments]
        if not where:
            return self.spark.createDataFrame([], _SCHEMAS[table])
        return self.spark.read.schema(_SCHEMAS[table]).option("basePath", f"{self.path}/{table}").parquet(*where)

    def _table(self, name: str) -> DataFrame:
        """A table of the live segments, whose files are listed once."""
        if name not in self.tables:
            self.tables[name] = self._read(name, [s["name"] for s in self.manifest["dead" if name == "dead" else "segments"]])
        return self.tables[name]

    def _buckets(self, keys: list[str]) -> list[int]:
        """The buckets that hold these keys, as _bucket() gives them."""
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        return sorted({signed(xxhash.xxh64_intdigest(k.encode(), seed=42)) % self.buckets for k in keys})

    def _live(self, rows: DataFrame) -> DataFrame:
        """rows (with their segment) without those whose id is on a list of dead ones that is about their segment."""
        lists = self.manifest["dead"]
        if not lists:
            return rows
        about = [F.struct(F.lit(d["name"]).alias("d"), F.lit(s["name"]).alias("s")) for d in lists for s in self.manifest["segments"] if _applies(d, s)]
        pairs = self.spark.range(1).select(F.inline(F.array(*about)))  # a row for each list and segment
        gone = self._table("dead").join(F.broadcast(pairs), F.col("segment") == F.col("d")).select(F.col("id").alias("dead_id"), F.col("s").alias("dead_in"))
        few = sum(d["n"] for d in lists) * len(self.manifest["segments"]) <= FEW_DEAD
        return rows.join(F.broadcast(gone) if few else gone, (F.col("id") == F.col("dead_id")) & (F.col("segment") == F.col("dead_in")), "left_anti")

    def upsert(self, repos: DataFrame) -> None:
        """Documents new or changed; what the index had of their ids is dead from the same version on."""
        segment, dead = self._segment(postings(repos, self.stemmed), trigrams(repos)), self._put_dead(repos)

        def change(now: dict) -> dict:
            seq, born = max((s["seq"] for s in now["segments"]), default=-1) + 1, now["version"] + 1
            return now | {"segments": [*now["segments"], segment | {"seq": seq, "read": born}], "dead": [*now["dead"], dead | {"upto": seq - 1, "born": born}]}

        self._commit(change)
        self._tidy()

    def delete(self, ids: DataFrame) -> None:
        """Takes the documents with these ids out."""
        dead = self._put_dead(ids)
        self._commit(lambda now: now | {"dead": [*now["dead"], dead | {"upto": max((s["seq"] for s in now["segments"]), default=-1), "born": now["version"] + 1}]})

    def _put_dead(self, ids: DataFrame) -> dict:
        name = uuid.uuid4().hex
        ids.select("id").distinct().write.parquet(f"{self.path}/dead/segment={name}")
        return {"name": name, "n": self._read("dead", [name]).count()}

    def _tidy(self) -> None:
        """Merges segments of one size class while a class has FAN of them, so their number grows with the logarithm of the changes."""
        while True:
            classes = defaultdict(list)
            for s in self.manifest["segments"]:
                classes[len(_digits(s["n"]))].append(s["name"])
            many = next((names for _, names in sorted(classes.items()) if len(names) >= FAN), None)
            if many is None or not self.merge(many):
                return

    def merge(self, names: list[str] | None = None) -> bool:
        """Puts what is live of some segments (all of them unless named) into one; False if another writer took one of them meanwhile."""
        now = self.manifest
        old = [s for s in now["segments"] if names is None or s["name"] in names]
        if len(old) + len(now["dead"]) < 2:
            return False
        mine = SearchIndex(self.spark, self.path, now | {"segments": old})
        segment = self._segment(mine._live(mine._table("terms")).drop("segment", "bucket"), mine._live(mine._table("trigrams")).drop("segment", "bucket"))
        gone, seq = {s["name"] for s in old}, max(s["seq"] for s in old)

        def change(present: dict) -> dict | None:
            left = [s for s in present["segments"] if s["name"] not in gone]
            if len(left) + len(gone) != len(present["segments"]):
                return None
            return present | {"segments": sorted([*left, segment | {"seq": seq, "read": now["version"]}], key=lambda s: s["seq"])}

        return self._commit(change)

    def vacuum(self) -> None:
        """Removes the files that this version does not need, and older versions; readers of those fail from then on."""
        live = {s["name"] for s in [*self.manifest["segments"], *self.manifest["dead"]]}
        for table in _SCHEMAS:
            for n in files.names(self.spark, f"{self.path}/{table}"):
                if n.removeprefix("segment=") not in live:
                    files.delete(self.spark, f"{self.path}/{table}/{n}")
        for n in files.names(self.spark, f"{self.path}/manifest"):
            if n < _manifest("", self.manifest["version"]).rsplit("/", 1)[1]:
                files.delete(self.spark, f"{self.path}/manifest/{n}")

    def of(self, words: list[str]) -> list[str]:
        """The index terms of words as they are written."""
        return [stem(w) if self.stemmed else w for w in words]

    def rows(self, terms: list[str]) -> DataFrame:
        """id, term, len, places of some index terms; other buckets' files and row groups are not read."""
        asked = list(dict.fromkeys(terms)) or [""]
        found = self._table("terms").where(F.col("bucket").isin(self._buckets(asked)) & F.col("term").isin(asked) & (F.col("term") != ""))
        return self._live(found).select("id", "term", "len", "places")

    def terms(self) -> DataFrame:
        """id, term, len, places of the whole index."""
        return self._live(self._table("terms").where(F.col("bucket") != WHOLE)).select("id", "term", "len", "places")

    def lengths(self) -> DataFrame:
        """id, len of every document."""
        return self._live(self._table("terms").where(F.col("bucket") == WHOLE)).select("id", "len")

    def stats(self) -> DataFrame:
        """One row: n documents and their mean length; from the manifest where nothing is dead."""
        if not self.manifest["dead"]:
            n, total = (sum(s[k] for s in self.manifest["segments"]) for k in ("n", "total"))
            return self.spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(total / n if n else None).cast("double").alias("mean_len"))
        return self.lengths().agg(F.count("*").alias("n"), F.avg("len").alias("mean_len"))

    def dfs(self, terms: list[str]) -> DataFrame:
        """term (as asked), df: in how many documents each is; stored numbers for single words where nothing is dead."""
        if self.manifest["dead"]:
            return self.matches(terms).groupBy("term").agg(F.count("*").alias("df"))
        split = {t: self.of(index_words(t)) for t in terms}
        single = {t: s[0] for t, s in split.items() if len(s) == 1}
        asked = list(dict.fromkeys(single.values())) or [""]
        stored = self._table("df").where(F.col("bucket").isin(self._buckets(asked)) & F.col("term").isin(asked))
        named = F.explode(F.array_compact(F.array(*(F.when(F.col("term") == s, F.lit(t)) for t, s in single.items())))) if single else F.lit("")
        counted = stored.select(named.alias("asked"), "df")
        for t, words in split.items():
            if len(words) > 1:
                counted = counted.unionByName(self._phrase(words).agg(F.count("*").alias("df")).select(F.lit(t).alias("asked"), "df"))
        return counted.groupBy(F.col("asked").alias("term")).agg(F.sum("df").alias("df")).where("df > 0")

    def all_dfs(self) -> DataFrame:
        """term, df of all index terms."""
        if self.manifest["dead"]:
            return self.terms().groupBy("term").agg(F.count("*").alias("df"))
        return self._table("df").groupBy("term").agg(F.sum("df").alias("df"))

    def grams(self, grams: list[str]) -> DataFrame:
        """id, gram of some trigrams."""
        return self._live(self._table("trigrams").where(F.col("bucket").isin(self._buckets(grams)) & F.col("gram").isin(grams))).select("id", "gram")

    def matches(self, terms: list[str], weights: dict[str, float] = WEIGHTS) -> DataFrame:
        """id, len, term (as asked), tf (weighted) of the terms of a query; a term of several words is a phrase."""
        split = {t: self.of(index_words(t)) for t in terms}
        single = {t: s[0] for t, s in split.items() if len(s) == 1}
        named = F.explode(F.filter(F.array(*(F.when(F.col("term") == s, F.lit(t)) for t, s in single.items())), lambda x: x.isNotNull())) if single else F.lit("")
        out = self.rows(list(single.values())).select("id", "len", named.alias("asked"), frequency(weights).alias("tf"))
        for t, words in split.items():
            if len(words) > 1:
                out = out.unionByName(self._phrase(words).select("id", "len", F.lit(t).alias("asked"), frequency(weights).alias("tf")))
        return out.where("tf > 0").withColumnRenamed("asked", "term")

    def _phrase(self, words: list[str]) -> DataFrame:
        """id, len, places where the words stand one after another."""
        out = None
        for k, w in enumerate(words):
            here = self.rows([w]).select("id", "len", F.transform("places", lambda p: p - k).alias("places"))
            out = here if out is None else out.join(here.select("id", F.col("places").alias("next")), "id").select("id", "len", F.array_intersect("places", "next").alias("places"))
        return out.where(F.size("places") > 0)


def _digits(n: int) -> str:
    """n to the base FAN, which has as many digits as n's size class."""
    out = ""
    while n:
        out, n = str(n % FAN) + out, n // FAN
    return out


def _manifest(path: str, version: int) -> str:
    return f"{path}/manifest/{version:012d}.json"


def _last(spark: SparkSession, path: str) -> int:
    found = files.names(spark, f"{path}/manifest")
    return int(found[-1].removesuffix(".json")) if found else 0


def _read_manifest(spark: SparkSession, path: str) -> dict | None:
    """The newest version that is whole; one that is being written is not."""
    for n in reversed(files.names(spark, f"{path}/manifest")):
        try:
            return json.loads(files.read(spark, f"{path}/manifest/{n}"))
        except ValueError:
            continue
    return None


def opened(spark: SparkSession, path: str, buckets: int | None = None, stemmed: bool | None = None) -> SearchIndex | None:
    """The index under a path as it is now, if there is one. How it was built is read from it; what is asked for has to agree."""
    found = _read_manifest(spark, path)
    if found is None:
        return None
    if buckets is not None and buckets != found["buckets"]:
        raise ValueError(f"the index under {path} has {found['buckets']} buckets, not {buckets}")
    if stemmed is not None and stemmed != found["stemmed"]:
        raise ValueError(f"the index under {path} is {'stemmed' if found['stemmed'] else 'not stemmed'}")
    return SearchIndex(spark, path, found)


def listed(spark: SparkSession, root: str) -> list[str]:
    """The names of the indexes in a folder, as of accounts (see table_name)."""
    return [n for n in files.names(spark, root) if files.names(spark, f"{root}/{n}/manifest")]


def drop(spark: SparkSession, path: str) -> None:
    """Removes an index: its manifest first, so that nobody opens what is left."""
    files.delete(spark, f"{path}/manifest")
    files.delete(spark, path)
