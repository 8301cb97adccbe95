"""Sets of ids as bitmaps, a row for 32,768 ids, and their algebra."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids of one bitmap.
SPAN = 32_768


@dataclass(frozen=True)
class IdSet:
    """An expression over named sets: IdSet.of("a") | IdSet.of("b"), a & b, ~a (all ids of the universe but those of a)."""

    op: str
    parts: tuple = ()

    @classmethod
    def of(cls, name: str) -> IdSet:
        return cls("name", (name,))

    def __or__(self, other: IdSet) -> IdSet:
        return IdSet("or", (self, other))

    def __and__(self, other: IdSet) -> IdSet:
        return IdSet("and", (self, other))

    def __invert__(self) -> IdSet:
        return IdSet("not", (self,))

    def names(self) -> set[str]:
        return {self.parts[0]} if self.op == "name" else set().union(*(p.names() for p in self.parts))

    def bits(self, held: dict[str, np.ndarray], universe: np.ndarray) -> np.ndarray:
        """The bitmap of this expression, given those of its names."""
        if self.op == "name":
            return held[self.parts[0]] & universe
        first = self.parts[0].bits(held, universe)
        if self.op == "not":
            return universe & ~first
        second = self.parts[1].bits(held, universe)
        return first | second if self.op == "or" else first & second


def any_of(*names: str) -> IdSet:
    out = IdSet.of(names[0])
    for n in names[1:]:
        out = out | IdSet.of(n)
    return out


def all_of(*names: str) -> IdSet:
    out = IdSet.of(names[0])
    for n in names[1:]:
        out = out & IdSet.of(n)
    return out


def bitmaps(members: DataFrame) -> DataFrame:
    """name, bucket, bits of members(name, id): summed in every task before a shuffle, so a set of any size sends each task's bitmaps
    once. Repeated members and null ids make no difference."""
    rows = members.where("id is not null").select("name", F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at"))
    return rows.groupBy("name", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def members_of(expressions: dict[str, IdSet], sets: DataFrame, universe: DataFrame) -> DataFrame:
    """name, id for each of the expressions over sets(name, bucket, bits) within universe(id). A name without a set is empty.

    One aggregate brings the bitmaps of a span of ids together, whatever the number of expressions; ids come out as rows
    where they are, and no set is ever a list.
    """
    every = universe.where("id is not null").select(F.bitmap_bucket_number("id").alias("bucket"), F.bitmap_bit_position("id").alias("at")).groupBy("bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    names = sorted(set().union(*(e.names() for e in expressions.values())))
    rows = sets.where(F.col("name").isin(names)).select("name", "bucket", "bits").unionByName(every.withColumn("name", F.lit(None).cast("string")))
    together = rows.groupBy("bucket").agg(F.max(F.when(F.col("name").isNull(), F.col("bits"))).alias("all"), *(F.max(F.when(F.col("name") == n, F.col("bits"))).alias(f"s{k}") for k, n in enumerate(names)))

    def ids_of(e: IdSet):
        @F.pandas_udf("array<long>")
        def run(bucket: pd.Series, everything: pd.Series, *held: pd.Series) -> pd.Series:
            out = []
            for b, u, *h in zip(bucket, everything, *held):
                maps = {n: np.frombuffer(x, np.uint8) if x is not None else np.zeros(SPAN // 8, np.uint8) for n, x in zip(names, h)}
                at = np.flatnonzero(np.unpackbits(e.bits(maps, np.frombuffer(u, np.uint8)), bitorder="little"))
                out.append((b - 1) * SPAN + at + 1 if b > 0 else b * SPAN - at)  # as Spark numbers bits
            return pd.Series(out)

        return run

    found = together.where("all is not null").select(*(ids_of(e)("bucket", "all", *(f"s{k}" for k in range(len(names)))).alias(f"e{k}") for k, e in enumerate(expressions.values())))
    listed = F.array(*(F.struct(F.lit(name).alias("name"), F.col(f"e{k}").alias("ids")) for k, name in enumerate(expressions)))
    return found.select(F.explode(listed).alias("x")).select("x.name", F.explode("x.ids").alias("id"))
