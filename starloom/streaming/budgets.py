"""The stateful rules over an unbounded stream of requests: bursts, daily budgets, index state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


def timed(events: DataFrame, at: str = "ts", late: str = "10 minutes") -> DataFrame:
    """events with at as a zoned timestamp and a watermark on it."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late)


def burst_stream(events: DataFrame, limit: int, seconds: int = 60, key: str = "key", at: str = "ts") -> DataFrame:
    """Requests of each key and tumbling window and how many are over the limit; a window comes out when the watermark passes it."""
    counted = events.groupBy(key, F.window(at, f"{seconds} seconds").alias("w")).agg(F.count("*").alias("requests"))
    return counted.select(key, F.col("w.start").alias("window_start"), "requests", F.greatest(F.col("requests") - limit, F.lit(0)).alias("denied"))


class _Budget(StatefulProcessor):
    """Counts a key's requests by day; at most limit of a day are allowed."""

    def __init__(self, limit: int) -> None:
        self.limit = max(0, int(limit))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.used = handle.getMapState("used", "day string", "n long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            pdf = pdf.sort_values(["ts", "id"])
            out = []
            for i, ts in zip(pdf["id"], pdf["ts"]):
                day = str(pd.Timestamp(ts).date())
                n = (self.used.getValue((day,))[0] if self.used.containsKey((day,)) else 0) + 1
                self.used.updateValue((day,), (n,))
                out.append((key[0], i, day, n, n <= self.limit))
            newest = max((d for (d,) in self.used.keys()), default="")
            for (d,) in list(self.used.keys()):  # two days are open at a time
                if d < str((pd.Timestamp(newest) - pd.Timedelta(days=1)).date()):
                    self.used.removeKey((d,))
            yield pd.DataFrame(out, columns=["key", "id", "day", "used", "allowed"])

    def close(self) -> None:
        pass


def budget_stream(events: DataFrame, limit: int) -> DataFrame:
    """key, id, day, used, allowed for events(key, id, ts), one state a key. Needs the RocksDB state store."""
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=_Budget(limit), outputStructType="key string, id long, day string, used long, allowed boolean", outputMode="append", timeMode="none")


def state_stream(events: DataFrame, key: str, seq: str, columns: list[str]) -> DataFrame:
    """The folded state of each key, updated as patches come (update or complete output mode)."""
    newest = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct(seq, c)))[c]
    return events.groupBy(key).agg(*(newest(c).alias(c) for c in columns))
