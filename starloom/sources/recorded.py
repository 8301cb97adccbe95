"""Recorded responses of a listing as a data source: a partition for each page, in batches and as a stream.

A recording is a folder with a folder page=<n> for each page, whose files hold one JSON object:
{"status": 200, "headers": {"etag": ..., "link": ..., "retry-after": ...}, "body": "..."}. Spark can lay it out with
partitionBy("page").text(). Paths are those of file systems that pyarrow opens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

#: What a page came to, and the columns of a row.
STATES = ("ok", "unchanged", "missing", "limited", "failed", "unreadable", "capped")
SCHEMA = "page int, status int, state string, etag string, next int, wait_s long, remaining int, json string, error string"
#: Pages that are read of one listing at most; more are an error row (fixed value of the listing: 100 pages of 100).
MOST_PAGES = 100


def _pages(path: str) -> list[int]:
    at, root = fs.FileSystem.from_uri(path if "://" in path or path.startswith("/") else f"/{path}")
    found = at.get_file_info(fs.FileSelector(root, allow_not_found=True))
    return sorted(int(m.group(1)) for f in found if (m := re.fullmatch(r"page=(\d+)", f.base_name)))


def _read(path: str, page: int) -> str:
    at, root = fs.FileSystem.from_uri(path)
    files = [f for f in at.get_file_info(fs.FileSelector(f"{root}/page={page}")) if f.is_file and not f.base_name.startswith(("_", "."))]
    return "".join(at.open_input_stream(f.path).read().decode() for f in sorted(files, key=lambda f: f.base_name))


def _number(x) -> int | None:
    try:
        return int(float(x))
    except (TypeError, ValueError):
        return None


def row_of(page: int, recorded: str) -> tuple:
    """A page's row. 304 is a page that has not changed and has no body; 404 is missing; 403 and 429 wait for retry-after where they say
    so; other codes are failures; what is no recording, or a good page whose body is no JSON, is unreadable."""
    try:
        said = json.loads(recorded)
        status, headers, body = int(said["status"]), {k.lower(): v for k, v in (said.get("headers") or {}).items()}, said.get("body")
    except (ValueError, TypeError, KeyError, AttributeError) as e:
        return (page, None, "unreadable", None, None, None, None, None, f"no recorded response: {type(e).__name__}")
    wait, remaining = _number(headers.get("retry-after")), _number(headers.get("x-ratelimit-remaining"))
    head = lambda state: (page, status, state, headers.get("etag"))
    if status == 304:
        return (*head("unchanged"), None, None, remaining, None, None)
    if status == 404:
        return (*head("missing"), None, None, remaining, None, "not found")
    if status in (403, 429):
        return (*head("limited"), None, wait if wait and wait > 0 else None, remaining, None, f"rate limit (HTTP {status})")
    if not 200 <= status < 300:
        return (*head("failed"), None, None, remaining, None, f"HTTP {status}")
    try:
        json.loads(body)
    except (ValueError, TypeError):
        return (*head("unreadable"), None, None, remaining, None, "the body is no JSON")
    link = re.search(r"<[^>]*[?&]page=(\d+)[^>]*>;\s*rel=\"next\"", headers.get("link") or "")
    return (*head("ok"), int(link.group(1)) if link else None, None, remaining, body, None)


class _Page(InputPartition):
    def __init__(self, page: int, capped: bool = False) -> None:
        self.page, self.capped = page, capped


class _Pages:
    """What both readers share: which pages there are, and a page's row."""

    def __init__(self, options: dict) -> None:
        self.path, self.most = options["path"], int(options.get("pages", MOST_PAGES))

    def parts(self, first: int, last: int) -> list[_Page]:
        found = [p for p in _pages(self.path) if first < p <= last]
        inside = [_Page(p) for p in found if p <= self.most]
        return inside + [_Page(p, True) for p in found if p > self.most][:1]

    def read(self, partition: _Page | None) -> Iterator[tuple]:
        if partition is None:  # Spark's stand-in for no partitions
            return
        if partition.capped:
            yield (partition.page, None, "capped", None, None, None, None, None, f"more than {self.most} pages")
        else:
            yield row_of(partition.page, _read(self.path, partition.page))


class _Batch(_Pages, DataSourceReader):
    def partitions(self) -> list[_Page]:
        return self.parts(-1, 1 << 31)


class _Stream(_Pages, DataSourceStreamReader):
    """Offsets are page numbers: a batch has the pages that were recorded since the one before."""

    def initialOffset(self) -> dict:
        return {"page": -1}

    def latestOffset(self) -> dict:
        return {"page": max(_pages(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[_Page]:
        return self.parts(start["page"], end["page"])


class Recorded(DataSource):
    """format("recorded").option("path", folder), with option pages for the most pages of a listing."""

    @classmethod
    def name(cls) -> str:
        return "recorded"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Recorded)


def record(responses: DataFrame, path: str) -> None:
    """Lays out responses(page, status, headers map, body) as a recording."""
    text = F.to_json(F.struct("status", "headers", "body"))
    responses.select("page", text.alias("value")).repartition("page").write.partitionBy("page").text(path)


def listing(pages: DataFrame) -> DataFrame:
    """pages up to the one that ends the listing: an error, or a good page that names no next one. Unchanged pages go on, as nothing was said
    about what follows."""
    ends = ~F.col("state").isin("ok", "unchanged") | ((F.col("state") == "ok") & F.col("next").isNull())
    before = F.sum(ends.cast("int")).over(Window.orderBy("page").rowsBetween(Window.unboundedPreceding, -1))  # MOST_PAGES rows
    return pages.withColumn("over", F.coalesce(before, F.lit(0)) > 0).where(~F.col("over")).drop("over")
