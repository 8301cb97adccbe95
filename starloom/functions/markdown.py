"""Markdown as lines with a state: running text of it, and chunks of it that a model can take."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk at about, and the share of them that a chunk repeats of the one before (fixed values).
CHUNK, OVERLAP = 1200, 0.15


@dataclass(frozen=True)
class Line:
    """A line, whether it is code in a fence, a mark of a fence, and the heading that it is (its level; 0: none)."""

    text: str
    code: bool = False
    fence: bool = False
    level: int = 0


def lines(text: str) -> Iterator[Line]:
    """The lines of a document. A fence ends with as many of its marks as it began with, or with the document."""
    mark, count = "", 0
    for raw in text.replace("\r\n", "\n").replace("\r", "").split("\n"):
        body = raw.lstrip(" ") if len(raw) - len(raw.lstrip(" ")) <= 3 else raw
        run = len(body) - len(body.lstrip(body[0])) if body[:1] in ("`", "~") else 0
        if mark:
            closes = body[:1] == mark and run >= count and not body[run:].strip()
            yield Line(raw, not closes, closes)
            mark = "" if closes else mark
        elif run >= 3 and not (body[0] == "`" and "`" in body[run:]):
            mark, count = body[0], run
            yield Line(raw, fence=True)
        else:
            level = len(body) - len(body.lstrip("#"))
            yield Line(raw, level=level if 1 <= level <= 6 and body[level : level + 1] in ("", " ", "\t") else 0)


def _closing(text: str, at: int, opens: str, closes: str) -> int:
    """Where what opens at a place closes again, marks within it counted; -1 if it does not."""
    depth = 0
    for k in range(at, len(text)):
        depth += (text[k] == opens) - (text[k] == closes)
        if not depth:
            return k
    return -1


def inline(text: str) -> str:
    """Links as their words, images and tags as blanks."""
    out, at = [], 0
    while at < len(text):
        c = text[at]
        image = c == "!" and text[at + 1 : at + 2] == "["
        if c == "[" or image:
            begin = at + image
            end = _closing(text, begin, "[", "]")
            target = _closing(text, end + 1, "(", ")") if end > 0 and text[end + 1 : end + 2] == "(" else -1
            if target > 0:
                out.append(" " if image else inline(text[begin + 1 : end]))
                at = target + 1
                continue
        elif c == "<" and len(text) > at + 1 and text[at + 1] not in " <>":
            end = text.find(">", at)
            if end > 0:
                out.append(" ")
                at = end + 1
                continue
        out.append(c)
        at += 1
    return "".join(out)


def _uncommented(text: str) -> str:
    """A document without its comments; one that does not end stays."""
    out, at = [], 0
    while (begin := text.find("<!--", at)) >= 0 and (end := text.find("-->", begin + 4)) >= 0:
        out += [text[at:begin], " "]
        at = end + 3
    return "".join([*out, text[at:]])


def plain(text: str) -> str:
    """A document as running text: comments, images, tags, link targets and fence marks go, code stays; marks of headings and quotes go."""
    prose, out = [], []

    def flush() -> None:
        if prose:  # links and tags may run over lines
            out.extend(inline("\n".join(prose)).split("\n"))
            prose.clear()

    for line in lines(_uncommented(text)):
        if line.fence or line.code:
            flush()
            out.append(" " if line.fence else line.text)
            continue
        body = line.text.lstrip(" ") if len(line.text) - len(line.text.lstrip(" ")) <= 3 else line.text
        if line.level:
            body = body[line.level :].strip()
        if body.startswith(">"):
            body = body[1:].lstrip(" ")
        prose.append(body)
    flush()
    kept: list[str] = []
    for x in out:
        x = re.sub(r"[ \t]+", " ", x)
        if x or not kept or kept[-1]:  # one empty line between others
            kept.append(x)
    return "\n".join(kept).strip()


def plain_markdown(text: Column) -> Column:
    """plain() of a column, null for null, in batches."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(plain, na_action="ignore")

    return run(text)


def _blocks(text: str, size: int) -> Iterator[tuple[str, bool, int]]:
    """(text, whether it is fenced code, heading level) of paragraphs, headings and fences. A paragraph over size is cut behind spaces."""
    held: list[str] = []

    def paragraph():
        body = "\n".join(held).strip("\n")
        held.clear()
        while len(body) > size:
            cut = max(body.rfind(" ", 0, size), body.rfind("\n", 0, size)) + 1
            cut = cut or size
            yield body[:cut].rstrip(), False, 0
            body = body[cut:].lstrip()
        if body.strip():
            yield body, False, 0

    code: list[str] = []
    for line in lines(text):
        if line.fence and not code:
            yield from paragraph()
            code.append(line.text)
        elif code:
            code.append(line.text)
            if line.fence:
                yield "\n".join(code), True, 0
                code.clear()
        elif line.level:
            yield from paragraph()
            yield line.text.strip(), False, line.level
        elif not line.text.strip():
            yield from paragraph()
        else:
            held.append(line.text)
    if code:
        yield "\n".join(code), True, 0
    yield from paragraph()


def chunks(text: str, size: int = CHUNK, overlap: float = OVERLAP) -> list[tuple[str, str]]:
    """(nearest heading before or at its start, body) of the chunks of a document: whole paragraphs, headings and fences up to size
    characters, or one fence that is longer. A chunk begins with the end of the one before, cut at a space, unless that is code."""
    out: list[tuple[str, str]] = []
    heading, at_start, body, tail = "", "", "", False  # tail: body is only what is repeated
    free = ""  # the end of body behind its last code

    def close() -> None:
        nonlocal body, tail
        if body and not tail:
            out.append((at_start, body))
        body, tail = "", False

    for block, code, level in _blocks(text, size):
        if body and len(body) + 2 + len(block) > size:
            repeated = "" if tail else free[-int(size * overlap) :]
            repeated = repeated[repeated.find(" ") + 1 :].strip() if " " in repeated else ""
            close()
            if repeated and len(repeated) + 2 + len(block) <= size:
                body, tail = repeated, True
            free = body
        if level:
            heading = block.lstrip("#").strip()
        if not body or tail:
            at_start = heading
        body, tail, free = f"{body}\n\n{block}" if body else block, False, "" if code else f"{free}\n\n{block}"
    close()
    return out


_CHUNKS = pa.schema([("id", pa.int64()), ("n", pa.int32()), ("of", pa.int32()), ("heading", pa.string()), ("body", pa.string()), ("hash", pa.string())])


def markdown_chunks(docs: DataFrame, size: int = CHUNK, overlap: float = OVERLAP) -> DataFrame:
    """id, n (from 0), of (chunks of the document), heading, body, hash of docs(id, full_name, readme): the chunks of each readme.

    The hash covers what a model sees of a chunk (chunk_text), so it names what has to be embedded anew. Null and blank readmes have no
    chunks. A document is one row's work; no rows are moved."""

    def run(batches):
        for batch in batches:
            for i, name, text in zip(*(batch.column(c).to_pylist() for c in ("id", "full_name", "readme"))):
                found = chunks(text or "", size, overlap)
                if found:
                    hashes = [hashlib.sha256(f"{name or ''} — {h}\n{b}".encode()).hexdigest() for h, b in found]
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(([i] * len(found), range(len(found)), [len(found)] * len(found), [h for h, _ in found], [b for _, b in found], hashes), _CHUNKS)], schema=_CHUNKS)

    return docs.select("id", "full_name", "readme").mapInArrow(run, "id long, n int, of int, heading string, body string, hash string")


def chunk_text(full_name: Column, heading: Column, body: Column) -> Column:
    """What a model sees of a chunk: where it is from, then its text."""
    return F.concat(F.coalesce(full_name, F.lit("")), F.lit(" — "), heading, F.lit("\n"), body)


def changed_chunks(new: DataFrame, old: DataFrame) -> DataFrame:
    """id, n, hash, change of chunks(id, n, hash) of two versions: 'embed' for texts that a document did not have, 'keep' for those that it
    had (at whatever place), 'drop' for those it has no more."""
    had = old.select("id", "hash").distinct().withColumn("had", F.lit(True))
    rows = new.select("id", "n", "hash").join(had, ["id", "hash"], "left").select("id", "n", "hash", F.when(F.col("had"), "keep").otherwise("embed").alias("change"))
    return rows.unionByName(old.select("id", "n", "hash").join(new.select("id", "hash"), ["id", "hash"], "left_anti").withColumn("change", F.lit("drop")))
