"""A page of varied results: caps for owners and names, near copies held back, and taken again where the page has room."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Results of one owner and of one name root on a page; cosine from which two are copies, and neighbours (fixed values).
OWNER_CAP, ROOT_CAP, COPY, NEAR = 2, 2, 0.92, 0.85
#: Factor for each neighbour that was taken before, and the least of their product (fixed values).
NEIGHBOUR, FLOOR = 0.90, 0.60
#: Endings that a name's first word loses (fixed values).
ENDINGS = "js|ts|ui|sdk|cli|server|client"
#: Results of a query that are looked at for a page.
WINDOW = 30
DIGITS = 9


def name_root(name: Column) -> Column:
    """The first word of a name, without an ending that many names have."""
    return F.regexp_replace(F.element_at(F.split(F.ltrim(F.lower(name), F.lit("-_.")), "[-_.]+"), 1), f"^(.{{2,}}?)(?:{ENDINGS})$", "$1")


def _cosines(vectors) -> np.ndarray:
    """Between all rows; 0 where a vector is missing, null in places, of another length or without direction."""
    n = len(vectors)
    width = max((len(v) for v in vectors if v is not None), default=0)
    rows = np.zeros((n, width))
    for k, v in enumerate(vectors):
        if v is not None and len(v) == width:
            rows[k] = [np.nan if x is None else x for x in v]
    norm = np.sqrt((rows * rows).sum(axis=1))
    unit = np.divide(rows, norm[:, None], out=np.zeros_like(rows), where=np.isfinite(norm[:, None]) & (norm[:, None] > 0))
    return unit @ unit.T


def pick(owners: list, roots: list, vectors: list, lexical: list, limit: int) -> list[tuple[int, int, str | None]]:
    """(place in the order given, neighbours taken before, why it was held back) of what the page shows. One pass takes what no rule holds
    back; if the page has room left then, those held back come in, in their order. The only one with word evidence is never held back."""
    cos, alone = _cosines(vectors), sum(map(bool, lexical)) == 1
    taken: list[int] = []
    shown, held = [], []
    for k in range(len(owners)):
        if len(shown) == limit:
            break
        near = int((cos[k, taken] >= NEAR).sum())
        why = None
        if sum(owners[t] == owners[k] for t in taken) >= OWNER_CAP:
            why = "owner"
        elif sum(roots[t] == roots[k] for t in taken) >= ROOT_CAP:
            why = "name"
        elif (cos[k, taken] >= COPY).any():
            why = "copy"
        if why is None or (alone and lexical[k]):
            taken.append(k)
            shown.append((k, near, None))
        else:
            held.append((k, near, why))
    return shown + held[: limit - len(shown)]


def diversified(hits: DataFrame, limit: int = 10, window: int = WINDOW) -> DataFrame:
    """query_id, position, id, score, base, suppressed_by of hits(query_id, id, owner, name, score, lexical, vector): a page of limit results
    for each query, from the first window by score.

    Null owners and names count as one owner and one name; a row without a vector is nobody's neighbour. Of a query only window rows are
    kept by every task, so a query with most of the hits is no larger than others where it is picked from.
    """
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    first = hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= window)
    rows = first.select("query_id", "place", "id", F.lower("owner").alias("owner"), name_root(F.col("name")).alias("root"), F.col("score").cast("double").alias("base"), F.coalesce("lexical", F.lit(False)).alias("lexical"), F.col("vector").cast("array<double>").alias("vector"))
    of_query = hits.schema["query_id"].dataType.simpleString()

    def page(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place", ignore_index=True)
        text = lambda c: ["" if x is None else x for x in pdf[c]]
        at, near, why = zip(*pick(text("owner"), text("root"), list(pdf["vector"]), list(pdf["lexical"]), limit))
        out = pdf.loc[list(at), ["query_id", "id", "base"]].assign(place=list(at), suppressed_by=list(why))
        out["score"] = (out["base"] * np.maximum(FLOOR, NEIGHBOUR ** np.array(near))).round(DIGITS)
        out = out.sort_values(["score", "place"], ascending=[False, True])
        return out.assign(position=np.arange(1, len(out) + 1))[["query_id", "position", "id", "score", "base", "suppressed_by"]]

    return rows.groupBy("query_id").applyInPandas(page, f"query_id {of_query}, position long, id long, score double, base double, suppressed_by string")
