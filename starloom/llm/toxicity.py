"""Toxicity scores: gradient-boosted trees over dense features of the text, calibrated by isotonic regression."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import crc_mod, semi_join, staged
from starloom.llm.labelled import label_sample

#: Bounds of the fit: labelled rows read, and entries of the learned lexicon.
MAX_LABELLED, MAX_LEXICON = 20_000, 5_000
#: Second-person words of the corpus languages (fixed values).
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine deiner ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo tuya usted ustedes su".split())
#: Insults that belong to the lexicon without labels (fixed values).
SEED = frozenset("asshole bastard bitch clown coward creep cretin crap degenerate disgusting dumb fool freak garbage hateful hypocrite idiot idiots imbecile jerk liar loathsome loser losers lunatic moron morons nasty pathetic pig rat scum scumbag shit shut sick stupid traitor trash ugly useless vermin vile weak wimp worthless blöd dumm idiotisch arschloch abschaum versager connard débile crétin imbécile ordure salaud tonto estúpido basura imbécil asqueroso inútil".split())
#: Signs and digits that stand for letters in obfuscated words (fixed values).
_LEET = str.maketrans("013457@$", "oieastas")
_WORD = re.compile(r"\w+")
_MASKED = re.compile(r"\b\w*[^\W\d_][\d@$*!.]+[^\W\d_]\w*")
NEAR = 5
FEATURES = ["lexicon", "lexicon_rate", "stems", "stem_rate", "near_you", "near_rate", "you_rate", "capitals", "exclamations", "stops", "marks", "masked", "masked_hits", "repeat_letters", "log_words"]


def _stems(word: str) -> list[str]:
    return [f"{word[:k]}*" for k in (4, 5) if len(word) > k]


def lexicon_counts(texts) -> dict[str, int]:
    """How many of the texts hold each word, and each word beginning."""
    found: dict[str, int] = {}
    for text in texts:
        words = set(_WORD.findall((text or "").lower()))
        for w in words | {s for x in words for s in _stems(x)}:
            found[w] = found.get(w, 0) + 1
    return found


def features(text: str, lexicon: frozenset, stems: frozenset) -> list[float]:
    low = (text or "").lower()
    words = _WORD.findall(low)
    n, size = max(len(words), 1), max(len(low), 1)
    hits = [i for i, w in enumerate(words) if w in lexicon]
    begun = [i for i, w in enumerate(words) if w[:4] in stems or w[:5] in stems]
    you = [i for i, w in enumerate(words) if w in SECOND_PERSON]
    places = np.array(sorted({*hits, *begun}))
    near = 0
    if len(places) and you:
        at = np.searchsorted(you_ := np.array(you), places)
        gap = np.minimum(np.abs(places - you_[np.minimum(at, len(you_) - 1)]), np.abs(places - you_[np.maximum(at - 1, 0)]))
        near = int((gap <= NEAR).sum())
    masked = _MASKED.findall(text or "") if re.search(r"[\d@$*]", low) else []
    unmasked = sum((m := x.lower().translate(_LEET)) in lexicon or re.sub(r"[^\w]", "", m) in lexicon for x in masked)
    capitals = sum(map(str.isupper, text or ""))
    return [len(hits), np.log1p(1000 * len(hits) / n), len(begun), np.log1p(1000 * len(begun) / n), near, np.log1p(1000 * near / n), len(you) / n, capitals / size, low.count("!") / n, (low.count(".") + low.count(",")) / n, sum(map(low.count, "#$%&*|")) / n, len(masked) / n, unmasked, len(re.findall(r"(\w)\1\1", low)) / n, np.log1p(len(words))]


# ---- boosted trees on binned features ----


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 48, least: float = 1.0, ridge: float = 1.0) -> dict:
    """Boosted regression trees on the logistic loss. A tree is a list of (feature, edge) for each inner node and leaf values."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    raw, trees = np.full(len(y), base), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, p * (1 - p)
        node, splits = np.zeros(len(y), dtype=np.int64), []
        for level in range(depth):
            width = 1 << level
            best = np.full(width, 1e-9)
            chosen = [(0, np.inf)] * width
            total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                cell = node * (len(e) + 1) + binned[:, f]
                gl = np.cumsum(np.bincount(cell, g, width * (len(e) + 1)).reshape(width, -1), axis=1)[:, :-1]
                hl = np.cumsum(np.bincount(cell, h, width * (len(e) + 1)).reshape(width, -1), axis=1)[:, :-1]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + ridge) + gr**2 / (hr + ridge) - (total_g**2 / (total_h + ridge))[:, None]
                gain[(hl < least) | (hr < least)] = -1
                at = gain.argmax(axis=1)
                for k in range(width):
                    if gain[k, at[k]] > best[k]:
                        best[k], chosen[k] = gain[k, at[k]], (f, float(e[at[k]]))
            splits.append(chosen)
            node = 2 * node + _goes_right(x, node, chosen)
        leaves = np.bincount(node, g, 1 << depth) / (np.bincount(node, h, 1 << depth) + ridge) * rate
        raw = raw + leaves[node]
        trees.append((splits, leaves))
    return {"base": base, "trees": trees}


def _goes_right(x: np.ndarray, node: np.ndarray, chosen: list) -> np.ndarray:
    f, e = np.array([c[0] for c in chosen]), np.array([c[1] for c in chosen])
    return (x[np.arange(len(x)), f[node]] > e[node]).astype(np.int64)


def raw_scores(model: dict, x: np.ndarray) -> np.ndarray:
    out = np.full(len(x), model["base"])
    for splits, leaves in model["trees"]:
        node = np.zeros(len(x), dtype=np.int64)
        for chosen in splits:
            node = 2 * node + _goes_right(x, node, chosen)
        out += leaves[node]
    return out


def fit_isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: knots (raw score, rate), not falling."""
    order = np.argsort(raw, kind="stable")
    pools: list[list[float]] = []  # rate, weight, lowest and highest raw score
    for r, t in zip(raw[order].tolist(), y[order].astype(float).tolist()):
        pools.append([t, 1.0, r, r])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            t2, w2, _, hi = pools.pop()
            t1, w1, lo, _ = pools.pop()
            pools.append([(t1 * w1 + t2 * w2) / (w1 + w2), w1 + w2, lo, hi])
    return np.array([v for p in pools for v in p[2:]]), np.array([p[0] for p in pools for _ in range(2)])


def calibrated(model: dict, x: np.ndarray) -> np.ndarray:
    """Calibrated rates, with a trace of the raw score so that order within a pool stays."""
    raw = raw_scores(model, x)
    rate = np.interp(raw, *model["knots"]) if len(model["knots"][0]) else np.full(len(raw), 0.5)
    return np.clip(0.999 * rate + 0.001 / (1 + np.exp(-raw)), 0, 1)


def fit_calibrated(x: np.ndarray, y: np.ndarray) -> dict:
    """Trees on four rows of five, calibration on the fifth (on all where there is none)."""
    part = np.arange(len(y)) % 5 == 4
    if len(set(y[~part].tolist())) < 2:
        share = (y.sum() + 0.5) / (len(y) + 1)
        return {"base": float(np.log(share / (1 - share))), "trees": [], "knots": (np.zeros(1), np.array([share]))}
    model = fit_trees(x[~part], y[~part])
    held = part if part.any() else ~part
    model["knots"] = fit_isotonic(raw_scores(model, x[held]), y[held])
    return model


def toxicity_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fold_mod: int = 4, held_out: int = 2, threshold: float = 0.3, max_labelled: int = MAX_LABELLED, max_lexicon: int = MAX_LEXICON) -> DataFrame:
    """One row for each row of docs: id, held_out, score, predicted.

    Labels of rows with crc32(id) mod fold_mod = held_out are never read. Of the others at most about
    max_labelled, chosen by hash, are split in two. Words and word beginnings that toxic rows of one half
    hold far more often than others make a lexicon (the max_lexicon with most support) for the features of the
    other half, so that trees (4 rows of 5) and calibration see how reliable such a lexicon is on fresh
    rows. The scores use the lexicon of both halves.
    Whole texts are scored (null: empty); nothing but the text is an input. Where the rows that trees learn from are of
    one kind (or none) the score is the share of label 1, for want of anything to tell apart; few rows of both
    kinds are learned from like many. Rows that repeat an id come back as often, and the smallest of their texts
    trains; null ids never train. Equal texts have equal scores.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sample = staged(label_sample(labels, label_col, fold_mod, held_out, max_labelled), "sample")
    chosen = staged(semi_join(rows, sample, "id", sample.count()).groupBy("id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), "labelled")
    half = F.pmod(F.xxhash64("id", F.lit(11)), F.lit(2)).cast("int")

    def count(batches):
        for pdf in batches:
            both = [lexicon_counts(pdf["text"][pdf["label"] == k]) for k in (1, 0)]
            words = list(both[0] | both[1])
            yield pd.DataFrame({"word": words, "half": pdf["half"].iloc[0] if len(pdf) else 0, "t": [both[0].get(w, 0) for w in words], "c": [both[1].get(w, 0) for w in words]})

    labelled = chosen.join(F.broadcast(sample), "id").withColumn("half", half)
    counts = [labelled.where(F.col("half") == k).mapInPandas(count, "word string, half int, t long, c long") for k in (0, 1)]
    sums = [F.sum(F.when(F.col("half") == k, F.col(x)).otherwise(0)).alias(f"{x}{k}") for k in (0, 1) for x in "tc"]
    counted = staged(counts[0].union(counts[1]).groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"), *sums).where("t >= 4"), "words")

    def lexicon(t: str, c: str) -> tuple[frozenset, frozenset]:
        found = [r.word for r in counted.where(f"{t} >= 4 and {t} >= 6 * {c}").orderBy(F.desc(t), "word").limit(max_lexicon).collect()]
        return SEED | {w for w in found if w[-1] != "*"}, frozenset(w[:-1] for w in found if w[-1] == "*")

    def featurise(words, stems):
        def run(batches):
            for batch in batches:
                x = [features(t, words, stems) for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(x, type=pa.list_(pa.float64()))], names=["id", "x"])

        return run

    fresh = [labelled.where(F.col("half") == 1 - k).select("id", "text").mapInArrow(featurise(*lexicon(f"t{k}", f"c{k}")), "id long, x array<double>") for k in (0, 1)]
    train = fresh[0].union(fresh[1]).join(F.broadcast(sample), "id").toPandas().sort_values("id")
    x, y = np.array(train["x"].tolist()).reshape(-1, len(FEATURES)), train["label"].to_numpy().astype(float)
    model = fit_calibrated(x, y)
    words, stems = lexicon("t", "c")

    def score(batches):
        for batch in batches:
            x = np.array([features(t, words, stems) for t in batch.column("text").to_pylist()]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(calibrated(model, x))], names=["id", "score"])

    scored = rows.mapInArrow(score, "id long, score double")
    return scored.select(F.col("id").alias(id_col), (crc_mod(F.col("id"), fold_mod) == held_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
