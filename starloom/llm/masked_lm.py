"""Masked pseudo-likelihood scores: a window network in numpy predicts every word from both sides."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import WordHasher, blocks, partitions, staged

#: Words with parameters of their own, at most: the commonest that occur twice or more. Bounds the model's memory, to about
#: 2 * WIDTH * 4 bytes a word in a task; all other words are one unit and share theirs.
MAX_OWN = 4_000_000
#: Numbers a word is embedded in, tokens that are predicted in one step, and the step's length.
WIDTH, BATCH, RATE = 16, 2048, 0.3
#: Units that a prediction is normalised over, in training and in scores: the commonest for certain, others drawn in
#: proportion to their counts and weighted up. A vocabulary of no more units is summed whole.
AGAINST_TRAIN, AGAINST = 48, 96
OFFSETS = np.array([-2, -1, 1, 2])
PAD, RARE = 0, 1
#: Parameter rows that travel together when they are averaged.
BLOCK = 8192


@dataclass
class Lexicon:
    """The units that are predicted: 0 pads (and is never predicted), 1 is all words without parameters of their own,
    the others are words in the order of their counts.

    known: sorted hashes of the words with units of their own, unit: these units; share: of each unit in all
    tokens; inside: log-probability of a word inside unit 1, where all words are equally likely.
    """

    known: np.ndarray
    unit: np.ndarray
    share: np.ndarray
    inside: float

    def units(self, words: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(words), RARE, np.int32)
        at = np.minimum(np.searchsorted(self.known, words), len(self.known) - 1)
        return np.where(self.known[at] == words, self.unit[at], RARE).astype(np.int32)


def lexicon(words: np.ndarray, n: np.ndarray, other_words: int, other_tokens: int) -> Lexicon:
    """words: hashes of the words with units of their own, n: how often they occur; how many words and tokens the rest is."""
    order = np.lexsort((words, -n))
    share = (np.concatenate([[0, other_tokens], n[order]]) / max(1, other_tokens + n.sum())).astype(np.float32)
    unit = np.empty(len(words), np.int32)
    unit[order] = np.arange(2, len(words) + 2)
    by_hash = np.argsort(words)
    return Lexicon(words[by_hash], unit[by_hash], share, -float(np.log(max(1, other_words))))


class Draw:
    """Samples of about k units in proportion to their shares; units of a share of one in k or more are always in."""

    def __init__(self, share: np.ndarray, k: int) -> None:
        order = np.argsort(-share, kind="stable")
        order = order[share[order] > 0]
        q, m = share[order].astype(float), 0
        left = np.append(q[::-1].cumsum()[::-1], 0)
        while m < len(q) and m < k and q[m] * (k - m) >= left[m] * (1 - 1e-9):
            m += 1
        self.sure, self.rest = order[:m], order[m:]
        self.k = k - m if len(self.rest) else 0
        self.rate = self.k / left[m] if self.k else 0.0
        self.ends = np.cumsum(q[m:] * self.rate)
        self.weights = np.log(np.concatenate([q[:m], np.full(self.k, 1 / self.rate if self.k else 1.0)])).astype(np.float32)

    def __call__(self, at: float) -> np.ndarray:
        """The units of one sample, each once; at (0 to 1) says which. weights are theirs."""
        if not self.k:
            return self.sure
        i = np.minimum(np.searchsorted(self.ends, at + np.arange(self.k)), len(self.rest) - 1)
        return np.concatenate([self.sure, self.rest[i]])


def initial_rows(block: int, rows: int = BLOCK, seed: int = 4) -> np.ndarray:
    """The embeddings that the units of a block start from."""
    return np.random.default_rng([seed, block]).standard_normal((BLOCK, WIDTH), dtype=np.float32)[:rows]


def initial_parameters(units: int, seed: int = 4) -> dict[str, np.ndarray]:
    """emb: a row a unit, as context; mix: a matrix for each place of the window; out: a row a unit, as prediction. With out
    at 0 the network gives the shares of the corpus. Fixed by the seed, so a task makes its own."""
    emb = np.empty((units, WIDTH), np.float32)
    for k in range(0, units, BLOCK):
        emb[k : k + BLOCK] = initial_rows(k // BLOCK, min(BLOCK, units - k), seed)
    mix = np.random.default_rng(seed).standard_normal((4, WIDTH, WIDTH), dtype=np.float32) * np.float32(0.5 / WIDTH**0.5)
    return {"emb": emb, "mix": mix, "out": np.zeros((units, WIDTH), np.float32)}


def padded(tokens: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts one after another with two pads before each and after the last; and where the tokens are."""
    place = np.arange(len(tokens)) + 2 * np.repeat(np.arange(1, len(counts) + 1), counts)
    out = np.zeros(len(tokens) + 2 * len(counts) + 2, dtype=np.int32)
    out[place] = tokens
    return out, place


class Groups:
    """The distinct ones of some rows, and which one each is; sums over those that are equal."""

    def __init__(self, index: np.ndarray) -> None:
        n = len(index)
        bits = n.bit_length()
        key = np.sort((index.astype(np.int64) << bits) | np.arange(n))  # sorts faster than argsort
        self.order, key = key & ((1 << bits) - 1), key >> bits
        new = np.concatenate([[True], key[1:] != key[:-1]])
        self.first = np.flatnonzero(new)
        self.rows = key[self.first]
        self.at = np.empty(n, np.int64)
        self.at[self.order] = np.cumsum(new) - 1

    def summed(self, values: np.ndarray) -> np.ndarray:
        """The first two of a row are added for all rows at once, what is left of frequent ones by their runs."""
        count = np.diff(self.first, append=len(self.order))
        out = values.take(self.order.take(self.first), axis=0)
        two = np.flatnonzero(count > 1)
        out[two] += values.take(self.order.take(self.first[two] + 1), axis=0)
        more = np.flatnonzero(count > 2)
        if len(more):
            left = count[more] - 2
            ends = np.cumsum(left)
            rest = np.arange(ends[-1]) + np.repeat(self.first[more] + 2 - ends + left, left)
            out[more] += np.add.reduceat(values.take(self.order.take(rest), axis=0), ends - left, axis=0)
        return out


class Network:
    """Predicts a token from the two before and the two after it: p(u) is the unit's share times exp(out[u] . h), normalised,
    where h comes from the embeddings around."""

    def __init__(self, p: dict[str, np.ndarray], lex: Lexicon) -> None:
        self.p, self.lex = p, lex
        self.share = np.log(np.maximum(lex.share, 1e-30)).astype(np.float32)
        self.slot = np.full(len(lex.share), -1, np.int32)

    def _take(self, name: str, rows: np.ndarray) -> np.ndarray:
        """Some rows in single precision; a model that only scores is held in half."""
        return np.asarray(self.p[name].take(rows, axis=0), np.float32)

    def _hidden(self, e: np.ndarray) -> np.ndarray:
        """h, from the embeddings around side by side."""
        return np.tanh(e @ self.p["mix"].reshape(-1, WIDTH))

    def _odds(self, h: np.ndarray, mine: np.ndarray, share: np.ndarray, other: np.ndarray, weights: np.ndarray, at: np.ndarray):
        """From each token's own parameters and log share, those of the sampled units and which of them a token is (or -1): its score,
        and the parts of p's normaliser that the sampled and its own unit have, and the whole."""
        own = np.einsum("ij,ij->i", mine, h)
        z = h @ other.T
        z += weights
        if (np.abs(other).sum(axis=1) + weights).max() > 60:  # h is between -1 and 1
            np.minimum(z, 60, out=z)
        np.exp(z, out=z)
        twice = np.flatnonzero(at >= 0)
        z[twice, at[twice]] = 0  # it counts by its own share
        first = np.exp(np.minimum(own + share, 60))
        return own, z, first, first + z @ np.ones(len(other), np.float32)

    def train(self, seq: np.ndarray, at: np.ndarray, draw: Draw, sums: dict[str, np.ndarray], rng: np.random.Generator) -> None:
        """Adagrad steps on the log-probability of the tokens at these places; sums: squares of each row's gradients. Rows that a step
        needs are read and written once each."""
        p, mix = self.p, self.p["mix"].reshape(-1, WIDTH)
        for i in range(0, len(at), BATCH):
            a = at[i : i + BATCH]
            n, units = len(a), draw(rng.random())
            near, met = Groups(seq[a[:, None] + OFFSETS].ravel()), Groups(np.concatenate([seq[a], units]))
            emb, out = p["emb"].take(near.rows, axis=0), p["out"].take(met.rows, axis=0)
            e, mine, other = emb.take(near.at, axis=0).reshape(n, -1), out.take(met.at[:n], axis=0), out.take(met.at[n:], axis=0)
            slot = np.full(len(met.rows), -1)
            slot[met.at[n:]] = np.arange(len(units))
            h = self._hidden(e)
            _, z, first, total = self._odds(h, mine, self.share.take(met.rows).take(met.at[:n]), other, draw.weights, slot.take(met.at[:n]))
            pull, total = (first / total - 1)[:, None], total[:, None]
            dx = (pull * mine + z @ other / total) * (1 - h * h)
            back = (dx @ mix.T).reshape(-1, WIDTH)
            g = (e.T @ dx).reshape(sums["mix"].shape)
            sums["mix"] += g * g
            p["mix"] -= RATE * 0.1 * g / np.sqrt(sums["mix"])
            for name, groups, held, values in (("out", met, out, np.concatenate([pull * h, z.T @ (h / total)])), ("emb", near, emb, back)):
                g = groups.summed(values)
                s = sums[name].take(groups.rows) + np.einsum("ij,ij->i", g, g) / WIDTH
                sums[name][groups.rows] = s
                g *= (RATE / np.sqrt(s))[:, None]
                held -= g
                p[name][groups.rows] = held

    def log_probs(self, seq: np.ndarray, at: np.ndarray, draw: Draw) -> np.ndarray:
        """log P(word | two before, two after) at these places, which ascend: embeddings are read once for all windows they are in."""
        units = draw(0.5)
        other = self._take("out", units)
        self.slot[units] = np.arange(len(units), dtype=np.int32)
        out = np.empty(len(at))
        for i in range(0, len(at), BATCH):
            a = at[i : i + BATCH]
            u, start = seq[a], a[0] - 2
            e = self._take("emb", seq[start : a[-1] + 3]).take((a - start)[:, None] + OFFSETS, axis=0).reshape(len(a), -1)
            share = self.share.take(u)
            own, _, _, total = self._odds(self._hidden(e), self._take("out", u), share, other, draw.weights, self.slot.take(u))
            out[i : i + BATCH] = share + own - np.log(total)
            out[i : i + BATCH][u == RARE] += self.lex.inside
        self.slot[units] = -1
        return out


def _count(batches):
    """Occurrences of every word of a partition, by hash."""
    hasher, held, counts = WordHasher(), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    fresh: list[np.ndarray] = []

    def merged():
        h, inverse = np.unique(np.concatenate([held, *fresh]), return_inverse=True)
        return h, np.bincount(inverse, np.concatenate([counts, np.ones(sum(map(len, fresh)), np.int64)]), len(h)).astype(np.int64)

    for batch in batches:
        texts = [t or b"" for t in batch.column("text").to_pylist()]
        for i, j in blocks(texts):
            fresh.append(hasher(texts[i:j])[0])
            if sum(map(len, fresh)) > 1_000_000:
                held, counts = merged()
                fresh = []
            if len(held) > 2_000_000:
                yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["word", "n"])
                held, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    held, counts = merged()
    yield pa.RecordBatch.from_arrays([pa.array(held.view(np.int64)), pa.array(counts)], names=["word", "n"])


def vocabulary(rows: DataFrame, max_own: int = MAX_OWN) -> Lexicon:
    """The lexicon of all words of all texts. Counting covers every word; the driver gets those with units of their own."""
    counts = staged(rows.select("text").mapInArrow(_count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    of_count = counts.groupBy("n").agg(F.count("*").alias("words")).collect()  # as many as there are different counts
    least, own = 2, 0
    for r in sorted(of_count, key=lambda r: -r.n):
        own += r.words if r.n > 1 else 0
        if own > max_own:
            least = r.n + 1
            break
    few = [r for r in of_count if r.n < least]
    named = counts.where(F.col("n") >= least).toArrow()
    return lexicon(named["word"].to_numpy().view(np.uint64), named["n"].to_numpy(), sum(r.words for r in few), sum(r.n * r.words for r in few))


_CHANGES = "block int, row binary, n binary, change binary"


def _mean(batches):
    """The mean change of each parameter row of a block, weighted by n."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for block, row, n, change in zip(*(batch.column(k).to_pylist() for k in ("block", "row", "n", "change"))):
            change = np.frombuffer(change, np.float16 if block >= 0 else np.float32).reshape(len(row) // 2, -1)
            row, n = np.frombuffer(row, np.int16), np.frombuffer(n, np.float32)
            s, w = held.setdefault(block, (np.zeros((BLOCK if block >= 0 else 1, change.shape[1])), np.zeros(BLOCK if block >= 0 else 1)))
            s[row] += change * n[:, None].astype(float)
            w[row] += n
    for block, (s, w) in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "change": pa.array([(s / np.maximum(w, 1)[:, None]).astype(np.float32).tobytes()], pa.binary())})


def _batch(block: int, row: np.ndarray, n: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "row": pa.array([row.astype(np.int16).tobytes()], pa.binary()), "n": pa.array([n.astype(np.float32).tobytes()], pa.binary()), "change": pa.array([change.tobytes()], pa.binary())})


def train(rows: DataFrame, shared_lex, rounds: int = 1) -> dict[str, np.ndarray]:
    """Parameters after rounds in which every partition trains on all positions of its texts and the changes are averaged:
    a unit's weighted by how often the partition met it, the window's by positions. shared_lex is a broadcast lexicon."""
    sc, units = rows.sparkSession.sparkContext, len(shared_lex.value.share)
    held = None
    for turn in range(rounds):
        start = sc.broadcast(held) if held is not None else None

        def local(batches, start=start, turn=turn):
            lex, hasher, n = shared_lex.value, WordHasher(), 0
            p = initial_parameters(units) if start is None else {k: v.astype(np.float32) for k, v in start.value.items()}
            mix = p["mix"].copy()
            net, draw, rng = Network(p, lex), Draw(lex.share, AGAINST_TRAIN), np.random.default_rng(turn)
            sums = {"mix": np.full(mix.shape, 1e-6, np.float32), "emb": np.full(units, 1e-6, np.float32), "out": np.full(units, 1e-6, np.float32)}
            met = np.zeros(units, np.int32)
            for batch in batches:
                texts = [t or b"" for t in batch.column("text").to_pylist()]
                for i, j in blocks(texts):
                    words, counts = hasher(texts[i:j])
                    tokens = lex.units(words)
                    np.add.at(met, tokens, 1)
                    seq, place = padded(tokens, counts)
                    net.train(seq, place[rng.permutation(len(place))], draw, sums, rng)
                    n += len(words)
            if not n:
                return
            yield _batch(-1, np.zeros(1), np.array([n]), p["mix"].ravel() - mix.ravel())
            for k in range(0, units, BLOCK):
                row = np.flatnonzero(met[k : k + BLOCK])
                if len(row):
                    emb = initial_rows(k // BLOCK)[row] if start is None else start.value["emb"][k + row]
                    out = 0 if start is None else start.value["out"][k + row]
                    change = np.concatenate([p["emb"][k + row] - emb, p["out"][k + row] - out], axis=1)
                    yield _batch(k // BLOCK, row, met[k + row], change.astype(np.float16))

        changes = rows.select("text").mapInArrow(local, _CHANGES)
        means = staged(changes.repartition(partitions(rows.sparkSession), "block").mapInArrow(_mean, "block int, change binary"), "parameters")
        if held is None:
            first = initial_parameters(0)
            held = {"mix": first["mix"], "emb": np.empty((units, WIDTH), np.float16), "out": np.zeros((units, WIDTH), np.float16)}
            for k in range(0, units, BLOCK):
                held["emb"][k : k + BLOCK] = initial_rows(k // BLOCK, min(BLOCK, units - k))
        for r in means.toLocalIterator():  # a block at a time
            change = np.frombuffer(r.change, np.float32)
            if r.block < 0:
                held["mix"] = held["mix"] + change.reshape(held["mix"].shape)
                continue
            change = change.reshape(-1, 2 * WIDTH)
            at = slice(r.block * BLOCK, min(units, (r.block + 1) * BLOCK))
            held["emb"][at] += change[: at.stop - at.start, :WIDTH].astype(np.float16)
            held["out"][at] += change[: at.stop - at.start, WIDTH:].astype(np.float16)
        if start is not None:
            start.destroy()
    return held if held is not None else initial_parameters(units)


def masked_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 1, max_own: int = MAX_OWN) -> DataFrame:
    """One row for each row of docs: id, n_tokens, log_prob (the sum over all tokens of the log-probability that
    the network gives each word from the two words on either side), mean_log_prob.

    Tokens are words (A-Z lower-cased); counts, training and scores take every token of every text. The probability is that of the
    word among all distinct words of docs: the share of its unit in the corpus times what the words around say, normalised
    over the vocabulary (over AGAINST units of it, drawn in proportion to their counts and weighted up; all of a small one).
    Words that occur twice or more have units of their own, the max_own commonest at most; any others share one
    unit and are equally likely inside it.

    Null, empty and blank texts have no tokens, log_prob 0 and a null mean. Repeated rows count as often as they come;
    null ids are scored; equal texts have equal scores. An empty table gives no rows. Other columns are not read.
    Each input partition trains its own copy and the copies are averaged, so scores depend a little on how the input is
    split. The model takes about 80 bytes a unit on the driver and in a task that scores, 150 in one that trains: it grows with the vocabulary up to max_own units.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text"))
    sc = docs.sparkSession.sparkContext
    shared_lex = sc.broadcast(vocabulary(rows, max_own))
    model = sc.broadcast(train(rows, shared_lex, rounds))

    def score(batches):
        lex, hasher = shared_lex.value, WordHasher()
        net, draw = Network(model.value, lex), Draw(lex.share, AGAINST)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").to_pylist()]
            n, s = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            for i, j in blocks(texts):
                words, counts = hasher(texts[i:j])
                seq, place = padded(lex.units(words), counts)
                n[i:j] = counts
                s[i:j] = np.bincount(np.repeat(np.arange(j - i), counts), net.log_probs(seq, place, draw), j - i)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(n), pa.array(s)], names=["id", "n_tokens", "log_prob"])

    out = rows.mapInArrow(score, f"id {rows.schema['id'].dataType.simpleString()}, n_tokens long, log_prob double")
    return out.select(F.col("id").alias(id_col), "n_tokens", "log_prob", F.when(F.col("n_tokens") > 0, F.col("log_prob") / F.col("n_tokens")).alias("mean_log_prob"))
