"""Near-duplicate vectors through a robust-pruned flat graph built on overlapping cluster shards.

How it runs:

1. Equal vectors are one class. Centroids are fitted on a bounded sample and every class is dealt to the shards of its
   nearest ones; a shard over MOST is dealt again, by centroids of a sample of its own, with overlap.
2. Each shard builds its graph: the nearest of each node, pruned robustly, and the reverse links. Lists of a node are united.
3. Each shard is searched for all its members at once, from its medoid and from the member itself, and outward over all
   that is within SLACK of the limit. A pair that shares several shards counts in one of them, and a shard returns
   a row for each member (what it is linked with, summed, and a root), so rows do not grow with a group's square.
4. United lists that lead out of a shard are followed in rounds of joins on ids, for pairs that share no shard.
5. Recall is audited against brute force by vector. Under RECALL the search runs again, wider; under LEAST it fails.
"""

from __future__ import annotations

import hashlib
import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from starloom.llm.common import BROADCAST_KEYS, partitions, staged
from starloom.llm.components import components
from starloom.llm.jaccard_join import reach_sql

#: The centroids are fitted on at most about so many vectors (and of a shard that is dealt again, on so many of its own).
MAX_FITTED, MAX_CENTROIDS, FITTED_AGAIN = 20_000, 2_048, 4_000
#: Vectors that one shard holds at about, and over how many it is dealt again.
SHARD, MOST, OVERLAP_AGAIN = 1_500, 12_000, 2
DEGREE, ALPHA, BEAM, POOL, RANDOM = 24, 1.2, 8, 48, 8
#: Cosine below the limit at which the range search still walks on.
SLACK = 0.12
#: Vectors of the recall audit, the recall under which the search runs again, and under which it fails.
AUDITED, RECALL, LEAST = 400, 0.97, 0.9

log = logging.getLogger(__name__)


# ---- inside one shard ----


def _cosines(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a))
    for i in range(0, len(a), 200_000):
        out[i : i + 200_000] = np.einsum("ij,ij->i", x[a[i : i + 200_000]], x[b[i : i + 200_000]])
    return out


def _medoid(x: np.ndarray) -> int:
    return int(np.argmax(x @ x.mean(axis=0)))


def _greedy(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> np.ndarray:
    """Best-first search for all queries at once from the medoid; the nearest nodes each one met."""
    q = len(queries)
    found, sims = np.full((q, beam), -1), np.full((q, beam), -np.inf)
    done = np.ones((q, beam), dtype=bool)
    found[:, 0], sims[:, 0], done[:, 0] = start, x[queries] @ x[start], False
    seen = np.zeros((q, len(x)), dtype=bool)
    seen[:, start] = True
    active = np.arange(q)
    while len(active):
        at = np.where(done[active], -np.inf, sims[active]).argmax(axis=1)
        node = found[active, at]
        done[active, at] = True
        near = graph[node]
        r, c = np.nonzero(near >= 0)
        who, what = active[r], near[r, c]
        fresh = ~seen[who, what]
        who, what, r = who[fresh], what[fresh], r[fresh]
        seen[who, what] = True
        new = np.full((len(active), graph.shape[1]), -1)
        score = np.full(new.shape, -np.inf)
        slot = np.arange(len(r)) - np.searchsorted(r, r)
        new[r, slot], score[r, slot] = what, _cosines(x, queries[who], what)
        both, all_sims = np.concatenate([found[active], new], axis=1), np.concatenate([sims[active], score], axis=1)
        all_done = np.concatenate([done[active], new < 0], axis=1)
        order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
        found[active], sims[active], done[active] = (np.take_along_axis(v, order, axis=1) for v in (both, all_sims, all_done))
        active = active[~done[active].all(axis=1)]
    return found


def _pruned(x: np.ndarray, node: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """Robust pruning: the nearest of a pool stay, but those alpha times nearer to one that stays than to the node."""
    out = np.full((len(node), degree), -1)
    for lo in range(0, len(node), 128):
        p = pool[lo : lo + 128]
        v = x[p]
        sim = np.where((p >= 0) & (p != node[lo : lo + 128, None]), np.einsum("npd,nd->np", v, x[node[lo : lo + 128]]), -np.inf)
        order = np.argsort(-sim, axis=1, kind="stable")
        p, sim, v = np.take_along_axis(p, order, axis=1), np.take_along_axis(sim, order, axis=1), np.take_along_axis(v, order[:, :, None], axis=1)
        twin = np.zeros(p.shape, dtype=bool)
        twin[:, 1:] = p[:, 1:] == p[:, :-1]
        alive = np.isfinite(sim) & ~twin
        far = np.maximum(2 - 2 * np.where(np.isfinite(sim), sim, -1), 0)
        rows = np.arange(len(p))
        for k in range(degree):
            has = alive.any(axis=1)
            if not has.any():
                break
            best = alive.argmax(axis=1)
            out[lo : lo + 128][has, k] = p[rows, best][has]
            between = np.maximum(2 - 2 * np.einsum("npd,nd->np", v, v[rows, best]), 0)
            alive &= ALPHA**2 * between > far
            alive[rows, best] = False
    return out


def _pools(x: np.ndarray, size: int, rng: np.random.Generator) -> np.ndarray:
    """For each row the size nearest others, and some random ones that lead far away."""
    n = len(x)
    near, f = min(size, n - 1), x.astype(np.float32)
    out = np.empty((n, near + RANDOM), np.int64)
    out[:, near:] = rng.integers(0, n, (n, RANDOM))
    for i in range(0, n, 512):
        sim = f[i : i + 512] @ f.T
        sim[np.arange(len(sim)), np.arange(i, i + len(sim))] = -np.inf
        out[i : i + 512, :near] = np.argpartition(-sim, near - 1, axis=1)[:, :near] if near < n - 1 else np.argsort(-sim, axis=1)[:, :near]
    return out


def build_graph(x: np.ndarray, degree: int = DEGREE, seed: int = 1) -> np.ndarray:
    """Neighbours of each row, -1 where there are fewer than degree: the nearest others and some random ones, pruned,
    then the reverse links added and pruned again."""
    n = len(x)
    if n <= 1:
        return np.full((n, 1), -1)
    rng = np.random.default_rng(seed)
    nodes = np.arange(n)
    out = _pruned(x, nodes, _pools(x, POOL, rng), degree)
    a, b = np.nonzero(out >= 0)[0], out[out >= 0]
    order = rng.permutation(len(b))  # of too many reverse links, any are as good
    a, b = a[order], b[order]
    by = np.argsort(b, kind="stable")
    a, b = a[by], b[by]
    slot = np.arange(len(b)) - np.searchsorted(b, b)
    back = np.full((n, 2 * degree), -1)
    fits = slot < 2 * degree
    back[b[fits], slot[fits]] = a[fits]
    return _pruned(x, nodes, np.concatenate([out, back], axis=1), degree)


def range_search(x: np.ndarray, graph: np.ndarray, least: float, beam: int = BEAM, slack: float = SLACK):
    """For some hundred rows at a time: (query, node, cosine) of all nodes with cosine >= least - slack that a greedy search
    from the medoid, and then outward from the query and over such nodes, comes to. Each once, the query left out."""
    n, start = len(x), _medoid(x) if len(x) else 0
    chunk = max(16, min(512, 4_000_000 // max(n, 1)))
    for lo in range(0, n, chunk):
        queries = np.arange(lo, min(n, lo + chunk))
        met = _greedy(x, graph, start, queries, beam)
        seen = np.zeros((len(queries), n), dtype=bool)
        r, c = np.nonzero(met >= 0)
        code = np.unique(np.concatenate([r * n + met[r, c], np.arange(len(queries)) * n + queries]))
        q, node, out = code // n, code % n, []
        while len(q):
            seen[q, node] = True
            cos = _cosines(x, queries[q], node)
            go = cos >= least - slack
            q, node = q[go], node[go]
            out.append((queries[q], node, cos[go]))
            q, node = np.repeat(q, graph.shape[1]), graph[node].ravel()
            fresh = (node >= 0) & ~seen[q, node]
            code = np.unique(q[fresh] * n + node[fresh])
            q, node = code // n, code % n
        q, node, cos = (np.concatenate(v) for v in zip(*out))
        other = q != node
        yield q[other], node[other], cos[other]


def _merged(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Roots (the smallest member of each component) after these links."""
    while True:
        ra, rb = root[a], root[b]
        if (ra == rb).all():
            return root
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while (root != root[root]).any():
            root = root[root]


# ---- over all shards ----


def unit_vector(v) -> np.ndarray | None:
    """v scaled to length one in double precision, or None if it has no direction. Its largest component is scaled to one first,
    so that no finite vector overflows or vanishes."""
    if not v or any(c is None for c in v):
        return None
    x = np.array(v, dtype=np.float64)
    top = np.abs(x).max()
    if not np.isfinite(top) or top == 0 or np.isnan(x).any():
        return None
    x = x / top
    return x / np.sqrt(x @ x)


def _usable(batches):
    """Unit vectors and a digest of each usable vector."""
    for batch in batches:
        ids, digests, units = [], [], []
        for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()):
            x = unit_vector(v)
            if x is not None:
                ids.append(i)
                digests.append(hashlib.blake2b(np.array(v, dtype=np.float64).tobytes(), digest_size=16).hexdigest())
                units.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(ids, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(units, type=pa.list_(pa.float64()))], names=["id", "digest", "v"])


def _unusable(batches):
    for batch in batches:
        kept = [i for i, v in zip(batch.column("id").to_pylist(), batch.column("v").to_pylist()) if i is None or unit_vector(v) is None]
        yield pa.RecordBatch.from_arrays([pa.array(kept, type=pa.int64())], names=["id"])


def _centroids(x: np.ndarray, k: int, seed: int = 2) -> np.ndarray:
    c = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)]
    for _ in range(6):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def _rows(column) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.array(column.flatten().to_numpy(zero_copy_only=False)).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _first_deal(reps: DataFrame, n: int, overlap: int) -> DataFrame:
    """c, shard of each vector in the shards of its nearest centroids, which a bounded sample gives."""
    sample = reps.where(F.pmod(F.xxhash64("c"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, MAX_FITTED / max(n, 1)))).select("v").limit(2 * MAX_FITTED).toArrow().column("v")
    dims: dict[int, list] = {}
    for v in sample.to_pylist():
        dims.setdefault(len(v), []).append(v)
    k = min(MAX_CENTROIDS, max(1, -(-n * overlap // SHARD)))
    centroids = {d: _centroids(np.array(x), k) for d, x in dims.items()}

    def assign(batches):
        base, first = {}, 0
        for dim in sorted(centroids):
            base[dim], first = first, first + len(centroids[dim])
        for batch in batches:
            shards = []
            for v in batch.column("v").to_pylist():
                c = centroids.get(len(v))
                shards.append([first + len(v)] if c is None else (base[len(v)] + np.argsort(-(c @ np.array(v)), kind="stable")[: min(overlap, k)]).tolist())
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(shards, type=pa.list_(pa.int64()))], names=["c", "shards"])

    rows = reps.select("c", "v").mapInArrow(assign, "c long, shards array<long>")
    return rows.select("c", F.explode("shards").alias("shard"))


def _dealt_again(reps: DataFrame, large: DataFrame, rows: DataFrame) -> DataFrame:
    """c, shard for the rows(c, shard) of large(shard, n): by centroids of a sample of each shard, in salted groups of at
    most about MOST rows, so that no task holds a large shard."""
    salts = F.ceil(F.col("n") / MOST).cast("int")
    held = staged(rows.join(F.broadcast(large) if large.count() <= BROADCAST_KEYS else large, "shard").join(reps.select("c", "v"), "c"), "large")

    def fit(table: pa.Table) -> pa.Table:
        n = table.column("n")[0].as_py()
        c = _centroids(_rows(table.column("v")), -(-n * OVERLAP_AGAIN // SHARD))
        return pa.table({"shard": table.column("shard").slice(0, 1), "n": table.column("n").slice(0, 1), "centroids": pa.array([c.tobytes()], pa.binary())})

    def assign(left: pa.Table, right: pa.Table) -> pa.Table:
        if not len(left):
            return pa.table({"c": pa.array([], pa.int64()), "shard": pa.array([], pa.int64())})
        x = _rows(left.column("v"))
        c = np.frombuffer(right.column("centroids")[0].as_py(), np.float64).reshape(-1, x.shape[1])
        near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP_AGAIN]
        shard = left.column("shard")[0].as_py()
        return pa.table({"c": pa.array(np.repeat(left.column("c").to_numpy(), near.shape[1])), "shard": pa.array([hash((shard, k)) for k in near.ravel().tolist()], pa.int64())})

    sample = held.where(F.pmod(F.xxhash64("c", F.lit(3)), F.lit(1_000_000)) < 1_000_000 * F.least(F.lit(1.0), FITTED_AGAIN / F.col("n")))
    fitted = sample.groupBy("shard").applyInArrow(fit, "shard long, n long, centroids binary")
    spread = fitted.select("shard", "centroids", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"))
    dealt = held.withColumn("salt", F.pmod(F.xxhash64("c", F.lit(4)), salts).cast("int"))
    return dealt.groupBy("shard", "salt").cogroup(spread.groupBy("shard", "salt")).applyInArrow(assign, "c long, shard long")


def deal(reps: DataFrame, n: int, overlap: int, rounds: int = 8) -> DataFrame:
    """c, shards (sorted): overlapping cluster shards of about SHARD members. Those that rounds of dealing leave over MOST
    (vectors that hardly differ) are searched as they are, in blocks."""
    rows = staged(_first_deal(reps, n, overlap), "assigned")
    for _ in range(rounds):
        large = staged(rows.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > MOST), "crowded")
        if large.isEmpty():
            break
        few = F.broadcast(large.select("shard")) if large.count() <= BROADCAST_KEYS else large.select("shard")
        again = _dealt_again(reps, large, rows.join(few, "shard", "left_semi"))
        rows = staged(rows.join(few, "shard", "left_anti").unionByName(again), "assigned")
    return rows.groupBy("c").agg(F.sort_array(F.collect_set("shard")).alias("shards"))  # at most overlap times OVERLAP_AGAIN a round


def _adjacency(least: float):
    def run(table: pa.Table) -> pa.Table:
        c, x = table.column("c").to_numpy(), _rows(table.column("v"))
        order = np.argsort(c)
        c, x = c[order], x[order]
        near, walk = [], []
        for i, g in enumerate(build_graph(x)):
            g = g[g >= 0]
            near.append(c[g])
            walk.append(c[g[x[g] @ x[i] >= least - SLACK]])
        return pa.table({"c": pa.array(c), "near": pa.array(near, pa.list_(pa.int64())), "walk": pa.array(walk, pa.list_(pa.int64()))})

    return run


_FOUND = pa.schema([("c", pa.int64()), ("others", pa.int64()), ("root", pa.int64()), ("out", pa.list_(pa.int64()))])


def _padded(lists: list, width: int) -> np.ndarray:
    """Lists of longs as the rows of a matrix, filled up with -1 - row so that no two rows share a fill."""
    out = np.repeat(-1 - np.arange(len(lists), dtype=np.int64)[:, None], width, axis=1)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


def _share(a: np.ndarray, b: np.ndarray, base: int = -(1 << 62)) -> np.ndarray:
    """The smallest entry that a row of a shares with the same row of b; base where there is none."""
    same = a[:, :, None] == b[:, None, :]
    return np.where(same.any(axis=(1, 2)), np.where(same.any(axis=2), a, np.iinfo(np.int64).max).min(axis=1), base)


def _searcher(least: float, beam: int):
    """Of each member of a shard: the sizes of the classes it is linked with (pairs that this shard counts), its root, and the
    vectors outside all its shards that lists of what it came to lead to."""

    def run(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("c").to_numpy())
        table = table.take(pa.array(order))
        c, m, x = table.column("c").to_numpy(), table.column("m").to_numpy(), _rows(table.column("v"))
        shard, shards = table.column("shard")[0].as_py(), table.column("shards").to_pylist()
        near = [np.array(r or [], dtype=np.int64) for r in table.column("near").to_pylist()]
        at = [np.searchsorted(c, r) for r in near]
        at = [p[(p < len(c)) & (c[np.minimum(p, len(c) - 1)] == r)] for p, r in zip(at, near)]
        graph = np.full((len(c), max([1, *map(len, at)])), -1)
        for k, p in enumerate(at):
            graph[k, : len(p)] = p
        width = max(map(len, shards))
        mine = _padded(shards, width)
        exits = [(k, f["w"], f["s"]) for k, r in enumerate(table.column("exits").to_pylist()) for f in r or []]
        gate = np.array([e[0] for e in exits], dtype=np.int64)
        ends, which = np.unique(np.array([e[1] for e in exits], dtype=np.int64), return_inverse=True)
        theirs = _padded([exits[i][2] for i in np.unique(which, return_index=True)[1]] if exits else [], max([width, *(len(e[2]) for e in exits)]))
        of_gate = np.searchsorted(gate, np.arange(len(c) + 1))
        others, root, out = np.zeros(len(c), np.int64), np.arange(len(c)), [[] for _ in c]
        for q, node, cos in range_search(x, graph, least, beam):
            if len(exits):
                q2, v2 = np.concatenate([q, np.unique(q)]), np.concatenate([node, np.unique(q)])
                n = of_gate[v2 + 1] - of_gate[v2]
                way = np.repeat(of_gate[v2] - (np.cumsum(n) - n), n) + np.arange(n.sum())
                code = np.unique(np.repeat(q2, n) * len(ends) + which[way])
                for i in range(0, len(code), 500_000):
                    a, b = code[i : i + 500_000] // len(ends), code[i : i + 500_000] % len(ends)
                    apart = _share(mine[a], theirs[b]) == -(1 << 62)
                    for u, w in zip(a[apart].tolist(), ends[b[apart]].tolist()):
                        out[u].append(w)
            up = cos >= least
            q, node = q[up], node[up]
            root = _merged(root, q, node)
            for i in range(0, len(q), 500_000):
                a, b = q[i : i + 500_000], node[i : i + 500_000]
                if width > 1:
                    own = _share(mine[a], mine[b]) == shard
                    a, b = a[own], b[own]
                others += np.bincount(a, m[b], len(c)).astype(np.int64)
        return pa.table([pa.array(c), pa.array(others), pa.array(c[root]), pa.array(out, type=pa.list_(pa.int64()))], schema=_FOUND)

    return run


def _with_cosines(batches):
    for batch in batches:
        p, q = _rows(batch.column("p")), _rows(batch.column("q"))
        cos = np.einsum("ij,ij->i", p, q) if len(batch) else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("w"), pa.array(cos)], names=["u", "w", "cos"])


def _across(pairs: DataFrame, reps: DataFrame, homes: DataFrame, walks: DataFrame, least: float, rounds: int = 64) -> DataFrame:
    """Links (u, w) between vectors that share no shard: pairs(u, w) and what the united lists lead to from them, round
    by round, until nothing within SLACK of the limit is new; an error if that takes more than rounds."""
    a, b = reps.select(F.col("c").alias("u"), F.col("v").alias("p")), reps.select(F.col("c").alias("w"), F.col("v").alias("q"))
    ordered = lambda df: df.select(F.least("u", "w").alias("u"), F.greatest("u", "w").alias("w")).where("u <> w").distinct()
    fresh = staged(ordered(pairs), "outside")
    done = None
    for _ in range(rounds):
        if fresh.isEmpty():
            break
        same = fresh.join(a, "u").join(b, "w").where(F.size("p") == F.size("q")).select("u", "w", "p", "q")
        tested = staged(same.mapInArrow(_with_cosines, "u long, w long, cos double"), "tested")
        done = tested if done is None else done.unionByName(tested)
        on = tested.where(F.col("cos") >= least - SLACK)
        both = on.select("u", "w").unionByName(on.select(F.col("w").alias("u"), F.col("u").alias("w")))
        step = ordered(both.join(walks.withColumnRenamed("c", "w"), "w").select("u", F.explode("walk").alias("w"))).join(done.select("u", "w"), ["u", "w"], "left_anti")
        hu, hw = homes.select(F.col("c").alias("u"), F.col("shards").alias("hu")), homes.select(F.col("c").alias("w"), F.col("shards").alias("hw"))
        fresh = staged(step.join(hu, "u").join(hw, "w").where(~F.arrays_overlap("hu", "hw")).select("u", "w"), "outside")
    else:
        if not fresh.isEmpty():
            raise RuntimeError(f"links between shards did not settle in {rounds} rounds")
    return fresh.limit(0) if done is None else done.where(F.col("cos") >= least).select("u", "w")


def search(reps: DataFrame, n: int, least: float, overlap: int, beam: int) -> tuple[DataFrame, DataFrame]:
    """Of reps(c, m, v): (c, others) what each is linked with, by class size, and (u, v) links that join its components."""
    tasks = max(partitions(reps.sparkSession), -(-n * overlap // SHARD))
    homes = staged(deal(reps, n, overlap), "homes")
    dealt = staged(reps.select("c", "m", "v").join(homes, "c").withColumn("shard", F.explode("shards")), "shards")
    lists = dealt.select("shard", "c", "v").repartition(tasks, "shard").groupBy("shard").applyInArrow(_adjacency(least), "c long, near array<long>, walk array<long>")
    united = lambda x: F.array_distinct(F.flatten(F.collect_list(x))).alias(x)  # noqa: E731  DEGREE links a shard and vector
    graph = staged(lists.groupBy("c").agg(united("near"), united("walk")), "graph")
    walks = graph.where(F.size("walk") > 0).select("c", "walk")
    steps = walks.select("c", F.explode("walk").alias("w")).join(homes, "c")
    exits = steps.join(homes.select(F.col("c").alias("w"), F.col("shards").alias("s")), "w").where(F.col("shards") != F.col("s"))
    exits = exits.groupBy("c").agg(F.collect_list(F.struct("w", "s")).alias("exits"))  # DEGREE links a shard and vector
    joined = dealt.join(graph.select("c", "near"), "c").join(exits, "c", "left").repartition(tasks, "shard")
    found = staged(joined.groupBy("shard").applyInArrow(_searcher(least, beam), "c long, others long, root long, out array<long>"), "found")
    across = staged(_across(found.select(F.col("c").alias("u"), F.explode("out").alias("w")), reps, homes, walks, least), "across")
    size = lambda x: reps.select(F.col("c").alias(x), "m")
    more = across.join(size("w"), "w").select(F.col("u").alias("c"), F.col("m").alias("others")).unionByName(across.join(size("u"), "u").select(F.col("w").alias("c"), F.col("m").alias("others")))
    others = found.select("c", "others").unionByName(more).groupBy("c").agg(F.sum("others").alias("others"))
    links = found.where("root <> c").select(F.col("c").alias("u"), F.col("root").alias("v")).unionByName(across.toDF("u", "v"))
    return staged(others, "others"), staged(links, "links")


def audit(reps: DataFrame, others: DataFrame, n: int, least: float) -> float | None:
    """The mean over audited vectors of the share of their links that were found, against brute force over all vectors; None
    if none of them has a link. Audited are AUDITED vectors of all, chosen by hash, and as many of those with
    links; the lower mean of the two counts. Every link found is a true one, so sums are enough to tell."""
    by_hash = lambda df, size: df.where(F.pmod(F.xxhash64("c", F.lit(9)), F.lit(1_000_000)) <= int(1_000_000 * min(1.0, AUDITED / max(size, 1)))).limit(2 * AUDITED)
    linked = others.where("others > 0").select("c")
    n_linked = linked.count()
    drawn = by_hash(reps.select("c"), n).withColumn("kind", F.lit(0)).unionByName(by_hash(linked, n_linked).withColumn("kind", F.lit(1)))
    chosen = drawn.groupBy("c").agg(F.collect_set("kind").alias("kinds")).join(reps.select("c", "v"), "c").join(others, "c").collect()  # 4 * AUDITED vectors at most
    by_dim: dict[int, list] = {}
    for r in chosen:
        by_dim.setdefault(len(r.v), []).append(r)
    queries = {d: (np.array([r.c for r in rs]), np.array([r.v for r in rs])) for d, rs in by_dim.items()}

    def brute(batches):
        total = {d: np.zeros(len(ids), np.int64) for d, (ids, _) in queries.items()}
        for batch in batches:
            size = np.diff(batch.column("v").offsets.to_numpy())
            for d, (ids, q) in queries.items():
                at = np.flatnonzero(size == d)
                if len(at):
                    part = batch.take(pa.array(at))
                    near = (q @ _rows(part.column("v")).T >= least) & (ids[:, None] != part.column("c").to_numpy()[None, :])
                    total[d] += near @ part.column("m").to_numpy()
        for d, (ids, _) in queries.items():
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total[d])], names=["c", "true"])

    true = {r.c: r.true for r in reps.select("c", "m", "v").mapInArrow(brute, "c long, true long").groupBy("c").agg(F.sum("true").alias("true")).collect()}
    means = []
    for kind in (0, 1):
        shares = [min(1.0, r.others / true[r.c]) for r in chosen if kind in r.kinds and true.get(r.c)]
        means += [sum(shares) / len(shares)] if shares else []
    return min(means) if means else None


def audited_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 3, beam: int = BEAM) -> tuple[DataFrame, float | None]:
    """near_vectors and its audited recall (None where the audit met no link)."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v"))
    usable = staged(rows.where("id is not null").mapInArrow(_usable, "id long, digest string, v array<double>"), "vectors")
    reps = staged(usable.groupBy("digest").agg(F.min("id").alias("c"), F.count("*").alias("m"), F.first("v").alias("v")), "classes")
    # an id that several vectors share names several classes; inside, each has a number of its own
    named = staged(reps.withColumn("name", F.col("c")).withColumn("c", F.xxhash64("digest")), "named")
    n = named.count()
    for attempt in range(3):
        others, links = search(named, n, least, overlap << attempt, beam << attempt)
        recall = audit(named, others, n, least)
        log.info("near_vectors: %d classes, overlap %d, audited recall %s", n, overlap << attempt, recall)
        if recall is None or recall >= RECALL:
            break
    if recall is not None and recall < LEAST:
        raise RuntimeError(f"the audited recall of near vectors is {recall:.3f}; pass a larger overlap or beam")
    roots = components(links)
    classes = named.join(others, "c", "left").join(roots, named["c"] == roots["node"], "left")
    classes = classes.select("digest", "name", (F.col("m") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "c").alias("root"))
    least_id = classes.groupBy("root").agg(F.min("name").alias("component_id"))
    classes = staged(classes.join(least_id, "root").select("digest", "n_links", "component_id"), "roots")
    members = usable.select("id", "digest").join(F.broadcast(classes) if n <= BROADCAST_KEYS // 8 else classes, "digest").select("id", "n_links", "component_id")
    missing = rows.mapInArrow(_unusable, "id long")
    out = members.union(missing.select("id", F.lit(0).cast("long"), F.col("id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept")), recall


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = 0.95, overlap: int = 3, beam: int = BEAM) -> DataFrame:
    """One row for each row of vectors: id, n_links, component_id, kept.

    Cosines are in double precision. Null, empty and zero vectors and those with null or non-finite components
    link with nothing, nor do vectors of different lengths; finite ones link however large or small. Equal vectors are one
    class and search once; a member's n_links counts the rest of its class and all members of linked classes. kept is
    id = component_id. Rows with a null id come back without links; rows that repeat an id and its vector count as links
    of each other; rows that share an id but not a vector each have the links of their own. An empty table gives no rows.

    Every vector is indexed, and every link is verified by its cosine. Recall is audited by brute force: under RECALL the
    search runs again with twice the overlap and beam, twice at most; if it is then under LEAST, this fails.
    """
    return audited_vectors(vectors, id_col, vector_col, least, overlap, beam)[0]


def vectors_sql(embeddings: str = "embeddings", least: float = 0.95) -> str:
    """Links and components by brute force, as DuckDB SQL, for vectors of one length."""
    return f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM {embeddings}),
ok AS (SELECT id, v FROM v WHERE v IS NOT NULL AND len(list_filter(v, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(v, v) > 0),
links AS (SELECT a.id AS x, b.id AS y FROM ok a JOIN ok b ON a.id < b.id WHERE list_cosine_similarity(a.v, b.v) >= {least}),
{reach_sql("links", "v")},
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id)
SELECT v.id AS vec_id, (SELECT count(*) FROM both_ways WHERE x = v.id) AS n_links, root AS component_id, v.id = root AS kept FROM v JOIN roots USING (id)"""
