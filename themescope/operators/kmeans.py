"""K-Means for many starts in shared passes (CLU-3, CLU-4).

All starts — every (k, seed) — are seeded and moved together: a pass reads the vectors
once, works on the centres of all starts that still move, and sends the sums of each
cluster up a tree of tasks.  Starts that have converged leave the passes.

Seeding is k-means++ as an exponential race: the next centre of a seed is the row with the
least −ln(u) / d², d² being the squared distance to the seed's centres so far and u a
uniform number made from the md5 of the row's id, the seed and the step.  That row is drawn
with probability proportional to d², and the draw does not depend on partitions or order.
A start with k centres takes the first k of its seed, so a sweep over k seeds each seed once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.functions.vector import l2_normalize
from themescope.operators.cluster import MAX_CENTRE_CELLS, assign_nearest, centres_literal, collect_small


@dataclass(frozen=True)
class KMeansModel:
    """Centres of one start (row c is cluster c) and the sum of squared distances to them."""
    seed: int
    centres: np.ndarray
    cost: float

    def rows(self) -> list[dict]:
        return [{"cluster": c, "center": v.tolist()} for c, v in enumerate(self.centres)]


def _matrix(column) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _squared_distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (centres * centres).sum(1)[None] - 2.0 * (x @ centres.T)
    return np.maximum(d, 0.0)


def uniform(h: np.ndarray, seed: int, step: int) -> np.ndarray:
    """Numbers in (0, 1) from hashes of ids, a seed and a step."""
    x = h.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + step * 0xD1342543DE82EF95) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def unit_vectors(df: DataFrame, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """(id, h, v): unit vectors with a 60-bit number from the md5 of the id; rows without a vector are left out."""
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    return df.where(F.col(vec_col).isNotNull()).select(
        key.alias("id"), F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long").alias("h"),
        l2_normalize(vec_col).alias("v"))


def blocks(vectors: DataFrame) -> RDD:
    """The vectors as NumPy blocks (ids, h, matrix), one per Arrow batch.

    An iteration is one tree-aggregated job over these; as a query it would be planned anew
    every time, which takes longer than a pass over a small table."""
    def pack(batches):
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(2))
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column(0).to_pylist()], pa.list_(pa.string())), pa.array([batch.column(1).to_numpy().tobytes()]),
                    pa.array([np.ascontiguousarray(x).tobytes()])], ["ids", "h", "v"])

    def unpack(row):
        return row.ids, np.frombuffer(row.h, np.int64), np.frombuffer(row.v).reshape(len(row.ids), -1)

    return vectors.select("id", "h", "v").mapInArrow(pack, "ids array<string>, h binary, v binary").rdd.map(unpack)


def _by_tree(data: RDD, of_block, merge):
    """One value for all blocks: merged in each task, then up a tree; None without blocks."""
    def both(a, b):
        return b if a is None else a if b is None else merge(a, b)
    return data.treeAggregate(None, lambda acc, block: both(acc, of_block(block)), both)


def seed_centres(data: RDD, k: int, seeds: list[int]) -> dict[int, np.ndarray]:
    """The first k centres of every seed, one pass per centre; fewer where the table has
    fewer different vectors."""
    centres: dict[int, np.ndarray] = {}
    for step in range(k):
        open_ = {s: centres.get(s) for s in seeds if len(centres.get(s, ())) == step}

        def race(block, open_=open_, step=step):
            ids, h, x = block
            best = {}
            for seed, c in open_.items():
                weight = np.ones(len(x))
                if c is not None:
                    weight = _squared_distances(x, c).min(1)
                    weight[weight < 1e-12] = 0.0         # a centre's own copies: rounding leaves no weight
                with np.errstate(divide="ignore"):
                    key = -np.log(uniform(h, seed, step)) / weight
                if np.isfinite(least := key.min()):
                    best[seed] = min((least, ids[i], x[i].tolist()) for i in np.flatnonzero(key == least))
            return best

        found = _by_tree(data, race, lambda a, b: {s: min(x for x in (a.get(s), b.get(s)) if x) for s in a.keys() | b.keys()}) or {}
        for s, (_, _, v) in found.items():
            centres[s] = np.concatenate((centres[s], [v])) if step else np.array([v])
    return centres


def _pass(data: RDD, sets: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, float]]:
    """One pass over the vectors: new centres and cost of every start.  An empty cluster
    keeps its centre.  Starts are taken together up to ``MAX_CENTRE_CELLS`` numbers."""
    out, todo = {}, list(sets.items())
    while todo:
        some, cells = {}, 0
        while todo and (not some or cells + todo[0][1].size <= MAX_CENTRE_CELLS):
            start, centres = todo.pop(0)
            if centres.size > MAX_CENTRE_CELLS:
                raise ValueError(f"centres hold {centres.size} values; above {MAX_CENTRE_CELLS}")
            some[start], cells = centres, cells + centres.size
        every = np.concatenate(list(some.values()))
        ends = np.cumsum([len(c) for c in some.values()])

        def sums(block, every=every, ends=ends):
            x = block[2]
            d, rows = _squared_distances(x, every), np.arange(len(x))
            own, cost = np.zeros(d.shape), np.zeros(len(every))
            for lo, hi in zip([0, *ends[:-1]], ends):
                near = lo + d[:, lo:hi].argmin(1)
                own[rows, near] = 1.0
                cost += np.bincount(near, d[rows, near], len(every))
            return own.sum(0), cost, own.T @ x

        n, cost, total = _by_tree(data, sums, lambda a, b: tuple(p + q for p, q in zip(a, b)))
        for (start, centres), lo, hi in zip(some.items(), [0, *ends[:-1]], ends):
            filled = n[lo:hi, None] > 0
            out[start] = (np.where(filled, total[lo:hi] / np.maximum(n[lo:hi, None], 1), centres), float(cost[lo:hi].sum()))
    return out


def fit_starts(data: RDD, starts: list[tuple[int, int]], max_iter: int = 300, tol: float = 1e-4) -> list[KMeansModel]:
    """One model per (k, seed).  A start stops when its centres' squared moves add up to at
    most ``tol`` times the mean variance of a component."""
    seeds = sorted({s for _, s in starts})
    moments = _by_tree(data, lambda b: (len(b[2]), b[2].sum(0), (b[2] ** 2).sum(0)), lambda a, b: tuple(p + q for p, q in zip(a, b)))
    if moments is None:
        raise ValueError("no vectors to cluster")
    n, total, squares = moments
    enough = tol * float((squares / n - (total / n) ** 2).mean())
    chosen = seed_centres(data, max(k for k, _ in starts), seeds)
    sets = {i: chosen[s][:k] for i, (k, s) in enumerate(starts)}
    moving = dict(sets)
    for _ in range(max_iter):
        if not moving:
            break
        for i, (new, _) in _pass(data, moving).items():
            moved = ((new - moving[i]) ** 2).sum()
            sets[i] = moving[i] = new
            if moved <= enough:
                del moving[i]
    cost = _pass(data, sets)
    return [KMeansModel(s, sets[i], cost[i][1]) for i, (_, s) in enumerate(starts)]


def kmeans_fit(df: DataFrame, k: int, n_init: int = 10, seed: int = 42, max_iter: int = 300, tol: float = 1e-4,
               vec_col: str = "embedding", id_col: str = "id") -> tuple[KMeansModel, float]:
    """Best of ``n_init`` starts (seeds seed..seed+n_init-1) on L2-normalised vectors, by
    cost to nine digits (ties → lower seed).  Returns (model, cost).

    Rows without a vector take no part; rows of one id draw the same number; a table with
    fewer than k different vectors has as many clusters as vectors; an empty one is an error.
    """
    data = blocks(unit_vectors(df, vec_col, id_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = fit_starts(data, [(k, seed + i) for i in range(n_init)], max_iter, tol)
    finally:
        data.unpersist()
    best = min(models, key=lambda m: (float(f"{m.cost:.9g}"), m.seed))
    return best, best.cost


def kmeans_labels(df: DataFrame, model: KMeansModel, vec_col: str = "embedding", id_col: str = "id") -> DataFrame:
    """``df`` with its nearest centre as ``cluster``, numbered by size descending, then by
    smallest member id; null without a vector."""
    raw = assign_nearest(df, centres_literal(model.rows()), vec_col, out="raw_cluster").drop("sq_dist")
    raw = raw.withColumn("raw_cluster", F.when(F.col(vec_col).isNotNull(), F.col("raw_cluster")))
    stats = raw.groupBy("raw_cluster").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias("m"))
    rows = collect_small(stats, len(model.centres) + 1, "cluster sizes")
    order = sorted((r for r in rows if r["raw_cluster"] is not None), key=lambda r: (-r["n"], r["m"]))
    mapping = F.create_map(*[x for new, r in enumerate(order) for x in (F.lit(int(r["raw_cluster"])), F.lit(new))])
    return raw.withColumn("cluster", mapping[F.col("raw_cluster")].cast("int")).drop("raw_cluster")


def elbow_curve(df: DataFrame, max_k: int = 10, n_init: int = 10, seed: int = 42, vec_col: str = "embedding",
                max_iter: int = 300, tol: float = 1e-4, id_col: str = "id") -> list[tuple[int, float]]:
    """(k, best cost over ``n_init`` starts) for k = 2..max_k, all starts in the same passes."""
    data = blocks(unit_vectors(df, vec_col, id_col)).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        models = fit_starts(data, [(k, seed + i) for k in range(2, max_k + 1) for i in range(n_init)], max_iter, tol)
    finally:
        data.unpersist()
    return [(k, min(m.cost for m in models[j * n_init:(j + 1) * n_init])) for j, k in enumerate(range(2, max_k + 1))]
