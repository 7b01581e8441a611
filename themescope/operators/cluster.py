"""Centres, nearest-centre assignment, Lloyd step, elbow point, silhouettes (exact
Euclidean and scalable squared).  Whole K-Means fits are in ``kmeans``."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.functions.vector import as_double_array, dot, l2_normalize, squared_distance
from themescope.operators import blocks

# Upper bound on k·d inlined into a plan as a literal (8 bytes each): 8 MB.
MAX_CENTRE_CELLS = 1_000_000
MAX_CENTRES = 4096


def centroids_from_labels(df: DataFrame, label_col: str = "cluster",
                          vec_col: str = "embedding") -> DataFrame:
    """Mean vector per label as (cluster INT, center ARRAY<DOUBLE>).

    ``Summarizer.mean`` is one partial/final aggregate over dense vectors, so
    a label holding a third of all rows is pre-aggregated in every task.
    """
    v = df.select(F.col(label_col).cast("int").alias("cluster"),
                  array_to_vector(as_double_array(vec_col)).alias("_v"))
    m = v.groupBy("cluster").agg(Summarizer.mean(F.col("_v")).alias("_m"))
    return m.select("cluster", vector_to_array("_m", "float64").alias("center"))


def collect_small(df: DataFrame, max_rows: int, what: str = "table") -> list:
    """Collect a result whose row count is bounded by a model parameter (k),
    refusing — instead of silently truncating — when the bound is broken."""
    rows = df.limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"{what} has more than {max_rows} rows; refusing to inline it")
    return rows


def constant_rows(rows: list[dict], ddl: str) -> Column:
    """k small rows as one constant ``ARRAY<STRUCT<…>>`` expression.

    Built as ``from_json`` of a literal string, which the optimizer folds
    once into a literal — a single expression instead of one column object
    per number.  Callers bound ``rows`` (see ``collect_small``).
    """
    payload = json.dumps([{k: (float(v) if isinstance(v, float) else v) for k, v in r.items()} for r in rows])
    return F.from_json(F.lit(payload), f"array<struct<{ddl}>>")


def centres_literal(centroids: DataFrame | list, max_k: int = MAX_CENTRES) -> Column:
    """Centres as one constant ``ARRAY<STRUCT<cluster INT, center ARRAY<DOUBLE>>>``.

    k × d is checked against ``MAX_CENTRE_CELLS``; the constant then ships with
    the task closure, so assignment needs no join and works unchanged on a
    stream.
    """
    rows = centroids if isinstance(centroids, list) else collect_small(centroids, max_k, "centroids")
    cells = sum(len(r["center"]) for r in rows)
    if cells > MAX_CENTRE_CELLS:
        raise ValueError(f"centres hold {cells} values; above {MAX_CENTRE_CELLS}")
    items = [{"cluster": int(r["cluster"]), "center": [float(x) for x in r["center"]]}
             for r in sorted(rows, key=lambda r: r["cluster"])]
    return constant_rows(items, "cluster:int,center:array<double>")


def assign_nearest(df: DataFrame, centres: Column, vec_col: str = "embedding",
                   normalize: bool = True, out: str = "cluster") -> DataFrame:
    """Nearest centre by Euclidean distance; ties go to the lowest cluster id.

    Adds ``out`` and ``sq_dist``.  ``array_min`` over (distance, id) structs
    gives the tie rule for free.
    """
    v = l2_normalize(vec_col) if normalize else as_double_array(vec_col)
    best = F.array_min(F.transform(centres, lambda c: F.struct(
        squared_distance(F.col("_vec"), c["center"]).alias("d2"), c["cluster"].alias("cluster"))))
    return (df.withColumn("_vec", v).withColumn("_best", best)
            .withColumn(out, F.col("_best.cluster")).withColumn("sq_dist", F.col("_best.d2"))
            .drop("_best", "_vec"))


def lloyd_step(df: DataFrame, centres: Column, vec_col: str = "embedding",
               normalize: bool = True) -> DataFrame:
    """One Lloyd iteration: assign to ``centres`` then recompute means."""
    assigned = assign_nearest(df, centres, vec_col, normalize)
    vec = l2_normalize(vec_col) if normalize else as_double_array(vec_col)
    return centroids_from_labels(assigned.withColumn("_nv", vec), "cluster", "_nv")


def lloyd_steps(df: DataFrame, start: DataFrame, steps: int, vec_col: str = "embedding",
                normalize: bool = True, max_k: int = MAX_CENTRES) -> list:
    """Run ``steps`` Lloyd iterations from given centres; returns the final
    centre rows (k rows, collected after each step)."""
    rows = collect_small(start, max_k, "centroids")
    for _ in range(steps):
        rows = collect_small(lloyd_step(df, centres_literal(rows), vec_col, normalize), max_k, "centroids")
    return rows


def inertia(assigned: DataFrame) -> DataFrame:
    return assigned.agg(F.sum("sq_dist").alias("inertia"), F.count(F.lit(1)).alias("n"))


def elbow_k(curve: list[tuple[int, float]]) -> int:
    """Bend of the curve: the k farthest from the chord between its ends (ours)."""
    if len(curve) < 3:
        return curve[0][0]
    (k0, i0), (k1, i1) = curve[0], curve[-1]
    def gap(k, i):
        return abs((i1 - i0) * k - (k1 - k0) * i + k1 * i0 - i1 * k0)
    return max(curve, key=lambda p: gap(*p))[0]


# --- silhouettes -----------------------------------------------------------

SIDE_ROWS = 256                # rows that meet eight times as many: distances that stay in the cache
_SIL_SCHEMA = "id string, cluster int, other int, dist_sum double, cnt long"


def _by_cluster(block, normalize: bool):
    """(vectors, rows without one, ids, clusters, code of each row, clusters by code), rows sorted by cluster."""
    v = blocks.vectors_of(block)
    if normalize:
        n = np.sqrt((v * v).sum(1, keepdims=True))
        v = v / np.where(n > 0, n, 1.0)
    cluster = block["cluster"].values
    order = pc.array_sort_indices(cluster)
    names = pc.unique(cluster.take(order))
    cluster = cluster.take(order)
    lost = np.isnan(v).any(1)[order.to_numpy()]
    v = np.where(np.isnan(v).any(1, keepdims=True), 0.0, v)[order.to_numpy()]
    code = pc.index_in(cluster, names).to_numpy()
    return v, lost, block["id"].values.take(order), cluster, code, names


def _silhouette_kernel(normalize: bool):
    def sums_of(side, sums, met):
        _, lost, ids, cluster, _, _ = side
        names, size = met[5], np.bincount(met[4], minlength=len(met[5]))
        n, c = sums.shape
        for s, e in blocks.tiles(n, c):
            rows = pa.array(np.repeat(np.arange(s, e), c))
            yield pa.RecordBatch.from_arrays(
                [ids.take(rows), cluster.take(rows), names.take(pa.array(np.tile(np.arange(c), e - s))),
                 pa.array(sums[s:e].ravel(), mask=np.repeat(lost[s:e], c)), pa.array(np.tile(size, e - s))],
                ["id", "cluster", "other", "dist_sum", "cnt"])

    def run(left, right, same):
        a, b = _by_cluster(left, normalize), _by_cluster(right, normalize)
        to_b, to_a = np.zeros((len(a[0]), len(b[5]))), np.zeros((len(b[0]), len(a[5])))
        runs = lambda code: np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        for s in range(0, len(a[0]), SIDE_ROWS):
            x, xa = a[0][s:s + SIDE_ROWS], a[4][s:s + SIDE_ROWS]
            for t in range(0, len(b[0]), 8 * SIDE_ROWS):
                y, yb = b[0][t:t + 8 * SIDE_ROWS], b[4][t:t + 8 * SIDE_ROWS]
                d = blocks.pair_distances(x, y)
                d[a[1][s:s + SIDE_ROWS]] = 0.0
                d[:, b[1][t:t + 8 * SIDE_ROWS]] = 0.0
                first = runs(yb)
                to_b[s:s + len(x), yb[first]] += np.add.reduceat(d, first, axis=1)
                if not same:
                    first = runs(xa)
                    to_a[t:t + len(y), xa[first]] += np.add.reduceat(d, first, axis=0).T
        yield from sums_of(a, to_b, b)
        if not same:
            yield from sums_of(b, to_a, a)
    return run


def silhouette_points(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding",
                      id_col: str = "id", normalize: bool = True,
                      block_rows: int | None = None) -> DataFrame:
    """Exact per-point silhouette with plain Euclidean distance.

    s = (b − a) / max(a, b); a = mean distance to the rest of its own
    cluster, b = smallest mean distance to another cluster; singletons and points
    without a cluster or a vector get 0.  Quadratic by definition: computed over block pairs (see ``blocks``),
    emitting per (point, cluster) sums that a partial aggregate folds.
    """
    pts = df.select(F.col(id_col).cast("string").alias("id"),
                    F.col(cluster_col).cast("int").alias("cluster"), F.col(vec_col).alias("vec"))
    nb, dim = blocks.plan_blocks(pts, "vec", block_rows)
    packed = blocks.packed(pts, blocks.block_of(nb), dim, {"id": "string", "cluster": "int"})
    sums = (blocks.met_blocks(packed, nb, _silhouette_kernel(normalize), _SIL_SCHEMA)
            .groupBy("id", "cluster", "other")
            .agg(F.sum("dist_sum").alias("s"), F.sum("cnt").alias("c")))
    own = F.col("other") == F.col("cluster")
    per_point = sums.groupBy("id", "cluster").agg(
        F.max(F.when(own, F.col("c"))).alias("n_own"),
        F.max(F.when(own, F.try_divide(F.col("s"), F.col("c") - 1))).alias("a"),
        F.min(F.when(~own, F.col("s") / F.col("c"))).alias("b"))
    s = (F.when((F.col("n_own") <= 1) | F.col("b").isNull(), F.lit(0.0))
         .otherwise(F.coalesce(F.try_divide(F.col("b") - F.col("a"),
                                            F.greatest("a", "b")), F.lit(0.0))))
    return per_point.select("id", "cluster", s.alias("silhouette"))


def silhouette_exact(df: DataFrame, **kw) -> DataFrame:
    """Mean exact silhouette (one row: silhouette, n)."""
    p = silhouette_points(df, **kw)
    return p.agg(F.avg("silhouette").alias("silhouette"), F.count(F.lit(1)).alias("n"))


def silhouette_squared(df: DataFrame, cluster_col: str = "cluster", vec_col: str = "embedding",
                       normalize: bool = True, max_k: int = MAX_CENTRES) -> DataFrame:
    """Silhouette with *squared* Euclidean distance in O(n·k).

    Same definition as Spark's ``ClusteringEvaluator(distanceMeasure=
    'squaredEuclidean')``: per-cluster (Σx, Σ‖x‖², n) are aggregated once,
    inlined as a k-row constant, and each point's mean squared distance to
    every cluster follows from them.  Never passed off as the exact metric.
    """
    vec = l2_normalize(vec_col) if normalize else as_double_array(vec_col)
    pts = df.select(F.col(cluster_col).cast("int").alias("cluster"), vec.alias("v"))
    pts = pts.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    stats = pts.groupBy("cluster").agg(
        Summarizer.sum(array_to_vector("v")).alias("_s"), F.sum("sq").alias("psi"),
        F.count(F.lit(1)).alias("n"))
    rows = collect_small(stats.select("cluster", vector_to_array("_s").alias("s"), "psi", "n"),
                         max_k, "cluster statistics")
    if sum(len(r["s"]) for r in rows) > MAX_CENTRE_CELLS:
        raise ValueError("cluster statistics too large to inline")
    lit = constant_rows([{"cluster": int(r["cluster"]), "s": [float(x) for x in r["s"]],
                          "psi": float(r["psi"]), "n": int(r["n"])} for r in rows],
                        "cluster:int,s:array<double>,psi:double,n:bigint")
    dists = F.transform(lit, lambda c: F.struct(
        c["cluster"].alias("cluster"), c["n"].alias("n"),
        (F.col("sq") + c["psi"] / c["n"] - 2 * dot(F.col("v"), c["s"]) / c["n"]).alias("d")))
    p = pts.withColumn("_d", dists)
    own = F.filter("_d", lambda x: x["cluster"] == F.col("cluster"))[0]
    others = F.filter("_d", lambda x: x["cluster"] != F.col("cluster"))
    b = F.array_min(F.transform(others, lambda x: x["d"]))
    a = own["d"] * own["n"] / (own["n"] - 1)
    s = (F.when((own["n"] <= 1) | b.isNull(), F.lit(0.0))
         .when(a < b, 1 - a / b).when(a > b, b / a - 1).otherwise(F.lit(0.0)))
    return p.select(s.alias("s")).agg(F.avg("s").alias("silhouette"), F.count(F.lit(1)).alias("n"))
