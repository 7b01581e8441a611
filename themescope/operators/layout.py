"""Layout epochs for the 2-D theme map (VEC-8), after McInnes et al. 2018.

Start from given coordinates (the centred PCA), then run ``epochs`` rounds of
expected-gradient updates:

* attraction along every fuzzy edge (src, dst, w), weighted by w;
* repulsion from ``negatives`` rows per node, drawn by a hash of (node, epoch, s) from a
  pool of about ``POOL`` nodes that a hash of (node, epoch) chooses, and scaled by how often
  the node's edges would be sampled (Σw / max w).

Nodes and their edges are packed once into parts of NumPy arrays, keyed by part.  An epoch is
one exchange: each part sends every other part the coordinates that its edges point to, and
its nodes of the pool to all; the arrays themselves stay where they are.  Every
``CHECKPOINT_EPOCHS`` epochs the coordinates are checkpointed into the shared
``spark.checkpoint.dir``, so a lost executor redoes a few epochs at most.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.operators.kmeans import uniform
from themescope.session import checkpoint_root, stored

INIT_EXTENT = 10.0     # initial coordinates scaled to max |coord| = 10
GRAD_CLIP = 4.0
REPULSION_EPS = 0.001
PART_NODES = 50_000    # nodes of a part, on average
POOL = 1024            # nodes that repel in an epoch, on average
CHECKPOINT_EPOCHS = 25


def fit_ab(min_dist: float = 0.1, spread: float = 1.0) -> tuple[float, float]:
    """Least-squares (a, b) so that 1 / (1 + a·d^(2b)) follows 1 below
    ``min_dist`` and exp(−(d − min_dist)/spread) above it (Gauss–Newton)."""
    x = np.linspace(0, spread * 3, 300)[1:]
    y = np.where(x < min_dist, 1.0, np.exp(-(x - min_dist) / spread))
    a, b = 1.0, 1.0
    for _ in range(200):
        xb = x ** (2 * b)
        f = 1.0 / (1.0 + a * xb)
        r = f - y
        da = -xb * f * f
        db = -a * xb * 2 * np.log(x) * f * f
        J = np.stack([da, db], axis=1)
        step = np.linalg.lstsq(J, -r, rcond=None)[0]
        a, b = max(a + step[0], 1e-6), max(b + step[1], 1e-6)
        if np.abs(step).max() < 1e-12:
            break
    return float(a), float(b)


def _clip(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -GRAD_CLIP, GRAD_CLIP)


def attraction(from_: np.ndarray, to: np.ndarray, a: float, b: float) -> np.ndarray:
    """Gradient on ``from_`` (rows x, y) towards ``to``, clipped."""
    diff = from_ - to
    d2 = (diff * diff).sum(1)
    pull = np.zeros(len(d2))
    far = d2 > 0
    pull[far] = -2.0 * a * b * d2[far] ** (b - 1.0) / (1.0 + a * d2[far] ** b)
    return _clip(pull[:, None] * diff)


def repulsion(from_: np.ndarray, to: np.ndarray, a: float, b: float) -> np.ndarray:
    diff = from_ - to
    d2 = (diff * diff).sum(1)
    return _clip((2.0 * b / ((REPULSION_EPS + d2) * (1.0 + a * d2 ** b)))[:, None] * diff)


def _packed(df: DataFrame, key: str, order: list[str], columns: dict[str, str]):
    """(key, {column: array}) for every key, the rows in the given order."""
    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        return pd.DataFrame({"key": [int(pdf[key].iloc[0])]} | {c: [pdf[c].to_numpy().astype(t).tobytes()] for c, t in columns.items()})

    rows = df.groupBy(key).applyInPandas(pack, "key long, " + ", ".join(f"{c} binary" for c in columns))
    return rows.rdd.map(lambda r: (r["key"], {c: np.frombuffer(r[c], t) for c, t in columns.items()}))


def _epoch(epoch: int, epochs: int, rate: float, negatives: int, seed: int, pool: float, a: float, b: float):
    """What a part sends, and how it moves its nodes by what it gets."""
    def send(item):
        part, (own, at) = item
        for k in np.unique(own["to_part"]):
            yield int(k), ("edge", part, at[own["to_idx"][own["to_part"] == k]])
        u = uniform(own["h"], seed, epoch)
        chosen = np.flatnonzero(u < pool)
        for k in range(own["parts"]):
            yield k, ("pool", part, np.column_stack((u[chosen], own["h"][chosen].view(np.float64), at[chosen])))

    def move(item):
        part, (mine, got) = item
        (own, at), = mine
        got = list(got)
        grad = np.zeros_like(at)
        if len(own["src_idx"]):
            near = np.concatenate([x for _, _, x in sorted((m for m in got if m[0] == "edge"), key=lambda m: m[1])])
            pull = attraction(at[own["src_idx"]], near[own["slot"]], a, b) * own["weight"][:, None]
            for c in (0, 1):
                grad[:, c] += np.bincount(own["src_idx"], pull[:, c], len(at))
        near = np.concatenate([x for kind, _, x in got if kind == "pool"])
        near = near[np.lexsort((near[:, 1].copy().view(np.int64), near[:, 0]))]
        for s in range(negatives if len(near) else 0):
            pick = near[(uniform(own["h"], seed + 1 + s, epoch) * len(near)).astype(np.int64)]
            push = repulsion(at, pick[:, 2:], a, b) * own["rate"][:, None]
            push[pick[:, 1].copy().view(np.int64) == own["h"]] = 0.0
            grad += push
        return part, (own, at + rate * (1.0 - epoch / epochs) * grad)
    return send, move


def layout_epochs(edges: DataFrame, init: DataFrame, epochs: int = 200, negatives: int = 5,
                  min_dist: float = 0.1, spread: float = 1.0, seed: int = 42,
                  learning_rate: float = 1.0, parts: int | None = None) -> DataFrame:
    """(id, x, y) after ``epochs`` rounds; ``edges`` = (src, dst, weight) from
    ``fuzzy_edges``, ``init`` = (id, x, y) from ``project_2d``.

    Ids are unique; edges of other nodes are left out; nodes without edges are moved by
    nothing.  The result does not depend on ``parts`` but for the order of sums.
    """
    spark = init.sparkSession
    checkpoint_root(spark)
    a, b = fit_ab(min_dist, spread)
    start = stored(init.select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")), "layout-start")
    n, extent = start.agg(F.count(F.lit(1)), F.max(F.greatest(F.abs("x"), F.abs("y")))).first()
    if not n:
        return start
    parts = parts or math.ceil(n / PART_NODES)
    scale = INIT_EXTENT / extent if extent else 1.0
    e = stored(edges.select("src", "dst", "weight"), "layout-edges")
    top = e.agg(F.max("weight")).first()[0] or 1.0
    rate = e.groupBy("src").agg((F.sum("weight") / top).alias("rate")).withColumnRenamed("src", "id")
    h = F.conv(F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 15), 16, 10).cast("long")
    nodes = start.join(rate, "id", "left").select(
        "id", h.alias("h"), F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), (F.col("x") * scale).alias("x"),
        (F.col("y") * scale).alias("y"), F.coalesce("rate", F.lit(0.0)).alias("rate"))
    # A part is a bounded number of nodes.
    nodes = stored(nodes.withColumn("idx", F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1), "layout-nodes")
    ends = [nodes.select(F.col("id").alias(end), F.col("part").alias(f"{end}_part"), F.col("idx").alias(f"{end}_idx")) for end in ("src", "dst")]
    e = stored(e.join(ends[0], "src").join(ends[1], "dst").drop("src", "dst"), "layout-indexed")
    wanted = e.select("src_part", "dst_part", "dst_idx").distinct()
    mine = _packed(nodes, "part", ["idx"], {"h": "i8", "x": "f8", "y": "f8", "rate": "f8"})
    along = _packed(e, "src_part", ["src_idx", "dst_part", "dst_idx"], {"src_idx": "i8", "dst_part": "i8", "dst_idx": "i8", "weight": "f8"})
    sent = _packed(wanted.withColumnRenamed("src_part", "to_part").withColumnRenamed("dst_idx", "to_idx"), "dst_part",
                   ["to_part", "to_idx"], {"to_part": "i8", "to_idx": "i8"})

    def joined(item):
        part, (node, edge, to) = item
        (node,), edge, to = node, list(edge), list(to)
        none = np.zeros(0, np.int64)
        own = {"h": node["h"], "rate": node["rate"], "parts": parts, "to_part": none, "to_idx": none, "src_idx": none} | (to[0] if to else {})
        if edge:
            # Coordinates arrive by part, in the order of their index: where each edge finds its own.
            key = (edge[0]["dst_part"] << 32) | edge[0]["dst_idx"]
            own |= {"src_idx": edge[0]["src_idx"], "weight": edge[0]["weight"], "slot": np.searchsorted(np.unique(key), key)}
        return part, (own, np.column_stack((node["x"], node["y"])))

    state = mine.groupWith(along, sent).partitionBy(parts).map(joined, preservesPartitioning=True).persist()
    held = [state]
    for epoch in range(epochs):
        send, move = _epoch(epoch, epochs, learning_rate, negatives, seed, POOL / n, a, b)
        inbox = state.flatMap(send).partitionBy(parts)
        # Read twice by the next epoch: to send and to move.
        state = state.cogroup(inbox, parts).map(move, preservesPartitioning=True).persist()
        held.append(state)
        if (epoch + 1) % CHECKPOINT_EPOCHS == 0 and epoch + 1 < epochs:
            state.checkpoint()
            state.count()
            for old in held[:-1]:
                old.unpersist()
            held = [state]
    flat = spark.createDataFrame(state.map(lambda s: (s[0], s[1][1].tobytes())), "part int, at binary")

    def unpacked(batches):
        for batch in batches:
            for part, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                xy = np.frombuffer(at).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(xy), part, np.int32)), pa.array(np.arange(len(xy), dtype=np.int32)),
                                                  pa.array(xy[:, 0].copy()), pa.array(xy[:, 1].copy())], ["part", "idx", "x", "y"])

    done = stored(flat.mapInArrow(unpacked, "part int, idx int, x double, y double"), "layout-done")
    for old in held:
        old.unpersist()
    return nodes.select("id", "part", "idx").join(done, ["part", "idx"]).select("id", "x", "y")
