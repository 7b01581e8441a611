"""Exact top-k inner products by norm order and Cauchy-Schwarz bounds.

Vectors are packed into blocks in descending order of length.  A query's
scores against the longest vectors give a first threshold.  Block by block,
a query is through as soon as its length times the longest vector left is below
its threshold; before that, partial sums over the first axes of an SVD rotation
plus the product of the residual lengths bound each score, and only pairs whose
bound reaches the threshold are multiplied out, in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themescope.llm.common import arrow_rows, table, written

K = 10
SCALE = 1024.0
QUERY_EVERY = 100
BLOCK = 4096                       # vectors of a block
QUERY_BLOCK = 512
SHELF_BYTES = 32 << 20             # vector blocks that a query block is sent to once
SHELVES_PER_CORE = 8
CHUNK = 512                        # vectors bounded at a time
HEAD = 1024                        # longest vectors, for the first thresholds
SEED = 5
SAMPLE = 4096                      # vectors the rotation is fitted on
AXES = 16                          # of the partial sums
LEAST = np.iinfo(np.int64).min


def quantised(v) -> Column:
    return F.transform(v, lambda x: F.floor(x.cast("double") * SCALE).cast("long"))


def usable(v) -> Column:
    """Not null, and every component a finite number."""
    return F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    out = np.zeros((len(lists), width), np.int64)
    offsets = lists.offsets.to_numpy()
    n = np.diff(offsets)
    values = lists.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]]
    out[np.repeat(np.arange(len(n)), n), np.arange(len(values)) - np.repeat(offsets[:-1] - offsets[0], n)] = values
    return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer a @ b.T; through floating point where no sum can exceed 2^53."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_of_block(q_ids, q, tau, v_ids, v, rotation, k):
    """Rows (query index, vec_id, score): the k best of the block for each query,
    but for scores below its threshold.  ``v`` is in descending order of length."""
    qn, vn = np.linalg.norm(q.astype(np.float64), axis=1), np.linalg.norm(v.astype(np.float64), axis=1)
    qr, vr = q @ rotation, v @ rotation
    m = min(AXES, q.shape[1])
    q_rest, v_rest = np.linalg.norm(qr[:, m:], axis=1), np.linalg.norm(vr[:, m:], axis=1)
    tau, best = tau.copy(), np.full((len(q), k), LEAST)
    found = []
    for at in range(0, len(v), CHUNK):
        part = slice(at, at + CHUNK)
        slack = 1e-9 * qn * vn[at] + 1e-6
        live = np.flatnonzero(qn * vn[at] + slack >= tau)
        if len(live) == 0:
            break
        bound = qr[live, :m] @ vr[part, :m].T + q_rest[live, None] * v_rest[None, part] + slack[live, None]
        open_ = (bound >= tau[live, None]) & (q_ids[live, None] != v_ids[None, part])
        qi, vi = np.nonzero(open_)
        if len(qi) == 0:
            continue
        scores = np.full(open_.shape, LEAST)
        if len(qi) * 8 < open_.size:
            scores[qi, vi] = np.einsum("ij,ij->i", q[live[qi]], v[part][vi])
        else:
            scores = np.where(open_, products(q[live], v[part]), LEAST)
        best[live] = np.partition(np.concatenate((best[live], scores), 1), -k, 1)[:, -k:]
        tau[live] = np.maximum(tau[live], best[live].min(1))
        qi, vi = np.nonzero(scores >= np.maximum(tau[live], LEAST + 1)[:, None])
        found.append((live[qi], v_ids[part][vi], scores[qi, vi]))
    if not found:
        return np.zeros((3, 0), np.int64)
    qi, ids, scores = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -scores, qi))
    qi, ids, scores = qi[order], ids[order], scores[order]
    first = np.flatnonzero(np.concatenate(([True], qi[1:] != qi[:-1])))
    rank = np.arange(len(qi)) - np.repeat(first, np.diff(np.append(first, len(qi))))
    keep = rank < k
    return np.stack([qi[keep], ids[keep], scores[keep]])


def _packed(rows: int, width: int, head=None, k: int = K):
    """Blocks (part, block, n, ids, data, longest, reach): reach is the length that
    a vector needs to be of use to some query of the block."""
    names = ["part", "block", "n", "ids", "data", "taus", "longest", "reach"]

    def block(part, number, ids, data):
        norms = np.linalg.norm(data.astype(np.float64), axis=1)
        tau = np.full(len(ids), LEAST)
        if head is not None:
            h_ids, h = head.value
            scores = np.where(ids[:, None] == h_ids[None, :], LEAST, products(data, h))
            if scores.shape[1] >= k:
                tau = np.partition(scores, -k, 1)[:, -k]
        need = np.where(tau > 0, tau / np.maximum(norms, 1e-300), 0.0)
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((part, pa.int32()), (number, pa.int32()), (len(ids), pa.int32()), (ids.tobytes(), pa.binary()),
                                          (data.tobytes(), pa.binary()), (tau.astype(np.int64).tobytes(), pa.binary()),
                                          (float(norms.max()), pa.float64()), (float(need.min()) * (1 - 1e-9), pa.float64()))], names=names)

    def pack(batches):
        from pyspark import TaskContext
        part, number, ids, data, size = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                some = batch.slice(at, rows)
                ids.append(some.column(0).to_numpy())
                data.append(_matrix(some.column(1), width))
                size += some.num_rows
                if size >= rows:
                    yield block(part, number, np.concatenate(ids), np.concatenate(data))
                    ids, data, size, number = [], [], 0, number + 1
        if size:
            yield block(part, number, np.concatenate(ids), np.concatenate(data))
    return pack


PACKED = "part int, block int, n int, ids binary, data binary, taus binary, longest double, reach double"


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """(query_id, rank, vec_id, score) of vectors (vec_id, embedding).

    Queries: the rows whose vec_id is divisible by ``every``; candidates: all
    rows but those of the query's own vec_id.  Components count as
    floor(1024 * x); ties go to the smaller vec_id.  Vectors that are null or
    hold null or non-finite components, and rows without vec_id, take no part;
    shorter vectors count as filled up with zeros.  Repeated rows are
    candidates of their own; as queries, rows of one vec_id and equal components are one
    query, rows of one vec_id and other components are queries of their own.  Fewer than ``k`` candidates give fewer rows; an
    empty table, or one without queries, gives none.  Extra columns are ignored.
    """
    spark = vectors.sparkSession
    rows = (vectors.where(F.col("vec_id").isNotNull() & usable("embedding"))
            .select(F.col("vec_id").cast("long").alias("vec_id"), quantised("embedding").alias("v")))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = written(rows.withColumn("norm", norm), "quantised")
    width, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count(F.lit(1))).first()
    # One row in so many, so that no task sends the driver more than its part of the sample.
    some = F.pmod(F.xxhash64("vec_id", "v"), F.lit(max(1, -(-n // SAMPLE)))) == 0
    sample = _matrix(rows.where(some).limit(SAMPLE).select("v").toArrow().column(0).combine_chunks(), width).astype(np.float64)
    # The axes of the sample's SVD, without the side as long as the sample.
    turn = spark.sparkContext.broadcast(np.linalg.eigh(sample.T @ sample)[1][:, ::-1])

    # Blocks in descending order of length; their numbers follow (part, block).
    by_norm = rows.repartitionByRange(F.col("norm").desc()).sortWithinPartitions(F.col("norm").desc())
    blocks = written(by_norm.select("vec_id", "v").mapInArrow(_packed(BLOCK, width), PACKED), "vector-blocks")
    numbers = Window.partitionBy(F.lit(0)).orderBy("part", "block")
    # One row per block of thousands of vectors.
    order = written(blocks.select("part", "block", "n", "longest").withColumn("vb", F.row_number().over(numbers)), "block-order")
    blocks = blocks.join(order.select("part", "block", "vb"), ["part", "block"])
    # Of the driver's own: one length for each block of thousands of vectors, and the blocks of the longest vectors.
    sizes = order.orderBy("vb").select("n", "longest").collect()
    first = int(np.searchsorted(np.cumsum([r["n"] for r in sizes]), HEAD)) + 1
    heads = sorted(blocks.where(F.col("vb") <= first).select("vb", "ids", "data").collect())
    head_ids, head = (np.frombuffer(b"".join(r[c] for r in heads), np.int64) for c in ("ids", "data"))
    head = spark.sparkContext.broadcast((head_ids[:HEAD], head.reshape(len(head_ids), width)[:HEAD]))
    queries = written(rows.where(F.col("vec_id") % every == 0).select("vec_id", "v").distinct()
                      .mapInArrow(_packed(QUERY_BLOCK, width, head, k), PACKED), "query-blocks")
    # A query block needs the blocks up to the last whose longest vector is in reach.
    longest = np.array([r["longest"] for r in sizes])
    lengths = spark.sparkContext.broadcast(longest)

    def in_reach(batches):
        for batch in batches:
            n = np.searchsorted(-lengths.value, -batch.column(3).to_numpy(), "right")
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(n, pa.int64())], names=["q_ids", "q", "taus", "needed"])

    # A query block is sent once to a shelf of blocks that stand one after another.
    cores = spark.sparkContext.defaultParallelism
    shelf = max(1, min(SHELF_BYTES // (BLOCK * 8 * max(width, 1)), len(sizes) // (SHELVES_PER_CORE * cores)))
    pairs = (queries.select("ids", "data", "taus", "reach")
             .mapInArrow(in_reach, "q_ids binary, q binary, taus binary, needed long").where("needed > 0")
             .select(F.explode(F.sequence(F.lit(0), F.floor((F.col("needed") - 1) / shelf).cast("int"))).alias("shelf"), "q_ids", "q", "taus", "needed"))
    shelved = blocks.select(F.floor((F.col("vb") - 1) / shelf).cast("int").alias("shelf"), "vb", F.col("ids").alias("v_ids"), F.col("data").alias("v"))

    odd = np.random.default_rng(SEED).integers(0, 1 << 62, max(width, 1)) * 2 + 1

    def search(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                q_ids, q, taus, v_ids, v = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in range(5))
                q = q.reshape(len(q_ids), -1)
                which = (q * odd[:q.shape[1]]).sum(1)    # tells the vectors of one vec_id apart
                qi, ids, scores = best_of_block(q_ids, q, taus, v_ids, v.reshape(len(v_ids), -1), turn.value, k)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[qi]), pa.array(which[qi]), pa.array(ids), pa.array(scores)],
                                                 names=["query_id", "which", "vec_id", "score"])

    # Spark takes the exploded pairs for as small as the query blocks' file; unhinted, it sends them to the driver and all executors.
    hits = (pairs.join(shelved.hint("merge"), "shelf").where("vb <= needed")
            .select("q_ids", "q", "taus", "v_ids", "v").mapInArrow(search, "query_id long, which long, vec_id long, score long"))
    with arrow_rows(spark, 8):
        hits = written(hits, "hits")
    rank = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.col("score").desc(), "vec_id"))
    return (hits.withColumn("rank", rank).where(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def query(spark, sf_dir):
    return top_k(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.e AS which, c.vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM (SELECT DISTINCT vec_id, e FROM v WHERE vec_id % {QUERY_EVERY} = 0) q JOIN v c ON c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, which ORDER BY score DESC, vec_id) AS rk FROM s)
SELECT query_id, CAST(rk AS INTEGER) AS rank, vec_id, score FROM r WHERE rk <= {K}"""
