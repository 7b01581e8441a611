"""Exact k nearest neighbours by metric pruning (VEC-5).

1. *Cells.*  A bounded number of rows, chosen by a hash, are pivots; every row belongs to
   the cell of its nearest pivot.  A cell with many rows is split into blocks by a hash.
2. *Bound.*  The k best inside its own block give each row an upper bound u of its k-th
   distance.
3. *Join.*  Blocks of neighbouring cells are packed into parts.  A part meets all parts, one
   at a time, and keeps the k best of each row by (distance, id).  With r the largest and s
   the smallest distance of a cell's rows to its pivot p, no row of the cell is within u of
   x if |x − p| − r > u or s − |x − p| > u: such cells are passed over.

Nothing is capped: on rows without clusters every cell is met, which is the plain comparison
of all rows with each other, in bounded memory; a part is sent once to each other part.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.functions.vector import as_double_array
from themescope.operators import blocks
from themescope.operators.ingest import first_n_per_group
from themescope.session import stored

MAX_PIVOTS = 1024
BLOCK_ROWS = 1024              # rows of a block, on average, at most
CELL_ROWS = 256                # rows of a cell on average, until MAX_PIVOTS is reached
MAX_PART_BYTES = 8 << 20       # vectors of a part; every part meets all parts in one task
PARTS_PER_CORE = 2
MEET_ROWS, MEET_COLUMNS = 512, 4096     # rows that meet at a time
MAX_HITS = 1 << 17             # pairs whose exact distances are held at a time
_CANDIDATES = "id string, nbr string, dist double"
#: Distances to pivots come from products and are a little off; bounds are loosened by this share.
SLACK = 1e-7


def _matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    d = (x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2.0 * (x @ pivots.T)
    return np.sqrt(np.maximum(d, 0.0))


def _cells(pivots: np.ndarray):
    names = ["id", "vec", "cell", "to_pivot"]

    def cells(batches):
        for batch in batches:
            if batch.num_rows:
                d = _distances(_matrix(batch.column(1)), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()),
                                                  pa.array(d[np.arange(len(d)), near])], names)
    return cells


def nearest(a: np.ndarray, a_ids: np.ndarray, b: np.ndarray, b_ids: np.ndarray, k: int, within: np.ndarray):
    """(row of a, row of b, distance): for each row of a its k nearest rows of b by (distance,
    id), those of its own id and those beyond ``within`` left out.  Products choose who may
    be among them; the distances themselves are exact differences."""
    out = []
    rank = np.empty(len(b), np.int64)
    rank[np.argsort(b_ids, kind="stable")] = np.arange(len(b))
    bb, scale = (b * b).sum(1), 1.0 + max((a * a).sum(1).max(), (b * b).sum(1).max())
    for s in range(0, len(a), 64):
        x = a[s:s + 64]
        d = np.maximum((x * x).sum(1)[:, None] + bb[None] - 2.0 * (x @ b.T), 0.0)
        d[a_ids[s:s + 64, None] == b_ids[None]] = np.inf
        most = np.minimum(np.partition(d, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1], within[s:s + 64] ** 2)
        i, j = np.nonzero((d <= most[:, None] + 1e-11 * scale) & np.isfinite(d))
        exact = np.sqrt(((x[i] - b[j]) ** 2).sum(1))
        order = np.lexsort((rank[j], exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.searchsorted(i, np.arange(len(x)))
        keep = (np.arange(len(i)) - first[i] < k) & (exact <= within[s + i])
        out.append((s + i[keep], j[keep], exact[keep]))
    return tuple(np.concatenate(x) for x in zip(*out))


def _own_block(k: int):
    def own(pdf: pd.DataFrame) -> pd.DataFrame:
        x, ids = blocks.stack(pdf["vec"]), pdf["id"].to_numpy()
        i, j, d = nearest(x, ids, x, ids, k, np.full(len(x), np.inf))
        return pd.DataFrame({"id": ids[i], "nbr": ids[j], "dist": d})
    return own


class Best:
    """The k nearest so far of each row, by (distance, id); ``bound``: what they surely are within."""

    def __init__(self, vecs: np.ndarray, ids: np.ndarray, bound: np.ndarray, k: int):
        self.vecs, self.ids, self.bound, self.k = vecs, ids, bound, k
        self.dist = np.full((len(vecs), k), np.inf)
        self.nbr = np.full((len(vecs), k), None, object)

    def within(self, rows: np.ndarray) -> np.ndarray:
        return np.minimum(self.bound[rows], self.dist[rows, -1])

    def meet(self, rows: np.ndarray, b: np.ndarray, b_ids: np.ndarray) -> None:
        """``rows`` meet all of b but those of their own id.  Products choose who may be
        among the nearest; the distances themselves are exact differences."""
        x, within = self.vecs[rows], self.within(rows)
        xx, bb = (x * x).sum(1), (b * b).sum(1)
        scale = xx.max() + bb.max()
        kind = np.float32 if scale < 1e30 else np.float64
        d = (-2.0 * x).astype(kind) @ b.astype(kind).T
        d += bb.astype(kind)
        # Loosened by what rounded products and sums may be off.
        off = (b.shape[1] + 16) * 2 * np.finfo(kind).eps * scale
        i, j = blocks.where(d <= np.minimum(within ** 2 - xx + off, np.finfo(kind).max).astype(kind)[:, None])
        if len(i) > MAX_HITS and len(rows) > 1:
            for half in np.array_split(rows, 2):
                self.meet(half, b, b_ids)
            return
        other = self.ids[rows[i]] != b_ids[j]
        i, j = i[other], j[other]
        dist = np.sqrt(((x[i] - b[j]) ** 2).sum(1))
        i, j, dist = (v[dist <= within[i]] for v in (i, j, dist))
        if len(i) == 0:
            return
        met = np.unique(i)
        held, known = np.isfinite(self.dist[rows[met]]), rows[met]
        i = np.concatenate((i, np.repeat(met, self.k)[held.ravel()]))
        dist, nbr = np.concatenate((dist, self.dist[known][held])), np.concatenate((b_ids[j], self.nbr[known][held]))
        order = np.lexsort((nbr.astype(str), dist, i))
        i, dist, nbr = i[order], dist[order], nbr[order]
        # Rows that stand twice bid once.
        new = np.concatenate(([True], (i[1:] != i[:-1]) | (dist[1:] != dist[:-1]) | (nbr[1:] != nbr[:-1])))
        i, dist, nbr = i[new], dist[new], nbr[new]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        i, dist, nbr, place = (v[place < self.k] for v in (i, dist, nbr, place))
        self.dist[known], self.nbr[known] = np.inf, None
        self.dist[rows[i], place], self.nbr[rows[i], place] = dist, nbr


def _sorted_part(row):
    """(vectors, ids, first row and end of each cell, cells, distances to pivots, bounds), rows by cell."""
    cells = row["cell"].values.to_numpy()
    order = np.argsort(cells, kind="stable")
    cells = cells[order]
    first = np.flatnonzero(np.concatenate(([True], cells[1:] != cells[:-1])))
    column = lambda c: row[c].values.to_numpy(zero_copy_only=False)[order]
    return (blocks.vectors_of(row)[order], column("id"), first, np.concatenate((first[1:], [len(cells)])), cells[first],
            column("to_pivot"), column("bound"))


def _near_part(pivots: np.ndarray, k: int):
    """A part of the rows meets itself and then all others, one at a time: runs of its rows
    meet the cells that may hold a row nearer than their k-th best so far."""
    def near(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = None
        for batch in batches:
            for r in range(batch.num_rows):
                b, b_ids, first, ends, cells, to_pivot, bound = _sorted_part({c: batch.column(c)[r] for c in batch.schema.names})
                if best is None:
                    if batch.column("blk")[r].as_py() != key[0].as_py():
                        raise ValueError("a part meets itself first")
                    best = Best(b, b_ids, bound, k)
                far, inner = np.maximum.reduceat(to_pivot, first), np.minimum.reduceat(to_pivot, first)
                for s in range(0, len(best.vecs), MEET_ROWS):
                    rows = np.arange(s, min(len(best.vecs), s + MEET_ROWS))
                    d = _distances(best.vecs[rows], pivots[cells])
                    loose = best.within(rows)[:, None] + SLACK * (1.0 + d.max(1))[:, None]
                    reach = ((d - far[None] <= loose) & (inner[None] - d <= loose)).any(0)
                    if not reach.any():
                        continue
                    some = np.concatenate([np.arange(x, y) for x, y in zip(first[reach], ends[reach])])
                    for t in range(0, len(some), MEET_COLUMNS):
                        best.meet(rows, b[some[t:t + MEET_COLUMNS]], b_ids[some[t:t + MEET_COLUMNS]])
        i, place = np.nonzero(np.isfinite(best.dist))
        for s in range(0, len(i), MAX_HITS):
            at = i[s:s + MAX_HITS], place[s:s + MAX_HITS]
            yield pa.RecordBatch.from_arrays([pa.array(best.ids[at[0]], pa.string()), pa.array(best.nbr[at], pa.string()), pa.array(best.dist[at])],
                                             ["id", "nbr", "dist"])
    return near


def _reach(pivots: np.ndarray, radius: np.ndarray, inner: np.ndarray, parts: np.ndarray):
    """Rows with their bound -> the blocks other than their own that may hold closer rows."""
    offset = np.cumsum(parts) - parts
    names = ["id", "vec", "block", "bound", "meets"]

    def reach(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            d = _distances(_matrix(batch.column(1)), pivots)
            bound = batch.column(3).to_numpy(zero_copy_only=False)
            loose = (bound + SLACK * (1.0 + d.max(1)))[:, None]
            open_ = (d - radius[None] <= loose) & (inner[None] - d <= loose) & (parts > 0)[None]
            own = batch.column(2).to_numpy()
            meets = []
            for k, row in enumerate(open_):
                cells = np.flatnonzero(row)
                found = np.concatenate([np.arange(offset[c], offset[c] + parts[c]) for c in cells]) if len(cells) else cells
                meets.append(found[found != own[k]])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(4)), pa.array(meets, pa.list_(pa.int32()))], names)
    return reach


def _bounded(df: DataFrame, k: int, vec_col: str, id_col: str, block_rows: int | None):
    """(rows (id, vec, cell, to_pivot, block, bound), k best inside each block, pivots, their rows'
    largest and smallest distance, blocks and rows of each cell)."""
    pts = df.where(F.col(vec_col).isNotNull()).select(F.col(id_col).cast("string").alias("id"), as_double_array(vec_col).alias("vec"))
    n = pts.count()
    wanted = min(MAX_PIVOTS, max(1, math.ceil(n / min(block_rows or CELL_ROWS, CELL_ROWS))))
    chosen = pts.orderBy(F.xxhash64("id", "vec"), "id").limit(wanted).select("vec").collect()
    pivots = np.array([r["vec"] for r in chosen]) if chosen else np.zeros((1, 1))
    cells = stored(pts.mapInArrow(_cells(pivots), "id string, vec array<double>, cell int, to_pivot double"), "knn-cells")
    radius, inner = np.zeros(len(pivots)), np.zeros(len(pivots))
    parts, count = np.zeros(len(pivots), np.int64), np.zeros(len(pivots), np.int64)
    # One row per pivot.
    for r in cells.groupBy("cell").agg(F.max("to_pivot").alias("far"), F.min("to_pivot").alias("near"), F.count(F.lit(1)).alias("n")).collect():
        radius[r["cell"]], inner[r["cell"]], count[r["cell"]] = r["far"], r["near"], r["n"]
        parts[r["cell"]] = math.ceil(r["n"] / (block_rows or BLOCK_ROWS))
    offset = np.cumsum(parts) - parts
    of_cell = F.array(*[F.struct(F.lit(int(o)), F.lit(int(max(p, 1)))) for o, p in zip(offset, parts)])
    block = of_cell[F.col("cell")]
    rows = cells.withColumn("block", (block["col1"] + F.pmod(F.xxhash64("id", "vec"), block["col2"])).cast("int"))
    own = stored(rows.select("id", "vec", "block").groupBy("block").applyInPandas(_own_block(k), _CANDIDATES)
                 .dropDuplicates(["id", "nbr", "dist"]), "knn-own")
    bound = own.groupBy("id").agg(F.when(F.count(F.lit(1)) >= k, F.max("dist")).alias("bound")).withColumnRenamed("id", "of")
    bounded = rows.join(bound, F.col("of") == F.col("id"), "left").withColumn("bound", F.coalesce("bound", F.lit(float("inf")))).drop("of")
    return bounded, own, pivots, radius, inner, parts, count


def knn_blocks(df: DataFrame, k: int, vec_col: str = "embedding", id_col: str = "id", block_rows: int | None = None):
    """Blocks of rows, the k best inside each, and the (row, block) meetings that are left."""
    bounded, own, pivots, radius, inner, parts, _ = _bounded(df, k, vec_col, id_col, block_rows)
    meets = bounded.select("id", "vec", "block", "bound").mapInArrow(
        _reach(pivots, radius, inner, parts), "id string, vec array<double>, block int, bound double, meets array<int>")
    return bounded.select("id", "vec", "block"), own, meets.withColumn("meets", F.explode("meets")), int(parts.sum())


def knn_graph(df: DataFrame, k: int = 15, vec_col: str = "embedding", id_col: str = "id", block_rows: int | None = None) -> DataFrame:
    """Exact k nearest neighbours (Euclidean, raw vectors): (id, nbr, rank, dist).

    Ties at the k-th distance go to the lowest neighbour ids.  Rows without a vector take no
    part; rows of one id are never neighbours of each other, and all of them bid for its
    k places.  ``block_rows``: rows of a block (and of a cell) instead of the defaults.
    """
    rows, _, pivots, _, _, parts, count = _bounded(df, k, vec_col, id_col, block_rows)
    # Blocks of neighbouring numbers make a part; parts are packed, and each is sent to all.
    n, wide = max(int(count.sum()), 1), pivots.shape[1] * np.dtype(blocks.vector_type(df, vec_col)).itemsize
    wanted = min(n, max(PARTS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism, math.ceil(n * wide / MAX_PART_BYTES)))
    size = np.repeat(count / np.maximum(parts, 1), parts)
    part_of = np.minimum((np.cumsum(size) - size) * wanted / n, wanted - 1).astype(int).tolist() or [0]
    packed = stored(blocks.packed(
        rows.withColumn("vec", F.col("vec").cast(df.schema[vec_col].dataType)), F.lit(part_of)[F.col("block")], pivots.shape[1],
        {"id": "string", "cell": "int", "to_pivot": "double", "bound": "double"}), "knn-parts")
    there = [r["blk"] for r in packed.select("blk").collect()]
    if not there:
        return df.sparkSession.createDataFrame([], "id string, nbr string, rank int, dist double")
    # More partitions than parts: few tasks get two, whatever number the session has.
    met = (packed.select(F.explode(F.lit(there)).alias("part"), "*").withColumn("_other", F.col("blk") != F.col("part"))
           .repartition(8 * len(there), "part").sortWithinPartitions("part", "_other"))
    best = met.groupBy("part").applyInArrow(_near_part(pivots, k), _CANDIDATES).dropDuplicates(["id", "nbr", "dist"])
    return first_n_per_group(best, "id", k, [F.col("dist"), F.col("nbr")], rank_col="rank").select("id", "nbr", "rank", "dist")
