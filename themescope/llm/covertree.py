"""Near-duplicate vectors by dual traversal of cover trees.

Vectors of equal label are compared by cosine, as chords between unit vectors.
The top level of a label's tree are pivots; each vector goes to its nearest
pivot, and the vectors of a pivot are kept in blocks.  Block pairs whose pivot
distance less both radii exceeds the threshold chord are never joined.  In a
task each block is a cover tree: nested levels of halving radii, every node
covering its members.  Two trees are walked together; a node pair is dropped
when its centres are further apart than the chord plus both radii, taken whole
when they are nearer than the chord less both radii, and opened otherwise.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.llm.common import arrow_rows, table, written
from themescope.llm.graph import components
from themescope.llm.topk import usable

THRESHOLD = 0.93
BLOCK = 2048
PIVOTS = 64
SLACK = 1e-9


def chord(cosine):
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors, lengths): each vector times a power of two, which rounds nothing
    and keeps squares finite."""
    _, exponent = np.frexp(np.abs(x).max(1, initial=0))
    x = np.ldexp(x, -exponent[:, None])
    return x, np.sqrt((x * x).sum(1))


class Tree:
    """Cover tree of a block.  A node is (centre, members, radius); opening it
    covers its members with balls of half the radius, the first around its own
    centre."""

    def __init__(self, x: np.ndarray):
        self.x, self.norm = scaled(x)
        self.cos = None
        self.opened: dict[int, tuple] = {}
        d = chord(self.cosines(np.array([0]), np.arange(len(x)))[0])
        self.nodes = [(0, np.arange(len(x)), float(d.max()))]

    def cosines(self, a, b):
        return (self.x[a] @ self.x[b].T) / (self.norm[a][:, None] * self.norm[b][None, :])

    def children(self, k: int):
        """(node numbers, centres, radii, sizes) of the children of node k."""
        if k in self.opened:
            return self.opened[k]
        centre, members, radius = self.nodes[k]
        if self.cos is None:
            every = np.arange(len(self.x))
            self.cos = self.cosines(every, every)
        left, made = members, []
        while len(left):
            c = centre if not made else int(left[0])
            d = chord(self.cos[c, left])
            near = d <= radius / 2
            near |= left == c
            mine = left[near]
            made.append((c, mine, float(d[near].max())))
            left = left[~near]
        first = len(self.nodes)
        self.nodes += made
        out = (np.arange(first, len(self.nodes)), np.array([m[0] for m in made]), np.array([m[2] for m in made]),
               np.array([len(m[1]) for m in made]))
        self.opened[k] = out
        return out


class Links:
    """Link counts and connected classes over the members of two trees."""

    def __init__(self, na: int, nb: int):
        self.count = np.zeros(na + nb, np.int64)
        self.shift = na
        self.edges: list[np.ndarray] = []

    def join(self, u, v):
        self.edges.append(np.stack([u, v]))

    def roots(self) -> np.ndarray:
        label = np.arange(len(self.count))
        if self.edges:
            u, v = np.concatenate(self.edges, 1)
            while True:
                low = np.minimum(label[u], label[v])
                new = label.copy()
                np.minimum.at(new, u, low)
                np.minimum.at(new, v, low)
                new = new[new]
                if (new == label).all():
                    break
                label = new
        return label


def linked(xa: np.ndarray, xb: np.ndarray | None, threshold: float = THRESHOLD):
    """(counts, roots) over the rows of xa, then of xb: links of each row into the
    other block, and the least row reachable.  xb None: links inside xa."""
    ta = Tree(xa)
    same = xb is None
    tb = ta if same else Tree(xb)
    out = Links(len(xa), 0 if same else len(xb))
    shift = 0 if same else len(xa)
    r = float(chord(threshold))

    def cosines(a, b):
        return (ta.x[a] @ tb.x[b].T) / (ta.norm[a][:, None] * tb.norm[b][None, :])

    def exact(a, b):
        m = cosines(a, b) >= threshold
        if same:
            m &= a[:, None] != b[None, :]
        if not m.any():
            return
        # In one tree (a, b) and (b, a) are both walked, so each side is counted once.
        out.count[a] += m.sum(1)
        if not same:
            out.count[b + shift] += m.sum(0)
        lab_a, lab_b = np.arange(len(a)), np.arange(len(b)) + len(a)
        none = len(a) + len(b)
        while True:
            new_b = np.minimum(lab_b, np.where(m, lab_a[:, None], none).min(0))
            new_a = np.minimum(lab_a, np.where(m, new_b[None, :], none).min(1))
            if (new_a == lab_a).all() and (new_b == lab_b).all():
                break
            lab_a, lab_b = new_a, new_b
        rows = np.concatenate([a, b + shift])
        out.join(rows, rows[np.concatenate([lab_a, lab_b])])

    def whole(a, b):
        if same and a is b:
            out.count[a] += len(b) - 1
        else:
            out.count[a] += len(b)
            if not same:
                out.count[b + shift] += len(a)
        out.join(a, np.full(len(a), b[0] + shift))
        out.join(b + shift, np.full(len(b), a[0]))

    stack = [(0, 0)]
    while stack:
        i, j = stack.pop()
        ca, a, ra = ta.nodes[i]
        cb, b, rb = tb.nodes[j]
        d = float(chord(cosines(np.array([ca]), np.array([cb]))[0, 0]))
        if d - ra - rb > r + SLACK:
            continue
        if d + ra + rb < r - SLACK and not (same and i == j and len(a) == 1):
            whole(a, b)
            continue
        if (ra <= r and rb <= r) or min(len(a), len(b)) <= 16:
            exact(a, b)
            continue
        # Open every node that is wider than the chord.
        ia, centre_a, rad_a, size_a = ta.children(i) if ra > r else (np.array([i]), np.array([ca]), np.array([ra]), np.array([len(a)]))
        ib, centre_b, rad_b, size_b = tb.children(j) if rb > r else (np.array([j]), np.array([cb]), np.array([rb]), np.array([len(b)]))
        cos = cosines(centre_a, centre_b)
        near = chord(cos) <= r + SLACK + rad_a[:, None] + rad_b[None, :]
        single = (size_a == 1)[:, None] & (size_b == 1)[None, :]
        pairs = np.nonzero(near & ~single)
        stack.extend(zip(ia[pairs[0]].tolist(), ib[pairs[1]].tolist()))
        hit = single & (cos >= threshold)
        if same:
            hit &= centre_a[:, None] != centre_b[None, :]
        if hit.any():
            out.count[centre_a] += hit.sum(1)
            if not same:
                np.add.at(out.count, centre_b + shift, hit.sum(0))
            u, v = np.nonzero(hit)
            out.join(centre_a[u], centre_b[v] + shift)
    return out.count, out.roots()


def _to_cells(key, left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one (label, dim, salt) with their nearest pivot (cell, dist)."""
    if left.num_rows == 0 or right.num_rows == 0:
        return left.select(["rid", "vec_id", "label", "dim", "v"]).append_column("cell", pa.nulls(left.num_rows, pa.int32())) \
            .append_column("dist", pa.nulls(left.num_rows, pa.float64()))
    right = right.sort_by("cell")
    dim = left.column("dim")[0].as_py()
    x, nx = scaled(_dense(left.column("v"), dim))
    p, np_ = scaled(_dense(right.column("v"), dim))
    cos = (x @ p.T) / (nx[:, None] * np_[None, :])
    best = cos.argmax(1)
    cells = right.column("cell").to_numpy()[best]
    return (left.select(["rid", "vec_id", "label", "dim", "v"])
            .append_column("cell", pa.array(cells, pa.int32()))
            .append_column("dist", pa.array(chord(cos[np.arange(len(best)), best]), pa.float64())))


def _dense(column, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0]:offsets[-1]].reshape(-1, dim).astype(np.float64)


BLOCKS = "label string, dim int, cell int, n int, radius double, rids binary, ids binary, data binary"


def _blocks(batches):
    """Consecutive rows of equal (label, dim, cell, part) become one block."""
    names = [c.split()[0] for c in BLOCKS.split(", ")]
    key, held = None, []

    def block():
        label, dim, cell, _ = key
        rids, ids, dist = (np.concatenate([h.column(c).to_numpy() for h in held]) for c in (4, 5, 6))
        data = np.concatenate([_dense(h.column(7), dim) for h in held])
        return pa.RecordBatch.from_arrays(
            [pa.array([x], t) for x, t in ((label, pa.string()), (dim, pa.int32()), (cell, pa.int32()), (len(rids), pa.int32()),
                                          (float(dist.max()), pa.float64()), (rids.tobytes(), pa.binary()), (ids.tobytes(), pa.binary()),
                                          (data.tobytes(), pa.binary()))], names=names)

    for batch in batches:
        keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
        at = 0
        while at < len(keys):
            to = at
            while to < len(keys) and keys[to] == keys[at]:
                to += 1
            if keys[at] != key and held:
                yield block()
                held = []
            key = keys[at]
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield block()


def _link_rows(threshold: float):
    def run(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                same, dim = batch.column(0)[r].as_py(), batch.column(1)[r].as_py()
                rid_a, id_a, rid_b, id_b = (np.frombuffer(batch.column(c)[r].as_buffer(), np.int64) for c in (2, 3, 5, 6))
                xa, xb = (np.frombuffer(batch.column(c)[r].as_buffer(), np.float64).reshape(-1, dim) for c in (4, 7))
                count, root = linked(xa, None if same else xb, threshold)
                rids, ids = (rid_a, id_a) if same else (np.concatenate([rid_a, rid_b]), np.concatenate([id_a, id_b]))
                hit = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(rids[hit]), pa.array(ids[hit]), pa.array(count[hit]), pa.array(ids[root[hit]])],
                                                 names=["rid", "vec_id", "n", "root"])
    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row per row of vectors (vec_id, embedding, label).

    Links join rows of equal, not null label and equal length whose cosine in
    double precision is ``threshold`` or more.  Vectors that are null, empty or
    zero, or hold null or non-finite components, and rows without vec_id, link
    with nothing; their component is their own vec_id.  Repeated rows link with
    each other; rows of one vec_id share a component.  ``kept`` marks the rows
    whose vec_id is the component's (null ids: kept).  A label that holds many
    of the rows is split into blocks; no pair of rows is ever written out.  An
    empty table gives no rows; extra columns are ignored.
    """
    rows = written(vectors.select(
        F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("long").alias("vec_id"),
        F.col("label").cast("string").alias("label"),
        F.when(F.col("label").isNotNull() & F.col("vec_id").isNotNull() & usable("embedding")
               & F.exists("embedding", lambda x: x != 0),
               F.transform("embedding", lambda x: x.cast("double"))).alias("v")), "vectors")
    live = rows.where("v IS NOT NULL").withColumn("dim", F.size("v"))
    sizes = written(live.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")), "labels")
    # Top level: at most PIVOTS per label, one per block where that is fewer.
    by_hash = Window.partitionBy("label", "dim").orderBy(F.xxhash64("rid"), "rid")
    pivots = (live.withColumn("cell", F.row_number().over(by_hash)).where(F.col("cell") <= PIVOTS)
              .join(sizes, ["label", "dim"]).where(F.col("cell") <= F.ceil(F.col("n") / BLOCK))
              .select("label", "dim", "cell", "v"))
    pivots = written(pivots, "pivots")
    salts = sizes.select("label", "dim", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("salt"))
    dealt = (live.join(sizes, ["label", "dim"])
             .withColumn("salt", F.pmod(F.xxhash64("rid"), F.floor((F.col("n") - 1) / BLOCK) + 1)).drop("n"))
    cells = written(dealt.groupBy("label", "dim", "salt").cogroup(pivots.join(salts, ["label", "dim"]).groupBy("label", "dim", "salt"))
                    .applyInArrow(_to_cells, "rid long, vec_id long, label string, dim int, v array<double>, cell int, dist double"), "cells")

    in_cell = cells.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64(F.lit(1), "rid"), F.floor((F.col("n") - 1) / BLOCK) + 1)
    ordered = (cells.join(in_cell, ["label", "dim", "cell"])
               .select("label", "dim", "cell", part.alias("part"), "rid", "vec_id", "dist", "v")
               .repartition("label", "dim", "cell", "part").sortWithinPartitions("label", "dim", "cell", "part"))
    blocks = written(ordered.mapInArrow(_blocks, BLOCKS).withColumn("block", F.monotonically_increasing_id()), "blocks")

    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, y: a + y * y)))
    centres = pivots.select("label", "dim", "cell", unit(F.col("v")).alias("centre"))
    meta = written(blocks.select("block", "label", "dim", "cell", "radius").join(centres, ["label", "dim", "cell"]), "block-meta")
    a = meta.select("label", "dim", F.col("block").alias("a"), F.col("centre").alias("x"), F.col("radius").alias("ra"))
    b = meta.select("label", "dim", F.col("block").alias("b"), F.col("centre").alias("y"), F.col("radius").alias("rb"))
    cosine = F.aggregate(F.zip_with("x", "y", lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    apart = F.sqrt(F.greatest(2.0 - 2.0 * cosine, F.lit(0.0)))
    pairs = (a.join(b, ["label", "dim"]).where("a <= b")
             .where(apart - F.col("ra") - F.col("rb") <= float(chord(threshold)) + 1e-6).select("a", "b"))
    side = lambda n: blocks.select(F.col("block").alias(n), F.col("rids").alias(f"rids_{n}"), F.col("ids").alias(f"ids_{n}"),
                                   F.col("data").alias(f"data_{n}"), *(["dim"] if n == "a" else []))
    joined = (pairs.join(side("a"), "a").join(side("b"), "b").repartition(F.xxhash64("a", "b"))
              .select((F.col("a") == F.col("b")).alias("same"), "dim", "rids_a", "ids_a", "data_a", "rids_b", "ids_b", "data_b"))
    with arrow_rows(rows.sparkSession, 8):
        found = written(joined.mapInArrow(_link_rows(threshold), "rid long, vec_id long, n long, root long"), "found")

    counts = found.groupBy("rid").agg(F.sum("n").alias("n_links"))
    # A vec_id's own row links to its root in each block pair; rows of one vec_id are one node.
    classes = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    return (rows.select("rid", "vec_id").join(counts, "rid", "left")
            .join(classes.withColumnRenamed("node", "vec_id"), "vec_id", "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.coalesce("component", "vec_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True))))


def query(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e,
         sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS norm
  FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
l AS (SELECT a.rid, a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.rid <> b.rid AND len(a.e) = len(b.e)
      WHERE a.norm > 0 AND b.norm > 0
        AND list_sum(list_transform(list_zip(a.e, b.e), lambda p: p[1] * p[2])) / (a.norm * b.norm) >= {THRESHOLD}),
r AS (SELECT a AS id, a AS reached FROM l UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.reached),
c AS (SELECT id, min(reached) AS component_id FROM r GROUP BY id)
SELECT e.vec_id, count(l.a) AS n_links, coalesce(min(c.component_id), e.vec_id) AS component_id,
       e.vec_id = coalesce(min(c.component_id), e.vec_id) AS kept
FROM embeddings e LEFT JOIN c ON c.id = e.vec_id LEFT JOIN l ON l.a = e.vec_id GROUP BY e.vec_id"""
