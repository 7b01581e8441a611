"""Near-duplicate documents by consistent weighted sampling.

Words are lower-case runs of letters and digits, shingles five words, weights
tf * idf.  Improved consistent weighted sampling (each sample the shingle of
least a = c / (y e^r), with r, c ~ Gamma(2,1) and y on r's grid below the weight)
gives 64 samples; 16 bands of 4 make the candidates, and weighted Jaccard
similarity, sum of minima over sum of maxima, of 0.8 or more makes a link.
Classes are the connected components of the links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from themescope.llm.common import BATCH_ROWS, arrow_rows, lean, table, written
from themescope.llm.graph import components
from themescope.llm.shingles import cell_counts, shingle_counts
from themescope.llm.textcodes import folded_words, mix64, text_slices

THRESHOLD = 0.8
BANDS, ROWS = 16, 4
#: Document frequencies are kept for 2^20 hashed cells: exact sums over all
#: documents, of a size that does not depend on the corpus.
DF_CELLS = 1 << 20
TABLE = 1 << 16
#: Characters that are hashed at a time.
SLICE_CHARS = 1 << 17
#: Nodes and bytes of shingle ids that each of the two parts of a group holds.
GROUP_NODES = 512
GROUP_BYTES = 8 << 20
#: Bits of the filter (half a MB) that keeps texts outside all candidates from being shuffled.
FILTER_BITS = 22
#: Ids from here on are given to rows that have none of their own.
LATE = 1 << 62
SEED = 11


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold a shingle of each cell, number of documents)."""
    def count(batches):
        total = np.zeros(DF_CELLS + 1, np.int64)
        for batch in batches:
            total[DF_CELLS] += batch.num_rows
            for _, texts in text_slices(batch, 0, chars=SLICE_CHARS):
                doc, ids, _ = shingle_counts(*folded_words(texts))
                cell = np.sort((doc.astype(np.uint64) << np.uint64(20)) | (ids & np.uint64(DF_CELLS - 1)))
                cell = cell[np.concatenate(([True], cell[1:] != cell[:-1]))] if len(cell) else cell
                found, n = np.unique((cell & np.uint64(DF_CELLS - 1)).astype(np.int64), return_counts=True)
                total[found] += n
        return total

    total = cell_counts(docs.select("text"), count, DF_CELLS + 1)
    return total[:DF_CELLS], int(total[DF_CELLS])


def idf_table(df: np.ndarray, n_docs: int) -> np.ndarray:
    """Smooth idf scaled to 1 .. 2, so that wide-spread shingles still count."""
    return (1 + np.log((1 + n_docs) / (1 + np.minimum(df, n_docs))) / np.log(2 + n_docs)).astype(np.float32)


class Sampler:
    """Weighted samples of shingle sets.  The random variates of a shingle come
    from fixed tables of 2^16 draws that hashes of the shingle index."""

    def __init__(self, n: int = BANDS * ROWS, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.odd = rng.integers(0, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2, 1, TABLE).astype(np.float32)
        self.beta = rng.random(TABLE, np.float32)
        # ln c - r is what a sample needs besides y; 256 keeps the key positive.
        self.ln_c = (np.log(rng.gamma(2, 1, TABLE)) + 256).astype(np.float32)

    def __call__(self, starts: np.ndarray, ids: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """(documents, samples) of u32; ``starts`` are the first shingles of the documents."""
        z, ln_w = mix64(ids), np.log(weights).astype(np.float32)
        low = z & np.uint64(0xFFFFFFFF)
        out = np.empty((len(starts), len(self.odd)), np.uint32)
        for k, odd in enumerate(self.odd):
            x = z * odd
            r = self.r[x >> np.uint64(48)]
            beta = self.beta[(x >> np.uint64(32)) & np.uint64(0xFFFF)]
            grid = np.floor(ln_w / r + beta)
            ln_a = self.ln_c[(x >> np.uint64(16)) & np.uint64(0xFFFF)] - r * (grid - beta + 1)
            key = (np.maximum(ln_a, 0).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low
            out[:, k] = np.minimum.reduceat(key, starts)
        return out


def band_hashes(samples: np.ndarray) -> np.ndarray:
    out = np.empty((len(samples), BANDS), np.int64)
    for b in range(BANDS):
        h = np.full(len(samples), b + 1, np.uint64)
        for j in range(ROWS):
            h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + samples[:, b * ROWS + j])
        out[:, b] = h.view(np.int64)
    return out


def text_keys(hashes: np.ndarray, offsets: np.ndarray, texts: list[str]) -> list[bytes]:
    """16 bytes that tell the word sequences apart; texts without words by their characters."""
    n = np.diff(offsets)
    place = (np.arange(len(hashes)) - np.repeat(offsets[:-1], n)).astype(np.uint64)
    out = []
    for odd in (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)):
        each = mix64(hashes + mix64((place + np.uint64(1)) * odd))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each)))
        out.append(mix64(sums[offsets[1:]] - sums[offsets[:-1]] + odd))
    both = np.stack(out, 1)
    return [both[i].tobytes() if n[i] else hashlib.md5(b"text:" + t.encode("utf-8", "surrogatepass")).digest()
            for i, t in enumerate(texts)]


def signatures(docs: DataFrame, idf) -> DataFrame:
    """(doc_id, key, bands) of docs (doc_id, text); no words, no bands."""
    def sign(batches):
        weights, sampler = idf.value, Sampler()
        for batch in batches:
            for at, texts in text_slices(batch, 1, chars=SLICE_CHARS):
                hashes, offsets = folded_words(texts)
                doc, ids, tf = shingle_counts(hashes, offsets)
                bands = [[] for _ in texts]
                if len(doc):
                    first = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
                    w = tf * weights[(ids & np.uint64(DF_CELLS - 1)).astype(np.int64)]
                    # Cache-sized runs of whole documents.
                    cuts = np.unique(np.searchsorted(first, np.arange(0, len(ids), 1 << 15)))
                    for a, b in zip(cuts, [*cuts[1:], len(first)]):
                        if a == b:
                            continue
                        lo, hi = first[a], first[b] if b < len(first) else len(ids)
                        made = band_hashes(sampler(first[a:b] - lo, ids[lo:hi], w[lo:hi]))
                        for d, x in zip(doc[first[a:b]], made):
                            bands[d] = x
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(texts)), pa.array(text_keys(hashes, offsets, texts), pa.binary()),
                     pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "key", "bands"])
    return docs.mapInArrow(lean(sign), "doc_id long, key binary, bands array<long>")


def _cells_of(nodes: np.ndarray) -> np.ndarray:
    return (mix64(nodes.astype(np.int64).view(np.uint64)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def node_filter(nodes: DataFrame) -> np.ndarray:
    """A bit per hashed cell for the ids in ``nodes`` (one long column): of fixed
    size, so it can be sent to all tasks; the join after it makes it exact."""
    def count(batches):
        total = np.zeros(1 << FILTER_BITS, np.uint8)
        for batch in batches:
            total[_cells_of(batch.column(0).to_numpy())] = 1
        return total
    return np.packbits(cell_counts(nodes, count, 1 << FILTER_BITS) > 0)


def vectors(docs: DataFrame, nodes: DataFrame, idf) -> DataFrame:
    """(node, ids, tfs) of the rows of docs (node, text) whose node is in ``nodes``
    (node): sorted 48-bit shingle ids, six bytes each, and their counts."""
    wanted = docs.sparkSession.sparkContext.broadcast(node_filter(nodes))

    def make(batches):
        bits = wanted.value
        for batch in batches:
            cell = _cells_of(batch.column(0).to_numpy())
            batch = batch.filter(pa.array((bits[cell >> 3] >> (7 - (cell & 7)) & 1).astype(bool)))
            for first, texts in text_slices(batch, 1, chars=SLICE_CHARS):
                doc, ids, tf = shingle_counts(*folded_words(texts))
                at = np.searchsorted(doc, np.arange(len(texts) + 1))
                six = np.ascontiguousarray(ids.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
                tf = tf.astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(texts)), pa.array([six[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary()),
                     pa.array([tf[a:b].tobytes() if (tf[a:b] > 1).any() else b"" for a, b in zip(at, at[1:])], pa.binary())],
                    names=["node", "ids", "tfs"])
    made = docs.mapInArrow(lean(make), "node long, ids binary, tfs binary")
    return made.join(nodes, "node", "left_semi").dropDuplicates(["node"])


def unpacked(ids, tfs, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ids, weights) of a stored vector; no counts stored, all are 1."""
    full = np.zeros((len(ids) // 6, 8), np.uint8)
    full[:, :6] = np.frombuffer(ids, np.uint8).reshape(-1, 6)
    full = full.view("<u8").ravel()
    weights = idf[(full & np.uint64(DF_CELLS - 1)).astype(np.int64)]
    return full, weights * np.frombuffer(tfs, "<u4").astype(np.float32) if len(tfs) else weights


def weighted_jaccard(ids_a, w_a, ids_b, w_b) -> float:
    if len(ids_a) == 0 or len(ids_b) == 0:
        return 0.0
    at = np.minimum(np.searchsorted(ids_b, ids_a), len(ids_b) - 1)
    same = ids_b[at] == ids_a
    low = float(np.minimum(w_a[same], w_b[at[same]]).sum(dtype=np.float64))
    return low / (float(w_a.sum(dtype=np.float64)) + float(w_b.sum(dtype=np.float64)) - low)


def similarities(pairs: DataFrame, vecs: DataFrame, idf) -> DataFrame:
    """(a, b, sim) of the pairs (a, b)."""
    def compare(batches):
        for batch in batches:
            side = [batch.column(i) for i in range(2, 6)]
            sim = []
            for k in range(batch.num_rows):
                ia, ta, ib, tb = (c[k].as_py() for c in side)
                sim.append(weighted_jaccard(*unpacked(ia, ta, idf.value), *unpacked(ib, tb, idf.value)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim, pa.float64())], names=["a", "b", "sim"])

    side = lambda n: vecs.select(F.col("node").alias(n), F.col("ids").alias(f"ids_{n}"), F.col("tfs").alias(f"tfs_{n}"))
    joined = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ids_a", "tfs_a", "ids_b", "tfs_b")
    return joined.mapInArrow(lean(compare), "a long, b long, sim double")


def _open_links(ids: list, weights: list, comp: np.ndarray, threshold: float):
    """Index pairs that connect the components of one group as far as similarities
    do: every node outside the largest component is compared with all others."""
    n = [len(x) for x in ids]
    row = np.repeat(np.arange(len(ids)), n)
    word, col = np.unique(np.concatenate(ids), return_inverse=True)
    w = np.concatenate(weights)
    total = np.bincount(row, w, len(ids))
    comp, waiting, out = comp.copy(), np.ones(len(ids), bool), []
    dense = np.zeros(len(word), np.float32)
    first = np.concatenate(([0], np.cumsum(n)))
    while True:
        names, where, sizes = np.unique(comp, return_inverse=True, return_counts=True)
        left = np.flatnonzero(waiting & (where != sizes.argmax()))
        if len(left) == 0:
            return out
        k = left[0]
        waiting[k] = False
        mine = slice(first[k], first[k + 1])
        dense[col[mine]] = w[mine]
        low = np.bincount(row, np.minimum(w, dense[col]), len(ids))
        dense[col[mine]] = 0
        similar = low >= threshold * (total + total[k] - low)
        for c in np.unique(comp[similar & (comp != comp[k])]):
            out.append((k, int(np.flatnonzero(similar & (comp == c))[0])))
            comp[comp == c] = comp[k]


def _group_links(threshold: float, idf):
    def run(batches):
        key, held = None, []

        def links():
            nodes = [h[0] for h in held]
            pairs = _open_links([h[2] for h in held], [h[3] for h in held], np.array([h[1] for h in held]), threshold)
            return pa.RecordBatch.from_arrays([pa.array([nodes[x] for x, _ in pairs], pa.int64()),
                                               pa.array([nodes[y] for _, y in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(4))))
            for r, k in enumerate(keys):
                if k != key and held:
                    yield links()
                    held = []
                key = k
                held.append((batch.column(4)[r].as_py(), batch.column(5)[r].as_py(),
                             *unpacked(batch.column(6)[r].as_py(), batch.column(7)[r].as_py(), idf.value)))
        if held:
            yield links()
    return run


def numbered(docs: DataFrame) -> tuple[DataFrame, bool]:
    """(docs as (_row, _id), whether ids are shared): _id is doc_id, or a number of
    their own, ``LATE`` or more, for rows whose doc_id stands with different texts."""
    doc_id = F.col("doc_id").cast("long")
    text = xxhash64_text("text")
    shared = written(docs.select(doc_id.alias("_of"), text.alias("h")).where("_of IS NOT NULL").groupBy("_of")
                     .agg(F.min("h").alias("lo"), F.max("h").alias("hi")).where("lo <> hi").select("_of"), "shared-ids")
    rows = docs.select(F.struct(*docs.columns).alias("_row"))
    doc_id = F.col("_row.doc_id").cast("long")
    if shared.first() is None:
        return rows.withColumn("_id", doc_id), False
    own = F.lit(LATE) + F.pmod(F.xxhash64(doc_id, F.coalesce("_row.text", F.lit(""))), F.lit(1 << 60))
    rows = rows.withColumn("_key", doc_id).join(shared, F.col("_key") == F.col("_of"), "left")
    return rows.select("_row", F.when(F.col("_of").isNotNull(), own).otherwise(F.col("_key")).alias("_id")), True


def xxhash64_text(text: str):
    return F.xxhash64(F.coalesce(text, F.lit("")))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept), one row per row of ``docs`` (doc_id, text).

    As ``classes``, but a doc_id may stand with different texts: such rows are
    documents of their own, and name a class only where it has no other id.
    Extra columns are ignored.
    """
    rows, shared = numbered(docs.select("doc_id", "text"))
    found = classes(rows.select(F.col("_id").alias("doc_id"), "_row.text"), threshold)
    if not shared:
        return found
    own = written(rows.where(F.col("_id") >= LATE).select("_id", F.col("_row.doc_id").cast("long").alias("_doc")).distinct(), "own-ids")
    for c in ("doc_id", "class_id"):
        found = (found.join(own, F.col(c) == F.col("_id"), "left")
                 .withColumn(c, F.coalesce("_doc", c)).drop("_id", "_doc"))
    return found.select("doc_id", "class_id", "kept")


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, kept), one row per row of ``docs`` (doc_id, text).

    class_id is the least doc_id of the class, kept marks that document.

    Texts of equal words are one node from the start.  In each bucket of a band
    every node is compared with the least one.  Buckets whose nodes are not all
    connected by then are compared in full, each node outside the largest
    component with all others, in groups of bounded size (a large bucket is
    split, and the parts meet two by two); pairs are never written, only links
    that connect something.  So no link that shares a bucket is lost.

    Null text counts as empty; all texts without words and with equal
    characters are one class.  Fewer than five words make one shingle.  Rows of
    one doc_id must have one text.  Rows without doc_id join the class of equal
    words and are compared through it; where no row of that class has an id,
    class_id is null and each such row is kept.  An empty table gives no rows;
    extra columns are ignored.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, BATCH_ROWS):
        df, n_docs = document_frequencies(docs)
    idf = spark.sparkContext.broadcast(idf_table(df, n_docs))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(spark, BATCH_ROWS):
        signed = written(signatures(rows, idf), "signatures")
    nodes = written(signed.where("doc_id IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("node"), F.min("bands").alias("bands")), "nodes")

    band = written(nodes.select("node", F.posexplode("bands").alias("band", "bucket")), "bands")
    heads = (band.groupBy("band", "bucket").agg(F.min("node").alias("head"), F.count(F.lit(1)).alias("n"))
             .where("n > 1").drop("n"))
    members = written(band.join(heads, ["band", "bucket"]), "members")
    stars = members.where("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct()
    stars = written(stars, "stars")
    needed = stars.select(F.col("a").alias("node")).union(stars.select("b")).distinct()
    with arrow_rows(spark, BATCH_ROWS):
        vecs = written(vectors(rows.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("node"), "text"), needed, idf), "vectors")
    with arrow_rows(spark, 512):
        tried = written(similarities(stars, vecs, idf), "tried")
    links = tried.where(F.col("sim") >= threshold).select("a", "b")
    first = written(components(links), "classes")

    # Buckets in which three or more nodes are not all connected yet.
    all_nodes = members.select("band", "bucket", "node").join(first, "node", "left")
    all_nodes = all_nodes.withColumn("c", F.coalesce("component", "node")).join(
        vecs.select("node", F.length("ids").alias("size")), "node")
    open_ = (all_nodes.groupBy("band", "bucket")
             .agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("lo"), F.max("c").alias("hi"), F.sum("size").alias("bytes"))
             .where("n > 2 AND lo <> hi")
             .select("band", "bucket", F.ceil(F.greatest(F.col("n") / GROUP_NODES, F.col("bytes") / GROUP_BYTES)).cast("int").alias("parts")))
    i = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    dealt = (all_nodes.join(open_, ["band", "bucket"]).withColumn("i", i)
             .select("band", "bucket", "node", "c", "i", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("j"))
             .select("band", "bucket", F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), "node", "c"))
    groups = (dealt.join(vecs, "node").select("band", "bucket", "i", "j", "node", "c", "ids", "tfs")
              .repartition("band", "bucket", "i", "j").sortWithinPartitions("band", "bucket", "i", "j", "node"))
    with arrow_rows(spark, 512):
        more = written(groups.mapInArrow(lean(_group_links(threshold, idf)), "a long, b long"), "more-links")
    # The classes found so far are stars already: what is left is to join them.
    joined = components(first.select(F.col("component").alias("a"), F.col("node").alias("b")).unionByName(more))

    of_key = (nodes.select("key", "node").join(joined, "node", "left")
              .select("key", F.coalesce("component", "node").alias("class_id")))
    return (signed.select("doc_id", "key").join(of_key, "key", "left")
            .select("doc_id", "class_id", (F.col("class_id").isNull() | F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False))).alias("kept")))


def one_per_class(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: of each class one row, that
    of its least doc_id.  Rows whose id stands with different texts, and then
    rows without id, come after all others, in the order of a hash of id and
    text.  Columns of any name are kept as they are."""
    rows, _ = numbered(docs)
    late = F.lit(LATE + (1 << 60)) + F.pmod(xxhash64_text("_row.text"), F.lit(1 << 60))
    rows = rows.withColumn("_id", F.coalesce("_id", late))
    found = classes(rows.select(F.col("_id").alias("doc_id"), "_row.text"))
    keep = found.where("kept").select(F.col("doc_id").alias("_id")).distinct()
    # Repeated rows of one id and text: the first; the join has them next to each other.
    first = F.row_number().over(Window.partitionBy("_id").orderBy("_id"))
    return rows.join(keep, "_id", "left_semi").withColumn("_nth", first).where("_nth = 1").select("_row.*")


def query(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
