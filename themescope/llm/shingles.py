"""Word shingles of hashed words, and counts over hashed cells."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import lean, written
from themescope.llm.textcodes import mix64

SHINGLE = 5
ID_BITS = 48
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F,
                 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def shingle_counts(values: np.ndarray, offsets: np.ndarray, k: int = SHINGLE):
    """(doc, id, tf): the distinct shingles of each document, ordered by doc and id.

    A document of fewer than ``k`` words has one shingle, all its words; one
    without words has none.  Ids have 48 bits.
    """
    n = np.diff(offsets)
    doc = np.repeat(np.arange(len(n)), n)
    at = np.flatnonzero(np.arange(len(values)) + k <= offsets[1:][doc]) if len(values) else np.zeros(0, np.int64)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h += values[at + j] * _ODD[j]
    docs = doc[at]
    short = np.flatnonzero((n > 0) & (n < k))
    if len(short):
        extra = np.array([(values[offsets[d]:offsets[d + 1]] * _ODD[:n[d]]).sum(dtype=np.uint64) for d in short], np.uint64)
        h, docs = np.concatenate((h, extra)), np.concatenate((docs, short))
    key = (docs.astype(np.uint64) << np.uint64(ID_BITS)) | (mix64(h) >> np.uint64(64 - ID_BITS))
    key = np.sort(key)
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(key)))
    key = key[first]
    return (key >> np.uint64(ID_BITS)).astype(np.int64), key & np.uint64((1 << ID_BITS) - 1), tf


# Counts over cells -------------------------------------------------------------

CHUNK = 1 << 14


def _packed(chunks, counts) -> pa.RecordBatch:
    """Rows (chunk, counts), deflated: most counts are small, and what the driver
    collects is a tenth of the dense arrays."""
    return pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in counts], pa.binary())],
                                      names=["chunk", "counts"])


def _unpacked(counts: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(counts), np.int64)


def _summed(batches):
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for c, x in zip(b.column(0), b.column(1)):
            c, x = c.as_py(), _unpacked(x.as_py())
            if c in sums:
                sums[c] += x
            else:
                sums[c] = x.copy()
    yield _packed(list(sums), sums.values())


def counted_cells(df: DataFrame, count) -> DataFrame:
    """(chunk int, counts binary), written: totals of ``count`` over all rows of
    ``df`` by chunk of ``CHUNK`` cells, only chunks that are not all 0.

    ``count(batches)`` runs once in each task and yields (first chunk, dense
    counts).  The dense arrays are added up in two shuffles by chunk, each task
    streaming through its rows.
    """
    def task(batches):
        for first, total in count(batches):
            some = [at for at in range(0, len(total), CHUNK) if total[at:at + CHUNK].any()]
            yield _packed([first + at // CHUNK for at in some], (total[at:at + CHUNK].astype(np.int64) for at in some))

    schema = "chunk int, counts binary"
    salt = F.floor(F.rand(7) * 16)
    parts = df.mapInArrow(lean(task), schema).repartition("chunk", salt).mapInArrow(lean(_summed), schema)
    return written(parts.repartition("chunk").mapInArrow(lean(_summed), schema), "cells")


def read_cells(cells: DataFrame, n_cells: int, first: int = 0) -> np.ndarray:
    """``n_cells`` totals from chunk ``first`` on: what the driver gets is of that size."""
    n = -(-n_cells // CHUNK)
    total = np.zeros(n * CHUNK, np.int64)
    for r in cells.where(F.col("chunk").between(first, first + n - 1)).collect():
        x = _unpacked(r["counts"])
        at = (r["chunk"] - first) * CHUNK
        total[at:at + len(x)] += x
    return total[:n_cells]


def cell_counts(df: DataFrame, count, n_cells: int) -> np.ndarray:
    """Total of ``count(batches)``, counts over ``n_cells`` cells, over all rows of ``df``."""
    return read_cells(counted_cells(df, lambda batches: [(0, count(batches))]), n_cells)
