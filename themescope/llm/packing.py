"""Packing documents into token windows by the sum-of-squares rule.

Each task packs its share of the documents online.  A level array counts the
partially filled windows of each fill level; a document goes to the level that
makes the sum of the squared counts smallest (a new window is level 0).  A
document longer than a window fills whole windows first.  At the end of a task
the windows still open are closed: the contents of the emptiest are cut to fill
the others, so a task leaves at most one window that is not full.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import lean, table
from themescope.llm.tokens import END_ID, encoded_rows, public_path

WINDOW = 4096
TOKENIZER = "word_bpe_49k.json"
PIECE_SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class LevelPacker:
    """Online sum-of-squares packing of sizes below ``window``."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.count = np.zeros(window + 1, np.int64)       # open windows by fill; 0 and window stay 0
        self.open: dict[int, list[list]] = {}             # fill -> windows, each a list of items

    def level(self, size: int) -> int:
        """The fill to add ``size`` to; of equally good ones the fullest."""
        top = self.window - size
        after = self.count[size:self.window + 1]           # count at h + size for h = 0 .. top
        cost = 2 * after + 1
        cost[top] = 0                                     # a full window is counted nowhere
        cost = cost + np.where(self.count[:top + 1] > 0, 1 - 2 * self.count[:top + 1], np.iinfo(np.int64).max // 4)
        cost[0] = 2 * self.count[size] + 1 if size < self.window else 0
        return top - int(np.argmin(cost[::-1]))

    def place(self, size: int, item) -> list | None:
        """Put ``item``; the window, if that fills it, else None."""
        h = self.level(size)
        if h:
            window = self.open[h].pop()
            self.count[h] -= 1
        else:
            window = []
        window.append((size, item))
        if h + size == self.window:
            return window
        self.open.setdefault(h + size, []).append(window)
        self.count[h + size] += 1
        return None

    def drain(self):
        """The windows still open, fullest first, as lists of (size, item)."""
        for fill in sorted(self.open, reverse=True):
            yield from self.open[fill]
        self.open, self.count = {}, np.zeros_like(self.count)


def _close(windows: list[list], window: int):
    """Open windows (fullest first) refilled: yields lists of (size, item, skip),
    all but the last full.  Donors are the emptiest windows."""
    fills = [sum(s for s, _ in w) for w in windows]
    left, right, spare = 0, len(windows) - 1, []          # spare: pieces cut loose so far
    while left <= right or spare:
        if left <= right:
            out = [(s, item, 0) for s, item in windows[left]]
            room = window - fills[left]
            left += 1
        else:
            out, room = [], window
        while room:
            if not spare:
                if left > right:
                    break
                spare = [(s, item, 0) for s, item in windows[right]]
                right -= 1
            size, item, skip = spare.pop()
            some = min(size, room)
            out.append((some, item, skip))
            room -= some
            if some < size:
                spare.append((size - some, item, skip + some))
        yield out


def _packer(path: str, end_id: int, window: int):
    def pack(batches):
        from pyspark import TaskContext
        first = TaskContext.get().partitionId() << 32
        packer, n, rows, size = LevelPacker(window), 0, [], 0

        def emit(pieces):
            """Rows of one window; a piece is (size, (doc_id, start, doc_tokens, ids), skip)."""
            nonlocal n, size
            at = 0
            for length, (doc, start, tokens, ids), skip in pieces:
                rows.append((doc, start + skip, length, tokens, first + n, at, ids[4 * skip:4 * (skip + length)]))
                at += length
            size += at
            n += 1

        def batch():
            nonlocal size
            kinds = [pa.int64()] * 6 + [pa.binary()]
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")]
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
            rows.clear()
            size = 0
            return out

        for source, k, ids in encoded_rows(batches, path, end_id):
            doc, tokens, at = source.column(0)[k].as_py(), len(ids) // 4, 0
            while tokens - at >= window:
                emit([(window, (doc, at, tokens, ids[4 * at:4 * (at + window)]), 0)])
                at += window
                if size >= 1 << 20:
                    yield batch()
            if at < tokens:
                full = packer.place(tokens - at, (doc, at, tokens, ids[4 * at:]))
                if full:
                    emit([(s, item, 0) for s, item in full])
            if size >= 1 << 20:
                yield batch()
        for pieces in _close(list(packer.drain()), window):
            emit(pieces)
        if rows:
            yield batch()
    return pack


def packed(docs: DataFrame, tokenizer: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, sequence_id, offset, ids) of ``docs`` (doc_id, text).

    Documents are dealt to tasks by a hash of the id, as many as the shuffle
    has partitions; each task packs on its own.  Every id of a document, its end
    id included, lies in exactly one piece.  Sequences are padded to ``window``
    by the reader.  Null text is empty: one end id.  Null ids and repeated rows
    are documents like others; ties leave the order of texts.  An empty table
    has no piece.  Extra columns are ignored.
    """
    dealt = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
             .repartition(F.xxhash64("doc_id")).sortWithinPartitions("doc_id", "text"))
    return dealt.mapInArrow(lean(_packer(tokenizer, end_id, window)), PIECE_SCHEMA)


def query(spark, sf_dir):
    pieces = packed(table(spark, sf_dir, "documents"), public_path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").cast("long").alias("ids_crc32"),
                         "doc_tokens", "sequence_id", "offset")
