"""Byte passages that stand earlier in the corpus, by a run-length index.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a
document of smaller id, or in the same one.  Strings are called windows below.

1. *Anchors.*  The least hashed ``GRAM`` bytes inside a window are its anchor, so equal windows
   have equal anchors.  Windows that share one anchor occurrence lie side by side (their
   bytes are its *context*, at most 2 * LENGTH - GRAM) and never equal each other.  Each task
   deals out the anchors of its text with a hash of their context, equal ones once.  Tasks by
   anchor answer: of equal contexts all but the first stand earlier as a whole; first ones
   are asked for if their anchor has other contexts as well.
2. *Contexts* asked for are cut from the texts and sent to tasks by anchor.
3. *Index.*  The contexts of each anchor are ordered by place and halved, and the halves
   again, down to single contexts.  On each level the earlier halves go into one
   run-compressed Burrows-Wheeler transform with sampled run ends (``runindex``), and the
   later halves stream through it: where their matching statistics reach LENGTH, the
   window stands earlier.  Windows found on one level leave the levels below, so whatever
   a window still meets there belongs to its own anchor's half.
4. *Cut.*  Texts meet their windows and drop the bytes these cover.

Anchors at the edge of a very common passage have a context of their own in every document.
A sample of the documents names the commonest of them; these are dealt out window by
window, each with a hash of its own as anchor, so no task gets all of them.
"""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import shuffle_partitions, table, written
from themescope.llm.runindex import RunIndex
from themescope.llm.textcodes import mix64

LENGTH = 100
GRAM = 40
#: A task deals out the anchors of about so many bytes together.
FLUSH_BYTES = 4 << 20
#: Bytes of text for each task by anchor.
BUCKET_BYTES = 16 << 20
#: One in so many documents is looked at for anchors with many contexts.
SAMPLE = 64
#: Contexts in the sample from which an anchor is dealt out by window; at most so many anchors are.
MANY, MOST_MANY = 64, 1 << 14
#: Bytes of contexts that are indexed together.
INDEX_BYTES = 2 << 20
_SEGMENT = 1 << 18                                      # windows hashed at a time
_SPAN = LENGTH - GRAM + 1                                # grams of a window
_FIRST = -(1 << 63)                                      # stands for a null id: before all others


def _words(b: np.ndarray, n: int, at: int) -> np.ndarray:
    """Eight bytes from each of the positions at .. at+n-1 on."""
    return np.ndarray(n, "<u8", b, offset=at, strides=(1,))


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    n = len(b) - GRAM + 1
    h = mix64(_words(b, n, 0))
    for at in range(8, GRAM, 8):
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + _words(b, n, at))
    return h


def _window_hashes(b: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two hashes of the windows at these positions."""
    words, both = _words(b, len(b) - 7, 0), []
    for seed in (0x9E3779B97F4A7C15, 0xD1342543DE82EF95):
        h = np.full(len(at), seed, np.uint64)
        for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
            h = mix64(h * np.uint64(seed) + words[at + k])
        both.append(h)
    return both


def _least(a: np.ndarray, span: int) -> np.ndarray:
    size = 1
    out = a
    while 2 * size <= span:
        out = np.minimum(out[:-size], out[size:])
        size *= 2
    return np.minimum(out[:len(a) - span + 1], out[span - size:])


def anchors(texts: list[bytes]):
    """(text, first window, number of windows, hash) of the anchors of some texts, in order."""
    b = np.frombuffer(b"".join(texts), np.uint8)
    end = np.cumsum([len(t) for t in texts])
    total = len(b) - LENGTH + 1
    starts, places, values, before = [], [], [], -1
    for s in range(0, total, _SEGMENT):
        m = min(_SEGMENT, total - s)
        h = _gram_hashes(b[s:s + m + LENGTH - 1])
        # 44 bits of the hash, then the position: of equal grams the leftmost.
        least = _least((h & ~np.uint64((1 << 20) - 1)) | np.arange(len(h), dtype=np.uint64), _SPAN)
        at = (least & np.uint64((1 << 20) - 1)).astype(np.int64)
        new = np.flatnonzero(np.concatenate(([s + at[0] != before], at[1:] != at[:-1])))
        starts.append(s + new)
        places.append(s + at[new])
        values.append(h[at[new]])
        before = s + at[-1]
    if not starts:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64))
    first, place, value = (np.concatenate(x) for x in (starts, places, values))
    # Windows with one anchor occurrence, those that lie inside its text.
    text = np.searchsorted(end, place, "right")
    begin = np.concatenate(([0], end))[text]
    stop = np.minimum(np.append(first[1:], total), end[text] - LENGTH + 1)
    first = np.maximum(first, begin)
    keep = stop > first
    return text[keep], (first - begin)[keep], (stop - first)[keep], value[keep]


def _flushes(batches, columns: list[str], of: str):
    """Rows of the batches as lists of columns, about FLUSH_BYTES of column ``of`` at a time."""
    held, size = {c: [] for c in columns}, 0
    for batch in batches:
        col = {c: batch.column(batch.schema.get_field_index(c)) for c in columns}
        for k in range(batch.num_rows):
            for c in columns:
                held[c].append(col[c][k].as_py())
            size += len(held[of][-1])
            if size >= FLUSH_BYTES:
                yield held
                held, size = {c: [] for c in columns}, 0
    if held[of]:
        yield held


_DEALT = "bucket int, known boolean, hash binary, context binary, id binary, key binary, window binary"
_ANSWER = "key long, id long, window long, hash long, asked boolean"
_PACKED = (("hash", np.uint64), ("context", np.uint64), ("id", np.int64), ("key", np.int64), ("window", np.int64))


def _context_hashes(texts: list[bytes], text, first, number) -> np.ndarray:
    """A hash of each context: its 8-byte words, taken from its first byte on and back from its last."""
    b = np.frombuffer(b"".join(texts) + bytes(8), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    at = (np.cumsum(size) - size)[text] + first
    words, length = _words(b, len(b) - 7, 0), number + LENGTH - 1
    h = mix64(length.astype(np.uint64))
    for k in range(0, 2 * LENGTH - GRAM, 8):
        more = length > k
        place = at + np.minimum(k, length - 8)           # the last word overlaps the one before
        h = np.where(more, mix64(h * np.uint64(0x9E3779B97F4A7C15) + words[np.where(more, place, 0)]), h)
    return h


def dealt(ids, keys, texts, many: np.ndarray) -> list[np.ndarray]:
    """Anchor, context, id, key and window (first * 256 + number) of some texts' anchors;
    those of ``many`` by window."""
    text, first, number, value = anchors(texts)
    context = _context_hashes(texts, text, first, number)
    wide = np.isin(value, many)
    if wide.any():
        k = np.repeat(np.flatnonzero(wide), number[wide])
        step = np.arange(len(k)) - np.repeat(np.cumsum(number[wide]) - number[wide], number[wide])
        size = np.array([len(t) for t in texts], np.int64)
        at = (np.cumsum(size) - size)[text[k]] + first[k] + step
        hashes = _window_hashes(np.frombuffer(b"".join(texts), np.uint8), at)
        text, first = np.concatenate((text[~wide], text[k])), np.concatenate((first[~wide], first[k] + step))
        number = np.concatenate((number[~wide], np.ones(len(k), np.int64)))
        value, context = (np.concatenate((x[~wide], h)) for x, h in zip((value, context), hashes))
    return [value, context, np.array(ids, np.int64)[text], np.array(keys, np.int64)[text], (first << 8) | number]


def _ordered(value, context, id_, key, window):
    """Entries by anchor, context and place; which are the first of their context; which
    stand at the place of that one (a row that is repeated)."""
    order = np.lexsort((window, key, id_, context, value))
    value, context, id_, key, window = (x[order] for x in (value, context, id_, key, window))
    new = np.ones(len(value), bool)
    new[1:] = (value[1:] != value[:-1]) | (context[1:] != context[:-1])
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    same = (id_ == id_[first]) & (key == key[first]) & (window == window[first])
    return new, same, [value, context, id_, key, window]


def _deal(buckets: int, many: np.ndarray):
    """Texts -> their anchors by bucket; contexts that the task's own text holds earlier are known."""
    names = [x.split()[0] for x in _DEALT.split(", ")]
    types = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]

    def deal(batches):
        from pyspark import TaskContext
        task, turn = TaskContext.get().partitionId(), 0
        for rows in _flushes(batches, ["id", "key", "bytes"], "bytes"):
            new, same, entries = _ordered(*dealt(rows["id"], rows["key"], rows["bytes"], many))
            bucket = ((entries[0][new] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            fresh = [x[new][order] for x in entries]
            cut = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out = [(int(k), False, *[x[cut[k]:cut[k + 1]].tobytes() for x in fresh]) for k in np.flatnonzero(np.diff(cut))]
            turn += 1
            out.append(((task * 31 + turn) % buckets, True, *[x[~same].tobytes() for x in entries]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
    return deal


def _answer(batches):
    """Dealt anchors -> windows that stand earlier, and contexts asked for."""
    names = [x.split()[0] for x in _ANSWER.split(", ")]

    def rows(which, value, context, id_, key, window, asked):
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (
            key[which], id_[which], window[which], value[which].view(np.int64), asked[which])], names)

    held: dict[int, list] = {}
    for batch in batches:
        for r in batch.to_pylist():
            entries = [np.frombuffer(r[c], t) for c, t in _PACKED]
            if r["known"]:
                every = np.ones(len(entries[0]), bool)
                yield rows(every, *entries, ~every)
            else:
                held.setdefault(r["bucket"], []).append(entries)
    for bucket in list(held):
        new, same, entries = _ordered(*(np.concatenate(x) for x in zip(*held.pop(bucket))))
        value = entries[0]
        edge = np.flatnonzero(np.concatenate(([True], value[1:] != value[:-1])))
        contexts = np.repeat(np.add.reduceat(new.astype(np.int64), edge), np.diff(np.append(edge, len(value))))
        yield rows(~same | (new & (contexts > 1)), *entries, same)


_CONTEXT = "bucket int, hash long, id long, key long, first long, bytes binary"


def _contexts(buckets: int):
    """Texts with the contexts asked for -> these by bucket."""
    names = [x.split()[0] for x in _CONTEXT.split(", ")]
    types = [pa.int32(), *[pa.int64()] * 4, pa.binary()]

    def contexts(batches):
        for rows in _flushes(batches, ["id", "key", "bytes", "found"], "bytes"):
            out = []
            for id_, key, text, found in zip(*rows.values()):
                for value, window in {(f["hash"], f["window"]) for f in found}:
                    first, n = window >> 8, window & 255
                    out.append(((value >> 20) % buckets, value, id_, key, first, text[first:first + n + LENGTH - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)], names)
    return contexts


def earlier_windows(hashes: list[int], contexts: list[bytes]) -> list[np.ndarray]:
    """For each context whether its windows stand in an earlier context of the same anchor.

    ``contexts`` are distinct, those of one anchor side by side and in order.  Level by
    level: the earlier half of each anchor's block is indexed, the later half streamed."""
    value = np.array(hashes)
    new = np.concatenate(([True], value[1:] != value[:-1]))
    group = np.cumsum(new) - 1
    rank = np.arange(len(value)) - np.flatnonzero(new)[group]
    done = [np.zeros(max(len(c) - LENGTH + 1, 0), bool) for c in contexts]
    hit = [False] * len(contexts)                        # some of its windows found
    depth = int(rank.max()).bit_length()
    for level in range(depth - 1, -1, -1):
        block, side = (group << 32) | (rank >> (level + 1)), (rank >> level) & 1
        both = np.intersect1d(block[side == 0], block[side == 1])
        meets = np.isin(block, both)
        earlier, later = ([(k, a, n) for k in np.flatnonzero(meets & (side == s)).tolist()
                           for a, n in (_stretches(~done[k]) if hit[k] else [(0, len(done[k]))])] for s in (0, 1))
        if not earlier or not later:
            continue
        index = RunIndex([contexts[k][a:a + n + LENGTH - 1] for k, a, n in earlier])
        found = index.matching_statistics([contexts[k][a:a + n + LENGTH - 1] for k, a, n in later], LENGTH)
        for (k, a, _), at in zip(later, found):
            if len(at):
                done[k][a + at] = hit[k] = True
    return done


def _stretches(mask: np.ndarray) -> list[tuple[int, int]]:
    """(first, number) of the runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], mask, [False])).astype(np.int8)))
    return list(zip(edge[::2].tolist(), (edge[1::2] - edge[::2]).tolist()))


def _match(batches):
    """Contexts by bucket -> (key, first, n): windows that stand earlier."""
    schema = pa.schema([("key", pa.int64()), ("first", pa.int64()), ("n", pa.int32())])

    def matched(some):
        out = []
        for (_, _, key, first, _), done in zip(some, earlier_windows([x[0] for x in some], [x[4] for x in some])):
            if done.any():
                out += [(key, first + a, n) for a, n in _stretches(done)]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else ((), (), ()), schema.types)], schema=schema)

    # A row that is repeated asks twice for the same place.
    rows = sorted({x for batch in batches for x in zip(*(batch.column(k).to_pylist() for k in range(1, 6)))})
    some, size = [], 0
    for k, row in enumerate(rows):
        some.append(row)
        size += len(row[4])
        if k + 1 == len(rows) or size >= INDEX_BYTES and rows[k + 1][0] != row[0]:
            yield matched(some)
            some, size = [], 0


def _cut(batches):
    """Texts with their windows -> spans of bytes removed, bytes kept."""
    span = pa.struct([("start", pa.int64()), ("length", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])
    for batch in batches:
        out: list = [[], [], [], []]
        for doc, text, first, number in zip(*(batch.column(k) for k in range(4))):
            text, first = text.as_py(), first.values
            spans, kept = [], text
            if first is not None and len(first):
                cover = np.zeros(len(text) + 1, np.int64)
                a, n = first.to_numpy(), number.values.to_numpy()
                np.add.at(cover, a, 1)
                np.add.at(cover, a + n + LENGTH - 1, -1)
                found = _stretches(np.cumsum(cover[:-1]) > 0)
                spans = [{"start": a, "length": n} for a, n in found]
                kept = b"".join(text[a + n:b] for (a, n), (b, _) in zip([(0, 0), *found], [*found, (len(text), 0)]))
            for o, x in zip(out, (doc.as_py(), len(text), spans, kept)):
                o.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, schema.types)], schema=schema)


def many_contexts(texts: DataFrame) -> np.ndarray:
    """Anchors with the most contexts in a sample of the texts, in ascending order: a bounded
    list that settles only how these are dealt out."""
    def sampled(batches):
        for rows in _flushes(batches, ["id", "key", "bytes"], "bytes"):
            value, context, *_ = dealt(rows["id"], rows["key"], rows["bytes"], np.zeros(0, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(context.view(np.int64))], ["hash", "context"])

    some = texts.where(F.pmod("key", F.lit(SAMPLE)) == 0).mapInArrow(sampled, "hash long, context long").distinct()
    often = some.groupBy("hash").count().where(F.col("count") >= MANY).orderBy(F.desc("count"), "hash").limit(MOST_MANY)
    return np.sort(np.array([r[0] for r in often.collect()], np.int64).view(np.uint64))


@contextmanager
def shuffles_removed(spark):
    """Shuffle files of the queries inside go when a query ends: their results are read from tables."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    old = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, old)


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every row of ``docs`` (doc_id, text): bytes of the
    text, maximal (start, length) of what is removed, the remaining bytes.

    Null texts are empty; a null id comes before all others; rows of one id that hold
    different texts are documents of their own, in the order of a hash of the text; rows
    that repeat id and text are one document and answered alike; texts shorter than the
    window lose nothing; an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("bytes"))
    d = d.withColumn("key", F.xxhash64(F.col("doc_id").isNull(), "doc_id", "bytes")).withColumn("id", F.coalesce("doc_id", F.lit(_FIRST)))
    size = d.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(spark), size // BUCKET_BYTES)
    long = d.where(F.octet_length("bytes") >= LENGTH).select("id", "key", "bytes")
    with shuffles_removed(spark):
        entries = long.mapInArrow(_deal(buckets, many_contexts(long)), _DEALT)
        found = written(entries.repartition(buckets, "bucket").mapInArrow(_answer, _ANSWER), "anchors")
        asked = found.where("asked").groupBy("key").agg(F.collect_list(F.struct("hash", "window")).alias("found"))
        context = long.join(asked, "key").select("id", "key", "bytes", "found").mapInArrow(_contexts(buckets), _CONTEXT)
        marks = written(context.repartition(buckets, "bucket").mapInArrow(_match, "key long, first long, n int"), "windows")
    marks = marks.unionByName(found.where("not asked").select(
        "key", F.shiftright("window", 8).alias("first"), F.col("window").bitwiseAND(255).cast("int").alias("n")))
    marks = marks.groupBy("key").agg(F.collect_list("first").alias("first"), F.collect_list("n").alias("n"))
    return d.join(marks, "key", "left").select("doc_id", "bytes", "first", "n").mapInArrow(
        _cut, "doc_id long, n_bytes long, spans array<struct<start long, length long>>, kept binary")


def query(spark, sf_dir):
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["length"])
    return without_repeats(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"))
