"""Token ids in grammar-compressed shards (Re-Pair).

Documents are range-partitioned by doc_id, encoded in ascending order and cut
into shards of about ``shard_tokens`` ids.  In a shard the most frequent
neighbouring pairs are replaced by new symbols (nonterminals), round after
round, until no pair is frequent.  Pairs never span two documents, so each
document is a run of symbols that can be decoded on its own; the stored
expansion lengths lead to any position inside a long document.

File format: Parquet, one row per shard.

==============  ==============================================================
part, block     position: shards in this order hold the documents in order
doc_ids         ids of the documents, in order
doc_tokens      their numbers of ids, end id included
doc_symbols     their numbers of symbols in ``body``
width           2 or 4: bytes of a symbol
alphabet        u32: id of the symbols 0 .. a-1
rules           symbol pairs; rule k is symbol a+k
lengths         u32: number of ids that rule k expands to
body            symbols of all documents, one after another
==============  ==============================================================
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import starts, table
from themescope.llm.tokens import END_ID, encoded_rows, public_path
from themescope.session import scratch_path

SHARD_TOKENS = 1 << 18
#: A pair is worth a rule from this many occurrences on.
MIN_COUNT = 8
#: A round replaces every pair that occurs at least max / CLASS times.
CLASS = 16
#: Rules up to this many ids are decoded from a table.
TABLED = 64
TOKENIZER = "byte_bpe_50k.json"
SHARD_SCHEMA = ("part int, block int, doc_ids array<long>, doc_tokens array<long>, doc_symbols array<long>, "
                "width int, alphabet binary, rules binary, lengths binary, body binary")


def _pair_counts(keys):
    keys = np.sort(keys)
    edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[edge], np.diff(np.append(edge, len(keys)))


def _replaceable(at):
    """Whether a pair position is one of every other of its run: no two overlap."""
    first = np.concatenate(([True], at[1:] != at[:-1] + 1))
    run_start = np.maximum.accumulate(np.where(first, at, 0))
    return (at - run_start) & 1 == 0


def compress(ids: np.ndarray, doc_tokens: np.ndarray, min_count: int = MIN_COUNT) -> dict:
    """Re-Pair of one shard.  Pairs of one frequency class are replaced in the
    same round; where two of them overlap the left one wins."""
    alphabet = np.flatnonzero(np.bincount(ids))
    rank = np.zeros(int(alphabet[-1]) + 1 if len(alphabet) else 1, np.uint32)
    rank[alphabet] = np.arange(len(alphabet))
    body = rank[ids]
    width = 2 if len(alphabet) <= 60_000 else 4
    most = (1 << 16) - 1 if width == 2 else (1 << 32) - 1
    sym, key, shift = (np.uint16, np.uint32, 16) if width == 2 else (np.uint32, np.uint64, 32)
    body = body.astype(sym)
    last = np.zeros(len(body), bool)                     # of its document
    last[np.cumsum(doc_tokens) - 1] = True
    # Pairs are hashed to 2^16 cells.
    mix, down = (key(0x9E3779B1), key(16)) if width == 2 else (key(0x9E3779B97F4A7C15), key(48))
    base, rules, lengths = len(alphabet), [], [np.ones(len(alphabet), np.int64)]
    n_rules = 0
    while len(body) > 1 and base + n_rules < most:
        keys = (body[:-1].astype(key) << key(shift)) | body[1:]
        inside = ~last[:-1]
        if not inside.any():
            break
        # A hashed histogram first: only pairs of cells with enough occurrences are sorted.
        cell = ((keys * mix) >> down).astype(np.uint16)
        heavy = np.bincount(cell, minlength=1 << 16) >= min_count
        maybe = np.flatnonzero(heavy[cell] & inside)
        if len(maybe) == 0:
            break
        pairs, counts = _pair_counts(keys[maybe])
        top = int(counts.max())
        if top < min_count:
            break
        chosen = pairs[counts >= max(min_count, top // CLASS)]
        if len(chosen) > most - base - n_rules:
            order = np.argsort(-counts[counts >= max(min_count, top // CLASS)], kind="stable")
            chosen = np.sort(chosen[order[:most - base - n_rules]])
        place = np.full(1 << 16, -1, np.int32)            # of a chosen pair, by cell
        place[(chosen * mix) >> down] = np.arange(len(chosen))
        found = place[cell[maybe]]
        maybe, found = maybe[found >= 0], found[found >= 0]
        wanted = keys[maybe]
        hit = chosen[found] == wanted
        other = np.flatnonzero(~hit)                      # not chosen, or another pair of the cell
        found[other] = np.minimum(np.searchsorted(chosen, wanted[other]), len(chosen) - 1)
        hit[other] = chosen[found[other]] == wanted[other]
        at, found = maybe[hit], found[hit]
        apart = _replaceable(at)
        at, hits = at[apart], found[apart]
        used = np.flatnonzero(np.bincount(hits, minlength=len(chosen)))
        number = np.zeros(len(chosen), np.int64)
        number[used] = np.arange(len(used))
        new = number[hits]
        left = (chosen[used] >> key(shift)).astype(np.int64)
        right = (chosen[used] & key((1 << shift) - 1)).astype(np.int64)
        known = np.concatenate(lengths)
        lengths.append(known[left] + known[right])
        rules.append(np.stack([left, right], 1))
        body[at] = (base + n_rules + new).astype(sym)
        last[at] = last[at + 1]
        keep = np.ones(len(body), bool)
        keep[at + 1] = False
        body, last = body[keep], last[keep]
        n_rules += len(used)
    ends = np.flatnonzero(last) + 1
    return {"width": width, "alphabet": alphabet.astype("<u4").tobytes(),
            "rules": (np.concatenate(rules) if rules else np.zeros((0, 2), int)).astype(f"<u{width}").tobytes(),
            "lengths": np.concatenate(lengths)[base:].astype("<u4").tobytes(),
            "body": body.astype(f"<u{width}").tobytes(), "doc_symbols": np.diff(np.concatenate(([0], ends)))}


class Shard:
    """Random access to the documents of one stored shard."""

    def __init__(self, width, alphabet, rules, lengths, body, doc_symbols):
        kind = f"<u{width}"
        self.alphabet = np.frombuffer(alphabet, "<u4")
        self.rules = np.frombuffer(rules, kind).reshape(-1, 2).astype(np.uint32)
        self.lengths = np.concatenate((np.ones(len(self.alphabet), np.int64), np.frombuffer(lengths, "<u4").astype(np.int64)))
        self.body = np.frombuffer(body, kind).astype(np.uint32)
        self.at = np.concatenate(([0], np.cumsum(np.asarray(doc_symbols, np.int64))))
        self.short = None

    def _open(self, symbols: np.ndarray, longest: int) -> np.ndarray:
        """Rules that stand for more than ``longest`` ids replaced by their pairs."""
        base = len(self.alphabet)
        while len(symbols):
            rule = self.lengths[symbols] > longest
            if not rule.any():
                break
            to = np.cumsum(1 + rule) - 1                  # where the last part of each symbol goes
            out = np.empty(int(to[-1]) + 1, np.uint32)
            out[to[~rule]] = symbols[~rule]
            pair = self.rules[symbols[rule] - base]
            out[to[rule] - 1], out[to[rule]] = pair[:, 0], pair[:, 1]
            symbols = out
        return symbols

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        """Ids of a run of symbols: short rules are looked up in a table of their ids."""
        if self.short is None:
            known = np.flatnonzero(self.lengths <= TABLED)
            self.short = self.alphabet[self._open(known.astype(np.uint32), 1)]
            self.first = np.zeros(len(self.lengths), np.int64)
            self.first[known] = np.cumsum(self.lengths[known]) - self.lengths[known]
        symbols = self._open(symbols, TABLED)
        n = self.lengths[symbols]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.short)) < 1 << 31 else np.int64
        return self.short[np.repeat((self.first[symbols] - ends + n).astype(kind), n) + np.arange(total, dtype=kind)]

    def document(self, k: int, start: int = 0, length: int | None = None) -> np.ndarray:
        """Ids ``start`` .. ``start + length`` of document ``k``; only the symbols
        that the expansion lengths show to overlap are expanded."""
        symbols = self.body[self.at[k]:self.at[k + 1]]
        if start == 0 and length is None:
            return self.expand(symbols)
        ends = np.cumsum(self.lengths[symbols])
        stop = int(ends[-1]) if length is None else min(start + length, int(ends[-1]))
        a = int(np.searchsorted(ends, start, "right"))
        b = int(np.searchsorted(ends, stop, "left")) + 1
        skipped = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[start - skipped:stop - skipped]


def _shard_writer(path: str, end_id: int, shard_tokens: int):
    def write(batches):
        from pyspark import TaskContext
        part, block = TaskContext.get().partitionId(), 0
        schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
                            ("doc_tokens", pa.list_(pa.int64())), ("doc_symbols", pa.list_(pa.int64())), ("width", pa.int32()),
                            ("alphabet", pa.binary()), ("rules", pa.binary()), ("lengths", pa.binary()), ("body", pa.binary())])

        def row(ids, docs):
            tokens = np.array([len(x) // 4 for x in ids], np.int64)
            made = compress(np.frombuffer(b"".join(ids), "<u4"), tokens)
            made |= {"part": part, "block": block, "doc_ids": docs, "doc_tokens": tokens.tolist(),
                     "doc_symbols": made["doc_symbols"].tolist()}
            return pa.RecordBatch.from_pylist([made], schema)

        ids, docs, size = [], [], 0
        for batch, k, x in encoded_rows(batches, path, end_id, rows=2048, chars=1 << 22):
            ids.append(x)
            docs.append(batch.column(0)[k].as_py())
            size += len(x) // 4
            if size >= shard_tokens:
                yield row(ids, docs)
                ids, docs, size, block = [], [], 0, block + 1
        if ids:
            yield row(ids, docs)
    return write


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> None:
    """Encode ``docs`` (doc_id, text) and write the shards to the folder ``path``.

    Null text is empty (only the end id).  Null ids come first, rows of one id
    in the order of their texts; repeated rows are kept.  A text longer than a
    shard is a shard of its own.  An empty table writes no shard.  Extra
    columns are ignored.
    """
    ordered = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    ordered.mapInArrow(_shard_writer(tokenizer, end_id, shard_tokens), SHARD_SCHEMA).write.parquet(path)


def _decode(batches):
    schema = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("doc_id", pa.int64()), ("inner_start", pa.int64()),
                        ("n_tokens", pa.int64()), ("ids", pa.binary())])
    for batch in batches:
        for r in batch.to_pylist():
            shard = Shard(r["width"], r["alphabet"], r["rules"], r["lengths"], r["body"], r["doc_symbols"])
            ids = shard.expand(shard.body).astype("<u4").tobytes()
            ends = (4 * np.cumsum(np.array(r["doc_tokens"], np.int64))).tolist()
            n = len(ends)
            yield pa.RecordBatch.from_arrays([
                pa.array([r["part"]] * n, pa.int32()), pa.array([r["block"]] * n, pa.int32()),
                pa.array(r["doc_ids"], pa.int64()), pa.array([a // 4 for a in [0, *ends][:n]], pa.int64()),
                pa.array(r["doc_tokens"], pa.int64()),
                pa.array([ids[a:b] for a, b in zip([0, *ends], ends)], pa.binary())], schema=schema)


def read_tokens(spark, path: str, ids=None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every stored document; ``start`` counts
    the ids of all documents before it.  ``ids``: an expression over the decoded
    column of that name that is wanted instead; it is applied before anything
    is shuffled."""
    shards = spark.read.schema(SHARD_SCHEMA).parquet(path)
    rows = shards.mapInArrow(_decode, "part int, block int, doc_id long, inner_start long, n_tokens long, ids binary")
    if ids is not None:
        rows = rows.withColumn("ids", ids)
    sizes = shards.select("part", "block", F.aggregate("doc_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n"))
    base = starts(sizes, [], "part", ["block"], "n", "base").select("part", "block", "base")
    return (rows.join(base, ["part", "block"])
            .select("doc_id", (F.col("base") + F.col("inner_start")).alias("start"), "n_tokens", "ids"))


def query(spark, sf_dir):
    path = scratch_path(spark, "token-shards")
    write_tokens(table(spark, sf_dir, "documents"), path, public_path(TOKENIZER))
    crc = F.crc32("ids").cast("long")
    return read_tokens(spark, path, crc).withColumnRenamed("ids", "ids_crc32")
