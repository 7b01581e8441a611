"""Periodic runs of words, found on a grammar (Re-Pair).

Documents are taken in shards.  In a shard the most frequent neighbouring pairs of
word ids become nonterminals, round after round, until no pair occurs twice; what is
left of each document is paired up until one symbol, its root, stands for it.  Equal
stretches share their nonterminals, so they are looked at once.

A run that lies in the expansion of a nonterminal but in neither of its halves crosses
the boundary between them.  For each nonterminal the periods of such runs are read off
the places where the word before the boundary comes again after it, or the word after it
has come before; how far the period holds to both sides follows from hashes of word
sequences, and every run found is compared word by word.  Runs are carried to all places
that the nonterminals derive, and of intervals of one period only the maximal ones stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import WORDS, table

SHARD_WORDS = 1 << 17
MIN_LENGTH = 12
#: A round replaces every pair that occurs at least max / CLASS times.
CLASS = 8
SEPARATOR = r"[\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)


class Grammar:
    """Pair rules over word ids.  Symbol ``alphabet + k`` is rule k; ``size`` and
    ``first`` give a symbol's number of words and one place where it stands."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray):
        self.words, self.alphabet = words, int(words.max()) + 1
        self.left, self.right = [], []
        self.rounds = [self.alphabet]                    # first symbol of each round, and the end
        place = np.zeros(self.alphabet, np.int64)
        place[words[::-1]] = np.arange(len(words))[::-1]
        self._first, self._size = [place], [np.ones(self.alphabet, np.int64)]
        body, at = words.astype(np.int64), np.arange(len(words))
        doc = np.repeat(np.arange(len(lengths)), lengths)
        while True:
            key, inside = self._keys(body, doc)
            cell = ((key.view(np.uint64) * _MIX) >> np.uint64(45)).astype(np.int64)
            often = np.flatnonzero(inside & (np.bincount(cell[inside], minlength=1 << 19) > 1)[cell])
            pairs, counts = np.unique(key[often], return_counts=True)
            if len(pairs) == 0 or counts.max() < 2:
                break
            chosen = pairs[counts >= max(2, counts.max() // CLASS)]
            found = np.minimum(np.searchsorted(chosen, key[often]), len(chosen) - 1)
            marked = often[chosen[found] == key[often]]
            # Of neighbouring marks every other one: no two pairs overlap.
            new = np.concatenate(([True], marked[1:] != marked[:-1] + 1))
            run = np.maximum.accumulate(np.where(new, marked, 0))
            body, at, doc = self._replace(body, at, doc, key, marked[(marked - run) % 2 == 0])
        while len(body) > len(lengths[lengths > 0]):
            key, inside = self._keys(body, doc)
            start = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
            odd = (np.arange(len(body)) - start[np.searchsorted(start, np.arange(len(body)), "right") - 1]) % 2
            body, at, doc = self._replace(body, at, doc, key, np.flatnonzero(inside & (odd[:-1] == 0)))
        self.roots, self.at = body, at
        self.left, self.right = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (self.left, self.right))
        self.first, self.size = np.concatenate(self._first), np.concatenate(self._size)

    @staticmethod
    def _keys(body, doc):
        return (body[:-1] << 32) | body[1:], doc[:-1] == doc[1:]

    def _replace(self, body, at, doc, key, where):
        pairs, first, which = np.unique(key[where], return_index=True, return_inverse=True)
        base, left, right = self.rounds[-1], pairs >> 32, pairs & 0xFFFFFFFF
        size = np.concatenate(self._size)
        self._size = [size, size[left] + size[right]]
        self._first.append(at[where[first]])
        self.left.append(left)
        self.right.append(right)
        self.rounds.append(base + len(pairs))
        body[where] = base + which
        keep = np.ones(len(body), bool)
        keep[where + 1] = False
        return body[keep], at[keep], doc[keep]


def _spread(counts: np.ndarray):
    """(row, 0 .. count-1) for every row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


class Extender:
    """How many words from two places on (or back) are equal: by hashes, or (``exact``)
    by the words themselves, which takes longer."""

    def __init__(self, words: np.ndarray, exact: bool = False):
        self.words, self.exact, n = words, exact, len(words)
        value = (words.astype(np.uint64) + np.uint64(1)) * _MIX
        value ^= value >> np.uint64(29)
        up = np.full(n + 1, 0xD1342543DE82EF95, np.uint64)
        up[0] = 1
        self.up = np.cumprod(up)
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value * self.up[:n][::-1])))

    def _equal(self, x, y, n):
        if self.exact:
            return self.holds(x, y + n, y - x, n)
        # x < y: the sum over x is brought to the powers of y.
        return (self.sums[y + n] - self.sums[y]) * self.up[y - x] == self.sums[x + n] - self.sums[x]

    def common(self, x, y, limit, back: bool):
        """Equal words at x, x+1, .. and y, y+1, .. (back: x-1, x-2, ..), at most ``limit``."""
        got = np.zeros(len(x), np.int64)
        step = np.int64(1) << max(int(limit.max()).bit_length(), 1) if len(limit) else 1
        near = np.arange(len(x))
        for _ in range(4):                               # most end here
            near = near[got[near] < limit[near]]
            a, b = (x[near] - 1 - got[near], y[near] - 1 - got[near]) if back else (x[near] + got[near], y[near] + got[near])
            near = near[self.words[a] == self.words[b]]
            got[near] += 1
        while step and len(near):
            fits = near[got[near] + step <= limit[near]]
            a, b = (x[fits] - got[fits] - step, y[fits] - got[fits] - step) if back else (x[fits] + got[fits], y[fits] + got[fits])
            fits = fits[self._equal(a, b, step)]
            got[fits] += step
            step >>= 1
        return got

    def holds(self, start, end, period, most=None):
        """Whether words ``period`` apart are equal all over [start, end), or at ``most`` first words."""
        row, i = _spread(end - start - period if most is None else np.full(len(start), most))
        bad = self.words[start[row] + i] != self.words[start[row] + i + period[row]]
        return np.bincount(row[bad], minlength=len(start)) == 0


def crossing_runs(g: Grammar, exact: bool = False):
    """(symbol, start, end, period) of runs across the boundary of each rule; start and end
    lie in ``g.words``, at the symbol's first place."""
    words, n = g.words, len(g.words)
    order = np.argsort(words, kind="stable")
    posting = words[order].astype(np.int64) * n + order
    symbol = np.arange(g.alphabet, len(g.size))
    symbol = symbol[g.size[symbol] >= MIN_LENGTH]
    begin, end = g.first[symbol], g.first[symbol] + g.size[symbol]
    cut, half = begin + g.size[g.left[symbol - g.alphabet]], g.size[symbol] // 2
    same = Extender(words, exact)
    out = []
    for after in (True, False):
        # The word before the cut comes again (after), or the word after it has come before.
        word = words[cut - 1 if after else cut].astype(np.int64) * n
        lo = np.searchsorted(posting, word + (cut if after else np.maximum(begin, cut - half)))
        hi = np.searchsorted(posting, word + (np.minimum(end, cut + half) if after else cut))
        row, i = _spread(np.maximum(hi - lo, 0))
        place = order[lo[row] + i]
        b, c = begin[row], cut[row]
        period = place - (c - 1) if after else c - place
        x, y = (c, c + period) if after else (c - period, c)
        before = same.common(x, y, x - b, True)
        more = np.flatnonzero(before + (end[row] - y) >= np.maximum(period, MIN_LENGTH - period))
        row, x, y, period, before = row[more], x[more], y[more], period[more], before[more]
        ahead = same.common(x, y, end[row] - y, False)
        good = (before + ahead >= np.maximum(period, MIN_LENGTH - period)) & ((before if after else ahead) > 0)
        out.append((symbol[row[good]], (x - before)[good], (y + ahead)[good], period[good]))
    sym, start, stop, period = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((period, stop, start, sym))
    sym, start, stop, period = sym[order], start[order], stop[order], period[order]
    least = np.ones(len(sym), bool)                      # other periods of the same stretch are multiples
    least[1:] = (sym[1:] != sym[:-1]) | (start[1:] != start[:-1]) | (stop[1:] != stop[:-1])
    sym, start, stop, period = sym[least], start[least], stop[least], period[least]
    if not same.holds(start, stop, period).all():        # hashes of different words were equal
        return crossing_runs(g, exact=True)
    return sym, start, stop, period


def shard_runs(words: np.ndarray, lengths: np.ndarray):
    """(document, start, length, period) of all runs of a shard's documents, by start, then period."""
    empty = np.zeros(0, np.int64)
    if len(words) < MIN_LENGTH:
        return empty, empty, empty, empty
    g = Grammar(words, lengths)
    sym, start, stop, period = crossing_runs(g)
    own = np.bincount(sym, minlength=len(g.size))
    base = np.cumsum(own) - own
    has = own > 0
    for lo, hi in zip(g.rounds, g.rounds[1:]):
        k = np.arange(lo, hi) - g.alphabet
        has[lo:hi] |= has[g.left[k]] | has[g.right[k]]
    node, at, found = g.roots, g.at, []
    while True:                                          # down all derivations that hold runs
        live = has[node]
        node, at = node[live], at[live]
        if len(node) == 0:
            break
        row, i = _spread(own[node])
        r = base[node[row]] + i
        found.append((at[row] + start[r] - g.first[node[row]], stop[r] - start[r], period[r]))
        left, right = g.left[node - g.alphabet], g.right[node - g.alphabet]
        node, at = np.concatenate((left, right)), np.concatenate((at, at + g.size[left]))
    if not found:
        return empty, empty, empty, empty
    start, length, period = (np.concatenate(x) for x in zip(*found))
    ends = np.cumsum(lengths)
    doc = np.searchsorted(ends, start, "right")
    order = np.lexsort((-length, start, period, doc))
    doc, start, length, period = doc[order], start[order], length[order], period[order]
    group = np.cumsum(np.concatenate(([0], (doc[1:] != doc[:-1]) | (period[1:] != period[:-1]))))
    reach = start + length + group * (len(words) + 1)    # grows from group to group
    maximal = np.ones(len(doc), bool)
    maximal[1:] = reach[1:] > np.maximum.accumulate(reach)[:-1]
    doc, start, length, period = doc[maximal], start[maximal], length[maximal], period[maximal]
    order = np.lexsort((period, start, doc))
    doc, start = doc[order], start[order]
    return doc, start - (ends - lengths)[doc], length[order], period[order]


class _Ids(dict):
    def __missing__(self, word):
        self[word] = len(self)
        return self[word]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _shard(ids: list, texts: list, schema):
    number = _Ids()
    words = np.fromiter((number[w] for t in texts for w in t), np.int64)
    lengths = np.array([len(t) for t in texts], np.int64)
    doc, start, length, period = shard_runs(words, lengths)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    collapsed = []
    for k, t in enumerate(texts):
        if at[k] < at[k + 1]:
            cover = np.zeros(len(t) + 1, np.int64)
            s, e, p = (x[at[k]:at[k + 1]] for x in (start, start + length, period))
            np.add.at(cover, s + p, 1)
            np.add.at(cover, e, -1)
            t = [w for w, c in zip(t, np.cumsum(cover).tolist()) if c == 0]
        collapsed.append(b" ".join(t))
    runs = pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)], fields=list(_RUN))
    return pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array(lengths, pa.int64()),
        pa.ListArray.from_arrays(pa.array(at, pa.int32()), runs).cast(pa.list_(_RUN)),
        pa.array(collapsed, pa.binary()).cast(pa.string())], schema=schema)


def _find(shard_words: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("collapsed", pa.string())])

    def find(batches):
        ids, texts, size = [], [], 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                # bytes.split() cuts at the six separators; no byte of a longer character is one.
                words = (text.as_py() or b"").split()
                ids.append(doc.as_py())
                texts.append(words)
                size += len(words)
                if size >= shard_words:
                    yield _shard(ids, texts, schema)
                    ids, texts, size = [], [], 0
        if ids:
            yield _shard(ids, texts, schema)
    return find


def periodic_runs(docs: DataFrame, shard_words: int = SHARD_WORDS) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of every row of ``docs`` (doc_id, text).

    ``runs``: array of (start, length, period), by start, then period: all maximal
    stretches of at least twelve words and two periods.  ``collapsed``: the text's words,
    joined by one space, without those that a run repeats after its first period.
    Words are what ASCII white space separates.  Null, empty and blank texts have no words
    and no runs; a null doc_id stays null; repeated rows are answered one by one; an empty
    table gives no rows; extra columns are ignored.  A text longer than a shard is a shard
    of its own.
    """
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _find(shard_words), "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string")


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text): every tenth document, by the crc of its id, repeats words from a
    place on with one period, both given by that crc.  Rows without an id stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.filter(F.split("text", SEPARATOR), lambda w: w != "")
    change = (h % 10 == 0) & F.col("text").rlike(WORDS)
    d = (docs.select("doc_id", "text", F.when(change, words).alias("w"), F.floor(h / 10).alias("g"))
         .withColumn("n", F.size("w")).withColumn("a", F.expr("cast(if(n > 0, g % n, 0) as int)"))
         .withColumn("p", F.expr("cast(1 + floor((n - a) / (3 + g % 8)) as int)")))
    tail = F.expr("slice(flatten(array_repeat(slice(w, a + 1, p), cast(ceil((n - a) / p) as int))), 1, n - a)")
    return d.select("doc_id", F.when(F.col("w").isNotNull(), F.array_join(F.concat(F.expr("slice(w, 1, a)"), tail), " "))
                    .otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The longest run (ties: smallest start, then period) and digests of the rest."""
    best: Column = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    d = found.withColumn("best", best)
    length, period = F.col("best.length"), -F.col("best.period")
    return d.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))


def query(spark, sf_dir):
    return digests(periodic_runs(planted(table(spark, sf_dir, "documents"))))
