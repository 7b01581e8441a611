"""Language identification by cross-parsing.

A bounded sample of labelled text per language becomes a suffix automaton.  A
text is parsed into the fewest phrases that each occur in a language's sample
(greedy longest matches); the language that needs the fewest phrases wins, each
phrase counted with the bits of a position in the sample.  The automata are
stored as one dense table, so a task parses many texts in step: one look-up per
character and language gives the next state and whether a phrase ended.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themescope.llm.common import Made, lean, table
from themescope.llm.textcodes import LETTER, classes, code_points, lower, text_slices

#: Bounds of the fit: labelled rows, characters per language, letters told apart, bytes of the table.
SAMPLE_ROWS = 256
SAMPLE_CHARS = 32_768
LETTERS = 120
TABLE_BYTES = 96 << 20
#: Texts are parsed in parts of this many characters; a part starts a phrase.
PART = 512
#: Characters that are parsed at a time, states whose rows are made at a time.
SLICE_CHARS, BLOCK = 1 << 18, 4096
SALTS = 64
SEED = 3
UNKNOWN = "und"


def letters(text) -> Column:
    """Lower case, everything but letters as single spaces."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " "))


def training_text(docs: DataFrame, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, str]:
    """Text per language from labelled rows (doc_id, text, lang): of each
    language the ``rows`` rows of least hash, of each row ``chars / rows``
    characters from a hashed position (all of a shorter text)."""
    share = chars // rows
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    order = F.xxhash64(F.lit(SEED), "doc_id")
    least = labelled.select("lang", "doc_id", order.alias("h")).withColumn("salt", F.pmod("h", F.lit(SALTS)))
    # The least of each salt, then of those: no task sorts a whole language.
    for keys in (["lang", "salt"], ["lang"]):
        least = (least.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "doc_id")))
                 .where(F.col("rank") <= rows).drop("rank"))
    # rows * languages ids: a bounded number per language.
    some = labelled.join(F.broadcast(least.select("doc_id").distinct()), "doc_id").select("lang", "doc_id", letters(F.col("text")).alias("t"))
    at = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.greatest(F.char_length("t") - share, F.lit(0)) + 1) + 1
    got = some.select("lang", "doc_id", F.substring("t", at.cast("int"), F.lit(share)).alias("t")).orderBy("lang", "doc_id").collect()
    out: dict[str, list[str]] = {}
    for r in got:
        if r["t"]:
            out.setdefault(r["lang"], []).append(r["t"])
    return {lang: " ".join(parts)[:2 * chars] for lang, parts in sorted(out.items())}


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the states; state 0 is the root, missing means no such substring."""
    nxt, link, length = [{}], [-1], [0]
    last = 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


class Parser:
    """Dense tables of the automata of all languages.

    A row holds, per character class, four times the first cell of the next
    state's row plus the number of phrases that the character ends.  Classes: 0
    between words, 1 letters of no sample, then the letters; the last one pads.
    """

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        found: dict[str, int] = {}
        for t in texts.values():
            for ch in t:
                if ch != " ":
                    found[ch] = found.get(ch, 0) + 1
        known = sorted(found, key=lambda ch: (-found[ch], ch))[:LETTERS]
        self.width = len(known) + 3
        self.pad = self.width - 1
        self.code = np.where(classes() == LETTER, 1, 0).astype(np.uint8)
        for i, ch in enumerate(known):
            self.code[ord(ch)] = i + 2
        self.code = self.code[lower()]
        most = max(256, TABLE_BYTES // (4 * self.width * 2 * max(1, len(texts))))
        self.roots, self.bits, first = [], [], 0
        # Room for the most states there can be; what is not written takes no memory.
        table = np.empty((sum(2 * min(most, len(t)) + 1 for t in texts.values()), self.width), np.uint32)
        for lang in self.langs:
            codes = self.code[np.frombuffer(texts[lang].encode("utf-32-le"), np.uint32)].tolist()[:most]
            states = suffix_automaton(codes)
            root = np.zeros(self.width, np.int64)
            root[list(states[0])] = list(states[0].values())
            for at in range(0, len(states), BLOCK):
                some = states[at:at + BLOCK]
                to = np.zeros((len(some), self.width), np.int64)
                for s, d in enumerate(some):
                    if d:
                        to[s, list(d)] = list(d.values())
                missing = to == 0
                # A character of no word of the sample is a phrase of its own, besides the one that it ends.
                ended = missing * np.where(root == 0, 2, 1)
                if at == 0:
                    ended[0] = missing[0]
                cells = (np.where(missing, root, to) + first) * self.width * 4 + ended
                cells[:, self.pad] = (np.arange(at, at + len(some)) + first) * self.width * 4
                table[first + at:first + at + len(some)] = cells
            self.roots.append(first * self.width)
            self.bits.append(np.log2(max(2, len(codes))))
            first += len(states)
        self.table = table[:first].ravel()

    def codes(self, texts: list[str]):
        """(classes of all texts with runs of spaces as one, first position of each text)."""
        points, at = code_points(texts)
        code = self.code[points]
        space = code == 0
        keep = ~space
        keep[1:] |= ~space[:-1] & space[1:]
        return code[keep], np.concatenate(([0], np.cumsum(keep)))[at]

    def __call__(self, texts: list[str]) -> np.ndarray:
        """Bits per character of each text (rows) in each language; nan where there is no letter."""
        code, at = self.codes(texts)
        n = np.diff(at)
        parts = -(-n // PART)
        if len(self.langs) == 0 or parts.sum() == 0:
            return np.full((len(texts), len(self.langs)), np.nan)
        lanes = np.full((int(parts.sum()), PART), self.pad, np.uint8)
        part_of = np.repeat(np.arange(len(n)), parts)
        first = np.cumsum(parts) - parts
        where = np.arange(len(code)) - np.repeat(at[:-1], n)
        lanes[np.repeat(first, n) + where // PART, where % PART] = code
        phrases = np.ones((len(self.langs), len(lanes)), np.int64)
        for a in range(0, len(lanes), 4096):
            steps = np.ascontiguousarray(lanes[a:a + 4096].T).astype(np.uint32)
            row = np.repeat(np.array(self.roots, np.uint32)[:, None], steps.shape[1], 1)
            ended = np.zeros(row.shape, np.uint32)
            for step in steps:
                cell = self.table[row + step]
                ended += cell & np.uint32(3)
                row = cell >> np.uint32(2)
            phrases[:, a:a + 4096] += ended
        total = np.stack([np.bincount(part_of, p, len(n)) for p in phrases], 1)
        has = np.bincount(np.repeat(np.arange(len(n)), n), code != 0, len(n)) > 0
        bits = total * np.array(self.bits) / np.maximum(n, 1)[:, None]
        bits[~has] = np.nan
        return bits


NEW = ("lang_pred", "score", "bits")


def with_language(docs: DataFrame, texts: dict[str, str], text_col: str = "text", names: tuple[str, str, str] = NEW) -> DataFrame:
    """``docs`` with lang_pred, score and bits, called ``names``.

    lang_pred: the language of fewest bits per character, ties to the smaller
    name; ``und`` (score 0, bits null) for a text that is null, empty or has no
    letter, and for all texts where no language was learned.  score: bits of the
    second-best language over those of the two best together, 1 where only one
    was learned.  Whole texts are parsed, however long.  Repeated rows and null
    ids are rows like others; an empty table gives no rows.  Input columns called
    as in ``names`` are replaced, others are kept.
    """
    docs = docs.drop(*names)
    columns = docs.columns
    at = columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(Made(Parser, texts))

    def detect(batches):
        parse = shared.value()
        called = np.array([*parse.langs, UNKNOWN], object)
        for batch in batches:
            for first, some in text_slices(batch, at, chars=SLICE_CHARS):
                bits = parse(some)
                und = np.isnan(bits).all(1) if bits.shape[1] else np.ones(len(some), bool)
                filled = np.where(und[:, None], 1.0, bits) if bits.shape[1] else np.ones((len(some), 1))
                best = filled.argmin(1)
                low = filled.min(1)
                second = np.sort(filled, 1)[:, 1] if filled.shape[1] > 1 else np.full(len(some), np.inf)
                score = np.where(und, 0.0, np.where(np.isinf(second), 1.0, second / np.where(np.isinf(second), 1.0, low + second)))
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(first, len(some)) for c in batch.columns),
                     pa.array(called[np.where(und, len(parse.langs), best)].tolist(), pa.string()),
                     pa.array(score, pa.float64()), pa.array(low, pa.float64(), mask=und)], names=[*columns, *names])

    kinds = (T.StringType(), T.DoubleType(), T.DoubleType())
    return docs.mapInArrow(lean(detect), T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(names, kinds))]))


def held_out(doc_id) -> Column:
    """Rows that nothing is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == 2, F.lit(False))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    learned = training_text(docs.where(~held_out(F.col("doc_id"))))
    return with_language(docs.select("doc_id", "text"), learned).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
