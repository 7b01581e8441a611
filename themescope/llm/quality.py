"""Quality selection by importance resampling.

Two hashed n-gram models, one of target text (labelled good, not toxic) and one
of all text, give every n-gram a log ratio.  Unigrams are the first five
letters of a word, bigrams two words in a row; a repeated word is one bigram
whatever the word.  A document's log weight is that of its weakest passage: the
least sum of ratios over eight words in a row, relative to what target text has
on average.  Toxic text may be few words of an otherwise clean document, so a
second ratio, target text against text labelled toxic, gives every beginning of
a word its evidence; a document's is that of its three worst words.  Documents
are drawn without replacement by the Gumbel top-k rule.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themescope.llm.common import BATCH_ROWS, arrow_rows, lean, table, written
from themescope.llm.shingles import CHUNK, cell_counts, counted_cells, read_cells
from themescope.llm.textcodes import classes, code_points, mix64, span_hasher, span_hashes, text_slices, word_spans

CELLS = 1 << 20
#: Characters that are counted or scored at a time.
SLICE_CHARS = 1 << 18
PREFIX = 5
PASSAGE = 8
BIGRAM_SHARE = 0.3
#: Pseudo-count of a cell, in words of the target sample.
PRIOR = 2.0
#: Labelled target documents that the target model is fitted on, at most (in
#: expectation); as many toxic ones for the evidence of toxic text.
SAMPLE_ROWS = 20_000
#: Beginnings of words that may mark toxic text, in letters; the word is longer.  Whole words may too.
MARKS = range(3, 9)
#: A mark counts this often in a document at most; a document's evidence is that of so many words.
WORST = 3
#: Share of target documents outside the fit below the level of toxic evidence.
TOXIC_TAIL = 0.0075
#: Pseudo-count of a mark, in the toxic sample.
MARK_PRIOR = 0.5
#: Folds of that sample: a document of it is scored by a model without its fold.
FOLDS = 5
#: Share of target documents outside the fit below the level that counts the documents to keep.
TAIL = 0.002
#: Weights are sharpened by this before the Gumbel noise is added.
TEMPERATURE = 0.1
SEED = 9


def ngram_cells(texts: list[str]):
    """(unigram cells, bigram cells, offsets): the bigram at i joins the words i - 1 and i;
    0 stands for no bigram (first word of a text)."""
    points, at = code_points(texts)
    first, end = word_spans(points, classes()[points])
    offsets = np.searchsorted(first, at)
    word = span_hashes(points, first, end, False)
    prefix = span_hashes(points, first, np.minimum(end, first + PREFIX), True)
    mask = np.uint64(CELLS - 1)
    both = mix64(word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:] * np.uint64(0xC2B2AE3D27D4EB4F)) & mask
    both = np.where(word[:-1] == word[1:], np.uint64(1), np.maximum(both, np.uint64(2)))
    bigram = np.concatenate((np.zeros(min(1, len(word)), np.uint64), both))
    bigram[offsets[:-1][offsets[:-1] < len(word)]] = 0
    return (prefix & mask).astype(np.int64), bigram.astype(np.int64), offsets


def add_ngrams(total: np.ndarray, texts: list[str]) -> None:
    """Adds the counts of unigram cells, then of bigram cells."""
    one, two, _ = ngram_cells(texts)
    total[:CELLS] += np.bincount(one, minlength=CELLS)
    total[CELLS:2 * CELLS] += np.bincount(two, minlength=CELLS)


def ngram_counts(docs: DataFrame) -> np.ndarray:
    """Counts of unigram cells, then of bigram cells, over all rows of docs (text)."""
    def count(batches):
        total = np.zeros(2 * CELLS, np.int64)
        for batch in batches:
            for _, texts in text_slices(batch, 0, chars=SLICE_CHARS):
                add_ngrams(total, texts)
        return total
    return cell_counts(docs.select("text"), count, 2 * CELLS)


def log_ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Per cell, log of the target model over the raw model, less the mean over
    target text; both kinds of n-grams by themselves.  The raw model smooths
    the target one."""
    out = np.empty(2 * CELLS, np.float32)
    step = 1 << 16                                        # cells at a time: little memory besides the result
    for kind in (0, CELLS):
        skip = int(kind > 0)                              # cell 0 of the bigrams is none
        t, r = target[kind + skip:kind + CELLS], raw[kind + skip:kind + CELLS]
        share, n = t.sum() / max(float(r.sum()), 1.0), t.sum()
        part = lambda at: np.log((t[at:at + step] + PRIOR) / (r[at:at + step] * share + PRIOR))  # noqa: B023, E731
        mean = sum(float((t[at:at + step] * part(at)).sum()) for at in range(0, len(t), step)) / max(n, 1.0)
        for at in range(0, len(t), step):
            made = part(at) - mean
            first = kind + skip + at
            out[first:first + len(made)] = made * BIGRAM_SHARE if kind else made
    out[CELLS] = 0.0
    return out


def log_weights(texts: list[str], ratios: np.ndarray) -> np.ndarray:
    """The weakest passage of each text; 0 without words, all words where there are fewer."""
    one, two, offsets = ngram_cells(texts)
    sums = np.concatenate(([0.0], np.cumsum((ratios[one] + ratios[CELLS + two]).astype(np.float64))))
    out = np.zeros(len(texts))
    n = np.diff(offsets)
    whole = n <= PASSAGE
    out[whole] = sums[offsets[1:][whole]] - sums[offsets[:-1][whole]]
    if (~whole).any():
        passage = sums[PASSAGE:] - sums[:-PASSAGE]
        a, b = offsets[:-1][~whole], offsets[1:][~whole] - PASSAGE + 1
        # Passages that span two texts lie between b and the next a.
        out[~whole] = np.minimum.reduceat(np.append(passage, np.inf), np.stack([a, b], 1).ravel())[::2]
    return out


def mark_cells(texts: list[str]):
    """(cells of each kind of mark, offsets): per word, CELLS where it has no such mark."""
    points, at = code_points(texts)
    first, end = word_spans(points, classes()[points])
    hashes, mask = span_hasher(points, True), np.uint64(CELLS - 1)
    cells = [np.where(end - first > p, (mix64(hashes(first, np.minimum(end, first + p)) + np.uint64(p)) & mask).astype(np.int64), CELLS)
             for p in MARKS]
    return [*cells, (hashes(first, end) & mask).astype(np.int64)], np.searchsorted(first, at)


def add_marks(total: np.ndarray, texts: list[str]) -> None:
    """Adds the counts of mark cells, each at most WORST times a document."""
    kinds, offsets = mark_cells(texts)
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    for cells in kinds:
        has = cells < CELLS
        key, n = np.unique(doc[has] * CELLS + cells[has], return_counts=True)
        total += np.bincount(key % CELLS, np.minimum(n, WORST), CELLS).astype(np.int64)


#: Cells of a group of sampled rows: unigrams, bigrams, marks, and the number of rows.
GROUP_CELLS = 3 * CELLS + CHUNK


def sample_counts(sample: DataFrame, parts: int) -> DataFrame:
    """Counts of the rows of sample (text, _fold), all folds in one job, the first
    ``parts`` folds being target text and the next one toxic: see ``read_group``."""
    def count(batches):
        at, total = None, None                            # one fold in memory at a time
        for batch in batches:
            folds = batch.column(1).to_numpy()
            for fold in np.unique(folds):
                if fold != at:
                    if at is not None:
                        yield at * (GROUP_CELLS // CHUNK), total
                    at, total = int(fold), np.zeros(GROUP_CELLS, np.int64)
                some = batch.filter(pa.array(folds == fold))
                total[3 * CELLS] += some.num_rows
                for _, texts in text_slices(some, 0, chars=SLICE_CHARS):
                    if fold < parts:
                        add_ngrams(total, texts)
                    add_marks(total[2 * CELLS:3 * CELLS], texts)
        if at is not None:
            yield at * (GROUP_CELLS // CHUNK), total
    # A fold's rows (a bounded number) in one task, so that few dense arrays are added up.
    return counted_cells(sample.select("text", "_fold").repartition(parts + 1, "_fold").sortWithinPartitions("_fold"), count)


def read_group(counts: DataFrame, fold: int) -> np.ndarray:
    return read_cells(counts, GROUP_CELLS, fold * (GROUP_CELLS // CHUNK))


def mark_evidence(target: np.ndarray, toxic: np.ndarray, n_target: int, n_toxic: int) -> np.ndarray:
    """Per mark cell, log of target over toxic counts a document, 0 where target
    text has it more often; the last is that of no mark."""
    ratio = np.log((target * (n_toxic / max(n_target, 1)) + MARK_PRIOR) / (toxic + MARK_PRIOR))
    return np.append(np.minimum(ratio, 0), 0).astype(np.float32)


def toxic_evidence(texts: list[str], evidence: np.ndarray) -> np.ndarray:
    """Sum over the WORST words of each text, a word's evidence that of its worst mark; 0 is none."""
    kinds, offsets = mark_cells(texts)
    each = evidence[kinds[0]]
    for cells in kinds[1:]:
        each = np.minimum(each, evidence[cells])
    doc = np.repeat(np.arange(len(texts)), np.diff(offsets))
    has = np.flatnonzero(each < 0)
    has = has[np.lexsort((each[has], doc[has]))]
    rank = np.arange(len(has)) - np.searchsorted(doc[has], doc[has])
    has = has[rank < WORST]
    return np.bincount(doc[has], each[has], len(texts))


def weighted(docs: DataFrame, models, rest: list[str], text: bool = False) -> DataFrame:
    """docs (text, *rest) with its log weight and toxic evidence, null where
    nothing is labelled toxic: (*rest, log_weight, toxic), the text first if wanted."""
    first = 0 if text else 1
    def score(batches):
        ratios, evidence = models.value
        for batch in batches:
            for at, texts in text_slices(batch, 0, chars=SLICE_CHARS):   # one slice of texts in memory at a time
                toxic = pa.nulls(len(texts), pa.float64()) if evidence is None else pa.array(toxic_evidence(texts, evidence), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(texts)) for c in batch.columns[first:]), pa.array(log_weights(texts, ratios), pa.float64()), toxic],
                    names=[*["text"][first:], *rest, "log_weight", "toxic"])
    docs = docs.select("text", *rest)
    return docs.mapInArrow(lean(score), T.StructType([*docs.schema.fields[first:], T.StructField("log_weight", T.DoubleType()), T.StructField("toxic", T.DoubleType())]))


def has_word():
    return F.coalesce(F.col("text").rlike(r"[^\s]"), F.lit(False))


def _kth_largest(rows: DataFrame, k: int, key: str) -> float:
    """The k-th largest key.  Counts per bin of the key, then per bin of bins,
    find the bin it is in; only that bin is sorted."""
    binned = rows.select(key, F.floor(F.greatest(F.least(F.col(key), F.lit(1e6)), F.lit(-1e6)) * 64).cast("long").alias("bin"))
    sizes = written(binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).withColumn("coarse", F.floor(F.col("bin") / 4096)), "key-bins")
    above = 0
    for level, inside in (("coarse", F.lit(True)), ("bin", None)):
        inside = F.col("coarse") == place if inside is None else inside
        upto = F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy(F.col(level).desc()))
        at = (sizes.where(inside).groupBy(level).agg(F.sum("n").alias("n")).select(level, "n", upto.alias("upto"))
              .where(F.col("upto") + above >= k).orderBy(F.col(level).desc()).first())
        place, above = at[level], above + at["upto"] - at["n"]
    edge = binned.where(F.col("bin") == place).orderBy(F.col(key).desc()).limit(k - above)
    return edge.agg(F.min(key)).first()[0]


def with_group(docs: DataFrame) -> DataFrame:
    """docs with the group that its level is for: ``lang``, where there is such
    a column, and the length in characters as a power of ten."""
    size = F.floor(F.log10(F.greatest(F.length("text"), F.lit(100)))).cast("int")
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("")) if "lang" in docs.columns else F.lit("")
    return docs.withColumns({"_lang": lang, "_size": F.coalesce(F.least(size, F.lit(5)), F.lit(2))})


def stratified(ids: DataFrame, rows: int) -> DataFrame:
    """About ``rows`` of ids (doc_id, _lang, _size), all where there are at most
    half as many: one half by the share of a group, the other even over groups."""
    groups = ids.groupBy("_lang", "_size").agg(F.count(F.lit(1)).alias("_n"))
    total, n_groups = groups.agg(F.sum("_n"), F.count(F.lit(1))).first()
    share = rows / 2 * (1 / max(total or 0, 1) + 1 / (max(n_groups, 1) * F.col("_n")))
    u = F.pmod(F.xxhash64(F.lit(SEED), "doc_id"), F.lit(1 << 52)) / float(1 << 52)
    return ids.join(F.broadcast(groups), ["_lang", "_size"]).where(u < share).select("doc_id").distinct()


class Levels:
    """Quantile at ``tail`` of a score by group, from the scores of target documents
    outside the fit (_lang, _size, score), less the scale of the noise.

    A group of at least 1 / tail such documents has its own level; others take
    the lower one of all documents of their language and of their length."""

    def __init__(self, held_out: DataFrame, score: str, tail: float = TAIL, additive: bool = False):
        # Exact up to a million rows of a group.
        level = F.percentile_approx(score, F.lit(tail), F.lit(1_000_000))
        cube = written(held_out.cube("_lang", "_size").agg(
            F.grouping_id().cast("int").alias("kind"), F.count(score).alias("n"), level.alias("level")), "levels")
        self.own = cube.where((F.col("kind") == 0) & (F.col("n") >= 1 / tail)).select("_lang", "_size", F.col("level").alias("_own"))
        self.lang = cube.where("kind = 1").select("_lang", F.col("level").alias("_of_lang"))
        self.size = cube.where("kind = 2").select("_size", F.col("level").alias("_of_size"))
        top = cube.where("kind = 3").select("level").first()
        self.all = top[0] if top and top[0] is not None else None
        self.additive = additive

    def relative(self, rows: DataFrame, score: str) -> DataFrame:
        """rows (_lang, _size, score, ...) with the score less the level of their group."""
        if self.all is None:
            return rows
        for part, on in ((self.own, ["_lang", "_size"]), (self.lang, ["_lang"]), (self.size, ["_size"])):
            rows = rows.join(F.broadcast(part), on, "left")
        both = F.col("_of_lang") + F.col("_of_size") - self.all if self.additive else F.lit(None)
        level = F.coalesce("_own", both, F.least("_of_lang", "_of_size"), F.lit(self.all))
        return rows.withColumn(score, F.col(score) - level + TEMPERATURE).drop("_own", "_of_lang", "_of_size")


class Resampler:
    """Model and cut of one corpus, fitted on docs (doc_id, text, and lang where
    there is one) and labels (doc_id, quality, toxic).

    Target: quality 1, toxic not 1.  The target model is fitted on about
    ``SAMPLE_ROWS`` such documents at most, spread over languages and lengths;
    the raw model on all documents.  Evidence of toxic text compares that sample
    with as many documents labelled toxic.  Weights and evidence are relative to a level by group
    (``Levels``), taken from all target documents: those of the sample are
    scored by a model without their fold, the others are no part of the fit.
    A document whose evidence misses its level weighs no more than by how much.
    As many documents are drawn as reach their levels: those with the largest
    log_weight / TEMPERATURE + Gumbel noise, the noise a hash of id and text.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        rows = with_group(docs.withColumn("doc_id", F.col("doc_id").cast("long"))).select("doc_id", "text", "_lang", "_size")
        good = (labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) != 1) & F.col("doc_id").isNotNull())
                .select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
        toxic = labels.where((F.col("toxic") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        sample, chosen = self.sampled(rows, good)
        toxic_sample, _ = self.sampled(rows, toxic)
        with arrow_rows(spark, BATCH_ROWS):
            raw = ngram_counts(rows)
            counts = sample_counts(sample.unionByName(toxic_sample.withColumn("_fold", F.lit(FOLDS).cast(sample.schema["_fold"].dataType))), FOLDS)
        # The driver holds the counts of one fold at a time, besides the totals.
        toxic_marks = read_group(counts, FOLDS)
        toxic_marks, n_toxic = toxic_marks[2 * CELLS:3 * CELLS].copy(), int(toxic_marks[3 * CELLS])
        total = np.zeros(GROUP_CELLS, np.int64)
        for f in range(FOLDS):
            total += read_group(counts, f)

        def models(left_out=None):
            use = total if left_out is None else total - read_group(counts, left_out)
            target = use[:2 * CELLS]
            # Counted up to the whole sample: pseudo-counts weigh as much as in the model of all folds.
            target = target * (total[:2 * CELLS].sum() / max(target.sum(), 1))
            evidence = mark_evidence(use[2 * CELLS:3 * CELLS], toxic_marks, int(use[3 * CELLS]), n_toxic) if n_toxic else None
            return spark.sparkContext.broadcast((log_ratios(target, raw), evidence))

        group, scores = ["_lang", "_size"], ["log_weight", "toxic"]
        held_out = []
        for f in range(FOLDS):
            without = models(f)
            part = sample.where((F.col("_fold") == f) & has_word())
            with arrow_rows(spark, BATCH_ROWS):
                held_out.append(written(weighted(part, without, group), "fold-weights"))
            without.destroy()
        self.models = models()
        del raw, total, toxic_marks
        with arrow_rows(spark, BATCH_ROWS):
            scored = written(self.noisy(rows, ["doc_id", *group]).where("_noise IS NOT NULL"), "weights")
        outside = scored.join(good, "doc_id", "left_semi").join(F.broadcast(chosen), "doc_id", "left_anti").select(*group, *scores)
        held_out = reduce(DataFrame.unionByName, held_out, outside)
        self.levels = [Levels(held_out, "log_weight", TAIL), Levels(held_out, "toxic", TOXIC_TAIL, additive=True)]
        scored = written(self.keyed(scored), "keys")
        k = scored.where("log_weight >= 0").count() if self.levels[0].all is not None else scored.count()
        self.cut = _kth_largest(scored, k, "gumbel_key") if k else float("inf")

    def sampled(self, rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(about SAMPLE_ROWS of the rows with these ids, at most, and their fold; their ids)."""
        groups = written(rows.select("doc_id", "_lang", "_size").join(ids, "doc_id", "left_semi"), "labelled-groups")
        chosen = written(stratified(groups, SAMPLE_ROWS), "sample-ids")
        fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "doc_id"), F.lit(FOLDS))
        # About SAMPLE_ROWS ids, so they can be broadcast.
        return written(rows.join(F.broadcast(chosen), "doc_id", "left_semi").withColumn("_fold", fold), "label-sample"), chosen

    def noisy(self, docs: DataFrame, rest: list[str], text: bool = False) -> DataFrame:
        """(*rest, log_weight, toxic, _noise) of docs (doc_id, text, *rest), the text first if
        wanted; no noise where there is no word."""
        u = (F.pmod(F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), "text"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
        rows = docs.select("text", F.when(has_word(), -F.log(-F.log(u))).alias("_noise"), F.struct(*rest).alias("_row"))
        out = weighted(rows, self.models, ["_row", "_noise"], text)
        return out.select(*["text"][:text], *[F.col("_row")[c].alias(c) for c in rest], "log_weight", "toxic", "_noise")

    def keyed(self, rows: DataFrame) -> DataFrame:
        """rows (_lang, _size, log_weight, toxic, _noise, ...) with weights relative to the levels, and keys."""
        for levels, score in zip(self.levels, ["log_weight", "toxic"]):
            rows = levels.relative(rows, score)
        weight = F.when(F.col("toxic") < 0, F.least("log_weight", "toxic")).otherwise(F.col("log_weight"))
        rows = rows.withColumn("log_weight", F.when(F.col("_noise").isNotNull(), weight)).drop("toxic")
        return rows.withColumn("gumbel_key", F.col("log_weight") / TEMPERATURE + F.col("_noise"))

    def scored(self, docs: DataFrame, rest: list[str]) -> DataFrame:
        """(text, *rest, log_weight, gumbel_key) of docs (doc_id, text, *rest)."""
        rows = self.noisy(with_group(docs), [*rest, "_lang", "_size"], True)
        return self.keyed(rows).select("text", *rest, "log_weight", "gumbel_key")


NEW = ("log_weight", "gumbel_key", "selected")


def resampled(docs: DataFrame, labels: DataFrame, names: tuple[str, str, str] = NEW) -> DataFrame:
    """``docs`` with log_weight, gumbel_key and selected (see ``Resampler``), called ``names``.

    A text that is null, empty or blank is never drawn, its log_weight is null.
    Without labelled target text every other document is drawn.  Repeated rows (equal id and text) have one key and are drawn
    together; rows without id are rows like others.  An empty table gives no
    rows.  Input columns called as in ``names`` are replaced, all others are kept,
    whatever they are called.
    """
    docs = docs.drop(*names)
    columns = docs.columns
    model = Resampler(docs, labels)
    # The columns beside the text travel as one, so that none clashes with the operator's own.
    group = ["lang"] if "lang" in columns else []
    rows = docs.select("doc_id", "text", *group, F.struct(*[c for c in columns if c != "text"]).alias("_docs_row"))
    got = model.scored(rows, ["_docs_row"])
    selected = F.coalesce(F.col("gumbel_key") >= model.cut, F.lit(False))
    return got.select(*[F.col("text" if c == "text" else f"_docs_row.`{c}`").alias(c) for c in columns],
                      *[c.alias(n) for c, n in zip([F.col("log_weight"), F.col("gumbel_key"), selected], names)])


def query(spark, sf_dir):
    return resampled(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), table(spark, sf_dir, "labels")).drop("text", "lang")
