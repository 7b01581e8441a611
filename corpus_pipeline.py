"""Training corpus from raw documents: five stages, each one operator of
``themescope.llm``.  Every stage works on all rows its predecessor kept; all but
the last return the columns of ``documents``.

Input columns keep their values, also those named like a stage's own.
Each operator's docstring says what becomes of nulls, empty and very long texts,
ties, repeated rows, empty tables and extra columns.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themescope.llm import langid, minhash, mixing, packing, quality
from themescope.llm.common import BATCH_ROWS, free_names, table
from themescope.llm.tokens import public_path
from themescope.session import scratch_path

#: A text that costs more bits per character than letters drawn evenly is in no learned language.
REJECT_BITS = math.log2(32)


def few_texts_at_a_time(spark: SparkSession) -> None:
    """Sets the session to send texts to Python in small batches.  The tables that stages return
    are computed after them, so the setting stays; no row depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key))
    spark.conf.set(key, str(min(now, BATCH_ROWS) if now > 0 else BATCH_ROWS))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps what importance resampling draws; blank texts go."""
    few_texts_at_a_time(spark)
    names = free_names(docs, quality.NEW)
    return quality.resampled(docs, table(spark, sf_dir, "labels"), names).where(F.col(names[2])).select(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts in one of the languages learned from the labelled rows; texts
    without a letter, or no better explained than by even letters, go."""
    few_texts_at_a_time(spark)
    learned = langid.training_text(docs.where(~langid.held_out(F.col("doc_id"))))
    names = free_names(docs, langid.NEW)
    known = (F.col(names[0]) != langid.UNKNOWN) & (F.col(names[2]) <= REJECT_BITS)
    return langid.with_language(docs, learned, names=names).where(known).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates."""
    return minhash.one_per_class(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or twice."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token windows, with their ids."""
    few_texts_at_a_time(spark)
    return packing.packed(docs, public_path(packing.TOKENIZER))


STAGES = [("quality classifier", quality_classifier), ("language ID", language_id), ("MinHash near-dedup", near_dedup),
          ("mixing sources", mix_sources), ("packing", pack)]

#: The first stage's model and the token ids can't be expressed in SQL; of the stages, tests/llm
#: compares near-dedup alone with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "stage-" + name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
