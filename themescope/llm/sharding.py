"""Two-pass external shuffle into shards of equal row counts (native).

Pass 1 scatters the records over memory-sized buckets by a seeded hash of the
id.  Pass 2 collects one bucket at a time, brings it into a canonical order and
permutes it with ``shuffle()`` (Spark's inside-out Fisher-Yates).  The buckets
one after another are a random permutation of the table; it is cut into shards
whose row counts differ by at most one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from themescope.llm.common import crc32_text, shuffle_partitions, starts, table

#: Text bytes a bucket holds on average; a few buckets are in memory per task.
BUCKET_BYTES = 4 << 20
BUCKETS_PER_TASK = 16
RECORD_BYTES = 8
SHARDS = 24
SEED = 20_240_501


def shuffled_shards(df: DataFrame, n_shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id",
                    text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """``df`` with ``shard`` (0 .. n_shards-1) and ``slot`` (gapless from 0 in each shard).

    Law: row counts of two shards differ by at most one; an earlier shard is
    never the smaller one.  The order inside and across shards is a seeded
    random permutation; the same rows, seed and shuffle partitions give the
    same permutation again, also when a lost task is run anew.

    Nulls: a null id or text is an ordinary record.  Repeated rows and equal
    texts are records of their own; rows of one id meet in one bucket.  Very
    long texts: one record must fit into memory, nothing else.  An empty table
    gives an empty result.  Input columns named ``shard`` or ``slot`` are
    replaced; other extra columns are carried along.
    """
    spark = df.sparkSession
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    total = df.agg(F.sum(F.octet_length(text_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    n_rows = total["n"]
    parts = shuffle_partitions(spark)
    n_buckets = max(-(-((total["b"] or 0) + RECORD_BYTES * n_rows) // bucket_bytes), BUCKETS_PER_TASK * parts)

    bucket = F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(n_buckets))
    key = F.xxhash64(F.lit(seed + 1), F.col(id_col), F.col(text_col))
    scattered = (df.select(bucket.alias("_bucket"), F.struct(key.alias("k"), F.struct(*cols).alias("r")).alias("_rec"))
                 .repartition(-(-n_buckets // BUCKETS_PER_TASK), "_bucket")
                 .groupBy("_bucket").agg(F.collect_list("_rec").alias("_recs")))
    counts = df.select(bucket.alias("_bucket")).groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n"))
    offsets = starts(counts.withColumn("_chunk", F.floor(F.col("_bucket") / 4096)),
                     [], "_chunk", ["_bucket"], "_n", "_offset").select("_bucket", "_offset")

    # The merge join leaves each task's buckets sorted: shuffle() draws its
    # random numbers in the same order whenever the task runs.
    by_key = F.array_sort("_recs", lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    permuted = (scattered.join(offsets.hint("merge"), "_bucket")
                .select("_offset", F.shuffle(by_key, seed).alias("_recs"))
                .select("_offset", F.posexplode("_recs").alias("_at", "_rec")))

    at = F.col("_offset") + F.col("_at")
    q, r = divmod(n_rows, n_shards)
    head = r * (q + 1)
    rest = max(q, 1)
    shard = F.when(at < head, F.floor(at / F.lit(q + 1))).otherwise(r + F.floor((at - head) / F.lit(rest)))
    slot = F.when(at < head, at % F.lit(q + 1)).otherwise((at - head) % F.lit(rest))
    return permuted.select(*[F.col("_rec.r")[c].alias(c) for c in cols],
                           shard.cast("int").alias("shard"), slot.cast("long").alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; the rows of a file are in slot order."""
    (sharded.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
     .write.partitionBy("shard").parquet(path))


def query(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return shuffled_shards(docs).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + RECORD_BYTES).cast("long").alias("size"),
        crc32_text("text").cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
