"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themescope.session import arrow_rows, scratch_path, ship  # noqa: F401

WORDS = r"[^\x20\x09-\x0D]+"
#: Rows that hold texts are sent to Python so many at a time.
BATCH_ROWS = 1024


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table; the workers get this package, whatever folder the driver was started in."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back: cuts
    the lineage, and several later uses read files instead of recomputing.
    The explicit schema keeps empty tables readable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def lean(run):
    """``run`` for mapInArrow, after which the worker hands memory that its
    allocators keep back to the system: workers wait for later tasks, idle ones too."""
    def task(batches):
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)
    return task


class Made:
    """``make(*args)``, made in a worker when it is first called.  Sent as a broadcast
    it serves all tasks of a job, and goes with the worker's first task of another."""

    def __init__(self, make, *args):
        self.make, self.args = make, args

    def __reduce__(self):
        return Made, (self.make, *self.args)

    def __call__(self):
        if not hasattr(self, "made"):
            self.made = self.make(*self.args)
        return self.made


def free_names(df: DataFrame, names: tuple[str, ...]) -> tuple[str, ...]:
    """``names`` with as many underscores before them as it takes to clash with no
    column of ``df`` (Spark's names are equal whatever their case)."""
    taken = {c.lower() for c in df.columns}
    mark = ""
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return tuple(mark + n for n in names)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc32_text(c) -> Column:
    """Unsigned crc32 of the UTF-8 bytes; null text counts as empty."""
    return F.crc32(F.encode(F.coalesce(c, F.lit("")), "UTF-8"))


def starts(df: DataFrame, keys: list[str], bucket: str, order: list, size: str, out: str) -> DataFrame:
    """Add ``out``: the sum of ``size`` over the rows of equal ``keys`` that come
    before a row in the order (bucket, *order).

    Two levels: totals per (keys, bucket) are summed over the buckets, then a
    window inside each bucket adds the rest, so no task sorts a whole key.
    ``keys`` and ``bucket`` must not be null.
    """
    totals = df.groupBy(*keys, bucket).agg(F.sum(size).alias("_sum"))
    over = (Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))).orderBy(bucket)
    base = totals.select(*keys, bucket, (F.sum("_sum").over(over) - F.col("_sum")).alias("_base"))
    inner = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return (df.withColumn("_in", F.sum(size).over(inner) - F.col(size))
            .join(base, [*keys, bucket])
            .withColumn(out, (F.col("_base") + F.col("_in")).cast("long")).drop("_base", "_in"))
