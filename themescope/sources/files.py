"""File sources and sinks for posts, vectors, clustered posts and reports
(SRC-3..7, SNK-1..4).  Parquet partitioned by ``dataset`` is the default
sink; CSV round-trips with pandas-style quote doubling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from themescope import schemas
from themescope.functions.text import dataset_key

CLUSTERED_SUFFIX = "_clustered.csv"
CSV_OPTIONS = {"header": "true", "escape": '"', "multiLine": "true"}


def read_posts_csv(spark: SparkSession, path: str, with_cluster: bool = False) -> DataFrame:
    """Header CSV as written by pandas (quotes doubled), with an explicit schema."""
    if not with_cluster:
        return spark.read.schema(schemas.POST).options(**CSV_OPTIONS).csv(path)
    return in_order(spark.read.schema(schemas.CLUSTERED).options(**CSV_OPTIONS).csv(path))


def in_order(rows: DataFrame) -> DataFrame:
    """Rows as read from files, with their arrival order as ``ord`` where they have none:
    files by path, then the row order of a file.

    The scan order alone would not do: Spark packs the largest files first.  The number
    of a file comes from the sorted list of paths (one row per file); inside a file the
    generated ids ascend, as ``multiLine`` files are read by one task each."""
    own = F.col("ord") if "ord" in rows.columns else F.lit(None).cast("long")
    path, row = F.col("_metadata.file_path"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    at = rows.select(*rows.columns, path.alias("_path"), row.alias("_row"))
    number = F.row_number().over(Window.orderBy("_path")).cast("long")
    files = rows.select(path.alias("_path")).distinct().select("_path", number.alias("_file"))
    place = F.shiftleft(F.col("_file"), 33) + F.col("_row")
    return at.join(files, "_path").withColumn("ord", F.coalesce(own, place)).drop("_path", "_file", "_row")


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).options(**CSV_OPTIONS).csv(path)


def read_clustered(spark: SparkSession, folder: str) -> DataFrame:
    """Every ``*_clustered.csv`` of a folder — a single CSV file (as pandas
    writes it) or a folder of part files (as Spark writes it) — with the
    dataset each row came from, taken from the path."""
    df = spark.read.schema(schemas.CLUSTERED).options(**CSV_OPTIONS).csv(
        f"{folder.rstrip('/')}/*{CLUSTERED_SUFFIX}")
    path = F.col("_metadata.file_path")
    dataset = F.regexp_extract("_from", r"([^/]+)_clustered\.csv(/[^/]+)?$", 1)
    return in_order(df.select("*", "_metadata", path.alias("_from"))).withColumn("dataset", dataset).drop("_from", "_metadata")


def list_datasets(spark: SparkSession, folder: str, suffix: str = ".csv",
                  exclude_suffix: str = CLUSTERED_SUFFIX) -> DataFrame:
    """Dataset names in a folder of landed CSV files, empty ones and folders that
    Spark wrote included; outputs are excluded.  Only the folder is listed, no
    file is opened (Spark's readers leave out empty files)."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    entries = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    names = sorted(e.getPath().getName() for e in entries)
    return spark.createDataFrame([(n[:-len(suffix)],) for n in names if n.endswith(suffix) and not n.endswith(exclude_suffix)],
                                 "dataset string")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTOR).parquet(path)


def write_table(df: DataFrame, path: str, topic: str | None = None, mode: str = "append") -> None:
    """Parquet sink partitioned by ``dataset`` (derived from ``topic`` if given)."""
    if topic is not None:
        df = df.withColumn("dataset", dataset_key(F.lit(topic)))
    df.write.mode(mode).partitionBy("dataset").parquet(path)


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Several feeds mapped into one schema (UNION ALL by column name)."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_report(lines: DataFrame, path: str) -> None:
    """Report lines (a handful of rows) as one text file, in line order."""
    lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
