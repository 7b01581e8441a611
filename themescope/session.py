"""Session set-up and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import SparkSession

# Session settings every themescope job relies on.  Time zone: epoch seconds,
# windows and year-month strings are defined in UTC.
SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_spark(master: str | None = None, app: str = "themescope",
              shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """Local/test session builder; on a cluster use the provided session and
    call :func:`configure` on it instead."""
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (SparkSession.builder.master(master or f"local[{cpus}]").appName(app)
               .config("spark.ui.enabled", "false")
               .config("spark.ui.showConsoleProgress", "false")
               .config("spark.driver.memory", os.environ.get("THEMESCOPE_DRIVER_MEMORY", "16g"))
               .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus))))
    for k, v in {**SESSION_CONF, **extra}.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    return spark


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime SQL settings themescope needs to an existing session,
    and ship the package to its Python workers."""
    for k, v in SESSION_CONF.items():
        spark.conf.set(k, v)
    ship(spark)
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the workers (once a context), so that Python
    operators run whatever folder the driver was started in."""
    sc = spark.sparkContext
    if getattr(sc, "_themescope_shipped", False):
        return
    here = Path(__file__).resolve().parent
    path = Path(tempfile.mkdtemp(prefix="themescope-ship-")) / f"{here.name}.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(here.rglob("*.py")):
            z.write(f, f.relative_to(here.parent))
    sc.addPyFile(str(path))
    sc._themescope_shipped = True


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    Read from ``spark.checkpoint.dir``; only a local-mode session (tests, the
    bench) gets a fresh temporary folder when the setting is absent.  On a
    cluster an unset value is an error: a machine-local folder would not
    survive the loss of an executor.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder")
        root = tempfile.mkdtemp(prefix="themescope-chk-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unique path below the shared checkpoint folder."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df, name: str):
    """``df`` written once below the shared folder and read back: cuts the lineage, and
    several later uses read files.  The schema is given, so empty tables stay readable."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, n: int):
    """Jobs inside send at most ``n`` rows to Python at a time: for rows that hold
    long binaries."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(key)
    spark.conf.set(key, str(n))
    try:
        yield
    finally:
        spark.conf.set(key, old)


def balance(df, min_partitions: int | None = None):
    """Spread a scan that yields fewer partitions than the cluster has cores
    (e.g. one large single-row-group file) round-robin over all of them, so
    CPU-heavy per-row work (regex cleaning, tokenising) is not one task.
    A scan that is already wide enough — any table at scale — is untouched.
    """
    target = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(target) if df.rdd.getNumPartitions() < target else df
