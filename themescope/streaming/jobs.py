"""Streaming jobs.

Every job is the batch operator applied to a streaming DataFrame: the same
column expressions, so stream and batch agree by construction.  Sinks keep
their checkpoints under the shared ``spark.checkpoint.dir`` so a restarted
query (or a lost executor) resumes exactly where it stopped.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from themescope import schemas
from themescope.functions.vector import l2_normalize
from themescope.operators.cluster import MAX_CENTRES, assign_nearest, centres_literal, collect_small
from themescope.session import scratch_path
from themescope.sources.hits import flatten_pages, hits_to_posts


def ingest_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """Landed JSON response pages → post rows, as a stream (STR-1), with the
    time of the micro-batch that read them as ``landed_at``."""
    reader = spark.readStream.schema(schemas.RESPONSE_PAGE)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return hits_to_posts(flatten_pages(reader.json(path))).withColumn("landed_at", F.current_timestamp())


def dedup_stream(posts: DataFrame, delay: str = "1 day", key: str = "id",
                 ts: str = "landed_at") -> DataFrame:
    """Drop repeated ids while their first copy is within the watermark (STR-2).

    The watermark is on the landing time, never on ``created_at``: a post that
    has no time, or an old one, is not late.  State per id is evicted once the
    watermark passes, so it stays bounded by the ids landed within ``delay``.
    """
    return posts.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


_JSON_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}


def _least_of_batches(batches):
    """Of each Arrow batch the row of least ``ord`` per id: a hot id is cut before the shuffle."""
    for batch in batches:
        rows = pd.DataFrame({"id": batch.column(0).to_pandas(), "ord": batch.column(1).to_numpy(zero_copy_only=False)})
        yield batch.take(pa.array(rows.sort_values("ord", kind="stable").drop_duplicates("id").index.to_numpy()))


def keep_first_stream(posts: DataFrame, ttl: str = "1 day", ts: str = "landed_at") -> DataFrame:
    """Rows of ``posts`` (id, ord, ...) that come earlier in ``ord`` than every copy of
    their id so far (STR-2): for ``run_updates``, read by ``kept_first``.

    State per id is its least ``ord`` alone, dropped when no copy has landed for
    ``ttl`` (watermark of ``ts``); a copy that lands later gives one more row,
    which ``kept_first`` settles.  Null ids are one key, as in batch.  ``ord`` is
    not null; other columns of any type may be null.  ``ts`` is not returned.
    """
    columns = [f for f in posts.schema.fields if f.name != ts]
    row = F.to_json(F.struct(*[f.name for f in columns]), _JSON_TIME)
    packed = posts.withWatermark(ts, ttl).select("id", F.col("ord").cast("long").alias("ord"), F.col(ts).alias("landed"), row.alias("row"))
    packed = packed.mapInArrow(_least_of_batches, packed.schema)
    keep_ms = int(pd.Timedelta(ttl).total_seconds() * 1000)

    def run(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        # Mostly one frame of one row: plain arrays, as a key costs what its pandas calls cost.
        least = row = landed = None
        for frame in frames:
            order, times = frame["ord"].to_numpy(), frame["landed"].to_numpy()
            at, time = int(order.argmin()), int(times.max().astype("datetime64[ms]").astype("int64"))
            if least is None or order[at] < least:
                least, row = int(order[at]), frame["row"].iat[at]
            landed = time if landed is None else max(landed, time)
        known = state.get[0] if state.exists else None
        if known is None or least < known:
            state.update((least,))
            yield pd.DataFrame({"row": [row]})
        state.setTimeoutTimestamp(max(landed + keep_ms, state.getCurrentWatermarkMs() + 1))

    out = packed.groupBy("id").applyInPandasWithState(run, "row string", "least bigint", "update", "EventTimeTimeout")
    schema = T.StructType([T.StructField(f.name, f.dataType) for f in columns])
    return out.select(F.from_json("row", schema, _JSON_TIME).alias("r")).select("r.*")


def kept_first(spark: SparkSession, sink_path: str, schema: T.StructType) -> DataFrame:
    """The first row of every id from the updates of ``keep_first_stream``: batch ORD-1."""
    from themescope.operators.ingest import dedup_first
    return dedup_first(spark.read.schema(schema).parquet(f"{sink_path}/batch_id=*"))


def assign_stream(df: DataFrame, centres: Column, vec_col: str = "embedding",
                  normalize: bool = True) -> DataFrame:
    """Stateless nearest-centre assignment; centres ship as a constant (STR-3)."""
    return assign_nearest(df, centres, vec_col, normalize)


def drift_counts_stream(clustered: DataFrame, period: str = "7 days", slide: str | None = None,
                        delay: str = "30 days", ts: str = "created_at") -> DataFrame:
    """Per (window, cluster) counts; rows behind the watermark are dropped (STR-4)."""
    w = F.window(F.col(ts), period, slide) if slide else F.window(F.col(ts), period)
    return (clustered.withWatermark(ts, delay).groupBy(w.alias("w"), "cluster")
            .agg(F.count(F.lit(1)).alias("n_posts"))
            .select(F.col("w.start").alias("period_start"), F.col("w.end").alias("period_end"),
                    "cluster", "n_posts"))


def drift_with_late_batch(spark: SparkSession, path: str, period: str = "7 days", delay: str = "7 days",
                          ts: str = "created_at"):
    """``foreachBatch`` function for drift counts that lose no row (STR-4).

    The watermark of a batch is the latest ``ts`` of earlier batches less
    ``delay``, as Spark's own.  Rows whose period it has passed go to the table
    ``late`` whole, as do rows without a time (period null); all others are
    counted, so counts of passed periods never change.  Tables are versioned by
    batch id: a replayed batch overwrites its own, the state is one timestamp.
    """
    spark.createDataFrame([(None,)], "latest timestamp").write.mode("ignore").parquet(f"{path}/clock/batch=-1")

    def run(batch: DataFrame, batch_id: int):
        clock = batch.sparkSession.read.schema("latest timestamp, batch long").parquet(f"{path}/clock")
        latest = clock.where(F.col("batch") < batch_id).select(F.max("latest")).scalar()
        passed = F.coalesce(F.col("period_end") <= latest - F.expr(f"INTERVAL {delay}"), F.lit(False))
        batch = batch.persist()
        w = F.window(F.col(ts), period)
        # ``window`` leaves out rows without a time.
        rows = batch.withColumn("_w", w).select(*batch.columns, F.col("_w.start").alias("period_start"), F.col("_w.end").alias("period_end"))
        untimed = batch.where(F.col(ts).isNull()).withColumns({c: F.lit(None).cast("timestamp") for c in ("period_start", "period_end")})
        for table, df in (("counts", rows.where(~passed).groupBy("period_start", "period_end", "cluster").agg(F.count(F.lit(1)).alias("n_posts"))),
                          ("late", rows.where(passed).unionByName(untimed)), ("clock", batch.agg(F.max(ts).alias("latest")))):
            df.write.mode("overwrite").parquet(f"{path}/{table}/batch={batch_id}")
        batch.unpersist()
    return run


def drift_counts_on_time(spark: SparkSession, path: str) -> DataFrame:
    """(period_start, cluster, n_posts) of rows that were not late."""
    return (spark.read.parquet(f"{path}/counts").groupBy("period_start", "cluster")
            .agg(F.sum("n_posts").cast("long").alias("n_posts")))


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The rows that came behind the watermark or without a time, with their period."""
    return spark.read.parquet(f"{path}/late").drop("batch")


def drift_counts_corrected(spark: SparkSession, path: str) -> DataFrame:
    """Counts on time plus late rows: what a batch over all timed rows counts."""
    late = (late_rows(spark, path).where(F.col("period_start").isNotNull())
            .groupBy("period_start", "cluster").agg(F.count(F.lit(1)).alias("n_posts")))
    return (drift_counts_on_time(spark, path).unionByName(late).groupBy("period_start", "cluster")
            .agg(F.sum("n_posts").cast("long").alias("n_posts")))


def run_batches(df: DataFrame, fn, checkpoint: str) -> None:
    """Every micro-batch through ``fn(batch, batch_id)``, until all that is there is processed."""
    q = df.writeStream.foreachBatch(fn).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def run_available_now(df: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> None:
    """Process everything available, then stop (file sink, exactly-once)."""
    q = (df.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start(sink_path))
    q.awaitTermination()


def run_updates(df: DataFrame, sink_path: str, checkpoint: str) -> None:
    """Update-mode aggregate → every batch's changed rows appended with its
    batch id; readers take the latest row per key (see ``latest_updates``)."""
    def write(batch: DataFrame, batch_id: int):
        (batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite")
         .parquet(f"{sink_path}/batch_id={batch_id}"))
    q = (df.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
         .foreachBatch(write).trigger(availableNow=True).start())
    q.awaitTermination()


def latest_updates(spark: SparkSession, sink_path: str, keys: list[str]) -> DataFrame:
    from themescope.operators.ingest import first_n_per_group
    u = spark.read.option("basePath", sink_path).parquet(f"{sink_path}/batch_id=*")
    return first_n_per_group(u, keys, 1, [F.col("batch_id").desc()]).drop("batch_id")


def update_centres_batch(centres_path: str, decay: float = 1.0, vec_col: str = "embedding",
                         max_k: int = MAX_CENTRES):
    """``foreachBatch`` function for decayed centre updates (STR-5).

    Centres live in a Parquet table versioned by batch id
    (``centres_path/version=<id>``, columns cluster, center, weight).  Each
    batch reads the newest version below its id, assigns its rows, and
    writes version ``batch_id`` with c' = (c·n·a + Σx) / (n·a + m) — so a
    replayed batch overwrites the same version: idempotent.
    """
    def run(batch: DataFrame, batch_id: int):
        spark = batch.sparkSession
        prev = spark.read.parquet(centres_path).where(F.col("version") < batch_id)
        last = prev.select(F.max("version")).scalar()
        old = prev.where(F.col("version") == last).select("cluster", "center", "weight")
        rows = collect_small(old, max_k, "centres")
        a = assign_nearest(batch, centres_literal(rows), vec_col)
        stats = (a.select("cluster", array_to_vector(l2_normalize(vec_col)).alias("_v"))
                 .groupBy("cluster").agg(Summarizer.mean(F.col("_v")).alias("_m"), F.count(F.lit(1)).alias("m"))
                 .select("cluster", vector_to_array("_m").alias("center_new"), "m"))
        j = old.join(stats, "cluster", "left")
        na = F.col("weight") * decay
        m = F.coalesce(F.col("m"), F.lit(0)).cast("double")
        new_center = F.when(F.col("m").isNull(), F.col("center")).otherwise(F.zip_with(
            "center", "center_new", lambda c, x: (c * na + x * m) / (na + m)))
        out = j.select("cluster", new_center.alias("center"), (na + m).alias("weight"))
        out.write.mode("overwrite").parquet(f"{centres_path}/version={batch_id}")
    return run


LANDED_FILE_BYTES = 64 << 20


def landed_files(texts: DataFrame, least: int, text_col: str = "text") -> int:
    """Number of files to land pages of ``texts`` in: no task writes or reads more than about
    ``LANDED_FILE_BYTES``; a multiple of ``least``."""
    size = texts.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    return least * max(1, math.ceil(size / LANDED_FILE_BYTES / least))


def write_stream_input(df: DataFrame, path: str, n_files: int, order: str = "ord",
                       fmt: str = "parquet") -> str:
    """Land a table as ``n_files`` files (range-split on ``order``) for a file stream."""
    w = df.repartitionByRange(n_files, order).write.mode("overwrite")
    getattr(w, fmt)(path)
    return path


def stream_dir(spark: SparkSession, name: str) -> str:
    return scratch_path(spark, name)
