"""Mixing sources to target weights by a low-discrepancy schedule (native).

The words of each source, its documents in a seeded random order, form one
stream that is cut into blocks of equal word counts.  Slot i of the mix gets
the golden-ratio point frac(i * phi); the cumulative target shares map the point
to a source, and the r-th slot of a source takes block r of its stream.  The
stream starts again when it has been used up (twice at most).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from themescope.llm.common import WORDS, starts, table, written

# --- fixed values of the mix ------------------------------------------------
WEIGHTS = (5, 2, 1)               # by rank of the source, repeating
SHARE = 1.5                       # words of the mix over words of all documents
MAX_REPEATS = 2
# ---------------------------------------------------------------------------
BLOCK_WORDS = 256
MIN_BUCKET_ROWS = 256
MIN_CHUNK, MAX_CHUNKS = 1024, 65_536
CELLS = 1024
PHI = (math.sqrt(5) - 1) / 2
LOW = 1 << 20
PHI_HIGH = math.fmod(LOW * PHI, 1.0)
SEED = "mix-1"


def n_words(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(skey, source, source_size, weight, rank, target) from (skey, source, source_size).

    Water filling: in ascending order of cap over weight a source is filled to
    its cap as long as the level that the rest would reach is not below it; the
    rest shares what is left by weight.  One row per source, so the windows
    over all rows stay small.
    """
    every = Window.partitionBy(F.lit(0))
    by_name = every.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    ranked = (sizes.withColumn("rank", F.row_number().over(by_name) - 1)
              .withColumn("weight", weight.cast("long"))
              .withColumn("cap", F.col("source_size") * MAX_REPEATS)
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    filled = every.orderBy("ratio", "rank")
    level = ranked.withColumn(
        "level", (F.sum("source_size").over(every) * F.lit(SHARE)
                  - F.coalesce(F.sum("cap").over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        / F.sum("weight").over(filled.rowsBetween(0, Window.unboundedFollowing)))
    capped = F.col("level") >= F.col("ratio")
    final = F.max(F.when(~capped, F.col("level"))).over(every)
    target = F.when(capped, F.col("cap").cast("double")).otherwise(F.col("weight") * final)
    return level.select("skey", "source", "source_size", "weight", "rank", target.alias("target"))


def slim_documents(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, source, skey, size, mix) written once; skey is never null.
    rid tells repeated rows apart, mix is the seeded random order."""
    mix = F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    return written(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("skey"),
        n_words("text").alias("size"), mix.alias("mix")), "mix-documents")


def schedule(targets: DataFrame, total_words: float, block: int = BLOCK_WORDS) -> DataFrame:
    """(slot, skey, rank_in_source): the slots of the mix in order.

    Each source gets as many slots as its target has blocks; where the point
    set gives it a few slots too many they are left out, where a few too few
    they follow at the end.
    """
    spark = targets.sparkSession
    n = max(0, math.ceil(total_words / block))
    n_chunk = max(MIN_CHUNK, -(-n // MAX_CHUNKS))
    edge = Window.partitionBy(F.lit(0)).orderBy("rank")
    bands = (targets.withColumn("need", F.ceil(F.round("target") / block).cast("long"))
             .withColumn("hi", F.sum("target").over(edge) / F.lit(float(total_words) or 1.0))
             .withColumn("lo", F.coalesce(F.lag("hi").over(edge), F.lit(0.0)))
             .withColumn("hi", F.when(F.lead("rank").over(edge).isNull(), F.lit(2.0)).otherwise(F.col("hi"))))
    cells = bands.where("hi > lo").select(
        "skey", "lo", "hi", F.explode(F.sequence(
            F.least(F.floor(F.col("lo") * CELLS), F.lit(CELLS - 1)).cast("int"),
            F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)).cast("int"))).alias("cell"))
    slots = spark.range(n).select(
        F.col("id").alias("slot"),
        ((F.floor(F.col("id") / LOW) * PHI_HIGH + F.pmod("id", F.lit(LOW)) * PHI) % 1.0).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") * CELLS).cast("int"))
    mapped = (slots.join(cells, "cell").where("point >= lo AND point < hi")
              .select("slot", "skey", F.floor(F.col("slot") / n_chunk).alias("chunk"), F.lit(1).alias("one")))
    ranked = starts(mapped, ["skey"], "chunk", ["slot"], "one", "rank_in_source").select("slot", "skey", "rank_in_source")
    given = mapped.groupBy("skey").agg(F.count(F.lit(1)).alias("given"))
    n_sources = F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    late = (bands.join(given, "skey", "left").withColumn("n_sources", n_sources)
            .withColumn("given", F.coalesce("given", F.lit(0))).where("need > given")
            .select("skey", "rank", "n_sources", F.explode(F.sequence(F.col("given"), F.col("need") - 1)).alias("rank_in_source"))
            .select((F.lit(n) + F.col("rank_in_source") * F.col("n_sources") + F.col("rank")).alias("slot"),
                    "skey", "rank_in_source"))
    return (ranked.join(bands.select("skey", "need"), "skey").where("rank_in_source < need").drop("need")
            .select("slot", "skey", "rank_in_source").unionByName(late))


def mixed(slim: DataFrame, block: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces (slot, at, rid, doc_id, skey, pass, first_word, n_words),
    in the order (slot, at), and the targets of the sources.

    A piece is a run of words of one document; ``pass`` counts from 0 and says
    which time round the stream it belongs to.  Each source's pieces hold
    round(target) words.  Null sources are one source, the last in order; a
    null or empty text has no words and no piece; repeated rows are documents
    of their own.  An empty table, or one without words, gives an empty mix.
    """
    sizes = slim.groupBy("skey").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = written(source_targets(sizes), "mix-targets")
    total = targets.agg(F.sum("source_size")).first()[0] or 0
    rows = slim.where("size > 0")
    # About the square root of the rows in a bucket: neither a bucket nor the list of buckets is long.
    n_rows = rows.count()
    n_buckets = max(1, -(-n_rows // max(MIN_BUCKET_ROWS, math.isqrt(n_rows))))
    prefix = F.conv(F.substring("mix", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(prefix * n_buckets / (1 << 32)))
    placed = starts(rows, ["skey"], "bucket", ["mix", "doc_id", "rid"], "size", "start")
    length = F.col("source_size")
    copies = (placed.join(targets.select("skey", "source_size", F.round("target").cast("long").alias("quota")), "skey")
              .select("rid", "doc_id", "skey", "size", "quota",
                      F.explode(F.array(*[F.struct(F.lit(p).alias("pass"), (F.col("start") + p * length).alias("a"))
                                          for p in range(MAX_REPEATS)])).alias("c"))
              .select("rid", "doc_id", "skey", "quota", "c.pass", "c.a",
                      F.least(F.col("c.a") + F.col("size"), F.col("quota")).alias("b"))
              .where("a < b"))
    r = F.col("rank_in_source")
    pieces = copies.select("*", F.explode(F.sequence(F.floor(F.col("a") / block), F.floor((F.col("b") - 1) / block)))
                           .alias("rank_in_source"))
    first = F.greatest(F.col("a"), r * block)
    pieces = pieces.select("skey", r, "rid", "doc_id", "pass", (first - r * block).alias("at"),
                           (first - F.col("a")).alias("first_word"),
                           (F.least(F.col("b"), (r + 1) * block) - first).alias("n_words"))
    mix = (pieces.join(schedule(targets, total * SHARE, block), ["skey", "rank_in_source"])
           .select("slot", "at", "rid", "doc_id", "skey", "pass", "first_word", "n_words"))
    return mix, targets


def taken_words(docs: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words the mix takes of each document."""
    slim = slim_documents(docs)
    mix, targets = mixed(slim)
    taken = mix.groupBy("rid").agg(F.sum("n_words").alias("taken"))
    return (slim.join(targets.select("skey", "source_size", "target"), "skey").join(taken, "rid", "left")
            .select("doc_id", "size", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """Whole documents as the mix takes them, with the columns of ``docs``.

    A document appears once for each time round in which the mix takes at
    least half of its words; one without words appears once.
    """
    numbered = docs.withColumn("_rid", F.monotonically_increasing_id())
    numbered = written(numbered, "mix-numbered")
    slim = written(numbered.select(
        F.col("_rid").alias("rid"), "doc_id", "source",
        F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("skey"),
        n_words("text").alias("size"),
        F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))).alias("mix")),
        "mix-slim")
    mix, _ = mixed(slim)
    passes = mix.groupBy("rid", "pass").agg(F.sum("n_words").alias("w")).join(slim.select("rid", "size"), "rid")
    copies = passes.where("2 * w >= size").groupBy("rid").agg(F.count(F.lit(1)).alias("_copies"))
    copies = copies.unionByName(slim.where("size = 0").select("rid", F.lit(1).cast("long").alias("_copies")))
    return (numbered.join(copies.withColumnRenamed("rid", "_rid"), "_rid")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
            .select(*docs.columns))


def query(spark, sf_dir):
    return taken_words(table(spark, sf_dir, "documents"))


ORACLE = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
         CAST(CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '{WORDS}')) END AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS mix FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight,
             row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM s),
l AS (SELECT *, 2 * source_size AS cap, (2 * source_size) / CAST(weight AS DOUBLE) AS ratio FROM w),
v AS (SELECT *, ((SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE)
                 - coalesce(sum(cap) OVER (ORDER BY ratio, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
                / CAST(sum(weight) OVER (ORDER BY ratio, rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lvl FROM l),
t AS (SELECT source, source_size, CASE WHEN lvl >= ratio THEN CAST(cap AS DOUBLE)
             ELSE weight * (SELECT max(lvl) FROM v WHERE lvl < ratio) END AS target FROM v),
p AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY mix, doc_id, rid
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d),
c AS (SELECT p.*, t.source_size, t.target, CAST(round(t.target) AS BIGINT) AS quota
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(greatest(0, least(start + size, quota) - least(start, quota))
          + greatest(0, least(start + source_size + size, quota) - least(start + source_size, quota)) AS BIGINT) AS taken
FROM c"""
