"""Explicit schemas for every table themescope reads or exchanges."""

from pyspark.sql import types as T

HIT_FIELDS = [
    T.StructField("objectID", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("story_text", T.StringType()),
    T.StructField("comment_text", T.StringType()),
    T.StructField("created_at_i", T.LongType()),
    T.StructField("points", T.LongType()),
    T.StructField("url", T.StringType()),
]
HIT = T.StructType(HIT_FIELDS)

# One landed search response page: the tag it was fetched for, its page
# number and the hits array, as the search service returns it.
RESPONSE_PAGE = T.StructType([
    T.StructField("content_type", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("hits", T.ArrayType(HIT)),
])

# Flattened hits: one row per hit with its arrival coordinates.
HITS = T.StructType([
    T.StructField("content_type", T.StringType()),
    T.StructField("page", T.IntegerType()),
    T.StructField("pos", T.IntegerType()),
    *HIT_FIELDS,
])

POST = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("text", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("platform", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("score", T.LongType()),
    T.StructField("url", T.StringType()),
])

VECTOR = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

CENTROID = T.StructType([
    T.StructField("cluster", T.IntegerType()),
    T.StructField("center", T.ArrayType(T.DoubleType())),
])

# ``ord`` is the arrival order; files of other writers may lack this last column.
CLUSTERED = T.StructType(POST.fields + [T.StructField("cluster", T.IntegerType()), T.StructField("ord", T.LongType())])

LAYOUT = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("x", T.DoubleType()),
    T.StructField("y", T.DoubleType()),
])
