"""Explicit schemas of the shop tables and event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PRODUCT = T.StructType(
    [
        T.StructField("productId", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("imageUrl", T.StringType()),
        T.StructField("categories", T.StringType()),
        T.StructField("tags", T.StringType()),
    ]
)

RATING = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("productId", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("timestamp", T.LongType()),
    ]
)

LOGIN = T.StructType(
    [
        T.StructField("userId", T.LongType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

PAGE_VIEW = T.StructType(
    [
        T.StructField("itemId", T.IntegerType()),
        T.StructField("eventType", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

RECOMMENDATION = T.StructType(
    [T.StructField("productId", T.IntegerType()), T.StructField("score", T.DoubleType())]
)

USER_RECS = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("recommendations", T.ArrayType(RECOMMENDATION, False)),
    ]
)

PRODUCT_RECS = T.StructType(
    [
        T.StructField("productId", T.IntegerType()),
        T.StructField("recommendations", T.ArrayType(RECOMMENDATION, False)),
    ]
)

STREAM_RECS = T.StructType(
    [
        T.StructField("userId", T.IntegerType()),
        T.StructField("recs", T.ArrayType(RECOMMENDATION, False)),
    ]
)

# Long form of a similarity matrix: one row per ordered product pair.
SIMILARITY = T.StructType(
    [
        T.StructField("productId", T.IntegerType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("recProductId", T.IntegerType()),
        T.StructField("score", T.DoubleType()),
    ]
)

LATE_VIEWS = T.StructType([*PAGE_VIEW.fields, T.StructField("watermark", T.LongType())])

HOT_ITEMS = T.StructType(
    [
        T.StructField("windowEnd", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("itemId", T.IntegerType()),
        T.StructField("nums", T.LongType()),
    ]
)


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Select the schema's columns in order and cast them; a missing column fails at analysis."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
