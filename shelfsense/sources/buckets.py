"""Tables laid out by a hash bucket of a key, so that a few keys are read without a full scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKET = "bucket"
MAX_BUCKETS = 10_000


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int) -> None:
    """One partition folder per bucket. The rebalance hint splits the bucket of a hot key over tasks."""
    if buckets > MAX_BUCKETS:
        raise ValueError(f"more than {MAX_BUCKETS} buckets")
    rows = df.withColumn(BUCKET, bucket_of(key, buckets)).hint("rebalance", BUCKET)
    rows.write.mode("overwrite").partitionBy(BUCKET).parquet(path)


def read_buckets(spark: SparkSession, path: str, keys: DataFrame, key: str, buckets: int) -> DataFrame:
    """The rows of all buckets that ``keys`` fall into; other folders are not opened.

    Only bucket numbers, at most ``buckets`` of them, come to the driver.
    """
    hit = [row[0] for row in keys.select(bucket_of(key, buckets)).distinct().collect()]
    return spark.read.parquet(path).where(F.col(BUCKET).isin(hit)).drop(BUCKET)
