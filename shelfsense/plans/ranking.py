"""Ranking inside groups, and ranked lists nested into arrays."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, keys: Sequence[str], order: Sequence[Column], rank: str = "rank") -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window))


def top_k(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """First ``k`` rows per key; Spark cuts every map task to ``k`` per key before the shuffle."""
    return ranked(df, keys, order, rank).where(F.col(rank) <= k)


def nest_ranked(df: DataFrame, key: str, item: str, score: str, out: str = "recommendations") -> DataFrame:
    """Turn rows already cut to a top-k into one row per key with an array in rank order."""
    entry = F.struct(F.col("rank"), F.col(item).alias("productId"), F.col(score).alias("score"))
    return (
        df.groupBy(key)
        .agg(F.sort_array(F.collect_list(entry)).alias("_list"))
        .select(
            key,
            F.transform(
                "_list", lambda e: F.struct(e["productId"].alias("productId"), e["score"].alias("score"))
            ).alias(out),
        )
    )


def unnest_ranked(df: DataFrame, key: str, item: str = "recProductId", source: str = "recommendations") -> DataFrame:
    """Inverse of :func:`nest_ranked`: (key, rank, item, score)."""
    return df.select(key, F.posexplode(source).alias("_pos", "_rec")).select(
        key,
        (F.col("_pos") + 1).alias("rank"),
        F.col("_rec.productId").alias(item),
        F.col("_rec.score").alias("score"),
    )
