"""Rating statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.scores import year_month


def rating_counts(ratings: DataFrame) -> DataFrame:
    """Ratings per product: (productId, count)."""
    return ratings.groupBy("productId").agg(F.count(F.lit(1)).alias("count"))


def monthly_rating_counts(ratings: DataFrame) -> DataFrame:
    """Ratings per product and calendar month: (productId, count, yearmonth)."""
    return (
        ratings.groupBy(year_month(F.col("timestamp")).alias("yearmonth"), "productId")
        .agg(F.count(F.lit(1)).alias("count"))
        .select("productId", "count", "yearmonth")
    )


def mean_scores(ratings: DataFrame) -> DataFrame:
    """Mean score per product: (productId, avg)."""
    return ratings.groupBy("productId").agg(F.avg("score").alias("avg"))


def rate_more_products(ratings: DataFrame) -> DataFrame:
    return rating_counts(ratings).orderBy(F.desc("count"), "productId")


def rate_more_recently(ratings: DataFrame) -> DataFrame:
    return monthly_rating_counts(ratings).orderBy(F.desc("yearmonth"), F.desc("count"), "productId")


def average_products(ratings: DataFrame) -> DataFrame:
    return mean_scores(ratings).orderBy(F.desc("avg"), "productId")


def hot_products(monthly: DataFrame, n: int) -> DataFrame:
    """Leading products of the newest months, from a monthly count table."""
    return _first(monthly, [F.desc("yearmonth"), F.desc("count"), F.asc("productId")], n)


def most_rated(counts: DataFrame, n: int) -> DataFrame:
    return _first(counts, [F.desc("count"), F.asc("productId")], n)


def _first(rows: DataFrame, order: list, n: int) -> DataFrame:
    """The leading ``n`` rows with their ``rank``; only these are ranked."""
    return rows.orderBy(*order).limit(n).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def distinct_users(ratings: DataFrame) -> DataFrame:
    return ratings.select("userId").distinct()


def distinct_products(ratings: DataFrame) -> DataFrame:
    return ratings.select("productId").distinct()
