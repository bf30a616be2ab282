"""Score arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Similarities are rounded before they are compared or ranked, so that neither depends on the
# order in which partitions add up a floating-point sum.
SCORE_DIGITS = 9
PRIORITY_DIGITS = 12


def rounded(col: Column, digits: int = SCORE_DIGITS) -> Column:
    return F.round(col, digits)


def weighted_mean(similarity: Column, rating: Column) -> Column:
    """Aggregate: mean of similarity * rating. The sum is decimal, hence the same in any order."""
    return F.sum((similarity * rating).cast("decimal(20,11)")).cast("double") / F.count(F.lit(1))


def cooccurrence_similarity(together: Column, count_a: Column, count_b: Column) -> Column:
    """Shared raters over the geometric mean of both rating counts (product taken as double)."""
    return together / F.sqrt(count_a.cast("double") * count_b.cast("double"))


def log10_at_least_one(count: Column) -> Column:
    return F.log10(F.greatest(count, F.lit(1)).cast("double"))


def half_star(score: Column) -> Column:
    """10-point score to the 5-point scale, two decimals, half up."""
    return F.round(score / 2, 2)


def score_or_zero(avg: Column) -> Column:
    return F.coalesce(avg, F.lit(0.0))


def year_month(epoch_seconds: Column) -> Column:
    """yyyyMM of an epoch in seconds, in the session's (UTC) calendar."""
    ts = F.timestamp_seconds(epoch_seconds)
    return (F.year(ts) * 100 + F.month(ts)).cast("int")


def register_sql_functions(spark: SparkSession) -> None:
    """``changeDate(seconds)`` for SQL users: an inlined SQL function, no Python involved."""
    spark.sql(
        "CREATE OR REPLACE TEMPORARY FUNCTION changeDate(seconds BIGINT) RETURNS INT "
        "RETURN CAST(date_format(timestamp_seconds(seconds), 'yyyyMM') AS INT)"
    )
