"""Per-user rating state: recent lists and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.plans.ranking import top_k


def newest_first() -> list:
    """Order of a user's ratings: newest first; equal times by product, then by higher score."""
    return [F.desc("timestamp"), F.asc("productId"), F.desc("score")]


def recent_ratings(ratings: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` newest ratings of every user: (userId, rank, productId, score, timestamp)."""
    return top_k(ratings, ["userId"], newest_first(), n).select("userId", "rank", "productId", "score", "timestamp")


def latest_rating(ratings: DataFrame) -> DataFrame:
    """Each user's newest rating, as one row of (userId, productId, score, timestamp).

    An aggregate with a partial step: a user with very many ratings shrinks to one row per map task.
    """
    newest = F.struct("timestamp", (-F.col("productId")).alias("minus_product"), "score")
    return ratings.groupBy("userId").agg(F.max(newest).alias("last")).select(
        "userId",
        (-F.col("last.minus_product")).alias("productId"),
        F.col("last.score").alias("score"),
        F.col("last.timestamp").alias("timestamp"),
    )


def merge_ratings(existing: DataFrame, updates: DataFrame | None = None, arrival: tuple[str, ...] = ()) -> DataFrame:
    """One row per (user, product): the write that arrives last sets the score, the first one the time.

    Updates arrive after all existing rows, whatever their clock says. ``arrival`` names columns that order the rows of
    one table; without them, time and score do. Columns missing in a table (a merged one has none) count as null.
    """
    order = arrival or ("timestamp", "score")
    kinds = {c: t[c].dataType for t in (existing.schema, updates.schema if updates is not None else existing.schema) for c in order if c in t.names}

    def turn(rows: DataFrame, n: int) -> DataFrame:
        missing = [c for c in order if c not in rows.columns]
        return rows.withColumns({"_turn": F.lit(n)} | {c: F.lit(None).cast(kinds[c]) for c in missing}).select(
            "userId", "productId", F.col("score").alias("_score"), F.col("timestamp").alias("_time"), F.struct("_turn", *order).alias("_seq")
        )

    rows = turn(existing, 0)
    if updates is not None:
        rows = rows.unionByName(turn(updates, 1))
    return rows.groupBy("userId", "productId").agg(
        F.max_by("_score", "_seq").alias("score"), F.min_by("_time", "_seq").alias("timestamp")
    )


def merge_versions(rows: DataFrame, version: str = "_version") -> DataFrame:
    """One row per (user, product) of writes with a version: the last write sets the score, the first one the time.

    Writes of one version count in order of time, then score.
    """
    seq = F.struct(version, "timestamp", "score")
    return rows.groupBy("userId", "productId").agg(F.max_by("score", seq).alias("score"), F.min_by("timestamp", seq).alias("timestamp"))
