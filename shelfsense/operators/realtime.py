"""Priority scores that refresh a user's list after a new rating."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.functions.scores import PRIORITY_DIGITS, log10_at_least_one, rounded, weighted_mean
from shelfsense.operators.content import met_similarity
from shelfsense.operators.ratings import latest_rating, recent_ratings
from shelfsense.plans.joins import hot_keys, spread_join
from shelfsense.plans.ranking import nest_ranked, ranked, top_k
from shelfsense.session import materialise

RECENT = 20
CANDIDATES = 20
MIN_SIMILARITY = 0.4
HIGH_SCORE = 3

EVENTS_PER_TASK = 100_000

#: Products of a user that are carried as an array; users who rated more take a join.
RATED_ARRAY = 2048


def candidates(
    events: DataFrame, ratings: DataFrame, similar: DataFrame, n: int = CANDIDATES, spread: int = EVENTS_PER_TASK, held: int = RATED_ARRAY
) -> DataFrame:
    """The ``n`` products most similar to each event's product that its user has not rated.

    (userId, rank, candidate). ``similar`` is a ranked similarity table. A user who rated ``r``
    products can lose at most ``r`` entries of a list, so no list is read beyond rank ``n + r``. The
    events of one product beyond ``spread`` are split over several tasks. Users who rated more than ``held`` products take a join.
    """
    rated = ratings.select("userId", "productId").distinct()
    # The rated products travel with the event as an array, so that lists are cut to ``n`` in the task that opens them.
    number = F.count(F.lit(1)).over(Window.partitionBy("userId"))
    few = F.collect_list(F.when(F.col("_rated") <= held, F.col("productId")))
    load = materialise(
        rated.withColumn("_rated", number).groupBy("userId").agg(F.first("_rated").alias("_rated"), few.alias("_known")), "rated-products"
    )
    asked = events.select("userId", "productId").join(load, "userId", "left")
    lists = similar.select("productId", F.col("rank").alias("_rank"), F.col("recProductId").alias("candidate"), "score")
    reach = F.col("_rank") <= F.coalesce("_rated", F.lit(0)) + n
    hot = hot_keys(events.select("productId"), "productId", spread)
    offered = spread_join(asked, lists, "productId", hot).where(reach)
    unseen = offered.where(~F.coalesce(F.array_contains("_known", F.col("candidate")), F.lit(False))).drop("_known")
    busy = load.where(F.col("_rated") > held)
    if not busy.isEmpty():
        seen = rated.join(busy.select("userId"), "userId", "left_semi").withColumnRenamed("productId", "candidate")
        unseen = unseen.join(seen, ["userId", "candidate"], "left_anti")
    best = top_k(unseen, ["userId"], [F.desc("score"), F.asc("candidate")], n)
    return best.select("userId", "rank", "candidate")


def deepest_rank(ratings: DataFrame, n: int = CANDIDATES) -> int:
    """Rank beyond which no list is read by :func:`candidates`: ``n`` and the products of the user who rated most."""
    load = ratings.groupBy("userId").agg(F.count_distinct("productId").alias("_rated"))
    return n + (load.agg(F.max("_rated")).first()[0] or 0)


def priority_scores(
    wanted: DataFrame,
    recent: DataFrame,
    similar: DataFrame | Callable[[DataFrame], DataFrame] | None,
    threshold: float = MIN_SIMILARITY,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Score of every candidate against its user's recent ratings: (userId, productId, score).

    mean(similarity * rating) + lg(high ratings) - lg(low ratings), over recent ratings whose
    similarity passes the threshold; counts below one read as one. Candidates without any fall out.
    ``similar`` is a similarity table, or a function that gives the rows of it for given (productId, recProductId).
    With ``profiles`` (:func:`shelfsense.operators.content.tag_profiles`) it is taken from those where a user's two lists meet.
    """
    history = recent.select("userId", F.col("productId").alias("ratedId"), F.col("score").alias("rating"))
    if profiles is not None:
        asked = wanted.select("userId", F.col("candidate").alias("productId"))
        evidence = met_similarity(asked, history.withColumnRenamed("ratedId", "recProductId"), "userId", profiles, threshold)
        return _priorities(evidence.withColumnRenamed("productId", "candidate"))
    met = wanted.select("userId", "candidate").join(history, "userId")
    if callable(similar):
        met = materialise(met, "evidence")
        similar = similar(met.select(F.col("candidate").alias("productId"), F.col("ratedId").alias("recProductId")))
    lookup = similar.where(F.col("score") > threshold).select(
        F.col("productId").alias("candidate"), F.col("recProductId").alias("ratedId"), F.col("score").alias("similarity")
    )
    return _priorities(met.join(lookup, ["candidate", "ratedId"]))


def _priorities(evidence: DataFrame) -> DataFrame:
    """Score of every (userId, candidate) from rows of (similarity, rating)."""
    high = F.count_if(F.col("rating") > HIGH_SCORE)
    low = F.count_if(F.col("rating") <= HIGH_SCORE)
    score = weighted_mean(F.col("similarity"), F.col("rating")) + log10_at_least_one(high) - log10_at_least_one(low)
    return evidence.groupBy("userId", "candidate").agg(rounded(score, PRIORITY_DIGITS).alias("score")).select(
        "userId", F.col("candidate").alias("productId"), "score"
    )


def realtime_scores(
    events: DataFrame,
    ratings: DataFrame,
    similar: DataFrame | Callable[[DataFrame], DataFrame],
    recent_n: int = RECENT,
    candidate_n: int = CANDIDATES,
    threshold: float = MIN_SIMILARITY,
    pair_scores: Callable[[DataFrame], DataFrame] | None = None,
    profiles: DataFrame | None = None,
) -> DataFrame:
    """Ranked list for the user of each rating event: (userId, rank, productId, score).

    Of several events of one user the latest counts. ``ratings`` is the history, which already
    holds the events. Only the event users' ratings are read beyond the scan. ``similar`` is a
    similarity table, or a function that opens the part of it with the given productIds. Lists cut at
    :func:`deepest_rank` do if ``pair_scores`` gives the similarity of (productId, recProductId) pairs, or ``profiles`` the products' vectors.
    """
    last = latest_rating(events)
    history = ratings.join(last.select("userId"), "userId", "left_semi")
    opened = similar(last.select("productId")) if callable(similar) else similar
    wanted = candidates(last, history, opened, candidate_n)
    lookup = pair_scores
    if lookup is None and profiles is None:
        lookup = similar(wanted.select(F.col("candidate").alias("productId"))) if callable(similar) else similar
    scored = priority_scores(wanted, recent_ratings(history, recent_n), lookup, threshold, profiles)
    order = [F.desc("score"), F.asc("productId")]
    return ranked(scored, ["userId"], order).select("userId", "rank", "productId", "score")


def realtime_recs(
    events: DataFrame, ratings: DataFrame, similar: DataFrame | Callable[[DataFrame], DataFrame], **options
) -> DataFrame:
    """One row per event user: (userId, recs), an empty list where nothing qualifies."""
    lists = nest_ranked(realtime_scores(events, ratings, similar, **options), "userId", "productId", "score", "recs")
    users = events.select("userId").distinct()
    nothing = F.array().cast("array<struct<productId:int,score:double>>")
    return users.join(lists, "userId", "left").select("userId", F.coalesce("recs", nothing).alias("recs"))
