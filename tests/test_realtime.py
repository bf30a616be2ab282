import math
import random

import pytest

from shelfsense import schemas
from shelfsense.operators import content, realtime


@pytest.fixture()
def similar(spark):
    pairs = {(1, 20): 0.9, (1, 21): 0.8, (1, 2): 0.95, (1, 22): 0.5, (20, 1): 0.9, (20, 2): 0.6, (20, 3): 0.5}
    pairs.update({(21, 1): 0.8, (21, 2): 0.4})
    rows, rank = [], {}
    for (a, b), s in sorted(pairs.items(), key=lambda x: (x[0][0], -x[1])):
        rank[a] = rank.get(a, 0) + 1
        rows.append((a, rank[a], b, s))
    return spark.createDataFrame(rows, schemas.SIMILARITY)


@pytest.fixture()
def history(spark):
    return spark.createDataFrame([(7, 1, 5.0, 300), (7, 2, 4.0, 200), (7, 3, 2.0, 100), (8, 99, 5.0, 10)], schemas.RATING)


def test_candidates_skip_rated_products(history, similar, rows):
    event = history.where("userId = 7 AND productId = 1")
    assert rows(realtime.candidates(event, history, similar, 2)) == [(7, 1, 20), (7, 2, 21)]


def test_scores(history, similar, rows):
    event = history.where("userId = 7 AND productId = 1")
    got = {r.productId: r.score for r in realtime.realtime_scores(event, history, similar).collect()}
    # Similarity exactly 0.4 (21 with 2) and a missing one (21 with 3) carry no weight; 22 has none at all.
    assert set(got) == {20, 21}
    assert got[20] == pytest.approx((0.9 * 5 + 0.6 * 4 + 0.5 * 2) / 3 + math.log10(2) - math.log10(1), abs=1e-11)
    assert got[21] == pytest.approx(0.8 * 5, abs=1e-11)


def test_recs_are_empty_when_nothing_qualifies(history, similar):
    got = {r.userId: [x.productId for x in r.recs] for r in realtime.realtime_recs(history, history, similar).collect()}
    assert got == {7: [21, 20], 8: []} or got == {7: [20, 21], 8: []}
    first = realtime.realtime_recs(history, history, similar).where("userId = 7").first().recs
    assert first[0].score >= first[1].score


def test_latest_event_of_a_user_counts(spark, history, similar):
    events = history.where("userId = 7")
    only = history.where("userId = 7 AND productId = 1")
    a = realtime.realtime_scores(events, history, similar).collect()
    assert a == realtime.realtime_scores(only, history, similar).collect()


def test_hot_event_products_are_split_without_change(spark, rows):
    similar = spark.createDataFrame([(1, r, 100 + r, 1 - r / 100) for r in range(1, 41)], schemas.SIMILARITY)
    events = [(u, 1 if u % 3 else 2, 4.0, u) for u in range(60)]
    rated = events + [(u, 100 + r, 1.0, 0) for u in range(60) for r in range(u % 7)]
    event_df, rated_df = (spark.createDataFrame(x, schemas.RATING) for x in (events, rated))
    whole = rows(realtime.candidates(event_df, rated_df, similar, 5))
    assert whole == rows(realtime.candidates(event_df, rated_df, similar, 5, spread=4))
    taken = lambda u: max(0, u % 7 - 1)
    assert whole == [(u, i + 1, 101 + taken(u) + i) for u in range(60) if u % 3 for i in range(5)]


def test_opened_parts_give_the_same_scores(history, similar):
    event = history.where("userId = 7 AND productId = 1")
    opened = lambda keys: similar.join(keys.distinct(), "productId", "left_semi")
    whole = realtime.realtime_scores(event, history, similar).collect()
    assert whole and whole == realtime.realtime_scores(event, history, opened).collect()


def test_cut_lists_with_pair_scores_give_the_same(spark, history, similar):
    event = history.where("userId = 7 AND productId = 1")
    depth = realtime.deepest_rank(history, 1)
    assert depth == 4
    whole = realtime.realtime_scores(event, history, similar, candidate_n=1).collect()
    scorer = lambda pairs: similar.join(pairs.distinct(), ["productId", "recProductId"])
    cut = realtime.realtime_scores(event, history, similar.where(f"rank <= {depth}"), candidate_n=1, pair_scores=scorer)
    assert whole and whole == cut.collect()
    assert realtime.deepest_rank(history.limit(0), 5) == 5


def test_lists_meet_by_user_without_a_shuffle_of_pairs(spark, rows):
    """Scores from the products' vectors equal those of given pairs; no table of pairs is written, and busy users take a join."""
    rng = random.Random(4)
    words = [f"w{n}" for n in range(9)]
    products = [(p, "n", "u", "c", "|".join(rng.choices(words, k=3))) for p in range(60)]
    rated = [(u, rng.randrange(60), float(rng.randint(1, 5)), rng.randrange(999)) for u in range(12) for _ in range(1 + 3 * u)]
    ratings = spark.createDataFrame(rated + [(None, 3, 2.0, 5), (3, None, 2.0, 5)], schemas.RATING)
    members, vectors = content.tag_vectors(spark.createDataFrame(products, schemas.PRODUCT))
    profiles, lists = content.tag_profiles(members, vectors), content.similar_lists(members, vectors)
    got = realtime.realtime_scores(ratings, ratings, lists, profiles=profiles)
    files = " ".join(got.inputFiles())
    assert "evidence" not in files and "tag-profiles" in files
    pairs = realtime.realtime_scores(ratings, ratings, lists, pair_scores=lambda met: content.pair_similarity(met, profiles))
    assert rows(got) == rows(pairs) == rows(realtime.realtime_scores(ratings, ratings, lists)) and rows(got)
    last = ratings.where("userId IS NOT NULL").dropDuplicates(["userId"])
    assert rows(realtime.candidates(last, ratings, lists, held=4)) == rows(realtime.candidates(last, ratings, lists))
