import pytest

from shelfsense import schemas
from shelfsense.operators import ratings, serving, statistics
from shelfsense.plans.ranking import nest_ranked, unnest_ranked

RATINGS = [(1, 10, 5.0, 100), (1, 11, 2.0, 200), (1, 10, 3.0, 300), (2, 10, 4.0, 50), (2, 12, 1.0, 50)]


@pytest.fixture()
def frame(spark):
    return spark.createDataFrame(RATINGS, schemas.RATING)


def test_statistics_order(spark, frame):
    assert [tuple(r) for r in statistics.rate_more_products(frame).collect()] == [(10, 3), (11, 1), (12, 1)]
    assert [tuple(r) for r in statistics.average_products(frame).collect()] == [(10, 4.0), (11, 2.0), (12, 1.0)]
    dated = spark.createDataFrame([(1, 9, 1.0, 1395676800), (1, 8, 1.0, 0), (2, 9, 1.0, 1395676801)], schemas.RATING)
    assert [tuple(r) for r in statistics.rate_more_recently(dated).collect()] == [(9, 2, 201403), (8, 1, 197001)]
    hot = statistics.hot_products(statistics.monthly_rating_counts(dated), 1)
    assert [r.productId for r in hot.collect()] == [9]


def test_recent_list(frame, rows):
    got = rows(ratings.recent_ratings(frame, 2).select("userId", "rank", "productId", "score"))
    assert got == [(1, 1, 10, 3.0), (1, 2, 11, 2.0), (2, 1, 10, 4.0), (2, 2, 12, 1.0)]


def test_recent_list_keeps_20_not_21(spark):
    many = spark.createDataFrame([(1, p, 1.0, p) for p in range(50)], schemas.RATING)
    got = ratings.recent_ratings(many)
    assert sorted(r.productId for r in got.collect()) == list(range(30, 50))


def test_latest_rating_agrees_with_recent_list(frame, rows):
    first = ratings.recent_ratings(frame, 1).select("userId", "productId", "score", "timestamp")
    assert rows(ratings.latest_rating(frame)) == rows(first)


def test_upsert_keeps_first_time(spark, frame, rows):
    new = spark.createDataFrame([(2, 12, 5.0, 900), (3, 10, 2.0, 901)], schemas.RATING)
    got = rows(ratings.merge_ratings(frame, new))
    assert got == [(1, 10, 3.0, 100), (1, 11, 2.0, 200), (2, 10, 4.0, 50), (2, 12, 5.0, 50), (3, 10, 2.0, 901)]


def test_upsert_takes_the_last_write_whatever_its_clock(spark, rows):
    old = spark.createDataFrame([(1, 1, 5.0, 100), (2, 1, 5.0, 200)], schemas.RATING)
    new = spark.createDataFrame([(1, 1, 2.0, 100), (2, 1, 1.0, 150)], schemas.RATING)
    assert rows(ratings.merge_ratings(old, new)) == [(1, 1, 2.0, 100), (2, 1, 1.0, 200)]


def test_upsert_orders_one_table_by_arrival(spark, rows):
    kind = "userId int, productId int, score double, timestamp long, seq int"
    old = spark.createDataFrame([(1, 1, 5.0, 100, 1), (1, 1, 3.0, 100, 2)], kind)
    assert rows(ratings.merge_ratings(old, arrival=("seq",))) == [(1, 1, 3.0, 100)]
    again = ratings.merge_ratings(ratings.merge_ratings(old, arrival=("seq",)), old.limit(1), arrival=("seq",))
    assert rows(again) == [(1, 1, 5.0, 100)]


@pytest.fixture()
def products(spark):
    return spark.createDataFrame(
        [(10, "Red ring", "u", "c", "t"), (11, "red bolt", "u", "c", "t"), (13, "ring", "u", "c", "t")], schemas.PRODUCT
    )


def test_detail_defaults_to_zero(spark, frame, products):
    means = statistics.mean_scores(frame)
    asked = spark.createDataFrame([(10,), (13,), (99,), (10,)], "productId int")
    got = {r.productId: r.score for r in serving.product_detail(asked, products, means).collect()}
    assert got == {10: 4.0, 13: 0.0}


def test_search_is_case_sensitive_and_unanchored(frame, products):
    means = statistics.mean_scores(frame)
    assert {r.productId for r in serving.search_products(products, "ring", means).collect()} == {10, 13}
    assert {r.productId for r in serving.search_products(products, "^red", means).collect()} == {11}


def test_serving_keeps_rank_and_skips_unknown(spark, frame, products):
    recs = spark.createDataFrame(
        [(10, 1, 13, 0.9), (10, 2, 77, 0.8), (10, 3, 11, 0.7), (11, 1, 10, 0.9)], schemas.SIMILARITY
    )
    means = statistics.mean_scores(frame)
    asked = spark.createDataFrame([(10,), (404,)], "productId int")
    got = serving.serve_for_products(asked, recs, products, means)
    assert sorted((r.productId, r["rank"], r.recProductId, r.meanScore) for r in got.collect()) == [
        (10, 1, 13, 0.0),
        (10, 3, 11, 2.0),
    ]
    assert serving.serve_for_products(asked, recs, products, means, limit=2).count() == 1


def test_users_by_name(spark):
    got = serving.users_by_name(spark.createDataFrame([("abc",)], "username string")).first()
    assert got.userId == 96354


def test_nesting_round_trip(spark, rows):
    long = spark.createDataFrame([(1, 1, 5, 0.9), (1, 2, 4, 0.8), (2, 1, 1, 0.1)], schemas.SIMILARITY)
    nested = nest_ranked(long, "productId", "recProductId", "score")
    assert nested.schema["recommendations"].dataType.elementType.names == ["productId", "score"]
    assert rows(unnest_ranked(nested, "productId")) == rows(long)
