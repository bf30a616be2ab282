import pytest

from shelfsense.operators import logs
from shelfsense.plans import catalogue

LINES = {
    "xx LOGIN_PREFIX:96354|login|1590909556000": ("recommender_login", "96354|login|1590909556000"),
    "PRODUCT_PV_PREFIX:102383|pv|1590909302": ("recommender_pv", "102383|pv|1590909302"),
    "i PRODUCT_RATING_PREFIX:96354|102383|5.0|1590909303": ("recommender_rating", "96354|102383|5.0|1590909303"),
    # Two prefixes: login wins wherever it stands.
    "PRODUCT_PV_PREFIX:1|pv|2 LOGIN_PREFIX:3|login|4": ("recommender_login", "3|login|4"),
    # The same prefix twice: the part between is the body.
    "a PRODUCT_PV_PREFIX: 1|pv|2 PRODUCT_PV_PREFIX:3|pv|4": ("recommender_pv", "1|pv|2"),
    "PRODUCT_RATING_PREFIX:": ("recommender_rating", ""),
    "PRODUCT_RATING_PREFIX:x|2|3.0|4": ("recommender_rating", "x|2|3.0|4"),
    "PRODUCT_RATING_PREFIX:1|2|3.0": ("recommender_rating", "1|2|3.0"),
    "PRODUCT_RATING_PREFIX:\t1 | 2|\t3.5 |4||": ("recommender_rating", "1 | 2|\t3.5 |4||"),
    "LOGIN_PREFIX:99999999999|login|1590909556123": ("recommender_login", "99999999999|login|1590909556123"),
    "nothing here": None,
    "": None,
}


@pytest.fixture()
def lines(spark):
    return spark.createDataFrame([(v,) for v in LINES], "value string")


def test_routes(lines):
    got = {r.value: (r.topic, r.body) for r in logs.classify(lines).where("topic IS NOT NULL").collect()}
    assert got == {k: v for k, v in LINES.items() if v}
    assert logs.clean_lines(lines).count() == len(got)


def test_parsers(lines):
    clean = logs.clean_lines(lines)
    ratings = logs.parse_ratings(logs.topic_rows(clean, logs.RATING_TOPIC))
    assert sorted(tuple(r) for r in ratings.collect()) == [(1, 2, 3.5, 4), (96354, 102383, 5.0, 1590909303)]
    logins = logs.parse_logins(logs.topic_rows(clean, logs.LOGIN_TOPIC)).selectExpr("userId", "eventType", "unix_millis(ts)")
    assert sorted(tuple(r) for r in logins.collect()) == [
        (3, "login", 4),
        (96354, "login", 1590909556000),
        (99999999999, "login", 1590909556123),
    ]
    views = logs.parse_page_views(logs.topic_rows(clean, logs.PV_TOPIC)).selectExpr("itemId", "unix_seconds(ts)")
    assert sorted(tuple(r) for r in views.collect()) == [(1, 2), (102383, 1590909302)]


def test_quarantine_is_the_rest(lines):
    bad = {r.value for r in logs.quarantine(lines).collect()}
    assert bad == {"PRODUCT_RATING_PREFIX:", "PRODUCT_RATING_PREFIX:x|2|3.0|4", "PRODUCT_RATING_PREFIX:1|2|3.0"}


def test_rating_messages_ignore_other_prefixes(spark):
    df = spark.createDataFrame([("LOGIN_PREFIX:1 PRODUCT_RATING_PREFIX: 1|2|3|4 ",), ("LOGIN_PREFIX:1",)], "value string")
    assert [tuple(r) for r in logs.clean_rating_lines(df).collect()] == [("logProcessor", "1|2|3|4")]


def test_ingestion_stamp_has_no_fraction(lines):
    row = logs.stamp_ingestion(lines).first()
    assert row.eventTime.microsecond == 0


def test_out_of_range_times_and_odd_scores_are_quarantined(spark):
    bad = [
        "PRODUCT_PV_PREFIX:1|pv|99999999999999999",
        "LOGIN_PREFIX:1|login|9223372036854775807",
        "LOGIN_PREFIX:1||1590909302000",
        "PRODUCT_RATING_PREFIX:1|2|NaN|100",
        "PRODUCT_RATING_PREFIX:1|2|Infinity|100",
    ]
    good = ["PRODUCT_PV_PREFIX:1|pv|9223372036854", "LOGIN_PREFIX:1|login|9223372036854774", "PRODUCT_RATING_PREFIX:1|2|3.5|100"]
    lines = spark.createDataFrame([(x,) for x in bad + good], "value string")
    assert sorted(r.value for r in logs.quarantine(lines).collect()) == sorted(bad)
    cleaned = logs.clean_lines(lines)
    assert logs.parse_page_views(logs.topic_rows(cleaned, logs.PV_TOPIC)).count() == 1
    assert logs.parse_logins(logs.topic_rows(cleaned, logs.LOGIN_TOPIC)).count() == 1
    assert logs.parse_ratings(logs.topic_rows(cleaned, logs.RATING_TOPIC)).count() == 1


def test_a_line_is_cut_and_trimmed_once(spark):
    """Conditions on parsed fields stay above the parsing: the plan trims the body and each field a single time."""
    lines = spark.createDataFrame([("PRODUCT_RATING_PREFIX: 1 | 2|4.0|\t9 ",), ("PRODUCT_RATING_PREFIX:1|2|x|9",)], "value string")
    parsed = logs.parse_ratings(logs.topic_rows(logs.clean_lines(lines.repartition(2)), logs.RATING_TOPIC))
    plan = parsed.where("score > 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("trim(") == 5
    assert [tuple(r) for r in parsed.collect()] == [(1, 2, 4.0, 9)]


def test_lines_of_a_stream_are_stored_compressed(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(catalogue, "new_path", lambda spark, name: f"{tmp_path}/{name}")
    lines = spark.createDataFrame([("a|b",), ("",), ("é",)], "value string")
    assert catalogue._line_stream(lines).isStreaming
    parts = list((tmp_path / "lines").glob("part-*"))
    assert parts and all(p.name.endswith(".gz") for p in parts)
    assert sorted(r.value for r in spark.read.text(f"{tmp_path}/lines").collect()) == ["", "a|b", "é"]
