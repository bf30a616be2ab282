"""Cleansing, routing and parsing of raw log lines; the same code for batch and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.text import bar_field, trim_all

# Line prefixes and the topics they lead to, in order of precedence.
ROUTES = [
    ("LOGIN_PREFIX:", "recommender_login"),
    ("PRODUCT_RATING_PREFIX:", "recommender_rating"),
    ("PRODUCT_PV_PREFIX:", "recommender_pv"),
]
LOGIN_TOPIC, RATING_TOPIC, PV_TOPIC = [topic for _, topic in ROUTES]
RATING_KEY = "logProcessor"


def _by_route(line: Column, pick: int) -> Column:
    return F.coalesce(*[F.when(line.contains(route[0]), F.lit(route[pick])) for route in ROUTES])


def classify(lines: DataFrame, value: str = "value") -> DataFrame:
    """(topic, body, value): body is what follows the prefix up to its next occurrence, trimmed.

    A prefix with nothing behind it gives an empty body; a line without any prefix gives NULL topic.
    """
    line = F.col(value)
    body = F.split_part(line, _by_route(line, 0), F.lit(2))
    return lines.select(_by_route(line, 1).alias("topic"), trim_all(body).alias("body"), line.alias("value"))


def clean_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Routed lines only: (topic, body)."""
    return classify(lines, value).where("topic IS NOT NULL").select("topic", "body")


def clean_rating_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Rating-only cleansing with a constant output key: (key, body).

    Looks for the rating prefix alone, whatever other prefix the line holds.
    """
    prefix = ROUTES[1][0]
    line = F.col(value)
    body = F.split_part(line, F.lit(prefix), F.lit(2))
    return lines.where(line.contains(prefix)).select(F.lit(RATING_KEY).alias("key"), trim_all(body).alias("body"))


#: Largest epoch values a timestamp can hold, in the unit of the log.
_LONGEST = {"seconds": 2**63 // 10**6, "millis": 2**63 // 10**3 - 1}


def valid_time(raw: Column, unit: str) -> Column:
    """Epoch time written as text, NULL where it does not parse or is no timestamp."""
    time = raw.try_cast("bigint")
    return F.when(time.between(-_LONGEST[unit], _LONGEST[unit]), time)


def valid_score(raw: Column) -> Column:
    """Score written as text, NULL where it does not parse or is not finite."""
    score = raw.try_cast("double")
    return F.when(~F.isnan(score) & (F.abs(score) < float("inf")), score)


def _field(raw: Column, kind: str) -> Column:
    """The field as its kind, NULL where it is not valid: numbers that parse, times in range, finite scores, filled names."""
    if kind in _LONGEST:
        return valid_time(raw, kind)
    if kind == "score":
        return valid_score(raw)
    if kind == "name":
        return F.when(raw != "", raw)
    return raw.try_cast(kind)


def _parsed(rows: DataFrame, body: str, fields: list[tuple[str, int, str]]) -> DataFrame:
    """All columns of ``rows`` plus one column per (name, position, type), NULL where it does not parse.

    The raw fields leave a generator of one row, below which no condition on them is moved, so the body and each field are cut and trimmed once.
    """
    cut = F.inline(F.array(F.struct(*[bar_field(F.col(body), i).alias(name) for name, i, _ in fields])))
    return rows.select("*", cut).select(*rows.columns, *[_field(F.col(name), kind).alias(name) for name, _, kind in fields])


_RATING_FIELDS = [("userId", 0, "int"), ("productId", 1, "int"), ("score", 2, "score"), ("timestamp", 3, "seconds")]
_LOGIN_FIELDS = [("userId", 0, "bigint"), ("eventType", 1, "name"), ("_time", 2, "millis")]
_VIEW_FIELDS = [("itemId", 0, "int"), ("eventType", 1, "name"), ("_time", 2, "seconds")]


def _complete(fields) -> Column:
    ok = F.lit(True)
    for name, _, _ in fields:
        ok = ok & F.col(name).isNotNull()
    return ok


def parse_ratings(rows: DataFrame, body: str = "body") -> DataFrame:
    good = _parsed(rows.select(body), body, _RATING_FIELDS).where(_complete(_RATING_FIELDS))
    return good.select("userId", "productId", "score", "timestamp")


def parse_logins(rows: DataFrame, body: str = "body") -> DataFrame:
    """Login times are epoch milliseconds."""
    good = _parsed(rows.select(body), body, _LOGIN_FIELDS).where(_complete(_LOGIN_FIELDS))
    return good.select("userId", "eventType", F.timestamp_millis("_time").alias("ts"))


def parse_page_views(rows: DataFrame, body: str = "body") -> DataFrame:
    """Page-view times are epoch seconds."""
    good = _parsed(rows.select(body), body, _VIEW_FIELDS).where(_complete(_VIEW_FIELDS))
    return good.select("itemId", "eventType", F.timestamp_seconds("_time").alias("ts"))


def quarantine(lines: DataFrame, value: str = "value") -> DataFrame:
    """Routed lines whose body does not parse: (topic, body, value)."""
    routed = classify(lines, value).where("topic IS NOT NULL")
    parses = F.lit(False)
    for topic, fields in ((LOGIN_TOPIC, _LOGIN_FIELDS), (RATING_TOPIC, _RATING_FIELDS), (PV_TOPIC, _VIEW_FIELDS)):
        good = F.lit(True)
        for _, i, kind in fields:
            good = good & _field(bar_field(F.col("body"), i), kind).isNotNull()
        parses = F.when(F.col("topic") == topic, good).otherwise(parses)  # a body meets the rule of its topic alone
    return routed.where(~parses)


def topic_rows(cleaned: DataFrame, topic: str) -> DataFrame:
    return cleaned.where(F.col("topic") == topic)


def stamp_ingestion(rows: DataFrame, column: str = "eventTime") -> DataFrame:
    """Arrival time in whole seconds as the event time."""
    return rows.withColumn(column, F.date_trunc("second", F.current_timestamp()))
