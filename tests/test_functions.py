from datetime import datetime

import pytest
from pyspark.sql import functions as F

from shelfsense.functions import scores, text


def java_hash(s: str) -> int:
    h = 0
    units = s.encode("utf-16-be")
    for i in range(0, len(units), 2):
        h = (h * 31 + units[i] * 256 + units[i + 1]) & 0xFFFFFFFF
    return h - 2**32 if h >= 2**31 else h


def test_string_hash(spark):
    names = ["abc", "", "Customer#000000001", "商品", "a😀b", "zzzzzzzzzzzzzzzz"]
    df = spark.createDataFrame([(n,) for n in names] + [(None,)], "s string")
    got = {r.s: r.h for r in df.select("s", text.string_hash32(F.col("s")).alias("h")).collect()}
    assert got == {**{n: java_hash(n) for n in names}, None: None}
    assert got["abc"] == 96354


def test_trim_and_fields(spark):
    df = spark.createDataFrame([("\t 1 |x\n| 2.5\r|",)], "s string")
    got = df.select(*[text.bar_field(F.col("s"), i) for i in range(5)]).first()
    assert tuple(got) == ("1", "x", "2.5", "", "")


def test_words(spark):
    df = spark.createDataFrame([("A|b c||",), ("",)], "s string")
    got = [r[0] for r in df.select(text.words(text.bars_to_spaces(F.col("s")))).collect()]
    assert got == [["a", "b", "c"], []]


@pytest.mark.parametrize("score,expected", [(10.0, 5.0), (7.0, 3.5), (0.0, 0.0), (0.33, 0.17), (0.01, 0.01)])
def test_half_star(spark, score, expected):
    assert spark.range(1).select(scores.half_star(F.lit(score))).first()[0] == expected


def test_log10(spark):
    got = spark.range(1).select(*[scores.log10_at_least_one(F.lit(n)) for n in (0, 1, 10, 100)]).first()
    assert tuple(got) == (0.0, 0.0, 1.0, 2.0)


def test_year_month_and_sql_name(spark):
    scores.register_sql_functions(spark)
    edge = int(datetime(2016, 2, 29, 23, 59, 59).timestamp())
    df = spark.createDataFrame([(1395676800,), (edge,), (0,)], "t bigint")
    got = df.select(scores.year_month(F.col("t")), F.expr("changeDate(t)")).collect()
    assert [tuple(r) for r in got] == [(201403, 201403), (201602, 201602), (197001, 197001)]


def test_cooccurrence_similarity_large_counts(spark):
    big = 4_000_000_000
    got = spark.range(1).select(scores.cooccurrence_similarity(F.lit(big), F.lit(big), F.lit(big))).first()[0]
    assert got == 1.0
