"""Shop tables derived from the order, part, customer and event tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.session import configure


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _instant(col: str) -> Column:
    return F.col(col).cast("timestamp")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line is its customer's rating of the part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("userId"),
        F.col("l_partkey").cast("int").alias("productId"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("score"),
        F.unix_seconds(_instant("l_shipdate")).alias("timestamp"),
    )


def rating_arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ratings with the columns that give their order of arrival: (shipDate, orderKey, lineNumber)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").cast("int").alias("userId"),
        F.col("l_partkey").cast("int").alias("productId"),
        F.ceil(F.col("l_quantity") / 10).cast("double").alias("score"),
        F.unix_seconds(_instant("l_shipdate")).alias("timestamp"),
        _instant("l_shipdate").alias("shipDate"),
        F.col("l_orderkey").alias("orderKey"),
        F.col("l_linenumber").alias("lineNumber"),
    )


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    return parts.select(
        F.col("p_partkey").cast("int").alias("productId"),
        F.col("p_name").alias("name"),
        F.concat(F.lit("img/"), F.col("p_partkey").cast("string")).alias("imageUrl"),
        F.concat_ws("|", "p_type", "p_brand").alias("categories"),
        F.concat_ws("|", F.translate("p_name", " ", "|"), F.translate("p_type", " ", "|"), F.col("p_brand")).alias(
            "tags"
        ),
    )


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").cast("int").alias("userId"), F.col("c_name").alias("username")
    )


def _item() -> Column:
    return F.regexp_extract("props", '"k": *([0-9]+)', 1)


def page_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "view")
        .select(_item().cast("int").alias("itemId"), F.lit("pv").alias("eventType"), _instant("ts").alias("ts"))
    )


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of a user's events, clicks standing in for logins; times in whole milliseconds."""
    events = table(spark, sf_dir, "events")
    return events.select(
        F.col("user_id").cast("bigint").alias("userId"),
        F.when(F.col("event_type") == "click", F.lit("login")).otherwise(F.col("event_type")).alias("eventType"),
        F.timestamp_millis(F.unix_millis(_instant("ts"))).alias("ts"),
    )


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logger lines, one per event, including junk and malformed ones."""
    return timed_log_lines(spark, sf_dir).select("value")


def timed_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw logger lines with the second in which each is written: (value, sec)."""
    seconds = F.unix_seconds(_instant("ts")).cast("string")
    millis = F.unix_millis(_instant("ts")).cast("string")
    user, item = F.col("user_id").cast("string"), _item()
    score = (F.pmod("event_id", F.lit(5)) + 1).cast("string")
    kind, variant = F.col("event_type"), F.pmod("event_id", F.lit(6))
    login = F.concat(user, F.lit("|login|"), millis)
    rating = F.concat(user, F.lit("|"), item, F.lit("|"), score, F.lit(".0|"), seconds)
    line = (
        F.when(kind == "click", F.concat(F.lit("INFO web LOGIN_PREFIX:"), login))
        .when(kind == "view", F.concat(F.lit("INFO web PRODUCT_PV_PREFIX:"), item, F.lit("|pv|"), seconds))
        .when(kind == "purchase", F.concat(F.lit("INFO web PRODUCT_RATING_PREFIX:"), rating))
        .when(kind == "error", F.concat(F.lit("ERROR web request failed for "), user))
        .when(variant == 0, F.concat(F.lit("web PRODUCT_RATING_PREFIX:"), user, F.lit("|"), item, F.lit("|bad|"), seconds))
        .when(variant == 1, F.concat(F.lit("web PRODUCT_PV_PREFIX:"), item))
        .when(
            variant == 2,
            F.concat(F.lit("web LOGIN_PREFIX: \t"), user, F.lit(" | login |\t"), millis, F.lit(" ")),
        )
        .when(variant == 3, F.concat(F.lit("web LOGIN_PREFIX:"), login, F.lit(" PRODUCT_RATING_PREFIX:"), rating))
        .when(variant == 4, F.lit("web PRODUCT_RATING_PREFIX:"))
        .otherwise(F.concat(F.lit("web PRODUCT_RATING_PREFIX:"), rating, F.lit("||")))
    )
    return table(spark, sf_dir, "events").select(line.alias("value"), F.unix_seconds(_instant("ts")).alias("sec"))
