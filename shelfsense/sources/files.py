"""File scans and table sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.functions.text import trim_all
from shelfsense.operators.logs import valid_score, valid_time
from shelfsense.schemas import conform

# Delimiters and field positions of the two input file formats.
PRODUCT_SEPARATOR = "^"
PRODUCT_FIELDS = ["productId", "name", "categoryIds", "externalId", "imageUrl", "categories", "tags"]
RATING_SEPARATOR = ","
RATING_FIELDS = ["userId", "productId", "score", "timestamp"]


#: The line as it stands in the file.
LINE = "line"


def _delimited(spark: SparkSession, path: str, names: list[str], sep: str) -> DataFrame:
    """(line, one column per name): trimmed fields, null where empty or missing; fields beyond the names and blank lines are left out."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.col("value").alias(LINE), F.split("value", f"\\{sep}", -1).alias("_fields"))
    field = [F.get("_fields", F.lit(i)) for i in range(len(names))]
    return lines.select(LINE, *(F.when(f != "", trim_all(f)).alias(n) for f, n in zip(field, names, strict=True)))


def _product_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = _delimited(spark, path, PRODUCT_FIELDS, PRODUCT_SEPARATOR)
    return raw.withColumn("_id", F.expr("try_cast(productId AS INT)"))


def read_products(spark: SparkSession, path: str) -> DataFrame:
    """Product file: seven ``^``-separated fields, five kept, no quoting; lines without an id are in :func:`bad_products`."""
    rows = _product_rows(spark, path).where("_id IS NOT NULL")
    return rows.select(F.col("_id").alias("productId"), "name", "imageUrl", "categories", "tags")


def bad_products(spark: SparkSession, path: str) -> DataFrame:
    """The lines that :func:`read_products` leaves out, as they stand, and their fields as text."""
    return _product_rows(spark, path).where("_id IS NULL").drop("_id")


def _rating_rows(spark: SparkSession, path: str) -> DataFrame:
    raw = _delimited(spark, path, RATING_FIELDS, RATING_SEPARATOR)
    parsed = F.struct(
        F.expr("try_cast(userId AS INT)").alias("userId"),
        F.expr("try_cast(productId AS INT)").alias("productId"),
        valid_score(F.col("score")).alias("score"),
        valid_time(F.col("timestamp"), "seconds").alias("timestamp"),
    )
    whole = F.lit(True)
    for name in ("userId", "productId", "score", "timestamp"):
        whole = whole & F.col(f"_parsed.{name}").isNotNull()
    return raw.withColumn("_parsed", parsed).withColumn("_whole", whole)


def read_ratings(spark: SparkSession, path: str) -> DataFrame:
    """Rating file: user, product, score, epoch seconds; lines that do not parse, by the rule of the log parsers, are in :func:`bad_ratings`."""
    return _rating_rows(spark, path).where("_whole").select("_parsed.*")


def bad_ratings(spark: SparkSession, path: str) -> DataFrame:
    """The lines that :func:`read_ratings` leaves out, as they stand, and their fields as text."""
    return _rating_rows(spark, path).where("NOT _whole").drop("_parsed", "_whole")


def read_table(
    spark: SparkSession,
    location: str,
    schema: T.StructType | None = None,
    fmt: str = "parquet",
    options: dict[str, str] | None = None,
) -> DataFrame:
    """Table scan by location (a path, or a collection named in ``options`` for other formats)."""
    reader = spark.read.format(fmt).options(**(options or {}))
    df = reader.load(location) if location else reader.load()
    return conform(df, schema) if schema else df


def write_table(
    df: DataFrame, location: str, fmt: str = "parquet", options: dict[str, str] | None = None
) -> None:
    """Replace the table's whole content."""
    writer = df.write.mode("overwrite").format(fmt).options(**(options or {}))
    writer.save(location) if location else writer.save()


def write_by_topic(df: DataFrame, location: str, fmt: str = "parquet") -> None:
    """Route rows by their ``topic`` column: one partition folder per topic."""
    df.write.mode("overwrite").format(fmt).partitionBy("topic").save(location)
