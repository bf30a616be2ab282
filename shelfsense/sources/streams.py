"""Stream sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

LINE = T.StructType([T.StructField("value", T.StringType())])


def read_lines(
    spark: SparkSession, location: str, fmt: str = "text", options: dict[str, str] | None = None
) -> DataFrame:
    """Line stream as (value). Files by default; ``kafka`` subscribes to ``location`` from the latest offset."""
    reader = spark.readStream.format(fmt)
    if fmt == "kafka":
        defaults = {"subscribe": location, "startingOffsets": "latest"}
        return reader.options(**{**defaults, **(options or {})}).load().select(F.col("value").cast("string").alias("value"))
    return reader.schema(LINE).options(**(options or {})).load(location).select("value")


def to_console(df: DataFrame, mode: str = "append") -> DataStreamWriter:
    """Print alerts or rankings as they come."""
    return df.writeStream.format("console").outputMode(mode).option("truncate", "false")


def to_files(df: DataFrame, path: str, checkpoint: str, fmt: str = "parquet", by_topic: bool = False) -> DataStreamWriter:
    """Append to a file table, one folder per topic if asked for."""
    writer = df.writeStream.format(fmt).outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return writer.partitionBy("topic") if by_topic else writer


def to_topics(df: DataFrame, checkpoint: str, options: dict[str, str]) -> DataStreamWriter:
    """Kafka sink: the ``topic`` column routes each row, ``body`` is the message."""
    rows = df.select("topic", F.col("body").alias("value"))
    return rows.writeStream.format("kafka").options(**options).option("checkpointLocation", checkpoint)
