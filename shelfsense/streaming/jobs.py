"""The four stream jobs: cleansing, hot items, login monitors, realtime lists."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter

from shelfsense import schemas
from shelfsense.operators import hotitems, logins, logs, ratings, realtime
from shelfsense.sources.keyed import BATCH, KeyedTable, last_write, store_batch
from shelfsense.streaming.processors import BurstMonitor, PatternMonitor

TRIGGER = "2 seconds"

# Times arrive in ascending order; events at the very watermark count as late, equal times must not.
ASCENDING = "1 millisecond"


def cleanse(lines: DataFrame) -> DataFrame:
    """log stream -> routed (topic, body) stream."""
    return logs.clean_lines(lines)


def cleanse_ratings(lines: DataFrame) -> DataFrame:
    """log stream -> rating messages (key, body, eventTime) stamped on arrival."""
    return logs.stamp_ingestion(logs.clean_rating_lines(lines))


def hot_item_counts(
    views: DataFrame, size: str = "10 minutes", slide: str = "2 minutes", delay: str = "1 second"
) -> DataFrame:
    """Views per item of every closed sliding window: (windowEnd, itemId, nums).

    Two chained stateful operators: views are counted once per slide-long pane, and the pane counts, not the views, are copied to the
    windows that cover them and summed. The state of the first holds the open panes, that of the second one sum per open window and item.
    In append mode a window's rows all appear in the micro-batch in which the watermark passes its
    end; views behind the watermark are dropped. The window must be a whole number of slides.
    """
    if pd.Timedelta(size) % pd.Timedelta(slide):
        raise ValueError("the window must be a whole number of slides")
    panes = (
        views.withWatermark("ts", delay)
        .groupBy(F.window("ts", slide).alias("pane"), "itemId")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    counted = panes.groupBy(F.window("pane", size, slide).alias("window"), "itemId").agg(F.sum("n").alias("nums"))
    return counted.select(F.unix_seconds("window.end").alias("windowEnd"), "itemId", "nums")


def hot_items(counts: DataFrame, path: str, checkpoint: str, n: int = hotitems.TOP) -> DataStreamWriter:
    """Rank the windows closed in each micro-batch and store (windowEnd, rank, itemId, nums).

    Ranked as a batch, so a window of any number of items is cut to ``n`` before it is shuffled.
    """

    def rank(batch: DataFrame, batch_id: int) -> None:
        store_batch(hotitems.hot_items(batch, n), path, batch_id)

    return counts.writeStream.outputMode("append").foreachBatch(rank).option("checkpointLocation", checkpoint)


def _timed(events: DataFrame, delay: str) -> DataFrame:
    """What the monitors read: (userId, eventType, ms, ts)."""
    return events.withWatermark("ts", delay).select("userId", "eventType", F.unix_millis("ts").alias("ms"), "ts")


def login_bursts(
    events: DataFrame,
    limit: int = logins.BURST_LIMIT,
    seconds: int = logins.BURST_SECONDS,
    delay: str = ASCENDING,
    event_type: str | None = logins.LOGIN,
) -> DataFrame:
    """Burst alerts of a login stream: (userId, windowStart, loginNums, msg)."""
    rows = events if event_type is None else events.where(F.col("eventType") == event_type)
    monitor = BurstMonitor(limit, seconds * 1000, logins.BURST_MESSAGE)
    return (
        _timed(rows, delay)
        .groupBy("userId")
        .transformWithState(
            monitor, "userId bigint, windowStart bigint, loginNums bigint, msg string", "Append", "EventTime"
        )
    )


def login_patterns(
    events: DataFrame,
    seconds: int = logins.PATTERN_SECONDS,
    repeats: tuple[int, ...] = logins.PATTERN_REPEATS,
    delay: str = ASCENDING,
) -> DataFrame:
    """Runs of consecutive logins: (userId, firstLogin, loginNums, msg)."""
    monitor = PatternMonitor(seconds * 1000, tuple(repeats), logins.LOGIN, logins.PATTERN_MESSAGE)
    return (
        _timed(events, delay)
        .groupBy("userId")
        .transformWithState(
            monitor, "userId bigint, firstLogin bigint, loginNums int, msg string", "Append", "EventTime"
        )
    )


#: Micro-batches whose deltas pile up before a keyed table is folded.
FOLD_AFTER = 16


def _store(table: KeyedTable, rows: DataFrame, epoch: int, batch_id: int) -> None:
    table.put(rows, epoch, batch_id)
    if table.deltas() > FOLD_AFTER:
        table.compact()
        table.vacuum()


def rating_table(spark: SparkSession, path: str, buckets: int) -> KeyedTable:
    """Rating history by user: one row per (user, product), the last write sets the score and the first one the time."""
    return KeyedTable(spark, path, schemas.RATING, "userId", buckets, ratings.merge_versions)


def rating_log(spark: SparkSession, path: str, buckets: int) -> KeyedTable:
    """Rating history by user in which every rating is a row."""
    return KeyedTable(spark, path, schemas.RATING, "userId", buckets, lambda rows: rows)


def list_table(spark: SparkSession, path: str, buckets: int) -> KeyedTable:
    """One live list per user."""
    return KeyedTable(spark, path, schemas.STREAM_RECS, "userId", buckets, last_write(["userId"], ["recs"]))


def keep_ratings(rating_events: DataFrame, table: KeyedTable, checkpoint: str) -> DataStreamWriter:
    """Write every rating of a stream to the history."""
    epoch = table.claim(checkpoint)
    return rating_events.writeStream.foreachBatch(lambda rows, batch_id: _store(table, rows, epoch, batch_id)).option(
        "checkpointLocation", checkpoint
    )


def realtime_lists(
    rating_events: DataFrame,
    history: KeyedTable,
    similar: DataFrame | Callable[[DataFrame], DataFrame],
    lists: KeyedTable,
    checkpoint: str,
    **options,
) -> DataStreamWriter:
    """Write the ratings of a micro-batch to the history, then refresh and store the list of every user in it.

    ``similar`` is the similarity table, or a function that opens the part of it that holds the given products (see
    :func:`shelfsense.sources.buckets.read_buckets`). The history is read after the write, for the users of the batch alone, so what a user
    has just rated is known as rated. The batch joins both as a set. A replayed batch writes both deltas anew.
    """
    epochs = history.claim(checkpoint), lists.claim(checkpoint)

    def refresh(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            _store(history, rows, epochs[0], batch_id)
            known = history.read(rows)
            _store(lists, realtime.realtime_recs(rows, known, similar, **options), epochs[1], batch_id)
        finally:
            rows.unpersist()

    writer = rating_events.writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=TRIGGER)


def late_rows(rows: DataFrame, time: str, delay_seconds: float, table_path: str, checkpoint: str) -> DataStreamWriter:
    """Side output: rows that are behind the watermark when their micro-batch begins, stored with the watermark they missed.

    The watermark of a batch is the largest time of all earlier batches less the delay; each batch stores that one number for the next, and
    the first has none. These are the rows that an event-time operator with this delay may drop.
    """
    spark = rows.sparkSession
    passed = T.StructType([T.StructField("most", T.LongType())])
    micros = F.unix_micros(F.col(time))

    def split(batch: DataFrame, batch_id: int) -> None:
        seen = batch.persist()
        try:
            before = spark.read.schema(passed).parquet(f"{table_path}/marks/{BATCH}={batch_id - 1}").first()[0] if batch_id else None
            mark = None if before is None else before - int(delay_seconds * 1_000_000)
            behind = seen.where(micros < mark) if mark is not None else seen.limit(0)
            store_batch(behind.withColumn("watermark", F.lit(mark).cast("long")), f"{table_path}/late", batch_id)
            store_batch(seen.agg(F.greatest(F.max(micros), F.lit(before).cast("long")).alias("most")), f"{table_path}/marks", batch_id)
        finally:
            seen.unpersist()

    return rows.writeStream.foreachBatch(split).option("checkpointLocation", checkpoint)
