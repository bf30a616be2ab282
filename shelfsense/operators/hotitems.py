"""Hot items: page views counted over sliding windows, with a ranking per window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfsense.functions.text import window_report
from shelfsense.plans.ranking import top_k

WINDOW_SECONDS = 600
SLIDE_SECONDS = 120
TOP = 3


def window_counts(views: DataFrame, size: int = WINDOW_SECONDS, slide: int = SLIDE_SECONDS) -> DataFrame:
    """Views per item and sliding window: (windowEnd in epoch seconds, itemId, nums).

    Views are counted once per slide-long pane; the few pane counts, not the views, are then
    copied to the windows that cover them.
    """
    if size % slide:
        raise ValueError("the window must be a whole number of slides")
    pane = (F.floor(F.unix_seconds("ts") / slide) * slide).cast("bigint")
    panes = views.groupBy("itemId", pane.alias("pane")).agg(F.count(F.lit(1)).alias("n"))
    ends = F.explode(F.sequence(F.col("pane") + slide, F.col("pane") + size, F.lit(slide).cast("bigint")))
    return panes.select("itemId", ends.alias("windowEnd"), "n").groupBy("windowEnd", "itemId").agg(F.sum("n").alias("nums"))


def hot_items(counts: DataFrame, n: int = TOP) -> DataFrame:
    """The ``n`` most viewed items per window: (windowEnd, rank, itemId, nums)."""
    return top_k(counts, ["windowEnd"], [F.desc("nums"), F.asc("itemId")], n).select("windowEnd", "rank", "itemId", "nums")


def hot_item_report(top: DataFrame) -> DataFrame:
    """One text per window end: its time, then a numbered line per item."""
    rows = top.groupBy("windowEnd").agg(F.sort_array(F.collect_list(F.struct("rank", "itemId", "nums"))).alias("top"))
    return rows.select("windowEnd", window_report(F.col("windowEnd"), F.col("top")).alias("report"))
