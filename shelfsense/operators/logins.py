"""Login monitoring: bursts in windows anchored at a login, and runs of consecutive logins."""

from __future__ import annotations

from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfsense.plans.joins import counted_join
from shelfsense.session import materialise

# Limits, spans and alert texts of the two monitors.
BURST_LIMIT = 3
BURST_SECONDS = 30
BURST_MESSAGE = "连续登录次数过多.限制登录5分钟后重试."
PATTERN_SECONDS = 20
PATTERN_REPEATS = (2, 3, 4)
PATTERN_MESSAGE = "登录次数过多....."
LOGIN = "login"

# Users with more distinct login times than this are cut along the time axis.
USER_BLOCK = 4096
CHUNK_MS = 3_600_000


def login_times(events: DataFrame, event_type: str | None = LOGIN) -> DataFrame:
    """(userId, ms, n): login times in whole milliseconds with their multiplicity."""
    logins = events if event_type is None else events.where(F.col("eventType") == event_type)
    return logins.groupBy("userId", F.unix_millis("ts").alias("ms")).agg(F.count(F.lit(1)).alias("n"))


def _fold_windows(times: DataFrame, span: int, limit: int) -> DataFrame:
    """Windows of users with few login times: one fold over the sorted times of a user."""
    state = "struct<start: bigint, n: bigint, closed: array<struct<start: bigint, n: bigint>>>"
    begin = F.struct(
        F.lit(None).cast("bigint").alias("start"),
        F.lit(0).cast("bigint").alias("n"),
        F.array().cast("array<struct<start:bigint,n:bigint>>").alias("closed"),
    ).cast(state)

    def closed(acc):
        window = F.array(F.struct(acc["start"].alias("start"), acc["n"].alias("n")))
        return F.when(acc["n"] >= limit, F.concat(acc["closed"], window)).otherwise(acc["closed"])

    def step(acc, t):
        inside = t["ms"] <= acc["start"] + span
        return F.when(
            inside, F.struct(acc["start"].alias("start"), (acc["n"] + t["n"]).alias("n"), acc["closed"].alias("closed"))
        ).otherwise(F.struct(t["ms"].alias("start"), t["n"].alias("n"), closed(acc).alias("closed")))

    lists = times.groupBy("userId").agg(F.array_sort(F.collect_list(F.struct("ms", "n"))).alias("times"))
    windows = lists.select("userId", F.explode(F.aggregate("times", begin, step, closed)).alias("w"))
    return windows.select("userId", F.col("w.start").alias("windowStart"), F.col("w.n").alias("loginNums"))


def _chunk_outcomes(span: int, chunk_ms: int):
    """Per time chunk: where the chain of windows leaves it, for every way it can be entered.

    A chunk is entered with a time ``c`` up to which logins are already counted; only values up to
    one span past its start differ. The outcome is a step function of ``c``, kept as its steps:
    from ``enter`` on, the chain leaves with ``leave`` (NULL: unchanged).
    """

    def outcomes(key: tuple[Any, ...], rows: pd.DataFrame) -> pd.DataFrame:
        user, chunk = key
        ms = np.sort(rows["ms"].to_numpy())
        following = np.searchsorted(ms, ms + span, side="right")
        reach = np.searchsorted(ms, chunk * chunk_ms - 1 + span, side="right")
        at = np.arange(min(reach, len(ms) - 1) + 1)
        while True:
            onward = following[at]
            if (onward == len(ms)).all():
                break
            at = np.where(onward < len(ms), np.minimum(onward, len(ms) - 1), at)
        leave = list(ms[at] + span)
        enter = [-(2**62), *ms[: len(leave) - 1]]
        if reach == len(ms):
            enter.append(ms[-1])
            leave.append(None)
        frame = pd.DataFrame({"enter": pd.array(enter, "Int64"), "leave": pd.array(leave, "Int64")})
        frame = frame[(frame["leave"] != frame["leave"].shift()).fillna(True)]
        return frame.assign(userId=user, chunk=chunk)[["userId", "chunk", "enter", "leave"]]

    return outcomes


def _chunk_entries(key: tuple[Any, ...], steps: pd.DataFrame) -> pd.DataFrame:
    """Follow one user's chunks in time order; the steps hold no logins, only chunk outcomes."""
    covered, out = -(2**62), []
    for chunk, part in steps.sort_values(["chunk", "enter"]).groupby("chunk", sort=True):
        out.append((key[0], chunk, covered))
        enter = part["enter"].to_numpy(dtype=np.int64)
        leave = part["leave"].iloc[np.searchsorted(enter, covered, side="right") - 1]
        covered = covered if pd.isna(leave) else int(leave)
    return pd.DataFrame(out, columns=["userId", "chunk", "covered"])


def _chunk_windows(span: int):
    """Assign the logins of one chunk to window starts, given what is already covered."""

    def assign(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("ms")
        ms, covered = rows["ms"].to_numpy(), int(rows["covered"].iloc[0])
        start = np.empty(len(ms), dtype=np.int64)
        at = np.searchsorted(ms, covered, side="right")
        start[:at] = covered - span
        while at < len(ms):
            end = np.searchsorted(ms, ms[at] + span, side="right")
            start[at:end] = ms[at]
            at = end
        return pd.DataFrame({"userId": rows["userId"], "windowStart": start, "n": rows["n"]})

    return assign


def _chunked_windows(times: DataFrame, span: int, limit: int, chunk_ms: int) -> DataFrame:
    """Windows of users with many login times, cut into time chunks that run in parallel.

    A chunk holds at most ``chunk_ms`` distinct times, whatever the number of logins.
    """
    chunk_ms = max(chunk_ms, 2 * span)
    rows = materialise(times.withColumn("chunk", F.floor(F.col("ms") / chunk_ms).cast("bigint")), "login-chunks")
    steps = rows.groupBy("userId", "chunk").applyInPandas(
        _chunk_outcomes(span, chunk_ms), "userId bigint, chunk bigint, enter bigint, leave bigint"
    )
    entries = steps.groupBy("userId").applyInPandas(_chunk_entries, "userId bigint, chunk bigint, covered bigint")
    parts = (
        rows.join(entries, ["userId", "chunk"])
        .groupBy("userId", "chunk")
        .applyInPandas(_chunk_windows(span), "userId bigint, windowStart bigint, n bigint")
    )
    return parts.groupBy("userId", "windowStart").agg(F.sum("n").alias("loginNums")).where(F.col("loginNums") >= limit)


def login_bursts(
    events: DataFrame,
    limit: int = BURST_LIMIT,
    seconds: int = BURST_SECONDS,
    event_type: str | None = LOGIN,
    block: int = USER_BLOCK,
    chunk_ms: int = CHUNK_MS,
) -> DataFrame:
    """Alerts for ``limit`` or more logins in a window: (userId, windowStart in ms, loginNums, msg).

    A window opens at a user's first login, covers ``seconds`` (end included) and is followed by the
    next one at the first login after it.
    """
    span = seconds * 1000
    times = materialise(login_times(events, event_type), "login-times")
    sizes = times.groupBy("userId").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    busy = materialise(sizes.select("userId"), "busy-users")
    if busy.isEmpty():
        found = _fold_windows(times, span, limit)
    else:
        few = _fold_windows(counted_join(times, busy, "userId", "left_anti"), span, limit)
        many = _chunked_windows(counted_join(times, busy, "userId", "left_semi"), span, limit, chunk_ms)
        found = few.unionByName(many)
    return found.withColumn("msg", F.lit(BURST_MESSAGE))


def login_patterns(
    events: DataFrame, seconds: int = PATTERN_SECONDS, repeats: tuple[int, ...] = PATTERN_REPEATS
) -> DataFrame:
    """Every run of logins: (userId, firstLogin in ms, loginNums, msg).

    A login whose very next event of the user is a login starts a run; the run has ``r + 1`` logins
    if its ``r``-th following login is less than ``seconds`` later. Looking ahead never goes further
    than that, so a user's events are ranked per stretch of time, each with a copy of the following
    stretch's beginning.
    """
    span = seconds * 1000
    stretch = 10 * span
    timed = events.select("userId", "eventType", F.unix_millis("ts").alias("ms"))
    bucket = F.floor(F.col("ms") / stretch).cast("bigint")
    ahead = F.when(F.pmod("ms", F.lit(stretch)) < span, F.array(bucket, bucket - 1)).otherwise(F.array(bucket))
    rows = timed.withColumn("_home", bucket).withColumn("_bucket", F.explode(ahead))
    by_time = Window.partitionBy("userId", "_bucket").orderBy("ms", "eventType")
    logins = rows.withColumn("_next", F.lead("eventType").over(by_time)).where(F.col("eventType") == LOGIN)
    reach = [F.lead("ms", r).over(by_time).alias(f"_after{r}") for r in repeats]
    runs = logins.select("userId", "ms", "_next", "_home", "_bucket", *reach).where(
        (F.col("_next") == LOGIN) & (F.col("_home") == F.col("_bucket"))
    )
    lengths = F.array_compact(F.array(*[F.when(F.col(f"_after{r}") - F.col("ms") < span, F.lit(r + 1)) for r in repeats]))
    return runs.select(
        "userId", F.col("ms").alias("firstLogin"), F.explode(lengths).alias("loginNums"), F.lit(PATTERN_MESSAGE).alias("msg")
    )
