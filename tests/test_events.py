"""Hot items and login monitors, batch and stream."""

import os
import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import Row

from shelfsense.operators import hotitems, logins, logs
from shelfsense.schemas import HOT_ITEMS
from shelfsense.sources.keyed import read_all
from shelfsense.sources.streams import read_lines, to_console, to_files
from shelfsense.streaming import jobs
from shelfsense.streaming.processors import PatternMonitor

T0 = 1_600_000_000
BURST = {1: [0, 5, 29, 31, 60], 2: [0, 10], 3: [0, 10, 30]}
FAR = 4_102_444_800


def at(seconds):
    return datetime.fromtimestamp(T0 + seconds, timezone.utc)


def events(spark, rows):
    return spark.createDataFrame([(u, k, at(s)) for u, k, s in rows], "userId bigint, eventType string, ts timestamp")


def brute_bursts(times, span, limit):
    out, times = [], sorted(times)
    while times:
        inside = [t for t in times if t <= times[0] + span]
        if len(inside) >= limit:
            out.append((times[0], len(inside)))
        times = times[len(inside) :]
    return out


def test_burst_windows(spark):
    df = events(spark, [(u, "login", s) for u, ts in BURST.items() for s in ts] + [(2, "view", 11)])
    got = sorted((r.userId, r.windowStart // 1000 - T0, r.loginNums) for r in logins.login_bursts(df).collect())
    assert got == [(1, 0, 3), (3, 0, 3)]
    assert logins.login_bursts(df, event_type=None).count() == 3


@pytest.mark.parametrize("block", [10_000, 20, 1])
def test_burst_chain_cut_along_time(spark, block):
    """Users beyond ``block`` login times run chunk by chunk; the windows must not notice."""
    rng = random.Random(11)
    data = {1: [rng.randrange(40_000) for _ in range(900)], 2: [rng.randrange(400_000) for _ in range(60)], 3: [5, 5, 5]}
    data[4] = list(range(0, 6000, 7))  # evenly spaced: chains from different starts never meet
    df = events(spark, [(u, "login", s) for u, ts in data.items() for s in ts])
    got = sorted(
        (r.userId, r.windowStart // 1000 - T0, r.loginNums)
        for r in logins.login_bursts(df, block=block, chunk_ms=100_000).collect()
    )
    assert got == sorted((u, s, n) for u, ts in data.items() for s, n in brute_bursts(ts, 30, 3))


PATTERN = [(1, "login", s) for s in (0, 5, 10, 15, 19)] + [
    (2, "login", 0), (2, "view", 1), (2, "login", 2), (2, "login", 3), (2, "login", 4),
    (3, "login", 0), (3, "login", 1), (3, "view", 2), (3, "login", 3),
    (4, "login", 0), (4, "login", 10), (4, "login", 20),
]
RUNS = [(1, 0, 3), (1, 0, 4), (1, 0, 5), (1, 5, 3), (1, 5, 4), (1, 10, 3), (2, 2, 3), (3, 0, 3)]


def test_login_runs(spark):
    got = sorted((r.userId, r.firstLogin // 1000 - T0, r.loginNums) for r in logins.login_patterns(events(spark, PATTERN)).collect())
    assert got == RUNS


def test_login_runs_across_stretches(spark):
    """Runs that straddle the boundary of a time stretch are found once."""
    shifted = [(u, k, s + d * 1000 + 193 - T0 % 200) for d in range(3) for u, k, s in PATTERN]
    got = sorted((r.userId, r.loginNums) for r in logins.login_patterns(events(spark, shifted)).collect())
    assert got == sorted([(u, n) for u, _, n in RUNS] * 3)


def views(spark, rows):
    return spark.createDataFrame([(i, "pv", at(s)) for i, s in rows], "itemId int, eventType string, ts timestamp")


def brute_hot(rows, size, slide, n):
    counts = {}
    for i, s in rows:
        pane = (T0 + s) // slide * slide
        for end in range(pane + slide, pane + size + 1, slide):
            counts.setdefault(end, {}).setdefault(i, 0)
            counts[end][i] += 1
    return sorted(
        (end, r + 1, i, c)
        for end, items in counts.items()
        for r, (i, c) in enumerate(sorted(items.items(), key=lambda x: (-x[1], x[0]))[:n])
    )


ROTATION = [(k % 7, 3 * k) for k in range(400)]


def test_hot_items_and_report(spark, rows):
    top = hotitems.hot_items(hotitems.window_counts(views(spark, ROTATION)))
    assert rows(top) == brute_hot(ROTATION, 600, 120, 3)
    report = hotitems.hot_item_report(top).orderBy("windowEnd").first().report.split("\n")
    assert report[0].startswith("时间:2020-09-13 ") and report[1].startswith("No1: 商品ID=") and len(report) == 5
    with pytest.raises(ValueError):
        hotitems.window_counts(views(spark, ROTATION), 100, 30)


def feed(spark, tmp_path, schema, parts, start):
    """One file per part, in order; every part is its own run, so state is recovered in between."""
    source = tmp_path / "in"
    source.mkdir()
    for n, lines in enumerate(parts):
        (source / f"{n:03d}.json").write_text("\n".join(lines))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
        start(stream).trigger(availableNow=True).start().awaitTermination()


def run_stream(spark, tmp_path, schema, parts, build, columns):
    sink, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    feed(spark, tmp_path, schema, parts, lambda stream: to_files(build(stream), sink, progress))
    return sorted(tuple(r) for r in spark.read.parquet(sink).select(*columns).collect())


def run_hot_items(spark, tmp_path, parts):
    sink, progress = str(tmp_path / "out"), str(tmp_path / "progress")
    start = lambda stream: jobs.hot_items(jobs.hot_item_counts(stream), sink, progress)
    feed(spark, tmp_path, "itemId int, ts timestamp", parts, start)
    return sorted(tuple(r) for r in read_all(spark, sink, HOT_ITEMS).collect())


def iso(seconds):
    return datetime.fromtimestamp(seconds, timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def test_stream_hot_items_equals_batch(spark, tmp_path):
    lines = [f'{{"itemId":{i},"ts":"{iso(T0 + s)}"}}' for i, s in ROTATION]
    parts = [lines[:150], lines[150:], [f'{{"itemId":0,"ts":"{iso(FAR)}"}}']]
    assert run_hot_items(spark, tmp_path, parts) == brute_hot(ROTATION, 600, 120, 3)


def _login_parts(rows):
    rows = sorted(rows, key=lambda r: r[2])
    line = lambda u, k, t: f'{{"userId":{u},"eventType":"{k}","ts":"{iso(t)}"}}'
    lines = [line(u, k, T0 + s) for u, k, s in rows]
    half = len(lines) // 2
    first = lines[:half]
    random.Random(2).shuffle(first)  # order inside a batch is free
    return [first, lines[half:], [line(-1, "login", FAR)]]


LOGIN_SCHEMA = "userId bigint, eventType string, ts timestamp"


def test_stream_bursts_equal_batch(spark, tmp_path):
    rows = [(u, "login", s) for u, ts in BURST.items() for s in ts]
    got = run_stream(spark, tmp_path, LOGIN_SCHEMA, _login_parts(rows), jobs.login_bursts, ["userId", "windowStart", "loginNums"])
    assert got == [(1, T0 * 1000, 3), (3, T0 * 1000, 3)]


def test_stream_patterns_equal_batch(spark, tmp_path):
    got = run_stream(spark, tmp_path, LOGIN_SCHEMA, _login_parts(PATTERN), jobs.login_patterns, ["userId", "firstLogin", "loginNums"])
    assert [(u, t // 1000 - T0, n) for u, t, n in got] == RUNS


def feed_files(spark, tmp_path, parts, build):
    """Every part is a micro-batch of one run; returns the sink's rows and the checkpoint."""
    source, sink, progress = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "progress")
    source.mkdir()
    for n, part in enumerate(parts):
        file = source / f"{n:03d}.json"
        file.write_text("\n".join(f'{{"userId":{u},"eventType":"{k}","ts":"{iso(T0 + s)}"}}' for u, k, s in part))
        os.utime(file, (T0 + n, T0 + n))
    stream = spark.readStream.schema(LOGIN_SCHEMA).option("maxFilesPerTrigger", 1).json(str(source))
    query = to_files(build(stream), sink, progress).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len([p for p in query.recentProgress if p["numInputRows"]]) == len([p for p in parts if p])
    return sorted(tuple(r) for r in spark.read.parquet(sink).collect()), progress


def _busy_login_rows():
    """A user with several logins in most seconds, one with few, repeated rows, and other events between."""
    rng = random.Random(5)
    rows = [(1, rng.choice(["login", "login", "view", "alpha"]), rng.randrange(600)) for _ in range(1500)]
    rows += [(2, "login", rng.randrange(600)) for _ in range(60)] + [(3, "login", 7)] * 9 + [(4, "view", 8)] * 3
    return rows


@pytest.mark.parametrize("kind", ["burst", "pattern"])
def test_monitors_over_many_batches(spark, tmp_path, kind):
    """Twenty micro-batches in order of time equal the batch form, and the busy user's state holds the last stretch of time alone."""
    rows = _busy_login_rows()
    parts = [[r for r in rows if r[2] // 30 == n] for n in range(20)]
    stream, batch = (jobs.login_bursts, logins.login_bursts) if kind == "burst" else (jobs.login_patterns, logins.login_patterns)
    got, progress = feed_files(spark, tmp_path, [*parts, [(-1, "login", FAR - T0)]], stream)
    want = sorted(tuple(r) for r in batch(events(spark, rows)).collect())
    assert got == want and len(want) > 20
    state = lambda name, at: {
        r.key.userId: r.n
        for r in spark.read.format("statestore").option("stateVarName", name).option("batchId", at).load(progress).groupBy("key").count().withColumnRenamed("count", "n").collect()
    }
    # Batch 19 adds the last 30 seconds; all older slots were folded and removed when the watermark passed them.
    assert state("slots", 19)[1] <= 31 and max(state("open", 19).values()) == 1


class _Store:
    """A state variable in memory that counts its calls."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def __getattr__(self, name):
        held = self.held
        acts = {
            "get": lambda: held.get(None),
            "update": lambda value: held.update({None: value}),
            "getValue": held.get,
            "updateValue": lambda key, value: held.update({key: value}),
            "removeKey": held.pop,
            "keys": lambda: list(held),
            "clear": held.clear,
        }
        self.calls += 1
        return acts[name]


class _Handle:
    def __init__(self):
        self.stores, self.timers = {}, set()

    def getMapState(self, name, *schemas):
        return self.stores.setdefault(name, _Store())

    getValueState = getMapState

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_a_monitor_calls_the_store_once_for_many_events():
    """A user's 2,000 events of different seconds in three micro-batches; the second begins before the first is passed to its end."""
    monitor, handle = PatternMonitor(20_000, (2, 3, 4), "login", "m"), _Handle()
    monitor.init(handle)
    rng = random.Random(3)
    times = [s * 7 for s in range(2000)]
    kinds = [rng.choice(["login", "login", None, "view"]) for _ in times]
    found = []
    for low, high, mark in ((0, 700, 600), (700, 1400, 1300), (1400, 2000, 10**9)):
        rows = [Row(userId=1, eventType=kinds[n], ms=times[n] * 1000) for n in range(low, high)]
        rng.shuffle(rows)
        list(monitor.handleInputRows((1,), iter(rows), None))
        clock = type("Clock", (), {"getCurrentWatermarkInMs": lambda self, ms=min(mark * 7000, 10**11): ms})()
        while due := [t for t in sorted(handle.timers) if t <= clock.getCurrentWatermarkInMs()]:
            handle.deleteTimer(due[0])
            found += list(monitor.handleExpiredTimer((1,), clock, None))
    want = [
        (times[n] * 1000, r + 1)
        for n in range(2000)
        for r in (2, 3, 4)
        if kinds[n : n + 2] == ["login", "login"]
        and len(after := [t for t, k in zip(times[n + 1 :], kinds[n + 1 :]) if k == "login"]) >= r
        and after[r - 1] - times[n] < 20
    ]
    assert sorted((r.firstLogin, r.loginNums) for r in found) == want and want
    assert not any(store.held for store in handle.stores.values()) and not handle.timers
    assert sum(store.calls for store in handle.stores.values()) < 100


def test_late_logins_are_left_out(spark, tmp_path):
    """A login behind the watermark neither opens nor joins a window."""
    parts = [[(1, "login", 0), (1, "login", 5)], [(2, "login", 100)], [(2, "login", 101)], [(1, "login", 6), (2, "login", 102)], [(-1, "login", FAR - T0)]]
    got, _ = feed_files(spark, tmp_path, parts, jobs.login_bursts)
    assert [(u, (t // 1000) - T0, n) for u, t, n, _ in got] == [(2, 100, 3)]


def test_stream_hot_items_counts_panes(spark, tmp_path):
    """Two stateful operators: 500 views of one item in one pane enter the second as a single row; part slides are refused."""
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.json").write_text("\n".join(f'{{"itemId":1,"ts":"{iso(T0 - T0 % 120 + 600 + n % 100)}"}}' for n in range(500)))
    stream = spark.readStream.schema("itemId int, ts timestamp").json(str(source))
    query = to_files(jobs.hot_item_counts(stream), str(tmp_path / "out"), str(tmp_path / "p")).trigger(availableNow=True).start()
    query.awaitTermination()
    first = query.recentProgress[0]["stateOperators"]
    assert sorted(op["numRowsTotal"] for op in first) == [0, 1]  # the pane is open yet, nothing is copied
    with pytest.raises(ValueError):
        jobs.hot_item_counts(stream, "100 seconds", "30 seconds")


def test_rating_stream_is_stamped(spark):
    lines = spark.createDataFrame([("PRODUCT_RATING_PREFIX:1|2|3.0|4",)], "value string")
    row = jobs.cleanse_ratings(lines).first()
    assert (row.key, row.body) == (logs.RATING_KEY, "1|2|3.0|4") and row.eventTime.microsecond == 0


def test_late_views_are_dropped(spark, tmp_path):
    line = lambda i, t: f'{{"itemId":{i},"ts":"{iso(t)}"}}'
    parts = [[line(1, T0)], [line(1, T0 + 3600)], [line(2, T0)], [line(0, FAR)]]
    assert {item for _, _, item, _ in run_hot_items(spark, tmp_path, parts)} == {1}


def test_columns_of_empty_input(spark):
    empty = spark.createDataFrame([], LOGIN_SCHEMA)
    assert logins.login_bursts(empty).collect() == [] and logins.login_patterns(empty).collect() == []


def test_console_and_topic_sinks(spark, tmp_path, rows):
    source = tmp_path / "log"
    source.mkdir()
    (source / "a.txt").write_text("x LOGIN_PREFIX:1|login|2\njunk\nPRODUCT_PV_PREFIX:3|pv|4\n")
    lines = read_lines(spark, str(source))
    to_console(jobs.cleanse(lines)).trigger(availableNow=True).start().awaitTermination()
    out = str(tmp_path / "topics")
    to_files(jobs.cleanse(lines), out, str(tmp_path / "p"), by_topic=True).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.read.parquet(out).select("topic", "body")) == [("recommender_login", "1|login|2"), ("recommender_pv", "3|pv|4")]
