from pyspark.sql import functions as F

from shelfsense import schemas
from shelfsense.sources import buckets, files, keyed
from shelfsense.streaming import jobs


def test_products_file(spark, tmp_path):
    path = tmp_path / "p.csv"
    path.write_text(
        '7^ Mouse "pro", 8G ^1,2^X^http://i ^a|b^ t1|t2 \n8^n^c^e^u^^t\nbad^n^c^e^u^k^t\n', encoding="utf-8"
    )
    got = files.read_products(spark, str(path)).orderBy("productId")
    assert got.schema.names == schemas.PRODUCT.names
    first, second = got.collect()
    assert tuple(first) == (7, 'Mouse "pro", 8G', "http://i", "a|b", "t1|t2")
    assert (second.productId, second.categories) == (8, None)


def test_ratings_file(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("4867,457976,5.0,1395676800\n1, 2,3.5, 4\nx,1,1.0,1\n1,2\n")
    got = files.read_ratings(spark, str(path))
    assert sorted(tuple(r) for r in got.collect()) == [(1, 2, 3.5, 4), (4867, 457976, 5.0, 1395676800)]


def test_table_round_trip_replaces(spark, tmp_path, rows):
    for fmt in ("parquet", "json", "orc"):
        where = str(tmp_path / fmt)
        files.write_table(spark.createDataFrame([(1, 1, 1.0, 1)], schemas.RATING), where, fmt)
        files.write_table(spark.createDataFrame([(2, 3, 4.0, 5)], schemas.RATING), where, fmt)
        assert rows(files.read_table(spark, where, schemas.RATING, fmt)) == [(2, 3, 4.0, 5)]


def test_topic_routing(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "1"), ("b", "2"), ("a", "3")], "topic string, body string")
    files.write_by_topic(df, str(tmp_path / "t"))
    back = spark.read.parquet(str(tmp_path / "t")).where(F.col("topic") == "a").select("body")
    assert rows(back) == [("1",), ("3",)]


def _recs(spark, *items):
    return spark.createDataFrame([(u, [(p, float(p))]) for u, p in items], schemas.STREAM_RECS)


def test_keyed_table(spark, tmp_path):
    path = str(tmp_path / "k")
    table = keyed.KeyedTable(spark, path, schemas.STREAM_RECS, "userId", 4, keyed.last_write(["userId"], ["recs"]))
    again = lambda: keyed.KeyedTable(spark, path, schemas.STREAM_RECS, "userId", 4, keyed.last_write(["userId"], ["recs"]))
    live = lambda t, keys=None: {r.userId: r.recs[0].productId for r in t.read(keys).collect()}
    assert live(table) == {}
    first = table.claim("checkpoint-a")
    table.put(_recs(spark, (1, 10), (2, 20)), first, 0)
    table.put(_recs(spark, (2, 21), (3, 30)), first, 1)
    assert live(table) == {1: 10, 2: 21, 3: 30}
    table.put(_recs(spark, (2, 22)), first, 1)  # the batch is replayed
    assert live(table) == {1: 10, 2: 22}
    assert again().claim("checkpoint-a") == first  # restarted from its checkpoint
    second = again().claim("checkpoint-b")  # a new run counts its batches from 0 again
    again().put(_recs(spark, (1, 11)), second, 0)
    assert second > first and live(table) == {1: 11, 2: 22}
    before = table.read()
    assert table.compact() and table.deltas() == 0 and live(table) == {1: 11, 2: 22}
    table.put(_recs(spark, (2, 23), (9, 90)), second, 1)
    assert live(table, spark.createDataFrame([(2,), (77,)], "userId int")) == {2: 23}
    assert {r.userId for r in before.collect()} == {1, 2}  # a reader from before the switch still finds its files
    table.put(_recs(spark), second, 2)  # an empty batch
    for _ in range(3):
        table.compact()
        table.vacuum()
    assert live(table) == {1: 11, 2: 23, 9: 90}
    assert len(list((tmp_path / "k" / "base").iterdir())) == 2 and len(list((tmp_path / "k" / "delta").iterdir())) == 0


def test_compaction_beside_a_writer(spark, tmp_path):
    table = jobs.rating_table(spark, str(tmp_path / "r"), 4)
    rating = lambda *rows: spark.createDataFrame(list(rows), schemas.RATING)
    table.load(rating((1, 1, 1.0, 5), (1, 2, 2.0, 6)))
    table.put(rating((1, 1, 3.0, 9)), 0, 0)
    rows, until, number = table._rows()  # a compaction begins
    table.put(rating((1, 1, 4.0, 10), (2, 1, 5.0, 11)), 0, 1)  # a batch arrives meanwhile
    assert table._base(table.merge(rows), until, number)
    assert not table._base(table.merge(rows), until, number)  # another one that began at the same time loses
    got = sorted(tuple(r) for r in table.read().collect())
    assert got == [(1, 1, 4.0, 5), (1, 2, 2.0, 6), (2, 1, 5.0, 11)] and table.deltas() == 1


def test_buckets_open_only_what_is_asked(spark, tmp_path, rows):
    path = str(tmp_path / "b")
    table = spark.createDataFrame([(u, 1, 1.0, u) for u in range(200)], schemas.RATING)
    buckets.write_bucketed(table, path, "userId", 8)
    keys = spark.createDataFrame([(5,), (6,)], "userId int")
    got = buckets.read_buckets(spark, path, keys, "userId", 8)
    assert {5, 6} <= {r.userId for r in got.collect()} and got.count() < 200
    assert rows(got.where("userId = 5")) == [(5, 1, 1.0, 5)]
    assert "PartitionFilters: [bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_unreadable_lines_are_kept_apart(spark, tmp_path):
    (tmp_path / "p.csv").write_text("1^a^x^y^u^c^t\nx^b^x^y^u^c^t\n")
    (tmp_path / "r.csv").write_text("1,2,3.5,100\n1,2,NaN,100\n1,2,,100\nx\n\n1,2,5.0,99999999999999999\n")
    assert [r.productId for r in files.read_products(spark, str(tmp_path / "p.csv")).collect()] == [1]
    assert [r.productId for r in files.bad_products(spark, str(tmp_path / "p.csv")).collect()] == ["x"]
    assert files.read_ratings(spark, str(tmp_path / "r.csv")).count() == 1
    bad = {r.line for r in files.bad_ratings(spark, str(tmp_path / "r.csv")).collect()}
    assert bad == {"1,2,NaN,100", "1,2,,100", "x", "1,2,5.0,99999999999999999"}


def test_rating_stream_scores_what_it_has_just_stored(spark, tmp_path):
    """Both ratings of a user come in batches of their own: the second list must not offer the first product."""
    source = tmp_path / "ratings"
    source.mkdir()
    similar = spark.createDataFrame([(p, r, q, 0.9) for p in (1, 2) for r, q in ((1, 3 - p), (2, 7))], schemas.SIMILARITY)
    history = jobs.rating_log(spark, str(tmp_path / "h"), 2)
    lists = jobs.list_table(spark, str(tmp_path / "l"), 2)
    seen = []
    for part, line in enumerate(["5,1,4.0,100\n", "5,2,5.0,200\n"]):
        (source / f"{part}.csv").write_text(line)
        stream = spark.readStream.schema(schemas.RATING).csv(str(source))
        jobs.realtime_lists(stream, history, similar, lists, str(tmp_path / "c"), threshold=-1.0).trigger(availableNow=True).start().awaitTermination()
        seen.append([x.productId for r in lists.read().collect() for x in r.recs])
    assert len(seen) == 2 and 1 not in seen[1] and 2 not in seen[1]
    assert sorted(r.productId for r in history.read().collect()) == [1, 2]


def test_workers_find_the_package(spark, tmp_path):
    """A driver in another folder, without the package on PYTHONPATH, runs a query with Python workers."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = f"""
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
from shelfsense.session import ship
ship(spark)
def find(batches):
    from shelfsense import schemas
    import pyarrow as pa
    for b in batches:
        yield pa.RecordBatch.from_pydict({{"n": [len(schemas.RATING.fields)]}})
print("found", spark.range(1).mapInArrow(find, "n long").first().n)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "found 4" in done.stdout, done.stderr[-2000:]
