"""Named queries over the order, part, customer and event tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from shelfsense.functions.scores import half_star, register_sql_functions
from shelfsense.operators import (
    content,
    hotitems,
    itemcf,
    latent,
    logins,
    logs,
    ratings,
    realtime,
    search,
    serving,
    statistics,
)
from shelfsense.plans.ranking import nest_ranked, unnest_ranked
from shelfsense.schemas import HOT_ITEMS, LATE_VIEWS, PRODUCT, RATING
from shelfsense.session import ROCKSDB_PROVIDER, materialise, new_path
from shelfsense.sources import order_tables as tables
from shelfsense.sources.buckets import read_buckets, write_bucketed
from shelfsense.sources.files import bad_products, bad_ratings, read_products, read_ratings, read_table, write_by_topic, write_table
from shelfsense.sources.keyed import read_all
from shelfsense.sources.streams import read_lines, to_files
from shelfsense.streaming import jobs

# The events table spreads few users over a month, so its monitors look over hours, not seconds.
BURST_HOURS = 6
PATTERN_HOURS = 48
WIDE_WINDOW, WIDE_SLIDE = 6 * 3600, 3600
SEARCH = "r.*(bolt|ring)$"
TOP_N = 20
BUCKETS = 16


# -- statistics and serving ------------------------------------------------------------------------


def rate_more_products(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.rate_more_products(tables.ratings(spark, sf))


def rate_more_recently(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.rate_more_recently(tables.ratings(spark, sf))


def rate_more_recently_sql(spark: SparkSession, sf: str) -> DataFrame:
    """The monthly counts as SQL text over a view, with the registered ``changeDate``."""
    register_sql_functions(spark)
    return spark.sql(
        "SELECT productId, count(1) AS count, changeDate(timestamp) AS yearmonth FROM {ratings} "
        "GROUP BY changeDate(timestamp), productId",
        ratings=tables.ratings(spark, sf),
    )


def average_products(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.average_products(tables.ratings(spark, sf))


def _means(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.mean_scores(tables.ratings(spark, sf))


def _means_of(spark: SparkSession, sf: str, top: DataFrame) -> DataFrame:
    """Means of the few products of a top list only."""
    ids = top.select("productId").distinct()
    return statistics.mean_scores(tables.ratings(spark, sf).join(ids, "productId", "left_semi"))


def hot_products_top_n(spark: SparkSession, sf: str) -> DataFrame:
    monthly = statistics.monthly_rating_counts(tables.ratings(spark, sf))
    top = materialise(statistics.hot_products(monthly, TOP_N), "hot")
    return serving.recommended_products(top, tables.products(spark, sf), _means_of(spark, sf, top)).select(
        "rank", "productId", "yearmonth", "count", "name", "meanScore"
    )


def rate_more_top_n(spark: SparkSession, sf: str) -> DataFrame:
    top = materialise(statistics.most_rated(statistics.rating_counts(tables.ratings(spark, sf)), TOP_N), "most-rated")
    return serving.recommended_products(top, tables.products(spark, sf), _means_of(spark, sf, top)).select(
        "rank", "productId", "count", "name", "meanScore"
    )


def product_detail(spark: SparkSession, sf: str) -> DataFrame:
    products = tables.products(spark, sf)
    return serving.product_detail(products.select("productId"), products, _means(spark, sf))


def product_search(spark: SparkSession, sf: str) -> DataFrame:
    """Every name is tried; only the hits' ratings are averaged."""
    products = tables.products(spark, sf)
    hits = materialise(products.where(F.col("name").rlike(SEARCH)), "hits")
    return serving.with_mean_score(hits, _means_of(spark, sf, hits))


def product_search_indexed(spark: SparkSession, sf: str) -> DataFrame:
    """The same search by the trigram index, with index and products stored in buckets of which only those asked for are opened."""
    products = tables.products(spark, sf)
    index = _bucketed(search.trigrams(products), "trigrams", "gram")
    stored = _bucketed(products, "products-by-id", "productId")
    hits = materialise(search.search(SEARCH, index, stored, products), "hits")
    return serving.with_mean_score(hits, _means_of(spark, sf, hits))


def distinct_users(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.distinct_users(tables.ratings(spark, sf))


def distinct_products(spark: SparkSession, sf: str) -> DataFrame:
    return statistics.distinct_products(tables.ratings(spark, sf))


# -- log lines -------------------------------------------------------------------------------------


def _raw_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The log as it arrives: text files, one line per event."""
    path = new_path(spark, "log")
    tables.log_lines(spark, sf).write.text(path)
    return spark.read.text(path)


def log_clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    return logs.clean_lines(_raw_lines(spark, sf))


def log_route_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Routed to one folder per topic, read back and counted."""
    path = new_path(spark, "topics")
    write_by_topic(logs.clean_lines(_raw_lines(spark, sf)), path)
    return spark.read.parquet(path).groupBy("topic").agg(F.count(F.lit(1)).alias("lines"))


def log_rating_messages(spark: SparkSession, sf: str) -> DataFrame:
    return logs.clean_rating_lines(_raw_lines(spark, sf))


def log_clean_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return logs.parse_ratings(logs.topic_rows(log_clean_lines(spark, sf), logs.RATING_TOPIC))


def log_clean_logins(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.parse_logins(logs.topic_rows(log_clean_lines(spark, sf), logs.LOGIN_TOPIC))
    return rows.select("userId", "eventType", F.unix_millis("ts").alias("ms"))


def log_clean_views(spark: SparkSession, sf: str) -> DataFrame:
    rows = logs.parse_page_views(logs.topic_rows(log_clean_lines(spark, sf), logs.PV_TOPIC))
    return rows.select("itemId", "eventType", F.unix_seconds("ts").alias("seconds"))


def log_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    return logs.quarantine(_raw_lines(spark, sf))


def log_arrival_stamp(spark: SparkSession, sf: str) -> DataFrame:
    """Rating messages stamped on arrival; ``stamped`` says that the time is a whole second since the query began."""
    since = F.date_trunc("second", F.lit(datetime.now(timezone.utc)))
    rows = logs.stamp_ingestion(log_rating_messages(spark, sf))
    whole = F.col("eventTime") == F.date_trunc("second", "eventTime")
    return rows.select("key", "body", (whole & (F.col("eventTime") >= since)).alias("stamped"))


# -- file loaders ----------------------------------------------------------------------------------


def _product_file(spark: SparkSession, sf: str) -> str:
    """The products as a file in the loader's format; every 50th line has no usable id."""
    rows = tables.products(spark, sf)
    bad = F.when(F.pmod("productId", F.lit(100)) == 0, F.lit("")).when(F.pmod("productId", F.lit(50)) == 0, F.concat(F.lit("x"), F.col("productId").cast("string")))
    line = F.concat_ws("^", F.coalesce(bad, F.concat(F.lit(" "), F.col("productId").cast("string"))), "name", F.lit("1,2"), F.lit("ext"), "imageUrl", "categories", "tags")
    path = new_path(spark, "products-file")
    rows.select(line).write.text(path)
    return path


def _rating_file(spark: SparkSession, sf: str) -> str:
    """The order lines as a rating file; lines with an order key that 97 divides have a time no clock shows, or no score."""
    rows = tables.rating_arrivals(spark, sf)
    odd = F.pmod("orderKey", F.lit(97)) == 0
    first = F.col("lineNumber") == 1
    time = F.when(odd & first, F.lit("99999999999999999")).otherwise(F.col("timestamp").cast("string"))
    score = F.when(odd & ~first, F.lit("none")).otherwise(F.col("score").cast("string"))
    path = new_path(spark, "ratings-file")
    rows.select(F.concat_ws(",", F.col("userId").cast("string"), F.col("productId").cast("string"), score, time)).write.text(path)
    return path


def load_products_file(spark: SparkSession, sf: str) -> DataFrame:
    """File to table and back: lines parsed, stored as a whole table, scanned again."""
    path = new_path(spark, "products")
    write_table(read_products(spark, _product_file(spark, sf)), path)
    return read_table(spark, path, PRODUCT)


def load_ratings_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ratings per user and product of the loaded file, so that lines repeated in it are counted."""
    path = new_path(spark, "ratings")
    write_table(read_ratings(spark, _rating_file(spark, sf)), path)
    rows = read_table(spark, path, RATING)
    return rows.groupBy("userId", "productId", "score", "timestamp").agg(F.count(F.lit(1)).alias("lines"))


def load_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    """What the loaders of both files left out, as it stood there, with the number of equal lines."""
    bad = bad_products(spark, _product_file(spark, sf)).select(F.lit("products").alias("file"), "line")
    bad = bad.union(bad_ratings(spark, _rating_file(spark, sf)).select(F.lit("ratings"), "line"))
    return bad.groupBy("file", "line").agg(F.count(F.lit(1)).alias("lines"))


# -- rating state ----------------------------------------------------------------------------------


def recent_ratings(spark: SparkSession, sf: str) -> DataFrame:
    return ratings.recent_ratings(tables.ratings(spark, sf))


ARRIVAL = ("shipDate", "orderKey", "lineNumber")


def rating_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """All order lines in their order of arrival; a repeat replaces the score."""
    return ratings.merge_ratings(tables.rating_arrivals(spark, sf), arrival=ARRIVAL)


def rating_upsert_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """The older lines as the table, already merged, and the newer ones as updates."""
    rows = tables.rating_arrivals(spark, sf)
    newer = F.col("shipDate") >= F.lit("1995-06-17").cast("timestamp")
    old = ratings.merge_ratings(rows.where(~newer), arrival=ARRIVAL)
    return ratings.merge_ratings(old, rows.where(newer), arrival=ARRIVAL)


def half_star_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Order quantities (1 to 50) read as 10-point scores in fifths, on the 5-point scale."""
    lines = tables.table(spark, sf, "lineitem")
    return lines.groupBy(half_star(F.col("l_quantity") / 5).alias("score")).agg(F.count(F.lit(1)).alias("lines"))


def user_hash_id(spark: SparkSession, sf: str) -> DataFrame:
    return serving.users_by_name(tables.users(spark, sf).select("username"))


# -- similarity ------------------------------------------------------------------------------------


def item_cooccurrence(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.cooccurrence(tables.ratings(spark, sf))


def itemcf_topk(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.itemcf_similar(tables.ratings(spark, sf))


def itemcf_topk_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return itemcf.itemcf_similar(tables.ratings(spark, sf), distinct_users=True)


def serve_itemcf(spark: SparkSession, sf: str) -> DataFrame:
    """Item lists of all products, stored nested as a table of lists, served with product detail."""
    products = tables.products(spark, sf)
    stored = materialise(nest_ranked(itemcf_topk(spark, sf), "productId", "recProductId", "score"), "itemcf-lists")
    served = serving.serve_for_products(
        products.select("productId"), unnest_ranked(stored, "productId"), products, _means(spark, sf)
    )
    return served.select("productId", "rank", "recProductId", "score", "name", "meanScore")


def content_tfidf(spark: SparkSession, sf: str) -> DataFrame:
    return content.tfidf(tables.products(spark, sf))


def content_similar(spark: SparkSession, sf: str) -> DataFrame:
    return content.content_similar(tables.products(spark, sf))


def content_topk(spark: SparkSession, sf: str) -> DataFrame:
    return content.content_similar(tables.products(spark, sf), k=TOP_N)


def serve_content(spark: SparkSession, sf: str) -> DataFrame:
    """Whole lists of all products with product detail, which travels with the listed products instead of being joined to the result."""
    products = tables.products(spark, sf)
    detail = serving.with_mean_score(products, _means(spark, sf)).select("productId", "name", F.col("score").alias("meanScore"))
    return content.content_similar(products, asked=products.select("productId"), detail=detail)


def content_similar_hashed(spark: SparkSession, sf: str) -> DataFrame:
    return content.content_similar(content.bucket_tags(tables.products(spark, sf)))


def content_hashed_terms(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of the hashed tag words, entry by entry."""
    return content.hashed_terms(tables.products(spark, sf)).withColumn("weight", F.round("weight", 9))


def content_hashed_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Size and length of every product's hashed, rescaled vector."""
    squares = F.aggregate("features", F.lit(0.0), lambda acc, e: acc + e["weight"] * e["weight"])
    return content.hashed_vectors(tables.products(spark, sf)).select(
        "productId", F.size("words").alias("words"), F.round(F.sqrt(squares), 9).alias("length")
    )


# -- latent factors --------------------------------------------------------------------------------


def _model(spark: SparkSession, sf: str):
    return latent.train(materialise(tables.ratings(spark, sf), "als-ratings"))


def als_user_recs(spark: SparkSession, sf: str) -> DataFrame:
    return unnest_ranked(latent.user_recs(_model(spark, sf)), "userId", "productId")


def als_item_similar(spark: SparkSession, sf: str) -> DataFrame:
    return latent.factor_similar(_model(spark, sf).itemFactors)


def als_item_topk(spark: SparkSession, sf: str) -> DataFrame:
    return latent.factor_similar(_model(spark, sf).itemFactors, k=TOP_N)


def als_rmse_grid(spark: SparkSession, sf: str) -> DataFrame:
    return latent.rmse_grid(tables.ratings(spark, sf))


def als_best_of_grid(spark: SparkSession, sf: str) -> DataFrame:
    return latent.best_of_grid(als_rmse_grid(spark, sf))


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Given vectors as factors; those without a value or with a component that is none are left out."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = tables.table(spark, sf, "embeddings").where(F.col("embedding").isNotNull() & finite)
    return rows.select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").alias("features"))


def vector_similar(spark: SparkSession, sf: str) -> DataFrame:
    """The similarity of factors on vectors that need no training."""
    return latent.factor_similar(_vectors(spark, sf))


def vector_topk(spark: SparkSession, sf: str) -> DataFrame:
    return latent.factor_similar(_vectors(spark, sf), k=TOP_N)


def vector_best_dots(spark: SparkSession, sf: str) -> DataFrame:
    """The search behind the lists per user, on vectors that need no training: every vector asks all."""
    rows = _vectors(spark, sf)
    best = latent.best_dots(rows, rows, TOP_N)
    return best.select(F.col("id").cast("int").alias("id"), "rank", F.col("item").cast("int").alias("item"), "score")


def damped_rmse_grid(spark: SparkSession, sf: str) -> DataFrame:
    return latent.damped_grid(tables.ratings(spark, sf))


def damped_best_of_grid(spark: SparkSession, sf: str) -> DataFrame:
    return latent.best_of_grid(damped_rmse_grid(spark, sf), ["damping"])


def rmse_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """The error measure itself: every rating predicted by its product's mean."""
    rows = tables.ratings(spark, sf)
    predicted = rows.join(_means(spark, sf), "productId").withColumnRenamed("avg", "prediction")
    return latent.rmse(predicted).select(F.round("rmse", 9).alias("rmse"))


def serve_offline(spark: SparkSession, sf: str) -> DataFrame:
    products = tables.products(spark, sf)
    served = serving.serve_for_users(
        tables.users(spark, sf).select("userId"), als_user_recs(spark, sf), products, _means(spark, sf)
    )
    return served.select("userId", "rank", "productId", "score", "name", "meanScore")


# -- realtime --------------------------------------------------------------------------------------


def _lists(spark: SparkSession, sf: str, depth: int, asked: DataFrame | None = None):
    """Similarity lists down to ``depth``, and the products' vectors that score pairs."""
    members, vectors = content.tag_vectors(tables.products(spark, sf))
    lists = content.similar_lists(members, vectors, k=depth, asked=asked)
    return lists, content.tag_profiles(members, vectors)


def realtime_candidates(spark: SparkSession, sf: str) -> DataFrame:
    history = materialise(tables.ratings(spark, sf), "rating-history")
    last = materialise(ratings.latest_rating(history), "latest-ratings")
    members, vectors = content.tag_vectors(tables.products(spark, sf))
    lists = content.similar_lists(members, vectors, k=realtime.deepest_rank(history), asked=last)
    return realtime.candidates(last, history, lists)


def realtime_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Every user's latest rating as the event; no similarity table beyond the lists of the products asked for."""
    history = materialise(tables.ratings(spark, sf), "rating-history")
    last = materialise(ratings.latest_rating(history), "latest-ratings")
    lists, profiles = _lists(spark, sf, realtime.deepest_rank(history), last)
    return realtime.realtime_scores(last, history, lists, profiles=profiles)


# -- page views and logins -------------------------------------------------------------------------


def hot_items_window(spark: SparkSession, sf: str) -> DataFrame:
    return hotitems.hot_items(hotitems.window_counts(tables.page_views(spark, sf)))


def hot_items_report(spark: SparkSession, sf: str) -> DataFrame:
    counts = hotitems.window_counts(tables.page_views(spark, sf), WIDE_WINDOW, WIDE_SLIDE)
    return hotitems.hot_item_report(hotitems.hot_items(counts))


def login_burst(spark: SparkSession, sf: str) -> DataFrame:
    return logins.login_bursts(tables.user_events(spark, sf), seconds=BURST_HOURS * 3600)


def login_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return logins.login_patterns(tables.user_events(spark, sf), seconds=PATTERN_HOURS * 3600)


# -- streams ---------------------------------------------------------------------------------------


def _line_stream(lines: DataFrame) -> DataFrame:
    """Write lines as compressed text files and open a stream on them."""
    spark = lines.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    path = new_path(spark, "lines")
    lines.select("value").write.text(path, compression="gzip")
    return read_lines(spark, path)


def _run_to_table(stream: DataFrame, name: str, by_topic: bool = False) -> DataFrame:
    spark = stream.sparkSession
    path = new_path(spark, name)
    query = to_files(stream, path, new_path(spark, "progress"), by_topic=by_topic).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def stream_route_counts(spark: SparkSession, sf: str) -> DataFrame:
    topics = _run_to_table(jobs.cleanse(_line_stream(tables.log_lines(spark, sf))), "stream-topics", by_topic=True)
    return topics.groupBy("topic").agg(F.count(F.lit(1)).alias("lines"))


#: Micro-batches of a stream query that is fed in order of time.
STRETCHES = 3


def _by_stretch(rows: DataFrame, name: str, n: int = STRETCHES) -> DataFrame:
    """Rows with ``part``: the whole time, measured by ``sec``, cut into ``n`` equal stretches."""
    rows = materialise(rows, name)
    span = rows.agg(F.min("sec").alias("_low"), F.max("sec").alias("_high"))  # one row
    part = F.floor((F.col("sec") - F.col("_low")) * n / (F.col("_high") - F.col("_low") + 1)).cast("int")
    return rows.crossJoin(F.broadcast(span)).withColumn("part", part).drop("_low", "_high")


def _in_batches(parts: list[DataFrame], run: Callable[[DataFrame, str], DataStreamWriter], progress: str) -> None:
    """Append one part of lines after the other to a folder; each is one micro-batch of a query restarted from its checkpoint."""
    spark = parts[0].sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB_PROVIDER)
    path = new_path(spark, "lines")
    for part in parts:
        part.select("value").write.mode("append").text(path)
        run(read_lines(spark, path), progress).trigger(availableNow=True).start().awaitTermination()


def _in_order(lines: DataFrame, closing: str, run: Callable[[DataFrame, str], DataStreamWriter]) -> None:
    """Feed (value, sec) by stretches of time. The last one has a ``closing`` line far ahead: it moves the watermark past all others."""
    spark = lines.sparkSession
    timed = _by_stretch(lines, "timed-lines")
    parts = [timed.where(F.col("part") == k).select("value") for k in range(STRETCHES)]
    parts[-1] = parts[-1].union(spark.createDataFrame([(closing,)], "value string"))
    _in_batches(parts, run, new_path(spark, "progress"))


def stream_hot_items(spark: SparkSession, sf: str) -> DataFrame:
    path = new_path(spark, "stream-hot")

    def rank(lines: DataFrame, progress: str) -> DataStreamWriter:
        views = logs.parse_page_views(logs.topic_rows(jobs.cleanse(lines), logs.PV_TOPIC))
        return jobs.hot_items(jobs.hot_item_counts(views, f"{WIDE_WINDOW} seconds", f"{WIDE_SLIDE} seconds"), path, progress)

    _in_order(tables.timed_log_lines(spark, sf), "PRODUCT_PV_PREFIX:0|pv|4102444800", rank)
    return read_all(spark, path, HOT_ITEMS)


def _monitored(spark: SparkSession, sf: str, name: str, monitor: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All user events, in order of time, through a login monitor; its alerts as a file table."""
    body = F.concat_ws("|", F.col("userId").cast("string"), "eventType", F.unix_millis("ts").cast("string"))
    lines = tables.user_events(spark, sf).select(body.alias("value"), F.unix_seconds("ts").alias("sec"))
    path = new_path(spark, name)
    _in_order(lines, "-1|login|4102444800000", lambda raw, progress: to_files(monitor(logs.parse_logins(raw, "value")), path, progress))
    return spark.read.parquet(path)


def stream_login_burst(spark: SparkSession, sf: str) -> DataFrame:
    return _monitored(spark, sf, "stream-burst", lambda events: jobs.login_bursts(events, seconds=BURST_HOURS * 3600))


def stream_login_pattern(spark: SparkSession, sf: str) -> DataFrame:
    return _monitored(spark, sf, "stream-pattern", lambda events: jobs.login_patterns(events, seconds=PATTERN_HOURS * 3600))


def _bucketed(df: DataFrame, name: str, key: str) -> Callable[[DataFrame], DataFrame]:
    """Store a table by key bucket; the result opens the buckets of the keys it is given."""
    path = new_path(df.sparkSession, name)
    write_bucketed(df, path, key, BUCKETS)
    return lambda keys: read_buckets(keys.sparkSession, path, keys, key, BUCKETS)


def _rating_lines(rows: DataFrame) -> DataFrame:
    fields = [F.col(c).cast("string") for c in ("userId", "productId", "score", "timestamp")]
    return rows.select(F.concat(F.lit("PRODUCT_RATING_PREFIX:"), F.concat_ws("|", *fields)).alias("value"))


def _stream_lists(spark: SparkSession, sf: str) -> DataFrame:
    """The history begins empty: the stream itself writes every rating before it scores the users who rated."""
    history = tables.ratings(spark, sf)
    events = logs.parse_ratings(logs.topic_rows(jobs.cleanse(_line_stream(_rating_lines(history))), logs.RATING_TOPIC))
    lists, profiles = _lists(spark, sf, realtime.deepest_rank(history))
    by_product = _bucketed(lists, "similar-by-product", "productId")
    state = jobs.rating_log(spark, new_path(spark, "ratings-by-user"), BUCKETS)
    served = jobs.list_table(spark, new_path(spark, "stream-recs"), BUCKETS)
    writer = jobs.realtime_lists(events, state, by_product, served, new_path(spark, "progress"), profiles=profiles)
    writer.trigger(availableNow=True).start().awaitTermination()
    return unnest_ranked(served.read(), "userId", "productId", "recs")


def stream_rating_state(spark: SparkSession, sf: str) -> DataFrame:
    """All order lines in yearly micro-batches, by two runs with their own checkpoints and a compaction between; the merged history."""
    rows = materialise(tables.ratings(spark, sf), "rating-history")
    table = jobs.rating_table(spark, new_path(spark, "rating-state"), BUCKETS)
    cuts = [F.lit(y).cast("timestamp").cast("long") for y in ("1993-01-01", "1994-01-01", "1995-01-01", "1996-01-01", "1997-01-01", "1998-01-01")]
    year = sum(((F.col("timestamp") >= c).cast("int") for c in cuts), F.lit(0))
    parts = [_rating_lines(rows.where(year == k)) for k in range(len(cuts) + 1)]

    def keep(lines: DataFrame, progress: str) -> DataStreamWriter:
        return jobs.keep_ratings(logs.parse_ratings(logs.topic_rows(jobs.cleanse(lines), logs.RATING_TOPIC)), table, progress)

    _in_batches(parts[:4], keep, new_path(spark, "progress"))
    table.compact()
    _in_batches(parts[4:], keep, new_path(spark, "progress"))
    return table.read()


#: Views whose item number this divides reach the log one part later than their time.
TARDY = 7


def stream_late_views(spark: SparkSession, sf: str) -> DataFrame:
    """Views that come behind the watermark, with the watermark they missed: three stretches of time as micro-batches, some views one later."""
    views = _by_stretch(tables.page_views(spark, sf).select("itemId", F.unix_seconds("ts").alias("sec")), "views", 3)
    part = F.col("part") + (F.pmod("itemId", F.lit(TARDY)) == 0).cast("int")
    line = F.concat(F.lit("PRODUCT_PV_PREFIX:"), F.concat_ws("|", F.col("itemId").cast("string"), F.lit("pv"), F.col("sec").cast("string")))
    lines = materialise(views.select(part.alias("part"), line.alias("value")), "view-lines")
    path = new_path(spark, "late-views")

    def split(raw: DataFrame, progress: str) -> DataStreamWriter:
        return jobs.late_rows(logs.parse_page_views(logs.topic_rows(jobs.cleanse(raw), logs.PV_TOPIC)), "ts", 1, path, progress)

    _in_batches([lines.where(F.col("part") == k) for k in range(4)], split, new_path(spark, "progress"))
    late = read_all(spark, f"{path}/late", LATE_VIEWS)
    return late.groupBy("itemId", F.unix_seconds("ts").alias("seconds"), (F.col("watermark") / 1_000_000).cast("long").alias("watermark")).agg(
        F.count(F.lit(1)).alias("views")
    )


def stream_recs(spark: SparkSession, sf: str) -> DataFrame:
    return _stream_lists(spark, sf)


def serve_stream(spark: SparkSession, sf: str) -> DataFrame:
    products = tables.products(spark, sf)
    served = serving.serve_for_users(
        tables.users(spark, sf).select("userId"), _stream_lists(spark, sf), products, _means(spark, sf)
    )
    return served.select("userId", "rank", "productId", "score", "name", "meanScore")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        rate_more_products,
        rate_more_recently,
        rate_more_recently_sql,
        average_products,
        hot_products_top_n,
        rate_more_top_n,
        product_detail,
        product_search,
        product_search_indexed,
        distinct_users,
        distinct_products,
        log_clean_lines,
        log_route_counts,
        log_rating_messages,
        log_clean_ratings,
        log_clean_logins,
        log_clean_views,
        log_quarantine,
        log_arrival_stamp,
        load_products_file,
        load_ratings_file,
        load_quarantine,
        recent_ratings,
        rating_upsert,
        rating_upsert_incremental,
        half_star_scores,
        user_hash_id,
        item_cooccurrence,
        itemcf_topk,
        itemcf_topk_distinct,
        serve_itemcf,
        content_tfidf,
        content_similar,
        content_topk,
        serve_content,
        content_similar_hashed,
        content_hashed_terms,
        content_hashed_vectors,
        als_user_recs,
        als_item_similar,
        als_item_topk,
        als_rmse_grid,
        als_best_of_grid,
        vector_similar,
        vector_topk,
        vector_best_dots,
        damped_rmse_grid,
        damped_best_of_grid,
        rmse_of_means,
        serve_offline,
        realtime_candidates,
        realtime_scores,
        hot_items_window,
        hot_items_report,
        login_burst,
        login_pattern,
        stream_route_counts,
        stream_hot_items,
        stream_login_burst,
        stream_login_pattern,
        stream_recs,
        serve_stream,
        stream_rating_state,
        stream_late_views,
    )
}
