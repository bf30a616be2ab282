"""The catalogue's queries as SQL over the same tables, written independently of the Spark code."""

from __future__ import annotations

from shelfsense.operators.content import HASH_BUCKETS
from shelfsense.operators.logins import BURST_MESSAGE, PATTERN_MESSAGE
from shelfsense.operators.latent import GRID_DAMPING, split_limit
from shelfsense.plans.catalogue import BURST_HOURS, PATTERN_HOURS, SEARCH, TOP_N, WIDE_SLIDE, WIDE_WINDOW

_RATINGS = """ratings AS (
  SELECT o_custkey::INT AS "userId", l_partkey::INT AS "productId", ceil(l_quantity / 10)::DOUBLE AS score,
         ((epoch_us(l_shipdate) // 1000) // 1000)::BIGINT AS "timestamp"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_MEANS = """means AS (SELECT "productId", avg(score) AS mean FROM ratings GROUP BY 1)"""

_COUNTS = """counts AS (SELECT "productId", count(*) AS count FROM ratings GROUP BY 1)"""

_MONTHLY = """monthly AS (
  SELECT "productId", count(*) AS count, strftime(to_timestamp("timestamp") AT TIME ZONE 'UTC', '%Y%m')::INT AS yearmonth
  FROM ratings GROUP BY "productId", yearmonth)"""

_UPSERT = """WITH arrived AS (
  SELECT o_custkey::INT AS "userId", l_partkey::INT AS "productId", ceil(l_quantity / 10)::DOUBLE AS score,
         ((epoch_us(l_shipdate) // 1000) // 1000)::BIGINT AS "timestamp",
         row_number() OVER (PARTITION BY o_custkey, l_partkey ORDER BY l_shipdate, l_orderkey, l_linenumber) AS n
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT "userId", "productId", arg_max(score, n) AS score, arg_min("timestamp", n) AS "timestamp" FROM arrived GROUP BY ALL"""

_RATING_FILE = """WITH file AS (
  SELECT o_custkey::INT AS "userId", l_partkey::INT AS "productId", ceil(l_quantity / 10)::DOUBLE AS score,
         ((epoch_us(l_shipdate) // 1000) // 1000)::BIGINT AS "timestamp", l_linenumber AS n, l_orderkey % 97 = 0 AS odd
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

_ITEM = """regexp_extract(props, '"k": *([0-9]+)', 1)"""

_LINES = f"""src AS (
  SELECT event_type AS kind, event_id % 6 AS variant, user_id::VARCHAR AS u, {_ITEM} AS item,
         (event_id % 5 + 1)::VARCHAR AS score, ((epoch_us(ts) // 1000) // 1000)::VARCHAR AS sec, (epoch_us(ts) // 1000)::VARCHAR AS ms
  FROM events),
lines AS (
  SELECT CASE
    WHEN kind = 'click' THEN 'INFO web LOGIN_PREFIX:' || u || '|login|' || ms
    WHEN kind = 'view' THEN 'INFO web PRODUCT_PV_PREFIX:' || item || '|pv|' || sec
    WHEN kind = 'purchase' THEN 'INFO web PRODUCT_RATING_PREFIX:' || u || '|' || item || '|' || score || '.0|' || sec
    WHEN kind = 'error' THEN 'ERROR web request failed for ' || u
    WHEN variant = 0 THEN 'web PRODUCT_RATING_PREFIX:' || u || '|' || item || '|bad|' || sec
    WHEN variant = 1 THEN 'web PRODUCT_PV_PREFIX:' || item
    WHEN variant = 2 THEN 'web LOGIN_PREFIX: ' || chr(9) || u || ' | login |' || chr(9) || ms || ' '
    WHEN variant = 3 THEN 'web LOGIN_PREFIX:' || u || '|login|' || ms || ' PRODUCT_RATING_PREFIX:' || u || '|' || item
                          || '|' || score || '.0|' || sec
    WHEN variant = 4 THEN 'web PRODUCT_RATING_PREFIX:'
    ELSE 'web PRODUCT_RATING_PREFIX:' || u || '|' || item || '|' || score || '.0|' || sec || '||' END AS value
  FROM src),
routed AS (
  SELECT value,
    CASE WHEN strpos(value, 'LOGIN_PREFIX:') > 0 THEN 'recommender_login'
         WHEN strpos(value, 'PRODUCT_RATING_PREFIX:') > 0 THEN 'recommender_rating'
         WHEN strpos(value, 'PRODUCT_PV_PREFIX:') > 0 THEN 'recommender_pv' END AS topic,
    CASE WHEN strpos(value, 'LOGIN_PREFIX:') > 0 THEN split_part(value, 'LOGIN_PREFIX:', 2)
         WHEN strpos(value, 'PRODUCT_RATING_PREFIX:') > 0 THEN split_part(value, 'PRODUCT_RATING_PREFIX:', 2)
         ELSE split_part(value, 'PRODUCT_PV_PREFIX:', 2) END AS raw
  FROM lines),
cleaned AS (
  SELECT topic, trim(raw, ' ' || chr(9)) AS body, value FROM routed WHERE topic IS NOT NULL),
fields AS (
  SELECT topic, body, value,
    trim(split_part(body, '|', 1), ' ' || chr(9)) AS f1, trim(split_part(body, '|', 2), ' ' || chr(9)) AS f2,
    trim(split_part(body, '|', 3), ' ' || chr(9)) AS f3, trim(split_part(body, '|', 4), ' ' || chr(9)) AS f4
  FROM cleaned),
checked AS (
  SELECT *, CASE topic
    WHEN 'recommender_rating' THEN regexp_full_match(f1, '[0-9]+') AND regexp_full_match(f2, '[0-9]+')
         AND regexp_full_match(f3, '[0-9]+[.]?[0-9]*') AND regexp_full_match(f4, '[0-9]+')
    ELSE regexp_full_match(f1, '[0-9]+') AND regexp_full_match(f3, '[0-9]+') END AS good
  FROM fields)"""

_PAIR_COUNTS = """folded AS (SELECT "userId", "productId", count(*) AS n FROM ratings GROUP BY 1, 2),
totals AS (SELECT "productId", sum(n)::BIGINT AS total FROM folded GROUP BY 1),
pairs AS (
  SELECT a."productId" AS p, b."productId" AS q, sum(a.n * b.n)::BIGINT AS together
  FROM folded a JOIN folded b ON a."userId" = b."userId" AND a."productId" <> b."productId" GROUP BY 1, 2),
scored AS (
  SELECT p, q, together, t.total AS c1, s.total AS c2, together / sqrt(t.total::DOUBLE * s.total::DOUBLE) AS score
  FROM pairs JOIN totals t ON t."productId" = p JOIN totals s ON s."productId" = q),
itemcf AS (
  SELECT * FROM (
    SELECT p AS "productId", row_number() OVER (PARTITION BY p ORDER BY score DESC, q)::INT AS rank,
           q AS "recProductId", score FROM scored) WHERE rank <= 10)"""

_TERMS = """words AS (
  SELECT p_partkey::INT AS id, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS term
  FROM part),
tf AS (SELECT id, term, count(*) AS tf FROM words WHERE term <> '' GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weighted AS (
  SELECT id, term, tf, df, tf * ln(((SELECT count(*) FROM part) + 1) / (df + 1)) AS w FROM tf JOIN df USING (term))"""



def _content(terms: str) -> str:
    """Ranked cosines above the threshold of the vectors that ``terms`` weighs."""
    return (
        terms
        + """,
units AS (
  SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS u FROM weighted WHERE w > 0),
cosines AS (
  SELECT a.id AS p, b.id AS q, round(sum(a.u * b.u), 9) AS score
  FROM units a JOIN units b ON a.term = b.term AND a.id <> b.id GROUP BY 1, 2),
content AS (
  SELECT p AS "productId", row_number() OVER (PARTITION BY p ORDER BY score DESC, q)::INT AS rank,
         q AS "recProductId", score
  FROM cosines WHERE score > 0.4)"""
    )


_CONTENT = _content(_TERMS)

# Multipliers and addend of 32-bit murmur3, and its seed. All steps are unsigned modulo 2^32.
_MASK, _K1, _K2, _ADD, _F1, _F2, _SEED = 4294967295, 3432918353, 461845907, 3864292196, 2246822507, 3266489909, 42

_HASHED_TERMS = f"""tags AS (
  SELECT p_partkey::INT AS id, unnest(string_split(lower(p_name || ' ' || p_type || ' ' || p_brand), ' ')) AS word FROM part),
digits AS (SELECT word, hex(word) AS x, strlen(word)::BIGINT AS n FROM (SELECT DISTINCT word FROM tags)),
bytes AS (
  SELECT word, n, list_transform(range(0, n), lambda i: 16 * (strpos('0123456789ABCDEF', substr(x, 2 * i + 1, 1)) - 1)
                                                        + strpos('0123456789ABCDEF', substr(x, 2 * i + 2, 1)) - 1) AS b FROM digits),
blocks AS (
  SELECT word, n, list_concat(
    list_transform(range(0, n // 4), lambda i: (b[4 * i + 1] + 256 * b[4 * i + 2] + 65536 * b[4 * i + 3] + 16777216 * b[4 * i + 4])::UBIGINT),
    list_transform(range(n // 4 * 4, n), lambda i: (b[i + 1] + CASE WHEN b[i + 1] > 127 THEN 4294967040 ELSE 0 END)::UBIGINT)) AS k
  FROM bytes),
spread AS (SELECT word, n, list_transform(k, lambda v: (v * {_K1}::UBIGINT) & {_MASK}::UBIGINT) AS k FROM blocks),
mixed AS (
  SELECT word, n, list_transform(k, lambda v: ((((v << 15) & {_MASK}::UBIGINT) | (v >> 17)) * {_K2}::UBIGINT) & {_MASK}::UBIGINT) AS k FROM spread),
folded AS (
  SELECT word, xor(list_reduce(list_concat([{_SEED}::UBIGINT], k), lambda h, v:
    (((((xor(h, v) << 13) & {_MASK}::UBIGINT) | (xor(h, v) >> 19)) * 5::UBIGINT + {_ADD}::UBIGINT) & {_MASK}::UBIGINT)), n::UBIGINT) AS h FROM mixed),
once AS (SELECT word, (xor(h, h >> 16) * {_F1}::UBIGINT) & {_MASK}::UBIGINT AS h FROM folded),
twice AS (SELECT word, (xor(h, h >> 13) * {_F2}::UBIGINT) & {_MASK}::UBIGINT AS h FROM once),
whole AS (SELECT word, xor(h, h >> 16)::BIGINT AS h FROM twice),
buckets AS (SELECT word, (((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % {HASH_BUCKETS} + {HASH_BUCKETS}) % {HASH_BUCKETS})::INT AS term FROM whole),
tf AS (SELECT id, term, count(*) AS tf FROM tags JOIN buckets USING (word) GROUP BY 1, 2),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
weighted AS (
  SELECT id, term, tf, df, tf * ln(((SELECT count(*) FROM part) + 1) / (df + 1)) AS w FROM tf JOIN df USING (term))"""

_RECENT = """recent AS (
  SELECT * FROM (
    SELECT "userId", row_number() OVER (PARTITION BY "userId" ORDER BY "timestamp" DESC, "productId", score DESC)::INT AS rank,
           "productId", score, "timestamp" FROM ratings) WHERE rank <= 20)"""

_REALTIME = f"""WITH {_RATINGS}, {_CONTENT}, {_RECENT},
rated AS (SELECT DISTINCT "userId", "productId" FROM ratings),
asked AS (SELECT "userId", "productId" FROM recent WHERE rank = 1),
candidates AS (
  SELECT * FROM (
    SELECT a."userId", c."recProductId" AS candidate,
           row_number() OVER (PARTITION BY a."userId" ORDER BY c.score DESC, c."recProductId")::INT AS rank
    FROM asked a JOIN content c ON a."productId" = c."productId"
    WHERE NOT EXISTS (SELECT 1 FROM rated r WHERE r."userId" = a."userId" AND r."productId" = c."recProductId"))
  WHERE rank <= 20),
evidence AS (
  SELECT k."userId", k.candidate, c.score AS sim, r.score AS rating
  FROM candidates k JOIN recent r ON r."userId" = k."userId"
  JOIN content c ON c."productId" = k.candidate AND c."recProductId" = r."productId"),
scores AS (
  SELECT "userId", candidate,
         round(sum(CAST(sim * rating AS DECIMAL(20, 11)))::DOUBLE / count(*) + log10(greatest(count(*) FILTER (rating > 3), 1))
               - log10(greatest(count(*) FILTER (rating <= 3), 1)), 12) AS score
  FROM evidence GROUP BY 1, 2),
realtime AS (
  SELECT "userId", row_number() OVER (PARTITION BY "userId" ORDER BY score DESC, candidate)::INT AS rank,
         candidate AS "productId", score FROM scores)"""

_REALTIME_ROWS = f'{_REALTIME} SELECT "userId", rank, "productId", score FROM realtime'

_VECTORS = """WITH given AS (
  SELECT vec_id::INT AS id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
units AS (
  SELECT id, list_transform(e, lambda x: x / norm) AS u
  FROM (SELECT id, e, sqrt(list_inner_product(e, e)) AS norm FROM given) WHERE norm > 0),
cosines AS (
  SELECT a.id AS p, b.id AS q, round(list_inner_product(a.u, b.u), 9) AS score FROM units a JOIN units b ON a.id <> b.id),
vectors AS (
  SELECT p AS "productId", row_number() OVER (PARTITION BY p ORDER BY score DESC, q)::INT AS rank, q AS "recProductId", score
  FROM cosines WHERE score > 0.4)"""

_DAMPED = f"""WITH {_RATINGS},
drawn AS (
  SELECT *, substr(md5('42|' || "userId" || '|' || "productId" || '|' || "timestamp"), 1, 8) < '{split_limit()}' AS train FROM ratings),
sums AS (SELECT "productId", sum(score) AS s, count(*) AS n FROM drawn WHERE train GROUP BY 1),
dampings AS (SELECT unnest({[float(d) for d in GRID_DAMPING]})::DOUBLE AS damping),
errors AS (
  SELECT damping, score - (s + damping * (SELECT avg(score) FROM drawn WHERE train)) / (n + damping) AS e
  FROM drawn JOIN sums USING ("productId") CROSS JOIN dampings WHERE NOT train),
grid AS (SELECT damping, round(sqrt(avg(e * e)), 9) AS rmse FROM errors GROUP BY 1)"""

_PRODUCT_DETAIL = """detail AS (
  SELECT p_partkey::INT AS "productId", p_name AS name, 'img/' || p_partkey AS "imageUrl", p_type || '|' || p_brand AS categories,
         replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|') || '|' || p_brand AS tags, coalesce(mean, 0.0) AS score
  FROM part LEFT JOIN means ON p_partkey = "productId")"""


def _served(lists: str, key: str, item: str) -> str:
    return (
        f'SELECT l."{key}", l.rank, l."{item}", l.score, d.name, d.score AS "meanScore" '
        f'FROM {lists} l JOIN detail d ON d."productId" = l."{item}"'
    )


def _windows(size: int, slide: int) -> str:
    return f"""WITH views AS (
  SELECT {_ITEM}::INT AS item, (epoch_us(ts) // 1000) // 1000 AS sec FROM events WHERE event_type = 'view'),
placed AS (
  SELECT item, unnest(generate_series((sec // {slide}) * {slide} + {slide}, (sec // {slide}) * {slide} + {size}, {slide})) AS w
  FROM views),
tally AS (SELECT w, item, count(*) AS nums FROM placed GROUP BY 1, 2),
hot AS (
  SELECT * FROM (
    SELECT w AS "windowEnd", row_number() OVER (PARTITION BY w ORDER BY nums DESC, item)::INT AS rank, item AS "itemId", nums
    FROM tally) WHERE rank <= 3)"""


_BURST = f"""WITH RECURSIVE logins AS (
  SELECT user_id AS u, (epoch_us(ts) // 1000) AS t FROM events WHERE event_type = 'click'),
anchors AS (
  SELECT u, min(t) AS t FROM logins GROUP BY u
  UNION ALL
  SELECT a.u, (SELECT min(l.t) FROM logins l WHERE l.u = a.u AND l.t > a.t + {BURST_HOURS * 3600000}) AS t
  FROM anchors a WHERE a.t IS NOT NULL)
SELECT a.u AS "userId", a.t AS "windowStart", count(*) AS "loginNums", '{BURST_MESSAGE}' AS msg
FROM anchors a JOIN logins l ON l.u = a.u AND l.t BETWEEN a.t AND a.t + {BURST_HOURS * 3600000}
GROUP BY 1, 2 HAVING count(*) >= 3"""

_PATTERN = f"""WITH ordered AS (
  SELECT user_id AS u, (epoch_us(ts) // 1000) AS t, event_type = 'click' AS login,
         lead(event_type) OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000),
           CASE event_type WHEN 'click' THEN 'login' ELSE event_type END) = 'click' AS followed
  FROM events),
chain AS (
  SELECT u, t, followed, lead(t, 2) OVER w AS t2, lead(t, 3) OVER w AS t3, lead(t, 4) OVER w AS t4
  FROM ordered WHERE login WINDOW w AS (PARTITION BY u ORDER BY t)),
runs AS (
  SELECT u, t, 3 AS len, t2 AS last FROM chain WHERE followed
  UNION ALL SELECT u, t, 4, t3 FROM chain WHERE followed
  UNION ALL SELECT u, t, 5, t4 FROM chain WHERE followed)
SELECT u AS "userId", t AS "firstLogin", len AS "loginNums", '{PATTERN_MESSAGE}' AS msg
FROM runs WHERE last - t < {PATTERN_HOURS * 3600000}"""

_ROUTE_COUNTS = f"WITH {_LINES} SELECT topic, count(*) AS lines FROM cleaned GROUP BY topic"

_REPORT_LINE = "'No' || rank || ': 商品ID=' || \"itemId\" || ' 浏览量=' || nums || chr(10)"

ORACLES: dict[str, str] = {
    "rate_more_products": f'WITH {_RATINGS}, {_COUNTS} SELECT "productId", count FROM counts',
    "rate_more_recently": f'WITH {_RATINGS}, {_MONTHLY} SELECT "productId", count, yearmonth FROM monthly',
    "rate_more_recently_sql": f'WITH {_RATINGS}, {_MONTHLY} SELECT "productId", count, yearmonth FROM monthly',
    "average_products": f'WITH {_RATINGS}, {_MEANS} SELECT "productId", mean AS avg FROM means',
    "hot_products_top_n": f"""WITH {_RATINGS}, {_MEANS}, {_MONTHLY}, {_PRODUCT_DETAIL},
top AS (SELECT *, row_number() OVER (ORDER BY yearmonth DESC, count DESC, "productId")::INT AS rank FROM monthly)
SELECT t.rank, t."productId", t.yearmonth, t.count, d.name, d.score AS "meanScore" FROM top t JOIN detail d USING ("productId") WHERE t.rank <= {TOP_N}""",
    "rate_more_top_n": f"""WITH {_RATINGS}, {_MEANS}, {_COUNTS}, {_PRODUCT_DETAIL},
top AS (SELECT *, row_number() OVER (ORDER BY count DESC, "productId")::INT AS rank FROM counts)
SELECT t.rank, t."productId", t.count, d.name, d.score AS "meanScore" FROM top t JOIN detail d USING ("productId") WHERE t.rank <= {TOP_N}""",
    "product_detail": f"WITH {_RATINGS}, {_MEANS}, {_PRODUCT_DETAIL} SELECT * FROM detail",
    "product_search": f"WITH {_RATINGS}, {_MEANS}, {_PRODUCT_DETAIL} SELECT * FROM detail WHERE regexp_matches(name, '{SEARCH}')",
    "product_search_indexed": f"WITH {_RATINGS}, {_MEANS}, {_PRODUCT_DETAIL} SELECT * FROM detail WHERE regexp_matches(name, '{SEARCH}')",
    "distinct_users": f'WITH {_RATINGS} SELECT DISTINCT "userId" FROM ratings',
    "distinct_products": f'WITH {_RATINGS} SELECT DISTINCT "productId" FROM ratings',
    "log_clean_lines": f"WITH {_LINES} SELECT topic, body FROM cleaned",
    "log_route_counts": _ROUTE_COUNTS,
    "log_rating_messages": f"""WITH {_LINES} SELECT 'logProcessor' AS key,
trim(split_part(value, 'PRODUCT_RATING_PREFIX:', 2), ' ' || chr(9)) AS body
FROM lines WHERE value LIKE '%PRODUCT_RATING_PREFIX:%'""",
    "log_clean_ratings": f"""WITH {_LINES} SELECT f1::INT AS "userId", f2::INT AS "productId", f3::DOUBLE AS score,
f4::BIGINT AS "timestamp" FROM checked WHERE good AND topic = 'recommender_rating'""",
    "log_clean_logins": f"""WITH {_LINES} SELECT f1::BIGINT AS "userId", f2 AS "eventType", f3::BIGINT AS ms
FROM checked WHERE good AND topic = 'recommender_login'""",
    "log_clean_views": f"""WITH {_LINES} SELECT f1::INT AS "itemId", f2 AS "eventType", f3::BIGINT AS seconds
FROM checked WHERE good AND topic = 'recommender_pv'""",
    "log_quarantine": f"WITH {_LINES} SELECT topic, body, value FROM checked WHERE NOT good",
    "recent_ratings": f"WITH {_RATINGS}, {_RECENT} SELECT * FROM recent",
    "rating_upsert": _UPSERT,
    "rating_upsert_incremental": _UPSERT,
    "stream_rating_state": """SELECT o_custkey::INT AS "userId", l_partkey::INT AS "productId",
       arg_max(ceil(l_quantity / 10)::DOUBLE, l_shipdate::VARCHAR || ' ' || ceil(l_quantity / 10)::INT::VARCHAR) AS score,
       min((epoch_us(l_shipdate) // 1000) // 1000)::BIGINT AS "timestamp"
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL""",
    "stream_late_views": f"""WITH views AS (
  SELECT {_ITEM}::INT AS item, ((epoch_us(ts) // 1000) // 1000)::BIGINT AS sec FROM events WHERE event_type = 'view'),
parts AS (
  SELECT item, sec, (sec - min(sec) OVER ()) * 3 // (max(sec) OVER () - min(sec) OVER () + 1) + (item % 7 = 0)::INT AS part FROM views),
marks AS (SELECT p.part, max(e.sec) - 1 AS watermark FROM (SELECT DISTINCT part FROM parts) p JOIN parts e ON e.part < p.part GROUP BY p.part)
SELECT item AS "itemId", sec AS seconds, watermark, count(*) AS views
FROM parts JOIN marks USING (part) WHERE sec < watermark GROUP BY ALL""",
    "log_arrival_stamp": f"""WITH {_LINES} SELECT 'logProcessor' AS "key",
       trim(split_part(value, 'PRODUCT_RATING_PREFIX:', 2), ' ' || chr(9)) AS body, true AS stamped
FROM lines WHERE strpos(value, 'PRODUCT_RATING_PREFIX:') > 0""",
    "load_products_file": """SELECT p_partkey::INT AS "productId", p_name AS name, 'img/' || p_partkey AS "imageUrl",
       p_type || '|' || p_brand AS categories, replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|') || '|' || p_brand AS tags
FROM part WHERE p_partkey % 50 <> 0""",
    "load_ratings_file": f"""{_RATING_FILE} SELECT "userId", "productId", score, "timestamp", count(*) AS lines
FROM file WHERE NOT odd GROUP BY ALL""",
    "load_quarantine": f"""{_RATING_FILE}, bad AS (
  SELECT 'ratings' AS file, "userId" || ',' || "productId" || ',' || CASE WHEN odd AND n <> 1 THEN 'none' ELSE score::VARCHAR END || ','
         || CASE WHEN odd AND n = 1 THEN '99999999999999999' ELSE "timestamp"::VARCHAR END AS line FROM file WHERE odd
  UNION ALL
  SELECT 'products', CASE WHEN p_partkey % 100 = 0 THEN '' ELSE 'x' || p_partkey END || '^' || p_name || '^1,2^ext^img/' || p_partkey || '^'
         || p_type || '|' || p_brand || '^' || replace(p_name, ' ', '|') || '|' || replace(p_type, ' ', '|') || '|' || p_brand
  FROM part WHERE p_partkey % 50 = 0)
SELECT file, line, count(*) AS lines FROM bad GROUP BY ALL""",
    "half_star_scores": "SELECT round((l_quantity / 5) / 2, 2) AS score, count(*) AS lines FROM lineitem GROUP BY 1",
    "user_hash_id": """WITH hashed AS (
  SELECT c_name, list_reduce(list_transform(string_split(c_name, ''), lambda c: unicode(c)::BIGINT),
                             lambda acc, c: (acc * 31 + c) % 4294967296) AS h FROM customer)
SELECT c_name AS username, (CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END)::INT AS "userId" FROM hashed""",
    "item_cooccurrence": f"""WITH {_RATINGS}, {_PAIR_COUNTS}
SELECT p AS product1, q AS product2, together AS cooccurrence, c1 AS count1, c2 AS count2 FROM scored WHERE p < q""",
    "itemcf_topk": f"WITH {_RATINGS}, {_PAIR_COUNTS} SELECT * FROM itemcf",
    "itemcf_topk_distinct": f"WITH {_RATINGS}, {_PAIR_COUNTS} SELECT * FROM itemcf".replace(
        "count(*) AS n FROM ratings", "1 AS n FROM ratings"
    ),
    "serve_itemcf": f"WITH {_RATINGS}, {_MEANS}, {_PRODUCT_DETAIL}, {_PAIR_COUNTS} "
    + _served("itemcf", "productId", "recProductId"),
    "content_tfidf": f'WITH {_TERMS} SELECT id AS "productId", term, tf, df, round(w, 9) AS weight FROM weighted',
    "content_similar": f"WITH {_CONTENT} SELECT * FROM content",
    "content_topk": f"WITH {_CONTENT} SELECT * FROM content WHERE rank <= {TOP_N}",
    "content_similar_hashed": f"WITH {_content(_HASHED_TERMS)} SELECT * FROM content",
    "content_hashed_terms": f'WITH {_HASHED_TERMS} SELECT id AS "productId", term AS bucket, tf, df, round(w, 9) AS weight FROM weighted',
    "content_hashed_vectors": f"""WITH {_HASHED_TERMS}
SELECT id AS "productId", sum(tf)::INT AS words, round(sqrt(sum(w * w)), 9) AS length FROM weighted GROUP BY 1""",
    "serve_content": f"WITH {_RATINGS}, {_MEANS}, {_PRODUCT_DETAIL}, {_CONTENT} "
    + _served("content", "productId", "recProductId"),
    "vector_similar": f"{_VECTORS} SELECT * FROM vectors",
    "vector_topk": f"{_VECTORS} SELECT * FROM vectors WHERE rank <= {TOP_N}",
    "vector_best_dots": f"""{_VECTORS} SELECT * FROM (
  SELECT a.id, row_number() OVER (PARTITION BY a.id ORDER BY round(list_dot_product(a.e, b.e), 9) DESC, b.id)::INT AS rank,
         b.id AS item, round(list_dot_product(a.e, b.e), 9) AS score
  FROM given a, given b WHERE round(list_dot_product(a.e, b.e), 9) > 0) WHERE rank <= {TOP_N}""",
    "damped_rmse_grid": f"{_DAMPED} SELECT damping, rmse FROM grid",
    "damped_best_of_grid": f"{_DAMPED} SELECT damping, rmse FROM grid ORDER BY rmse, damping LIMIT 1",
    "rmse_of_means": f"""WITH {_RATINGS}, {_MEANS}
SELECT round(sqrt(avg((score - mean) * (score - mean))), 9) AS rmse FROM ratings JOIN means USING ("productId")""",
    "realtime_candidates": f'{_REALTIME} SELECT "userId", rank, candidate FROM candidates',
    "realtime_scores": _REALTIME_ROWS,
    "hot_items_window": f"{_windows(600, 120)} SELECT * FROM hot",
    "hot_items_report": f"""{_windows(WIDE_WINDOW, WIDE_SLIDE)} SELECT "windowEnd",
'时间:' || strftime(to_timestamp("windowEnd") AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S') || '.0' || chr(10)
|| string_agg({_REPORT_LINE}, '' ORDER BY rank) || '================================' AS report
FROM hot GROUP BY "windowEnd\"""",
    "login_burst": _BURST,
    "login_pattern": _PATTERN,
    "stream_route_counts": _ROUTE_COUNTS,
    "stream_hot_items": f"{_windows(WIDE_WINDOW, WIDE_SLIDE)} SELECT * FROM hot",
    "stream_login_burst": _BURST,
    "stream_login_pattern": _PATTERN,
    "stream_recs": _REALTIME_ROWS,
    "serve_stream": f"{_REALTIME}, {_MEANS}, {_PRODUCT_DETAIL} " + _served("realtime", "userId", "productId"),
}
