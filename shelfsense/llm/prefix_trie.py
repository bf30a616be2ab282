"""Conversation prefix trie by Spark SQL's ROLLUP over positional turn-id columns.

A conversation is cut into blocks of ``WIDTH`` turns. A block is one row: the node that the prior block ended in, and the ids of its turns by position. One ROLLUP
over the position columns, grouped by that node, aggregates every prefix in every block at once; ``grouping_id`` tells its
depth. What a node's subtree holds needs no walk: a node belongs to its smallest member, a conversation owns its nodes from one depth on, and
all sums over subtrees are sums over members. The first ROLLUP finds that depth for every conversation, the second one adds up.

Digests of turns and of prefixes have 120 bits; different texts with equal digests are taken to be impossible.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.common import table
from shelfsense.session import materialise

#: Turns of a block, one ROLLUP column each.
WIDTH = 8
#: Rows of one conversation that are put in order together; longer ones are cut by turn number or by block first.
_STRETCH = 4096
#: Ids that a list of members keeps together while it is digested.
_IDS = 256


def _running(rows: DataFrame, key: str, stretch: Column, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with the sums over all earlier rows of their key. Rows of a key are ordered by stretch first, so that no task orders a long key alone."""
    rows = rows.withColumn("_stretch", stretch)
    inside = Window.partitionBy(key, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.select("*", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(f"_{n}") for n, x in sums.items()))
    earlier = Window.partitionBy(key).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy(key, "_stretch")
        .agg(*(F.sum(x).alias(f"_sum_{n}") for n, x in sums.items()))
        .select(key, "_stretch", *(F.sum(f"_sum_{n}").over(earlier).alias(f"_base_{n}") for n in sums))
        .where(F.col(f"_base_{next(iter(sums))}").isNotNull())
    )
    total = [(F.col(f"_{n}") + F.coalesce(f"_base_{n}", F.lit(0))).alias(n) for n in sums]
    return own.join(base, [key, "_stretch"], "left").select(*(c for c in rows.columns if c != "_stretch"), *total)


def _digest(text: Column) -> Column:
    """Three numbers of 40 bits each."""
    h = F.sha1(text)
    part = lambda k: F.conv(F.substring(h, 1 + 10 * k, 10), 16, 10).cast("long")
    return F.struct(*(part(k).alias(f"d{k}") for k in range(3)))


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos from 1, turn_id, chars): turns in order of ``turn``, null first; equal turns in order of their digests.

    Null role and text count as empty; rows without a conv_id take no part.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        _digest(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_id"),
        F.length(text).cast("long").alias("chars"),
    )
    turns = materialise(turns, "turns")
    # A shift keeps the order of the turn numbers; nulls come first.
    stretch = F.coalesce(F.shiftright("turn", 12), F.lit(-(2**62)))
    order = [F.col("turn").asc_nulls_first(), F.col("turn_id")]
    return _running(turns, "conv_id", stretch, order, {"before": F.lit(1)}).select(
        "conv_id", (F.col("before") + 1).cast("long").alias("pos"), "turn_id", "chars"
    )


def rebuilt(turns: DataFrame, every: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of another one: conversation c takes the first h turns of c - c % ``every``,
    h = crc32(c as text) % ``most``, in place of its own first h. Returns the turns and one row (conv_id, len) per conversation."""
    h = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(most))
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    heads = (
        turns.where((F.col("conv_id") % every == 0) & (F.col("pos") < most))
        .groupBy(F.col("conv_id").alias("head"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "turn_id", "chars"))).alias("first"))
    )
    convs = (
        sizes.select("conv_id", "own", h.alias("h"), (F.col("conv_id") - F.col("conv_id") % every).alias("head"))
        .join(heads, "head", "left")
        .select("conv_id", "own", "h", F.slice("first", 1, F.col("h").cast("int")).alias("first"))
        .select("*", F.when(F.col("first").isNull(), 0).otherwise(F.size("first")).cast("long").alias("taken"))
    )
    convs = materialise(convs, "rebuilt")
    given = convs.select("conv_id", F.explode("first").alias("t")).select("conv_id", "t.pos", "t.turn_id", "t.chars")
    own = (
        turns.join(convs.select("conv_id", "h", "taken"), "conv_id")
        .where(F.col("pos") > F.col("h"))
        .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "turn_id", "chars")
    )
    return given.unionByName(own), convs.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("own") - F.col("h"))).alias("len"))


def _blocks(turns: DataFrame, convs: DataFrame, width: int) -> DataFrame:
    """One row per conversation and block: (conv_id, len, block, node, chars before, t1, t2, ...), one empty row for a conversation without turns.

    ``t`` holds a turn's id and the characters of the prefix that ends there; ``node`` is the sum of the digests of all earlier blocks.
    """
    place = (F.col("pos") - 1) % width
    at = lambda c, k: F.max(F.when(place == k, F.col(c)))
    rows = turns.groupBy("conv_id", F.floor((F.col("pos") - 1) / width).alias("block")).agg(
        *(at("turn_id", k).alias(f"i{k + 1}") for k in range(width)), *(at("chars", k).alias(f"n{k + 1}") for k in range(width))
    )
    own = _digest(F.concat_ws(",", "block", *(f"i{k + 1}.d{j}" for k in range(width) for j in range(3))))
    rows = materialise(rows.withColumn("own", own), "turn-blocks")
    chars = sum((F.coalesce(f"n{k + 1}", F.lit(0)) for k in range(width)), F.lit(0).cast("long"))
    sums = {f"k{j}": F.col(f"own.d{j}") for j in range(3)} | {"chars": chars}
    rows = _running(rows, "conv_id", F.floor(F.col("block") / _STRETCH), [F.col("block")], sums)
    until, columns = F.col("chars"), []
    for k in range(1, width + 1):
        until = until + F.coalesce(f"n{k}", F.lit(0))
        columns.append(F.when(F.col(f"n{k}").isNotNull(), F.struct(f"i{k}.d0", f"i{k}.d1", f"i{k}.d2", until.alias("chars"))).alias(f"t{k}"))
    node = F.struct(*(F.coalesce(f"k{j}", F.lit(0)).cast("long").alias(f"d{j}") for j in range(3)))
    following = F.struct(*((F.coalesce(f"k{j}", F.lit(0)) + F.col(f"own.d{j}")).cast("long").alias(f"d{j}") for j in range(3)))
    rows = rows.join(convs, "conv_id").select("conv_id", "len", "block", node.alias("node"), following.alias("next"), F.col("chars").alias("chars0"), *columns)
    kind = rows.schema
    empty = convs.where("len = 0").select(
        *(
            F.col(f.name) if f.name in ("conv_id", "len") else F.lit(0).cast("long").alias(f.name) if f.name in ("block", "chars0")
            else F.struct(*(F.lit(0).cast("long").alias(f"d{j}") for j in range(3))).alias(f.name) if f.name in ("node", "next")
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in kind
        )
    )
    return rows.unionByName(empty)


def _rollup(blocks: DataFrame, width: int, measures: str) -> DataFrame:
    """One row per node: all prefixes of all blocks, with ``depth`` and the measures; the empty prefix counts in the first block only."""
    names = [f"t{k}" for k in range(1, width + 1)]
    # Each column that is rolled up sets its bit of grouping_id; the last position stands for two columns.
    local = " ".join(f"WHEN {(2 << (width - k)) - 1 if k < width else 0} THEN {k}" for k in range(width + 1))
    rows = blocks.sparkSession.sql(
        f"SELECT block, node, next, chars0, {', '.join(names)}, CASE grouping_id() {local} END AS k, {measures} "
        f"FROM {{blocks}} GROUP BY block, node, chars0, ROLLUP ({', '.join(names[:-1])}, ({names[-1]}, next))",
        blocks=blocks,
    )
    last = F.coalesce(*(F.when(F.col("k") == k, F.col(f"t{k}")) for k in range(1, width + 1)))
    return rows.where(F.when(F.col("k") == 0, F.col("block") == 0).otherwise(last.isNotNull())).withColumn(
        "depth", (F.col("block") * width + F.col("k")).cast("long")
    )


def _before(width: int) -> Column:
    """Characters of the node's prefix without its last turn; 0 for the root."""
    earlier = [F.when(F.col("k") == k, F.col(f"t{k - 1}.chars")) for k in range(2, width + 1)]
    return F.coalesce(*earlier, F.when(F.col("k") == 1, F.col("chars0")), F.lit(0).cast("long"))


def _name(width: int, shift: int = 0) -> Column:
    """Name of the node ``shift`` turns above a row: block, prior block's node and the turns behind it; a full block names the next one."""
    k = F.col("k") - shift
    of = lambda node: [f"{node}.d{j}" for j in range(3)]
    turns = [F.when(k >= n, F.col(f"t{n}.d{j}")) for n in range(1, width) for j in range(3)]
    inside = F.concat_ws(",", "block", *of("node"), *turns)
    return F.sha1(F.when(k == width, F.concat_ws(",", F.col("block") + 1, *of("next"))).otherwise(inside))


def _ends(members: DataFrame) -> DataFrame:
    """(name, ends_sha256): SHA-256 of the members' ids in ascending order, joined by commas.

    Ids are joined in short runs first; a task then streams the runs of a node through the digest and holds one batch of runs.
    """
    runs = (
        members.groupBy("name", F.floor(F.col("conv_id") / _IDS).alias("run"))
        .agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
        .repartition("name")
        .sortWithinPartitions("name", "run")
        .select("name", "ids")
    )

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, hashlib.sha256()
        for batch in batches:
            out: list[tuple[str, str]] = []
            for other, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if other == name:
                    state.update(b"," + ids.encode())
                    continue
                if name is not None:
                    out.append((name, state.hexdigest()))
                name, state = other, hashlib.sha256(ids.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["name", "ends_sha256"])
        if name is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (name, state.hexdigest())], names=["name", "ends_sha256"])

    return runs.mapInArrow(digest, "name string, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame, width: int = WIDTH) -> DataFrame:
    """Nodes of the prefix trie of ``turns`` (conv_id, pos from 1 without gaps, turn_id, chars) and ``convs`` (conv_id, len), one row each.

    A node's text is turn ``depth`` of conversation ``conv_id``; (conv_id, depth) is its key.
    Defined cases: conversations without turns are members of the root; equal conversations share all nodes; an empty table has no node; repeated
    turns are turns; conversations of any length go on in further blocks.
    """
    blocks = materialise(_blocks(turns, convs, width), "trie-blocks")
    first = _rollup(blocks, width, "min(conv_id) AS conv_id, max(len) AS longest")
    own = (
        first.select("conv_id", "depth", _before(width).alias("before"), (F.col("longest") == F.col("depth")).alias("leaf"))
        .groupBy("conv_id")
        .agg(F.min("depth").alias("own_from"), F.min("before").alias("shared"), F.max("leaf").cast("long").alias("leaf"))
    )
    own = materialise(own, "trie-owners")
    # A copy of a smaller conversation owns nothing and shares all its characters.
    whole = blocks.where(F.col("len") <= (F.col("block") + 1) * width).select(
        "conv_id", F.greatest(F.col("chars0"), *(F.coalesce(f"t{k}.chars", F.lit(0)) for k in range(1, width + 1))).alias("all_chars")
    )
    marks = whole.join(own, "conv_id", "left").select(
        "conv_id", F.coalesce("own_from", F.lit(2**62)).alias("own_from"), F.coalesce("shared", "all_chars").alias("shared"), F.coalesce("leaf", F.lit(0)).alias("leaf")
    )
    marked = blocks.join(materialise(marks, "trie-marks"), "conv_id")
    measures = (
        "min(conv_id) AS conv_id, count(*) AS n_convs, min(own_from) AS own_from, sum(leaf) AS n_leaves, "
        "sum(shared) AS sum_shared, min(shared) AS least_shared"
    )
    nodes = _rollup(marked, width, measures).select(
        _name(width).alias("name"),
        F.when(F.col("depth") > 0, F.when((F.col("k") > 0), _name(width, 1))).alias("parent"),
        "conv_id",
        "depth",
        "own_from",
        "n_convs",
        "n_leaves",
        # Every member but the smallest saves what it shares with smaller ones, from this node's last text on.
        (F.col("sum_shared") - F.col("least_shared") - (F.col("n_convs") - 1) * _before(width)).alias("saved_tokens"),
    )
    nodes = materialise(nodes, "trie-nodes")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("name")).agg(F.count("*").alias("n_children"))
    # A node that its conversation owns from a smaller depth on has a parent of the same conversation; the others look theirs up.
    above = nodes.select(F.col("name").alias("parent"), F.col("conv_id").alias("above"))
    branches = nodes.where((F.col("depth") > 0) & (F.col("own_from") == F.col("depth"))).select("conv_id", "depth", "parent")
    branches = branches.join(above, "parent").select("conv_id", "depth", "above")
    full = F.col("len") == (F.col("block") + 1) * width
    members = blocks.where((F.col("len") > F.col("block") * width) & (F.col("len") <= (F.col("block") + 1) * width) | (F.col("len") == 0))
    members = members.withColumn("k", F.when(F.col("len") == 0, 0).when(full, width).otherwise(F.col("len") % width)).select("conv_id", _name(width).alias("name"))
    return (
        nodes.join(children, "name", "left")
        .join(_ends(members), "name", "left")
        .join(branches, ["conv_id", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            F.when(F.col("depth") > 0, F.coalesce("above", "conv_id")).alias("parent_conv_id"),
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            "n_leaves",
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = materialise(turns_of(table(spark, sf_dir, "conversations")), "ordered-turns")
    return trie(*rebuilt(turns))


ORACLE = r"""
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS p,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS head,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
           lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
             lambda x, y: xor(x >> 1, 3988292384::BIGINT * (x & 1)))), 4294967295::BIGINT) % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)),
parts AS (
  SELECT c.conv_id, 0 AS part, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.head AND t.p <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.p, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.p > c.h),
built AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, p) AS d, role, text FROM parts),
lists AS (
  SELECT c.conv_id, coalesce(l.ids, []) AS ids, coalesce(l.n, []) AS n
  FROM convs c LEFT JOIN (
    SELECT conv_id, list(length(role)::VARCHAR || ':' || role || text ORDER BY d) AS ids, list(length(text) ORDER BY d) AS n
    FROM built GROUP BY conv_id) l ON l.conv_id = c.conv_id),
paths AS (
  SELECT conv_id, d, list_slice(ids, 1, d) AS path, len(ids) AS size, CASE WHEN d > 0 THEN n[d] ELSE 0 END AS chars
  FROM lists, unnest(generate_series(0, len(ids))) AS u(d)),
nodes AS (
  SELECT d, path, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
  FROM paths GROUP BY d, path),
kids AS (
  SELECT d - 1 AS d, list_slice(path, 1, d - 1) AS path, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY ALL),
below AS (
  SELECT a AS d, list_slice(n.path, 1, a) AS path, sum((n_convs - 1) * chars) AS saved,
         count(*) FILTER (WHERE k.d IS NULL) AS leaves
  FROM nodes n LEFT JOIN kids k ON k.d = n.d AND k.path = n.path, unnest(generate_series(0, n.d)) AS u(a)
  GROUP BY a, list_slice(n.path, 1, a))
SELECT n.conv_id, n.d AS depth, up.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children,
       b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n JOIN below b ON b.d = n.d AND b.path = n.path
LEFT JOIN kids k ON k.d = n.d AND k.path = n.path
LEFT JOIN nodes up ON up.d = n.d - 1 AND up.path = list_slice(n.path, 1, n.d - 1)
"""
