"""Approximate nearest neighbours by cross-polytope hashing with multiprobe.

A table rotates a unit vector by three rounds of random signs and fast Hadamard transform and takes the nearest signed axis as bucket. Queries
also probe the next axes of each table. Buckets are cut into blocks of bounded size by counts that are known
beforehand, so that a hot bucket is many blocks; a block of queries meets a block of vectors as one matrix product, and only its best rows
leave. Equal vectors are one representative until the end. A query that met few vectors is compared with all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.common import small_batches, table
from shelfsense.session import materialise

TABLES = 12
PROBES = 10
BLOCK = 1024
QUERY_BLOCK = 256
#: A query whose buckets gave fewer vectors than this times the length kept for the final measure is compared with all vectors.
FEW = 4
SEED = 20
_ALL = 1 << 30


def rotations(dim: int, tables: int) -> np.ndarray:
    """Random signs: (table, round, padded dimension)."""
    width = 1 << max(1, int(np.ceil(np.log2(max(2, dim)))))
    return np.random.default_rng(SEED).choice([-1.0, 1.0], size=(tables, 3, width))


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep lengths."""
    n, width = x.shape
    h = 1
    while h < width:
        x = x.reshape(n, -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, width)
        h *= 2
    return x / np.sqrt(width)


def axes(x: np.ndarray, signs: np.ndarray, probes: int) -> np.ndarray:
    """Buckets (axis, doubled, plus one if negative) of the rows, nearest axis first."""
    y = np.zeros((len(x), signs.shape[1]))
    y[:, : x.shape[1]] = x
    for s in signs:
        y = hadamard(y * s)
    both = np.stack([y, -y], axis=2).reshape(len(y), -1)
    order = np.argsort(-both, axis=1, kind="stable")[:, :probes]
    return order


def usable(vectors: DataFrame) -> DataFrame:
    """(id, v, dim) of vectors that take part: not null, not zero, all components finite. One row per id."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + F.abs(x))
    return (
        vectors.select(F.col("vec_id").alias("id"), v.alias("v"))
        .where(F.col("id").isNotNull() & F.col("v").isNotNull())
        .where(~bad)
        .where(norm > 0)
        .withColumn("dim", F.size("v"))
        .dropDuplicates(["id"])
    )


def _hashed(rows: DataFrame, tables: int, probes: int) -> DataFrame:
    """(dim, table, bucket, id, v) for each of the nearest ``probes`` axes in every table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.asarray(batch.column(2))
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                x = np.asarray(part.column(1).flatten(), dtype=float).reshape(part.num_rows, int(dim))
                x = x / np.abs(x).max(axis=1, keepdims=True)
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                signs = rotations(int(dim), tables)
                for t in range(tables):
                    for lot in range(0, len(x), 4096):
                        found = axes(x[lot : lot + 4096], signs[t], probes).astype(np.int32)
                        for k in range(found.shape[1]):
                            own = part.slice(lot, 4096)
                            n = own.num_rows
                            yield pa.RecordBatch.from_arrays(
                                [pa.array(np.full(n, dim, np.int32)), pa.array(np.full(n, t, np.int32)), pa.array(found[:, k]), own.column(0).cast(pa.int64()), own.column(1)],
                                names=["dim", "table", "bucket", "id", "v"],
                            )

    return small_batches(rows.select("id", "v", "dim")).mapInArrow(run, "dim int, table int, bucket int, id long, v array<double>")


def _blocks(rows: DataFrame, size: int) -> DataFrame:
    """Rows of a bucket gathered in blocks of about ``size``. The counts are tables x buckets x dimensions rows: broadcast."""
    place = ["dim", "table", "bucket"]
    counts = rows.groupBy(*place).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    return (
        rows.join(F.broadcast(counts), place)
        .withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
        .groupBy(*place, "block")
        .agg(F.collect_list("id").alias("ids"), F.flatten(F.collect_list("v")).alias("vs"))
    )


def _best(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of every pair of blocks: (query, rep, score)."""
    pairs = queries.select("dim", "table", "bucket", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs")).join(vectors.drop("block"), ["dim", "table", "bucket"])

    def unit(flat: np.ndarray, n: int) -> np.ndarray:
        x = flat.reshape(n, -1)
        x = x / np.abs(x).max(axis=1, keepdims=True)
        return x / np.linalg.norm(x, axis=1, keepdims=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                q_ids, q_vs, ids, vs = (np.asarray(batch.column(c)[row].values) for c in ("q_ids", "q_vs", "ids", "vs"))
                order = np.argsort(ids, kind="stable")
                ids, x = ids[order], unit(vs, len(ids))[order]
                score = unit(q_vs, len(q_ids)) @ x.T
                score = np.round(score, 12)  # equal measures stay equal, whatever block computes them
                top = np.argsort(-score, axis=1, kind="stable")[:, :k]
                at = np.repeat(np.arange(len(q_ids)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[at]), pa.array(ids[top.ravel()]), pa.array(score[at, top.ravel()])], names=["query_id", "rep", "near"])

    return small_batches(pairs.select("q_ids", "q_vs", "ids", "vs")).mapInArrow(run, "query_id long, rep long, near double")


def neighbours(vectors: DataFrame, is_query: F.Column, k: int = 5, tables: int = TABLES, probes: int = PROBES) -> DataFrame:
    """The ``k`` nearest found of each query by cosine: (query_id, rank, vec_id, score).

    ``vectors`` has vec_id and embedding; ``is_query`` is a condition on ``vec_id``. A query finds every other row. Ties go to the smaller
    vec_id. The measure is computed once more, in double precision, on the original vectors of the winners. No list is shorter than
    ``k`` while there are candidates: queries with few vectors in their buckets get the exact list.
    The final ranks go by that measure.
    Defined cases: vectors that are null, zero, empty or hold a null or non-finite component take no part; so do null ids; vectors
    of another length are never neighbours; rows with one vec_id count once; an empty table gives no rows; further columns are not read.
    """
    rows = materialise(usable(vectors), "ann-vectors")
    # Hashing and block products order vectors by a rounded measure; twice the list goes on to the exact one.
    wide = 2 * (k + 1)
    # Equal vectors share a representative, the smallest id; k + 1 members reach every list, the query's own id included.
    same = rows.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    member = materialise(
        same.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))).where(F.col("nth") <= k + 1), "ann-members"
    )
    reps = member.where("nth = 1").select(F.col("id").alias("rep"), "h1", "h2")
    members = member.join(reps, ["h1", "h2"]).select("rep", "id")
    base = rows.join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    asking = rows.withColumnRenamed("id", "vec_id").where(is_query).withColumnRenamed("vec_id", "id")
    held = materialise(_hashed(base, tables, 1), "ann-held")
    order = Window.partitionBy("query_id").orderBy(F.desc("near"), "rep")

    def best(queries: DataFrame, blocks: DataFrame) -> DataFrame:
        met = _best(_blocks(queries, QUERY_BLOCK), blocks, wide).distinct().withColumn("met", F.count("*").over(Window.partitionBy("query_id")))
        return met.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= wide).select("query_id", "rep", "met")

    found = materialise(best(_hashed(asking, tables, probes), _blocks(held, BLOCK)), "ann-found").where(F.col("met") >= FEW * wide)
    # All axes of one table hold every vector once: exact, and in blocks.
    short = materialise(asking.join(found.select(F.col("query_id").alias("id")), "id", "left_anti"), "ann-short")
    if not short.isEmpty():
        found = found.union(best(_hashed(short, 1, _ALL), _blocks(held.where("table = 0"), BLOCK)))
    found = found.drop("met").join(members, "rep").where("id <> query_id")

    def dot(a: str, b: str) -> F.Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    cosine = dot("qv", "v") / (F.sqrt(dot("qv", "qv")) * F.sqrt(dot("v", "v")))
    # Squares of very large or small components leave the range of doubles; such vectors are scaled by their largest component.
    largest = F.array_max(F.transform("v", F.abs))
    safe = rows.select("id", F.when(largest.between(1e-100, 1e100), F.col("v")).otherwise(F.transform("v", lambda x: x / largest)).alias("v"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.join(safe.select(F.col("id").alias("query_id"), F.col("v").alias("qv")), "query_id")
        .join(safe, "id")
        .select("query_id", F.col("id").alias("vec_id"), cosine.alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
