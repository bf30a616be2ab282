"""Keyed tables on plain Parquet that streams update: a base, the deltas of micro-batches, merged when read.

A delta's version is (epoch, batch). A run claims its epoch by the name of its checkpoint: a restart from that checkpoint goes on with the same
epoch, a run with a new one gets the next, so batch ids that start at 0 again never hide behind older ones. A replayed batch
replaces its folder. Compaction folds base and deltas into a new base beside a running writer; a numbered pointer file, created whole, makes
it current, and readers go by the highest number. Only folders that no pointer needs are removed, by :meth:`KeyedTable.vacuum`.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shelfsense.sources.buckets import BUCKET, MAX_BUCKETS, bucket_of

BATCH = "batch"
#: Version of a row among all writes of its table; older first.
VERSION = "_version"
_BASE = (-1, -1)


def store_batch(rows: DataFrame, path: str, batch_id: int) -> None:
    """Store one batch of rows that have no key, in a folder of its own."""
    rows.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_all(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All rows of all batches."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).select(*schema.names)


class _Folder:
    """The few file operations a keyed table needs, on whatever file system Spark is given."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self.root = path.rstrip("/")
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def names(self, sub: str) -> list[str]:
        at = self._path(f"{self.root}/{sub}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def has(self, sub: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{sub}"))

    def read(self, sub: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/{sub}"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create(self, sub: str, value: dict) -> bool:
        """Write a whole file under a name nobody has taken: first beside it, then renamed. False if the name is taken."""
        hidden = self._path(f"{self.root}/.{uuid.uuid4().hex}")
        stream = self._fs.create(hidden, True)
        stream.write(bytearray(json.dumps(value).encode()))
        stream.close()
        target = self._path(f"{self.root}/{sub}")
        self._fs.mkdirs(target.getParent())
        done = not self._fs.exists(target) and self._fs.rename(hidden, target)
        if not done:
            self._fs.delete(hidden, False)
        return bool(done)

    def drop(self, sub: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{sub}"), True)


def last_write(keys: list[str], values: list[str]) -> Callable[[DataFrame], DataFrame]:
    """Merge rule: the newest write of a key replaces all earlier ones."""

    def merge(rows: DataFrame) -> DataFrame:
        newest = F.max_by(F.struct(*values), F.col(VERSION)).alias("_row")
        return rows.groupBy(*keys).agg(newest).select(*keys, *(F.col("_row").getField(v).alias(v) for v in values))

    return merge


class KeyedTable:
    """One live row per key, laid out by a hash bucket of ``by`` so that a few keys open few files.

    ``merge`` turns rows with a ``_version`` column (base rows have the oldest) into one row per key; it must be a fold, so that
    merging a merged base with later rows gives what merging all rows gives.
    """

    def __init__(
        self, spark: SparkSession, path: str, schema: T.StructType, by: str, buckets: int, merge: Callable[[DataFrame], DataFrame]
    ) -> None:
        if buckets > MAX_BUCKETS:
            raise ValueError(f"more than {MAX_BUCKETS} buckets")
        self.spark, self.path, self.schema, self.by, self.buckets, self.merge = spark, path.rstrip("/"), schema, by, buckets, merge
        self.folder = _Folder(spark, self.path)

    def claim(self, run: str) -> int:
        """Epoch of the run that keeps its progress under the name ``run``."""
        while True:
            taken = self.folder.names("epochs")
            for name in taken:
                if self.folder.read(f"epochs/{name}")["run"] == run:
                    return int(name)
            new = f"{len(taken):08d}"
            if self.folder.create(f"epochs/{new}", {"run": run}):
                return int(new)

    def _write(self, rows: DataFrame, sub: str) -> None:
        # The rebalance hint splits the bucket of a hot key over tasks.
        laid_out = rows.select(*self.schema.names, bucket_of(self.by, self.buckets).alias(BUCKET)).hint("rebalance", BUCKET)
        laid_out.write.mode("overwrite").partitionBy(BUCKET).parquet(f"{self.path}/{sub}")

    def load(self, rows: DataFrame) -> None:
        """Start a table from rows of one version."""
        self._base(self.merge(rows.withColumn(VERSION, self._version(*_BASE))), _BASE)

    def put(self, rows: DataFrame, epoch: int, batch_id: int) -> None:
        """Store one micro-batch, all of it or nothing; a replay replaces it. Rows of one batch have one version."""
        self._write(rows, f"delta/{epoch:08d}-{batch_id:012d}")

    @staticmethod
    def _version(epoch: int, batch: int) -> Column:
        return F.struct(F.lit(epoch).cast("long").alias("epoch"), F.lit(batch).cast("long").alias("batch"))

    def _pointer(self) -> dict:
        names = self.folder.names("current")
        return self.folder.read(f"current/{names[-1]}") if names else {"base": None, "until": list(_BASE), "number": -1}

    def _deltas(self, until: list[int]) -> list[tuple[list[int], str]]:
        """Finished deltas behind ``until``, oldest first."""
        found = []
        for name in self.folder.names("delta"):
            version = [int(x) for x in name.split("-")]
            if version > until and self.folder.has(f"delta/{name}/_SUCCESS"):
                found.append((version, name))
        return found

    def _open(self, sub: str, version: tuple[int, int], hit: list[int] | None) -> DataFrame:
        kind = T.StructType([*self.schema.fields, T.StructField(BUCKET, T.IntegerType())])
        rows = self.spark.read.schema(kind).parquet(f"{self.path}/{sub}")
        if hit is not None:
            rows = rows.where(F.col(BUCKET).isin(hit))
        return rows.select(*self.schema.names, self._version(*version).alias(VERSION))

    def _rows(self, hit: list[int] | None = None) -> tuple[DataFrame, list[int], int]:
        pointer = self._pointer()
        deltas = self._deltas(pointer["until"])
        parts = [self._open(pointer["base"], _BASE, hit)] if pointer["base"] else []
        parts += [self._open(f"delta/{name}", tuple(version), hit) for version, name in deltas]
        if not parts:
            parts = [self.spark.createDataFrame([], self.schema).withColumn(VERSION, self._version(*_BASE))]
        rows = parts[0]
        for part in parts[1:]:
            rows = rows.unionByName(part)
        return rows, deltas[-1][0] if deltas else pointer["until"], pointer["number"]

    def read(self, keys: DataFrame | None = None) -> DataFrame:
        """The live rows; with ``keys`` only those whose ``by`` column is among theirs, and only their buckets are opened.

        Only bucket numbers, at most as many as there are buckets, come to the driver.
        """
        if keys is None:
            return self.merge(self._rows()[0]).select(*self.schema.names)
        wanted = keys.select(self.by).distinct()
        hit = [row[0] for row in wanted.select(bucket_of(self.by, self.buckets)).distinct().collect()]
        return self.merge(self._rows(hit)[0].join(wanted, self.by, "left_semi")).select(*self.schema.names)

    def _base(self, rows: DataFrame, until: tuple[int, int] | list[int], after: int = -1) -> bool:
        sub = f"base/{uuid.uuid4().hex}"
        self._write(rows, sub)
        number = after + 1
        return self.folder.create(f"current/{number:012d}", {"base": sub, "until": list(until), "number": number})

    def compact(self) -> bool:
        """Fold all finished deltas into a new base. Batches written meanwhile stay deltas; False if another compaction was faster."""
        rows, until, number = self._rows()
        return self._base(self.merge(rows), until, number)

    def deltas(self) -> int:
        """Deltas a reader has to merge with the base."""
        return len(self._deltas(self._pointer()["until"]))

    def vacuum(self, keep: int = 2) -> None:
        """Remove bases and deltas that the newest ``keep`` pointers do not need; readers that began under older ones must have ended."""
        names = self.folder.names("current")
        pointers = [self.folder.read(f"current/{n}") for n in names]
        for pointer in pointers[:-keep]:
            self.folder.drop(pointer["base"])
        kept = pointers[-keep:]
        for name in self.folder.names("delta"):
            if kept and [int(x) for x in name.split("-")] <= kept[0]["until"]:
                self.folder.drop(f"delta/{name}")
        for name in names[:-keep]:
            self.folder.drop(f"current/{name}")
