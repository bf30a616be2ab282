"""Session set-up and the shared folder for intermediate tables."""

from __future__ import annotations

import gc
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_local_dir: dict[str, str] = {}
_shipped: set[str] = set()


def configure(spark: SparkSession) -> SparkSession:
    """Runtime settings every job relies on: UTC calendar, adaptive re-planning, skew splitting."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    return spark


def build_session(app: str = "shelfsense", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return ship(configure(builder.getOrCreate()))


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once per application; they may have been started anywhere."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        package = os.path.dirname(os.path.abspath(__file__))
        root, name = os.path.split(package)
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="shelfsense-"), name), "zip", root, name)
        sc.addPyFile(archive)  # Spark itself carries the file to every executor
        _shipped.add(sc.applicationId)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the one named by ``spark.checkpoint.dir``.

    Only a local master may go without that setting; it then gets a temporary folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = _local_dir.setdefault(sc.applicationId, tempfile.mkdtemp(prefix="shelfsense-"))
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as a Parquet table in the shared folder and read it back.

    Cuts the lineage, survives lost executors and is computed once however often it is read.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.mode("error").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Remove shuffle files and cached blocks that nothing refers to any more.

    Spark removes them once the driver's garbage collector has found them, which in a driver with little to do may be after the job.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()
