"""What Python workers keep after the stages of the pipeline, in a Spark application of its own."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SCRIPT = r"""
import random, re, sys, tempfile
import psutil, pyarrow as pa
import corpus_pipeline
from shelfsense.llm import packing
from shelfsense.session import build_session

def left(batches):
    import ctypes, re
    import pyarrow as pa
    def held():
        return int(re.search(r"RssAnon:\s+(\d+)", open("/proc/self/status").read())[1]) // 1024
    for _ in batches:
        before = held()
        pa.default_memory_pool().release_unused()
        ctypes.CDLL(None).malloc_trim(0)
        yield pa.RecordBatch.from_pydict({"mb": [before - held()]})

spark = build_session("worker-memory", "local[1]", spark__sql__shuffle__partitions="2", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("ERROR")
rng = random.Random(5)
word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7))
long = [(k, " ".join(word() for _ in range(2500))) for k in range(300)]
docs = spark.createDataFrame(pa.table({"doc_id": [r[0] for r in long], "text": [r[1] for r in long]})).coalesce(1)
assert packing.pack(docs, packing.vocabulary()).agg({"length": "sum"}).first()[0] > 0
print("left", spark.range(1).coalesce(1).mapInArrow(left, "mb long").first()[0])

folder = tempfile.mkdtemp(prefix="worker-memory-")
pool = [word() for _ in range(300)]
rows = [(k, " ".join(rng.choices(pool, k=40)) + (" frimble gorp frimbled" if k % 3 == 0 else "")) for k in range(90)]
spark.createDataFrame(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]})).write.parquet(folder + "/documents.parquet")
spark.createDataFrame(pa.table({"doc_id": list(range(90)), "quality": [k % 2 for k in range(90)], "toxic": [int(k % 3 == 0) for k in range(90)]})).write.parquet(folder + "/labels.parquet")
print("pieces", corpus_pipeline.run(spark, folder).count())
mine = [p for p in psutil.Process().children(recursive=True) if "pyspark.daemon" in " ".join(p.cmdline())]
print("daemons", sum(p.ppid() not in {q.pid for q in mine} for p in mine))
spark.stop()
"""


def test_workers_keep_little_after_the_pipeline():
    env = os.environ | {"PYTHONPATH": ROOT, "PYSPARK_PYTHON": sys.executable}
    done = subprocess.run([sys.executable, "-c", SCRIPT], env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    said = dict(line.split() for line in done.stdout.splitlines() if line.startswith(("left ", "pieces ", "daemons ")))
    # The worker has given back what it does not use, and no step starts workers of a second kind.
    assert int(said["left"]) < 20
    assert int(said["pieces"]) > 0
    assert int(said["daemons"]) == 1
