"""Helpers of the corpus operators: tables, bounded text slices, words, shingles, folds."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Lower-cases A-Z in UTF-8 and leaves every other byte alone.
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_S1, _S2, _S3 = np.uint64(30), np.uint64(27), np.uint64(31)

#: UTF-8 bytes of text that a Python task turns into arrays at a time.
SLICE_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold_of(column: str, n: int) -> F.Column:
    """crc32 of the id, written as text, modulo ``n``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def schema_of(docs: DataFrame, keep: list[str], more: str) -> T.StructType:
    """The ``keep`` columns of ``docs`` followed by the columns that ``more`` declares."""
    return T.StructType([docs.schema[c] for c in keep] + T.StructType.fromDDL(more).fields)


#: Rows of an Arrow batch between Spark and Python; texts are long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def small_batches(rows: DataFrame) -> DataFrame:
    """The same rows; the session's Arrow batches are set to ``BATCH_ROWS`` from here on."""
    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return rows


def give_back() -> None:
    """Return to the system what Arrow and the C library keep of freed memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same function for ``mapInArrow``; a task ends with :func:`give_back`.

    Spark keeps Python workers for later tasks, so what they hold idle lies beside the memory of all later stages.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return task


def slices(batches: Iterable[pa.RecordBatch], text: str, budget: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Cut Arrow batches into slices of at most ``budget`` bytes of text, one row at least, with the texts as a list.

    A slice bounds what a task unfolds at a time, however many rows a batch holds. Nulls stay None.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + budget, side="right")))
            part = batch.slice(at, to - at)
            yield part, column.slice(at, to - at).to_pylist()
            at = to


def words(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased, as UTF-8 (``bytes.split`` cuts at exactly these bytes)."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split() if text else []


def plain_words(text: str | None) -> list[bytes]:
    """The same words as they stand."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of unsigned 64-bit values."""
    h = (h ^ (h >> _S1)) * _MIX[1]
    h = (h ^ (h >> _S2)) * _MIX[2]
    return h ^ (h >> _S3)


def word_hashes(ws: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))


def windows(hashes: np.ndarray, width: int) -> np.ndarray:
    """One 64-bit hash for every run of ``width`` neighbouring words; none if there are fewer words."""
    n = len(hashes) - width + 1
    if n < 1:
        return np.empty(0, dtype=np.uint64)
    out = mix(hashes[:n] + _MIX[0])
    for k in range(1, width):
        out = mix(out * _MIX[0] + hashes[k : k + n])
    return out


def shingle_set(ws: list[bytes], width: int = 5) -> np.ndarray:
    """Sorted distinct hashes of the ``width``-word shingles; fewer words make one shingle, no words none."""
    if not ws:
        return np.empty(0, dtype=np.uint64)
    hashes = word_hashes(ws)
    if len(ws) < width:
        return windows(hashes, len(ws)) ^ np.uint64(len(ws))
    return np.unique(windows(hashes, width))


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
