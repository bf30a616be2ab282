"""Best-fit packing into few sequences: Martello and Toth's dominance reduction, then best fit for what it leaves.

Pieces of one length are alike, so the whole instance is a histogram with one number per length, however many documents there are. The plan is made
on that histogram: it says which lengths share a sequence and how often. Every piece has a rank among the pieces of its length (rank
in its partition plus the counts of the partitions before), and the plan turns length and rank into a place. No token is moved for it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.chunks import ENCODE_BYTES
from shelfsense.llm.common import slices, small_batches, table
from shelfsense.llm.packing import tokenizer
from shelfsense.session import materialise

WINDOW = 2048
END_ID = 0

#: Lengths that share a sequence, longest first, with the copies of each.
Pattern = tuple[tuple[int, int], ...]


def _dominating(i: int, left: np.ndarray, capacity: int) -> tuple[int, ...] | None:
    """Lengths that dominate every way to fill a sequence with ``i``; None if none is found.

    A set dominates another one if the other's lengths can be dealt to the set's, each share no longer than the length it is dealt to; then some best
    packing uses the set. Tried are ``i`` alone, with one and with two others.
    """
    room = capacity - i
    others = left.copy()
    others[i] -= 1
    fits = np.flatnonzero(others[: room + 1])
    if not len(fits):
        return (i,)
    j = int(fits[-1])
    small = [int(s) for s in fits[:3] for _ in range(min(3, int(others[s])))][:3]
    if i + j == capacity or len(small) < 2 or small[0] + small[1] > room:
        return i, j  # a full sequence, or only one other ever fits
    if len(small) > 2 and sum(small) <= room:
        return None
    # Two others at most. The best two together against the longest alone:
    partner = fits[np.searchsorted(fits, room - fits, side="right") - 1]
    usable = (room - fits >= fits[0]) & ((partner != fits) | (others[fits] > 1))
    lower = np.searchsorted(fits, np.minimum(room - fits, fits - 1), side="right") - 1
    partner = np.where(usable, partner, np.where(lower >= 0, fits[lower], 0))
    if int(np.where(fits + partner <= room, fits + partner, 0).max()) <= j:
        return i, j
    others[j] -= 1
    seconds = np.flatnonzero(others[: room - j + 1])
    if not len(seconds):
        return None
    b = int(seconds[-1])
    if others[b + 1 : room // 2 + 1].any():
        return None
    return i, j, b


def reduce_instance(left: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Fix dominating sets, longest length first, until no length has one; ``left`` keeps the lengths that are not fixed.

    A set that dominates once goes on doing so while its lengths last, so it is fixed as often as they allow.
    """
    fixed: list[tuple[int, Pattern]] = []
    changed = True
    while changed:
        changed = False
        for i in np.flatnonzero(left)[::-1].tolist():
            while left[i]:
                chosen = _dominating(i, left, capacity)
                if chosen is None:
                    break
                lengths, copies = np.unique(chosen, return_counts=True)
                times = int((left[lengths] // copies).min())
                left[lengths] -= times * copies
                fixed.append((times, tuple(zip(lengths[::-1].tolist(), copies[::-1].tolist(), strict=True))))
                changed = True
    return fixed


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, Pattern]]:
    """Best fit, longest first: every piece goes to the fullest sequence that still takes it. Sequences filled alike are one group."""
    open_at: dict[int, list[tuple[int, Pattern]]] = {}
    rooms = np.zeros(capacity + 1, dtype=bool)
    for s in np.flatnonzero(left)[::-1].tolist():
        todo = int(left[s])
        while todo:
            fitting = np.flatnonzero(rooms[s:])
            if len(fitting):
                room = s + int(fitting[0])
                bins, pattern = open_at[room].pop()
                rooms[room] = bool(open_at[room])
            else:
                room, bins, pattern = capacity, -1, ()
            each = room // s
            full = todo // each if bins < 0 else min(bins, todo // each)
            part = 1 if todo - full * each and full != bins and todo < (full + 1) * each else 0
            rest = todo - full * each if part else 0
            for n, copies in ((full, each), (part, rest)):
                if n:
                    now = room - copies * s
                    open_at.setdefault(now, []).append((n, (*pattern, (s, copies))))
                    rooms[now] = True
            if bins > full + part:
                open_at.setdefault(room, []).append((bins - full - part, pattern))
                rooms[room] = True
            todo -= full * each + rest
        left[s] = 0
    return [group for groups in open_at.values() for group in groups]


class Plan:
    """Places of pieces by length and rank; its size depends on the number of lengths alone."""

    def __init__(self, counts: dict[int, int], capacity: int) -> None:
        left = np.zeros(capacity + 1, dtype=np.int64)
        left[list(counts)] = list(counts.values())
        fixed = reduce_instance(left, capacity)
        self.fixed = sum(n for n, _ in fixed)
        rows, used, first = [], np.zeros(capacity + 1, dtype=np.int64), 0
        for bins, pattern in fixed + best_fit(left, capacity):
            offset = 0
            for s, copies in pattern:
                rows.append((s << 44 | int(used[s]), s, first, copies, offset))
                used[s] += bins * copies
                offset += s * copies
            first += bins
        self.sequences = first
        self.start, self.size, self.first, self.copies, self.offset = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5).T.copy()

    def places(self, size: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = size << 44 | rank
        at = np.searchsorted(self.start, key, side="right") - 1
        turn, copy = np.divmod(key - self.start[at], self.copies[at])
        return self.first[at] + turn, self.offset[at] + copy * size


_TOKENS = "doc_id long, part int, doc_tokens long, full_rank long, last_rank long, crcs array<long>, ids binary"


def tokenise(docs: DataFrame, vocabulary: str, window: int, end_id: int) -> DataFrame:
    """Ids of every document as little-endian unsigned 32-bit, checksums of its pieces, and their ranks by length in the partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part = tokenizer(vocabulary), TaskContext.get().partitionId()
        seen = [0] * (window + 1)
        for batch, texts in slices(batches, "text", ENCODE_BYTES):
            raw = [np.append(a, np.uint32(end_id)).astype("<u4").tobytes() for a in own.encode(texts)]
            lengths = [len(r) // 4 for r in raw]
            full_rank, last_rank = [], []
            for n in lengths:
                full, rest = divmod(n, window)
                full_rank.append(seen[window])
                seen[window] += full
                last_rank.append(seen[rest])
                seen[rest] += 1
            crcs = [[zlib.crc32(r[k : k + 4 * window]) for k in range(0, len(r), 4 * window)] for r in raw]
            columns = [pa.array(lengths, pa.int64()), pa.array(full_rank, pa.int64()), pa.array(last_rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([part] * len(raw), pa.int32()), *columns, pa.array(crcs, pa.list_(pa.int64())), pa.array(raw, pa.binary())],
                names=["doc_id", "part", "doc_tokens", "full_rank", "last_rank", "crcs", "ids"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, _TOKENS)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents with their ids and places in sequences of at most ``window`` tokens.

    Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null; only documents longer than
    a sequence are cut, into whole sequences and a rest; an empty table gives no piece; further columns are not read.
    """
    tokens = materialise(tokenise(docs, vocabulary, window, end_id), "token-ids")
    full, rest = F.floor(F.col("doc_tokens") / window), F.col("doc_tokens") % window
    sizes = F.array(F.struct(F.lit(window).cast("long").alias("size"), full.alias("n")), F.struct(rest.alias("size"), F.lit(1).cast("long").alias("n")))
    counts = (
        tokens.select("part", F.explode(sizes).alias("s"))
        .groupBy("part", F.col("s.size").alias("size"))
        .agg(F.sum("s.n").alias("n"))
        .where((F.col("size") > 0) & (F.col("n") > 0))
    )
    counts = materialise(counts, "length-counts")
    # One number per length.
    plan = Plan({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, window)
    before = Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("part", "size", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    whole = F.col("piece") < full
    pieces = (
        tokens.select("*", F.posexplode("crcs").alias("piece", "ids_crc32"))
        .withColumn("start", F.col("piece").cast("long") * window)
        .withColumn("length", F.when(whole, F.lit(window)).otherwise(rest).cast("long"))
        .withColumn("rank", F.when(whole, F.col("full_rank") + F.col("piece")).otherwise(F.col("last_rank")))
        .join(base.withColumnRenamed("size", "length"), ["part", "length"])
        .withColumn("rank", F.col("rank") + F.col("base"))
    )

    @F.pandas_udf("sequence_id long, offset long")
    def place(size: pd.Series, rank: pd.Series) -> pd.DataFrame:
        sequence, offset = plan.places(size.to_numpy(), rank.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    return pieces.withColumn("place", place("length", "rank")).select(
        "doc_id",
        "piece",
        "start",
        "length",
        "ids_crc32",
        "place.sequence_id",
        "place.offset",
        F.substring("ids", (F.col("start") * 4 + 1).cast("int"), (F.col("length") * 4).cast("int")).alias("ids"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from shelfsense.llm.packing import vocabulary

    return pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")
