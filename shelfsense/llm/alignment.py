"""Cross-tokenizer alignment: where two tokenizers cut a text alike, which of their tokens overlap, and which pairs of ids belong together.

Token ends as byte offsets are two ascending lists with the same last entry. The shorter list drives a galloping search into the longer (doubling
steps, then bisection, each run of entries starting where its first entry was found). Ends met in both lists cut the text into groups; the
ranks of neighbouring ends in the other list bound the tokens that a token overlaps.

Links are counted per document, folded into blocks of a few megabytes of text and summed over the corpus. A block's own pairs come
back with their totals and meet its documents again, so the last step holds one block at a time. No pair occurs twice in a block, so no
key of the join can hold more than one row per block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.chunks import ENCODE_BYTES, ByteTokenizer, ranges
from shelfsense.llm.common import slices, small_batches, table
from shelfsense.session import materialise

#: UTF-8 bytes of text whose pairs are folded together before they leave a task; a longer text makes a block of its own.
BLOCK_BYTES = 8 << 20
_RUN = 8


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """For each entry of the ascending ``short``, how many entries of the ascending ``long`` are smaller."""
    low = np.zeros(len(short), dtype=np.int64)
    if len(short) > _RUN:
        low = np.repeat(gallop(short[::_RUN], long), _RUN)[: len(short)]
    high = np.full(len(short), len(long), dtype=np.int64)
    live, step = np.arange(len(short)), 1
    while len(live):  # doubling steps, until an entry is not smaller
        probe = low[live] + step - 1
        inside = probe < len(long)
        live, probe = live[inside], probe[inside]
        smaller = long[probe] < short[live]
        low[live[smaller]] = probe[smaller] + 1
        high[live[~smaller]] = probe[~smaller]
        live, step = live[smaller], 2 * step
    live = np.flatnonzero(low < high)
    while len(live):  # bisection of what is left
        middle = (low[live] + high[live]) >> 1
        smaller = long[middle] < short[live]
        low[live[smaller]] = middle[smaller] + 1
        high[live[~smaller]] = middle[~smaller]
        live = live[low[live] < high[live]]
    return low


class Alignment:
    """Common ends and overlap ranges of the tokens of two tokenizers, from the ascending ends of their tokens."""

    def __init__(self, ends_a: np.ndarray, ends_b: np.ndarray) -> None:
        flip = len(ends_b) < len(ends_a)
        short, long = (ends_b, ends_a) if flip else (ends_a, ends_b)
        rank = gallop(short, long)
        met = long[rank] == short if len(short) else np.zeros(0, dtype=bool)
        at_short, at_long = np.flatnonzero(met), rank[met]
        #: Index of the last token of each group on both sides.
        self.last_a, self.last_b = (at_long, at_short) if flip else (at_short, at_long)
        # A token overlaps the others from the rank of its start to the rank of its end.
        first = np.concatenate([[0], (rank + met)[:-1]]) if len(rank) else rank
        sizes = rank - first + 1 if len(rank) else rank
        own, other = np.repeat(np.arange(len(short)), sizes), ranges(first, sizes)
        #: One entry per link on both sides, ascending.
        self.link_a, self.link_b = (other, own) if flip else (own, other)


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece

        self.a = ByteTokenizer(path_a)
        self.b = sp = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.bytes_a = self.a.bytes_of
        self.bytes_b = [self._piece(sp, i) for i in range(sp.get_piece_size())]
        self.size_a, self.size_b = (np.array([len(x) for x in side], dtype=np.int64) for side in (self.bytes_a, self.bytes_b))
        names_a, names_b = ([str(i) for i in range(len(side))] for side in (self.bytes_a, self.bytes_b))
        # An id's text in the list of groups: inside its side, at the end of its side, and (B) at the end of the document.
        self.shown = [f"{i}{end}" for names, ends in ((names_a, ",|"), (names_b, [",", ";", ""])) for end in ends for i in names]

    @staticmethod
    def _piece(sp, i: int) -> bytes:
        if sp.is_control(i) or sp.is_unknown(i):
            return b""
        piece = sp.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if sp.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, texts: list[str | None]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
        """Ids of both sides, and whether the text has tokens: it is not empty, and both sides spell a blank and the text."""
        full = [t or "" for t in texts]
        ids_a = self.a.encode(pa.array([" " + t for t in full], pa.string()))
        ids_b = self.b.encode(full, num_threads=1)
        spell_a, spell_b = self.bytes_a.__getitem__, self.bytes_b.__getitem__
        ok = []
        for t, a, b in zip(full, ids_a, ids_b, strict=True):
            want = b" " + t.encode()
            ok.append(bool(t) and b"".join(map(spell_a, a)) == want and b"".join(map(spell_b, b)) == want)
        return ids_a, ids_b, ok

    def groups(self, ids_a: np.ndarray, ids_b: np.ndarray, found: Alignment, ends: set[int] | np.ndarray) -> tuple[list[str], np.ndarray]:
        """The groups' parts in order, and how many parts lie before each group; ``ends`` are the last groups of documents."""
        n_a, n_b, g = len(self.bytes_a), len(self.bytes_b), len(found.last_a)
        sizes_a, sizes_b = np.diff(found.last_a, prepend=-1), np.diff(found.last_b, prepend=-1)
        before_a, before_b = found.last_a + 1, np.concatenate([[0], found.last_b[:-1] + 1])
        code = np.empty(len(ids_a) + len(ids_b), dtype=np.int64)
        kind_a, kind_b = np.zeros(len(ids_a), dtype=np.int64), np.zeros(len(ids_b), dtype=np.int64)
        kind_a[found.last_a] = 1
        kind_b[found.last_b] = 1
        kind_b[found.last_b[ends]] = 2
        code[np.arange(len(ids_a)) + np.repeat(before_b, sizes_a)] = ids_a + kind_a * n_a
        code[np.arange(len(ids_b)) + np.repeat(before_a, sizes_b)] = ids_b + kind_b * n_b + 2 * n_a
        shown = list(map(self.shown.__getitem__, code.tolist()))
        return shown, np.concatenate([[0], before_a + found.last_b + 1]) if g else np.zeros(1, dtype=np.int64)


_loaded: dict[tuple[str, str], Tokenizers] = {}


def tokenizers(path_a: str, path_b: str) -> Tokenizers:
    if (path_a, path_b) not in _loaded:
        _loaded[path_a, path_b] = Tokenizers(path_a, path_b)
    return _loaded[path_a, path_b]


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, lists), dtype=np.int64, count=len(lists))
    return np.fromiter((i for x in lists for i in x), dtype=np.int64, count=int(sizes.sum())), sizes


class _Slice:
    """Alignment of a few texts: counts per document, texts of the groups, and distinct pairs per document."""

    def __init__(self, texts: list[str | None], own: Tokenizers) -> None:
        lists_a, lists_b, ok = own.encode(texts)
        good = np.flatnonzero(ok)
        ids_a, n_a = _flat([lists_a[k] for k in good])
        ids_b, n_b = _flat([lists_b[k] for k in good])
        found = Alignment(np.cumsum(own.size_a[ids_a]), np.cumsum(own.size_b[ids_b]))
        n = len(texts)
        self.n_a, self.n_b, self.n_groups, self.n_links = (np.zeros(n, dtype=np.int64) for _ in range(4))
        self.n_a[good], self.n_b[good] = n_a, n_b
        stops = np.cumsum(n_a)
        groups = np.searchsorted(found.last_a, stops - 1) + 1  # groups up to the end of each document
        self.n_groups[good] = np.diff(groups, prepend=0)
        self.groups = [""] * n
        shown, parts = own.groups(ids_a, ids_b, found, groups - 1)
        for k, a, b in zip(good.tolist(), parts[np.concatenate([[0], groups[:-1]]).astype(np.int64)].tolist(), parts[groups].tolist(), strict=True):
            self.groups[k] = "".join(shown[a:b])
        doc = np.repeat(good, n_a)[found.link_a]
        self.n_links = np.bincount(doc, minlength=n).astype(np.int64)
        self.pairs, index = np.unique(ids_a[found.link_a] << 32 | ids_b[found.link_b], return_inverse=True)
        both, self.counts = np.unique(doc * max(1, len(self.pairs)) + index, return_counts=True)
        self.doc, self.index = both // max(1, len(self.pairs)), both % max(1, len(self.pairs))


_DOCS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_ENCODED = f"block long, {_DOCS}, at binary, n binary, pairs array<long>, counts array<long>"
_SCHEMA = pa.schema(
    [("block", pa.int64())]
    + [(c, pa.int64()) for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("at", pa.binary()), ("n", pa.binary())]
    + [(c, pa.list_(pa.int64())) for c in ("pairs", "counts")]
)


def _block(block: int, held: list[tuple[pa.Array, _Slice]]) -> Iterator[pa.RecordBatch]:
    """Rows of a block's documents, with their links as places in the block's list of pairs, and that list."""
    pairs = np.unique(np.concatenate([s.pairs for _, s in held]))
    totals = np.zeros(len(pairs), dtype=np.int64)
    for ids, s in held:
        place = np.searchsorted(pairs, s.pairs)[s.index].astype("<i4") if len(s.pairs) else np.zeros(0, dtype="<i4")
        np.add.at(totals, place, s.counts)
        bounds = np.searchsorted(s.doc, np.arange(len(ids) + 1))
        counts = s.counts.astype("<i4")
        cells = [[x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)] for x in (place, counts)]
        none = pa.nulls(len(ids), pa.list_(pa.int64()))
        digests = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in s.groups]
        numbers = [pa.array(x) for x in (s.n_a, s.n_b, s.n_groups, s.n_links)]
        columns = [pa.array(np.full(len(ids), block)), ids, *numbers, pa.array(digests), *(pa.array(x, pa.binary()) for x in cells), none, none]
        yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
    for at in range(0, len(pairs), 1 << 16):
        some, n = pairs[at : at + (1 << 16)], totals[at : at + (1 << 16)]
        yield pa.RecordBatch.from_pylist([{"block": block, "pairs": some.tolist(), "counts": n.tolist()}], schema=_SCHEMA)


def encode(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """One row per document (counts, digest, links as places in its block's list of pairs) and the blocks' lists of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block = tokenizers(path_a, path_b), TaskContext.get().partitionId() << 33
        held: list[tuple[pa.Array, _Slice]] = []
        size = 0
        for batch, texts in slices(batches, "text", ENCODE_BYTES):
            held.append((batch.column(0).cast(pa.int64()), _Slice(texts, own)))
            size += pc.sum(pc.binary_length(batch.column(1))).as_py() or 0
            if size >= BLOCK_BYTES or sum(len(ids) for ids, _ in held) >= 1 << 16:
                yield from _block(block, held)
                held, size, block = [], 0, block + 1
        if held:
            yield from _block(block, held)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, _ENCODED)


def pair_counts(encoded: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, n, best) over the corpus: how many links hold the two ids, and whether no id is linked more often with the B id."""
    rows = _block_pairs(encoded).groupBy("pair").agg(F.sum("n").alias("n"))
    rows = rows.select("pair", F.shiftright("pair", 32).alias("a_id"), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b_id"), "n")
    rows = materialise(rows, "pair-counts")
    # One row per id of the second vocabulary.
    most = F.broadcast(rows.groupBy("b_id").agg(F.max("n").alias("most")))
    return rows.join(most, "b_id").select("pair", "a_id", "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def _block_pairs(encoded: DataFrame) -> DataFrame:
    lists = encoded.where(F.col("pairs").isNotNull()).select("block", F.explode(F.arrays_zip("pairs", "counts")).alias("p"))
    return lists.select("block", F.col("p.pairs").alias("pair"), F.col("p.counts").alias("n"))


def align(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Counts and digests of every document, with what its links weigh in the whole corpus.

    Defined cases: texts null, empty or not spelled by both sides have zeros and the empty digest; repeated rows count and are returned each; a
    null doc_id stays null; texts of any length are aligned whole; an empty table gives an empty table; further columns are not read.
    :func:`groups` returns the groups themselves, :func:`pair_counts` the pairs of ids.
    """
    encoded = materialise(encode(docs, path_a, path_b), "aligned")
    totals = pair_counts(encoded).select("pair", F.col("n").alias("total"), "best")
    known = _block_pairs(encoded).select(F.col("block").alias("of_block"), "pair").join(totals, "pair")
    rows = encoded.where(F.col("pairs").isNull()).drop("pairs", "counts")

    def weigh(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(right["pair"].to_numpy())
        total, best = right["total"].to_numpy()[order], right["best"].to_numpy()[order].astype(np.int64)
        left = left.combine_chunks()
        out: dict[str, list[int]] = {"n_best": [], "count_sum": []}
        for at, n in zip(left["at"], left["n"], strict=True):
            place, counts = np.frombuffer(at.as_py(), dtype="<i4"), np.frombuffer(n.as_py(), dtype="<i4").astype(np.int64)
            out["n_best"].append(int(counts @ best[place]))
            out["count_sum"].append(int(counts @ total[place]))
        kept = left.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
        for name, values in out.items():
            kept = kept.append_column(name, pa.array(values, pa.int64()))
        return kept.append_column("groups_sha256", left["groups_sha256"])

    kind = _DOCS.replace("groups_sha256", "n_best long, count_sum long, groups_sha256")
    return rows.groupBy("block").cogroup(known.groupBy("of_block")).applyInArrow(weigh, kind)


def groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """(doc_id, groups): the ids of both sides between common ends, as ``a1,a2|b1;a3|b2,b3``; cases as in :func:`align`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = tokenizers(path_a, path_b)
        for batch, texts in slices(batches, "text"):
            found = _Slice(texts, own).groups
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found, pa.string())], names=["doc_id", "groups"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, groups string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as files

    return align(table(spark, sf_dir, "documents"), files.path("byte_bpe_50k.json"), files.path("piece_bpe_32k.model"))
