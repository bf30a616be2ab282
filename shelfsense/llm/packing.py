"""Packing by concatenate and cut: token totals of partitions give global offsets, fixed windows give the sequences.

The first pass tokenises every text once and writes ids together with each document's offset inside its partition.
The totals of the partitions, one small row each, are summed up; partition start plus offset is the document's
place in the one long stream of tokens. The second pass cuts the stored ids at multiples of the window, so no token row is shuffled.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfsense.llm.chunks import ENCODE_BYTES, ChunkTable, per_text, text_column
from shelfsense.llm.common import slices, small_batches, table, tidy
from shelfsense.session import materialise

WINDOW = 4096
END_ID = 2

#: Characters for which the vocabulary's normaliser and splitter are these simple rules (no composition, no odd blanks).
_ODD = r"[^\t\n\r -~À-ÖØ-öø-ÿ‘’“”–—…]|<\|"
_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+")
#: Pieces a worker keeps before it starts its table anew.
_PIECES_KEPT = 150_000


class WordTokenizer:
    """Token ids of the `tokenizers` library with two tables of known strings in front of it.

    The library cuts a text at blanks and then into pieces before it merges, and each piece is encoded alone. So Arrow lower-cases the
    texts, cuts them at blanks and finds the distinct chunks, which are looked up; an unknown chunk is cut into pieces; unknown pieces go
    to the library's merge model.
    Texts with characters outside plain Latin, where normalising could reach across pieces, go to the library whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.library = Tokenizer.from_file(path)
        self.in_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        self.pieces: dict[str, list[int]] = {}
        self.table = ChunkTable(self._learn)

    @staticmethod
    def _cut(chunk: str) -> list[str]:
        if chunk.isalpha():
            return [chunk]
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return [chunk[:-1], chunk[-1]]
        return _SPLIT.findall(chunk)

    def _learn(self, chunks: list[str]) -> list[list[int]]:
        """Ids of unknown chunks."""
        if len(self.pieces) > _PIECES_KEPT:
            self.pieces = {}
        parts = [self._cut(c) for c in chunks]
        merge, known = self.library.model.tokenize, self.pieces
        for piece in {p for ps in parts for p in ps}.difference(known):
            form = piece if piece.isascii() else self.in_bytes.pre_tokenize_str(piece)[0][0]
            known[piece] = [t.id for t in merge(form)]
        return [known[ps[0]] if len(ps) == 1 else [i for p in ps for i in known[p]] for ps in parts]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text, as unsigned 32-bit arrays."""
        column = text_column(texts)
        odd = pc.match_substring_regex(column, _ODD)
        lists = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", column)))
        ids, sizes = self.table.take(lists.flatten())
        bounds = per_text(sizes, pc.list_value_length(lists).to_numpy(zero_copy_only=False))
        out = [ids[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        for k in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
            out[k] = self._whole(column[k].as_py())
        return out

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


_loaded: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


_TOKENS = "doc_id long, part int, part_start long, doc_tokens long, ids binary"


def tokenise(docs: DataFrame, vocabulary: str, end_id: int = END_ID) -> DataFrame:
    """Ids of every document as little-endian unsigned 32-bit, with its start among the tokens of its partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, done = tokenizer(vocabulary), TaskContext.get().partitionId(), 0
        for batch, texts in slices(batches, "text", ENCODE_BYTES):
            arrays = [np.append(a, np.uint32(end_id)) for a in own.encode(texts)]
            lengths = np.array([len(a) for a in arrays], dtype=np.int64)
            starts = done + np.cumsum(lengths) - lengths
            done += int(lengths.sum())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array(np.full(len(arrays), part, dtype=np.int32)),
                    pa.array(starts),
                    pa.array(lengths),
                    pa.array([a.astype("<u4").tobytes() for a in arrays], type=pa.binary()),
                ],
                names=["doc_id", "part", "part_start", "doc_tokens", "ids"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(tidy(run), _TOKENS)


_PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, first boolean, last boolean, ids binary"
)


def cut(tokens: DataFrame, window: int = WINDOW) -> DataFrame:
    """Cut the stream at multiples of ``window``: one boundary record per piece, with the ids of the piece."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("_n"))
    starts = totals.select(
        "part", (F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_base")
    )
    placed = tokens.join(F.broadcast(starts), "part").select(
        "doc_id", "doc_tokens", (F.col("_base") + F.col("part_start")).alias("at"), "ids"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc_id, n, at, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                start = 0
                while start < n:
                    sequence, offset = divmod(at + start, window)
                    length = min(n - start, window - offset)
                    piece = ids[4 * start : 4 * (start + length)]
                    rows.append((doc_id, start, length, zlib.crc32(piece), n, sequence, offset, start == 0, start + length == n, piece))
                    start += length
                    held += len(piece)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], schema=_OUT)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(_OUT.names, r, strict=True)) for r in rows], schema=_OUT)

    return small_batches(placed).mapInArrow(tidy(run), _PIECES)


_OUT = pa.schema(
    [(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    + [("first", pa.bool_()), ("last", pa.bool_()), ("ids", pa.binary())]
)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """Pieces of all documents in sequences of ``window`` tokens; all but the last sequence are full.

    Defined cases: a null or empty text is the end id alone; repeated rows are packed each; a null doc_id stays null;
    texts of any length are cut where windows end; an empty table gives no piece; further columns are not read.
    The broadcast table has one row of two numbers per partition of the input.
    """
    return cut(materialise(tokenise(docs, vocabulary, end_id), "token-ids"), window)


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: boundary records of the packed documents (digests; ids stay in the operator)."""
    return pack(docs, vocabulary()).drop("ids", "first", "last")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stage(spark, table(spark, sf_dir, "documents"), sf_dir)
