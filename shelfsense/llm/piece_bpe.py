"""SentencePiece encoding and decoding for merge-type vocabularies, by a score-ordered agenda of adjacent pairs.

The vocabulary file gives pieces and scores. A text becomes single characters; of all neighbours that form a piece, the
pair with the best score (leftmost on ties) merges first, until no pair is left; characters without a piece become bytes.
No piece holds a blank mark behind another character, so a text falls into chunks that never merge across their borders;
each distinct chunk is encoded once and compared with the library in batches, texts with odd blanks as a whole; a difference ends the job. Short chunks run side by side, one merge each per round, as rows of a matrix; long ones use a heap.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from shelfsense.llm.chunks import ENCODE_BYTES, SpacedEncoder, text_column
from shelfsense.llm.common import slices, small_batches, table

MARK = "▁"
_CHUNK = f"{MARK}*[^{MARK}\n]+|{MARK}+|\n"
_LONG = 40
_NONE = np.int32(2**31 - 1)


class PieceModel:
    """Encoder and decoder over one vocabulary file (merge type, byte fallback, blanks kept, text not normalised)."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        sp = self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.begin, self.end, self.unknown = sp.bos_id(), sp.eos_id(), sp.unk_id()
        n = sp.get_piece_size()
        plain = {sp.id_to_piece(i): i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        self.byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.has_bytes = all(sp.is_byte(i) for i in self.byte_ids)
        # Characters that occur only inside longer pieces get symbols behind the vocabulary.
        self.symbol = {p: i for p, i in plain.items() if len(p) == 1}
        for p in plain:
            for c in p:
                self.symbol.setdefault(c, n + len(self.symbol))
        self.width = n + len(self.symbol) + 1
        ids = {**plain, **self.symbol}
        order = np.lexsort((np.arange(n), [-sp.get_score(i) for i in range(n)]))
        score = np.array([sp.get_score(i) for i in range(n)])
        # Equal scores share a rank, so that the place in the text decides between them.
        rank = np.zeros(n, dtype=np.int32)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(score[order]) != 0]))
        pairs = {}
        for p, i in plain.items():
            for k in range(1, len(p)):
                if p[:k] in ids and p[k:] in ids:
                    pairs[ids[p[:k]] * self.width + ids[p[k:]]] = (int(rank[i]), i)
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.ranks = np.array([pairs[k][0] for k in sorted(pairs)], dtype=np.int32)
        self.piece_of_rank = np.zeros(n, dtype=np.int32)
        made = [i for p, i in plain.items() if len(p) > 1]
        self.piece_of_rank[rank[made]] = made
        # Beginnings of pieces that share a score with another: there the place decides, and the heap is used.
        counts = np.bincount(rank[made])
        self.tied = {p[:2] for p, i in plain.items() if len(p) > 1 and counts[rank[i]] > 1}
        self.after_letter = {b for p in plain for a, b in zip(p, p[1:]) if a.isalpha()}
        self.size = n
        self.texts = [b"" if sp.is_control(i) or sp.is_unknown(i) else p.encode() for p, i in ((sp.id_to_piece(i), i) for i in range(n))]
        if self.has_bytes:  # ASCII bytes stand for themselves; others may join to characters
            for b in range(128):
                self.texts[self.byte_ids[b]] = bytes([b])
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids) if b >= 128} if self.has_bytes else {}
        self.high = np.isin(np.arange(n), list(self.byte_of))
        if any(MARK in p.lstrip(MARK) or "\n" in p for p in plain):
            raise ValueError("a piece holds a blank mark behind another character, or a line end")
        self.tables = SpacedEncoder(self._learn, odd=f"^ |  |{MARK}", pattern=_CHUNK, blank=MARK)

    def _finish(self, chunk: str, symbols: list[int], lengths: list[int]) -> list[int]:
        """Symbols without an id become their UTF-8 bytes, or the unknown id."""
        if all(0 <= s < self.size for s in symbols):
            return symbols
        out, at = [], 0
        for s, n in zip(symbols, lengths, strict=True):
            if 0 <= s < self.size:
                out.append(s)
            elif self.has_bytes:
                out += [self.byte_ids[b] for b in chunk[at : at + n].encode()]
            else:
                out.append(self.unknown)
            at += n
        return out

    def agenda(self, chunk: str) -> list[int]:
        """One chunk, by a heap of (rank, place) over a linked list of symbols."""
        sym = [self.symbol.get(c, -1) for c in chunk]
        n = len(sym)
        left, right, size = list(range(-1, n - 1)), list(range(1, n + 1)), [1] * n
        heap: list[tuple[int, int, int, int]] = []

        def propose(a: int, b: int) -> None:
            if 0 <= a and b < n and sym[a] >= 0 and sym[b] >= 0:
                hit = self.pairs.get(sym[a] * self.width + sym[b])
                if hit:
                    heapq.heappush(heap, (hit[0], a, sym[a], sym[b]))

        for a in range(n - 1):
            propose(a, a + 1)
        alive = [True] * n
        while heap:
            _, a, s, t = heapq.heappop(heap)
            b = right[a] if alive[a] else n
            if b >= n or sym[a] != s or sym[b] != t:
                continue
            sym[a] = self.pairs[s * self.width + t][1]
            size[a] += size[b]
            alive[b] = False
            right[a] = right[b]
            if right[b] < n:
                left[right[b]] = a
            propose(left[a], a)
            propose(a, right[a])
        keep = [k for k in range(n) if alive[k]]
        return self._finish(chunk, [sym[k] for k in keep], [size[k] for k in keep])

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.width + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE)

    def _side_by_side(self, rows: list[list[int]]) -> list[list[int]]:
        """Agendas of many short chunks of known symbols: in each round every chunk merges its best pair."""
        n, m = len(rows), max(map(len, rows))
        if m == 1:
            return rows
        size = np.array([len(r) for r in rows])
        sym = np.full((n, m), -1, dtype=np.int32)
        flat = np.array([s for r in rows for s in r], dtype=np.int32)
        sym[np.repeat(np.arange(n), size), np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
        rank = self._rank(sym[:, :-1].ravel(), sym[:, 1:].ravel()).reshape(n, m - 1)
        live, cols = np.arange(n), np.arange(m)
        final: list[list[int]] = [[] for _ in range(n)]
        while len(live):
            best = rank.argmin(axis=1)
            own = np.arange(len(live))
            more = rank[own, best] != _NONE
            if not more.all():
                done = ~more
                for i, row, k in zip(live[done].tolist(), sym[done].tolist(), size[done].tolist(), strict=True):
                    final[i] = row[:k]
                live, sym, rank, best, size = live[more], sym[more], rank[more], best[more], size[more]
                if not len(live):
                    break
                own = np.arange(len(live))
                widest = int(size.max())
                if widest < m:
                    m, cols, sym, rank = widest, cols[:widest], sym[:, :widest], rank[:, : widest - 1]
            sym[own, best] = self.piece_of_rank[rank[own, best]]
            shift = np.minimum(cols + (cols > best[:, None]), m - 1)
            sym = np.take_along_axis(sym, shift, 1)
            rank = np.take_along_axis(rank, np.minimum(shift[:, :-1], m - 2), 1)
            sym[:, -1], rank[:, -1] = -1, _NONE
            size = size - 1
            for at, ok in ((best - 1, best > 0), (best, best < m - 1)):
                i, j = own[ok], at[ok]
                rank[i, j] = self._rank(sym[i, j], sym[i, j + 1])
        return final

    def encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        get = self.symbol.get
        rows = [[get(c, -1) for c in chunk] for chunk in chunks]
        alone = {k for k, r in enumerate(rows) if len(r) > _LONG or max(r) >= self.size or min(r) < 0 or any(t in chunks[k] for t in self.tied)}
        out: dict[int, list[int]] = {k: self.agenda(chunks[k]) for k in alone}
        short = sorted((k for k in range(len(chunks)) if k not in alone), key=lambda k: len(rows[k]))
        for at in range(0, len(short), 8192):
            part = short[at : at + 8192]
            out.update(zip(part, self._side_by_side([rows[k] for k in part]), strict=True))
        return [out[k] for k in range(len(chunks))]

    def _learn(self, new: list[str]) -> list[list[int]]:
        """Ids of unknown chunks; a line end, and a comma or full stop behind a letter, never merges and is set apart."""
        tails = {t for t in ",." if t not in self.after_letter}
        heads = ["\n" if len(c) > 1 and c[0] == "\n" else "" for c in new]
        bare = [c[1:] if h else c for h, c in zip(heads, new, strict=True)]
        ends = [c[-1] if len(c) > 1 and c[-1] in tails and c[-2].isalpha() else "" for c in bare]
        stems = [c[:-1] if e else c for e, c in zip(ends, bare, strict=True)]
        alone = list({*stems, *",.\n"} - {""})
        own = dict(zip(alone, self.encode_chunks(alone), strict=True)) | {"": []}
        # A line end in front keeps the library from adding a blank mark, and merges with nothing.
        theirs = self.library.encode(["\n" + s.replace(MARK, " ") for s in alone], num_threads=1)
        skip = len(self.library.encode("\n"))
        if any(own[s] != ids[skip:] for s, ids in zip(alone, theirs, strict=True)):
            raise ValueError("ids differ from those of the library")
        return [own[s] if not h and not e else own[h] + own[s] + own[e] for h, s, e in zip(heads, stems, ends, strict=True)]

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """Ids of each text between begin and end id, as unsigned 32-bit arrays; an empty text has only these two.

        Raises where the library gives others.
        """
        column = text_column(texts)
        empty = pc.equal(column, "").to_pylist()
        b, e = [np.uint32(self.begin)], [np.uint32(self.end)]
        out = [
            np.concatenate([b, e] if void else [b, ids, e]).astype(np.uint32)
            for void, ids in zip(empty, self.tables.encode(column), strict=True)
        ]
        for k in np.flatnonzero(self.tables.odd_ones(column)).tolist():
            if out[k].tolist() != self.library.encode(column[k].as_py(), add_bos=True, add_eos=True):
                raise ValueError("ids differ from those of the library")
        return out

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces joined, blank marks to blanks, the first blank dropped, byte pieces back to UTF-8.

        Bytes that form no character become U+FFFD one by one.
        """
        out: list[bytes] = []
        run: list[int] = []
        texts, byte_of = self.texts, self.byte_of

        def flush() -> None:
            out.append(_utf8(bytes(run)))
            run.clear()

        if not self.high[ids].any():
            out = [texts[i] for i in ids.tolist()]
        else:
            for i in ids.tolist():
                b = byte_of.get(i)
                if b is not None:
                    run.append(b)
                    continue
                if run:
                    flush()
                out.append(texts[i])
            if run:
                flush()
        whole = b"".join(out).decode("utf-8", "replace").replace(MARK, " ")
        return whole[1:] if whole[:1] == " " and self._starts_blank(ids) else whole

    def _starts_blank(self, ids: np.ndarray) -> bool:
        first = next((int(i) for i in ids if self.texts[i]), None)
        return first is not None and first not in self.byte_of and self.texts[first].startswith(MARK.encode())


def _utf8(raw: bytes) -> bytes:
    try:
        raw.decode("utf-8")
        return raw
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(raw):
        for n in (1, 2, 3, 4):
            try:
                raw[at : at + n].decode("utf-8")
            except UnicodeDecodeError:
                continue
            out.append(raw[at : at + n])
            at += n
            break
        else:
            out.append("�".encode())
            at += 1
    return b"".join(out)


_loaded: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    if path not in _loaded:
        _loaded[path] = PieceModel(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, path: str, check: bool = False) -> DataFrame:
    """(doc_id, ids, decoded) of every text; ``check`` adds ``agrees``, the comparison with the library on both.

    Defined cases: a null or empty text is begin and end id and decodes to the empty text; characters outside the
    vocabulary become byte pieces; repeated rows give repeated rows; a null doc_id stays null; an empty table gives an
    empty table; further columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch, texts in slices(batches, "text"):
            ids = own.encode(texts)
            decoded = [own.decode(x) for x in ids]
            columns = [batch.column(0).cast(pa.int64()), pa.array([x.tolist() for x in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            if check:
                theirs = own.library.encode([t or "" for t in texts], add_bos=True, add_eos=True, num_threads=1)
                columns.append(pa.array([x.tolist() == y and d == own.library.decode(y) for x, y, d in zip(ids, theirs, decoded, strict=True)]))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "decoded", "agrees"][: len(columns)])

    kind = "doc_id long, ids array<int>, decoded string" + (", agrees boolean" if check else "")
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, kind)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts; cases as in :func:`encode_documents`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model(path)
        for batch, texts in slices(batches, "text"):
            ids = own.encode(texts)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).cast(pa.int64()),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids]),
                    pa.array([hashlib.sha256(own.decode(x).encode()).hexdigest() for x in ids]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
