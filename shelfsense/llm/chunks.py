"""Texts cut into chunks that a tokenizer encodes one by one, and a bounded table of the ids of chunks already seen."""

from __future__ import annotations

import gc
import json
import os
import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Marks the ends of chunks while a slice of texts is cut; texts that hold it are cut by Python's regular expressions.
_END = "\x1e"
#: UTF-8 bytes of text that an encoder takes at a time.
ENCODE_BYTES = 2 << 20
#: Chunks that a table looks up at a time, and entries it keeps before it starts anew.
_AT_ONCE, ENTRIES = 300_000, 350_000


def text_column(texts: list[str | None] | pa.Array) -> pa.Array:
    """Texts as an Arrow column without nulls."""
    column = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    return pc.fill_null(column, "")


def cut(texts: pa.Array, pattern: str) -> tuple[pa.Array, np.ndarray]:
    """All matches of ``pattern`` in all texts, and the number of them in each; an empty chunk may end a text.

    The pattern has to cover every character and to mean the same to Arrow's and Python's regular expressions.
    """
    if pc.any(pc.match_substring(texts, _END)).as_py():
        lists = pa.array([re.findall(pattern, t) for t in texts.to_pylist()], pa.list_(pa.string()))
    else:
        lists = pc.split_pattern(pc.replace_substring_regex(texts, pattern=f"({pattern})", replacement=rf"\1{_END}"), pattern=_END)
    return lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)


class ChunkTable:
    """Ids of chunks, learned once each; beyond ``entries`` only chunks met in several slices are kept."""

    def __init__(self, learn: Callable[[list[str]], Sequence[Sequence[int]]], entries: int = ENTRIES) -> None:
        self.learn, self.entries = learn, entries
        self._start([], np.zeros(0, dtype=np.int64), np.empty(0, dtype=np.uint32), np.zeros(0, dtype=np.int32))

    def _start(self, names: list[str], sizes: np.ndarray, flat: np.ndarray, used: np.ndarray) -> None:
        self.at = dict(zip(names, range(len(names)), strict=True))
        self.starts, self.flat, self.used = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), flat, used

    def _shrink(self) -> None:
        keep = np.flatnonzero(self.used > 1)
        if len(keep) > self.entries // 2:
            keep = np.sort(np.argsort(-self.used, kind="stable")[: self.entries // 2])
        names, sizes = list(self.at), np.diff(self.starts)[keep]
        self._start([names[k] for k in keep.tolist()], sizes, self.flat[ranges(self.starts[keep], sizes)], self.used[keep] // 2)

    def _add(self, new: list[str]) -> None:
        gc.disable()  # many small lists, none in a cycle
        try:
            ids = self.learn(new)
            self.at.update(zip(new, range(len(self.at), len(self.at) + len(new)), strict=True))
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), dtype=np.uint32, count=int(sizes.sum()))])
            self.used = np.concatenate([self.used, np.zeros(len(new), dtype=np.int32)])
        finally:
            gc.enable()

    def take(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all chunks one behind another, and the number of ids of each chunk."""
        parts = [self._take(chunks.slice(at, _AT_ONCE)) for at in range(0, len(chunks), _AT_ONCE)]
        if not parts:
            return np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def _take(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        coded = chunks.dictionary_encode()
        names, codes = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy(zero_copy_only=False)
        at = list(map(self.at.get, names))
        new = [c for c, k in zip(names, at, strict=True) if k is None]
        if new:
            if len(self.at) + len(new) > self.entries:
                self._shrink()
                new = [c for c in names if c not in self.at]
            self._add(new)
            at = list(map(self.at.__getitem__, names))
        at = np.array(at, dtype=np.int64)
        self.used[at] += 1
        sizes = (self.starts[at + 1] - self.starts[at])[codes]
        return self.flat[ranges(self.starts[at][codes], sizes)], sizes


def ranges(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[k], first[k] + 1, ... (sizes[k] of them) for every k, one behind another."""
    ends = np.cumsum(sizes)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)


def per_text(sizes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Where each text's ids begin, from the ids per chunk and the chunks per text; one bound more than there are texts."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    return ends[np.concatenate([[0], np.cumsum(counts)])].astype(np.int64)


def pieces_of(flat: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]


class SpacedEncoder:
    """Encodes a blank and the text behind it, chunk by chunk.

    Most texts are cut at single blanks and line ends (``odd`` finds the others, where runs of blanks matter); all others by ``pattern``.
    """

    def __init__(self, learn: Callable[[list[str]], Sequence[Sequence[int]]], odd: str, pattern: str, blank: str) -> None:
        self.odd, self.pattern, self.blank = odd, pattern, blank
        self.exact = ChunkTable(learn)
        self.spaced = ChunkTable(lambda new: learn([("\n" + c[1:]) if c[:1] == _END else blank + c for c in new]))

    def odd_ones(self, texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, f"{self.odd}|{_END}")

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """Ids of every text, as unsigned 32-bit arrays."""
        odd = self.odd_ones(texts)
        lists = pc.split_pattern(pc.replace_substring(pc.filter(texts, pc.invert(odd)), "\n", f" {_END}"), pattern=" ")
        ids, sizes = self.spaced.take(lists.flatten())
        plain = iter(pieces_of(ids, per_text(sizes, pc.list_value_length(lists).to_numpy(zero_copy_only=False))))
        if not pc.any(odd).as_py():
            return list(plain)
        whole = pc.binary_join_element_wise(self.blank, pc.replace_substring(pc.filter(texts, odd), " ", self.blank), "")
        chunks, counts = cut(whole, self.pattern)
        ids, sizes = self.exact.take(chunks)
        others = iter(pieces_of(ids, per_text(sizes, counts)))
        return [next(others) if o else next(plain) for o in odd.to_pylist()]


class ByteTokenizer:
    """Byte-level BPE by `tiktoken`, from the vocabulary file of the `tokenizers` library; strings of special tokens are plain text.

    Both libraries give the same ids where every merge makes an id of its own, in the order of the merges, which is checked. Texts with very long runs of
    blanks go to the library the file was made for.
    """

    #: Fixed value: the splitter that the vocabulary was made with.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
    LONG_RUN = r"[\s\x0b\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{1000}"

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks share the machine already
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            merges = json.load(f)["model"]["merges"]
        self.bytes_of, vocabulary = self.token_bytes(), self.library.get_vocab(with_added_tokens=False)
        made = [vocabulary["".join(m.split(" ") if isinstance(m, str) else m)] for m in merges]
        if made != list(range(256, 256 + len(made))):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {b: i for i, b in enumerate(self.bytes_of[: 256 + len(made)])}
        self.fast = tiktoken.Encoding("own", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: pa.Array) -> list[list[int]]:
        long = pc.match_substring_regex(texts, self.LONG_RUN).to_pylist()
        whole = self.library.encode
        return [whole(t, add_special_tokens=False).ids if odd else self.fast.encode_ordinary(t) for t, odd in zip(texts.to_pylist(), long, strict=True)]

    def token_bytes(self) -> list[bytes]:
        """Bytes of every id; ids without an entry have none."""
        # Bytes that print stand for themselves, the others for the characters from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
        vocabulary = self.library.get_vocab(with_added_tokens=False)
        out = [b""] * (max(vocabulary.values(), default=-1) + 1)
        for piece, i in vocabulary.items():
            if all(c in byte_of for c in piece):
                out[i] = bytes(byte_of[c] for c in piece)
        return out
