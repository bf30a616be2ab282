"""Quality rules: counts over whole texts, and a calibrated regression on hashed words and character trigrams.

The regression learns from a bounded sample of labelled rows; every text is then scored in Arrow batches and held
against fixed thresholds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.common import fold_of, mix, plain_words, schema_of, slices, small_batches, table, tidy, windows, word_hashes, words
from shelfsense.llm.logistic import calibrate, fit, sample_labels, sigmoid

BITS = 15
#: Most labelled rows of each class that training takes.
PER_CLASS = 2000
MIN_PROBABILITY = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
_SYMBOLS = bytes(b"#*$%&|<>")
_P = tuple(np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


def base_counts(text: str | None, ws: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, from the words as they stand and their hashes."""
    if not text:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    # Code points: bytes that do not continue a character, without the blanks.
    starts = np.frombuffer(raw, np.uint8)
    blanks = (starts == 32) | ((starts >= 9) & (starts <= 13))
    chars = int(((starts & 0xC0) != 0x80).sum() - blanks.sum())
    symbols = len(raw) - len(raw.translate(None, _SYMBOLS))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += bool(line.split())
        else:
            seen.add(line)
    repeat = 0
    n = len(ws) - 4
    if n > 1:
        codes, distinct = pd.factorize(windows(hashes, 5))
        if len(distinct) < n:
            often = np.bincount(codes)[codes] > 1
            cover = np.zeros(len(ws) + 1, dtype=np.int64)
            np.add.at(cover, np.flatnonzero(often), 1)
            np.add.at(cover, np.flatnonzero(often) + 5, -1)
            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(ws), chars, symbols, dup, repeat


def cells(text: str | None, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the words and of the character trigrams of one text."""
    word = (mix(hashes) >> np.uint64(64 - BITS)).astype(np.int64)
    code = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(code) < 3:
        return word, np.empty(0, np.int64)
    h = (code[:-2] * _P[0]) ^ (code[1:-1] * _P[1]) ^ (code[2:] * _P[2])
    h = (h ^ (h >> np.uint32(15))) * _P[1]
    return word, (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class QualityModel:
    word: np.ndarray
    char: np.ndarray
    bias: float
    curve: np.ndarray

    def probability(self, text: str | None, hashes: np.ndarray) -> float:
        """Calibrated probability of good quality; each family of features is scaled by the root of its size."""
        word, char = cells(text, hashes)
        z = self.bias
        z += self.word[word].sum() / np.sqrt(len(word)) if len(word) else 0.0
        z += self.char[char].sum() / np.sqrt(len(char)) if len(char) else 0.0
        return float(sigmoid(np.array(z * self.curve[0] + self.curve[1])))


_PASS = QualityModel(np.zeros(1 << BITS), np.zeros(1 << BITS), 0.0, np.array([0.0, 10.0]))


def _features(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("held", pa.int32()), ("cells", pa.list_(pa.int32())), ("xs", pa.list_(pa.float32()))])
        for batch, texts in slices(batches, "text"):
            rows = []
            for text, doc_id, y, held in zip(texts, *(batch.column(c).to_pylist() for c in ("doc_id", "y", "held")), strict=True):
                at, xs = [], []
                for k, c in enumerate(cells(text, word_hashes(words(text)))):
                    if len(c):
                        own, n = np.unique(c, return_counts=True)
                        at.append(own + (k << BITS))
                        xs.append(n / np.sqrt(len(c)))
                joined = np.concatenate(at) if at else np.empty(0, np.int64)
                rows.append({"doc_id": doc_id, "y": y, "held": held, "cells": joined.tolist(), "xs": np.concatenate(xs).tolist() if xs else []})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return small_batches(sample).mapInArrow(tidy(run), "doc_id long, y int, held int, cells array<int>, xs array<float>")


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> QualityModel:
    """Fit on at most about ``per_class`` labelled documents of each class; a third of them calibrates the curve.

    Without documents of both classes the model lets everything pass.
    """
    sample, shift = sample_labels(labels, "quality", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").withColumn("held", F.when(fold_of("doc_id", 3) == 0, 1).otherwise(0))
    if not sample.take(1):
        return _PASS
    got = _features(rows).toArrow().sort_by([("doc_id", "ascending")]).combine_chunks()
    y = np.asarray(got["y"]).astype(np.int64)
    if len(set(y.tolist())) < 2:
        return _PASS
    # Flat arrays, never lists: the sample is small in this form only.
    sizes = np.asarray(pc.list_value_length(got["cells"]))
    at = np.repeat(np.arange(len(y), dtype=np.int32), sizes)
    columns = np.asarray(pc.list_flatten(got["cells"]))
    values = np.asarray(pc.list_flatten(got["xs"]))
    held = np.asarray(got["held"]) == 1
    if len(set(y[held].tolist())) < 2 or len(set(y[~held].tolist())) < 2:
        held = np.zeros(len(y), dtype=bool)
    own, place = ~held[at], np.cumsum(~held) - 1
    w, b = fit(place[at[own]], columns[own], values[own], y[~held], 2 << BITS, 1e-4)
    z = np.bincount(at, weights=w[columns] * values, minlength=len(y)) + b
    test = held if held.any() else ~held
    curve = calibrate(z[test, None], y[test]) + np.array([0.0, shift])
    return QualityModel(w[: 1 << BITS].round(6), w[1 << BITS :].round(6), round(b, 6), curve.round(6))


_KINDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double"


def score(docs: DataFrame, model: QualityModel, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row with its counts, probability and verdicts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows, chance = [], []
            for text in texts:
                ws, low = plain_words(text), words(text)
                hashes = word_hashes(ws)
                rows.append(base_counts(text, ws, hashes))
                # The regression alone takes words in lower case.
                chance.append(model.probability(text, hashes if low == ws else word_hashes(low)))
            counts = np.array(rows, dtype=np.int64).reshape(len(texts), 5)
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, *(pa.array(counts[:, k]) for k in range(5)), pa.array(chance, pa.float64())],
                names=[*keep, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "probability"],
            )

    out = small_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(tidy(run), schema_of(docs, keep, _KINDS))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("probability") >= MIN_PROBABILITY))


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts, probability, ``base_failed`` and ``kept`` of every document.

    Defined cases: a null or empty text has no words, fails the base rules and is not kept; repeated rows give repeated
    rows; a null doc_id stays null and is never a label; no labels, or labels of one class only, leave the base rules alone;
    an empty table gives an empty table; further columns are not read.
    """
    return score(docs, train(docs, labels), ["doc_id"])


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are kept, unchanged. Columns may have any name; the counts are joined to none."""
    model = train(docs, table(spark, sf_dir, "labels"))
    wide = docs.select(F.struct(*docs.columns).alias("_row"), "text")

    return score(wide, model, ["_row"]).where("kept").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
