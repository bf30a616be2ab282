"""Language identification by multilingual mixture inference.

Every language is a distribution of hashed letter trigrams, counted over all training documents. A text is a mixture: its trigrams come
from languages in unknown proportions, which expectation-maximisation estimates. The set of languages is
chosen by penalised likelihood: the least language leaves as long as the loss stays below half a log per trigram count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.common import fold_of, slices, small_batches, table

BITS = 15
UNKNOWN = "und"
#: Log-likelihood that expectation-maximisation may leave ungained; the penalty for a language is half the logarithm of the length.
GAIN = 0.05
_P = tuple(np.uint32(p) for p in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))
#: Unicode has no letter from here on; the last code point below is unassigned.
_TOP = 0x34000
_letters: list[np.ndarray] = []


def trigrams(text: str | None) -> np.ndarray:
    """Hashed letter trigrams of the lower-cased text, words between single blanks; none without a letter."""
    if not text:
        return np.empty(0, np.int64)
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(_TOP)), dtype=bool, count=_TOP))
    code = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = np.where(_letters[0][np.minimum(code, _TOP - 1)], code, np.uint32(32))
    blank = code == 32
    code = code[~(blank & np.concatenate([[False], blank[:-1]]))]  # runs of blanks become one
    if len(code) < 3:
        return np.empty(0, np.int64)
    h = (code[:-2] * _P[0]) ^ (code[1:-1] * _P[1]) ^ (code[2:] * _P[2])
    h = (h ^ (h >> np.uint32(15))) * _P[1]
    return (h >> np.uint32(32 - BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    """``chance[cell, language]`` of the trigram cells, additively smoothed."""

    names: list[str]
    chance: np.ndarray

    def mixture(self, text: str | None) -> tuple[str, float, list[tuple[str, float]]]:
        """Leading language, its proportion, and the whole mixture, largest first; ties go to the smaller name."""
        cells = trigrams(text)
        if not len(cells) or not self.names:
            return UNKNOWN, 0.0, []
        own, n = np.unique(cells, return_counts=True)
        p, n = self.chance[own], n.astype(float)
        total = n.sum()
        single = n @ np.log(p)
        best = int(single.argmax())
        # The likelihood is concave in the proportions: where no other language has an upward slope, one language is the optimum.
        slope = n @ (p / p[:, best : best + 1]) / total
        if (slope <= 1 + 1e-9).all():
            return self.names[best], 1.0, [(self.names[best], 1.0)]
        chosen = np.flatnonzero(slope >= 1 - 1e-9)
        penalty = 0.5 * np.log(total)
        share, fit = self._estimate(p[:, chosen], n)
        while len(chosen) > 1:
            less = np.delete(np.arange(len(chosen)), share.argmin())
            share_less, fit_less = (np.ones(1), single[chosen[less[0]]]) if len(less) == 1 else self._estimate(p[:, chosen[less]], n)
            if fit - fit_less > penalty:
                break
            chosen, share, fit = chosen[less], share_less, fit_less
        ranked = sorted(((self.names[k], float(s)) for k, s in zip(chosen, share, strict=True)), key=lambda x: (-x[1], x[0]))
        return ranked[0][0], min(1.0, ranked[0][1]), ranked

    @staticmethod
    def _estimate(p: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, float]:
        """Proportions and log-likelihood after expectation-maximisation from equal parts."""
        share = np.full(p.shape[1], 1 / p.shape[1])
        total = n.sum()
        while True:
            slope = (n / (p @ share)) @ p / total
            share = share * slope
            share /= share.sum()
            if total * (slope.max() - 1) <= GAIN:  # bounds what further steps could gain, the likelihood being concave
                return share, float(n @ np.log(p @ share))


def train(docs: DataFrame) -> LanguageModel:
    """Count trigrams of all documents outside fold 1 of 3 with a language; only (language, cell) sums are gathered.

    Their number is the number of languages times the number of cells.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch, texts in slices(batches, "text"):
            for text, lang in zip(texts, batch.column(batch.schema.get_field_index("lang")).to_pylist(), strict=True):
                if lang not in sums:
                    sums[lang] = np.zeros(1 << BITS, np.int64)
                sums[lang] += np.bincount(trigrams(text), minlength=1 << BITS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "cell", "n"])

    learn = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold_of("doc_id", 3) != 1)).select("lang", "text")
    sums = small_batches(learn).mapInArrow(run, "lang string, cell int, n long").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array(sums["lang"].to_pylist(), dtype=object)
    names = sorted(set(lang.tolist()))
    counts = np.zeros((1 << BITS, len(names)))
    for k, name in enumerate(names):
        mine = lang == name
        counts[np.asarray(sums["cell"])[mine], k] = np.asarray(sums["n"])[mine]
    return LanguageModel(names, (counts + 0.5) / (counts.sum(axis=0) + 0.5 * (1 << BITS)))


def identify(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """``held_out``, leading language, its proportion and the mixture of every document.

    Defined cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing could be learned; ties go
    to the smaller name; repeated rows give repeated rows and count twice in training; a null doc_id stays null;
    an empty table gives an empty table; further columns are not read.
    """
    model = model or train(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("mixture", pa.map_(pa.string(), pa.float64()))])
        for batch, texts in slices(batches, "text"):
            found = [model.mixture(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[2] for f in found], schema.field(3).type)],
                schema=schema,
            )

    out = small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, lang_pred string, score double, mixture map<string, double>")
    return out.withColumn("held_out", fold_of("doc_id", 3) == 1)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score")
