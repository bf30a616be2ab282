"""Toxicity: a weighted lexicon matched by Aho-Corasick on folded text, normalised by length, with exception phrases.

Folding makes look-alike characters and digit substitutions equal and turns everything that is no letter into a blank. The lexicon holds
words and beginnings of words that mark toxic rows of a bounded labelled sample beyond chance, with their log-odds. Words that begin alike
but are harmless there, pairs of neighbouring words that are harmless although one of them is an entry, and phrases that a caller names,
are exceptions: hits inside them do not count.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.common import fold_of, schema_of, slices, small_batches, table, tidy
from shelfsense.llm.logistic import calibrate, sample_labels, sigmoid

#: Most labelled rows of each class that training takes.
PER_CLASS = 4000
#: Lengths of the beginnings of words that may become entries.
STEMS = (4, 5, 6, 7, 8)
#: Wrong entries to be expected in the whole lexicon, if labels were dealt at random (Chernoff bound, Bonferroni).
RISK = 0.5

#: Greek and Cyrillic letters, digits and signs that stand for the Latin letter beside them.
LOOKALIKES = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "у": "y", "і": "i", "ј": "j", "ѕ": "s", "к": "k",
    "м": "m", "т": "t", "н": "h", "в": "b", "ԁ": "d", "ո": "n", "ѵ": "v", "ѡ": "w", "г": "r",
    "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ϲ": "c",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ß": "s", "ø": "o", "đ": "d", "ł": "l", "æ": "a", "œ": "o",
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "€": "e", "!": "i", "|": "i",
}
#: Signs that stand for a letter only between letters; at the end of a word they are punctuation.
_SIGNS = "!|$@€"


#: Unicode has no letter from here on; the last code point below is unassigned.
_TOP = 0x34000


def _fold_table() -> np.ndarray:
    """Folded code point of every code point below ``_TOP``; 32 for what is no letter, 0 for what disappears."""
    out = np.full(_TOP, 32, dtype=np.uint32)
    for c in range(_TOP):
        ch = chr(c)
        if ch in LOOKALIKES:
            out[c] = ord(LOOKALIKES[ch])
            continue
        if unicodedata.category(ch) in ("Mn", "Cf"):
            out[c] = 0
            continue
        if not ch.isalnum():
            continue
        # Accented Latin letters are letters of their own; other forms of a letter fold to it.
        base = ch.lower()[:1] if c < 0x250 else unicodedata.normalize("NFKD", ch.lower())[:1].lower()
        base = LOOKALIKES.get(base, base)
        out[c] = ord(base) if base.isalpha() else 32
    out[ord("l")] = out[ord("L")] = ord("i")  # l, I and 1 look alike: one class for text and lexicon
    return out


_table: list[np.ndarray] = []
_ACCENTED = re.compile(r" [a-z]*[^ a-z][^ ]*(?= )")


def _bare(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))
_BETWEEN = re.compile(rf"(?<![^\W\d_])[{re.escape(_SIGNS)}]|[{re.escape(_SIGNS)}](?![^\W\d_])")


def fold(text: str | None) -> str:
    """Folded words between single blanks, with a blank at both ends."""
    if not text:
        return " "
    if not _table:
        _table.append(_fold_table())
    code = np.frombuffer(_BETWEEN.sub(" ", text).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _table[0][np.minimum(code, _TOP - 1)]
    return f" {' '.join(folded[folded > 0].tobytes().decode('utf-32-le').split())} "


@dataclass
class Lexicon:
    entries: dict[str, float]
    exceptions: list[str]
    weights: np.ndarray = field(default_factory=lambda: np.array([0.0, 0.0, 0.0, -2.0]))

    def automaton(self):  # noqa: ANN201
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.entries.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in self.exceptions:
            found.add_word(phrase, (len(phrase), None))
        if len(found):
            found.make_automaton()
        return found


def measures(folded: str, automaton) -> tuple[float, float, float]:  # noqa: ANN001
    """Sum of weights over the root of the length, over the length, and the largest weight. Each word counts once."""
    n = max(1, folded.count(" ") - 1)
    if not len(automaton):
        return 0.0, 0.0, 0.0
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (size, weight) in automaton.iter(folded):
        start = end - size + 1
        if weight is None:
            spared.append((start, end))
        elif weight > hits.get(start, 0.0):
            hits[start] = weight
    # Accents can disguise a word too: whole words count without them.
    for word in _ACCENTED.finditer(folded) if not folded.isascii() else ():
        found = automaton.get(f"{_bare(word[0])} ", None)
        if found and found[1] and found[1] > hits.get(word.start(), 0.0):
            hits[word.start()] = found[1]
    for a, b in spared:
        for start in [s for s in hits if a <= s < b]:
            del hits[start]
    total = sum(hits.values())
    return total / math.sqrt(n), total / n, max(hits.values(), default=0.0)


def _counts(sample: DataFrame) -> DataFrame:
    """Documents of either class that hold each folded word and each beginning, summed per task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(n[0].keys() | n[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([n[1][k] for k in keys], pa.int64()), pa.array([n[0][k] for k in keys], pa.int64())], names=["entry", "toxic", "clean"])
            n[0].clear(), n[1].clear()
            return batch

        for batch, texts in slices(batches, "text"):
            for text, y in zip(texts, batch.column(batch.schema.get_field_index("y")).to_pylist(), strict=True):
                ws = {w for w in fold(text).split() if len(w) > 2}
                n[y].update({f" {w} " for w in ws} | {f" {w[:k]}" for k in STEMS for w in ws if len(w) >= k})
            if len(n[0]) + len(n[1]) > 500_000:
                yield out()
        yield out()

    return small_batches(sample).mapInArrow(tidy(run), "entry string, toxic long, clean long").groupBy("entry").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _pairs(sample: DataFrame, share: dict[str, float]) -> DataFrame:
    """Documents of either class that hold an entry's word with the word before or behind it, and the least share of toxic ones among its entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            rows: list[tuple[str, float, int]] = []
            for text, y in zip(texts, batch.column(batch.schema.get_field_index("y")).to_pylist(), strict=True):
                ws = fold(text).split()
                seen: dict[str, float] = {}
                for k, w in enumerate(ws):
                    own = [share[e] for e in (f" {w} ", *(f" {w[:n]}" for n in STEMS)) if e in share]
                    for pair in (ws[k - 1 : k + 1], ws[k : k + 2]) if own else ():
                        if len(pair) == 2:
                            phrase = f" {' '.join(pair)} "
                            seen[phrase] = min(seen.get(phrase, 1.0), *own)
                rows += [(phrase, least, y) for phrase, least in seen.items()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int64())], names=["phrase", "share", "y"])

    found = small_batches(sample).mapInArrow(tidy(run), "phrase string, share double, y long")
    return found.groupBy("phrase").agg(F.min("share").alias("share"), F.sum("y").alias("toxic"), F.sum(1 - F.col("y")).alias("clean"))


def harmless_pairs(sample: DataFrame, share: dict[str, float]) -> list[str]:
    """Pairs of words that hold an entry and stand in clean documents only, oftener than chance allows for that entry.

    Their number is bounded by the sample; without entries there are none.
    """
    if not share:
        return []
    pairs = _pairs(sample, share).persist()
    least = math.log(max(1, pairs.where("clean >= 2").count()) / RISK)
    chosen = pairs.where((F.col("toxic") == 0) & (F.col("clean") >= 2) & (-F.col("clean") * F.log(1 - F.col("share")) >= least)).orderBy("phrase").collect()
    pairs.unpersist()
    return [r["phrase"] for r in chosen]


def train(docs: DataFrame, labels: DataFrame, phrases: tuple[str, ...] = (), per_class: int = PER_CLASS) -> Lexicon:
    """Learn the lexicon from rows outside fold 0 of 5, at most about ``per_class`` of each class, and the score's curve.

    Without rows of both classes the lexicon is empty and every score is low.
    """
    sample, shift = sample_labels(labels.where(fold_of("doc_id", 5) != 0), "toxic", per_class)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    sizes = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    spared = [fold(p) for p in phrases]
    if len(sizes) < 2:
        return Lexicon({}, spared)
    a, b = F.col("toxic") + 0.5, F.col("clean") + 0.5
    odds = F.log(a / (sizes[1] + 1.0)) - F.log(b / (sizes[0] + 1.0))
    base = sizes[1] / (sizes[0] + sizes[1])
    share = F.col("toxic") / (F.col("toxic") + F.col("clean"))
    # Exponent of the chance that so many of the documents are toxic by accident.
    against = F.when(share >= 1, F.lit(-math.log(base))).otherwise(share * F.log(share / base) + (1 - share) * F.log((1 - share) / (1 - base)))
    surely = F.when(share > base, (F.col("toxic") + F.col("clean")) * against).otherwise(0.0)
    counts = _counts(rows).select("entry", odds.alias("odds"), surely.alias("surely"), "clean", "toxic").persist()
    least = math.log(max(1, counts.where("toxic >= 2").count()) / RISK)
    chosen = counts.where(F.col("surely") >= least).orderBy(F.desc("surely"), "entry").collect()
    entries = {r["entry"]: round(float(r["odds"]), 6) for r in chosen}
    stems = [e for e in entries if not e.endswith(" ")]
    # Every beginning of a word meets all stems; the sample bounds the number of exceptions.
    begun = F.explode(F.array(*(F.substring("entry", 1, k + 1) for k in STEMS))).alias("stem")
    harmless = (
        counts.where(F.col("entry").endswith(" ") & (F.col("clean") >= 2) & (F.col("odds") < 0))
        .select("entry", begun)
        .join(F.broadcast(rows.sparkSession.createDataFrame(pa.table({"stem": pa.array(stems, pa.string())}))), "stem", "left_semi")
        .select("entry")
        .distinct()
        .orderBy("entry")
        .collect()
    )
    counts.unpersist()
    share = {r["entry"]: (r["toxic"] + 0.5) / (r["toxic"] + r["clean"] + 1.0) for r in chosen}
    lexicon = Lexicon(entries, spared + [r["entry"] for r in harmless] + harmless_pairs(rows, share))
    got = _measure(rows, lexicon, ["doc_id", "y"]).toArrow().sort_by([("doc_id", "ascending")]).to_pydict()
    x = np.column_stack([got["root"], got["share"], got["most"]])
    lexicon.weights = (calibrate(x, np.array(got["y"])) + np.array([0.0, 0.0, 0.0, shift])).round(6)
    return lexicon


def _measure(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch, texts in slices(batches, "text"):
            found = np.array([measures(fold(t), automaton) for t in texts])
            kept = [batch.column(batch.schema.get_field_index(c)) for c in keep]
            yield pa.RecordBatch.from_arrays([*kept, *(pa.array(found[:, k]) for k in range(3))], names=[*keep, "root", "share", "most"])

    return small_batches(docs.select(*dict.fromkeys([*keep, "text"]))).mapInArrow(tidy(run), schema_of(docs, keep, "root double, share double, most double"))


def score(docs: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    w = [float(x) for x in lexicon.weights]
    z = F.lit(w[3]) + w[0] * F.col("root") + w[1] * F.col("share") + w[2] * F.col("most")
    return _measure(docs, lexicon, keep).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), z))))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def toxicity(docs: DataFrame, labels: DataFrame, phrases: tuple[str, ...] = ()) -> DataFrame:
    """Score and verdict of every document; ``phrases`` are exceptions beside the learned ones.

    Defined cases: a null or empty text has no hit and gets the low score of a text without one; repeated rows give
    repeated rows; a null doc_id stays null; no labels, or labels of one class only, give an empty lexicon and low scores; an
    empty table gives an empty table; further columns are not read.
    """
    return score(docs, train(docs, labels, phrases), ["doc_id"]).select("doc_id", (fold_of("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that are not predicted toxic, unchanged."""
    lexicon = train(docs, table(spark, sf_dir, "labels"))
    wide = docs.select(F.struct(*docs.columns).alias("_row"), "text")
    return score(wide, lexicon, ["_row"]).where("predicted = 0").select("_row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
