"""Column clashes, extreme values and odd texts of single operators."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from shelfsense.llm import cross_polytope, language_mixture, line_dedup, toxicity

LONG = "a line of more than forty characters that five documents share"


def test_line_dedup_keeps_clashing_columns(spark):
    clash = ["_gone", "_row", "_lines", "_n_lines", "_n_dropped", "_all", "_h"]
    docs = spark.createDataFrame([(k, f"{LONG}\nown {k}") for k in range(6)], "doc_id long, text string").select("*", *(F.lit(c).alias(c) for c in clash))
    rows = line_dedup.dedup_lines(docs).collect()
    assert len(rows) == 6 and all([r[c] for c in clash] == clash for r in rows)
    assert sorted(r["__n_dropped"] for r in rows) == [0, 1, 1, 1, 1, 1]
    assert line_dedup.clean(spark, docs, "").columns == docs.columns


def test_neighbours_of_extreme_vectors(spark):
    rng = random.Random(4)
    base = [[rng.gauss(0, 1) for _ in range(8)] for _ in range(30)]
    scale = [1.0, 1e-200, 1e200, 1e-310, 1e300]
    rows = [(k, [x * scale[k % 5] for x in v]) for k, v in enumerate(base)]
    got = cross_polytope.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 5 >= 0).collect()
    units = [np.array(v) / max(map(abs, v)) for _, v in rows]
    units = [u / math.sqrt(u @ u) for u in units]
    for q in range(30):
        want = sorted(((-float(units[q] @ units[k]), k) for k in range(30) if k != q))[:5]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])
        assert [r.vec_id for r in mine] == [k for _, k in want]
        assert all(abs(r.score + s) < 1e-9 for r, (s, _) in zip(mine, want, strict=True))


def test_letters_of_the_last_planes():
    assert len(language_mixture.trigrams("\U00030000\U00031234")) > 0
    assert toxicity.fold("\U00030001") != toxicity.fold("")


def test_mixture_reaches_the_optimum():
    rng = np.random.default_rng(3)
    p, n = rng.dirichlet(np.ones(40), 4).T, rng.integers(0, 60, 40).astype(float)
    share, fit = language_mixture.LanguageModel._estimate(p, n)
    for _ in range(20000):
        share = share * ((n / (p @ share)) @ p) / n.sum()
    assert abs(fit - n @ np.log(p @ share)) <= language_mixture.GAIN
