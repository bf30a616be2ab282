"""Corpus pipeline: quality rules, toxicity, line dedup, near duplicates, packing; each stage works on what its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from shelfsense.llm import line_dedup, ngram_join, packing, quality, toxicity
from shelfsense.session import materialise

STAGES = [
    ("quality rules", quality.stage),
    ("toxicity", toxicity.stage),
    ("line dedup", line_dedup.clean),
    ("n-gram Jaccard join", ngram_join.stage),
    ("packing", packing.stage),
]

#: Learned models decide in the first two stages; tests hold run() against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on the documents below ``sf_dir``; every stage is written and read again.

    Each stage defines its own cases; an empty table stays empty to the end.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), "pipeline")
    return STAGES[-1][1](spark, docs, sf_dir)
