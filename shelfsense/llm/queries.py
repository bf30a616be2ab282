"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from shelfsense.llm import (
    alignment,
    best_fit,
    cross_polytope,
    language_mixture,
    license_scan,
    line_dedup,
    ngram_join,
    packing,
    piece_bpe,
    prefix_trie,
    quality,
    toxicity,
    warc,
)

QUERIES = {
    "op1_line_dedup": line_dedup.query,
    "op2_sentencepiece": piece_bpe.query,
    "op3_language_id": language_mixture.query,
    "op4_nearest_neighbours": cross_polytope.query,
    "op5_ngram_jaccard_join": ngram_join.query,
    "op6_license_scan": license_scan.query,
    "op7_quality_rules": quality.query,
    "op8_warc": warc.query,
    "op9_toxicity": toxicity.query,
    "op10_packing": packing.query,
    "op11_tokenizer_alignment": alignment.query,
    "op12_prefix_trie": prefix_trie.query,
    "op13_best_fit_packing": best_fit.query,
    "op5_ngram_jaccard_links": ngram_join.query_links,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op5_ngram_jaccard_join": ngram_join.ORACLE,
    "op8_warc": warc.ORACLE,
    "op12_prefix_trie": prefix_trie.ORACLE,
}
