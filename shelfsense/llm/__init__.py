"""Operators for large text corpora: cleaning, deduplication, scoring, tokenising, searching, packing."""
