"""Product search through an index of the three-character pieces (trigrams) of the names.

The index answers which products can match a regular expression; the expression itself is then tried on those products alone.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3

#: One clause per part of a pattern that every match must contain: the trigram sets of its alternatives, one of which a name must hold whole.
Clauses = list[list[set[str]]]


def grams_of(text: str) -> set[str]:
    return {text[i : i + GRAM] for i in range(len(text) - GRAM + 1)}


def trigrams(products: DataFrame) -> DataFrame:
    """The index: (gram, productId), once each. Names shorter than three characters have no entry; no pattern with a clause matches them."""
    name = F.col("name")
    starts = F.when(F.length(name) >= GRAM, F.sequence(F.lit(1), F.length(name) - (GRAM - 1)))
    grams = F.array_distinct(F.transform(starts, lambda i: F.substring(name, i, F.lit(GRAM))))
    return products.select(F.explode(grams).alias("gram"), "productId")


def required(pattern: str) -> Clauses:
    """Clauses of a pattern, none if it may match names that share no trigram.

    Plain runs of letters, digits, spaces, ``_`` and ``-`` outside groups are clauses, and so are groups of alternatives that are such runs.
    Whatever else the pattern holds only separates runs: it is left to the verification. A pattern with alternatives outside groups, or with a
    backslash, a class, a nested or a special group, has none of these safely and gives no clause.
    """
    if any(mark in pattern for mark in ("\\", "[", "(?")):
        return []
    clauses: Clauses = []
    run, at = "", 0

    def plain(text: str) -> bool:
        return all(c.isalnum() or c in " _-" for c in text)

    def optional(position: int) -> bool:
        return pattern[position : position + 1] in ("*", "?", "{")

    def close() -> None:
        nonlocal run
        if len(run) >= GRAM:
            clauses.append([grams_of(run)])
        run = ""

    while at < len(pattern):
        c = pattern[at]
        if c == "(":
            end = pattern.find(")", at)
            inside = pattern[at + 1 : end]
            if end < 0 or "(" in inside:
                return []
            close()
            choices = inside.split("|")
            if not optional(end + 1) and all(plain(choice) and len(choice) >= GRAM for choice in choices):
                clauses.append([grams_of(choice) for choice in choices])
            at = end + 1
            continue
        if c in "|)":
            return []
        if c == "{":
            close()
            at = pattern.find("}", at) + 1 or len(pattern)
            continue
        if plain(c) and not optional(at + 1):
            run += c
        else:
            close()
        if pattern[at + 1 : at + 2] == "+":
            close()
        at += 1
    close()
    return clauses


def candidates(entries: DataFrame, clauses: Clauses) -> DataFrame:
    """(productId) of the products whose trigrams satisfy every clause; ``entries`` is the index, or the part of it with the clauses' grams.

    A product brings at most the pattern's own trigrams to its group.
    """
    wanted = sorted(set().union(*(grams for clause in clauses for grams in clause)))
    held = entries.where(F.col("gram").isin(wanted)).groupBy("productId").agg(F.collect_set("gram").alias("_held"))

    def whole(grams: set[str]) -> Column:
        return F.size(F.array_intersect("_held", F.array(*map(F.lit, sorted(grams))))) == len(grams)

    every = [reduce(Column.__or__, map(whole, clause)) for clause in clauses]
    return held.where(reduce(Column.__and__, every)).select("productId")


def search(
    pattern: str,
    index: Callable[[DataFrame], DataFrame],
    products_of: Callable[[DataFrame], DataFrame],
    all_products: DataFrame,
) -> DataFrame:
    """Products whose name matches an unanchored, case-sensitive regular expression.

    ``index`` gives the index entries of a frame of grams and ``products_of`` the products of a frame of ids, e.g. the readers of bucketed
    tables, which open only the buckets asked for. A pattern without a clause is tried on ``all_products``.
    """
    clauses = required(pattern)
    rows = all_products
    if clauses:
        spark = all_products.sparkSession
        wanted = sorted(set().union(*(grams for clause in clauses for grams in clause)))
        entries = index(spark.createDataFrame([(gram,) for gram in wanted], "gram string"))
        found = candidates(entries, clauses)
        rows = products_of(found).join(found, "productId", "left_semi")
    return rows.where(F.col("name").rlike(pattern))
