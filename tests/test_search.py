"""Product search by trigrams against trying every name."""

import random
import re

import pytest

from shelfsense import schemas
from shelfsense.operators import search
from shelfsense.sources.buckets import read_buckets, write_bucketed

WORDS = ["bolt", "ring", "red", "steel", "nut", "abcd", "abccdef", "abd", "xxbolt", "鋼ring"]
PATTERNS = [
    "bolt", "r.*(bolt|ring)$", "^steel .*nut$", "abc+def", "abcd{0,2}", "(bolt)?ring", "(bolt|ab)d", "x{2,3}bolt", "bol(t|s)",
    "nothing here", "red|nut", "[a]bcd", "\\w+ring", "(?i)BOLT", "", "ab", "鋼ring", "(red |steel )+nut", "Bolt",
]


@pytest.fixture(scope="module")
def names():
    rng = random.Random(3)
    made = {n: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(1, 5))) for n in range(300)}
    return made | {300: None, 301: "", 302: "ab", 303: "bolt" * 50, 304: "red\nring"}


@pytest.fixture(scope="module")
def shop(spark, names, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("search"))
    products = spark.createDataFrame([(p, n, "u", "c", "t") for p, n in names.items()], schemas.PRODUCT)
    write_bucketed(search.trigrams(products), f"{folder}/index", "gram", 8)
    write_bucketed(products, f"{folder}/products", "productId", 8)
    index = lambda grams: read_buckets(spark, f"{folder}/index", grams, "gram", 8)
    stored = lambda ids: read_buckets(spark, f"{folder}/products", ids, "productId", 8)
    return index, stored, products


@pytest.mark.parametrize("pattern", PATTERNS)
def test_search_equals_scan(shop, names, pattern):
    index, stored, products = shop
    got = sorted(r.productId for r in search.search(pattern, index, stored, products).collect())
    assert got == [p for p, n in names.items() if n is not None and re.search(pattern, n, re.ASCII)]


def test_index_holds_each_trigram_once(shop, names):
    index, _, products = shop
    got = sorted(tuple(r) for r in search.trigrams(products).collect())
    assert got == sorted((g, p) for p, n in names.items() for g in search.grams_of(n or ""))


def test_only_candidates_are_tried(spark, shop):
    """With a clause the whole table is never opened, and few names are tried; without one the scan is the way."""
    index, stored, products = shop
    asked = []

    def counted(ids):
        asked.append(ids.count())
        return stored(ids)

    hits = search.search("steel .*nut$", index, counted, products.limit(0)).count()
    assert 0 < hits <= asked[0] < 150
    assert search.required("red|nut") == [] and search.search("red|nut", None, None, products).count() > 0


@pytest.mark.parametrize("pattern", ["(?i)bolt", "a|bolt", "[b]olt", "b\\olt", "(a(bolt))", "bolt)", "(bolt"])
def test_patterns_without_clause(pattern):
    assert search.required(pattern) == []
