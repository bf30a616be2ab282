"""Text and number expressions with the edge behaviour the log formats need."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace to trim is every character up to and including U+0020.
BLANKS = "".join(chr(c) for c in range(0x21))


def trim_all(col: Column) -> Column:
    """Trim tabs, line ends and other control characters as well as spaces."""
    return F.trim(col, F.lit(BLANKS))


def bar_field(col: Column, index: int) -> Column:
    """Trimmed ``index``-th part (from 0) of a ``|``-separated text, empty when there are too few."""
    return trim_all(F.split_part(col, F.lit("|"), F.lit(index + 1)))


def bars_to_spaces(col: Column) -> Column:
    return F.translate(col, "|", " ")


def words(col: Column) -> Column:
    """Lower-cased, whitespace-separated words; an empty text has none."""
    return F.filter(F.split(F.lower(col), "\\s"), lambda w: w != "")


def hash_bucket(word: Column, buckets: int) -> Column:
    """Bucket of a word from 0: its 32-bit murmur3 (seed 42, trailing bytes mixed one by one) modulo ``buckets``, never negative."""
    return F.pmod(F.hash(word), F.lit(buckets))


def string_hash32(col: Column) -> Column:
    """Signed 32-bit polynomial hash (base 31) over UTF-16 code units; a user's id from the name."""
    unit_hex = F.hex(F.encode(col, "UTF-16BE"))
    units = F.when(F.length(col) > 0, F.sequence(F.lit(0), (F.length(unit_hex) / 4).cast("int") - 1))
    unsigned = F.aggregate(
        F.coalesce(units, F.array().cast("array<int>")),
        F.lit(0).cast("bigint"),
        lambda acc, i: (
            acc * F.lit(31) + F.conv(F.substring(unit_hex, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
        ).bitwiseAND(F.lit(0xFFFFFFFF)),
    )
    signed = F.when(unsigned >= F.lit(2**31), unsigned - F.lit(2**32)).otherwise(unsigned)
    return F.when(col.isNotNull(), signed.cast("int"))


# Parts of the ranking report.
REPORT_TIME = "时间:"
REPORT_ITEM = ": 商品ID="
REPORT_VIEWS = " 浏览量="
REPORT_END = "================================"


def window_report(window_end: Column, top: Column) -> Column:
    """Text report of a window (end in epoch seconds) and its ranked array of struct(itemId, nums)."""
    time = F.date_format(F.timestamp_seconds(window_end), "yyyy-MM-dd HH:mm:ss'.0'")
    lines = F.transform(
        top,
        lambda x, i: F.concat(
            F.lit("No"),
            (i + 1).cast("string"),
            F.lit(REPORT_ITEM),
            x["itemId"].cast("string"),
            F.lit(REPORT_VIEWS),
            x["nums"].cast("string"),
        ),
    )
    return F.array_join(F.concat(F.array(F.concat(F.lit(REPORT_TIME), time)), lines, F.array(F.lit(REPORT_END))), "\n")
