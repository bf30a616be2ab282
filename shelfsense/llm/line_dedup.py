"""Line dedup in DataFrame functions alone: lines that many documents share stay in one document only.

Lines are hashed once and written as (document, position, hash); counting, choosing and dropping work on
these narrow rows. Only the last step touches texts again, and moves each of them once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfsense.llm.common import table
from shelfsense.session import materialise

#: [\x20\x09-\x0D], the characters that are stripped from both ends of a line.
_BLANK = " \t\n\x0b\f\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def line_key(line: Column) -> Column:
    """The line stripped of blanks at both ends, A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_BLANK)), _UPPER, _UPPER.lower())


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``docs`` with ``text`` cleaned, plus ``_n_lines`` and ``_n_dropped``; all columns of ``docs`` stay. Where ``docs`` has a column of
    one of these two names, the new one gets a further ``_`` in front.

    A key of at least ``min_chars`` code points found in at least ``min_docs`` different doc_ids loses all its lines
    except those in the largest of these doc_ids.
    Defined cases: null or empty text is one empty line and comes back empty; a line repeated inside one document
    counts once for the document, and all its copies go or stay together; rows repeated with one doc_id count as one
    document and are all returned; documents with a null doc_id keep their lines and are not counted; an empty table
    gives an empty table; very long texts are whole; further columns pass through, whatever their names.
    """
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    row = F.xxhash64(F.coalesce("text", F.lit("")))
    hashed = (
        docs.where(F.length("text") >= min_chars)
        .where(F.col("doc_id").isNotNull())
        .select("doc_id", row.alias("_row"), F.posexplode(lines).alias("_pos", "_line"))
        .where(F.length("_line") >= min_chars)
        .select("doc_id", "_row", "_pos", line_key(F.col("_line")).alias("_key"))
        .where(F.length("_key") >= min_chars)
        .select("doc_id", "_row", "_pos", F.xxhash64("_key").alias("_h"), F.xxhash64(F.lit(1), "_key").alias("_g"))
    )
    hashed = materialise(hashed, "line-hashes")
    common = (
        hashed.groupBy("_h", "_g", "doc_id")
        .agg(F.lit(1).alias("_one"))
        .groupBy("_h", "_g")
        .agg(F.count("*").alias("_docs"), F.max("doc_id").alias("_keeper"))
        .where(F.col("_docs") >= min_docs)
    )
    # Written first, so that the join below deals both sides anew and adaptive execution can split a hot line.
    common = materialise(common, "common-lines")
    dropped = (
        hashed.join(common, ["_h", "_g"])
        .where(F.col("doc_id") != F.col("_keeper"))
        .groupBy("doc_id", "_row")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    n = F.size("_lines")
    kept = F.transform(
        F.array_except(F.sequence(F.lit(0), n - 1), F.col("_gone")), lambda i: F.element_at("_lines", i + 1)
    )
    # The caller's row travels as one struct, so its names meet none of the names used here.
    whole = docs.select(F.struct("*").alias("_all"), "doc_id", row.alias("_row"))
    names = {"n_lines": n.cast("long"), "n_dropped": F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("long")}
    text = F.when(F.col("_gone").isNull(), F.coalesce("_all.text", F.lit(""))).otherwise(F.array_join(kept, "\n"))
    columns = [text.alias("text") if c == "text" else F.col("_all").getField(c).alias(c) for c in docs.columns]
    for name, value in names.items():
        shown = f"_{name}"
        while shown in docs.columns:
            shown = f"_{shown}"
        columns.append(value.alias(shown))
    return (
        whole.join(dropped, ["doc_id", "_row"], "left")
        .withColumn("_lines", F.split(F.coalesce("_all.text", F.lit("")), "\n", -1))
        .select(*columns)
    )


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the same documents with the dropped lines gone and ``n_chars`` of what is left; cases as in :func:`dedup_lines`."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.col("_n_lines").alias("n_lines"),
        F.col("_n_dropped").alias("n_dropped"),
        F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"),
    )


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40
  GROUP BY k HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT doc_id, pos, line, (c.k IS NOT NULL AND doc_id <> keeper) AS gone
  FROM keyed LEFT JOIN common c ON keyed.k = c.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
