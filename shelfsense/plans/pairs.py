"""Pairs of members inside groups, with large groups cut into a grid of bounded cells.

A group of ``n`` members is cut into ``c = ceil(n / block)`` chunks by a hash of the member. Chunk
``i`` meets chunk ``j`` in cell ``(i, j)``, ``i <= j``, so every unordered pair meets in exactly one
cell, a cell never holds more than about ``2 * block`` rows, and cells of one hot group spread over
the cluster. Groups up to ``block`` members have the single cell ``(0, 0)`` and are not copied.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfsense.plans.joins import counted_join
from shelfsense.session import materialise


def _chunked(members: DataFrame, group: Sequence[str], member: str, block: int) -> tuple[DataFrame, bool]:
    """Adds ``_chunk`` and ``_chunks``; the flag tells whether any group is larger than ``block``."""
    sizes = members.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > block)
    large = materialise(sizes.select(*group, F.ceil(F.col("_n") / block).cast("int").alias("_chunks")), "large-groups")
    if large.isEmpty():
        return members.withColumn("_chunks", F.lit(1)).withColumn("_chunk", F.lit(0)), False
    rows = counted_join(members, large, list(group), "left").withColumn("_chunks", F.coalesce("_chunks", F.lit(1)))
    return rows.withColumn("_chunk", F.pmod(F.xxhash64(member), F.col("_chunks")).cast("int")), True


def cells(members: DataFrame, group: Sequence[str], member: str, block: int) -> DataFrame:
    """Members copied to every cell of their group that needs them: adds ``_i``, ``_j``, ``_chunk``.

    Group the result by (group..., _i, _j): rows with ``_chunk == _i`` face those with ``_chunk == _j``.
    """
    rows, split = _chunked(members, group, member, block)
    if not split:
        return rows.withColumn("_i", F.lit(0)).withColumn("_j", F.lit(0)).drop("_chunks")
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1)).alias("_other")
    return (
        rows.select("*", other)
        .withColumn("_i", F.least("_chunk", "_other"))
        .withColumn("_j", F.greatest("_chunk", "_other"))
        .drop("_chunks", "_other")
    )


def facing_rows(chunk: np.ndarray, i: int, j: int) -> tuple[np.ndarray, np.ndarray]:
    """Row positions of both sides of cell (i, j)."""
    return np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)


def unordered(ids_a: np.ndarray, ids_b: np.ndarray, hit: np.ndarray, same_chunk: bool):
    """Positions of the hits, each unordered pair once: (rows, columns) of ``hit``."""
    if same_chunk:
        hit &= ids_a[:, None] < ids_b[None, :]
    return np.nonzero(hit)


def partner_lists(
    members: DataFrame, group: Sequence[str], member: str, payload: Sequence[str] = (), block: int = 2048, both: bool = False
) -> DataFrame:
    """Every member with arrays of its partners: (group..., a_<col>, b_<col>), the b columns parallel arrays.

    An array holds the members after its own, or with ``both`` all members, its own among them. Every chunk of a group
    becomes one sorted array of about ``block`` members at most, so a pair costs one array entry where it is shuffled. Lists
    inside a chunk need no join; only chunks of a group beyond ``block`` are joined with each other, one row per cell.
    """
    columns = [member, *payload]
    rows, split = _chunked(members.select(*group, *columns), group, member, block)
    lists = rows.groupBy(*group, "_chunk", "_chunks").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("_x"))

    def sides(df: DataFrame, own: str, others: Callable[[str], Column]) -> DataFrame:
        return df.select(*group, *[F.col(f"{own}.{c}").alias(f"a_{c}") for c in columns], *[others(c).alias(f"b_{c}") for c in columns])

    fields = [F.col(f"_x.{c}").alias(f"_x_{c}") for c in columns]
    opened = lists.select(*group, *fields, F.posexplode("_x").alias("_at", "_a"))
    if both:
        inside = sides(opened, "_a", lambda c: F.col(f"_x_{c}"))
    else:
        size = F.size(f"_x_{member}")
        inside = sides(opened.where(F.col("_at") < size - 1), "_a", lambda c: F.slice(f"_x_{c}", F.col("_at") + 2, size))
    if not split:
        return inside
    many = lists.where("_chunks > 1")
    other = F.explode(F.array_except(F.sequence(F.lit(0), F.col("_chunks") - 1), F.array("_chunk")))
    left = many.select(*group, F.col("_chunk").alias("_i"), other.alias("_j"), F.col("_x").alias("_y"))
    right = many.select(*group, other.alias("_i"), F.col("_chunk").alias("_j"), F.col("_x").alias("_z"))
    met = left.join(right, [*group, "_i", "_j"]).select(*group, F.explode("_y").alias("_a"), "_z")
    if not both:
        # Members of different chunks differ, but arrive in either order; the other order is in the cell (j, i).
        met = met.select(*group, "_a", F.filter("_z", lambda e: e[member] > F.col(f"_a.{member}")).alias("_z")).where(F.size("_z") > 0)
    return inside.unionByName(sides(met, "_a", lambda c: F.col(f"_z.{c}")))


def member_pairs(
    members: DataFrame, group: Sequence[str], member: str, payload: Sequence[str] = (), block: int = 2048
) -> DataFrame:
    """Unordered member pairs of every group: (group..., a_<col>, b_<col>), a_member < b_member."""
    columns = [f"{side}_{c}" for side in "ab" for c in (member, *payload)]
    return unfolded(partner_lists(members, group, member, payload, block), [member, *payload]).select(*group, *columns)


def unfolded(lists: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The rows of :func:`partner_lists` with one row per partner."""
    partners = [f"b_{c}" for c in columns]
    kept = [c for c in lists.columns if c not in partners]
    if len(partners) == 1:
        return lists.select(*kept, F.explode(partners[0]).alias(partners[0]))
    return lists.select(*kept, F.inline(F.arrays_zip(*partners)))


def both_directions(pairs: DataFrame, a: str, b: str, src: str, dst: str, keep: Sequence[str]) -> DataFrame:
    """Each unordered pair as two ordered rows (src, dst, keep...), in one pass over the pairs."""
    return pairs.select(
        F.explode(
            F.array(
                F.struct(F.col(a).alias(src), F.col(b).alias(dst)), F.struct(F.col(b).alias(src), F.col(a).alias(dst))
            )
        ).alias("_p"),
        *keep,
    ).select(f"_p.{src}", f"_p.{dst}", *keep)
