"""Joins back to groups of which a few may hold most rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A group with more than this share of all rows is hot; there are fewer of them than the inverse.
HOT_SHARE = 1 / 1000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], total: int | None = None, shuffled: bool = False) -> DataFrame:
    """``rows`` joined on ``keys`` with ``groups``, which has one row for each key and its number of ``rows``.

    Hot groups, at most 1 / ``HOT_SHARE`` of ``total`` rows by their definition, are broadcast, so
    their rows stay where they are; the others meet in a shuffle in which no key has a larger share.
    With ``shuffled`` that holds however small the groups are on disk, where they may take a small
    part of their size in memory. The column ``rows`` is dropped. Null keys join nothing.
    """
    if total is None:
        total = rows.count()
    hot = F.col("rows") > total * HOT_SHARE
    large = F.broadcast(groups.filter(hot).drop("rows"))
    of_large = rows.join(large, keys)
    others = groups.filter(~hot).drop("rows")
    others = others.hint("merge") if shuffled else others
    of_others = rows.join(F.broadcast(groups.filter(hot).select(*keys)), keys, "left_anti").join(others, keys)
    return of_large.unionByName(of_others)
