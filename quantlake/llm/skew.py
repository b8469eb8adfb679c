"""Joins on keys of which one may hold a third of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key with more than one in so many of the rows is hot; there are fewer hot keys than this, so the driver may hold them.
SHARE = 256


def hot_keys(rows: DataFrame, key: str, total: int | None = None) -> dict:
    """The hot keys, fewer than ``SHARE``, and into how many parts of about one in ``SHARE`` of the rows each can be dealt."""
    total = rows.count() if total is None else total
    counts = rows.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") * SHARE > total)
    return {r[0]: math.ceil(r[1] * SHARE / total) for r in counts.collect()}


def is_hot(key: str, hot: dict) -> Column:
    return F.col(key).isin([F.lit(k) for k in hot]) if hot else F.lit(False)


def parts(key: str, hot: dict) -> Column:
    """Into how many parts a key is to be dealt: 1, unless it is hot."""
    if not hot:
        return F.lit(1)
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in hot.items() for x in kv)), F.col(key)), F.lit(1))


def lookup(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The inner join of ``rows`` with a ``table`` that has each key at most once, in which no hot key meets in one task.

    What ``table`` has of the hot keys, fewer than ``SHARE`` rows, is broadcast; the other rows are joined by a shuffle.
    ``rows`` is read more than once, so it should have been written.
    """
    hot = hot_keys(rows, key, total)
    if not hot:
        return rows.join(table, key)
    mine = is_hot(key, hot)
    return rows.filter(mine).join(F.broadcast(table.filter(mine)), key).unionByName(rows.filter(~mine).join(table, key))
