"""Null-safe column expressions: arithmetic, ranks, compounding, correlations.

Missing values are NULL everywhere; NaN and infinities become NULL at the edge (``number``).  Ranks are taken on quantised
values, so that the order of a floating-point sum never moves a portfolio edge.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def number(c: str | Column) -> Column:
    """A double, or NULL for what is no finite number."""
    x = col(c).try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def quantise(c: str | Column, digits: int = 6) -> Column:
    scale = F.lit(float(10**digits))
    return F.floor(col(c) * scale + 0.5) / scale


def divide(a: str | Column, b: str | Column) -> Column:
    return F.try_divide(col(a), col(b))


def clip(c: str | Column, low: Column, high: Column) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), low), high))


def compound(c: str | Column) -> Column:
    """Product of 1 + r, less 1, over rows whose r is not null."""
    return F.product(F.lit(1.0) + col(c)) - 1.0


def compound_or_zero(c: str | Column) -> Column:
    """As ``compound``; 0 if there is no value."""
    return F.coalesce(F.product(F.lit(1.0) + col(c)), F.lit(1.0)) - 1.0


def annualised(c: str | Column, periods: int) -> Column:
    """(product of 1 + r) ** (periods / n) - 1 over non-null values."""
    return F.pow(F.product(F.lit(1.0) + col(c)), F.lit(float(periods)) / F.count(col(c))) - 1.0


def average_rank(value: str, keys: Sequence[str]) -> Column:
    """Rank from 1 with ties at their mean; NULL for NULL."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = F.count(value).over(Window.partitionBy(*keys, value))
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (ties - 1) / 2.0)


def percent_rank(value: str, keys: Sequence[str]) -> Column:
    """Mean rank over the number of non-null values."""
    return average_rank(value, keys) / F.count(value).over(Window.partitionBy(*keys))


def correlation(a: str | Column, b: str | Column) -> Column:
    """Pearson correlation as an aggregate over rows where both are set; NULL where either does not vary."""
    a, b = (F.when(col(a).isNotNull() & col(b).isNotNull(), x) for x in (col(a), col(b)))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def weighted_mean(value: str | Column, weight: str | Column) -> Column:
    v, w = col(value), col(weight)
    return F.try_divide(F.sum(v * w), F.sum(F.when(v.isNotNull(), w)))


def bucket(order: WindowSpec, count: Column, buckets: int) -> Column:
    """ceil(place * buckets / count) within 1 to ``buckets``."""
    place = F.row_number().over(order)
    return F.least(F.greatest(F.ceil(place * F.lit(float(buckets)) / count), F.lit(1)), F.lit(buckets)).cast("int")


def layer_name(factor: str | Column, layer: str | Column) -> Column:
    return F.format_string("%s_D%02d", col(factor), col(layer))


def split_layer_name(name: str | Column) -> tuple[Column, Column]:
    """(base, layer) of a layer name; the layer is NULL where the end is no number."""
    base = F.regexp_extract(col(name), r"^(.*)_D(\d+)$", 1)
    layer = F.regexp_extract(col(name), r"^(.*)_D(\d+)$", 2)
    return F.when(base != "", base).otherwise(col(name)), layer.try_cast("int")


def month(date: str | Column) -> Column:
    return F.concat_ws("-", F.substring(col(date), 1, 4), F.substring(col(date), 5, 2))


def compact_date(c: str | Column) -> Column:
    """YYYYMMDD of a date with or without dashes; NULL for what is no date."""
    text = F.regexp_replace(col(c).cast("string"), "-", "")
    return F.when(text.rlike("^[0-9]{8}$") & F.try_to_timestamp(text, F.lit("yyyyMMdd")).isNotNull(), text)


def dashed_date(c: str | Column) -> Column:
    """YYYY-MM-DD of a compact date."""
    return F.concat_ws("-", F.substring(col(c), 1, 4), F.substring(col(c), 5, 2), F.substring(col(c), 7, 2))
