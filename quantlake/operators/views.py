"""Research views over the silver layer."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import divide


def optional(df: DataFrame, name: str, kind: str):  # noqa: ANN201
    """A column, or typed NULL where the table lacks it."""
    return F.col(name).cast(kind) if name in df.columns else F.lit(None).cast(kind).alias(name)


def union_view(tables: Mapping[str, DataFrame], tag: str = "dataset") -> DataFrame:
    """Union by name, each row tagged with its table; columns that a table lacks are NULL."""
    out = None
    for name, df in tables.items():
        part = df.withColumn(tag, F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("a union view needs a table")
    return out


def adjusted_daily(daily: DataFrame, adj_factor: DataFrame, prices: Sequence[str] = ("close",)) -> DataFrame:
    """Prices times the factor of the day (hfq), and over the factor of the latest day in the whole table (qfq)."""
    latest = adj_factor.groupBy("ts_code").agg(F.max_by("adj_factor", "trade_date").alias("latest_adj_factor"))
    out = daily.join(adj_factor.select("ts_code", "trade_date", "adj_factor"), ["ts_code", "trade_date"], "left").join(latest, "ts_code", "left")
    hfq = {f"{p}_hfq": F.col(p) * F.col("adj_factor") for p in prices}
    qfq = {f"{p}_qfq": divide(F.col(p) * F.col("adj_factor"), F.nullif("latest_adj_factor", F.lit(0.0))) for p in prices}
    return out.withColumns(hfq | qfq)


def adjusted_returns(adjusted: DataFrame) -> DataFrame:
    """Return against the previous row of the security, however long ago that was."""
    before = F.lag("close_hfq").over(Window.partitionBy("ts_code").orderBy("trade_date"))
    return adjusted.withColumn("return_adjusted", divide("close_hfq", F.nullif(before, F.lit(0.0))) - 1.0)


def stock_universe_daily(daily: DataFrame, stock_basic: DataFrame | None, suspend_d: DataFrame | None, columns: Sequence[str] = ("name", "list_date", "delist_date")) -> DataFrame:
    """Flags of each security and day; without metadata a security is not listed, and the current name decides on ST.

    A security whose dates are unknown counts as listed, as long as there is a row for it.
    """
    out = daily.select("ts_code", "trade_date")
    if stock_basic is None:
        out = out.withColumns({x: F.lit(None).cast("string") for x in columns}).withColumn("_known", F.lit(False))
    else:
        out = out.join(stock_basic.select("ts_code", *(optional(stock_basic, x, "string") for x in columns), F.lit(True).alias("_known")), "ts_code", "left")
    if suspend_d is None:
        out = out.withColumn("is_suspended", F.lit(False))
    else:
        halted = suspend_d.select("ts_code", "trade_date").distinct().withColumn("_halted", F.lit(True))
        out = out.join(halted, ["ts_code", "trade_date"], "left").withColumn("is_suspended", F.coalesce("_halted", F.lit(False))).drop("_halted")
    not_yet, no_more = F.coalesce(F.col("trade_date") < F.col("list_date"), F.lit(False)), F.coalesce(F.col("trade_date") > F.col("delist_date"), F.lit(False))
    listed = F.coalesce("_known", F.lit(False)) & ~not_yet & ~no_more
    return out.withColumns({"is_listed_on_date": listed, "is_st_name": F.coalesce(F.col("name").contains("ST"), F.lit(False))}).drop("_known")


def asof_intervals(reports: DataFrame) -> DataFrame:
    """visible_from is the announcement; next_visible_from the next one for the same period."""
    order = [F.col("ann_date").asc_nulls_last()] + ([F.col("_ingested_at").asc_nulls_last()] if "_ingested_at" in reports.columns else [])
    nxt = F.lead("ann_date").over(Window.partitionBy("ts_code", "end_date").orderBy(*order))
    return reports.withColumns({"visible_from": F.col("ann_date"), "next_visible_from": nxt})


def open_trade_dates(trade_cal: DataFrame, start: str, end: str) -> DataFrame:
    return trade_cal.filter(F.col("cal_date").between(start, end) & (F.col("is_open").cast("string") == "1")).select(F.col("cal_date").cast("string").alias("trade_date")).distinct()
