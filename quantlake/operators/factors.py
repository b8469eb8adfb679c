"""Factor construction, normalisation and neutralisation.

Time-series stages are partitioned by security, cross-sections by (factor, date): two shuffles, whatever the number of
factors.  Signal dates are a few hundred at most and are broadcast; joins on validity intervals take the security as key and
the interval as a residual, never the interval alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import clip, divide, number, quantise
from quantlake.specs import FACTORS, FactorSpec

SCORE_DIGITS = 10


def eligible(signals: DataFrame, universe: DataFrame, date: str = "trade_date") -> DataFrame:
    """(trade_date, ts_code) of securities that are listed, trading and not ST on the given dates."""
    fit = universe.filter(F.col("is_listed_on_date") & ~F.col("is_suspended") & ~F.col("is_st_name")).select("trade_date", "ts_code")
    return fit.join(F.broadcast(signals.select(F.col(date).alias("trade_date")).distinct()), "trade_date")


def as_factor(df: DataFrame, name: str, value: str) -> DataFrame:
    return df.select(F.lit(name).alias("factor"), "trade_date", "ts_code", F.col(value).cast("double").alias("raw_value"))


def asof_factors(fit: DataFrame, intervals: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Of the reports visible on each date, the value of the latest period, for each factor's column.

    A report without a column's value is no candidate for it.  All columns share one join and one aggregation.
    """
    known = intervals.select("ts_code", "end_date", "ann_date", "visible_from", "next_visible_from", *dict.fromkeys(columns.values()))
    seen = fit.join(known, "ts_code").filter((F.col("visible_from") <= F.col("trade_date")) & (F.col("next_visible_from").isNull() | (F.col("trade_date") < F.col("next_visible_from"))))
    best = lambda c: F.max(F.when(F.col(c).isNotNull(), F.struct("end_date", "visible_from", "ann_date", F.col(c).cast("double").alias("v"))))
    wide = seen.groupBy("trade_date", "ts_code").agg(*(best(c).alias(f"_{k}") for k, c in enumerate(columns.values())))
    long = F.inline(F.array(*(F.struct(F.lit(name).alias("factor"), F.col(f"_{k}.v").alias("raw_value")) for k, name in enumerate(columns))))
    return wide.select("trade_date", "ts_code", long).filter(F.col("raw_value").isNotNull()).select("factor", "trade_date", "ts_code", "raw_value")


def asof_factor(fit: DataFrame, intervals: DataFrame, name: str, column: str) -> DataFrame:
    return asof_factors(fit, intervals, {name: column})


def snapshot_factor(fit: DataFrame, table: DataFrame, name: str, column: str, where: str | None = None) -> DataFrame:
    rows = table if where is None else table.filter(where)
    return as_factor(rows.filter(F.col(column).isNotNull()).join(fit, ["trade_date", "ts_code"]), name, column)


def momentum(fit: DataFrame, returns: DataFrame, start: str, end: str, lag: int = 60, name: str = "Momentum_60D") -> DataFrame:
    """Price over the price ``lag`` rows before, within the slice from ``start`` to ``end``."""
    before = F.lag("close_hfq", lag).over(Window.partitionBy("ts_code").orderBy("trade_date"))
    sliced = returns.filter(F.col("trade_date").between(start, end)).withColumn("_m", divide("close_hfq", F.nullif(before, F.lit(0.0))) - 1.0)
    return as_factor(sliced.filter(F.col("_m").isNotNull()).join(fit, ["trade_date", "ts_code"]), name, "_m")


def rolling_factor(fit: DataFrame, table: DataFrame, column: str, rows: int, how: str, start: str, end: str, name: str, scale: float = 1.0) -> DataFrame:
    """Mean or sample deviation over the last ``rows`` rows, where all of them have a value."""
    window = Window.partitionBy("ts_code").orderBy("trade_date").rowsBetween(1 - rows, 0)
    made = {"avg": F.avg, "stddev": F.stddev_samp}[how](column).over(window) * F.lit(scale)
    sliced = table.filter(F.col("trade_date").between(start, end)).withColumns({"_x": made, "_n": F.count(column).over(window)})
    return as_factor(sliced.filter((F.col("_n") == rows) & F.col("_x").isNotNull()).join(fit, ["trade_date", "ts_code"]), name, "_x")


def turnover_factor(fit: DataFrame, daily_basic: DataFrame, start: str, end: str, rows: int = 20, name: str = "Turnover_20D") -> DataFrame:
    return rolling_factor(fit, daily_basic, "turnover_rate_f", rows, "avg", start, end, name)


def volatility_factor(fit: DataFrame, returns: DataFrame, start: str, end: str, rows: int = 252, year: int = 252, name: str = "Volatility") -> DataFrame:
    return rolling_factor(fit, returns, "return_adjusted", rows, "stddev", start, end, name, math.sqrt(year))


def price_factors(fit: DataFrame, returns: DataFrame, start: str, end: str, lag: int = 60, rows: int = 252, year: int = 252, names: tuple[str, str] = ("Momentum_60D", "Volatility")) -> DataFrame:
    """``momentum`` and ``volatility_factor`` from one pass over the returns: one shuffle, one sort, one join."""
    order = Window.partitionBy("ts_code").orderBy("trade_date")
    window = order.rowsBetween(1 - rows, 0)
    made = returns.filter(F.col("trade_date").between(start, end)).select(
        "trade_date", "ts_code", (divide("close_hfq", F.nullif(F.lag("close_hfq", lag).over(order), F.lit(0.0))) - 1.0).alias("_m"),
        F.when(F.count("return_adjusted").over(window) == rows, F.stddev_samp("return_adjusted").over(window) * F.lit(math.sqrt(year))).alias("_v"),
    )
    long = F.inline(F.array(*(F.struct(F.lit(name).alias("factor"), F.col(c).alias("raw_value")) for name, c in zip(names, ("_m", "_v"), strict=True))))
    return made.join(fit, ["trade_date", "ts_code"]).select("trade_date", "ts_code", long).filter("raw_value is not null").select("factor", "trade_date", "ts_code", "raw_value")


def net_inflow(fit: DataFrame, moneyflow: DataFrame, name: str = "Main_Net_In") -> DataFrame:
    """Large and extra-large purchases less sales; a missing amount counts as nothing."""
    amount = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    total = lambda side: amount(f"{side}_lg_amount") + amount(f"{side}_elg_amount")
    return as_factor(moneyflow.withColumn("_net", total("buy") - total("sell")).join(fit, ["trade_date", "ts_code"]), name, "_net")


def holder_concentration(fit: DataFrame, holders: DataFrame, name: str = "Holder_Concen") -> DataFrame:
    """Summed holdings of the latest period of each announcement, valid until the security's next announcement."""
    total = holders.groupBy("ts_code", "ann_date", "end_date").agg(quantise(F.sum("hold_ratio"), 6).alias("ratio"))
    latest = total.groupBy("ts_code", "ann_date").agg(F.max(F.struct("end_date", "ratio")).alias("x")).select("ts_code", F.col("ann_date").alias("visible_from"), "x.end_date", "x.ratio")
    nxt = F.lead("visible_from").over(Window.partitionBy("ts_code").orderBy("visible_from", "end_date"))
    spans = latest.withColumn("next_visible_from", nxt)
    seen = fit.join(spans, "ts_code").filter((F.col("visible_from") <= F.col("trade_date")) & (F.col("next_visible_from").isNull() | (F.col("trade_date") < F.col("next_visible_from"))))
    best = seen.groupBy("trade_date", "ts_code").agg(F.max(F.struct("end_date", "visible_from", "ratio")).alias("best"))
    return as_factor(best.select("trade_date", "ts_code", F.col("best.ratio").alias("_v")), name, "_v")


def factor_panel(parts: Iterable[DataFrame]) -> DataFrame:
    """All factors in one long table; rows that a source repeats are averaged."""
    every = None
    for part in parts:
        every = part if every is None else every.unionByName(part)
    rows = every.withColumn("raw_value", number("raw_value")).filter(F.col("raw_value").isNotNull())
    return rows.groupBy("factor", "trade_date", "ts_code").agg(quantise(F.avg("raw_value"), 8).alias("raw_value"))


def winsorize_zscore(df: DataFrame, value: str, keys: list[str], lower: float = 0.01, upper: float = 0.99, out: str = "score") -> DataFrame:
    """Clip to exact quantiles of each cross-section and standardise; 0 where nothing varies, NULL for NULL."""
    bounds = df.groupBy(*keys).agg(F.percentile(value, [lower, upper]).alias("_q"))
    clipped = df.join(bounds, keys).withColumn("_c", clip(value, F.col("_q")[0], F.col("_q")[1]))
    whole = Window.partitionBy(*keys)
    deviation = F.stddev_pop("_c").over(whole)
    varies = F.max("_c").over(whole) > F.min("_c").over(whole)
    z = F.when(F.col("_c").isNotNull(), F.when(varies, quantise(divide(F.col("_c") - F.avg("_c").over(whole), deviation), SCORE_DIGITS)).otherwise(0.0))
    return clipped.withColumn(out, z).drop("_q", "_c")


def normalize(panel: DataFrame, specs: Iterable[FactorSpec] = FACTORS) -> DataFrame:
    """Scores of a panel: values in the factor's direction, winsorised and standardised in each (factor, date)."""
    pairs = [F.lit(x) for s in specs for x in (s.name, float(s.direction))]
    directed = panel.withColumn("_d", number("raw_value") * F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("factor")), F.lit(1.0)))
    return winsorize_zscore(directed, "_d", ["factor", "trade_date"]).drop("_d")


def exposures(daily_basic: DataFrame, signals: DataFrame, members: DataFrame) -> DataFrame:
    """(trade_date, ts_code, log_total_mv, industry) on signal dates; the membership that began last wins."""
    size = daily_basic.join(F.broadcast(signals.select("trade_date").distinct()), "trade_date").groupBy("trade_date", "ts_code").agg(F.max("total_mv").alias("total_mv"))
    size = size.withColumn("log_total_mv", F.when(F.col("total_mv") > 0, F.log("total_mv")))
    m = members.select("ts_code", "l1_name", "in_date", "out_date")
    inside = (F.col("in_date") <= F.col("trade_date")) & (F.col("out_date").isNull() | (F.col("trade_date") < F.col("out_date")))
    joined = size.join(m, "ts_code").filter(inside).groupBy("trade_date", "ts_code").agg(F.max(F.struct("in_date", "l1_name")).alias("m"))
    named = size.join(joined, ["trade_date", "ts_code"], "left")
    return named.select("trade_date", "ts_code", quantise("log_total_mv", 10).alias("log_total_mv"), F.coalesce(F.col("m.l1_name"), F.lit("Unknown")).alias("industry"))


def neutralize(scores: DataFrame, exposure: DataFrame, score: str = "score", out: str = "neutralized_score") -> DataFrame:
    """Residual of the score on a constant, log size and industries, in each (factor, date).

    Within industries score and size are put in deviations from their means; what the size explains of the rest is taken off.
    That equals least squares on dummies.  Under three scores, or scores that do not vary, give NULL; a missing size stands at
    the mean of the scored securities, a missing industry is one of its own.
    """
    keys = ["factor", "trade_date"]
    joined = scores.join(exposure.select("trade_date", "ts_code", "industry", "log_total_mv"), ["trade_date", "ts_code"], "left")
    joined = joined.withColumn("industry", F.coalesce("industry", F.lit("Unknown")))
    whole, inner = Window.partitionBy(*keys), Window.partitionBy(*keys, "industry")
    has = F.col(score).isNotNull()
    size = F.when(has, F.coalesce("log_total_mv", F.avg(F.when(has, F.col("log_total_mv"))).over(whole), F.lit(0.0)))
    step = joined.withColumn("_x", size)
    demean = lambda c: F.col(c) - F.avg(F.when(has, F.col(c))).over(inner)
    step = step.withColumns({"_y": demean(score), "_x": F.when(has, demean("_x"))})
    sxx, sxy = F.sum(F.col("_x") * F.col("_x")).over(whole), F.sum(F.col("_x") * F.col("_y")).over(whole)
    beta = F.when(sxx > 1e-12, sxy / sxx).otherwise(0.0)
    enough = (F.count(score).over(whole) >= 3) & (F.max(score).over(whole) > F.min(score).over(whole))
    return step.withColumn(out, F.when(has & enough, quantise(F.col("_y") - beta * F.col("_x"), SCORE_DIGITS))).drop("_x", "_y", "industry", "log_total_mv")
