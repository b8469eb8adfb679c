"""Calendars, portfolios, turnover, backtests and performance."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import annualised, compound, compound_or_zero, divide, month, quantise


def rebalance_calendar(trade_dates: DataFrame, start: str, end: str) -> DataFrame:
    """The last trading day of each month within the span, and the next trading day of all; none after ``end``."""
    every = trade_dates.select("trade_date").distinct().withColumn("exec_date", F.lead("trade_date").over(Window.orderBy("trade_date")))
    months = every.filter(F.col("trade_date").between(start, end)).groupBy(F.substring("trade_date", 1, 6).alias("m"))
    last = months.agg(F.max(F.struct("trade_date", "exec_date")).alias("x")).select(F.col("x.trade_date").alias("signal_date"), "x.exec_date")
    return last.filter(F.col("exec_date").isNotNull() & (F.col("exec_date") <= end))


def period_calendar(calendar: DataFrame) -> DataFrame:
    """With the execution date of the next period and the period's number from 0."""
    order = Window.orderBy("signal_date")
    return calendar.select("signal_date", "exec_date", F.lead("exec_date").over(order).alias("next_exec_date"), (F.row_number().over(order) - 1).alias("period"))


def top_quantile_weights(scores: DataFrame, quantile: float = 0.2, score: str = "score") -> DataFrame:
    """Equal weights of the best ceil(q * n), at least one; equal scores in the order of the code."""
    rows = scores.filter(F.col(score).isNotNull()).groupBy("factor", "trade_date", "ts_code").agg(F.avg(score).alias("_s"))
    keys = ["factor", "trade_date"]
    n = F.greatest(F.lit(1), F.ceil(F.count("*").over(Window.partitionBy(*keys)) * F.lit(quantile)))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("_s").desc(), "ts_code"))
    return rows.withColumns({"_n": n, "_p": place}).filter(F.col("_p") <= F.col("_n")).select("factor", "trade_date", "ts_code", (F.lit(1.0) / F.col("_n")).alias("weight"))


def filter_execution_universe(scores: DataFrame, calendar: DataFrame, eligible_at_exec: DataFrame) -> DataFrame:
    """Scores of securities that can be traded on the execution date of their signal."""
    days = F.broadcast(calendar.select(F.col("signal_date").alias("trade_date"), "exec_date").distinct())
    fit = eligible_at_exec.select("exec_date", "ts_code")
    return scores.join(days, "trade_date").join(fit, ["exec_date", "ts_code"], "left_semi").drop("exec_date").select(*scores.columns)


def turnover(weights: DataFrame) -> DataFrame:
    """One-way turnover of each date against the previous date with a portfolio; 1 on the first.

    Each weight counts on its own date and, negative, on the next: the sums by security are the changes.
    """
    days = weights.select("factor", "trade_date").distinct()
    order = Window.partitionBy("factor").orderBy("trade_date")
    days = days.withColumns({"next_date": F.lead("trade_date").over(order), "is_first": F.lag("trade_date").over(order).isNull()})
    out = weights.join(days.select("factor", "trade_date", "next_date"), ["factor", "trade_date"])
    left = out.filter(F.col("next_date").isNotNull()).select("factor", F.col("next_date").alias("trade_date"), "ts_code", (-F.col("weight")).alias("weight"))
    change = weights.select("factor", "trade_date", "ts_code", "weight").unionByName(left).groupBy("factor", "trade_date", "ts_code").agg(F.sum("weight").alias("d"))
    total = change.groupBy("factor", "trade_date").agg((F.sum(F.abs("d")) / 2.0).alias("t"))
    return total.join(days, ["factor", "trade_date"]).select("factor", "trade_date", quantise(F.when(F.col("is_first"), F.lit(1.0)).otherwise(F.col("t")), 10).alias("turnover"))


def period_days(returns: DataFrame, calendar: DataFrame, end: str) -> DataFrame:
    """(signal_date, exec_date, day) of the days in each period, after its execution up to the next; both sides are calendars."""
    days = returns.select(F.col("trade_date").alias("day")).distinct()
    periods = period_calendar(calendar)
    inside = (F.col("day") > F.col("exec_date")) & (F.col("day") <= F.coalesce("next_exec_date", F.lit(end)))
    return days.join(F.broadcast(periods), inside).select("signal_date", "exec_date", "day")


def backtest(weights: DataFrame, returns: DataFrame, calendar: DataFrame, end: str, cost: float = 0.001, suspensions: DataFrame | None = None) -> DataFrame:
    """Daily portfolio returns.

    A missing return counts 0 where the security is suspended and is otherwise left out, the rest being scaled up; with
    nothing left the day returns 0.  The cost of the turnover is taken off on a period's first day.
    """
    days = F.broadcast(period_days(returns, calendar, end))
    held = weights.withColumnRenamed("trade_date", "signal_date").join(days, "signal_date")
    r = returns.select(F.col("trade_date").alias("day"), "ts_code", "return_adjusted")
    rows = held.join(r, ["day", "ts_code"], "left")
    if suspensions is None:
        rows = rows.withColumn("_halted", F.lit(False))
    else:
        halted = suspensions.select(F.col("trade_date").alias("day"), "ts_code").distinct().withColumn("_h", F.lit(True))
        rows = rows.join(halted, ["day", "ts_code"], "left").withColumn("_halted", F.coalesce("_h", F.lit(False)))
    missing = F.col("return_adjusted").isNull()
    counted = ~missing | F.col("_halted")
    per_day = rows.groupBy("factor", "signal_date", "exec_date", "day").agg(
        F.sum(F.when(counted, F.col("weight") * F.coalesce("return_adjusted", F.lit(0.0)))).alias("_r"),
        F.sum(F.when(counted, F.col("weight"))).alias("_w"),
        F.count("*").alias("holding_count"),
        F.count_if(missing & F.col("_halted")).alias("suspended_count"),
        F.count_if(missing & ~F.col("_halted")).alias("invalid_missing_count"),
    )
    charged = per_day.join(turnover(weights).withColumnRenamed("trade_date", "signal_date"), ["factor", "signal_date"])
    first = F.row_number().over(Window.partitionBy("factor", "signal_date").orderBy("day")) == 1
    gross = F.coalesce(divide("_r", "_w"), F.lit(0.0))
    fee = F.when(first, F.col("turnover") * cost).otherwise(0.0)
    return charged.select(
        "factor", "signal_date", F.col("day").alias("trade_date"), quantise(gross - fee, 10).alias("portfolio_return"), quantise(F.coalesce("_w", F.lit(0.0)), 10).alias("active_weight"), "holding_count", "suspended_count", "invalid_missing_count"
    )


def benchmark_returns(index_daily: DataFrame) -> DataFrame:
    before = F.lag("close").over(Window.partitionBy("ts_code").orderBy("trade_date"))
    return index_daily.select("trade_date", (divide("close", F.nullif(before, F.lit(0.0))) - 1.0).alias("benchmark_return"))


def nav(daily: DataFrame, keys: tuple[str, ...] = ("factor",), value: str = "portfolio_return") -> DataFrame:
    """Compounded value from 1, and the drawdown against its highest so far."""
    so_far = Window.partitionBy(*keys).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    out = daily.withColumn("nav", F.product(1.0 + F.coalesce(value, F.lit(0.0))).over(so_far))
    return out.withColumn("drawdown", divide("nav", F.max("nav").over(so_far)) - 1.0)


def performance(daily: DataFrame, benchmark: DataFrame, turnovers: DataFrame, year: int = 252) -> DataFrame:
    """Metrics of each factor's daily returns; the Sharpe ratio is annual return over annual deviation."""
    rows = nav(daily).join(benchmark, "trade_date", "left").withColumn("b", F.coalesce("benchmark_return", F.lit(0.0)))
    n = rows.groupBy("factor").agg(
        F.min("trade_date").alias("start_date"),
        F.max("trade_date").alias("end_date"),
        F.count("*").alias("trading_days"),
        annualised("portfolio_return", year).alias("annual_return"),
        (F.stddev_pop("portfolio_return") * F.lit(math.sqrt(year))).alias("annual_volatility"),
        F.min("drawdown").alias("max_drawdown"),
        compound("portfolio_return").alias("cumulative_return"),
        annualised("b", year).alias("benchmark_annual_return"),
        F.sum(F.col("suspended_count") + F.col("invalid_missing_count")).alias("missing_return_count"),
        F.sum("suspended_count").alias("suspended_return_count"),
        F.sum("invalid_missing_count").alias("invalid_missing_return_count"),
        F.avg(1.0 - F.col("active_weight")).alias("average_invalid_missing_weight"),
        F.max(1.0 - F.col("active_weight")).alias("max_invalid_missing_weight"),
    )
    t = turnovers.groupBy("factor").agg(F.avg("turnover").alias("average_monthly_turnover"), (F.avg("turnover") * 12).alias("annualized_turnover"))
    return n.join(t, "factor", "left").withColumns(
        {"sharpe": divide("annual_return", F.nullif("annual_volatility", F.lit(0.0))), "excess_annual_return": F.col("annual_return") - F.col("benchmark_annual_return")}
    )


def monthly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("factor", month("trade_date").alias("month")).agg(compound("portfolio_return").alias("monthly_return"))


def yearly_returns(daily: DataFrame) -> DataFrame:
    return daily.groupBy("factor", F.substring("trade_date", 1, 4).alias("year")).agg(compound_or_zero("portfolio_return").alias("yearly_return"))


def coverage(scores: DataFrame, weights: DataFrame, score: str = "score") -> DataFrame:
    """Dates, rows and mean breadth of each factor's scores and holdings."""
    per_date = scores.groupBy("factor", "trade_date").agg(F.count(score).alias("valid"))
    of_scores = per_date.groupBy("factor").agg(
        F.count("*").alias("signal_count"), F.min("trade_date").alias("first_signal"), F.max("trade_date").alias("last_signal"), F.avg("valid").alias("average_valid_stocks"), F.sum("valid").alias("valid_rows")
    )
    held = weights.groupBy("factor", "trade_date").agg(F.count("*").alias("h")).groupBy("factor").agg(F.avg("h").alias("average_holding_count"))
    return of_scores.join(held, "factor", "left")


def compare_metrics(raw: DataFrame, neutral: DataFrame, names: tuple[str, ...] = ("annual_return", "excess_annual_return", "sharpe", "max_drawdown", "cumulative_return", "average_monthly_turnover")) -> DataFrame:
    """Both sets of metrics side by side with their differences."""
    a = raw.select("factor", *(F.col(x).alias(f"{x}_raw") for x in names))
    b = neutral.select("factor", *(F.col(x).alias(f"{x}_neutralized") for x in names))
    out = a.join(b, "factor", "outer")
    return out.withColumns({f"{x}_delta": F.col(f"{x}_neutralized") - F.col(f"{x}_raw") for x in names})
