"""Forward returns, information coefficients, deciles and exposures."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import annualised, average_rank, bucket, compound, compound_or_zero, correlation, divide, percent_rank, quantise, weighted_mean
from quantlake.operators.portfolio import nav, period_days


def forward_returns(returns: DataFrame, calendar: DataFrame, end: str, codes: DataFrame | None = None, suspensions: DataFrame | None = None) -> DataFrame:
    """Compounded return of each security over each holding period.

    A day without a return counts 0 where the security is suspended, and otherwise makes the period's return NULL.  What is
    missing is counted as days of the period less days with a return: there is a row for each security and period, as asked
    for, but none for each security and day.
    """
    days = period_days(returns, calendar, end)
    length = days.groupBy("signal_date", "exec_date").agg(F.count("*").alias("holding_days"))
    names = (codes if codes is not None else returns).select("ts_code").distinct()
    on_day = F.broadcast(days.withColumnRenamed("day", "trade_date"))
    got = returns.filter(F.col("return_adjusted").isNotNull()).join(on_day, "trade_date").select("signal_date", "ts_code", "trade_date", "return_adjusted", F.lit(0).alias("halted"))
    if suspensions is not None:
        halted = suspensions.select("trade_date", "ts_code").distinct().join(on_day, "trade_date")
        missing = halted.join(returns.filter(F.col("return_adjusted").isNotNull()).select("trade_date", "ts_code"), ["trade_date", "ts_code"], "left_anti")
        got = got.unionByName(missing.select("signal_date", "ts_code", "trade_date", F.lit(None).cast("double").alias("return_adjusted"), F.lit(1).alias("halted")))
    total = got.groupBy("signal_date", "ts_code").agg(
        compound_or_zero("return_adjusted").alias("_r"), F.count("return_adjusted").alias("_n"), F.sum("halted").alias("_h")
    )
    every = names.crossJoin(F.broadcast(length)).join(total, ["signal_date", "ts_code"], "left")
    n, h = F.coalesce("_n", F.lit(0)), F.coalesce("_h", F.lit(0))
    invalid = F.col("holding_days") - n - h
    return every.select(
        "signal_date", "exec_date", "ts_code",
        F.when(invalid == 0, quantise(F.coalesce("_r", F.lit(0.0)), 10)).alias("forward_return"),
        "holding_days", (F.col("holding_days") - n).alias("missing_return_count"), h.alias("suspended_return_count"), invalid.alias("invalid_missing_return_count"),
    )


def information_coefficients(scores: DataFrame, forward: DataFrame, score: str = "score") -> DataFrame:
    """Pearson and rank correlation of scores and forward returns in each (factor, date).

    NULL with fewer than three pairs or where a side does not vary; ranks are taken among complete pairs.
    """
    keys = ["factor", "trade_date"]
    joined = scores.join(forward.select(F.col("signal_date").alias("trade_date"), "ts_code", "forward_return"), ["trade_date", "ts_code"], "left")
    both = F.col(score).isNotNull() & F.col("forward_return").isNotNull()
    pairs = joined.select(*keys, F.when(both, F.col(score)).alias("x"), F.when(both, F.col("forward_return")).alias("y"))
    ranked = pairs.withColumns({"rx": average_rank("x", keys), "ry": average_rank("y", keys)})
    out = ranked.groupBy(*keys).agg(F.count("x").alias("sample_count"), (F.max("x") > F.min("x")).alias("vx"), (F.max("y") > F.min("y")).alias("vy"), correlation("x", "y").alias("ic"), correlation("rx", "ry").alias("rank_ic"))
    fit = (F.col("sample_count") >= 3) & F.col("vx") & F.col("vy")
    return out.select(*keys, *(F.when(fit, quantise(c, 10)).alias(c) for c in ("ic", "rank_ic")), "sample_count")


def summarize_ic(ic: DataFrame) -> DataFrame:
    parts = []
    for c in ("ic", "rank_ic"):
        parts += [
            F.avg(c).alias(f"{c}_mean"),
            F.stddev_pop(c).alias(f"{c}_std"),
            F.avg(F.when(F.col(c).isNotNull(), (F.col(c) > 0).cast("double"))).alias(f"{c}_win_rate"),
            divide(F.avg(c), F.nullif(F.stddev_pop(c), F.lit(0.0))).alias(f"{c}_icir"),
        ]
    out = ic.groupBy("factor").agg(*parts, F.count("rank_ic").alias("periods"))
    return out.withColumns({f"{c}_annual_icir": F.col(f"{c}_icir") * math.sqrt(12) for c in ("ic", "rank_ic")})


def assign_layers(scores: DataFrame, layers: int = 10, score: str = "score", out: str = "decile") -> DataFrame:
    """Layer 1 (lowest) to ``layers`` by score, then code, within each (factor, date)."""
    keys = ["factor", "trade_date"]
    rows = scores.filter(F.col(score).isNotNull())
    order = Window.partitionBy(*keys).orderBy(score, "ts_code")
    return rows.withColumn(out, bucket(order, F.count("*").over(Window.partitionBy(*keys)), layers))


def decile_returns(deciles: DataFrame, forward: DataFrame) -> DataFrame:
    joined = deciles.join(forward.select(F.col("signal_date").alias("trade_date"), "ts_code", "forward_return"), ["trade_date", "ts_code"], "left")
    return joined.groupBy("factor", "trade_date", "decile").agg(quantise(F.avg("forward_return"), 10).alias("mean_return"), F.count("forward_return").alias("stock_count"))


def summarize_deciles(returns: DataFrame) -> DataFrame:
    """How often returns rise with the decile, their mean rank correlation with it, and each decile's mean and annual return."""
    keys = ["factor", "trade_date"]
    rows = returns.filter(F.col("mean_return").isNotNull())
    step = rows.withColumns({"_d": F.col("mean_return") - F.lag("mean_return").over(Window.partitionBy(*keys).orderBy("decile")), "rd": average_rank("decile", keys), "rr": average_rank("mean_return", keys)})
    per_date = step.groupBy(*keys).agg(F.count("*").alias("n"), (F.min("_d") >= 0).alias("rising"), correlation("rd", "rr").alias("rho"))
    shape = per_date.groupBy("factor").agg(
        F.avg(F.when((F.col("n") >= 2) & F.col("rising"), 1.0).otherwise(0.0)).alias("monotonic_ratio"), F.avg(F.when(F.col("n") >= 3, F.col("rho"))).alias("mean_spearman")
    )
    each = rows.groupBy("factor").agg(*(x for d in (1, 5, 10) for x in (F.avg(F.when(F.col("decile") == d, F.col("mean_return"))).alias(f"d{d}_mean"), annualised(F.when(F.col("decile") == d, F.col("mean_return")), 12).alias(f"d{d}_annual"))))
    return shape.join(each, "factor")


def long_short(returns: DataFrame, high: int = 10, low: int = 1) -> DataFrame:
    side = lambda d: F.max(F.when(F.col("decile") == d, F.col("mean_return")))
    return returns.groupBy("factor", "trade_date").agg((side(high) - side(low)).alias("long_short_return"))


def periodic_metrics(rows: DataFrame, value: str = "long_short_return", year: int = 12, keys: tuple[str, ...] = ("factor",)) -> DataFrame:
    """Metrics of period returns; the Sharpe ratio is annual return over annual deviation."""
    known = rows.filter(F.col(value).isNotNull())
    walked = nav(known, keys, value)
    out = walked.groupBy(*keys).agg(
        F.count("*").alias("periods"), annualised(value, year).alias("annual_return"), (F.stddev_pop(value) * math.sqrt(year)).alias("annual_volatility"), F.min("drawdown").alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("win_rate"), compound(value).alias("cumulative_return"),
    )
    return out.withColumn("sharpe", divide("annual_return", F.nullif("annual_volatility", F.lit(0.0))))


def yearly_period_returns(rows: DataFrame, value: str = "long_short_return") -> DataFrame:
    return rows.filter(F.col(value).isNotNull()).groupBy("factor", F.substring("trade_date", 1, 4).alias("year")).agg(compound(value).alias("yearly_return"), F.count("*").alias("periods"))


def size_exposure(scores: DataFrame, weights: DataFrame, exposure: DataFrame) -> DataFrame:
    """Mean log size and size percentile of the portfolio against all scored securities."""
    keys = ["factor", "trade_date"]
    base = scores.filter(F.col("score").isNotNull()).join(exposure.select("trade_date", "ts_code", "log_total_mv"), ["trade_date", "ts_code"], "left")
    base = base.withColumn("pct", percent_rank("log_total_mv", keys))
    held = base.join(weights.select(*keys, "ts_code", "weight"), [*keys, "ts_code"], "left")
    w = F.when(F.col("weight").isNotNull(), F.col("log_total_mv"))
    return held.groupBy(*keys).agg(
        F.avg("log_total_mv").alias("baseline_log_total_mv"),
        weighted_mean(w, "weight").alias("portfolio_log_total_mv"),
        (weighted_mean(w, "weight") - F.avg("log_total_mv")).alias("active_log_total_mv"),
        weighted_mean(F.when(F.col("weight").isNotNull(), F.col("pct")), "weight").alias("portfolio_size_percentile"),
        F.count("*").alias("baseline_count"),
        F.count("weight").alias("holding_count"),
        F.count_if(F.col("log_total_mv").isNull()).alias("missing_size_count"),
    )


def industry_exposure(scores: DataFrame, weights: DataFrame, exposure: DataFrame) -> DataFrame:
    """Industry weights of the portfolio against the share of all scored securities."""
    keys = ["factor", "trade_date"]
    base = scores.filter(F.col("score").isNotNull()).join(exposure.select("trade_date", "ts_code", "industry"), ["trade_date", "ts_code"], "left")
    base = base.withColumn("industry", F.coalesce("industry", F.lit("Unknown"))).join(weights.select(*keys, "ts_code", "weight"), [*keys, "ts_code"], "left")
    per = base.groupBy(*keys, "industry").agg(F.count("*").alias("baseline_count"), F.count("weight").alias("holding_count"), F.coalesce(F.sum("weight"), F.lit(0.0)).alias("portfolio_weight"))
    share = F.col("baseline_count") / F.sum("baseline_count").over(Window.partitionBy(*keys))
    return per.withColumn("baseline_weight", share).withColumn("active_weight", F.col("portfolio_weight") - F.col("baseline_weight"))


def exposure_summary(size: DataFrame, industry: DataFrame) -> DataFrame:
    """Mean active size, percentile, and the mean portfolio weight of unknown industries of each factor."""
    s = size.groupBy("factor").agg(F.avg("active_log_total_mv").alias("mean_active_size"), F.avg("portfolio_size_percentile").alias("mean_size_percentile"))
    i = industry.groupBy("factor").agg(F.avg(F.abs("active_weight")).alias("mean_abs_active"), F.max(F.abs("active_weight")).alias("max_abs_active"))
    unknown = industry.filter("industry = 'Unknown'").groupBy("factor").agg(F.avg("portfolio_weight").alias("unknown_weight"))
    return s.join(i, "factor", "outer").join(unknown, "factor", "left").fillna(0.0, ["unknown_weight"])
