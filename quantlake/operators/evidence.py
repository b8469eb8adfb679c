"""Evidence for or against a challenger: paired tests, yearly wins, gates, data quality, reproduction.

Everything is a relation: a test is a row, a gate is a row with what it compares, and the decision is an aggregate of gates.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import divide
from quantlake.specs import BOOTSTRAP_BLOCK, BOOTSTRAP_REPETITIONS, BOOTSTRAP_SEED, FACTORS, LABELS, PRIMARY

#: Terms of the series for erf; enough for statistics up to about sixteen.
TERMS = 300


def paired(advantage: DataFrame) -> DataFrame:
    """(metric, month, value) of the monthly differences that there are."""
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, (c, _) in PRIMARY.items())))
    return advantage.select(F.col("attribution_month").alias("month"), every.alias("x")).select("x.metric", "month", "x.value").filter("value is not null")


def two_sided_p(statistic: Column) -> Column:
    """erfc(|s| / sqrt 2) by the series of positive terms z, z * 2z^2 / 3, ...; NULL for NULL."""
    z = F.abs(statistic) / math.sqrt(2.0)
    start = F.struct(z.alias("term"), z.alias("sum"))

    def step(state: Column, n: Column) -> Column:
        term = state["term"] * 2.0 * z * z / (2 * n + 1)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    erf = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, step, lambda s: s["sum"]) * F.exp(-z * z) * (2.0 / math.sqrt(math.pi))
    return F.when(statistic.isNotNull(), F.greatest(1.0 - erf, F.lit(0.0)))


def newey_west(rows: DataFrame) -> DataFrame:
    """n, lag, statistic and two-sided p value of each metric's mean with Bartlett weights.

    Autocovariances come from a join of each series with itself on the metric; a series has a value a month.
    """
    by = Window.partitionBy("metric")
    placed = rows.withColumns({"k": F.row_number().over(by.orderBy("month")), "n": F.count("*").over(by), "mean": F.avg("value").over(by)})
    lag = F.least(F.greatest(F.lit(1), F.floor(4.0 * F.pow(F.col("n") / 100.0, F.lit(2.0 / 9.0)))), F.col("n") - 1).cast("int")
    own = placed.select("metric", "n", "mean", "k", (F.col("value") - F.col("mean")).alias("d"), lag.alias("lag"))
    other = own.select("metric", F.col("k").alias("k2"), F.col("d").alias("d2"))
    gap = F.col("k") - F.col("k2")
    weight = F.when(gap == 0, 1.0).otherwise(2.0 * (1.0 - gap / (F.col("lag") + 1.0)))
    variance = own.join(other, "metric").filter(gap.between(0, F.col("lag"))).groupBy("metric", "n", "mean", "lag").agg((F.sum(weight * F.col("d") * F.col("d2")) / F.col("n")).alias("lv"))
    statistic = F.when(F.col("n") > 1, divide("mean", F.nullif(F.sqrt(F.greatest("lv", F.lit(0.0)) / F.col("n")), F.lit(0.0))))
    return variance.select("metric", F.col("lag").alias("newey_west_lag"), statistic.alias("newey_west_stat")).withColumn("newey_west_two_sided_p", two_sided_p(F.col("newey_west_stat")))


def block_bootstrap(values: Sequence[float], repetitions: int = BOOTSTRAP_REPETITIONS, block: int = BOOTSTRAP_BLOCK, seed: int = BOOTSTRAP_SEED) -> tuple[float, float]:
    """2.5 and 97.5 % quantiles of means over resampled blocks of consecutive values."""
    v = np.asarray(values, float)
    if not v.size:
        return math.nan, math.nan
    block = min(block, v.size)
    blocks = np.lib.stride_tricks.sliding_window_view(v, block)
    draws = np.random.default_rng(seed).integers(0, len(blocks), (repetitions, math.ceil(v.size / block)))
    means = blocks[draws].reshape(repetitions, -1)[:, : v.size].mean(axis=1)
    low, high = np.quantile(means, [0.025, 0.975])
    return float(low), float(high)


def bootstrap(rows: DataFrame, repetitions: int = BOOTSTRAP_REPETITIONS, block: int = BOOTSTRAP_BLOCK, seed: int = BOOTSTRAP_SEED) -> DataFrame:
    """The bootstrap interval of each metric's mean; a metric's seed is its place among them, and a series a value a month."""
    names = list(PRIMARY)

    def one(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("month")
        name = series["metric"].iloc[0]
        low, high = block_bootstrap(series["value"].to_numpy(), repetitions, block, seed + names.index(name))
        return pd.DataFrame({"metric": [name], "bootstrap_repetitions": [repetitions], "bootstrap_block_months": [min(block, len(series))], "bootstrap_ci_95_low": [low], "bootstrap_ci_95_high": [high]})

    kinds = "metric string, bootstrap_repetitions int, bootstrap_block_months int, bootstrap_ci_95_low double, bootstrap_ci_95_high double"
    return rows.groupBy("metric").applyInPandas(one, kinds).withColumn("bootstrap_significant_positive", F.col("bootstrap_ci_95_low") > 0)


def paired_tests(rows: DataFrame) -> DataFrame:
    """Count, mean, median, win rate and paired t of each metric, with what ``newey_west`` says of it."""
    t = F.when(F.count("*") > 1, divide(F.avg("value"), F.nullif(F.stddev_samp("value") / F.sqrt(F.count("*")), F.lit(0.0))))
    plain = rows.groupBy("metric").agg(F.count("*").alias("months"), F.avg("value").alias("mean_delta"), F.median("value").alias("median_delta"), F.avg((F.col("value") > 0).cast("double")).alias("win_rate"), t.alias("simple_t"))
    return plain.join(newey_west(rows), "metric")


def annual_stability(metrics: DataFrame, challenger: str, baseline: str, years: Sequence[int]) -> DataFrame:
    """Of each whole year and primary metric the values of both, their difference, and who wins."""
    every = F.explode(F.array(*(F.struct(F.lit(name).alias("metric"), F.col(c).alias("value")) for name, (_, c) in PRIMARY.items())))
    rows = metrics.filter(F.col("period").isin([str(y) for y in years])).select(F.col("period").cast("int").alias("year"), "strategy_id", every.alias("x"))
    pick = lambda who: F.max(F.when(F.col("strategy_id") == who, F.col("x.value")))
    out = rows.groupBy("year", F.col("x.metric").alias("metric")).agg(pick(challenger).alias("challenger"), pick(baseline).alias("baseline"))
    out = out.filter("challenger is not null and baseline is not null")
    return out.withColumns({"delta": F.col("challenger") - F.col("baseline"), "challenger_wins": F.col("challenger") > F.col("baseline")})


def complete_years(start: str, end: str) -> list[int]:
    """Years that an evaluation covers but for its first; the last counts from 20 December on."""
    return [y for y in range(int(start[:4]) + 1, int(end[:4]) + 1) if end >= f"{y}1220"]


#: Fixed values: (gate, metric, column, 1 where the challenger must have more or as much, -1 less or as much; strictly?).
COMPARISONS = (
    *(("return", name, column, 1, True) for name, (_, column) in PRIMARY.items()),
    ("drawdown", "d10_d1", "d10_d1_max_drawdown", 1, False),
    ("drawdown", "top20", "top20_max_drawdown", 1, False),
    ("turnover", "d10_d1", "d10_d1_average_two_leg_turnover", -1, False),
    ("turnover", "top20", "top20_average_monthly_turnover", -1, False),
)


def gates(metrics: DataFrame, stability: DataFrame, period: str, challenger: str, baseline: str, years: Sequence[int]) -> DataFrame:
    """(gate, metric, challenger, baseline, passed): what the challenger must do better in the whole period and in two years of three."""
    side = lambda who, c: F.max(F.when(F.col("strategy_id") == who, F.col(c)))
    whole = metrics.filter(F.col("period") == period).agg(*(side(who, c).alias(f"{k}_{tag}") for k, (_, _, c, _, _) in enumerate(COMPARISONS) for who, tag in ((challenger, "a"), (baseline, "b"))))
    rows = []
    for k, (gate, metric, _, sign, strictly) in enumerate(COMPARISONS):
        ahead = (F.col(f"{k}_a") - F.col(f"{k}_b")) * sign
        passed = F.coalesce(ahead > 0 if strictly else ahead >= 0, F.lit(False))
        rows.append(F.struct(F.lit(gate).alias("gate"), F.lit(metric).alias("metric"), F.col(f"{k}_a").alias("challenger"), F.col(f"{k}_b").alias("baseline"), passed.alias("passed")))
    need = math.ceil(2 * len(years) / 3)
    wins = stability.groupBy("metric").agg(F.count_if("challenger_wins").cast("double").alias("wins"))
    names = F.explode(F.array(*(F.lit(n) for n in PRIMARY))).alias("metric")
    every = metrics.sparkSession.range(1).select(names).join(wins, "metric", "left").withColumn("wins", F.coalesce("wins", F.lit(0.0)))
    yearly = every.select(F.lit("annual_stability").alias("gate"), "metric", F.col("wins").alias("challenger"), F.lit(float(need)).alias("baseline"), ((F.col("wins") >= need) & F.lit(need > 0)).alias("passed"))
    return whole.select(F.inline(F.array(*rows))).unionByName(yearly)


def all_gates(compared: DataFrame, intervals: DataFrame, quality: DataFrame) -> DataFrame:
    """With the gates of significance, the interval's low end above 0, and of data, no critical check that did not pass."""
    significant = intervals.select(F.lit("bootstrap").alias("gate"), "metric", F.col("bootstrap_ci_95_low").alias("challenger"), F.lit(0.0).alias("baseline"), F.col("bootstrap_significant_positive").alias("passed"))
    failed = F.count_if(F.col("critical") & (F.col("status") != "passed"))
    data = quality.agg(F.lit("data_quality").alias("gate"), F.lit("critical_failures").alias("metric"), failed.cast("double").alias("challenger"), F.lit(0.0).alias("baseline"), (failed == 0).alias("passed"))
    return compared.unionByName(significant).unionByName(data)


def decision(rows: DataFrame) -> DataFrame:
    """One row: the label that the gates give, and those that did not pass."""
    holds = lambda *names: F.coalesce(F.bool_and(F.when(F.col("gate").isin(*names), F.col("passed"))), F.lit(False))
    label = (
        F.when(~holds("data_quality"), LABELS["insufficient"])
        .when(~holds("return", "annual_stability"), LABELS["worse"])
        .when(holds("bootstrap") & (F.count_if(F.col("gate") == "bootstrap") == len(PRIMARY)) & holds("drawdown", "turnover"), LABELS["replace"])
        .otherwise(LABELS["keep"])
    )
    lost = F.array_sort(F.collect_set(F.when(~F.col("passed"), F.concat_ws(":", "gate", "metric"))))
    return rows.agg(label.alias("label"), F.array_join(lost, ",").alias("failed_gates"))


def quality_gate(returns: DataFrame, index: DataFrame, code: str, panel: DataFrame, calendar: DataFrame, checks: DataFrame, start: str, end: str, first_volatility: str, first_month: str) -> DataFrame:
    """(check_name, status, critical, detail): whether the data cover what an evaluation from ``start`` to ``end`` needs.

    ``checks`` has the newest rows of the catalog's quality table.  Missing values in financial indicators are a warning,
    as rows without an announcement are not used anyway.
    """
    state = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "passed").otherwise("failed")
    row = lambda df, name, ok, detail: df.select(F.lit(name).alias("check_name"), state(ok).alias("status"), F.lit(True).alias("critical"), detail.alias("detail"))
    span = lambda df: df.agg(F.min("trade_date").alias("lo"), F.max("trade_date").alias("hi"), F.count("*").alias("n"))
    covers = (F.col("lo") <= start) & (F.col("hi") >= end)
    shown = F.format_string("min=%s, max=%s, rows=%d", "lo", "hi", "n")
    firsts = panel.groupBy("factor").agg(F.min("trade_date").alias("first")).agg(F.count("*").alias("n"), F.max(F.when(F.col("factor") == "Volatility", F.col("first"))).alias("volatility"))
    begin = calendar.agg(F.min("signal_date").alias("signal"), F.min("exec_date").alias("execution"))
    parts = [
        row(span(returns), "adjusted_return_coverage", covers, shown),
        row(span(index.filter((F.col("ts_code") == code) & F.col("close").isNotNull())), "benchmark_coverage", covers, F.concat(F.lit(f"benchmark={code}, "), shown)),
        row(firsts, "frozen_factor_availability", (F.col("n") == len(FACTORS)) & (F.col("volatility") <= first_volatility), F.format_string("factor_count=%d, first_volatility=%s", "n", "volatility")),
        row(begin, "evaluation_boundary", F.col("execution").startswith(first_month), F.format_string("first_signal=%s, first_execution=%s", "signal", "execution")),
    ]
    lenient = (F.col("dataset") == "fina_indicator_vip") & (F.col("check_name") == "dataset_integrity") & (F.col("status") != "passed")
    parts.append(checks.select(F.concat_ws(":", F.lit("catalog"), "dataset", "check_name").alias("check_name"), F.when(lenient, "warning").otherwise(F.col("status")).alias("status"), (~lenient).alias("critical"), "detail"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def reproduction(now: DataFrame, archived: DataFrame, keys: Sequence[str], names: Sequence[str], rtol: float = 1e-9, atol: float = 1e-10) -> DataFrame:
    """Which values of an archived result are met within tolerance; two missing values are equal."""

    def long(df: DataFrame, name: str) -> DataFrame:
        return df.select(*keys, F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias(name)) for n in names))).alias("x")).select(*keys, "x.*")

    near = F.abs(F.col("new_value") - F.col("old_value")) <= atol + rtol * F.abs("old_value")
    equal = F.coalesce(near, F.col("new_value").isNull() & F.col("old_value").isNull())
    rows = long(archived, "old_value").join(long(now, "new_value"), [*keys, "metric"], "left")
    return rows.withColumns({"absolute_difference": F.abs(F.col("new_value") - F.col("old_value")), "within_tolerance": equal})
