"""Walk-forward selection: folds, champions, out-of-sample legs and metrics.

Folds and the incumbent's path are a few dozen rows of planning and stay on the driver; candidate statistics, legs and
metrics are DataFrames.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import annualised, compound, divide, quantise
from quantlake.operators.diagnostics import assign_layers, decile_returns, long_short
from quantlake.operators.portfolio import backtest, nav, period_calendar, top_quantile_weights, turnover
from quantlake import specs
from quantlake.specs import WalkForward


@dataclass(frozen=True)
class Fold:
    fold_id: str
    status: str
    decision: str
    embargo: str | None
    train: tuple[str, ...]
    validation: tuple[str, ...]
    oos: tuple[str, ...]


def schedule(periods: list[tuple[str, str, str | None]], config: WalkForward, end: str) -> list[Fold]:
    """Folds over (signal, execution, next execution) rows in order.

    A decision may use periods whose holding has ended by its signal: the last train + validation of them.  The period before
    the decision is under embargo.  A fold whose out-of-sample periods are not all over is the last.
    """
    config.validate()
    need = config.train_periods + config.validation_periods

    def finished(at: int) -> list[str]:
        return [s for s, _, nxt in periods[:at] if nxt is not None and nxt <= periods[at][0]]

    at = next((i for i in range(len(periods)) if len(finished(i)) >= need), len(periods))
    folds: list[Fold] = []
    while at < len(periods):
        history = finished(at)[-need:]
        if len(history) == need:
            asked = periods[at : at + config.oos_periods]
            done = [p for p in asked if p[2] is not None and p[2] <= end]
            complete = len(done) == config.oos_periods
            folds.append(
                Fold(
                    f"F{len(folds) + 1:03d}", "complete" if complete else "incomplete", periods[at][0], periods[at - 1][0] if at else None,
                    tuple(history[: config.train_periods]), tuple(history[-config.validation_periods :]), tuple(p[0] for p in (asked if complete else done)),
                )
            )
            if not complete:
                break
        at += config.step_periods
    return folds


def periods_of(calendar: DataFrame) -> list[tuple[str, str, str | None]]:
    return [tuple(r) for r in period_calendar(calendar).orderBy("signal_date").select("signal_date", "exec_date", "next_exec_date").collect()]


def schedule_frame(spark: SparkSession, folds: list[Fold]) -> DataFrame:
    kinds = "fold_id string, status string, decision_signal_date string, embargo_signal_date string, train_signal_dates array<string>, validation_signal_dates array<string>, oos_signal_dates array<string>"
    return spark.createDataFrame([(f.fold_id, f.status, f.decision, f.embargo, list(f.train), list(f.validation), list(f.oos)) for f in folds], kinds)


def fold_dates(folds: DataFrame) -> DataFrame:
    """(fold_id, part, trade_date) with part train, validation or oos."""
    parts = [folds.select("fold_id", F.lit(p).alias("part"), F.explode(f"{p}_signal_dates").alias("trade_date")) for p in ("train", "validation", "oos")]
    return parts[0].union(parts[1]).union(parts[2])


def bucket_turnover(scores: DataFrame, layers: int = 10) -> DataFrame:
    """Turnover of the lowest and of the highest layer, and their sum."""
    rows = assign_layers(scores, layers).filter(F.col("decile").isin(1, layers))
    n = F.count("*").over(Window.partitionBy("factor", "trade_date", "decile"))
    legs = rows.select(F.concat_ws("|", "factor", "decile").alias("factor"), "trade_date", "ts_code", (1.0 / n).alias("weight"))
    t = turnover(legs).withColumns({"leg": F.substring_index("factor", "|", -1).cast("int"), "factor": F.substring_index("factor", "|", 1)})
    side = lambda d: F.max(F.when(F.col("leg") == d, F.col("turnover")))
    out = t.groupBy("factor", "trade_date").agg(side(1).alias("low_turnover"), side(layers).alias("high_turnover"))
    return out.withColumn("two_leg_turnover", F.coalesce("low_turnover", F.lit(0.0)) + F.coalesce("high_turnover", F.lit(0.0)))


def long_short_periods(scores: DataFrame, forward: DataFrame, config: WalkForward) -> DataFrame:
    """Highest less lowest layer by period: gross, turnover of both legs, its cost, and net."""
    gross = long_short(decile_returns(assign_layers(scores, config.buckets), forward), config.buckets)
    out = gross.join(bucket_turnover(scores, config.buckets), ["factor", "trade_date"], "left")
    cost = F.col("two_leg_turnover") * config.cost
    return out.select(
        "factor", "trade_date", quantise("long_short_return", 10).alias("gross_long_short_return"), "two_leg_turnover", quantise(cost, 12).alias("transaction_cost"), quantise(F.col("long_short_return") - cost, 10).alias("net_long_short_return")
    )


def candidates(rank_ic: DataFrame, periods: DataFrame, folds: DataFrame, config: WalkForward) -> DataFrame:
    """Training and validation statistics of each factor in each complete fold, and whether it may be chosen.

    The Sharpe ratio is mean over deviation, for a year of twelve periods.
    """
    folds = folds.filter("status = 'complete'")
    dates = fold_dates(folds).filter("part != 'oos'")
    ic = rank_ic.join(dates, "trade_date").groupBy("fold_id", "factor").agg(
        F.count(F.when(F.col("part") == "train", F.col("rank_ic"))).alias("train_rankic_periods"),
        F.avg(F.when(F.col("part") == "train", F.col("rank_ic"))).alias("train_rankic_mean"),
        F.count(F.when(F.col("part") == "validation", F.col("rank_ic"))).alias("validation_rankic_periods"),
        quantise(F.avg(F.when(F.col("part") == "validation", F.col("rank_ic"))), 10).alias("validation_rankic_mean"),
    )
    r = F.col("net_long_short_return")
    ls = periods.join(dates.filter("part = 'validation'"), "trade_date").groupBy("fold_id", "factor").agg(
        F.count(r).alias("validation_return_periods"),
        F.avg(r).alias("validation_return_mean"),
        quantise(F.when(F.stddev_pop(r) > 1e-12, F.try_divide(F.avg(r), F.stddev_pop(r)) * math.sqrt(12)), 8).alias("validation_sharpe"),
        quantise(F.avg("two_leg_turnover"), 10).alias("validation_average_two_leg_turnover"),
    )
    every = folds.select("fold_id").crossJoin(rank_ic.select("factor").distinct())
    out = every.join(ic, ["fold_id", "factor"], "left").join(ls, ["fold_id", "factor"], "left").fillna(0, ["train_rankic_periods", "validation_rankic_periods", "validation_return_periods"])
    reasons = F.array(
        F.when(F.col("train_rankic_periods") < config.min_train_rankic, F.lit("insufficient_train_rankic")),
        F.when(F.col("validation_return_periods") < config.min_validation_returns, F.lit("insufficient_validation_returns")),
        F.when(F.col("validation_sharpe").isNull(), F.lit("invalid_validation_sharpe")),
    )
    why = F.array_join(F.filter(reasons, lambda x: x.isNotNull()), "|")
    best = Window.partitionBy("fold_id", "is_eligible").orderBy(F.desc_nulls_last("validation_sharpe"), F.asc_nulls_last("validation_average_two_leg_turnover"), F.desc_nulls_last("validation_rankic_mean"), "factor")
    out = out.withColumn("is_eligible", why == "").withColumn("eligibility_reason", F.when(F.col("is_eligible"), F.lit("eligible")).otherwise(why))
    return out.withColumn("selection_rank", F.when(F.col("is_eligible"), F.row_number().over(best)))


def successor(incumbent: str | None, ranked: dict[str, float], margin: float) -> tuple[str | None, str]:
    """Who holds a fold, and why; ``ranked`` has the Sharpe ratio of the eligible factors, the best first."""
    best, held = next(iter(ranked), None), ranked.get(incumbent)
    if best is None:
        return None, specs.NO_CANDIDATE
    if held is None:
        return best, specs.LOST if incumbent else specs.FIRST
    if ranked[best] >= held + margin and best != incumbent:
        return best, specs.BEATEN
    return incumbent, specs.STAYS if best == incumbent else specs.KEPT


def champions(rows: DataFrame, config: WalkForward) -> list[tuple[str, str | None, str | None, str]]:
    """(fold, incumbent before, champion, reason) in the order of folds: a path over a few dozen rows of candidates.

    The champion of the last fold that had one is the incumbent.
    """
    by_fold: dict[str, dict[str, float]] = {}
    for r in rows.select("fold_id", "factor", "is_eligible", "validation_sharpe").orderBy("fold_id", "selection_rank").collect():
        ranked = by_fold.setdefault(r["fold_id"], {})
        if r["is_eligible"]:
            ranked[r["factor"]] = r["validation_sharpe"]
    incumbent, out = None, []
    for fold, ranked in by_fold.items():
        holder, why = successor(incumbent, ranked, config.switch_margin)
        out.append((fold, incumbent, holder, why))
        incumbent = holder or incumbent
    return out


def selection_log(candidate_rows: DataFrame, path: DataFrame) -> DataFrame:
    """Candidates with the outcome of their fold: every row's reason, which is the fold's for the one selected."""
    chosen = F.coalesce(F.col("factor") == F.col("champion"), F.lit(False))
    why = F.when(chosen | (F.col("fold_reason") == specs.NO_CANDIDATE), F.col("fold_reason")).otherwise(specs.NOT_SELECTED)
    rows = candidate_rows.join(path.withColumnRenamed("decision_reason", "fold_reason"), "fold_id")
    return rows.select("fold_id", "factor", "is_eligible", "selection_rank", "incumbent_before", chosen.alias("selected"), why.alias("decision_reason"), F.col("fold_reason").alias("fold_decision_reason"))


def oos_signals(folds: DataFrame, path: DataFrame) -> DataFrame:
    """(fold_id, decision_signal_date, champion, signal_date) of the out-of-sample dates of complete folds that have a champion."""
    held = path.filter(F.col("champion").isNotNull()).select("fold_id", "champion")
    return folds.filter("status = 'complete'").join(held, "fold_id").select("fold_id", "decision_signal_date", "champion", F.explode("oos_signal_dates").alias("signal_date"))


def oos_inputs(neutral: DataFrame, composites: DataFrame, signals: DataFrame) -> DataFrame:
    """(factor, trade_date, ts_code, score) to be traded out of sample: each fold's champion under one name, and the composites."""
    own = neutral.join(signals.select(F.col("champion").alias("factor"), F.col("signal_date").alias("trade_date")), ["factor", "trade_date"])
    dates = signals.select(F.col("signal_date").alias("trade_date"))
    both = composites.filter(F.col("factor").isin(specs.COMPOSITE_EQUAL, specs.COMPOSITE_ROLLING)).join(dates, "trade_date")
    return own.select(F.lit(specs.CHAMPION).alias("factor"), "trade_date", "ts_code", F.col("neutralized_score").alias("score")).unionByName(both.select("factor", "trade_date", "ts_code", "score"))


def factor_weights(signals: DataFrame, rolling: DataFrame, calendar: DataFrame) -> DataFrame:
    """What each strategy holds of each factor on each out-of-sample date, and up to when what it rests on was known."""
    of_champion = signals.select(
        "fold_id", "signal_date", F.lit(specs.CHAMPION).alias("strategy_id"), F.col("champion").alias("source_factor"), F.lit(1.0).alias("weight"), F.lit("selected_champion").alias("weight_source"),
        F.col("decision_signal_date").alias("weight_as_of_date"), F.lit(None).cast("double").alias("rank_ic_mean"), F.lit(None).cast("long").alias("rank_ic_periods"),
    )
    ended = period_calendar(calendar).filter("next_exec_date is not null").select("next_exec_date")
    known = signals.select("fold_id", "signal_date").join(ended, F.col("next_exec_date") <= F.col("signal_date"), "left").groupBy("fold_id", "signal_date").agg(F.max("next_exec_date").alias("weight_as_of_date"))
    rows = rolling.withColumnRenamed("trade_date", "signal_date").withColumnRenamed("factor", "source_factor").join(known, "signal_date")
    n = F.count("*").over(Window.partitionBy("signal_date"))
    columns = ("fold_id", "signal_date", "strategy_id", "source_factor", "weight", "weight_source", "weight_as_of_date", "rank_ic_mean", "rank_ic_periods")
    equal = rows.withColumns({"weight": quantise(1.0 / n, 12), "strategy_id": F.lit(specs.COMPOSITE_EQUAL), "weight_source": F.lit("equal"), "rank_ic_mean": F.lit(None).cast("double"), "rank_ic_periods": F.lit(0).cast("long")})
    rolled = rows.withColumn("strategy_id", F.lit(specs.COMPOSITE_ROLLING))
    return of_champion.select(*columns).unionByName(equal.select(*columns)).unionByName(rolled.select(*columns))


def oos_daily(scores: DataFrame, returns: DataFrame, calendar: DataFrame, signals: DataFrame, benchmark: DataFrame, end: str, config: WalkForward, suspensions: DataFrame | None = None) -> DataFrame:
    """Daily returns of three legs (top quantile, highest and lowest layer), of highest less lowest, and of the benchmark.

    All legs go through one backtest without cost; each leg's cost is then taken off its first day.
    """
    layers = assign_layers(scores, config.buckets).filter(F.col("decile").isin(1, config.buckets))
    n = F.count("*").over(Window.partitionBy("factor", "trade_date", "decile"))
    name = F.when(F.col("decile") == 1, F.lit("d1")).otherwise(F.lit("d10"))
    legs = layers.select(F.concat_ws("|", "factor", name).alias("factor"), "trade_date", "ts_code", (1.0 / n).alias("weight"))
    top = top_quantile_weights(scores, config.top_quantile)
    weights = legs.unionByName(top.withColumn("factor", F.concat_ws("|", "factor", F.lit("top20"))))
    daily = backtest(weights, returns, calendar, end, 0.0, suspensions)
    t = turnover(weights).withColumnRenamed("trade_date", "signal_date")
    first = F.row_number().over(Window.partitionBy("factor", "signal_date").orderBy("trade_date")) == 1
    rows = daily.join(t, ["factor", "signal_date"]).withColumn("turnover", F.when(first, F.col("turnover")).otherwise(0.0))
    counts = ("suspended_count", "invalid_missing_count")
    rows = rows.select(
        F.substring_index("factor", "|", 1).alias("strategy_id"), F.substring_index("factor", "|", -1).alias("portfolio_leg"), "signal_date", "trade_date",
        F.col("portfolio_return").alias("gross_return"), "turnover", (F.col("turnover") * config.cost).alias("transaction_cost"), *counts,
    )
    pick = lambda leg, c: F.max(F.when(F.col("portfolio_leg") == leg, F.col(c)))
    pair = rows.filter("portfolio_leg in ('d10', 'd1')").groupBy("strategy_id", "signal_date", "trade_date").agg(
        F.lit("long_short").alias("portfolio_leg"), (pick("d10", "gross_return") - pick("d1", "gross_return")).alias("gross_return"), *(F.sum(c).alias(c) for c in ("turnover", "transaction_cost", *counts))
    )
    every = rows.unionByName(pair.filter(F.col("gross_return").isNotNull()))
    out = every.join(signals.select("fold_id", "champion", "signal_date"), "signal_date").join(benchmark.select("trade_date", F.col("benchmark_return").alias("b")), "trade_date", "left")
    net, base = quantise(F.col("gross_return") - F.col("transaction_cost"), 10), F.coalesce("b", F.lit(0.0))
    kind = F.when(F.col("strategy_id") == specs.CHAMPION, "champion_single").otherwise("multifactor")
    keys = ("fold_id", "strategy_id", "portfolio_leg", "signal_date", "trade_date")
    legs_out = out.select(
        *keys, kind.alias("strategy_type"), F.col("champion").alias("selected_factor"), "gross_return", "turnover", "transaction_cost", net.alias("net_return"), base.alias("benchmark_return"),
        F.when(F.col("portfolio_leg") == "long_short", net).otherwise(net - base).alias("excess_return"), *counts,
    )
    zero = lambda kind: F.lit(0).cast(kind)
    days = legs_out.select("fold_id", "signal_date", "trade_date", "benchmark_return").distinct().select(
        "fold_id", F.lit(specs.BENCHMARK).alias("strategy_id"), F.lit("benchmark").alias("portfolio_leg"), "signal_date", "trade_date", F.lit("benchmark").alias("strategy_type"), F.lit(None).cast("string").alias("selected_factor"),
        F.col("benchmark_return").alias("gross_return"), zero("double").alias("turnover"), zero("double").alias("transaction_cost"), F.col("benchmark_return").alias("net_return"), "benchmark_return", zero("double").alias("excess_return"),
        *(zero("long").alias(c) for c in counts),
    )
    return legs_out.unionByName(days)


OOS_KEY = ("fold_id", "trade_date", "strategy_id", "portfolio_leg")


def duplicate_oos_keys(daily: DataFrame) -> DataFrame:
    """Keys of out-of-sample rows that occur more than once; a sound result has none."""
    return daily.groupBy(*OOS_KEY).agg(F.count("*").alias("n")).filter("n > 1")


def require_unique_oos(daily: DataFrame) -> DataFrame:
    """The rows as they are, once it is sure that no key is repeated."""
    repeated = duplicate_oos_keys(daily).first()
    if repeated:
        raise ValueError(f"repeated out-of-sample row: {repeated.asDict()}")
    return daily


def oos_coefficients(ic: DataFrame, composite_ic: DataFrame, signals: DataFrame) -> DataFrame:
    """(strategy_id, fold_id, trade_date, rank_ic) of the champion in each fold and of the composites."""
    dates = signals.select("fold_id", "champion", F.col("signal_date").alias("trade_date"))
    own = ic.join(dates, "trade_date").filter(F.col("factor") == F.col("champion")).select(F.lit(specs.CHAMPION).alias("strategy_id"), "fold_id", "trade_date", "rank_ic")
    return own.unionByName(composite_ic.join(dates, "trade_date").select(F.col("factor").alias("strategy_id"), "fold_id", "trade_date", "rank_ic"))


def oos_metrics(daily: DataFrame, coefficients: DataFrame, days: int = 252) -> DataFrame:
    """Metrics by fold and pooled: long-short compounds to periods (12 a year), other legs are daily (``days`` a year).

    The Sharpe ratio is mean over deviation; the information ratio is that of daily excess returns.
    """
    scopes = F.explode(F.array(F.lit("fold"), F.lit("pooled")))
    fold = F.when(F.col("scope") == "fold", F.col("fold_id")).otherwise("ALL")
    both = daily.withColumn("scope", scopes).withColumn("fold_id", fold)
    keys = ("scope", "fold_id", "strategy_id", "portfolio_leg")
    is_pair = F.col("portfolio_leg") == "long_short"
    point = F.when(is_pair, F.col("signal_date")).otherwise(F.col("trade_date"))
    points = both.groupBy(*keys, point.alias("point")).agg(quantise(compound("net_return"), 10).alias("r"), F.min("trade_date").alias("trade_date"))
    year = F.when(is_pair, F.lit(12.0)).otherwise(F.lit(float(days)))
    walked = nav(points, keys, "r").groupBy(*keys).agg(
        F.count("*").alias("observation_count"), compound("r").alias("cumulative_return"), F.avg("r").alias("_m"), F.stddev_pop("r").alias("_s"), F.min("drawdown").alias("max_drawdown"), F.avg((F.col("r") > 0).cast("double")).alias("win_rate")
    )
    deviation = F.stddev_pop("excess_return")
    by_day = both.groupBy(*keys).agg(
        F.min("trade_date").alias("start_date"), F.max("trade_date").alias("end_date"), divide(F.sum("turnover"), F.countDistinct("signal_date")).alias("average_period_turnover"), F.sum("transaction_cost").alias("total_transaction_cost"),
        annualised("benchmark_return", days).alias("_b"), (F.when(deviation > 1e-12, F.avg("excess_return") / deviation) * math.sqrt(days)).alias("information_ratio"),
    )
    known = coefficients.withColumn("scope", scopes).withColumn("fold_id", fold).groupBy("scope", "fold_id", "strategy_id").agg(F.avg("rank_ic").alias("rank_ic_mean"), F.count("rank_ic").alias("rank_ic_periods"))
    annual = F.pow(1.0 + F.col("cumulative_return"), year / F.col("observation_count")) - 1.0
    return walked.join(by_day, list(keys)).join(known, ["scope", "fold_id", "strategy_id"], "left").select(
        *keys, F.when(is_pair, "monthly").otherwise("daily").alias("metric_frequency"), "start_date", "end_date", "observation_count", annual.alias("annual_return"), (F.col("_s") * F.sqrt(year)).alias("annual_volatility"),
        F.when(F.col("_s") > 1e-12, divide("_m", "_s") * F.sqrt(year)).alias("sharpe"), "max_drawdown", "win_rate", "cumulative_return", "average_period_turnover", "total_transaction_cost",
        F.when(is_pair, F.lit(0.0)).otherwise(F.col("_b")).alias("benchmark_annual_return"), F.when(is_pair, annual).otherwise(annual - F.col("_b")).alias("excess_annual_return"), "information_ratio",
        "rank_ic_mean", F.coalesce("rank_ic_periods", F.lit(0)).alias("rank_ic_periods"),
    )
