"""Composites of factors, their layers, and rolling weights.

Everything stays long: a strategy is a set of (strategy, factor) rows, and any number of strategies is one join and one
shuffle over the scores.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import layer_name, quantise
from quantlake.operators.diagnostics import assign_layers
from quantlake.operators.portfolio import nav, period_calendar
from quantlake.specs import COMPOSITE_EQUAL, COMPOSITE_ROLLING, FACTORS, Strategy

SCORE_DIGITS = 10


def equal_composite(scores: DataFrame, name: str = COMPOSITE_EQUAL, min_count: int = 1, score: str = "neutralized_score") -> DataFrame:
    """Mean of the factors that a security has; NULL under ``min_count``; securities without any are left out."""
    n = F.count(score)
    out = scores.groupBy("trade_date", "ts_code").agg(F.when(n >= min_count, quantise(F.avg(score), SCORE_DIGITS)).alias("score"), n.alias("available_count"))
    return out.filter("available_count > 0").select(F.lit(name).alias("factor"), "trade_date", "ts_code", "score", "available_count")


def naive_history(scores: DataFrame, rank_ic: DataFrame) -> DataFrame:
    """(target, factor, past date, rank_ic) by dates alone.  The newest figure was earned after the target date."""
    target = scores.select(F.col("trade_date").alias("target")).distinct()
    past = rank_ic.filter(F.col("rank_ic").isNotNull()).select("factor", "trade_date", "rank_ic")
    return past.join(F.broadcast(target), F.col("trade_date") < F.col("target"))


def point_in_time_history(scores: DataFrame, rank_ic: DataFrame, calendar: DataFrame) -> DataFrame:
    """As ``naive_history``, of periods whose holding had ended by the target date."""
    ended = period_calendar(calendar).filter(F.col("next_exec_date").isNotNull()).select(F.col("signal_date").alias("trade_date"), "next_exec_date")
    target = scores.select(F.col("trade_date").alias("target")).distinct()
    past = rank_ic.filter(F.col("rank_ic").isNotNull()).select("factor", "trade_date", "rank_ic").join(F.broadcast(ended), "trade_date")
    return past.join(F.broadcast(target), F.col("next_exec_date") <= F.col("target")).drop("next_exec_date")


def rolling_weights(scores: DataFrame, history: DataFrame, window: int = 12, min_periods: int = 6, of_date: bool = False, score: str = "neutralized_score") -> DataFrame:
    """Weights by the mean of the last ``window`` rank coefficients, none below 0; equal where nothing qualifies.

    Every factor has a weight on every date, or, if ``of_date``, on those dates on which it has a score.
    """
    last = F.row_number().over(Window.partitionBy("target", "factor").orderBy(F.desc("trade_date")))
    recent = history.withColumn("_k", last).filter(F.col("_k") <= window).groupBy("target", "factor").agg(F.avg("rank_ic").alias("rank_ic_mean"), F.count("*").alias("rank_ic_periods"))
    if of_date:
        scaffold = scores.filter(F.col(score).isNotNull()).select(F.col("trade_date").alias("target"), "factor").distinct()
    else:
        scaffold = scores.select(F.col("trade_date").alias("target")).distinct().crossJoin(scores.select("factor").distinct())
    raw = F.when(F.col("rank_ic_periods") >= min_periods, F.greatest("rank_ic_mean", F.lit(0.0))).otherwise(0.0)
    every = scaffold.join(recent, ["target", "factor"], "left").withColumn("raw", raw)
    whole = Window.partitionBy("target")
    total = F.sum("raw").over(whole)
    weight = F.when(total > 0, F.col("raw") / total).otherwise(1.0 / F.count("*").over(whole))
    return every.select(
        F.col("target").alias("trade_date"), "factor", quantise(weight, 12).alias("weight"), F.when(total > 0, F.lit("rolling_rankic")).otherwise(F.lit("fallback_equal")).alias("weight_source"),
        "rank_ic_mean", F.coalesce("rank_ic_periods", F.lit(0)).alias("rank_ic_periods"),
    )


def weighted_composite(scores: DataFrame, weights: DataFrame, name: str = COMPOSITE_ROLLING, min_count: int = 1, score: str = "neutralized_score") -> DataFrame:
    """Weighted mean over the factors that a security has, weights scaled to them."""
    rows = scores.join(weights.select("trade_date", "factor", "weight"), ["trade_date", "factor"])
    n, w = F.count(score), F.sum(F.when(F.col(score).isNotNull(), F.col("weight")))
    mean = F.try_divide(F.sum(F.col(score) * F.col("weight")), F.nullif(w, F.lit(0.0)))
    out = rows.groupBy("trade_date", "ts_code").agg(F.when(n >= min_count, quantise(mean, SCORE_DIGITS)).alias("score"), n.alias("available_count"))
    return out.filter("available_count > 0").select(F.lit(name).alias("factor"), "trade_date", "ts_code", "score", "available_count")


def strategy_map(spark: SparkSession, strategies: Iterable[Strategy]) -> DataFrame:
    """(strategy_id, factor, min_count); a few hundred rows, broadcast."""
    rows = [F.struct(F.lit(s.strategy_id).alias("strategy_id"), F.lit(f).alias("member"), F.lit(s.min_count).alias("min_count")) for s in strategies for f in s.factors]
    return F.broadcast(spark.range(1).select(F.inline(F.array(*rows))))


def all_composites(scores: DataFrame, strategies: Iterable[Strategy], score: str = "neutralized_score") -> DataFrame:
    """Every strategy's equal composite in one shuffle; a row for each security and date that has any score."""
    strategies = list(strategies)
    names = strategy_map(scores.sparkSession, strategies)
    rows = scores.filter(F.col(score).isNotNull()).join(names, scores["factor"] == names["member"])
    n = F.count("*")
    got = rows.groupBy("strategy_id", "trade_date", "ts_code").agg(F.when(n >= F.first("min_count"), quantise(F.avg(score), SCORE_DIGITS)).alias("score"), n.alias("available_count"))
    ids = names.select("strategy_id").distinct()
    every = scores.filter(F.col(score).isNotNull()).select("trade_date", "ts_code").distinct().crossJoin(F.broadcast(ids))
    out = every.join(got, ["strategy_id", "trade_date", "ts_code"], "left")
    return out.select(F.col("strategy_id").alias("factor"), "trade_date", "ts_code", "score", F.coalesce("available_count", F.lit(0)).alias("available_count"))


def group_scores(scores: DataFrame, score: str = "neutralized_score") -> DataFrame:
    """(group, trade_date, ts_code, group_score): mean of a group's factors."""
    pairs = [F.lit(x) for f in FACTORS for x in (f.name, f.group)]
    named = scores.filter(F.col(score).isNotNull()).withColumn("group", F.try_element_at(F.create_map(*pairs), F.col("factor")))
    return named.filter(F.col("group").isNotNull()).groupBy("group", "trade_date", "ts_code").agg(quantise(F.avg(score), SCORE_DIGITS).alias("group_score"))


def grouped_composite(scores: DataFrame, name: str = "Grouped", min_groups: int = 5, score: str = "neutralized_score") -> DataFrame:
    """Mean of the groups' means; NULL under ``min_groups``."""
    n = F.count("*")
    out = group_scores(scores, score).groupBy("trade_date", "ts_code").agg(F.when(n >= min_groups, quantise(F.avg("group_score"), SCORE_DIGITS)).alias("score"), n.alias("available_count"))
    return out.select(F.lit(name).alias("factor"), "trade_date", "ts_code", "score", "available_count")


def layer_weights(scores: DataFrame, layers: int = 10) -> DataFrame:
    """Equal weights within each layer; the layer becomes part of the name."""
    rows = assign_layers(scores, layers, out="layer")
    n = F.count("*").over(Window.partitionBy("factor", "trade_date", "layer"))
    return rows.select(layer_name("factor", "layer").alias("factor"), "trade_date", "ts_code", (F.lit(1.0) / n).alias("weight"))


def composite_coverage(scores: DataFrame) -> DataFrame:
    per = scores.groupBy("factor", "trade_date").agg(F.count("score").alias("valid"), F.avg("available_count").alias("components"))
    return per.groupBy("factor").agg(F.count("*").alias("signal_count"), F.avg("valid").alias("average_valid_stocks"), F.min("valid").alias("min_valid_stocks"), F.avg("components").alias("average_components"))


def layer_nav(daily: DataFrame) -> DataFrame:
    return nav(daily).select("factor", "trade_date", "portfolio_return", "nav")
