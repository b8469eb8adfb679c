"""Queries of the research engine: one for each relation, and for operators of the storage layer, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quantlake.functions.expr import bucket, clip, compact_date, dashed_date, divide, number, quantise
from quantlake.operators import marginal
from quantlake.plans import oracle
from quantlake.plans.research import RELATIONS, research
from quantlake.sources import catalog, lake
from quantlake.sources.bridge import duckdb_sql
from quantlake.specs import DATASETS, DatasetSpec

#: Query, relation, columns as they are, columns quantised to six digits.
SPECS: tuple[tuple[str, str, str, str], ...] = (
    ("u1_union_by_name", "union_by_name", "key name nationkey mktsegment dataset", "acctbal"),
    ("v2_adjusted", "adjusted", "ts_code trade_date", "close vol amount adj_factor latest_adj_factor close_hfq close_qfq"),
    ("v3_returns", "returns", "ts_code trade_date", "close vol amount adj_factor latest_adj_factor close_hfq close_qfq return_adjusted"),
    ("v4_universe", "universe", "ts_code trade_date name list_date delist_date is_suspended is_listed_on_date is_st_name", ""),
    ("v5_intervals", "intervals", "ts_code end_date ann_date _ingested_at visible_from next_visible_from", "roe tr_yoy debt_to_eqt grossprofit_margin"),
    ("q8_open_days", "open_days", "trade_date", ""),
    ("f16_calendar", "calendar", "signal_date exec_date", ""),
    ("k2_periods", "periods", "signal_date exec_date next_exec_date period", ""),
    ("j12_fit", "fit", "trade_date ts_code", ""),
    ("j13_fit_exec", "fit_exec", "exec_date ts_code", ""),
    ("f1_roe", "f_roe", "factor trade_date ts_code", "raw_value"),
    ("f1_growth", "f_growth", "factor trade_date ts_code", "raw_value"),
    ("f1_debt", "f_debt", "factor trade_date ts_code", "raw_value"),
    ("f1_margin", "f_margin", "factor trade_date ts_code", "raw_value"),
    ("f2_pe", "f_pe", "factor trade_date ts_code", "raw_value"),
    ("f2_yield", "f_yield", "factor trade_date ts_code", "raw_value"),
    ("f3_momentum", "f_momentum", "factor trade_date ts_code", "raw_value"),
    ("f4_turnover", "f_turnover", "factor trade_date ts_code", "raw_value"),
    ("f5_volatility", "f_volatility", "factor trade_date ts_code", "raw_value"),
    ("f6_inflow", "f_inflow", "factor trade_date ts_code", "raw_value"),
    ("f7_holders", "f_holders", "factor trade_date ts_code", "raw_value"),
    ("f8_panel", "panel", "factor trade_date ts_code", "raw_value"),
    ("f10_scores", "scores", "factor trade_date ts_code", "raw_value score"),
    ("f22_exposure", "exposure", "trade_date ts_code industry", "log_total_mv"),
    ("f11_neutral", "neutral", "trade_date ts_code factor", "raw_value score neutralized_score"),
    ("f13_exec_scores", "exec_scores", "factor trade_date ts_code", "raw_value score"),
    ("f12_weights", "weights", "factor trade_date ts_code", "weight"),
    ("f14_turnover", "turnover", "factor trade_date", "turnover"),
    ("g1_period_days", "period_days", "signal_date exec_date day", ""),
    ("f17_backtest", "backtest", "factor signal_date trade_date holding_count suspended_count invalid_missing_count", "portfolio_return active_weight"),
    ("f21_benchmark", "benchmark", "trade_date", "benchmark_return"),
    ("f23_nav", "nav", "factor signal_date trade_date holding_count suspended_count invalid_missing_count", "portfolio_return active_weight nav drawdown"),
    ("f18_performance", "performance", "factor start_date end_date trading_days missing_return_count suspended_return_count invalid_missing_return_count", "annual_return annual_volatility max_drawdown cumulative_return benchmark_annual_return average_invalid_missing_weight max_invalid_missing_weight average_monthly_turnover annualized_turnover sharpe excess_annual_return"),
    ("f12_neutral_weights", "neutral_weights", "factor trade_date ts_code", "weight"),
    ("f17_neutral_backtest", "neutral_backtest", "factor signal_date trade_date holding_count suspended_count invalid_missing_count", "portfolio_return active_weight"),
    ("f18_neutral_performance", "neutral_performance", "factor start_date end_date trading_days missing_return_count suspended_return_count invalid_missing_return_count", "annual_return annual_volatility max_drawdown cumulative_return benchmark_annual_return average_invalid_missing_weight max_invalid_missing_weight average_monthly_turnover annualized_turnover sharpe excess_annual_return"),
    ("f20_comparison", "comparison", "factor", "annual_return_raw excess_annual_return_raw sharpe_raw max_drawdown_raw cumulative_return_raw average_monthly_turnover_raw annual_return_neutralized excess_annual_return_neutralized sharpe_neutralized max_drawdown_neutralized cumulative_return_neutralized average_monthly_turnover_neutralized annual_return_delta excess_annual_return_delta sharpe_delta max_drawdown_delta cumulative_return_delta average_monthly_turnover_delta"),
    ("f19_coverage", "coverage", "factor signal_count first_signal last_signal valid_rows", "average_valid_stocks average_holding_count"),
    ("f24_monthly", "monthly", "factor month", "monthly_return"),
    ("g9_yearly", "yearly", "factor year", "yearly_return"),
    ("g1_forward", "forward", "signal_date exec_date ts_code holding_days missing_return_count suspended_return_count invalid_missing_return_count", "forward_return"),
    ("g2_ic", "ic", "factor trade_date sample_count", "ic rank_ic"),
    ("g3_ic_summary", "ic_summary", "factor periods", "ic_mean ic_std ic_win_rate ic_icir rank_ic_mean rank_ic_std rank_ic_win_rate rank_ic_icir ic_annual_icir rank_ic_annual_icir"),
    ("g4_deciles", "deciles", "factor trade_date ts_code decile", "raw_value score"),
    ("g5_decile_returns", "decile_returns", "factor trade_date decile stock_count", "mean_return"),
    ("g6_decile_summary", "decile_summary", "factor", "monotonic_ratio mean_spearman d1_mean d1_annual d5_mean d5_annual d10_mean d10_annual"),
    ("g7_long_short", "long_short", "factor trade_date", "long_short_return"),
    ("g8_long_short_metrics", "long_short_metrics", "factor periods", "annual_return annual_volatility max_drawdown win_rate cumulative_return sharpe"),
    ("g9_long_short_yearly", "long_short_yearly", "factor year periods", "yearly_return"),
    ("g10_size_exposure", "size_exposure", "factor trade_date baseline_count holding_count missing_size_count", "baseline_log_total_mv portfolio_log_total_mv active_log_total_mv portfolio_size_percentile"),
    ("g11_industry_exposure", "industry_exposure", "factor trade_date industry baseline_count holding_count", "portfolio_weight baseline_weight active_weight"),
    ("g12_exposure_summary", "exposure_summary", "factor", "mean_active_size mean_size_percentile mean_abs_active max_abs_active unknown_weight"),
    ("f13_executable", "executable", "factor trade_date ts_code", "neutralized_score"),
    ("g2_neutral_ic", "neutral_ic", "factor trade_date sample_count", "ic rank_ic"),
    ("m1_equal_composite", "equal_composite", "factor trade_date ts_code available_count", "score"),
    ("m2_naive_weights", "naive_weights", "trade_date factor weight_source rank_ic_periods", "weight rank_ic_mean"),
    ("k6_pit_weights", "pit_weights", "trade_date factor weight_source rank_ic_periods", "weight rank_ic_mean"),
    ("m3_rolling_composite", "rolling_composite", "factor trade_date ts_code available_count", "score"),
    ("c4_grouped_composite", "grouped_composite", "factor trade_date ts_code available_count", "score"),
    ("m1_composite_scores", "composite_scores", "factor trade_date ts_code available_count", "score"),
    ("m7_composite_coverage", "composite_coverage", "factor signal_count min_valid_stocks", "average_valid_stocks average_components"),
    ("m4_layer_weights", "layer_weights", "factor trade_date ts_code", "weight"),
    ("m5_layer_daily", "layer_daily", "factor signal_date trade_date holding_count suspended_count invalid_missing_count", "portfolio_return active_weight"),
    ("m8_layer_nav", "layer_nav", "factor trade_date", "portfolio_return nav"),
    ("c22_layer_profile", "layer_profile", "composite layer", "annual_return sharpe"),
    ("k3_fold_frame", "fold_frame", "fold_id status decision_signal_date embargo_signal_date", ""),
    ("k3_fold_dates", "fold_dates", "fold_id part trade_date", ""),
    ("k4_ls_periods", "ls_periods", "factor trade_date", "gross_long_short_return two_leg_turnover transaction_cost net_long_short_return"),
    ("k5_candidates", "candidates", "fold_id factor train_rankic_periods validation_rankic_periods validation_return_periods is_eligible eligibility_reason selection_rank", "train_rankic_mean validation_rankic_mean validation_return_mean validation_sharpe validation_average_two_leg_turnover"),
    ("k11_champions", "champions", "fold_id incumbent_before champion decision_reason", ""),
    ("k5_selection_log", "selection_log", "fold_id factor is_eligible selection_rank incumbent_before selected decision_reason fold_decision_reason", ""),
    ("k7_oos_signals", "oos_signals", "fold_id decision_signal_date champion signal_date", ""),
    ("k7_oos_inputs", "oos_inputs", "factor trade_date ts_code", "score"),
    ("k7_factor_weights", "factor_weights", "fold_id signal_date strategy_id source_factor weight_source weight_as_of_date rank_ic_periods", "weight rank_ic_mean"),
    ("k7_composite_ic", "composite_ic", "factor trade_date sample_count", "ic rank_ic"),
    ("k8_oos_daily", "oos_daily", "fold_id strategy_id portfolio_leg signal_date trade_date strategy_type selected_factor suspended_count invalid_missing_count", "gross_return turnover transaction_cost net_return benchmark_return excess_return"),
    ("a27_oos_duplicates", "oos_duplicates", "fold_id trade_date strategy_id portfolio_leg n", ""),
    ("k9_oos_ic", "oos_ic", "strategy_id fold_id trade_date", "rank_ic"),
    ("k9_oos_metrics", "oos_metrics", "scope fold_id strategy_id portfolio_leg metric_frequency start_date end_date observation_count rank_ic_periods", "annual_return annual_volatility sharpe max_drawdown win_rate cumulative_return average_period_turnover total_transaction_cost benchmark_annual_return excess_annual_return information_ratio rank_ic_mean"),
    ("c3_strategies", "strategies", "factor trade_date ts_code available_count", "score"),
    ("c5_group_correlation", "group_correlation", "group_a group_b dates", "correlation"),
    ("c3_strategy_ic", "strategy_ic", "factor trade_date sample_count", "ic rank_ic"),
    ("c3_strategy_ls", "strategy_ls", "factor trade_date", "long_short_return"),
    ("c6_strategy_pair_turnover", "strategy_pair_turnover", "factor trade_date", "low_turnover high_turnover two_leg_turnover"),
    ("f14_strategy_turnover", "strategy_turnover", "factor trade_date", "turnover"),
    ("f17_strategy_daily", "strategy_daily", "trade_date factor signal_date holding_count suspended_count invalid_missing_count", "portfolio_return active_weight benchmark_return"),
    ("c8_strategy_monthly", "strategy_monthly", "factor attribution_month", "d10_d1_return d10_d1_month_drawdown top20_return benchmark_return top20_within_month_max_drawdown top20_excess_return rank_ic top20_turnover d10_d1_two_leg_turnover"),
    ("c9_strategy_metrics", "strategy_metrics", "period strategy_id d10_d1_period_count top20_trading_days rank_ic_periods", "d10_d1_annual_return d10_d1_cumulative_return d10_d1_max_drawdown top20_annual_return benchmark_annual_return top20_excess_annual_return top20_cumulative_return top20_max_drawdown rank_ic_mean top20_average_monthly_turnover d10_d1_average_two_leg_turnover average_valid_stock_count average_available_component_count"),
    ("c10_contributions", "contributions", "family factor_id period", "d10_d1_annual_return_contribution d10_d1_cumulative_return_contribution d10_d1_max_drawdown_contribution d10_d1_average_two_leg_turnover_contribution top20_excess_annual_return_contribution top20_cumulative_return_contribution top20_max_drawdown_contribution top20_average_monthly_turnover_contribution rank_ic_mean_contribution"),
    ("c11_stability", "stability", "family factor_id positive_subperiods negative_subperiods stability", "full_contribution"),
    ("c14_advantage", "advantage", "attribution_month year", "d10_d1_delta top20_excess_delta"),
    ("c17_paired_tests", "paired_tests", "metric months newey_west_lag", "mean_delta median_delta win_rate simple_t newey_west_stat newey_west_two_sided_p"),
    ("c16_bootstrap", "intervals_of_means", "metric bootstrap_repetitions bootstrap_block_months bootstrap_significant_positive", "bootstrap_ci_95_low bootstrap_ci_95_high"),
    ("c18_annual_stability", "annual_stability", "year metric challenger_wins", "challenger baseline delta"),
    ("c19_gates", "gates", "gate metric passed", "challenger baseline"),
    ("c19_decision", "decision", "label failed_gates", ""),
    ("c21_quality_gate", "quality", "check_name status critical detail", ""),
    ("c20_reproduction", "reproduction", "period strategy_id metric within_tolerance", "old_value new_value"),
    ("c10_monthly_contributions", "monthly_contributions", "family factor_id attribution_month", "d10_d1_return_contribution top20_return_contribution benchmark_return_contribution top20_excess_return_contribution rank_ic_contribution d10_d1_month_drawdown_contribution top20_within_month_max_drawdown_contribution d10_d1_two_leg_turnover_contribution top20_turnover_contribution"),
    ("c12_grouped_improvement", "grouped_improvement", "metric positive_periods improved", ""),
    ("c12_group_definition", "group_definition", "factor direction group_id group_factor_count fixed_pool_member", "within_group_weight between_group_weight effective_weight"),
    ("c12_coverage_diagnostics", "coverage_diagnostics", "factor trade_date valid_stock_count total_stock_count least_available_component_count configured_component_count", "average_available_component_count"),
    ("c22_return_profile", "return_profile", "factor decile", "average_forward_return"),
    ("c22_return_monotony", "return_monotony", "factor", "d1 d10 spread monotonic_spearman"),
    ("w16_rolling_advantage", "rolling_advantage", "attribution_month year", "d10_d1_delta rolling_mean"),
    ("m5_naive_composite", "naive_composite", "factor trade_date ts_code available_count", "score"),
    ("m5_composite_long_short", "composite_long_short", "factor periods", "annual_return annual_volatility max_drawdown win_rate cumulative_return sharpe"),
    ("m5_layers", "composite_layers", "factor trade_date ts_code bucket", "score"),
    ("m5_top_layer_weights", "top_layer_weights", "factor trade_date ts_code", "weight"),
    ("m5_layer_turnover", "layer_turnover", "factor trade_date", "turnover"),
    ("m5_layer_metrics", "layer_metrics", "factor start_date end_date trading_days missing_return_count suspended_return_count invalid_missing_return_count", "annual_return annual_volatility max_drawdown cumulative_return benchmark_annual_return average_invalid_missing_weight max_invalid_missing_weight average_monthly_turnover annualized_turnover sharpe excess_annual_return"),
    ("m5_layer_period_returns", "layer_period_returns", "factor trade_date decile stock_count", "mean_return"),
    ("m5_layer_summary", "layer_summary", "factor", "monotonic_ratio mean_spearman d1_mean d1_annual d5_mean d5_annual d10_mean d10_annual"),
    ("m5_composite_spread", "composite_spread", "factor trade_date", "long_short_return"),
    ("m5_composite_ic_summary", "composite_ic_summary", "factor periods", "ic_mean ic_std ic_win_rate ic_icir rank_ic_mean rank_ic_std rank_ic_win_rate rank_ic_icir ic_annual_icir rank_ic_annual_icir"),
    ("m6_single_long_short", "single_long_short", "factor periods", "annual_return annual_volatility max_drawdown win_rate cumulative_return sharpe"),
    ("f3_momentum_60d", "fine_momentum", "factor trade_date ts_code", "raw_value"),
    ("f4_turnover_20d", "fine_turnover", "factor trade_date ts_code", "raw_value"),
    ("f5_volatility_252d", "fine_volatility", "factor trade_date ts_code", "raw_value"),
)


def _relation(name: str, keys: str, doubles: str) -> Callable[[SparkSession, str], DataFrame]:
    """Nine digits first: a mean of decimals can lie on a six-digit edge, and sums in another order on either side of it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return research(spark, sf_dir)[name].select(*keys.split(), *(quantise(quantise(c, 9), 6).alias(c) for c in doubles.split()))

    return run


LINES = DatasetSpec("lines", ("l_orderkey", "l_linenumber"), "static", "market")
_PICK = ("l_shipdate", "l_extendedprice", "l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag", "l_linestatus")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet")


def latest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.latest_per_key(_lines(spark, sf_dir), LINES.primary_key, [F.col(c).desc_nulls_last() for c in _PICK])


def duplicate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lake.duplicate_keys(_lines(spark, sf_dir), LINES.primary_key)


def alias_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a security under its former and its current code on one day: the newest stays, the current code before the former."""
    daily = research(spark, sf_dir)["daily"]
    code = F.when(F.col("ts_code") == "S000001.SZ", "300114.SZ").when(F.col("ts_code") == "S000002.SZ", "302132.SZ").otherwise(F.col("ts_code"))
    out = lake.merged(DATASETS["daily"], [daily.withColumn("ts_code", code)])
    return out.select("ts_code", "trade_date", "close")


def consolidated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches of the same keys: of each key the newer."""
    daily = research(spark, sf_dir)["daily"].select("ts_code", "trade_date", "close")
    first = daily.withColumns({"_batch_id": F.lit("a"), "_ingested_at": F.lit("2024-01-01T00:00:00Z"), "_api_name": F.lit("daily"), "_params_json": F.lit("{}")})
    second = daily.filter("trade_date >= '19980101'").withColumns({"close": quantise(F.col("close") * 2.0, 6), "_batch_id": F.lit("b"), "_ingested_at": F.lit("2024-01-02T00:00:00Z")})
    return lake.merged(DATASETS["daily"], [first, second])


def status_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status rows by segment, then later ones without a success date for some: that date is kept."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    old = c.groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.count("*").alias("rows"), F.lit("success").alias("status"), F.lit("20240101").alias("last_success"))
    new = c.filter("c_custkey % 2 = 0").groupBy(F.col("c_mktsegment").alias("dataset")).agg(F.count("*").alias("rows"), F.lit("failed").alias("status"), F.lit(None).cast("string").alias("last_success"))
    return lake.upsert(old, new, ["dataset"], ["last_success"])


def _checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as results of checks: the type stands for the dataset, a digit of the user for the check."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    check, at = F.concat(F.lit("check_"), F.col("user_id") % 10), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return events.select(F.lpad(F.col("event_id").cast("string"), 12, "0").alias("check_id"), F.col("event_type").alias("dataset"), check.alias("check_name"), F.when(F.col("value") > 20, "failed").otherwise("passed").alias("status"), at.alias("checked_at"))


def latest_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.latest_quality(_checks(spark, sf_dir))


def quality_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results appended in two goes: both stay."""
    rows = _checks(spark, sf_dir)
    return rows.filter("status = 'failed'").unionByName(rows.filter("status = 'passed'")).groupBy("dataset", "check_name", "status").agg(F.count("*").alias("n"))


def refreshed_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as datasets: those of region 0 are no more, those of regions 1 and 2 change, those of region 4 are new."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("dataset"), F.col("n_regionkey").alias("region"))
    old = n.filter("region < 4").withColumns({"strategy": F.lit("range"), "updated_at": F.lit("1")})
    current = n.filter("region > 0").withColumns({"strategy": F.when(F.col("region") < 3, "daily").otherwise("range"), "updated_at": F.lit("2")})
    return catalog.refreshed(old, current)


def finished_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as batches that run, of which one has ended."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    none = F.lit(None).cast("string")
    batches = o.select(F.col("o_orderkey").cast("string").alias("batch_id"), F.lit("running").alias("status"), F.lit(0).cast("long").alias("row_count"), none.alias("finished_at"), none.alias("error_message"))
    return catalog.finished(batches, "7", "failed", 3, "2024-01-01T00:00:00Z", "no answer")


def known_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    status = c.groupBy(F.col("c_nationkey").alias("dataset")).agg(F.count("*").alias("row_count"))
    return catalog.status_of_known(status, spark.read.parquet(f"{sf_dir}/nation.parquet").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("dataset")))


def parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A query with named parameters."""
    text = "select l_returnflag, count(*) as n from {lines} where l_shipdate >= to_timestamp(:start, 'yyyyMMdd') and l_linenumber <= :most group by l_returnflag"
    return spark.sql(text, args={"start": "19970101", "most": 3}, lines=_lines(spark, sf_dir))


def rolling_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the last twelve values of a series, where it has six of them."""
    r = research(spark, sf_dir)
    return marginal.rolling_advantage(r["long_short"], "long_short_return", "trade_date", ["factor"]).select("factor", "trade_date", quantise("rolling_mean").alias("rolling_mean"))


def row_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.date_format("ts", "yyyyMMdd").alias("trade_date"), "event_id")
    return lake.with_row_numbers(events, DATASETS["top_list"], "event_id")


def validations(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = research(spark, sf_dir)
    orders = _lines(spark, sf_dir).select(F.col("l_orderkey").alias("ts_code"), F.col("l_linenumber").alias("trade_date"))
    tables = {"daily": r["daily"], "adj_factor": r["adj_factor"], "stock_basic": r["stock_basic"], "trade_cal": r["trade_cal"], "suspend_d": orders, "moneyflow": None}
    return spark.createDataFrame([(n, *lake.validate(DATASETS[n], df)) for n, df in tables.items()], "dataset string, status string, detail string")


def usability(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = research(spark, sf_dir)
    return lake.usability(r["daily"], r["adj_factor"], r["stock_basic"], r["trade_cal"], r["adjusted"])


def scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scalar operators on lines: coercion, clipping, guarded logarithm and division, buckets, patterns and dates."""
    df = _lines(spark, sf_dir)
    order = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_quantity", "l_discount", "l_tax")
    size = F.count("*").over(Window.partitionBy("l_suppkey"))
    day = F.date_format("l_shipdate", "yyyyMMdd")
    return df.select(
        "l_orderkey", "l_linenumber", "l_partkey", day.alias("ship_day"),
        F.date_format("l_shipdate", "yyyy-MM").alias("ship_month"),
        day.rlike("^199[0-9]{5}$").alias("is_nineties"),
        F.col("l_returnflag").isin("A", "R").alias("is_returned"),
        quantise(clip("l_extendedprice", F.lit(1000.0), F.lit(50000.0))).alias("clipped"),
        quantise(F.when(F.col("l_discount") > 0, F.log("l_discount"))).alias("log_discount"),
        quantise(divide("l_extendedprice", F.nullif("l_tax", F.lit(0.0)))).alias("per_tax"),
        number(F.when(F.col("l_linenumber") == 1, "x").otherwise(F.col("l_linenumber").cast("string"))).alias("coerced"),
        bucket(order, size, 10).alias("bucket"),
        number(F.when(F.col("l_linenumber") == 2, "Infinity").when(F.col("l_linenumber") == 3, "NaN").when(F.col("l_linenumber") == 4, "-Infinity").otherwise(F.col("l_quantity").cast("string"))).alias("finite"),
        compact_date(F.when(F.col("l_linenumber") == 1, "1995-13-01").when(F.col("l_linenumber") == 2, F.date_format("l_shipdate", "yyyy-MM-dd")).otherwise(day)).alias("compact"),
        dashed_date(day).alias("dashed"),
    )


STORAGE: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "q1_latest_per_key": latest_lines,
    "a3_duplicate_keys": duplicate_lines,
    "q2_consolidate": consolidated,
    "q3_alias_repair": alias_repair,
    "d4_status_upsert": status_upsert,
    "s12_row_numbers": row_numbers,
    "q9_validate": validations,
    "q11_usability": usability,
    "p_scalars": scalars,
    "w18_latest_quality": latest_quality,
    "d6_quality_history": quality_history,
    "d5_refreshed_catalog": refreshed_catalog,
    "q12_finished_batches": finished_batches,
    "j4_known_status": known_status,
    "d7_parameters": parameters,
    "w16_rolling_mean": rolling_mean,
}

_DAILY = duckdb_sql("daily")


def _with(*names: str) -> str:
    seen: list[str] = []
    for n in names:
        oracle.needs(n, seen)
    return "with " + ", ".join(f"{x} as materialized ({oracle.CTES[x]})" for x in seen)


_CHECKS = "(select lpad(event_id::varchar, 12, '0') as check_id, event_type as dataset, 'check_' || (user_id % 10) as check_name, case when value > 20 then 'failed' else 'passed' end as status, strftime(ts, '%Y-%m-%d %H:%M:%S') as checked_at from events)"

STORAGE_SQL: dict[str, str] = {
    "q1_latest_per_key": f"select * exclude (rn) from (select *, row_number() over (partition by l_orderkey, l_linenumber order by {', '.join(f'{c} desc nulls last' for c in _PICK)}) as rn from lineitem) where rn = 1",
    "a3_duplicate_keys": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "q2_consolidate": f"""with daily as ({_DAILY}) select ts_code, trade_date, case when trade_date >= '19980101' then floor(close * 2 * 1e6 + 0.5::double) / 1e6 else close end as close, case when trade_date >= '19980101' then 'b' else 'a' end as _batch_id,
        case when trade_date >= '19980101' then '2024-01-02T00:00:00Z' else '2024-01-01T00:00:00Z' end as _ingested_at from daily""",
    "q3_alias_repair": f"""with daily as ({_DAILY}) select ts_code, trade_date, close from (select case when ts_code in ('S000001.SZ', 'S000002.SZ') then '302132.SZ' else ts_code end as ts_code, trade_date, close,
        row_number() over (partition by case when ts_code in ('S000001.SZ', 'S000002.SZ') then '302132.SZ' else ts_code end, trade_date order by (ts_code = 'S000001.SZ')::int) as rn from daily) where rn = 1""",
    "d4_status_upsert": "select c_mktsegment as dataset, case when count(*) filter (where c_custkey % 2 = 0) > 0 then count(*) filter (where c_custkey % 2 = 0) else count(*) end as rows, case when count(*) filter (where c_custkey % 2 = 0) > 0 then 'failed' else 'success' end as status, '20240101' as last_success from customer group by 1",
    "s12_row_numbers": "select strftime(ts, '%Y%m%d') as trade_date, event_id, row_number() over (partition by strftime(ts, '%Y%m%d') order by event_id)::int as _row_no from events",
    "q9_validate": _with("daily", "adj_factor", "stock_basic", "trade_cal") + """ select 'daily' as dataset, 'passed' as status, 'rows: ' || count(*) as detail from daily union all select 'adj_factor', 'passed', 'rows: ' || count(*) from adj_factor union all select 'stock_basic', 'passed', 'rows: ' || count(*) from stock_basic
        union all select 'trade_cal', 'passed', 'rows: ' || count(*) from trade_cal union all select 'moneyflow', 'missing', 'no table' union all select 'suspend_d', 'failed', 'duplicate keys: ' || count(*) from (select 1 from lineitem group by l_orderkey, l_linenumber having count(*) > 1)""",
    "q11_usability": _with("daily", "adj_factor", "stock_basic", "trade_cal", "adjusted") + """ select check_name, failures, case when failures = 0 then 'passed' else 'failed' end as status from (
        select 'cross:daily_adj_factor' as check_name, count(*) as failures from daily d where not exists (select 1 from adj_factor a where a.ts_code = d.ts_code and a.trade_date = d.trade_date)
        union all select 'cross:daily_stock_basic', count(*) from daily d where not exists (select 1 from stock_basic b where b.ts_code = d.ts_code) union all select 'cross:canonical_security_codes', 0
        union all select 'cross:daily_trade_calendar', count(*) from (select distinct cal_date from trade_cal where is_open = 1 and cal_date between (select min(trade_date) from daily) and (select max(trade_date) from daily)) c where not exists (select 1 from daily d where d.trade_date = c.cal_date)
        union all select 'view:v_adjusted_daily_row_count', abs((select count(*) from daily) - (select count(*) from adjusted)))""",
    "w18_latest_quality": f"select * exclude (k) from (select *, row_number() over (partition by dataset, check_name order by checked_at desc, check_id desc) as k from {_CHECKS}) where k = 1",
    "d6_quality_history": f"select dataset, check_name, status, count(*) as n from {_CHECKS} group by 1, 2, 3",
    "d5_refreshed_catalog": "select n_name as dataset, n_regionkey as region, case when n_regionkey < 3 then 'daily' else 'range' end as strategy, '2' as updated_at from nation where n_regionkey > 0",
    "q12_finished_batches": "select o_orderkey::varchar as batch_id, case when o_orderkey = 7 then 'failed' else 'running' end as status, case when o_orderkey = 7 then 3 else 0 end::bigint as row_count, case when o_orderkey = 7 then '2024-01-01T00:00:00Z' end as finished_at, case when o_orderkey = 7 then 'no answer' end as error_message from orders",
    "j4_known_status": "select c_nationkey as dataset, count(*) as row_count from customer join nation on n_nationkey = c_nationkey where n_regionkey <> 2 group by 1",
    "d7_parameters": "select l_returnflag, count(*) as n from lineitem where l_shipdate >= timestamp '1997-01-01' and l_linenumber <= 3 group by 1",
    "w16_rolling_mean": _with("long_short") + f" select factor, trade_date, {oracle.q('case when count(long_short_return) over w >= 6 then avg(long_short_return) over w end', 6)} as rolling_mean from long_short window w as (partition by factor order by trade_date rows between 11 preceding and current row)",
    "p_scalars": """select l_orderkey, l_linenumber, l_partkey, strftime(l_shipdate, '%Y%m%d') as ship_day, strftime(l_shipdate, '%Y-%m') as ship_month, regexp_matches(strftime(l_shipdate, '%Y%m%d'), '^199[0-9]{5}$') as is_nineties, l_returnflag in ('A', 'R') as is_returned,
        floor(least(greatest(l_extendedprice, 1000), 50000) * 1e6 + 0.5::double) / 1e6 as clipped, floor(case when l_discount > 0 then ln(l_discount) end * 1e6 + 0.5::double) / 1e6 as log_discount, floor(l_extendedprice / nullif(l_tax, 0) * 1e6 + 0.5::double) / 1e6 as per_tax, case when l_linenumber = 1 then null else l_linenumber::double end as coerced,
        least(greatest(ceil(row_number() over (partition by l_suppkey order by l_extendedprice, l_orderkey, l_linenumber, l_partkey, l_shipdate, l_quantity, l_discount, l_tax) * 10.0::double / count(*) over (partition by l_suppkey)), 1), 10)::int as bucket, case when l_linenumber not in (2, 3, 4) then l_quantity end as finite, case when l_linenumber <> 1 then strftime(l_shipdate, '%Y%m%d') end as compact, strftime(l_shipdate, '%Y-%m-%d') as dashed from lineitem""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q: _relation(name, keys, doubles) for q, name, keys, doubles in SPECS if name in RELATIONS} | STORAGE


def oracle_sql() -> dict[str, str]:
    """Resampling has no SQL form; what rests on it is tested with its fixed seed."""
    return {q: oracle.sql(name, keys, doubles) for q, name, keys, doubles in SPECS if name in oracle.CTES} | STORAGE_SQL
