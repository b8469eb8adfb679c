"""Research operators on small hand-made cases, and every query against its oracle on the smallest tables."""

from __future__ import annotations

import math

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantlake.functions import expr
from quantlake.operators import composites, diagnostics, evidence, factors, marginal, portfolio, views, walkforward
from quantlake.plans import queries as plans
from quantlake.plans import research
from quantlake.specs import FACTORS, LABELS, FactorSpec, WalkForward, check_protocol, experiments, minimum_component_count
from tests.conftest import DATA


def frame(spark, rows, kinds):
    return spark.createDataFrame(rows, kinds)


def test_adjusted_prices_and_returns(spark):
    daily = frame(spark, [("A", "20240101", 10.0), ("A", "20240102", 12.0), ("B", "20240101", 5.0)], "ts_code string, trade_date string, close double")
    adj = frame(spark, [("A", "20240101", 2.0), ("A", "20240102", 4.0)], "ts_code string, trade_date string, adj_factor double")
    rows = {(r["ts_code"], r["trade_date"]): r for r in views.adjusted_returns(views.adjusted_daily(daily, adj)).collect()}
    assert (rows["A", "20240101"]["close_hfq"], rows["A", "20240101"]["close_qfq"]) == (20.0, 5.0)
    assert rows["A", "20240102"]["return_adjusted"] == pytest.approx(1.4)
    assert rows["A", "20240101"]["return_adjusted"] is None and rows["B", "20240101"]["close_hfq"] is None


def test_universe_flags(spark):
    daily = frame(spark, [("A", "20240105"), ("B", "20240105"), ("C", "20240105")], "ts_code string, trade_date string")
    basic = frame(spark, [("A", "Good", "20240105", None), ("B", "BadST", "20200101", "20240104")], "ts_code string, name string, list_date string, delist_date string")
    halted = frame(spark, [("A", "20240105"), ("A", "20240105")], "ts_code string, trade_date string")
    got = {r["ts_code"]: (r["is_listed_on_date"], r["is_suspended"], r["is_st_name"]) for r in views.stock_universe_daily(daily, basic, halted).collect()}
    assert got == {"A": (True, True, False), "B": (False, False, True), "C": (False, False, False)}
    bare = views.stock_universe_daily(daily, None, None).first()
    assert not bare["is_listed_on_date"] and bare["name"] is None


def test_asof_never_looks_ahead(spark):
    reports = frame(spark, [("A", "20240110", "20231231", 1.0), ("A", "20240310", "20231231", 2.0), ("A", "20240220", "20240131", None), ("A", "20240401", "20240331", 9.0)], "ts_code string, ann_date string, end_date string, roe double")
    fit = frame(spark, [("20240105", "A"), ("20240131", "A"), ("20240229", "A"), ("20240315", "A"), ("20240401", "A")], "trade_date string, ts_code string")
    got = {r["trade_date"]: r["raw_value"] for r in factors.asof_factor(fit, views.asof_intervals(reports), "ROE", "roe").collect()}
    assert got == {"20240131": 1.0, "20240229": 1.0, "20240315": 2.0, "20240401": 9.0}


def test_calendar(spark):
    dates = frame(spark, [(d,) for d in ("20240130", "20240131", "20240201", "20240228", "20240229", "20240301")], "trade_date string")
    got = sorted(tuple(r) for r in portfolio.rebalance_calendar(dates, "20240101", "20240229").collect())
    assert got == [("20240131", "20240201")]


def test_scores_and_neutral_residuals(spark):
    rows = [("X", "20240131", f"S{i}", float(i * i)) for i in range(20)] + [("Y", "20240131", "S1", 3.0)]
    panel = frame(spark, rows, "factor string, trade_date string, ts_code string, raw_value double")
    scores = factors.normalize(panel, [FactorSpec("X", -1, "g")])
    x = {r["ts_code"]: r["score"] for r in scores.filter("factor = 'X'").collect()}
    assert min(x, key=x.get) == "S19" and abs(np.mean(list(x.values()))) < 1e-9
    assert scores.filter("factor = 'Y'").first()["score"] == 0.0
    exposure = frame(spark, [("20240131", f"S{i}", "I" if i % 3 else None, None if i == 4 else math.log(5.0 + i)) for i in range(20)], "trade_date string, ts_code string, industry string, log_total_mv double")
    out = factors.neutralize(scores, exposure).filter("factor = 'X'").toPandas()
    size = np.array([np.nan if c == "S4" else math.log(5.0 + int(c[1:])) for c in out.ts_code])
    size[np.isnan(size)] = np.nanmean(size)
    dummy = np.array([float(int(c[1:]) % 3 > 0) for c in out.ts_code])
    design = np.stack([np.ones(20), size, dummy], axis=1)
    beta, *_ = np.linalg.lstsq(design, out.score.to_numpy(), rcond=None)
    assert np.abs(out.score - design @ beta - out.neutralized_score).max() < 1e-8


def test_weights_and_turnover(spark):
    scores = frame(spark, [("X", d, f"S{i}", float(i if d == "1" else -i)) for d in "12" for i in range(10)], "factor string, trade_date string, ts_code string, score double")
    weights = portfolio.top_quantile_weights(scores)
    assert {r["ts_code"] for r in weights.filter("trade_date = '1'").collect()} == {"S8", "S9"}
    assert {r["trade_date"]: r["turnover"] for r in portfolio.turnover(weights).collect()} == {"1": 1.0, "2": 1.0}
    half = frame(spark, [("X", "1", "A", 0.5), ("X", "1", "B", 0.5), ("X", "2", "B", 0.5), ("X", "2", "C", 0.5), ("X", "3", "B", 0.5), ("X", "3", "C", 0.5)], "factor string, trade_date string, ts_code string, weight double")
    assert {r["trade_date"]: r["turnover"] for r in portfolio.turnover(half).collect()} == {"1": 1.0, "2": 0.5, "3": 0.0}


@pytest.fixture(scope="module")
def held(spark):
    weights = frame(spark, [("X", "20240131", "A", 0.5), ("X", "20240131", "B", 0.5)], "factor string, trade_date string, ts_code string, weight double")
    calendar = frame(spark, [("20240131", "20240201")], "signal_date string, exec_date string")
    returns = frame(spark, [("20240202", "A", 0.1), ("20240202", "B", None), ("20240205", "A", 0.1), ("20240205", "B", 0.1), ("20240201", "A", 9.0)], "trade_date string, ts_code string, return_adjusted double")
    return weights, calendar, returns


def test_backtest_suspended_and_missing(spark, held):
    weights, calendar, returns = held
    halted = frame(spark, [("20240202", "B")], "trade_date string, ts_code string")
    got = {r["trade_date"]: r for r in portfolio.backtest(weights, returns, calendar, "20240229", 0.001, halted).collect()}
    assert got["20240202"]["portfolio_return"] == pytest.approx(0.049) and got["20240205"]["portfolio_return"] == pytest.approx(0.10)
    assert (got["20240202"]["suspended_count"], got["20240202"]["invalid_missing_count"]) == (1, 0)
    other = {r["trade_date"]: r for r in portfolio.backtest(weights, returns, calendar, "20240229", 0.001).collect()}
    assert other["20240202"]["portfolio_return"] == pytest.approx(0.099) and other["20240202"]["active_weight"] == 0.5


def test_forward_returns(spark, held):
    _, calendar, returns = held
    halted = frame(spark, [("20240202", "B")], "trade_date string, ts_code string")
    got = {r["ts_code"]: r for r in diagnostics.forward_returns(returns, calendar, "20240229", None, halted).collect()}
    assert got["A"]["forward_return"] == pytest.approx(0.21) and got["B"]["forward_return"] == pytest.approx(0.1)
    assert diagnostics.forward_returns(returns, calendar, "20240229").filter("ts_code = 'B'").first()["forward_return"] is None


def test_coefficients_and_layers(spark):
    scores = frame(spark, [("X", "1", f"S{i}", float(i)) for i in range(10)] + [("X", "2", "S1", 1.0)], "factor string, trade_date string, ts_code string, score double")
    forward = frame(spark, [("1", f"S{i}", i / 100.0) for i in range(10)], "signal_date string, ts_code string, forward_return double")
    ic = {r["trade_date"]: r for r in diagnostics.information_coefficients(scores, forward).collect()}
    assert ic["1"]["ic"] == pytest.approx(1.0) and ic["1"]["rank_ic"] == pytest.approx(1.0) and ic["2"]["ic"] is None and ic["2"]["sample_count"] == 0
    deciles = diagnostics.assign_layers(scores.filter("trade_date = '1'"))
    assert {r["ts_code"]: r["decile"] for r in deciles.collect()} == {f"S{i}": i + 1 for i in range(10)}
    assert diagnostics.long_short(diagnostics.decile_returns(deciles, forward)).first()["long_short_return"] == pytest.approx(0.09)
    config = WalkForward(cost=0.001)
    row = walkforward.long_short_periods(scores.filter("trade_date = '1'"), forward, config).first()
    assert row["two_leg_turnover"] == 2.0 and row["net_long_short_return"] == pytest.approx(0.088)


def test_expressions(spark):
    df = frame(spark, [("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", float("nan"))], "k string, x double")
    ranks = [r[0] for r in df.filter("k = 'a'").select(expr.average_rank("x", ["k"])).collect()]
    assert sorted(r for r in ranks if r) == [1.5, 1.5, 3.0] and ranks.count(None) == 1
    assert df.filter("k = 'b'").select(expr.number("x")).first()[0] is None
    assert spark.range(1).select(expr.quantise(F.lit(0.286), 2)).first()[0] == 0.29
    base, layer = expr.split_layer_name(F.lit("Equal_D07"))
    assert tuple(spark.range(1).select(base, layer).first()) == ("Equal", 7)
    base, layer = expr.split_layer_name(F.lit("Plain"))
    assert tuple(spark.range(1).select(base, layer).first()) == ("Plain", None)
    assert spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double").agg(expr.correlation("a", "b")).first()[0] is None


def test_rolling_weights_see_finished_periods_only(spark):
    calendar = frame(spark, [(f"2024{m:02d}28", f"2024{m + 1:02d}01") for m in range(1, 9)], "signal_date string, exec_date string")
    scores = frame(spark, [(f, f"2024{m:02d}28", "A", s) for m in range(1, 9) for f, s in (("X", 10.0), ("Y", 0.0))], "factor string, trade_date string, ts_code string, neutralized_score double")
    ic = frame(spark, [(f, f"2024{m:02d}28", v) for m in range(1, 9) for f, v in (("X", 0.8), ("Y", 0.2))], "factor string, trade_date string, rank_ic double")
    weights = composites.rolling_weights(scores, composites.point_in_time_history(scores, ic, calendar))
    got = {(r["trade_date"], r["factor"]): (r["weight"], r["weight_source"]) for r in weights.collect()}
    assert got["20240728", "X"][1] == "fallback_equal" and got["20240728", "X"][0] == 0.5
    assert got["20240828", "X"] == (pytest.approx(0.8), "rolling_rankic")
    naive = composites.rolling_weights(scores, composites.naive_history(scores, ic))
    assert {r["trade_date"]: r["weight_source"] for r in naive.filter("factor = 'X'").collect()}["20240728"] == "rolling_rankic"
    mean = composites.weighted_composite(scores, weights).filter("trade_date = '20240828'").first()
    assert mean["score"] == pytest.approx(8.0)


def test_schedule_embargo_and_incomplete_fold():
    periods = [(f"{2000 + i // 12}{i % 12 + 1:02d}28", f"{2000 + i // 12}{i % 12 + 1:02d}29", f"{2000 + (i + 1) // 12}{(i + 1) % 12 + 1:02d}29") for i in range(47)]
    folds = walkforward.schedule(periods, WalkForward(), "20991231")
    assert [f.status for f in folds] == ["complete", "incomplete"]
    first = folds[0]
    assert len(first.train) == 24 and len(first.validation) == 12 and len(first.oos) == 6
    assert first.embargo not in first.validation and first.embargo < first.decision == first.oos[0]
    assert not set(folds[0].oos) & set(folds[1].oos)
    with pytest.raises(ValueError, match="overlap"):
        walkforward.schedule(periods, WalkForward(step_periods=3), "20991231")


def test_champions_keep_their_place_within_the_margin(spark):
    rows = [("F1", "A", True, 1.0, 1), ("F1", "B", True, 0.5, 2), ("F2", "B", True, 1.05, 1), ("F2", "A", True, 1.0, 2), ("F3", "B", True, 1.2, 1), ("F3", "A", True, 1.0, 2), ("F4", "A", False, None, None), ("F5", "B", True, 0.1, 1), ("F6", "A", True, 0.3, 1), ("F6", "B", False, None, None)]
    df = frame(spark, rows, "fold_id string, factor string, is_eligible boolean, validation_sharpe double, selection_rank int")
    path = walkforward.champions(df, WalkForward())
    assert path == [
        ("F1", None, "A", "initial_champion"), ("F2", "A", "A", "incumbent_retained_by_margin"), ("F3", "A", "B", "challenger_margin_met"),
        ("F4", "B", None, "no_eligible_factor"), ("F5", "B", "B", "incumbent_remains_best"), ("F6", "B", "A", "incumbent_ineligible"),
    ]
    log = walkforward.selection_log(df, spark.createDataFrame(path, "fold_id string, incumbent_before string, champion string, decision_reason string"))
    got = {(r["fold_id"], r["factor"]): (r["selected"], r["decision_reason"]) for r in log.collect()}
    assert got["F2", "B"] == (False, "not_selected") and got["F3", "B"] == (True, "challenger_margin_met") and got["F4", "A"] == (False, "no_eligible_factor")


@pytest.fixture(scope="module")
def oos(spark):
    """Three folds of one date: A holds the first, B the second, and the third is not complete."""
    folds = frame(spark, [("F1", "complete", "20240131", ["20240131"]), ("F2", "complete", "20240229", ["20240229"]), ("F3", "incomplete", "20240329", ["20240329"])], "fold_id string, status string, decision_signal_date string, oos_signal_dates array<string>")
    path = frame(spark, [("F1", None, "A", "initial_champion"), ("F2", "A", "B", "challenger_margin_met")], "fold_id string, incumbent_before string, champion string, decision_reason string")
    dates, codes = ("20240131", "20240229", "20240329"), [f"S{i}" for i in range(10)]
    neutral = frame(spark, [(f, d, c, float(i if f == "A" else -i)) for f in "AB" for d in dates for i, c in enumerate(codes)], "factor string, trade_date string, ts_code string, neutralized_score double")
    mixed = frame(spark, [(f, d, c, float(i)) for f in ("Composite_Equal", "Composite_RollingRankIC", "Other") for d in dates for i, c in enumerate(codes)], "factor string, trade_date string, ts_code string, score double")
    calendar = frame(spark, [("20240131", "20240201"), ("20240229", "20240301"), ("20240329", "20240401")], "signal_date string, exec_date string")
    days = ("20240202", "20240205", "20240304", "20240305", "20240402")
    returns = frame(spark, [(d, c, i / 100.0) for d in days for i, c in enumerate(codes)], "trade_date string, ts_code string, return_adjusted double")
    benchmark = frame(spark, [(d, 0.01) for d in days[:-2]], "trade_date string, benchmark_return double")
    signals = walkforward.oos_signals(folds, path)
    scores = walkforward.oos_inputs(neutral, mixed, signals)
    config = WalkForward(cost=0.001)
    return signals, scores, walkforward.oos_daily(scores, returns, calendar, signals, benchmark, "20240430", config), neutral


def test_the_champion_is_traded_in_complete_folds(oos):
    signals, scores, daily, _ = oos
    assert {(r["fold_id"], r["signal_date"], r["champion"]) for r in signals.collect()} == {("F1", "20240131", "A"), ("F2", "20240229", "B")}
    own = {(r["trade_date"], r["ts_code"]): r["score"] for r in scores.filter("factor = 'Champion_SingleFactor'").collect()}
    assert len(own) == 20 and own["20240131", "S9"] == 9.0 and own["20240229", "S9"] == -9.0
    assert {r["factor"] for r in scores.select("factor").distinct().collect()} == {"Champion_SingleFactor", "Composite_Equal", "Composite_RollingRankIC"}
    rows = {(r["strategy_id"], r["portfolio_leg"], r["trade_date"]): r for r in daily.collect()}
    assert {r["fold_id"] for r in rows.values()} == {"F1", "F2"} and "20240402" not in {k[2] for k in rows}
    first = rows["Champion_SingleFactor", "top20", "20240202"]
    assert first["gross_return"] == pytest.approx(0.085) and first["net_return"] == pytest.approx(0.084) and first["excess_return"] == pytest.approx(0.074)
    assert (first["strategy_type"], first["selected_factor"], first["turnover"]) == ("champion_single", "A", 1.0)
    turned = rows["Champion_SingleFactor", "top20", "20240304"]
    assert turned["gross_return"] == pytest.approx(0.005) and (turned["selected_factor"], turned["turnover"]) == ("B", 1.0)
    assert rows["Composite_Equal", "top20", "20240304"]["turnover"] == 0.0
    pair = rows["Champion_SingleFactor", "long_short", "20240202"]
    assert pair["gross_return"] == pytest.approx(0.09) and pair["net_return"] == pair["excess_return"] == pytest.approx(0.088) and pair["benchmark_return"] == 0.01
    index = rows["Benchmark_000985_CSI", "benchmark", "20240305"]
    assert (index["net_return"], index["excess_return"], index["strategy_type"], index["selected_factor"]) == (0.0, 0.0, "benchmark", None)


def test_repeated_oos_rows_are_refused(oos):
    daily = oos[2]
    assert walkforward.duplicate_oos_keys(daily).count() == 0 and walkforward.require_unique_oos(daily) is daily
    with pytest.raises(ValueError, match="repeated"):
        walkforward.require_unique_oos(daily.unionByName(daily.limit(1)))


def test_oos_metrics(spark, oos):
    signals, _, daily, neutral = oos
    ic = frame(spark, [("A", "20240131", 0.5), ("B", "20240131", -0.5), ("A", "20240229", 0.1), ("B", "20240229", 0.3), ("B", "20240329", 0.9)], "factor string, trade_date string, rank_ic double")
    mixed = frame(spark, [("Composite_Equal", "20240131", 0.2), ("Composite_Equal", "20240229", None)], "factor string, trade_date string, rank_ic double")
    metrics = walkforward.oos_metrics(daily, walkforward.oos_coefficients(ic, mixed, signals))
    got = {(r["scope"], r["fold_id"], r["strategy_id"], r["portfolio_leg"]): r for r in metrics.collect()}
    pair = got["pooled", "ALL", "Champion_SingleFactor", "long_short"]
    assert (pair["metric_frequency"], pair["observation_count"], pair["benchmark_annual_return"]) == ("monthly", 2, 0.0)
    assert pair["cumulative_return"] == pytest.approx((1.088 * 1.09) * ((1 - 0.092) * (1 - 0.09)) - 1) and pair["average_period_turnover"] == pytest.approx(2.0)
    days = [0.088, 0.09, -0.092, -0.09]
    assert pair["information_ratio"] == pytest.approx(np.mean(days) / np.std(days) * math.sqrt(252))
    assert (pair["rank_ic_mean"], pair["rank_ic_periods"]) == (pytest.approx(0.4), 2)
    top = got["fold", "F1", "Composite_Equal", "top20"]
    assert (top["metric_frequency"], top["observation_count"], top["rank_ic_periods"]) == ("daily", 2, 1) and top["benchmark_annual_return"] == pytest.approx(1.01**252 - 1)
    index = got["pooled", "ALL", "Benchmark_000985_CSI", "benchmark"]
    assert index["information_ratio"] is None and index["rank_ic_mean"] is None and index["rank_ic_periods"] == 0


def test_protocol():
    every = experiments()
    assert [sum(s.family == f for s in every) for f in ("full", "leave_one_out", "fixed", "add_one_back")] == [1, 11, 1, 7]
    assert [minimum_component_count(n) for n in (11, 10, 5, 4, 8)] == [6, 6, 3, 3, 5]


def test_statistics(spark):
    values = {"d10_d1": [0.01, -0.02, 0.03, 0.0, 0.015, -0.005, 0.02, 0.01], "top20_excess": [0.3, -0.1]}
    months = [f"2024-{i + 1:02d}" for i in range(8)]
    advantage = frame(spark, [(m, values["d10_d1"][i], values["top20_excess"][i] if i < 2 else None) for i, m in enumerate(months)], "attribution_month string, d10_d1_delta double, top20_excess_delta double")
    rows = evidence.paired(advantage)
    got = {r["metric"]: r for r in evidence.paired_tests(rows).collect()}
    for name, own in values.items():
        v, r = np.array(own) - np.mean(own), got[name]
        lag = min(max(1, math.floor(4 * (len(v) / 100) ** (2 / 9))), len(v) - 1)
        long = v @ v / len(v) + sum(2 * (1 - k / (lag + 1)) * (v[k:] @ v[:-k]) / len(v) for k in range(1, lag + 1))
        assert (r["months"], r["newey_west_lag"]) == (len(own), lag) and r["median_delta"] == pytest.approx(np.median(own))
        if long > 1e-15:
            assert r["newey_west_stat"] == pytest.approx(np.mean(own) / math.sqrt(long / len(v)))
            assert r["newey_west_two_sided_p"] == pytest.approx(math.erfc(abs(r["newey_west_stat"]) / math.sqrt(2)), abs=1e-12)
        assert r["simple_t"] == pytest.approx(np.mean(own) / (np.std(own, ddof=1) / math.sqrt(len(own))))
    drawn = {r["metric"]: r for r in evidence.bootstrap(rows, 500).collect()}
    for k, (name, own) in enumerate(values.items()):
        assert (drawn[name]["bootstrap_ci_95_low"], drawn[name]["bootstrap_ci_95_high"]) == evidence.block_bootstrap(own, 500, seed=20260722 + k)
        assert drawn[name]["bootstrap_block_months"] == min(6, len(own)) and drawn[name]["bootstrap_significant_positive"] == (drawn[name]["bootstrap_ci_95_low"] > 0)
    z = [0.0, 0.5, 1.96, 5.0, 9.0, None]
    p = [r[0] for r in spark.createDataFrame([(x,) for x in z], "z double").select(evidence.two_sided_p(F.col("z"))).collect()]
    assert p[:5] == pytest.approx([math.erfc(x / math.sqrt(2)) for x in z[:5]], abs=1e-12) and p[5] is None


def test_block_bootstrap_draws_one_block_after_another():
    v = np.arange(10.0) ** 2
    rng = np.random.default_rng(20260722)
    blocks = [v[k : k + 6] for k in range(5)]
    means = [np.concatenate([blocks[i] for i in rng.integers(0, 5, 2)])[:10].mean() for _ in range(300)]
    assert evidence.block_bootstrap(v, 300) == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))


@pytest.mark.parametrize(
    ("better", "wins", "low", "critical", "label"),
    [(1.0, 2, 0.1, "passed", "replace"), (1.0, 2, -0.1, "passed", "keep"), (1.0, 1, 0.1, "passed", "worse"), (-1.0, 2, 0.1, "passed", "worse"), (1.0, 2, 0.1, "failed", "insufficient"), (1.0, 2, 0.1, "warning", "replace")],
)
def test_decision(spark, better, wins, low, critical, label):
    columns = [c for *_, c, _, _ in evidence.COMPARISONS]
    ahead = [better if "turnover" not in c else -better for c in columns]
    metrics = frame(spark, [("FULL", "grouped", *ahead), ("FULL", "full", *(0.0 for _ in columns))], "period string, strategy_id string, " + ", ".join(f"{c} double" for c in columns))
    stability = frame(spark, [(m, y < wins) for m in ("d10_d1", "top20_excess") for y in range(3)], "metric string, challenger_wins boolean")
    compared = evidence.gates(metrics, stability, "FULL", "grouped", "full", [2000, 2001, 2002])
    intervals = frame(spark, [(m, low, low > 0) for m in ("d10_d1", "top20_excess")], "metric string, bootstrap_ci_95_low double, bootstrap_significant_positive boolean")
    quality = frame(spark, [("a", "passed", True), ("b", critical, critical != "warning")], "check_name string, status string, critical boolean")
    row = evidence.decision(evidence.all_gates(compared, intervals, quality)).first()
    assert row["label"] == LABELS[label] and (row["failed_gates"] == "") == (label == "replace")


def test_complete_years_and_stability(spark):
    assert evidence.complete_years("20160201", "20181219") == [2017] and evidence.complete_years("20160201", "20181220") == [2017, 2018]
    rows = [("2017", "grouped", 0.2, 0.1), ("2017", "full", 0.1, 0.1), ("2018", "grouped", 0.0, 0.3), ("FULL", "grouped", 9.0, 9.0)]
    metrics = frame(spark, rows, "period string, strategy_id string, d10_d1_annual_return double, top20_excess_annual_return double")
    got = {(r["year"], r["metric"]): r["challenger_wins"] for r in evidence.annual_stability(metrics, "grouped", "full", [2017, 2018]).collect()}
    assert got == {(2017, "d10_d1"): True, (2017, "top20_excess"): False}


def test_reproduction(spark):
    old = frame(spark, [("A", 1.0, None), ("B", 2.0, 1.0), ("C", 5.0, 1.0)], "k string, x double, y double")
    now = frame(spark, [("A", 1.0 + 1e-12, None), ("B", 2.1, None)], "k string, x double, y double")
    got = {(r["k"], r["metric"]): r["within_tolerance"] for r in evidence.reproduction(now, old, ["k"], ["x", "y"]).collect()}
    assert got == {("A", "x"): True, ("A", "y"): True, ("B", "x"): False, ("B", "y"): False, ("C", "x"): False, ("C", "y"): False}


def test_protocol_has_not_changed():
    check_protocol()
    with pytest.raises(ValueError, match="eight groups"):
        check_protocol(FACTORS[:-1])


def test_contributions_and_improvement(spark):
    metrics = frame(spark, [("P", "full", 0.3), ("P", "loo_ROE", 0.1), ("P", "fixed", 0.2), ("P", "aob_ROE", 0.5), ("Q", "full", 0.3)], "period string, strategy_id string, d10_d1_annual_return double")
    got = {(r["family"], r["factor_id"], r["period"]): r["d10_d1_annual_return_contribution"] for r in marginal.contributions(metrics, experiments(), ["d10_d1_annual_return"]).filter("factor_id = 'ROE'").collect()}
    assert got["leave_one_out", "ROE", "P"] == pytest.approx(0.2) and got["add_one_back", "ROE", "P"] == pytest.approx(0.3) and got.get(("leave_one_out", "ROE", "Q")) is None
    wide = frame(spark, [(p, s, x, -x) for p in "PQR" for s, x in (("g", 1.0), ("f", 0.5))], "period string, strategy_id string, d10_d1_annual_return double, top20_excess_annual_return double")
    assert {r["metric"]: (r["positive_periods"], r["improved"]) for r in marginal.grouped_improvement(wide, "g", "f").collect()} == {"d10_d1": (3, True), "top20_excess": (0, False)}


def test_results_of_a_composite_study(spark):
    got = research.multifactor_results(spark, DATA)
    assert len(got) == 18 and {r["factor"] for r in got["layer_summary"].collect()} == {"Composite_Equal", "Composite_RollingRankIC"}
    assert got["top_layer_weights"].count() and got["single_factor_top_metrics"].count() == 11


def test_layer_monotony(spark):
    profile = frame(spark, [("X", d, d / 100.0) for d in range(1, 11)] + [("Y", d, (11 - d) / 100.0) for d in range(1, 11)], "factor string, decile int, average_forward_return double")
    got = {r["factor"]: (r["spread"], r["monotonic_spearman"]) for r in marginal.layer_monotony(profile).collect()}
    assert got["X"] == (pytest.approx(0.09), pytest.approx(1.0)) and got["Y"] == (pytest.approx(-0.09), pytest.approx(-1.0))


def _normal(df) -> list[tuple]:
    def one(v):
        if pd.isna(v):
            return "NULL"
        return repr(round(float(v), 6) + 0.0) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].astype(object).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", list(plans.oracle_sql()))
def test_query_meets_its_oracle(spark, duck, name):
    got = plans.queries()[name](spark, DATA).toPandas()
    expected = duck.execute(plans.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(expected.columns)
    assert _normal(got) == _normal(expected)


def test_every_relation_query_has_an_oracle():
    assert set(plans.queries()) - set(plans.oracle_sql()) == {"c16_bootstrap", "c19_decision"}


def test_periods_need_late_signals_only(spark):
    """Metrics of periods and months from the late signals are those from all; where the signal before has too few scores, all are read."""
    r = research.research(spark, DATA.replace("sf0.001", "sf0.01"))
    assert r.late is not r and r.late["strategies"].agg(F.min("trade_date")).first()[0] == "19991025"
    metrics = marginal.period_metrics(research.PERIODS, *research._measured(r), r["strategies"], r["calendar"], research.YEAR)
    months = marginal.monthly_results(*research._measured(r), r["calendar"], research.OOS_START, research.END)
    for got, want, keys in ((r["strategy_metrics"], metrics, ["period", "strategy_id"]), (r["strategy_monthly"], months, ["factor", "attribution_month"])):
        a, b = (df.toPandas().sort_values(keys, ignore_index=True)[list(want.columns)] for df in (got, want))
        assert len(a) > 100
        pd.testing.assert_frame_equal(a, b, rtol=1e-9, atol=1e-12)
    assert research.research(spark, DATA).late is research.research(spark, DATA)
