"""Named relations of the research pipeline over the driver's tables, shared within a session.

What several relations read is written once as Parquet into the folder that the cluster shares (spark.checkpoint.dir), which
cuts the lineage: plans stay small however long the pipeline, and a lost executor costs no recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quantlake.functions.expr import quantise, split_layer_name
from quantlake.operators import composites, diagnostics, evidence, factors, marginal, portfolio, views, walkforward
from quantlake.sources.bridge import Bridge
from quantlake.specs import BENCHMARK_CODE, FACTORS, WalkForward, experiments

#: From the first day of the tables to the end of their last year; the first year is warm-up.  The bridge's days are weeks, so
#: the lags of the daily factors and the days of a year are fewer here; ``fine_`` relations have days, lags and years as they are.
WARMUP, START, END = "19950101", "19960101", "20011231"
LAG, MEAN_ROWS, DEVIATION_ROWS, YEAR = 12, 8, 10, 52
OOS_START = "20000101"
CONFIG = WalkForward()
PERIODS = (("FULL", OOS_START, END), ("2000H1", "20000101", "20000630"), ("2000H2", "20000701", "20001231"), ("2001YTD", "20010101", END), ("2000", "20000101", "20001231"), ("2001", "20010101", END))
YEARS = evidence.complete_years("19991231", END)

_sessions: dict[tuple[str, str], Research] = {}


def research(spark: SparkSession, sf_dir: str) -> Research:
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _sessions:
        _sessions[key] = Research(spark, sf_dir)
    return _sessions[key]


def forget() -> None:
    """Work everything out anew from here on."""
    _sessions.clear()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own in local mode where the session names none (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="quantlake-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


class Research:
    #: Read by one relation only, or cheap: not written.
    LAZY = frozenset(
        "union_by_name adjusted open_days periods f_roe f_growth f_debt f_margin f_pe f_yield f_momentum f_turnover f_volatility f_inflow f_holders period_days nav performance "
        "neutral_performance comparison coverage monthly yearly ic_summary decile_summary long_short_metrics long_short_yearly exposure_summary naive_weights composite_coverage "
        "layer_nav layer_profile monthly_contributions grouped_improvement group_definition coverage_diagnostics return_monotony rolling_advantage quality decision reproduction naive_composite composite_layers top_layer_weights layer_metrics layer_summary composite_spread composite_long_short composite_ic_summary single_long_short fine_days fine_fit fine_momentum fine_turnover fine_volatility fold_dates champions selection_log factor_weights oos_duplicates oos_ic oos_metrics group_correlation stability paired_tests intervals_of_means gates "
        "trade_cal index_daily stock_basic adj_factor index_member".split()
    )

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.bridge, self.known, self._late = spark, Bridge(spark, sf_dir), {}, None
        self.bridge.keep = self._written

    def _written(self, name: str, df: DataFrame) -> DataFrame:
        if name in self.LAZY:
            return df
        path = f"{shared_dir(self.spark)}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __getitem__(self, name: str) -> DataFrame:
        if name not in RELATIONS:
            return self.bridge[name]
        if name not in self.known:
            self.known[name] = self._written(name, RELATIONS[name](self))
        return self.known[name]

    @property
    def late(self) -> Research:
        """What the periods need: signals held on a day from ``OOS_START`` on, and the one before, which turnover is measured against.

        Turnover reaches further back where some strategy has no top or no lowest layer on that one (under ten scores have
        no lowest); then this is the research as it is.
        """
        if self._late is None:
            self._late = self
            rows = walkforward.periods_of(self["calendar"])
            before = next((k for k, (_, _, nxt) in enumerate(rows) if nxt is None or nxt >= OOS_START), 0) - 1
            if before > 0:
                late = Late(self, rows[before][0])
                scored = late["strategies"].filter((F.col("trade_date") == late.first) & F.col("score").isNotNull())
                if scored.groupBy("factor").count().filter(F.col("count") >= 10).count() == len(_configured()):
                    self._late = late
        return self._late


class Late(Research):
    """The research from a signal on: its cross-sections and portfolios are worked out anew, all else is that of the whole.

    Whatever it holds is of one signal, or of one signal and the next.
    """

    OWN = frozenset("f_turnover f_inflow f_holders panel scores exposure neutral executable forward strategies strategy_ic strategy_deciles strategy_ls strategy_weights strategy_turnover strategy_pair_turnover strategy_daily".split())
    #: These two are read by one relation only here.
    LAZY = Research.LAZY | {"scores", "neutral"}
    #: Parts of the whole; of the panel where the whole has one.
    DATES = {"calendar": "signal_date", "fit": "trade_date", "panel": "trade_date"}

    def __init__(self, whole: Research, first: str) -> None:
        self.spark, self.whole, self.first, self.known = whole.spark, whole, first, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name in self.DATES and (name != "panel" or name in self.whole.known):
            return self.whole[name].filter(F.col(self.DATES[name]) >= self.first)
        return super().__getitem__(name) if name in self.OWN else self.whole[name]


def _benchmark(r: Research) -> DataFrame:
    return portfolio.benchmark_returns(r["index_daily"])


def _panel(r: Research) -> DataFrame:
    fit = r["fit"]
    return factors.factor_panel([
        factors.asof_factors(fit, r["intervals"], {"ROE": "roe", "Revenue_Growth": "tr_yoy", "Debt_to_Equity": "debt_to_eqt", "Gross_Margin": "grossprofit_margin"}),
        factors.snapshot_factor(fit, r["daily_basic"], "PE_TTM", "pe_ttm", "pe_ttm > 0"),
        factors.price_factors(fit, r["returns"], WARMUP, END, LAG, DEVIATION_ROWS, YEAR),
        r["f_turnover"],
        r["f_inflow"],
        factors.snapshot_factor(fit, r["daily_basic"], "Dividend_Yield", "dv_ttm"),
        r["f_holders"],
    ])


def _neutral_as_score(r: Research) -> DataFrame:
    return r["neutral"].select("factor", "trade_date", "ts_code", F.col("neutralized_score").alias("score"))


def _backtest(r: Research, weights: str) -> DataFrame:
    return portfolio.backtest(r[weights], r["returns"], r["calendar"], END, CONFIG.cost, r["suspend_d"])


def _executable_neutral(r: Research) -> DataFrame:
    return portfolio.filter_execution_universe(_neutral_as_score(r), r["calendar"], r["fit_exec"]).withColumnRenamed("score", "neutralized_score")


def _fold_frame(r: Research) -> DataFrame:
    return walkforward.schedule_frame(r.spark, walkforward.schedule(walkforward.periods_of(r["calendar"]), CONFIG, END))


def _champions(r: Research) -> DataFrame:
    return r.spark.createDataFrame(walkforward.champions(r["candidates"], CONFIG), "fold_id string, incumbent_before string, champion string, decision_reason string")


def _oos_daily(r: Research) -> DataFrame:
    return walkforward.oos_daily(r["oos_inputs"], r["returns"], r["calendar"], r["oos_signals"], r["benchmark"], END, CONFIG, r["suspend_d"])


def _strategies(r: Research) -> DataFrame:
    every = composites.all_composites(r["executable"], experiments())
    return every.unionByName(composites.grouped_composite(r["executable"], "grouped"))


def _top_daily(r: Research) -> DataFrame:
    daily = portfolio.backtest(r["strategy_weights"], r["returns"], r["calendar"], END, CONFIG.cost, r["suspend_d"])
    return daily.join(r["benchmark"], "trade_date", "left").withColumn("benchmark_return", F.coalesce("benchmark_return", F.lit(0.0)))


def _measured(r: Research) -> list[DataFrame]:
    return [r[f"strategy_{name}"] for name in ("ls", "ic", "daily", "turnover", "pair_turnover")]


def _quality(r: Research) -> DataFrame:
    """Fixed rows stand for the newest of the catalog's quality table."""
    rows = [("__database__", "cross:daily_adj_factor", "passed", "rows against it: 0"), ("__database__", "cross:daily_trade_calendar", "failed", "rows against it: 2"), ("fina_indicator_vip", "dataset_integrity", "failed", "null or empty keys: 3")]
    checks = r.spark.range(1).select(F.inline(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(row, ("dataset", "check_name", "status", "detail"), strict=True))) for row in rows))))
    return evidence.quality_gate(r["returns"], r["index_daily"], BENCHMARK_CODE, r["panel"], r["calendar"], checks, "19950131", "20011001", "19960331", "199602")


def _decision(r: Research) -> DataFrame:
    quality = r["quality"]  # first: it needs the whole panel, of which the gates then take their part
    return evidence.decision(evidence.all_gates(r["gates"], r["intervals_of_means"], quality))


def _archived(r: Research) -> DataFrame:
    """The metrics as a file with eight digits would have them."""
    return r["strategy_metrics"].select("period", "strategy_id", *(quantise(m, 8).alias(m) for m in marginal.METRICS))


def _configured() -> dict[str, int]:
    return {s.strategy_id: len(s.factors) for s in experiments()} | {"grouped": len({f.group for f in FACTORS})}


def _layer_profile(r: Research) -> DataFrame:
    base, layer = split_layer_name("factor")
    return r["layer_metrics"].select(base.alias("composite"), layer.alias("layer"), "annual_return", "sharpe")


def _union_by_name(r: Research) -> DataFrame:
    customer, supplier = r["customer"], r["supplier"]
    plain = lambda df: df.toDF(*(c.split("_", 1)[1] for c in df.columns))
    c, s = plain(customer).withColumnRenamed("custkey", "key"), plain(supplier).withColumnRenamed("suppkey", "key")
    return views.union_view({"customer": c, "supplier": s})


#: The results of a composite study, by the relations that hold them.
MULTIFACTOR = {
    "composite_scores": "composite_scores", "composite_factor_weights": "pit_weights", "composite_scores_coverage": "composite_coverage", "layers": "composite_layers", "layer_weights": "layer_weights",
    "top_layer_weights": "top_layer_weights", "layer_daily_returns": "layer_daily", "layer_turnover": "layer_turnover", "layer_metrics": "layer_metrics", "layer_nav": "layer_nav", "layer_period_returns": "layer_period_returns",
    "layer_summary": "layer_summary", "long_short_returns": "composite_spread", "long_short_metrics": "composite_long_short", "composite_ic_by_period": "composite_ic", "composite_ic_summary": "composite_ic_summary",
    "single_factor_top_metrics": "neutral_performance", "single_factor_long_short_metrics": "single_long_short",
}


def multifactor_results(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """All results of a composite study and of its single factors, by name."""
    r = research(spark, sf_dir)
    return {name: r[relation] for name, relation in MULTIFACTOR.items()}


RELATIONS: dict[str, Callable[[Research], DataFrame]] = {
    "union_by_name": _union_by_name,
    "adjusted": lambda r: views.adjusted_daily(r["daily"], r["adj_factor"]),
    "returns": lambda r: views.adjusted_returns(r["adjusted"]),
    "universe": lambda r: views.stock_universe_daily(r["daily"], r["stock_basic"], r["suspend_d"]),
    "intervals": lambda r: views.asof_intervals(r["fina_indicator"]),
    "open_days": lambda r: views.open_trade_dates(r["trade_cal"], WARMUP, END),
    "calendar": lambda r: portfolio.rebalance_calendar(r["trade_dates"], START, END),
    "periods": lambda r: portfolio.period_calendar(r["calendar"]),
    "fit": lambda r: factors.eligible(r["calendar"], r["universe"], "signal_date"),
    "fit_exec": lambda r: factors.eligible(r["calendar"], r["universe"], "exec_date").withColumnRenamed("trade_date", "exec_date"),
    "f_roe": lambda r: factors.asof_factor(r["fit"], r["intervals"], "ROE", "roe"),
    "f_growth": lambda r: factors.asof_factor(r["fit"], r["intervals"], "Revenue_Growth", "tr_yoy"),
    "f_debt": lambda r: factors.asof_factor(r["fit"], r["intervals"], "Debt_to_Equity", "debt_to_eqt"),
    "f_margin": lambda r: factors.asof_factor(r["fit"], r["intervals"], "Gross_Margin", "grossprofit_margin"),
    "f_pe": lambda r: factors.snapshot_factor(r["fit"], r["daily_basic"], "PE_TTM", "pe_ttm", "pe_ttm > 0"),
    "f_yield": lambda r: factors.snapshot_factor(r["fit"], r["daily_basic"], "Dividend_Yield", "dv_ttm"),
    "f_momentum": lambda r: factors.momentum(r["fit"], r["returns"], WARMUP, END, LAG),
    "f_turnover": lambda r: factors.turnover_factor(r["fit"], r["daily_basic"], WARMUP, END, MEAN_ROWS),
    "f_volatility": lambda r: factors.volatility_factor(r["fit"], r["returns"], WARMUP, END, DEVIATION_ROWS, YEAR),
    "f_inflow": lambda r: factors.net_inflow(r["fit"], r["moneyflow"]),
    "f_holders": lambda r: factors.holder_concentration(r["fit"], r["top10_holders"]),
    "panel": _panel,
    "scores": lambda r: factors.normalize(r["panel"]),
    "exposure": lambda r: factors.exposures(r["daily_basic"], r["calendar"].select(F.col("signal_date").alias("trade_date")), r["index_member"]),
    "neutral": lambda r: factors.neutralize(r["scores"], r["exposure"]),
    "exec_scores": lambda r: portfolio.filter_execution_universe(r["scores"], r["calendar"], r["fit_exec"]),
    "weights": lambda r: portfolio.top_quantile_weights(r["exec_scores"]),
    "turnover": lambda r: portfolio.turnover(r["weights"]),
    "period_days": lambda r: portfolio.period_days(r["returns"], r["calendar"], END),
    "backtest": lambda r: _backtest(r, "weights"),
    "benchmark": _benchmark,
    "nav": lambda r: portfolio.nav(r["backtest"]),
    "performance": lambda r: portfolio.performance(r["backtest"], r["benchmark"], r["turnover"], YEAR),
    "neutral_weights": lambda r: portfolio.top_quantile_weights(r["executable"].withColumnRenamed("neutralized_score", "score")),
    "neutral_backtest": lambda r: _backtest(r, "neutral_weights"),
    "neutral_performance": lambda r: portfolio.performance(r["neutral_backtest"], r["benchmark"], portfolio.turnover(r["neutral_weights"]), YEAR),
    "comparison": lambda r: portfolio.compare_metrics(r["performance"], r["neutral_performance"]),
    "coverage": lambda r: portfolio.coverage(r["scores"], r["weights"]),
    "monthly": lambda r: portfolio.monthly_returns(r["backtest"]),
    "yearly": lambda r: portfolio.yearly_returns(r["backtest"]),
    "forward": lambda r: diagnostics.forward_returns(r["returns"], r["calendar"], END, None, r["suspend_d"]),
    "ic": lambda r: diagnostics.information_coefficients(r["scores"], r["forward"]),
    "ic_summary": lambda r: diagnostics.summarize_ic(r["ic"]),
    "deciles": lambda r: diagnostics.assign_layers(r["scores"]),
    "decile_returns": lambda r: diagnostics.decile_returns(r["deciles"], r["forward"]),
    "decile_summary": lambda r: diagnostics.summarize_deciles(r["decile_returns"]),
    "long_short": lambda r: diagnostics.long_short(r["decile_returns"]),
    "long_short_metrics": lambda r: diagnostics.periodic_metrics(r["long_short"]),
    "long_short_yearly": lambda r: diagnostics.yearly_period_returns(r["long_short"]),
    "size_exposure": lambda r: diagnostics.size_exposure(r["exec_scores"], r["weights"], r["exposure"]),
    "industry_exposure": lambda r: diagnostics.industry_exposure(r["exec_scores"], r["weights"], r["exposure"]),
    "exposure_summary": lambda r: diagnostics.exposure_summary(r["size_exposure"], r["industry_exposure"]),
    "executable": _executable_neutral,
    "neutral_ic": lambda r: diagnostics.information_coefficients(r["executable"], r["forward"], "neutralized_score"),
    "equal_composite": lambda r: composites.equal_composite(r["executable"], min_count=6),
    "naive_weights": lambda r: composites.rolling_weights(r["executable"], composites.naive_history(r["executable"], r["neutral_ic"])),
    "pit_weights": lambda r: composites.rolling_weights(r["executable"], composites.point_in_time_history(r["executable"], r["neutral_ic"], r["calendar"]), of_date=True),
    "rolling_composite": lambda r: composites.weighted_composite(r["executable"], r["pit_weights"], min_count=6),
    "grouped_composite": lambda r: composites.grouped_composite(r["executable"]),
    "composite_scores": lambda r: r["equal_composite"].unionByName(r["rolling_composite"]),
    "composite_coverage": lambda r: composites.composite_coverage(r["composite_scores"]),
    "layer_weights": lambda r: composites.layer_weights(r["composite_scores"]),
    "layer_daily": lambda r: _backtest(r, "layer_weights"),
    "layer_nav": lambda r: composites.layer_nav(r["layer_daily"]),
    "layer_profile": _layer_profile,
    "fold_frame": _fold_frame,
    "fold_dates": lambda r: walkforward.fold_dates(r["fold_frame"]),
    "ls_periods": lambda r: walkforward.long_short_periods(r["executable"].withColumnRenamed("neutralized_score", "score"), r["forward"], CONFIG),
    "candidates": lambda r: walkforward.candidates(r["neutral_ic"], r["ls_periods"], r["fold_frame"], CONFIG),
    "champions": _champions,
    "selection_log": lambda r: walkforward.selection_log(r["candidates"], r["champions"]),
    "oos_signals": lambda r: walkforward.oos_signals(r["fold_frame"], r["champions"]),
    "oos_inputs": lambda r: walkforward.oos_inputs(r["executable"], r["composite_scores"], r["oos_signals"]),
    "factor_weights": lambda r: walkforward.factor_weights(r["oos_signals"], r["pit_weights"], r["calendar"]),
    "composite_ic": lambda r: diagnostics.information_coefficients(r["composite_scores"], r["forward"]),
    "oos_ic": lambda r: walkforward.oos_coefficients(r["neutral_ic"], r["composite_ic"], r["oos_signals"]),
    "oos_daily": _oos_daily,
    "oos_duplicates": lambda r: walkforward.duplicate_oos_keys(r["oos_daily"]),
    "oos_metrics": lambda r: walkforward.oos_metrics(walkforward.require_unique_oos(r["oos_daily"]), r["oos_ic"], YEAR),
    "strategies": _strategies,
    "group_correlation": lambda r: marginal.group_correlation(r["executable"]),
    "strategy_ic": lambda r: diagnostics.information_coefficients(r["strategies"], r["forward"]),
    "strategy_ls": lambda r: diagnostics.long_short(r["strategy_deciles"]),
    "strategy_pair_turnover": lambda r: walkforward.bucket_turnover(r["strategies"]),
    "strategy_weights": lambda r: portfolio.top_quantile_weights(r["strategies"]),
    "strategy_turnover": lambda r: portfolio.turnover(r["strategy_weights"]),
    "strategy_daily": _top_daily,
    "strategy_monthly": lambda r: marginal.monthly_results(*_measured(r.late), r["calendar"], OOS_START, END),
    "strategy_metrics": lambda r: marginal.period_metrics(PERIODS, *_measured(r.late), r.late["strategies"], r["calendar"], YEAR),
    "contributions": lambda r: marginal.contributions(r["strategy_metrics"], experiments()),
    "monthly_contributions": lambda r: marginal.contributions(r["strategy_monthly"], experiments(), marginal.MONTHLY, "attribution_month", "factor"),
    "stability": lambda r: marginal.classify_stability(r["contributions"].filter("period not in ('2000', '2001')"), "FULL"),
    "grouped_improvement": lambda r: marginal.grouped_improvement(r["strategy_metrics"].filter("period in ('2000H1', '2000H2', '2001YTD')"), "grouped", "full"),
    "group_definition": lambda r: marginal.group_definition(r.spark),
    "coverage_diagnostics": lambda r: marginal.coverage_diagnostics(r["strategies"], _configured()),
    "strategy_deciles": lambda r: diagnostics.decile_returns(diagnostics.assign_layers(r["strategies"]), r["forward"]),
    "return_profile": lambda r: marginal.layer_profile(r["strategy_deciles"], OOS_START, r["calendar"]),
    "return_monotony": lambda r: marginal.layer_monotony(r["return_profile"]),
    "advantage": lambda r: marginal.monthly_advantage(r["strategy_monthly"], "grouped", "full"),
    "rolling_advantage": lambda r: marginal.rolling_advantage(r["advantage"], "d10_d1_delta", "attribution_month"),
    "paired_tests": lambda r: evidence.paired_tests(evidence.paired(r["advantage"])),
    "intervals_of_means": lambda r: evidence.bootstrap(evidence.paired(r["advantage"])),
    "annual_stability": lambda r: evidence.annual_stability(r["strategy_metrics"], "grouped", "full", YEARS),
    "gates": lambda r: evidence.gates(r["strategy_metrics"], r["annual_stability"], "FULL", "grouped", "full", YEARS),
    "quality": _quality,
    "decision": _decision,
    "reproduction": lambda r: evidence.reproduction(r["strategy_metrics"], _archived(r), ["period", "strategy_id"], marginal.METRICS),
    "naive_composite": lambda r: composites.weighted_composite(r["executable"], r["naive_weights"], "Composite_Naive", 6),
    "composite_layers": lambda r: diagnostics.assign_layers(r["composite_scores"], out="bucket"),
    "top_layer_weights": lambda r: r["layer_weights"].filter(split_layer_name("factor")[1] == CONFIG.buckets),
    "layer_turnover": lambda r: portfolio.turnover(r["layer_weights"]),
    "layer_metrics": lambda r: portfolio.performance(r["layer_daily"], r["benchmark"], r["layer_turnover"], YEAR),
    "layer_period_returns": lambda r: diagnostics.decile_returns(r["composite_layers"].withColumnRenamed("bucket", "decile"), r["forward"]),
    "layer_summary": lambda r: diagnostics.summarize_deciles(r["layer_period_returns"]),
    "composite_spread": lambda r: diagnostics.long_short(r["layer_period_returns"]),
    "composite_long_short": lambda r: diagnostics.periodic_metrics(r["composite_spread"]),
    "composite_ic_summary": lambda r: diagnostics.summarize_ic(r["composite_ic"]),
    "single_long_short": lambda r: diagnostics.periodic_metrics(diagnostics.long_short(diagnostics.decile_returns(diagnostics.assign_layers(r["executable"], score="neutralized_score"), r["forward"]))),
    "fine_returns": lambda r: views.adjusted_returns(r["fine_daily"]),
    "fine_fit": lambda r: r["fine_daily"].join(r["fine_days"], "trade_date").select("trade_date", "ts_code"),
    "fine_momentum": lambda r: factors.momentum(r["fine_fit"], r["fine_returns"], WARMUP, END),
    "fine_turnover": lambda r: factors.turnover_factor(r["fine_fit"], r["fine_daily"], WARMUP, END),
    "fine_volatility": lambda r: factors.volatility_factor(r["fine_fit"], r["fine_returns"], WARMUP, END),
}
