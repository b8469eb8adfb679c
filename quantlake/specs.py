"""Registries and settings: datasets, factors, protocols.  Fixed values stand as they are to be used."""

from __future__ import annotations

import math
from dataclasses import dataclass, field


class DatasetNotFoundError(KeyError):
    """No dataset or group of that name."""


@dataclass(frozen=True)
class DatasetSpec:
    name: str
    primary_key: tuple[str, ...]
    fetch: str
    group: str
    date_field: str | None = None
    chunk_days: int | None = None
    api_name: str | None = None
    default_params: dict = field(default_factory=dict)
    param_sets: tuple[dict, ...] = ()
    fields: tuple[str, ...] = ()

    @property
    def source(self) -> str:
        return self.api_name or self.name


_CODE_DATE = ("ts_code", "trade_date")
_STATEMENT = ("ts_code", "ann_date", "f_ann_date", "end_date", "report_type", "comp_type", "end_type", "update_flag")
_HOLDER = ("ts_code", "ann_date", "end_date", "holder_name")

#: What the datasets are asked for.
STOCK_FIELDS = ("ts_code", "symbol", "name", "area", "industry", "market", "exchange", "list_status", "list_date", "delist_date", "is_hs", "act_name", "act_ent_type")
LIST_STATUSES = ("L", "D", "P")
INDEX_MARKETS = ("SSE", "SZSE", "CSI", "CICC", "SW", "OTH")
INDEX_CODES = ("000001.SH", "399001.SZ", "399006.SZ", "000300.SH", "000905.SH", "000852.SH", "000985.CSI")
WEIGHTED_INDEX_CODES = ("000300.SH", "000905.SH", "000852.SH", "000985.CSI")
INDUSTRY_LEVELS = ("L1", "L2", "L3")


def _sets(name: str, values: tuple[str, ...], **more: str) -> tuple[dict, ...]:
    """One set of parameters for each value."""
    return tuple({name: v} | more for v in values)


#: Keys, fetch strategies and chunk sizes of the datasets.
DATASETS: dict[str, DatasetSpec] = {
    d.name: d
    for d in (
        DatasetSpec("stock_basic", ("ts_code",), "param_sets", "static", param_sets=_sets("list_status", LIST_STATUSES), fields=STOCK_FIELDS),
        DatasetSpec("trade_cal", ("exchange", "cal_date"), "range", "market", "cal_date", 366, default_params={"exchange": "SSE"}),
        DatasetSpec("namechange", ("ts_code", "name", "start_date", "end_date", "ann_date", "change_reason"), "paged", "static"),
        DatasetSpec("stock_company", ("ts_code",), "static", "static"),
        DatasetSpec("daily", _CODE_DATE, "range", "market", "trade_date", 1),
        DatasetSpec("daily_basic", _CODE_DATE, "range", "market", "trade_date", 1),
        DatasetSpec("adj_factor", _CODE_DATE, "range", "market", "trade_date", 1),
        DatasetSpec("suspend_d", _CODE_DATE, "range", "market", "trade_date", 7),
        DatasetSpec("stk_limit", _CODE_DATE, "range", "market", "trade_date", 1),
        DatasetSpec("income_vip", _STATEMENT, "paged_range", "finance", "ann_date", 31),
        DatasetSpec("balancesheet_vip", _STATEMENT, "paged_range", "finance", "ann_date", 31),
        DatasetSpec("cashflow_vip", _STATEMENT, "paged_range", "finance", "ann_date", 31),
        DatasetSpec("fina_indicator_vip", ("ts_code", "ann_date", "end_date", "update_flag"), "paged_range", "finance", "ann_date", 31),
        DatasetSpec("dividend", ("ts_code", "ann_date", "end_date", "div_proc"), "daily", "corporate", "ann_date", 1),
        DatasetSpec("top10_holders", _HOLDER, "paged_range", "corporate", "ann_date", 31),
        DatasetSpec("top10_floatholders", _HOLDER, "paged_range", "corporate", "ann_date", 31),
        DatasetSpec("moneyflow", _CODE_DATE, "range", "market", "trade_date", 1),
        DatasetSpec("top_list", ("trade_date", "_row_no"), "daily", "trading", "trade_date", 1),
        DatasetSpec("index_basic", ("ts_code",), "param_sets", "static", param_sets=_sets("market", INDEX_MARKETS)),
        DatasetSpec("index_daily", _CODE_DATE, "param_sets_range", "market", "trade_date", 366, param_sets=_sets("ts_code", INDEX_CODES)),
        DatasetSpec("index_weight", ("index_code", "con_code", "trade_date"), "param_sets_range", "benchmark", "trade_date", 31, param_sets=_sets("index_code", WEIGHTED_INDEX_CODES)),
        DatasetSpec("index_classify", ("index_code", "industry_name", "level", "src"), "param_sets", "industry", param_sets=_sets("level", INDUSTRY_LEVELS, src="SW2021")),
        DatasetSpec("index_member_all", ("ts_code", "l1_code", "l2_code", "l3_code", "in_date", "out_date"), "paged", "industry"),
    )
}
GROUPS = ("static", "market", "finance", "corporate", "trading", "benchmark", "industry")
#: Fetched on open days only.
TRADING_DAY_DATASETS = frozenset({"daily", "daily_basic", "adj_factor", "stk_limit", "moneyflow", "top_list"})
#: Key columns that may be null.
NULLABLE_KEYS = {
    "namechange": frozenset({"end_date", "ann_date"}),
    "income_vip": frozenset({"end_type"}),
    "balancesheet_vip": frozenset({"end_type"}),
    "cashflow_vip": frozenset({"end_type"}),
    "index_member_all": frozenset({"out_date"}),
}
#: Former security codes and the codes that replaced them.
CODE_ALIASES = {"000022.SZ": "001872.SZ", "000043.SZ": "001914.SZ", "300114.SZ": "302132.SZ"}

#: Names of checks between tables, of views, and of the datasets that each view unites.
CROSS_CHECKS = ("cross:daily_adj_factor", "cross:daily_stock_basic", "cross:canonical_security_codes", "cross:daily_trade_calendar", "view:v_adjusted_daily_row_count")
UNION_VIEWS = {
    "v_stock_master": ("stock_basic", "namechange", "stock_company"),
    "v_daily_market": ("daily", "daily_basic", "adj_factor", "suspend_d", "stk_limit", "moneyflow"),
    "v_financial_reports": ("income_vip", "balancesheet_vip", "cashflow_vip", "fina_indicator_vip"),
    "v_corporate_actions": ("dividend", "top10_holders", "top10_floatholders"),
    "v_index_data": ("index_basic", "index_daily", "index_weight"),
    "v_industry_data": ("index_classify", "index_member_all"),
}
INTERVAL_VIEWS = {
    "v_fina_indicator_asof_intervals": "fina_indicator_vip",
    "v_income_asof_intervals": "income_vip",
    "v_balancesheet_asof_intervals": "balancesheet_vip",
    "v_cashflow_asof_intervals": "cashflow_vip",
}
DAILY_COLUMNS = ("open", "high", "low", "close", "pre_close", "change", "pct_chg", "vol", "amount")
PRICES = ("open", "high", "low", "close")
STOCK_COLUMNS = ("name", "market", "exchange", "industry", "list_status", "list_date", "delist_date", "is_hs")


def dataset(name: str) -> DatasetSpec:
    if name not in DATASETS:
        raise DatasetNotFoundError(name)
    return DATASETS[name]


def group(name: str) -> list[DatasetSpec]:
    if name == "all":
        return list(DATASETS.values())
    if name not in GROUPS:
        raise DatasetNotFoundError(name)
    return [d for d in DATASETS.values() if d.group == name]


@dataclass(frozen=True)
class FactorSpec:
    name: str
    direction: int
    group: str


#: Factors, their directions and their economic groups.
FACTORS = (
    FactorSpec("ROE", 1, "Quality"),
    FactorSpec("PE_TTM", -1, "Value"),
    FactorSpec("Revenue_Growth", 1, "Growth"),
    FactorSpec("Momentum_60D", 1, "Momentum"),
    FactorSpec("Turnover_20D", 1, "Liquidity"),
    FactorSpec("Debt_to_Equity", -1, "Quality"),
    FactorSpec("Volatility", -1, "LowVol"),
    FactorSpec("Main_Net_In", 1, "FundFlow"),
    FactorSpec("Dividend_Yield", 1, "Value"),
    FactorSpec("Holder_Concen", 1, "Ownership"),
    FactorSpec("Gross_Margin", 1, "Quality"),
)
#: Names of composites and out-of-sample strategies, and codes of reasons.
COMPOSITE_EQUAL = "Composite_Equal"
COMPOSITE_ROLLING = "Composite_RollingRankIC"
CHAMPION = "Champion_SingleFactor"
BENCHMARK = "Benchmark_000985_CSI"
BENCHMARK_CODE = "000985.CSI"
NO_CANDIDATE, FIRST, LOST, STAYS, BEATEN, KEPT, NOT_SELECTED = (
    "no_eligible_factor",
    "initial_champion",
    "incumbent_ineligible",
    "incumbent_remains_best",
    "challenger_margin_met",
    "incumbent_retained_by_margin",
    "not_selected",
)
FIXED_POOL = ("PE_TTM", "Dividend_Yield", "Volatility", "Main_Net_In")


#: The paired metrics, (difference by month, metric of a period), and the labels of a decision.
PRIMARY = {"d10_d1": ("d10_d1_delta", "d10_d1_annual_return"), "top20_excess": ("top20_excess_delta", "top20_excess_annual_return")}
LABELS = {"insufficient": "数据不足，无法判定", "replace": "可替换/挑战者更好", "keep": "继续作为挑战者", "worse": "不优于基准"}
BOOTSTRAP_SEED, BOOTSTRAP_REPETITIONS, BOOTSTRAP_BLOCK = 20260722, 10_000, 6


@dataclass(frozen=True)
class WalkForward:
    train_periods: int = 24
    validation_periods: int = 12
    oos_periods: int = 6
    step_periods: int = 6
    min_train_rankic: int = 18
    min_validation_returns: int = 9
    switch_margin: float = 0.10
    top_quantile: float = 0.20
    buckets: int = 10
    cost: float = 0.001

    def validate(self) -> None:
        if min(self.train_periods, self.validation_periods, self.oos_periods) < 1:
            raise ValueError("train, validation and out-of-sample periods must be positive")
        if self.step_periods < self.oos_periods:
            raise ValueError("a step shorter than the out-of-sample span would make folds overlap")
        if not 0 < self.top_quantile <= 1 or self.buckets < 2:
            raise ValueError("top_quantile must be in (0, 1], buckets at least 2")
        if self.cost < 0 or self.switch_margin < 0:
            raise ValueError("cost and switch margin cannot be negative")


@dataclass(frozen=True)
class Strategy:
    family: str
    strategy_id: str
    factors: tuple[str, ...]
    min_count: int
    factor_id: str | None = None
    baseline_id: str | None = None


def minimum_component_count(n: int) -> int:
    return max(1, math.ceil(n * 6 / 11))


def experiments(factors: tuple[str, ...] = tuple(f.name for f in FACTORS), fixed: tuple[str, ...] = FIXED_POOL) -> list[Strategy]:
    """The full set, each leave-one-out, the fixed pool, and each add-one-back to it."""
    full = Strategy("full", "full", factors, minimum_component_count(len(factors)))
    out = [full]
    for f in factors:
        rest = tuple(x for x in factors if x != f)
        out.append(Strategy("leave_one_out", f"loo_{f}", rest, minimum_component_count(len(rest)), f, "full"))
    out.append(Strategy("fixed", "fixed", fixed, minimum_component_count(len(fixed))))
    for f in factors:
        if f not in fixed:
            more = (*fixed, f)
            out.append(Strategy("add_one_back", f"aob_{f}", more, minimum_component_count(len(more)), f, "fixed"))
    return out


def check_protocol(factors: tuple[FactorSpec, ...] = FACTORS) -> None:
    """Refuse factors, groups or thresholds other than those that results were made with: eleven factors in eight groups."""
    groups = {g: tuple(sorted(f.name for f in factors if f.group == g)) for g in {f.group for f in factors}}
    frozen = {g: tuple(sorted(f.name for f in FACTORS if f.group == g)) for g in {f.group for f in FACTORS}}
    if (len(factors), len(groups)) != (11, 8) or groups != frozen:
        raise ValueError("the definition of eleven factors in eight groups has changed")
    if (minimum_component_count(11), minimum_component_count(8)) != (6, 5):
        raise ValueError("the coverage thresholds 6 of 11 and 5 of 8 have changed")
