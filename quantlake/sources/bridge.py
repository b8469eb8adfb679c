"""The driver's tables in the shape of the domain: suppliers stand for securities, weeks for trading days.

Each relation is one statement in the common ground of Spark SQL and DuckDB, so that queries and their oracles start from
equal rows.  A price is 100 and a thousandth of the mean unit price, so that weekly returns are those of a security.  ``ymd`` is the only function spelled differently.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

CODE = "concat('S', lpad(cast({} as string), 6, '0'), '.SZ')"
KEY = "cast(substr(ts_code, 2, 6) as int)"

RELATIONS: dict[str, str] = {
    "daily": f"""
        select {CODE.format("l_suppkey")} as ts_code, ymd(date_trunc('week', l_shipdate)) as trade_date,
               floor((1e2 + floor(sum(l_extendedprice) * 1e2 + 0.5e0) / 1e2 / sum(l_quantity) / 1e3) * 1e6 + 0.5e0) / 1e6 as close,
               sum(l_quantity) as vol, floor(sum(l_extendedprice) * 1e2 + 0.5e0) / 1e2 as amount
        from lineitem group by 1, 2""",
    "trade_dates": """
        select trade_date, cast(row_number() over (order by trade_date) as int) - 1 as week_no
        from (select distinct trade_date from daily) d""",
    "adj_factor": f"""
        select ts_code, d.trade_date, 1e0 + 1e-2 * (cast(substr(d.trade_date, 1, 4) as int) - 1995) as adj_factor
        from daily d join trade_dates t on d.trade_date = t.trade_date where ({KEY} + week_no) % 17 <> 0""",
    "stock_basic": f"""
        select c.ts_code, case when s_suppkey % 20 = 0 then concat(s_name, 'ST') else s_name end as name, list_date,
               case when s_suppkey % 33 = 0 then '20000103' end as delist_date
        from (select *, {CODE.format("s_suppkey")} as ts_code from supplier) c
        join (select ts_code, min(trade_date) as list_date from daily group by 1) f on c.ts_code = f.ts_code
        where s_suppkey % 29 <> 0""",
    "suspend_d": f"""
        select s.ts_code, s.trade_date
        from (select ts_code, trade_date, week_no from (select distinct ts_code from daily) c cross join trade_dates) s
        left join daily d on s.ts_code = d.ts_code and s.trade_date = d.trade_date
        where d.ts_code is null and (cast(substr(s.ts_code, 2, 6) as int) * 7 + week_no) % 3 = 0""",
    "daily_basic": f"""
        select w.ts_code, w.trade_date, case when n % 5 = 0 then null else dv end as dv_ttm, pe as pe_ttm,
               floor((vol % 97 + 1) / 10 * 1e4 + 0.5e0) / 1e4 as turnover_rate_f,
               floor(s_acctbal * close / 1e3 * 1e4 + 0.5e0) / 1e4 as total_mv
        from (select {CODE.format("l_suppkey")} as ts_code, l_suppkey, ymd(date_trunc('week', l_shipdate)) as trade_date, count(*) as n,
                     floor(avg(l_tax) * 1e2 * 1e6 + 0.5e0) / 1e6 as dv, floor((avg(l_discount) * 1e3 - 20e0) * 1e6 + 0.5e0) / 1e6 as pe
              from lineitem group by 1, 2, 3) w
        join daily d on w.ts_code = d.ts_code and w.trade_date = d.trade_date
        join supplier s on s.s_suppkey = w.l_suppkey""",
    "fina_indicator": f"""
        select {CODE.format("l_suppkey")} as ts_code, ymd(quarter_end) as end_date, ymd(l_shipdate) as ann_date,
               ymd(l_shipdate) as _ingested_at,
               floor(avg(l_discount) * 1e2 * 1e6 + 0.5e0) / 1e6 as roe,
               case when count(*) % 3 = 0 then null else floor(avg(l_tax) * 1e2 * 1e6 + 0.5e0) / 1e6 end as tr_yoy,
               floor(avg(l_extendedprice) / 1e2 * 1e6 + 0.5e0) / 1e6 as debt_to_eqt,
               floor(avg(l_quantity) * 1e6 + 0.5e0) / 1e6 as grossprofit_margin
        from (select l.*, date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as quarter_end
              from lineitem l join orders o on l.l_orderkey = o.o_orderkey) x
        where l_shipdate >= quarter_end group by 1, 2, 3, 4""",
    "top10_holders": f"""
        select {CODE.format("l_suppkey")} as ts_code, ymd(quarter_end) as end_date, ymd(l_shipdate) as ann_date,
               cast(o_custkey as string) as holder_name, floor(sum(l_extendedprice) / 1e4 * 1e6 + 0.5e0) / 1e6 as hold_ratio
        from (select l.*, o_custkey, date_trunc('quarter', o_orderdate) + interval 3 month - interval 1 day as quarter_end
              from lineitem l join orders o on l.l_orderkey = o.o_orderkey) x
        where l_shipdate >= quarter_end group by 1, 2, 3, 4""",
    "moneyflow": f"""
        select {CODE.format("l_suppkey")} as ts_code, ymd(date_trunc('week', l_shipdate)) as trade_date,
               floor(sum(case when l_returnflag = 'A' and l_linestatus = 'O' then l_extendedprice end) * 1e2 + 0.5e0) / 1e2 as buy_lg_amount,
               floor(sum(case when l_returnflag = 'N' and l_linestatus = 'O' then l_extendedprice end) * 1e2 + 0.5e0) / 1e2 as buy_elg_amount,
               floor(sum(case when l_returnflag = 'R' and l_linestatus = 'F' then l_extendedprice end) * 1e2 + 0.5e0) / 1e2 as sell_lg_amount,
               floor(sum(case when l_returnflag = 'N' and l_linestatus = 'F' then l_extendedprice end) * 1e2 + 0.5e0) / 1e2 as sell_elg_amount
        from lineitem group by 1, 2""",
    "index_member": f"""
        select {CODE.format("s_suppkey")} as ts_code, r_name as l1_name, '19950101' as in_date, '19980101' as out_date
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey % 13 <> 0
        union all
        select {CODE.format("s_suppkey")}, case when s_suppkey % 2 = 0 then r_name else 'OTHER' end, '19980101', null
        from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_suppkey % 13 <> 0""",
    "index_daily": """
        select '000985.CSI' as ts_code, ymd(date_trunc('week', l_shipdate)) as trade_date,
               floor((1e2 + floor(sum(l_extendedprice) * 1e2 + 0.5e0) / 1e2 / sum(l_quantity) / 1e3) * 1e6 + 0.5e0) / 1e6 as close
        from lineitem group by 1, 2""",
    # Days as they are, for factors over their own numbers of rows.
    "fine_daily": f"""
        select {CODE.format("l_suppkey")} as ts_code, ymd(l_shipdate) as trade_date,
               floor((1e2 + floor(sum(l_extendedprice) * 1e2 + 0.5e0) / 1e2 / sum(l_quantity) / 1e3) * 1e6 + 0.5e0) / 1e6 as close_hfq,
               floor((sum(l_quantity) % 97 + 1) / 10 * 1e4 + 0.5e0) / 1e4 as turnover_rate_f
        from lineitem group by 1, 2""",
    "fine_days": """
        select max(trade_date) as trade_date from fine_daily group by substr(trade_date, 1, 6)""",
    "trade_cal": """
        select 'SSE' as exchange, ymd(d) as cal_date, case when dow in (1, 7) then 0 else 1 end as is_open
        from (select distinct date_trunc('day', l_shipdate) as d, weekday_no(l_shipdate) as dow from lineitem) x""",
}

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
_SPARK = {"ymd": "date_format({}, 'yyyyMMdd')", "weekday_no": "dayofweek({})"}
_DUCK = {"ymd": "strftime({}, '%Y%m%d')", "weekday_no": "(dayofweek({}) + 1)"}


def _spelled(sql: str, forms: dict[str, str]) -> str:
    for name, form in forms.items():
        while m := re.search(rf"\b{name}\(", sql):
            depth, at = 1, m.end()
            while depth:
                depth += {"(": 1, ")": -1}.get(sql[at], 0)
                at += 1
            sql = sql[: m.start()] + form.format(sql[m.end() : at - 1]) + sql[at:]
    return sql


def duckdb_sql(name: str) -> str:
    return _spelled(RELATIONS[name], _DUCK)


class Bridge:
    """Domain relations over a folder of the driver's tables, each worked out once for a session and kept lazy."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.dir, self.known = spark, sf_dir, {}
        #: What becomes of a relation once it is worked out, by name: kept lazy, or written by whoever shares it.
        self.keep = lambda _, df: df

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self.known:
            if name in RELATIONS:
                sql = _spelled(RELATIONS[name], _SPARK)
                used = [x for x in (*RELATIONS, *TABLES) if x != name and re.search(rf"\b(?:from|join) {x}\b", sql)]
                for x in used:
                    sql = re.sub(rf"\b(from|join) {x}\b", rf"\1 {{{x}}}", sql)
                self.known[name] = self.keep(name, self.spark.sql(sql, **{x: self[x] for x in used}))
            else:
                self.known[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self.known[name]
