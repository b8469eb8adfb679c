"""The lake's layers, ingestion and checks."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from quantlake import config, specs
from quantlake.operators import views
from quantlake.sources import catalog, ingest, lake
from quantlake.specs import DATASETS, DatasetNotFoundError, dataset, group
from quantlake.streaming.upsert import follow_bronze

DAILY = DATASETS["daily"]


def daily(spark, *rows):
    return spark.createDataFrame(rows, "ts_code string, trade_date string, close double")


def closes(df) -> dict:
    return {(r["ts_code"], r["trade_date"]): r["close"] for r in df.collect()}


@pytest.fixture
def store(spark, tmp_path):
    return lake.Lake(spark, str(tmp_path / "lake"))


def test_upsert_keeps_the_newest(spark, store):
    store.upsert_silver(DAILY, daily(spark, ("A", "20240101", 10.0), ("B", "20240101", 5.0)), "b1", "2024-01-01T00:00:00Z")
    store.upsert_silver(DAILY, daily(spark, ("A", "20240101", 11.0)), "b2", "2024-01-02T00:00:00Z")
    assert closes(store.silver("daily")) == {("A", "20240101"): 11.0, ("B", "20240101"): 5.0}
    store.upsert_silver(DAILY, daily(spark, ("A", "20240101", 11.0)), "b2", "2024-01-02T00:00:00Z")
    assert store.silver("daily").count() == 2
    with pytest.raises(ValueError, match="key columns"):
        store.upsert_silver(DATASETS["adj_factor"], spark.createDataFrame([("A",)], "ts_code string"), "b", "t")


def test_many_batches_become_one_part(spark, store):
    for k in range(lake.PARTS + 3):
        store.upsert_silver(DAILY, daily(spark, ("A", "20240101", float(k)), (f"S{k}", "20240101", 1.0)), f"b{k:02d}", f"2024-01-01T00:00:{k:02d}Z")
    version, parts = store._parts("silver/daily")
    assert version == lake.PARTS + 3 and len(parts) < lake.PARTS
    got = closes(store.silver("daily"))
    assert len(got) == lake.PARTS + 4 and got["A", "20240101"] == lake.PARTS + 2
    files = [f for f in os.listdir(f"{store.root}/silver/daily") if f.startswith(("part-", "manifest-"))]
    assert len([f for f in files if f.startswith("manifest-")]) == lake.VERSIONS and not [f for f in os.listdir(f"{store.root}/silver/daily") if f.startswith("new-")]


def test_readers_of_the_old_version_and_writers_of_one_number(spark, store):
    store.upsert_silver(DAILY, daily(spark, ("A", "20240101", 1.0)), "b1", "2024-01-01T00:00:00Z")
    before = store.silver("daily")
    version, parts = store._parts("silver/daily")
    store._swap("silver/daily", daily(spark, ("A", "20240101", 2.0)))
    assert closes(before) == {("A", "20240101"): 1.0} and closes(store.silver("daily")) == {("A", "20240101"): 2.0}
    with pytest.raises(RuntimeError, match="another writer"):
        store._commit("silver/daily", version, parts)
    # A version that was written but never published is not seen.
    store._write("silver/daily", daily(spark, ("A", "20240101", 3.0)))
    assert closes(store.silver("daily")) == {("A", "20240101"): 2.0}


def test_current_code_wins_over_former(spark, store):
    store.upsert_silver(DAILY, daily(spark, ("300114.SZ", "20240101", 10.0), ("302132.SZ", "20240101", 11.0)), "b1", "2024-01-01T00:00:00Z")
    assert closes(store.silver("daily")) == {("302132.SZ", "20240101"): 11.0}


def test_consolidation_and_repair(spark, store):
    assert store.consolidate_bronze(DAILY) is None
    store.write_bronze(DAILY, daily(spark, ("A", "20240101", 10.0)), "b1", {}, "2024-01-01T00:00:00Z")
    store.write_bronze(DAILY, daily(spark, ("A", "20240101", 11.0), ("300114.SZ", "20240102", 1.0)), "b2", {}, "2024-01-02T00:00:00Z")
    assert store.consolidate_bronze(DAILY) == 2
    silver = store.silver("daily")
    assert closes(silver) == {("A", "20240101"): 11.0, ("302132.SZ", "20240102"): 1.0} and "_api_name" not in silver.columns
    store._swap("silver/moneyflow", spark.createDataFrame([("300114.SZ", "20240101", 1.0), ("302132.SZ", "20240101", 2.0)], "ts_code string, trade_date string, buy_lg_amount double"))
    assert store.repair_aliases([DAILY, DATASETS["moneyflow"], DATASETS["trade_cal"]]) == {"daily": (2, 2, 0), "moneyflow": (2, 1, 1)}


def test_validation(spark):
    ok = daily(spark, ("A", "20240101", 1.0))
    assert lake.validate(DAILY, ok) == ("passed", "rows: 1")
    assert lake.validate(DAILY, None)[0] == "missing"
    assert "missing key columns" in lake.validate(DAILY, ok.drop("ts_code"))[1]
    assert lake.validate(DAILY, ok.filter("false"))[1] == "empty table"
    assert "null or empty" in lake.validate(DAILY, daily(spark, ("", "20240101", 1.0)))[1]
    assert "duplicate" in lake.validate(DAILY, ok.union(ok))[1]
    assert "invalid dates" in lake.validate(DAILY, daily(spark, ("A", "2024-01-01", 1.0)))[1]
    assert "invalid dates" in lake.validate(DATASETS["trade_cal"].__class__("x", ("k",), "range", "market", "d"), spark.createDataFrame([("1", None)], "k string, d string"))[1]


def test_usability_finds_what_is_missing(spark):
    d = daily(spark, ("A", "20240102", 1.0), ("B", "20240104", 1.0), ("300114.SZ", "20240104", 1.0))
    adj = spark.createDataFrame([("A", "20240102"), ("300114.SZ", "20240104")], "ts_code string, trade_date string")
    basic = spark.createDataFrame([("A",), ("B",)], "ts_code string")
    cal = spark.createDataFrame([("20240101", 1), ("20240103", 1), ("20240104", 1), ("20240105", 1)], "cal_date string, is_open int")
    got = {r["check_name"]: (r["failures"], r["status"]) for r in lake.usability(d, adj, basic, cal, d).collect()}
    assert got == {
        "cross:daily_adj_factor": (1, "failed"), "cross:daily_stock_basic": (1, "failed"), "cross:canonical_security_codes": (1, "failed"),
        "cross:daily_trade_calendar": (1, "failed"), "view:v_adjusted_daily_row_count": (0, "passed"),
    }


def test_listed_flags(spark):
    rows = spark.createDataFrame([(c, "20240102") for c in "ABCD"], "ts_code string, trade_date string")
    basic = spark.createDataFrame([("A", "One", "20240103", None), ("B", "ST Two", None, None), ("C", "Three", "20230101", "20240101")], "ts_code string, name string, list_date string, delist_date string")
    got = {r["ts_code"]: (r["is_listed_on_date"], r["is_st_name"]) for r in views.stock_universe_daily(rows, basic, None).collect()}
    assert got == {"A": (False, False), "B": (True, True), "C": (False, False), "D": (False, False)}


def test_catalog(spark, store):
    c = catalog.Catalog(store)
    c.init()
    assert {r["dataset"] for r in c.table("dataset_catalog").collect()} == set(DATASETS)
    results = {n: (s, t) for n, s, t in c.validate_all()}
    assert results["daily"][0] == "missing" and results["view:v_adjusted_daily"] == ("passed", "queryable rows=0") and results["cross:daily_adj_factor"][0] == "missing"
    store.upsert_silver(DAILY, spark.createDataFrame([("A", "20210104", 10.0, 11.0, 9.0, 10.0), ("A", "20210105", 12.0, 13.0, 11.0, 12.0)], "ts_code string, trade_date string, open double, high double, low double, close double"), "b1", "t1")
    store.upsert_silver(DATASETS["adj_factor"], spark.createDataFrame([("A", "20210104", 2.0), ("A", "20210105", 4.0)], "ts_code string, trade_date string, adj_factor double"), "b2", "t1")
    store.upsert_silver(DATASETS["stock_basic"], spark.createDataFrame([("A", "Name", "19910403")], "ts_code string, name string, list_date string"), "b3", "t1")
    store.upsert_silver(DATASETS["trade_cal"], spark.createDataFrame([("SSE", "20210104", 1), ("SSE", "20210105", 1)], "exchange string, cal_date string, is_open int"), "b4", "t1")
    results = {n: (s, t) for n, s, t in c.validate_all()}
    assert all(results[x][0] == "passed" for x in ("daily", "cross:daily_adj_factor", "cross:daily_trade_calendar", "view:v_stock_universe_daily", "view:v_adjusted_daily_row_count"))
    rows = c.sql("select trade_date, close_hfq, close_qfq, high_hfq, pre_close from v_adjusted_daily where ts_code = :code order by trade_date", code="A").collect()
    assert [tuple(r) for r in rows] == [("20210104", 20.0, 5.0, 22.0, None), ("20210105", 48.0, 12.0, 52.0, None)]
    assert [r["return_adjusted"] for r in spark.table("v_adjusted_returns").orderBy("trade_date").collect()] == [None, pytest.approx(1.4)]
    assert tuple(spark.sql("select name, delist_date, market, is_listed_on_date from v_stock_universe_daily limit 1").first()) == ("Name", None, None, True)
    assert {r["dataset"] for r in spark.table("v_daily_market").collect()} == {"daily", "adj_factor"} and spark.table("v_income_asof_intervals").count() == 0
    history = c.table("data_quality")
    assert history.filter("dataset = 'daily'").count() == 2 and catalog.latest_quality(history).filter("dataset = 'daily'").first()["status"] == "passed"
    store._swap("catalog/dataset_catalog", c.table("dataset_catalog").drop("fields_json").withColumn("dataset", F.regexp_replace("dataset", "^top_list$", "gone")))
    c.init()
    assert {r["dataset"] for r in c.table("dataset_catalog").collect()} == set(DATASETS) and "fields_json" in store.table("catalog/dataset_catalog").columns


class Fake:
    def __init__(self, rows: int = 1, fail: bool = False) -> None:
        self.calls, self.rows, self.fail = [], rows, fail

    def fetch(self, api_name, params, fields):
        self.calls.append((api_name, dict(params)))
        if self.fail:
            raise RuntimeError("no answer")
        n = min(params.get("limit", self.rows), self.rows - params.get("offset", 0))
        return [{"ts_code": f"S{params.get('offset', 0) + i}", "trade_date": params.get("trade_date", "20240101"), "close": 1.0} for i in range(n)]


def test_fetch_strategies():
    fake = Fake(3001)
    assert len(ingest.fetch(fake, DATASETS["namechange"])) == 3001 and [c[1]["offset"] for c in fake.calls] == [0, 3000]
    assert [p["ann_date"] for p in ingest.requests(DATASETS["dividend"], "20240101", "20240103")] == ["20240101", "20240102", "20240103"]
    assert ingest.requests(DAILY, "20240101", "20240102") == [{"start_date": "20240101", "end_date": "20240102"}]
    assert len(ingest.requests(DATASETS["stock_basic"], None, None)) == 3


def test_requests_of_the_registry():
    assert [p["ts_code"] for p in ingest.requests(DATASETS["index_daily"], "20240101", "20240102")] == list(specs.INDEX_CODES)
    assert len(ingest.requests(DATASETS["index_weight"], "20240101", "20240102")) == 4
    assert ingest.requests(DATASETS["trade_cal"], "20240101", "20240102") == [{"exchange": "SSE", "start_date": "20240101", "end_date": "20240102"}]
    assert "delist_date" in DATASETS["stock_basic"].fields and [p["market"] for p in ingest.requests(DATASETS["index_basic"], None, None)][0] == "SSE"


def test_sync_records_success_and_failure(spark, store):
    c = catalog.Catalog(store)
    assert ingest.Sync(spark, store, Fake(2)).dataset(DAILY, "20240101", "20240101") == 2
    assert store.silver("daily").count() == 2 and store.bronze("daily").count() == 2
    first = c.table("sync_status").first()
    assert (first["status"], first["row_count"], first["last_end_date"]) == ("success", 2, "20240101")
    with pytest.raises(RuntimeError):
        ingest.Sync(spark, store, Fake(fail=True)).dataset(DAILY)
    row = c.table("sync_status").first()
    assert row["status"] == "failed" and row["last_success_at"] == first["last_success_at"] and row["last_end_date"] == "20240101"
    ingest.Sync(spark, store, Fake(3)).dataset(DAILY, "20240102", "20240102")
    row = c.table("sync_status").first()
    assert (row["status"], row["row_count"]) == ("success", 3)
    batches = {r["batch_id"]: r for r in c.table("sync_batches").collect()}
    assert sorted((r["status"], r["error_message"]) for r in batches.values()) == [("failed", "no answer"), ("success", None), ("success", None)]
    assert batches[row["last_batch_id"]]["status"] == "success" and all(r["finished_at"] for r in batches.values())
    assert ingest.Sync(spark, store, Fake(0)).dataset(DATASETS["adj_factor"]) == 0 and store.silver("adj_factor") is None


def test_a_vendor_with_a_token(monkeypatch):
    tokens = []

    def connect(token):
        tokens.append(token)
        return lambda api, params, fields: [{"api": api}] if params else None

    vendor = ingest.Vendor(connect, "QUANTLAKE_TEST_TOKEN")
    monkeypatch.delenv("QUANTLAKE_TEST_TOKEN", raising=False)
    with pytest.raises(RuntimeError, match="QUANTLAKE_TEST_TOKEN"):
        vendor.fetch("daily", {}, ())
    monkeypatch.setenv("QUANTLAKE_TEST_TOKEN", "secret")
    assert vendor.fetch("daily", {}, ()) == [] and vendor.fetch("daily", {"a": 1}, ("x",)) == [{"api": "daily"}] and tokens == ["secret"]


def test_settings(tmp_path):
    assert config.load().default_start_date == "2015-01-01"
    at = tmp_path / "settings.json"
    at.write_text('{"data_root": "lake", "source": {"max_retries": 5}, "datasets": {"daily": false}, "walk_forward": {"oos_periods": 3, "step_periods": 3}}')
    got = config.load(at)
    assert got.data_root == str(tmp_path / "lake") and got.source.max_retries == 5 and got.datasets == {"daily": False} and got.walk_forward.oos_periods == 3
    at.write_text('{"no_such_setting": 1}')
    with pytest.raises(ValueError, match="no_such_setting"):
        config.load(at)


def test_retries():
    class Shaky:
        left = 2

        def fetch(self, *_):
            self.left -= 1
            if self.left >= 0:
                raise OSError
            return None

    waits: list[float] = []
    assert ingest.Retrying(Shaky(), sleep=waits.append).fetch("x", {}, ()) == [] and waits == [0.25, 2.0, 0.25, 4.0, 0.25]


def test_planner_and_checkpoint(tmp_path):
    chunks = ingest.plan_chunks([DAILY, DATASETS["suspend_d"], DAILY, DATASETS["stock_basic"]], "20240101", "20240109", {"20240102"})
    assert [c.key for c in chunks] == ["daily:20240102:20240102", "suspend_d:20240101:20240107", "suspend_d:20240108:20240109", "stock_basic::"]
    at, events = tmp_path / "done.json", []

    def work(chunk):
        if chunk.dataset == "suspend_d" and chunk.start == "20240101":
            raise OSError("down")
        return 1

    assert ingest.run_chunks(chunks, work, at, log=events.append) == {"done": 3, "skipped": 0, "failed": 1}
    assert ingest.run_chunks(chunks, lambda _: 1, at) == {"done": 1, "skipped": 3, "failed": 0}
    assert [e["status"] for e in events] == ["done", "failed", "done", "done"]


def test_registry():
    assert len(DATASETS) == 23 and len(group("all")) == 23 and dataset("daily") is DAILY
    with pytest.raises(DatasetNotFoundError):
        dataset("nothing")


def test_bronze_as_a_stream(spark, store, tmp_path):
    for n, close in (("b1", 1.0), ("b2", 2.0)):
        store.write_bronze(DAILY, daily(spark, ("A", "20240101", close)), n, {}, f"2024-01-0{n[1]}T00:00:00Z")
        follow_bronze(store, DAILY, str(tmp_path / "checkpoint")).awaitTermination()
    assert closes(store.silver("daily")) == {("A", "20240101"): 2.0}


def test_batches_that_waited_together(spark, store, tmp_path):
    order = [3, 1, 5, 0, 4, 2]
    for n in order:
        store.write_bronze(DAILY, daily(spark, ("A", "20240101", float(n)), (f"S{n}", "20240101", 0.0)), f"b{n}", {}, f"2024-01-0{n + 1}T00:00:00Z")
    follow_bronze(store, DAILY, str(tmp_path / "checkpoint")).awaitTermination()
    got = closes(store.silver("daily"))
    assert got["A", "20240101"] == 5.0 and len(got) == 7
    # A batch that is older than what silver has does not win.
    store.write_bronze(DAILY, daily(spark, ("A", "20240101", -1.0)), "late", {}, "2023-01-01T00:00:00Z")
    follow_bronze(store, DAILY, str(tmp_path / "checkpoint")).awaitTermination()
    assert closes(store.silver("daily"))["A", "20240101"] == 5.0
