"""The catalog of a lake: datasets, batches, status and quality as tables, and views over silver."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import UTC, datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quantlake.operators import views
from quantlake.sources.lake import Lake, upsert, usability, validate
from quantlake.specs import CROSS_CHECKS, DAILY_COLUMNS, DATASETS, INTERVAL_VIEWS, PRICES, STOCK_COLUMNS, UNION_VIEWS, DatasetSpec

#: Columns of the catalog's tables.
TABLES = {
    "dataset_catalog": "dataset string, api_name string, layer string, primary_key_json string, strategy string, date_field string, group_name string, default_chunk_days bigint, fields_json string, updated_at string",
    "sync_batches": "batch_id string, dataset string, api_name string, params_json string, status string, row_count bigint, started_at string, finished_at string, error_message string",
    "sync_status": "dataset string, last_success_at string, last_batch_id string, last_start_date string, last_end_date string, row_count bigint, status string",
    "data_quality": "check_id string, dataset string, check_name string, status string, detail string, checked_at string",
}
DATABASE = "__database__"


def now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")


def latest_quality(checks: DataFrame) -> DataFrame:
    """The newest row of each check of each dataset."""
    place = F.row_number().over(Window.partitionBy("dataset", "check_name").orderBy(F.desc("checked_at"), F.desc("check_id")))
    return checks.withColumn("_k", place).filter("_k = 1").drop("_k")


def refreshed(old: DataFrame, current: DataFrame) -> DataFrame:
    """The dataset catalog: rows of datasets that are no more go, the others are as they are now."""
    return upsert(old.join(current.select("dataset"), "dataset", "left_semi").select(*old.columns), current, ["dataset"])


def finished(batches: DataFrame, batch: str, status: str, rows: int, at: str, error: str | None) -> DataFrame:
    """The batches with the outcome of one."""
    own = F.col("batch_id") == batch
    values = {"status": F.lit(status), "row_count": F.lit(rows).cast("long"), "finished_at": F.lit(at), "error_message": F.lit(error).cast("string")}
    return batches.withColumns({c: F.when(own, v).otherwise(F.col(c)) for c, v in values.items()})


def status_of_known(status: DataFrame, catalog: DataFrame) -> DataFrame:
    """Status of the datasets that the catalog has."""
    return status.join(catalog.select("dataset"), "dataset")


class Catalog:
    def __init__(self, lake: Lake) -> None:
        self.lake, self.spark = lake, lake.spark

    def _frame(self, name: str, rows: list[tuple]) -> DataFrame:
        return self.spark.createDataFrame(rows, TABLES[name])

    def table(self, name: str) -> DataFrame:
        """A table of the catalog with all its columns, whether or not it has been written."""
        df = self.lake.table(f"catalog/{name}")
        if df is None:
            return self._frame(name, [])
        kinds = self._frame(name, []).schema
        return df.select(*(F.col(f.name).cast(f.dataType) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in kinds))

    def _put(self, name: str, df: DataFrame) -> None:
        self.lake._swap(f"catalog/{name}", df)

    def init(self) -> None:
        """Write the tables that are missing or lack columns, bring the dataset catalog up to date, and make the views."""
        for name in TABLES:
            df = self.lake.table(f"catalog/{name}")
            if df is None or set(self.table(name).columns) - set(df.columns):
                self._put(name, self.table(name))
        self.refresh()
        self.create_views()

    def refresh(self) -> None:
        at = now()
        rows = [(d.name, d.source, "silver", json.dumps(d.primary_key), d.fetch, d.date_field, d.group, d.chunk_days, json.dumps(d.fields), at) for d in DATASETS.values()]
        self._put("dataset_catalog", refreshed(self.table("dataset_catalog"), self._frame("dataset_catalog", rows)))

    def start_batch(self, batch: str, spec: DatasetSpec, params: Mapping) -> None:
        row = (batch, spec.name, spec.source, json.dumps(dict(params), sort_keys=True), "running", 0, now(), None, None)
        self._put("sync_batches", self.table("sync_batches").unionByName(self._frame("sync_batches", [row])))

    def finish_batch(self, batch: str, spec: DatasetSpec, status: str, rows: int, start: str | None = None, end: str | None = None, error: str | None = None) -> None:
        """Record how a batch ended; a failure leaves the last success and, where it names none, the last span as they were."""
        at = now()
        self._put("sync_batches", finished(self.table("sync_batches"), batch, status, rows, at, error))
        row = (spec.name, at if status == "success" else None, batch, start, end, rows, status)
        self._put("sync_status", upsert(self.table("sync_status"), self._frame("sync_status", [row]), ["dataset"], ("last_success_at", "last_start_date", "last_end_date")))

    def record_quality(self, rows: list[tuple[str, str, str, str]]) -> None:
        """Append (dataset, check, status, detail) rows; earlier ones stay."""
        at = now()
        new = self._frame("data_quality", [(f"{d}:{c}:{uuid.uuid4().hex[:12]}", d, c, s, t, at) for d, c, s, t in rows])
        self._put("data_quality", self.table("data_quality").unionByName(new))

    def sql(self, query: str, **args: object) -> DataFrame:
        """A query over the views with named parameters, ``:name``."""
        return self.spark.sql(query, args=args)

    def create_views(self) -> list[str]:
        """(Re)make every view of the session; one whose tables are missing is empty."""
        silver = {d: self.lake.silver(d) for d in DATASETS}
        empty = lambda kinds: self.spark.createDataFrame([], kinds)
        made: dict[str, DataFrame] = {}
        for name, members in UNION_VIEWS.items():
            known = {d: silver[d] for d in members if silver[d] is not None}
            made[name] = views.union_view(known) if known else empty("dataset string")
        daily, factor, stock = silver["daily"], silver["adj_factor"], silver["stock_basic"]
        bare = empty("ts_code string, trade_date string")
        if daily is None or factor is None:
            made["v_adjusted_daily"] = made["v_adjusted_returns"] = bare
        else:
            rows = daily.select("ts_code", "trade_date", *(views.optional(daily, c, "double").alias(c) for c in DAILY_COLUMNS))
            made["v_adjusted_daily"] = views.adjusted_daily(rows, factor, PRICES)
            made["v_adjusted_returns"] = views.adjusted_returns(made["v_adjusted_daily"])
        made["v_stock_universe_daily"] = bare if daily is None or stock is None else views.stock_universe_daily(daily, stock, silver["suspend_d"], STOCK_COLUMNS)
        for name, d in INTERVAL_VIEWS.items():
            made[name] = empty("ts_code string, ann_date string") if silver[d] is None else views.asof_intervals(silver[d])
        made["v_sync_status"] = status_of_known(self.table("sync_status"), self.table("dataset_catalog"))
        for name, df in made.items():
            df.createOrReplaceTempView(name)
        return list(made)

    def usability(self) -> list[tuple[str, str, str]]:
        """(check, status, detail): every view can be read, and the tables fit each other."""
        out = []
        for name in self.create_views():
            if name not in UNION_VIEWS:
                try:
                    out.append((f"view:{name}", "passed", f"queryable rows={self.spark.table(name).count()}"))
                except AnalysisException as error:
                    out.append((f"view:{name}", "failed", f"view is not queryable: {str(error)[:200]}"))
        tables = {d: self.lake.silver(d) for d in ("daily", "adj_factor", "stock_basic", "trade_cal")}
        missing = [d for d, df in tables.items() if df is None]
        if missing:
            return out + [(c, "missing", f"no silver table: {', '.join(missing)}") for c in CROSS_CHECKS]
        rows = usability(*tables.values(), self.spark.table("v_adjusted_daily")).collect()
        return out + [(r["check_name"], r["status"], f"rows against it: {r['failures']}") for r in rows]

    def validate_all(self, specs: list[DatasetSpec] | None = None) -> list[tuple[str, str, str]]:
        """Every dataset's and every cross check's (name, status, detail), kept in data_quality."""
        each = [(s.name, *validate(s, self.lake.silver(s.name))) for s in specs or DATASETS.values()]
        cross = self.usability() if specs is None else []
        self.record_quality([(n, "dataset_integrity", s, t) for n, s, t in each] + [(DATABASE, n, s, t) for n, s, t in cross])
        return each + cross


