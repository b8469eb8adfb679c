"""Ingestion: adapters, fetch strategies, chunk planning and resumable runs.  All of it is driver-side planning."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from datetime import date, datetime, timedelta
from pathlib import Path
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from quantlake.sources.catalog import Catalog, now
from quantlake.sources.lake import Lake, with_row_numbers
from quantlake.specs import TRADING_DAY_DATASETS, DatasetSpec

PAGE = 3000


class Adapter(Protocol):
    def fetch(self, api_name: str, params: Mapping, fields: Iterable[str]) -> list[dict]: ...


class Vendor:
    """An adapter to a vendor's client, which is made with a token from the environment when it is first needed.

    ``connect`` takes the token and gives a function of (api_name, params, fields) to records, or None for no rows.
    """

    def __init__(self, connect: Callable[[str], Callable[[str, dict, list[str]], list[dict] | None]], token_env: str) -> None:
        self.connect, self.token_env, self.client = connect, token_env, None

    def fetch(self, api_name: str, params: Mapping, fields: Iterable[str]) -> list[dict]:
        if self.client is None:
            token = os.environ.get(self.token_env)
            if not token:
                raise RuntimeError(f"the environment variable {self.token_env} must hold the vendor's token")
            self.client = self.connect(token)
        return self.client(api_name, dict(params), list(fields)) or []


class Retrying:
    """An adapter that waits between calls and tries again, each time longer."""

    def __init__(self, inner: Adapter, pause: float = 0.25, retries: int = 3, backoff: float = 2.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.inner, self.pause, self.retries, self.backoff, self.sleep = inner, pause, retries, backoff, sleep

    def fetch(self, api_name: str, params: Mapping, fields: Iterable[str]) -> list[dict]:
        for attempt in range(1, self.retries + 1):
            try:
                self.sleep(self.pause)
                return self.inner.fetch(api_name, params, fields) or []
            except Exception:
                if attempt == self.retries:
                    raise
                self.sleep(self.backoff * attempt)
        return []


def days(start: str, end: str) -> Iterator[str]:
    at, last = (datetime.strptime(x, "%Y%m%d").date() for x in (start, end))
    while at <= last:
        yield at.strftime("%Y%m%d")
        at += timedelta(1)


def requests(spec: DatasetSpec, start: str | None, end: str | None) -> list[dict]:
    """Parameters of the calls that a dataset's fetch strategy makes (of the first page, if it has pages)."""
    base = dict(spec.default_params)
    if spec.fetch == "daily":
        return [base | {spec.date_field: d} for d in days(start, end)]
    span = {"start_date": start, "end_date": end} if spec.fetch.endswith("range") and start else {}
    if spec.fetch.startswith("param_sets"):
        return [base | p | span for p in spec.param_sets or ({},)]
    return [base | span]


def fetch(adapter: Adapter, spec: DatasetSpec, start: str | None = None, end: str | None = None) -> list[dict]:
    rows: list[dict] = []
    for params in requests(spec, start, end):
        if not spec.fetch.startswith("paged"):
            rows += adapter.fetch(spec.source, params, spec.fields)
            continue
        offset = 0
        while True:
            page = adapter.fetch(spec.source, params | {"limit": PAGE, "offset": offset}, spec.fields)
            rows += page
            if len(page) < PAGE:
                break
            offset += PAGE
    return rows


@dataclass(frozen=True)
class Chunk:
    dataset: str
    start: str | None
    end: str | None

    @property
    def key(self) -> str:
        return f"{self.dataset}:{self.start or ''}:{self.end or ''}"


def plan_chunks(specs: Iterable[DatasetSpec], start: str, end: str, open_days: set[str] | None = None) -> list[Chunk]:
    """Spans of each dataset's chunk size; single days of datasets that exist on trading days only when the market is open."""
    out, seen = [], set()
    for spec in specs:
        if spec.name in seen:
            continue
        seen.add(spec.name)
        if spec.chunk_days is None:
            out.append(Chunk(spec.name, None, None))
            continue
        at, last = (datetime.strptime(x, "%Y%m%d").date() for x in (start, end))
        while at <= last:
            stop: date = min(last, at + timedelta(spec.chunk_days - 1))
            a, b = at.strftime("%Y%m%d"), stop.strftime("%Y%m%d")
            if not (open_days is not None and spec.name in TRADING_DAY_DATASETS and a == b and a not in open_days):
                out.append(Chunk(spec.name, a, b))
            at = stop + timedelta(1)
    return out


class Sync:
    """Fetches datasets into a lake and keeps its catalog."""

    def __init__(self, spark: SparkSession, lake: Lake, adapter: Adapter) -> None:
        self.spark, self.lake, self.adapter, self.catalog = spark, lake, adapter, Catalog(lake)

    def dataset(self, spec: DatasetSpec, start: str | None = None, end: str | None = None, silver: bool = True) -> int:
        """Fetch, write bronze and, unless told otherwise, silver; the batch is recorded, a failure raised again.

        A call that brings no rows is a success and writes nothing.
        """
        batch, at = uuid.uuid4().hex, now()
        self.catalog.start_batch(batch, spec, {"start": start, "end": end})
        try:
            rows = fetch(self.adapter, spec, start, end)
            if rows:
                df: DataFrame = self.spark.createDataFrame([r | {"_arrival": i} for i, r in enumerate(rows)])
                df = with_row_numbers(df, spec, "_arrival").drop("_arrival")
                self.lake.write_bronze(spec, df, batch, {"start": start, "end": end}, at)
                if silver:
                    self.lake.upsert_silver(spec, df, batch, at)
        except Exception as error:
            self.catalog.finish_batch(batch, spec, "failed", 0, start, end, str(error)[:500])
            raise
        self.catalog.finish_batch(batch, spec, "success", len(rows), start, end)
        return len(rows)


def run_chunks(chunks: Iterable[Chunk], work: Callable[[Chunk], int], checkpoint: Path, every: int = 10, skip_failures: bool = True, log: Callable[[dict], None] = lambda _: None) -> dict[str, int]:
    """Work through chunks that the checkpoint does not have; it is saved after every few and at the end, come what may."""
    done = set(json.loads(checkpoint.read_text())["completed"]) if checkpoint.exists() else set()
    counts = {"done": 0, "skipped": 0, "failed": 0}

    def save() -> None:
        new = checkpoint.with_suffix(".tmp")
        new.write_text(json.dumps({"completed": sorted(done)}))
        new.replace(checkpoint)

    try:
        for chunk in chunks:
            if chunk.key in done:
                counts["skipped"] += 1
                continue
            try:
                rows = work(chunk)
            except Exception as error:
                counts["failed"] += 1
                log({"chunk": chunk.key, "status": "failed", "error": str(error)})
                if not skip_failures:
                    raise
                continue
            done.add(chunk.key)
            counts["done"] += 1
            log({"chunk": chunk.key, "status": "done", "rows": rows})
            if counts["done"] % every == 0:
                save()
    finally:
        save()
    return counts
