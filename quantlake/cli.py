"""Command line of the lake: init-db, status, validate, consolidate, repair, sync and sync-phased.

Exit codes: 0 done, 1 a check or a chunk failed, 2 a wrong call.
"""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from datetime import UTC, datetime
from pathlib import Path

from quantlake import config
from quantlake.operators.views import open_trade_dates
from quantlake.session import session
from quantlake.sources import ingest, sinks
from quantlake.sources.catalog import Catalog, status_of_known
from quantlake.sources.lake import Lake
from quantlake.specs import DATASETS, DatasetNotFoundError, dataset, group


def compact(day: str) -> str:
    """YYYYMMDD of a date with or without dashes, or of ``today``."""
    text = datetime.now(UTC).strftime("%Y%m%d") if day == "today" else day.replace("-", "")
    datetime.strptime(text, "%Y%m%d")
    return text


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quantlake")
    p.add_argument("--root", help="folder of the lake, on any store that Spark reads")
    p.add_argument("--config", help="file with settings; --root, --start and --end go before it")
    p.add_argument("--adapter", help="module:callable that gives the data source's adapter")
    sub = p.add_subparsers(dest="verb", required=True)
    sub.add_parser("init-db")
    sub.add_parser("status")
    for verb in ("validate", "consolidate-bronze", "repair-security-codes"):
        sub.add_parser(verb).add_argument("--dataset", action="append")
    for verb in ("sync", "sync-all", "sync-phased"):
        s = sub.add_parser(verb)
        s.add_argument("--dataset", action="append")
        s.add_argument("--group", default="all")
        s.add_argument("--start")
        s.add_argument("--end")
        s.add_argument("--bronze-only", action="store_true")
        s.add_argument("--dry-run", action="store_true")
        s.add_argument("--checkpoint", default="sync-checkpoint.json")
    return p


def main(argv: list[str] | None = None, spark=None, adapter=None) -> int:  # noqa: ANN001
    args = parser().parse_args(argv)
    try:
        settings = config.load(args.config)
        named = getattr(args, "dataset", None)
        specs = [dataset(n) for n in named] if named else [d for d in group(getattr(args, "group", "all")) if settings.datasets.get(d.name, True)]
        span = (compact(args.start or settings.default_start_date), compact(args.end or settings.default_end_date)) if args.verb.startswith("sync") else None
    except (DatasetNotFoundError, ValueError, OSError) as error:
        print(f"error: {error}", file=sys.stderr)
        return 2
    lake = Lake(spark or session(), args.root or settings.data_root)
    catalog = Catalog(lake)
    if args.verb == "init-db":
        catalog.init()
        return 0
    if args.verb == "status":
        for r in status_of_known(catalog.table("sync_status"), catalog.table("dataset_catalog")).orderBy("dataset").collect():
            print(json.dumps(r.asDict(), default=str))
        return 0
    if args.verb == "validate":
        found = catalog.validate_all(specs if named else None)
        for row in found:
            print(*row, sep="\t")
        return int(any(status != "passed" for _, status, _ in found))
    if args.verb == "consolidate-bronze":
        for s in specs:
            print(f"{s.name}\t{lake.consolidate_bronze(s)}")
        return 0
    if args.verb == "repair-security-codes":
        for name, counts in lake.repair_aliases(specs).items():
            print(name, *counts, sep="\t")
        return 0
    if adapter is None:
        if not args.adapter:
            print("error: sync needs --adapter", file=sys.stderr)
            return 2
        module, _, name = args.adapter.partition(":")
        adapter = ingest.Retrying(getattr(importlib.import_module(module), name)(), settings.source.rate_limit_seconds, settings.source.max_retries, settings.source.retry_backoff_seconds)
    sync = ingest.Sync(lake.spark, lake, adapter)
    if args.verb != "sync-phased":
        for s in specs:
            print(f"{s.name}\t{sync.dataset(s, *span, silver=not args.bronze_only)}")
        return 0
    cal = lake.silver("trade_cal")
    days = None if cal is None else {r["trade_date"] for r in open_trade_dates(cal, *span).collect()}
    chunks = ingest.plan_chunks(specs, *span, days)
    if args.dry_run:
        print(*(c.key for c in chunks), sep="\n")
        return 0
    at = Path(args.checkpoint)
    work = lambda c: sync.dataset(DATASETS[c.dataset], c.start, c.end, silver=not args.bronze_only)
    counts = ingest.run_chunks(chunks, work, at, log=lambda e: sinks.append_event(e, at.with_suffix(".jsonl")))
    print(json.dumps(counts))
    return int(counts["failed"] > 0)


if __name__ == "__main__":
    sys.exit(main())
