"""Result sinks: CSV, JSON manifests and events, Markdown tables, line charts, archives, and snapshots of files that must not change.

Results are reports, small by nature; large tables are written as Parquet by Spark.
"""

from __future__ import annotations

import hashlib
import json
import zipfile
from collections.abc import Iterable, Mapping
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


#: Rows that a report may have; more than a spreadsheet opens are no report.
MOST_ROWS = 1_000_000


def write_csv(df: DataFrame, path: Path, order: Iterable[str] = (), most: int = MOST_ROWS) -> None:
    """A report as one CSV file that spreadsheets read as UTF-8; a table of more than ``most`` rows is refused."""
    rows = (df.orderBy(*order) if order else df).limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows; write larger tables as Parquet")
    path.parent.mkdir(parents=True, exist_ok=True)
    rows.to_csv(path, index=False, encoding="utf-8-sig")


def read_csv(spark: SparkSession, path: Path) -> DataFrame:
    return spark.read.option("header", "true").option("inferSchema", "true").csv(str(path))


def write_json(value: Mapping, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    new = path.with_suffix(path.suffix + ".tmp")
    new.write_text(json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, default=str))
    new.replace(path)


def append_event(event: Mapping, path: Path) -> None:
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open("a", encoding="utf-8") as f:
        f.write(json.dumps(event, ensure_ascii=False, default=str) + "\n")


def markdown(df: DataFrame, most: int = 20) -> str:
    """The first rows as a Markdown table."""
    rows = df.limit(most).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    lines = [df.columns, ["---"] * len(df.columns), *([show(v) for v in r] for r in rows)]
    return "\n".join("| " + " | ".join(x) + " |" for x in lines)


#: How names of runs begin, and how many digits follow.
RUN_PREFIX, RUN_DIGITS = "wf_", 12


def run_id(config: Mapping, prefix: str = RUN_PREFIX) -> str:
    """A name that depends on the configuration alone."""
    return prefix + hashlib.sha256(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()[:RUN_DIGITS]


def snapshot(paths: Iterable[Path]) -> dict[str, str | None]:
    return {str(p): hashlib.sha256(p.read_bytes()).hexdigest() if p.exists() else None for p in paths}


def changed(before: Mapping[str, str | None], after: Mapping[str, str | None]) -> list[tuple[str, str]]:
    """(path, added, removed or changed) of every difference."""
    out = []
    for p in sorted(set(before) | set(after)):
        a, b = before.get(p), after.get(p)
        if a != b:
            out.append((p, "added" if a is None else "removed" if b is None else "changed"))
    return out


def bundle(paths: Iterable[Path], target: Path) -> None:
    """A ZIP archive of files under their own names, in the order of their names."""
    new = target.with_suffix(target.suffix + ".tmp")
    with zipfile.ZipFile(new, "w", zipfile.ZIP_DEFLATED) as archive:
        for p in sorted(paths, key=lambda x: x.name):
            archive.write(p, p.name)
    new.replace(target)


def line_chart(rows: DataFrame, path: Path, x: str, y: str, series: str, title: str = "", size: tuple[int, int] = (960, 420), most: int = MOST_ROWS) -> None:
    """Series as lines in an SVG file: a picture that needs no drawing library."""
    points: dict[str, list[tuple[str, float]]] = {}
    for r in rows.select(F.col(series).cast("string"), F.col(x).cast("string"), F.col(y).cast("double")).dropna().limit(most).collect():
        points.setdefault(r[0], []).append((r[1], r[2]))
    places = {v: k for k, v in enumerate(sorted({p[0] for own in points.values() for p in own}))}
    values = [p[1] for own in points.values() for p in own] or [0.0]
    low, high = min(values), max(values)
    (width, height), edge = size, 40
    at = lambda p: f"{edge + places[p[0]] / max(1, len(places) - 1) * (width - 2 * edge):.1f},{height - edge - (p[1] - low) / ((high - low) or 1.0) * (height - 2 * edge):.1f}"
    shapes = [f'<text x="{edge}" y="24" font-size="16">{escape(title)}</text>', f'<text x="4" y="{edge}" font-size="11">{high:.4g}</text>', f'<text x="4" y="{height - edge}" font-size="11">{low:.4g}</text>']
    for k, name in enumerate(sorted(points)):
        colour = f"hsl({k * 360 // len(points)},60%,40%)"
        shapes.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(at(p) for p in sorted(points[name]))}"/>')
        shapes.append(f'<text x="{width - edge - 150}" y="{edge + 14 * k}" font-size="11" fill="{colour}">{escape(name)}</text>')
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(shapes)}</svg>', encoding="utf-8")
