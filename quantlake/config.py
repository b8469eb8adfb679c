"""Settings of an installation from a JSON file, or a YAML file where a YAML reader is installed."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

from quantlake.specs import WalkForward

try:
    import yaml
except ModuleNotFoundError:
    yaml = None


@dataclass(frozen=True)
class Source:
    token_env: str = "DATA_VENDOR_TOKEN"
    max_retries: int = 3
    retry_backoff_seconds: float = 2.0
    rate_limit_seconds: float = 0.25


@dataclass(frozen=True)
class Settings:
    data_root: str = "data"
    default_start_date: str = "2015-01-01"
    default_end_date: str = "today"
    source: Source = Source()
    #: Datasets that are switched on or off; one that is not named is on.
    datasets: dict[str, bool] = field(default_factory=dict)
    walk_forward: WalkForward = WalkForward()


def _filled(kind: type, raw: dict):  # noqa: ANN202
    """A dataclass from a mapping; unknown names are refused, values take the type of the default."""
    known = {f.name: f for f in fields(kind)}
    unknown = set(raw) - set(known)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    default = kind()
    return replace(default, **{k: type(getattr(default, k))(v) for k, v in raw.items()})


def load(path: str | Path | None = None) -> Settings:
    """Settings of a file, with defaults for what it leaves out; a relative data_root is taken from the file's folder."""
    if path is None:
        return Settings()
    path = Path(path)
    text = path.read_text(encoding="utf-8")
    if path.suffix in (".yaml", ".yml"):
        if yaml is None:
            raise RuntimeError("reading YAML settings needs the yaml module; use JSON instead")
        raw = yaml.safe_load(text) or {}
    else:
        raw = json.loads(text)
    nested = {name: _filled(kind, raw.pop(name, {})) for name, kind in (("source", Source), ("walk_forward", WalkForward))}
    nested["walk_forward"].validate()
    out = replace(_filled(Settings, raw), **nested)
    root = out.data_root
    return out if "://" in root or Path(root).is_absolute() else replace(out, data_root=str(path.parent / root))
