"""Run configurations: nested maps that extend others and are read by dotted path."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any


def merged(base: dict, over: dict) -> dict:
    """A copy of base with over's values; maps on both sides merge."""
    out = dict(base)
    for k, v in over.items():
        out[k] = merged(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def _parsed(path: Path) -> dict:
    text = path.read_text()
    if path.suffix == ".json":
        return json.loads(text)
    import yaml  # only where YAML files are used

    return yaml.safe_load(text) or {}


def load(path: str | Path, _above: tuple[Path, ...] = ()) -> dict:
    """A configuration with all that its `extends` names, relative to itself; a circle is an error."""
    path = Path(path).resolve()
    if path in _above:
        raise ValueError(f"circular extends: {path}")
    own = _parsed(path)
    parents = own.pop("extends", [])
    out: dict = {}
    for p in [parents] if isinstance(parents, str) else parents:
        out = merged(out, load(path.parent / p, (*_above, path)))
    return merged(out, own)


def at(config: dict, dotted: str, default: Any = None) -> Any:
    for part in dotted.split("."):
        if not isinstance(config, dict) or part not in config:
            return default
        config = config[part]
    return config
