"""Configurations: read, checked, merged, and searched for the paths they name.

Defined cases: an empty file has no sections and is refused; a section or
target of the wrong kind is an error that names it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from pathlib import Path
from typing import Any

SECTIONS = ("project", "dataset", "generation", "models", "evaluation")
PATH_SUFFIXES = (".png", ".jpg", ".jpeg", ".bmp", ".tif", ".tiff", ".json", ".jsonl", ".yaml", ".yml")


def load_config(path: str, sections: tuple[str, ...] = SECTIONS) -> dict[str, Any]:
    """A YAML or JSON configuration with all its sections and a list of defect types per category."""
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        data = json.loads(text or "{}")
    else:
        try:
            import yaml
        except ImportError as e:  # not every installation reads YAML
            raise RuntimeError("YAML configurations need a YAML reader; use JSON") from e
        data = yaml.safe_load(text) or {}
    missing = [s for s in sections if s not in data]
    if missing:
        raise ValueError(f"missing config section: {missing[0]}")
    targets_of(data)
    return data


def targets_of(config: dict[str, Any]) -> list[tuple[str, str]]:
    """(category, defect type) pairs in the order given."""
    targets = config.get("dataset", {}).get("targets")
    fine = isinstance(targets, dict) and targets and all(isinstance(c, str) and isinstance(d, list) and d for c, d in targets.items())
    if not fine:
        raise ValueError("dataset.targets must map categories to lists of defect types that are not empty")
    return [(c, d) for c, types in targets.items() for d in types]


def fingerprint(value: Any) -> str:
    """SHA-256 of a value's JSON with sorted keys."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def looks_like_path(value: str) -> bool:
    return "/" in value or "\\" in value or value.lower().endswith(PATH_SUFFIXES)


def path_references(config: Any, skip: tuple[str, ...] = ("governance",)) -> Iterator[tuple[str, str]]:
    """(dotted key, path) of every text in a configuration that looks like a path, but for the sections to skip."""
    stack = [("", config)]
    while stack:
        key, value = stack.pop()
        if isinstance(value, dict):
            stack += [(f"{key}.{k}" if key else str(k), v) for k, v in reversed(value.items()) if key or k not in skip]
        elif isinstance(value, list):
            stack += [(f"{key}[{i}]", v) for i, v in reversed(list(enumerate(value)))]
        elif isinstance(value, str) and looks_like_path(value):
            yield key, value


def forbidden_references(config: Any, roots: list[str]) -> list[tuple[str, str]]:
    """References that overlap one of the roots: equal to it, below it or above it."""
    parts = lambda p: [x for x in p.replace("\\", "/").split("/") if x not in ("", ".")]
    overlaps = lambda a, b: a[: len(b)] == b or b[: len(a)] == a
    return [(k, p) for k, p in path_references(config) if any(overlaps(parts(p), parts(r)) for r in roots)]
