"""Settings by precedence: explicit ones, then those of a JSON file, then defaults."""

from __future__ import annotations

import json
from collections.abc import Mapping
from pathlib import Path
from typing import Any


def resolve(defaults: Mapping[str, Any], given: Mapping[str, Any] | None = None, path: str | None = None, section: str | None = None) -> dict[str, Any]:
    """The value of every key of ``defaults``; None among ``given`` means not given, unknown keys are an error."""
    stored: Mapping[str, Any] = {}
    if path is not None:
        doc = json.loads(Path(path).read_text(encoding="utf-8"))
        stored = doc.get(section, {}) if section else doc
        if not isinstance(stored, dict):
            raise ValueError(f"{path}: settings must be an object")
    explicit = {k: v for k, v in (given or {}).items() if v is not None}
    unknown = (set(stored) | set(explicit)) - set(defaults)
    if unknown:
        raise ValueError(f"unknown settings: {sorted(unknown)}")
    return {**defaults, **stored, **explicit}
