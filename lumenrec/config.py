"""Settings from a JSON file whose strings may name environment variables."""

from __future__ import annotations

import json
import os
from pathlib import Path
from typing import Any


def expand(value: Any) -> Any:
    """value with $NAME and ${NAME} replaced in every string of its dicts and lists; unknown names stay."""
    if isinstance(value, dict):
        return {k: expand(v) for k, v in value.items()}
    if isinstance(value, list):
        return [expand(v) for v in value]
    return os.path.expandvars(value) if isinstance(value, str) else value


def load_config(path: str) -> dict:
    """The settings in the file at path; FileNotFoundError if there is none."""
    if not Path(path).is_file():
        raise FileNotFoundError(f"no configuration at {path}")
    with open(path, encoding="utf-8") as f:
        return expand(json.load(f))
