"""Settings of a project as a TOML or JSON file."""

from __future__ import annotations

import json
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

SCHEMA_VERSION = 1


@dataclass(frozen=True)
class Settings:
    sections: dict[str, dict] = field(default_factory=dict)

    def section(self, name: str) -> dict:
        if name not in self.sections:
            raise KeyError(f"no section {name} in the settings")
        return self.sections[name]


def load_settings(path: str) -> Settings:
    """Raises unless the file says schema_version 1 and every other entry is a section."""
    text = Path(path).read_text(encoding="utf-8")
    raw = tomllib.loads(text) if path.endswith(".toml") else json.loads(text)
    if not isinstance(raw, dict) or raw.pop("schema_version", None) != SCHEMA_VERSION:
        raise ValueError(f"{path} must say schema_version = {SCHEMA_VERSION}")
    odd = sorted(k for k, v in raw.items() if not isinstance(v, dict))
    if odd:
        raise ValueError(f"no sections: {', '.join(odd)}")
    return Settings(raw)
