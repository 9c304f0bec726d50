"""Rules from TOML text or a file, section by section over the defaults."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path

from ..functions import values as V


@dataclass(frozen=True)
class Rules:
    layers: dict[str, str] = field(default_factory=lambda: dict(V.LAYERS))
    triggers: dict[str, str] = field(default_factory=lambda: dict(V.TRIGGERS))
    never: tuple[str, ...] = V.NEVER_FORGET
    ttl_days: dict[str, int] = field(default_factory=lambda: dict(V.TTL_DAYS))
    confidence: dict[str, float] = field(default_factory=lambda: dict(V.CONFIDENCE))

    def ttl(self, layer: str) -> int | None:
        return self.ttl_days.get(layer)


def parse(text: str) -> Rules:
    """A section that is there replaces the default's; others stay."""
    t = tomllib.loads(text)
    given = {"layers": t.get("layers"), "triggers": t.get("triggers"), "never": t.get("forget", {}).get("never"), "ttl_days": t.get("forget", {}).get("after_days"), "confidence": t.get("extract", {}).get("confidence")}
    return Rules(**{k: tuple(v) if k == "never" else v for k, v in given.items() if v is not None})


class Watched:
    """Rules of a file that are read again when the file changes; defaults while it is missing."""

    def __init__(self, path: str):
        self.path, self.seen, self.rules = Path(path), None, Rules()

    def get(self) -> Rules:
        try:
            now = self.path.stat().st_mtime_ns
        except FileNotFoundError:
            now = None
        if now != self.seen:
            self.seen, self.rules = now, Rules() if now is None else parse(self.path.read_text())
        return self.rules
