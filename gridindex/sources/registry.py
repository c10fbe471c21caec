"""The indicator registry: dimensions, their indicators and where each comes from, read from JSON and checked at once."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field


@dataclass(frozen=True)
class Indicator:
    key: str
    dimension: str
    abbr: str
    source: Mapping[str, object] = field(default_factory=dict)

    @property
    def absolute(self) -> str:
        return f"{self.key}_{self.abbr}_abs"

    @property
    def normalised(self) -> str:
        return f"{self.key}_{self.abbr}_norm"


@dataclass(frozen=True)
class Dimension:
    key: str
    abbr: str
    inverted: bool
    indicators: tuple[Indicator, ...]

    @property
    def column(self) -> str:
        return self.abbr.lower()


@dataclass(frozen=True)
class Registry:
    prefix: str
    dimensions: tuple[Dimension, ...]

    @classmethod
    def from_dict(cls, raw: Mapping) -> Registry:
        """Raises ValueError naming every missing field at once."""
        missing = []
        dimensions = []
        for name, d in raw.get("dimensions", {}).items():
            missing += [f"{name}.{f}" for f in ("abbr", "indicators") if f not in d]
            found = []
            for key, i in d.get("indicators", {}).items():
                missing += [f"{name}.{key}.{f}" for f in ("abbr", "source") if f not in i]
                found.append(Indicator(key, name, i.get("abbr", ""), i.get("source", {})))
            dimensions.append(Dimension(name, d.get("abbr", ""), bool(d.get("invert", False)), tuple(found)))
        if not dimensions:
            missing.append("dimensions")
        if missing:
            raise ValueError("registry lacks " + ", ".join(missing))
        return cls(raw.get("file_prefix", ""), tuple(dimensions))

    @classmethod
    def from_json(cls, path: str) -> Registry:
        with open(path, encoding="utf-8") as f:
            return cls.from_dict(json.load(f))

    @property
    def indicators(self) -> tuple[Indicator, ...]:
        return tuple(i for d in self.dimensions for i in d.indicators)

    def file_name(self, indicator: Indicator) -> str:
        return f"{self.prefix}_{indicator.key}_{indicator.abbr}.parquet"

    def effective_weights(self) -> dict[str, float]:
        """Percent of the final score that each indicator carries: dimensions weigh alike, as do a dimension's indicators."""
        share = 100 / len(self.dimensions)
        return {i.key: share / len(d.indicators) for d in self.dimensions for i in d.indicators}
