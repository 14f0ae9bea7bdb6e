"""Every knob of a run in one frozen, validated, hashable object."""

from __future__ import annotations

import hashlib
import json
import tomllib
from dataclasses import asdict, dataclass, fields, replace
from datetime import date
from pathlib import Path


@dataclass(frozen=True, slots=True)
class Config:
    start: date = date(1995, 1, 1)
    end: date = date(2001, 12, 31)
    lag_days: int = 1
    filing_buffer_days: int = 1
    max_age_months: int = 18
    n_deciles: int = 5
    min_names: int = 5
    holding_months: int = 1
    weighting: str = "ew"
    cost_bps: float = 10.0
    winsor: tuple[float, float] = (0.01, 0.99)
    min_sector_names: int = 5
    nw_lags: int = 4
    text_measure: str = "cosine"
    float_band: tuple[float, float] = (0.02, 0.5)

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("start must come before end")
        if self.weighting not in ("ew", "cw"):
            raise ValueError(f"weighting is ew or cw, not {self.weighting!r}")
        if self.text_measure not in ("cosine", "jaccard"):
            raise ValueError(f"text_measure is cosine or jaccard, not {self.text_measure!r}")
        if not 0 <= self.winsor[0] < self.winsor[1] <= 1:
            raise ValueError("winsor bounds must be ordered quantiles")
        for name in ("lag_days", "n_deciles", "min_names", "holding_months"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")
        if not 0 <= self.float_band[0] < self.float_band[1]:
            raise ValueError("float_band must be ordered ratios")
        if self.cost_bps < 0:
            raise ValueError("cost_bps must not be negative")

    @property
    def cost(self) -> float:
        """One-way cost as a fraction."""
        return self.cost_bps / 1e4

    def with_(self, **changes: object) -> Config:
        return replace(self, **changes)

    @property
    def hash(self) -> str:
        """Twelve hex digits that name this configuration."""
        return hashlib.sha256(json.dumps(asdict(self), default=str, sort_keys=True).encode()).hexdigest()[:12]


def load(path: str | Path) -> Config:
    """A configuration from a TOML file; an unknown key is an error."""
    given = tomllib.loads(Path(path).read_text())
    unknown = set(given) - {f.name for f in fields(Config)}
    if unknown:
        raise ValueError(f"unknown settings: {', '.join(sorted(unknown))}")
    for name in {"winsor", "float_band"} & set(given):
        given[name] = tuple(given[name])
    return Config(**given)
