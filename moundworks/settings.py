"""Settings from the environment (prefix MW_) with defaults; paths derive from one root."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from datetime import date

PREFIX = "MW_"


@dataclass(frozen=True)
class Settings:
    data_root: str = "data"
    backend: str = "spark"
    season_start: int = 2015
    pitch_rps: float = 0.25
    pitch_retries: int = 5
    pitch_timeout_s: float = 120.0
    rest_rps: float = 4.0
    register_rps: float = 0.2
    refresh_days: int = 14
    user_agent: str = "moundworks"
    log_level: str = "INFO"

    def __post_init__(self):
        if self.backend != "spark":
            raise NotImplementedError(f"backend {self.backend!r}: only spark is there")

    @classmethod
    def load(cls, env: dict[str, str] | None = None, **given) -> Settings:
        """What is given, else the environment, else the default; a value that isn't of its type raises."""
        env = os.environ if env is None else env
        kinds = {"int": int, "float": float, "str": str}
        found = {f.name: kinds[f.type](env[PREFIX + f.name.upper()]) for f in fields(cls) if PREFIX + f.name.upper() in env}
        return cls(**(found | given))

    @property
    def raw(self) -> str:
        return f"{self.data_root}/raw"

    @property
    def lake(self) -> str:
        return f"{self.data_root}/lake"

    @property
    def models(self) -> str:
        return f"{self.data_root}/models"

    def current_season(self, today: date | None = None) -> int:
        """Before March the last season's data is the current."""
        today = today or date.today()
        return today.year if today.month >= 3 else today.year - 1

    def seasons(self, today: date | None = None) -> list[int]:
        return list(range(self.season_start, self.current_season(today) + 1))

    def shown(self) -> dict:
        return asdict(self) | {"raw": self.raw, "lake": self.lake, "models": self.models}
