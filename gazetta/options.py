"""Options of runs, from arguments or environment variables."""

from __future__ import annotations

import logging
import os
from dataclasses import dataclass, fields


def parse_sources(value: str | None, distinct: bool = True) -> tuple[str, ...]:
    """Names of a comma list, in capitals and without blanks; each once, in order, if distinct."""
    names = [x.strip().upper() for x in (value or "").split(",") if x.strip()]
    return tuple(dict.fromkeys(names) if distinct else names)


@dataclass(frozen=True)
class Options:
    sources: tuple[str, ...] = ()
    lookback_days: int = 4
    detail_retries: int = 3
    detail_backoff_seconds: float = 2.0
    detail_timeout_seconds: int = 30
    batch_size: int = 50
    chunk_size: int = 1200
    chunk_overlap: int = 200
    search_size: int = 40
    index_name: str = "circulars_chunks"
    storage_path: str = "data/raw"
    refetch_on_url_change: bool = False

    def __post_init__(self) -> None:
        object.__setattr__(self, "detail_retries", max(1, self.detail_retries))
        object.__setattr__(self, "detail_backoff_seconds", max(0.0, self.detail_backoff_seconds))

    @classmethod
    def from_env(cls, prefix: str = "GAZETTA_", env: dict[str, str] | None = None) -> Options:
        env = os.environ if env is None else env
        given = {}
        for f in fields(cls):
            if (value := env.get(prefix + f.name.upper())) is not None:
                kind = type(f.default)
                given[f.name] = parse_sources(value) if kind is tuple else value.lower() in ("1", "true", "yes") if kind is bool else kind(value)
        return cls(**given)


def configure_logging(level: str = "INFO") -> None:
    logging.basicConfig(level=level.upper(), format="%(asctime)s %(levelname)s %(name)s %(message)s", force=True)
