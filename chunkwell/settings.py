"""Settings from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """A key is required by generators that call a service, the offline default needs none; files of at most `max_records` records, 0 for any number.

    Of a collection that is indexed `probes` cells are searched, 0 for all.
    """

    store_path: str = "collections"
    api_key: str = ""
    max_records: int = 0
    top_k: int = 3
    context_expansion: int = 0
    two_pass: bool = True
    probes: int = 8

    @classmethod
    def load(cls, env: Mapping[str, str] | None = None, key_required: bool = False) -> Settings:
        env = os.environ if env is None else env
        get = lambda name, default: env.get(f"CHUNKWELL_{name}", default)
        out = cls(
            get("STORE_PATH", cls.store_path), get("API_KEY", ""), int(get("MAX_RECORDS", 0)), int(get("TOP_K", cls.top_k)),
            int(get("CONTEXT_EXPANSION", 0)), str(get("TWO_PASS", "true")).lower() in ("1", "true", "yes"), int(get("PROBES", cls.probes)),
        )
        if key_required and not out.api_key.strip():
            raise ValueError("CHUNKWELL_API_KEY must be set")
        return out
