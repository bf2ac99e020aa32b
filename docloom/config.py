"""Settings of the engine, read from environment variables (DOCLOOM_...), and presets of model providers."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class Provider:
    base_url: str | None
    model: str | None
    needs_key: bool = True


PROVIDERS = {"local": Provider("http://localhost:11434/v1", None, needs_key=False), "custom": Provider(None, None)}


@dataclass(frozen=True)
class Settings:
    """Frozen; `from_env` fills it, `replace` from dataclasses changes copies. Keys never show in repr."""

    provider: str = "local"
    base_url: str | None = None
    model: str | None = None
    api_key: str | None = None
    timeout_s: float = 120.0
    min_interval_s: float = 0.0
    max_retries: int = 8
    ask_max_retries: int = 2
    rate_limit_retries: int = 3
    max_calls: int | None = 40
    price_in_usd: float | None = None
    price_out_usd: float | None = None
    batch_chars: int = 6000
    batch_items: int = 40
    embedder: str = "hash"
    embed_batch_items: int = 32
    embed_batch_chars: int = 24_000
    chunk_chars: int = 1000
    chunk_overlap: int = 150
    top_k: int = 5
    candidates: int = 20
    max_steps: int = 5
    confirm_pages: int = 50
    max_pages: int = 50
    max_upload_mb: int = 20
    glossary: str | None = None
    trace_path: str | None = None
    trajectories: str | None = None

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> Settings:
        env = os.environ if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(f"DOCLOOM_{f.name.upper()}")
            if raw is None or raw == "":
                continue
            kind = str(f.type)
            found[f.name] = int(raw) if kind.startswith("int") else float(raw) if kind.startswith("float") else raw
        made = cls(**found)
        if made.provider not in PROVIDERS:
            raise ValueError(f"unknown provider {made.provider!r}, known: {', '.join(PROVIDERS)}")
        return made

    def __repr__(self) -> str:
        shown = replace(self, api_key="***") if self.api_key else self
        return f"Settings({', '.join(f'{f.name}={getattr(shown, f.name)!r}' for f in fields(self))})"

    @property
    def url(self) -> str:
        url = self.base_url or PROVIDERS[self.provider].base_url
        if not url:
            raise ValueError("a base URL is required for this provider")
        return url.rstrip("/")

    @property
    def model_name(self) -> str:
        name = self.model or PROVIDERS[self.provider].model
        if not name:
            raise ValueError("a model is required for this provider")
        return name

    @property
    def prices(self) -> tuple[float, float] | None:
        """Per million tokens, in and out; None unless both are known."""
        return None if self.price_in_usd is None or self.price_out_usd is None else (self.price_in_usd, self.price_out_usd)
