"""Engine settings: environment variables and a .env file over defaults, with range and cross-field checks."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields
from pathlib import Path
from urllib.parse import urlsplit

PREFIX = "CITELOOM_"


@dataclass(frozen=True)
class Settings:
    index_path: str = "index"
    generator_url: str = "http://localhost:11434"
    generation_model: str = "qwen2.5:3b"
    health_timeout: float = 5.0
    retrieve_top_k: int = 20
    rerank_top_n: int = 6
    evidence_top_n: int = 2
    generation_timeout: int = 200
    generation_retries: int = 1
    temperature: float = 0.1
    context_characters: int = 12_000
    maximum_dense_drop: float = 0.02
    minimum_dense_score: float = 0.82
    identifier_override_score: float = 0.75
    minimum_rerank_score: float = -1.0

    def __post_init__(self) -> None:
        url = urlsplit(self.generator_url)
        if url.scheme not in ("http", "https") or not url.netloc:
            raise ValueError("generator_url must be http or https with a host")
        object.__setattr__(self, "generator_url", self.generator_url.rstrip("/"))
        checks = {
            "retrieve_top_k must be positive": self.retrieve_top_k > 0,
            "rerank_top_n must be between 1 and retrieve_top_k": 0 < self.rerank_top_n <= self.retrieve_top_k,
            "evidence_top_n must be between 1 and rerank_top_n": 0 < self.evidence_top_n <= self.rerank_top_n,
            "generation_model must not be blank": bool(self.generation_model.strip()),
            "health_timeout must be between 0 and 60": 0 < self.health_timeout <= 60,
            "generation_timeout must be positive": self.generation_timeout > 0,
            "generation_retries must be between 0 and 3": 0 <= self.generation_retries <= 3,
            "temperature must be between 0 and 2": 0 <= self.temperature <= 2,
            "context_characters must be positive": self.context_characters > 0,
            "scores must be between -1 and 1": all(-1 <= s <= 1 for s in (self.minimum_dense_score, self.identifier_override_score)),
            "identifier_override_score must not exceed minimum_dense_score": self.identifier_override_score <= self.minimum_dense_score,
        }
        failed = [text for text, fine in checks.items() if not fine]
        if failed:
            raise ValueError("; ".join(failed))


def load_settings(env: dict[str, str] | None = None, dotenv: str | None = ".env") -> Settings:
    """Environment over the file over the defaults; values take the type of their default."""
    given: dict[str, str] = {}
    if dotenv and Path(dotenv).is_file():
        for line in Path(dotenv).read_text().splitlines():
            name, mark, value = line.strip().partition("=")
            if mark and not name.startswith("#"):
                given[name.strip()] = value.strip().strip("\"'")
    given |= dict(os.environ if env is None else env)
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    values = {n: kind(given[PREFIX + n.upper()]) for n, kind in kinds.items() if PREFIX + n.upper() in given}
    return Settings(**values)
