"""The engine's options with their bounds, from keywords or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field, fields


def _bounded(default, low, high):
    return field(default=default, metadata={"low": low, "high": high})


@dataclass(frozen=True)
class Options:
    """What searches and answers can be told; a value out of its bounds is an error."""

    top_k: int = _bounded(8, 1, 50)
    candidates: int = _bounded(300, 1, 5_000)
    vector_weight: float = _bounded(0.30, 0.0, 1.0)
    dimensions: int = _bounded(384, 8, 4_096)
    rerank_limit: int = _bounded(24, 1, 200)
    rerank_input: int = _bounded(12, 1, 100)
    rerank_chars: int = _bounded(160, 20, 5_000)
    web_gate: float = _bounded(0.35, 0.0, 1.0)
    web_results: int = _bounded(3, 1, 20)
    request_delay: float = _bounded(2.0, 0.0, 60.0)
    attempts: int = _bounded(3, 1, 10)
    attachment_bytes: int = _bounded(25_000_000, 1, 1_000_000_000)
    attachment_pages: int = _bounded(200, 1, 10_000)

    def __post_init__(self):
        for f in fields(self):
            value = getattr(self, f.name)
            if isinstance(value, bool) or not isinstance(value, (int, float) if isinstance(f.default, float) else int):
                raise TypeError(f"{f.name} is no {type(f.default).__name__}")
            if not f.metadata["low"] <= value <= f.metadata["high"]:
                raise ValueError(f"{f.name} is within {f.metadata['low']} and {f.metadata['high']}")

    @classmethod
    def from_env(cls, prefix: str = "LEXSPARK_", env: dict[str, str] | None = None) -> Options:
        """Options named in the environment (``LEXSPARK_TOP_K`` …); blank ones keep their defaults."""
        env = dict(os.environ) if env is None else env
        given = {f.name: env.get(prefix + f.name.upper(), "").strip() for f in fields(cls)}
        return cls(**{f.name: type(f.default)(given[f.name]) for f in fields(cls) if given[f.name]})
