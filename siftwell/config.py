"""Settings: defaults, a YAML file, then environment variables."""

from __future__ import annotations

import dataclasses
import os

import yaml


@dataclasses.dataclass
class Config:
    warehouse: str = "siftwell-warehouse"
    score_mode: str = "reference"
    limit: int = 20
    min_score: float = 0.0
    detail: str = "L1"
    shuffle_partitions: int | None = None
    global_context: str | None = None
    collections: dict = dataclasses.field(default_factory=dict)
    contexts: dict = dataclasses.field(default_factory=dict)

    @classmethod
    def load(cls, path: str | None = None, env: dict | None = None) -> "Config":
        """Unknown keys of the file are ignored; ``SIFTWELL_<NAME>`` overrides a scalar setting."""
        env = os.environ if env is None else env
        values: dict = {}
        if path and os.path.exists(path):
            with open(path, encoding="utf-8") as f:
                values = yaml.safe_load(f) or {}
        known = {f.name: f for f in dataclasses.fields(cls)}
        out = cls(**{k: v for k, v in values.items() if k in known})
        for name, field in known.items():
            raw = env.get(f"SIFTWELL_{name.upper()}")
            if raw is not None and name not in ("collections", "contexts"):
                kind = {"limit": int, "min_score": float, "shuffle_partitions": int}.get(field.name, str)
                setattr(out, name, kind(raw))
        return out

    def save(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            yaml.safe_dump(dataclasses.asdict(self), f, sort_keys=True)

    def context_for(self, path: str) -> str | None:
        """The global context and those of every prefix of ``path``, shortest first."""
        own = [v for k, v in sorted(self.contexts.items(), key=lambda x: (len(x[0]), x[0])) if path.startswith(k)]
        parts = ([self.global_context] if self.global_context else []) + own
        return "\n\n".join(parts) or None
