"""Parameters of the engine: ranges, cross-field rules, defaults and overrides."""

from __future__ import annotations

import json
import os
import tempfile
from dataclasses import asdict, dataclass, fields
from pathlib import Path


class ParameterError(ValueError):
    """Field errors as {path: message}."""

    def __init__(self, errors: dict[str, str]):
        super().__init__("; ".join(f"{k}: {v}" for k, v in errors.items()))
        self.errors = errors


# Least, greatest and default of each parameter.
RANGES = {
    "chunk_size": (128, 2048, 512),
    "chunk_overlap": (0, 1024, 64),
    "dedup_threshold": (0.8, 1.0, 0.95),
    "top_k": (1, 50, 10),
    "top_n": (1, 20, 4),
    "similarity_threshold": (0.0, 1.0, 0.35),
    "temperature": (0.0, 1.0, 0.2),
    "seed": (0, 2**63 - 1, 42),
    "graph_hops": (0, 3, 1),
    "hybrid_weight_vector": (0.0, 1.0, 0.7),
}


def _default(name: str):
    return RANGES[name][2]


@dataclass(frozen=True)
class Params:
    chunk_size: int = _default("chunk_size")
    chunk_overlap: int = _default("chunk_overlap")
    dedup_threshold: float = _default("dedup_threshold")
    top_k: int = _default("top_k")
    top_n: int = _default("top_n")
    similarity_threshold: float = _default("similarity_threshold")
    temperature: float = _default("temperature")
    seed: int = _default("seed")
    graph_hops: int = _default("graph_hops")
    hybrid_weight_vector: float = _default("hybrid_weight_vector")

    def __post_init__(self):
        errors = {}
        for f in fields(self):
            low, high, default = RANGES[f.name]
            v = getattr(self, f.name)
            if isinstance(v, bool) or not isinstance(v, (int, float)) or (isinstance(default, int) and not isinstance(v, int)):
                errors[f"params.{f.name}"] = "wrong type"
            elif not low <= v <= high:
                errors[f"params.{f.name}"] = f"must lie in [{low}, {high}]"
        if not errors:
            if self.chunk_overlap > self.chunk_size // 2:
                errors["params.chunk_overlap"] = "must be at most half of chunk_size"
            if self.top_n > self.top_k:
                errors["params.top_n"] = "must be at most top_k"
        if errors:
            raise ParameterError(errors)

    def override(self, **values) -> Params:
        """Defaults with the non-null overrides, validated as a whole."""
        unknown = set(values) - {f.name for f in fields(self)}
        if unknown:
            raise ParameterError({f"params.{k}": "unknown" for k in sorted(unknown)})
        return Params(**(asdict(self) | {k: v for k, v in values.items() if v is not None}))


@dataclass(frozen=True)
class GuardThresholds:
    max_tokens: int = 512
    injection: float = 0.8
    toxicity: float = 0.7
    off_topic: float = 0.5
    unsupported: float = 0.3
    max_chars: int = 6000


def save_config(path: str, params: Params) -> None:
    """Atomic write: a reader sees the old file or the new one."""
    target = Path(path)
    fd, tmp = tempfile.mkstemp(dir=target.parent, suffix=".tmp")
    with os.fdopen(fd, "w") as f:
        json.dump(asdict(params), f, sort_keys=True)
    os.replace(tmp, target)


def load_config(path: str) -> Params:
    """Defaults if there is no file; an invalid file is set aside."""
    target = Path(path)
    if not target.exists():
        return Params()
    try:
        return Params(**json.loads(target.read_text()))
    except (ValueError, TypeError):
        os.replace(target, target.with_suffix(".invalid"))
        return Params()
