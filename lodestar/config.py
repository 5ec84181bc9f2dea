"""Configuration: frozen dataclasses, dotted overrides, fingerprint of what an index depends on."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os
from collections.abc import Mapping
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Chunking:
    strategy: str = "structure"
    target_tokens: int = 512
    overlap_tokens: int = 64
    min_tokens: int = 32

    def __post_init__(self):
        if self.strategy not in ("structure", "fixed"):
            raise ValueError(f"unknown chunking strategy {self.strategy!r}")


@dataclass(frozen=True)
class Lexical:
    enabled: bool = True
    k1: float = 1.2
    b: float = 0.75
    top_k: int = 50
    use_stopwords: bool = True


@dataclass(frozen=True)
class Dense:
    enabled: bool = True
    model: str = "hashing-64"
    query_prefix: str = ""
    passage_prefix: str = ""
    top_k: int = 50
    normalize: bool = True


@dataclass(frozen=True)
class Fusion:
    method: str = "rrf"
    k: int = 60

    def __post_init__(self):
        if self.method not in ("rrf", "normalized_sum"):
            raise ValueError(f"unknown fusion method {self.method!r}")


@dataclass(frozen=True)
class Rerank:
    enabled: bool = True
    model: str = "token-overlap"
    top_n: int = 5
    candidates: int = 50


@dataclass(frozen=True)
class Rewrite:
    enabled: bool = False
    max_queries: int = 3


@dataclass(frozen=True)
class Assembly:
    max_context_tokens: int = 3000
    dedup_threshold: float = 0.92
    ordering: str = "edges"

    def __post_init__(self):
        if self.ordering not in ("edges", "sequential"):
            raise ValueError(f"unknown ordering {self.ordering!r}")


@dataclass(frozen=True)
class Retrieval:
    bm25: Lexical = field(default_factory=Lexical)
    dense: Dense = field(default_factory=Dense)
    fusion: Fusion = field(default_factory=Fusion)
    rerank: Rerank = field(default_factory=Rerank)
    rewrite: Rewrite = field(default_factory=Rewrite)
    assembly: Assembly = field(default_factory=Assembly)


@dataclass(frozen=True)
class Generation:
    provider: str = "null"
    model: str = ""
    require_citations: bool = True


@dataclass(frozen=True)
class Evaluation:
    k_values: tuple[int, ...] = (1, 3, 5, 10, 20)
    ndcg_k: int = 10
    min_recall_at_10: float = 0.80
    min_ndcg_at_10: float = 0.60
    min_faithfulness: float = 0.70
    max_p95_latency_ms: float = 1500.0


@dataclass(frozen=True)
class Config:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    generation: Generation = field(default_factory=Generation)
    eval: Evaluation = field(default_factory=Evaluation)

    @classmethod
    def load(cls, path: str | None = None, overrides: Mapping[str, Any] | None = None, env: Mapping[str, str] | None = None) -> Config:
        """File (JSON, or YAML where a parser is installed), then environment, then overrides."""
        out = cls()
        if path:
            with open(path, encoding="utf-8") as f:
                body = f.read()
            if path.endswith((".yml", ".yaml")):
                import yaml

                tree = yaml.safe_load(body) or {}
            else:
                tree = json.loads(body)
            out = out.patch(_dotted(tree))
        prefix = "LODESTAR_"
        found = {k[len(prefix) :].lower().replace("__", "."): json_or_text(v) for k, v in (env or os.environ).items() if k.startswith(prefix)}
        return out.patch(found).patch(overrides or {})

    def patch(self, overrides: Mapping[str, Any]) -> Config:
        """A copy with dotted keys replaced, as in ``{"retrieval.rerank.enabled": False}``."""
        out = self
        for dotted, value in overrides.items():
            out = _replaced(out, dotted.split("."), value, dotted)
        return out

    def fingerprint(self) -> str:
        """12 hex digits over everything that an index is built from."""
        d = self.retrieval.dense
        relevant = {"chunking": dataclasses.asdict(self.chunking), "dense_model": d.model, "normalize": d.normalize, "passage_prefix": d.passage_prefix}
        return hashlib.sha1(json.dumps(relevant, sort_keys=True).encode()).hexdigest()[:12]


def json_or_text(value: str) -> Any:
    try:
        return json.loads(value)
    except ValueError:
        return value


def _dotted(tree: Mapping[str, Any], head: str = "") -> dict[str, Any]:
    out: dict[str, Any] = {}
    for k, v in tree.items():
        out |= _dotted(v, f"{head}{k}.") if isinstance(v, Mapping) else {f"{head}{k}": v}
    return out


def _replaced(node: Any, path: list[str], value: Any, dotted: str) -> Any:
    if not dataclasses.is_dataclass(node) or path[0] not in {f.name for f in dataclasses.fields(node)}:
        raise KeyError(f"unknown config key {dotted!r}")
    if len(path) > 1:
        value = _replaced(getattr(node, path[0]), path[1:], value, dotted)
    elif isinstance(getattr(node, path[0]), tuple):
        value = tuple(value)
    return dataclasses.replace(node, **{path[0]: value})
