"""Settings of a run, read once and never changed: defaults, then a YAML file, then environment variables."""

from __future__ import annotations

import dataclasses
import os
from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Chunking:
    window_words: int = 350
    overlap_words: int = 50
    min_chunk_words: int = 120
    chapter_regex: str = r"(?im)^(chapter|chapitre)\b.*$"

    @property
    def step(self) -> int:
        return max(1, self.window_words - self.overlap_words)


@dataclass(frozen=True)
class Retrieval:
    k: int = 12
    candidate_pool: int = 80
    max_per_chapter: int = 12
    enforce_buckets: bool = False
    k1: float = 1.5
    b: float = 0.75


@dataclass(frozen=True)
class Verifier:
    backend: str = "lexical"
    score_mix_alpha: float = 0.15
    sentence_level: bool = True
    top_sentences: int = 5
    entail_threshold: float = 0.52
    contra_threshold: float = 0.78
    nli_margin: float = 0.04
    enable_alias_gate: bool = False
    enable_contra_alias_gate: bool = True
    emit_supports_claim_fallback: bool = True
    min_fact_conf: float = 0.40
    #: A folder that a model's answers are kept in from run to run; without one they are for this run alone.
    known: str = ""


@dataclass(frozen=True)
class Graph:
    min_fact_conf: float = 0.65


@dataclass(frozen=True)
class Logic:
    min_shared_tokens: int = 2
    min_jaccard: float = 0.20
    max_pairs: int = 400
    duplicate_jaccard: float = 0.92
    hard_contradiction: float = 0.85
    soft_contradiction: float = 0.70
    duplicate_entailment: float = 0.60
    margin: float = 0.05


@dataclass(frozen=True)
class Decision:
    contradiction_penalty: float = 2.0
    neutral_alpha: float = 0.15
    mode: str = "balanced"
    min_precision: float = 0.55


@dataclass(frozen=True)
class Settings:
    chunking: Chunking = field(default_factory=Chunking)
    retrieval: Retrieval = field(default_factory=Retrieval)
    verifier: Verifier = field(default_factory=Verifier)
    kg: Graph = field(default_factory=Graph)
    logic: Logic = field(default_factory=Logic)
    aggregation: Decision = field(default_factory=Decision)


TRUE, FALSE = {"1", "true", "yes", "y", "on"}, {"0", "false", "no", "n", "off"}


def as_bool(value: Any, default: bool = False) -> bool:
    if isinstance(value, bool):
        return value
    said = str(value).strip().lower()
    return True if said in TRUE else False if said in FALSE else default


def _typed(value: Any, like: Any) -> Any:
    if isinstance(like, bool):
        return as_bool(value, like)
    return type(like)(value) if isinstance(like, (int, float)) else value


def load(path: str | None = None, environ: dict[str, str] | None = None, prefix: str = "STORYPROOF_") -> Settings:
    """Settings from a YAML file (sections as above; others are ignored) and PREFIX_SECTION_NAME variables, which win."""
    said: dict[str, Any] = {}
    if path:
        import yaml

        with open(path, encoding="utf-8") as f:
            said = yaml.safe_load(f) or {}
    env = os.environ if environ is None else environ
    out = {}
    for section in dataclasses.fields(Settings):
        default = section.default_factory()
        values = dict(said.get(section.name) or {})
        values |= {f.name: env[key] for f in dataclasses.fields(default) if (key := f"{prefix}{section.name}_{f.name}".upper()) in env}
        known = {f.name: getattr(default, f.name) for f in dataclasses.fields(default)}
        out[section.name] = dataclasses.replace(default, **{k: _typed(v, known[k]) for k, v in values.items() if k in known})
    return Settings(**out)
