"""Settings that change results, in one place and always passed explicitly."""

from __future__ import annotations

import json
import os
from dataclasses import asdict, dataclass, fields
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    """The defaults, with which results must be the same."""

    embedding_dim: int = 384
    query_prefix: str = ""
    similarity_threshold: float = 0.15
    graph_distance_threshold: int = 2
    rrf_k: int = 60
    bm25_k1: float = 1.2
    bm25_b: float = 0.75
    chunk_min_words: int = 40
    chunk_max_words: int = 320
    chunk_overlap_words: int = 30
    cosine_floor: float = 0.65
    reuse_discount: float = 0.5
    knn: int = 20
    persist_confidence: float = 0.70
    excerpt_chars: int = 1500
    cache_max_entries: int = 1000
    cache_ttl_s: float | None = None
    requests_per_minute: int = 30
    tokens_per_minute: int = 8000
    max_retries: int = 3


#: The factor on a result's score by its distance from the focus note.
HOP_FACTORS = {0: 1.40, 1: 1.25, 2: 1.10}
#: Files of a vault and folders never entered.
EXTENSIONS = (".md", ".markdown", ".mdx")
IGNORED_FOLDERS = ("node_modules", "venv", "__pycache__")
SITE_FOLDERS = ("build", "dist", "out", "_site")
ASSETS = (".png", ".jpg", ".jpeg", ".gif", ".svg", ".pdf", ".mp3", ".webp")
#: Kinds of inferred relations.
RELATIONS = ("EXTENDS", "CONTRADICTS", "SUPPORTS", "PREREQUISITE_FOR", "REFINES", "NONE")

_RANGES = {"similarity_threshold": (0.0, 1.0), "graph_distance_threshold": (1, 10), "requests_per_minute": (1, 100_000), "tokens_per_minute": (1, 100_000_000), "max_retries": (0, 20)}


def clamp(x: int, low: int, high: int) -> int:
    return max(low, min(high, int(x)))


def load_settings(path: str) -> Settings:
    """Settings of a vault's JSON file over the defaults; unknown keys are left out, values out of range refused."""
    file = Path(path)
    given = json.loads(file.read_text("utf-8")) if file.exists() else {}
    known = {f.name for f in fields(Settings)}
    given = {k: v for k, v in given.items() if k in known}
    for k, (low, high) in _RANGES.items():
        if k in given and not low <= given[k] <= high:
            raise ValueError(f"{k} must be from {low} to {high}")
    return Settings(**given)


def save_settings(path: str, settings: Settings) -> None:
    """Written for its owner only."""
    file = Path(path)
    file.parent.mkdir(parents=True, exist_ok=True)
    with os.fdopen(os.open(file, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600), "w", encoding="utf-8") as f:
        json.dump(asdict(settings), f, indent=2)
