"""Build and query settings, saved with every field so that a saved one loads as it was."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path


class _Saved:
    def save(self, path: str) -> None:
        Path(path).write_text(json.dumps(asdict(self), indent=2))

    @classmethod
    def load(cls, path: str):
        """Defaults overlaid with the keys of a JSON file; unknown keys are an error."""
        given = json.loads(Path(path).read_text())
        unknown = set(given) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(cls(), **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


# The defaults of the settings.
@dataclass(frozen=True)
class IndexConfig(_Saved):
    model: str = "none"
    chunk_strategy: str = "heading"
    chunk_size: int = 500
    chunk_overlap: int = 100
    min_chunk_chars: int = 0
    max_chunk_chars: int = 0
    embed_max_chars: int = 1500
    include: tuple[str, ...] = ("*.md", "*.markdown", "*.txt")
    exclude: tuple[str, ...] = ()
    use_ivf: bool = False
    auto_ivf_threshold: int = 5000
    ivf_centroids: int = 0
    ivf_kmeans_iters: int = 0
    ivf_nprobe: int = 0
    stem: bool = False
    parse_frontmatter: bool = True


@dataclass(frozen=True)
class QueryConfig(_Saved):
    mode: str = "hybrid"
    k: int = 3
    weight_semantic: float = 0.48
    weight_bm25: float = 0.52
    bm25_k1: float = 2.33
    bm25_b: float = 0.97
    semantic_hard_floor: float = 0.35
    semantic_soft_floor: float = 0.43
    bm25_min_for_soft_zone: float = 0.44
    min_query_terms_in_corpus: int = 0
    nprobe: int = 0
    n_semantic: int = 0
    max_linked: int = 3
    title_boost: float = 2.5
    require_tags: tuple[str, ...] = field(default_factory=tuple)


NO_EMBEDDING_TITLE_BOOST = 2.0


def auto_centroids(n: int) -> int:
    return 16 if n <= 0 else min(n, max(16, int(4 * math.sqrt(n))))


def auto_nprobe(k: int) -> int:
    return min(k, max(4, int(math.sqrt(k))))


def auto_shortlist(k: int) -> int:
    return max(20 * k, 100)


def use_ivf(cfg: IndexConfig, chunks: int, dim: int, forced: bool | None = None) -> bool:
    """Never without vectors; as forced; else from ``auto_ivf_threshold`` chunks on, or as configured."""
    if not dim:
        return False
    if forced is not None:
        return forced
    return cfg.use_ivf or chunks >= cfg.auto_ivf_threshold
