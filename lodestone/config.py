"""One frozen configuration for all operators."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Defaults are fixed values: results depend on them."""

    k1: float = 1.5
    b: float = 0.75
    epsilon: float = 0.25
    default_limit: int = 10
    max_limit: int = 50
    hybrid_max_limit: int = 100
    bm25_weight: float = 0.5
    semantic_weight: float = 0.5
    bm25_candidates: int = 50
    semantic_candidates: int = 50
    snippet_words: int = 26
    rag_passages: int = 5
    rag_chars: int = 3000
    rag_min_score: float = 0.15
    match_floor: float = 0.0
    max_candidates: int = 100
    web_limit: int = 10
    ai_limit: int = 5
    research_limit: int = 15
    code_limit: int = 10
    research_multiplier: int = 4
    research_host_cap: int = 3
    research_words: int = 56
    code_multiplier: int = 3
    code_bm25_weight: float = 0.7
    code_semantic_weight: float = 0.3
    code_words: int = 34
    code_chars: int = 600
    crawl_depth: int = 2
    crawl_pages: int = 25
    crawl_chars: int = 200_000
    frontier_cap: int = 2000
    chunk_chars: int = 1500
    #: Spark-side bounds: bytes of query vectors that go to every task at once.
    query_bytes: int = 32 << 20


DEFAULT = EngineConfig()


def clamp_limit(limit: int | None, config: EngineConfig = DEFAULT, cap: int | None = None) -> int:
    """At least 1, at most the cap; None is the default."""
    return max(1, min(config.default_limit if limit is None else int(limit), config.max_limit if cap is None else cap))


#: What a query, a list of results and a list of domains may be.
QUERY_CHARS, DOMAINS, SOURCES = 500, {"include": 300, "exclude": 150}, 5


def normalized_weights(bm25: float, semantic: float) -> tuple[float, float]:
    """Weights that sum to one. Negative ones, or two zeros, are an error."""
    if bm25 < 0 or semantic < 0 or bm25 + semantic <= 0:
        raise ValueError(f"weights must not be negative, nor both zero: {bm25}, {semantic}")
    return bm25 / (bm25 + semantic), semantic / (bm25 + semantic)
