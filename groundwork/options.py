"""Options of a grounding run, with their defaults."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from .functions.text import STOPWORDS

PLAIN = {"exact": 0.40, "fuzzy": 0.25, "ngram": 0.20, "tfidf": 0.15, "embedding": 0.0}
EMBEDDED = {"exact": 0.30, "fuzzy": 0.15, "ngram": 0.15, "tfidf": 0.10, "embedding": 0.30}
SCORES = {"grounding": 0.35, "accuracy": 0.30, "coverage": 0.15, "faithfulness": 0.20}


@dataclass(frozen=True)
class CitationPattern:
    """A user's citation format: every match of `pattern` becomes extract(match) -> (format, id).

    Empty matches are passed over.
    """

    name: str
    pattern: str
    extract: Callable[[re.Match], tuple[str, str]] = field(default=lambda m: ("custom", m.group(1)))
    flags: int = 0


@dataclass(frozen=True)
class CiteOptions:
    attribution_threshold: float = 0.4
    fuzzy_threshold: float = 0.8
    ngram_threshold: float = 0.3
    tfidf_threshold: float = 0.3
    embedding_threshold: float = 0.8
    weights: dict | None = None
    score_weights: dict | None = None
    claim_granularity: str = "sentence"
    source_map: dict | None = None
    citation_patterns: tuple[CitationPattern, ...] = ()
    stopwords: tuple[str, ...] = tuple(STOPWORDS)
    #: A claim with more sources is scored against the 50 that share most of its tokens; None: against all, however many.
    max_sources_per_claim: int | None = 50
    embedder: Callable[[list[str]], list[list[float]]] | None = None

    def resolved_weights(self) -> dict:
        return (EMBEDDED if self.embedder else PLAIN) | (self.weights or {})

    def resolved_score_weights(self) -> dict:
        return SCORES | (self.score_weights or {})

    def with_overrides(self, **overrides) -> "CiteOptions":
        """Overrides replace whole values, also the nested weights."""
        return replace(self, **overrides)
