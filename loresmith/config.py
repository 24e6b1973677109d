"""Tunables of the engine.  Every operator takes its numbers from one of these frozen records."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class RetrievalConfig:
    """Retrieval, scoring and evidence settings (fixed default values)."""

    top_k: int = 5
    min_similarity: float = 0.35
    min_final: float = 0.30
    max_per_file: int = 2
    min_retrieved: int = 1
    diversity_lambda: float = 0.7
    same_file_penalty: float = 0.70
    same_section_penalty: float = 0.90
    hybrid: bool = True  # off: vector candidates only
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_top_k: int = 20
    rrf_k: int = 60
    rrf_vector_weight: float = 1.0
    rrf_bm25_weight: float = 1.0
    date_exact_boost: float = 1.25
    date_mismatch_penalty: float = 0.55
    date_filter: bool = False
    topic_match_boost: float = 1.20
    topic_mismatch_penalty: float = 0.80
    prioritize_cards: bool = True
    card_boost: float = 1.35
    card_intent_bonus: float = 1.10
    raw_evidence_boost: float = 0.85
    children_per_parent: int = 2
    child_score_ratio: float = 0.9
    max_context_chars: int = 6000
    max_primary: int = 5
    max_evidence: int = 3
    weak_min_fallback: int = 2
    weak_mismatch_ratio: float = 0.7
    answer_with_cards: bool = True

    @property
    def over_fetch(self) -> int:
        return max(3 * self.top_k, self.top_k + 6)


@dataclass(frozen=True)
class ChunkConfig:
    """Chunk sizes (fixed default values)."""

    size: int = 1200
    overlap: int = 200


@dataclass(frozen=True)
class PrivacyPolicy:
    """Switches of the de-identification chain."""

    anonymize: bool = True
    show_names: bool = False
    show_times: bool = False
    show_dates: bool = False
    mask_mentions: bool = True
    mask_links: bool = True
    date_label: str = "업무일"
    time_label: str = "시간대"
    author_hints: tuple[str, ...] = field(default_factory=tuple)
    bot_hints: tuple[str, ...] = ("Channel", "channel")


@dataclass(frozen=True)
class CardConfig:
    """Card building limits (fixed default values)."""

    max_chars: int = 18000
    max_cards: int = 30
    source_weight: float = 1.25
    parent_ids: int = 3


RETRIEVAL = RetrievalConfig()
CHUNKS = ChunkConfig()
PRIVACY = PrivacyPolicy()
CARDS = CardConfig()
