"""Thresholds and budgets of retrieval, graph and governance, as parameters with the defaults that results depend on."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Params:
    # similarity thresholds
    sim_high: float = 0.85
    sim_update_only: float = 0.92
    sim_low: float = 0.75
    sim_search: float = 0.50
    top_retrieval: int = 5
    top_search: int = 3
    # text bounds
    abstract_chars: int = 600
    summary_chars: int = 600
    transcript_chars: int = 6000
    # fusion
    rrf_k: int = 60
    weight_vector: float = 1.0
    weight_lexical: float = 0.8
    weight_transform_auto: float = 0.35
    weight_transform_deep: float = 0.5
    environment_weight: float = 0.08
    # rerank and gate
    rerank_top: int = 20
    gate_confidence: float = 0.62
    gate_gap: float = 0.035
    gate_chars: int = 80
    gate_transforms: int = 2
    multi_limit: int = 3
    # edges
    weight_step: float = 0.1
    weight_max: float = 1.0
    co_recall_half_life_days: float = 30.0
    co_recall_least: float = 0.02
    # diffusion
    hops: int = 2
    paths: int = 64
    fan_out: int = 8
    tokens: int = 1600
    hop_decay: float = 0.82
    least_score: float = 0.55
    type_factor: dict[str, float] = field(
        default_factory=lambda: {"semantic": 0.85, "temporal": 0.80, "causal": 1.0, "same_environment": 0.90, "parent_child": 0.95, "co_recall": 0.70, "supersedes": 1.0, "sibling": 0.75}
    )
    # briefing
    briefing_similarity: float = 0.60
    briefing_top: int = 5
    briefing_tokens: int = 2000
    briefing_excerpt: int = 140
    # archive
    archive_days: int = 90
    archive_weight: float = 0.25


DEFAULTS = Params()
