"""Default parameters of the context pipeline."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    # store
    max_chunks: int = 1000
    max_chunk_chars: int = 4000
    stale_threshold: int = 20
    # duplicates and drift
    dedup_threshold: float = 0.92
    drift_threshold: float = 0.6
    drift_recent_turns: int = 3
    # scoring
    vocab_boost: float = 0.15
    embedding_dims: int = 64
    medium_score: float = 0.5
    # budget
    max_context: int = 8192
    generation_headroom: int = 2048
    fixed_budget: int | None = None
    budget_ranges: dict = field(
        default_factory=lambda: {
            "ultra_small": (1000, 3000),
            "medium": (3000, 5000),
            "escalation": (4000, 6000),
        }
    )
    # archive tier
    archive_gate: float = 0.85
    archive_top_k: int = 5
    archive_max_records: int = 2000
    archive_max_age: int = 1000
    # reply gate
    gate_accept: float = 0.4
    gate_flag: float = 0.2
    gate_floor: int = 3
    # initial decay multiplier of a stored chunk
    decay_multiplier: float = 1.0
    # rows per block when a conversation is cut into pieces
    block_rows: int = 4096
    # proven upper bound of the message index over all conversations, if known
    longest: int | None = None
