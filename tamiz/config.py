"""Thresholds and weights an operator may be given; defaults reproduce the shipped rules."""

from __future__ import annotations

from dataclasses import dataclass

from . import constants as C


@dataclass(frozen=True)
class TriageConfig:
    """All tunables in one value; pass a changed copy (``dataclasses.replace``) to any plan."""

    # "exact" looks authentication headers up under their lower-case names only;
    # "insensitive" accepts any spelling.
    header_case: str = "exact"
    # True: take the sender domain from the address part instead of the first "@".
    address_only: bool = False

    keywords: tuple[str, ...] = tuple(C.PHISHING_KEYWORDS)
    subject_keywords: tuple[str, ...] = tuple(C.SUBJECT_KEYWORDS)
    heuristic_words: tuple[str, ...] = tuple(C.HEURISTIC_WORDS)

    knn_k: int = 5
    knn_threshold: float = 0.85
    training_cap: int = 1000
    feedback_cap: int = 100
    accuracy_window: int = 20

    validator_weight: float = 0.25
    validator_safe: float = 0.85
    validator_review: float = 0.70
    knn_vote_floor: float = 0.60

    quality_min_confidence: float = 0.65
    quality_review_confidence: float = 0.70
    quality_min_headers: int = 5

    brand: str = "Triage"
    customer_id: int = 1
    case_classification_id: int = 30
    alert_severity: str = "high"


DEFAULT = TriageConfig()
