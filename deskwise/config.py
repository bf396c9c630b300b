"""Every tunable of the triage flow in one immutable record."""

from __future__ import annotations

from dataclasses import dataclass, replace

from deskwise.functions import lexicon as lx


@dataclass(frozen=True)
class TriageConfig:
    """``profile`` selects one of the two behaviours the flow supports.

    * ``runtime``: all reasons are listed, best similarity is that of the first re-ranked case,
      history is limited after filtering, rounded output.
    * ``batch``: first matching reason, best similarity is the maximum over the returned cases,
      history is limited before filtering, unrounded output.
    """

    profile: str = "runtime"
    min_confidence: float = 0.50
    min_similarity: float = 0.45
    semantic_candidates: int = 50
    top_k: int = 5
    semantic_weight: float = 0.80
    intent_weight: float = 0.20
    history_limit: int | None = None
    security_terms: tuple[str, ...] = lx.SECURITY_TERMS["runtime"]
    human_terms: tuple[str, ...] = lx.HUMAN_TERMS["runtime"]
    complaint_intent: str = lx.COMPLAINT
    excluded_intent: str = lx.NON_ACTIONABLE

    def with_(self, **changes) -> TriageConfig:
        return replace(self, **changes)


RUNTIME = TriageConfig()
BATCH = TriageConfig(
    profile="batch",
    security_terms=lx.SECURITY_TERMS["batch"],
    human_terms=lx.HUMAN_TERMS["batch"],
)
