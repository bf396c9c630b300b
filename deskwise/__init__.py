"""Support-conversation triage on Spark: DataFrame in, DataFrame out."""

from deskwise.config import TriageConfig

__all__ = ["TriageConfig"]
