"""Importing this module registers every query of the library outside ``tidemark.llm``."""

from tidemark.plans import q_book, q_joins, q_labels, q_more, q_regress, q_rest, q_risk, q_series, q_shocks, q_strategy, q_study, q_tape  # noqa: F401
from tidemark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
