"""All registered queries of the retrieval engine with their DuckDB equivalents."""

from __future__ import annotations

from .plans import answers, claims, corpus, evaluation, evidence, guidance, index, limits, quotes, ranking, reading, rules, scopes, state, structure, text, titles, units  # noqa: F401  (importing registers)
from .registry import ORACLES, QUERIES

FLAGSHIP = "hybrid_flagship"

__all__ = ["FLAGSHIP", "ORACLES", "QUERIES"]
