"""All registered queries and their oracles."""

from __future__ import annotations

from . import views  # noqa: F401  (registers the shared views)
from . import q_audits, q_cells, q_effects, q_synthesis, q_text  # noqa: F401
from .registry import QUERIES, oracles

__all__ = ["QUERIES", "oracles"]
