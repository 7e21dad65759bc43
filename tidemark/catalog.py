"""All queries over the reference tables and their oracle SQL."""

from __future__ import annotations

from .plans import bundles, decision, evaluation, forecasting, ingest, issues, learning, outcomes, panel, readiness, scoring, series, visibility, walks  # noqa: F401  they register themselves
from .registry import ORACLES, QUERIES

FLAGSHIP = "q_signal_panel"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
