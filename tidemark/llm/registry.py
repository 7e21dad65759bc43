"""The queries of the text operators and their SQL."""

from __future__ import annotations

from .queries import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)
