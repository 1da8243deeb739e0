"""Registered queries with the SQL that checks them."""

from __future__ import annotations

from .base import ORACLES, QUERIES


def load_all() -> None:
    from . import aggregates, experiments, joins, models, projections, reshape, scans, windows  # noqa: F401


__all__ = ["ORACLES", "QUERIES", "load_all"]
