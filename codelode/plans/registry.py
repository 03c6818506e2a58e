"""Registered queries of the engine's own operators."""

from __future__ import annotations

from codelode.plans import advising, facts, ingesting, linking, repository, scanning

_PARTS = [linking, repository, scanning, ingesting, advising, facts]


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.queries().items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.oracle_sql().items()}
