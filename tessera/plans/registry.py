"""Queries by name, each with the SQL that gives the same rows."""

from __future__ import annotations

from tessera.plans.base import ORACLES, QUERIES


def _load() -> None:
    from tessera.plans import codes, datasets, entities, features, joins, pooling, rankers, retrieval, scalars, scans, sketches, windows  # noqa: F401


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
