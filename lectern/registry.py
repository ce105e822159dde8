"""All queries over the driver's tables, by name, with their oracle SQL."""

from __future__ import annotations

from lectern.queries import base, boxes, documents, files, more, pictures, reading, sources  # noqa: F401


def queries() -> dict:
    return dict(base.QUERIES)


def oracle_sql() -> dict:
    return dict(base.ORACLES)
