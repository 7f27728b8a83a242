"""All registered queries of the library and their SQL."""

from __future__ import annotations

from . import core, genome_queries  # noqa: F401  (they register)
from .registry import FULL, ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def full_queries() -> dict:
    return dict(FULL)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
